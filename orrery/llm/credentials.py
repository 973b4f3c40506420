"""Credentials embedded in source code: found and redacted without touching the code around them.

The whole grammars of token formats, key armor and connection strings are one deterministic automaton (``grammars``),
the words near which passwords stand another (``cues``). Both run over overlapping chunks of the joined texts. The first
gives where a value begins and ends, whatever its length: a span is what lies between two accepts, and is checked
against its exact format. What the automaton passed over because a match that came to nothing held it is searched by
the same formats. The lines of cues are read by expressions for assignments, headers, flags and sentences. All absolute
spans are deduplicated and judged: placeholders, masks, references, labels, hashes and ids are none. Redaction splices
a placeholder into each span.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.automaton import Automaton, Grammar, width

PLACEHOLDER = "[REDACTED]"
#: Bytes of text scanned at once.
SLICE = 8 << 20

# Published formats of tokens. (head, whole token)
TOKENS = [
    (r"(?:AKIA|ASIA)", r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    (r"gh[pousr]_", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    (r"github_pat_", r"github_pat_[A-Za-z0-9_]{22,}"),
    (r"glpat-", r"glpat-[A-Za-z0-9_-]{20,}"),
    (r"xox[abeoprs]-", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    (r"[sr]k_(?:live|test)_", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    (r"npm_", r"npm_[A-Za-z0-9]{36}"),
    (r"eyJ", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    (r"AIza", r"AIza[0-9A-Za-z_-]{35}"),
    (r"SG\.", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    (r"hf_", r"hf_[A-Za-z0-9]{30,}"),
    (r"pypi-", r"pypi-[A-Za-z0-9_-]{50,}"),
    (r"dop_v1_", r"dop_v1_[a-f0-9]{64}"),
    (r"shp(?:at|ca|pa|ss)_", r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}"),
]


def _plain(expression: str) -> str:
    """Without marks that only tell the expression engine not to go back."""
    return expression.replace("}+", "}")


# Ends of names whose values are secret.
SECRET_NAMES = ("password", "passwd", "passphrase", "passcode", "pwd", "pass", "secret", "token", "apikey", "accesskey", "secretkey", "privatekey",
                "encryptionkey", "signingkey", "authkey", "masterkey", "sharedkey", "accountkey", "servicekey", "smtppw", "dbpw", "userpw", "rootpw", "adminpw", "credential", "cred", "apisecret")
NOT_SECRET_NAMES = ("bypass", "compass", "encompass", "surpass", "publictoken", "nexttoken", "pagetoken", "continuationtoken")

# Words for a password in the languages of the texts.
PASSWORD_WORDS = ("password", "passphrase", "passwort", "kennwort", "zugang", "contraseña", "contrasena", "clave", "mot de passe", "senha", "パスワード", "비밀번호", "암호")

_GAP = r"""[^ \t\r\n\f\v/"'<>]"""
# A key block in base64.
WRAPPED = ("LS0tLS1CRUdJTiB", r"LS0tLS1CRUdJTiB[A-Za-z0-9+/]{60,}={0,2}")
GRAMMARS = [
    *(Grammar(f"token {i}", head, _plain(whole[len(head):]), f"token {i} ends", exclusive=True) for i, (head, whole) in enumerate([*TOKENS, WRAPPED])),
    # a user and a password before a host
    Grammar("url", "//", r"""[^ \t\r\n\f\v:/?#\[\]@"'<>]*:""" + _GAP + "+@[A-Za-z0-9\\[$]", "url ends", exclusive=True),
    Grammar("armor", "----BEGIN ", "(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", "armor ends", exclusive=True),
]
FORMATS = [re.compile(whole.encode()) for _, whole in [*TOKENS, WRAPPED]]
HEAD_LENGTHS = [width(head) for head, _ in [*TOKENS, WRAPPED]]
CUES = [
    Grammar("named", "(?i:pass|pwd|pw|secret|token|key|cred)"),
    Grammar("said", r"(?i:login[ \t]|bearer[ \t]|basic[ \t]|token[ \t])|-u[ \t]|--(?:user|auth|token|password|passwd|api-key|apikey|secret|access-token|auth-token|client-secret)[ =]", bounded=True),
    Grammar("mention", "(?i:" + "|".join(w.encode().decode("latin-1") for w in PASSWORD_WORDS) + ")"),
    Grammar("joined", r"""[ \t"']\+[ \t"']"""),
]

#: Any format, for what the automaton passed over.
LEFT_RE = re.compile(("(?<![A-Za-z0-9])(?:" + "|".join([*(t for _, t in TOKENS), WRAPPED[1]]) + ")(?![A-Za-z0-9])").encode())
LEFT_URL_RE = re.compile(rb"""[A-Za-z0-9]://[^\s:/?#\[\]@"'<>]*+:(?P<v>[^\s/"'<>]+)@(?=[A-Za-z0-9\[$])""")
SCHEME_RE = re.compile(rb"[A-Za-z0-9]:")
ARMOR_BYTES_RE = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
STOP_RE = re.compile(rb"""[\s"'<>]""")
ARMOR_RE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_NAME = r"(?<![\w$])(?P<k>(?=[\w$-]{0,63}(?i:pass|pwd|pw|secret|token|key|cred))[A-Za-z_$][\w$-]{0,63})"
_QUOTED = r"""[bru]{0,2}(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q))[^\\\n])++)(?P=q)"""
_TYPE = r"(?:\s*:\s*&?(?:'?static\s+)?[A-Za-z_][\w<>\[\], |.]{0,40}?|\s+(?:string|str|String))?"
_LOOKUP = r"""(?:[^"'`\n=]{0,120}?(?:\|\||\?\?|\?:|\bor\b)\s*|[\w.$:]{0,40}(?:environ\.get|getenv|get_env|env|ENV\.fetch|lookup)\(\s*["'][\w.-]{1,64}["']\s*(?:,|\)\s*(?:\|\||\?\?|\?:|\bor\b))\s*)?"""
NAMED_RE = re.compile(r"(?i:pass|pwd|pw|secret|token|key|cred)[^\n:=>|?,)]*+[:=>|?,)]")
QUOTED_RE = re.compile(_NAME + r"""["'\]]{0,3}""" + _TYPE + r"\s*(?::=|=>|\?\?=?|\|\|=?|\?:|=(?!=)|:(?![:=]))\s*" + _LOOKUP + _QUOTED)
ENV_RE = re.compile(r"""(?:environ\.get|getenv|get_env|\benv|ENV\.fetch|lookup)\(\s*["']""" + _NAME + r"""["']\s*(?:,|\)\s*(?:\|\||\?\?|\?:|\bor\b))\s*""" + _QUOTED)
BARE_RE = re.compile(_NAME + r"""["'\]]{0,3}[ \t]*(?:=(?![=>])|:(?![:=]))[ \t]*(?P<v>[^\s"'`<>,;(){}\[\]]{8,})(?P<after>[,;]?(?=\s|$|["'`&]))""")
DEFAULT_RE = re.compile(r"\$\{" + _NAME + r":[-=](?P<v>[^}\s\"']++)\}")
XML_ATTRIBUTE_RE = re.compile(r"""\b(?:key|name|id)\s*=\s*(["'])(?P<k>[\w.:-]{1,64})\1[^<>]{0,200}?\bvalue\s*=\s*(?P<q>["'])(?P<v>[^"'<>]++)(?P=q)""")
XML_ELEMENT_RE = re.compile(r"<(?P<k>[\w.:-]{1,64})(?:\s[^<>]*)?>(?P<v>[^<>\s]++)</")
SAID_RES = [
    re.compile(r"\blogin\s+\S+\s+password\s+(?P<v>\S+)"),
    re.compile(r"""(?:^|\s)(?:-u|--user)[ =]+["']?[^\s:"']++:(?P<v>[^\s"']+)"""),
    re.compile(r"""(?:^|\s)--(?:auth|token|password|passwd|api-key|apikey|secret|access-token|auth-token|client-secret)[ =]+["']?(?P<v>[^\s"']{8,})"""),
]
_MENTION = "(?i:" + "|".join(PASSWORD_WORDS) + r""")[^\n:\uff1a="'`]{0,40}?(?:[:\uff1a]|\s(?:is|ist|est|es|\u00e9)\s|\u306f)\s*(?:[\w.@-]{1,64}\s*/\s*)?"""
MENTION_RE = re.compile(_MENTION + r"""(?P<v>[^\s"'`<>/]{8,})\s*$""")
# One within a sentence, in quotes or not; what ends the sentence is no part of it.
MENTION_WITHIN_RE = re.compile(_MENTION + r"""["'`]?(?P<v>(?:(?!["'`<>/])[!-~]){8,}+)""")
METHOD_RE = re.compile(r"^(?:argon\d|[bs]crypt|pbkdf|sha-?\d|md\d|aes[-_\d]|hmac|utf-?\d|base\d\d)", re.I)
OPEN_RE = re.compile(_NAME + r"""["'\]]{0,3}""" + _TYPE + r"\s*(?::=|=|:)\s*+(?:[>|][+-]?|\(|\\)?\s*$")
NEXT_RE = re.compile(r"""\s*(?P<q>["'`]?)(?P<v>[^\s"'`]{8,}+)(?P=q)[,;)]*\s*$""")
HEADER_RE = re.compile(r"\b(?P<s>Bearer|Basic|Token|bearer|basic|token)\s+(?P<v>[A-Za-z0-9+/=._~-]{8,})")
JOIN_RE = re.compile(r"""(["'])[ \t]*\+[ \t]*(["'])""")
COMMENT_RE = re.compile(r"\s*(?:[-*>]\s+)?(?:#|//|;|--|/\*|\*|<!--)")
KEY_RUN_RE = re.compile(r"[A-Za-z0-9+/=]{32,}")
# A line that may stand between BEGIN and the body of a key: a header, or nothing but marks.
HEADER_LINE_RE = re.compile(r"""[^\w\n]*(?:[A-Z][\w-]*: [^\n]*)?|[^\w\n]*n[^\w\n]*""")
# A further line of a key's body, behind the rest of the one before; the line break may be an escape in a literal.
KEY_LINE_RE = re.compile(r"""[ \t"'`,;+.()\\]*?(?:\\r)?(?:\\n|\r?\n)[ \t"'`+.()#*>|\n\r]*(?:// )?(?P<b>[A-Za-z0-9+/]+={0,2})(?![^\s"'`\\,;+)])""")
TRAILING_RE = re.compile(r"(?:^|\s)(?:#|//|--|/\*|<!--)\s")
# Languages in which a value without quotes is no literal.
CODE = frozenset("python py go rust rs typescript javascript ts tsx js jsx java kotlin kt csharp cs swift ruby rb php c cpp h hcl tf json toml".split())

PLACEHOLDER_RE = re.compile(
    r"^[x*.#_-]+$|\*{3}|x{6}|^\.{2,}|\.{3}$|…|<[^>]*>|\{\{|%\(|%[A-Z_]+%|^!(?:ref|sub|getatt|secret|vault|env|include)|change[-_ ]?(?:me|this)|replace[-_ ]?(?:me|this|with)|your[-_ ]|example|placeholder"
    r"|dummy|insert[-_ ]|^todo|redacted|masked|not[-_ ]?set|^(?:none|null|true|false|undefined|password|passwd|secret|token|string|pass|pwd)$", re.I)
# A value that is a variable or a command, or one into which an expression is put.
VARIABLE_RE = re.compile(r"^\$(?:[A-Z_][A-Z0-9_]*|[a-z]+(?:[A-Z][a-z]+)*|[a-z]+(?:_[a-z0-9]+)+|\(.*)$|\$\{[A-Za-z_][^{}]*\}")
REFERENCE_RE = re.compile(r"^(?:process|os|env|var|local|locals|module|settings|config|cfg|self|this|secrets|vault|data|ENV|System|params|ctx|context|import|Rails)\b[.\[(]|^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$")
NO_SECRET_RE = re.compile(r"^[a-z]+(?:[-_][a-z]+)*[-_]\d{1,6}$|^(?:sha\d+|md5|hmac|aes|rs|hs|es)[-_:/]|^data:|^[a-z][a-z0-9+.-]*://|^\.{0,2}/?(?:[\w.-]+/)+[\w-]+\.[A-Za-z]{1,5}$|^/[\w./-]+$|^\d[\d.,:_-]*$", re.I)


@dataclass(frozen=True)
class Credential:
    """A span of a text, in characters; ``line`` is 1-based."""

    start: int
    end: int
    line: int
    kind: str


def secret_name(name: str) -> bool:
    bare = re.sub(r"[^a-z]", "", name.lower())
    return bare.endswith(SECRET_NAMES) and not bare.endswith(NOT_SECRET_NAMES)


def placeholder(value: str) -> bool:
    return bool(PLACEHOLDER_RE.search(value) or VARIABLE_RE.search(value)) or len(set(value)) < 4


def secret_value(value: str, quoted: bool) -> bool:
    """Whether a named value looks generated or chosen as a secret rather than a word, label, path or reference."""
    if len(value) < 8 or re.search(r"\s", value) or placeholder(value) or NO_SECRET_RE.search(value) or (not quoted and REFERENCE_RE.search(value)):
        return False
    digit, lower, upper = (re.search(p, value) for p in (r"\d", r"[a-z]", r"[A-Z]"))
    if digit and (lower or upper):
        return True
    mixed = lower and upper
    return bool(mixed and (re.search(r"[^A-Za-z_.\-]", value) or len(re.findall(r"[a-z][A-Z]|[A-Z]{2}[a-z]", value)) >= 4))


def _runs_on(value: str) -> bool:
    """Whether words in another script follow a value without a blank."""
    own = re.match(r"[!-~]*", value)[0]
    return len(own) < len(value) and secret_value(own.rstrip(".,;:?)"), False)


def basic(value: str) -> bool:
    try:
        user, colon, word = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode().partition(":")
    except ValueError:
        return False
    return bool(colon and word) and not placeholder(word)


def _joined(line: str) -> tuple[str, list[int]]:
    """The line with concatenated literals joined, and the place in the line of each of its characters."""
    keep = np.ones(len(line) + 1, bool)
    for m in JOIN_RE.finditer(line):
        keep[m.start() : m.end()] = False
    at = np.flatnonzero(keep)
    return "".join(line[i] for i in at[:-1]), at.tolist()


def line_values(line: str, cues: int, code: bool) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the usable credentials that the words of a line point to. ``code``: bare values are none."""
    at = None
    if cues & BIT["joined"] and JOIN_RE.search(line):
        line, at = _joined(line)
    out = []
    if cues & BIT["named"] and NAMED_RE.search(line):
        for expression in (QUOTED_RE, ENV_RE, XML_ATTRIBUTE_RE, XML_ELEMENT_RE, DEFAULT_RE):
            out += [(*m.span("v"), "named") for m in expression.finditer(line) if secret_name(m["k"]) and secret_value(m["v"], True)]
        if not code or COMMENT_RE.match(line):
            out += [(*m.span("v"), "named") for m in BARE_RE.finditer(line) if secret_name(m["k"]) and secret_value(m["v"], False)]
    if cues & BIT["said"]:
        out += [(*m.span("v"), "said") for r in SAID_RES for m in r.finditer(line) if not placeholder(m["v"])]
        known = "authorization" in line.lower()
    if cues & BIT["mention"] and (not code or COMMENT_RE.match(line)):
        out += [(*m.span("v"), "said") for m in MENTION_RE.finditer(line) if not _runs_on(m["v"]) and not placeholder(m["v"]) and not re.fullmatch(r"[^\W\d_]?[^\WA-Z\d_]+[.!?]?", m["v"])]
    if cues & BIT["mention"] and (from_ := 0 if not code or COMMENT_RE.match(line) else x.end() if (x := TRAILING_RE.search(line)) else None) is not None:
        for m in MENTION_WITHIN_RE.finditer(line, from_):
            v = m["v"].rstrip(".,;:?)")
            if secret_value(v, False) and not METHOD_RE.match(v):
                out.append((m.start("v"), m.start("v") + len(v), "said"))
    if cues & BIT["said"]:
        for m in HEADER_RE.finditer(line):
            if (m["s"] in ("Basic", "basic") and basic(m["v"])) or (m["s"][0] in "Bb" or known) and m["s"].lower() != "basic" and secret_value(m["v"], False):
                out.append((*m.span("v"), "header"))
    if at is not None:
        out = [(at[a], at[b - 1] + 1, k) for a, b, k in out]
    return out


def _key_block(text: str, end: int) -> int | None:
    """Where the body of the key block that begins before ``end`` ends; None if it has no body.

    A body has a long run of base64. Where an END follows before another block begins, the body reaches there. A block
    without END has the run on its own line or behind header, comment and blank lines, and ends with its base64 lines.
    """
    stop = text.find("-----", end)
    closed = stop >= 0 and text.startswith("-----END", stop)
    run = KEY_RUN_RE.search(text, end, stop) if closed else _open_body(text, end, len(text) if stop < 0 else stop)
    if not run or placeholder(run[0]):
        return None
    if closed:
        return stop
    at = run.end()
    while more := KEY_LINE_RE.match(text, at):
        short = len(more["b"]) < 32
        if short and (len(more["b"]) % 4 or not re.search(r"[\d+/=]", more["b"])):
            break
        at = more.end("b")
        if short:
            break
    return at


def _open_body(text: str, at: int, stop: int) -> re.Match | None:
    while at < stop:
        line_end = min(stop, n if (n := text.find("\n", at)) >= 0 else stop)
        if run := KEY_RUN_RE.search(text, at, line_end):
            return run
        if not HEADER_LINE_RE.fullmatch(text, at, line_end):
            return None
        at = line_end + 1
    return None


@cache
def grammars() -> Automaton:
    return Automaton(GRAMMARS)


@cache
def cues() -> Automaton:
    return Automaton(CUES)


BIT = {g.opens: 1 << i for i, g in enumerate(CUES)}


def grammar_spans(data: np.ndarray, of: Automaton) -> tuple[list[tuple[int, int, str]], list[int]]:
    """((start, end, kind) of the values of tokens, wrapped keys and connection strings; the ends of BEGIN lines), in bytes."""
    ends, masks = of.scan(data)
    if not len(ends):
        return [], []
    raw, spans, dead = data.tobytes(), set(), []
    at = lambda name: ends[(masks & of.bit[name]) > 0]
    for i, format_ in enumerate(FORMATS):
        opens, closes = at(f"token {i}"), at(f"token {i} ends")
        last = closes[np.append(np.diff(closes) > 1, True)] if len(closes) else closes
        begin = np.searchsorted(opens, last, "right") - 1
        length, used = HEAD_LENGTHS[i], set()
        for j, e in zip(begin.tolist(), last.tolist()):
            start = int(opens[j]) + 1 - length
            if format_.fullmatch(raw, start, e + 1) and not raw[e + 1 : e + 2].isalnum():
                spans.add((start, e + 1, "token" if i < len(TOKENS) else "key"))
                used.add(j)
        dead += [int(o) for j, o in enumerate(opens) if j not in used]
    opens, closes = at("url"), at("url ends")
    begin = np.searchsorted(opens, closes, "right") - 1
    used = dict(zip(begin.tolist(), closes.tolist()))  # the last one of each
    for j, e in used.items():
        o = int(opens[j])
        value = raw.find(b":", o + 1) + 1
        if SCHEME_RE.match(raw, max(0, o - 2), o):
            spans.add((value, e - 1, "url"))
        else:
            dead.append(o)
    dead += [int(o) for j, o in enumerate(opens) if j not in used and not raw[o + 1 : o + 2].isspace()]
    armor = [e + 1 for e in at("armor ends").tolist() if raw.startswith(b"-----", max(0, raw.rfind(b"----BEGIN ", 0, e) - 1))]
    upto = -1
    for o in sorted(dead):
        if o < upto:
            continue
        stop = m.start() if (m := STOP_RE.search(raw, o + 1)) else len(raw)
        upto = stop
        spans.update((*m.span(), "key" if m[0].startswith(WRAPPED[0].encode()) else "token") for m in LEFT_RE.finditer(raw, o, stop))
        spans.update((*m.span("v"), "url") for m in LEFT_URL_RE.finditer(raw, max(0, o - 3), min(len(raw), stop + 1)))
        if raw.endswith(b"-----BEGIN", o, stop) and (m := ARMOR_BYTES_RE.match(raw, stop - 10)):
            armor.append(m.end())
    return sorted(spans), sorted(set(armor))


def _usable(value: str, kind: str) -> bool:
    if kind == "key":
        return bool(ARMOR_RE.match(base64.b64decode(value[:72]).decode("latin-1")))
    return not placeholder(value) and not (kind == "url" and re.search(r"\s", value))


def find(texts: list[str], automata: tuple[Automaton, Automaton] | None = None) -> list[list[Credential]]:
    """The usable credentials of each text, in order and without overlaps."""
    whole, words = automata or (grammars(), cues())
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(blobs), np.uint8)
    out: list[list[Credential]] = [[] for _ in texts]
    spans, armor = grammar_spans(data, whole)
    ends, masks = words.scan(data)
    if not (spans or armor or len(ends)):
        return out
    starts = np.concatenate(([0], np.cumsum([len(b) + 1 for b in blobs])))[:-1]
    breaks = np.concatenate(([-1], np.flatnonzero(data == 10), [len(data)]))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))
    doc_of = lambda at: int(np.searchsorted(starts, at, "right")) - 1
    row_of = lambda at: int(np.searchsorted(breaks, at, "left")) - 1
    first_row = np.searchsorted(breaks, starts, "left") - 1
    # the first byte of a text may be a line break of its own
    line_of = lambda row, d: row - int(first_row[d]) + 1

    def add(begin: int, end: int, kind: str) -> None:
        d = doc_of(begin)
        value = data[begin:end].tobytes().decode("utf-8", "surrogatepass")
        if _usable(value, kind):
            out[d].append(Credential(int(chars[begin] - chars[starts[d]]), int(chars[end] - chars[starts[d]]), line_of(row_of(begin), d), kind))

    for span in spans:
        add(*span)
    for end in armor:
        d = doc_of(end - 1)
        begin = int(chars[end] - chars[starts[d]])
        if (stop := _key_block(texts[d], begin)) is not None:
            out[d].append(Credential(begin, stop, line_of(row_of(end - 1), d), "key"))
    lines: dict[tuple[int, int], int] = {}
    for m, r, d in zip(masks.tolist(), (np.searchsorted(breaks, ends, "left") - 1).tolist(), (np.searchsorted(starts, ends, "right") - 1).tolist()):
        lines[d, r] = lines.get((d, r), 0) | m
    fences: dict[int, list[tuple[int, str]]] = {}
    joins: list[tuple[int, int, int, str, list[int]]] = []
    for (d, r), mask in lines.items():
        low, high = int(breaks[r]) + 1, int(breaks[r + 1])
        before, line_no = int(chars[low] - chars[starts[d]]), line_of(r, d)
        if d not in fences:
            fences[d] = _fences(texts[d])
        code = _language(fences[d], line_no) in CODE
        line = data[low:high].tobytes().decode("utf-8", "surrogatepass")
        out[d] += [Credential(before + x, before + y, line_no, k) for x, y, k in set(line_values(line, mask, code))]
        if mask & BIT["named"] and (m := OPEN_RE.search(line)) and secret_name(m["k"]):
            at = before + len(line) + 1
            below = NEXT_RE.match((texts[d][at:] if (stop := texts[d].find("\n", at)) < 0 else texts[d][at:stop]))
            if below and secret_value(below["v"], bool(below["q"])):
                out[d].append(Credential(at + below.start("v"), at + below.end("v"), line_no + 1, "named"))
        if mask & BIT["joined"] and JOIN_RE.search(line):
            joins.append((d, line_no, before, *_joined(line)))
    if joins:
        _add_joined(joins, whole, out)
    return [_disjoint(found) for found in out]


def _add_joined(joins: list[tuple[int, int, int, str, list[int]]], whole: Automaton, out: list[list[Credential]]) -> None:
    """Values of the lines whose concatenated literals have been joined, at the places that they have in their texts."""
    blobs = [line.encode("utf-8", "surrogatepass") for _, _, _, line, _ in joins]
    starts = np.concatenate(([0], np.cumsum([len(b) + 1 for b in blobs])))[:-1]
    for begin, end, kind in grammar_spans(np.frombuffer(b"\n".join(blobs), np.uint8), whole)[0]:
        i = int(np.searchsorted(starts, begin, "right")) - 1
        d, line_no, before, _, places = joins[i]
        a, b = (len(blobs[i][: x - int(starts[i])].decode("utf-8", "surrogatepass")) for x in (begin, end))
        if _usable(blobs[i][begin - int(starts[i]) : end - int(starts[i])].decode("utf-8", "surrogatepass"), kind):
            out[d].append(Credential(before + places[a], before + places[b - 1] + 1, line_no, kind))


def _fences(text: str) -> list[tuple[int, str]]:
    """(line, language or "") of each fence line."""
    out, open_ = [], False
    for m in re.finditer(r"(?m)^[ \t]*```+[ \t]*([\w+-]*)", text):
        open_ = not open_
        out.append((text.count("\n", 0, m.start()) + 1, m[1].lower() if open_ else ""))
    return out


def _language(fences: list[tuple[int, str]], line: int) -> str:
    at = [lang for n, lang in fences if n < line]
    return at[-1] if at else ""


def _disjoint(found: list[Credential]) -> list[Credential]:
    out: list[Credential] = []
    for c in sorted(set(found), key=lambda c: (c.start, -c.end, c.kind)):
        if not out or c.start >= out[-1].end:
            out.append(c)
        elif c.end > out[-1].end:
            out[-1] = Credential(out[-1].start, c.end, out[-1].line, out[-1].kind)
    return out


def redact(text: str, found: list[Credential], by: str = PLACEHOLDER) -> str:
    """``text`` with each span replaced; all other characters stay."""
    out, at = [], 0
    for c in found:
        out += [text[at : c.start], by]
        at = c.end
    return "".join([*out, text[at:]])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    keys, texts, size = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        keys.append(key)
        texts.append(text or "")
        size += len(texts[-1])
        if size >= SLICE:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def credentials(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no INT, start INT, length INT, kind), one row per credential of each text; offsets in characters.

    Lines end at ``\\n`` and count from 1; a key block stands on its BEGIN line. Null and empty texts give no rows, the
    same row twice gives its credentials once, rows with a null key are read too. Other columns are ignored. The texts
    don't leave their partition.
    """
    kind, automata = texts.schema[key].dataType, (grammars(), cues())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, some in _slices(batch):
                rows = [(k, c) for k, found in zip(keys, find(some, automata)) for c in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], batch.schema.field(0).type), *(pa.array([f(c) for _, c in rows], t) for f, t in (
                        (lambda c: c.line, pa.int32()), (lambda c: c.start, pa.int32()), (lambda c: c.end - c.start, pa.int32()), (lambda c: c.kind, pa.string())))],
                    names=[key, "line_no", "start", "length", "kind"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, line_no int, start int, length int, kind string").distinct()


def redacted(texts: DataFrame, key: str, text: str, by: str = PLACEHOLDER) -> DataFrame:
    """(key, text, n_redacted INT): each text once with its credentials replaced; null stays null with 0.

    A repeated key counts once, with its smallest text; null keys are left out. Other columns are ignored.
    """
    kind, automata = texts.schema[key].dataType, (grammars(), cues())
    once = texts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column(1).is_null().to_pylist()
            at = 0
            for keys, some in _slices(batch):
                found = find(some, automata)
                done = [None if null[at + i] else redact(t, f, by) for i, (t, f) in enumerate(zip(some, found))]
                at += len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(done, pa.string()), pa.array([len(f) for f in found], pa.int32())], names=[key, text, "n_redacted"])

    return once.mapInArrow(run, f"`{key}` {kind.simpleString()}, `{text}` string, n_redacted int")
