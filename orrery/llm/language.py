"""Language of documents and of their segments, by hyperdimensional profiles.

Every letter of a small alphabet is a random vector of +1 and -1. A trigram binds its letters' vectors, permuted by
place, by multiplication; a text bundles the vectors of its trigrams by addition; languages are prototypes bundled from
labelled texts, and a text is compared with them by cosine. The dot product is linear in the bundle, so the products of
all trigrams with all prototypes are one small table, and a segment's product is a sum of table rows.

Prose is what remains without code lines, fenced code, inline code, paths, identifiers and numbers; comments are prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Languages that are told apart unless others are named.
LANGUAGES = ("en", "de", "fr", "es", "pt", "ko", "ja")
# Three-letter codes.
CODES3 = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "kor": "ko", "jpn": "ja"}
#: What a text or segment of too little confidence is called.
UNKNOWN = "und"
#: Least share of the prose for a language to be in a text.
LEAST_SHARE = 0.15
#: Bound of the training sample: labelled documents of each language, and their length in characters.
TRAIN_DOCUMENTS, TRAIN_CHARS = 300, 8000
DIMENSION, SEED = 2048, 7
#: Characters of text handled at once.
SLICE = 1 << 17

# Letters: a break, a to z, Hangul by first consonant (19), kana in groups of eight code points (12), Han in four, others.
BREAK, HANGUL, KANA, HAN, OTHER, SIZE, DROP = 0, 27, 46, 58, 62, 63, 255


def _alphabet() -> np.ndarray:
    """Code point to letter: base letters without accents and case, groups of Hangul, kana and Han, one for others."""
    import unicodedata

    out = np.zeros(0x10000, np.uint8)
    for c in range(0x80, 0x10000):
        kind = unicodedata.category(chr(c))
        if kind == "Mn":
            out[c] = DROP
        elif kind[0] == "L":
            base = unicodedata.normalize("NFD", chr(c))[0].lower()
            out[c] = ord(base[0]) - 96 if "a" <= base[0] <= "z" else OTHER
    for c in range(26):
        out[97 + c] = out[65 + c] = c + 1
    out[[0xDF, 0x1E9E]], out[[0xE6, 0xC6]], out[[0x153, 0x152]] = 19, 1, 15
    points = np.arange(0x10000)
    out[0xAC00:0xD7A4] = HANGUL + (points[0xAC00:0xD7A4] - 0xAC00) // 588
    out[0x1100:0x1113] = HANGUL + points[:19]
    out[0x1160:0x1200] = DROP  # vowels and finals of decomposed syllables
    out[0x3130:0x3190] = HANGUL
    for start, end in ((0x3041, 0x30A0), (0x30A1, 0x3100)):
        out[start:end] = KANA + (points[start:end] - start) // 8
    out[0x31F0:0x3200] = out[0xFF66:0xFFA0] = KANA
    for start, end in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00)):
        out[start:end] = HAN + points[start:end] % 4
    out[0x3099:0x309B] = DROP
    return out


# What a code point is for telling prose from code.
SPACE, NEWLINE, TICK, SYMBOL, JOINER, UPPER, LOWER, DIGIT, WIDE, STOP = 1, 2, 4, 8, 16, 32, 64, 128, 256, 512


def _kinds(letters: np.ndarray) -> np.ndarray:
    out = np.zeros(0x10000, np.uint16)
    out[[32, 9, 13, 11, 12, 0xA0, 0x3000]] = SPACE
    out[10] = SPACE | NEWLINE
    out[96] = TICK
    out[[ord(c) for c in "{}();=<>[]|&$@\\^~%+"]] = SYMBOL
    out[[ord(c) for c in "_/"]] = JOINER
    out[48:58], out[65:91], out[97:123] = DIGIT, UPPER, LOWER
    out[(letters >= HANGUL) & (letters < OTHER)] = WIDE
    out[0x1160:0x1200] = WIDE
    out[[ord(c) for c in ".?!"]] = STOP
    out[[0x3002, 0xFF01, 0xFF1F]] = STOP | WIDE
    return out


ALPHABET = _alphabet()
KINDS = _kinds(ALPHABET)
# Lines of code by their first word, unless a comment; a shell or list mark may stand before it.
CODE_LINE = re.compile(
    r"^[ \t]*(?:(?:import|from|return|const|let|var|def|class|pub|fn|func|function|package|use|mod|impl|struct|enum|interface|type|if|elif|else|for|while|switch|case|try|except|catch|finally|with|raise"
    r"|throw|export|async|await|yield|break|continue|pass|static|private|public|protected|set|mkdir|cd|echo|git|npm|npx|pip|make|docker|sudo|rm|cp|mv|curl|source|unset|print|printf|assert|del|self|this|void|int"
    r"|string|bool|float)\b(?![ \t]*[,.:]?[ \t]+[^\n]*[a-z][.?!][ \t\r]*$)|[.\w/-]+\([^\n]*[);{,][ \t\r]*$|\./|[{}()\[\]<$@])[^\n]*$", re.M)
FENCE = re.compile(r"^[ \t]*(?:```|~~~)[^\n]*$", re.M)
COMMENT = re.compile(r"^[ \t]*(?://+|#+|--|;+|/?\*+|<!--)(?=[ \t]|\w)", re.M)


def segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, trigram codes, first code of each segment); start and end in characters of the document.

    A segment is a sentence or the rest of a line, as far as it has prose; only such segments are given.
    """
    joined = "\n".join(texts) + "\n"
    u = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    u = np.minimum(u, 0xFFFF).astype(np.uint16)
    kinds, letters = KINDS[u], ALPHABET[u]
    newline = (kinds & NEWLINE) > 0
    line_end = np.flatnonzero(newline)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    lengths = line_end + 1 - line_start
    doc_start = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
    of_line = lambda at: np.searchsorted(line_start, at, "right") - 1

    def matching(expression: re.Pattern) -> np.ndarray:
        out = np.zeros(len(line_start), bool)
        out[of_line(np.fromiter((m.start() for m in expression.finditer(joined)), np.int64))] = True
        return out

    # lines: fenced, commented, code
    comment, code, inside = matching(COMMENT), matching(CODE_LINE), np.zeros(len(line_start), bool)
    if "```" in joined or "~~~" in joined:
        fence = matching(FENCE)
        opened = np.cumsum(fence)
        first_line = of_line(doc_start)
        before = np.zeros(len(line_start), np.int64)
        before[first_line] = opened[first_line] - fence[first_line]
        inside = (opened - np.maximum.accumulate(before)) % 2 == 1
        code |= fence
        comment &= ~fence
    # inline code: between two ticks of a line, if their number is even
    inline = np.zeros(len(u), bool)
    ticks = np.flatnonzero(kinds & TICK)
    if len(ticks):
        row, first, n = np.unique(of_line(ticks), return_index=True, return_counts=True)
        rank = np.arange(len(ticks)) - np.repeat(first, n)
        even = np.repeat(n % 2 == 0, n)
        marks = np.zeros(len(u) + 1, np.int8)
        marks[ticks[even & (rank % 2 == 0)]] += 1
        marks[ticks[even & (rank % 2 == 1)] + 1] -= 1
        inline = np.cumsum(marks[:-1], dtype=np.int8).view(bool)
        inline[ticks] = True
    plain = letters > 0
    symbols = (kinds & SYMBOL) > 0
    code |= np.add.reduceat(symbols & ~inline, line_start, dtype=np.int32) * 12 > np.add.reduceat(plain & ~inline, line_start, dtype=np.int32)
    code = (code | inside) & ~comment
    bad = np.repeat(code, lengths)
    bad |= inline
    # words: runs without spaces and without a change between wide and other characters; odd ones are code
    wide, space, stop = (kinds & WIDE) > 0, (kinds & SPACE) > 0, (kinds & STOP) > 0
    class_ = space.view(np.uint8) | (wide.view(np.uint8) << 1) | (inline.view(np.uint8) << 2)
    word_start = np.concatenate(([0], np.flatnonzero(class_[1:] != class_[:-1]) + 1))
    odd = (kinds & (JOINER | SYMBOL | DIGIT)) > 0
    odd[1:] |= ((kinds[:-1] & LOWER) > 0) & ((kinds[1:] & UPPER) > 0)
    odd[1:-1] |= stop[1:-1] & plain[:-2] & plain[2:]
    odd &= ~wide
    strange = np.zeros(len(word_start), bool)
    strange[np.searchsorted(word_start, np.flatnonzero(odd & ~bad), "right") - 1] = True
    bad |= np.repeat(strange, np.diff(np.append(word_start, len(u))))
    dropped = letters == DROP
    letters[bad & ~dropped] = BREAK
    # segments end at line ends and after a stop before a space, or after a wide stop
    cut = np.zeros(len(u), bool)
    cut[1:] = newline[:-1] | (stop[:-1] & (wide[:-1] | space[1:]))
    keep = letters != BREAK
    keep[1:] |= keep[:-1]  # one break after each word
    keep |= cut
    keep &= ~dropped
    at = np.flatnonzero(keep)
    a, s = letters[at].astype(np.int32), np.cumsum(cut, dtype=np.int32)[at]
    mid = np.flatnonzero(a[1:-1] != BREAK)
    codes = (a[mid] * SIZE + a[mid + 1]) * SIZE + a[mid + 2]
    if not len(codes):
        none = np.zeros(0, np.int64)
        return none, none, none, codes, none
    s, at = s[mid + 1], at[mid + 1]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    start = at[first]
    end = at[np.append(first[1:], len(s)) - 1] + 1
    doc = np.searchsorted(doc_start, start, "right") - 1
    return doc, start - doc_start[doc], end - doc_start[doc], codes, first


class Profiles:
    """Letter vectors, and the products of all trigrams with the prototypes of the languages."""

    def __init__(self, counts: np.ndarray, names: Sequence[str] = LANGUAGES) -> None:
        """``counts``: trigrams x languages, called ``names``, of the training texts; a language without any is never found."""
        self.names = tuple(names)
        vectors = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SIZE, DIMENSION))
        once, twice = np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)
        seen, total = np.flatnonzero(counts.any(axis=1)), counts.sum(axis=0)
        weights = np.sqrt(counts[seen] / np.maximum(total, 1)).astype(np.float32)
        parts = [slice(i, i + 4096) for i in range(0, len(seen), 4096)]
        bound = lambda p: (twice[seen[p] // SIZE**2] * once[seen[p] // SIZE % SIZE] * vectors[seen[p] % SIZE]).astype(np.float32)
        prototypes = sum((weights[p].T @ bound(p) for p in parts), np.zeros((counts.shape[1], DIMENSION), np.float32))
        prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
        known = total > 0
        if known.sum() > 1:
            prototypes[known] -= prototypes[known].mean(axis=0)
        prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
        # trigrams of no training text would only add noise: their products stay 0
        self.table = np.zeros((SIZE**3, counts.shape[1]), np.float32)
        for p in parts:
            self.table[seen[p]] = bound(p) @ prototypes.T / np.sqrt(DIMENSION)
        self.table[:, ~known] = -1.0

    def cosines(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cosines of each segment with each language, trigrams of each segment); a bundle's norm is that of distinct trigrams."""
        n = np.diff(np.append(first, len(codes)))
        return np.add.reduceat(self.table[codes], first, axis=0) / np.sqrt(n)[:, None], n


def trained(texts: list[str], labels: list[str], rounds: int = 3, names: Sequence[str] = LANGUAGES) -> Profiles:
    """Prototypes from labelled texts; after the first round each sentence counts for the language it is closest to.

    Labels may be wrong for some texts, as long as most of each language's are right.
    """
    doc, _, _, codes, first = segments(texts)
    counts = np.zeros((SIZE**3, len(names)), np.float32)
    if not len(first):
        return Profiles(counts, names)
    label = np.array([list(names).index(x) for x in labels])[doc]
    seg = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes))))
    given = np.unique(label)
    for i in range(rounds):
        counts[:] = 0
        for l in given:
            counts[:, l] = np.bincount(codes[label[seg] == l], minlength=SIZE**3)
        profiles = Profiles(counts, names)
        if i + 1 < rounds:
            label = _best(*profiles.cosines(codes, first))[0]
    return profiles


def _best(cosines: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, confidence): the margin of the best cosine over the second, relative to it."""
    order = np.argsort(cosines, axis=1)
    rows = np.arange(len(cosines))
    best, second = cosines[rows, order[:, -1]], cosines[rows, order[:, -2]]
    return order[:, -1], np.clip((best - second) / np.maximum(np.abs(best), 1e-9), 0, 1)


#: A sentence with fewer trigrams or a smaller margin takes the language of the text around it.
SURE_TRIGRAMS, SURE_MARGIN = 20, 0.25


def label_texts(texts: list[str], profiles: Profiles) -> tuple[np.ndarray, ...]:
    """(document, start, end, language, confidence, weight) of each sentence with prose, in order.

    The weight is the sentence's prose in UTF-8 bytes, so that wide scripts weigh like others.
    """
    doc, start, end, codes, first = segments(texts)
    if not len(first):
        none = np.zeros(0, np.int64)
        return doc, start, end, none, none.astype(float), none
    cosines, n = profiles.cosines(codes, first)
    middle = codes // SIZE % SIZE
    wide = np.add.reduceat((middle >= HANGUL) & (middle < OTHER), first)
    weight = n + 2 * wide
    best, sure = _best(cosines, n)
    unsure = (n < SURE_TRIGRAMS) | (sure < SURE_MARGIN)
    k = len(profiles.names)
    short = unsure & (2 * wide > n)
    if short.any():
        # short sentences in wide scripts are judged together, those of a text that are closest to one language
        group, of = np.unique(doc[short] * k + best[short], return_inverse=True)
        together, size = np.zeros((len(group), k)), np.bincount(of, n[short])
        np.add.at(together, of, cosines[short] * np.sqrt(n[short])[:, None])
        one, margin = _best(together / np.sqrt(size)[:, None], size)
        good = (size >= SURE_TRIGRAMS) & (margin >= SURE_MARGIN) & (one == group % k)
        unsure[np.flatnonzero(short)[good[of]]] = False
    if unsure.any():
        # the document's sure sentences vote by weight; where there are none, the sum of all products decides
        docs = int(doc[-1]) + 1
        votes = np.zeros((docs, k))
        np.add.at(votes, (doc[~unsure], best[~unsure]), weight[~unsure])
        sums = np.zeros((docs, k))
        np.add.at(sums, doc, cosines * np.sqrt(n)[:, None])
        main = np.where(votes.any(axis=1), votes.argmax(axis=1), sums.argmax(axis=1))
        # among the languages that the document surely has, the closest; else the main one
        allowed = votes > 0
        allowed[np.arange(docs), main] = True
        masked = np.where(allowed[doc], cosines, -np.inf)
        best = np.where(unsure, masked.argmax(axis=1), best)
    return doc, start, end, best, sure, weight


def normal_label(lang: Column) -> Column:
    """The two-letter language a label names; null for null, blank and und. Region, case and three-letter forms count."""
    head = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    code = head
    for long, short in CODES3.items():
        code = F.when(head == long, short).otherwise(code)
    return F.when((head == "") | (head == "und"), None).otherwise(code)


def profiles_of(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCUMENTS, chars: int = TRAIN_CHARS, names: Sequence[str] = LANGUAGES) -> Profiles:
    """Prototypes of the languages ``names`` from at most ``per_language`` labelled texts of at most ``chars`` characters for each language.

    The sample is the texts with the smallest hashes of their keys, so it depends on no order and no machine.
    """
    rows = documents.select(F.xxhash64(key).alias("_h"), normal_label(F.col(lang)).alias("_l"), F.col(text).alias("_t"))
    rows = rows.filter(F.col("_l").isin(*names) & (F.length("_t") <= chars))
    counts = dict(rows.groupBy("_l").count().collect())
    if not counts:
        return trained([], [], names=names)
    share = F.lit(0.0)
    for l, n in counts.items():
        share = F.when(F.col("_l") == l, F.lit(min(1.0, (per_language * 1.2 + 20) / n))).otherwise(share)
    near = rows.filter(F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53)) < share)
    w = Window.partitionBy("_l").orderBy("_h", "_t")
    sample = near.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_language).orderBy("_l", "_n").select("_t", "_l").collect()
    return trained([r[0] for r in sample], [r[1] for r in sample], names=names)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    at, texts, size = 0, [], 0
    for i, text in enumerate(batch.column(1).to_pylist()):
        texts.append(text or "")
        size += len(texts[-1])
        if size >= SLICE:
            yield at, texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield at, texts


def _named(profiles: Profiles, language: np.ndarray, confidence: np.ndarray, least: float) -> pa.Array:
    names = np.array([*profiles.names, UNKNOWN], object)
    return pa.array(names[np.where(confidence < least, len(names) - 1, language)], pa.string())


def languages(documents: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text", least_confidence: float = 0.0) -> DataFrame:
    """(key, language, share DOUBLE, confidence DOUBLE) of each language of each text's prose, whatever its share.

    What has less than ``least_confidence`` is ``und``: in none of the languages, or in too few words to tell.

    A text without prose, a null and an empty text give no rows; equal rows give equal rows. Other columns are ignored.
    Texts stay in their partition.
    """
    shared = documents.sparkSession.sparkContext.broadcast(profiles)
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch):
                doc, _, _, best, sure, weight = label_texts(texts, shared.value)
                k = len(shared.value.names)
                mass = np.bincount(doc * k + best, weight, len(texts) * k).reshape(-1, k) if len(doc) else np.zeros((len(texts), k))
                belief = np.bincount(doc * k + best, weight * sure, len(texts) * k).reshape(-1, k) if len(doc) else mass
                d, l = np.nonzero(mass)
                confidence = belief[d, l] / mass[d, l]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(d + at)), _named(shared.value, l, confidence, least_confidence), pa.array(mass[d, l] / mass.sum(axis=1)[d], pa.float64()), pa.array(confidence, pa.float64())],
                    names=[key, "language", "share", "confidence"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, language string, share double, confidence double")


def language_segments(documents: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text", least_confidence: float = 0.0) -> DataFrame:
    """(key, segment_no INT from 1, start INT, end INT, language, confidence DOUBLE): stretches of prose in one language.

    Neighbouring sentences of one language are one segment; offsets count characters of the text. Texts as in ``languages``.
    """
    shared = documents.sparkSession.sparkContext.broadcast(profiles)
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch):
                doc, start, end, best, sure, weight = label_texts(texts, shared.value)
                if not len(doc):
                    continue
                new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (best[1:] != best[:-1]))))
                d = doc[new]
                confidence = np.add.reduceat(sure * weight, new) / np.add.reduceat(weight, new)
                first_of_doc = np.maximum.accumulate(np.where(np.concatenate(([True], d[1:] != d[:-1])), np.arange(len(d)), 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(d + at)), pa.array(np.arange(len(d)) - first_of_doc + 1, pa.int32()), pa.array(start[new], pa.int32()),
                     pa.array(end[np.append(new[1:], len(doc)) - 1], pa.int32()), _named(shared.value, best[new], confidence, least_confidence), pa.array(confidence, pa.float64())],
                    names=[key, "segment_no", "start", "end", "language", "confidence"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, segment_no int, start int, end int, language string, confidence double")


def mislabelled(found: DataFrame, documents: DataFrame, key: str = "doc_id", lang: str = "lang", least: float = LEAST_SHARE) -> DataFrame:
    """(key, true_lang): each language with at least ``least`` of the prose, of each text that has two such or whose
    label doesn't name its one. Texts with null keys are left out."""
    big = found.filter((F.col("share") >= least) & F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("language").alias("_all"))
    labels = documents.filter(F.col(key).isNotNull()).select(key, normal_label(F.col(lang)).alias("_label"))
    cases = big.join(labels, key).filter((F.size("_all") > 1) | F.col("_label").isNull() | (F.col("_label") != F.col("_all")[0]))
    return cases.select(key, F.explode("_all").alias("true_lang")).distinct()
