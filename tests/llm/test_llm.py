"""Operators for training data against brute force, round trips and held-out labels, with nulls, ties, repeats and empty tables."""

import base64
import itertools
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import automaton, cooccurrence, copies, credentials, language, leximin, mixing, packing, relevance, sizes, split

# 1


@pytest.mark.parametrize("large", [3, 100_000])
def test_leximin(spark, large):
    rows = [(1, "a", 9000.0, 0.1, 1.0, 1), (1, "b", 8000.0, 0.9, 1.0, 1), (1, "c", 10.0, 0.95, 1.0, 1), (1, "d", 8500.0, 0.92, 0.2, 1), (1, "b", 8000.0, 0.9, 1.0, 2), (1, "e", None, None, None, 1),
            (2, "x", float("nan"), None, 1.0, 1), (2, "y", 0.0, 0.0, 1.0, 1), (None, "z", 1.0, 1.0, 1.0, 1), (3, None, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "g int, item string, r double, q double, dem double, at int").withColumn("position", F.lit("clash")).withColumn("_n", F.lit(1))
    got = {(r.g, r.item): r.position for r in leximin.leximin(df, "g", "item", ["r", "q"], "dem", "at", large).collect()}
    assert got[1, "b"] == 1 and len(got) == 7 and {got[2, "x"], got[2, "y"]} == {1, 2} and got[2, "x"] == 1
    once = {(g, i): (r or 0.0, q or 0.0, 1.0 if d is None else d) for g, i, r, q, d, _ in rows if g == 1 and i}
    pct = lambda k, x: sum(o[k] <= x for o in once.values()) / len(once)
    key = lambda gi: [-p * once[gi][2] for p in sorted((pct(0, once[gi][0]), pct(1, once[gi][1])))]
    assert [gi[1] for gi in sorted(once, key=lambda gi: (key(gi), gi[1]))] == [i for (g, i), _ in sorted(got.items(), key=lambda x: x[1]) if g == 1]
    assert leximin.leximin(df.limit(0), "g", "item", ["r", "q"], "dem", "at", large).count() == 0


def test_leximin_counts_every_score(spark):
    rows = [("a", 3.0, 3.0, 1.0), ("b", 2.0, 2.0, 2.0), ("c", 1.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "item string, x double, y double, z double").withColumns({"g": F.lit(1), "dem": F.lit(1.0), "at": F.lit(1)})
    third = {r.item: r.position for r in leximin.leximin(df, "g", "item", ["x", "y", "z"], "dem", "at").collect()}
    two = {r.item: r.position for r in leximin.leximin(df, "g", "item", ["x", "y"], "dem", "at").collect()}
    assert two == {"a": 1, "b": 2, "c": 3} and third == {"b": 1, "a": 2, "c": 3}


# 2


def brute_pairs(rows, most):
    commits = {}
    for repo, sha, rel in rows:
        if None not in (repo, sha, rel):
            commits.setdefault((repo, sha), set()).add(rel)
    kept = {k: v for k, v in commits.items() if len(v) <= most}
    n, f, ab = Counter(r for r, _ in kept), Counter(), Counter()
    for (repo, _), rels in kept.items():
        f.update((repo, x) for x in rels)
        ab.update((repo, a, b) for a, b in itertools.combinations(sorted(rels), 2))
    return {k: (c, f[k[0], k[1]], f[k[0], k[2]], n[k[0]]) for k, c in ab.items()}


def test_pairs(spark):
    rnd = random.Random(4)
    rows = [(f"r{rnd.choice([0, 0, 0, 1])}", f"s{rnd.randint(0, 60)}", rnd.choice([None, *"abcdefghéZ", "日"])) for _ in range(700)]
    rows += [("r0", "bulk", f"x{i}") for i in range(9)] + [(None, "s", "a"), ("r1", None, "a")] + rows[:50]
    df = spark.createDataFrame(rows, "repo string, sha string, rel string").withColumn("n_f", F.lit(1)).withColumn("_id", F.lit(1))
    want = brute_pairs(rows, 8)
    got = {(r.repo, r.rel_a, r.rel_b): r for r in cooccurrence.pairs(df, max_files=8).collect()}
    assert {k: (r.n_ab, r.n_a, r.n_b, r.n_commits) for k, r in got.items()} == want
    for k, r in got.items():
        c, a, b, n = want[k]
        assert math.isclose(r.odds_ratio, (c + 0.5) * (n - a - b + c + 0.5) / ((a - c + 0.5) * (b - c + 0.5))) and math.isclose(r.lift, c * n / (a * b))
    some = {(r.repo, r.rel_a, r.rel_b) for r in cooccurrence.pairs(df, max_files=8, least=3, times_chance=1.5).collect()}
    assert some == {k for k, (c, a, b, n) in want.items() if c >= 3 and c * n >= 1.5 * a * b}
    assert cooccurrence.pairs(df.limit(0)).count() == 0


def test_pairs_of_commits_of_any_size(spark, monkeypatch):
    """A commit that holds most rows is parted into blocks, and triangles are made in steps; all give the same pairs."""
    rnd = random.Random(5)
    rows = [("r", "huge", f"f{i}") for i in range(300)] * 2 + [("r", f"s{i}", f"f{rnd.randint(0, 40)}") for i in range(30) for _ in range(4)] + [("q", "huge", "a"), ("q", "huge", "b")]
    df = spark.createDataFrame(rows, "repo string, sha string, rel string")
    want = brute_pairs(rows, 10**9)
    for block, run in ((4096, 1 << 21), (20, 1 << 21), (4096, 1000), (20, 50)):
        monkeypatch.setattr(cooccurrence, "BLOCK", block)
        monkeypatch.setattr(cooccurrence, "LARGE", 10 * block)
        monkeypatch.setattr(cooccurrence, "RUN", run)
        got = {(r.repo, r.rel_a, r.rel_b): (r.n_ab, r.n_a, r.n_b, r.n_commits) for r in cooccurrence.pairs(df).collect()}
        assert got == want


def test_runs_in_steps(monkeypatch):
    monkeypatch.setattr(cooccurrence, "RUN", 64)
    import pyarrow as pa
    kind = pa.list_(pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array([list(range(50, 0, -1)), [3, 1, 2], [200, 7, 100]], kind), pa.array([None, None, [150, 5]], kind)], names=["ids", "others"])
    got = Counter()
    for b in cooccurrence._runs(iter([batch])):
        codes = b.column(0).to_pylist()
        assert codes == sorted(set(codes))
        for c, n in zip(codes, b.column(1).to_pylist()):
            got[c >> 32, c & 0xFFFFFFFF] += n
    want = Counter(itertools.combinations(range(1, 51), 2)) + Counter([(1, 2), (1, 3), (2, 3)]) + Counter((min(a, b), max(a, b)) for a in (200, 7, 100) for b in (150, 5))
    assert got == want


def test_runs_merge_over_batches():
    rnd = np.random.default_rng(0)
    codes = np.sort(rnd.integers(0, 40, 500))
    batches = [cooccurrence._batch(c, np.ones(len(c), int)) for c in np.array_split(codes, 37)]
    out = Counter()
    for b in cooccurrence._merge(iter(batches)):
        for c, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            assert c not in out
            out[c] = n
    assert out == Counter(codes.tolist())


# 3


def test_automaton_agrees_with_re():
    grammars = [("a", r"ab?c[0-9]{2}", True), ("b", r"(?i:key)[^\n=]*=", False), ("c", r"(?:xy|z)+q", False)]
    a = automaton.Automaton([automaton.Grammar(str(k), p, bounded=b) for k, (_, p, b) in enumerate(grammars)])
    rnd = random.Random(1)
    for chunk, overlap in ((7, 901), (64, 901), (7, 3), (64, 5)):
        text = "".join(rnd.choice("abc12 KEYkey=\nxyzq") for _ in range(900))
        ends, masks = a.scan(text.encode(), chunk=chunk, overlap=overlap)
        got = {(int(e), k) for e, m in zip(ends, masks) for k in range(3) if m >> k & 1}
        want = set()
        for k, (_, p, bounded) in enumerate(grammars):
            r = re.compile(("(?<![A-Za-z0-9])" if bounded else "") + "(?:" + p + ")")
            for i in range(len(text)):
                for j in range(i + 1, min(len(text), i + 901) + 1):
                    if r.fullmatch(text, i, j) and (not bounded or i == 0 or not re.match("[A-Za-z0-9]", text[i - 1])):
                        want.add((j - 1, k))
        assert got == want
    assert len(a.scan(b"")[0]) == 0


def test_automaton_heads_rests_and_exclusive_grammars():
    a = automaton.Automaton([automaton.Grammar("k", "key_", "[a-z_]{3,}", "k ends", exclusive=True), automaton.Grammar("u", "//", "[a-z_]*:[a-z]+@", "u ends", exclusive=True)])
    names = {v: k for k, v in a.bit.items()}
    for chunk, overlap in ((5, 2), (2048, 320)):
        events = lambda t: [(int(e), names[int(m)]) for e, m in zip(*a.scan(t.encode(), chunk=chunk, overlap=overlap))]
        assert events(" key_abcd.") == [(4, "k"), (7, "k ends"), (8, "k ends")]
        assert events("akey_abc") == [] and events("key_ab key_abc") == [(3, "k"), (10, "k"), (13, "k ends")]
        assert events("key_key_abc")[0] == (3, "k") and [e for e in events("key_key_abc") if e[1] == "k"] == [(3, "k")]
        assert events("http://key_abc:pw@h") == [(6, "u"), (17, "u ends")]
        assert events("x " * 40 + "://" + "u" * 99 + ":" + "p" * 3000 + "@") == [(82, "u"), (82 + 99 + 1 + 3000 + 1, "u ends")]


def secret(rnd, n, chars=string.ascii_letters + string.digits):
    while True:
        v = "".join(rnd.choice(chars) for _ in range(n))
        if re.search(r"\d", v) and re.search("[a-z]", v) and len(set(v)) > min(5, n - 2):
            return v


def test_credentials_in_many_forms():
    rnd = random.Random(9)
    s = lambda n=24: secret(rnd, n)
    aws = "AKIA" + "".join(rnd.choice(string.ascii_uppercase) for _ in range(13)) + "4Q7"
    yes = [
        f'api_key = "{s()}"', f"password: {s(12)}", f"export DB_PASSWORD='{s(10)}'", f'  "clientSecret": "{s()}",', f"const t: string = 'ghp_{s(36)}';", f"  x: {aws}", f"# TODO drop {aws}",
        f'dsn = "postgres://svc:{s(10)}@db.example:5432/x"', f"Authorization: Bearer {s(32)}", f'Authorization = "Basic {base64.b64encode(b"ci:h4rborMaple").decode()}"', f'<add key="ACCESS_KEY" value="{s()}" />',
        f"<api_key>{s()}</api_key>", f"// machine db.x login ci password {s(10)}", f"# curl -u ci:{s(10)} https://x", f"deploy --token {s(32)} --retries 2", f'k = process.env.API_KEY || "{s()}"', f'cfg["api_key"] = "{s()}"', f'x = os.getenv("API_KEY") or "{s()}"', f'y = getenv("API_KEY", "{s()}")',
        f'token = os.environ.get("TOKEN", "{s()}")', f"# //r.test/:_authToken={s()}", f'webhookSecret: "rk_live_{s(4)}" + "{s(20)}",', f"// mot de passe de test : {s(10)}", f"# 비밀번호: {s(10)}", "SECRET=${SECRET:-" + s(16) + "}",
    ]
    no = [
        'api_key = "your-api-key-here"', "password: ${DB_PASSWORD}", "password: !ref PWD", 'secret = "changeme"', "token: ********", 'token = "<token>"', 'password_label = "Enter your password"', "secret_name: billing-db-credentials", "tokenizer: bytepair-small2",
        'api_key_header = "X-Api-Key1"', f'cache_key = "{s(40)}"', 'etag = "sha256-abc123def456ghi789"', "-----BEGIN PUBLIC KEY-----", "-----BEGIN CERTIFICATE-----", "password must have at least 12 characters", "masked as ghp_****************Iw", "x = var.db_pass",
        "const k = process.env.API_KEY;", 'token_url = "https://a.example/oauth2/token"', "TOKEN_COUNT=162", 'token = "header-231"', "https://a.example/docs/api_key", "pattern: ghp_[A-Za-z0-9]{36}", "password = passwords[0]", '"-----BEGIN PRIVATE KEY-----" lines are rejected',
    ]
    body = [*yes, *no]
    rnd.shuffle(body)
    text = "\r\n".join(body)
    lines = text.split("\n")
    found = {c.line for c in credentials.find(["", text, "plain"])[1]}
    assert {lines[i - 1].rstrip("\r") for i in found} == set(yes)


def test_key_blocks_multi_line_values_and_redaction():
    rnd = random.Random(3)
    pem = "\n".join(secret(rnd, 64) for _ in range(4))
    text = f'é\nKEY = """-----BEGIN RSA PRIVATE KEY-----\n{pem}\n-----END RSA PRIVATE KEY-----"""\napi_key = (\n    "{secret(rnd, 30)}"\n)\nsecret: >-\n  {secret(rnd, 30)}\nend'
    found = credentials.find([text])[0]
    assert [c.line for c in found] == [2, 9, 12]
    done = credentials.redact(text, found)
    assert done == 'é\nKEY = """-----BEGIN RSA PRIVATE KEY-----[REDACTED]-----END RSA PRIVATE KEY-----"""\napi_key = (\n    "[REDACTED]"\n)\nsecret: >-\n  [REDACTED]\nend'
    assert credentials.find([done])[0] == []
    long = "x" * 50_000 + f' token="{secret(rnd, 30)}" ' + "y" * 50_000
    (c,) = credentials.find([long])[0]
    assert 50_000 < c.start < 50_020 and c.end - c.start == 30


def test_credentials_frame(spark):
    df = spark.createDataFrame([(1, "password: abc123DEF456"), (1, "password: abc123DEF456"), (2, None), (3, ""), (None, 'secret = "zz99aaBBcc"')], "id int, content string").withColumn("line_no", F.lit(7))
    assert {(r.id, r.line_no, r.start, r.length) for r in credentials.credentials(df, "id", "content").collect()} == {(1, 1, 10, 12), (None, 1, 10, 10)}
    assert {(r.id, r.content, r.n_redacted) for r in credentials.redacted(df, "id", "content").collect()} == {(1, "password: [REDACTED]", 1), (2, None, 0), (3, "", 0)}
    assert credentials.credentials(df.limit(0), "id", "content").count() == 0


# 4


def size(text):
    cjk = sum(any(a <= ord(c) <= b for a, b in [(0x1100, 0x11FF), (0x3040, 0x30FF), (0x3130, 0x318F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7A3), (0xD7B0, 0xD7FF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x2FFFD)]) for c in text)
    other = sum(2 if ord(c) > 0xFFFF else 1 for c in text) - sum(2 if 0x20000 <= ord(c) <= 0x2FFFD else 1 for c in text if size_is_cjk(c))
    return math.ceil(other / 4) + math.ceil(0.95 * cjk)


def size_is_cjk(c):
    return any(a <= ord(c) <= b for a, b in [(0x1100, 0x11FF), (0x3040, 0x30FF), (0x3130, 0x318F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7A3), (0xD7B0, 0xD7FF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x2FFFD)])


def test_pieces(spark):
    rnd = random.Random(8)
    texts = {1: "", 2: "short", 3: "x" * 5000, 4: "値" * 700 + "😀" * 300 + "𠀀" * 50, 5: "## H\r\n" + "\r\n\r\n".join("word " * rnd.randint(1, 80) for _ in range(40)), 6: "".join(rnd.choice("a 値\n.。\r😀﷒﷑﷓") for _ in range(3000)),
             7: "\n \n".join("Sentence one. And two! " * 9 for _ in range(20))}
    df = spark.createDataFrame([*texts.items(), (2, "short"), (8, None), (None, "x")], "id int, body string").withColumn("tokens", F.lit(1)).withColumn("text", F.lit("clash"))
    for limit, overlap in ((50, 8), (33, 0), (20, 19), (60, 45)):
        got = {}
        for r in split.pieces(df, "id", "body", limit, overlap).orderBy("id", "piece_no").collect():
            got.setdefault(r.id, []).append(r)
        assert got.keys() == texts.keys()
        for k, rows in got.items():
            assert [r.piece_no for r in rows] == list(range(1, len(rows) + 1)) and all(r.n_pieces == len(rows) and r.tokens == size(r.text) <= limit for r in rows)
            assert "".join(r.text[len(r.overlap) :] for r in rows) == texts[k] and (len(rows) > 1) == (size(texts[k]) > limit)
            before = ""
            for r in rows:
                assert r.text.startswith(r.overlap) and before.endswith(r.overlap) and size(r.overlap) <= overlap
                assert not (r.text[len(r.overlap) :].startswith("\n") and before.endswith("\r"))
                before += r.text[len(r.overlap) :]
            # the overlap is as long as four units a token allow, a CJK code point taking four; one that doesn't fit is left out
            before, padded = "", lambda t: sum(4 if size_is_cjk(c) else 2 if ord(c) > 0xFFFF or c in "\ufdd1\ufdd2" else 1 for c in t)
            for r in rows:
                assert padded(r.overlap) >= min(padded(before), 4 * overlap - 3) - 5 * (k == 6)  # marks that look like pads
                before += r.text[len(r.overlap) :]
    ends = [r.text for r in split.pieces(df, "id", "body", 50, 8).filter("id = 7 and piece_no < n_pieces").collect()]
    assert all(t.endswith((". ", "! ", "\n")) for t in ends)
    with pytest.raises(ValueError):
        split.pieces(df, "id", "body", 5, 5)
    assert split.pieces(df.limit(0), "id", "body", 50, 8).count() == 0


# 5


def test_copies(spark):
    rows = [(4, "foldBasket", '(a: Map<str, int> = "x,y", b)'), (2, "FOLD_basket", "(\n b , a : map[STR, Int]='X,Y',)"), (9, "$fold-basket", "(b, a: Map<str,int> = `x y`)"), (7, "foldBasket", "(a, b)"), (7, "foldBasket", "(a, b)"), (8, "foldBasket", "(b,a)"),
            (1, "other", "()"), (3, "Other", "( )"), (5, "none", ""), (6, "none", None), (None, "x", "()"), (10, None, "()"), (11, "life", "(x: &'a str, y: &'b T)"), (12, "life", "(y: &'b T, x: &'a str)")]
    df = spark.createDataFrame(rows, "symbol_id int, name string, signature string").withColumn("_k", F.lit("clash"))
    for share in (0.001, 0.5):
        ids = copies.keyed(df)
        got = {(r.first_id, r.copy_id): r.copies for r in copies.members(ids, share=share).collect()}
        assert {k for k in got if k[0] != k[1]} == {(2, 4), (2, 9), (7, 8), (1, 3), (11, 12)} and got[2, 4] == 3
        assert {r.first_id: r.copies for r in copies.collapse(ids, share=share).collect()} == {2: 3, 7: 2, 1: 2, 11: 2}
        all_ = copies.keyed(df, all_rows=True)
        assert {r.first_id: (r.name, r.copies) for r in copies.records(all_, share=share).collect()} == {
            2: ("FOLD_basket", 3), 7: ("foldBasket", 2), 1: ("other", 2), 11: ("life", 2), 5: ("none", 1), 6: ("none", 1), 10: (None, 1)}
    assert copies.members(copies.keyed(df.limit(0))).count() == 0 and copies.records(copies.keyed(df.limit(0), all_rows=True)).count() == 0


def test_hot_copies_are_salted(spark):
    df = spark.range(3000).select(F.col("id").alias("symbol_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("name"), F.lit("(x)").alias("signature"))
    ids = copies.keyed(df)
    assert {r.first_id for r in copies.members(ids).filter("copies > 1").collect()} == {1} and copies.members(ids).filter("first_id = 1").count() == 2000
    assert copies.collapse(ids).filter("copies = 2000 and first_id = 1").count() == 1


# 6


def test_term_weights(spark):
    docs = {"a": ["x", "x", "y"], "b": ["y", "z"], "c": [], "d": None, "e": ["y"] * 3 + ["w"]}
    df = spark.createDataFrame([(k, v, i) for k, v in docs.items() for i in (2, 1)] + [(None, ["x"], 1), ("f", [None, "y"], 1)], "id string, tokens array<string>, indexed_at int").withColumn("term", F.lit("clash")).withColumn("df", F.lit(1))
    lists = {k: [t for t in v or [] if t] for k, v in {**docs, "f": ["y"]}.items()}
    n, avg = len(lists), sum(map(len, lists.values())) / len(lists)
    got = {(r.id, r.term): (r.tf, r.df, r.score) for r in relevance.term_weights(df).collect()}
    assert got.keys() == {(k, t) for k, v in lists.items() for t in v}
    for (k, t), (tf, d, s) in got.items():
        assert tf == lists[k].count(t) and d == sum(t in v for v in lists.values())
        assert math.isclose(s, math.log((n - d + 0.5) / (d + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(lists[k]) / avg)))
    assert {r.id: r.term for r in relevance.top_term(relevance.term_weights(df)).collect()} == {"a": "x", "b": "z", "e": "w", "f": "y"}
    assert relevance.term_weights(df.limit(0)).count() == 0
    two = df.withColumn("field", F.lit("p")).unionByName(df.filter("id in ('a', 'b')").withColumn("field", F.lit("q"))).unionByName(df.withColumn("field", F.lit(None).cast("string")))
    split_ = relevance.term_weights(two, collection=["field"])
    assert {(r.id, r.term): (r.tf, r.df, r.score) for r in split_.filter("field = 'p'").collect()} == got
    assert {(r.id, r.term, r.tf, r.df) for r in split_.filter("field <> 'p'").collect()} == {("a", "x", 2, 1), ("a", "y", 1, 2), ("b", "y", 1, 2), ("b", "z", 1, 1)}


# 7


def test_first_fit_matches_the_definition():
    rnd = random.Random(6)
    for _ in range(30):
        sizes_, room, want = sorted((rnd.randint(0, 100) for _ in range(rnd.randint(0, 60))), reverse=True), [], []
        for s in sizes_:
            k = next((i for i, r in enumerate(room) if r >= s), len(room))
            room += [100] * (k == len(room))
            room[k] -= s
            want.append(k)
        assert packing.first_fit(sizes_, 100) == want


def test_packing(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(1, 40)) for i in range(300)] + [(300, 250), (301, 0), (302, None), (303, 100), (5, 7), (None, 3)]
    df = spark.createDataFrame(rows, "id int, n int").withColumn("container_id", F.lit(1)).withColumn("start", F.lit(1))
    got = packing.pack(df, "id", "n", 100, group_items=100).collect()
    used, parts = Counter(), {}
    for r in got:
        used[r.container_id] += r.end - r.start
        parts.setdefault(r.id, []).append((r.part_no, r.start, r.end, r.n_parts))
    assert max(used.values()) <= 100 and sum(used.values()) == sum(n or 0 for i, n in rows if i is not None)
    assert sorted(parts[300]) == [(1, 0, 100, 3), (2, 100, 200, 3), (3, 200, 250, 3)] and all(len(v) == 1 for k, v in parts.items() if k not in (300, 5)) and len(parts[5]) == 2
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "id", "n", 0)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world <|endoftext|>"), (2, ""), (3, None), (4, "x" * 20_000)], "id int, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.id: r.n_tokens for r in sizes.token_counts(df).collect()}
    encode = sizes.encoder().encode_ordinary
    assert got == {1: len(encode("hello world <|endoftext|>")), 2: 0, 3: 0, 4: len(encode("x" * 20_000))} and got[1] > 3


# 8


def test_mixing_plan():
    sizes_, targets, repeats = {"a": 1000, "b": 100, "c": 10, "d": 0}, {"a": 0.5, "b": 0.3, "c": 0.1, "d": 0.1}, {"a": 1, "b": 2, "c": 4}
    budget, x, w = mixing.plan(sizes_, targets, repeats)
    assert x == 0 and math.isclose(budget, 40 / (0.1 / 0.9)) and math.isclose(w["c"], 1 / 9)
    budget, x, w = mixing.plan(sizes_, targets, repeats, 500)
    assert 0 < x < 1 and all(budget * w[k] <= sizes_[k] * repeats[k] * (1 + 1e-6) for k in w) and budget == 500
    assert math.isclose(budget * w["c"], 40, rel_tol=1e-6)
    assert mixing.plan({}, targets, repeats) == (0.0, 0.0, {})
    shares = mixing.normalised(sizes_)
    e = mixing.exponent_for_entropy(shares, 0.8)
    assert math.isclose(mixing.entropy(mixing.tempered(shares, e)), 0.8, abs_tol=1e-6)
    budget, x, w = mixing.plan_entropy(sizes_, 0.8, {"a": 9, "b": 9, "c": 9}, 100)
    assert math.isclose(x, e) and math.isclose(mixing.entropy(w), 0.8, abs_tol=1e-6) and budget == 100
    budget, x, w = mixing.plan_entropy(sizes_, 1.0, repeats, 600)  # a limit binds before the entropy
    assert e < x < 1 and math.isclose(max(budget * w[k] / (sizes_[k] * repeats[k]) for k in w), 1, rel_tol=1e-6)
    assert mixing.plan_entropy({}, 1.0, repeats, 5) == (0.0, 0.0, {})


def test_mixing_selection(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "a", "a", "b"]), rnd.randint(1, 9)) for i in range(400)] + [(900, None, 5), (901, "zz", 5), (None, "a", 5), (902, "a", None), (903, "b", 0)]
    df = spark.createDataFrame(rows, "id int, source string, n int").withColumn("repeats", F.lit(9))
    sizes_ = mixing.source_sizes(df.filter("id is not null"), "source", "n", ["a", "b"])
    assert sizes_ == {s: sum(n or 0 for i, x, n in rows if x == s and i is not None) for s in "ab"}
    budgets = {"a": sizes_["a"] * 0.4, "b": sizes_["b"] * 2.5}
    got = mixing.select(df, "id", "source", "n", budgets, sizes_, {"a": 1, "b": 3}).collect()
    used = Counter()
    for r in got:
        used[r.source] += (r.n or 0) * r.repeats
        assert r.repeats in ({1} if r.source == "a" else {2, 3})
    assert all(budgets[s] - 9 <= used[s] <= budgets[s] for s in budgets)
    times = {r.id: r.repeats for r in got}
    for s, whole in (("a", 0), ("b", 2)):  # nothing that could be used once more fits
        assert budgets[s] - used[s] < min(n for i, x, n in rows if x == s and i is not None and n and times.get(i, 0) == whole)
    capped = mixing.select(df, "id", "source", "n", {"b": 1e9}, sizes_, {"b": 3}).collect()
    assert {r.repeats for r in capped} == {3}
    names = spark.createDataFrame([(" Commit-Log ",), ("CODE",), ("  ",), (None,)], "s string").select(mixing.normal_source(F.col("s")).alias("s")).collect()
    assert [r.s for r in names] == ["commit_log", "code", None, None]


def test_mixing_of_nothing(spark):
    none = spark.createDataFrame([], "id int, source string, n int")
    assert mixing.select(none, "id", "source", "n", {}, {}, {}).count() == 0 and mixing.select(none, "id", "source", "n", {"a": 10.0}, {}, {"a": 2}).count() == 0
    some = spark.createDataFrame([(1, "a", None), (2, "a", 0), (3, None, 4)], "id int, source string, n int")
    assert mixing.select(some, "id", "source", "n", {"a": 10.0}, {"a": 0}, {"a": 2}).count() == 0


@pytest.mark.parametrize("block", [1, 64])
def test_a_long_document_closes_no_permutation(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = [(i, "a", 5000) for i in range(20)] + [(100 + i, "a", 10 + i) for i in range(60)] + [(500, "b", 7)]
    df = spark.createDataFrame(rows, "id int, source string, n int")
    budgets = {"a": 2000.0, "b": 6.0}
    got = mixing.select(df, "id", "source", "n", budgets, {"a": sum(n for _, s, n in rows if s == "a"), "b": 7}, {"a": 1, "b": 1}).collect()
    left, used = {n for i, s, n in rows if s == "a"} - {r.n for r in got}, sum(r.n for r in got)
    assert all(r.source == "a" and r.repeats == 1 for r in got) and used <= 2000 and 2000 - used < min(left)


# 9

SENTENCES = {
    "en": ["The parser reads every line once and keeps the result until the file changes.", "There is no reason to load the table before the index has been checked.", "Nobody should edit this file by hand, because the next run would write it again.", "When two of them have the same score, the shorter name comes first in the list."],
    "de": ["Die Tabelle wird einmal gelesen und bleibt erhalten, bis sich die Datei ändert.", "Es gibt keinen Grund, den Index vor der Prüfung zu laden.", "Niemand sollte diese Datei von Hand bearbeiten, weil der nächste Lauf sie neu schreibt.", "Wenn zwei die gleiche Punktzahl haben, kommt der kürzere Name zuerst."],
    "fr": ["Le tableau est lu une seule fois puis conservé jusqu'à ce que le fichier change.", "Il n'y a aucune raison de charger l'index avant d'avoir vérifié la table.", "Personne ne devrait modifier ce fichier à la main, car il sera réécrit.", "Quand deux éléments ont le même score, le nom le plus court vient en premier."],
    "es": ["La tabla se lee una sola vez y luego se guarda hasta que cambia el archivo.", "No hay ninguna razón para cargar el índice antes de comprobar la lista.", "Nadie debería editar este archivo a mano, porque la próxima vez se vuelve a escribir.", "Cuando dos tienen la misma puntuación, el nombre más corto va primero."],
    "pt": ["A tabela é lida uma única vez e depois fica guardada até que o arquivo mude.", "Não há razão nenhuma para carregar o índice antes de verificar a lista.", "Ninguém deve editar este arquivo à mão, porque ele será escrito outra vez.", "Quando dois têm a mesma pontuação, o nome mais curto vem primeiro."],
    "ko": ["표는 한 번만 읽고 파일이 바뀔 때까지 그대로 보관합니다.", "목록을 확인하기 전에 색인을 불러올 이유가 없습니다.", "이 파일을 직접 고치지 말고 작업을 다시 실행해 주세요.", "점수가 같으면 짧은 이름이 먼저 나옵니다."],
    "ja": ["表は一度だけ読み込まれ、ファイルが変わるまで保持されます。", "一覧を確認する前に索引を読み込む理由はありません。", "このファイルを手で編集せず、処理をもう一度実行してください。", "点数が同じときは、短い名前のほうが先に並びます。"],
}


@pytest.fixture(scope="module")
def profiles():
    texts = [(" ".join(s[:3]), l) for l, s in SENTENCES.items() for _ in range(3)]
    wrong = [(" ".join(SENTENCES["en"][:3]), l) for l in ("de", "ko")]
    return language.trained(*map(list, zip(*texts, *wrong)))


def test_held_out_sentences(profiles):
    for l, s in SENTENCES.items():
        for t in (s[3], s[3].upper(), __import__("unicodedata").normalize("NFD", s[3])):
            _, _, _, best, sure, _ = language.label_texts([t], profiles)
            assert {language.LANGUAGES[i] for i in best} == {l}


def test_code_paths_and_identifiers_are_no_prose(profiles):
    code = "import { a } from './b';\nfunc readTable(x string) error {\n\treturn nil, err\n}\n```\nthis is fenced text of the block\n```\nset -euo pipefail\n./tools/run.sh --limit 3\n"
    assert len(language.segments([code])[0]) == 0 and len(language.segments(["", " \n", "`only code`"])[0]) == 0
    doc, start, end, best, _, _ = language.label_texts([code + "// " + SENTENCES["de"][0] + "\n", SENTENCES["fr"][1] + " " + SENTENCES["ko"][2]], profiles)
    assert [(int(d), language.LANGUAGES[b]) for d, b in zip(doc, best)] == [(0, "de"), (1, "fr"), (1, "ko")]
    assert SENTENCES["ko"][2][1:-1] in (SENTENCES["fr"][1] + " " + SENTENCES["ko"][2])[start[2] : end[2] + 1]


def test_languages_of_frames(spark, profiles):
    en, ja = " ".join(SENTENCES["en"]), "".join(SENTENCES["ja"])
    rows = [(1, en, "en-US"), (2, en, "ja"), (3, en + "\n" + ja, "en"), (4, ja, " JPN "), (5, None, "en"), (6, "", None), (7, ja, "und"), (8, "x = 1;", "en"), (9, en, ""), (None, en, "ja")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").withColumn("language", F.lit("clash")).withColumn("share", F.lit(1))
    found = language.languages(df, profiles)
    assert {(r.doc_id, r.true_lang) for r in language.mislabelled(found, df).collect()} == {(2, "en"), (3, "en"), (3, "ja"), (7, "ja"), (9, "en")}
    assert all(0 < r.share <= 1 and 0 <= r.confidence <= 1 for r in found.collect())
    segs = language.language_segments(df, profiles).filter("doc_id = 3").orderBy("segment_no").collect()
    assert [(r.segment_no, r.language) for r in segs] == [(1, "en"), (2, "ja")] and segs[1].start >= len(en)
    none = language.profiles_of(df.limit(0))
    assert language.languages(df.limit(0), none).count() == 0


def test_training_is_bounded_and_ignores_order(spark):
    rows = [(i, " ".join(SENTENCES[l]), l) for i, l in enumerate(["en", "de", "ko"] * 20)]
    a = language.profiles_of(spark.createDataFrame(rows, "doc_id int, text string, lang string"), per_language=5)
    b = language.profiles_of(spark.createDataFrame(rows[::-1], "doc_id int, text string, lang string").repartition(7), per_language=5)
    assert np.array_equal(a.table, b.table)


def test_other_languages_and_a_least_confidence(spark):
    texts = [(" ".join(SENTENCES[l][:3]), {"en": "x1", "de": "x2"}[l]) for l in ("en", "de") for _ in range(3)]
    two = language.trained(*map(list, zip(*texts)), names=("x1", "x2"))
    df = spark.createDataFrame([(1, SENTENCES["en"][3]), (2, SENTENCES["de"][3]), (3, SENTENCES["ja"][3])], "doc_id int, text string")
    assert {r.doc_id: r.language for r in language.languages(df, two).filter("doc_id < 3").collect()} == {1: "x1", 2: "x2"}
    assert {r.language for r in language.languages(df, two, least_confidence=1.01).collect()} == {"und"} == {r.language for r in language.language_segments(df, two, least_confidence=1.01).collect()}
    rows = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(texts)], "doc_id int, text string, lang string").withColumn("lang", F.when(F.col("lang") == "x1", "en").otherwise("de"))
    assert language.profiles_of(rows, names=("de", "en")).names == ("de", "en")


def test_short_lines_in_a_wide_script_are_judged_together(profiles):
    """Comments of a few syllables each, beside sentences in another language."""
    lines = "\n".join([*SENTENCES["en"], *(f"// {w}" for s in SENTENCES["ko"] for w in s.rstrip(".").split(" "))])
    _, _, _, best, _, weight = language.label_texts([lines], profiles)
    share = weight[best == language.LANGUAGES.index("ko")].sum() / weight.sum()
    assert share > 0.15 and {language.LANGUAGES[b] for b in best} == {"en", "ko"}


# 3, whole values


def test_values_of_any_length():
    rnd = random.Random(11)
    for n in (300, 4364, 20_000):
        v = secret(rnd, n)
        yes = [f'API_KEY="{v}"', f"API_KEY={v}", f"<api_key>{v}</api_key>", f'<add key="API_KEY" value="{v}" />', "SECRET=${SECRET:-" + v + "}", f"t: eyJ{v}.eyJ{v}.{v}", f"u: https://{v}:{v}@db.example/x", f"machine x login {v} password {v}", f"run --token {v} --fast", f"Authorization: Bearer {v}", f"curl -u {v}:{v} https://x"]
        for line in yes:
            found = credentials.find(["a\n" * 900 + line + "\nb"])[0]
            assert [c.line for c in found] == [901] and found[0].end - found[0].start >= n, line[:60]
            left = credentials.redact(line, credentials.find([line])[0])
            assert v not in left.replace(f"https://{v}:", "").replace(f"login {v} ", "").replace(f"-u {v}:", ""), line[:60]
        (c,) = credentials.find([f"api_key = (\n  '{v}'\n)"])[0]
        assert c.end - c.start == n
        (c,) = credentials.find(["z " * 9000 + f'token="{v}"' + " y" * 9000])[0]
        assert c.end - c.start == n


def test_key_bodies_of_any_length():
    rnd = random.Random(12)
    rows = [secret(rnd, 64) for _ in range(1500)]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    redacted = lambda t: credentials.redact(t, credentials.find([t])[0])
    assert redacted(f"a\n{begin}\n" + "\n".join(rows) + f"\n{end}\nb") == f"a\n{begin}[REDACTED]{end}\nb"
    for sep in ("\n", "\r\n", "\n    ", "\\n", '\\n" +\n  "'):
        cut = f"{begin}{sep}" + sep.join([*rows[:40], "Ab3+" * 3 + "Q2=="])
        assert redacted(cut + "\nplain text follows\n") == f"{begin}[REDACTED]\nplain text follows\n"
        assert redacted(cut + f"\nplain text\n{begin}\n" + "\n".join(rows[40:50]) + f"\n{end}\n") == f"{begin}[REDACTED]\nplain text\n{begin}[REDACTED]{end}\n"


def test_wrapped_key_blocks():
    rnd = random.Random(13)
    body = "\n".join(secret(rnd, 64) for _ in range(49))
    wrap = lambda kind: base64.b64encode(f"-----BEGIN {kind}-----\n{body}\n-----END {kind}-----\n".encode()).decode()
    for line in ("TLS_KEY={}", 'tls: "{}"'):
        text = line.format(wrap("RSA PRIVATE KEY"))
        assert credentials.redact(text, credentials.find([text])[0]) == line.format("[REDACTED]")
        assert credentials.find([line.format(wrap("CERTIFICATE"))])[0] == []


def test_long_lines_take_linear_time():
    import time

    for line in ("key = " + " " * 200_000 + "x", "token='" + "a1B" * 100_000, "password: " + "aB3/" * 50_000 + "(", "key:\n" + "),;" * 100_000 + "'", "-----BEGIN PRIVATE KEY-----\n" + ("Ab3+" * 16 + "\n") * 5000 + "x", "eyJ" + "aB3-" * 50_000, '"' + " " * 100_000 + "+ key"):
        at = time.time()
        credentials.find([line])
        assert time.time() - at < 5, line[:20]


def test_dollars_in_passwords_are_no_references():
    for v in ("tR7$e9Lq!2vB", "aB3$Xk29sdkQ", "$tR7e9Lq2vB", "Q1$_w8Zr$(kP5"):
        for line in (f'password = "{v}"', f"u: postgres://svc:{v}@db.example/x"):
            (c,) = credentials.find([line])[0]
            assert line[c.start : c.end] == v
    for v in ("$DB_PASSWORD1", "${DB_PASSWORD1}", "$db_pass1", "$dbPassword", "$(pass show db1)", "$(pass)", "pre-${Env}-9Xk2a"):
        assert credentials.find([f'password = "{v}"', f"u: postgres://svc:{v}@db.example/x"]) == [[], []]


def test_passwords_within_sentences():
    v = "Xk29sdkQ2"
    for line in (f"The staging password is {v} until Friday.", f"password is `{v}`", f"Use the password: {v}, then log in.", f"The passphrase for it is '{v}'.", f"パスワードは{v}です。", f"x = 1  # the password is {v} for now", "y " * 5000 + f"the password is {v} for now" + " z" * 5000):
        text = f"a\n```python\n{line}\n```\n" if line.startswith("x =") else line
        (c,) = credentials.find([text])[0]
        assert text[c.start : c.end] == v
    for line in ("The password hash is Argon2id based.", "The password is required for all users.", "password is `your-password1` here"):
        assert credentials.find([line])[0] == []


def test_credentials_are_found_wherever_a_chunk_begins():
    rnd = random.Random(14)
    v, user = secret(rnd, 24), secret(rnd, 320)
    for line in (f"u: https://{user}:{v}@db.example/x", f'x = $password["k"] || {"y" * 400}; password{" " * 400}= "{v}"', "t = 'ghp_" + v + "'" + " " * 400 + "+" + " " * 400 + "'" + v + "'"):
        want = len(credentials.find([line])[0])
        assert want == 1
        for before in range(1200, 2100, 50):
            assert len(credentials.find(["a" * before, line])[1]) == want


def test_grammar_spans_agree_with_the_formats():
    """Fragments of tokens in any order: the automaton and what it leaves give what the formats find."""
    def merged(spans):
        out = []
        for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    bits = ["eyJ", "-", "_", ".", "ghp_", "glpat-", "sk_live_", "AKIA", "npm_", "SG.", "hf_", "xoxb-", "://", "//", ":", "@", "/", " ", "\n", '"', "http", "u", "LS0tLS1CRUdJTiB", "dop_v1_", "pypi-", "github_pat_"]
    for seed in range(400):
        r = random.Random(seed)
        t = "".join(r.choice(bits) if r.random() < 0.7 else "".join(r.choice(string.ascii_letters + "0123456789") for _ in range(r.choice([3, 8, 16, 22, 36, 64]))) for _ in range(r.randint(2, 25))).encode()
        got, _ = credentials.grammar_spans(np.frombuffer(t, np.uint8), credentials.grammars())
        assert merged({s[:2] for s in got}) == merged({m.span() for m in credentials.LEFT_RE.finditer(t)} | {m.span("v") for m in credentials.LEFT_URL_RE.finditer(t)}), t


def test_values_of_any_length_at_any_offset():
    rnd = random.Random(3)
    body = lambda n: "\n".join("".join(rnd.choice(string.ascii_letters + "0123456789+/") for _ in range(64)) for _ in range(n // 65))
    for n in (257, 4097, 100_000):
        v = secret(rnd, n)
        for line in (f"password = '{v}'", f"u: https://svc:{v}@db.example/x", f"jwt=eyJ{v}.{v[:40]}.{v[:40]}", f"t: ghp_{v}"):
            want = line.index("eyJ" if "eyJ" in line[:7] else "ghp_" if "ghp_" in line[:7] else v)
            for before in (0, 1, 700, 2047, 5000):
                text = "b " * before + line
                (c,) = credentials.find([text])[0]
                assert c.start == 2 * before + want and (c.end - c.start >= n)
    for header in ("", "Proc-Type: 4,ENCRYPTED\nComment: " + "x " * 400 + "\n\n"):
        key = f"-----BEGIN RSA PRIVATE KEY-----\n{header}{body(200_000)}\n-----END RSA PRIVATE KEY-----"
        for before in (0, 1999, 2040):
            text = "é" * before + "\n" + key + "\nafter"
            (c,) = credentials.find([text])[0]
            assert c.line == 2 and credentials.redact(text, [c]) == "é" * before + "\n-----BEGIN RSA PRIVATE KEY-----[REDACTED]-----END RSA PRIVATE KEY-----\nafter"


def test_tokens_within_what_comes_to_nothing():
    t = "ghp_" + "a1B2" * 9
    for line in (f"https://{t}@github.com/x", f"eyJ-{t} x", f"//{t}", f"glpat-{t}.", f"//h:6379;token={t}"):
        (c,) = credentials.find([line])[0]
        assert t in line[c.start : c.end]
    (c,) = credentials.find(["eyJ_-----BEGIN PRIVATE KEY-----\n" + "Ab3+" * 16])[0]
    assert c.kind == "key"
