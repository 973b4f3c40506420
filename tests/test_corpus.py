"""Outlines, references, ranking and budgets on small corpora, against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from orrery.operators import bm25, budget, cochange, outline, rank, select
from orrery.operators.skew import cume_dist, hot_keys, join_on_key, running_total

FILES = [
    ("src/core.py", "class Engine:\n    def start(self, x):\n        pass\n\ndef helper_one(a, b):\n    return a\n"),
    ("src/app.py", "from core import Engine\nimport os, json as j\nEngine().start(helper_one(1, 2))\n"),
    ("tests/test_app.py", "import app\ndef test_app():\n    helper_one(Engine)\n"),
    ("web/ui.ts", "import { a } from './page';\nexport const VERSION = 1;\nexport const go = async (x) => x;\nconst local = 2;\nfunction draw$(n: number) {}\n"),
    ("web/page.ts", "draw$(1);\nexport default class Page {}\n"),
    ("cmd/main.go", 'package main\nimport (\n\t"fmt"\n\tx "a/b"\n)\nimport "os"\nfunc (s *S) Run(a int) {}\ntype S struct {}\n'),
    ("lib/a.rs", "pub use crate::x::{y, z};\nmod inner;\npub async fn run_it(a: u8) {}\npub(crate) struct T;\n"),
    ("empty.py", ""),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("r", p, t) for p, t in FILES], "repo string, rel string, text string").cache()


def test_symbols(files):
    got = {(r.rel, r.kind, r.name, r.signature, r.line, r.top_level) for r in outline.symbols(files, ["repo", "rel"]).collect()}
    assert ("src/core.py", "class", "Engine", "", 1, True) in got
    assert ("src/core.py", "function", "start", "(self, x)", 2, False) in got
    assert ("web/ui.ts", "const", "VERSION", "", 2, True) in got and ("web/ui.ts", "function", "go", "", 3, True) in got
    assert not any(g[2] == "local" for g in got)
    assert ("cmd/main.go", "func", "Run", "(a int)", 7, True) in got and ("cmd/main.go", "type", "S", "", 8, True) in got
    assert ("lib/a.rs", "fn", "run_it", "(a: u8)", 3, True) in got and ("lib/a.rs", "type", "T", "", 4, True) in got


def test_at_most_fifty_symbols(spark):
    df = spark.createDataFrame([("a.py", "\n".join(f"def f{i}(): pass" for i in range(60)))], "rel string, text string")
    assert [r.name for r in outline.symbols(df, ["rel"]).orderBy("ord").collect()] == [f"f{i}" for i in range(50)]


def test_imports(files):
    got = outline.resolve(outline.imports(files, ["repo", "rel"]), files, ["repo"]).collect()
    rows = {(r.rel, r.specifier, r.line, r.resolved) for r in got}
    assert ("web/ui.ts", "./page", 1, "web/page.ts") in rows
    assert {("src/app.py", "core", 1, None), ("src/app.py", "os", 2, None), ("src/app.py", "json", 2, None)} <= rows
    assert {(r[1], r[2]) for r in rows if r[0] == "cmd/main.go"} == {("fmt", 3), ("a/b", 4), ("os", 6)}
    assert {(r[1], r[2]) for r in rows if r[0] == "lib/a.rs"} == {("crate::x::{y, z}", 1), ("inner", 2)}


def test_relative_python_imports(spark):
    df = spark.createDataFrame([("r", "p/q/a.py", "from .b import x\nfrom ..c.d import y\nfrom . import z\n"), ("r", "p/q/b.py", ""), ("r", "p/c/d/__init__.py", ""), ("r", "p/q/__init__.py", "")], "repo string, rel string, text string")
    got = {r.specifier: r.resolved for r in outline.resolve(outline.imports(df, ["repo", "rel"]), df, ["repo"]).collect()}
    assert got == {".b": "p/q/b.py", "..c.d": "p/c/d/__init__.py", ".": "p/q/__init__.py"}


def test_import_that_spans_lines(spark):
    df = spark.createDataFrame([("a.js", "\nimport {\n a } from\n  'x';require( \"y\" )")], "rel string, text string")
    assert [(r.specifier, r.line) for r in outline.imports(df, ["rel"]).orderBy("ord").collect()] == [("x", 3), ("y", 4)]


def brute_reference(files, symbols):
    out = {}
    for rel, text in files:
        own = symbols.get(rel, [])
        total = 0
        for name in own:
            if len(name) < 4 or name.lower() in set(__import__("orrery.functions.text", fromlist=["x"]).COMMON_NAMES):
                continue
            # \b of ASCII words
            pattern = (r"(?<![A-Za-z0-9_])" if re.match(r"\w", name[0], re.A) else r"(?<=[A-Za-z0-9_])") + re.escape(name) + (r"(?![A-Za-z0-9_])" if re.match(r"\w", name[-1], re.A) else r"(?=[A-Za-z0-9_])")
            for other, t in files:
                if other != rel:
                    total += min(len(re.findall(pattern, t)), 20)
        out[rel] = total + min(len(own), 10) * 0.5
    return out


@pytest.mark.parametrize("few", [True, False])
def test_reference_scores_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(rank, "few_bytes", lambda df: few)
    rnd = random.Random(5)
    names = ["alpha", "beta_1", "main", "abc", "Delta", "x$yz", "wait?", "été1", "$run", "$?!$"]
    files = [(f"f{i}.py", " ".join(rnd.choice([*names, "alpha.", "xalpha", "Étre", "wait?z", "x$yz9", "a$run", "a$?!$b", "a$?!$$b"]) for _ in range(60))) for i in range(8)]
    symbols = {f"f{i}.py": [rnd.choice(names) for _ in range(rnd.randint(0, 13))] for i in range(8)}
    f = spark.createDataFrame([("r", *x) for x in files], "repo string, rel string, text string")
    s = spark.createDataFrame([("r", rel, n) for rel, ns in symbols.items() for n in ns], "repo string, rel string, name string")
    got = rank.reference_scores(f, s, rank.name_counts(f, s, ["repo"], "rel"), ["repo"], "rel")
    plain = {k: v for k, v in symbols.items()}
    assert {r.rel: r.reference for r in got.collect()} == brute_reference(files, {k: [n for n in v if n.isascii()] + [n for n in v if not n.isascii()] for k, v in plain.items()})


def test_a_name_in_many_files_forms_no_pairs(spark):
    """One name that 100,000 files define and name: each is named by all others, and no row is a pair of files."""
    n = 100_000
    files = spark.range(n).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("rel"))
    counts = files.withColumns({"word": F.lit("hotname"), "n": F.lit(30).cast("bigint")})
    got = rank.references(counts, files.withColumn("name", F.lit("hotname")), ["repo"], "rel")
    assert got.agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first() == ((n - 1) * 20, (n - 1) * 20, n)
    alone = rank.references(counts.limit(1), files.limit(1).withColumn("name", F.lit("hotname")), ["repo"], "rel")
    assert alone.count() == 0 and rank.references(counts.limit(0), files.withColumn("name", F.lit("x")).limit(0), ["repo"], "rel").count() == 0


def test_nulls_and_empty_tables_in_names_and_sizes(spark):
    from orrery.functions import text as T

    f = spark.createDataFrame([("r", "a.py", None), ("r", "b.py", ""), ("r", "c.py", "name_1 name_1 $odd"), (None, "d.py", "name_1")], "repo string, rel string, text string").withColumn("n", F.lit("clash"))
    s = spark.createDataFrame([("r", "a.py", "name_1"), ("r", "a.py", None), ("r", "b.py", "x$odd"), (None, "d.py", "name_1")], "repo string, rel string, name string")
    assert [tuple(r) for r in rank.name_counts(f, s, ["repo"], "rel").select("repo", "rel", "word", "n").collect()] == [("r", "c.py", "name_1", 2)]
    assert rank.name_counts(f.limit(0), s, ["repo"], "rel").count() == rank.name_counts(f, s.limit(0), ["repo"], "rel").count() == 0
    blocks = f.select(F.lit("g").alias("g"), F.monotonically_increasing_id().alias("rank"), "text")
    sized = T.with_sizes(blocks, F.col("text"))
    assert {r.text: (r.other, r.cjk) for r in sized.collect()} == {None: (None, None), "": (0, 0), "name_1 name_1 $odd": (18, 0), "name_1": (6, 0)}
    assert budget.greedy_fit(sized, ["g"], 5).filter("included").count() == 2 and budget.greedy_fit(sized.limit(0), ["g"], 5).count() == 0
    wide = spark.createDataFrame([("a値😀𠀀",)], "t string")
    assert T.with_sizes(wide, F.col("t")).select("other", "cjk").first() == wide.select(T.other_units(F.col("t")), T.cjk_chars(F.col("t"))).first() == (3, 2)
    assert [r.t for r in spark.createDataFrame([(" a \t\r\n\x0b",), ("",), (None,)], "t string").select(T.rstrip(F.col("t")).alias("t")).collect()] == [" a", "", None]


def test_ties_stand_by_path_as_a_person_sorts(spark):
    paths = ["B", "_x", "a-b", "a/b", "aB", "a_b", "ab", "b", None]
    df = spark.createDataFrame([("r", p, i, 1.0) for i, p in enumerate(paths)], "repo string, rel string, id int, score double")
    order = rank.by_path("rel", "id")
    assert [r.rel for r in rank.ranked(df, ["repo"], order).orderBy("rank").collect()] == [None, "_x", "a_b", "a-b", "a/b", "ab", "aB", "b", "B"]
    assert [r.rel for r in rank.top(df, ["repo"], order, 3).orderBy("rank").collect()] == [None, "_x", "a_b"]


def test_rank_order_demotion_and_parts(files):
    s = outline.symbols(files, ["repo", "rel"])
    refs = rank.reference_scores(files, s, rank.word_counts(files, ["repo", "rel"]), ["repo"], "rel")
    plain = rank.ranked(rank.scored(refs, ["repo"], "rel", "rel"), ["repo"], "rel").orderBy("rank").collect()
    assert plain[0].rel == "src/core.py"
    extra = files.filter("rel = 'tests/test_app.py'").select("repo", "rel", F.lit(2.0).alias("contribution"))
    for r in rank.scored(refs, ["repo"], "rel", "rel", [extra]).collect():
        assert abs(r.score - (r.reference + r.scorers) * r.demotion) < 1e-9
        assert r.reference <= 1 and r.demotion == (0.2 if r.rel.startswith("tests/") else 1.0)


def test_expansion_leaves_seeds_out(files):
    s = outline.symbols(files, ["repo", "rel"])
    seeds = files.filter("rel = 'src/core.py'").select("repo", "rel")
    got = select.expansion(rank.word_counts(files, ["repo", "rel"]), s, seeds, files, ["repo"], "rel", "rel").orderBy("rank").collect()
    assert [r.rel for r in got] == ["src/app.py", "tests/test_app.py"]


def brute_bm25(docs, terms, k1=1.2, b=0.75):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for key, tokens in docs.items():
        for t in dict.fromkeys(terms):
            tf, d = tokens.count(t), sum(t in x for x in docs.values())
            if tf:
                out[key] = out.get(key, 0) + math.log((n - d + 0.5) / (d + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(tokens) / avg))
    return out


def test_bm25(spark):
    docs = {"a": ["x", "y", "x"], "b": [], "c": ["z"] * 5 + ["y"], "d": ["q"]}
    df = spark.createDataFrame(list(docs.items()), "id string, tokens array<string>")
    got = {r.id: r.score for r in bm25.bm25(df, ["x", "y", "x", "none"], "id").collect()}
    want = brute_bm25(docs, ["x", "y", "none"])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert bm25.bm25(df, [], "id").count() == 0 and bm25.bm25(df.limit(0), ["x"], "id").count() == 0


def test_bm25_of_texts(spark):
    texts = {"a": "Queries and a query of the parser", "b": "", "c": "nothing here"}
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    got = {r.id: r.score for r in bm25.bm25_texts(df, ["query", "parser"], "id", "t").collect()}
    want = brute_bm25({"a": ["query", "query", "parser"], "b": [], "c": ["nothing", "here"]}, ["query", "parser"])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("stretch", [3, 4096])
def test_budgets_match_a_loop(spark, monkeypatch, stretch):
    monkeypatch.setattr(budget, "STRETCH", stretch)
    rnd = random.Random(3)
    rows = [(g, i + 1, i < 2, rnd.randint(0, 90), rnd.randint(0, 20)) for g in "ab" for i in range(30)]
    df = spark.createDataFrame(rows, "g string, rank bigint, is_seed boolean, other bigint, cjk bigint")
    tokens = lambda o, c: math.ceil(o / 4) + math.ceil(c * 0.95)
    for cap in (0, 30, 100, 250, 10_000) if stretch > 3 else (30, 250):
        got = {(r.g, r["rank"]): r.included for r in budget.greedy_fit(df, ["g"], cap, header=(10, 1), reserve=3).collect()}
        cutoff = {(r.g, r["rank"]) for r in budget.prefix_cut(df, ["g"], cap, header=(10, 1)).collect()}
        seeded = {(r.g, r["rank"]): (r.included, r.degraded) for r in budget.seeded_fit(df, ["g"], cap).collect()}
        for g in "ab":
            o, c, po, pc, open_ = 10, 1, 10, 1, True
            so, sc = sum(r[3] for r in rows if r[0] == g and r[2]), sum(r[4] for r in rows if r[0] == g and r[2])
            degraded = tokens(so, sc) > cap
            do = dc = 0
            for _, k, seed, x, y in sorted(r for r in rows if r[0] == g):
                fits = tokens(o + x, c + y) + 3 <= cap
                o, c = (o + x, c + y) if fits else (o, c)
                assert got[g, k] == fits
                po, pc = po + x, pc + y
                open_ = open_ and tokens(po, pc) <= cap and k <= cap
                assert ((g, k) in cutoff) == open_
                ok = (not degraded or not seed or k == 1) and tokens(do + x, dc + y) <= cap
                do, dc = (do + x, dc + y) if ok else (do, dc)
                assert seeded[g, k] == (ok, degraded)


def test_a_greedy_fit_of_a_million_blocks(spark):
    """The first blocks of one group fill the budget; of the others only those that fit are looked at again."""
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.col("id") + 1).alias("rank"), F.when(F.col("id") == 700_000, 8).otherwise(40 + F.col("id") % 50).alias("other"), F.lit(0).alias("cjk"))
    got = [r["rank"] for r in budget.greedy_fit(df, ["g"], 1000).filter("included").collect()]
    total, want = 0, []
    for i in range(1_000_000):
        size = 8 if i == 700_000 else 40 + i % 50
        if total + size <= 4000:
            total, want = total + size, [*want, i + 1]
    assert sorted(got) == want and 700_001 in want


def test_cochange_matches_the_loop(spark):
    rnd = random.Random(1)
    history = {f"s{i}": rnd.sample([f"f{j}" for j in range(12)], rnd.randint(1, 6)) for i in range(40)}
    seeds = {"f0", "f3"}
    df = spark.createDataFrame([("r", s, i, f) for i, (s, fs) in enumerate(history.items()) for f in fs * 2], "repo string, sha string, commit_ord int, rel string")
    sd = spark.createDataFrame([("r", f) for f in seeds], "repo string, rel string")
    sums = cochange.seed_sums(cochange.window_commits(df, limit=30, bulk=5), sd)
    want = {}
    for fs in [v for v in list(history.values())[:30] if len(v) <= 5]:
        for s in seeds & set(fs):
            for f in fs:
                if f != s:
                    want[f] = want.get(f, 0) + 1
    assert {r.rel: r.together for r in sums.collect()} == want
    top = {r.rel: r.contribution for r in cochange.cochange_scores(sums, sd).collect()}
    assert max(top.values()) == 1.0 and all(abs(v - want[k] / max(want.values())) < 1e-12 for k, v in top.items())
    rows = cochange.outside(sums.unionByName(sums.limit(1).withColumn("rel", F.lit(".git/x"))), sd, None, exclude=["f1"]).collect()
    assert {r.rel for r in rows}.isdisjoint({"f0", "f3", "f1", ".git/x"}) and len(rows) == 5


def test_running_totals_and_percentiles_of_a_hot_group(spark):
    rnd = random.Random(2)
    rows = [(("hot" if i % 3 else f"g{i % 5}"), rnd.randint(0, 9), i) for i in range(400)] + [(None, 1, 400)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {r.i: r.t for r in running_total(df, ["g"], ["v", "i"], "v", "t").collect()}
    for g in {r[0] for r in rows}:
        total = 0
        for _, v, i in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]):
            total += v
            assert got[i] == total
    pct = {r.i: r.p for r in cume_dist(df.filter("g is not null"), "g", "v", "p").collect()}
    for g, v, i in rows[:-1]:
        same = [r for r in rows if r[0] == g]
        assert abs(pct[i] - sum(r[1] <= v for r in same) / len(same)) < 1e-12
    assert running_total(df.limit(0), ["g"], ["v"], "v", "t").count() == 0
    counts = df.groupBy("g").count().filter("g is not null")
    hot = hot_keys(counts, ["g"], "count", share=0.3, at_least=10)
    assert [r.g for r in hot.collect()] == ["hot"]
    assert join_on_key(df.filter("g is not null"), counts, ["g"], hot).count() == 400
