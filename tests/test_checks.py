import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from orrery.operators import baseline, detect, evaluate, health, lookup, outline, rank, rot, sections
from orrery.sources import baseline_file, config, git
from orrery.sources.files import read_tree, walk


def write(root, rel, text, mode="w"):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def test_walk_skips_what_it_must(tmp_path, spark):
    for rel in (".venv/lib/junk.py", "node_modules/p/i.js", "gen/out.py", "pkg/__init__.py", "_x/a.py", "big.py", "src/b.py"):
        write(tmp_path, rel, "x" * (600_000 if rel == "big.py" else 1))
    write(tmp_path, "src/bin.dat", b"a\0b", "wb")
    os.symlink(tmp_path / "src/b.py", tmp_path / "src/link.py")
    assert [r[0] for r in walk(str(tmp_path), exclude=["gen"])] == ["_x/a.py", "pkg/__init__.py", "src/b.py", "src/bin.dat"]
    rows = {r.rel: r.text for r in read_tree(spark, str(tmp_path), include=["src/**"]).collect()}
    assert rows == {"src/b.py": "x", "src/bin.dat": None}
    assert read_tree(spark, str(tmp_path / "none")).count() == 0


def test_duplicates(spark):
    rows = [("a.py", "helper", "(a,  b)", True), ("b.py", "helper", "(a, b)", True), ("c.py", "helper", "(z)", True), ("tests/d.py", "helper", "(a,b)", True), ("a.py", "abc", "(x)", True), ("b.py", "abc", "(x)", True),
            ("a.py", "__init__", "(x)", True), ("b.py", "__init__", "(x)", True), ("a.py", "CONST", "", True), ("b.py", "CONST", "", True), ("a.py", "method", "(s)", False), ("b.py", "method", "(s)", False)]
    got = health.duplicates(spark.createDataFrame(rows, "rel string, name string, signature string, top_level boolean"))
    assert sorted((r.name, r.rel) for r in got.collect()) == [("helper", "a.py"), ("helper", "b.py")]
    assert [tuple(r) for r in health.duplicate_names(got).select("name", "n_files", "first").collect()] == [("helper", 2, "a.py")]
    assert health.duplicates(got.withColumns({"signature": F.lit(None).cast("string"), "top_level": F.lit(True)})).count() == 0


def test_orphans_and_coverage(spark):
    files = spark.createDataFrame([("r", "src/used.ts", "export const thing = () => 1"), ("r", "src/consumer.ts", "thing()\nfunction other() {}\nother"), ("r", "src/lonely.ts", "function lonely() {}"), ("r", "src/none.ts", "1"), ("r", "src/index.ts", "function entry() {}")], "repo string, rel string, text string")
    s = outline.symbols(files, ["repo", "rel"])
    refs = health.referenced(rank.word_counts(files, ["repo", "rel"]), s, ["repo"], "rel")
    assert sorted(r.rel for r in health.orphans(files, s, refs, ["repo"], "rel", "rel").collect()) == ["src/consumer.ts", "src/lonely.ts"]
    assert [r.rel for r in health.uncovered(files, {"m": ["src/[!l]*"]}).collect()] == ["src/lonely.ts"] and health.uncovered(files, {}).count() == 0


def test_constraints(spark):
    files = spark.createDataFrame([("a/x.py", "import twin.db\nfrom ok import y\nprint(1)"), ("b/y.py", "def only(): pass")], "rel string, text string")
    imports = outline.imports(files, ["rel"])
    assert [(r.specifier, r.line) for r in health.must_not_import(imports, ["a/**"], ["twin/**"]).collect()] == [("twin.db", 1)]
    assert [r.rel for r in health.only_in(outline.symbols(files, ["rel"]), "only", ["a/**"]).collect()] == ["b/y.py"]
    assert [(r.rel, r.line) for r in health.forbid_pattern(files, ["rel"], r"print\(", ["**"]).collect()] == [("a/x.py", 3)]
    assert health.valid_pattern(spark, "(") and health.valid_pattern(spark, r"a(?!b)\z") is None
    counts = {r.module: r.n_files for r in health.module_counts(files, {"a": ["a/**"], "none": ["x/**"], "all": ["**"]}).collect()}
    assert counts == {"a": 1, "none": 0, "all": 2} and health.module_counts(files, {}).count() == 0 and health.module_counts(files.limit(0), {"a": ["a/**"]}).first().n_files == 0


def test_secret_lines(spark):
    df = spark.createDataFrame([("l.md", 'a\napi_key = "sk_live_0123456789abcdef"\ntoken: "short"')], "rel string, text string")
    assert [r.line for r in health.secret_lines(df, ["rel"]).collect()] == [2]


def test_rot(spark):
    text = "# T\nSee `src/a.py` and `src/gone.py`, `docs/*.md`, `x/*.zip`, `src`.\n```\n`in/fence.py`\n```\n## Commands\n- Watch: `npm run dev` · Test: `pytest -q`\n`<place>/x` `http://a/b`\n# Other\n`make x`"
    doc = spark.createDataFrame([("AGENTS.md", text)], "rel string, text string")
    spans = rot.backticks(doc, ["rel"])
    rows = [(r.text, r.line, r.label, r.in_commands) for r in spans.orderBy("line", "span_no").collect()]
    assert ("npm run dev", 7, "Watch", True) in rows and ("pytest -q", 7, "Test", True) in rows and ("make x", 10, "", False) in rows and not any(r[0] == "in/fence.py" for r in rows)
    files = spark.createDataFrame([("src/a.py",), ("docs/b.md",)], "rel string")
    assert {r.text for r in rot.missing_paths(spans, files).collect()} == {"src/gone.py", "x/*.zip"}
    reason = spans.filter(rot.is_command(F.col("text"))).select("text", rot.non_terminating_reason(F.col("text"), F.col("label"), ["make"]).alias("why")).collect()
    assert {r.text: bool(r.why) for r in reason} == {"npm run dev": True, "pytest -q": False, "make x": True}
    assert {(r.text, bool(r.reason)) for r in rot.commands(spans).collect()} == {("npm run dev", True), ("pytest -q", False)}
    assert rot.missing_paths(spans.limit(0), files).count() == 0


def test_baseline(spark, tmp_path):
    rows = [("fail", "c", "one", "a.py", 3, "id"), ("fail", "c", "two", "b.py", None, None), ("warn", "c", "prose", None, None, None), ("info", "c", "three", "c.py", 1, None)]
    results = spark.createDataFrame(rows, baseline.RESULT)
    known = baseline.entries(results.filter("detail <> 'two'"))
    baseline_file.write(str(tmp_path), known)
    back = baseline_file.read(spark, str(tmp_path))
    assert back.exceptAll(known).count() == 0 and back.count() == known.count() == 2
    reworded = spark.createDataFrame([("fail", "c", "other words", "a.py", 3, "id"), ("fail", "c", "two", "b.py", None, None), ("fail", "c", "x", "a.py", 3, "other"), ("info", "c", "i", None, None, None)], baseline.RESULT)
    got = {(r.detail.removesuffix(baseline.KNOWN), r.level) for r in baseline.apply(reworded, back).collect()}
    assert got == {("other words", "warn"), ("two", "fail"), ("x", "fail"), ("i", "info")}
    (tmp_path / baseline_file.FILE).write_text("{broken")
    assert baseline_file.read(spark, str(tmp_path)).count() == 0
    (tmp_path / baseline_file.FILE).write_text(json.dumps({"version": 1, "entries": [{"check": "c", "identifier": "prose"}]}))
    assert baseline_file.read(spark, str(tmp_path)).first().identifier == "prose"


def test_sections(spark):
    df = spark.createDataFrame([("a.md", "pre token\n## One Token \nbody token token\n\n## Two\n"), ("b.md", None), ("c.md", " \n")], "source string, text string")
    s = sections.split_sections(df, "source", "text").orderBy("section_ord").collect()
    assert [(r.heading, r.body.split("\n")[0].strip()) for r in s] == [("", "pre token"), ("One Token", "## One Token"), ("Two", "## Two")]
    found = sections.search(sections.split_sections(df, "source", "text"), "TOKEN", ["source", "section_ord"])
    assert [(r.heading, r.score) for r in found.collect()] == [("One Token", 8), ("", 1)]
    assert [sections.within_budget(found, ["source", "section_ord"], n).count() for n in (7, 9, 10)] == [0, 1, 2]  # 30 units, then 39


def test_evaluation(spark):
    tasks = spark.createDataFrame([("t1", "a.py"), ("t2", "b.py"), ("t3", None)], "id string, expect_file string")
    items = spark.createDataFrame([("mid", "a.py", True, False), ("light", "a.py", True, True), ("light", "b.py", True, True)], "profile string, rel string, in_outline boolean, included boolean")
    cells = evaluate.cells(["mid", "light", "none"], tasks, items)
    assert cells.count() == 9 and cells.filter("content_hit is null").count() == 3
    got = {r.profile: (r.n, r.outline_rate, r.content_rate) for r in evaluate.rates(cells).collect()}
    assert got == {"mid": (2, 0.5, 0.0), "light": (2, 1.0, 1.0), "none": (2, 0.0, 0.0)}
    assert evaluate.matrix(["a"], ["m", "n"], tasks).count() == 6
    text = "# P\n\n## Repository Map\n\n## a.py\n- L1\n## b.py\n\n## Target Files\n\n### a.py\n## Not a part\n### c.py\n## Rule Reminder\n\n### d.py\n"
    lines = spark.createDataFrame([("mid", i, l) for i, l in enumerate(text.split("\n"))], "profile string, n int, line string")
    assert {r.rel for r in evaluate.headings(lines, "Repository Map", "## ").collect()} == {"a.py", "b.py"} and {r.rel for r in evaluate.headings(lines, "Target Files", "### ").collect()} == {"a.py", "c.py"}
    assert [r.p for r in spark.createDataFrame([("The ANSWER",), (None,)], "a string").select(evaluate.passed(F.col("a"), F.array(F.lit("answer"))).alias("p")).collect()] == [True, False]


def test_detect(spark):
    files = spark.createDataFrame([(p, "") for p in ["web/a.ts", "web/b.ts", "web/c.ts", "src/x/1.py", "src/x/2.py", "src/x/3.py", "src/x/4.py", "one.py", "few/a.py"]] + [("pytest.ini", ""), ("web/package.json", '{"scripts": {"test": "vitest", "build": "tsc"}}'), ("bad/package.json", "{")], "rel string, text string")
    assert {(r.module, r.glob) for r in detect.modules(files).collect()} == {("x", "src/x/**"), ("web", "web/**")}
    assert {(r.dir, r.command) for r in detect.commands(files).collect()} == {(".", "pytest"), ("web", "cd web && npm test"), ("web", "cd web && npm run build")}


def test_lookup(spark):
    s = spark.createDataFrame([("runIt",), ("rerunItNow",)], "name string")
    assert [r.name for r in lookup.find_symbols(s, "runIt").collect()] == ["runIt"] and lookup.find_symbols(s, "RUNIT").count() == 2
    f = spark.createDataFrame([("b", "x run\nrunner\n run("), ("a", "no")], "rel string, text string")
    assert [(r.line, r.line_text) for r in lookup.reference_lines(f, "run", ["rel"], ["rel"]).collect()] == [(1, "x run"), (3, "run(")]


def test_config(tmp_path):
    (tmp_path / config.FILE).write_text("version: 1\nmodules:\n  core: [src/**, 'a b/**']\n  web:\n    - web/**  # all\nhealth:\n  orphans: fail\nconstraints:\n  - id: one\n    symbol: X\n    only_in: [a/**]\nunknown: 1\n")
    c = config.load(str(tmp_path))
    assert c.modules == {"core": ["src/**", "a b/**"], "web": ["web/**"]} and c.health["orphans"] == "fail" and c.health["duplicates"] == "warn"
    assert c.constraints == [{"id": "one", "symbol": "X", "only_in": ["a/**"]}]
    with pytest.raises(ValueError):
        c.profile("none")
    (tmp_path / config.FILE).write_text("version: 2\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path))


def test_git(tmp_path, spark):
    run = lambda *a: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(3):
        write(tmp_path, f"d/é{i}.py", str(i))
        run("add", ".")
        run("commit", "-qm", str(i))
    (tmp_path / "d/é0.py").unlink()
    write(tmp_path, "new.py", "1")
    run("add", "-A")
    assert [f for _, f in git.log(str(tmp_path))] == [["d/é2.py"], ["d/é1.py"], ["d/é0.py"]]
    assert git.changed_files(str(tmp_path), "--staged") == ["new.py"]
    assert not git.history_available(str(tmp_path)) and git.read_history(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        git.changed_files(str(tmp_path), "nope..nope")
    assert git.is_repo(str(tmp_path)) and not git.is_repo(str(tmp_path / ".git"))
    for _ in range(2):
        assert git.cached_history(spark, str(tmp_path), str(tmp_path / "cache")).count() == 0 and os.listdir(tmp_path / "cache") == [f"{git.head(str(tmp_path))}-500"]


def test_queries_read_every_source_however_it_is_spelled(spark, tmp_path):
    from datetime import datetime

    from orrery.plans import queries

    at = lambda day: datetime(2026, 1, day)
    rows = [(1, "r", "a.md", "changelog", "pre\n## One\nx\n## Two\ny", at(1)), (2, "r", "b.md", None, "## Three\nz", at(1)), (3, "r", "c.md", "README ", "## Four\n", at(1)), (4, "r", "d.md", "readme", "plain", at(1)),
            (5, "r", "m.md", " Repo-Map", "map", at(2)), (6, "r", "x.py", "CODE", "long code text " * 9, at(3)), (7, "s", "m.md", "repo_map", "map", at(5)), (8, "s", "x.py", "code", "c", at(4)), (9, "t", "e.md", "design", None, at(1))]
    spark.createDataFrame(rows, "doc_id int, repo string, rel string, source string, text string, updated_at timestamp").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    split = {(r.doc_id, r.section_ord): r.heading for r in run("section_split")}
    assert {k: v for k, v in split.items() if k[0] < 5} == {(1, 0): "", (1, 1): "One", (1, 2): "Two", (2, 0): "Three", (3, 0): "Four", (4, 0): ""} and {k[0] for k in split} == set(range(1, 9))
    assert {r.repo for r in run("stale_maps")} == {"r"}
