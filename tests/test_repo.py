import os
import subprocess

import pytest

from orrery.functions.counter import Counter, Exact
from orrery.plans import checks, evaluation, scaffold
from orrery.plans.repo import MAP, Repo, write_document
from orrery.plans.sync import sync_rules, sync_status
from orrery.sources import config
from orrery.streaming import commits


@pytest.fixture(scope="module")
def repo(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("repo")
    texts = {
        "AGENTS.md": "# Rules\nUse `src/core.py`, not `src/gone.py`.\n## Commands\n- Test: `pytest -q`\n", "src/core.py": "class Engine:\n    def start(self):\n        pass\n", "src/app.py": "from src.core import Engine\nEngine()\n",
        "tests/test_app.py": "import app\ndef test_app():\n    Engine()\n", "web/ui.ts": "export function drawPage(n: number) {}\n", "src/huge.py": "def huge_one(): pass\n" + "x = 1\n" * 6000, "docs/generated/leak.md": 'api_key = "sk_live_0123456789abcdef"\n',
        "context.config.yaml": "version: 1\nmodules:\n  core: [src/**]\n  ghost: [none/**]\nprofiles:\n  small:\n    inject: [target-files]\n    budget: 300\nconstraints:\n  - id: one\n    symbol: drawPage\n    only_in: [src/**]\nsync:\n  targets: [claude]\n",
    }
    for rel, text in texts.items():
        os.makedirs(os.path.dirname(root / rel), exist_ok=True)
        (root / rel).write_text(text)
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "one")
    (root / "src/core.py").write_text(texts["src/core.py"] + "# changed\n")
    return Repo(spark, config.load(str(root)))


def test_map(repo):
    text = repo.map(400)
    assert text.index("## src/core.py") < text.index("## tests/test_app.py") and "- L1 class `Engine`" in text and Counter().tokens(text) <= 440
    assert "more files didn't fit" in repo.map(60)


def test_pack_skips_what_does_not_fit(repo):
    p = repo.pack("small")
    assert "### src/core.py" in p.content and "### src/huge.py" not in p.content and "1 more file(s) don't fit" in p.content and p.tokens <= 330 and p.path.endswith("all-small.md")
    m = repo.pack("light", module="core")
    assert "### Outside this module" in m.content and "- web/ui.ts" in m.content and "## Rule Reminder" in m.content
    assert repo.pack("frontier", about="engine").notes
    with pytest.raises(ValueError):
        repo.pack("none")
    with pytest.raises(ValueError):
        repo.pack("light", module="none")


def test_diff_pack_leads_with_the_change(repo):
    text = repo.pack("small", diff="HEAD").content
    assert "_Changed in `HEAD`: `src/core.py`._" in text and text.index("### src/core.py") < text.index("### src/app.py") and "web/ui.ts" not in text
    with pytest.raises(ValueError):
        repo.pack("small", diff="no-such-revision")


def test_explain_adds_up(repo):
    rows = repo.explain("small", about="draw the page").collect()
    assert rows[0].rel == "web/ui.ts" and all(abs(r.score - (r.reference + r.scorers) * r.demotion) < 1e-9 for r in rows)
    assert {r.rel for r in rows if not r.included} == {"src/huge.py"}


def test_check(repo):
    rows = checks.run(repo).collect()
    got = {(r.level, r.name, r.subject or r.file) for r in rows}
    assert {("fail", "constraint", "one"), ("warn", "rot-path", "src/gone.py"), ("fail", "rot-module", "ghost"), ("fail", "secrets", "docs/generated/leak.md"), ("info", "coverage", "web/ui.ts"), ("warn", "sync", "claude"), ("warn", "repomap", None)} <= got
    assert {("ok", "rules", None), ("ok", "duplicate", None)} <= got and {r.name for r in rows} == set(checks.CHECKS)


def test_one_broken_check_or_constraint_hides_no_other(repo):
    old = repo.config.constraints
    repo.config.constraints = [{"id": "bad", "forbid_pattern": "(", "in": ["**"]}, {"id": "odd"}, *old, {"id": "good", "forbid_pattern": "Engine", "in": ["src/app.py"]}]
    try:
        broken = dict(checks.CHECKS) | {"zz": lambda r: 1 / 0}
        got = {(r.level, r.name, r.subject) for r in checks.run(repo, checks={k: broken[k] for k in ("constraint", "zz", "rules")}).collect()}
    finally:
        repo.config.constraints = old
    assert got == {("fail", "constraint", "bad"), ("fail", "constraint", "odd"), ("fail", "constraint", "one"), ("fail", "constraint", "good"), ("fail", "zz", None), ("ok", "rules", None)}


def test_a_map_older_than_the_code_is_told(repo):
    path = write_document(repo.config.root, MAP, "# old\n")
    os.utime(path, (1, 1))
    assert [(r.level, "src/app.py" in r.detail) for r in checks.repomap(repo).collect()] == [("warn", True)]
    os.utime(path, (4e9, 4e9))
    assert checks.repomap(repo).count() == 0
    os.remove(path)


def test_commands_of_the_rules(repo, monkeypatch):
    monkeypatch.setattr(checks.shutil, "which", lambda r: None)
    assert [(r.level, r.subject) for r in checks.rot_commands(repo).collect()] == [("warn", "pytest -q")]
    repo.config.rot["run"] = True
    for failure, want in ((None, []), ("it ends with 1", ["fail"])):
        monkeypatch.setattr(checks, "_failure", lambda c, root, f=failure: f)
        assert [r.level for r in checks.rot_commands(repo).collect()] == want
    repo.config.rot["skip_commands"] = ["pytest"]
    assert [r.level for r in checks.rot_commands(repo).collect()] == ["info"]
    repo.config.rot.update(run=False, skip_commands=[])
    monkeypatch.undo()
    assert checks._failure("exit 3", repo.config.root) == "it ends with 3" and checks._failure("true", repo.config.root) is None


def test_search(repo):
    text = repo.context("pytest")
    assert text.startswith('<!-- sections for "pytest" -->\n') and "## Commands" in text and repo.context("nothing-like-this").startswith("Nothing is said of")
    assert Counter().tokens(repo.context("pytest", 12)) <= 12 and "## Commands" not in repo.context("pytest", 12)
    assert "src/core.py:1 class `Engine`" in repo.find("Engine") and "src/app.py:2 Engine()" in repo.find("Engine")


def test_rules_and_module_context(repo):
    assert repo.rules().startswith("# Rules")
    write_document(repo.config.root, "docs/context/core.md", "About the core.\n")
    text = repo.module_context("core", "small")
    assert text.startswith("<!-- docs/context/core.md -->\nAbout the core.") and "### src/core.py" in text
    assert "no module is called" in repo.module_context("none") and "no profile is called" in repo.module_context("core", "none")


def test_sync(repo):
    assert [s for *_, s in sync_status(repo.config)] == ["missing"]
    assert sync_rules(repo.config) == [("CLAUDE.md", "written")] and [s for *_, s in sync_status(repo.config)] == ["in sync"]
    assert sync_rules(repo.config) == [("CLAUDE.md", "unchanged")]
    open(os.path.join(repo.config.root, "CLAUDE.md"), "w").write("mine")
    assert sync_rules(repo.config) == [("CLAUDE.md", "refused")] and sync_rules(repo.config, force=True, link=True) == [("CLAUDE.md", "linked")]
    assert [s for *_, s in sync_status(repo.config)] == ["in sync"] and sync_rules(repo.config, link=True) == [("CLAUDE.md", "unchanged")]
    assert sync_rules(repo.config) == [("CLAUDE.md", "written")] and not os.path.islink(os.path.join(repo.config.root, "CLAUDE.md"))
    assert [t for t, *_ in sync_status(config.Config(repo.config.root))] == ["claude"]
    with pytest.raises(ValueError):
        sync_status(config.Config(repo.config.root, sync={"targets": ["none"]}))


def test_scorers_and_counter_can_be_given(repo, spark):
    from pyspark.sql import functions as F

    lift = lambda files: files.filter("rel = 'web/ui.ts'").select("repo", "rel", F.lit(9.0).alias("contribution"))
    words = Exact(lambda: lambda t: len(t.split()))
    other = Repo(spark, repo.config, scorers=[lift], counter=words)
    p = other.pack("small")
    assert p.tokens == len(p.content.split()) and p.content.index("### web/ui.ts") < p.content.index("### src/core.py")
    assert words.tokens("a b c") == 3 and type(Exact(lambda: 1 / 0)) is Counter
    assert len(other.map(30).split()) <= 30 + 8


def test_evaluation_from_packs_to_report(repo):
    tasks = [{"id": "t1", "question": "Where is Engine?", "expect": ["core.py"], "expect_file": "src/core.py"}, {"id": "t2", "question": "q", "expect": ["x"], "expect_file": "src/huge.py"}, {"id": "t3", "question": "q", "expect": ["x"]}]
    cells, rates = evaluation.dry_run(repo, tasks, ["small", "mid"])
    got = {(r.profile, r.id): (r.outline_hit, r.content_hit) for r in cells.collect()}
    assert got == {("small", "t1"): (False, True), ("small", "t2"): (False, False), ("small", "t3"): (None, None), ("mid", "t1"): (True, False), ("mid", "t2"): (True, False), ("mid", "t3"): (None, None)}
    text = evaluation.dry_run_report(cells, rates, "2026-01-01")
    assert "| small | t1 | no | yes |" in text and "| mid | 2 | 100 % | 0 % |" in text and "not counted: t3." in text
    commands = evaluation.models("echo=sh -c 'cat >/dev/null && echo it is in SRC/CORE.PY'; bad=false")
    assert evaluation.model_run(repo, tasks, ["small"], commands, lambda n: n == 0) is None and evaluation.model_run(repo, [], ["small"], commands, lambda n: True) is None
    results = evaluation.model_run(repo, tasks[:1], ["small"], commands, lambda n: n == 2)
    assert {r.model: r.passed for r in results.collect()} == {"echo": True, "bad": False}
    text = evaluation.model_report(results, "2026-01-01")
    assert "| small | echo | 1 | 100 % |" in text and "| small | bad | t1 | no |" in text
    with pytest.raises(ValueError):
        evaluation.models("nameless")


def test_scaffold(tmp_path, spark):
    for rel in ("src/x/a.py", "src/x/b.py", "src/x/c.py", "one.py"):
        write_document(str(tmp_path), rel, "x = 1\n")
    write_document(str(tmp_path), "pytest.ini", "")
    write_document(str(tmp_path), "far/away/Makefile", "")
    c = config.load(str(tmp_path))
    assert scaffold.scaffold(spark, c, auto=True, ci=True) == [(config.FILE, "created"), ("AGENTS.md", "created"), (".github/workflows/context.yml", "created")]
    again = config.load(str(tmp_path))
    assert again.modules == {"x": ["src/x/**"]} and again.profiles == config.PROFILES and again.sync == {"targets": ["claude"]}
    text = (tmp_path / "AGENTS.md").read_text()
    assert "- Test (python): `pytest`" in text and "make" not in text.lower() and (tmp_path / "docs/context").is_dir()
    assert [s for _, s in scaffold.scaffold(None, c)] == ["kept", "kept"]
    with pytest.raises(ValueError):
        scaffold.scaffold(None, c, hooks=True)
    os.makedirs(tmp_path / ".git/hooks")
    assert scaffold.scaffold(None, c, hooks=True)[-1] == (".git/hooks/pre-commit", "created") and os.access(tmp_path / ".git/hooks/pre-commit", os.X_OK)


def test_command_line(repo, capsys, monkeypatch, spark):
    from orrery import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    root = repo.config.root
    run = lambda *a: (cli.main([*a, "--root", root]), capsys.readouterr().out)
    assert run("map", "--out", "docs/generated/m.md")[0] == 0 and os.path.exists(os.path.join(root, "docs/generated/m.md"))
    assert "### src/core.py" in run("pack", "--profile", "small", "--stdout")[1] and "wrote " in run("pack", "--profile", "small")[1] and os.path.exists(os.path.join(root, "docs/generated/packs/all-small.md"))
    code, out = run("check")
    assert code == 1 and "fail  constraint: [one] web/ui.ts:1 defines drawPage" in out
    run("check", "--update-baseline")
    assert run("check")[0] == 0 and run("check", "--no-baseline")[0] == 1
    write_document(root, "tasks.yaml", "tasks:\n  - id: t1\n    question: q\n    expect: [x]\n    expect_file: src/core.py\n")
    assert "| small | t1 | no | yes |" in run("eval", os.path.join(root, "tasks.yaml"), "--profile", "small", "--stdout")[1]
    assert run("rules")[1].startswith("# Rules") and "class `Engine`" in run("find", "Engine")[1]


def test_stream_of_commits(spark, tmp_path):
    rows = [("r", f"s{i}", i, f) for i in range(6) for f in ("a", "b", f"c{i % 2}")]
    schema = "repo string, sha string, commit_ord int, rel string"
    for k in range(2):
        spark.createDataFrame(rows[k * 9 : k * 9 + 9], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seeds = spark.createDataFrame([("r", "a")], "repo string, rel string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    commits.maintain(stream, seeds, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.rel: r.together for r in commits.read(spark, str(tmp_path / "out")).collect()} == {"b": 6, "c0": 3, "c1": 3}


def test_stream_of_commits_in_parts(spark, tmp_path):
    """Commits whose files come in several batches, some again, one of which grows too large."""
    from orrery.operators import cochange

    rows = [("r", f"s{i}", i, f) for i in range(5) for f in ("a", "b", f"c{i}")] + [("r", "s4", 4, f"x{i}") for i in range(3)]
    schema = "repo string, sha string, commit_ord int, rel string"
    for part in (rows[0::3], rows[1::3] + rows[0:4], rows[2::3]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seeds = spark.createDataFrame([("r", "a"), ("r", "c1")], "repo string, rel string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    commits.maintain(stream, seeds, str(tmp_path / "out"), str(tmp_path / "cp"), bulk=4).awaitTermination(180)
    whole = cochange.seed_sums(cochange.window_commits(spark.createDataFrame(rows, schema), bulk=4), seeds)
    assert {r.rel: r.together for r in commits.read(spark, str(tmp_path / "out")).collect()} == {r.rel: r.together for r in whole.collect()}
