"""The checks of a repository. Each is a function of the repository that gives results and registers itself by name.

A result is (level, name, detail, file, line, subject). A check that finds nothing gives one "ok" result, one that is
switched off an "info", one that breaks a failure of its own; none hides another.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.glob import matches
from orrery.operators import baseline, health, outline, rot
from orrery.operators.skew import cut
from orrery.plans.repo import MAP, Repo
from orrery.plans.sync import sync_status
from orrery.sources import baseline_file
from orrery.sources.config import FILE, GENERATED

CHECKS: dict[str, Callable[[Repo], DataFrame]] = {}
#: Seconds that a command of the rules may take.
COMMAND_SECONDS = 60


def check(name: str) -> Callable[[Callable[[Repo], DataFrame]], Callable[[Repo], DataFrame]]:
    def register(f: Callable[[Repo], DataFrame]) -> Callable[[Repo], DataFrame]:
        CHECKS[name] = f
        return f

    return register


def run(repo: Repo, use_baseline: bool = True, checks: dict[str, Callable[[Repo], DataFrame]] | None = None) -> DataFrame:
    """The results of all checks; failures that the baseline knows are warnings."""
    results = told(repo, [])
    for name, f in (CHECKS if checks is None else checks).items():
        try:
            part = cut(f(repo))
            part = told(repo, [("ok", name, "nothing found", None, None, None)]) if part.isEmpty() else part
        except Exception as x:
            part = told(repo, [("fail", name, f"the check broke: {next(iter(str(x).splitlines()), type(x).__name__)}", None, None, None)])
        results = results.unionByName(part)
    return baseline.apply(results, baseline_file.read(repo.spark, repo.config.root)) if use_baseline else results


def told(repo: Repo, rows: list[tuple]) -> DataFrame:
    return repo.spark.createDataFrame(rows, baseline.RESULT)


def found(df: DataFrame, level: str, name: str, detail: Column, file: str | Column = "rel", line: str | None = None, subject: str | Column | None = None) -> DataFrame:
    col = lambda c, t: (F.col(c) if isinstance(c, str) else c if c is not None else F.lit(None)).cast(t)
    return df.select(F.lit(level).alias("level"), F.lit(name).alias("name"), detail.alias("detail"), col(file, "string").alias("file"), col(line, "int").alias("line"), col(subject, "string").alias("subject"))


def _say(*parts: str | Column) -> Column:
    """Text with columns in it."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


AT = lambda: _say(F.col("rel"), ":", F.col("line"))


@check("rules")
def rules(repo: Repo) -> DataFrame:
    if repo.agents is None:
        return told(repo, [("fail", "rules", "there are no rules: AGENTS.md is missing", None, None, None)])
    long = health.long_texts(repo.files.filter("rel = 'AGENTS.md'"), ["rel"], repo.config.rules["max_lines"])
    return found(long, "warn", "rules", _say(F.col("rel"), " is ", F.col("n_lines"), " lines long"))


@check("repomap")
def repomap(repo: Repo) -> DataFrame:
    """The map must not be older than a source file."""
    path = os.path.join(repo.config.root, MAP)
    if not os.path.exists(path):
        return told(repo, [("warn", "repomap", "there is no map yet", None, None, None)])
    newer = health.first_newer(repo.sources, "rel", "mtime", datetime.fromtimestamp(os.path.getmtime(path), timezone.utc))
    return told(repo, [("warn", "repomap", f"the map is older than {newer}", None, None, None)] if newer else [])


@check("constraint")
def constraints(repo: Repo) -> DataFrame:
    """Each constraint by itself: one that can't be read is a failure of its own."""
    out, imports = told(repo, []), None
    for i, c in enumerate(repo.config.constraints):
        id_ = str(c.get("id") or i + 1)
        wrong = None
        if c.get("symbol") and c.get("only_in"):
            hit = health.only_in(repo.symbols, c["symbol"], c["only_in"])
            detail = _say(f"[{id_}] ", AT(), f" defines {c['symbol']}")
        elif c.get("from") and c.get("must_not_import"):
            imports = imports if imports is not None else cut(outline.resolve(outline.imports(repo.sources, ["repo", "rel"]), repo.files, ["repo"]))
            hit = health.must_not_import(imports, c["from"] if isinstance(c["from"], list) else [c["from"]], c["must_not_import"])
            detail = _say(f"[{id_}] ", AT(), " imports ", F.col("specifier"))
        elif c.get("forbid_pattern") and c.get("in"):
            wrong = health.valid_pattern(repo.spark, c["forbid_pattern"])
            hit = None if wrong else health.forbid_pattern(repo.files, ["rel"], c["forbid_pattern"], c["in"])
            detail = _say(f"[{id_}] ", AT(), " holds the pattern")
        else:
            wrong, hit = "it is of no known form", None
        if hit is None:
            out = out.unionByName(told(repo, [("fail", "constraint", f"[{id_}] can't be checked: {wrong}", None, None, id_)]))
        else:
            out = out.unionByName(found(hit, "fail", "constraint", detail, line="line", subject=F.lit(id_)))
    return out


def _off(repo: Repo, name: str, level: str) -> DataFrame | None:
    return told(repo, [("info", name, "switched off", None, None, None)]) if level == "off" else None


@check("duplicate")
def duplicate(repo: Repo) -> DataFrame:
    level = repo.config.health["duplicates"]
    names = health.duplicate_names(health.duplicates(repo.symbols))
    return _off(repo, "duplicate", level) or found(names, level, "duplicate", _say(F.col("name"), " has the same signature in ", F.col("n_files"), " files, ", F.col("first"), " the first"), file="first", subject="name")


@check("orphan")
def orphan(repo: Repo) -> DataFrame:
    h = repo.config.health
    lost = health.orphans(repo.sources, repo.symbols, health.referenced(repo.counts, repo.symbols, ["repo"], "rel"), ["repo"], "rel", "rel", h["orphan_ignore"])
    return _off(repo, "orphan", h["orphans"]) or found(lost, h["orphans"], "orphan", _say("no other file names anything of ", F.col("rel")), subject="rel")


@check("coverage")
def coverage(repo: Repo) -> DataFrame:
    level = repo.config.health["coverage"]
    return _off(repo, "coverage", level) or found(health.uncovered(repo.sources, repo.config.modules), level, "coverage", _say(F.col("rel"), " belongs to no module"), subject="rel")


def _spans(repo: Repo) -> DataFrame:
    return rot.backticks(repo.files.filter("rel = 'AGENTS.md'"), ["rel"])


@check("rot-path")
def rot_paths(repo: Repo) -> DataFrame:
    gone = rot.missing_paths(_spans(repo), repo.files)
    return found(gone, "warn", "rot-path", _say(AT(), " names ", F.col("text"), ", which isn't there"), line="line", subject="text")


@check("rot-command")
def rot_commands(repo: Repo) -> DataFrame:
    """Commands under a heading called Commands: their runner must be there. They are run only if the settings say so
    (``rot.run``), and then not those that don't end by themselves."""
    spans = rot.commands(_spans(repo), repo.config.rot.get("skip_commands") or []).collect()  # those of one document
    rows, there = [], {}
    for s in spans:
        at, runner = f"{s.rel}:{s.line}", s.text.split()[0]
        if not repo.config.rot.get("run"):
            there[runner] = there[runner] if runner in there else shutil.which(runner) is not None
            if not there[runner]:
                rows.append(("warn", "rot-command", f"{at} wants {runner}, which isn't on the path", s.rel, s.line, s.text))
        elif s.reason:
            rows.append(("info", "rot-command", f"{at} wasn't run: {s.reason}", s.rel, s.line, s.text))
        else:
            why = _failure(s.text, repo.config.root)
            if why:
                rows.append(("fail", "rot-command", f"{at} fails: {why}", s.rel, s.line, s.text))
    return told(repo, rows)


def _failure(command: str, root: str) -> str | None:
    try:
        code = subprocess.run(command, shell=True, cwd=root, capture_output=True, timeout=COMMAND_SECONDS).returncode
    except subprocess.TimeoutExpired:
        return f"it takes more than {COMMAND_SECONDS} s"
    except OSError as x:
        return str(x)
    return f"it ends with {code}" if code else None


@check("rot-module")
def rot_modules(repo: Repo) -> DataFrame:
    counts = health.module_counts(repo.files, repo.config.modules).filter("n_files = 0")
    return found(counts, "fail", "rot-module", _say("module ", F.col("module"), " holds no file"), file=F.lit(FILE), subject="module")


@check("secrets")
def secrets(repo: Repo) -> DataFrame:
    hits = health.secret_lines(repo.files.filter(matches(F.col("rel"), ["AGENTS.md", "docs/context/**", f"{GENERATED}/**", "**/AGENTS.md"])), ["rel"])
    return found(hits, "fail", "secrets", _say(AT(), " looks like a secret"), line="line")


@check("sync")
def sync(repo: Repo) -> DataFrame:
    return told(repo, [("warn", "sync", f"{path} is {state}", path, None, name) for name, path, state in sync_status(repo.config) if state != "in sync"])
