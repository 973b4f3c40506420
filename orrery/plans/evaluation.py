"""Does what a pack holds answer the tasks? By looking at packs only, or by asking models."""

from __future__ import annotations

import shlex
import subprocess
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import evaluate
from orrery.operators.skew import cut
from orrery.plans.repo import Repo

TASK = "id string, question string, expect array<string>, expect_file string"
ANSWER = "profile string, model string, id string, answer string, seconds double, tokens bigint"
MODEL_SECONDS = 300


def task_rows(repo: Repo, tasks: Sequence[dict]) -> DataFrame:
    return repo.spark.createDataFrame([(t["id"], t["question"], [str(e) for e in t["expect"]], t.get("expect_file")) for t in tasks], TASK)


def pack_items(repo: Repo, profiles: Sequence[str], module: str | None = None) -> DataFrame:
    """(profile, rel, in_outline, included): the files whose outline or content each profile's pack shows."""
    out = None
    for name in profiles:
        text = repo.pack(name, module).content
        document = repo.spark.createDataFrame([(name, text)], "profile string, text string")
        lines = document.select("profile", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
        part = lambda title, mark: evaluate.headings(lines, title, mark)
        rows = part("Repository Map", "## ").withColumns({"in_outline": F.lit(True), "included": F.lit(False)}).unionByName(part("Target Files", "### ").withColumns({"in_outline": F.lit(False), "included": F.lit(True)}))
        out = rows if out is None else out.unionByName(rows)
    return cut(out)


def dry_run(repo: Repo, tasks: Sequence[dict], profiles: Sequence[str], module: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, rates) of the profiles' packs; no model is asked."""
    cells = cut(evaluate.cells(list(profiles), task_rows(repo, tasks), pack_items(repo, profiles, module)))
    return cells, evaluate.rates(cells)


def dry_run_report(cells: DataFrame, rates: DataFrame, date: str) -> str:
    mark = lambda x: "–" if x is None else "yes" if x else "no"
    rows = cells.orderBy("profile", "id").collect()  # a cell per task and profile
    out = f"# What the packs hold ({date})\n\n| profile | task | outline | content |\n|---|---|---|---|\n" + "".join(f"| {r.profile} | {r.id} | {mark(r.outline_hit)} | {mark(r.content_hit)} |\n" for r in rows)
    out += "\n| profile | tasks | outline | content |\n|---|---|---|---|\n"
    for r in rates.select("profile", "n", evaluate.percent(F.col("outline_rate")).alias("o"), evaluate.percent(F.col("content_rate")).alias("c")).orderBy("profile").collect():
        out += f"| {r.profile} | {r.n} | {r.o} % | {r.c} % |\n" if r.n else f"| {r.profile} | 0 | – | – |\n"
    skipped = sorted({r.id for r in rows if r.content_hit is None})
    return out + (f"\nWithout an expected file, so not counted: {', '.join(skipped)}.\n" if skipped else "")


def models(text: str) -> dict[str, str]:
    """``name=command`` pairs, parted by semicolons."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, eq, command = part.partition("=")
        if not (eq and name.strip() and command.strip()):
            raise ValueError(f"a model is given as name=command, not {part!r}")
        out[name.strip()] = command.strip()
    return out


def ask(command: str, prompt: str) -> str | None:
    """What a command prints when it reads the prompt; None if it fails."""
    try:
        run = subprocess.run(shlex.split(command), input=prompt, capture_output=True, text=True, timeout=MODEL_SECONDS)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return run.stdout if run.returncode == 0 else None


def model_run(repo: Repo, tasks: Sequence[dict], profiles: Sequence[str], commands: dict[str, str], confirm: Callable[[int], bool], module: str | None = None) -> DataFrame | None:
    """(profile, model, id, passed, tokens, seconds, answer) of every call, after ``confirm`` has seen their number.

    The calls go from the driver, one at a time, as they are few and cost money; None if there are none or they are
    declined.
    """
    calls = evaluate.matrix(list(profiles), list(commands), task_rows(repo, tasks)).orderBy("profile", "model", "id").collect() if profiles and commands and tasks else []
    if not calls or not confirm(len(calls)):
        return None
    packs, by_id, rows = {p: repo.pack(p, module) for p in profiles}, {t["id"]: t for t in tasks}, []
    for c in calls:
        at, pack = time.monotonic(), packs[c.profile]
        answer = ask(commands[c.model], f"{pack.content}\n\n{by_id[c.id]['question']}\n")
        rows.append((c.profile, c.model, c.id, answer, time.monotonic() - at, pack.tokens))
    answers = repo.spark.createDataFrame(rows, ANSWER).join(task_rows(repo, tasks).select("id", "expect"), "id")
    return cut(answers.select("profile", "model", "id", evaluate.passed(F.col("answer"), F.col("expect")).alias("passed"), "tokens", "seconds", evaluate.clip(F.coalesce("answer", F.lit("(failed)"))).alias("answer")))


def model_report(results: DataFrame, date: str) -> str:
    rows = results.orderBy("profile", "model", "id").collect()
    out = f"# What the models answered ({date})\n\n| profile | model | task | passed | tokens | s | answer |\n|---|---|---|---|---|---|---|\n"
    out += "".join(f"| {r.profile} | {r.model} | {r.id} | {'yes' if r.passed else 'no'} | {r.tokens} | {r.seconds:.1f} | {r.answer.replace('|', ' ')} |\n" for r in rows)
    out += "\n| profile | model | calls | passed |\n|---|---|---|---|\n"
    return out + "".join(f"| {r.profile} | {r.model} | {r.n} | {r.p} % |\n" for r in evaluate.pass_rates(results).select("profile", "model", "n", evaluate.percent(F.col("rate")).alias("p")).orderBy("profile", "model").collect())
