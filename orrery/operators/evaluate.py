"""Does a pack hold what a task needs? Cells of profiles and tasks, rates, and grading of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cells(profiles: list[str], tasks: DataFrame, items: DataFrame) -> DataFrame:
    """(profile, id, outline_hit, content_hit): whether a task's expected file is in the profile's pack.

    ``items`` holds (profile, rel, in_outline, included). A task without ``expect_file`` isn't scored: both are null.
    Every task appears once per profile: the profiles are a list, which each task row carries, so no join pairs them.
    """
    rows = tasks.select("id", "expect_file", F.explode(F.array(*[F.lit(p) for p in profiles])).alias("profile"))
    best = items.groupBy("profile", F.col("rel").alias("expect_file")).agg(F.max("in_outline").alias("_o"), F.max("included").alias("_c"))
    joined = rows.join(best, ["profile", "expect_file"], "left")
    scored = lambda c: F.when(F.col("expect_file").isNotNull(), F.coalesce(c, F.lit(False)))
    return joined.select("profile", "id", scored(F.col("_o")).alias("outline_hit"), scored(F.col("_c")).alias("content_hit"))


def headings(lines: DataFrame, section: str, mark: str) -> DataFrame:
    """(profile, rel): what the headings of level ``mark`` name within the section called ``section`` of a pack.

    ``lines`` holds (profile, n, line) of documents. A section of a pack is a ``## `` heading that is no path, up to the
    next such heading; the sections are few, so their bounds meet the lines by broadcast.
    """
    titles = ("Project Rules (AGENTS.md)", "Project Rules (summary)", "Repository Map", "Target Files", "Rule Reminder")
    tops = lines.filter(F.col("line").isin(*[f"## {t}" for t in titles])).select("profile", F.col("n").alias("_at"), (F.col("line") == f"## {section}").alias("_on"))
    bounds = tops.withColumn("_to", F.lead("_at", 1, 1 << 30).over(Window.partitionBy("profile").orderBy("_at"))).filter("_on")
    named = lines.filter(F.col("line").startswith(mark)).join(F.broadcast(bounds), "profile").filter((F.col("n") > F.col("_at")) & (F.col("n") < F.col("_to")))
    return named.select("profile", F.rtrim(F.substring("line", len(mark) + 1, 1 << 30)).alias("rel")).distinct()


def rates(cells_: DataFrame) -> DataFrame:
    """(profile, n, outline_rate, content_rate) over the scored cells; 0 where none is."""
    rate = lambda c: F.coalesce(F.sum(F.col(c).cast("double")) / F.nullif(F.count(c), F.lit(0)), F.lit(0.0))
    return cells_.groupBy("profile").agg(F.count("content_hit").alias("n"), rate("outline_hit").alias("outline_rate"), rate("content_hit").alias("content_rate"))


def matrix(profiles: list[str], models: list[str], tasks: DataFrame) -> DataFrame:
    """(profile, model, id): every call that an evaluation would make."""
    each = lambda names: F.explode(F.array(*[F.lit(n) for n in names]))
    return tasks.select("id", each(profiles).alias("profile")).select("id", "profile", each(models).alias("model")).select("profile", "model", "id")


def passed(answer: Column, expect: Column) -> Column:
    """Whether an answer holds any expected text, ignoring case; false for a null answer."""
    return F.coalesce(F.exists(expect, lambda e: F.contains(F.lower(answer), F.lower(e))), F.lit(False))


def pass_rates(answers: DataFrame) -> DataFrame:
    """(profile, model, n, rate) of graded answers (profile, model, passed)."""
    return answers.groupBy("profile", "model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("passed").cast("double")).alias("rate"))


def percent(x: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(x * 100 + 0.5).cast("int")


def clip(answer: Column, size: int = 80) -> Column:
    return F.substring(F.regexp_replace(answer, r"\s+", " "), 1, size)
