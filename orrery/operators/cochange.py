"""Files that change together with seed files, from commit histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.glob import excluded
from orrery.operators.rank import top

MIN_COMMITS, BULK_FILES, WINDOW = 50, 50, 500
# Folders that are never looked into.
IGNORED_DIRS = (".git", "node_modules", "dist", "build", "out", "target", "vendor", "__pycache__", ".venv", "venv", ".next", ".cache", "coverage")


def window_commits(commits: DataFrame, repo: str = "repo", limit: int = WINDOW, bulk: int = BULK_FILES) -> DataFrame:
    """(repo, sha, commit_ord, rel): distinct files of the newest ``limit`` commits that name at most ``bulk`` files.

    The window is taken first and bulk commits leave it after. Rows that repeat count once; null files are none.
    """
    rows = commits.filter((F.col("commit_ord") < limit) & F.col("rel").isNotNull()).groupBy(repo, "sha", "rel").agg(F.min("commit_ord").alias("commit_ord"))
    small = rows.groupBy(repo, "sha").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= bulk)
    return rows.join(small, [repo, "sha"], "left_semi")


def deep_enough(commits: DataFrame, repo: str = "repo", least: int = MIN_COMMITS) -> DataFrame:
    """(repo, n_commits, available): whether a history is long enough to say anything."""
    n = commits.groupBy(repo).agg(F.countDistinct("sha").alias("n_commits"))
    return n.withColumn("available", F.col("n_commits") >= least)


def seed_sums(history: DataFrame, seeds: DataFrame, repo: str = "repo") -> DataFrame:
    """(repo, rel, together BIGINT > 0): over the commits with seeds, how many other seeds each file met.

    Closed form: a file sums the number of seeds of its commits, less one for itself where it is a seed. The history
    meets itself on the commit only through that number, so no pair of files is ever formed.
    """
    marked = history.join(seeds.select(repo, "rel").distinct().withColumn("_seed", F.lit(1)), [repo, "rel"], "left")
    per = marked.filter("_seed = 1").groupBy(repo, "sha").agg(F.count(F.lit(1)).alias("_seeds"))
    sums = marked.join(per, [repo, "sha"]).groupBy(repo, "rel").agg(F.sum(F.col("_seeds") - F.coalesce("_seed", F.lit(0))).alias("together"))
    return sums.filter("together > 0")


def cochange_scores(sums: DataFrame, seeds: DataFrame, repo: str = "repo") -> DataFrame:
    """(repo, rel, contribution): sums per seed as a share of the largest of the repository."""
    n = seeds.select(repo, "rel").distinct().groupBy(repo).agg(F.count(F.lit(1)).alias("_n"))
    most = sums.groupBy(repo).agg(F.max("together").alias("_most"))
    per = sums.join(n, repo).join(most, repo)
    return per.select(repo, "rel", ((F.col("together") / F.col("_n")) / (F.col("_most") / F.col("_n"))).alias("contribution"))


def ignored_path(rel: Column) -> Column:
    """Whether a folder or the name starts with a dot or is never looked into."""
    return F.exists(F.split(rel, "/"), lambda s: s.startswith(".") | s.isin(*IGNORED_DIRS))


def outside(sums: DataFrame, own: DataFrame, present: DataFrame | None, exclude: Sequence[str] = (), repo: str = "repo", k: int = 5) -> DataFrame:
    """The ``k`` files of each repository that changed with the seeds most, not ``own``, not excluded or ignored, and
    (if ``present`` is given) still there. Ties stand by path."""
    rows = sums.join(own.select(repo, "rel").distinct(), [repo, "rel"], "left_anti").filter(~ignored_path(F.col("rel")) & ~excluded(F.col("rel"), exclude))
    if present is not None:
        rows = rows.join(present.select(repo, "rel").distinct(), [repo, "rel"], "left_semi")
    return top(rows.withColumnRenamed("together", "score"), [repo], "rel", k).withColumnRenamed("score", "together")
