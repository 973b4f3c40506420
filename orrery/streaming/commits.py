"""Keeping co-change sums up to date from a stream of commits: an extension, without the window of newest commits, as
a stream has no newest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.cochange import BULK_FILES, seed_sums, window_commits

ROWS = "repo string, sha string, rel string, batch int"
SUMS = "repo string, rel string, together bigint, batch int"


def maintain(commits: DataFrame, seeds: DataFrame, out: str, checkpoint: str, bulk: int = BULK_FILES) -> StreamingQuery:
    """Write what each micro-batch of (repo, sha, rel) changes in the sums to a folder of its own below ``out``.

    A commit may come in parts, over any number of batches, and rows may come again: a batch meets the earlier rows of
    its commits, and what it writes is their sums with it less their sums without it. A commit that grows beyond
    ``bulk`` files takes its sums back. A batch that is run again overwrites its folders and only reads earlier ones.
    """

    def sums(rows: DataFrame) -> DataFrame:
        return seed_sums(window_commits(rows.withColumn("commit_ord", F.lit(0)), limit=1, bulk=bulk), seeds)

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        new = df.filter("repo is not null and sha is not null and rel is not null").select("repo", "sha", "rel").distinct()
        new.write.mode("overwrite").parquet(f"{out}/rows/batch={epoch}")
        known = spark.read.schema(ROWS).parquet(f"{out}/rows")
        new = known.filter(F.col("batch") == epoch).drop("batch")
        before = known.filter(F.col("batch") < epoch).drop("batch").join(new.select("repo", "sha").distinct(), ["repo", "sha"], "left_semi")
        change = sums(before.unionByName(new)).unionByName(sums(before).withColumn("together", -F.col("together")))
        change.groupBy("repo", "rel").agg(F.sum("together").alias("together")).filter("together <> 0").write.mode("overwrite").parquet(f"{out}/sums/batch={epoch}")

    return commits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, out: str) -> DataFrame:
    """(repo, rel, together > 0) over all batches."""
    return spark.read.schema(SUMS).parquet(f"{out}/sums").groupBy("repo", "rel").agg(F.sum("together").alias("together")).filter("together > 0")
