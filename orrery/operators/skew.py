"""Building blocks that stay balanced when one key holds a large share of the rows.

``cut``            reliable checkpoint in the shared folder (lineage ends, executors may be lost)
``running_total``  prefix sums per group without putting a group into one task
``hot_keys``       the keys that hold more than a share of all rows, exactly; their number is bounded by the share
``join_on_key``    many-to-one join: hot keys by broadcast of their bounded right side, the rest by shuffle
``lookup``         many-to-one join: a right side of checked size by broadcast, a larger one by ``join_on_key``
``cume_dist``      percentile of a value within its group, ties share the highest
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key is hot if it holds at least this share of all rows, or at least what a partition holds on average if that is
#: less; so there are at most ``max(1 / HOT_SHARE, partitions)`` hot keys, and none else outweighs a partition.
HOT_SHARE = 1 / 1000
#: Bytes that a whole right side may have to be broadcast.
BROADCAST_BYTES = 16 << 20


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder now and read it from there from now on.

    The folder is the session's ``spark.checkpoint.dir``. Where none is named a temporary one is set on a local master
    (tests); on a cluster, whose machines don't share such a folder, that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="orrery-"))
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same_key(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of key columns of two aliased frames."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], weight: str | Column, out: str) -> DataFrame:
    """Add ``out``, the sum of ``weight`` over the rows of the group up to and with this one.

    The rows are range-partitioned by group and order, so a group of any size spreads over tasks; each task sums its
    own stretch and adds the total of the stretches before it, of which there are at most as many as partitions.
    Rows that tie on ``order`` stay together and are summed in an unspecified order: make ``order`` unique where that
    matters. Null group keys form one group. An empty frame stays empty.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = df.repartitionByRange(partitions(df.sparkSession), *[F.col(g) for g in group], *by)
    parts = cut(parts.withColumn("_w", F.col(weight) if isinstance(weight, str) else weight).withColumn("_pid", F.spark_partition_id()))
    stretch = Window.partitionBy(*group, "_pid").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(*group, "_pid").agg(F.sum("_w").alias("_s")).select(*group, "_pid", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    rows = parts.withColumn(out, F.sum("_w").over(stretch)).alias("l")
    joined = rows.join(offsets.alias("r"), same_key("l", "r", [*group, "_pid"]))
    return joined.select(*[f"l.{c}" for c in df.columns], (F.col(f"l.{out}") + F.col("r._off")).alias(out))


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str, share: float | None = None, at_least: int = 1000) -> DataFrame:
    """The keys of ``counts(keys, n)`` with ``n`` of at least ``share`` of the sum of ``n`` (and ``at_least``)."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    share = min(HOT_SHARE, 1 / partitions(counts.sparkSession)) if share is None else share
    return counts.filter(F.col(n) >= max(at_least, total * share)).select(*keys)


def hot_rows(df: DataFrame, keys: Sequence[str], at_least: int = 100_000) -> DataFrame | None:
    """The hot keys of ``df`` itself as a local table, by partial counts; None if there are none."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    spark = df.sparkSession
    total = df.count()
    if total < at_least:
        return None
    found = counts.filter(F.col("_n") >= max(at_least, total * min(HOT_SHARE, 1 / partitions(spark)))).select(*keys)
    rows = found.collect()  # at most max(1 / HOT_SHARE, partitions)
    return spark.createDataFrame(rows, found.schema) if rows else None


def join_on_key(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join ``right`` (one row per key) to ``left``; ``hot`` are the keys that ``left`` repeats most.

    ``hot`` is bounded (see ``hot_keys``), so it and its rows of ``right`` may be broadcast; the other keys hold less
    than the hot share each and go through a shuffle. Keys must not be null.
    """
    marked = left.join(F.broadcast(hot.select(*keys).distinct().withColumn("_hot", F.lit(True))), list(keys), "left")
    cold = marked.filter(F.col("_hot").isNull()).drop("_hot").join(right, list(keys), how)
    few = right.join(F.broadcast(hot.select(*keys).distinct()), list(keys), "left_semi")
    return cold.unionByName(marked.filter("_hot").drop("_hot").join(F.broadcast(few), list(keys), how))


def few_bytes(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df`` take at most ``most`` bytes, strings by their length and other columns by 16 bytes."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if f.dataType.typeName() in ("string", "binary") else F.lit(16) for f in df.schema.fields]
    return (df.agg(F.sum(reduce(lambda a, b: a + b, sizes))).first()[0] or 0) <= most


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: Callable[[], DataFrame], small: bool | None = None) -> DataFrame:
    """Inner join of ``right`` (one row per key) to ``left``. Keys must not be null.

    A right side of at most ``BROADCAST_BYTES`` is broadcast, so that ``left`` keeps its partitioning; a larger one meets
    the keys that ``left`` repeats most, which ``hot`` gives, by broadcast and the others by shuffle (``join_on_key``).
    """
    if few_bytes(right) if small is None else small:
        return left.join(F.broadcast(right), list(keys))
    return join_on_key(left, right, keys, hot())


def cume_dist(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the share of the group's rows whose ``value`` isn't larger. ``group`` and ``value`` hold no nulls.

    Rows are first counted per distinct value, so ties of any number weigh one row in the sort.
    """
    counts = cut(df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n")))
    upto = running_total(counts, [group], [value], "_n", "_upto")
    total = counts.groupBy(group).agg(F.sum("_n").alias("_all"))
    share = upto.join(total, group).select(group, value, (F.col("_upto") / F.col("_all")).alias(out))
    return join_on_key(df, share, [group, value], hot_keys(counts, [group, value], "_n"))
