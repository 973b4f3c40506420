"""One ranking from several differently scaled scores.

Each score becomes its percentile within the item's group (ties share the highest), each item's own percentiles are
sorted ascending and the arrays are compared lexicographically, larger first (leximin): an item can't hide a weak
score behind a strong one, and no score weighs by its range. A demotion factor multiplies the sorted array.

Groups below the hot share take one shuffle by group, after which repeats, percentiles and positions need no other.
Groups that hold more, found by partial counts, are spread over tasks by range totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.skew import cume_dist, cut, hot_rows, partitions, running_total


def _vector(scores: Sequence[str], demotion: str) -> Column:
    return F.transform(F.array_sort(F.array(*[f"{s}_percentile" for s in scores])), lambda p: p * F.col(demotion))


def leximin(rows: DataFrame, group: str, item: str, scores: Sequence[str], demotion: str, first: str, large: int = 100_000) -> DataFrame:
    """(group, item, scores, demotion, <score>_percentile..., weakest_first ARRAY<DOUBLE>, position BIGINT from 1).

    A repeated (group, item) counts once: the row with the smallest ``first`` (then the smallest values) stands. A null
    score contributes nothing and counts as 0, NaN likewise; a null demotion is 1. Rows with a null group or item are
    left out, as no item is named. Full ties stand by item ascending. An empty table gives no rows. Other columns are
    ignored. Groups of fewer than ``large`` rows are never spread; the result is the same either way.
    """
    value = lambda c, v: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(v))
    named = rows.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    picked = named.select(group, item, F.struct(F.col(first), *[value(c, 0.0).alias(c) for c in scores], value(demotion, 1.0).alias(demotion)).alias("_r"))
    once = lambda d: d.groupBy(group, item).agg(F.min("_r").alias("_r")).select(group, item, *[f"_r.{c}" for c in scores], f"_r.{demotion}")
    hot = hot_rows(named, [group], large)
    small = picked if hot is None else picked.join(F.broadcast(hot), group, "left_anti")
    out = once(small.repartition(partitions(rows.sparkSession), group))
    out = out.select("*", *[F.cume_dist().over(Window.partitionBy(group).orderBy(s)).alias(f"{s}_percentile") for s in scores])
    out = out.withColumn("weakest_first", _vector(scores, demotion))
    out = out.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(F.col("weakest_first").desc(), item)).cast("bigint"))
    if hot is None:
        return out
    big = cut(once(picked.join(F.broadcast(hot), group, "left_semi")))
    for s in scores:
        big = cume_dist(big, group, s, f"{s}_percentile")
    big = big.withColumn("weakest_first", _vector(scores, demotion))
    big = running_total(big, [group], [F.col("weakest_first").desc(), F.col(item)], F.lit(1), "position")
    return out.unionByName(big.withColumn("position", F.col("position").cast("bigint")))
