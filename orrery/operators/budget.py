"""Cutting ranked blocks to a token budget.

Sizes are additive pairs (UTF-16 units that don't count as CJK, CJK code points) turned into tokens after adding, so
the size of a concatenation is exact. Every block costs at least one token, so ranks beyond the budget can be dropped
from a prefix first, which bounds its windows by the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions.text import units_to_tokens
from orrery.operators.skew import cut, few_bytes

#: Blocks of a group that are folded at once.
STRETCH = 4096


def prefix_cut(blocks: DataFrame, group: Sequence[str], budget: int, header: tuple[int, int] = (0, 0)) -> DataFrame:
    """The blocks from rank 1 on as long as header and blocks together stay within the budget; with ``tokens`` so far.

    ``blocks`` has (group, rank, other, cjk, ...), sizes not null.
    """
    w = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    near = blocks.filter(F.col("rank") <= budget)
    so_far = units_to_tokens(F.sum("other").over(w) + header[0], F.sum("cjk").over(w) + header[1])
    return near.withColumn("tokens", so_far).filter(F.col("tokens") <= budget)


def greedy_fit(blocks: DataFrame, group: Sequence[str], budget: int, header: tuple[int, int] = (0, 0), reserve: int = 0) -> DataFrame:
    """(group, rank, included): in rank order, each block that still fits is taken and one that doesn't is skipped.

    The room left only shrinks, so what is larger than it never fits any more. Each round folds the first ``STRETCH``
    blocks of a group that still fit alone, and what is left of the others goes to the next round; the first block of
    a round is always taken, and mostly nothing is left after one or two. A row holds (rank, other, cjk) of at most
    ``STRETCH`` blocks, never texts, and carries two numbers and the ranks taken. Group keys must not be null.
    """
    keys = list(group)
    fits = lambda o, c: units_to_tokens(o, c) + reserve <= budget
    sized = blocks.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in ("rank", "other", "cjk")], F.lit(header[0]).cast("bigint").alias("_o"), F.lit(header[1]).cast("bigint").alias("_c"))
    rest = cut(sized.filter(fits(F.col("other") + F.col("_o"), F.col("cjk") + F.col("_c"))))
    item, zero = F.struct("rank", "other", "cjk"), lambda: F.struct(F.first("_o").alias("other"), F.first("_c").alias("cjk"), F.array().cast("array<bigint>").alias("taken"))

    def step(a: Column, x: Column) -> Column:
        ok = fits(a.other + x.other, a.cjk + x.cjk)
        return F.struct(F.when(ok, a.other + x.other).otherwise(a.other).alias("other"), F.when(ok, a.cjk + x.cjk).otherwise(a.cjk).alias("cjk"), F.when(ok, F.concat(a.taken, F.array(x["rank"]))).otherwise(a.taken).alias("taken"))

    taken = None
    while not rest.isEmpty():
        near = rest.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).filter(F.col("_n") <= STRETCH)
        listed = near.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_i"), zero().alias("_z"), F.max("rank").alias("_last"))
        done = cut(listed.select(*keys, "_last", F.aggregate("_i", F.col("_z"), step).alias("_s")).select(*keys, "_last", F.col("_s.other").alias("_o"), F.col("_s.cjk").alias("_c"), "_s.taken"))
        some = done.select(*keys, F.explode("taken").alias("rank"))
        taken = some if taken is None else taken.unionByName(some)
        left = done.select(*keys, "_last", "_o", "_c")
        later = rest.drop("_o", "_c").join(F.broadcast(left) if few_bytes(left) else left, keys)
        rest = cut(later.filter((F.col("rank") > F.col("_last")) & fits(F.col("other") + F.col("_o"), F.col("cjk") + F.col("_c"))).drop("_last"))
    taken = sized.select(*keys, "rank").limit(0) if taken is None else taken
    return blocks.select(*keys, "rank").join(taken.withColumn("included", F.lit(True)), [*keys, "rank"], "left").select(*keys, "rank", F.coalesce("included", F.lit(False)).alias("included"))


def seeded_fit(blocks: DataFrame, group: Sequence[str], budget: int, header: tuple[int, int] = (0, 0), reserve: int = 0) -> DataFrame:
    """(group, rank, is_seed, included, degraded): seeds lead and survive together, or only the first one's body may.

    ``blocks`` has (group, rank, is_seed, other, cjk) with the seeds ranked first. If all seeds fit, they are taken and
    the rest is fitted greedily. If not, the group is degraded: of the seeds only the first is taken, if it fits.
    """
    seeds = blocks.filter("is_seed").groupBy(*group).agg(F.sum("other").alias("_o"), F.sum("cjk").alias("_c"))
    fits = units_to_tokens(F.coalesce("_o", F.lit(0)) + header[0], F.coalesce("_c", F.lit(0)) + header[1]) + reserve <= budget
    marked = blocks.join(seeds.select(*group, (~fits).alias("degraded")), list(group), "left").withColumn("degraded", F.coalesce("degraded", F.lit(False)))
    open_ = marked.filter(~F.col("degraded") | ~F.col("is_seed") | (F.col("rank") == 1))
    taken = greedy_fit(open_, group, budget, header, reserve)
    return marked.join(taken, [*group, "rank"], "left").select(*group, "rank", "is_seed", F.coalesce("included", F.lit(False)).alias("included"), "degraded")
