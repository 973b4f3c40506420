"""Mixing sources to target weights under repetition limits.

Temperature mixing raises shares to an exponent. Here the share of a source relative to its target is raised:
``w ~ target * (share / target) ** x`` runs from the targets (x = 0) to the natural shares (x = 1). The exponent is
bisected to the smallest at which no source must repeat its documents more often than allowed, or, without targets, to
a wanted entropy. The weights are realised as whole random permutations of a source's documents and a part of one more:
its start, and behind it, in blocks of like size, what still fits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions.text import normal_source  # noqa: F401
from orrery.operators.skew import cut, running_total


def normalised(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else {}


def tempered(shares: Mapping[str, float], x: float) -> dict[str, float]:
    """Shares raised to ``x`` and normalised; a share of 0 stays 0."""
    return normalised({k: v**x if v > 0 else 0.0 for k, v in shares.items()})


def between(targets: Mapping[str, float], shares: Mapping[str, float], x: float) -> dict[str, float]:
    """The weights at ``x`` on the way from ``targets`` to ``shares``; a source without text has weight 0."""
    return normalised({k: t * (shares[k] / t) ** x if t > 0 and shares.get(k, 0) > 0 else 0.0 for k, t in targets.items()})


def entropy(shares: Mapping[str, float]) -> float:
    return -sum(v * math.log(v) for v in shares.values() if v > 0)


def bisect(holds: Callable[[float], bool], low: float, high: float, steps: int = 60) -> float:
    """The smallest x in [low, high] at which ``holds``, if it holds from some x on; ``high`` if it doesn't there."""
    if holds(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def exponent_for_entropy(shares: Mapping[str, float], wanted: float) -> float:
    """The exponent in [0, 1] at which the tempered shares have the wanted entropy, or the nearest to it."""
    return 1.0 if entropy(shares) >= wanted else bisect(lambda x: entropy(tempered(shares, x)) <= wanted, 0.0, 1.0)


def plan(sizes: Mapping[str, int], targets: Mapping[str, float], repeats: Mapping[str, int], budget: float | None = None) -> tuple[float, float, dict[str, float]]:
    """(budget, exponent, weights). Without a budget, the largest at which the targets can be met.

    At x = 1 every limit holds for a budget of at most the sum of sizes; a larger budget is lowered to what the limits allow.
    """
    have = {k: n for k, n in sizes.items() if n > 0 and targets.get(k, 0) > 0}
    if not have:
        return 0.0, 0.0, {}
    shares, wanted = normalised(have), normalised({k: targets[k] for k in have})
    most = {k: have[k] * max(1, repeats.get(k) or 1) for k in have}
    if budget is None:
        budget = min(most[k] / wanted[k] for k in have)
    budget = min(budget, min(most[k] / shares[k] for k in have))
    x = bisect(lambda x: all(budget * w <= most[k] * (1 + 1e-12) for k, w in between(wanted, shares, x).items()), 0.0, 1.0)
    return float(budget), x, between(wanted, shares, x)


def plan_entropy(sizes: Mapping[str, int], wanted: float, repeats: Mapping[str, int], budget: float) -> tuple[float, float, dict[str, float]]:
    """(budget, exponent, weights): natural shares raised to the largest exponent of at most 1 with the wanted entropy,
    or to the smallest larger one at which every limit holds. A budget beyond all limits at x = 1 is lowered."""
    have = {k: n for k, n in sizes.items() if n > 0}
    if not have:
        return 0.0, 0.0, {}
    shares = normalised(have)
    most = {k: n * max(1, repeats.get(k) or 1) for k, n in have.items()}
    budget = min(budget, min(most[k] / shares[k] for k in have))
    x = bisect(lambda x: all(budget * w <= most[k] * (1 + 1e-12) for k, w in tempered(shares, x).items()), exponent_for_entropy(shares, wanted), 1.0)
    return float(budget), x, tempered(shares, x)


def source_sizes(documents: DataFrame, source: str, size: str, known: list[str]) -> dict[str, int]:
    """Sum of sizes of the named sources, at most one number each."""
    rows = documents.filter(F.col(source).isin(known)).groupBy(source).agg(F.sum(size)).collect()
    return {k: int(n or 0) for k, n in rows}


#: Documents of one source and block that are looked at together to fill what is left of a budget.
BLOCK = 64


def select(documents: DataFrame, key: str, source: str, size: str, budgets: Mapping[str, float], sizes: Mapping[str, int], repeats: Mapping[str, int]) -> DataFrame:
    """(key, source, size, repeats INT): how often each chosen document is used.

    Each source's documents are used in whole permutations as often as its budget holds them. One more permutation,
    drawn by a hash of the key, is used from its start on as far as it fits, and behind that what still fits, larger
    documents first; so less is left of a budget than the smallest document that could be used once more. No document
    exceeds its limit. Sources that aren't named give no rows, nor do null keys; a document of size 0 is used in whole
    permutations only. A source of any size is spread over tasks: the driver sees at most ``BLOCK`` documents of each
    source and block, the documents of a size between two powers of two, and only such as may fit.
    """
    epochs, rest = F.lit(0), F.lit(0.0)
    for k, b in budgets.items():
        n, most = sizes.get(k, 0), max(1, repeats.get(k) or 1)
        whole = min(int(b * (1 + 1e-12) // n), most) if n else 0
        left = b - whole * n if whole < most and n else 0.0
        epochs = F.when(F.col(source) == k, F.lit(whole)).otherwise(epochs)
        rest = F.when(F.col(source) == k, F.lit(float(left))).otherwise(rest)
    rows = documents.filter(F.col(source).isin(*budgets) & F.col(key).isNotNull()).select(key, source, F.col(size).cast("bigint").alias(size))
    rows = rows.withColumns({"_epochs": epochs, "_rest": rest}).withColumn("_order", F.xxhash64(F.col(key), F.col("_epochs")))
    upto = cut(running_total(rows, [source], ["_order", key], size, "_upto"))
    start = (F.col("_upto") <= F.col("_rest")) & (F.col(size) > 0)
    open_ = upto.filter(~start & (F.col(size) > 0) & (F.col(size) <= F.col("_rest")))
    used = upto.groupBy(source, "_rest").agg(F.coalesce(F.sum(F.when(start, F.col(size))), F.lit(0)).alias("_used")).collect()  # one row per source
    room = {r[source]: r["_rest"] - r["_used"] for r in used}
    more = _fill(open_, key, source, size, room)
    taken = documents.sparkSession.createDataFrame(more, rows.select(key, source).schema).withColumn("_more", F.lit(1))
    marked = upto.withColumn("_first", F.when(start, 1).otherwise(0)).join(F.broadcast(taken), [key, source], "left")
    repeated = (F.col("_epochs") + F.greatest(F.col("_first"), F.coalesce("_more", F.lit(0)))).cast("int")
    return marked.withColumn("repeats", repeated).filter("repeats > 0").select(key, source, size, "repeats")


def _fill(open_: DataFrame, key: str, source: str, size: str, room: dict[str, float]) -> list[tuple]:
    """Documents of ``open_`` that fill each source's room, until none fits any more."""
    taken: list[tuple] = []
    block = F.floor(F.log2(size))
    while True:
        limit = F.lit(0.0)
        for k, left in room.items():
            limit = F.when(F.col(source) == k, F.lit(float(left))).otherwise(limit)
        rows = open_.filter(F.col(size) <= limit)
        if taken:
            gone = open_.sparkSession.createDataFrame(taken, open_.select(key, source).schema)
            rows = rows.join(F.broadcast(gone), [key, source], "left_anti")
        first = Window.partitionBy(source, "_block").orderBy("_order", key)
        some = rows.withColumn("_block", block).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= BLOCK).select(source, "_block", "_n", key, size)
        found = sorted(some.collect(), key=lambda r: (r[source], -r["_block"], r["_n"]))
        if not found:
            return taken
        for r in found:
            if r[size] <= room[r[source]]:
                room[r[source]] -= r[size]
                taken.append((r[key], r[source]))
