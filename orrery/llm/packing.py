"""Filling fixed-capacity containers: first-fit decreasing in randomised groups of items.

Groups are drawn by a hash of the key, so each has about ``group_items`` items whatever the data, and each is packed on
its own: items by size descending, each into the first container with room, found in a tournament tree of the rooms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ITEMS = 20_000


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item, in the given order; sizes are at most ``capacity``."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        i = 1
        while i < leaves:
            i *= 2
            if room[i] < size:
                i += 1
        out.append(i - leaves)
        room[i] -= size
        i //= 2
        while i:
            best = room[2 * i] if room[2 * i] >= room[2 * i + 1] else room[2 * i + 1]
            if room[i] == best:
                break
            room[i] = best
            i //= 2
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(key, part_no INT, n_parts INT, start BIGINT, end BIGINT, container_id BIGINT), start and end in units of size.

    An item larger than ``capacity`` is cut into full containers and a rest, which is packed like the others; no other
    item is split. Items of size 0 take no room but have a container; null and negative sizes count as 0. Repeated keys
    are items of their own; rows with a null key are left out. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    rows = items.filter(F.col(key).isNotNull()).select(key, F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("_size"))
    groups = max(1, round(rows.count() / group_items))
    kind = items.schema[key].dataType.simpleString()
    grouped = rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("bigint"))

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.maximum(1, -(-pdf["_size"].to_numpy() // capacity))
        at = np.repeat(np.arange(len(pdf)), n)
        part = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        start = part * capacity
        end = np.minimum(start + capacity, pdf["_size"].to_numpy()[at])
        keys = pdf[key].to_numpy()[at]
        order = np.lexsort((part, keys, start - end))
        bins = np.empty(len(at), np.int64)
        bins[order] = first_fit((end - start)[order].tolist(), capacity)
        return pd.DataFrame({key: keys, "part_no": part + 1, "n_parts": n[at], "start": start, "end": end, "container_id": (int(group[0]) << 32) + bins})

    return grouped.groupBy("_group").applyInPandas(run, f"`{key}` {kind}, part_no int, n_parts int, start bigint, end bigint, container_id bigint")


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """(container_id, n_items, used, fill): what each container holds."""
    used = packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("end") - F.col("start")).alias("used"))
    return used.withColumn("fill", F.col("used") / F.lit(float(capacity)))
