"""Items that appear together: pair counts per repository and how much they exceed chance.

Files get dense order-preserving 32-bit numbers, a pair is one packed 64-bit code. Tasks sort their codes in bounded
runs and count run lengths (``_runs``); the runs are spilled to the shuffle, merged by Spark's external sorter and
summed over the merged order (``_merge``). Odds ratios carry the continuity correction of one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.skew import cut, few_bytes, hot_keys, lookup, partitions, running_total

#: Rows of a commit beyond which its files are listed in blocks of about so many.
LARGE, BLOCK = 40_000, 4096
#: Pair codes a task holds before it sorts them into a run.
RUN = 1 << 21
RUN_SCHEMA = "code bigint, n bigint"


def _count(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Run lengths (or sums of ``n``) of sorted codes."""
    if not len(codes):
        return codes, codes
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts], np.diff(np.append(starts, len(codes))) if n is None else np.add.reduceat(n, starts)


def _batch(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])


def _triangle(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of the pairs of each row of sorted ids, at most about ``RUN`` at once."""
    k = ids.shape[1]
    per = k * (k - 1) // 2
    if per <= RUN:
        a, b = np.triu_indices(k, 1)
        for part in np.array_split(ids, len(ids) * per // RUN + 1):
            yield ((part[:, a] << 32) | part[:, b]).ravel()
    else:
        for row in ids:
            yield from _rectangles(row, row, True)


def _rectangles(left: np.ndarray, right: np.ndarray, above: bool) -> Iterator[np.ndarray]:
    """Codes of the pairs of two lists of ids, those with the smaller id first; ``above``: of one list with itself."""
    step = max(1, RUN // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step, None]
        small, large = np.minimum(part, right), np.maximum(part, right)
        codes = (small << 32) | large
        yield codes[part < right] if above else codes.ravel()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted and counted runs of the pairs within each list ``ids`` or, where ``others`` isn't null, between the two."""
    held, size = [], 0

    def codes() -> Iterator[np.ndarray]:
        for batch in batches:
            alone = batch.filter(pc.is_null(batch.column(1)))
            lists = alone.column(0)
            ids, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(lists.offsets)
            lengths, ends = np.diff(ends), ends - ends[0]
            for k in np.unique(lengths[lengths > 1]):
                yield from _triangle(np.sort(ids[ends[:-1][lengths == k][:, None] + np.arange(k)], axis=1))
            for row in batch.filter(pc.is_valid(batch.column(1))).to_pylist():
                yield from _rectangles(np.array(row["ids"], np.int64), np.array(row["others"], np.int64), False)

    for part in codes():
        held.append(part)
        size += part.size
        if size >= RUN:
            yield _batch(*_count(np.sort(np.concatenate(held))))
            held, size = [], 0
    if held:
        yield _batch(*_count(np.sort(np.concatenate(held))))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a sorted partition; the last code of a batch waits for the next batch."""
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, n = _count(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        n = n.copy()
        if last is not None:
            if codes[0] == last:
                n[0] += total
            else:
                yield _batch(np.array([last]), np.array([total]))
        last, total = int(codes[-1]), int(n[-1])
        if len(codes) > 1:
            yield _batch(codes[:-1], n[:-1])
    if last is not None:
        yield _batch(np.array([last]), np.array([total]))


def baskets(named: DataFrame, max_files: int | None) -> DataFrame:
    """(repo, sha, block, rels, k): the distinct files of each commit of at most ``max_files``, ``k`` in number.

    A commit is one row (block 0) unless it has more than ``LARGE`` rows. Such commits, found by partial counts, are made
    distinct in tasks of their own and parted into blocks of about ``BLOCK`` files by a hash of the file, so that no
    list grows with the data, however large a commit is.
    """
    keys = ["repo", "sha"]
    large = cut(named.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LARGE).select(*keys))
    some = not large.isEmpty()
    side = lambda df: F.broadcast(df) if few_bytes(df) else df
    few = named.join(side(large), keys, "left_anti") if some else named
    out = few.groupBy(*keys).agg(F.collect_set("rel").alias("rels")).select(*keys, F.lit(0).alias("block"), "rels", F.size("rels").cast("bigint").alias("k"))
    if some:
        many = cut(named.join(side(large), keys, "left_semi").groupBy(*keys, "rel").agg(F.count(F.lit(1)).alias("_seen")))
        sized = many.join(side(many.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))), keys)
        block = F.pmod(F.xxhash64("rel"), F.greatest(F.lit(1), F.ceil(F.col("k") / BLOCK))).cast("int")
        out = out.unionByName(sized.groupBy(*keys, block.alias("block"), "k").agg(F.collect_list("rel").alias("rels")))
    return out if max_files is None else out.filter(F.col("k") <= max_files)


def pairs(commits: DataFrame, max_files: int | None = None, least: int = 1, times_chance: float = 0.0) -> DataFrame:
    """(repo, rel_a, rel_b, n_ab, n_a, n_b, n_commits, lift, odds_ratio), rel_a < rel_b by code point.

    Counted are a repository's commits (distinct sha) that name at least one file and, if ``max_files`` is given, at
    most as many distinct files. Repeated rows and commits fetched again count once; rows with a null repo, sha or rel
    name no file. Kept are pairs with ``n_ab >= least`` and ``n_ab * n_commits >= times_chance * n_a * n_b``; files that
    can't reach either bound in any pair are dropped before pairs are formed, which loses none. At most 2^32 files are
    numbered; more raise an error.
    """
    spark = commits.sparkSession
    named = commits.filter(F.col("repo").isNotNull() & F.col("sha").isNotNull() & F.col("rel").isNotNull()).select("repo", "sha", "rel")
    inside = cut(baskets(named, max_files))
    n_commits = inside.groupBy("repo").agg(F.countDistinct("sha").alias("n_commits"))
    listed = inside.select("repo", "sha", "block", F.explode("rels").alias("rel"))
    files = cut(listed.groupBy("repo", "rel").agg(F.count(F.lit(1)).alias("n_f")))
    # a repository's number of commits is joined to its files, which a hot repository has many of
    files = lookup(files, n_commits, ["repo"], lambda: hot_keys(files.groupBy("repo").agg(F.count(F.lit(1)).alias("_f")), ["repo"], "_f"))
    files = files.filter((F.col("n_f") >= least) & (F.col("n_commits") >= F.lit(times_chance) * F.col("n_f")))
    files = cut(running_total(files, [], ["repo", "rel"], F.lit(1), "_id"))
    top = files.agg(F.max("_id")).first()[0] or 0
    if top >= 1 << 32:
        raise ValueError(f"{top} files don't fit into 32-bit numbers")
    files = files.withColumn("_id", F.col("_id").cast("bigint"))
    small = few_bytes(files)
    numbered = lookup(listed, files.select("repo", "rel", "_id"), ["repo", "rel"], lambda: hot_keys(files, ["repo", "rel"], "n_f"), small)
    lists = numbered.groupBy("repo", "sha", "block").agg(F.collect_list("_id").alias("ids"))
    codes = lists.filter(F.size("ids") > 1).select("ids", F.lit(None).cast("array<bigint>").alias("others"))
    if inside.filter("block > 0").head(1):
        blocks = cut(lists)
        left, right = blocks.select("repo", "sha", "block", "ids"), blocks.select("repo", "sha", F.col("block").alias("_other"), F.col("ids").alias("others"))
        codes = blocks.filter(F.size("ids") > 1).select("ids", F.lit(None).cast("array<bigint>").alias("others")).unionByName(
            left.join(right, ["repo", "sha"]).filter("block < _other").select("ids", "others").repartition(partitions(spark)))
    runs = codes.mapInArrow(_runs, RUN_SCHEMA)
    merged = runs.repartition(partitions(spark), "code").sortWithinPartitions("code").mapInArrow(_merge, RUN_SCHEMA).filter(F.col("n") >= least)
    half = F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))
    found = merged.select(F.shiftrightunsigned("code", 32).alias("_a"), half.alias("_b"), F.col("n").alias("n_ab"))
    named_a = files.select(F.col("_id").alias("_a"), "repo", F.col("rel").alias("rel_a"), F.col("n_f").alias("n_a"), "n_commits")
    named_b = files.select(F.col("_id").alias("_b"), F.col("rel").alias("rel_b"), F.col("n_f").alias("n_b"))
    found = found if small else cut(found)
    hot_side = lambda c: hot_keys(found.groupBy(c).agg(F.count(F.lit(1)).alias("_n")), [c], "_n")
    both = lookup(lookup(found, named_a, ["_a"], lambda: hot_side("_a"), small), named_b, ["_b"], lambda: hot_side("_b"), small)
    ab, a, b, n = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n_commits"))
    odds = (ab + 0.5) * (n - a - b + ab + 0.5) / ((a - ab + 0.5) * (b - ab + 0.5))
    kept = both.filter(F.col("n_ab") * F.col("n_commits") >= F.lit(times_chance) * F.col("n_a") * F.col("n_b"))
    return kept.select("repo", "rel_a", "rel_b", "n_ab", "n_a", "n_b", "n_commits", (ab * n / (a * b)).alias("lift"), odds.alias("odds_ratio"))
