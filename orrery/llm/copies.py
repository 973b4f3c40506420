"""Duplicates hidden by formatting: one record per definition, with its number of copies.

Two rows are copies if their names have the same letters and digits ignoring case, and so have their parameters in any
order. Canonical keys are counted exactly with partial counts; hot keys are salted into a two-level aggregation, the
others take one shuffle. The representative is the smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.skew import cut, hot_keys

SALTS = 64
#: Quoted literals, separators, other text; a closing quote stands before a delimiter, so that a lone ' is no literal.
PIECES = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'(?=\s*(?:[,)\]}]|$))|,|[^,"']+|["']"""


def bare(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def parameters(signature: Column) -> Column:
    """The parameters of a signature, bare and sorted. Commas in brackets of any depth or in literals don't separate.

    The outer parentheses are dropped, arrows are no brackets, and an empty parameter (trailing comma) is none.
    """
    inner = F.regexp_replace(F.regexp_replace(signature, r"->|=>", " "), r"^\s*\(([\s\S]*)\)\s*$", "$1")
    pieces = F.regexp_extract_all(inner, F.lit(PIECES), F.lit(0))
    count = lambda s, chars: F.length(s) - F.length(F.translate(s, chars, ""))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("depth"))

    def step(a: Column, p: Column) -> Column:
        depth = F.when(p.rlike("""^["']."""), a.depth).otherwise(F.greatest(a.depth + count(p, "([{<") - count(p, ")]}>"), F.lit(0)))
        closes = (p == ",") & (a.depth == 0)
        return F.struct(
            F.when(closes, F.concat(a.done, F.array(a.cur))).otherwise(a.done).alias("done"),
            F.when(closes, "").otherwise(F.concat(a.cur, p)).alias("cur"),
            depth.cast("int").alias("depth"))

    split = F.aggregate(pieces, state, step, lambda a: F.concat(a.done, F.array(a.cur)))
    return F.array_sort(F.filter(F.transform(split, bare), lambda p: p != ""))


def canonical(name: Column, signature: Column) -> Column:
    """32-byte key of a definition."""
    return F.unhex(F.sha2(F.concat_ws("\x01", bare(name), F.array_join(parameters(signature), "\x02")), 256))


def keyed(rows: DataFrame, key: str = "symbol_id", name: str = "name", signature: str = "signature", all_rows: bool = False) -> DataFrame:
    """(key, _k) of the rows that can have copies: key and name not null, signature not null, empty or blank.

    A repeated key counts once; should its rows differ, the one with the smallest canonical key stands. With
    ``all_rows`` every row with a key is given, with its ``name`` and ``signature``; ``_k`` is null where a row can't
    have copies, and such a row stands only if no other row of its key can. Other columns are ignored.
    """
    able = F.col(name).isNotNull() & F.col(signature).rlike(r"\S")
    some = rows.filter(F.col(key).isNotNull())
    if not all_rows:
        return cut(some.filter(able).select(key, canonical(F.col(name), F.col(signature)).alias("_k")).groupBy(key).agg(F.min("_k").alias("_k")))
    marked = some.select(key, F.struct(F.when(able, canonical(F.col(name), F.col(signature))).alias("_k"), F.col(name).alias("name"), F.col(signature).alias("signature")).alias("_s"))
    best = marked.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("_s._k").isNotNull(), F.col("_s"))), F.min("_s")).alias("_s"))
    return cut(best.select(key, "_s.*"))


def collapse(ids: DataFrame, key: str = "symbol_id", share: float = 0.001, salts: int = SALTS) -> DataFrame:
    """(_k, first_id, copies, and the representative's other columns): one row per canonical key; null keys give none."""
    others = [c for c in ids.columns if c not in (key, "_k")]
    some = ids.filter(F.col("_k").isNotNull())
    hot = hot_keys(some.groupBy("_k").agg(F.count(F.lit(1)).alias("n")), ["_k"], "n", share)
    marked = some.select("_k", F.struct(key, *others).alias("first"), F.lit(1).alias("copies")).join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_k", "left")
    agg = lambda d, *by: d.groupBy(*by).agg(F.min("first").alias("first"), F.sum("copies").cast("bigint").alias("copies"))
    salted = marked.filter("_hot").withColumn("_salt", F.pmod(F.xxhash64(f"first.{key}"), F.lit(salts)))
    both = agg(marked.filter(F.col("_hot").isNull()), "_k").unionByName(agg(agg(salted, "_k", "_salt"), "_k"))
    return both.select("_k", F.col(f"first.{key}").alias("first_id"), *[f"first.{c}" for c in others], "copies")


def records(ids: DataFrame, key: str = "symbol_id", share: float = 0.001, salts: int = SALTS) -> DataFrame:
    """``collapse`` and the rows without a canonical key, each a record of its own."""
    alone = ids.filter(F.col("_k").isNull()).withColumnRenamed(key, "first_id").withColumn("copies", F.lit(1).cast("bigint"))
    return collapse(ids, key, share, salts).unionByName(alone)


def members(ids: DataFrame, key: str = "symbol_id", share: float = 0.001, salts: int = SALTS) -> DataFrame:
    """(first_id, copy_id, copies) for every row of ``ids``; the representative is its own copy.

    Keys below the hot share take one shuffle, in which their bounded groups find the minimum; hot ones, at most
    ``1 / share`` keys, are collapsed in two salted levels and meet their representative by broadcast.
    """
    hot = cut(hot_keys(ids.groupBy("_k").agg(F.count(F.lit(1)).alias("n")), ["_k"], "n", share))
    marked = ids.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_k", "left")
    w = Window.partitionBy("_k")
    cold = marked.filter(F.col("_hot").isNull()).select(F.min(key).over(w).alias("first_id"), F.col(key).alias("copy_id"), F.count(F.lit(1)).over(w).alias("copies"))
    big = marked.filter("_hot").drop("_hot")
    one = big.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts))).groupBy("_k", "_salt").agg(F.min(key).alias("f"), F.count(F.lit(1)).alias("n"))
    two = one.groupBy("_k").agg(F.min("f").alias("first_id"), F.sum("n").alias("copies"))
    return cold.unionByName(big.join(F.broadcast(two), "_k").select("first_id", F.col(key).alias("copy_id"), "copies"))
