"""How distinctive a term is per record: probabilistic relevance weights.

``score = ln((N - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg_len))`` with the
collection's document frequencies, number of records N (those without terms count too) and average length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.skew import cut, few_bytes, hot_keys, lookup

K1, B = 1.2, 0.75


def term_weights(docs: DataFrame, key: str = "id", tokens: str = "tokens", version: str = "indexed_at", collection: Sequence[str] = (), k1: float = K1, b: float = B) -> DataFrame:
    """(key, collection..., term, tf, df, score), one row per record and distinct term.

    A record is a key within its ``collection``, the columns whose values part the table into collections with
    statistics of their own (none: the table is one). A repeated record counts once, with its earliest version. Null and
    empty token arrays count in N and in the average length and give no rows; null tokens in an array are skipped; a
    null key or collection is no record. Other columns are ignored.

    The records are shuffled once, as arrays, repeats combined before; their terms are counted where they then are. Terms meet their document
    frequency by broadcast if all of these are few bytes, else through a shuffle, in which terms that a large share of
    records hold are broadcast (bounded, see ``hot_keys``).
    """
    own = [key, *collection]
    named = docs.filter(" and ".join(f"`{c}` is not null" for c in own))
    once = named.groupBy(*own).agg(F.min_by(tokens, F.struct(version, tokens)).alias("_t"))
    once = once.select(*own, F.filter(F.coalesce("_t", F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("_t"))
    # a row without a term stands for the record itself
    listed = once.select(*own, F.size("_t").alias("_len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "_t")).alias("term"))
    counted = cut(listed.groupBy(*own, "_len", "term").agg(F.count(F.lit(1)).alias("tf")))
    records, tf = counted.filter("term is null"), counted.filter("term is not null")
    stats = records.groupBy(*collection).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_len").alias("_avg"))
    df = tf.groupBy(*collection, "term").agg(F.count(F.lit(1)).alias("df"))
    if collection:
        sizes = cut(df.groupBy(*collection).agg(F.count(F.lit(1)).alias("_terms")))
        df = lookup(df, stats, collection, lambda: hot_keys(sizes, collection, "_terms"))
    else:
        n, avg = stats.first()
        df = df.withColumns({"_n": F.lit(float(n)), "_avg": F.lit(float(avg or 0.0))})
    df = cut(df)
    by = [*collection, "term"]
    both = lookup(tf, df, by, lambda: hot_keys(df, by, "df"), few_bytes(df))
    idf = F.log((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("_len") / F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(1.0))
    return both.select(*own, "term", "tf", "df", (idf * (F.col("tf") * F.lit(k1 + 1.0)) / (F.col("tf") + norm)).alias("score"))


def top_term(weights: DataFrame, key: str = "id") -> DataFrame:
    """(key, term): the term of the highest score; ties go to the smallest term. Combined before the shuffle."""
    best = weights.groupBy(key).agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "term")).alias("b"))
    return best.select(key, F.col("b.term").alias("term"))
