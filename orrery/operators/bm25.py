"""Okapi BM25 over fields, each with its own statistics and weight."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import exploded_parts, stem
from orrery.operators.skew import cut

K1 = 1.2
#: weight and b of each field
FIELDS = {"path": (3.0, 0.5), "symbols": (2.0, 0.5), "body": (1.0, 0.75)}
QUERY_WEIGHT = 2.0


def bm25(docs: DataFrame, terms: Sequence[str], key: str, tokens: str = "tokens", field: str | None = None, fields: Mapping[str, tuple[float, float]] = FIELDS, b: float = 0.75, k1: float = K1) -> DataFrame:
    """(key, score) of the documents that hold a query term, or with ``field`` their weighted sum over the fields.

    ``docs`` has one row per key (and field) with an array of tokens. Query terms count once each. Documents without
    tokens count in N and the average length. Without documents or terms the result is empty.
    """
    terms = list(dict.fromkeys(terms))
    rows = docs.select(key, (F.col(field) if field else F.lit("")).alias("_f"), F.coalesce(tokens, F.array().cast("array<string>")).alias("_t"))
    counted = [F.size(F.filter("_t", _is(t))).alias(f"_n{i}") for i, t in enumerate(terms)]
    return _score(rows.select(key, "_f", F.size("_t").alias("_len"), *counted), terms, key, fields if field else {"": (1.0, b)}, k1)


def bm25_texts(texts: DataFrame, terms: Sequence[str], key: str, text: str, b: float = 0.75, k1: float = K1) -> DataFrame:
    """``bm25`` of the search tokens of unique keys' texts. Only (key, length, counts of the terms) leave a text's task."""
    terms = list(dict.fromkeys(terms))
    # a stem is its part without the end, but for a final y: other parts needn't be stemmed
    near = F.lit(False)
    for t in terms:
        near = near | F.col("part").startswith(t[:-1])
    parts = exploded_parts(texts, [key], text).select(key, F.when(near, stem(F.col("part"))).alias("_s"))
    counts = [F.count(F.when(F.col("_s") == t, 1)).cast("int").alias(f"_n{i}") for i, t in enumerate(terms)]
    sized = cut(parts.groupBy(key).agg(F.count(F.lit(1)).alias("_len"), *counts))
    none = texts.select(key).join(sized.select(key), key, "left_anti").select(key, F.lit(0).cast("bigint").alias("_len"), *[F.lit(0).alias(f"_n{i}") for i in range(len(terms))])
    return _score(sized.unionByName(none).withColumn("_f", F.lit("")), terms, key, {"": (1.0, b)}, k1)


def _is(term: str) -> Callable[[Column], Column]:
    return lambda t: t == term


def _score(counts: DataFrame, terms: list[str], key: str, fields: Mapping[str, tuple[float, float]], k1: float) -> DataFrame:
    """Scores from (key, _f, _len, _n0...): a few numbers per document, written once, as the statistics come first.

    The statistics are one number per field and term and come to the driver, bounded by the query.
    """
    rows = cut(counts.filter(F.col("_f").isin(*fields)))
    found = [F.sum((F.col(f"_n{i}") > 0).cast("bigint")).alias(f"d{i}") for i in range(len(terms))]
    stats = {r["_f"]: r for r in rows.groupBy("_f").agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg"), *found).collect()} if terms else {}
    total, any_ = F.lit(0.0), F.lit(False)
    for i in range(len(terms)):
        part, tf = F.lit(0.0), F.col(f"_n{i}").cast("double")
        for name, (weight, b) in fields.items():
            if name not in stats:
                continue
            n, d, avg = stats[name]["n"], stats[name][f"d{i}"] or 0, stats[name]["avg"] or 0.0
            idf = max(0.0, math.log((n - d + 0.5) / (d + 0.5) + 1))
            length = F.lit(b) * (F.col("_len") / F.lit(avg)) if avg > 0 else F.lit(0.0)
            value = F.lit(weight) * (F.lit(idf) * (tf * F.lit(k1 + 1)) / (tf + F.lit(k1) * (F.lit(1 - b) + length)))
            part = F.when((F.col("_f") == name) & (tf > 0), value).otherwise(part)
        total, any_ = total + part, any_ | (tf > 0)
    return rows.filter(any_).select(key, total.alias("_s")).groupBy(key).agg(F.sum("_s").alias("score"))


def contribution(scores: DataFrame, weight: float = QUERY_WEIGHT) -> DataFrame:
    """(key..., contribution): scores as a share of the best, times the weight of the query; nothing if none is positive."""
    best = scores.agg(F.max("score")).first()[0] or 0
    keys = [c for c in scores.columns if c != "score"]
    return scores.filter(F.lit(best > 0)).select(*keys, (F.col("score") / F.lit(float(best or 1)) * F.lit(weight)).alias("contribution"))
