"""The ratchet: known violations are warnings, new ones stay failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("check", "file", "line", "subject", "identifier")
ENTRY = "check string, file string, line int, subject string, identifier string"
KNOWN = " (known to the baseline)"
RESULT = "level string, name string, detail string, file string, line int, subject string"


def with_key(results: DataFrame) -> DataFrame:
    """Results with the columns that a baseline entry is matched by.

    A result with a location is known by check, file, line and subject, so rewording it doesn't hide it; one without is
    known by its text.
    """
    plain = F.col("file").isNull()
    return results.select("*", F.col("name").alias("_check"), F.col("file").alias("_file"), F.when(~plain, F.col("line")).alias("_line"), F.when(~plain, F.col("subject")).alias("_subject"), F.when(plain, F.col("detail")).alias("_identifier"))


def entries(results: DataFrame) -> DataFrame:
    """(check, file, line, subject, identifier): what ``fail`` and ``warn`` results are remembered by."""
    rows = with_key(results.filter(F.col("level").isin("fail", "warn")))
    return rows.select(*[F.col(f"_{k}").alias(k) for k in KEY]).distinct()


def apply(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """``results`` with known failures downgraded to warnings and marked; everything else stays as it is."""
    known = baseline.select(*[F.col(k).alias(f"b_{k}") for k in KEY]).distinct().withColumn("_known", F.lit(True))
    same = reduce(lambda a, b: a & b, (F.col(f"_{k}").eqNullSafe(F.col(f"b_{k}")) for k in KEY))
    joined = with_key(results).join(known, same, "left")
    hit = (F.col("level") == "fail") & F.coalesce("_known", F.lit(False))
    changed = {"level": F.when(hit, "warn").otherwise(F.col("level")), "detail": F.when(hit, F.concat("detail", F.lit(KNOWN))).otherwise(F.col("detail"))}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in results.columns])


def failures(results: DataFrame) -> int:
    return results.filter("level = 'fail'").count()
