"""Looking up symbols and the lines that name them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import escape_regex, lines


def find_symbols(symbols: DataFrame, query: str) -> DataFrame:
    """Definitions called exactly ``query``; where there is none, those that hold it, ignoring case."""
    exact = symbols.filter(F.col("name") == query)
    return exact if exact.head(1) else symbols.filter(F.contains(F.lower("name"), F.lit(query.lower())))


def reference_lines(files: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], k: int = 30, width: int = 120, text: str = "text") -> DataFrame:
    """(keys, line, line_text): the first ``k`` lines, by ``order`` and line, that hold ``name`` as a whole word.

    Each file sends at most ``k`` lines, cut to ``width`` characters.
    """
    pattern = f"(?<![A-Za-z0-9_]){escape_regex(name)}(?![A-Za-z0-9_])"
    hits = F.filter(F.transform(lines(F.col(text)), lambda l, i: F.when(l.rlike(pattern), F.struct((i + 1).cast("int").alias("line"), F.substring(F.trim(l), 1, width).alias("line_text")))), lambda h: h.isNotNull())
    rows = files.filter(F.contains(F.col(text), F.lit(name))).select(*keys, F.explode(F.slice(hits, 1, k)).alias("_h")).select(*keys, "_h.*")
    return rows.orderBy(*order, "line").limit(k)
