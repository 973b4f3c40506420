"""Markdown sections and the search for the best of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions.text import cjk_chars, count_substring, other_units, trim_all
from orrery.operators.budget import prefix_cut

HEADING_WEIGHT = 5


def split_sections(documents: DataFrame, source: str, text: str) -> DataFrame:
    """(source, section_ord INT, heading, body): a text cut before each ``## `` line; blank sections are left out.

    A section's heading is its first line without the mark if it has one, else empty; bodies are trimmed. Null texts
    give no rows.
    """
    parts = F.filter(F.transform(F.split(F.col(text), r"(?m)^(?=## )", -1), trim_all), lambda p: p != "")
    rows = documents.select(source, F.posexplode(parts).alias("section_ord", "body"))
    return rows.select(source, "section_ord", trim_all(F.regexp_extract("body", r"^## ([^\n]*)", 1)).alias("heading"), "body")


def section_score(heading: Column, body: Column, query: str) -> Column:
    """Five for each time the query stands in the heading, one for each time in the body, ignoring case."""
    n = lambda c: F.coalesce(count_substring(c, query), F.lit(0))
    return (n(heading) * HEADING_WEIGHT + n(body)).cast("bigint")


def search(sections: DataFrame, query: str, order: list[str], k: int = 5) -> DataFrame:
    """The ``k`` sections with the highest positive scores; ties stand in the order of ``order``. An empty query fails."""
    scored = sections.withColumn("score", section_score(F.col("heading"), F.col("body"), query)).filter("score > 0")
    return scored.orderBy(F.col("score").desc(), *order).limit(k)


def within_budget(found: DataFrame, order: list[str], budget: int = 4000, header: tuple[int, int] = (0, 0), columns: Callable[[Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """The first of the found sections whose texts stay within the budget together, with ``rank`` and ``tokens``.

    ``columns`` sizes a text, by the heuristic if it isn't given.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("score").desc(), *order)  # a search result: k rows
    other, cjk = columns(F.col("body")) if columns else (other_units(F.col("body")), cjk_chars(F.col("body")))
    sized = found.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumns({"other": other, "cjk": cjk, "_one": F.lit(1)})
    return prefix_cut(sized, ["_one"], budget, header).drop("_one")
