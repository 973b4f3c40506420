"""Ranking files by references to their symbols from other files, with further signals on top.

Each text is cut once into its words, of which the names of the group are counted. What the other files of a group say of a name is the
group's total less what the file says itself, so a name meets its total and its own count, both many-to-one, and no
pair of a defining and a naming file is ever formed. Names outside ``[A-Za-z0-9_]`` can't be words; they are counted in
the texts that have their longest word (``odd_counts``), and then are words like the others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions.text import is_generic_name, is_test_path, words
from orrery.operators.skew import cut, few_bytes, running_total

#: A scorer gives (keys, contribution) for the files it has something to say about.
Scorer = Callable[[DataFrame], DataFrame]
COUNT_CAP, SELF_CAP, SELF_WEIGHT, TEST_DEMOTION = 20, 10, 0.5, 0.2


def word_counts(files: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, word, n): distinct words of each text; combined before the shuffle, as a text is in one task."""
    return files.select(*keys, F.explode(words(F.col(text))).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


WORD = r"^[A-Za-z0-9_]+\z"


def _named(symbols: DataFrame, group: Sequence[str], file: str, generic: bool) -> DataFrame:
    rows = symbols.filter(F.length("name") >= 4) if generic else symbols.filter(~is_generic_name(F.col("name")))
    return rows.groupBy(*group, file, F.col("name").alias("word")).agg(F.count(F.lit(1)).alias("_times"))


def name_counts(files: DataFrame, symbols: DataFrame, group: Sequence[str], file: str, text: str = "text") -> DataFrame:
    """(group, file, word, n): how often each text names a symbol of its group, names of four characters and more.

    The texts are read once: their words meet the names right where they are cut, by broadcast if the names are few
    bytes, and what isn't a name is never shuffled. Written once, as rankings ask for it several times.
    """
    keys = [*group, file]
    names = cut(symbols.filter(F.length("name") >= 4).select(*group, "name").distinct())
    inner = F.array_sort(F.regexp_extract_all("name", F.lit("([A-Za-z0-9_]+)"), F.lit(1)), lambda a, b: F.length(b) - F.length(a))
    odd = names.filter(~F.col("name").rlike(WORD)).withColumn("word", F.get(inner, 0))
    wanted = names.filter(F.col("name").rlike(WORD)).select(*group, F.col("name").alias("word"))
    if odd.isEmpty():
        return cut(_counts_of(files, keys, text, wanted, group))
    asked = odd.filter("word is not null")
    all_ = cut(_counts_of(files, keys, text, wanted.unionByName(asked.select(*group, "word")).distinct(), group))
    plain = all_.join(F.broadcast(wanted) if few_bytes(wanted) else wanted, [*group, "word"], "left_semi")
    return cut(plain.unionByName(odd_counts(files, odd, all_, group, file, text)))


def _counts_of(files: DataFrame, keys: Sequence[str], text: str, wanted: DataFrame, group: Sequence[str]) -> DataFrame:
    by = [*group, "word"]
    if few_bytes(wanted):
        rows = files.select(*keys, F.explode(words(F.col(text))).alias("word")).join(F.broadcast(wanted), by, "left_semi")
        return rows.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    return word_counts(files, keys, text).join(wanted, by, "left_semi")


def odd_counts(files: DataFrame, odd: DataFrame, counts: DataFrame, group: Sequence[str], file: str, text: str = "text") -> DataFrame:
    """(group, file, word, n) of names with characters outside words (``$``, ``?``, ``!``).

    ``odd`` holds (group, name, word), a name with its longest word, ``counts`` how often each text has that. A boundary
    is needed at each end: where the name's end isn't a word character, one must follow it. So the words of a name are
    whole words of the text, and only texts with its longest one are searched, each once for all its names. A name
    without any word must be a whole run of marks between two word characters.
    """
    keys = [*group, file]
    asked = counts.join(odd.filter("word is not null"), [*group, "word"]).groupBy(*keys).agg(F.collect_set("name").alias("_names"))
    word = lambda c: c.rlike("^[A-Za-z0-9_]")
    edge = lambda c, at: F.when(word(c), F.lit(f"(?{at}![A-Za-z0-9_])")).otherwise(F.lit(f"(?{at}=[A-Za-z0-9_])"))
    pattern = lambda n: F.concat(edge(F.substring(n, 1, 1), "<"), F.lit(r"\Q"), n, F.lit(r"\E"), edge(F.substring(n, -1, 1), ""))
    found = F.filter(F.transform("_names", lambda n: F.struct(n.alias("word"), F.regexp_count(F.col(text), pattern(n)).cast("bigint").alias("n"))), lambda x: x.n > 0)
    some = files.select(*keys, text).join(asked, keys).select(*keys, F.explode(found).alias("_x")).select(*keys, "_x.word", "_x.n")
    bare = odd.filter("word is null").select(*group, F.col("name").alias("word"))
    if bare.isEmpty():
        return some
    marks = files.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?<=[A-Za-z0-9_])([^A-Za-z0-9_\s]{4,})(?=[A-Za-z0-9_])"), F.lit(1))).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    return some.unionByName(marks.join(bare, [*group, "word"], "left_semi"))


def references(counts: DataFrame, symbols: DataFrame, group: Sequence[str], file: str, cap: int | None = COUNT_CAP, generic: bool = False) -> DataFrame:
    """(group, file, n > 0): how often the other files of the group name the symbols of ``file``.

    A symbol defined several times in a file counts as often; each other file counts a name at most ``cap`` times.
    ``counts`` holds (group, file, word, n), one row per file and word (``name_counts``). A word's total is one row per group and word,
    combined before its shuffle; a name that many files define meets it in a join whose skewed side is split at run time.
    """
    names = _named(symbols, group, file, generic)
    known = names.select(*group, "word").distinct()
    seen = counts.join(known, [*group, "word"], "left_semi").withColumn("n", F.col("n") if cap is None else F.least(F.col("n"), F.lit(cap)))
    total = seen.groupBy(*group, "word").agg(F.sum("n").alias("_all"))
    both = names.join(seen, [*group, file, "word"], "left").join(total, [*group, "word"])
    others = both.groupBy(*group, file).agg(F.sum((F.col("_all") - F.coalesce("n", F.lit(0))) * F.col("_times")).cast("bigint").alias("n"))
    return others.filter("n > 0")


def reference_scores(files: DataFrame, symbols: DataFrame, counts: DataFrame, group: Sequence[str], file: str) -> DataFrame:
    """(group, file, reference): capped counts from other files plus half a point for each of up to ten symbols."""
    keys = [*group, file]
    got = references(counts, symbols, group, file).withColumnRenamed("n", "_refs")
    own = symbols.groupBy(*keys).agg(F.count(F.lit(1)).alias("_own"))
    score = F.coalesce(F.col("_refs"), F.lit(0)).cast("double") + F.least(F.coalesce(F.col("_own"), F.lit(0)), F.lit(SELF_CAP)) * F.lit(SELF_WEIGHT)
    return files.select(*keys).distinct().join(own, keys, "left").join(got, keys, "left").select(*keys, score.alias("reference"))


def ratio_to_max(df: DataFrame, column: str, group: Sequence[str], weight: float = 1.0) -> DataFrame:
    """``column`` as a share of the group's largest value, times ``weight``; unchanged where that isn't positive.

    The maximum is one row per group and comes back by a join, so a group of any size stays spread.
    """
    if not group:
        top = df.agg(F.max(column)).first()[0] or 0
        return df.withColumn(column, F.col(column) / F.lit(float(top)) * F.lit(weight)) if top > 0 else df
    most = df.groupBy(*group).agg(F.max(column).alias("_most"))
    share = F.when(F.col("_most") > 0, F.col(column) / F.col("_most") * F.lit(weight)).otherwise(F.col(column))
    return df.join(most, list(group)).withColumn(column, share).drop("_most")


def scored(reference: DataFrame, group: Sequence[str], file: str, path: str, scorers: Sequence[DataFrame] = ()) -> DataFrame:
    """(group, file, path, score, reference, scorers, demotion) with ``score = (reference + scorers) * demotion``.

    ``reference`` holds (group, file, path, reference). With any scorer, even an empty one, the reference is first
    divided by its largest value in the group; a file that a scorer doesn't name gets 0 from it.
    """
    out, keys = reference, [*group, file]
    if scorers:
        out = ratio_to_max(out, "reference", group)
    total = F.lit(0.0)
    for i, s in enumerate(scorers):
        out = out.join(s.select(*keys, F.col("contribution").alias(f"_c{i}")), keys, "left")
        total = total + F.coalesce(F.col(f"_c{i}"), F.lit(0.0))
    demotion = F.when(is_test_path(F.col(path)), TEST_DEMOTION).otherwise(1.0)
    out = out.withColumn("scorers", total).withColumn("demotion", demotion)
    return out.select(*keys, path, ((F.col("reference") + F.col("scorers")) * F.col("demotion")).alias("score"), "reference", "scorers", "demotion") if path not in keys else out.select(*keys, ((F.col("reference") + F.col("scorers")) * F.col("demotion")).alias("score"), "reference", "scorers", "demotion")


def by_path(path: str | Column, *more: str | Column) -> list[Column]:
    """Order of ties: paths as a person sorts them (Unicode's collation), nulls first, then ``more``."""
    col = F.col(path) if isinstance(path, str) else path
    return [F.collate(col, "UNICODE").asc_nulls_first(), *[F.col(c) if isinstance(c, str) else c for c in more]]


def _ties(tie: str | Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in ([tie] if isinstance(tie, str) else tie)]


def ranked(scores: DataFrame, group: Sequence[str], tie: str | Sequence[str | Column]) -> DataFrame:
    """Add ``rank`` from 1 by score descending, then ``tie``; groups of any size are spread over tasks."""
    return running_total(scores, list(group), [F.col("score").desc(), *_ties(tie)], F.lit(1), "rank").withColumn("rank", F.col("rank").cast("bigint"))


def top(scores: DataFrame, group: Sequence[str], tie: str | Sequence[str | Column], k: int) -> DataFrame:
    """The ``k`` first of each group with their ``rank``; each task keeps only its own ``k`` before the shuffle."""
    order = [F.col("score").desc(), *_ties(tie)]
    if not group:
        best = scores.orderBy(*order).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    w = Window.partitionBy(*group).orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def elsewhere(scores: DataFrame, inside: DataFrame, keys: Sequence[str], group: Sequence[str], tie: str | Sequence[str | Column], k: int = 20) -> DataFrame:
    """The ``k`` best files that aren't in ``inside``."""
    return top(scores.join(inside.select(*keys).distinct(), list(keys), "left_anti"), group, tie, k)
