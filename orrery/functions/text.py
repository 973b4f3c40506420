"""Column functions over text: sizes, tokens, stems, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code point ranges that count as CJK in sizes.
CJK_SIZES = (r"\x{1100}-\x{11ff}\x{3040}-\x{30ff}\x{3130}-\x{318f}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{a960}-\x{a97f}"
             r"\x{ac00}-\x{d7a3}\x{d7b0}-\x{d7ff}\x{f900}-\x{faff}\x{ff00}-\x{ffef}\x{20000}-\x{2fffd}")
# Code point ranges that search tokens index as bigrams.
CJK_SEARCH = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}"
CJK_TOKENS = 0.95
# Stop words of search tokens.
STOPWORDS = ("a an and are as at be by for from has have he in is it its of on or that the this to was were will with not but can if into than then so such "
             "which what when where who how do does did you your we our").split()
# Words that keep their suffix.
STEM_EXCEPTIONS = ("always", "hundred", "anything", "everything", "nothing", "something")
# Names too common to be a reference.
COMMON_NAMES = ("main init test setup index data name type value get set run new update create delete read write").split()
TEST_PATH = r"(^|/)(tests?|__tests__)/|(^|/)(test_[^/]*|conftest)\.py\z|\.(test|spec)\.[jt]sx?\z"
# White space as in trimming: all that Unicode calls so, and the byte order mark.
WHITE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _beyond_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x7f]+", "")


def cjk_chars(text: Column) -> Column:
    """Code points that count as CJK; texts of ASCII only aren't searched."""
    return F.when(_ascii(text), 0).otherwise(F.length(F.regexp_replace(_beyond_ascii(text), f"[^{CJK_SIZES}]+", "")))


def other_units(text: Column) -> Column:
    """UTF-16 units of the code points that don't count as CJK."""
    astral = F.length(F.regexp_replace(_beyond_ascii(text), r"[^\x{10000}-\x{1ffff}\x{2fffe}-\x{10ffff}]+", ""))
    return F.when(_ascii(text), F.length(text)).otherwise(F.length(text) - cjk_chars(text) + astral)


def with_sizes(df: DataFrame, text: Column, other: str = "other", cjk: str = "cjk") -> DataFrame:
    """``df`` with ``other_units`` and ``cjk_chars`` of ``text``, which is computed and searched once a row.

    Each step comes from a generator, so that the optimizer can't copy it into the places that use it.
    """
    once = lambda d, c: d.select("*", F.explode(F.array(F.struct(c))).alias("_x")).select(*[f"`{n}`" for n in d.columns], "_x.*")
    rows = once(df, text.alias("_text"))
    rows = once(rows, F.when(_ascii(F.col("_text")), "").otherwise(_beyond_ascii(F.col("_text"))).alias("_rest"))
    rows = once(rows, F.length(F.regexp_replace("_rest", f"[^{CJK_SIZES}]+", "")).cast("bigint").alias("_cjk"))
    astral = F.length(F.regexp_replace("_rest", r"[^\x{10000}-\x{1ffff}\x{2fffe}-\x{10ffff}]+", ""))
    return rows.select(*[f"`{n}`" for n in df.columns if n not in (other, cjk)], (F.length("_text") - F.col("_cjk") + astral).cast("bigint").alias(other), F.col("_cjk").alias(cjk))


def rstrip(text: Column) -> Column:
    """Without the ASCII white space at its end."""
    return F.rtrim(text, F.lit(" \t\n\x0b\f\r"))


def units_to_tokens(other: Column, cjk: Column) -> Column:
    return (F.ceil(other / F.lit(4.0)) + F.ceil(cjk * F.lit(CJK_TOKENS))).cast("bigint")


def approx_tokens(text: Column) -> Column:
    """``ceil(other / 4) + ceil(0.95 * cjk)``; null for null."""
    return units_to_tokens(other_units(text), cjk_chars(text))


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def head_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(lines(text), 1, n), "\n")


def words(text: Column) -> Column:
    """Whole words for counting references: runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), F.lit(1))


def camel_parts(word: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(word, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, " "), lambda p: p != "")


def stem(token: Column) -> Column:
    """Plural, gerund and participle endings folded; everything else is left alone."""
    size = F.length(token)
    cut = lambda n: F.substr(token, F.lit(1), F.length(token) - n)

    def fold(bare: Column) -> Column:
        doubled = bare.rlike(r"([bdgmnprt])\1\z")
        short = F.substr(bare, F.lit(1), F.length(bare) - 1)
        return F.when(doubled & (F.length(short) >= 3), short).when(~doubled & (F.length(bare) >= 4), bare).otherwise(token)

    long = size > 4
    return (
        F.when((size < 4) | token.isin(*STEM_EXCEPTIONS), token)
        .when(long & (token.endswith("ies") | token.endswith("ied")), F.concat(cut(3), F.lit("y")))
        .when(long & token.rlike(r"(sses|xes|zes|ches|shes)\z"), cut(2))
        .when(long & token.endswith("ing"), fold(cut(3)))
        .when(long & token.endswith("ed") & ~token.endswith("eed"), fold(cut(2)))
        .when(token.endswith("s") & ~token.rlike(r"[suio]s\z"), cut(1))
        .otherwise(token)
    )


def search_parts(text: Column) -> Column:
    """Runs that search tokens come from: bigrams of CJK runs and parts of compound words, in their own case.

    Compound words are parted in the whole text at once, which is the same as in each word; texts without CJK need no
    function per run.
    """
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    latin = F.regexp_extract_all(spaced, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    bigrams = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
    piece = lambda r: F.when(r.rlike("^[A-Za-z0-9]") | (F.length(r) == 1), F.array(r)).otherwise(bigrams(r))
    mixed = F.flatten(F.transform(F.regexp_extract_all(spaced, F.lit(rf"([{CJK_SEARCH}]+|[A-Za-z0-9]+)"), F.lit(1)), piece))
    return F.when(~_ascii(text) & text.rlike(f"[{CJK_SEARCH}]"), mixed).otherwise(latin)


def is_search_part(part: Column) -> Column:
    """Whether a lower-case part is searched for: CJK, or two letters or more and no stop word."""
    return ~part.rlike("^[a-z0-9]") | ((F.length(part) >= 2) & ~part.isin(*STOPWORDS))


def search_tokens(text: Column) -> Column:
    """Tokens that queries and texts are matched by, as an array; parts are lower-cased, filtered and stemmed."""
    return F.transform(F.filter(F.transform(search_parts(text), F.lower), is_search_part), stem)


def exploded_parts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, part): a row for each part that is searched for. For large texts: the filters are compiled, not called."""
    rows = texts.select(*keys, F.explode(search_parts(F.col(text))).alias("_p")).select(*keys, F.lower("_p").alias("part"))
    return rows.filter(is_search_part(F.col("part")))


def count_substring(haystack: Column, needle: str) -> Column:
    """Occurrences without overlap, ignoring case; an empty needle is an error."""
    if not needle:
        raise ValueError("an empty query matches everywhere")
    low = needle.lower()
    return ((F.length(haystack) - F.length(F.replace(F.lower(haystack), F.lit(low), F.lit("")))) / F.lit(len(low))).cast("bigint")


def extension(path: Column) -> Column:
    """With its dot; '' if there is none or the name starts with its only dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)).otherwise(".")


def is_test_path(path: Column) -> Column:
    return F.coalesce(path.rlike(TEST_PATH), F.lit(False))


def is_generic_name(name: Column) -> Column:
    return (F.length(name) < 4) | F.lower(name).isin(*COMMON_NAMES)


def escape_regex(s: str) -> str:
    return "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in s)


def normal_source(source: Column) -> Column:
    """Lower case, without blanks around, words joined by one underscore; blank is null."""
    s = F.regexp_replace(F.regexp_replace(F.lower(source), r"^[\s_-]+|[\s_-]+$", ""), r"[\s_-]+", "_")
    return F.when(s != "", s)
