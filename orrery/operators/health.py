"""Checks of a corpus: duplicate definitions, orphans, uncovered files, constraints, secrets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.glob import matches
from orrery.functions.text import basename, is_test_path, lines
from orrery.operators.rank import references

# Names of files that programs start from.
ENTRY_POINTS = ("main", "index", "cli", "app", "__main__", "server", "worker", "setup", "conftest", "page", "layout", "route", "middleware")
# Patterns of secret-shaped text.
SECRETS = (
    r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", r"AKIA[0-9A-Z]{16}", r"ghp_[A-Za-z0-9]{36}",
    r"""(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*["'][^"'\s]{12,}["']""",
)


def duplicates(symbols: DataFrame, group: Sequence[str] = (), path: str = "rel") -> DataFrame:
    """(group, name, path): the files of each name that is defined with one signature in two or more files.

    Test files, nested definitions, names under four characters or between double underscores, and definitions without
    a signature are left out; signatures are compared without white space, and groups of one name are joined. A row per
    file, so a name of any number of files stays spread; ``duplicate_names`` counts them.
    """
    sig = F.regexp_replace(F.coalesce("signature", F.lit("")), r"\s+", "")
    rows = symbols.filter(~is_test_path(F.col(path)) & F.col("top_level") & (F.length("name") >= 4) & ~F.col("name").rlike(r"^__.+__\z")).withColumn("_sig", sig).filter("_sig <> ''")
    by_file = rows.groupBy(*group, "name", "_sig", path).agg(F.count(F.lit(1)).alias("_n"))
    counts = by_file.groupBy(*group, "name", "_sig").agg(F.count(F.lit(1)).alias("_files")).filter("_files >= 2")
    return by_file.join(counts, [*group, "name", "_sig"], "left_semi").select(*group, "name", path).distinct()


def duplicate_names(found: DataFrame, group: Sequence[str] = (), path: str = "rel") -> DataFrame:
    """(group, name, n_files, first): a row per name of ``duplicates``, with the first of its files by path."""
    return found.groupBy(*group, "name").agg(F.count(F.lit(1)).alias("n_files"), F.min(path).alias("first"))


def referenced(counts: DataFrame, symbols: DataFrame, group: Sequence[str], file: str) -> DataFrame:
    """(group, file) of the files with a symbol of four or more characters that another file names."""
    return references(counts, symbols, group, file, cap=None, generic=True).select(*group, file)


def is_entry_point(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+\z", "").isin(*ENTRY_POINTS)


def orphans(files: DataFrame, symbols: DataFrame, referenced_files: DataFrame, group: Sequence[str], file: str, path: str, ignore: Sequence[str] = ()) -> DataFrame:
    """(group, file, path) of files with symbols that no other file names; tests, entry points and ignored ones aside.

    Files without symbols are never reported, as a failed extraction looks the same.
    """
    keys = [*group, file]
    rows = files.filter(~is_test_path(F.col(path)) & ~F.coalesce(is_entry_point(F.col(path)), F.lit(False)) & ~matches(F.col(path), ignore))
    return rows.join(symbols.select(*keys).distinct(), keys, "left_semi").join(referenced_files, keys, "left_anti").select(*dict.fromkeys([*keys, path]))


def uncovered(files: DataFrame, modules: Mapping[str, Sequence[str]], path: str = "rel") -> DataFrame:
    """Files that no module's globs match; without modules none is reported."""
    return files.filter(~matches(F.col(path), [g for globs in modules.values() for g in globs]) & F.lit(bool(modules)) & F.col(path).isNotNull())


def module_counts(files: DataFrame, modules: Mapping[str, Sequence[str]], path: str = "rel") -> DataFrame:
    """(module, n_files BIGINT): the files that each module's globs match, counted in one scan; no modules, no rows."""
    if not modules:
        return files.select(F.lit("").alias("module"), F.lit(0).cast("bigint").alias("n_files")).limit(0)
    sums = files.agg(*[F.coalesce(F.sum(F.coalesce(matches(F.col(path), globs), F.lit(False)).cast("bigint")), F.lit(0)).alias(f"_{i}") for i, globs in enumerate(modules.values())])
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, modules)), F.array(*[f"_{i}" for i in range(len(modules))]))).alias("module", "n_files"))


def only_in(symbols: DataFrame, name: str, allowed: Sequence[str], path: str = "rel") -> DataFrame:
    """Definitions of ``name`` outside the allowed globs."""
    return symbols.filter((F.col("name") == name) & ~matches(F.col(path), allowed))


def must_not_import(found: DataFrame, from_: Sequence[str], denied: Sequence[str], path: str = "rel") -> DataFrame:
    """Imports of files under ``from_`` whose specifier, with dots as slashes too, or resolved file is denied."""
    spec = F.col("specifier")
    hit = matches(spec, denied) | matches(F.replace(spec, F.lit("."), F.lit("/")), denied)
    if "resolved" in found.columns:
        hit = hit | matches(F.col("resolved"), denied)
    return found.filter(matches(F.col(path), from_) & hit)


def line_hits(files: DataFrame, keys: Sequence[str], patterns: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, line INT) of the lines that one of the patterns is found in; lines stay in their row until they hit."""
    hits = F.filter(F.transform(lines(F.col(text)), lambda l, i: F.when(_any(l, patterns), (i + 1).cast("int"))), lambda n: n.isNotNull())
    return files.select(*keys, F.explode(hits).alias("line"))


def _any(line: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | line.rlike(p)
    return hit


def valid_pattern(spark: SparkSession, pattern: str) -> str | None:
    """What the engine that will run the pattern says against it; None if it takes it."""
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
    except Exception as x:
        return next((line for line in str(x).splitlines() if line.strip()), type(x).__name__)
    return None


def forbid_pattern(files: DataFrame, keys: Sequence[str], pattern: str, in_: Sequence[str], path: str = "rel", text: str = "text") -> DataFrame:
    """(keys, line) where the pattern stands in a file under ``in_``. Test patterns by ``valid_pattern`` first."""
    return line_hits(files.filter(matches(F.col(path), in_)), keys, [pattern], text)


def secret_lines(files: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, line) of secret-shaped text."""
    return line_hits(files, keys, SECRETS, text)


def long_texts(files: DataFrame, keys: Sequence[str], most: int = 150, text: str = "text") -> DataFrame:
    """(keys, n_lines) of texts with more lines than ``most``."""
    return files.select(*keys, F.size(lines(F.col(text))).cast("bigint").alias("n_lines")).filter(F.col("n_lines") > most)


def first_newer(items: DataFrame, path: str, changed: str, built_at) -> str | None:
    """The first path, in order, of the items changed after ``built_at``; None if there is none."""
    return items.filter(F.col(changed) > F.lit(built_at)).agg(F.min(path)).first()[0]


def stale(items: DataFrame, built: DataFrame, keys: Sequence[str], changed: str, built_at: str) -> DataFrame:
    """(keys) whose newest change is later than they were built. ``built`` holds (keys, built_at)."""
    newest = items.groupBy(*keys).agg(F.max(changed).alias("_changed"))
    return built.join(newest, list(keys)).filter(F.col("_changed") > F.col(built_at)).select(*keys, F.col("_changed").alias("changed_at"))


def first_newer_of(items: DataFrame, built: DataFrame, keys: Sequence[str], path: str, changed: str, built_at: str) -> DataFrame:
    """(keys, first): the first path, in order, of each key's items that changed after ``built`` (one row per key)."""
    late = items.join(built.select(*keys, built_at), list(keys)).filter(F.col(changed) > F.col(built_at))
    return late.groupBy(*keys).agg(F.min(path).alias("first")).filter("first is not null")
