"""Which files a pack is about: a module, a change with its callers, or all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.glob import matches
from orrery.functions.text import extension, is_generic_name, is_test_path
from orrery.operators.outline import SOURCE_EXTENSIONS
from orrery.operators.rank import TEST_DEMOTION, by_path, top

EXPANSION = 10


def source_files(files: DataFrame, path: str = "rel") -> DataFrame:
    return files.filter(extension(F.col(path)).isin(*SOURCE_EXTENSIONS))


def module_files(files: DataFrame, modules: Mapping[str, Sequence[str]], name: str, path: str = "rel") -> DataFrame:
    """All files of a module, of any type; an unknown module is an error."""
    if name not in modules:
        raise ValueError(f"no module is called {name!r}; there are: {', '.join(modules) or 'none'}")
    return files.filter(matches(F.col(path), modules[name]))


def expansion(counts: DataFrame, symbols: DataFrame, seeds: DataFrame, files: DataFrame, group: Sequence[str], file: str, path: str, k: int = EXPANSION) -> DataFrame:
    """(group, file, score, rank): the ``k`` files of each group that name the seeds' symbols most.

    Each distinct name counts every time it stands in a file; test files weigh a fifth, seeds are left out. Ties stand by
    path, then ``file``.
    """
    keys = [*group, file]
    names = symbols.join(seeds.select(*keys).distinct(), keys, "left_semi").filter(~is_generic_name(F.col("name"))).select(*group, F.col("name").alias("word")).distinct()
    n = counts.join(names, [*group, "word"]).groupBy(*keys).agg(F.sum("n").alias("_n")).join(seeds.select(*keys).distinct(), keys, "left_anti")
    paths = files.select(*dict.fromkeys([*keys, path])).distinct()
    score = F.col("_n") * F.when(is_test_path(F.col(path)), TEST_DEMOTION).otherwise(1.0)
    scored = n.join(paths, keys).select(*keys, F.col(path).alias("_path"), score.alias("score"))
    return top(scored, group, by_path("_path", file), k).drop("_path")
