"""Modules and commands of a project, from its paths and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import basename, dirname
from orrery.operators.rank import top

MIN_FILES, MOST_MODULES = 3, 8
# Files that say how to build and test, and folders whose subfolders are the modules.
MANIFESTS = ("package.json", "pytest.ini", "setup.cfg", "pyproject.toml", "Cargo.toml", "go.mod", "Makefile")
CONTAINERS = ("services", "apps", "packages", "crates", "src", "lib")


def modules(files: DataFrame, group: Sequence[str] = (), path: str = "rel", containers: Sequence[str] = CONTAINERS, least: int = MIN_FILES, most: int = MOST_MODULES) -> DataFrame:
    """(group, module, glob, n_files): the ``most`` folders with at least ``least`` files, largest first, then by path.

    A container's subfolders count instead of it. A module is called like its folder's last part, other characters than
    letters, digits, ``_`` and ``-`` as ``-``; of folders with one name only the first stands.
    """
    parts = F.split(F.col(path), "/")
    folder = F.when((F.size(parts) > 2) & parts[0].isin(*containers), F.concat_ws("/", parts[0], parts[1])).when(F.size(parts) > 1, parts[0])
    counts = files.select(*group, folder.alias("_dir")).filter("_dir is not null").groupBy(*group, "_dir").agg(F.count(F.lit(1)).alias("score")).filter(F.col("score") >= least)
    named = top(counts, group, "_dir", most).withColumn("module", F.regexp_replace(basename(F.col("_dir")), "[^A-Za-z0-9_-]", "-"))
    first = named.groupBy(*group, "module").agg(F.min_by(F.struct("_dir", "score"), "rank").alias("_b"))
    return first.select(*group, "module", F.concat("_b._dir", F.lit("/**")).alias("glob"), F.col("_b.score").alias("n_files"))


def folder_of(path: Column) -> Column:
    return dirname(path)


def folders(sources: DataFrame, path: str = "rel", containers: Sequence[str] = CONTAINERS) -> DataFrame:
    """(dir) where manifests count: the root, the folders in it that hold sources, and such subfolders of a container."""
    parts = F.split(F.col(path), "/")
    two = F.when((F.size(parts) > 2) & parts[0].isin(*containers), F.concat_ws("/", parts[0], parts[1]))
    listed = F.filter(F.array(F.lit("."), F.when(F.size(parts) > 1, parts[0]), two), lambda d: d.isNotNull())
    return sources.select(F.explode(listed).alias("dir")).distinct()


def commands(files: DataFrame, path: str = "rel", text: str = "text") -> DataFrame:
    """(dir, label, command, detail): how to build and test, by the manifests next to each other.

    Scripts of package.json (build, dev, test, lint), pytest by pytest.ini, setup.cfg or its table in pyproject.toml,
    cargo, go and make. An unreadable package.json says nothing.
    """
    name = basename(F.col(path))
    rows = files.select(dirname(F.col(path)).alias("dir"), name.alias("_n"), F.col(text).alias("_t"))
    script = lambda k: F.struct(F.lit(k).alias("k"), F.get_json_object("_t", f"$.scripts.{k}").alias("v"))
    item = "struct<label string, command string, detail string>"
    fixed = lambda label, command: F.struct(F.lit(label).alias("label"), F.lit(command).alias("command"), F.lit("").alias("detail")).cast(item)
    js = F.transform(F.filter(F.array(*[script(k) for k in ("build", "dev", "test", "lint")]), lambda s: s.v.isNotNull() & (s.v != "")), lambda s: F.struct(
        F.concat(F.initcap(s.k), F.lit(" (js)")).alias("label"), F.when(s.k == "test", "npm test").otherwise(F.concat(F.lit("npm run "), s.k)).alias("command"), s.v.alias("detail")).cast(item))
    found = (
        F.when(F.col("_n") == "package.json", js)
        .when(F.col("_n").isin("pytest.ini", "setup.cfg") | ((F.col("_n") == "pyproject.toml") & F.contains("_t", F.lit("[tool.pytest"))), F.array(fixed("Test (python)", "pytest")))
        .when(F.col("_n") == "Cargo.toml", F.array(fixed("Test (rust)", "cargo test"), fixed("Build (rust)", "cargo build")))
        .when(F.col("_n") == "go.mod", F.array(fixed("Test (go)", "go test ./...")))
        .when(F.col("_n") == "Makefile", F.array(fixed("Make targets", "make")))
    )
    out = rows.select("dir", F.explode(found).alias("_c")).select("dir", "_c.*").distinct()
    return out.withColumn("command", F.when(F.col("dir") == ".", F.col("command")).otherwise(F.concat(F.lit("cd "), "dir", F.lit(" && "), "command")))
