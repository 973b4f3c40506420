"""Reading a source tree as a table of files."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from orrery.functions.glob import compiled
from orrery.operators.cochange import IGNORED_DIRS

MAX_BYTES = 512 * 1024
SCHEMA = "rel string, size bigint, mtime timestamp, text string"


def walk(root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), max_bytes: int = MAX_BYTES) -> list[tuple[str, int, datetime]]:
    """(path, size, mtime) of the regular files below ``root``, sorted.

    Names that start with a dot, folders that are never looked into, links, files above ``max_bytes`` and what an
    exclude glob matches (a folder with all it holds) are left out; folders that can't be read count as empty.
    """
    out_re = [compiled(g) for g in exclude]
    in_re = [compiled(g) for g in include]
    found, todo = [], [""]
    while todo:
        folder = todo.pop()
        try:
            entries = list(os.scandir(os.path.join(root, folder)))
        except OSError:
            continue
        for e in entries:
            rel = f"{folder}/{e.name}" if folder else e.name
            if e.name.startswith(".") or any(r.match(rel) for r in out_re):
                continue
            if e.is_dir(follow_symlinks=False):
                if e.name not in IGNORED_DIRS:
                    todo.append(rel)
            elif e.is_file(follow_symlinks=False) and (not in_re or any(r.match(rel) for r in in_re)):
                s = e.stat(follow_symlinks=False)
                if s.st_size <= max_bytes:
                    found.append((rel, s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc)))
    return sorted(found)


def read_text(path: str) -> str | None:
    """A text file's content, wrong bytes replaced; null for binary (a NUL byte) and unreadable files."""
    try:
        with open(path, "rb") as f:
            data = f.read()
    except OSError:
        return None
    return None if b"\0" in data else data.decode("utf-8", "replace")


def read_tree(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """The files of a tree that every executor sees, each read where it is processed."""
    root = os.path.abspath(root)
    listed = walk(root, include, exclude)
    if not listed:
        return spark.createDataFrame([], SCHEMA)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text=[read_text(os.path.join(root, r)) for r in pdf["rel"]])

    paths = spark.createDataFrame(listed, "rel string, size bigint, mtime timestamp")
    return paths.repartition(min(len(listed), spark.sparkContext.defaultParallelism)).mapInPandas(load, SCHEMA)
