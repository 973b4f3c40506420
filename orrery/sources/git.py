"""Reading changes and history from git."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from orrery.operators.cochange import MIN_COMMITS, WINDOW

COMMITS = "repo string, commit_ord int, sha string, pos int, rel string"


def git(root: str, args: Sequence[str]) -> str | None:
    """The output of a git command, null if it fails."""
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    except OSError:
        return None
    return run.stdout if run.returncode == 0 else None


def is_repo(root: str) -> bool:
    """Whether ``root`` is inside a working tree; a bare repository is none."""
    return (git(root, ["rev-parse", "--is-inside-work-tree"]) or "").strip() == "true"


def head(root: str) -> str | None:
    out = git(root, ["rev-parse", "HEAD"])
    return out.strip() if out else None


def is_shallow(root: str) -> bool:
    return (git(root, ["rev-parse", "--is-shallow-repository"]) or "").strip() == "true"


def depth(root: str) -> int:
    return int((git(root, ["rev-list", "--count", "HEAD"]) or "0").strip() or 0)


def history_available(root: str, least: int = MIN_COMMITS) -> bool:
    """Whether co-change can say anything: a repository with a full history of enough commits."""
    return is_repo(root) and not is_shallow(root) and depth(root) >= least


def changed_files(root: str, range_: str) -> list[str]:
    """Files that a revision range or ``--staged`` changes, relative to ``root``, without deleted ones."""
    args = ["diff", "--name-only", "--relative", "-z", "--diff-filter=d", "--find-renames", *(["--cached"] if range_ == "--staged" else [range_])]
    out = git(root, args)
    if out is None:
        raise ValueError(f"not a git repository or not a revision range: {range_}")
    return [p for p in out.split("\0") if p]


def log(root: str, limit: int = WINDOW) -> list[tuple[str, list[str]]]:
    """(sha, files) of the newest commits that name files, merges aside."""
    out = git(root, ["log", "--no-merges", f"-n{limit}", "--format=%x00%x00%H", "--name-only", "--relative", "-z"]) or ""
    commits = []
    for block in out.split("\0\0")[1:] if out else []:
        sha, *files = [p for p in block.replace("\n", "\0").split("\0") if p]
        if files:
            commits.append((sha, files))
    return commits


def read_history(spark: SparkSession, root: str, limit: int = WINDOW) -> DataFrame:
    """(repo, commit_ord, sha, pos, rel) of a repository's newest commits; empty if there is no usable history."""
    rows = [(root, i, sha, j, rel) for i, (sha, files) in enumerate(log(root, limit)) for j, rel in enumerate(files)] if history_available(root) else []
    return spark.createDataFrame(rows, COMMITS)


def cached_history(spark: SparkSession, root: str, cache: str, limit: int = WINDOW) -> DataFrame:
    """``read_history``, kept as a Parquet folder named by the newest commit and the window.

    The folder counts once it is whole; where it can't be written the history is read again each time.
    """
    path = os.path.join(cache, f"{head(root) or 'none'}-{limit}")
    if not os.path.exists(os.path.join(path, "_SUCCESS")):
        try:
            os.makedirs(cache, exist_ok=True)
        except OSError:
            return read_history(spark, root, limit)
        read_history(spark, root, limit).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema(COMMITS).parquet(path)
