"""The baseline's JSON file."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from orrery.operators.baseline import ENTRY, KEY

FILE = "docs/generated/baseline.json"
VERSION = 2


def read(spark: SparkSession, root: str) -> DataFrame:
    """Entries of either schema; empty if the file is missing or unreadable."""
    try:
        with open(os.path.join(root, FILE), encoding="utf-8") as f:
            data = json.load(f)
        entries = data.get("entries") if isinstance(data, dict) else None
    except (OSError, ValueError):
        entries = None
    at = lambda e, k: (e.get("location") or {}).get(k)
    rows = [(e.get("check"), at(e, "file"), at(e, "line"), e.get("subject") if e.get("location") else None, None if e.get("location") else e.get("identifier") or "") for e in entries or []]
    return spark.createDataFrame(rows, ENTRY)


def write(root: str, entries: DataFrame) -> None:
    """Written by the driver: a baseline is read by people."""
    out = []
    for r in entries.orderBy(*KEY).collect():
        e = {"check": r["check"]}
        if r["file"] is not None:
            e["location"] = {"file": r["file"]} | ({} if r["line"] is None else {"line": r["line"]})
            e |= {} if r["subject"] is None else {"subject": r["subject"]}
        else:
            e["identifier"] = r["identifier"]
        out.append(e)
    path = os.path.join(root, FILE)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"version": VERSION, "entries": out}, f, indent=2, ensure_ascii=False)
        f.write("\n")
