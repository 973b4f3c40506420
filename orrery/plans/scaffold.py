"""First settings and rules of a project, as a draft from its paths and manifests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import basename
from orrery.operators import detect
from orrery.operators.select import source_files
from orrery.plans.repo import write_document
from orrery.sources.config import FILE, GENERATED, PROFILES, Config
from orrery.sources.files import read_tree

HOOK = "#!/bin/sh\nexec python -m orrery.cli check --root \"$(git rev-parse --show-toplevel)\"\n"
WORKFLOW = "name: context\non: [pull_request]\njobs:\n  check:\n    runs-on: ubuntu-latest\n    steps:\n      - uses: actions/checkout@v4\n        with: {fetch-depth: 0}\n      - run: python -m orrery.cli check\n"


def detected(spark: SparkSession, config: Config) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """((module, glob) by size, (label, command, detail) by folder): what a project's paths and manifests say.

    Manifests count in the root, in folders that hold sources, and in a container's subfolders that do.
    """
    files = read_tree(spark, config.root, exclude=config.exclude)
    sources = source_files(files)
    modules = [(r.module, r.glob) for r in detect.modules(sources).orderBy(F.desc("n_files"), "glob").collect()]  # at most eight
    manifests = files.filter(basename(F.col("rel")).isin(*detect.MANIFESTS))
    near = manifests.join(detect.folders(sources), detect.folder_of(F.col("rel")) == F.col("dir"), "left_semi")
    commands = [(r.label, r.command, r.detail) for r in detect.commands(near).orderBy("dir", "label").collect()]
    return modules, commands


def settings(modules: list[tuple[str, str]]) -> str:
    listed = "modules:\n" + "".join(f"  {name}:\n    - \"{glob}\"\n" for name, glob in modules) if modules else "modules: {}\n"
    profiles = "".join(f"  {name}: {{inject: [{', '.join(p['inject'])}], budget: {p['budget']}}}\n" for name, p in PROFILES.items())
    return f"# Settings of maps, packs and checks: a draft, to be read and changed.\nversion: 1\n\n{listed}\nexclude: []\n\nprofiles:\n{profiles}\nsync:\n  targets: [claude]\n"


def rules(commands: list[tuple[str, str, str]]) -> str:
    listed = "".join(f"- {label}: `{command}`{f' ({detail})' if detail else ''}\n" for label, command, detail in commands) or "- Build: to be filled in\n- Test: to be filled in\n"
    blank = "".join(f"\n## {title}\n\n- to be filled in\n" for title in ("Why it is built this way", "What must not be done", "Words and what they mean"))
    return f"# AGENTS.md\n\nA draft: keep it short, and say only what the code doesn't.\n\n## Commands\n\n{listed}{blank}"


def scaffold(spark: SparkSession | None, config: Config, auto: bool = False, hooks: bool = False, ci: bool = False) -> list[tuple[str, str]]:
    """(path, created | kept): settings, rules and folders; what is there already stays as it is."""
    modules, commands = detected(spark, config) if auto else ([], [])
    wanted = {FILE: settings(modules), "AGENTS.md": rules(commands)}
    if ci:
        wanted[".github/workflows/context.yml"] = WORKFLOW
    if hooks:
        if not os.path.isdir(os.path.join(config.root, ".git")):
            raise ValueError("a hook needs a git repository")
        wanted[".git/hooks/pre-commit"] = HOOK
    out = []
    for path, text in wanted.items():
        if os.path.lexists(os.path.join(config.root, path)):
            out.append((path, "kept"))
            continue
        full = write_document(config.root, path, text)
        if text is HOOK:
            os.chmod(full, 0o755)
        out.append((path, "created"))
    for folder in ("docs/context", f"{GENERATED}/packs"):
        os.makedirs(os.path.join(config.root, folder), exist_ok=True)
    return out
