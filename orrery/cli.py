"""python -m orrery.cli init|map|pack|explain|check|get|find|rules|module|sync|eval [--root DIR] ..."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from orrery.operators import baseline
from orrery.plans import checks, evaluation, scaffold
from orrery.plans.repo import MAP, Repo, write_document
from orrery.plans.sync import sync_rules
from orrery.session import session
from orrery.sources import baseline_file, config

COMMANDS = ["init", "map", "pack", "explain", "check", "get", "find", "rules", "module", "sync", "eval"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("argument", nargs="?", default="", help="what to get or find, the module, or the file of tasks")
    p.add_argument("--root", default=".")
    p.add_argument("--profile", default="light", help="of eval: profiles with commas between")
    p.add_argument("--budget", type=int, default=8000)
    for name in ("module", "about", "diff", "models", "out"):
        p.add_argument(f"--{name}")
    for name in ("stdout", "no-baseline", "update-baseline", "run-commands", "force", "link", "auto", "hooks", "ci", "yes"):
        p.add_argument(f"--{name}", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    c = config.load(a.root)
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    if a.command in ("sync", "init"):
        rows = sync_rules(c, a.force, a.link) if a.command == "sync" else scaffold.scaffold(session() if a.auto else None, c, a.auto, a.hooks, a.ci)
        print(*(f"{path} {state}" for path, state in rows), sep="\n")
        return 0
    if a.run_commands:
        c.rot["run"] = True
    repo = Repo(session(), c, now)

    def put(path: str, text: str) -> None:
        print(text if a.stdout else f"wrote {write_document(c.root, a.out or path, text)}")

    if a.command == "map":
        put(MAP, repo.map(a.budget))
    elif a.command == "pack":
        pack = repo.pack(a.profile, a.module, a.about, a.diff)
        put(pack.path, pack.content)
        print(*pack.notes, sep="\n", file=sys.stderr)
    elif a.command == "explain":
        repo.explain(a.profile, a.module, a.about, a.diff).show(20, False)
    elif a.command == "get":
        print(repo.context(a.argument, a.budget))
    elif a.command == "find":
        print(repo.find(a.argument))
    elif a.command == "rules":
        print(repo.rules())
    elif a.command == "module":
        print(repo.module_context(a.argument, a.profile, a.about))
    elif a.command == "eval":
        tasks, profiles = config.load_tasks(a.argument), a.profile.split(",")
        if not a.models:
            put("eval/inclusion.md", evaluation.dry_run_report(*evaluation.dry_run(repo, tasks, profiles, a.module), now[:10]))
        else:
            ask = lambda n: a.yes or input(f"{n} calls. Go on? [y/N] ").strip().lower() in ("y", "yes")
            results = evaluation.model_run(repo, tasks, profiles, evaluation.models(a.models), ask, a.module)
            if results is not None:
                put("eval/results.md", evaluation.model_report(results, now[:10]))
    else:
        results = checks.run(repo, not (a.no_baseline or a.update_baseline))
        if a.update_baseline:
            baseline_file.write(c.root, baseline.entries(results))
            return 0
        for r in results.orderBy("name", "file", "line").collect():
            print(f"{r.level:5} {r.name}: {r.detail}")
        return int(baseline.failures(results) > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
