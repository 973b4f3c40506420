"""Copies of the rules, or links to them, where other tools look for theirs."""

from __future__ import annotations

import os

from orrery.plans.repo import write_document
from orrery.sources.config import Config
from orrery.sources.files import read_text

# Where rules are copied to.
TARGETS = {"claude": "CLAUDE.md", "cursor": ".cursorrules", "gemini": "GEMINI.md", "copilot": ".github/copilot-instructions.md", "windsurf": ".windsurfrules"}
DEFAULT = ["claude"]
MARK = "<!-- a copy of AGENTS.md: change that file, not this one -->\n"


def targets(config: Config) -> dict[str, str]:
    """The wanted targets, ``DEFAULT`` where none are named; an unknown one is an error."""
    wanted = config.sync.get("targets")
    wanted = DEFAULT if wanted is None else wanted
    unknown = [t for t in wanted if t not in TARGETS]
    if unknown:
        raise ValueError(f"no such target: {', '.join(unknown)}; there are: {', '.join(TARGETS)}")
    return {t: TARGETS[t] for t in wanted}


def _links(config: Config, path: str) -> bool:
    return os.path.exists(path) and os.path.realpath(path) == os.path.realpath(os.path.join(config.root, "AGENTS.md"))


def sync_status(config: Config) -> list[tuple[str, str, str]]:
    """(target, path, in sync | missing | differs) of each configured copy or link."""
    want, out = MARK + (read_text(os.path.join(config.root, "AGENTS.md")) or ""), []
    for name, path in targets(config).items():
        full = os.path.join(config.root, path)
        have = read_text(full)
        out.append((name, path, "in sync" if _links(config, full) or have == want else "missing" if have is None else "differs"))
    return out


def sync_rules(config: Config, force: bool = False, link: bool = False) -> list[tuple[str, str]]:
    """(path, written | linked | unchanged | refused): copy or link the rules to each place.

    A file that is neither such a copy nor such a link is refused unless forced.
    """
    rules, out = read_text(os.path.join(config.root, "AGENTS.md")), []
    if rules is None:
        raise ValueError("there are no rules to copy: AGENTS.md is missing")
    for path in targets(config).values():
        full = os.path.join(config.root, path)
        old, linked = read_text(full), _links(config, full)
        if linked if link else old == MARK + rules and not os.path.islink(full):
            out.append((path, "unchanged"))
        elif old is not None and not linked and not old.startswith(MARK) and not force:
            out.append((path, "refused"))
        else:
            if os.path.lexists(full):
                os.remove(full)
            if link:
                os.makedirs(os.path.dirname(full), exist_ok=True)
                os.symlink(os.path.relpath(os.path.join(config.root, "AGENTS.md"), os.path.dirname(full)), full)
            else:
                write_document(config.root, path, MARK + rules)
            out.append((path, "linked" if link else "written"))
    return out
