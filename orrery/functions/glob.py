"""Path globs as regular expressions, and their use on columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(glob: str) -> str:
    """A regular expression for the whole path, for Java and RE2.

    ``*`` and ``?`` stay in a segment, ``**`` as a whole segment spans any number of them, ``[...]`` and ``{a,b}`` as
    usual; names may start with a dot. A backslash takes the next character literally.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            if i and out[-1] == "/":
                out[-1] = "(?:/.*)?"  # the folder itself, too
            else:
                out.append(".*")
            break
        if c == "*":
            out.append("[^/]*")
            while glob[i : i + 1] == "*":
                i += 1
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{" and "}" in glob[i:]:
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            out.append("\\" + c if c in r".*+?^${}()|[]\\" else c)
        i += 1
    return "^(?:" + "".join(out) + r")\z"


def compiled(glob: str) -> re.Pattern:
    """The glob for use in Python."""
    return re.compile(to_regex(glob).removesuffix(r"\z") + r"\Z")


def is_glob(text: str) -> bool:
    return any(c in text for c in "*?[]")


def matches(path: Column, globs: Sequence[str]) -> Column:
    """Whether any of the globs matches; false without globs and for null."""
    any_ = reduce(lambda a, b: a | b, (path.rlike(to_regex(g)) for g in globs), F.lit(False))
    return F.coalesce(any_, F.lit(False))


def excluded(path: Column, globs: Sequence[str]) -> Column:
    """Whether a glob matches the path or one of the folders above it, which excludes all they hold."""
    ups = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda n: F.array_join(F.slice(F.split(path, "/"), F.lit(1), n), "/"))
    return F.coalesce(F.exists(ups, lambda p: matches(p, globs)), F.lit(False)) if globs else F.lit(False)
