"""Glob patterns as regular expressions that don't backtrack over segments."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BREAK = "\n\r  "


def _segment(part: str) -> str:
    # Runs of stars are one star, so that patterns of many stars stay cheap.
    out = re.sub(r"\*+", "*", part)
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in out)


def glob_regex(pattern: str) -> str:
    """*, ? within a segment and ** as a whole segment; without a slash the pattern holds at any depth."""
    rooted = "/" in pattern
    parts = pattern.strip("/").split("/")
    out, i = "", 0
    while i < len(parts):
        if parts[i] == "**":
            while i + 1 < len(parts) and parts[i + 1] == "**":
                i += 1
            out += f"(?:[^/{_BREAK}]+/)*" if i + 1 < len(parts) else f"[^{_BREAK}]*"
        else:
            out += _segment(parts[i]) + ("/" if i + 1 < len(parts) else "")
        i += 1
    return f"^{out}$" if rooted else f"(?:^|/){out}$"


def matches_any(path: Column | str, patterns: list[str]) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return reduce(lambda a, b: a | b, (path.rlike(glob_regex(p)) for p in patterns), F.lit(False))
