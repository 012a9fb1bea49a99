"""Glob patterns as regular expressions over path columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """``*`` and ``?`` stay inside a folder, ``**/`` crosses any number of them."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "{":
            depth += 1
            out.append("(?:")
        elif ch == "}" and depth:
            depth -= 1
            out.append(")")
        elif ch == "," and depth:
            out.append("|")
        elif ch == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    if depth:
        raise ValueError(f"unbalanced braces in {pattern!r}")
    return "^" + "".join(out) + "$"


def glob_match(path: Column | str, pattern: str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return path.rlike(glob_regex(pattern))


def basename(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def glob_match_any(path: Column | str, pattern: str) -> Column:
    """Match the file name or the whole path."""
    return glob_match(basename(path), pattern) | glob_match(path, pattern)
