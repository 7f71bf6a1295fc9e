"""Exclude globs: unlike those of a search, * stays within a path's step."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a scan leaves out unless told otherwise.
DEFAULT_EXCLUDES = ("**/target/**", "**/build/**", "**/.git/**", "**/node_modules/**", "**/.idea/**", "**/*.class")


def glob_regex(glob: str) -> str:
    """** is any text (a slash after it belongs to it), * and ? are of one step; the whole path must match."""
    wild = lambda m: ".*" if m[0][:2] == "**" else r"[^/\\]*" if m[0] == "*" else r"[^/\\]" if m[0] == "?" else re.escape(m[0])
    return "^" + re.sub(r"(?s)\*\*[/\\]?|\*|\?|.", wild, glob) + "$"


def excluded(path: Column, globs=DEFAULT_EXCLUDES, root: str | None = None) -> Column:
    """Whether a glob matches the path, or with a ``root`` the absolute path below it."""
    if not globs:
        return F.lit(False)
    rx = "|".join(f"(?:{glob_regex(g)})" for g in globs)
    return path.rlike(rx) if root is None else path.rlike(rx) | F.concat(F.lit(root.rstrip("/") + "/"), path).rlike(rx)


def without_excluded(files: DataFrame, globs=DEFAULT_EXCLUDES, column: str = "file_path") -> DataFrame:
    return files.filter(~excluded(F.col(column), globs))
