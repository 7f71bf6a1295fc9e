"""Filters over elements, and ordered pages of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import K1
from ..model import ELEMENT_TYPES, LANGUAGES, known

MAX_PAGE, DEFAULT_PAGE = 500, 50
#: Sort field -> (column, compared in lower case).
SORTS = {"NAME": ("name", True), "QUALIFIED_NAME": ("qualified_name", True), "FILE_PATH": ("file_path", True), "LINE": ("line_start", False), "ELEMENT_TYPE": ("element_type", False), "LANGUAGE": ("language", False)}


@dataclass
class SearchQuery:
    """A search request; blank and empty parts are no constraint."""

    text: str | None = None
    repo_ids: list[str] = field(default_factory=list)
    element_types: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    file_pattern: str | None = None
    name_prefix: str | None = None
    visibility: str | None = None
    modifier: str | None = None
    sort: str = "RELEVANCE"
    ascending: bool = True
    limit: int = DEFAULT_PAGE
    offset: int = 0


def path_matches(pattern: str) -> Column:
    """The whole path, in lower case; * and ? cross slashes."""
    rx = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())
    return F.lower("file_path").rlike(f"(?s)^{rx}$")


def predicates(q: SearchQuery) -> list[Column]:
    out = []
    if q.repo_ids:
        out.append(F.col("repo_id").isin(q.repo_ids))
    if types := known(q.element_types, ELEMENT_TYPES):
        out.append(F.col("element_type").isin(types))
    if langs := known(q.languages, list(LANGUAGES)):
        out.append(F.col("language").isin(langs))
    if q.file_pattern and q.file_pattern.strip():
        out.append(path_matches(q.file_pattern))
    if q.name_prefix and q.name_prefix.strip():
        out.append(F.lower("qualified_name").startswith(q.name_prefix.lower()))
    if q.visibility and q.visibility.strip():
        out.append(F.lower("visibility") == q.visibility.lower())
    if q.modifier and q.modifier.strip():
        out.append(F.array_contains(F.transform("modifiers", F.lower), q.modifier.lower()))
    return out


def _clause_scores(found: DataFrame, elements: DataFrame, q: SearchQuery) -> DataFrame:
    """``found`` with what the repository, type and language that it has add to its score: each asked value is a term of a field without lengths, so a rare one of several counts for more. Statistics are of all elements."""
    for column, asked in (("repo_id", q.repo_ids), ("element_type", known(q.element_types, ELEMENT_TYPES)), ("language", known(q.languages, list(LANGUAGES)))):
        if asked:
            each = elements.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_df"))
            docs = each.agg(F.sum("_df").alias("n")).first()["n"] or 0
            idf = F.log(1 + (F.lit(docs) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
            part = each.filter(F.col(column).isin(asked)).select(column, (idf / (1 + K1)).alias("_part"))  # as many rows as values are asked
            found = found.join(F.broadcast(part), column).withColumn("score", F.col("score") + F.col("_part")).drop("_part")
    return found


def search(elements: DataFrame, q: SearchQuery, scores: DataFrame | None = None) -> DataFrame:
    """Matching elements before ordering and paging; ``scores`` (id, score) are those of the text, if there is one, and filters by repository, type and language add to them."""
    out = elements
    for p in predicates(q):
        out = out.filter(p)
    return _clause_scores(out.join(scores, "id"), elements, q) if q.text and q.text.strip() and scores is not None else out


def page(found: DataFrame, q: SearchQuery) -> DataFrame:
    """Ordered, with the id as the last key; at most 500 rows from the offset."""
    n = DEFAULT_PAGE if q.limit <= 0 else min(q.limit, MAX_PAGE)
    if q.sort in SORTS:
        name, lower = SORTS[q.sort]
        key = F.lower(name) if lower else F.col(name)
        found = found.orderBy(key.asc() if q.ascending else key.desc(), "id")
    else:
        found = found.orderBy(*([F.desc("score")] if "score" in found.columns else []), "id")
    return found.offset(max(0, q.offset)).limit(n)


def at_location(elements: DataFrame, file_path: str, line: int) -> DataFrame:
    """Elements over a line of a file, innermost first; a missing end is open and comes last."""
    hit = elements.filter((F.col("file_path") == file_path) & (F.col("line_start") > 0) & (F.col("line_start") <= line) & ((F.col("line_end") <= 0) | (F.col("line_end") >= line)))
    span = F.col("line_end") - F.col("line_start")
    return hit.withColumn("span", F.when(span < 0, F.lit(2**31 - 1)).otherwise(span)).orderBy("span", "id")


def by_qualified_name(elements: DataFrame, name: str) -> DataFrame:
    return elements.filter(F.col("qualified_name") == name).orderBy("id")


def repo_structure(elements: DataFrame, repo_id: str, depth: int = 3, limit: int = 500) -> DataFrame:
    """Directories and files by path, as deep as ``depth`` slashes."""
    slashes = F.size(F.split("file_path", "/")) - 1
    return elements.filter((F.col("repo_id") == repo_id) & F.col("element_type").isin("DIRECTORY", "FILE") & (slashes <= depth)).orderBy("file_path", "id").limit(limit)


def readme(elements: DataFrame, repo_id: str) -> DataFrame:
    """The markdown document whose path ends readme.md or readme.markdown, else the first."""
    docs = elements.filter((F.col("repo_id") == repo_id) & (F.col("element_type") == "MARKDOWN_DOCUMENT"))
    return docs.orderBy(F.lower("file_path").rlike(r"readme\.(md|markdown)$").desc(), "file_path", "id").limit(1)
