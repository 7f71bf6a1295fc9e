"""Tokens, postings, full-text match, BM25, and rendering of elements."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("name", "qualified_name", "snippet", "doc_comment", "signature")
TOKEN = r"[\p{L}\p{N}_]+(?:[.:'’][\p{L}\p{N}_]+)*"
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(text: str) -> list[str]:
    return sorted(set(re.findall(r"\w+(?:[.:'’]\w+)*", text.lower())))


def _each_field(elements: DataFrame, fields: tuple[str, ...], made: str, value: Callable[[Column], Column], *more: str) -> DataFrame:
    """(id, ``more``, field, ``made``): one row for each field of an element, with ``value`` of its text."""
    have = [f for f in fields if f in elements.columns]
    return elements.select("id", *more, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), value(F.col(f)).alias(made)) for f in have))).alias("x")).select("id", *more, "x.*")


def postings(elements: DataFrame, fields: tuple[str, ...] = FIELDS, terms: list[str] | None = None) -> DataFrame:
    """(field, id, term, tf, dl): one row for each term of an element's field. With ``terms`` only these become rows, and texts without any are not taken apart."""
    if terms is None:
        each = _each_field(elements, fields, "ts", tokens).filter("ts is not null and size(ts) > 0")
        found = F.col("ts")
    else:
        some = lambda c: F.when(reduce(or_, (F.contains(F.lower(c), F.lit(t)) for t in terms), F.lit(False)), tokens(c))
        each = _each_field(elements, fields, "ts", some).filter("ts is not null")
        found = F.filter("ts", lambda t: t.isin(terms))
    return each.select("field", "id", F.size("ts").alias("dl"), F.explode(found).alias("term")).groupBy("field", "id", "term", "dl").agg(F.count("*").cast("int").alias("tf")).select("field", "id", "term", "tf", "dl")


def _shared_ids(elements: DataFrame) -> DataFrame:
    """``elements`` with _twice: whether the id may be that of another row too; it surely is not where this is false. Only hashes of ids travel, and of those that come twice at most 65,536 numbers go to every task."""
    mark = lambda h: F.pmod(h, F.lit(1 << 16)).cast("int")
    seen = elements.select(F.xxhash64("id").alias("_h")).groupBy("_h").agg(F.count("*").alias("_c")).filter("_c > 1")
    seen = seen.select(mark(F.col("_h")).alias("_m")).distinct().withColumn("_twice", F.lit(True))
    return elements.withColumn("_m", mark(F.xxhash64("id"))).join(F.broadcast(seen), "_m", "left").withColumn("_twice", F.col("_twice").isNotNull()).drop("_m")


def _kept_apart(*columns: str) -> list[Column]:
    """Grouping keys that tell rows of shared ids apart, and no others."""
    return [F.when(F.col("_twice"), F.col(c)).alias(c) for c in columns]


def term_counts(elements: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, term, n): rows of ``postings`` for each term. They are counted where texts are read; only those of shared ids travel one by one."""
    each = _each_field(_shared_ids(elements.filter(_any_text(elements, fields))), fields, "ts", tokens, "_twice").filter("ts is not null and size(ts) > 0")
    each = each.select("field", "_twice", *_kept_apart("id"), F.when(F.col("_twice"), F.size("ts")).alias("dl"), F.explode(F.array_distinct("ts")).alias("term"))
    once = each.groupBy("field", "term", "_twice", "id", "dl").agg(F.count("*").alias("n"))
    return once.groupBy("field", "term").agg(F.sum(F.when(F.col("_twice"), 1).otherwise(F.col("n"))).alias("n"))


def text_stats(elements: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, docs, total) as ``bm25`` counts them in postings: rows of one id that are equally long in a field count once."""
    each = _each_field(_shared_ids(elements.filter(_any_text(elements, fields))), fields, "dl", lambda c: F.size(tokens(c)), "_twice").filter("dl > 0")
    once = each.groupBy("field", "_twice", *_kept_apart("id"), F.when(F.col("_twice"), F.col("dl")).alias("k")).agg(F.count("*").alias("docs"), F.sum("dl").alias("total"))
    apart = lambda c: F.sum(F.when(F.col("_twice"), c[0]).otherwise(c[1]))
    return once.groupBy("field").agg(apart((F.lit(1), F.col("docs"))).alias("docs"), apart((F.col("k"), F.col("total"))).alias("total"))


def _any_text(elements: DataFrame, fields: tuple[str, ...]) -> Column:
    return reduce(or_, (F.col(f).isNotNull() for f in fields if f in elements.columns), F.lit(False))


def ranked(elements: DataFrame, text: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, score) of ``bm25`` over elements: postings are made of the asked terms alone."""
    return bm25(postings(elements, fields, query_terms(text)), text, text_stats(elements, fields))


def fulltext_match(posts: DataFrame, text: str) -> DataFrame:
    """(id): every term in one and the same field, in any field."""
    terms = query_terms(text)
    hit = posts.filter(F.col("term").isin(terms)).groupBy("id", "field").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(terms))
    return hit.select("id").distinct()


def field_stats(elements: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, docs, total): how many elements have terms in a field, and how many terms; no postings are made for it."""
    have = [f for f in fields if f in elements.columns]
    each = elements.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.size(tokens(F.col(f))).alias("dl")) for f in have)).cast("array<struct<field:string,dl:int>>")).alias("x")).select("x.*").filter("dl > 0")
    return each.groupBy("field").agg(F.count("*").alias("docs"), F.sum("dl").alias("total"))


def bm25(posts: DataFrame, text: str, stats: DataFrame | None = None) -> DataFrame:
    """(id, score): summed over terms and fields in which all terms match. ``stats`` (field, docs, total) if they are known."""
    terms = query_terms(text)
    if stats is None:
        stats = posts.select("field", "id", "dl").distinct().groupBy("field").agg(F.count("*").alias("docs"), F.sum("dl").alias("total"))
    docs = stats.select("field", "docs", (F.col("total") / F.col("docs")).alias("mean"))
    hit = posts.filter(F.col("term").isin(terms))
    whole = hit.groupBy("id", "field").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(terms)).drop("n")
    df = hit.groupBy("field", "term").agg(F.count("*").alias("df"))
    scored = hit.join(whole, ["id", "field"]).join(F.broadcast(df), ["field", "term"]).join(F.broadcast(docs), "field")  # at most terms x 5 and 5 rows
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return scored.groupBy("id").agg(F.sum(part).alias("score"))


def summary_line(columns: list[str]) -> Column:
    """[TYPE] name (path:start-end), and on lines of their own the signature, up to 120 characters of the snippet and 100 of the doc comment, where ``columns`` has them."""
    name = F.coalesce("qualified_name", "name", F.lit("(unnamed)"))
    lines = F.when(F.col("line_start") > 0, F.concat(F.lit(":"), F.col("line_start").cast("string"), F.when(F.col("line_end") > F.col("line_start"), F.concat(F.lit("-"), F.col("line_end").cast("string"))).otherwise(""))).otherwise("")
    where = F.when(F.col("file_path").isNotNull(), F.concat(F.lit(" ("), "file_path", lines, F.lit(")"))).otherwise("")
    more = []
    for column, title, most in (("signature", "Signature", 0), ("snippet", "Preview", 120), ("doc_comment", "Doc", 100)):
        if column in columns:
            text = F.regexp_replace(column, r"^\s+|\s+$", "") if most else F.col(column)
            text = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text) if most else text
            more.append(F.coalesce(F.concat(F.lit(f"\n   {title}: "), text), F.lit("")))
    return F.concat(F.lit("["), "element_type", F.lit("] "), name, where, *more)


def numbered_lines(elements: DataFrame) -> DataFrame:
    """(id, line, rendered): each line of a snippet with its number, from the element's first line or 1."""
    first = F.when(F.col("line_start") > 0, F.col("line_start")).otherwise(1)
    each = elements.filter("snippet is not null").select("id", first.alias("first"), F.posexplode(F.split("snippet", "\n")).alias("pos", "text"))
    line = (F.col("first") + F.col("pos")).cast("int")
    return each.select("id", line.alias("line"), F.concat(F.when(F.length(line.cast("string")) < 4, F.lpad(line.cast("string"), 4, " ")).otherwise(line.cast("string")), F.lit(" | "), "text").alias("rendered"))


def full_render(columns: list[str]) -> Column:
    """All filled columns of an element, one a line."""
    return F.concat_ws("\n", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns))


def snippet_from_source(elements: DataFrame, files: DataFrame, context: int = 0) -> DataFrame:
    """(id, text): the element's lines and ``context`` around them from files (repo_id, file_path, content); the stored snippet where there is no file."""
    joined = elements.join(files.select("repo_id", "file_path", "content"), ["repo_id", "file_path"], "left")
    start = F.greatest(F.lit(1), F.col("line_start") - context)
    own = F.array_join(F.slice(F.split("content", "\n"), start, F.greatest(F.col("line_end"), F.col("line_start")) + context - start + 1), "\n")
    return joined.select("id", F.coalesce(F.when(F.col("line_start") > 0, own), F.col("snippet")).alias("text"))


def short_label(name: Column, most: int = 30, ends: str = "…") -> Column:
    """A name as a drawing has it: of one longer than ``most`` the first ``most`` - 2, and ``ends``."""
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 2), F.lit(ends))).otherwise(name)
