"""JSON and Markdown files into elements and edges in Spark expressions alone: no Python workers.

JSON goes through variants, level by level; a Markdown file's fences, headings and sections are found in the array of its lines, in one narrow pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..store import materialize, spread
from .rows import SNIPPET_LINES

_KEYS = ("repo_id", "file_path")
_FQCN = r"^(?:[a-z_][a-z0-9_]*\.)+[A-Z][A-Za-z0-9_$]*$"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def _truncated(text: Column) -> Column:
    lines = F.split(text, "\n")
    return F.when(F.size(lines) <= SNIPPET_LINES, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, SNIPPET_LINES), "\n"), F.lit("\n// ... (truncated)")))


def _base(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def _elements(rows: DataFrame, **given: Column) -> DataFrame:
    """Rows in the shape of the model: ``given`` columns, those that the rows have, and else nothing."""
    have = set(rows.columns)
    return rows.select(*((given[f.name] if f.name in given else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in model.ELEMENTS))


def _edges(ends: list[DataFrame]) -> DataFrame:
    """(from_id, edge_type, to_id) in the shape of the model."""
    all_ = reduce(DataFrame.unionByName, ends)
    return all_.select(model.edge_id(*map(F.col, ("from_id", "edge_type", "to_id"))).alias("id"), "from_id", "to_id", "edge_type", F.lit(None).cast("map<string,string>").alias("metadata"))


def _id(kind: str, name: Column) -> Column:
    return model.element_id(F.col("repo_id"), F.col("file_path"), F.lit(kind), name)


def _last_column(text: Column) -> Column:
    """Of the character before the last, counted from its line's start."""
    head = F.substring(text, 1, F.greatest(F.length(text) - 1, F.lit(0)))
    return F.length(head) - F.length(F.regexp_extract(head, r"(?s)^(.*\n)", 1)) + 1


# -- JSON


def json_leaves(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (repo_id, file_path, content) -> ((repo_id, file_path, path, leaf), files that aren't JSON).

    A frontier of containers is opened level by level with ``variant_explode``; each level is written, so as many rounds as the deepest file has levels. Of a key that is there twice the last counts; lists count from [0]; empty containers have no leaf; numbers with a fraction or exponent read as Java prints a double (-0.0 as 0.0).
    """
    spark, key = files.sparkSession, "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        # What stands behind a first value is not read; within an array and an object it must be one value, so the text holds nothing else.
        whole = files.select(*_KEYS, F.try_parse_json(F.concat(F.lit("["), "content", F.lit("]"))).alias("a"), F.try_parse_json(F.concat(F.lit('{"x":'), "content", F.lit("}"))).alias("o"))
        one = F.try_variant_get("a", "$[0]", "variant")
        read = materialize(whole.select(*_KEYS, F.lit("").alias("path"), F.when(F.col("o").isNotNull() & F.try_variant_get("a", "$[1]", "variant").isNull(), one).alias("v")))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    kind = F.schema_of_variant("v")
    opens = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
    at, found = read.filter("v is not null").withColumn("kind", kind), []
    while True:
        text = F.when(F.col("kind") == "VOID", "null").when((F.col("kind") == "DOUBLE") | F.col("kind").rlike(r"^DECIMAL\((\d|1[0-8]),|^DECIMAL\(\d+,(?!0\))"), F.try_variant_get("v", "$", "double").cast("string")).otherwise(F.try_variant_get("v", "$", "string"))
        found.append(at.filter(~opens).select(*_KEYS, "path", text.alias("leaf")))
        inner = at.filter(opens).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        name = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), F.col("key")))
        at = materialize(inner.select(*_KEYS, name.alias("path"), F.col("value").alias("v")).withColumn("kind", kind))
        if at.isEmpty():
            break
    return reduce(DataFrame.unionByName, found), read.filter("v is null").select(*_KEYS)


def parse_json(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files (repo_id, file_path, content) -> elements (the file and its leaves), edges, errors. A file that can't be read, an empty or null one too, leaves its error alone."""
    leaves, bad = json_leaves(files)
    top = _id("CONFIG_FILE", F.col("file_path"))
    content = F.coalesce("content", F.lit(""))
    head = F.substring(content, 1, F.greatest(F.length(content) - 1, F.lit(0)))
    whole = files.join(bad, list(_KEYS), "left_anti").withColumns({"element_type": F.lit("CONFIG_FILE"), "language": F.lit("JSON")})
    whole = _elements(whole, id=top, name=_base(F.col("file_path")), qualified_name=F.col("file_path"), snippet=_truncated(_trimmed(content)), line_start=F.lit(1), line_end=F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1, col_start=F.lit(1), col_end=_last_column(content))
    own = F.concat("file_path", F.lit("#"), F.col("path"))
    keys = _elements(leaves.withColumns({"element_type": F.lit("CONFIG_KEY"), "language": F.lit("JSON")}), id=_id("CONFIG_KEY", own), name=F.col("path"), qualified_name=own, snippet=F.col("leaf"), line_start=F.lit(0), line_end=F.lit(0), parent_id=top)
    inside = leaves.select(top.alias("from_id"), F.lit("CONTAINS").alias("edge_type"), _id("CONFIG_KEY", own).alias("to_id"))
    classes = leaves.filter(F.col("leaf").rlike(_FQCN)).select(_id("CONFIG_KEY", own).alias("from_id"), F.lit("REFERENCES_CLASS").alias("edge_type"), _id("CLASS", F.col("leaf")).alias("to_id"))
    return whole.unionByName(keys), _edges([inside, classes]), bad.withColumn("error", F.lit("not JSON"))


# -- Markdown

_MARK = r"^ {0,3}(`{3,}|~{3,})"
_ATX = r"(?s)^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\z"
_UNDER = r"^ {0,3}(?:=+|-+)[ \t]*\z"
_NO_TITLE = r"^ {0,3}(?:[#>*+-]|\d+[.)])"
_README = r"(?i)(?:^|/)readme\.(?:md|markdown)\z"


def _fences(lines: str) -> Column:
    """Spans (a, z) of fenced lines, marks included: a fence ends at a line of its own sign alone, as long at least, or with the file."""
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, _MARK, 1).alias("m"), F.regexp_replace(x, r"\s", "").alias("x"))), lambda x: x["m"] != "")
    none, empty = F.lit(None).cast("struct<i:int,m:string,x:string>"), F.array().cast("array<struct<a:int,z:int>>")

    def step(s: Column, x: Column) -> Column:
        open_ = s["open"]
        ends = (F.substring(x["m"], 1, 1) == F.substring(open_["m"], 1, 1)) & (F.length(x["m"]) >= F.length(open_["m"])) & (F.length(x["x"]) == F.length(x["m"]))
        closed = F.concat(s["spans"], F.array(F.struct(open_["i"].alias("a"), x["i"].alias("z"))))
        return F.when(open_.isNull(), F.struct(x.alias("open"), s["spans"].alias("spans"))).when(ends, F.struct(none.alias("open"), closed.alias("spans"))).otherwise(s)

    last = lambda s: F.when(s["open"].isNull(), s["spans"]).otherwise(F.concat(s["spans"], F.array(F.struct(s["open"]["i"].alias("a"), F.lit(2147483647).alias("z")))))
    return F.aggregate(marks, F.struct(none.alias("open"), empty.alias("spans")), step, last)


def headings(files: DataFrame) -> DataFrame:
    """files (repo_id, file_path, content) -> with ``lines`` and ``heads`` (array of line from 1, level, title, underlined, in order): ATX and underlined headings outside fenced code."""
    rows = files.select(*_KEYS, F.coalesce("content", F.lit("")).alias("content")).withColumn("lines", F.split("content", "\n")).withColumn("fences", _fences("lines"))

    def head(x: Column, i: Column) -> Column:
        free = lambda n: ~F.exists("fences", lambda s: (s["a"] <= n) & (n <= s["z"]))
        before = F.get("lines", i - 1)
        atx = F.struct((i + 1).alias("line"), F.length(F.regexp_extract(x, _ATX, 1)).alias("level"), _trimmed(F.regexp_extract(x, _ATX, 2)).alias("title"), F.lit(False).alias("under"))
        under = F.struct(i.alias("line"), F.when(x.contains("="), 1).otherwise(2).alias("level"), _trimmed(before).alias("title"), F.lit(True).alias("under"))
        return F.when(x.rlike(_ATX) & free(i), atx).when(x.rlike(_UNDER) & before.rlike(r"\S") & ~before.rlike(_NO_TITLE) & free(i) & free(i - 1), under)

    return rows.withColumn("heads", F.filter(F.transform("lines", head), lambda h: h.isNotNull())).drop("fences")


def _outlined(files: DataFrame) -> DataFrame:
    """Of each file one row, written: its content, size and end in lines, the text above its headings (null: none), and by heading ``heads`` (line, level, title, text of the line, span below, the next one's line and title, whether there is text below) and ``bodies``, that text.

    A row never holds a file's lines once for each heading, so a file takes as long as it has lines.
    """
    rows = headings(spread(files.select(*_KEYS, "content")).dropDuplicates(list(_KEYS)))
    size = F.size("lines")
    end = size - F.when(F.col("content").endswith("\n"), 1).otherwise(0)
    below = lambda first, last: F.regexp_replace(F.array_join(F.slice("lines", first, F.greatest(last - first + 1, F.lit(0))), "\n"), r"\s+\z", "")
    first, last = lambda h: h["line"] + 1 + h["under"].cast("int"), lambda j: F.coalesce(F.get("heads", j + 1)["line"] - 1, F.col("end"))
    rows = rows.select(*_KEYS, "content", "lines", "heads", size.alias("size"), end.alias("end"))
    free = F.size("heads") == 0
    upto = F.when(free, F.col("end")).otherwise(F.get("heads", F.lit(0))["line"] - 1)
    rows = rows.withColumns({"upto": upto, "bodies": F.transform("heads", lambda h, j: below(first(h), last(j)))}).withColumn("intro", below(F.lit(1), F.col("upto")))
    head = lambda h, j: F.struct(h["line"].alias("line"), h["level"].alias("level"), h["title"].alias("title"), F.get("lines", h["line"] - 1).alias("text"), first(h).alias("first"), last(j).alias("last"), F.get("heads", j + 1)["line"].alias("next_line"), F.get("heads", j + 1)["title"].alias("next_title"), F.get("bodies", j).rlike(r"\S").alias("filled"))
    return materialize(rows.select(*_KEYS, "content", "size", "upto", F.when(F.col("intro").rlike(r"\S"), F.col("intro")).alias("intro"), F.transform("heads", head).alias("heads"), "bodies"))


def parse_markdown(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (repo_id, file_path, content) -> elements, edges: the document, its headings, the text below each up to the next, and their order. Null and empty files are a document alone; of a path that is there twice one row counts."""
    rows = _outlined(files)
    doc = _id("MARKDOWN_DOCUMENT", F.col("file_path"))
    common = {"language": F.lit("MARKDOWN")}
    documents = _elements(rows.withColumns(common | {"element_type": F.lit("MARKDOWN_DOCUMENT")}), id=doc, name=_base(F.col("file_path")), qualified_name=F.col("file_path"), snippet=F.col("content"), line_start=F.lit(1), line_end=F.col("size"), col_start=F.lit(1), col_end=_last_column(F.col("content")))

    named = lambda kind, title, line: F.concat("file_path", F.lit(f"#{kind}:"), title, F.lit("@"), line.cast("string"))
    key = lambda kind, h: named(kind, h["title"], h["line"])
    h = F.col("h")
    each = rows.select(*_KEYS, F.explode("heads").alias("h"))
    line = h["text"]
    heads = _elements(each.withColumns(common | {"element_type": F.lit("MARKDOWN_HEADING")}), id=_id("MARKDOWN_HEADING", key("heading", h)), name=h["title"], qualified_name=key("heading", h), snippet=_trimmed(line), line_start=h["line"], line_end=h["line"], col_start=F.lit(1), col_end=F.greatest(F.length(line), F.lit(1)), parent_id=doc, metadata=F.create_map(F.lit("level"), h["level"].cast("string")))
    own = _id("MARKDOWN_HEADING", key("heading", h))
    free = F.size("heads") == 0
    below = rows.select(*_KEYS, F.explode(F.arrays_zip("heads", "bodies")).alias("z")).select(*_KEYS, F.col("z.heads").alias("h"), F.col("z.bodies").alias("body")).filter("h.filled")
    below = below.select(*_KEYS, h["first"].alias("first"), h["last"].alias("last"), h["title"].alias("name"), key("section", h).alias("own"), own.alias("above"), "body")
    above = rows.filter("intro is not null").select(*_KEYS, F.lit(1).alias("first"), F.col("upto").alias("last"), F.when(free, "(content)").otherwise("(preamble)").alias("name"), F.concat("file_path", F.when(free, "#content").otherwise("#preamble")).alias("own"), doc.alias("above"), F.col("intro").alias("body"))
    section = _id("MARKDOWN_SECTION", F.col("own"))
    sections = _elements(below.unionByName(above).withColumns(common | {"element_type": F.lit("MARKDOWN_SECTION")}), id=section, qualified_name=F.col("own"), snippet=F.col("body"), line_start=F.col("first"), line_end=F.col("last"), col_start=F.lit(1), col_end=F.length(F.regexp_extract("body", r"[^\n]*\z", 0)), parent_id=F.col("above"))

    edge = lambda df, a, kind, b: df.select(a.alias("from_id"), F.lit(kind).alias("edge_type"), b.alias("to_id"))
    folder = F.regexp_extract("file_path", r"^(.*)/", 1)
    readme = rows.filter(F.col("file_path").rlike(_README))
    ends = [
        edge(each, doc, "CONTAINS", own), edge(each, own, "SECTION_OF", doc), edge(each.filter("h.next_line is not null"), own, "PRECEDES", _id("MARKDOWN_HEADING", named("heading", h["next_title"], h["next_line"]))), edge(each.filter("h.filled"), own, "CONTAINS", _id("MARKDOWN_SECTION", key("section", h))), edge(above, F.col("above"), "CONTAINS", section),
        edge(readme, doc, "DOCUMENTS_DIR", model.element_id(F.col("repo_id"), folder, F.lit("DIRECTORY"), F.coalesce(F.nullif(folder, F.lit("")), F.lit(".")))),
    ]
    return documents.unionByName(heads).unionByName(sections), _edges(ends)
