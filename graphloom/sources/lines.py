"""Declarations found line by line, for files that no grammar reads: Spark expressions alone, no Python workers.

The first pattern that a line matches makes its element; the block ends where braces balance. A file's braces and declarations meet in one task, its text is shuffled once, for the snippets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..store import valid_edges
from .rows import SNIPPET_LINES

# The patterns of each language in their order: element type, pattern, group of the name.
PATTERNS = {
    "GO": (
        ("PACKAGE", r"^package\s+(\w+)", 1),
        ("FUNCTION", r"^func\s+(?:\(\s*\w+\s+\*?(\w+)\s*\)\s+)?(\w+)\s*\(([^)]*)\)(.*)", 2),
        ("STRUCT", r"^type\s+(\w+)\s+(struct|interface)\s*\{", 1),
    ),
    "RUST": (
        ("FUNCTION", r"^\s*(pub\s+)?fn\s+(\w+)\s*(?:<[^>]*>)?\s*\(", 2),
        ("STRUCT", r"^\s*(pub\s+)?struct\s+(\w+)", 2),
        ("ENUM", r"^\s*(pub\s+)?enum\s+(\w+)", 2),
        ("INTERFACE", r"^\s*(pub\s+)?trait\s+(\w+)", 2),
        ("CLASS", r"^\s*impl\s+(?:<[^>]*>\s+)?(?:(\w+)\s+for\s+)?(\w+)", 2),
    ),
    "TYPESCRIPT": (
        ("CLASS", r"^\s*(export\s+)?(abstract\s+)?class\s+(\w+)", 3),
        ("INTERFACE", r"^\s*(export\s+)?interface\s+(\w+)", 2),
        ("FUNCTION", r"^\s*(export\s+)?(async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\(", 3),
        ("FUNCTION", r"^\s*(export\s+)?(const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*=>", 3),
        ("ALIAS", r"^\s*(export\s+)?type\s+(\w+)\s*[=<]", 2),
        ("ENUM", r"^\s*(export\s+)?enum\s+(\w+)", 2),
    ),
    "CPP": (
        ("CLASS", r"^\s*(?:template\s*<[^>]*>\s+)?class\s+(\w+)", 1),
        ("STRUCT", r"^\s*(?:typedef\s+)?struct\s+(\w+)?\s*\{", 1),
        ("ENUM", r"^\s*(?:typedef\s+)?enum\s+(\w+)?\s*\{", 1),
        ("FUNCTION", r"^\s*(?:static\s+|extern\s+|inline\s+)*(?:\w+[\s*]+)+(\w+)\s*\([^;]*\)\s*\{", 1),
    ),
}
NOT_FUNCTIONS = ("if", "for", "while", "switch", "catch", "return")
# Languages that share the patterns of another; C has no classes.
PATTERNS |= {"JAVASCRIPT": PATTERNS["TYPESCRIPT"], "C": PATTERNS["CPP"][1:]}

_KEYS = ("repo_id", "file_path")


def _language(path: Column) -> Column:
    ends = {x: r"(?i)\.(" + "|".join(e.replace("+", r"\+") for e in model.LANGUAGES[x]) + ")$" for x in PATTERNS}
    return F.coalesce(*(F.when(path.rlike(p), x) for x, p in ends.items()))


def _declared(language: str, line: Column) -> Column:
    """What the line declares: type, name, qualified name (Go: without the package), visibility, receiver; null where nothing is, or what is has no name."""
    if language == "GO":
        line = F.regexp_replace(line, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    out = None
    for kind, pattern, group in reversed(PATTERNS[language]):
        part = lambda n, p=pattern: F.regexp_extract(line, p, n)
        kinds, name, own, public, receiver = F.lit(kind), part(group), part(group), F.lit(None).cast("string"), F.lit("")
        if language == "GO" and kind == "FUNCTION":
            receiver = part(1)
            kinds, own = F.when(receiver != "", "METHOD").otherwise(kind), F.concat_ws(".", F.nullif(receiver, F.lit("")), name)
        elif language == "GO" and kind == "STRUCT":
            kinds = F.when(part(2) == "interface", "INTERFACE").otherwise(kind)
        elif language == "RUST" and kind == "FUNCTION":
            public = F.when(part(1) != "", "public").otherwise("private")
        elif language == "RUST" and kind == "CLASS":
            name = F.concat_ws(" for ", F.nullif(part(1), F.lit("")), name)
            own = F.concat(F.lit("impl "), name)
        found = F.struct(kinds.alias("kind"), name.alias("name"), own.alias("own"), public.alias("visibility"), F.nullif(receiver, F.lit("")).alias("receiver"))
        named = (name != "") & ~((kinds == "FUNCTION") & name.isin(*NOT_FUNCTIONS)) if language in ("C", "CPP") else name != ""
        out = F.when(line.rlike(pattern), F.when(named, found)) if out is None else F.when(line.rlike(pattern), F.when(named, found)).otherwise(out)
    return out


def _lines() -> Column:
    return F.split("content", r"\r\n|\n|\r")


def declarations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (repo_id, file_path, content), one row a file -> elements, edges (a Go package contains what follows it).

    Of declarations with one id in a file the last stays. Files of other languages, null and empty ones give no rows; a block that never closes, or none at all, ends on its first line.
    """
    line = F.col("line")
    lines = files.select(*_KEYS, _language(F.col("file_path")).alias("language"), F.posexplode(_lines()).alias("at", "line")).filter("language is not null")
    head = F.coalesce(*(F.when(F.col("language") == x, _declared(x, line)) for x in PATTERNS))
    braces = F.transform(F.regexp_extract_all(line, F.lit("[{}]"), F.lit(0)), lambda c, i: F.struct((i + 1).alias("k"), F.when(c == "{", 1).otherwise(-1).alias("step")))
    seen = lines.filter(line.rlike("[{}]") | head.isNotNull()).select(*_KEYS, "language", "at", head.alias("head"), braces.alias("braces"))
    declared = F.when(F.col("head").isNotNull(), F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("step")))).otherwise(F.array())
    events = seen.select(*_KEYS, "language", "at", "head", F.inline(F.concat(declared, "braces"))).withColumn("head", F.when(F.col("k") == 0, F.col("head")))

    # Running windows only: what follows is read in descending order, so that no frame is scanned twice.
    down = Window.partitionBy(*_KEYS).orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*_KEYS).orderBy(F.desc("at"), F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    package = F.when((F.col("language") == "GO") & (F.col("head.kind") == "PACKAGE"), F.col("head.name"))
    placed = events.select("*", F.sum("step").over(down).alias("depth"), F.last(package, True).over(down).alias("package"), F.last(F.when(F.col("step") == 1, F.struct("at", "k")), True).over(up).alias("opens"))
    # A declaration waits at its first opening brace for the depth it began with.
    is_head = F.col("head").isNotNull()
    placed = placed.withColumn("from", F.when(is_head & F.col("opens").isNotNull(), F.col("opens")).otherwise(F.struct("at", "k")))
    level = Window.partitionBy(*_KEYS, "depth").orderBy(F.desc("from.at"), F.desc("from.k"), is_head).rowsBetween(Window.unboundedPreceding, 0)
    closes = F.last(F.when(~is_head, F.col("at")), True).over(level)
    single = F.col("head.kind").isin("PACKAGE", "ALIAS")
    ended = placed.withColumn("end", F.when(single | F.col("opens").isNull(), F.col("at")).otherwise(F.coalesce(closes, "at"))).filter(is_head)
    named = ended.select(
        *_KEYS, "language", "at", "end", "package", single.alias("single"), F.when(F.col("head.kind") == "ALIAS", "CLASS").otherwise(F.col("head.kind")).alias("element_type"), F.col("head.name").alias("name"),
        F.when(F.col("head.kind") == "PACKAGE", F.col("head.own")).otherwise(F.concat_ws(".", "package", "head.own")).alias("qualified_name"), F.col("head.visibility").alias("visibility"), F.col("head.receiver").alias("receiver"),
    )
    last = Window.partitionBy(*_KEYS, "element_type", "qualified_name").orderBy(F.desc("at"))
    each = named.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    grouped = each.groupBy(*_KEYS).agg(F.collect_list(F.struct(*(c for c in each.columns if c not in _KEYS))).alias("found"))

    content = files.select(*_KEYS, "content")
    cut = content.join(grouped, list(_KEYS)).select(*_KEYS, _lines().alias("lines"), "found")
    rows = cut.select(*_KEYS, "lines", F.explode("found").alias("d")).select(*_KEYS, "d.*", F.array_join(F.slice("lines", F.col("d.at") + 1, F.least(F.col("d.end") - F.col("d.at") + 1, F.lit(SNIPPET_LINES))), "\n").alias("snippet"))
    made = {
        "id": model.element_id(*map(F.col, ("repo_id", "file_path", "element_type", "qualified_name"))), "line_start": F.col("at") + 1, "line_end": F.col("end") + 1,
        "snippet": F.when(F.col("single"), F.regexp_replace("snippet", r"^[\x00-\x20]+|[\x00-\x20]+$", "")).otherwise(F.col("snippet")), "metadata": F.when(F.col("receiver").isNotNull(), F.create_map(F.lit("receiverType"), "receiver")),
    }
    have = set(rows.columns)
    elements = rows.select(*((made[f.name] if f.name in made else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in model.ELEMENTS))
    ends = each.filter(F.col("package").isNotNull() & (F.col("element_type") != "PACKAGE")).select(
        model.element_id(F.col("repo_id"), F.col("file_path"), F.lit("PACKAGE"), F.col("package")).alias("from_id"), F.lit("CONTAINS").alias("edge_type"), made["id"].alias("to_id")
    )
    edges = ends.select(model.edge_id(*map(F.col, ("from_id", "edge_type", "to_id"))).alias("id"), "from_id", "to_id", "edge_type", F.lit(None).cast("map<string,string>").alias("metadata"))
    return elements, valid_edges(edges)
