"""Tables of the graph: elements, edges, repositories, indexed files; enumerations and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names that stored rows and requests use.
ELEMENT_TYPES = (
    "REPO", "DIRECTORY", "FILE",
    "PACKAGE", "NAMESPACE", "MODULE",
    "CLASS", "INTERFACE", "ENUM", "STRUCT", "TRAIT", "PROTOCOL", "TYPE_ALIAS",
    "CONSTRUCTOR", "METHOD", "FUNCTION", "FIELD", "PROPERTY", "ENUM_CONSTANT", "STATIC_INITIALIZER",
    "PARAMETER", "LOCAL_VARIABLE", "LAMBDA",
    "IMPORT", "USE_DECLARATION",
    "COMMENT_LINE", "COMMENT_BLOCK", "COMMENT_DOC", "ANNOTATION", "ATTRIBUTE", "DECORATOR",
    "MARKDOWN_DOCUMENT", "MARKDOWN_HEADING", "MARKDOWN_SECTION", "CONFIG_FILE", "CONFIG_KEY",
    "CALL_SITE", "TYPE_REFERENCE", "UNKNOWN",
)
EDGE_TYPES = (
    "CONTAINS",
    "EXTENDS", "IMPLEMENTS", "OVERRIDES", "MIXES_IN",
    "CALLS", "INSTANTIATES",
    "USES_TYPE", "IMPORTS", "DEPENDS_ON",
    "DOCUMENTS", "ANNOTATES",
    "IMPLEMENTS_PROTO", "CALLS_RPC", "SHARES_TYPE",
    "SECTION_OF", "DOCUMENTS_DIR",
    "CONFIGURES", "REFERENCES_CLASS",
    "PRECEDES", "DEFINED_IN",
)
DIRECTIONS = ("OUTGOING", "INCOMING", "BOTH")
STATUSES = ("PENDING", "INDEXING", "READY", "ERROR", "WATCHING")
LANGUAGES = {
    "JAVA": ["java"], "GO": ["go"], "RUST": ["rs"], "TYPESCRIPT": ["ts", "tsx"], "JAVASCRIPT": ["js", "jsx", "mjs", "cjs"], "C": ["c", "h"], "CPP": ["cpp", "cc", "cxx", "hpp", "hxx", "h++"],
    "MARKDOWN": ["md", "markdown"], "YAML": ["yaml", "yml"], "JSON": ["json"], "UNKNOWN": [],
}
NOT_SOURCE = ("MARKDOWN", "YAML", "JSON", "UNKNOWN")

_s = T.StringType()
ELEMENTS = T.StructType(
    [T.StructField(n, _s, n != "id") for n in ("id", "repo_id", "element_type", "language", "name", "qualified_name", "signature", "file_path")]
    + [T.StructField(n, T.IntegerType()) for n in ("line_start", "line_end", "col_start", "col_end")]
    + [T.StructField(n, _s) for n in ("snippet", "doc_comment", "return_type")]
    + [T.StructField("parameter_types", T.ArrayType(_s)), T.StructField("visibility", _s), T.StructField("modifiers", T.ArrayType(_s)), T.StructField("parent_id", _s), T.StructField("metadata", T.MapType(_s, _s))]
)
EDGES = T.StructType([*(T.StructField(n, _s) for n in ("id", "from_id", "to_id", "edge_type")), T.StructField("metadata", T.MapType(_s, _s))])
REPOS = T.StructType([*(T.StructField(n, _s) for n in ("id", "name", "root_path")), T.StructField("languages", T.ArrayType(_s)), T.StructField("status", _s), T.StructField("last_indexed", T.TimestampType()), T.StructField("element_count", T.IntegerType()), T.StructField("file_count", T.IntegerType()), T.StructField("description", _s)])
FILE_INDEX = T.StructType([T.StructField("repo_id", _s), T.StructField("file_path", _s), T.StructField("last_modified", T.LongType()), T.StructField("file_hash", _s)])
CHANGES = T.StructType([T.StructField("repo_id", _s), T.StructField("file_path", _s), T.StructField("change_type", _s), T.StructField("ts", T.TimestampType())])


def element_id(repo_id: Column, file_path: Column, element_type: Column, qualified_name: Column) -> Column:
    """The first 32 hex digits of SHA-256 over the four parts; a missing part reads "null"."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in (repo_id, file_path, element_type, qualified_name)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def edge_id(from_id: Column, edge_type: Column, to_id: Column) -> Column:
    return F.concat_ws("_", from_id, edge_type, to_id)


def narrow(id: Column | str, name: str) -> list[Column]:
    """An id as a text and the number after its last colon (``name``_t, ``name``_n), for shuffles: a number takes fewer bytes than its digits. Where the number's digits aren't those of the id all of it stays text, so ``widened`` gives back the same id."""
    id = F.col(id) if isinstance(id, str) else id
    tail = F.substring_index(id, ":", -1)
    number = tail.try_cast("bigint")
    whole = F.coalesce(number.cast("string") == tail, F.lit(False))
    return [F.when(whole, F.left(id, F.length(id) - F.length(tail))).otherwise(id).alias(f"{name}_t"), F.when(whole, number).alias(f"{name}_n")]


def widened(name: str) -> Column:
    return F.concat(f"{name}_t", F.coalesce(F.col(f"{name}_n").cast("string"), F.lit("")))


def language_of_extension(extension: str) -> str:
    return next((k for k, v in LANGUAGES.items() if extension.lower() in v), "UNKNOWN")


def language_of_file(path: Column) -> Column:
    """By the text after the last dot; none: UNKNOWN."""
    ext = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    out = F.lit("UNKNOWN")
    for name, exts in LANGUAGES.items():
        if exts:
            out = F.when(ext.isin(exts), name).otherwise(out)
    return out


def known(values: list[str] | None, of: list[str] | tuple[str, ...]) -> list[str]:
    """Enumeration names of a request, upper-cased; unknown ones are dropped, and none left means no filter."""
    return [v.upper() for v in values or [] if v and v.upper() in of]
