"""Scanning trees of files into elements and edges; the registry of parsers."""

from __future__ import annotations

import hashlib
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..functions.globs import DEFAULT_EXCLUDES, excluded
from ..store import GraphStore, materialize, spread, valid_edges
from ..streaming import files as tree
from . import blocks, classfile, documents, native, rows

for _m in (sys.modules[__name__], blocks, classfile, documents, rows, model):
    cloudpickle.register_pickle_by_value(_m)


@dataclass
class Parser:
    """``parse`` takes (repo_id, path, text) and returns Rows, or raises."""

    name: str
    can_parse: Callable[[str], bool]
    parse: Callable[[str, str, str], rows.Rows]
    built_in: bool = False


def _by_language(*languages: str) -> Callable[[str], bool]:
    exts = tuple(f".{e}" for x in languages for e in model.LANGUAGES[x])
    return lambda path: path.lower().endswith(exts)


def _blocks(language: str) -> Callable[[str, str, str], rows.Rows]:
    return lambda repo, path, text: blocks.BlockParser(language, repo, path, text).parse()


@dataclass
class ParserRegistry:
    """Parsers in order; the first that can parse a file does."""

    parsers: list[Parser] = field(default_factory=list)

    def register(self, parser: Parser) -> ParserRegistry:
        self.parsers.append(parser)
        return self

    def parser_of(self, path: str) -> Parser | None:
        return next((p for p in self.parsers if p.can_parse(path)), None)

    @staticmethod
    def with_defaults() -> ParserRegistry:
        out = ParserRegistry()
        for name, langs in (("JAVA", ("JAVA",)), ("GO", ("GO",)), ("RUST", ("RUST",)), ("TYPESCRIPT", ("TYPESCRIPT", "JAVASCRIPT")), ("CPP", ("CPP",)), ("C", ("C",))):
            out.register(Parser(name, _by_language(*langs), _blocks(name), True))
        out.register(Parser("MARKDOWN", _by_language("MARKDOWN"), documents.parse_markdown, True))
        return out.register(Parser("CONFIG", _by_language("YAML", "JSON"), documents.parse_config, True))

    def in_expressions(self, name: str) -> bool:
        """Whether a built-in parser comes before all parsers of users, so that what it does in Spark expressions can take its place."""
        for p in self.parsers:
            if not p.built_in:
                return False
            if p.name == name:
                return True
        return False


_ROW = T.StructType([T.StructField("_kind", T.StringType()), T.StructField("_error", T.StringType()), *model.ELEMENTS.fields, T.StructField("from_id", T.StringType()), T.StructField("edge_type", T.StringType()), T.StructField("to_id", T.StringType())])
_NAMES = [f.name for f in _ROW]


def parse_files(files: DataFrame, registry: ParserRegistry | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files (repo_id, file_path, content string) -> elements, edges, errors (repo_id, file_path, error). A file that fails gives no rows but its error.

    JSON and Markdown go through Spark expressions, unless a parser of a user comes first; all other files through Python workers.
    """
    registry = registry or ParserRegistry.with_defaults()
    found, rest = [], files.select("repo_id", "file_path", "content")
    for name, language in (("CONFIG", "JSON"), ("MARKDOWN", "MARKDOWN")):
        mine = F.coalesce(F.lower("file_path").rlike(r"\.(" + "|".join(model.LANGUAGES[language]) + r")\z"), F.lit(False))
        if not registry.in_expressions(name) or (own := rest.filter(mine)).isEmpty():
            continue
        rest = rest.filter(~mine)
        if language == "MARKDOWN":  # of each path one row, and written once within
            elements, edges = native.parse_markdown(own)
            found.append((elements, valid_edges(edges), own.limit(0).select("repo_id", "file_path", F.lit(None).cast("string").alias("error"))))
            continue
        made = native.parse_json(own)
        found.append((materialize(made[0].dropDuplicates(["id"])), materialize(valid_edges(made[1])), materialize(made[2])))
    if found and rest.isEmpty():
        return tuple(reduce(DataFrame.unionByName, x) for x in zip(*found))

    def parse(repo: str, path: str, text: str | None) -> rows.Rows:
        parser = registry.parser_of(path)
        if parser is None:
            raise ValueError("no parser")
        return parser.parse(repo, path, text or "")

    found.append(_parsed(rest, parse))
    return tuple(reduce(DataFrame.unionByName, x) for x in zip(*found))


_CALLED = ("id", "element_type", "language", "name", "qualified_name", "line_start", "line_end", "snippet", "parent_id")


def register_udtf(spark: SparkSession, registry: ParserRegistry | None = None, name: str = "parse_source") -> None:
    """Makes the registry's parsers a table function of SQL: ``select p.* from files f, lateral parse_source(f.repo_id, f.file_path, f.content) p``.

    A row has ``kind`` element, edge or error and the columns of that kind, others null. A file that no parser takes, or that fails, gives its error alone; null content counts as empty.
    """
    parsers = registry or ParserRegistry.with_defaults()

    class ParseSource:
        def eval(self, repo_id: str, file_path: str, content: str):
            none = dict.fromkeys((*_CALLED, "from_id", "edge_type", "to_id"))
            try:
                parser = parsers.parser_of(file_path)
                if parser is None:
                    raise ValueError("no parser")
                got = parser.parse(repo_id, file_path, content or "")
            except Exception as e:  # as in parse_files
                yield ("error", f"{type(e).__name__}: {e}"[:500], *none.values())
                return
            for r in got.elements:
                yield ("element", None, *(r.get(c) for c in _CALLED), None, None, None)
            for edge in got.edges:
                yield ("edge", None, *(None for _ in _CALLED), *edge)

    own = ", ".join(f"{c} {'int' if c.startswith('line_') else 'string'}" for c in _CALLED)
    spark.udtf.register(name, F.udtf(ParseSource, returnType=f"kind string, error string, {own}, from_id string, edge_type string, to_id string"))


def parse_class_files(files: DataFrame, packages: tuple[str, ...] = (), excludes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files (repo_id, file_path, content binary) of JARs and class files -> elements, edges, errors. ``packages`` are prefixes to keep, ``excludes`` patterns of class names to leave out. Null content counts as a broken file."""
    return _parsed(files, lambda repo, path, data: classfile.parse_binary(repo, path, data or b"", packages, excludes))


#: Rows of files that a task hands on at once.
ROWS = 10_000


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.MapType):
        return pa.map_(_arrow(kind.keyType), _arrow(kind.valueType))
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[kind.simpleString()]


def _parsed(files: DataFrame, parse: Callable[[str, str, object], rows.Rows]) -> tuple[DataFrame, DataFrame, DataFrame]:
    kinds = [(f.name, _arrow(f.dataType)) for f in _ROW]

    def column(out: list[dict], name: str, kind: pa.DataType) -> pa.Array:
        values = [r.get(name) for r in out]
        return pa.array([None if v is None else list(v.items()) for v in values] if pa.types.is_map(kind) else values, kind)

    def batch(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(out, n, k) for n, k in kinds], [n for n, _ in kinds])

    def run(batches):
        out = []
        for b in batches:
            for repo, path, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                if len(out) >= ROWS:
                    yield batch(out)
                    out = []
                failed = {"_kind": "error", "repo_id": repo, "file_path": path, "id": ""}
                try:
                    got = parse(repo, path, content)
                except Exception as e:  # one bad file must not stop the scan: its error is a row
                    out.append(failed | {"_error": f"{type(e).__name__}: {e}"[:500]})
                    continue
                out += [failed | {"_error": e} for e in getattr(got, "errors", ())]
                out += [r | {"_kind": "element"} for r in got.elements]
                out += [{"_kind": "edge", "id": "_".join(k), "from_id": k[0], "edge_type": k[1], "to_id": k[2]} for k in got.edges]
        if out:
            yield batch(out)

    made = materialize(spread(files.select("repo_id", "file_path", "content")).mapInArrow(run, _ROW))
    elements = made.filter("_kind = 'element'").select(*model.ELEMENTS.names).dropDuplicates(["id"])
    edges = made.filter("_kind = 'edge'").select("id", "from_id", "to_id", "edge_type", F.lit(None).cast("map<string,string>").alias("metadata"))
    return elements, valid_edges(edges), made.filter("_kind = 'error'").select("repo_id", "file_path", F.col("_error").alias("error"))


def _found(files: DataFrame, root: str, repo_id: str) -> DataFrame:
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace("path", rf"^.*?{_quoted(base)}/", "")
    return files.select(F.lit(repo_id).alias("repo_id"), rel.alias("file_path"), F.unix_millis("modificationTime").alias("last_modified"), F.sha2("content", 256).alias("file_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


#: Folders that one task opens before it hands on those that it has found.
FOLDERS = 1_000


def walk(spark: SparkSession, root: str, globs=DEFAULT_EXCLUDES) -> DataFrame:
    """(file_path, modified in ms, size) of the files below a root that aren't excluded: folders are a frontier that the executors list, and excluded ones are never opened. A tree of up to FOLDERS folders takes one round."""
    base, out, found = root, tree.compiled(globs), []
    at = spark.createDataFrame([("",)], "path string")

    def run(batches):
        fs, top = tree.located(base)
        for b in batches:
            files, left = tree.listed(fs, top, b.column(0).to_pylist(), out, FOLDERS)
            rows = [(p, False, n // 1_000_000, size) for p, n, size in files] + [(p, True, None, None) for p in left]
            kinds = {"path": pa.string(), "folder": pa.bool_(), "modified": pa.int64(), "size": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))

    while True:
        rows = materialize(at.mapInArrow(run, "path string, folder boolean, modified bigint, size bigint"))
        found.append(rows.filter("not folder").select(F.col("path").alias("file_path"), "modified", "size"))
        at = rows.filter("folder").select("path")
        if at.isEmpty():
            return reduce(DataFrame.unionByName, found)
        at = at.repartition(spark.sparkContext.defaultParallelism)


def _contents(spark: SparkSession, root: str, repo_id: str, files: DataFrame) -> DataFrame:
    """The listed files with their hashes and texts, each read where its row is; one that has gone meanwhile has no row."""
    base = root

    def run(batches):
        fs, top = tree.located(base)
        for b in batches:
            for path, modified in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with fs.open_input_stream(f"{top}/{path}", compression=None) as f:
                        raw = f.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([modified], pa.int64()), pa.array([hashlib.sha256(raw).hexdigest()]), pa.array([raw.decode("utf-8", "replace")])], ["file_path", "last_modified", "file_hash", "content"])

    read = files.select("file_path", "modified").mapInArrow(run, "file_path string, last_modified bigint, file_hash string, content string")
    return read.select(F.lit(repo_id).alias("repo_id"), "file_path", "last_modified", "file_hash", "content")


def scan_repo(spark: SparkSession, root: str, repo_id: str, globs=DEFAULT_EXCLUDES, extensions: list[str] | None = None) -> DataFrame:
    """(repo_id, file_path, last_modified, file_hash, content) of the files below a root that aren't excluded by their path from it or their absolute path; only files of the ``extensions`` are opened, if there are any, and excluded folders are not.

    Where only Spark's own file systems reach the root it lists the whole tree and filters.
    """
    try:
        tree.located(root)
    except (ValueError, NotImplementedError, OSError):
        return _scan_through_spark(spark, root, repo_id, globs, extensions)
    files = walk(spark, root, globs)
    if extensions:
        files = files.filter(F.lower(F.regexp_extract("file_path", r"\.([^./]*)\z", 1)).isin([e.lower() for e in extensions]))
    return _contents(spark, root, repo_id, files.repartition(spark.sparkContext.defaultParallelism))


def _scan_through_spark(spark: SparkSession, root: str, repo_id: str, globs=DEFAULT_EXCLUDES, extensions: list[str] | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        either = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else "\\" + c if c in "*?[]{}\\" else c for c in e)
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(map(either, extensions)) + "}")
    out = _found(reader.load(root), root, repo_id)
    return out.filter(~excluded(F.col("file_path"), globs, root.split("://")[-1].removeprefix("file:"))) if globs else out


def read_files(spark: SparkSession, root: str, repo_id: str, paths: list[str]) -> DataFrame:
    """As ``scan_repo``, of the named files alone."""
    return _found(spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{p}" for p in paths]), root, repo_id)


#: Changed files up to which each is opened by name; beyond, the tree is walked.
NAMED = 10_000


def changed_files(spark: SparkSession, root: str, repo_id: str, files: DataFrame, globs=DEFAULT_EXCLUDES) -> DataFrame:
    """As ``scan_repo``, of the files (repo_id, file_path) that a parser may read and that are still there: only these are opened."""
    known = ParserRegistry.with_defaults()
    rows = files.filter(F.col("repo_id") == repo_id).filter(~excluded(F.col("file_path"), globs)).select("file_path").distinct().limit(NAMED + 1).collect()
    if len(rows) > NAMED:
        return scan_repo(spark, root, repo_id, globs).join(files, ["repo_id", "file_path"], "left_semi")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [r[0] for r in rows if known.parser_of(r[0])]
    there = [n for n in names if fs.exists(path(f"{root.rstrip('/')}/{n}"))]
    if not there:
        return spark.createDataFrame([], "repo_id string, file_path string, last_modified bigint, file_hash string, content string")
    return read_files(spark, root, repo_id, there)


def scan_class_files(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """(repo_id, file_path, content binary) of the JARs and class files below a root, as ``parse_class_files`` takes them; a JAR is a repository of its own, named by its file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jar,class}").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(F.when(F.lower("path").endswith(".jar"), name).otherwise(repo_id).alias("repo_id"), F.regexp_replace("path", "^file:/*", "/").alias("file_path"), "content")


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def index_repo(spark: SparkSession, store: GraphStore, root: str, repo_id: str, name: str | None = None, globs=DEFAULT_EXCLUDES, registry: ParserRegistry | None = None) -> DataFrame:
    """Scan, parse and replace the repository's rows; returns its row of repos and ``parse_errors``, the number of files that didn't parse.

    A root that isn't there is refused and leaves no row; a scan that fails leaves the status ERROR. ``file_count`` is of all files read.
    """
    registry = registry or ParserRegistry.with_defaults()
    exts = [e for p in ("JAVA", "GO", "RUST", "TYPESCRIPT", "JAVASCRIPT", "CPP", "C", "MARKDOWN", "YAML", "JSON") for e in model.LANGUAGES[p]]
    state = lambda status: spark.createDataFrame([(repo_id, name or repo_id, root, [], status, None, 0, 0, None)], model.REPOS)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"no folder {root}")
    store.set_repo(state("INDEXING"))
    try:
        files = scan_repo(spark, root, repo_id, globs, exts)
        elements, edges, errors = parse_files(files, registry)
        store.replace_repo(repo_id, elements, edges, files.drop("content"))
    except Exception:
        store.set_repo(state("ERROR"))
        raise
    now = elements.agg(F.count("*").cast("int").alias("element_count"), F.collect_set("language").alias("languages"))
    read, failed = files.count(), errors.select("repo_id", "file_path").distinct().count()
    row = now.select(F.lit(repo_id).alias("id"), F.lit(name or repo_id).alias("name"), F.lit(root).alias("root_path"), "languages", F.lit("READY").alias("status"), F.current_timestamp().alias("last_indexed"), "element_count", F.lit(read).alias("file_count"), F.lit(None).cast("string").alias("description"))
    row = materialize(row)
    store.set_repo(row)
    return row.withColumn("parse_errors", F.lit(failed))


def browse(path: str) -> list[dict]:
    """Sub-directories of a folder for a chooser, hidden ones left out; on the driver."""
    at = os.path.abspath(path)
    found = [{"name": d.name, "path": d.path, "isGitRepo": os.path.isdir(os.path.join(d.path, ".git"))} for d in sorted(os.scandir(at), key=lambda d: d.name) if d.is_dir() and not d.name.startswith(".")]
    return ([{"name": "..", "path": os.path.dirname(at), "isGitRepo": False}] if os.path.dirname(at) != at else []) + found


def load_config(path: str) -> dict:
    """A YAML file as a mapping; anything that fails gives the defaults."""
    defaults = {"repos": [], "indexerThreads": 4, "watchDebounceMs": 500, "exclude": list(DEFAULT_EXCLUDES)}
    try:
        import yaml

        with open(path) as f:
            return defaults | (yaml.safe_load(f) or {})
    except Exception:  # a missing or broken file means the defaults
        return defaults
