"""Every operation by name: a registry of tools over a graph, each returning a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .model import EDGE_TYPES, ELEMENTS, known
from .operators import aggregates, neighbors, predicates
from .operators.predicates import SearchQuery
from .plans import similarity, traverse
from .sources import scan
from .store import GraphStore
from .streaming import changes
from .streaming import files as tree

REQUIRED = object()


class Graph:
    """What tools work on: elements and edges, and where there are any repos, changes and the store that they come from.

    With a store the tables are read anew after each write. Columns of the model that a table of elements lacks read as null.
    """

    def __init__(self, elements: DataFrame | None = None, edges: DataFrame | None = None, repos: DataFrame | None = None, log: DataFrame | None = None, store: GraphStore | None = None):
        self.store, self.log, self.watching = store, log, {}
        self._tables = {"elements": elements, "edges": edges, "repos": repos}

    def _table(self, name: str) -> DataFrame:
        found = self.store.read(name) if self.store else self._tables[name]
        if found is None:
            raise LookupError(f"the graph has no {name}")
        return found

    @property
    def elements(self) -> DataFrame:
        found = self._table("elements")
        return found.withColumns({f.name: F.lit(None).cast(f.dataType) for f in ELEMENTS if f.name not in found.columns})

    edges = property(lambda self: self._table("edges"))
    repos = property(lambda self: self._table("repos"))

    @cached_property
    def spark(self) -> SparkSession:
        return self.store.spark if self.store else self.elements.sparkSession

    def scores(self, query: str) -> DataFrame:
        """(id, score) of a text, from the postings that the store keeps, or made on the spot."""
        kept = self.store and self.store.postings(text.query_terms(query))
        return text.bm25(*kept[:1], query, kept[1]) if kept else text.ranked(self.elements, query)

    def element(self, id: str) -> DataFrame:
        """One element, from its bucket where there is a store."""
        found = self.store.elements_of([id]) if self.store else self.elements.filter(F.col("id") == id)
        return found.withColumns({f.name: F.lit(None).cast(f.dataType) for f in ELEMENTS if f.name not in found.columns})

    def edges_of(self, id: str | None, direction: str = "BOTH") -> DataFrame:
        """All edges, or where there is a store and one id those that touch it, from its bucket."""
        return self.store.edges_of([id], direction) if self.store and id is not None else self.edges

    def ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")


@dataclass(frozen=True)
class Tool:
    """``parameters``: name -> default, REQUIRED where there is none."""

    name: str
    description: str
    run: Callable[..., DataFrame]
    parameters: dict[str, object] = field(default_factory=dict)

    def schema(self) -> dict:
        """The parameters as a JSON schema."""
        kind = lambda v: {bool: "boolean", int: "integer", list: "array"}.get(type(v), "string")
        return {"type": "object", "properties": {k: {"type": kind(v)} for k, v in self.parameters.items()}, "required": [k for k, v in self.parameters.items() if v is REQUIRED]}


class ToolRegistry:
    """Tools by name; one registered later takes the place of an earlier one of its name."""

    def __init__(self):
        self._tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> ToolRegistry:
        self._tools[tool.name] = tool
        return self

    def names(self) -> list[str]:
        return sorted(self._tools)

    def get(self, name: str) -> Tool | None:
        return self._tools.get(name)

    def execute(self, graph: Graph, name: str, /, **args) -> DataFrame:
        """Unknown tools (LookupError), unknown arguments and missing required ones (ValueError) are refused."""
        tool = self._tools.get(name)
        if tool is None:
            raise LookupError(f"no tool {name}")
        if odd := sorted(args.keys() - tool.parameters.keys()):
            raise ValueError(f"{name} takes no {', '.join(odd)}")
        given = tool.parameters | {k: v for k, v in args.items() if v is not None}
        if missing := [k for k, v in given.items() if v is REQUIRED or v == "" and tool.parameters[k] is REQUIRED]:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        return tool.run(graph, **given)

    @staticmethod
    def with_defaults() -> ToolRegistry:
        out = ToolRegistry()
        for tool in _TOOLS.values():
            out.register(tool)
        return out


_TOOLS: dict[str, Tool] = {}


def _tool(**parameters):
    """Registers a function (graph, **parameters); its docstring is the description."""

    def keep(fn):
        _TOOLS[fn.__name__] = Tool(fn.__name__, fn.__doc__, fn, parameters)
        return fn

    return keep


def _by_element(name: str, description: str, of: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], order=("line_start", "id"), limit: int = 0, near: str | None = None) -> None:
    """A tool that asks one element, or any table of elements under ``ids``; ``limit`` holds for one element. ``near``: of one element it needs the edges in that direction alone."""

    def run(graph: Graph, id: str | None, ids: DataFrame | None, limit: int) -> DataFrame:
        if id is None and ids is None:
            raise ValueError(f"{name} needs id or ids")
        edges = graph.edges_of(id, near) if near and ids is None else graph.edges
        found = of(graph.elements, edges, graph.ids(id) if ids is None else ids).orderBy(*(["source_id"] if ids is not None else []), *order)
        return found.limit(limit) if limit > 0 and ids is None else found

    _TOOLS[name] = Tool(name, description, run, {"id": None, "ids": None, "limit": limit})


def _neighbors(name: str, description: str, edge_type: str, direction: str, limit: int = 0) -> None:
    _by_element(name, description, lambda e, g, ids: neighbors.neighbors(e, g, [edge_type], direction, ids), limit=limit, near=direction)


def _children(name: str, description: str, *kinds: str) -> None:
    _by_element(name, description, lambda e, g, ids: neighbors.children(e, g, ids, list(kinds)), near="OUTGOING")


_by_element("get_parent", "The element that the parent pointer names", lambda e, g, ids: neighbors.parents(e, ids))
_by_element("get_siblings", "What else the parent contains", neighbors.siblings)
_by_element("get_ancestors", "Up the parent pointers, nearest first", lambda e, g, ids: traverse.ancestors(e, ids).join(e, "id"), order=("depth",))
_children("get_methods", "Methods, functions and constructors inside", "METHOD", "FUNCTION", "CONSTRUCTOR")
_children("get_fields", "Fields and properties inside", "FIELD", "PROPERTY")
_children("get_constructors", "Constructors inside", "CONSTRUCTOR")
_children("get_imports", "Imports of a file", "IMPORT")
_by_element("get_superclass", "The type that this one extends", lambda e, g, ids: neighbors.first_neighbor(e, g, "EXTENDS", ids), near="OUTGOING")
_neighbors("get_interfaces", "Types that this one implements", "IMPLEMENTS", "OUTGOING")
_neighbors("get_subclasses", "Types that extend this one", "EXTENDS", "INCOMING")
_neighbors("get_implementors", "Types that implement this one", "IMPLEMENTS", "INCOMING")
_by_element("get_overrides", "The method that this one overrides", lambda e, g, ids: neighbors.first_neighbor(e, g, "OVERRIDES", ids), near="OUTGOING")
_neighbors("get_overriders", "Methods that override this one", "OVERRIDES", "INCOMING")
_by_element("get_override_chain", "The method and those it overrides, step by step", lambda e, g, ids: traverse.override_chain(e, g, ids).join(e, "id"), order=("depth",))
_by_element("get_callers", "What calls the element, with the class around each caller", neighbors.callers, limit=20, near="INCOMING")
_neighbors("get_callees", "What the element calls", "CALLS", "OUTGOING", limit=20)
_by_element("get_comments", "Comments on the element and, for methods, on what holds it", neighbors.comments)
_neighbors("get_annotations", "Annotations of the element", "ANNOTATES", "INCOMING")
_by_element("get_parameters", "Parameters, or else the recorded parameter types", neighbors.parameters, order=("position",))
_by_element("get_docs", "Own doc comment, comments, annotations and the enclosing element's doc", neighbors.docs, order=("ord", "other_id"))
_neighbors("get_imported_by", "What imports the element", "IMPORTS", "INCOMING")
_by_element("get_usages", "Callers, users of the type and makers, each once", neighbors.usages, order=("position", "id"), limit=50, near="INCOMING")
_by_element("get_config", "A configuration file's text, or its keys", neighbors.config, order=("name",))


@_tool(query="", repo_ids=[], element_types=[], languages=[], file_pattern=None, sort="RELEVANCE", ascending=True, limit=predicates.DEFAULT_PAGE, offset=0)
def search_code(graph: Graph, query: str, **rest) -> DataFrame:
    """Full-text search with filters, a sort and a page"""
    q = SearchQuery(text=query, **rest)
    if query and query.strip() and not text.query_terms(query):  # nothing has a text without a word
        return predicates.page(graph.elements.limit(0), q)
    scores = graph.scores(query) if text.query_terms(query) else None
    return predicates.page(predicates.search(graph.elements, q, scores), q)


@_tool(name=REQUIRED, exact_prefix=True, element_types=[], languages=[], repo_ids=[], limit=predicates.DEFAULT_PAGE, offset=0)
def search_by_name(graph: Graph, name: str, exact_prefix: bool, **rest) -> DataFrame:
    """Elements whose qualified name starts so, or whose texts hold the name"""
    if not exact_prefix:
        return search_code(graph, query=name, **rest)
    q = SearchQuery(name_prefix=name, **rest)
    return predicates.page(predicates.search(graph.elements, q), q)


@_tool(id=REQUIRED)
def get_element(graph: Graph, id: str) -> DataFrame:
    """One element and its rendering"""
    found = graph.element(id)
    return found.withColumn("rendered", text.full_render(found.columns))


@_tool(id=REQUIRED, context=0)
def get_snippet(graph: Graph, id: str, context: int) -> DataFrame:
    """The lines of an element's snippet, numbered; with ``context`` read anew from its file, with so many lines around"""
    found = graph.element(id)
    row = found.select("repo_id", "file_path", "line_start").first() if context > 0 and graph.store else None
    root = graph.repos.filter(F.col("id") == row["repo_id"]).select("root_path").first() if row and row["file_path"] else None
    if root is None:
        return text.numbered_lines(found).orderBy("line")
    files = scan.read_files(graph.spark, root["root_path"], row["repo_id"], [row["file_path"]])
    again = found.join(text.snippet_from_source(found, files, context).withColumnRenamed("text", "_text"), "id")
    return text.numbered_lines(again.withColumn("snippet", F.col("_text")).withColumn("line_start", F.greatest(F.lit(1), F.col("line_start") - context))).orderBy("line")


@_tool(file_path=REQUIRED, repo_id=None)
def get_file_outline(graph: Graph, file_path: str, repo_id: str | None) -> DataFrame:
    """A file's elements as a tree"""
    own = graph.elements if repo_id is None else graph.elements.filter(F.col("repo_id") == repo_id)
    return traverse.file_outline(own, file_path).join(own.withColumn("summary", text.summary_line(own.columns)).select("id", "summary"), "id").orderBy("sort_path")


@_tool(file_path=REQUIRED, line=REQUIRED, repo_id=None)
def get_elements_at_location(graph: Graph, file_path: str, line: int, repo_id: str | None) -> DataFrame:
    """Elements over a line of a file, innermost first"""
    own = graph.elements if repo_id is None else graph.elements.filter(F.col("repo_id") == repo_id)
    return predicates.at_location(own, file_path, int(line))


@_tool(id=REQUIRED, element_type=None)
def get_children(graph: Graph, id: str, element_type: str | None) -> DataFrame:
    """What the element contains, of all types or one"""
    return neighbors.children(graph.elements, graph.edges_of(id, "OUTGOING"), graph.ids(id), [element_type.upper()] if element_type else None).orderBy("line_start", "id")


@_tool(from_id=REQUIRED, to_id=REQUIRED, max_depth=traverse.DEFAULT_DEPTH)
def get_call_chain(graph: Graph, from_id: str, to_id: str, max_depth: int) -> DataFrame:
    """The first call paths between two elements"""
    return traverse.call_chain(graph.elements, graph.edges, from_id, to_id, max_depth)


@_tool(id=REQUIRED, direction="callees", depth=3)
def get_call_hierarchy(graph: Graph, id: str, direction: str, depth: int) -> DataFrame:
    """The tree of callees or callers"""
    return traverse.call_hierarchy(graph.elements, graph.edges, graph.ids(id), depth, direction.lower() == "callers").orderBy("path")


_PATH = {"from_id": REQUIRED, "to_id": REQUIRED, "max_depth": traverse.DEFAULT_DEPTH, "edge_types": [], "direction": "BOTH"}


@_tool(**_PATH)
def find_shortest_path(graph: Graph, from_id: str, to_id: str, max_depth: int, edge_types: list[str], direction: str) -> DataFrame:
    """One shortest path; hops -1 if there is none"""
    return traverse.shortest_path(graph.elements, graph.edges, from_id, to_id, max_depth, known(edge_types, EDGE_TYPES), direction.upper())


@_tool(**_PATH, max_paths=traverse.DEFAULT_PATHS)
def find_all_shortest_paths(graph: Graph, from_id: str, to_id: str, max_depth: int, edge_types: list[str], direction: str, max_paths: int) -> DataFrame:
    """All shortest paths"""
    return traverse.all_shortest_paths(graph.edges, from_id, to_id, max_depth, known(edge_types, EDGE_TYPES), direction.upper(), max_paths)


@_tool(**_PATH, max_paths=traverse.DEFAULT_PATHS)
def find_all_paths(graph: Graph, from_id: str, to_id: str, max_depth: int, edge_types: list[str], direction: str, max_paths: int) -> DataFrame:
    """All simple paths, short ones first"""
    return traverse.all_paths(graph.edges, from_id, to_id, max_depth, known(edge_types, EDGE_TYPES), direction.upper(), max_paths)


@_tool(id_a=REQUIRED, id_b=REQUIRED, edge_types=[], direction="BOTH")
def get_similarity(graph: Graph, id_a: str, id_b: str, edge_types: list[str], direction: str) -> DataFrame:
    """Common neighbours, Jaccard and Adamic-Adar of two elements, which may be missing"""
    pair, types, way = graph.spark.createDataFrame([(id_a, id_b)], "a string, b string"), known(edge_types, EDGE_TYPES), direction.upper()
    shared = similarity.common_neighbors(graph.elements, graph.edges, pair, types, way).groupBy("a", "b").agg(F.sort_array(F.collect_set("id")).alias("shared"))
    return similarity.pair_similarity(graph.edges, pair, types, way).join(shared, ["a", "b"], "left")


@_tool(repo_id=REQUIRED)
def get_readme(graph: Graph, repo_id: str) -> DataFrame:
    """A repository's readme, else its first markdown document"""
    return predicates.readme(graph.elements, repo_id)


@_tool(id=None, repo_id=None, limit=100)
def get_dependencies(graph: Graph, id: str | None, repo_id: str | None, limit: int) -> DataFrame:
    """Dependencies and imports of an element, or dependencies of a repository's packages"""
    if id is None and repo_id is None:
        raise ValueError("get_dependencies needs id or repo_id")
    found = neighbors.dependencies(graph.elements, graph.edges_of(id, "OUTGOING"), graph.ids(id)) if id else neighbors.repo_dependencies(graph.elements, graph.edges, repo_id, limit)
    return found.orderBy("source_id", "edge_type", "id")


@_tool()
def list_repos(graph: Graph) -> DataFrame:
    """Repositories by name"""
    return graph.repos.orderBy("name", "id")


@_tool(repo_id=REQUIRED, max_depth=3)
def get_repo_structure(graph: Graph, repo_id: str, max_depth: int) -> DataFrame:
    """Directories and files by path"""
    return predicates.repo_structure(graph.elements, repo_id, max_depth)


@_tool(repo_id=None, limit=200)
def list_configs(graph: Graph, repo_id: str | None, limit: int) -> DataFrame:
    """Configuration files"""
    return aggregates.config_files(graph.elements, repo_id, limit)


@_tool(id=REQUIRED, edge_types=[], limit=20)
def get_related(graph: Graph, id: str, edge_types: list[str], limit: int) -> DataFrame:
    """Edges both ways with their other ends"""
    return neighbors.related(graph.elements, graph.edges_of(id), known(edge_types, EDGE_TYPES), graph.ids(id), limit).orderBy(F.desc("direction"), "position")


@_tool(id=REQUIRED, target_language=None)
def find_cross_language(graph: Graph, id: str, target_language: str | None) -> DataFrame:
    """Ends of links into other languages"""
    return neighbors.cross_language(graph.elements, graph.edges_of(id), graph.ids(id), target_language and target_language.upper()).orderBy("edge_type", "id")


@_tool(repo_id=REQUIRED, root_path=REQUIRED, name=None)
def add_repo(graph: Graph, repo_id: str, root_path: str, name: str | None) -> DataFrame:
    """Index a repository into the store; its row"""
    return scan.index_repo(graph.spark, graph.store, root_path, repo_id, name)


@_tool(repo_id=REQUIRED)
def reindex_repo(graph: Graph, repo_id: str) -> DataFrame:
    """Index a known repository again; its row"""
    known_as = graph.repos.filter(F.col("id") == repo_id).select("root_path", "name").first()
    if known_as is None:
        raise LookupError(f"no repository {repo_id}")
    return scan.index_repo(graph.spark, graph.store, known_as["root_path"], repo_id, known_as["name"])


@_tool(repo_id=REQUIRED)
def remove_repo(graph: Graph, repo_id: str) -> DataFrame:
    """Take a repository out of the store; what is left"""
    graph.store.remove_repo(repo_id)
    return list_repos(graph)


@_tool(repo_id=REQUIRED, checkpoint=REQUIRED, log=None, once=False, quiet_ms=changes.DEBOUNCE_MS)
def start_watching(graph: Graph, repo_id: str, checkpoint: str, log: str | None, once: bool, quiet_ms: int) -> DataFrame:
    """Flush changes below a repository's root, or those of a change log, into the store as they come; the status. A repository that is watched goes on as it is"""
    own = graph.repos.filter(F.col("id") == repo_id)
    root = own.select("root_path").first()
    if root is None:
        raise LookupError(f"no repository {repo_id}")
    running = graph.watching.get(repo_id)
    if running is None or not running.isActive:

        def parse(files: DataFrame) -> tuple[DataFrame, ...]:
            found = scan.changed_files(graph.spark, root["root_path"], repo_id, files)
            return *scan.parse_files(found)[:2], found.drop("content")

        source = log if log is not None else tree.file_events(graph.spark, root["root_path"], repo_id, f"{checkpoint.rstrip('/')}/listings")
        graph.watching[repo_id] = changes.watch(graph.spark, source, graph.store, own, parse, checkpoint, scan.DEFAULT_EXCLUDES, once, quiet_ms)
    return get_watch_status(graph)


@_tool(repo_id=REQUIRED)
def stop_watching(graph: Graph, repo_id: str) -> DataFrame:
    """Stop the watch of a repository, if there is one; the status"""
    if running := graph.watching.pop(repo_id, None):
        changes.stop_between(running)
    return get_watch_status(graph)


@_tool()
def get_watch_status(graph: Graph) -> DataFrame:
    """Watched repositories and whether their query runs"""
    return graph.spark.createDataFrame([(k, q.isActive) for k, q in sorted(graph.watching.items())], "repo_id string, active boolean")


@_tool(limit=changes.RING, repo_id=None)
def list_recent_changes(graph: Graph, limit: int, repo_id: str | None) -> DataFrame:
    """Changes, newest first"""
    if graph.log is None:
        raise LookupError("the graph has no change log")
    return changes.recent_changes(graph.log, limit, repo_id)
