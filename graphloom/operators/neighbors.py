"""Joins of elements over their edges, for one id or any table of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARENTED = ("METHOD", "FUNCTION", "CONSTRUCTOR")
CROSS_LANGUAGE = ("SHARES_TYPE", "IMPLEMENTS_PROTO", "CALLS_RPC", "REFERENCES_CLASS")


def edge_ends(edges: DataFrame, types: list[str] | None = None, direction: str = "OUTGOING") -> DataFrame:
    """(source_id, other_id, edge_type, direction): edges seen from a node; dangling ones are kept."""
    kept = edges.filter(F.col("edge_type").isin(types)) if types else edges
    out = kept.select(F.col("from_id").alias("source_id"), F.col("to_id").alias("other_id"), "edge_type", F.lit("OUTGOING").alias("direction"))
    back = kept.select(F.col("to_id").alias("source_id"), F.col("from_id").alias("other_id"), "edge_type", F.lit("INCOMING").alias("direction"))
    return {"OUTGOING": out, "INCOMING": back}.get(direction, out.unionByName(back))


def neighbors(elements: DataFrame, edges: DataFrame, types: list[str], direction: str = "OUTGOING", ids: DataFrame | None = None, kinds: list[str] | None = None, how: str = "inner") -> DataFrame:
    """(source_id, edge_type, direction, the neighbour's columns). inner drops dangling edges, left keeps them with the raw id as ``id``."""
    ends = edge_ends(edges, types, direction)
    if ids is not None:
        ends = ends.join(ids.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    out = ends.join(elements, F.col("other_id") == F.col("id"), how)
    if kinds:
        out = out.filter(F.col("element_type").isin(kinds))
    return out.withColumn("id", F.coalesce("id", "other_id")).drop("other_id") if how == "left" else out.drop("other_id")


def children(elements, edges, ids=None, kinds=None):
    return neighbors(elements, edges, ["CONTAINS"], "OUTGOING", ids, kinds)


def first_neighbor(elements: DataFrame, edges: DataFrame, edge_type: str, ids: DataFrame | None = None) -> DataFrame:
    """The neighbour of least id over outgoing edges: superclass, overridden method."""
    found = neighbors(elements, edges, [edge_type], "OUTGOING", ids)
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("id"))).filter("_n = 1").drop("_n")


def parents(elements: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """By the parent pointer, not by CONTAINS."""
    own = elements if ids is None else elements.join(ids.select("id"), "id", "left_semi")
    return own.select(F.col("id").alias("source_id"), F.col("parent_id").alias("_p")).join(elements, F.col("_p") == F.col("id")).drop("_p")


def siblings(elements: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The parent's contained elements but the element itself.

    Each child meets those who ask: these are held, as they are fewer, and the rows of one child come together, which takes few bytes where they are written."""
    own = elements if ids is None else elements.join(ids.select("id"), "id", "left_semi")
    up = own.select(F.col("id").alias("source_id"), F.col("parent_id").alias("_p")).join(elements.select(F.col("id").alias("_p")), "_p", "left_semi")
    down = children(elements, edges).withColumnRenamed("source_id", "_p")
    return down.join(up, "_p").filter("id <> source_id").drop("_p")


def callers(elements: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Callers with the id and name of the class around them."""
    above = elements.select(F.col("id").alias("_pid"), F.col("name").alias("parent_name"))
    return neighbors(elements, edges, ["CALLS"], "INCOMING", ids).join(above, F.col("parent_id") == F.col("_pid"), "left").drop("_pid")


def comments(elements: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """What documents the element (scope own), and for methods, functions and constructors what documents their parent (scope parent)."""
    own = neighbors(elements, edges, ["DOCUMENTS"], "INCOMING", ids).withColumn("scope", F.lit("own"))
    some = elements.filter(F.col("element_type").isin(*PARENTED)).select(F.col("id").alias("_m"), "parent_id")
    some = some if ids is None else some.join(ids.select(F.col("id").alias("_m")), "_m", "left_semi")
    above = own.withColumnRenamed("source_id", "_above").drop("scope", "parent_id").join(some.withColumnRenamed("parent_id", "_p"), F.col("_above") == F.col("_p"))
    return own.drop("parent_id").unionByName(above.withColumnRenamed("_m", "source_id").withColumn("scope", F.lit("parent")).drop("_above", "_p"))


def usages(elements: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Callers, users of the type and makers, each once, at the first of these that holds."""
    found = neighbors(elements, edges, ["CALLS", "USES_TYPE", "INSTANTIATES"], "INCOMING", ids)
    order = F.when(F.col("edge_type") == "CALLS", 0).when(F.col("edge_type") == "USES_TYPE", 1).otherwise(2)
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("source_id", "id").orderBy(order))).filter("_n = 1").withColumn("position", order).drop("_n")


def related(elements: DataFrame, edges: DataFrame, types: list[str] | None = None, ids: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Edges both ways with their other ends, missing ones by raw id; at most ``limit`` for each direction of an element.

    Direction, position and type go to the names as one text (``-07 CALLS`` for an incoming edge), which takes fewer bytes than columns."""
    found = edge_ends(edges, types, "BOTH")
    if ids is not None:
        found = found.join(ids.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    found = found.select("source_id", (F.col("direction") == "INCOMING").alias("_in"), "edge_type", "other_id")
    top = Window.partitionBy("source_id", "_in").orderBy("edge_type", "other_id")
    found = found.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= limit)
    wide = len(str(limit)) + 1
    place = F.concat(F.when(F.col("_in"), "-").otherwise("+"), F.lpad(F.col("_n").cast("string"), wide - 1, "0"))
    found = found.select("source_id", "other_id", F.concat(place, F.coalesce(F.concat(F.lit(" "), "edge_type"), F.lit(""))).alias("_p"))
    found = found.join(elements.select("id", "name", "element_type"), F.col("other_id") == F.col("id"), "left")
    edge_type = F.when(F.length("_p") > wide, F.expr(f"substring(_p, {wide + 2})"))
    return found.select("source_id", "other_id", edge_type.alias("edge_type"), F.when(F.col("_p").startswith("-"), "INCOMING").otherwise("OUTGOING").alias("direction"), F.substring("_p", 2, wide - 1).cast("int").alias("position"), "name", "element_type")


def related_counts(edges: DataFrame) -> DataFrame:
    return edge_ends(edges, None, "BOTH").groupBy("source_id", "direction", "edge_type").agg(F.count("*").alias("n"))


def dependencies(elements: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """DEPENDS_ON and IMPORTS, with targets that may be missing."""
    return neighbors(elements, edges, ["DEPENDS_ON", "IMPORTS"], "OUTGOING", ids, how="left")


def repo_dependencies(elements: DataFrame, edges: DataFrame, repo_id: str, limit: int = 100) -> DataFrame:
    """DEPENDS_ON of a repository's packages, modules and namespaces (the first ``limit`` by id)."""
    units = elements.filter((F.col("repo_id") == repo_id) & F.col("element_type").isin("PACKAGE", "MODULE", "NAMESPACE")).orderBy("id").limit(limit)
    return neighbors(elements, edges, ["DEPENDS_ON"], "OUTGOING", units, how="left")


def cross_language(elements: DataFrame, edges: DataFrame, ids: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """Ends in another language (``target``: in that one); without a target, ends of the same language and the same known repository are dropped."""
    found = neighbors(elements, edges, list(CROSS_LANGUAGE), "BOTH", ids)
    if target:
        return found.filter(F.col("language") == target)
    own = elements.select(F.col("id").alias("source_id"), F.col("language").alias("_l"), F.col("repo_id").alias("_r"))
    same = (F.col("language") == F.col("_l")) & F.col("repo_id").isNotNull() & F.col("repo_id").eqNullSafe(F.col("_r"))
    return found.join(own, "source_id").filter(~F.coalesce(same, F.lit(False))).drop("_l", "_r")


def parameters(elements: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(source_id, position, name): PARAMETER children by line; without any, the recorded parameter types."""
    made = children(elements, edges, ids, ["PARAMETER"]).select("source_id", F.row_number().over(Window.partitionBy("source_id").orderBy("line_start", "id")).alias("position"), "name")
    own = elements if ids is None else elements.join(ids.select("id"), "id", "left_semi")
    typed = own.select(F.col("id").alias("source_id"), F.posexplode("parameter_types").alias("position", "name")).withColumn("position", F.col("position") + 1)
    return made.unionByName(typed.join(made, "source_id", "left_anti"))


def docs(elements: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(source_id, section, ord, other_id, text): own doc comment, documenting comments, annotations, the enclosing element's doc."""
    own = elements if ids is None else elements.join(ids.select("id"), "id", "left_semi")
    first = own.filter("doc_comment is not null").select(F.col("id").alias("source_id"), F.lit("own").alias("section"), F.lit(0).alias("ord"), F.col("id").alias("other_id"), F.col("doc_comment").alias("text"))
    notes = neighbors(elements, edges, ["DOCUMENTS"], "INCOMING", ids, ["COMMENT_DOC"]).select("source_id", F.lit("comment").alias("section"), F.lit(1).alias("ord"), F.col("id").alias("other_id"), F.col("snippet").alias("text"))
    marks = neighbors(elements, edges, ["ANNOTATES"], "INCOMING", ids).select("source_id", F.lit("annotation").alias("section"), F.lit(2).alias("ord"), F.col("id").alias("other_id"), F.col("name").alias("text"))
    inner = own.filter(F.col("element_type").isin(*PARENTED, "FIELD", "PROPERTY")).select(F.col("id").alias("source_id"), F.col("parent_id").alias("_p"))
    above = inner.join(elements.filter("doc_comment is not null"), F.col("_p") == F.col("id")).select("source_id", F.lit("enclosing").alias("section"), F.lit(3).alias("ord"), F.col("id").alias("other_id"), F.col("doc_comment").alias("text"))
    return first.unionByName(notes).unionByName(marks).unionByName(above)


def config(elements: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The snippet of a configuration file, or its keys where it has none."""
    own = elements.join(ids.select("id"), "id", "left_semi").filter("element_type = 'CONFIG_FILE'")
    whole = own.filter("snippet is not null").select(F.col("id").alias("source_id"), F.lit(None).cast("string").alias("name"), "snippet")
    keys = children(elements, edges, own.filter("snippet is null"), ["CONFIG_KEY"]).select("source_id", "name", "snippet")
    return whole.unionByName(keys)


def inner_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    n = nodes.select("id").distinct()
    return edges.join(n.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(n.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
