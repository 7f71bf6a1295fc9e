"""Breadth-first frontiers, subgraphs, hierarchies and paths.

Reachability runs as a driver loop of joins over a frontier that never comes to the driver; each level is written to the shared folder, so plans stay short and lost executors cost nothing. Paths are rows that carry their ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.neighbors import edge_ends
from ..store import materialize

MAX_DEPTH, DEFAULT_DEPTH, MAX_PATHS, DEFAULT_PATHS, CALL_CHAINS = 10, 6, 200, 50, 10


def _depth(depth: int) -> int:
    return DEFAULT_DEPTH if depth <= 0 else min(depth, MAX_DEPTH)


def reach(edges: DataFrame, roots: DataFrame, depth: int, types: list[str] | None = None, direction: str = "OUTGOING") -> DataFrame:
    """roots (id) -> (root, id, depth): every node within ``depth`` hops of each root, at its least depth."""
    ends = edge_ends(edges, types, direction).select(F.col("source_id").alias("id"), "other_id")
    frontier = roots.select(F.col("id").alias("root"), "id").distinct()
    levels = [frontier.withColumn("depth", F.lit(0))]
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels)
        found = frontier.join(ends, "id").select("root", F.col("other_id").alias("id")).distinct()
        frontier = materialize(found.join(seen.select("root", "id"), ["root", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(d)))
    return reduce(DataFrame.unionByName, levels)


def subgraph(elements: DataFrame, edges: DataFrame, roots: DataFrame, depth: int, types: list[str] | None = None, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` outgoing hops (those that exist), and all edges of the nodes before the last level, dangling ones too."""
    way = "INCOMING" if reverse else "OUTGOING"
    found = reach(edges, roots, depth, types, way)
    nodes = found.join(elements, "id")
    expanded = found.filter(F.col("depth") < depth).select("root", F.col("id").alias("source_id"))
    hops = edge_ends(edges, types, way).join(expanded, "source_id")
    a, b = ("other_id", "source_id") if reverse else ("source_id", "other_id")
    return nodes, hops.select("root", F.col(a).alias("from_id"), "edge_type", F.col(b).alias("to_id")).distinct()


def _jumps(pointers: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """pointers (id, to) -> (jump tables of 1, 2, 4, ... steps (id, to, low), the nodes (id, to) where cycles were cut).

    low is the least id among the steps that a jump passes, its end included: a node that is the low of its own jump lies on a cycle and is the least of it. Its pointer is cut, and the tables are made anew; each table is empty once it jumps further than any chain goes.
    """
    cut = None
    first = materialize(pointers.select("id", "to", F.col("to").alias("low")))
    while True:
        tables = [first]
        while True:
            n, own = tables[-1].agg(F.count("*"), F.count_if(F.col("low") == F.col("id"))).first()
            if not n or own:
                break
            a, b = tables[-1], tables[-1].select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
            tables.append(materialize(a.join(b, "to").select("id", F.col("_to").alias("to"), F.least("low", "_low").alias("low"))))
        if not own:
            return tables[:-1], cut
        marks = tables[-1].filter("low = id").select("id")
        found = materialize(first.join(marks, "id").select("id", "to"))
        cut = found if cut is None else cut.unionByName(found)
        first = materialize(first.join(found.select("id"), "id", "left_anti"))


def _climbed(tables: list[DataFrame], sources: DataFrame) -> DataFrame:
    """sources (id) -> (source_id, depth, id), depth 0 included: jumps of the longest table first make each depth once, by its binary digits."""
    at = sources.select(F.col("id").alias("source_id"), F.lit(0).alias("depth"), "id")
    for k in reversed(range(len(tables))):
        far = at.join(tables[k].select("id", "to"), "id").select("source_id", (F.col("depth") + (1 << k)).alias("depth"), F.col("to").alias("id"))
        at = materialize(at.unionByName(far))
    return at


def climb(pointers: DataFrame, sources: DataFrame) -> DataFrame:
    """pointers (id, to), one at most a node; sources (id) -> (source_id, depth, id): the node itself at depth 0 and all that its pointers lead to, each once.

    Pointer doubling: a chain of any depth takes as many rounds as its depth has binary digits, twice. A cycle is walked once around: it is cut at its least node, and what lies behind the cut is added, from the cycle's first node up to where the chain came in.
    """
    tables, cut = _jumps(pointers)
    at = _climbed(tables, sources)
    if cut is None:
        return at
    cut = materialize(cut)
    ring = _climbed(tables, cut.select(F.col("to").alias("id"))).join(cut.select(F.col("to").alias("source_id"), F.col("id").alias("low")), "source_id")
    ring = materialize(ring.select("low", F.col("id").alias("node"), (F.col("depth") + 1).alias("place")))
    ended = at.join(cut.select("id"), "id", "left_semi").select("source_id", F.col("id").alias("low"), F.col("depth").alias("upto"))
    entry = at.join(ended, "source_id").join(ring, F.col("node").eqNullSafe(F.col("id")) & (ring["low"] == ended["low"])).groupBy("source_id", ended["low"].alias("low"), "upto").agg(F.min("place").alias("entry"))
    return at.unionByName(entry.join(ring, "low").filter("place < entry").select("source_id", (F.col("upto") + F.col("place")).cast("int").alias("depth"), F.col("node").alias("id")))


def ancestors(elements: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(source_id, depth, id): up the parent pointers, nearest first, to a root, a missing element or a cycle."""
    up = elements.filter("parent_id is not null").select("id", F.col("parent_id").alias("to")).join(elements.select(F.col("id").alias("to")), "to", "left_semi")
    own = elements.select("id") if ids is None else elements.select("id").join(ids.select("id"), "id", "left_semi")
    return climb(up, own).filter("depth > 0")


def override_chain(elements: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(source_id, depth, id): the element itself and, again and again, the first method that it overrides."""
    first = edges.filter("edge_type = 'OVERRIDES'").join(elements.select(F.col("id").alias("to_id")), "to_id", "left_semi").groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("to"))
    return climb(first, elements.select("id").join(ids.select("id"), "id", "left_semi"))


def file_outline(elements: DataFrame, file_path: str | None = None) -> DataFrame:
    """(file_path, depth, sort_path, id): a file's elements as a tree by their parents in the file, however deep; those with a parent elsewhere, or on a cycle of parents, are left out."""
    own = elements.filter("file_path is not null")
    own = own if file_path is None else own.filter(F.col("file_path") == file_path)
    step = F.concat(F.lpad(F.col("line_start").cast("string"), 8, "0"), F.lit("|"), F.col("id"))
    own = materialize(own.select("id", "file_path", "parent_id", step.alias("step")))
    up = own.filter("parent_id is not null").select("id", "file_path", F.col("parent_id").alias("to")).join(own.select(F.col("id").alias("to"), "file_path"), ["to", "file_path"], "left_semi")
    at = _climbed(_jumps(up)[0], own)
    top = at.join(own.filter("parent_id is null").select("id"), "id", "left_semi").select("source_id", F.col("depth").alias("upto"))
    steps = at.join(own.select("id", "step"), "id").join(top, "source_id").groupBy("source_id", "upto").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "step"))).alias("s"))
    return steps.join(own.select(F.col("id").alias("source_id"), "file_path"), "source_id").select("file_path", F.col("upto").alias("depth"), F.col("s.step").alias("sort_path"), F.col("source_id").alias("id"))


def call_hierarchy(elements: DataFrame, edges: DataFrame, ids: DataFrame, depth: int = 3, up: bool = False) -> DataFrame:
    """(source_id, depth, path, id, recursive): the tree of callees (up: callers); a node that is on its own way to the root ends there."""
    ends = edge_ends(edges, ["CALLS"], "INCOMING" if up else "OUTGOING").select(F.col("source_id").alias("id"), F.col("other_id").alias("next"))
    real = elements.select(F.col("id").alias("next"))
    at = materialize(elements.select("id").join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("source_id"), "id", F.array("id").alias("path"), F.lit(False).alias("recursive")))
    out = [at.withColumn("depth", F.lit(0))]
    for d in range(1, depth + 1):
        at = materialize(at.filter("not recursive").join(ends, "id").join(real, "next", "left_semi").select("source_id", F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path"), F.array_contains("path", F.col("next")).alias("recursive")))
        if at.isEmpty():
            break
        out.append(at.withColumn("depth", F.lit(d)))
    return reduce(DataFrame.unionByName, out)


def _met(ends: DataFrame, pairs: DataFrame, depth: int, shortest: bool) -> tuple[DataFrame | None, list[DataFrame], list[DataFrame]]:
    """(meetings (a, b, n, node), nodes so many hops after a, nodes so many hops before b).

    Both ends of each pair take turns to grow by a hop; a pair has a path of n hops where, after n turns, a node is on both sides. No node is a or b again. ``shortest``: nodes come at their least distance alone, and a pair that has met grows no more.
    """
    keys, ahead, back = ["a", "b"], [materialize(pairs.withColumn("node", F.col("a")))], [materialize(pairs.withColumn("node", F.col("b")))]
    met = None
    for n in range(1, depth + 1):
        side, own, other = (ahead, "source_id", "other_id") if n % 2 else (back, "other_id", "source_id")
        at = side[-1]
        if shortest and met is not None:
            at = at.join(met.select(*keys).distinct(), keys, "left_anti")
        last = F.col("node") == F.col("b") if n % 2 else F.col("node") == F.col("a")  # a path ends there
        at = at.filter(~last).join(ends, F.col("node") == F.col(own)).filter(F.col(other) != F.col("a" if n % 2 else "b")).select(*keys, F.col(other).alias("node")).distinct()
        if shortest:
            for seen in side:
                at = at.join(seen, [*keys, "node"], "left_anti")
        side.append(materialize(at))
        found = ahead[-1].join(back[-1], [*keys, "node"]).withColumn("n", F.lit(n))
        met = materialize(found if met is None else met.unionByName(found))
        if side[-1].isEmpty():
            break
    return met, ahead, back


def _half(n: int) -> int:
    return (n + 1) // 2


def distances(edges: DataFrame, pairs: DataFrame, depth: int = DEFAULT_DEPTH, types: list[str] | None = None, direction: str = "BOTH") -> DataFrame:
    """pairs (a, b) -> (a, b, hops) of those that are within ``depth`` hops, 0 for one and the same id."""
    pairs = pairs.select("a", "b").distinct()
    ends = edge_ends(edges, types, direction).select("source_id", "other_id")
    met, _, _ = _met(ends, pairs.filter("a <> b"), _depth(depth), True)
    return met.groupBy("a", "b").agg(F.min("n").alias("hops")).unionByName(pairs.filter("a = b").withColumn("hops", F.lit(0)))


def paths(edges: DataFrame, pairs: DataFrame, depth: int = DEFAULT_DEPTH, types: list[str] | None = None, direction: str = "OUTGOING", most: int = DEFAULT_PATHS, shortest: bool = False) -> DataFrame:
    """pairs (a, b) -> (a, b, hops, path, steps): the first ``most`` simple paths of each pair, short and then least ones first; with ``shortest`` only those of its least length. steps keep each edge as it is stored, the least of several.

    Nodes that lie on no path of a length are never part of one: both ends grow to meet, and only nodes that lead to a meeting are kept, so this takes rows as there are edges and hops. Then paths grow from a over kept nodes, and of each pair and length only the least prefixes stay: as each prefix can be ended, the first paths are among their extensions. Where a path can't be ended without a node twice there may be too few; such pairs are done again with more prefixes.
    """
    depth, keys, most = _depth(depth), ["a", "b"], max(1, min(most, MAX_PATHS))
    edge = lambda a, b: F.struct(F.col(a).alias("from_id"), "edge_type", F.col(b).alias("to_id"))
    step = F.when(F.col("direction") == "OUTGOING", edge("source_id", "other_id")).otherwise(edge("other_id", "source_id"))
    ends = edge_ends(edges, types, direction).select("source_id", "other_id", step.alias("step"))
    none = F.array().cast("array<struct<from_id:string,edge_type:string,to_id:string>>")
    pairs = materialize(pairs.select("a", "b").distinct())
    same = pairs.filter("a = b").select("a", "b", F.lit(0).alias("hops"), F.array("a").alias("path"), none.alias("steps"))
    met, ahead, back = _met(ends.select("source_id", "other_id"), pairs.filter("a <> b"), depth, shortest)
    kept: dict[int, DataFrame] = {}
    for p in range(len(ahead) - 1, 0, -1):
        own = met.filter(F.expr("(n + 1) div 2") == p).select(*keys, "n", "node")
        if p + 1 in kept:
            up = kept[p + 1].join(ends, F.col("node") == F.col("other_id")).select(*keys, "n", F.col("source_id").alias("node")).distinct()
            own = own.unionByName(up.join(ahead[p], [*keys, "node"], "left_semi").select(*keys, "n", "node"))
        kept[p] = materialize(own)
    open_, done, wide = met.select(*keys, "n").distinct(), [], most if shortest else 4 * most
    longest = (len(ahead) - 1) + (len(back) - 1)
    while True:
        at = open_.select(*keys, "n", F.col("a").alias("tip"), F.array("a").alias("path"), none.alias("steps"))
        found, cut = [], []
        for p in range(1, longest + 1):
            allowed = [kept[p]] if p in kept else []
            allowed += [back[n - p].select(*keys, F.lit(n).alias("n"), "node") for n in range(p, longest + 1) if p > _half(n) and n - p < len(back)]
            went = at.join(ends, F.col("tip") == F.col("source_id")).filter(~F.array_contains("path", F.col("other_id"))).withColumnRenamed("other_id", "node")
            went = went.join(reduce(DataFrame.unionByName, allowed), [*keys, "n", "node"], "left_semi").groupBy(*keys, "n", "path", "steps", "node").agg(F.min("step").alias("step"))
            went = went.select(*keys, "n", F.col("node").alias("tip"), F.concat("path", F.array("node")).alias("path"), F.concat("steps", F.array("step")).alias("steps"))
            went = went.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "n").orderBy("path"))).filter(F.col("rank") <= wide + 1)
            went = materialize(went)
            if went.isEmpty():
                break
            cut.append(went.filter(F.col("rank") > wide).select(*keys, "n"))
            at = went.filter(F.col("rank") <= wide).drop("rank")
            found.append(at.filter(F.col("n") == p).select(*keys, F.col("n").alias("hops"), "path", "steps"))
            at = at.filter(F.col("n") > p)
        if not found:
            break
        found = materialize(reduce(DataFrame.unionByName, found))
        done.append(found)
        if shortest:
            break
        short = reduce(DataFrame.unionByName, cut).distinct()
        upto = found.groupBy(*keys, "hops").agg(F.count("*").alias("k"))
        upto = short.join(upto, [*keys], "left").groupBy(*keys, "n").agg(F.coalesce(F.sum(F.when(F.col("hops") <= F.col("n"), F.col("k"))), F.lit(0)).alias("k"))
        again = upto.filter(F.col("k") < most).select(*keys).distinct()
        open_ = materialize(open_.join(again, keys, "left_semi"))
        if open_.isEmpty():
            break
        done = [d.join(open_.select(*keys).distinct(), keys, "left_anti") for d in done]
        wide *= 16
    out = reduce(DataFrame.unionByName, [same, *done])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("hops", "path"))
    return out.withColumn("_n", rank).filter(F.col("_n") <= most).drop("_n")


def _pair(edges: DataFrame, from_id: str, to_id: str) -> DataFrame:
    return edges.sparkSession.range(1).select(F.lit(from_id).alias("a"), F.lit(to_id).alias("b"))


def all_paths(edges: DataFrame, from_id: str, to_id: str, depth: int = DEFAULT_DEPTH, types: list[str] | None = None, direction: str = "OUTGOING", most: int | None = DEFAULT_PATHS) -> DataFrame:
    """(hops, path, steps): simple paths that end when they reach the target, short and then least ones first. steps keep each edge as it is stored."""
    return paths(edges, _pair(edges, from_id, to_id), depth, types, direction, most or MAX_PATHS).select("hops", "path", "steps").orderBy("hops", "path")


def shortest_hops(edges: DataFrame, from_id: str, to_id: str, depth: int = DEFAULT_DEPTH, types: list[str] | None = None, direction: str = "BOTH") -> int:
    """Hops of the shortest path, or -1."""
    found = distances(edges, _pair(edges, from_id, to_id), depth, types, direction).first()
    return found["hops"] if found else -1


def all_shortest_paths(edges: DataFrame, from_id: str, to_id: str, depth: int = DEFAULT_DEPTH, types: list[str] | None = None, direction: str = "BOTH", most: int = DEFAULT_PATHS) -> DataFrame:
    return paths(edges, _pair(edges, from_id, to_id), depth, types, direction, most, True).select("hops", "path", "steps").orderBy("hops", "path")


def shortest_path(elements: DataFrame, edges: DataFrame, from_id: str, to_id: str, depth: int = DEFAULT_DEPTH, types: list[str] | None = None, direction: str = "BOTH") -> DataFrame:
    """One row (hops, path, steps), of least ids; hops -1 and no path if there is none. A node that doesn't exist has no path to itself."""
    spark = edges.sparkSession
    if from_id == to_id and elements.filter(F.col("id") == from_id).isEmpty():
        found = all_shortest_paths(edges, from_id, to_id, 1, types, direction).limit(0)
    else:
        found = all_shortest_paths(edges, from_id, to_id, depth, types, direction, 1)
    return spark.range(1).select().join(found, F.lit(True), "left").withColumn("hops", F.coalesce("hops", F.lit(-1)))


def call_chain(elements: DataFrame, edges: DataFrame, from_id: str, to_id: str, depth: int = DEFAULT_DEPTH) -> DataFrame:
    """The first 10 call paths, short ones first, through elements that all exist."""
    real = edges.filter("edge_type = 'CALLS'").join(elements.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    start = elements.filter(F.col("id") == from_id).select(F.lit(1).alias("_one")).limit(1)
    return all_paths(materialize(real.select("from_id", "edge_type", "to_id")), from_id, to_id, depth, ["CALLS"], "OUTGOING", CALL_CHAINS).join(start, F.lit(True), "left_semi").orderBy("hops", "path")


def path_nodes(elements: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, position, the element's columns): ids that don't resolve are left out."""
    return paths.select("path", F.posexplode("path").alias("position", "id")).join(elements, "id")
