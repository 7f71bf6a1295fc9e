"""Hand-made graphs with known answers, and properties that hold on any graph."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom import fixtures, queries, store
from graphloom.functions.globs import excluded, glob_regex
from graphloom.model import known, language_of_extension, narrow, widened
from graphloom.operators import neighbors, predicates
from graphloom.plans import components, similarity, traverse


@pytest.fixture(scope="module")
def make(spark):
    def build(links, elements=None, parents=None):
        rows = [(a, t, b) for a, t, b in links]
        ids = elements or sorted({x for a, _, b in rows for x in (a, b)})
        up = parents or {}
        e = spark.createDataFrame([(i, "METHOD", i.upper(), up.get(i)) for i in ids], "id string, element_type string, name string, parent_id string")
        return e, spark.createDataFrame(rows, "from_id string, edge_type string, to_id string")

    return build


def calls(*pairs):
    return [(p[0], "CALLS", p[1]) for p in pairs]


def paths(df):
    return ["".join(r["path"]) for r in df.collect()]


def test_diamond(make):
    e, g = make(calls("ab", "ac", "bd", "cd"))
    assert traverse.shortest_path(e, g, "a", "d").first()["hops"] == 2
    assert paths(traverse.all_shortest_paths(g, "a", "d")) == ["abd", "acd"]
    assert paths(traverse.all_paths(g, "a", "d")) == ["abd", "acd"] == paths(traverse.call_chain(e, g, "a", "d"))
    assert paths(traverse.all_paths(g, "a", "d", most=1)) == ["abd"]


def test_cycle(make):
    e, g = make(calls("ab", "bc", "ca"), parents={"a": "b", "b": "c", "c": "a"})
    assert paths(traverse.all_paths(g, "a", "c")) == ["abc"]
    assert paths(traverse.all_paths(g, "a", "c", direction="BOTH")) == ["ac", "abc"]
    assert {(r["depth"], r["id"]) for r in traverse.ancestors(e, e.filter("id = 'a'")).collect()} == {(1, "b"), (2, "c")}
    last = traverse.call_hierarchy(e, g, e.filter("id = 'a'"), 5).orderBy("depth").collect()[-1]
    assert last["recursive"] and "".join(last["path"]) == "abca"


def test_edges_of_a_path_keep_their_direction(make):
    _, g = make(calls("ab", "cb"))
    row = traverse.all_paths(g, "a", "c", direction="BOTH").first()
    assert [(s["from_id"], s["to_id"]) for s in row["steps"]] == [("a", "b"), ("c", "b")]


def test_similarity(make, spark):
    _, g = make(calls("x1", "x2", "x3", "y2", "y3", "y4"))
    pair = spark.createDataFrame([("x", "y"), ("x", "x"), ("p", "q")], "a string, b string")
    out = {(r["a"], r["b"]): r for r in similarity.pair_similarity(g, pair, direction="OUTGOING").collect()}
    assert (out["x", "y"]["common"], out["x", "y"]["jaccard"], out["x", "y"]["adamic_adar"]) == (2, 0.5, 0.0)
    assert out["x", "x"]["jaccard"] == 1.0 and out["p", "q"]["jaccard"] == 0.0 and out["p", "q"]["n_a"] == 0
    both = {(r["a"], r["b"]): r for r in similarity.pair_similarity(g, pair).collect()}
    assert both["x", "y"]["adamic_adar"] == pytest.approx(2 / math.log(2))


def test_candidate_pairs_of_a_hub(make, monkeypatch):
    monkeypatch.setattr(similarity, "PART", 300)
    ids = [f"n{i:04}" for i in range(1100)]
    _, g = make([(i, "EXTENDS", "hub") for i in ids] + [(i, "EXTENDS", "few") for i in [*ids[:3], "m"]] + [("m", "EXTENDS", "one")])
    got = [(r["a"], r["b"]) for r in similarity.candidate_pairs(g, ["EXTENDS"]).collect()]
    assert len(got) == len(set(got)) and set(got) == set(combinations(ids, 2)) | {("m", i) for i in ids[:3]}


def test_classes_of_a_hub_make_pairs_only_where_they_are_read(make, monkeypatch):
    """Nodes of a hub that differ by neighbours of their own are linked without a row a pair."""
    monkeypatch.setattr(similarity, "PART", 20)
    links = [(f"n{i:03}", "EXTENDS", "hub") for i in range(120)] + [(f"n{i:03}", "EXTENDS", f"own{i // 2}") for i in range(90)]
    links += [(f"n{i:03}", "EXTENDS", "few") for i in range(0, 120, 7)] + [("m", "EXTENDS", "few"), ("k", "EXTENDS", "alone")]
    _, g = make(links)
    met = []
    monkeypatch.setattr(similarity, "candidate_pairs", lambda *a, f=similarity.candidate_pairs, **k: met.append(f(*a, **k)) or met[-1])
    nodes, pairs = similarity.similarity_classes(g, ["EXTENDS"])
    near = {}
    for a, _, b in links:
        near.setdefault(a, set()).add(b)
    named = {}
    for a in sorted(near):
        named.setdefault(frozenset(near[a]), a)
    want = {(a, b): (len(near[a] & near[b]), len(near[a]), len(near[b])) for a, b in combinations(sorted(named.values()), 2) if near[a] & near[b]}
    got = pairs.collect()
    assert {(r["a"], r["b"]): (r["common"], r["n_a"], r["n_b"]) for r in got} == want and len(got) == len(want)
    assert all(r["jaccard"] == pytest.approx(r["common"] / (r["n_a"] + r["n_b"] - r["common"])) for r in got)
    assert {r["id"]: (r["class_id"], r["links"]) for r in nodes.collect()} == {a: (named[frozenset(near[a])], sum(a != b and bool(near[a] & near[b]) for b in near)) for a in near}
    assert met[0].count() * 4 < len(want)


def test_dangling(make):
    e, g = make([("a", "CALLS", "b"), ("a", "CALLS", "ghost"), ("ghost", "CALLS", "d")], elements=["a", "b", "d"])
    assert [r["id"] for r in neighbors.neighbors(e, g, ["CALLS"], ids=e.filter("id = 'a'")).collect()] == ["b"]
    assert {r["id"]: r["degree"] for r in similarity.degrees(g, direction="OUTGOING").collect()}["a"] == 2
    nodes, edges = traverse.subgraph(e, g, e.filter("id = 'a'"), 1)
    assert {r["id"] for r in nodes.collect()} == {"a", "b"} and {r["to_id"] for r in edges.collect()} == {"b", "ghost"}
    assert traverse.call_chain(e, g, "a", "d").count() == 0
    assert traverse.shortest_path(e, g, "a", "d").first()["hops"] == 2
    assert {r["id"]: r["name"] for r in neighbors.neighbors(e, g, ["CALLS"], ids=e.filter("id = 'a'"), how="left").collect()} == {"b": "B", "ghost": None}


def test_self_and_unknown(make):
    e, g = make(calls("aa"))
    assert similarity.degrees(g).first()["degree"] == 1
    assert traverse.shortest_path(e, g, "a", "a").first()["hops"] == 0 and paths(traverse.call_chain(e, g, "a", "a")) == ["a"]
    assert traverse.shortest_path(e, g, "zz", "zz").first()["hops"] == -1 and traverse.call_chain(e, g, "zz", "zz").count() == 0
    assert traverse.shortest_path(e, g, "a", "zz").first()["hops"] == -1


def test_long_chains_are_followed_to_their_end(make):
    ids = [f"n{i:02}" for i in range(68)]
    e, g = make([(a, "OVERRIDES", b) for a, b in zip(ids, ids[1:])], parents=dict(zip(ids, ids[1:])))
    start = e.filter("id = 'n00'")
    assert [r["id"] for r in traverse.ancestors(e, start).orderBy("depth").collect()] == ids[1:]
    assert [r["id"] for r in traverse.override_chain(e, g, start).orderBy("depth").collect()] == ids


def test_override_chain_stops(make):
    e, g = make([("a", "OVERRIDES", "c"), ("a", "OVERRIDES", "b"), ("b", "OVERRIDES", "a")])
    assert [r["id"] for r in traverse.override_chain(e, g, e.filter("id = 'a'")).orderBy("depth").collect()] == ["a", "b"]


def test_location(spark):
    rows = [("class", 1, 50), ("method", 10, 20), ("field", 12, 0), ("unknown", 0, 0)]
    e = spark.createDataFrame([(i, "f", a, z) for i, a, z in rows], "id string, file_path string, line_start int, line_end int")
    assert [r["id"] for r in predicates.at_location(e, "f", 12).collect()] == ["method", "class", "field"]


def test_globs(spark):
    import re

    rx = re.compile(glob_regex("**/target/**"))
    assert all(rx.match(p) for p in ("a/target/x", "target/x", "mytarget/x")) and not rx.match("a/target")
    assert re.match(glob_regex("*.class"), "A.class") and not re.match(glob_regex("*.class"), "a/A.class")
    paths_ = spark.createDataFrame([("src/a/b.java",), ("SRC/x.Java",), ("lib/x.java",)], "file_path string")
    assert paths_.filter(predicates.path_matches("src/*.java")).count() == 2
    assert spark.createDataFrame([("a/.git/x",), ("a/b.class",), ("a/b.java",)], "file_path string").filter(~excluded(F.col("file_path"))).collect()[0][0] == "a/b.java"


def test_names():
    assert known(["class", "Nonsense", None], ["CLASS"]) == ["CLASS"] and known(["x"], ["CLASS"]) == []
    assert language_of_extension("JAVA") == "JAVA" and language_of_extension("zz") == "UNKNOWN"


def test_pages_are_disjoint_and_sorted(spark, sf):
    e, _ = fixtures.graph(spark, sf)
    q = lambda o: predicates.SearchQuery(element_types=["METHOD"], sort="NAME", limit=50, offset=o)
    a, b = ([r["name"] for r in predicates.page(predicates.search(e, q(o)), q(o)).collect()] for o in (0, 50))
    assert not set(a) & set(b) and [x.lower() for x in a + b] == sorted(x.lower() for x in a + b)
    assert predicates.page(e, predicates.SearchQuery(limit=10_000)).count() == 500 and predicates.page(e, predicates.SearchQuery(limit=0)).count() == 50


def test_symmetry(spark, sf):
    _, g = fixtures.graph(spark, sf)
    both = neighbors.edge_ends(g, ["CALLS"], "BOTH").select("source_id", "other_id").distinct()
    assert both.select("other_id", "source_id").exceptAll(both).isEmpty()


def test_store(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "g"))
    e = spark.createDataFrame([("1", "r", "f1"), ("2", "r", "f2"), ("3", "q", "f1")], "id string, repo_id string, file_path string")
    g = spark.createDataFrame([("a", "1", "2", "CALLS"), ("b", "2", "3", "CALLS"), ("c", "3", "3", "USES_TYPE")], "id string, from_id string, to_id string, edge_type string")
    assert s.read("elements") is None
    s.write(elements=e, edges=g)
    new = spark.createDataFrame([("4", "r", "f1")], "id string, repo_id string, file_path string")
    s.replace_files(spark.createDataFrame([("r", "f1")], "repo_id string, file_path string"), new, g.limit(0))
    assert {r["id"] for r in s.read("elements").collect()} == {"2", "3", "4"} and {r["id"] for r in s.read("edges").collect()} == {"b", "c"}
    s.remove_repo("q")
    assert {r["id"] for r in s.read("elements").collect()} == {"2", "4"} and s.read("edges").count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3)] + [(1000, 1000 + i) for i in range(1, 300)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(frame).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100, **{1000 + i: 1000 for i in range(300)}}
    assert components.connected_components(frame.limit(0)).count() == 0


ODD_IDS = ["order:7", "order:07", "order:-7", "order:+7", "order: 7", "order:7 ", ":7", "7", "order:", "order", "", "a:b:9", "a:99999999999999999999", None]


def test_narrow_ids_come_back(spark):
    df = spark.createDataFrame([(i,) for i in ODD_IDS], "id string").select("id", *narrow("id", "k")).select("id", "k_t", "k_n", widened("k").alias("back"))
    got = df.collect()
    assert all(r.id == r.back for r in got) and len({(r.k_t, r.k_n) for r in got}) == len(ODD_IDS)
    assert {r.id: r.k_n for r in got if r.k_n is not None} == {"order:7": 7, "order:-7": -7, ":7": 7, "7": 7, "a:b:9": 9}


def test_neighbor_sets(spark):
    """Both ways, loops, missing ends and types; an edge travels once."""
    links = [(a, t, b) for i, a in enumerate(ODD_IDS) for j, b in enumerate(ODD_IDS) for k, t in enumerate(["CALLS", "IMPORTS", None, "CALLS"]) if (3 * i + 5 * j + 7 * k) % 4 == 0]
    G = spark.createDataFrame(links, "from_id string, edge_type string, to_id string").repartition(3)
    want = {}
    for direction, seen in (("OUTGOING", links), ("INCOMING", [(b, t, a) for a, t, b in links])):
        first = {}
        for a, t, b in seen:
            first.setdefault((a, b), []).append(t)
        for ends, ts in first.items():
            want.setdefault(ends, (None if None in ts else min(ts), direction))
    got = similarity.neighbor_sets(G)
    rows = got.select("source_id", "other_id", "edge_type", "direction").collect()
    assert len(rows) == len(want) and {(r[0], r[1]): (r[2], r[3]) for r in rows} == want
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_valid_edges(spark, sf):
    """Repeats over several tasks, odd ids, other columns in their places; the query reads its graph once."""
    links = [(i, a, t, b) for i, (a, b) in enumerate((a, b) for a in ODD_IDS for b in ODD_IDS) for t in ("CALLS", None)]
    G = spark.createDataFrame(links, "id int, from_id string, edge_type string, to_id string")
    got = store.valid_edges(G.unionByName(G).unionByName(G.limit(9)).repartition(5))
    assert got.columns == G.columns
    assert sorted(map(tuple, got.collect())) == sorted(r for r in links if None not in r)
    reads = lambda n: queries.QUERIES[n](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Relation ")
    assert reads("valid_edges") == reads("edge_ids")


def test_siblings_of_one_child_come_together(spark, make):
    """They repeat its id and name, so files hold them in few bytes; the asking side is the one that is held."""
    kids = [f"k{i}" for i in range(7)]
    E, G = make([("p", "CONTAINS", k) for k in kids], parents=dict.fromkeys(kids, "p"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = neighbors.siblings(E, G, E.filter("id in ('k1', 'k3', 'k5')")).select("source_id", "id").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, rows)) == sorted((a, b) for a in ("k1", "k3", "k5") for b in kids if a != b)
    assert sum(a.id != b.id for a, b in zip(rows, rows[1:])) == len(kids) - 1
