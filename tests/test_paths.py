"""Pointer doubling and pruned paths against plain walks."""

import random
from collections import Counter
from itertools import pairwise

import pytest

from graphloom.plans import traverse

EDGES = "from_id string, edge_type string, to_id string"


def plain_climb(to, source):
    out, at = [source], to.get(source)
    while at is not None and at not in out:
        out.append(at)
        at = to.get(at)
    return out


def climbed(spark, to, sources):
    pointers = spark.createDataFrame(list(to.items()), "id string, to string")
    got = {}
    for r in traverse.climb(pointers, spark.createDataFrame([(s,) for s in sources], "id string")).collect():
        got.setdefault(r["source_id"], []).append((r["depth"], r["id"]))
    return {s: [i for _, i in sorted(v)] if sorted(d for d, _ in v) == list(range(len(v))) else v for s, v in got.items()}


def test_climb_a_deep_chain(spark, monkeypatch):
    """80 levels in seven tables; only the asked sources come out."""
    made = []
    monkeypatch.setattr(traverse, "_jumps", lambda p, f=traverse._jumps: made.append(f(p)) or made[-1])
    to = {f"n{i}": f"n{i + 1}" for i in range(80)}
    assert climbed(spark, to, ["n0", "n79", "n80"]) == {s: plain_climb(to, s) for s in ("n0", "n79", "n80")}
    assert len(made[0][0]) == 7 and made[0][1] is None


@pytest.mark.parametrize("seed", range(3))
def test_climb_cycles(spark, seed):
    """Tails into cycles of several lengths, a pointer to oneself, chains that end: each node once, in order."""
    dice = random.Random(seed)
    names = [f"n{i:02d}" for i in range(60)]
    dice.shuffle(names)
    to = {a: dice.choice(names[max(0, i - 6) : i + 2]) for i, a in enumerate(names) if dice.random() < 0.93}
    to |= {"x1": "x1", "y": "x1", "z": "gone"}
    sources = [*names, "x1", "y", "z"]
    assert climbed(spark, to, sources) == {s: plain_climb(to, s) for s in sources}


def test_ancestors_and_outline(spark):
    """Missing parents end a chain; parents in another file, and cycles, leave the outline."""
    rows = [("a", None, "f", 1), ("b", "a", "f", 2), ("c", "b", "f", 3), ("d", "gone", "f", 4), ("e", "a", "g", 5), ("p", "q", "f", 6), ("q", "p", "f", 7), ("r", "c", "f", 4)]
    e = spark.createDataFrame(rows, "id string, parent_id string, file_path string, line_start int")
    assert Counter(tuple(r) for r in traverse.ancestors(e).collect()) == Counter([("b", 1, "a"), ("c", 1, "b"), ("c", 2, "a"), ("e", 1, "a"), ("p", 1, "q"), ("q", 1, "p"), ("r", 1, "c"), ("r", 2, "b"), ("r", 3, "a")])
    assert {r["source_id"] for r in traverse.ancestors(e, spark.createDataFrame([("c",)], "id string")).collect()} == {"c"}
    got = {r["id"]: (r["depth"], [s[9:] for s in r["sort_path"]]) for r in traverse.file_outline(e).collect()}
    assert got == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "c": (2, ["a", "b", "c"]), "r": (3, ["a", "b", "c", "r"])}
    assert traverse.ancestors(e.limit(0)).count() == 0 and traverse.file_outline(e, "none").count() == 0


def plain_paths(edges, a, b, depth, both=False):
    near = {}
    for f, _, t in edges:
        near.setdefault(f, set()).add(t)
        if both:
            near.setdefault(t, set()).add(f)
    out = []

    def go(path):
        if path[-1] == b:
            out.append((len(path) - 1, path))
        elif len(path) <= depth:
            for t in near.get(path[-1], ()):
                if t not in path:
                    go([*path, t])

    go([a])
    return sorted(out)


@pytest.mark.parametrize("direction", ["OUTGOING", "BOTH"])
@pytest.mark.parametrize("depth", [1, 2, 5])
def test_paths_of_many_pairs(spark, direction, depth):
    """All, the first few and the shortest paths of each pair, with cycles, loops, several edges between two nodes and pairs without a path."""
    dice = random.Random(7)
    names = [chr(97 + i) for i in range(12)]
    edges = [(dice.choice(names), dice.choice(("CALLS", "IMPORTS")), dice.choice(names)) for _ in range(30)]
    pairs = list({(dice.choice(names), dice.choice(names)) for _ in range(14)}) + [("a", "a"), ("a", "nowhere")]
    g, p = spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, "a string, b string")
    want = {q: plain_paths(edges, *q, depth, direction == "BOTH") for q in pairs}

    def rows(df):
        out = {q: [] for q in pairs}
        for r in df.collect():
            out[r["a"], r["b"]].append((r["hops"], r["path"]))
            for (x, y), s in zip(pairwise(r["path"]), r["steps"]):
                assert tuple(s) in edges and {x, y} == {s["from_id"], s["to_id"]} and (direction == "BOTH" or x == s["from_id"])
            assert len(r["steps"]) == r["hops"]
        return {q: sorted(v) for q, v in out.items()}

    assert rows(traverse.paths(g, p, depth, None, direction, 200)) == want
    assert rows(traverse.paths(g, p, depth, None, direction, 2)) == {q: v[:2] for q, v in want.items()}
    least = {q: [x for x in v if x[0] == v[0][0]] for q, v in want.items()}
    assert rows(traverse.paths(g, p, depth, None, direction, 3, shortest=True)) == {q: v[:3] for q, v in least.items()}
    assert {(r["a"], r["b"]): r["hops"] for r in traverse.distances(g, p, depth, None, direction).collect()} == {q: v[0][0] for q, v in want.items() if v}


def test_paths_that_cannot_end_are_done_again(spark):
    """The least prefixes lead back through a node that the path holds already, so more are needed."""
    edges = [("s", "CALLS", "m"), ("m", "CALLS", "t"), *(("s", "CALLS", f"a{i:02d}") for i in range(40)), *((f"a{i:02d}", "CALLS", "b") for i in range(40)), ("b", "CALLS", "c"), *(("c", "CALLS", f"a{i:02d}") for i in range(40)), ("a00", "CALLS", "t")]
    found = traverse.paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame([("s", "t")], "a string, b string"), 6, None, "OUTGOING", 5)
    assert [(r["hops"], r["path"]) for r in found.orderBy("hops", "path").collect()] == plain_paths(edges, "s", "t", 6)[:5]


def test_two_hundred_of_a_billion_paths(spark):
    """Nine layers of ten nodes: 10**9 paths of ten hops; the first 200 come out, and no step makes more rows than edges and prefixes ask."""
    layer = lambda n: ["s"] if n == 0 else ["t"] if n == 10 else [f"l{n}x{i}" for i in range(10)]
    edges = [(a, "CALLS", b) for n in range(10) for a in layer(n) for b in layer(n + 1)] + [(f"l1x{i}", "CALLS", f"dead{i}y{j}") for i in range(10) for j in range(50)]
    g = spark.createDataFrame(edges, EDGES)
    made = []
    real, traverse.materialize = traverse.materialize, lambda df: (lambda out: (made.append(out.count()), out)[1])(real(df))
    try:
        for shortest in (True, False):
            found = traverse.paths(g, spark.createDataFrame([("s", "t")], "a string, b string"), 10, None, "OUTGOING", 200, shortest)
            got = [r["path"] for r in found.orderBy("path").collect()]
            assert len(got) == 200 and got[0] == ["s", *(f"l{n}x0" for n in range(1, 10)), "t"] and got[199] == ["s", *(f"l{n}x0" for n in range(1, 7)), "l7x1", "l8x9", "l9x9", "t"]
    finally:
        traverse.materialize = real
    assert max(made) <= 4 * 200 + 1
