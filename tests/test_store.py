"""The shared folder, written tables, and the store."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom import store


def test_shared_dir_without_a_setting(spark):
    """The session of the tests sets no spark.checkpoint.dir."""
    at = store.shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir() and at == store.shared_dir(spark)


def test_shared_dir_of_a_cluster(monkeypatch):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_dir(Session)
    monkeypatch.setattr(Context, "getCheckpointDir", staticmethod(lambda: "hdfs://x/y/"))
    assert store.shared_dir(Session) == "hdfs://x/y"


def test_discard_deletes_the_files(spark):
    df = store.materialize(spark.range(5))
    path = df.written_to.removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    store.discard(df)
    assert not os.path.exists(path)


def test_last_wins_has_no_ties(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, None)], "id int, v int, x string")
    for given in (rows, rows.orderBy(F.desc("x"))):
        assert {tuple(r) for r in store.last_wins(given, ["id"], "v").collect()} == {(1, 5, "b"), (2, 1, None)}


def test_versions(spark, tmp_path, monkeypatch):
    """Readers keep the version before, older folders go, and of two writers of one version the second fails and leaves nothing."""
    at = store.GraphStore(spark, str(tmp_path / "s"))
    row = lambda n: spark.createDataFrame([(str(n), "r", "FILE", "JAVA", f"name {n}", "a.java")], "id string, repo_id string, element_type string, language string, name string, file_path string")
    at.write(elements=row(1), edges=spark.createDataFrame([], "from_id string, edge_type string, to_id string"))
    first = at.read("elements")
    at.write(elements=row(2))
    assert first.first()["id"] == "1" and at.read("elements").first()["id"] == "2" and at.read("edges").count() == 0
    for n in (3, 4):
        at.write(elements=row(n))
    assert len(os.listdir(tmp_path / "s" / "elements")) == 2 and len(at._versions()) == 2
    old = at._current()
    monkeypatch.setattr(at, "_current", lambda: (old[0] - 1, old[1]))
    with pytest.raises(store.ConcurrentWrite):
        at.write(elements=row(9))
    monkeypatch.undo()
    assert at.read("elements").first()["id"] == "4" and len(os.listdir(tmp_path / "s" / "elements")) == 2


def test_postings_follow_the_elements(spark, tmp_path):
    schema = "id string, repo_id string, element_type string, language string, name string, file_path string"
    at = store.GraphStore(spark, str(tmp_path / "s"))
    edges = spark.createDataFrame([], "from_id string, edge_type string, to_id string")
    at.write(elements=spark.createDataFrame([("1", "r", "FILE", "JAVA", "red fox", "a"), ("2", "r", "FILE", "JAVA", "red hen", "b"), ("3", "q", "FILE", "JAVA", "red cat", "c")], schema), edges=edges, file_index=spark.createDataFrame([("r", "a", 1, "h"), ("q", "c", 1, "h")], "repo_id string, file_path string, last_modified long, file_hash string"))
    ids = lambda *terms: sorted(r["id"] for r in at.postings(list(terms))[0].collect())
    assert ids("red") == ["1", "2", "3"] and ids("fox", "hen") == ["1", "2"]
    files = spark.createDataFrame([("r", "a"), ("r", "b")], "repo_id string, file_path string")
    at.replace_files(files, spark.createDataFrame([("1", "r", "FILE", "JAVA", "blue fox", "a")], schema), edges, spark.createDataFrame([("r", "a", 2, "i")], "repo_id string, file_path string, last_modified long, file_hash string"))
    assert ids("red") == ["3"] and ids("blue", "hen") == ["1"] and at.postings(["red"])[1].filter("field = 'name'").first()["docs"] == 2
    assert sorted((r["file_path"], r["last_modified"]) for r in at.read("file_index").collect()) == [("a", 2), ("c", 1)]
    at.remove_repo("q")
    assert ids("red") == [] and at.read("elements").count() == 1 and at.read("file_index").count() == 1


def test_layers(spark, tmp_path, monkeypatch):
    """Changes of files, layer by layer and merged, against the same changes made to plain tables; a change writes nothing but its own rows."""
    monkeypatch.setattr(store.GraphStore, "LAYERS", 3)
    at = store.GraphStore(spark, str(tmp_path / "s"))
    dice = random.Random(3)
    element, edge = "id string, repo_id string, file_path string, name string", "from_id string, edge_type string, to_id string"
    key = lambda: (f"r{dice.randrange(2)}", f"f{dice.randrange(6)}")

    def made(files):
        e = [(f"{r}{f}-{i}", r, f, dice.choice(("red fox", "blue hen", "grey"))) for r, f in files for i in range(dice.randrange(4))]
        ids = [f"r{r}f{f}-{i}" for r in range(2) for f in range(6) for i in range(3)]
        return e, [(x[0] if dice.random() < 0.7 else dice.choice(ids), dice.choice(("CALLS", "EXTENDS")), dice.choice(ids)) for x in e for _ in range(3)]

    e, g = made([(f"r{r}", f"f{f}") for r in range(2) for f in range(6)])
    g = list(dict.fromkeys(g))
    index = {(x[1], x[2]): 0 for x in e}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    entries = "repo_id string, file_path string, last_modified long, file_hash string"
    at.write(elements=frame(e, element), edges=frame(g, edge), file_index=frame([(*k, v, "h") for k, v in index.items()], entries))
    base = at._current()[1]["elements"][0][0][0]
    for step in range(1, 6):
        files = list({key() for _ in range(2)})
        more, links = made(files)
        changed = [f for f in files if any((x[1], x[2]) == f for x in more)]
        at.replace_files(frame(files, "repo_id string, file_path string"), frame(more, element), frame(links, edge), frame([(*f, step, "h") for f in changed], entries))
        victims = {x[0] for x in e if (x[1], x[2]) in files}
        e = [x for x in e if x[0] not in victims] + more
        g = list(dict.fromkeys([x for x in g if x[0] not in victims and x[2] not in victims] + links))
        index = {k: v for k, v in index.items() if k not in files} | dict.fromkeys(changed, step)
        if step == 2:
            layers = at._current()[1]
            assert len(layers["elements"][0]) == 3 and layers["elements"][0][0][0] == base
        assert sorted(tuple(r) for r in at.read("elements").select("id", "repo_id", "file_path", "name").collect()) == sorted(e)
        assert sorted(tuple(r) for r in at.read("edges").select("from_id", "edge_type", "to_id").collect()) == sorted(g)
        assert {(r[0], r[1]): r[2] for r in at.read("file_index").select("repo_id", "file_path", "last_modified").collect()} == index
        asked = [x[0] for x in e[:2]] + ["gone", victims and next(iter(victims)) or "gone"]
        assert sorted(tuple(r) for r in at.elements_of(asked).select("id", "repo_id", "file_path", "name").collect()) == sorted(x for x in e if x[0] in asked)
        for way, ends in (("BOTH", (0, 2)), ("OUTGOING", (0,)), ("INCOMING", (2,))):
            assert sorted(tuple(r) for r in at.edges_of(asked, way).select("from_id", "edge_type", "to_id").collect()) == sorted(x for x in g if any(x[i] in asked for i in ends))
        posts, stats = at.postings(["red", "hen"])
        assert sorted(r["id"] for r in posts.collect()) == sorted(x[0] for x in e if x[3] != "grey")
        assert stats.filter("field = 'name'").first()["docs"] == len(e)
    assert all(len(v[0]) <= 3 for v in at._current()[1].values())
    at.remove_repo("r1")
    assert sorted(r["id"] for r in at.read("elements").collect()) == sorted(x[0] for x in e if x[1] == "r0")
    gone = {x[0] for x in e if x[1] == "r1"}
    assert at.read("edges").count() == sum(x[0] not in gone and x[2] not in gone for x in g)
    small = at._current()[1]
    at.compact()
    assert all(len(v[0]) <= len(small[k][0]) for k, v in at._current()[1].items()) and at.read("elements").count() == sum(x[1] == "r0" for x in e)


def rows_read(df) -> int:
    """Rows that come out of the scans of files, as Spark counts them."""
    df.collect()

    def walk(node):
        node = node.executedPlan() if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else node.plan() if "QueryStage" in node.getClass().getSimpleName() else node
        own = node.metrics().get("numOutputRows")
        if "FileSourceScan" in node.getClass().getSimpleName():
            return own.get().value()
        kids = node.children()
        return sum(walk(kids.apply(i)) for i in range(kids.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_one_id_reads_one_bucket(spark, tmp_path):
    """Of 20,000 elements and 60,000 edges a lookup, an untyped scan and a file's delete read what one bucket or file holds."""
    at = store.GraphStore(spark, str(tmp_path / "s"))
    n = spark.range(20_000)
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    elements = n.select(name(F.col("id")).alias("id"), F.lit("r").alias("repo_id"), F.concat(F.lit("f"), F.floor(F.col("id") / 10).cast("string")).alias("file_path"), F.lit("x").alias("name"))
    edges = n.select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), "id").select(name(F.col("id")).alias("from_id"), F.concat(F.lit("T"), F.col("k")).alias("edge_type"), name(F.col("id") * 7 * F.col("k") % 20_000).alias("to_id"))
    at.write(elements=elements, edges=edges, file_index=spark.createDataFrame([], "repo_id string, file_path string, last_modified long, file_hash string"))
    one, near = at.elements_of(["e77"]), at.edges_of(["e77"])
    assert one.count() == 1 and near.count() == edges.filter("from_id = 'e77' or to_id = 'e77'").count()
    read = rows_read(at.elements_of(["e77"])), rows_read(at.edges_of(["e77"])), rows_read(at.read("edges").filter("from_id = 'e77' or to_id = 'e77'"))
    assert read[0] < 20_000 / 30 and read[1] < 120_000 / 30 and read[2] == 60_000
    seen = []
    real = store.GraphStore._put
    try:
        store.GraphStore._put = lambda self, name, version, df: (seen.append((name, rows_read(df))), real(self, name, version, df))[1]
        at.replace_files(spark.createDataFrame([("r", "f7")], "repo_id string, file_path string"), elements.filter("id = 'e70'").limit(1), edges.filter("from_id = 'e70'"))
    finally:
        store.GraphStore._put = real
    assert max(k for _, k in seen) < 20_000 and at.read("elements").count() == 19_991
    assert sorted(r["to_id"] for r in at.edges_of(["e70"], "OUTGOING").collect()) == ["e1470", "e490", "e980"]
