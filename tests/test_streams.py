"""Debounce by timers, and changes of a tree of files."""

import json
import time

from pyspark.sql import functions as F

from graphloom.store import GraphStore
from graphloom.streaming import changes, files


def _store(spark, path, names):
    at = GraphStore(spark, str(path))
    row = lambda df, name: df.select(F.concat(F.lit("file:"), "file_path").alias("id"), "repo_id", F.lit("FILE").alias("element_type"), F.lit("UNKNOWN").alias("language"), F.lit(name).alias("name"), "file_path")
    none = spark.createDataFrame([], "from_id string, edge_type string, to_id string")
    at.write(elements=row(spark.createDataFrame([("r", n) for n in names], "repo_id string, file_path string"), "old"), edges=none)
    return at, lambda found: (row(found, "new"), none)


def _names(at):
    return {r["file_path"]: r["name"] for r in at.read("elements").collect()}


def _wait(check, most=60):
    until = time.time() + most
    while not check():
        assert time.time() < until, "it took too long"
        time.sleep(0.2)


def _log(folder, n, *rows):
    """Change records dropped into the log's folder at once."""
    at = lambda s: time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(1_700_000_000 + s)) + ".000Z"
    (folder / f".{n}").write_text("\n".join(json.dumps({"repo_id": "r", "file_path": f, "change_type": k, "ts": at(s)}) for f, k, s in rows))
    (folder / f".{n}").rename(folder / f"{n}.json")


def test_each_file_arrives_after_its_own_quiet_time(spark, tmp_path):
    """No later change is needed; the last kind by the changes' times wins; a batch without changes makes no version."""
    log = tmp_path / "log"
    log.mkdir()
    at, parse = _store(spark, tmp_path / "s", ["a.go", "b.go", "c.go"])
    query = changes.watch(spark, str(log), at, spark.createDataFrame([("r",)], "id string"), parse, str(tmp_path / "ck"), once=False, quiet_ms=600)
    try:
        _log(log, 1, ("a.go", "MODIFIED", 0))
        _wait(lambda: _names(at)["a.go"] == "new")
        version = at._versions()[-1]
        _log(log, 2, ("b.go", "DELETED", 540))
        _log(log, 3, ("b.go", "MODIFIED", 541), ("c.go", "DELETED", 660), ("c.go", "MODIFIED", 650))
        _wait(lambda: _names(at).get("b.go") == "new" and "c.go" not in _names(at))
        changes.wait_until_quiet(query)
        assert at._versions()[-1] <= version + 2
        version = at._versions()[-1]
        time.sleep(1.5)
        assert at._versions()[-1] == version and query.isActive
    finally:
        query.stop()
    _log(log, 4, ("a.go", "DELETED", 1800), ("zz", "DELETED", 1801))
    again = changes.watch(spark, str(log), at, spark.createDataFrame([("r",)], "id string"), parse, str(tmp_path / "ck"), once=False, quiet_ms=600)
    try:
        _wait(lambda: _names(at) == {"b.go": "new"})
    finally:
        again.stop()


def test_once_leaves_nothing_waiting(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    at, parse = _store(spark, tmp_path / "s", ["a.go", "b.go"])
    repos = spark.createDataFrame([("r",)], "id string")
    run = lambda: changes.watch(spark, str(log), at, repos, parse, str(tmp_path / "ck")).awaitTermination()
    _log(log, 1, ("a.go", "MODIFIED", 0), ("b.go", "MODIFIED", 99999), (None, "MODIFIED", 5))
    run()
    assert _names(at) == {"a.go": "new", "b.go": "new"}
    version = at._versions()[-1]
    run()
    _log(log, 2, ("x.go", "MODIFIED", 7))
    changes.watch(spark, str(log), at, spark.createDataFrame([("other",)], "id string"), parse, str(tmp_path / "ck")).awaitTermination()
    assert at._versions()[-1] == version


def test_bursts_put_the_timer_off(spark, tmp_path):
    """Changes that keep coming are one burst, with its first and last time and their number."""
    log = tmp_path / "log"
    log.mkdir()
    stream = changes.settled(changes.change_log(spark, str(log)), 2500)
    query = changes.timers(spark, stream.writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(processingTime="100 milliseconds").start)
    try:
        for n in range(4):
            _log(log, n, ("a", "MODIFIED" if n else "CREATED", n), ("a", "DELETED", n - 1))
            time.sleep(0.5)
        _wait(lambda: spark.table("bursts").count() == 1)
        row = spark.table("bursts").select("events", "change_type", F.unix_seconds("started").alias("s"), F.unix_seconds("ended").alias("e")).first()
        assert tuple(row) == (8, "MODIFIED", 1_699_999_999, 1_700_000_003)
    finally:
        query.stop()


def test_tree_of_files(spark, tmp_path):
    """Creates, changes and deletes, in new folders too; excluded folders aren't opened; a restart loses nothing and repeats nothing."""
    root = tmp_path / "src"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "pkg" / "a.go").write_text("a")
    (root / "b.go").write_text("b")
    (root / "node_modules" / "x.js").write_text("x")
    (root / "node_modules").chmod(0)

    def run(n):
        out = changes.collected(files.file_events(spark, str(root), "r", str(tmp_path / "state")), str(tmp_path / f"out{n}"), str(tmp_path / "ck"))
        return sorted((r["file_path"], r["change_type"]) for r in out.collect())

    assert run(1) == [("b.go", "CREATED"), ("pkg/a.go", "CREATED")]
    (root / "pkg" / "deep" / "er").mkdir(parents=True)
    (root / "pkg" / "deep" / "er" / "new é.go").write_text("n")
    (root / "pkg" / "a.go").write_text("changed")
    (root / "b.go").unlink()
    (root / "node_modules").chmod(0o755)
    assert run(2) == [("b.go", "DELETED"), ("pkg/a.go", "MODIFIED"), ("pkg/deep/er/new é.go", "CREATED")]
    assert run(3) == []


def test_tree_into_the_store(spark, tmp_path):
    """A running watch over a folder: what is written and deleted there is in the store soon after."""
    root = tmp_path / "src"
    root.mkdir()
    at, parse = _store(spark, tmp_path / "s", ["a.go", "b.go"])
    (root / "a.go").write_text("1")
    events = files.file_events(spark, str(root), "r", str(tmp_path / "state"))
    query = changes.watch(spark, events, at, spark.createDataFrame([("r",)], "id string"), parse, str(tmp_path / "ck"), once=False, quiet_ms=300)
    try:
        _wait(lambda: _names(at) == {"a.go": "new", "b.go": "old"})
        (root / "b.go").write_text("2")
        _wait(lambda: _names(at)["b.go"] == "new")
        (root / "a.go").unlink()
        _wait(lambda: "a.go" not in _names(at))
    finally:
        query.stop()
