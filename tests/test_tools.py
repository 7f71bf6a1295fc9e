"""Every tool by name, on the smallest tables and on a store."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import fixtures
from graphloom.store import GraphStore
from graphloom.tools import REQUIRED, Graph, Tool, ToolRegistry

ASKED = {"id": "customer:7", "from_id": "customer:1", "to_id": "customer:2", "id_a": "customer:1", "id_b": "customer:2", "repo_id": "r1", "file_path": "x", "line": 1, "name": "asia.", "max_depth": 2, "query": "the and"}
STORED = {"add_repo", "reindex_repo", "remove_repo", "start_watching", "stop_watching", "list_repos", "list_recent_changes"}


@pytest.fixture(scope="module")
def graph(spark, sf):
    return Graph(*fixtures.graph(spark, sf))


@pytest.mark.parametrize("name", [n for n in ToolRegistry.with_defaults().names() if n not in STORED])
def test_runs(graph, name):
    tools = ToolRegistry.with_defaults()
    args = {k: v for k, v in ASKED.items() if k in tools.get(name).parameters and not (name == "search_by_name" and k == "query")}
    assert tools.execute(graph, name, **args).columns


def test_answers(graph, spark):
    tools = ToolRegistry.with_defaults()
    ask = lambda tool, **args: tools.execute(graph, tool, **args).collect()
    assert ask("get_element", id="customer:7")[0]["rendered"].startswith("id: customer:7")
    calls = graph.edges.filter("edge_type = 'CALLS'").join(graph.elements.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    some = calls.select("from_id").distinct().orderBy("from_id").limit(3)
    want = {(r["from_id"], r["to_id"]) for r in calls.join(some, "from_id").collect()}
    assert {(r["source_id"], r["id"]) for r in ask("get_callees", ids=some.withColumnRenamed("from_id", "id"))} == want
    first = min(want)[0]
    assert {r["id"] for r in ask("get_callees", id=first, limit=1000)} == {b for a, b in want if a == first}
    assert len(ask("get_callees", id=first, limit=1)) == 1
    assert ask("find_shortest_path", from_id=first, to_id=min(want)[1], edge_types=["calls"])[0]["hops"] == 1
    found = ask("search_code", query="the and", limit=5)
    assert 0 < len(found) <= 5 and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    assert all(r["qualified_name"].lower().startswith("asia.") for r in ask("search_by_name", name="Asia."))


def test_registry(graph):
    tools = ToolRegistry.with_defaults()
    for args, error in (({}, ValueError), ({"id": ""}, ValueError), ({"id": "x", "odd": 1}, ValueError)):
        with pytest.raises(error):
            tools.execute(graph, "get_element", **args)
    with pytest.raises(LookupError):
        tools.execute(graph, "nothing")
    with pytest.raises(ValueError):
        tools.execute(graph, "get_callers")
    schema = tools.get("find_all_paths").schema()
    assert schema["required"] == ["from_id", "to_id"] and schema["properties"]["max_paths"] == {"type": "integer"}
    tools.register(Tool("get_element", "own", lambda g, id: g.ids(id), {"id": REQUIRED}))
    assert tools.execute(graph, "get_element", id="q").first()["id"] == "q"


def test_store_tools(spark, tmp_path):
    src, log = tmp_path / "src", tmp_path / "log"
    src.mkdir()
    log.mkdir()
    (src / "A.java").write_text("package p;\npublic class A {\n  void one() {}\n}\n")
    graph, tools = Graph(store=GraphStore(spark, str(tmp_path / "store"))), ToolRegistry.with_defaults()
    assert tools.execute(graph, "add_repo", repo_id="r", root_path=str(src)).first()["status"] == "READY"
    assert [r["id"] for r in tools.execute(graph, "list_repos").collect()] == ["r"]
    (src / "A.java").write_text("package p;\npublic class A {\n  void two() {}\n}\n")
    assert tools.execute(graph, "reindex_repo", repo_id="r").count() == 1
    assert "two" in {r["name"] for r in tools.execute(graph, "search_by_name", name="p.").collect()}
    lines = [("A.java", "DELETED", "2023-11-14T22:13:20.000Z"), ("zz", "MODIFIED", "2023-11-16T22:13:20.000Z")]
    (log / "1.json").write_text("\n".join(json.dumps({"repo_id": "r", "file_path": f, "change_type": k, "ts": t}) for f, k, t in lines))
    assert tools.execute(graph, "start_watching", repo_id="r", log=str(log), checkpoint=str(tmp_path / "ck"), once=True).first()["repo_id"] == "r"
    graph.watching["r"].awaitTermination()
    assert "two" not in {r["name"] for r in graph.elements.collect()}
    graph.log = spark.read.schema("repo_id string, file_path string, change_type string, ts timestamp").json(str(log))
    assert [r["file_path"] for r in tools.execute(graph, "list_recent_changes").collect()] == ["zz", "A.java"]
    assert tools.execute(graph, "stop_watching", repo_id="r").count() == 0
    assert tools.execute(graph, "remove_repo", repo_id="r").count() == 0
    with pytest.raises(LookupError):
        tools.execute(graph, "reindex_repo", repo_id="r")
