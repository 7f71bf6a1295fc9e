"""Every query against the SQL that stands beside it."""

import glob
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import fixtures, queries
from graphloom.functions import text
from graphloom.operators import neighbors


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {p.rsplit('/', 1)[1][:-8]} as select * from '{p}'")
    return c


def rows(cols, data):
    show = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_oracle(spark, sf, con, name):
    got, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["element_by_id", "edge_scan", "element_ids", "tokens", "constructors", "search_sorted_name"])
def test_graph_is_not_written(spark, sf, monkeypatch, name):
    monkeypatch.setattr(fixtures, "shared_dir", lambda spark: pytest.fail("wrote the graph for one pass over it"))
    monkeypatch.setattr(fixtures, "_LOADED", {})
    assert queries.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["delete_file", "delete_repo"])
def test_deleted_ids_are_found_once(spark, sf, name):
    """Not again in each branch of the graph's unions, which made plans of thousands of joins."""
    assert queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Join ") < 200


def test_edges_by_keys(spark, sf):
    tables = fixtures.tables(spark, sf)
    want = spark.sql(fixtures.EDGES, **{k: v for k, v in tables.items() if f"{{{k}}}" in fixtures.EDGES})
    got = fixtures.edges(spark, sf)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert fixtures._by_keys(fixtures.EDGES).count("(select distinct") == 6 and "select distinct 'order:'" not in fixtures._by_keys(fixtures.EDGES)


def test_stream_debounce_gives_every_burst(spark, sf):
    """As many as the batch query has, not one a path."""
    want = queries.QUERIES["debounce_sessions"](spark, sf).filter("cast(substring(file_path, 2, 9) as bigint) % 3 <> 0").select("file_path", "started", "ended", "events")
    got = queries.QUERIES["stream_debounce"](spark, sf).select("file_path", "started", "ended", "events")
    assert got.count() == want.count() > got.select("file_path").distinct().count() and got.exceptAll(want).isEmpty()


def shuffled_rows(df):
    """Rows that the shuffles of ``df`` wrote, by the metrics of the plan that ran."""
    df.collect()

    def walk(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if plan.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
            return walk(plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
        children = plan.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_terms_are_counted_where_they_are_read(spark, sf):
    """Each term of each text used to travel to be counted."""
    made = text.postings(fixtures.elements(spark, sf), ("snippet",)).count()
    assert shuffled_rows(queries.QUERIES["tokens"](spark, sf)) < made / 2


def test_a_search_moves_no_rows_of_other_terms(spark, sf):
    """Each field of each element used to travel for the means of lengths."""
    made = text.postings(fixtures.elements(spark, sf)).select("field", "id").distinct().count()
    assert shuffled_rows(queries.QUERIES["search_scored_filters"](spark, sf)) < made * 0.7


def test_counts_of_shared_ids(spark):
    """Rows of one id count as their postings do: one for each term and length."""
    rows = [("a", "red hen red", "x"), ("a", "red fox red", "x y"), ("a", "red", None), ("b", "Red hen", ""), (None, "red", "x"), (None, "red", "x"), ("c", None, "hen's x"), ("d", "--", "red")]
    elements = spark.createDataFrame(rows, "id string, snippet string, name string")
    posts = text.postings(elements)
    same = lambda got, want: sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert same(text.term_counts(elements), posts.groupBy("field", "term").count())
    lengths = posts.select("field", "id", "dl").distinct()
    assert same(text.text_stats(elements), lengths.groupBy("field").agg({"id": "max", "dl": "sum"}).drop("max(id)").join(lengths.groupBy("field").count(), "field").select("field", "count", "sum(dl)"))
    for asked in ("red", "Red hen", "x", "hen's", "none", ""):
        terms = text.query_terms(asked)
        assert same(text.postings(elements, terms=terms), posts.filter(posts.term.isin(terms)))
        assert same(text.ranked(elements, asked).selectExpr("id", "round(score, 9)"), text.bm25(posts, asked).selectExpr("id", "round(score, 9)"))


def test_related_rows_travel_narrow(spark, sf):
    """Direction, position and type were columns of their own on the way to the names."""
    left = queries.QUERIES["related"](spark, sf)._jdf.queryExecution().optimizedPlan()
    while left.nodeName() != "Join":
        left = left.children().apply(0)
    assert left.children().apply(0).output().size() == 3


@pytest.mark.parametrize("limit", [1, 2, 10, 200])
def test_related_of_odd_edges(spark, limit):
    """Null ends and types, types with spaces, empty ones and loops come out as they went in."""
    edges = [("a", "CALLS", f"n{i}") for i in range(12)] + [("a", "", "b"), ("a", "two words", "b"), ("a", " x ", "b"), ("a", None, "b"), (None, "CALLS", "a"), ("a", "CALLS", None), ("a", "LOOP", "a")]
    elements = spark.createDataFrame([("a", "A", "CLASS"), ("b", None, "CLASS"), ("n3", "N", "METHOD")], "id string, name string, element_type string")
    got = neighbors.related(elements, spark.createDataFrame(edges, "from_id string, edge_type string, to_id string"), limit=limit)
    names, want = {"a": ("A", "CLASS"), "b": (None, "CLASS"), "n3": ("N", "METHOD")}, []
    for way, ends in (("OUTGOING", [(f, t, k) for f, k, t in edges]), ("INCOMING", [(t, f, k) for f, k, t in edges])):
        for source in {e[0] for e in ends}:
            first = sorted(((k, o) for s, o, k in ends if s == source), key=lambda x: tuple((v is not None, v or "") for v in x))[:limit]
            want += [(source, way, k, o, n, *names.get(o, (None, None))) for n, (k, o) in enumerate(first, 1)]
    assert Counter(map(tuple, got.select("source_id", "direction", "edge_type", "other_id", "position", "name", "element_type").collect())) == Counter(want)


def test_pairs_are_dealt_by_their_second_key(spark, sf):
    """All edges that lead to a part or supplier come from one task, which cuts them to the first few."""
    made = fixtures.edges(spark, sf).filter("edge_type in ('IMPORTS', 'USES_TYPE') and to_id like 'supplier:%'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = made.select("edge_type", "to_id", F.spark_partition_id().alias("task")).groupBy("edge_type", "to_id").agg(F.countDistinct("task").alias("n")).agg(F.max("n"), F.count("*")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got[0] == 1 and got[1] > 0
