"""JSON and Markdown in Spark expressions against the plain parsers, row by row."""

import json
from collections import Counter

from pyspark.sql import functions as F

from graphloom.sources import documents, native, scan

FILES = "repo_id string, file_path string, content string"
MD = [
    "", "just text", "# One", "intro\n\n# One\ntext\n## Two ##\n\n### \nmore\n", "Title\n=====\nbody\n\nSub\n---\nx\n", "```\n# no\n```\n# yes\n~~~ sh\n# no\n```\n# still no\n~~~\n## ok", "````\n```\n# in\n````\n---\nafter\n===\n",
    "# a\n# b\n\n\n# c\n   \n", "- item\n---\n> quote\n===\n1. n\n---\n", "#no\n ####### seven\n   # three\n    # four\n# tail #\t\n", "é ü\n==\n\nlong\n" + "line\n" * 200, "# r\r\nx\r\n", "```\nopen\n# to the end\n", None, "\n\n\n", "a\n=\n=\n",
]
JSON = [
    '{"a": {"b": [1, {"c": null}, "com.x.Foo"], "e": {}, "l": []}, "t": true, "f": 1.5, "i": 12345678901234567890123, "s": "x\\ny"}', "[1, [2, [3]]]", "5", '"com.acme.Bar"', "{}", "", None, "{", '{"a": 1}}', "1] [2", '1, "y": 2', "1, 2", "null", '{"": {"": 1}, "a.b": 2}',
    json.dumps({"k": [{"n": i, "v": "t" * i} for i in range(30)]}, indent=1), '  {"u": "é \\u00fc"}  \n\n',
]
SEEN = ("id", "element_type", "language", "name", "qualified_name", "file_path", "line_start", "line_end", "snippet", "parent_id")


def plain(rows):
    elements, edges = Counter(), set()
    for r in rows:
        elements.update({tuple(e.get(c) for c in SEEN) for e in r.elements})
        edges |= set(r.edges)
    return elements, edges


def found(elements, edges):
    return Counter(tuple(r) for r in elements.select(*SEEN).collect()), {tuple(r) for r in edges.select("from_id", "edge_type", "to_id").collect()}


def test_markdown(spark):
    files = [("r", "README.md" if i == 3 else f"docs/f{i}.md", t) for i, t in enumerate(MD)] + [("r", "docs/readme.MARKDOWN", "# x")]
    assert found(*native.parse_markdown(spark.createDataFrame(files, FILES))) == plain(documents.parse_markdown(r, p, t or "") for r, p, t in files)
    made = native.parse_markdown(spark.createDataFrame(files, FILES))[0]
    assert {r["metadata"]["level"] for r in made.filter("element_type = 'MARKDOWN_HEADING'").collect()} >= {"1", "2", "3"}


def test_json(spark):
    files = [("r", f"c/f{i}.json", t) for i, t in enumerate(JSON)]
    good, bad = [], set()
    for r, p, t in files:
        try:
            good.append(documents.parse_config(r, p, t or ""))
        except ValueError:
            bad.add(p)
    elements, edges, errors = native.parse_json(spark.createDataFrame(files, FILES))
    assert found(elements, edges) == plain(good)
    assert {r["file_path"] for r in errors.collect()} == bad and len(bad) == 7


def test_json_keys_twice_and_numbers(spark):
    leaves, bad = native.json_leaves(spark.createDataFrame([("r", "a.json", '{"a": 1, "a": 2, "x": 1e10, "y": 1.50, "z": -0.0, "w": 2.0, "v": 123456789012345678901, "d": {"e": [[[{"f": "g"}]]]}}')], FILES))
    assert {r["path"]: r["leaf"] for r in leaves.collect()} == {"a": "2", "x": "1.0E10", "y": "1.5", "z": "0.0", "w": "2.0", "v": "123456789012345678901", "d.e[0][0][0].f": "g"} and bad.count() == 0
    assert native.json_leaves(spark.createDataFrame([], FILES))[0].count() == 0


def test_no_python_workers_and_parsers_of_users(spark):
    """Built-in JSON and Markdown run without Python; a user's parser that comes first gets its files all the same."""
    files = spark.createDataFrame([("r", "a.md", "# x\ny"), ("r", "b.json", '{"k": 1}'), ("r", "c.go", "package p\n"), ("r", "d.json", "{")], FILES)
    for df in (*native.parse_json(files.filter("file_path like '%json'")), *native.parse_markdown(files.filter("file_path = 'a.md'"))):
        assert "Python" not in (plan := df._jdf.queryExecution().toString()) and "Arrow" not in plan and "InPandas" not in plan
    elements, edges, errors = scan.parse_files(files)
    assert {r["element_type"] for r in elements.collect()} >= {"MARKDOWN_HEADING", "CONFIG_KEY", "PACKAGE"} and [r["file_path"] for r in errors.collect()] == ["d.json"] and edges.count() > 3
    own = scan.Parser("MINE", lambda p: p == "b.json", lambda r, p, t: scan.rows.Rows(r, p, "JSON", t))
    registry = scan.ParserRegistry([own, *scan.ParserRegistry.with_defaults().parsers])
    assert scan.parse_files(files, registry)[0].filter(F.col("file_path") == "b.json").count() == 0


def test_markdown_of_many_headings_and_repeated_paths(spark):
    text = "top\n" + "".join(f"# h{i}\nbody {i}\n" for i in range(3000))
    files = spark.createDataFrame([("r", "a.md", text), ("r", "a.md", text)], FILES)
    rows = native._outlined(files)
    assert "lines" not in rows.columns and rows.count() == 1  # no row by heading holds the file's lines
    elements, edges = native.parse_markdown(files)
    assert elements.count() == elements.select("id").distinct().count() == 6002 and edges.count() == 3000 * 2 + 2999 + 3001
    assert elements.filter("qualified_name = 'a.md#section:h2999@6000'").first()["snippet"] == "body 2999"
