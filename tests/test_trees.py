"""Syntax trees: the reader on printed trees, the command by a stand-in, both over files."""

import os
import stat

import pytest

from graphloom.sources import trees

SOURCE = "func f(a int) {\n  g()\n}\nx"
PRINTED = """(source_file [0, 0] - [3, 1]
  (function_declaration [0, 0] - [2, 1]
    name: (identifier [0, 5] - [0, 6])
    body: (block [0, 14] - [2, 1]
      (call [1, 2] - [1, 5])))
  (ERROR [3, 0] - [3, 1] "odd (token" UNEXPECTED 'x'
    left: literal
    (MISSING [3, 1] - [3, 1])))
file.go 0 ms (ERROR [3, 0] - [3, 1])
"""


def shape(node):
    return (node.kind, node.field, node.text, [shape(c) for c in node.children])


def test_reader():
    want = ("source_file", None, SOURCE, [
        ("function_declaration", None, "func f(a int) {\n  g()\n}", [("identifier", "name", "f", []), ("block", "body", "{\n  g()\n}", [("call", None, "g()", [])])]),
        ("ERROR", None, "x", [("MISSING", None, "", [])]),
    ])
    assert shape(trees.read_tree(PRINTED, SOURCE)) == want
    assert trees.read_tree(PRINTED, SOURCE).children[0].span == (0, 0, 2, 1)


@pytest.mark.parametrize("printed", ["", "  ", "no tree", "()", '("token")'])
def test_no_tree(printed):
    assert trees.read_tree(printed, "a") is None


def test_reader_bounds():
    assert shape(trees.read_tree("(a [0, 0] - [9, 4] (b [7, 0] - [8, 1]) (c [0, 1] - [0, 99]", "xy\nz")) == ("a", None, "xy\nz", [("b", None, "", []), ("c", None, "y", [])])
    deep = trees.read_tree("(a " * 20_000 + ")" * 20_000, "")
    for _ in range(19_999):
        deep = deep.children[0]
    assert not deep.children


@pytest.fixture
def stand_in(tmp_path):
    def make(script):
        at = tmp_path / "parser"
        at.write_text("#!/bin/sh\n" + script)
        os.chmod(at, os.stat(at).st_mode | stat.S_IXUSR)
        return str(at)

    return make


def test_command(stand_in, tmp_path):
    assert trees.run_parser("x", str(tmp_path / "none")) is None
    assert trees.run_parser("x", stand_in("exit 3")) is None
    assert trees.run_parser("x", stand_in("echo '(a)'; exit 1")) == "(a)\n"
    assert trees.run_parser("x", stand_in("exec sleep 5"), timeout=0.2) is None


def test_files(spark, stand_in, tmp_path):
    binary = stand_in('[ "$1" = parse ] || exit 1\ncase "$2" in *.go) echo "(file [0, 0] - [0, 3] name: (id [0, 1] - [0, 2]) (end [0, 2] - [0, 3]))";; *) exit 2;; esac')
    files = spark.createDataFrame([("r", "a/b.go", "abc"), ("r", "c.rs", "abc"), ("r", "d.go", None)], "repo_id string, file_path string, content string")
    got = trees.syntax_trees(files, binary).filter("file_path = 'a/b.go'").orderBy("node").collect()
    assert [(r.node, r.parent, r.kind, r.field, r.start_col, r.end_col, r.text) for r in got] == [(0, None, "file", None, 0, 3, "abc"), (1, 0, "id", "name", 1, 2, "b"), (2, 0, "end", None, 2, 3, "c")]
    assert {r.file_path for r in trees.syntax_trees(files, binary).collect()} == {"a/b.go", "d.go"}
    assert trees.syntax_trees(files, str(tmp_path / "none")).count() == 0


def test_small_trees_share_a_batch():
    files = [("r", f"f{i}", "(a [0, 0] - [0, 1] (b [0, 0] - [0, 1]))", "x") for i in range(100)]
    assert [b.num_rows for b in trees._batches(files)] == [200]
    assert [b.num_rows for b in trees._batches([("r", "f", "(a [0, 0] - [0, 1]" + " (b [0, 0] - [0, 1])" * 25_000 + ")", "x")])] == [10_000, 10_000, 5_001]
