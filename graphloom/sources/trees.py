"""Syntax trees as an external parser prints them: the command, the reader of its S-expressions, and both over a table of files."""

from __future__ import annotations

import dataclasses
import os
import re
import subprocess
import sys
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..store import spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

BINARY, TIMEOUT_S = "tree-sitter", 30
NODES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("repo_id", "file_path")]
    + [T.StructField(n, T.IntegerType()) for n in ("node", "parent")]
    + [T.StructField(n, T.StringType()) for n in ("kind", "field")]
    + [T.StructField(n, T.IntegerType()) for n in ("start_line", "start_col", "end_line", "end_col")]
    + [T.StructField("text", T.StringType())]
)
_TOKEN = re.compile(r'(?P<open>\()|(?P<close>\))|\[(?P<span>\s*\d+\s*,\s*\d+\s*\]\s*-\s*\[\s*\d+\s*,\s*\d+\s*)\]|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|(?P<label>[\w.\-]+)\s*:|(?P<word>[^\s()\[\]:"\']+)|.', re.S)


@dataclasses.dataclass
class Node:
    """Lines and columns count from 0; the end is not included."""

    kind: str
    field: str | None = None
    span: tuple[int, int, int, int] = (0, 0, 0, 0)
    text: str = ""
    children: list[Node] = dataclasses.field(default_factory=list)


def span_text(span: tuple[int, int, int, int], lines: list[str]) -> str:
    top, left, bottom, right = span
    if top >= len(lines):
        return ""
    if top == bottom:
        return lines[top][left:right]
    return "\n".join([lines[top][left:], *lines[top + 1 : bottom], *(line[:right] for line in lines[bottom : bottom + 1])])


def read_tree(printed: str, source: str) -> Node | None:
    """The first tree printed, each node with its part of the source; None if there is none. What is no node is skipped, open nodes end with the text; nesting has no bound."""
    lines = re.split(r"\r\n|\n|\r", source)
    root, open_nodes, label, named = None, [], None, True
    for m in _TOKEN.finditer(printed):
        if m["open"]:
            node = Node("", label)
            if open_nodes:
                open_nodes[-1].children.append(node)
            open_nodes.append(node)
            root, label, named = root or node, None, False
        elif not open_nodes:
            continue
        elif m["close"]:
            done = open_nodes.pop()
            if not done.kind and open_nodes:  # a token that has no type is no node
                open_nodes[-1].children.pop()
            label, named = None, True
            if not open_nodes:
                break
        elif m["span"]:
            open_nodes[-1].span = tuple(map(int, re.findall(r"\d+", m["span"])))
            open_nodes[-1].text = span_text(open_nodes[-1].span, lines)
        elif m["label"]:
            label, named = m["label"], True
        elif m["word"]:
            if not named:
                open_nodes[-1].kind = m["word"]
            named, label = True, None
    return root if root and root.kind else None


def run_parser(path: str, binary: str = BINARY, timeout: float = TIMEOUT_S) -> str | None:
    """What ``binary parse path`` prints; None if there is no such command, it fails without output or takes too long."""
    try:
        done = subprocess.run([binary, "parse", path], capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace") if done.stdout or not done.returncode else None


#: Rows that a task hands on at once.
ROWS = 10_000
_KINDS = [(f.name, pa.int32() if f.dataType == T.IntegerType() else pa.string()) for f in NODES]


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), _KINDS)], [n for n, _ in _KINDS])


def _batches(read: Iterable[tuple[str, str, str | None, str]]) -> Iterator[pa.RecordBatch]:
    """(repo, path, printed tree, source) -> the nodes in the order of the text, those of many small trees together and of a large one in parts."""
    out: list[tuple] = []
    for repo, path, printed, source in read:
        root = read_tree(printed, source) if printed else None
        todo, n = [(root, None)] if root else [], 0
        while todo:
            node, parent = todo.pop()
            todo += [(c, n) for c in reversed(node.children)]
            out.append((repo, path, n, parent, node.kind, node.field, *node.span, node.text))
            n += 1
            if len(out) == ROWS:
                yield _batch(out)
                out = []
    if out:
        yield _batch(out)


def printed_trees(files: DataFrame) -> DataFrame:
    """files (repo_id, file_path, content, printed) -> a row a node: node from 0, parent (null for the root), kind, field, span, text. A null, empty or unreadable tree gives no rows, null content counts as empty."""

    def run(batches):
        return _batches((repo, path, printed, content or "") for b in batches for repo, path, content, printed in zip(*(b.column(i).to_pylist() for i in range(4))))

    return spread(files.select("repo_id", "file_path", "content", "printed")).mapInArrow(run, NODES)


def syntax_trees(files: DataFrame, binary: str = BINARY, timeout: float = TIMEOUT_S) -> DataFrame:
    """files (repo_id, file_path, content) -> rows as of ``printed_trees``.

    A file that the command can't read gives no rows; ``lines.declarations`` is there for these. Each file is written to its task's own temporary folder, where the command reads it, and goes at once.
    """

    def run(batches):
        with tempfile.TemporaryDirectory() as folder:

            def read():
                for b in batches:
                    for repo, path, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                        at = os.path.join(folder, "file" + os.path.splitext(path or "")[1])
                        with open(at, "w", encoding="utf-8", newline="") as f:
                            f.write(content or "")
                        printed = run_parser(at, binary, timeout)
                        os.remove(at)
                        yield repo, path, printed, content or ""

            yield from _batches(read())

    return spread(files.select("repo_id", "file_path", "content")).mapInArrow(run, NODES)
