"""Parsers, scans and streams on small files."""

import hashlib
import json
import os
import time

import pytest

from graphloom.operators import neighbors
from graphloom.sources import documents, rows, scan
from graphloom.sources.blocks import BlockParser
from graphloom.store import GraphStore
from graphloom.streaming import changes

JAVA = """package com.example;
import java.util.List;
/** Greets. */
@Deprecated
public class Hello extends Base implements Runnable {
    private final String message = "a{b";
    static { init(); }
    public Hello(String m) { this.message = m; }
    /** Doc. */
    public String getMessage(int a, List<String> b) { return helper(a).trim(); }
    enum Color { RED, GREEN(1); int x; }
}
"""


def names(lang, text):
    got = BlockParser(lang, "r", "f", text).parse()
    by = {e["id"]: e["qualified_name"] for e in got.elements}
    return {(e["element_type"], e["qualified_name"]) for e in got.elements}, {(by.get(a), t, by.get(b)) for a, t, b in got.edges}, got


def test_java():
    have, edges, got = names("JAVA", JAVA)
    assert {("PACKAGE", "com.example"), ("IMPORT", "java.util.List"), ("CLASS", "com.example.Hello"), ("FIELD", "com.example.Hello#message"), ("CONSTRUCTOR", "com.example.Hello#Hello(String)"), ("METHOD", "com.example.Hello#getMessage(int,List<String>)"), ("ENUM_CONSTANT", "com.example.Hello.Color.RED"), ("ENUM_CONSTANT", "com.example.Hello.Color.GREEN"), ("PARAMETER", "com.example.Hello#getMessage(int,List<String>)#param:b"), ("ANNOTATION", "com.example.Hello@Deprecated"), ("COMMENT_DOC", "com.example.Hello#javadoc")} <= have
    assert ("com.example", "CONTAINS", "com.example.Hello") in edges and ("com.example.Hello#javadoc", "DOCUMENTS", "com.example.Hello") in edges
    field = next(e for e in got.elements if e["name"] == "message")
    assert field["visibility"] == "private" and field["modifiers"] == ["final"] and field["line_start"] == 6
    assert next(e for e in got.elements if e["name"] == "getMessage")["doc_comment"] == "Doc."


@pytest.mark.parametrize(
    ("lang", "text", "have", "edges"),
    [
        ("GO", "package m\nimport \"fmt\"\n// Doc.\ntype T struct {\n\tA int\n}\nfunc (t *T) Run(x int) error {\n\treturn helper()\n}\nfunc helper() error { return nil }\n", {("STRUCT", "m.T"), ("FIELD", "T.A"), ("METHOD", "m.T.Run"), ("FUNCTION", "m.helper"), ("IMPORT", "fmt"), ("COMMENT_DOC", "m.T#godoc")}, {("m.T.Run", "CALLS", "m.helper"), ("m.T#godoc", "DOCUMENTS", "m.T")}),
        ("RUST", "use std::io;\n#[derive(Debug)]\nstruct P { pub x: i32 }\nenum E { A, B(i32) }\ntrait S { fn area(&self) -> f64; }\nimpl S for P { fn area(&self) -> f64 { 1.0 } }\nmod inner { fn f() {} }\n", {("STRUCT", "crate::P"), ("FIELD", "crate::P::x"), ("ENUM_CONSTANT", "crate::E::B"), ("TRAIT", "crate::S"), ("METHOD", "crate::P::area"), ("FUNCTION", "crate::inner::f"), ("USE_DECLARATION", "std::io"), ("ATTRIBUTE", "crate::P#attr:#[derive(Debug)]")}, {("crate::P", "MIXES_IN", "crate::S"), ("crate::P", "CONTAINS", "crate::P::area")}),
        ("TYPESCRIPT", "import { A } from './a';\nclass Bar { }\nexport class Foo extends Bar {\n  private x: number = 1;\n  constructor(a: string) { }\n  run(a, b: number): void { }\n}\nconst f = (a: number) => { return h(a) }\nfunction h() { }\n", {("IMPORT", "./a"), ("CLASS", "Foo"), ("FIELD", "Foo.x"), ("METHOD", "Foo.run(any,number)"), ("CONSTRUCTOR", "Foo.constructor(string)"), ("FUNCTION", "f")}, {("Foo", "EXTENDS", "Bar"), ("f", "CALLS", "h")}),
        ("C", '#include "a.h"\nstruct S { int a; };\nenum E { ONE, TWO };\nint add(int a) { return a; }\nint main(void) { return add(1); }\n', {("IMPORT", "a.h"), ("FIELD", "S.a"), ("ENUM_CONSTANT", "E.TWO"), ("FUNCTION", "main")}, {("main", "CALLS", "add")}),
        ("CPP", "namespace ns { class B { public: virtual void f() = 0; }; class A { }; class D : public A { int x; public: D(int a) {} ~D() {} }; }\n", {("NAMESPACE", "ns"), ("INTERFACE", "ns::B"), ("CLASS", "ns::D"), ("FIELD", "ns::D::x"), ("CONSTRUCTOR", "ns::D::D(int)"), ("METHOD", "ns::D::~D()")}, {("ns::D", "EXTENDS", "ns::A")}),
    ],
)
def test_languages(lang, text, have, edges):
    got, links, _ = names(lang, text)
    assert have <= got and edges <= links


@pytest.mark.parametrize("lang", ["JAVA", "GO", "RUST", "TYPESCRIPT", "C", "CPP"])
@pytest.mark.parametrize("text", ["", "}", "{{{", "class", "/* open", '"', "fn x(", "}}}} class A { void f( {", "#", "enum E { , , }"])
def test_broken_sources_do_not_crash(lang, text):
    BlockParser(lang, "r", "f", text).parse()


def test_markdown():
    got = documents.parse_markdown("r", "docs/README.md", "pre\n# A\nx\n## B\n\n```\n# no\n```\nTitle\n===\n")
    heads = [(e["name"], e["line_start"], e["metadata"]["level"]) for e in got.elements if e["element_type"] == "MARKDOWN_HEADING"]
    assert heads == [("A", 2, "1"), ("B", 4, "2"), ("Title", 9, "1")]
    sections = {e["name"]: (e["line_start"], e["line_end"]) for e in got.elements if e["element_type"] == "MARKDOWN_SECTION"}
    assert sections["(preamble)"] == (1, 1) and sections["A"] == (3, 3) and sections["B"] == (5, 8) and "Title" not in sections
    assert sum(t == "PRECEDES" for _, t, _ in got.edges) == 2 and any(t == "DOCUMENTS_DIR" for _, t, _ in got.edges)


def test_config():
    got = documents.parse_config("r", "c.json", json.dumps({"a": {"b": [1, "com.x.Foo"]}, "e": {}}))
    assert {e["name"]: e["snippet"] for e in got.elements if e["element_type"] == "CONFIG_KEY"} == {"a.b[0]": "1", "a.b[1]": "com.x.Foo"}
    assert [t for _, t, _ in got.edges if t == "REFERENCES_CLASS"] == ["REFERENCES_CLASS"]
    with pytest.raises(ValueError):
        documents.parse_config("r", "c.json", "{")


def test_snippets():
    assert rows.truncate("x\n" * 200).count("\n") == 100


def test_index_and_watch(spark, tmp_path, monkeypatch):
    src = tmp_path / "src" / "com"
    src.mkdir(parents=True)
    (tmp_path / "src" / "target").mkdir()
    (src / "Hello.java").write_text(JAVA)
    (tmp_path / "src" / "target" / "Gone.java").write_text(JAVA)
    (tmp_path / "src" / "bad.json").write_text("{")
    (tmp_path / "src" / "README.md").write_text("# Hi\ntext\n")
    s = GraphStore(spark, str(tmp_path / "store"))
    row = scan.index_repo(spark, s, str(tmp_path / "src"), "repo").first()
    assert row["status"] == "READY" and row["file_count"] == 3 and row["parse_errors"] == 1 and s.read("file_index").count() == 3
    with pytest.raises(FileNotFoundError):
        scan.index_repo(spark, s, str(tmp_path / "nowhere"), "none")
    assert [r["id"] for r in s.read("repos").collect()] == ["repo"]
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(scan, "parse_files", lambda *_: (_ for _ in ()).throw(RuntimeError("broken")))
        scan.index_repo(spark, s, str(tmp_path / "src"), "again")
    assert {r["id"]: r["status"] for r in s.read("repos").collect()} == {"repo": "READY", "again": "ERROR"}
    s.set_repo(s.read("repos").filter("id = 'repo'"))
    s.write(repos=s.read("repos").filter("id = 'repo'"))
    before = {r["id"] for r in s.read("elements").collect()}
    scan.index_repo(spark, s, str(tmp_path / "src"), "repo")
    assert {r["id"] for r in s.read("elements").collect()} == before and s.read("repos").count() == 1
    e, g = s.read("elements"), s.read("edges")
    assert {"getMessage", "message", "Color"} <= {r["name"] for r in neighbors.children(e, g, e.filter("name = 'Hello' and element_type = 'CLASS'")).collect()}

    (src / "Hello.java").write_text(JAVA.replace("getMessage", "setMessage"))
    log = tmp_path / "log"
    log.mkdir()
    at = lambda n: time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(1_700_000_000 + n))
    lines = [("repo", "com/Hello.java", "DELETED", 0), ("repo", "com/Hello.java", "MODIFIED", 0.2), ("repo", "README.md", "DELETED", 1), ("other", "x.java", "MODIFIED", 2), ("repo", "zz", "MODIFIED", 86400)]
    (log / "1.json").write_text("\n".join(json.dumps({"repo_id": r, "file_path": f, "change_type": k, "ts": at(int(n)) + (".200Z" if n == 0.2 else ".000Z")}) for r, f, k, n in lines))

    def parse(files):
        found = scan.scan_repo(spark, str(tmp_path / "src"), "repo").join(files, ["repo_id", "file_path"], "left_semi")
        return scan.parse_files(found)[:2]

    changes.watch(spark, str(log), s, s.read("repos"), parse, str(tmp_path / "ck")).awaitTermination()
    now = {r["name"] for r in s.read("elements").collect()}
    assert "setMessage" in now and "getMessage" not in now and "Hi" not in now


def test_debounce(spark):
    at = [0, 200, 400, 2000]
    frame = spark.createDataFrame([("r", "f", "DELETED" if n == 200 else "MODIFIED", 1_700_000_000 + n / 1000) for n in at], "repo_id string, file_path string, change_type string, s double").selectExpr("repo_id", "file_path", "change_type", "timestamp_millis(cast(round(s * 1000) as bigint)) ts")
    out = changes.debounced(frame).orderBy("started").collect()
    assert [(r["events"], r["change_type"]) for r in out] == [(3, "MODIFIED"), (1, "MODIFIED")]
    assert changes.recent_changes(frame, 2).count() == 2


def test_registry_order_and_browse(tmp_path):
    first = scan.Parser("X", lambda p: p.endswith(".java"), lambda r, p, t: rows.Rows(r, p, "JAVA", t))
    assert scan.ParserRegistry([first, *scan.ParserRegistry.with_defaults().parsers]).parser_of("a.java").name == "X"
    assert scan.ParserRegistry.with_defaults().parser_of("a.bin") is None
    (tmp_path / "b").mkdir()
    (tmp_path / ".h").mkdir()
    assert [d["name"] for d in scan.browse(str(tmp_path))] == ["..", "b"]
    assert scan.load_config(str(tmp_path / "none.yaml"))["indexerThreads"] == 4


def test_rust_attributes(spark):
    """An item begins below its attributes, and a doc comment above them is the item's."""
    text = "//! File.\n#![allow(x)]\n/// Doc.\n#[derive(Debug, Clone)]\n#[cfg(any(a[0]))]\npub struct P {\n    #[serde] x: i32,\n}\n#[inline] fn f() {\n}\n#[unit]\nstruct U;\n"
    elements, edges, _ = scan.parse_files(spark.createDataFrame([("r", "a.rs", text)], "repo_id string, file_path string, content string"))
    rows = {r.qualified_name: r for r in elements.collect()}
    assert (rows["crate::P"].line_start, rows["crate::P"].line_end, rows["crate::P"].doc_comment) == (6, 8, "Doc.") and rows["crate::P"].snippet.startswith("pub struct")
    assert (rows["crate::f"].line_start, rows["crate::f"].col_start, rows["crate::U"].line_start, rows["crate::P::x"].line_start) == (9, 11, 12, 7)
    own = "crate::P#attr:#[cfg(any(a[0]))]"
    assert (rows[own].line_start, rows[own].snippet, rows[own].parent_id, rows[own].name) == (5, "#[cfg(any(a[0]))]", rows["crate::P"].id, None)
    assert rows["a.rs#attr@4:#[derive(Debug, Clone)]"].name == "#[derive(Debug, Clone)]" and not any("serde" in q or "allow" in q for q in rows)
    ids = {r.id: q for q, r in rows.items()}
    assert {(ids[e.from_id], ids[e.to_id]) for e in edges.collect() if e.edge_type == "ANNOTATES"} == {("crate::P#attr:#[derive(Debug, Clone)]", "crate::P"), (own, "crate::P"), ("crate::f#attr:#[inline]", "crate::f"), ("crate::U#attr:#[unit]", "crate::U")}


def test_walk_prunes(spark, tmp_path, monkeypatch):
    """A pipe below node_modules would hold up whoever opens it; a tree of more folders than a task opens takes several rounds."""
    src = tmp_path / "src"
    (src / "node_modules" / "x").mkdir(parents=True)
    os.mkfifo(src / "node_modules" / "x" / "pipe.java")
    deep = src
    for i in range(7):
        (deep := deep / f"d{i}").mkdir()
        (deep / f"f{i}.go").write_bytes(b"package p\xff\n")
    (src / "build").mkdir()
    (src / "build" / "one.go").write_text("a")
    (src / "build" / "in").mkdir()
    (src / "build" / "in" / "two.GO").write_text("b")
    monkeypatch.setattr(scan, "FOLDERS", 2)
    found = lambda *a, **k: {r["file_path"]: r for r in scan.scan_repo(spark, str(src), "r", *a, **k).collect()}
    rows = found(extensions=["go", "java"])
    assert sorted(rows) == sorted("/".join(f"d{j}" for j in range(i + 1)) + f"/f{i}.go" for i in range(7))
    one = rows["d0/f0.go"]
    assert one["content"] == "package p�\n" and one["file_hash"] == hashlib.sha256(b"package p\xff\n").hexdigest() and abs(one["last_modified"] - time.time() * 1000) < 600_000
    kept = set(found(("**/node_modules/**", "build/*")))
    assert "build/one.go" not in kept and "build/in/two.GO" in kept
    assert not found(("**",)) and {r["file_path"] for r in scan.changed_files(spark, str(src), "r", spark.createDataFrame([("r", "d0/f0.go"), ("r", "gone.go"), ("r", "build/in/two.GO"), ("q", "d0/d1/f1.go"), ("r", "d0/x.bin")], "repo_id string, file_path string")).collect()} == {"d0/f0.go"}


def test_files_of_one_partition_are_spread(spark):
    files = spark.range(40).coalesce(1).selectExpr("'r' repo_id", "concat('f', id, '.go') file_path", "'package p' content")
    from pyspark.sql import functions as F

    assert scan.spread(files).select(F.spark_partition_id()).distinct().count() > 1
    assert scan.parse_files(files)[0].count() == 40
