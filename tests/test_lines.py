"""Declarations by line: examples of each language, and block ends against a plain scan of characters."""

import random

import pytest

from graphloom import model
from graphloom.sources import lines


def files(spark, *rows):
    return spark.createDataFrame([("r", p, c) for p, c in rows], "repo_id string, file_path string, content string")


def found(spark, path, text):
    elements, _ = lines.declarations(files(spark, (path, text)))
    return sorted((r.line_start, r.line_end, r.element_type, r.qualified_name) for r in elements.collect())


def plain_end(text, start):
    depth, opened = 0, False
    for i, line in enumerate(text[start:], start):
        for c in line:
            depth += (c == "{") - (c == "}")
            opened |= c == "{"
            if opened and not depth:
                return i
    return start


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.go", "package p\r\n  func (s *S) Sell(n int) error {\r\n}\r\nfunc f() {}\r\ntype I interface {\r\n}\r\ntype T struct {\r\n", [(1, 1, "PACKAGE", "p"), (2, 3, "METHOD", "p.S.Sell"), (4, 4, "FUNCTION", "p.f"), (5, 6, "INTERFACE", "p.I"), (7, 7, "STRUCT", "p.T")]),
        ("a.go", "func f() {\n}\npackage p\nfunc f() {\n}", [(1, 2, "FUNCTION", "f"), (3, 3, "PACKAGE", "p"), (4, 5, "FUNCTION", "p.f")]),
        ("a.rs", "pub trait T {\n fn a(&self);\n}\nimpl T for S {\n fn b() {}\n}\nimpl S {}\nenum E { A }", [(1, 3, "INTERFACE", "T"), (2, 4, "FUNCTION", "a"), (4, 6, "CLASS", "impl T for S"), (5, 5, "FUNCTION", "b"), (7, 7, "CLASS", "impl S"), (8, 8, "ENUM", "E")]),
        ("a.tsx", "export abstract class A {\n}\n  type X = { a: 1 }\nconst f = async (a) => {\n};\nexport enum E {}", [(1, 2, "CLASS", "A"), (3, 3, "CLASS", "X"), (4, 5, "FUNCTION", "f"), (6, 6, "ENUM", "E")]),
        ("a.c", "class K {\n};\nstruct {\n} x;\nstatic int *f(int a) {\n else if (a) {\n }\n}\ntypedef enum E {\n};", [(5, 8, "FUNCTION", "f"), (9, 10, "ENUM", "E")]),
        ("a.H++", "template <T> class K {\n};\nstruct S {\n};", [(1, 2, "CLASS", "K"), (3, 4, "STRUCT", "S")]),
        ("a.rs", "fn x() {\n}\nfn x() {\n a\n}", [(3, 5, "FUNCTION", "x")]),
        ("a.py", "class A {}", []),
        ("a.go", "", []),
        ("a.go", None, []),
    ],
)
def test_languages(spark, path, text, want):
    assert found(spark, path, text) == want


def test_block_ends(spark):
    dice = random.Random(5)
    made = {f"{n}.rs": [(f"fn f{i}() " if dice.random() < 0.4 else "") + "".join(dice.choice("{}{} ") for _ in range(dice.randrange(4))) for i in range(40)] for n in range(30)}
    elements, _ = lines.declarations(files(spark, *((p, "\n".join(t)) for p, t in made.items())))
    got = {(r.file_path, r.line_start - 1): (r.line_end - 1, r.snippet) for r in elements.collect()}
    want = {(p, i): (plain_end(t, i), "\n".join(t[i : plain_end(t, i) + 1])) for p, t in made.items() for i, line in enumerate(t) if line.startswith("fn ")}
    assert got == want and len(got) > 300


def test_columns(spark):
    text = "package p\nfunc (s *S) f() {\n" + "x\n" * 200 + "}\npub fn"
    elements, edges = lines.declarations(files(spark, ("a.go", text), ("b.rs", "pub fn a() {}\nfn b() {}")))
    rows = {r.name: r for r in elements.collect()}
    assert elements.columns == model.ELEMENTS.names and rows["f"].line_end == 203 and rows["f"].snippet.count("\n") == 99 and rows["f"].metadata == {"receiverType": "S"}
    assert (rows["a"].visibility, rows["b"].visibility, rows["f"].visibility) == ("public", "private", None)
    assert [(r.from_id, r.edge_type, r.to_id) for r in edges.collect()] == [(rows["p"].id, "CONTAINS", rows["f"].id)]
