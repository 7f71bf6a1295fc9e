"""Class files and JARs, assembled here byte by byte."""

import io
import struct
import zipfile

import pytest

from graphloom.sources import classfile, scan


def assemble(name, access=0x21, parent="java/lang/Object", interfaces=(), fields=(), methods=()):
    pool, places = [struct.pack(">BIi", 5, 0, 7)], {}  # a long first: it takes two places

    def place(key, body):
        if key not in places:
            places[key] = len(pool) + 2
            pool.append(body)
        return places[key]

    def utf8(text):
        raw = text.encode()
        return place(("u", text), struct.pack(">BH", 1, len(raw)) + raw)

    def cls(text):
        return place(("c", text), struct.pack(">BH", 7, utf8(text)))

    def members(some):
        return struct.pack(">H", len(some)) + b"".join(struct.pack(">HHHHHI", a, utf8(n), utf8(d), 1, utf8("Extra"), 3) + b"xyz" for a, n, d in some)

    rest = struct.pack(">HHHH", access, cls(name), cls(parent) if parent else 0, len(interfaces)) + b"".join(struct.pack(">H", cls(i)) for i in interfaces) + members(fields) + members(methods)
    return struct.pack(">IHHH", 0xCAFEBABE, 0, 65, len(pool) + 2) + b"".join(pool) + rest + b"\0\0"


BASE = assemble("com/x/Base", interfaces=["com/x/Run"])
CHILD = assemble(
    "com/x/Child", 0x31, "com/x/Base", fields=[(0x1A, "NAMES", "[[Ljava/lang/String;"), (0x1010, "this$0", "I")],
    methods=[(1, "<init>", "(I)V"), (8, "<clinit>", "()V"), (0x0104, "run", "([JLjava/util/Map;Z)[I"), (0x1041, "bridge", "()V")],
)


def jar(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/") + ".class", data)
        z.writestr("META-INF/MANIFEST.MF", "x")
    return out.getvalue()


ALL = {"com__x__Base": BASE, "com__x__Child": CHILD, "com__x__Run": assemble("com/x/Run", 0x601), "com__x__Mark": assemble("com/x/Mark", 0x2601), "com__x__Hue": assemble("com/x/Hue", 0x4011, "java/lang/Enum")}


def test_jar():
    got = classfile.parse_binary("a.jar", "/lib/a.jar", jar(**ALL))
    by, kinds = {e["id"]: e["qualified_name"] for e in got.elements}, {e["qualified_name"]: e["element_type"] for e in got.elements}
    assert kinds == {
        "com.x": "PACKAGE", "com.x.Base": "CLASS", "com.x.Child": "CLASS", "com.x.Run": "INTERFACE", "com.x.Mark": "INTERFACE", "com.x.Hue": "ENUM", "com.x.Child#NAMES": "FIELD",
        "com.x.Child#<init>(int)": "CONSTRUCTOR", "com.x.Child#<clinit>()": "STATIC_INITIALIZER", "com.x.Child#run(long[],java.util.Map,boolean)": "METHOD",
    }
    edges = {(by.get(a), t, by.get(b)) for a, t, b in got.edges}
    assert {("com.x.Child", "EXTENDS", "com.x.Base"), ("com.x.Base", "IMPLEMENTS", "com.x.Run"), ("com.x", "CONTAINS", "com.x.Child"), ("com.x.Child", "CONTAINS", "com.x.Child#NAMES"), ("com.x.Hue", "EXTENDS", None)} <= edges
    assert not any(a == "com.x.Base" and t == "EXTENDS" for a, t, _ in edges) and not got.errors
    run = next(e for e in got.elements if e["name"] == "run")
    assert (run["return_type"], run["visibility"], run["modifiers"], run["line_start"], run["snippet"]) == ("int[]", "protected", ["native"], 0, classfile.SNIPPET)
    field = next(e for e in got.elements if e["name"] == "NAMES")
    assert (field["return_type"], field["visibility"], field["modifiers"]) == ("java.lang.String[][]", "private", ["static", "final"])
    assert next(e for e in got.elements if e["element_type"] == "CONSTRUCTOR")["name"] == "Child"


def test_filters():
    names = lambda *a: {e["name"] for e in classfile.parse_binary("a.jar", "a.jar", jar(**ALL), *a).elements if e["element_type"] in ("CLASS", "ENUM", "INTERFACE")}
    assert names(("com.x.Base", "com.y")) == {"Base"} and names(("com.",)) == set() and names((), ("R.n$", "Hue")) == {"Base", "Child", "Mark"}


@pytest.mark.parametrize(
    ("descriptor", "want"),
    [("(I[Ljava/lang/String;J)V", (["int", "java.lang.String[]", "long"], "void")), ("()[[D", ([], "double[][]")), ("()", ([], "void")), ("(Q)B", (["Q"], "byte")), ("(Lbroken)S", (["?"], "short"))],
)
def test_descriptors(descriptor, want):
    assert classfile.method_types(descriptor) == want


def test_any_cut_of_a_class_is_an_error_of_that_class_alone():
    for n in range(len(CHILD) - 2):
        got = classfile.parse_binary("r", "Child.class", CHILD[:n])
        assert len(got.errors) == 1 and not got.elements


def test_scan(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "a.jar").write_bytes(jar(**ALL, com__x__Bad=b"nonsense"))
    (tmp_path / "lib" / "Base.class").write_bytes(BASE)
    (tmp_path / "lib" / "b.jar").write_bytes(b"not a jar")
    elements, edges, errors = scan.parse_class_files(scan.scan_class_files(spark, str(tmp_path), "own"))
    got = {(r["repo_id"], r["qualified_name"]) for r in elements.collect()}
    assert {("a.jar", "com.x.Child"), ("own", "Base")} <= got and elements.filter("element_type = 'PACKAGE'").count() == 1
    assert edges.filter("edge_type = 'EXTENDS'").count() == 2
    assert sorted((r["repo_id"], r["error"].split(":")[0]) for r in errors.collect()) == [("a.jar", "com.x.Bad"), ("b.jar", "BadZipFile")]
    empty = spark.createDataFrame([("r", "x.class", None)], "repo_id string, file_path string, content binary")
    assert [d.count() for d in scan.parse_class_files(empty)] == [0, 0, 1] and [d.count() for d in scan.parse_class_files(empty.limit(0))] == [0, 0, 0]
