"""JVM class files and JARs into rows, read from the constant pool and the member tables; code is never looked at."""

from __future__ import annotations

import io
import re
import struct
import zipfile

from .rows import Rows

# Fixed values.
SNIPPET = "// [bytecode — no source available]"
PRIMITIVES = {"Z": "boolean", "B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "V": "void"}
VISIBILITY = {0x0001: "public", 0x0004: "protected", 0x0002: "private"}
MODIFIERS = {0x0008: "static", 0x0010: "final", 0x0400: "abstract", 0x0100: "native", 0x0020: "synchronized", 0x0040: "volatile", 0x0080: "transient"}
KINDS = {0x0200: "INTERFACE", 0x4000: "ENUM", 0x2000: "ANNOTATION"}
SYNTHETIC = 0x1000
_POOL_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}

_TYPE = re.compile(r"(\[*)(?:L([^;]*);|(.))", re.S)


def type_names(descriptors: str) -> list[str]:
    """Field descriptors side by side as type names: ``[Ljava/lang/String;I`` gives ``java.lang.String[]`` and ``int``. An unknown letter names itself, an L without its semicolon reads "?" and ends the list."""
    out, at = [], 0
    while m := _TYPE.match(descriptors, at):
        at = m.end()
        if m[3] == "L":
            return [*out, "?" + "[]" * len(m[1])]
        out.append((m[2].replace("/", ".") if m[3] is None else PRIMITIVES.get(m[3], m[3])) + "[]" * len(m[1]))
    return out


def method_types(descriptor: str) -> tuple[list[str], str]:
    """(parameter types, return type); no return part reads "void"."""
    inside, _, after = descriptor.removeprefix("(").partition(")")
    return type_names(inside), (type_names(after) or ["void"])[0]


class ClassReader:
    """access, super_name, interfaces, fields and methods (access, name, descriptor) of one class file."""

    def __init__(self, data: bytes):
        self._data, self._at = data, 0
        if self._u4() != 0xCAFEBABE:
            raise ValueError("not a class file")
        self._at += 4
        self._pool: dict[int, bytes | int] = {}
        i, n = 1, self._u2()
        while i < n:
            tag = self._take(1)[0]
            if tag == 1:
                self._pool[i] = self._take(self._u2())
            elif tag in _POOL_SIZES:
                body = self._take(_POOL_SIZES[tag])
                if tag == 7:
                    self._pool[i] = int.from_bytes(body, "big")
            else:
                raise ValueError(f"constant of unknown kind {tag}")
            i += 2 if tag in (5, 6) else 1  # long and double take two places
        self.access = self._u2()
        self.name, self.super_name = self._class(self._u2()), self._class(self._u2())
        self.interfaces = [self._class(self._u2()) for _ in range(self._u2())]
        self.fields, self.methods = self._members(), self._members()

    def _take(self, n: int) -> bytes:
        got = self._data[self._at : self._at + n]
        if len(got) < n:
            raise ValueError("class file ends early")
        self._at += n
        return got

    def _u2(self) -> int:
        return struct.unpack(">H", self._take(2))[0]

    def _u4(self) -> int:
        return struct.unpack(">I", self._take(4))[0]

    def _text(self, i: int) -> str:
        return self._pool[i].replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")

    def _class(self, i: int) -> str | None:
        return self._text(self._pool[i]) if i else None

    def _members(self) -> list[tuple[int, str, str]]:
        out = []
        for _ in range(self._u2()):
            access, name, descriptor = self._u2(), self._text(self._u2()), self._text(self._u2())
            for _ in range(self._u2()):
                self._u2()
                self._take(self._u4())
            out.append((access, name, descriptor))
        return out


class ClassRows(Rows):
    """Rows of class files that share one path; ``errors`` names those that can't be read."""

    def __init__(self, repo_id: str, path: str):
        super().__init__(repo_id, path, "JAVA", "")
        self.errors: list[str] = []

    def _declare(self, element_type: str, name: str, qualified_name: str, access: int | None = None, **more) -> dict:
        row = {"id": self.id_of(element_type, qualified_name), "repo_id": self.repo_id, "element_type": element_type, "language": self.language, "name": name, "qualified_name": qualified_name, "file_path": self.path, "line_start": 0, "line_end": 0, "col_start": 0, "col_end": 0} | more
        if access is not None:
            row |= {"snippet": SNIPPET, "visibility": next((v for bit, v in VISIBILITY.items() if access & bit), "package"), "modifiers": [m for bit, m in MODIFIERS.items() if access & bit]}
        self.elements.append(row)
        return row

    def add(self, class_name: str, data: bytes) -> None:
        """The class, its package and its members. Flags are read by their bit alone, so a class whose super flag is set has the modifier "synchronized", and an annotation type, being an interface, is an INTERFACE."""
        read = ClassReader(data)
        package, _, simple = class_name.rpartition(".")
        owner = self._declare(next((k for bit, k in KINDS.items() if read.access & bit), "CLASS"), simple, class_name, read.access)
        if read.super_name and read.super_name != "java/lang/Object":
            self.edge_to(owner, "EXTENDS", "CLASS", read.super_name.replace("/", "."))
        for name in read.interfaces:
            self.edge_to(owner, "IMPLEMENTS", "INTERFACE", name.replace("/", "."))
        if package:
            self.edge(self._declare("PACKAGE", package, package)["id"], "CONTAINS", owner["id"])
        members = []
        for access, name, descriptor in read.methods:
            kind = {"<init>": "CONSTRUCTOR", "<clinit>": "STATIC_INITIALIZER"}.get(name, "METHOD")
            types, returned = method_types(descriptor)
            signature = f"{name}({','.join(types)})"
            members.append((access, kind, simple if name == "<init>" else name, signature, {"signature": signature, "parameter_types": types, "return_type": returned}))
        members += [(access, "FIELD", name, name, {"return_type": (type_names(descriptor) or ["?"])[0]}) for access, name, descriptor in read.fields]
        for access, kind, name, key, more in members:
            if not access & SYNTHETIC:
                self.edge(owner["id"], "CONTAINS", self._declare(kind, name, f"{class_name}#{key}", access, parent_id=owner["id"], **more)["id"])


def included(class_name: str, packages: tuple[str, ...] = (), excludes: tuple[str, ...] = ()) -> bool:
    """Within one of the packages (none: everywhere) and matched by none of the patterns."""
    inside = not packages or any(class_name == p or class_name.startswith(f"{p}.") for p in packages)
    return bool(class_name.strip()) and inside and not any(re.search(x, class_name) for x in excludes)


def parse_binary(repo_id: str, path: str, data: bytes, packages: tuple[str, ...] = (), excludes: tuple[str, ...] = ()) -> ClassRows:
    """A JAR's classes, named by their entries, or one class, named by its file. A class that can't be read leaves an error and the others stay; a JAR that can't be opened raises."""
    out = ClassRows(repo_id, path)

    def add(name: str, read) -> None:
        if included(name, packages, excludes):
            try:
                out.add(name, read())
            except Exception as e:  # one bad class must not hide the others
                out.errors.append(f"{name}: {type(e).__name__}: {e}"[:500])

    if path.lower().endswith(".class"):
        add(path.rsplit("/", 1)[-1][: -len(".class")], lambda: data)
        return out
    with zipfile.ZipFile(io.BytesIO(data)) as jar:
        for entry in jar.namelist():
            if entry.endswith(".class"):
                add(re.sub(r"[/\\]", ".", entry.removesuffix(".class")), lambda entry=entry: jar.read(entry))
    return out
