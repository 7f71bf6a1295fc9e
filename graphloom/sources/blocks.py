"""A scanner for languages of braces: declarations, members, calls and comments, without a grammar.

Comments and strings are blanked out first; then text is read up to each brace or end of a statement, and that head tells what opens or is declared, given the scope around it.
"""

from __future__ import annotations

import re

from .rows import Rows

_TOKEN = {
    "default": re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    "RUST": re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'", re.S),
    "JAVA": re.compile(r"/\*.*?\*/|//[^\n]*|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
}
_NOT_CALLS = set("if for while switch catch return new throw super this synchronized do else try func fn def sizeof typeof await async match loop select go defer assert in of case instanceof delete".split())
_CALL = re.compile(r"(?:\b(new)\s+)?((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*)\s*\(")
_NAME = r"[A-Za-z_$][\w$]*"
_JAVA_WORDS = set("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_PUBLIC = ("public", "protected", "private")


def _split_args(text: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in text:
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [*out, cur.strip()] if cur.strip() else out


#: What may open, close or end something; all else is passed over at once.
_STOP = re.compile(r"[()\[\]{};,#\n]")


class Scope:
    def __init__(self, kind: str, name: str, row: dict | None, at: int):
        self.kind, self.name, self.row, self.at = kind, name, row, at


_AHEAD = {"": re.compile(r"\s*"), "CPP": re.compile(r"\s*(?:(?:public|private|protected)\s*:(?!:)\s*)*")}


class BlockParser:
    """One file of one language into rows."""

    def __init__(self, language: str, repo_id: str, path: str, text: str):
        self.language, self.text = language, text
        self.rows = Rows(repo_id, path, language, text)
        self.comments: list[tuple[int, int, str]] = []
        self.code = _TOKEN.get(language, _TOKEN["default"]).sub(self._blank, text)
        self.package = ""
        self.scopes: list[Scope] = []
        self.spans: list[tuple[int, int, dict]] = []
        self.marks: list[tuple[int, int]] = []
        self.package_row: dict | None = None

    def _blank(self, m: re.Match) -> str:
        t = m[0]
        if t.startswith(("/*", "//")):
            self.comments.append((m.start(), m.end(), "COMMENT_DOC" if t.startswith(("/**", "///", "//!")) else "COMMENT_BLOCK" if t.startswith("/*") else "COMMENT_LINE"))
        return re.sub(r"[^\n]", " ", t)

    # -- names

    def qualified(self, name: str, member: bool = False, args: list[str] | None = None) -> str:
        outer = [s.name for s in self.scopes if s.kind in ("type", "namespace", "impl")]
        lang = self.language
        if lang in ("RUST", "CPP"):
            return "::".join([*(["crate"] if lang == "RUST" else []), *outer, name]) + (f"({','.join(args or [])})" if lang == "CPP" and member else "")
        if lang == "C":
            return ".".join([*outer, name])
        owner = ".".join(x for x in [self.package if not outer or lang == "JAVA" else "", *outer] if x)
        if lang == "JAVA":
            return f"{owner}#{name}({','.join(args)})" if member and args is not None else f"{owner}#{name}" if member else f"{owner}.{name}" if owner else name
        if lang in ("TYPESCRIPT", "JAVASCRIPT"):
            return (f"{owner}.{name}" if outer else name) + (f"({','.join(args)})" if member and args is not None and outer else "")
        return f"{owner}.{name}" if owner else name

    # -- scan

    def parse(self) -> Rows:
        code, start, depth, i, n = self.code, 0, 0, 0, len(self.code)
        by_line = self.language in ("GO", "TYPESCRIPT", "JAVASCRIPT")
        while m := _STOP.search(code, i):
            i, c = m.start(), m[0]
            if c in "([":
                depth += 1
            elif c in ")]":
                depth = max(0, depth - 1)
            elif c == "#" and self.language in ("C", "CPP") and not code[start:i].strip():
                end = code.find("\n", i)
                end = n if end < 0 else end
                self.directive(i, end)
                start = i = end
                continue
            elif c == "{" and not depth:
                self.open(start, i)
                start = i + 1
            elif c == "}" and not depth:
                self.statement(start, i)
                self.close(i)
                start = i + 1
            elif not depth and (c == ";" or c == "," and self.in_type("enum", "rust") or c == "\n" and by_line and self.line_ends(code[start:i])):
                self.statement(start, i)
                start = i + 1
            i += 1
        self.statement(start, n)
        while self.scopes:
            self.close(n - 1)
        self.attach_comments()
        return self.rows

    def in_type(self, *flags: str) -> bool:
        s = self.scopes[-1] if self.scopes else None
        return bool(s and s.kind == "type" and s.row and (s.row["element_type"] == "ENUM" or self.language == "RUST" and s.row["element_type"] == "STRUCT"))

    def line_ends(self, head: str) -> bool:
        h = head.strip()
        return bool(h) and not re.search(r"(?:[=,.+\-*/&|?:<(]|=>|\bextends|\bimplements)$", h)

    def close(self, at: int) -> None:
        if self.scopes:
            s = self.scopes.pop()
            if s.row is not None:
                self.rows.end(s.row, at + 1)
                self.spans.append((s.at, at + 1, s.row))

    def add(self, kind: str, name: str, qn: str, start: int, **more) -> dict:
        while start < len(self.code) and self.code[start].isspace():
            start += 1
        owner = next((s.row for s in reversed(self.scopes) if s.row is not None), None)
        row = self.rows.element(kind, name, qn, start, parent=owner, **more)
        if self.marks:
            row["_top"] = self.rows.line(self.marks[0][0])
        holder = owner or (self.package_row if kind not in ("IMPORT", "USE_DECLARATION", "PACKAGE") else None)
        if holder is not None:
            self.rows.edge(holder["id"], "CONTAINS", row["id"])
        return row

    def type_row(self, kind: str, name: str, start: int, supers: list[str], interfaces: list[str], **more) -> dict:
        row = self.add(kind, name, self.qualified(name), start, **more)
        for s in supers:
            self.rows.edge_to(row, "EXTENDS", "CLASS" if kind not in ("INTERFACE", "TRAIT") else kind, s)
        for s in interfaces:
            self.rows.edge_to(row, "IMPLEMENTS", "INTERFACE", s)
        return row

    def push(self, kind: str, name: str, row: dict | None, at: int) -> None:
        self.scopes.append(Scope(kind, name, row, at))

    def begins(self, start: int, end: int) -> int:
        """Where a declaration starts: past blanks, C++ access labels and Rust attributes, which ``marks`` keeps."""
        start = _AHEAD["CPP" if self.language == "CPP" else ""].match(self.code, start, end).end()
        self.marks = []
        while self.language == "RUST" and (m := re.compile(r"#!?\[").match(self.code, start, end)):
            depth, at = 1, m.end()
            while depth and at < end:
                depth += (self.code[at] == "[") - (self.code[at] == "]")
                at += 1
            said = self.text[start:at]
            inner = said.startswith("#!")  # that of the file or module around it
            self.marks += [] if inner else [(start, at)]
            if not inner and (not self.scopes or self.scopes[-1].kind == "namespace"):
                self.rows.element("ATTRIBUTE", said, f"{self.rows.path}#attr@{self.rows.line(start)}:{said}", start, end=at)
            start = _AHEAD[""].match(self.code, at, end).end()
        return start

    def open(self, start: int, brace: int) -> None:
        start = self.begins(start, brace)
        head = " ".join(self.code[start:brace].split())
        inside = self.scopes[-1].kind if self.scopes else "file"
        if inside in ("body", "other"):
            return self.push("other", "", None, brace)
        got = getattr(self, f"open_{'ts' if self.language in ('TYPESCRIPT', 'JAVASCRIPT') else 'c' if self.language in ('C', 'CPP') else self.language.lower()}")(head, start, brace)
        if not got:
            self.push("other", "", None, brace)

    def statement(self, start: int, end: int) -> None:
        start = self.begins(start, end)
        head = " ".join(self.code[start:end].split())
        if not head or self.scopes and self.scopes[-1].kind in ("body", "other"):
            return
        getattr(self, f"say_{'ts' if self.language in ('TYPESCRIPT', 'JAVASCRIPT') else 'c' if self.language in ('C', 'CPP') else self.language.lower()}")(head, start, end)

    def callable(self, kind: str, name: str, qn: str, start: int, brace: int | None, params: list[tuple[str, str]], **more) -> None:
        row = self.add(kind, name, qn, start, parameter_types=[t for _, t in params], **more)
        if self.language == "JAVA":
            for p, t in params:
                child = self.rows.element("PARAMETER", p, f"{qn}#param:{p}", row["_at"], parent=row, return_type=t)
                self.rows.edge(row["id"], "CONTAINS", child["id"])
        if brace is not None:
            self.push("body", name, row, brace)
            self.calls(row, brace)

    def calls(self, row: dict, brace: int) -> None:
        depth, end = 0, len(self.code)
        for m in re.compile(r"[{}]").finditer(self.code, brace):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                end = m.start()
                break
        for m in _CALL.finditer(self.code, brace, end):
            last = re.split(r"\.|::|->", m[2])[-1]
            if last in _NOT_CALLS or m[2].split(".")[0] in ("if", "for", "while"):
                continue
            if m[1]:
                self.rows.edge_to(row, "INSTANTIATES", "CLASS", m[2])
            else:
                self.rows.edge_to(row, "CALLS", "METHOD" if self.language == "JAVA" else "FUNCTION", self.target(m[2], m.end(), end))

    def target(self, callee: str, at: int, end: int) -> str:
        if self.language != "JAVA":
            return self.package + "." + callee if self.language == "GO" and "." not in callee and self.package else callee
        depth, i = 1, at
        while i < end and depth:
            depth += (self.code[i] in "([{") - (self.code[i] in ")]}")
            i += 1
        n = len(_split_args(self.text[at : i - 1]))
        scope, _, name = callee.rpartition(".")
        own = scope or ".".join(x for x in [self.package, *(s.name for s in self.scopes if s.kind == "type")] if x)
        return f"{own}#{name}({','.join('?' * n)})"

    # -- Java

    _J_TYPE = re.compile(rf"(?:^|\s)(@interface|class|interface|enum|record)\s+({_NAME})(?:\s*<[^{{]*?>)?(?:\s*\([^)]*\))?(.*)$")
    _J_METHOD = re.compile(rf"^(?:@{_NAME}(?:\.\w+)*(?:\s*\([^)]*\))?\s+)*(.*?)({_NAME})\s*\((.*)\)\s*(?:throws .*)?$")

    def annotations(self, head: str) -> tuple[list[str], str]:
        found = re.findall(rf"@(?!interface\b)({_NAME}(?:\.{_NAME})*)(?:\s*\([^)]*\))?", head)
        return found, re.sub(rf"@(?!interface\b){_NAME}(?:\.{_NAME})*(?:\s*\([^)]*\))?", " ", head).strip()

    def annotate(self, row: dict, names: list[str], start: int) -> None:
        for n in names:
            mark = self.rows.element("DECORATOR" if self.language == "TYPESCRIPT" else "ANNOTATION", n, f"{row['qualified_name']}@{n}", row["_at"], parent=row)
            self.rows.edge(mark["id"], "ANNOTATES", row["id"])

    @staticmethod
    def java_params(text: str) -> list[tuple[str, str]]:
        out = []
        for p in _split_args(text):
            p = re.sub(r"@\w+(?:\([^)]*\))?\s*|\bfinal\s+", "", p).strip()
            t, _, n = p.rpartition(" ")
            if t:
                out.append((n, t.strip()))
        return out

    @staticmethod
    def java_words(text: str) -> dict:
        w = [x for x in re.findall(r"[a-z]+", text) if x in _JAVA_WORDS]
        return {"visibility": next((x for x in w if x in _PUBLIC), "package"), "modifiers": [x for x in w if x not in _PUBLIC]}

    def open_java(self, head: str, start: int, brace: int) -> bool:
        marks, head = self.annotations(head)
        if m := self._J_TYPE.search(head):
            kind = {"class": "CLASS", "record": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "@interface": "ANNOTATION"}[m[1]]
            ext = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|\bpermits\b|$)", m[3])
            imp = re.search(r"\bimplements\s+(.*?)(?=\bpermits\b|$)", m[3])
            clean = lambda x: [re.sub(r"<.*", "", t).strip() for t in _split_args(x[1])] if x else []
            row = self.type_row(kind, m[2], start, clean(ext), clean(imp), **self.java_words(head[: m.start(1)]))
            self.annotate(row, marks, start)
            self.push("type", m[2], row, brace)
            return True
        if not self.scopes or self.scopes[-1].kind != "type":
            return False
        if head == "static":
            row = self.add("STATIC_INITIALIZER", "<clinit>", self.qualified("<clinit>", True, []), start)
            self.push("body", "static", row, brace)
            self.calls(row, brace)
            return True
        if "=" not in head.split("(")[0] and (m := self._J_METHOD.match(head)):
            self.java_method(m, marks, start, brace)
            return True
        if self.scopes[-1].row["element_type"] == "ENUM":
            self.java_constants(head, start)
        return False

    def java_method(self, m: re.Match, marks: list[str], start: int, brace: int | None) -> None:
        before, name, params = m[1].strip(), m[2], self.java_params(m[3])
        kind = "CONSTRUCTOR" if name == self.scopes[-1].name else "METHOD"
        rtype = re.sub(r"^(?:(?:%s)\s+)*(?:<[^>]*>\s*)?" % "|".join(_JAVA_WORDS), "", before).strip() or None
        self.callable(kind, name, self.qualified(name, True, [t for _, t in params]), start, brace, params, return_type=rtype if kind == "METHOD" else None, signature=f"{before} {name}({', '.join(f'{t} {p}' for p, t in params)})".strip(), **self.java_words(before))
        row = next(r for r in reversed(self.rows.elements) if r["element_type"] == kind)
        self.annotate(row, marks, start)

    def java_constants(self, head: str, start: int) -> None:
        if m := re.match(rf"({_NAME})(?:\s*\(.*\))?$", self.annotations(head)[1]):
            owner = self.scopes[-1]
            row = self.rows.element("ENUM_CONSTANT", m[1], f"{owner.row['qualified_name']}.{m[1]}", start, parent=owner.row)
            self.rows.edge(owner.row["id"], "CONTAINS", row["id"])

    def say_java(self, head: str, start: int, end: int) -> None:
        if m := re.match(r"package\s+([\w.]+)$", self.annotations(head)[1]):
            self.package = m[1]
            self.package_row = self.add("PACKAGE", m[1], m[1], start)
        elif m := re.match(r"import\s+(?:static\s+)?([\w.*]+)$", head):
            self.rows.element("IMPORT", m[1], m[1], start, key=f"{self.rows.path}#import:{m[1]}")
        elif self.scopes and self.scopes[-1].kind == "type":
            marks, body = self.annotations(head)
            if self.scopes[-1].row["element_type"] == "ENUM" and not self.scopes[-1].row.get("_closed") and re.match(rf"{_NAME}(?:\s*\(.*\))?$", body):
                self.java_constants(head, start)
            elif "=" not in body.split("(")[0] and (m := self._J_METHOD.match(body)):
                self.java_method(m, marks, start, None)
            elif m := re.match(rf"((?:[a-z]+\s+)*?)([\w.<>\[\], ?]+?)\s+({_NAME})(?:\[\])?\s*(?:=.*|,.*)?$", body):
                row = self.add("FIELD", m[3], self.qualified(m[3], True), start, return_type=re.sub(r"^(?:(?:%s)\s+)*" % "|".join(_JAVA_WORDS), "", m[2]), **self.java_words(m[1] + " " + m[2]))
                self.annotate(row, marks, start)
        if self.scopes and self.scopes[-1].kind == "type" and self.code[end : end + 1] == ";" and self.scopes[-1].row["element_type"] == "ENUM":
            self.scopes[-1].row["_closed"] = True

    # -- Go

    def go_params(self, text: str) -> list[tuple[str, str]]:
        out, wait = [], []
        for p in _split_args(text):
            name, _, t = p.partition(" ")
            if t:
                out += [(x, t.strip()) for x in [*wait, name]]
                wait = []
            else:
                wait.append(name)
        return out + [("_", x) for x in wait]

    def open_go(self, head: str, start: int, brace: int) -> bool:
        if m := re.match(rf"func\s*(?:\(\s*(?:{_NAME}\s+)?\*?({_NAME})[^)]*\)\s*)?({_NAME})(?:\[[^\]]*\])?\s*\((.*?)\)\s*(.*)$", head):
            kind, params = ("METHOD", self.go_params(m[3])) if m[1] else ("FUNCTION", self.go_params(m[3]))
            qn = ".".join(x for x in (self.package, m[1], m[2]) if x)
            self.callable(kind, m[2], qn, start, brace, params, signature=head, return_type=m[4] or None, visibility="public" if m[2][0].isupper() else "package", metadata={"receiverType": m[1]} if m[1] else None)
            return True
        if m := re.match(rf"(?:type\s+)?({_NAME})(?:\[[^\]]*\])?\s+(struct|interface)$", head):
            row = self.type_row("STRUCT" if m[2] == "struct" else "INTERFACE", m[1], start, [], [], visibility="public" if m[1][0].isupper() else "package")
            self.push("type", m[1], row, brace)
            return True
        return False

    def say_go(self, head: str, start: int, end: int) -> None:
        if m := re.match(r"package\s+(\w+)$", head):
            self.package = m[1]
            self.package_row = self.add("PACKAGE", m[1], m[1], start)
        elif head.startswith("import"):
            for q in re.findall(r'"([^"\n]+)"', self.text[start:end]):
                self.rows.element("IMPORT", q, q, start, key=f"{self.rows.path}#import:{q}")
        elif self.scopes and self.scopes[-1].kind == "type" and (m := re.match(rf"({_NAME})\s+([\w.*\[\]{{}}]+)", head)) and self.scopes[-1].row["element_type"] == "STRUCT":
            self.add("FIELD", m[1], f"{self.scopes[-1].name}.{m[1]}", start, return_type=m[2])

    # -- Rust

    def attribute(self, row: dict, marks: list[tuple[int, int]]) -> None:
        for a, z in marks:
            mark = self.rows.element("ATTRIBUTE", None, f"{row['qualified_name']}#attr:{self.text[a:z]}", a, parent=row, end=z)
            self.rows.edge(mark["id"], "ANNOTATES", row["id"])

    def open_rust(self, head: str, start: int, brace: int) -> bool:
        marks = self.marks
        vis = "public" if re.match(r"pub\b", head) else "private"
        if m := re.match(rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(mod|struct|enum|trait|union)\s+({_NAME})", head):
            kind = {"mod": "MODULE", "struct": "STRUCT", "union": "STRUCT", "enum": "ENUM", "trait": "TRAIT"}[m[1]]
            row = self.type_row(kind, m[2], start, [], [], visibility=vis)
            self.attribute(row, marks)
            self.push("namespace" if m[1] == "mod" else "type", m[2], row, brace)
            return True
        if m := re.match(rf"(?:unsafe\s+)?impl(?:\s*<[^{{]*?>)?\s+(?:([\w:]+)(?:<.*?>)?\s+for\s+)?([\w:]+)", head):
            outer = [s.name for s in self.scopes if s.kind == "namespace"]
            owner = self.rows.id_of("STRUCT", "::".join(["crate", *outer, m[2]]))
            if m[1]:
                self.rows.edge(owner, "MIXES_IN", self.rows.id_of("TRAIT", "::".join(["crate", *outer, m[1]])))
            self.push("impl", m[2], None, brace)
            self.scopes[-1].owner = owner
            return True
        if m := re.match(rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*fn\s+({_NAME})(?:<.*?>)?\s*\((.*?)\)\s*(?:->\s*(.*?))?(?:\bwhere\b.*)?$", head):
            method = self.scopes and self.scopes[-1].kind in ("impl", "type")
            params = [(a.split(":", 1)[0].strip(), a.split(":", 1)[1].strip()) for a in _split_args(m[2]) if ":" in a]
            owner = getattr(self.scopes[-1], "owner", None) if self.scopes else None
            self.callable("METHOD" if method else "FUNCTION", m[1], self.qualified(m[1]), start, brace, params, signature=head, return_type=m[3] or None, visibility=vis)
            row = self.scopes[-1].row
            self.attribute(row, marks)
            if owner:
                self.rows.edge(owner, "CONTAINS", row["id"])
            return True
        return False

    def say_rust(self, head: str, start: int, end: int) -> None:
        if m := re.match(rf"(?:(?:const|async|unsafe)\s+)*fn\s+({_NAME})(?:<.*?>)?\s*\((.*?)\)\s*(?:->\s*(.*?))?$", head):
            self.callable("METHOD", m[1], self.qualified(m[1]), start, None, [], signature=head, return_type=m[3])
        elif m := re.match(r"(?:pub\s+)?use\s+(.+)$", head):
            self.rows.element("USE_DECLARATION", m[1], m[1], start, key=f"{self.rows.path}#use:{m[1]}")
        elif m := re.match(rf"(?:pub\s+)?struct\s+({_NAME})", head):
            self.attribute(self.type_row("STRUCT", m[1], start, [], []), self.marks)
        elif self.scopes and self.scopes[-1].kind == "type":
            kind = self.scopes[-1].row["element_type"]
            if kind == "ENUM" and (m := re.match(rf"({_NAME})", head)):
                self.add("ENUM_CONSTANT", m[1], f"{self.scopes[-1].row['qualified_name']}::{m[1]}", start)
            elif kind == "STRUCT" and (m := re.match(rf"(pub(?:\([^)]*\))?\s+)?({_NAME})\s*:\s*(.+)$", head)):
                self.add("FIELD", m[2], f"{self.scopes[-1].row['qualified_name']}::{m[2]}", start, return_type=m[3], visibility="public" if m[1] else "private")

    # -- TypeScript, JavaScript

    def ts_params(self, text: str) -> list[tuple[str, str]]:
        return [(re.split(r"[?:=]", p)[0].strip(), (re.search(r":\s*([^=]+)", p) or [0, "any"])[1].strip()) for p in _split_args(text)]

    def open_ts(self, head: str, start: int, brace: int) -> bool:
        marks, head = self.annotations(head)
        if m := re.search(rf"(?:^|\s)(class|interface|enum|namespace)\s+({_NAME})(?:<.*?>)?\s*(?:extends\s+(.*?))?(?:\s*implements\s+(.*))?$", head):
            clean = lambda x: [re.sub(r"<.*", "", t) for t in _split_args(x)] if x else []
            kind = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "namespace": "NAMESPACE"}[m[1]]
            row = self.type_row(kind, m[2], start, clean(m[3]), clean(m[4]), modifiers=[x for x in ("export", "abstract", "default") if re.search(rf"\b{x}\b", head[: m.start(1)])])
            self.annotate(row, marks, start)
            self.push("namespace" if m[1] == "namespace" else "type", m[2], row, brace)
            return True
        if m := re.match(rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_NAME})(?:<.*?>)?\s*\((.*?)\)(?:\s*:\s*(.*))?$", head):
            self.callable("FUNCTION", m[1], self.qualified(m[1]), start, brace, self.ts_params(m[2]), signature=head, return_type=m[3])
            return True
        if m := re.match(rf"(?:export\s+)?(?:const|let|var)\s+({_NAME})[^=]*=\s*(?:async\s*)?(?:\((.*?)\)|({_NAME}))(?:\s*:\s*[^=]+)?\s*=>$", head):
            self.callable("FUNCTION", m[1], self.qualified(m[1]), start, brace, self.ts_params(m[2] or m[3] or ""), signature=head)
            return True
        if self.scopes and self.scopes[-1].kind == "type" and (m := re.match(rf"((?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)\s+)*)\*?(#?{_NAME})\??(?:<.*?>)?\s*\((.*)\)(?:\s*:\s*(.*))?$", head)):
            params, words = self.ts_params(m[3]), m[1].split()
            self.callable("CONSTRUCTOR" if m[2] == "constructor" else "METHOD", m[2], self.qualified(m[2], True, [t for _, t in params]), start, brace, params, signature=head, return_type=m[4], visibility=next((w for w in words if w in _PUBLIC), "public"), modifiers=[w for w in words if w not in _PUBLIC])
            self.annotate(self.scopes[-1].row, marks, start)
            return True
        return False

    def say_ts(self, head: str, start: int, end: int) -> None:
        if head.startswith(("import ", "export {", "export *")) or re.match(r"from\b|\}", head):
            if m := re.search(r"""(?:from\s*|import\s*)['"]([^'"]+)""", self.text[start:end]):
                self.rows.element("IMPORT", m[1], m[1], start, key=f"{self.rows.path}#import:{m[1]}")
        elif self.scopes and self.scopes[-1].kind == "type":
            if self.scopes[-1].row["element_type"] == "ENUM":
                if m := re.match(rf"({_NAME})", head):
                    self.add("ENUM_CONSTANT", m[1], self.qualified(m[1]), start)
            elif m := re.match(rf"((?:(?:public|private|protected|static|readonly|declare|abstract)\s+)*)(#?{_NAME})[?!]?\s*(?::\s*([^=]+?))?\s*(?:=.*)?$", self.annotations(head)[1]):
                self.add("PROPERTY" if self.scopes[-1].row["element_type"] == "INTERFACE" else "FIELD", m[2], self.qualified(m[2]), start, return_type=m[3], visibility=next((w for w in m[1].split() if w in _PUBLIC), "public"))
        elif m := re.match(rf"(?:export\s+)?(?:const|let|var)\s+({_NAME})[^=]*=\s*(?:async\s*)?\((.*?)\)(?:\s*:\s*[^=]+)?\s*=>", head):
            self.callable("FUNCTION", m[1], self.qualified(m[1]), start, None, self.ts_params(m[2]), signature=head)
        elif m := re.match(rf"(?:export\s+)?type\s+({_NAME})", head):
            self.add("TYPE_ALIAS", m[1], self.qualified(m[1]), start)

    # -- C, C++

    def directive(self, start: int, end: int) -> None:
        if m := re.match(r'#\s*include\s*[<"]([^>"]+)', self.text[start:end]):
            self.rows.element("IMPORT", m[1], m[1], start, key=f"{self.rows.path}#include:{m[1]}")

    def open_c(self, head: str, start: int, brace: int) -> bool:
        cpp = self.language == "CPP"
        head = re.sub(r"^(?:public|private|protected)\s*:\s*", "", head)
        template = re.match(r"template\s*<(.*?)>\s*", head)
        head = head[template.end() :] if template else head
        if cpp and (m := re.match(rf"(?:inline\s+)?namespace\s+({_NAME}(?:::{_NAME})*)?$", head)):
            row = self.add("NAMESPACE", m[1] or "(anonymous)", self.qualified(m[1] or "(anonymous)"), start)
            self.push("namespace", m[1] or "(anonymous)", row, brace)
            return True
        if m := re.match(rf"(?:typedef\s+)?(struct|union|class|enum(?:\s+class)?)\s+({_NAME})?(?:\s+final)?\s*(?::\s*(.*))?$", head):
            kind = "ENUM" if m[1].startswith("enum") else "CLASS" if m[1] == "class" else "STRUCT"
            if kind == "CLASS" and re.search(r"\bvirtual\b[^;{]*=\s*0\s*;", self.code[brace : self.match_brace(brace)]):
                kind = "INTERFACE"
            name = m[2] or "(anonymous)"
            outer = "::".join(s.name for s in self.scopes if s.kind == "namespace")
            bases = [re.sub(r"\b(?:public|private|protected|virtual)\b|<.*", "", x).strip() for x in _split_args(m[3] or "")] if kind != "ENUM" else []
            row = self.type_row(kind, name, start, [f"{outer}::{b}" if outer and "::" not in b else b for b in bases], [], metadata={"kind": "union"} if m[1] == "union" else {"templateParams": template[1]} if template else None)
            self.push("type", name, row, brace)
            return True
        if m := re.match(rf"([\w:<>,*&\s~\[\]]*?)((?:{_NAME}::)*~?{_NAME})\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:const|noexcept|override|final|\s)*(?::.*)?$", head):
            if m[2] in _NOT_CALLS:
                return False
            params = [(re.sub(r"\W", "", p.split()[-1]) if len(p.split()) > 1 else "", " ".join(p.split()[:-1]) or p) for p in _split_args(m[3]) if p != "void"]
            inside = self.scopes[-1] if self.scopes and self.scopes[-1].kind == "type" else None
            kind = "CONSTRUCTOR" if inside and m[2] == inside.name else "METHOD" if inside or "::" in m[2] else "FUNCTION"
            qn = self.qualified(m[2], kind != "FUNCTION", [t for _, t in params])
            self.callable(kind, m[2].split("::")[-1], qn, start, brace, params, signature=head, return_type=m[1].strip() or None, metadata={"templateParams": template[1]} if template else None)
            return True
        return head.startswith('extern "C"') and not self.push("namespace", "", None, brace)

    def match_brace(self, at: int) -> int:
        depth = 0
        for m in re.compile(r"[{}]").finditer(self.code, at):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return m.start()
        return len(self.code)

    def say_c(self, head: str, start: int, end: int) -> None:
        head = re.sub(r"^(?:public|private|protected)\s*:\s*", "", head)
        inside = self.scopes[-1].row if self.scopes and self.scopes[-1].kind == "type" else None
        if m := re.match(rf"typedef\s+.*?({_NAME})$", head):
            self.add("TYPE_ALIAS", m[1], self.qualified(m[1]), start)
        elif inside and inside["element_type"] == "ENUM":
            if m := re.match(rf"({_NAME})", head):
                self.add("ENUM_CONSTANT", m[1], self.qualified(m[1]), start)
        elif inside and self.language == "CPP" and (m := re.match(rf"(?:virtual\s+)?([\w:<>,*&\s]*?)(~?{_NAME})\s*\(([^()]*)\)", head)):
            params = [(p.split()[-1], " ".join(p.split()[:-1]) or p) for p in _split_args(m[3])]
            kind = "CONSTRUCTOR" if m[2] == self.scopes[-1].name else "METHOD"
            self.callable(kind, m[2], self.qualified(m[2], True, [t for _, t in params]), start, None, params, signature=head, return_type=m[1].strip() or None)
        elif inside and (m := re.match(rf"([\w:<>,*&\s]+?)[\s*&]+({_NAME})(?:\[[^\]]*\])*(?:\s*=.*)?$", head)):
            self.add("FIELD", m[2], self.qualified(m[2]), start, return_type=m[1].strip())

    # -- comments

    def attach_comments(self) -> None:
        """A comment block that ends just above a declaration documents it; others stand alone."""
        blocks: list[list] = []
        for a, z, kind in self.comments:
            if blocks and kind != "COMMENT_BLOCK" and blocks[-1][2] == kind and not self.text[blocks[-1][1] : a].strip() and self.text.count("\n", blocks[-1][1], a) == 1 and self.text.startswith("//", a):
                blocks[-1][1] = z
            else:
                blocks.append([a, z, kind])
        starts = {r.get("_top", r["line_start"]): r for r in reversed(self.rows.elements) if r["element_type"] not in ("PARAMETER", "ANNOTATION", "DECORATOR", "ATTRIBUTE", "IMPORT")}
        mark = {"JAVA": "javadoc", "GO": "godoc", "RUST": "rustdoc"}.get(self.language, "doc")
        for a, z, kind in blocks:
            target = starts.get(self.rows.line(z) + 1)
            text = self.text[a:z]
            if target is not None and (kind == "COMMENT_DOC" or self.language == "GO"):
                row = self.rows.element("COMMENT_DOC", mark, f"{target['qualified_name']}#{mark}", a, parent=target, end=z)
                self.rows.edge(row["id"], "DOCUMENTS", target["id"])
                target["doc_comment"] = re.sub(r"(?m)^\s*(?:/\*+|\*+/|\*(?!/)|//[/!]?)\s?|\s*\*+/\s*$", "", text).strip()
            else:
                self.rows.element(kind, "comment", f"{self.rows.path}#comment@{self.rows.line(a)}", a, end=z)
