"""Markdown and configuration files into rows."""

from __future__ import annotations

import json
import re

from .rows import Rows, hashed_id

_README = re.compile(r"(?i)(?:^|/)readme\.(?:md|markdown)$")
_FQCN = re.compile(r"^(?:[a-z_][a-z0-9_]*\.)+[A-Z][A-Za-z0-9_$]*$")


def headings(text: str) -> list[tuple[int, int, str]]:
    """(line from 1, level, title): ATX and setext headings outside fenced code."""
    out, fence, closed, lines = [], None, -1, text.split("\n")
    for i, line in enumerate(lines):
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            closed = i
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
        elif mark:
            fence = mark[1]
        elif m := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line):
            out.append((i + 1, len(m[1]), (m[2] or "").strip()))
        elif i and closed != i - 1 and re.match(r" {0,3}(?:=+|-+)[ \t]*$", line) and lines[i - 1].strip() and not re.match(r" {0,3}(?:[#>*+-]|\d+[.)])", lines[i - 1]) and (not out or out[-1][0] != i):
            out.append((i, 1 if "=" in line else 2, lines[i - 1].strip()))
    return out


def parse_markdown(repo_id: str, path: str, text: str) -> Rows:
    """The document, its headings, the text below each up to the next, and their order."""
    rows, lines = Rows(repo_id, path, "MARKDOWN", text), text.split("\n")
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line) + 1)
    doc = rows.element("MARKDOWN_DOCUMENT", path.rpartition("/")[2], path, 0, end=len(text))
    doc["snippet"], doc["line_start"], doc["line_end"] = text, 1, len(lines)

    def section(first: int, last: int, name: str, key: str, above: dict) -> None:
        body = "\n".join(lines[first - 1 : last]).rstrip()
        if body.strip():
            row = rows.element("MARKDOWN_SECTION", name, f"{path}#{key}", at[first - 1], parent=above, end=at[first - 1] + len(body))
            row["snippet"], row["line_start"], row["line_end"] = body, first, last
            rows.edge(above["id"], "CONTAINS", row["id"])

    found = headings(text)
    end = len(lines) - (text.endswith("\n"))
    if not found or found[0][0] > 1:
        section(1, found[0][0] - 1 if found else end, "(preamble)" if found else "(content)", "preamble" if found else "content", doc)
    before = None
    for i, (line, level, title) in enumerate(found):
        row = rows.element("MARKDOWN_HEADING", title, f"{path}#heading:{title}@{line}", at[line - 1], parent=doc, metadata={"level": str(level)})
        rows.edge(doc["id"], "CONTAINS", row["id"])
        rows.edge(row["id"], "SECTION_OF", doc["id"])
        if before:
            rows.edge(before["id"], "PRECEDES", row["id"])
        before = row
        underlined = lines[line - 1].strip() == title and not lines[line - 1].lstrip().startswith("#")
        section(line + 1 + underlined, (found[i + 1][0] - 1) if i + 1 < len(found) else end, title, f"section:{title}@{line}", row)
    if _README.search(path):
        folder = path.rpartition("/")[0]
        rows.edge(doc["id"], "DOCUMENTS_DIR", hashed_id(repo_id, folder, "DIRECTORY", folder or "."))
    return rows


def leaves(value, path: str = ""):
    """(dotted path, text) of each leaf; lists count from [0]; empty objects and lists have none."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def is_class_name(text: str) -> bool:
    return bool(_FQCN.match(text))


def parse_config(repo_id: str, path: str, text: str) -> Rows:
    """The file and its leaves; one that can't be read raises, so that nothing of it is kept."""
    language = "JSON" if path.lower().endswith(".json") else "YAML"
    if language == "JSON":
        value = json.loads(text)
    else:
        import yaml

        value = yaml.safe_load(text)
    rows = Rows(repo_id, path, language, text)
    top = rows.element("CONFIG_FILE", path.rpartition("/")[2], path, 0, end=len(text))
    for where, leaf in leaves(value):
        row = rows.element("CONFIG_KEY", where, f"{path}#{where}", 0, parent=top)
        row["snippet"], row["line_start"], row["line_end"] = leaf, 0, 0
        rows.edge(top["id"], "CONTAINS", row["id"])
        if is_class_name(leaf):
            rows.edge_to(row, "REFERENCES_CLASS", "CLASS", leaf)
    return rows
