"""Rows of one parsed file: elements with ids, and edges between them."""

from __future__ import annotations

import bisect
import hashlib
import re

SNIPPET_LINES = 100


def hashed_id(repo_id: str, path: str, element_type: str, qualified_name: str) -> str:
    return hashlib.sha256(f"{repo_id}|{path}|{element_type}|{qualified_name}".encode()).hexdigest()[:32]


def truncate(snippet: str) -> str:
    lines = snippet.split("\n")
    return snippet if len(lines) <= SNIPPET_LINES else "\n".join(lines[:SNIPPET_LINES]) + "\n// ... (truncated)"


class Rows:
    def __init__(self, repo_id: str, path: str, language: str, text: str):
        self.repo_id, self.path, self.language, self.text = repo_id, path, language, text
        self.elements: list[dict] = []
        self.edges: dict[tuple[str, str, str], None] = {}
        self._lines = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        """From 1."""
        return bisect.bisect_left(self._lines, at) + 1

    def column(self, at: int) -> int:
        n = bisect.bisect_left(self._lines, at)
        return at - (self._lines[n - 1] + 1 if n else 0) + 1

    def id_of(self, element_type: str, qualified_name: str) -> str:
        return hashed_id(self.repo_id, self.path, element_type, qualified_name)

    def element(self, element_type: str, name: str, qualified_name: str, start: int, parent: dict | None = None, end: int | None = None, key: str | None = None, **more) -> dict:
        """``key``: the name that the id is made of, where it isn't the qualified name."""
        row = {
            "id": self.id_of(element_type, key or qualified_name), "repo_id": self.repo_id, "element_type": element_type, "language": self.language, "name": name, "qualified_name": qualified_name,
            "file_path": self.path, "line_start": self.line(start), "line_end": 0, "col_start": self.column(start), "col_end": 0, "parent_id": parent["id"] if parent else None, "_at": start,
        } | more
        self.elements.append(row)
        if end is None:
            end = self.text.find("\n", start)
            end = len(self.text) if end < 0 else end
        self.end(row, end)
        return row

    def end(self, row: dict, at: int) -> None:
        row["line_end"], row["col_end"] = self.line(max(at - 1, 0)), self.column(max(at - 1, 0))
        row["snippet"] = truncate(self.text[row["_at"] : at].strip())

    def edge(self, from_id: str, edge_type: str, to_id: str) -> None:
        self.edges[from_id, edge_type, to_id] = None

    def edge_to(self, row: dict, edge_type: str, target_type: str, name: str) -> None:
        """To the id that an element of that name in this file would have; it may stand for one elsewhere."""
        self.edge(row["id"], edge_type, self.id_of(target_type, name))
