"""Exact hierarchy of positioned text: lines with a place on a page, where the left edge tells what a line is.

The fold of one document, as in ``fold``: a section starts at the left margin, a bracket opens a level by its form alone
(no context), a line without a number belongs to the deepest open unit whose left edge it reaches, and a table takes what
stands below its heading on the same page. Cells of a table find their column by the nearest anchor.

Lines come in order of page, height and left edge; of equal ones the earlier line first. A footnote takes indented lines
until a line at the margin or a new page; explanations, provisos and illustrations have ids of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions import patterns as P
from .fold import folded

LEVELS = ("section", "subsection", "clause", "sub_clause", "item")
SCHEMA = "doc_id {key}, place int, kind string, type string, number string, unit_id string, parent_id string, title string, text_before string, text_after string, page_start int, page_end int, x double, y double"
#: Left edges in points: of sections, of what follows a table and of titles, of footnotes; and how far a line may miss an edge.
MARGIN, BODY, NOTE, SLACK = 30.5, 45.0, 35.0, 2.5
#: Height of a table below its heading, step of visual rows, distance that makes a new column.
TABLE_HEIGHT, ROW_STEP, COLUMN_GAP = 260.0, 4, 55.0

_RE = {n: re.compile(getattr(P, n)) for n in ("CHAPTER", "SECTION_START", "BRACKET", "EXPLANATION", "PROVISO", "ILLUSTRATION", "FOOTNOTE_START", "PARENT_BRIDGE")}
_SPECIAL = (("explanation", _RE["EXPLANATION"]), ("proviso", _RE["PROVISO"]), ("illustration", _RE["ILLUSTRATION"]))
_SERIAL = re.compile(r"(?i)^Sl\.\s*No\.?\b")
_NUMERIC = re.compile(r"^\[?\(\d+\)\s+")
_ITEM = re.compile(r"^(?:\((\d+)\)|(\d+)\.)\s*(.*)$")


def tidy(*parts: str) -> str:
    return re.sub(r"\s+", " ", " ".join(p for p in parts if p)).strip()


def item_of(text: str) -> tuple[int | None, str]:
    """Item number and what follows it; a number without dot or parentheses is text."""
    m = _ITEM.match(text.strip())
    return (int(m[1] or m[2]), m[3].strip()) if m else (None, text.strip())


def anchors_of(edges: list[float]) -> list[float]:
    """Column anchors: sorted left edges, each within the gap moving the last anchor half-way to itself."""
    found: list[float] = []
    for x in sorted(edges):
        if found and x - found[-1] <= COLUMN_GAP:
            found[-1] = (found[-1] + x) / 2
        else:
            found.append(x)
    return found


def grid(lines: list[dict]) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """Header cells and (number, cells) of a table's lines. Columns come from the rows that bear a number, if any do."""
    rows: dict[tuple, list[dict]] = {}
    for line in lines:
        rows.setdefault((line["page"], round(line["y"] / ROW_STEP) * ROW_STEP), []).append(line)
    visual = [sorted(rows[k], key=lambda line: line["x"]) for k in sorted(rows)]
    numbered = [row for row in visual if any(item_of(line["text"])[0] is not None for line in row)]
    anchors = anchors_of([line["x"] for row in numbered or visual for line in row])
    header, body = [""] * len(anchors), []
    for row in visual:
        cells, number = [""] * len(anchors), None
        for line in row:
            at = min(range(len(anchors)), key=lambda i: abs(line["x"] - anchors[i]))
            item, rest = item_of(line["text"])
            own = item is not None and number in (None, item)
            number = item if own else number
            cells[at] = tidy(cells[at], rest if own else line["text"])
        if number is not None:
            body.append((number, cells))
        elif body:
            body[-1][1][:] = [tidy(a, b) for a, b in zip(body[-1][1], cells)]
        else:
            header = [tidy(a, re.sub(r"^\(([A-Z])\)$", r"[\1]", b)) for a, b in zip(header, cells)]
    return header, body


class Node:
    def __init__(self, kind: str, number: str | None, line: dict, parent: Node | None, own_id: str, title: str | None = None):
        self.kind, self.number, self.parent, self.id, self.title = kind, number, parent, own_id, title
        self.before, self.after, self.has_child, self.tables = "", "", False, 0
        self.x, self.y, self.first, self.last = line["x"], line["y"], line["page"], line["page"]
        if parent is not None:
            parent.has_child = True

    def say(self, text: str, line: dict) -> None:
        if text.strip():
            if self.has_child:
                self.after = tidy(self.after, text)
            else:
                self.before = tidy(self.before, text)
            self.last = line["page"]


class Table:
    """The lines below a heading; ``TABLE`` is a heading only, ``Sl. No.`` is the first line too."""

    def __init__(self, line: dict, parent: Node | None, own_id: str):
        self.parent, self.id, self.head = parent, own_id, line
        self.marked = line["text"].strip().upper() == "TABLE"
        self.lines = [] if self.marked else [line]

    def ends(self, line: dict, starts_body: bool) -> bool:
        text = line["text"].strip()
        if line["page"] != self.head["page"] or line["y"] > self.head["y"] + TABLE_HEIGHT:
            return True
        if _NUMERIC.match(text):
            numbered = any(item_of(row["text"])[0] is not None for row in self.lines)
            at_margin = line["x"] <= MARGIN
            if not self.marked and self.lines and at_margin:
                return True
            if self.marked and numbered and self.parent is not None and self.parent.kind == "subsection" and abs(line["x"] - self.parent.x) <= SLACK:
                return True
            if self.marked and numbered and at_margin and any(_SERIAL.match(row["text"].strip()) for row in self.lines):
                return True
        return bool(self.lines) and starts_body

    def linearized(self, header: list[str], rows: list[tuple[int, list[str]]]) -> str:
        """One sentence a row, behind the unit that the table belongs to."""
        of = self.parent
        said = [f"{of.kind.replace('_', ' ').title()} ({of.number or ''}): {tidy(of.before, of.after)}" if of else "Table", *(["Table items:"] if rows else [])]
        for number, cells in rows:
            named = [f"{name or f'column_{chr(65 + i)}'}: {cell}" for i, (name, cell) in enumerate(zip(header, cells)) if cell]
            said.append(f"Item {number} — {'; '.join(named)}.")
        return tidy(*said)


class PositionedParser:
    """State of one document."""

    def __init__(self):
        self.chapter: Node | None = None
        self.open: dict[str, Node] = {}
        self.units: list[Node] = []
        self.notes: list[Node] = []
        self.tables: list[Table] = []
        self.orphans: list[dict] = []
        self.counts: dict[tuple, int] = {}
        self.title: str | None = None
        self.note: Node | None = None
        self.table: Table | None = None

    def deepest(self) -> Node | None:
        return next((self.open[level] for level in reversed(LEVELS) if level in self.open), self.chapter)

    def start(self, kind: str, number: str, line: dict, title: str | None = None) -> Node:
        at = LEVELS.index(kind)
        path = [self.open[level] for level in LEVELS[:at] if level in self.open]
        node = Node(kind, number, line, path[-1] if path else self.chapter, "-".join([*(n.number for n in path), number]), title)
        for level in LEVELS[at:]:
            self.open.pop(level, None)
        self.open[kind] = node
        self.units.append(node)
        return node

    def count(self, *what) -> int:
        self.counts[what] = self.counts.get(what, 0) + 1
        return self.counts[what]

    @staticmethod
    def kind_of(token: str) -> str:
        return "subsection" if token.isdigit() else "sub_clause" if token in P.LOWER_ROMAN else "clause" if token.islower() else "item"

    def continued(self, line: dict) -> Node | None:
        path = [self.open[level] for level in reversed(LEVELS) if level in self.open]
        if not path:
            return self.chapter
        if _RE["PARENT_BRIDGE"].match(line["text"].strip()) and "clause" in self.open:
            return self.open["clause"]
        return next((n for n in path if line["x"] + SLACK >= n.x), path[-1])

    @staticmethod
    def is_section(line: dict) -> bool:
        return line["x"] <= MARGIN and bool(_RE["SECTION_START"].match(line["text"].strip()))

    def starts_body(self, line: dict) -> bool:
        text = line["text"].strip()
        return self.is_section(line) or (line["x"] <= BODY and bool(re.match(r"^\([a-z]\)\s+", text))) or any(r.match(text) for _, r in _SPECIAL)

    def feed(self, line: dict) -> None:
        text = line["text"].strip()
        furniture = not text or text in P.BANNERS or (re.fullmatch(r"\d+", text) and line["font"] <= 7.5)
        if self.table is not None:
            if self.table.ends(line, self.starts_body(line)):
                self.table = None
            else:
                if not furniture:
                    self.table.lines.append(line)
                return
        if furniture:
            return
        if (m := _RE["FOOTNOTE_START"].match(text)) and line["x"] <= NOTE:
            self.note = Node("footnote", m[1], line, None, m[1])
            self.note.say(m[2], line)
            self.notes.append(self.note)
            return
        if self.note is not None and line["x"] >= NOTE and line["page"] == self.note.last:
            self.note.say(text, line)
            return
        self.note = None
        if text.upper() == "TABLE" or _SERIAL.match(text):
            parent = self.deepest()
            self.table = Table(line, parent, f"{parent.id if parent else 'table'}-table-{self.count(parent, 'table')}")
            self.tables.append(self.table)
        elif m := _RE["CHAPTER"].match(text):
            self.chapter, self.open = Node("chapter", m[1], line, None, f"chapter-{m[1]}", tidy(m[2] or "") or None), {}
            self.units.append(self.chapter)
        elif self.is_section(line):
            m = _RE["SECTION_START"].match(text)
            self.start("section", m[1], line, self.title)
            self.title = None
            self.tokens(m[2], line)
        elif line["bold"] and line["x"] <= BODY and not _RE["BRACKET"].match(text):
            self.title = tidy(text)
        elif found := next(((kind, m) for kind, r in _SPECIAL if (m := r.match(text)) and self.open), None):
            kind, m = found
            parent = self.deepest()
            n = str(self.count(parent, kind))
            block = Node(kind, n, line, parent, f"{parent.id}-{kind}-{n}")
            block.say(m[2], line)
            self.units.append(block)
        elif _RE["BRACKET"].match(text) and self.open:
            self.tokens(text, line)
        elif (target := self.continued(line)) is not None:
            target.say(text, line)
        else:
            self.orphans.append(line)

    def tokens(self, text: str, line: dict) -> None:
        """Open a level for each leading bracket; what is left is the text of the deepest."""
        while m := _RE["BRACKET"].match(text):
            self.start(self.kind_of(m[1]), m[1], line)
            text = text[m.end() :]
        self.deepest().say(text, line)

    def rows(self, key) -> list[tuple]:
        out: list[tuple] = []
        for kind, nodes in (("unit", self.units), ("footnote", self.notes)):
            for n in nodes:
                out.append((key, len(out), kind, n.kind, n.number, n.id, n.parent.id if n.parent else None, n.title, n.before, n.after, n.first, n.last, n.x, n.y))
        for t in self.tables:
            header, rows = grid(t.lines)
            page, x, y = t.head["page"], t.head["x"], t.head["y"]
            title = "TABLE" if t.marked else t.head["text"].strip()
            out.append((key, len(out), "table", "table", None, t.id, t.parent.id if t.parent else None, title, "|".join(header), t.linearized(header, rows), page, page, x, y))
            for i, (number, cells) in enumerate(rows, 1):
                out.append((key, len(out), "table_row", "row", str(number), f"{t.id}-row-{i}", t.id, None, "|".join(cells), "", page, page, x, y))
        for line in self.orphans:
            out.append((key, len(out), "orphan", None, None, None, None, None, line["text"].strip(), "", line["page"], line["page"], line["x"], line["y"]))
        return out


def parsed_positioned(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, line_no, x, y, font, bold, text) to units, footnotes, tables with their rows, and orphans; a document that fails gives one row of kind error."""
    return folded(lines.select("doc_id", "page", "line_no", "x", "y", "font", "bold", "text"), PositionedParser, SCHEMA, ["page", "y", "x", "line_no"])
