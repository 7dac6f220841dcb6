"""Exact hierarchy: a left-to-right fold over one document's lines, where a line's class depends on earlier ones.

Used where context decides (section numbers must rise, indents pick the unit that a line continues, titles are pending,
footnotes swallow indented lines). One group is one document; documents are spread over tasks, and the state is its open
path. The window path in ``hierarchy`` gives the same units wherever no such context is needed.

A table opens at a TABLE marker only (pipe or aligned lines without one are text of the open unit) and keeps every line
up to the next chapter, section, numeric bracket or marker: a row of kind ``table`` with the header as its text, then one
of kind ``table_row`` an item, its cells joined by ``|``. Two tables of one unit stay two. Rules of dashes
and markers are not text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import patterns as P

LEVELS = ("chapter", "section", "subsection", "clause", "sub_clause", "item", "sub_item")
SCHEMA = "doc_id {key}, place int, kind string, type string, number string, unit_id string, parent_id string, title string, text_before string, text_after string, page_start int, page_end int, line_start int, indent int, footnote_refs array<string>"

_RE = {n: re.compile(getattr(P, n)) for n in ("CHAPTER", "SECTION_START", "BRACKET", "EXPLANATION", "PROVISO", "ILLUSTRATION", "FOOTNOTE_START", "HEADING", "BOLD_LINE")}
_REFS = re.compile(r"(?i)^\s*(\d+[a-z]?)\s*\[\s*(?=\()")


class _Unit:
    def __init__(self, kind, number, line, parent, own_id, title=None):
        self.kind, self.number, self.parent, self.id, self.title = kind, number, parent, own_id, title
        self.before, self.after, self.has_child, self.refs = [], [], False, []
        self.page_start = self.page_end = line["page"]
        self.line, self.indent = line["line_no"], line["indent"]
        if parent is not None:
            parent.has_child = True

    def say(self, text, line):
        if text:
            (self.after if self.has_child else self.before).append(text)
        self.page_end = max(self.page_end, line["page"])


_ITEM = re.compile(r"^(?:\((\d+)\)|(\d+)\.)\s+(\S.*)$")
_BARE = re.compile(r"^\(?(\d+)\)?\.?$")


def _item(text: str) -> tuple[int | None, str]:
    """Number and body, as ``functions.text.item_number``."""
    if m := _ITEM.match(text):
        return int(m[1] or m[2]), m[3]
    m = _BARE.match(text)
    return (int(m[1]), "") if m else (None, text)


def _add(cells: list[str], more: list[str]) -> None:
    """Cell by cell, what is new behind what is there."""
    cells += [""] * (len(more) - len(cells))
    for i, cell in enumerate(more):
        cells[i] = f"{cells[i]} {cell}".strip()


class _Table:
    """Lines of one region, pipe and borderless ones apart, until rows() reads them."""

    def __init__(self, line, parent, own_id):
        self.parent, self.id, self.line, self.indent = parent, own_id, line["line_no"], line["indent"]
        self.page_start = self.page_end = line["page"]
        self.pipes, self.others, self.displaced = [], [], []
        self.last, self.heading, self.known = 0, None, set()

    def take(self, line, text):
        self.page_end, self.heading = max(self.page_end, line["page"]), None
        pipe = text.count("|") >= 2
        if pipe:
            cells = [re.sub(r"\s+", " ", c).strip() for c in text.split("|")]
            cells = cells[cells[0] == "" : len(cells) - (cells[-1] == "")]
            if cells and all(re.fullmatch(r":?-{3,}:?", c.replace(" ", "")) for c in cells):
                return
        else:
            cells = [re.sub(r"\s+", " ", c) for c in re.split(r"\s{2,}", text)]
        number, body = _item(cells[0]) if cells else (None, "")
        if number is not None:
            cells[0], self.last = body, number
            if not pipe and not body:
                del cells[0]
        elif not pipe and (line["heading_level"] or line["bold"]):
            self.heading = text
        (self.pipes if pipe else self.others).append((number, cells))

    def without_heading(self):
        """The heading that was the last line, taken back: it is the title of the section that follows."""
        self.others.pop()
        return self.heading

    @staticmethod
    def _read(lines):
        """Header cells, (number, cells) rows and whether the numbers are the table's own; without any, lines after the first are counted."""
        header, rows = [], []
        if not any(n is not None for n, _ in lines):
            return (lines[0][1] if lines else []), [(i, c) for i, (_, c) in enumerate(lines[1:], 1)], False
        for number, cells in lines:
            if number is not None:
                rows.append((number, list(cells)))
            else:
                _add(rows[-1][1] if rows else header, cells)
        return header, rows, True

    def rows(self):
        """Header cells and (number, cells) by number: borderless rows join the pipe row of their number."""
        header, rows, own = self._read(self.pipes)
        more_header, more, also = self._read(self.others)
        at = {number: cells for number, cells in reversed(rows)} if own and also else {}
        for number, cells in more:
            cells = ["", *cells] if also else cells  # the column of the number
            if number in at:
                _add(at[number], cells)
            else:
                rows.append((number, cells))
        return [*header, *more_header], sorted(rows + self.displaced, key=lambda r: r[0])

    def recovered(self, number):
        """Cells of a row to be filled, if the closed table lacks the number."""
        self.known = self.known or {n for n, _ in self.rows()[1]}
        if number in self.known:
            return None
        self.known.add(number)
        self.displaced.append((number, []))
        return self.displaced[-1][1]


class Parser:
    """State of one document. levels: 6 or 7 (with sub_item)."""

    def __init__(self, levels: int = 6):
        self.levels = LEVELS[:levels]
        self.open: dict[str, _Unit] = {}
        self.units: list[_Unit] = []
        self.notes: list[_Unit] = []
        self.orphans: list[tuple] = []
        self.title, self.note, self.special = None, None, {}
        self.tables: list[_Table] = []
        self.table: _Table | None = None  # open
        self.last_table: _Table | None = None  # of the open section
        self.displaced: list | None = None  # cells of a row that comes after its table
        self.listed = False

    def kind_of(self, token: str, indent: int) -> str:
        if token.isdigit():
            return "subsection"
        clause, item = self.open.get("clause"), self.open.get("item")
        if "sub_item" in self.levels and item and token in P.UPPER_ROMAN:
            return "sub_item"
        if token in P.LOWER_ROMAN and not (clause and len(token) == len(clause.number) == 1 and ord(token) == ord(clause.number) + 1):
            return "sub_clause"
        if token.islower():
            return "item" if item and indent >= item.indent > (clause.indent if clause else -1) else "clause"
        return "item"

    def start(self, kind: str, number: str, line: dict, title=None) -> _Unit:
        at = self.levels.index(kind)
        parent = next((self.open[lv] for lv in reversed(self.levels[:at]) if lv in self.open), None)
        path = [self.open[lv].number for lv in self.levels[1:at] if lv in self.open]
        unit = _Unit(kind, number, line, parent, f"chapter-{number}" if kind == "chapter" else "-".join([*path, number]), title)
        for lv in self.levels[at:]:
            self.open.pop(lv, None)
        self.open[kind] = unit
        self.units.append(unit)
        return unit

    def deepest(self):
        return next((self.open[lv] for lv in reversed(self.levels) if lv in self.open), None)

    def continued(self, indent: int):
        path = [self.open[lv] for lv in reversed(self.levels) if lv in self.open]
        return next((u for u in path if u.indent <= indent), path[-1] if path else None)

    def is_section(self, number: str, rest: str, line: dict) -> bool:
        if line["list_item"] or not (rest or self.title):
            return False
        section = self.open.get("section")
        value = int(re.match(r"\d+", number)[0])
        if section and not self.title and value <= int(re.match(r"\d+", section.number)[0]):
            return False
        if "subsection" in self.open:
            return bool(line["bold"] or self.title or rest.startswith("("))
        return True

    def start_table(self, line: dict) -> _Table:
        parent = self.deepest()
        of = parent.id if parent else "table"
        n = self.special[of, "table"] = self.special.get((of, "table"), 0) + 1
        self.tables.append(_Table(line, parent, f"{of}-table-{n}"))
        return self.tables[-1]

    def ends_table(self, text: str, line: dict) -> bool:
        """A chapter, a numeric bracket or a section. A plain line that bears the table's next number is its row."""
        if _RE["CHAPTER"].match(text) or re.match(r"^\[?\(\s*\d+\s*\)", text):
            return True
        m, table, section = _RE["SECTION_START"].match(text), self.table, self.open.get("section")
        if not m or not m[2] or line["list_item"] or text.count("|") >= 2 or re.search(r"^\d+[A-Z]?\.\s{2,}|\S\s{3,}\S", text):
            return False
        value, marked = int(re.match(r"\d+", m[1])[0]), bool(line["bold"] or table.heading)
        if section and value <= int(re.match(r"\d+", section.number)[0]):
            return False
        if m[2].startswith("("):
            return True
        if value == table.last + 1 and not (table.last and marked):
            return False
        return marked or (bool(section or table.pipes or table.others) and "subsection" not in self.open)

    def recovers(self, text: str, line: dict) -> bool:
        """A bare ``n.`` after a table that lacks n, and the lines up to the next unit (one list item among them), are its row."""
        if self.displaced is not None:
            item, first = line["list_item"], not self.listed
            unit = not item and (_RE["CHAPTER"].match(text) or _RE["SECTION_START"].match(text) or re.match(r"^\s*\[?\(\s*\d+\s*\)", text))
            if not unit and (first or not item):
                self.listed = self.listed or item
                _add(self.displaced, [text])
                return True
            self.displaced = None
        m = re.fullmatch(r"(\d+)\.", text)
        self.displaced = self.last_table.recovered(int(m[1])) if m and self.last_table else None
        self.listed = False
        return self.displaced is not None

    def feed(self, line: dict) -> None:
        text = line["text"].strip()
        if not text or text in P.BANNERS or re.fullmatch(r"-{3,}", text):
            if text in P.BANNERS:
                self.displaced = None
            return
        if m := _RE["FOOTNOTE_START"].match(text):
            self.note = _Unit("footnote", m[1], line, None, m[1])
            self.note.before.append(m[2])
            self.notes.append(self.note)
            return
        if self.note and line["indent"] > self.note.indent:
            self.note.say(text, line)
            return
        self.note = None
        if re.sub(r"[|*_\s]", "", text).upper() == "TABLE":
            self.table, self.displaced = self.start_table(line), None
            self.last_table = self.table
            return
        if self.table and not self.ends_table(text, line):
            self.table.take(line, text)
            return
        if self.table and self.table.heading and _RE["SECTION_START"].match(text):
            self.title = self.table.without_heading()
        self.table = None
        if self.recovers(text, line):
            return
        if m := _RE["CHAPTER"].match(text):
            self.start("chapter", m[1], line, m[2])
            self.last_table = None
            return
        if (m := _RE["SECTION_START"].match(text)) and self.is_section(m[1], m[2], line):
            self.start("section", m[1], line, self.title)
            self.title = self.last_table = None
            self.tokens(m[2], line)
            return
        if line["heading_level"] or line["bold"]:
            self.title = re.sub(r"^#+\s+|^\*\*|\*\*$", "", text)
            return
        for name in ("EXPLANATION", "PROVISO", "ILLUSTRATION"):
            if m := _RE[name].match(text):
                parent, kind = self.deepest(), name.lower()
                n = self.special[parent.id if parent else "", kind] = self.special.get((parent.id if parent else "", kind), 0) + 1
                block = _Unit(kind, str(n), line, parent, "-".join([*([parent.id] if parent else []), kind, str(n)]))
                block.before.append(m[2])
                self.units.append(block)
                return
        if _REFS.match(text) or _RE["BRACKET"].match(text):
            self.tokens(text, line)
            return
        target = self.continued(line["indent"])
        if target:
            target.say(text, line)
        else:
            self.orphans.append((line["page"], line["line_no"], text))

    def tokens(self, text: str, line: dict) -> None:
        refs = []
        while m := _REFS.match(text):
            refs.append(m[1])
            text = text[m.end() :]
        if refs:
            text = re.sub(r"\]$", "", text.rstrip())
        unit = None
        while m := _RE["BRACKET"].match(text):
            unit = self.start(self.kind_of(m[1], line["indent"]), m[1], line)
            unit.refs, refs = unit.refs + refs, []
            text = text[m.end() :]
        (unit or self.deepest()).say(text.strip(), line) if unit or self.deepest() else self.orphans.append((line["page"], line["line_no"], text))

    def rows(self, key):
        tidy = lambda parts: re.sub(r"\s+", " ", " ".join(parts)).strip()
        out = []
        for kind, units in (("unit", self.units), ("footnote", self.notes)):
            for u in units:
                out.append((key, len(out), kind, u.kind, u.number, u.id, u.parent.id if u.parent else None, u.title, tidy(u.before), tidy(u.after), u.page_start, u.page_end, u.line, u.indent, u.refs))
        for t in self.tables:
            header, rows = t.rows()
            out.append((key, len(out), "table", "table", None, t.id, t.parent.id if t.parent else None, None, "|".join(header), "", t.page_start, t.page_end, t.line, t.indent, []))
            for i, (number, cells) in enumerate(rows, 1):
                out.append((key, len(out), "table_row", "row", str(number), f"{t.id}-row-{i}", t.id, None, "|".join(cells), "", t.page_start, t.page_end, t.line, t.indent, []))
        for page, line, text in self.orphans:
            out.append((key, len(out), "orphan", None, None, None, None, None, text, "", page, page, line, 0, []))
        return out


def folded(lines: DataFrame, make, schema: str, order: list[str]) -> DataFrame:
    """Rows of a parser (feed a line, then rows(key)) over each document's lines in that order.

    Documents are dealt by id and streamed, so a task holds one document's state at a time. A document whose lines the
    parser cannot take gives one row of kind ``error`` with the message as its text, and the others go on.
    """
    kind = lines.schema["doc_id"].dataType.simpleString()
    schema = schema.replace("{key}", kind)
    names, kinds = zip(*(part.split() for part in schema.split(", ")))
    own = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parser, failed, rows, types = None, None, None, [], None

        def ended():
            if failed is None:
                try:
                    return parser.rows(key)
                except Exception as e:  # noqa: BLE001  one bad document must not fail the others
                    return [told(e)]
            return [told(failed)]

        def told(e):
            return tuple({"doc_id": key, "place": 0, "kind": "error", "text_before": f"{type(e).__name__}: {e}"}.get(n) for n in names)

        for batch in batches:
            types = types or pa.schema([pa.field(n, batch.schema.field("doc_id").type if n == "doc_id" else own[k]) for n, k in zip(names, kinds)])
            for line in batch.to_pylist():
                if parser is None or line["doc_id"] != key:
                    if parser is not None:
                        rows += ended()
                    key, parser, failed = line["doc_id"], make(), None
                if failed is None:
                    try:
                        parser.feed(line)
                    except Exception as e:  # noqa: BLE001
                        failed = e
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=types)
                rows = []
        if parser is not None:
            rows += ended()
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=types)

    return lines.repartition("doc_id").sortWithinPartitions("doc_id", *order).mapInArrow(run, schema)


def parsed(lines: DataFrame, levels: int = 6) -> DataFrame:
    """lines (doc_id, page, line_no, indent, heading_level, bold, list_item, text) to units, footnotes, tables with their rows, and orphans; a document that fails gives one row of kind error."""
    own = lines.select("doc_id", "page", "line_no", "indent", "heading_level", "bold", "list_item", "text")
    return folded(own, lambda: Parser(levels), SCHEMA, ["line_no"])
