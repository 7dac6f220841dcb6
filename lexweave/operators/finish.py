"""Finished documents: parsed rows of a document as one nested JSON with typed children.

A unit with children keeps its text before and after them under names of its foremost kind of child
(``text_before_clauses``, ``text_after_clauses``) and each kind of child under its plural; a unit without any has ``text``
and no children. Tables stand under the unit they belong to, the first as ``table`` and further ones in ``tables``, or
among ``orphan_tables``. Footnotes carry the units that refer to them, and ``footnote_reference_map`` lists those by number.
A section of a chapter stands there only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLURALS = {"subsection": "subsections", "clause": "clauses", "sub_clause": "sub_clauses", "item": "items", "sub_item": "sub_items", "section": "sections", "explanation": "explanations", "proviso": "provisos", "illustration": "illustrations"}
FOREMOST = ("subsection", "clause", "sub_clause", "item", "sub_item", "section")


def _said(*parts: str | None) -> str:
    return " ".join(p for p in parts if p)


def _children(unit: dict, inside: list[dict], nested: dict[int, dict]) -> dict:
    """The unit with its finished children, by kind."""
    out = {k: unit[k] for k in ("type", "number", "id", "title", "indent", "line_start", "page_start", "page_end", "footnote_refs") if unit.get(k) not in (None, [])}
    if inside:
        kinds = [c["type"] for c in inside]
        named = PLURALS[next((k for k in FOREMOST if k in kinds), kinds[0])]
        out[f"text_before_{named}"] = unit["text_before"] or ""
        for child in inside:
            out.setdefault(PLURALS[child["type"]], []).append(nested[child["place"]])
        out[f"text_after_{named}"] = unit["text_after"] or ""
    else:
        text = _said(unit["text_before"], unit["text_after"])
        if text or unit["type"] not in ("section", "chapter"):
            out["text"] = text
        out["children"] = []
    return out


def _table(head: dict, rows: list[dict]) -> dict:
    columns = head["text_before"].split("|") if head["text_before"] else []
    cells = [{"item_no": int(r["number"]), **{f"column_{i}": c for i, c in enumerate(r["text_before"].split("|"))}} for r in rows]
    out = {"type": "table", "table_id": head["id"], "title": head["title"] or "TABLE", "page_start": head["page_start"], "page_end": head["page_end"], "columns": columns, "rows": cells}
    return out | ({"linearized_text": head["text_after"]} if head["text_after"] else {})


def finished(rows: list[dict]) -> dict:
    """One document from its parsed rows in order of place. Ids may repeat (an amended text may hold a section twice); a
    child belongs to the last unit of its parent's id before it."""
    units = [r for r in rows if r["kind"] == "unit"]
    inside, top, last = {u["place"]: [] for u in units}, [], {}
    for u in units:
        above = last.get(u["parent_id"])
        (inside[above["place"]] if above is not None else top).append(u)
        last[u["id"]] = u
    nested: dict[int, dict] = {}
    for u in reversed(units):  # children come after their parents
        nested[u["place"]] = _children(u, inside[u["place"]], nested)
    doc = {"chapters": [nested[u["place"]] for u in top if u["type"] == "chapter"], "sections": [nested[u["place"]] for u in top if u["type"] == "section"], "footnotes": [], "orphans": []}
    if loose := [nested[u["place"]] for u in top if u["type"] not in ("chapter", "section")]:
        doc["loose_units"] = loose
    links: dict[str, list[str]] = {}
    for u in units:
        for ref in u.get("footnote_refs") or []:
            links.setdefault(ref, []).append(u["id"])
    body: dict[str, list[dict]] = {}
    for r in rows:
        if r["kind"] == "table_row":
            body.setdefault(r["parent_id"], []).append(r)
        elif r["kind"] == "footnote":
            note = {k: r[k] for k in ("type", "number", "page_start", "page_end")} | {"text": _said(r["text_before"], r["text_after"])}
            doc["footnotes"].append(note | ({"referenced_by": links[r["number"]]} if r["number"] in links else {}))
        elif r["kind"] == "orphan":
            doc["orphans"].append({"page": r["page_start"], "line": r.get("line_start"), "text": r["text_before"]})
        elif r["kind"] == "error":
            doc["error"] = r["text_before"]
    for r in rows:
        if r["kind"] == "table":
            table, unit = _table(r, body.get(r["id"], [])), last.get(r["parent_id"])
            if unit is None:
                doc.setdefault("orphan_tables", []).append(table)
            elif "table" not in nested[unit["place"]]:
                nested[unit["place"]]["table"] = table
            else:
                nested[unit["place"]].setdefault("tables", []).append(table)
    if links:
        doc["footnote_reference_map"] = links
    return doc


def document_json(parsed: DataFrame, indent: int | None = None) -> DataFrame:
    """(doc_id, json) of the rows of either parser; a document's rows meet in one task, as they came from one."""
    names = [c for c in parsed.columns if c != "doc_id"]
    of = F.struct(*names)
    gathered = parsed.groupBy("doc_id").agg(F.array_sort(F.collect_list(of)).alias("rows"))  # place comes first
    kind = parsed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [json.dumps(finished([r | {"id": r["unit_id"]} for r in rows]), ensure_ascii=False, indent=indent) for rows in batch.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "json"])

    return gathered.mapInArrow(run, f"doc_id {kind}, json string")
