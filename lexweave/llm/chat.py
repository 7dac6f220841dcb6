"""Chat formatting by schema fingerprints.

A record is a JSON object in any known layout. Those paths of its nested fields (arrays as ``[]``) that some layout knows,
sorted and hashed, are its fingerprint, which selects a declarative mapping from layout to canonical (role, text) turns;
other fields change nothing. Turns are written in one template whose control strings cannot occur inside a role or text, because those are escaped reversibly:

    <|im_start|>role\\ntext<|im_end|>\\n      with \\ as \\\\, "<|" as "<\\|", and in roles a newline as "\\n"

The loss mask is the list of spans of assistant texts in the written string. parse() reads all back from the string.

Defined cases: a null or missing text or role is empty; a record that lacks a path of every layout, or that is no JSON
object, keeps its row with a null string and its fingerprint; of several layouts that a record fits the first counts;
turns are ordered by turn, then role, then text, null first; repeated rows are turns each; a row with a null conv_id is a
conversation of its own, so such rows meet in no task; a conversation is one string, however long its texts; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"

#: Layouts: either the list of turns with its role and text fields, or turns of one field each (those in the second
#: place of a turn are needed, those in the third may be missing; a turn of none is left out).
LAYOUTS: list[dict] = [
    {"list": "turns", "role": "role", "text": "text"},
    {"list": "messages", "role": "role", "text": "content"},
    {"list": "conversations", "role": "from", "text": "value"},
    {"fields": [("system", (), ("system",)), ("user", ("instruction",), ("input",)), ("assistant", ("output",), ())]},
    {"fields": [("system", (), ("system",)), ("user", ("prompt",), ()), ("assistant", ("response",), ())]},
    {"fields": [("system", (), ("system",)), ("user", ("prompt",), ()), ("assistant", ("completion",), ())]},
    {"fields": [("system", (), ("system",)), ("user", ("question",), ()), ("assistant", ("answer",), ())]},
]
#: Names of roles that other layouts use.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value, prefix: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else {prefix}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value)) if value else {f"{prefix}[]"}
    return {prefix}


def fingerprint(paths) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths))) - (1 << 63)


def _needs(how: dict) -> list[set[str]]:
    """The sets of paths of which a record holds one at least to have the layout."""
    if "list" in how:
        return [{f"{how['list']}[].{how[k]}" for k in ("role", "text")}, {f"{how['list']}[]"}]
    return [{f for _, needed, _ in how["fields"] for f in needed}]


KNOWN = {p for how in LAYOUTS for need in _needs(how) for p in need} | {f for how in LAYOUTS for *_, more in how.get("fields", ()) for f in more}


def known_paths(record: dict) -> set[str]:
    """Known paths that the record holds, as values or with something inside."""
    held = field_paths(record)
    return {k for k in KNOWN if any(p == k or (not k.endswith("[]") and p.startswith((f"{k}.", f"{k}["))) for p in held)}


_MAPPINGS: dict[int, dict | None] = {}


def mapping(paths: set[str]) -> dict | None:
    """The layout that a fingerprint selects: the first whose needed paths are all there."""
    mark = fingerprint(paths)
    if mark not in _MAPPINGS:
        _MAPPINGS[mark] = next((how for how in LAYOUTS if any(need <= paths for need in _needs(how))), None)
    return _MAPPINGS[mark]


def canonical(record: dict, how: dict) -> list[tuple[str, str]]:
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)
    if "list" in how:
        named = [(text(t.get(how["role"])), text(t.get(how["text"]))) if isinstance(t, dict) else ("", text(t)) for t in record[how["list"]]]
        return [(ROLES.get(role, role), said) for role, said in named] if how["list"] == "conversations" else named
    return [(role, "\n\n".join(x for x in (text(record.get(f)) for f in (*needed, *more)) if x)) for role, needed, more in how["fields"] if needed or any(f in record for f in more)]


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: m[1], text, flags=re.S) if "\\" in text else text


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S) if "\\" in role else role


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The written string and its loss spans, in code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{_escape_role(role)}\n", escape(text)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), spans


def parse(written: str) -> list[tuple[str, str]]:
    """The turns of a written string."""
    turns, at = [], 0
    while at < len(written):
        if not written.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        end_of_role = written.index("\n", at)
        end = written.index(CLOSE, end_of_role)
        turns.append((_unescape_role(written[at + len(OPEN) : end_of_role]), unescape(written[end_of_role + 1 : end])))
        at = end + len(CLOSE) + 1
    return turns


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, raw in zip(batch.column("conv_id").to_pylist(), batch.column("record").to_pylist()):
            try:
                record = json.loads(raw) if raw is not None else None
            except ValueError:
                record = None
            paths = known_paths(record) if isinstance(record, dict) else None
            mark, how = (fingerprint(paths), mapping(paths)) if paths is not None else (None, None)
            written, spans = render(canonical(record, how)) if how else (None, [])
            rows.append({"conv_id": key, "fingerprint": mark, "formatted": written, "loss_spans": [{"start": a, "end": b} for a, b in spans]})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("fingerprint", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))


def format_records(records: DataFrame) -> DataFrame:
    """(conv_id, record JSON) to (conv_id, fingerprint, formatted, loss_spans)."""
    return records.select(F.col("conv_id").cast("long").alias("conv_id"), "record").mapInArrow(_format, "conv_id long, fingerprint long, formatted string, loss_spans array<struct<start: long, end: long>>")


def conversation_records(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one JSON record a conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = turns.select("conv_id", turn.alias("said"), F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"))
    grouped = own.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    return grouped.select("conv_id", F.to_json(F.struct("turns"), {"ignoreNullFields": "false"}).alias("record"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            written = row["formatted"] or ""
            turns = parse(written)
            loss = "".join(unescape(written[s["start"] : s["end"]]) for s in row["loss_spans"])
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((row["conv_id"], len(turns), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(written)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the written strings hold."""
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
