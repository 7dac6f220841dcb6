"""Scalar text functions as Column -> Column: all JVM-side, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """No-break spaces to spaces, white-space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.replace(_col(c), F.lit("\u00a0"), F.lit(" ")), r"\s+", " "))


def strip_inline_markup(c) -> Column:
    """Markdown and HTML inline markup off: images, links, code, list markers, emphasis, tags; ``( a )`` to ``(a)``."""
    t = F.trim(F.replace(_col(c), F.lit("\u00a0"), F.lit(" ")))
    for pattern, to in (
        (r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"`([^`]+)`", "$1"), (r"^\s*[-*+]\s+", ""),
        (r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"), (r"(?i)</?su[bp]>", ""), (r"(?i)<br\s*/?>", " "), (r"</?[^>]+>", ""), (r"[_*]", ""), (r"\(\s+([A-Za-z]+|\d+)\s+\)", "($1)"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def strip_closing_bracket(c) -> Column:
    return F.regexp_replace(F.rtrim(_col(c)), r"\]$", "")


def footnote_refs(c) -> Column:
    """Numbers of leading ``N[`` brackets before a ``(``."""
    t = _col(c)
    run = F.regexp_extract(t, P.FOOTNOTE_REF_RUN, 0)
    return F.when(t.rlike(r"(?i)^(?:\s*\d+[a-z]?\s*\[\s*)+\("), F.regexp_extract_all(run, F.lit(r"(\d+[A-Za-z]?)"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def without_footnote_refs(c) -> Column:
    t = _col(c)
    return F.when(t.rlike(r"(?i)^(?:\s*\d+[a-z]?\s*\[\s*)+\("), strip_closing_bracket(F.regexp_replace(t, P.FOOTNOTE_REF_RUN, ""))).otherwise(t)


def escape_markdown(c) -> Column:
    return F.regexp_replace(_col(c), r"([\\*_`])", r"\\$1")


def style_span(text, bold, italic, superscript) -> Column:
    t = escape_markdown(text)
    t = F.when(_col(italic), F.concat(F.lit("_"), t, F.lit("_"))).otherwise(t)
    t = F.when(_col(bold), F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t)
    return F.when(_col(superscript), F.concat(F.lit("<sup>"), t, F.lit("</sup>"))).otherwise(t)


def is_bold(flags, font) -> Column:
    return (_col(flags).bitwiseAND(16) != 0) | _col(font).contains("Bold")


def is_italic(flags, font) -> Column:
    return (_col(flags).bitwiseAND(2) != 0) | _col(font).contains("Italic") | _col(font).contains("Oblique")


def is_superscript(flags) -> Column:
    return _col(flags).bitwiseAND(1) != 0


def heading_level(size, dominant) -> Column:
    ratio = _col(size) / _col(dominant)
    return F.when(ratio >= 1.8, 1).when(ratio >= 1.5, 2).when(ratio >= 1.25, 3).when(ratio >= 1.1, 4)


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def first_number(c) -> Column:
    """First integer in a name, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(_col(c), r"\d+", 0), F.lit("")).cast("int"), F.lit(0))


def split_pipe_row(c) -> Column:
    cells = F.split(F.trim(_col(c)), r"\|", -1)
    n = F.size(cells)
    first = F.when(F.trim(cells[0]) == "", 2).otherwise(1)
    last = F.when((n > 1) & (F.trim(F.element_at(cells, -1)) == ""), n - 1).otherwise(n)
    return F.transform(F.slice(cells, first, F.greatest(last - first + 1, F.lit(0))), clean_text)


def item_number(c, placed: bool = False) -> Column:
    """(number, body) of ``(n) body``, ``n. body`` or a bare number; the dot is needed before a body.

    placed: the form of placed lines, where no space is needed and a bare number without dot or parentheses is text.
    """
    t = F.trim(_col(c))
    body = r"^(?:\((\d+)\)|(\d+)\.)\s*(\S.*)$" if placed else r"^(?:\((\d+)\)|(\d+)\.)\s+(\S.*)$"
    bare = r"^(?:\((?=\d+\)))?(\d+)[.)]$" if placed else r"^\(?(\d+)\)?\.?$"
    number = F.coalesce(F.nullif(F.regexp_extract(t, body, 1), F.lit("")), F.nullif(F.regexp_extract(t, body, 2), F.lit("")), F.nullif(F.regexp_extract(t, bare, 1), F.lit("")))
    rest = F.when(t.rlike(body), F.regexp_extract(t, body, 3)).when(t.rlike(bare), F.lit("")).otherwise(t)
    return F.struct(number.cast("int").alias("item_no"), rest.alias("body"))


def split_borderless(c) -> Column:
    """Cells at two or more spaces; a single cell with an item number gives number and body."""
    cells = F.filter(F.transform(F.split(F.trim(_col(c)), r"\s{2,}", -1), clean_text), lambda x: x != "")
    item = item_number(cells[0])
    return F.when((F.size(cells) == 1) & item["item_no"].isNotNull() & (item["body"] != ""), F.array(item["item_no"].cast("string"), item["body"])).otherwise(cells)


def table_marker(c) -> Column:
    return F.upper(F.regexp_replace(_col(c), r"[|*_\s]", ""))


def header_text(c) -> Column:
    return F.regexp_replace(clean_text(c), r"^\(([A-Z])\)$", "[$1]")


def column_key(i) -> Column:
    """column_A, column_B, ... column_Z, column_AA, ..."""
    n = _col(i)
    letter = lambda x: F.char(F.lit(65) + x)
    return F.concat(F.lit("column_"), F.when(n >= 26, letter(F.floor(n / 26) - 1)).otherwise(F.lit("")), letter(n % 26))


def merge_text(a, b) -> Column:
    return clean_text(F.concat_ws(" ", _col(a), _col(b)))


def node_text(before, after, text) -> Column:
    return clean_text(F.concat_ws(" ", _col(before), _col(after), _col(text)))


def known_columns(header) -> Column:
    h = F.lower(clean_text(header))
    hit = h.contains("sl. no") & h.contains("assessee") & h.contains("rate of tax") & h.contains("conditions")
    return F.when(hit, F.array(*map(F.lit, ("Sl. No.", "Assessee", "Income", "Rate of tax", "Conditions")))).otherwise(F.array().cast("array<string>"))


def unit_id(*numbers) -> Column:
    """Numbers on the open path, joined by dashes; null ones are left out."""
    return F.concat_ws("-", *map(_col, numbers))


def expand_range(c) -> Column:
    """``28 to 33, 44 and (5)`` to every number; splits at commas, and, or."""
    parts = F.filter(F.transform(F.split(_col(c), r"(?i)\s*(?:,|\band\b|\bor\b)\s*", -1), lambda x: F.trim(x)), lambda x: x != "")
    ends = lambda x, g: F.regexp_extract(x, r"(?i)^\(?(\d+)\)?\s*to\s*\(?(\d+)\)?$", g)
    low, high = lambda x: ends(x, 1).cast("int"), lambda x: ends(x, 2).cast("int")
    plain = lambda x: F.array(F.regexp_replace(x, r"^\(+|\)+$", ""))
    spread = lambda x: F.when((ends(x, 1) != "") & (low(x) <= high(x)), F.transform(F.sequence(low(x), high(x)), lambda v: v.cast("string"))).otherwise(plain(x))
    return F.flatten(F.transform(parts, spread))


def number_tokens(c) -> Column:
    """Split at commas, and, or, to; parentheses off; empty ones out."""
    parts = F.transform(F.split(_col(c), r"(?i),|\band\b|\bor\b|to", -1), lambda x: F.regexp_replace(F.trim(x), r"^\(+|\)+$", ""))
    return F.filter(parts, lambda x: x != "")


def reference_id(unit, number) -> Column:
    return F.format_string("ref-%s-%03d", F.coalesce(F.nullif(_col(unit), F.lit("")), F.lit("node")), _col(number))


def without_tail_punctuation(c) -> Column:
    return F.regexp_replace(_col(c), r"[\s).,;:]+$", "")


def without_tags(c) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), r"<[^>]+>", " "), r"\s+", " ")


def without_fence(c) -> Column:
    """A reply without its Markdown code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_col(c)), r"^```[a-z]*\s*", ""), r"\s*```$", ""))


def number_key(c) -> Column:
    """Leading digits as a sort key."""
    return F.nullif(F.regexp_extract(_col(c), r"\d+", 0), F.lit("")).cast("int")
