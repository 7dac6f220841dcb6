"""Line classification and forward fills: pure expressions and one window shape (document, line number)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import clean_text, split_pipe_row, table_marker

_C = F.col


def reading_order(*document: str, line: str = "line_no"):
    return Window.partitionBy(*(document or ("doc_id",))).orderBy(line)


def so_far(*document: str, line: str = "line_no"):
    return reading_order(*document, line=line).rowsBetween(Window.unboundedPreceding, 0)


def is_running_header(text="text") -> Column:
    return F.trim(_C(text)).isin(*P.BANNERS)


def is_header_or_page_number(text="text", font="font") -> Column:
    return F.trim(_C(text)).isin(*P.BANNERS) | (F.trim(_C(text)).rlike(r"^\d+$") & (_C(font) <= 7.5))


def is_section_start_at(text="text", x="x", most: float = 30.5) -> Column:
    return _C(text).rlike(r"^\d+[A-Z]?\.") & (_C(x) <= most)


def is_pipe_line(text="text") -> Column:
    return F.length(_C(text)) - F.length(F.replace(_C(text), F.lit("|"), F.lit(""))) >= 2


def is_pipe_separator(text="text") -> Column:
    cells = split_pipe_row(_C(text))
    return is_pipe_line(text) & (F.size(cells) > 0) & F.forall(cells, lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike(r"^:?-{3,}:?$"))


def is_table_marker(text="text") -> Column:
    return table_marker(_C(text)) == "TABLE"


def is_table_title(text="text") -> Column:
    return is_table_marker(text) | F.trim(_C(text)).rlike(r"(?i)^Sl\.\s*No\.?\b")


def starts_hierarchy(text="text") -> Column:
    t = F.trim(_C(text))
    return t.rlike(P.CHAPTER) | t.rlike(P.SECTION_START) | t.rlike(P.BRACKET) | t.rlike(P.EXPLANATION) | t.rlike(P.PROVISO) | t.rlike(P.ILLUSTRATION)


def is_borderless_candidate(text="text", list_item: Column | None = None, numeric_list_item: Column | None = None) -> Column:
    t = F.trim(_C(text))
    never = F.lit(False)
    return (
        F.when(is_pipe_line(text), False)
        .when(numeric_list_item if numeric_list_item is not None else never, True)
        .when(list_item if list_item is not None else never, False)
        .when(t.rlike(r"(?i)^Sl\.\s*No\.?\b"), True)
        .when(t.rlike(r"^\(?\d+\)?\.?\s{2,}\S+"), True)
        .otherwise(t.rlike(r"\S\s{3,}\S") & ~starts_hierarchy(text))
    )


def starts_table_boundary(text="text") -> Column:
    """What ends a table region: chapter, section or numeric bracket."""
    t = F.trim(_C(text))
    return t.rlike(P.CHAPTER) | t.rlike(r"^\d+[A-Z]?\.\s*\(") | t.rlike(r"^\s*\[?\(\s*\d+\s*\)")


def is_post_table_body(text="text", x="x") -> Column:
    special = _C(text).rlike(P.EXPLANATION) | _C(text).rlike(P.PROVISO) | _C(text).rlike(P.ILLUSTRATION)
    return is_section_start_at(text, x) | (_C(text).rlike(r"^\([a-z]\)\s") & (_C(x) <= 45)) | special


def is_column_letters(text="text") -> Column:
    return clean_text(_C(text)).rlike(r"^(?:[A-Z]\s+){2,}[A-Z]$")


def line_class(text="text") -> Column:
    """One class a line, in the parser's order of precedence."""
    t = F.trim(_C(text))
    return (
        F.when(t == "", "blank")
        .when(t.rlike(P.PAGE), "page")
        .when(is_running_header(text), "banner")
        .when(t.rlike(P.FOOTNOTE_START), "footnote")
        .when(is_table_marker(text), "table_marker")
        .when(t.rlike(r"(?i)<t[rdh][ >]"), "html_row")
        .when(is_pipe_line(text), "pipe_row")
        .when(t.rlike(P.CHAPTER), "chapter")
        .when(is_borderless_candidate(text), "borderless_row")
        .when(t.rlike(P.SECTION_START), "section")
        .when(t.rlike(P.HEADING) | t.rlike(P.BOLD_LINE), "heading")
        .when(t.rlike(P.EXPLANATION), "explanation")
        .when(t.rlike(P.PROVISO), "proviso")
        .when(t.rlike(P.ILLUSTRATION), "illustration")
        .when(t.rlike(r"^(?:\d+[a-z]?\s*\[\s*)?\[?\(\s*(?:[A-Za-z]+|\d+)\s*\)"), "bracket")
        .otherwise("text")
    )


def split_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a line of each document: line_no from 1, raw."""
    return documents.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "raw")).select(key, (_C("pos") + 1).alias("line_no"), "raw")


def markdown_lines(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scan of Markdown: blank lines out, page numbers filled forward, heading, list, bold and indent flags."""
    from ..functions.text import strip_inline_markup

    lines = split_lines(documents, key)
    page = F.nullif(F.regexp_extract(F.trim(_C("raw")), P.PAGE, 1), F.lit("")).cast("int")
    lines = lines.withColumn("page_mark", page).withColumn("page", F.coalesce(F.last("page_mark", ignorenulls=True).over(so_far(key)), F.lit(1)))
    raw = _C("raw")
    return lines.where((F.trim(raw) != "") & _C("page_mark").isNull()).select(
        key, "page", "line_no", (F.length(raw) - F.length(F.ltrim(raw))).alias("indent"),
        F.length(F.nullif(F.regexp_extract(F.trim(raw), P.HEADING, 1), F.lit(""))).alias("heading_level"),
        F.trim(raw).rlike(P.BOLD_LINE).alias("bold"), raw.rlike(P.LIST_ITEM).alias("list_item"), raw.rlike(P.NUMERIC_LIST_ITEM).alias("numeric_list_item"),
        "raw", strip_inline_markup(F.regexp_replace(F.trim(raw), r"^#{1,6}\s+", "")).alias("text"),
    )


def positioned_lines(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scan of ``[x=][y=][font=][bold=] text`` lines: others are dropped, PAGE markers fill forward, banners go."""
    lines = split_lines(documents, key)
    mark = F.nullif(F.regexp_extract("raw", r"^\s*PAGE\s+(\d+)\s*$", 1), F.lit("")).cast("int")
    lines = lines.withColumn("page", F.coalesce(F.last(mark, ignorenulls=True).over(so_far(key)), F.lit(0))).where(_C("raw").rlike(P.POSITIONED))
    g = lambda i: F.regexp_extract("raw", P.POSITIONED, i)
    out = lines.select(key, "page", "line_no", g(1).cast("double").alias("x"), g(2).cast("double").alias("y"), g(3).cast("double").alias("font"), (g(4) == "True").alias("bold"), clean_text(g(5)).alias("text"))
    return out.where(~is_header_or_page_number())


def in_reading_order(positioned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds place, a line's rank in its document by page, height and left edge."""
    return positioned.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("page", "y", "x", "line_no")))
