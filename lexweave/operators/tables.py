"""Tables: regions, pipe, borderless and HTML rows, merging by item number, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import clean_text, column_key, escape_markdown, item_number, merge_text, split_borderless, split_pipe_row
from .lines import is_borderless_candidate, is_pipe_line, is_pipe_separator, is_table_marker, so_far, starts_table_boundary


def regions(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines inside table regions: from a marker to the next boundary; region counts markers in the document."""
    mark, stop = is_table_marker(), starts_table_boundary()
    w = so_far(key)
    out = lines.withColumn("region", F.sum(F.when(mark, 1).otherwise(0)).over(w))
    out = out.withColumn("inside", F.last(F.when(mark, True).when(stop, False), ignorenulls=True).over(w))
    return out.where("inside").where(~mark).drop("inside")


def with_region(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every line, with a number for the stretch it lies in: a marker or a boundary starts one, so no two tables share it."""
    return lines.withColumn("region", F.sum(F.when(is_table_marker() | starts_table_boundary(), 1).otherwise(0)).over(so_far(key)))


def pipe_rows(lines: DataFrame, key: list[str]) -> DataFrame:
    """Cells of pipe lines: the item number, and the other cells; separator lines out."""
    rows = lines.where(is_pipe_line() & ~is_pipe_separator()).withColumn("cells", split_pipe_row("text"))
    first = item_number(F.get("cells", F.lit(0)))
    return rows.select(*key, "line_no", first["item_no"].alias("item_no"), F.array_join("cells", "|").alias("cells"))


def with_continuations(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a number are joined, cell by cell, to the numbered row before; rows before any number are the header.

    In a table without any number the first row is the header, and the others that say something are numbered in sequence.
    key has to name one table (``with_region``).
    """
    of = Window.partitionBy(*key)
    w = of.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(of.orderBy("line_no")) == 1
    s = rows.withColumn("own", F.max(F.col("item_no").isNotNull()).over(of)).withColumn("first", first).where("own or first or trim(replace(cells, '|', '')) <> ''")
    starts = F.when(F.col("own"), F.col("item_no").isNotNull()).otherwise(~F.col("first"))
    s = s.withColumn("session", F.sum(F.when(starts, 1).otherwise(0)).over(w)).withColumn("item_no", F.when(F.col("own"), F.col("item_no")).when(F.col("session") > 0, F.col("session").cast("int")))
    cells = s.select(*key, "session", "line_no", F.posexplode(F.split("cells", r"\|", -1)).alias("col", "cell"))
    joined = cells.groupBy(*key, "session", "col").agg(clean_text(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "cell"))), lambda x: x["cell"]), " ")).alias("cell"))
    rebuilt = joined.groupBy(*key, "session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "cell"))), lambda x: x["cell"]), "|").alias("cells"))
    numbers = s.groupBy(*key, "session").agg(F.max("item_no").alias("item_no"))
    return rebuilt.join(numbers, [*key, "session"]).withColumn("is_header", F.col("session") == 0)


def borderless_rows(lines: DataFrame, key: list[str]) -> DataFrame:
    cells = split_borderless("text")
    rows = lines.where(is_borderless_candidate()).withColumn("cells", cells)
    first = item_number(F.get("cells", F.lit(0)))
    return rows.select(*key, "line_no", first["item_no"].alias("item_no"), F.array_join("cells", "|").alias("cells"))


def loose_rows(lines: DataFrame, key: list[str]) -> DataFrame:
    """Numbered rows whose description and amount are split at the first known marker; three columns by default."""
    body = item_number(clean_text("text"))
    at = F.least(*(F.when(F.instr(body["body"], m) > 0, F.instr(body["body"], m)).otherwise(F.lit(1 << 30)) for m in P.DEDUCTION_MARKERS))
    found = at < (1 << 30)
    rows = lines.select(*key, "line_no", body["item_no"].alias("item_no"), body["body"].alias("body"), found.alias("found"), at.alias("at")).where("item_no is not null")
    description = F.when(F.col("found"), F.trim(F.substr(F.col("body"), F.lit(1), F.col("at") - 1))).otherwise(F.col("body"))
    amount = F.when(F.col("found"), F.trim(F.substr(F.col("body"), F.col("at")))).otherwise(F.lit(""))
    return rows.select(*key, "line_no", "item_no", description.alias("description"), amount.alias("amount"))


def html_cells(lines: DataFrame, key: list[str]) -> DataFrame:
    """Cells of ``<tr>`` lines: row line, column, spans, cleaned text."""
    cell = r"(?is)<t[dh]([^>]*)>(.*?)</t[dh]>"
    whole = F.regexp_extract_all("text", F.lit(r"(?is)<t[dh][^>]*>.*?</t[dh]>"), F.lit(0))
    span = lambda c, name: F.coalesce(F.nullif(F.regexp_extract(F.regexp_extract(c, cell, 1), rf"(?i){name}\s*=\s*[\"']?(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    cells = lines.where(F.lower("text").contains("<tr")).select(*key, "line_no", F.posexplode(whole).alias("pos", "c"))
    parts = cells.select(*key, "line_no", "pos", span(F.col("c"), "rowspan").alias("rowspan"), span(F.col("c"), "colspan").alias("colspan"), clean_text(F.regexp_replace(F.regexp_extract("c", cell, 2), r"<[^>]+>", " ")).alias("cell"))
    before = Window.partitionBy(*key, "line_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("col", F.coalesce(F.sum("colspan").over(before), F.lit(0)).cast("int"))


def merged_rows(one: DataFrame, two: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two tables by item number: full outer, cells of all rows of a number joined, those of one first, each in
    order of lines. Rows without a number stay as they are. place ranks a table's rows by number, those without one last.
    key has to name one table (``with_region``)."""

    def by_number(rows: DataFrame, name: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("line_no", "cells")))
        return rows.where("item_no is not null").groupBy(*key, "item_no").agg(F.array_join(F.transform(listed, lambda x: x["cells"]), " ").alias(name))

    a, b = by_number(one, "left_cells"), by_number(two, "right_cells")
    merged = a.join(b, [*key, "item_no"], "full_outer").select(*key, "item_no", merge_text(F.coalesce("left_cells", F.lit("")), F.coalesce("right_cells", F.lit(""))).alias("cells"))
    rest = [rows.where("item_no is null").select(*key, "item_no", clean_text("cells").alias("cells")) for rows in (one, two)]
    order = Window.partitionBy(*key).orderBy(F.col("item_no").asc_nulls_last(), "cells")
    return merged.unionByName(rest[0]).unionByName(rest[1]).withColumn("place", F.row_number().over(order))


def table_ids(tables: DataFrame, unit: str = "unit_id", key: str = "doc_id") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key, unit).orderBy("line_no"))
    return tables.withColumn("table_id", F.concat(F.coalesce(unit, F.lit("table")), F.lit("-table-"), n.cast("string")))


def linearized(rows: DataFrame, key: list[str], columns: tuple[str, ...] = ("No", "Item", "Rate"), prefix: Column | None = None) -> DataFrame:
    """A sentence a table: ``Table items: Item n - col: value; ... .``"""
    cells = F.split("cells", r"\|", -1)
    names = F.array(*map(F.lit, columns))
    named = F.transform(F.slice(cells, 1, len(columns)), lambda v, i: F.when(v != "", F.concat(F.coalesce(F.get(names, i), column_key(i)), F.lit(": "), v)).otherwise(F.lit("")))
    label = F.when(F.col("item_no").isNotNull(), F.concat(F.lit("Item "), F.col("item_no").cast("string"))).otherwise(F.lit("Row"))
    line = F.concat(label, F.lit(" - "), F.array_join(F.filter(named, lambda x: x != ""), "; "), F.lit("."))
    one = rows.select(*key, "line_no", line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    return one.groupBy(*key).agg(F.concat_ws(" ", prefix if prefix is not None else F.lit("Table"), F.lit("Table items:"), text).alias("linearized_text"))


def displaced_rows(lines: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Bare ``n.`` lines after a table that lacks item n: the row is what follows, up to the next number or boundary."""
    bare = lines.withColumn("item_no", F.nullif(F.regexp_extract(F.trim("text"), r"^(\d+)\.$", 1), F.lit("")).cast("int"))
    w = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("item_no").isNotNull() | starts_table_boundary() | is_table_marker()
    s = bare.withColumn("session", F.sum(F.when(cut, 1).otherwise(0)).over(w))
    text = clean_text(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " "))
    heads = s.groupBy(*key, "session").agg(F.max("item_no").alias("item_no"), text.alias("raw_text"), F.min("line_no").alias("line_no")).where("item_no is not null").drop("session")
    return heads.join(rows.select(*key, "item_no"), [*key, "item_no"], "left_anti")


def markdown_table(rows: DataFrame, key: list[str]) -> DataFrame:
    """Markdown of (key, row, cells array): header, rule, rows padded or cut to the header's width."""
    tidy = lambda c: F.transform(c, lambda x: escape_markdown(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))))
    width = F.size(F.min_by("cells", "row").over(Window.partitionBy(*key)))
    fit = rows.withColumn("w", width).withColumn("cells", F.slice(F.concat(tidy(F.col("cells")), F.array_repeat(F.lit(""), F.col("w"))), F.lit(1), F.col("w")))
    line = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("w")), " | "), F.lit(" |"))
    one = fit.withColumn("line", F.when(F.row_number().over(Window.partitionBy(*key).orderBy("row")) == 1, F.concat(line, F.lit("\n"), rule)).otherwise(line))
    return one.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


