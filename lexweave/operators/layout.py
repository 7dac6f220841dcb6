"""Page layout over spans and glyphs: dominant sizes, headings, cells by gap, anchors, boxes, rendering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text


def dominant_size(spans: DataFrame, key: list[str], weight: Column | None = None, otherwise: float = 10.0) -> DataFrame:
    """The rounded size with most text; ties go to the one met first (column ord)."""
    one = spans.withColumn("s", F.round("size", 1)).groupBy(*key, "s").agg(F.sum(weight if weight is not None else F.length("text")).alias("n"), F.min("ord").alias("o"))
    return one.groupBy(*key).agg(F.coalesce(F.max_by("s", F.struct("n", -F.col("o"))), F.lit(otherwise)).alias("dominant"))


def rendered_lines(spans: DataFrame, key: list[str], styled: str = "styled") -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", styled))), lambda x: x[styled]), "")
    return spans.groupBy(*key).agg(F.trim(joined).alias("text"))


def glyph_text(chars: DataFrame, key: list[str], gap: float = 1.8) -> DataFrame:
    """Line text: a space where the gap before a glyph is wide, a caret before superscripts."""
    w = Window.partitionBy(*key).orderBy("ord")
    before = F.lag("x1").over(w)
    piece = F.concat(F.when(F.col("x0") - before > gap, F.lit(" ")).otherwise(F.lit("")), F.when(F.col("superscript"), F.lit("^")).otherwise(F.lit("")), F.col("c"))
    return rendered_lines(chars.withColumn("piece", piece), key, "piece").withColumn("text", clean_text("text"))


def superscripts(chars: DataFrame, key: list[str], ratio: float = 0.85) -> DataFrame:
    """Glyphs with a flag: smaller than ratio times the page's most frequent size."""
    most = dominant_size(chars, key, weight=F.lit(1))
    return chars.join(most, key).withColumn("superscript", F.col("size") < F.col("dominant") * ratio)


def cells_by_gap(chars: DataFrame, key: list[str], gap: float = 18.0, bound: Column | None = None) -> DataFrame:
    """Cells of a line: a new one where the gap is wide, or where the bound of the last column is crossed by any gap; box and text of each."""
    w = Window.partitionBy(*key).orderBy("x0", "ord")
    before = F.col("x0") - F.lag("x1").over(w)
    wide = before > gap
    if bound is not None:
        wide = wide | F.coalesce((F.lag("x0").over(w) < bound) & (F.col("x0") >= bound) & (before > 0.1), F.lit(False))
    cut = F.when(wide, 1).otherwise(0)
    s = chars.withColumn("cut", cut).withColumn("cell", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord", "c"))), lambda x: x["c"]), "")
    return s.groupBy(*key, "cell").agg(text.alias("text"), F.min("x0").alias("x"), F.max("x1").alias("x_end"), F.bool_or("bold").alias("bold"))


def second_pass_bounds(cells: DataFrame, key: list[str], margin: float = 5.0) -> DataFrame:
    """The right-most column's start of a region, learnt from its lines' last cells."""
    last = cells.withColumn("r", F.row_number().over(Window.partitionBy(*key, "line").orderBy(F.desc("x")))).where("r = 1 and cell > 0")
    return last.groupBy(*key).agg((F.min("x") - margin).alias("bound"))


def region_cells(chars: DataFrame, key: list[str]) -> DataFrame:
    """Cells of a table region in two passes: the first finds where the last column begins, the second splits there too."""
    own = [*key, "line"]
    bounds = second_pass_bounds(cells_by_gap(chars, own), key)
    return cells_by_gap(chars.join(bounds, key, "left"), own, bound=F.col("bound"))


def selected_pages(spec: Column) -> Column:
    """``1-3,7`` to the pages it names, ascending, once each."""
    ends = lambda part: F.split(F.trim(part), "-")
    spans = F.transform(F.split(spec, ","), lambda part: F.sequence(F.element_at(ends(part), 1).cast("int"), F.element_at(ends(part), -1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def line_clusters(chars: DataFrame, key: list[str], tolerance: float = 3.0) -> DataFrame:
    """Greedy clustering by y against a cluster's first member: a fold over the sorted heights of a page."""
    ys = chars.groupBy(*key).agg(F.array_sort(F.collect_set("y0")).alias("ys"))
    firsts = F.aggregate("ys", F.array().cast("array<double>"), lambda acc, y: F.when((F.size(acc) > 0) & (y - F.element_at(acc, -1) <= tolerance), acc).otherwise(F.concat(acc, F.array(y))))
    return ys.select(*key, F.posexplode(firsts).alias("line", "y"))


def glyph_lines(chars: DataFrame, key: list[str], tolerance: float = 3.0) -> DataFrame:
    """Glyphs with the line they stand on: lines come from the glyphs that are no superscripts, and every glyph goes to the
    nearest line by height, of two equally near to the upper one."""
    plain = line_clusters(chars.where(~F.col("superscript")), key, tolerance)
    firsts = plain.groupBy(*key).agg(F.array_sort(F.collect_list("y")).alias("firsts"))
    gaps = F.transform("firsts", lambda y: F.abs(y - F.col("y0")))
    return chars.join(firsts, key, "left").withColumn("on_line", (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")).drop("firsts")


def visual_rows(lines: DataFrame, key: list[str], step: int = 4) -> DataFrame:
    """Lines of one visual row share y rounded half-even to a multiple of step."""
    return lines.withColumn("row_y", (F.bround(F.col("y") / step) * step).cast("int")).groupBy(*key, "row_y").agg(F.count("*").alias("n"), F.min("x").alias("x"))


def column_anchors(lines: DataFrame, key: list[str], apart: float = 55.0) -> DataFrame:
    """Column anchors of a table: sorted x, a new anchor where x leaves the running half-way mean by more than apart."""
    xs = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.col("x").cast("double"))).alias("xs"))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x - F.element_at(acc, -1) <= apart), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array((F.element_at(acc, -1) + x) / 2))).otherwise(F.concat(acc, F.array(x)))
    return xs.select(*key, F.aggregate("xs", F.array().cast("array<double>"), step).alias("anchors"))


def nearest_anchor(x: Column, anchors: Column) -> Column:
    """0-based place of the nearest anchor; ties to the first."""
    gaps = F.transform(anchors, lambda a: F.abs(a - x))
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def generic_table(lines: DataFrame, anchors: DataFrame, key: list[str]) -> DataFrame:
    """Text by visual row and nearest column."""
    placed = lines.join(anchors, key).withColumn("col", nearest_anchor(F.col("x").cast("double"), F.col("anchors"))).withColumn("row_y", (F.bround(F.col("y") / 4) * 4).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "line_no", "text"))), lambda v: v["text"]), " ")
    return placed.groupBy(*key, "row_y", "col").agg(text.alias("cell"))


def real_tables(cells: DataFrame, key: list[str]) -> DataFrame:
    """Tables that look real: two rows at least, and no few columns of very long or page-filling text."""
    one = cells.groupBy(*key).agg(F.countDistinct("row").alias("rows"), F.countDistinct("col").alias("cols"), F.max(F.length("cell")).alias("longest"), F.avg(F.length("cell")).alias("mean"), F.max("coverage").alias("coverage"))
    bad = (F.col("longest") > 400) | ((F.col("mean") > 150) & (F.col("cols") <= 3)) | ((F.col("coverage") > 0.6) & (F.col("cols") <= 3) & (F.col("mean") > 80))
    return one.where((F.col("rows") >= 2) & ~bad)


def outside_boxes(lines: DataFrame, boxes: DataFrame, key: list[str]) -> DataFrame:
    """Lines that meet no box of their page: an anti-join on the page with four inequalities."""
    a, b = lines.alias("a"), boxes.alias("b")
    on = (F.col("a.x0") < F.col("b.x1")) & (F.col("a.x1") > F.col("b.x0")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("a.y1") > F.col("b.y0"))
    for k in key:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, on, "left_anti")


def table_regions(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines from a centred TABLE heading (x > 150) up to a hierarchy marker at the left."""
    mark = (F.trim("text") == "TABLE") & (F.col("x") > 150)
    stop = (F.col("text").rlike(r"^(\d+[A-Z]?\.|\(\d+\))") & (F.col("x") <= 30.5)) | (F.col("text").rlike(r"^\([a-z]\)") & (F.col("x") <= 45))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("region", F.sum(F.when(mark, 1).otherwise(0)).over(w)).withColumn("inside", F.last(F.when(mark, True).when(stop, False), ignorenulls=True).over(w))
    return out.where("inside").where(~mark).drop("inside")


def list_depths(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Depth of list lines from a stack of indents: state that depends on its own history, so a fold a document. The stack
    goes on over pages; a row whose column ``resets`` is true (a heading or a table), if there is one, empties it and has no depth."""
    resets = F.col("resets") if "resets" in lines.columns else F.lit(False)

    def fold(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            page, stack, out = page.sort_values("line_no"), [], []
            for x, empties in zip(page["x"], page["resets"]):
                if empties:
                    stack.clear()
                    out.append(None)
                    continue
                while stack and stack[-1] > x + 2:
                    stack.pop()
                if not stack or x > stack[-1] + 2:
                    stack.append(x)
                out.append(len(stack) - 1)
            yield page.assign(depth=pd.array(out, dtype="Int32"))[[key, "line_no", "depth"]]

    return lines.select(key, "line_no", F.col("x").cast("double").alias("x"), F.coalesce(resets, F.lit(False)).alias("resets")).groupBy(key).applyInPandas(lambda page: next(fold(iter([page]))), f"{key} {lines.schema[key].dataType.simpleString()}, line_no {lines.schema['line_no'].dataType.simpleString()}, depth int")


def positioned_text(lines: DataFrame) -> Column:
    return F.format_string("[x=%7.2f] [y=%7.2f] [font=%4.1f] [bold=%s] %s", F.col("x").cast("double"), F.col("y").cast("double"), F.col("font").cast("double"), F.when(F.col("bold"), "True").otherwise("False"), F.col("text"))


def page_sections(first_page: Column, last_page: Column, first_section: Column, last_section: Column) -> Column:
    """Pages zipped with sections; an error if the ranges differ in length."""
    same = (last_page - first_page) == (last_section - first_section)
    return F.when(same, F.arrays_zip(F.sequence(first_page, last_page).alias("page"), F.sequence(first_section, last_section).alias("section"))).otherwise(F.raise_error(F.lit("ranges differ in length")))
