"""Hierarchy by windows: which unit is open at each line, ids, parents and continuation text, without Python.

A level is open at a line if its last opening comes after the last opening of every level above it. The open path is
thus a handful of running maxima over one (document, line) window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import clean_text, footnote_refs, unit_id, without_footnote_refs
from .lines import line_class, so_far

LEVELS = ("chapter", "section", "subsection", "clause", "sub_clause", "item", "sub_item")
SPECIAL = ("explanation", "proviso", "illustration")
NO_UNIT_TEXT = ("table_marker", "pipe_row", "html_row", "borderless_row", "footnote", "blank", "page", "banner")


def token_kind(token: Column, before: Column | None = None, item_open: Column | None = None) -> Column:
    """Kind of a bracket token. before: the last clause's token, which turns i after h, v after u, x after w into clauses.
    item_open: upper romans under an open item are sub_items (seven levels)."""
    roman = token.isin(*P.LOWER_ROMAN)
    follows = F.lit(False)
    if before is not None:
        follows = F.coalesce((F.length(token) == 1) & (F.length(before) == 1) & (F.ascii(token) == F.ascii(before) + 1), F.lit(False))
    kind = F.when(token.rlike(r"^\d+$"), "subsection").when(roman & ~follows, "sub_clause").when(token.rlike(r"^[a-z]+$"), "clause")
    if item_open is not None:
        kind = kind.when(token.isin(*P.UPPER_ROMAN) & item_open, "sub_item")
    return kind.otherwise("item")


def token_rows(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row a unit that a line opens: ord within the line, level, number, rest of the text.

    A section line ``5. (1)(a) text`` opens three; a footnote bracket ``17[(3) text`` opens its subsection.
    """
    t = F.trim(F.col("text"))
    cls = line_class()
    refs = footnote_refs(t)
    body = F.when(cls == "section", F.regexp_extract(t, P.SECTION_START, 2)).otherwise(without_footnote_refs(t))
    run = F.when(cls.isin("section", "bracket"), F.regexp_extract(body, P.BRACKET_RUN, 0)).otherwise(F.lit(""))
    tokens = F.regexp_extract_all(run, F.lit(P.BRACKET_TOKEN), F.lit(1))
    head = F.when(cls == "section", F.array(F.struct(F.lit("section").alias("level"), F.regexp_extract(t, P.SECTION_START, 1).alias("number")))).when(
        cls == "chapter", F.array(F.struct(F.lit("chapter").alias("level"), F.regexp_extract(t, P.CHAPTER, 1).alias("number")))
    ).otherwise(F.array().cast("array<struct<level: string, number: string>>"))
    opened = F.concat(head, F.transform(tokens, lambda x: F.struct(token_kind(x).alias("level"), x.alias("number"))))
    rest = F.when(cls.isin("section", "bracket"), F.substr(body, F.length(run) + 1)).when(cls == "chapter", F.regexp_extract(t, P.CHAPTER, 2)).otherwise(t)
    return lines.select(key, "line_no", cls.alias("cls"), refs.alias("footnote_refs"), clean_text(rest).alias("rest"), F.posexplode_outer(opened).alias("ord", "u")).select(
        key, "line_no", "cls", "footnote_refs", "rest", F.coalesce("ord", F.lit(0)).alias("ord"), F.col("u.level").alias("level"), F.col("u.number").alias("number")
    )


def open_path(rows: DataFrame, key: str = "doc_id", levels: tuple[str, ...] = LEVELS[1:6]) -> DataFrame:
    """Adds <level>_no for each level: the number open at the row, or null."""
    w = so_far(key, line="place")
    out = rows.withColumn("place", F.col("line_no") * 1000 + F.col("ord"))
    last = {lv: F.max(F.when(F.col("level") == lv, F.struct("place", "number"))).over(w) for lv in levels}
    out = out.select("*", *(last[lv].alias(f"_{lv}") for lv in levels))
    for i, lv in enumerate(levels):
        above = [F.coalesce(F.col(f"_{x}.place"), F.lit(-1)) for x in levels[:i]]
        top = F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-1)
        out = out.withColumn(f"{lv}_no", F.when(F.col(f"_{lv}.place") > top, F.col(f"_{lv}.number")))
    return out.drop(*(f"_{lv}" for lv in levels))


def with_ids(rows: DataFrame, levels: tuple[str, ...] = LEVELS[1:6]) -> DataFrame:
    """Adds <level>_id (null if not open), unit_id of the deepest open unit, its parent_id and depth."""
    out = rows
    for i, lv in enumerate(levels):
        out = out.withColumn(f"{lv}_id", F.when(F.col(f"{lv}_no").isNotNull(), unit_id(*(f"{x}_no" for x in levels[: i + 1]))))
    ids = [F.col(f"{lv}_id") for lv in reversed(levels)]
    open_ids = F.filter(F.array(*ids), lambda x: x.isNotNull())
    return out.withColumn("unit_id", F.get(open_ids, F.lit(0))).withColumn("parent_id", F.get(open_ids, F.lit(1))).withColumn("depth", F.size(open_ids))


def units(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row a unit: type, number, unit_id, parent_id, depth, place, text_before, text_after, footnote_refs.

    text_before is the text until the first child opens, text_after what follows its children.
    """
    opened = with_ids(open_path(token_rows(lines, key), key)).where(~F.col("cls").isin(*NO_UNIT_TEXT))
    w = so_far(key, line="place")
    # the unit a row belongs to is the last opened one; text after a deeper unit closed does not exist without indents
    own = opened.withColumn("unit_place", F.max(F.when(F.col("level").isNotNull(), F.col("place"))).over(w)).where("unit_place is not null")
    last_of_line = F.row_number().over(Window.partitionBy(key, "line_no").orderBy(F.desc("ord"))) == 1
    texts = own.withColumn("speaks", last_of_line).where("speaks and cls not in ('explanation', 'proviso', 'illustration')")
    joined = texts.groupBy(key, "unit_place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "rest"))), lambda x: x["rest"]), " ").alias("text"))
    heads = own.where("level is not null").select(
        key, "place", F.col("level").alias("type"), "number", "unit_id", "parent_id", "depth", F.when(F.col("ord") == 0, F.col("footnote_refs")).otherwise(F.array().cast("array<string>")).alias("footnote_refs"),
        "section_id", "subsection_id", "clause_id", "sub_clause_id", "item_id",
    )
    return heads.join(joined.withColumnRenamed("unit_place", "place"), [key, "place"], "left").withColumn("text", clean_text(F.coalesce("text", F.lit(""))))


def special_blocks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Explanations, provisos and illustrations: id under the open unit, numbered by kind."""
    rows = with_ids(open_path(token_rows(lines, key), key)).where(F.col("cls").isin(*SPECIAL))
    n = F.row_number().over(Window.partitionBy(key, "unit_id", "cls").orderBy("place"))
    pattern = F.when(F.col("cls") == "explanation", F.regexp_extract("rest", P.EXPLANATION, 2)).when(F.col("cls") == "proviso", F.regexp_extract("rest", P.PROVISO, 2)).otherwise(F.regexp_extract("rest", P.ILLUSTRATION, 2))
    return rows.select(key, "line_no", F.col("cls").alias("type"), F.col("unit_id").alias("parent_id"), F.concat_ws("-", "unit_id", "cls", n.cast("string")).alias("block_id"), pattern.alias("text"))


def continuation(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Plain lines with the deepest open unit they continue; orphans have none."""
    return with_ids(open_path(token_rows(lines, key), key)).where("cls = 'text'").select(key, "line_no", "unit_id", "rest")


def dominant_child(units_: DataFrame, key: str = "doc_id") -> DataFrame:
    """Kind of child that names a parent's text fields: the first kind present in order of levels."""
    prio = F.when(F.col("type") == "subsection", 1).when(F.col("type") == "clause", 2).when(F.col("type") == "sub_clause", 3).when(F.col("type") == "item", 4).otherwise(5)
    kids = units_.where("parent_id is not null").groupBy(key, "parent_id").agg(F.min_by("type", prio).alias("child_type"), F.count("*").alias("n_children"))
    return kids.withColumn("text_key", F.concat(F.lit("text_before_"), F.col("child_type"), F.lit("s")))


def pending_titles(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each section's title: the last heading or bold line since the section before."""
    rows = lines.withColumn("cls", line_class()).withColumn("sec", F.sum(F.when(F.col("cls") == "section", 1).otherwise(0)).over(so_far(key)))
    before = Window.partitionBy(key, F.col("sec") - F.when(F.col("cls") == "section", 1).otherwise(0)).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col("cls") == "heading", F.regexp_replace("text", r"^#+\s+|^\*\*|\*\*$", "")), ignorenulls=True).over(before)
    return rows.withColumn("title", title).where("cls = 'section'").select(key, "line_no", F.regexp_extract("text", P.SECTION_START, 1).alias("number"), "title")


def footnotes(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Footnotes with their continuation lines: sessions that start at a footnote and end where a unit or table starts."""
    w = so_far(key)
    rows = lines.withColumn("cls", line_class())
    start, stop = F.col("cls") == "footnote", ~F.col("cls").isin("footnote", "text")
    rows = rows.withColumn("session", F.sum(F.when(start | stop, 1).otherwise(0)).over(w)).withColumn("line_class", F.col("cls"))
    of = Window.partitionBy(key, "session").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("head", F.first("line_class").over(of)).where("head = 'footnote'")
    text = F.when(start, F.regexp_extract(F.trim("text"), P.FOOTNOTE_START, 2)).otherwise(F.trim("text"))
    number = F.max(F.when(start, F.regexp_extract(F.trim("text"), P.FOOTNOTE_START, 1)))
    return rows.groupBy(key, "session").agg(number.alias("number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda x: x["t"]), " ").alias("text"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end")).drop("session")


def footnote_links(units_: DataFrame, notes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Footnotes with the units that refer to them."""
    refs = units_.select(key, "unit_id", F.explode("footnote_refs").alias("number")).distinct()
    return notes.select(key, "number").distinct().join(refs, [key, "number"], "left").groupBy(key, "number").agg(F.array_sort(F.collect_set("unit_id")).alias("referenced_by"))


def unit_index(units_: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections, subsections and clauses by id; of one id given twice the last counts."""
    return units_.where(F.col("type").isin("section", "subsection", "clause")).groupBy(key, "unit_id").agg(*(F.max_by(c, "place").alias(c) for c in ("type", "number", "section_id", "subsection_id")))


def nested_json(units_: DataFrame, key: str = "doc_id") -> DataFrame:
    """One JSON document a row. Units in reading order with their depths are the tree in pre-order, so the nesting is
    a matter of how many brackets close before each unit: one group-by and one array expression, no recursion."""
    head = F.to_json(F.struct("type", "number", F.col("unit_id").alias("id"), "text"))
    one = units_.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "depth", head.alias("head")))).alias("u"))

    def piece(x: Column, i: Column) -> Column:
        before = F.get("u", i - 1)["depth"]
        closing = F.when(i == 0, F.lit("")).otherwise(F.concat(F.repeat(F.lit("]}"), F.greatest(before - x["depth"] + 1, F.lit(0))), F.when(before >= x["depth"], F.lit(",")).otherwise(F.lit(""))))
        return F.concat(closing, F.left(x["head"], F.length(x["head"]) - 1), F.lit(',"children":['))

    body = F.array_join(F.transform("u", piece), "")
    return one.select(key, F.concat(F.lit('{"sections":['), body, F.repeat(F.lit("]}"), F.element_at("u", -1)["depth"]), F.lit("]}")).alias("json"))


def simple_tree(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """The simple parser: any header opens a section, every other unit is its direct child, other text belongs to it."""
    t = F.trim("text")
    sub, clause, item = (t.rlike(p) for p in (r"^\(\d+[A-Z]*\)", r"^\([a-z]{1,3}\)", r"^\([A-Z]{1,2}\)"))
    header = t.rlike(r"(?i)^(?:#+\s*)?(?:Section\s+)?\d+[A-Z]*\.?\s") & ~t.startswith("(")
    kind = F.when(header, "section").when(sub, "subsection").when(clause, "clause").when(item, "item").otherwise("text")
    number = F.when(header, F.regexp_extract(t, P.SIMPLE_HEADER, 1)).when(kind != "text", F.regexp_extract(t, r"^\(([^)]*)\)", 1))
    rows = lines.select(key, "line_no", "text", kind.alias("type"), number.alias("number"))
    section = F.coalesce(F.last(F.when(F.col("type") == "section", F.col("number")), ignorenulls=True).over(so_far(key)), F.lit("1"))
    return rows.withColumn("section", section).where("type <> 'text'").select(key, "line_no", "type", "number", F.when(F.col("type") == "section", F.col("number")).otherwise(F.concat_ws("-", "section", "number")).alias("unit_id"))
