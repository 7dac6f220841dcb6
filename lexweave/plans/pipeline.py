"""End-to-end plans: lines to units to located, classified and resolved references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators import hierarchy, mentions
from ..operators.lines import reading_order, so_far
from .hooks import Hook, ModelConfig, apply_hook


def open_texts(lines: DataFrame) -> DataFrame:
    """Every line's text with the ids open at it: what relative references need."""
    rows = hierarchy.with_ids(hierarchy.open_path(hierarchy.token_rows(lines)))
    last = rows.groupBy("doc_id", "line_no").agg(*(F.max_by(c, "ord").alias(c) for c in ("unit_id", "section_id", "subsection_id", "clause_id", "sub_clause_id", "item_id")))
    return lines.select("doc_id", "line_no", "text").join(last, ["doc_id", "line_no"])


def whole_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, place, line_no, source_type, unit_id, section_id, subsection_id, text): the joined text of each unit, and
    singly, with their class as source_type, the lines that are no unit's text (tables, footnotes, explanations, orphans)."""
    rows = hierarchy.with_ids(hierarchy.open_path(hierarchy.token_rows(lines)))
    opened = F.max(F.when(F.col("level").isNotNull(), F.col("place"))).over(so_far("doc_id", line="place"))
    speaks = F.coalesce(F.lead("line_no").over(reading_order("doc_id", line="place")) != F.col("line_no"), F.lit(True))  # the last unit of a line has its text
    single = F.col("opened").isNull() | F.col("cls").isin(*hierarchy.NO_UNIT_TEXT, *hierarchy.SPECIAL)
    rows = rows.withColumn("opened", opened).withColumn("said", F.when(speaks, F.struct("place", "rest")))
    rows = rows.withColumn("at", F.when(single, F.col("place")).otherwise(F.col("opened")))
    head = F.min_by(F.struct("line_no", F.coalesce("level", "cls").alias("source_type"), "unit_id", "section_id", "subsection_id"), "place")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("said")), lambda x: x["rest"]), " ")
    return rows.groupBy("doc_id", "at").agg(head.alias("head"), clean_text(text).alias("text")).select("doc_id", F.col("at").alias("place"), "head.*", "text")


def enriched(texts: DataFrame, units: DataFrame, parity: bool = False, by_document: bool = False) -> DataFrame:
    """Located references of whole_texts, resolved against units; start and end are places in the joined text.

    The reference looks at sections, subsections and clauses only: those are the rows of these source_types.
    """
    key = ["doc_id", "place"]
    spans = mentions.uncontained(mentions.located_spans(texts, [*key, "line_no", "source_type", "unit_id", "section_id", "subsection_id"], parity), key)
    refs = mentions.resolved(spans, parity=parity).withColumn("relationship", mentions.window90())
    reason = F.when(F.col("target_id").isNull(), "no open unit")
    out = mentions.with_confidence(refs.withColumn("reason", reason), units, by_document)
    return out.withColumn("reason", F.coalesce("reason", F.when(~F.col("resolved"), "not in index")))


def agent(lines: DataFrame, heal: Hook | None = None, config: ModelConfig | None = None) -> DataFrame:
    """Simple tree, optional healing, reference detection: (doc_id, line_no, anchor, targets, ...)."""
    tree = apply_hook(hierarchy.simple_tree(lines), heal, config)
    w = mentions.Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(mentions.Window.unboundedPreceding, 0)
    at = lines.join(tree.select("doc_id", "line_no", "unit_id"), ["doc_id", "line_no"], "left").withColumn("unit_id", F.last("unit_id", ignorenulls=True).over(w))
    null = F.lit(None).cast("string")
    texts = at.select("doc_id", "line_no", "text", "unit_id", F.element_at(F.split("unit_id", "-"), 1).alias("section_id"), null.alias("subsection_id"), null.alias("clause_id"), null.alias("sub_clause_id"), null.alias("item_id"))
    return mentions.detected(texts, ["doc_id", "line_no"], "lookback70")


def counters(**counted: DataFrame) -> DataFrame:
    """(counter, n): the rows of each of a run's tables."""
    out = None
    for name, rows in counted.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        out = one if out is None else out.unionByName(one)
    return out
