"""Generators: every match of a pattern as a row, with its place. No Python, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import expand_range, number_key, number_tokens, reference_id, without_tags, without_tail_punctuation


def located_matches(text: Column, pattern: str) -> Column:
    """array<struct<text, start, end>> (0-based, end exclusive): a text is gap, match, gap, match, ... gap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
    start = lambda i: total(F.slice(gaps, 1, i + 1)) + total(F.slice(found, F.lit(1), i))
    return F.transform(found, lambda m, i: F.struct(m.alias("text"), start(i).alias("start"), (start(i) + F.length(m)).alias("end")))


def relation_mentions(units: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """units (.., text) to a row a mention: kind, ord, mention. All kinds come from one scan of the text."""
    clean = without_tags(F.col("text"))

    def tidy(kind: str):
        return lambda m: without_tail_punctuation(m) if kind == "table" else F.trim(m) if kind == "schedule" else m

    every = lambda k: F.regexp_extract_all(clean, F.lit(P.RELATION_KINDS[k]), F.lit(0))
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.transform(every(k), tidy(k)).alias("m")) for k in kinds or P.RELATION_KINDS))
    rest = [c for c in units.columns if c != "text"]
    return units.select(*rest, F.explode(found).alias("f")).select(*rest, F.col("f.kind").alias("kind"), F.posexplode("f.m").alias("ord", "mention"))


def section_targets(mention: Column, parity: bool = False) -> Column:
    """Sections that a section mention names. parity: digits in parentheses count as sections too."""
    return F.regexp_extract_all(mention if parity else F.regexp_replace(mention, r"\([^)]*\)", ""), F.lit(r"(?i)\b(\d+[A-Z]?)\b"), F.lit(1))


def outgoing_edges(units: DataFrame, parity: bool = False) -> DataFrame:
    """Distinct (src, dst) of section mentions, without a section's own number and without sections of other acts."""
    text = F.col("text") if parity else F.regexp_replace("text", P.RELATION_KINDS["external_act"], " ")
    mentions = relation_mentions(units.select(F.col("doc_id").cast("string").alias("src"), text.alias("text")), ("section",))
    return mentions.select("src", F.explode(section_targets(F.col("mention"), parity)).alias("dst")).where("dst <> src").distinct()


def incoming(edges: DataFrame) -> DataFrame:
    """dst with its number of sources and the first sources by number."""
    return edges.groupBy("dst").agg(F.count("*").alias("n"), F.min(F.struct(number_key("src").alias("k"), "src")).alias("first"))


def top_referenced(edges: DataFrame, k: int = 15) -> DataFrame:
    """The k targets with most sources; ties by number, then text. A top-k, no global sort."""
    ranked = edges.groupBy("dst").agg(F.count("*").alias("n"))
    return ranked.orderBy(F.desc("n"), number_key("dst"), "dst").limit(k)


def callers(edges: DataFrame, most: int = 8) -> DataFrame:
    """dst and its first `most` sources by number, as a list: bounded by a rank, so no list grows with a hot target."""
    w = Window.partitionBy("dst").orderBy(number_key("src"), "src")
    few = edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return few.groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("r", "src"))).alias("s")).select("dst", F.array_join(F.col("s.src"), ",").alias("callers"))


def located_spans(units: DataFrame, key: list[str], parity: bool = False) -> DataFrame:
    """A row a span of every located kind: kind, prio, ord, anchor, start, end."""
    kinds = list(P.LOCATED_KINDS)
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("prio"), located_matches(F.col("text"), P.located(k, parity)).alias("m")) for i, k in enumerate(kinds)))
    return (
        units.where(F.lower("text").rlike("section|clause|paragraph|schedule"))
        .select(*key, "text", F.explode(found).alias("f"))
        .select(*key, "text", "f.kind", "f.prio", F.posexplode("f.m").alias("ord", "s"))
        .select(*key, "text", "kind", "prio", "ord", F.col("s.text").alias("anchor"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    )


def uncontained(spans: DataFrame, key: list[str]) -> DataFrame:
    """Spans not inside a span of an earlier kind of the same unit: a hash anti-join on the unit with a residual."""
    s, e = spans.alias("s"), spans.select(*key, "prio", "start", "end").alias("e")
    same = [F.col(f"s.{k}") == F.col(f"e.{k}") for k in key]
    inside = (F.col("e.start") <= F.col("s.start")) & (F.col("e.end") >= F.col("s.end")) & (F.col("e.prio") < F.col("s.prio"))
    on = inside
    for c in same:
        on = on & c
    return s.join(e, on, "left_anti")


def resolved(spans: DataFrame, section: str = "section_id", subsection: str = "subsection_id", parity: bool = False) -> DataFrame:
    """Adds target_id and target_type. A relative target without an open unit to start from is null."""
    kind = F.col("kind")
    part = lambda k, i: F.nullif(F.regexp_extract("anchor", P.located(k, parity), i), F.lit(""))
    low = F.lower
    para = F.concat_ws("-", F.concat(F.lit("schedule-"), F.upper(part("para_schedule", 5))), F.concat(F.lit("part-"), F.upper(part("para_schedule", 4))), F.concat(F.lit("para-"), part("para_schedule", 1)), part("para_schedule", 2))
    sched = F.concat_ws("-", F.concat(F.lit("schedule-"), F.upper(part("schedule", 2))), F.concat(F.lit("part-"), F.upper(part("schedule", 1))))
    subs = F.when(F.col(section).isNotNull(), F.concat_ws("-", F.col(section), part("subsection", 1), low(part("subsection", 2))))
    sect = F.concat_ws("-", part("section", 1), part("section", 2), low(part("section", 3)), low(part("section", 4)))
    clau = F.when(F.col(subsection).isNotNull(), F.concat_ws("-", F.col(subsection), low(part("clause", 1))))
    target = F.when(kind == "para_schedule", para).when(kind == "schedule", sched).when(kind == "subsection", subs).when(kind == "section", sect).otherwise(clau)
    of_section = F.when(part("section", 4).isNotNull(), "subclause").when(part("section", 3).isNotNull(), "clause").when(part("section", 2).isNotNull(), "subsection").otherwise("section")
    kinds = (
        F.when(kind == "para_schedule", "paragraph")
        .when(kind == "schedule", F.when(part("schedule", 1).isNotNull(), "part").otherwise("schedule"))
        .when(kind == "subsection", F.when(part("subsection", 2).isNotNull(), "clause").otherwise("subsection"))
        .when(kind == "section", of_section)
        .otherwise("clause")
    )
    return spans.withColumn("target_id", target).withColumn("target_type", kinds)


def window90(text: str = "text", start: str = "start", end: str = "end") -> Column:
    """Relationship from 90 characters either side; the order of rules decides."""
    t, s, e = F.col(text), F.col(start), F.col(end)
    window = F.lower(F.substring(t, F.greatest(s - 90, F.lit(0)) + 1, e + 90 - F.greatest(s - 90, F.lit(0))))
    before = F.lower(F.substring(t, F.greatest(s - 90, F.lit(0)) + 1, s - F.greatest(s - 90, F.lit(0))))
    any_of = lambda w, *xs: w.rlike("|".join(xs))
    return (
        F.when(F.right(before, F.lit(40)).contains("subject to"), "subject_to")
        .when(any_of(window, "shall not apply", "not apply"), "exception_to")
        .when(window.contains("subject to"), "subject_to")
        .when(window.contains("notwithstanding"), "overrides")
        .when(any_of(window, "within the meaning of", "as defined in", "defined in", "means"), "definition_reference")
        .when(any_of(window, "in accordance with", "to the extent provided in", "provided in"), "procedure_reference")
        .when(any_of(F.right(before, F.lit(30)), "under", "as per") | window.contains("mentioned in"), "depends_on")
        .when(window.contains("for the purposes of"), "definition_or_scope")
        .otherwise("related_to")
    )


def lookback(rules: list[tuple[str, str]], reach: int, otherwise: str, text: str = "text", start: str = "start") -> Column:
    """Relationship from the `reach` characters before a span."""
    s = F.col(start)
    before = F.lower(F.substring(F.col(text), F.greatest(s - reach, F.lit(0)) + 1, s - F.greatest(s - reach, F.lit(0))))
    out = None
    for pattern, label in rules:
        out = F.when(before.rlike(pattern), label) if out is None else out.when(before.rlike(pattern), label)
    return out.otherwise(otherwise)


def with_confidence(refs: DataFrame, index: DataFrame, by_document: bool = True) -> DataFrame:
    """Left look-up of targets among units: high if there, else medium. by_document: only the same document's units."""
    keys = ["doc_id", "target_id"] if by_document else ["target_id"]
    known = index.select(*([F.col("doc_id")] if by_document else []), F.col("unit_id").alias("target_id"), F.lit(True).alias("resolved")).distinct()
    out = refs.join(known, keys, "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    return out.withColumn("confidence", F.when(F.col("resolved"), "high").otherwise("medium"))


def unresolved(refs: DataFrame, index: DataFrame) -> DataFrame:
    """References whose target is no unit of the index (unit_id): an anti-join on the target; those without a target stay."""
    return refs.join(index.select(F.col("unit_id").alias("target_id")), "target_id", "left_anti")


def section_report(edges: DataFrame, most: int = 8) -> DataFrame:
    """section, its targets, how many sections name it and the first of them by number."""
    into = incoming(edges).select("dst", F.col("n").alias("n_callers")).join(callers(edges, most), "dst")
    both = target_lists(edges).join(into, F.col("src") == F.col("dst"), "full_outer")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return both.select(F.coalesce("src", "dst").alias("section"), blank("targets"), F.coalesce("n_callers", F.lit(0)).alias("n_callers"), blank("callers"))


def merge_references(existing: DataFrame, new: DataFrame, unit: list[str]) -> DataFrame:
    """Union without repeats of (target_id, anchor, relationship) in a unit; existing rows win, then order."""
    both = existing.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)))
    w = Window.partitionBy(*unit, "target_id", "anchor", "relationship").orderBy("src", "ord")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def detected(units: DataFrame, key: list[str], style: str = "lookback60") -> DataFrame:
    """External, express and relative references of each unit.

    An express anchor inside the anchor of another act's section is passed over. style lookback60: one row a number;
    lookback70: ranges are expanded into one list, and express anchors inside an earlier express one are passed over too.
    """
    kinds = (("external", P.EXTERNAL), ("express", P.EXPRESS), ("relative", P.RELATIVE))
    found = F.array(*(F.struct(F.lit(i).alias("cls"), F.lit(k).alias("kind"), located_matches(F.col("text"), p).alias("m")) for i, (k, p) in enumerate(kinds)))
    rows = units.select("*", F.explode(found).alias("f")).select(*units.columns, F.col("f.cls").alias("cls"), F.col("f.kind").alias("kind"), F.posexplode("f.m").alias("ord", "s"))
    rows = rows.select(*units.columns, "cls", "kind", "ord", F.col("s.text").alias("anchor"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    first = Window.partitionBy(*key, "anchor").orderBy("cls", "start")
    rows = rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    earlier = rows.where("kind = 'external'" if style == "lookback60" else "kind in ('external', 'express')").select(*key, "kind", "start", F.col("anchor").alias("outer"))
    a, e = rows.alias("a"), earlier.alias("e")
    on = (F.col("a.kind") == "express") & F.expr("contains(e.outer, a.anchor)") & ((F.col("e.kind") == "external") | (F.col("e.start") < F.col("a.start")))
    for k in key:
        on = on & (F.col(f"a.{k}") == F.col(f"e.{k}"))
    rows = a.join(e, on, "left_anti")
    prefix = F.lower(F.regexp_extract("anchor", P.EXPRESS, 1))
    numbers = F.regexp_extract("anchor", P.EXPRESS, 2)
    targets = (
        F.when(F.col("kind") == "external", F.array(F.concat_ws(":", F.lit("external"), F.trim(F.regexp_extract("anchor", P.EXTERNAL, 2)), F.regexp_extract("anchor", P.EXTERNAL, 1))))
        .when(F.col("kind") == "express", expand_range(numbers) if style == "lookback70" else number_tokens(numbers))
        .otherwise(F.array(relative_target(F.lower(F.regexp_extract("anchor", P.RELATIVE, 1)))))
    )
    level = F.when(F.col("kind") == "external", "external_act").when(F.col("kind") == "relative", F.replace(F.lower(F.regexp_extract("anchor", P.RELATIVE, 1)), F.lit("-"), F.lit("_")))
    kind_of = F.when(prefix.startswith("sub-section"), "subsection").when(prefix.startswith("sub-clause"), "sub_clause").when(prefix.startswith("clause"), "clause").when(prefix.startswith("item"), "item").otherwise("section")
    rules = lookback(P.LOOKBACK70, 70, "related_to") if style == "lookback70" else lookback(P.LOOKBACK60, 60, "refers_to")
    out = rows.withColumn("targets", targets).withColumn("target_type", F.coalesce(level, kind_of)).withColumn("relationship", rules)
    out = out.withColumn("confidence", F.when(F.col("kind") == "relative", "medium").otherwise("high"))
    if style == "lookback60":
        return out.select("*", F.posexplode("targets").alias("n", "target_id")).drop("targets")
    return out.withColumn("target_id", F.array_join("targets", ",")).withColumn("n", F.lit(0)).drop("targets")


def relative_target(level: Column) -> Column:
    """The open ancestor of a level, else the deepest open one, else unknown. Needs ancestor columns."""
    at = lambda *names: F.coalesce(*(F.col(n) for n in names))
    deepest = at("item_id", "sub_clause_id", "clause_id", "subsection_id", "section_id")
    own = (
        F.when(level == "section", F.col("section_id"))
        .when(level == "sub-section", F.col("subsection_id"))
        .when(level == "clause", F.col("clause_id"))
        .when(level == "sub-clause", F.col("sub_clause_id"))
        .when(level == "item", F.col("item_id"))
    )
    return F.coalesce(own, deepest, F.lit("unknown"))


def numbered(refs: DataFrame, document: list[str], order: list[str], unit: str = "unit_id") -> DataFrame:
    """reference_id: a running number in the document."""
    return refs.withColumn("reference_id", reference_id(unit, F.row_number().over(Window.partitionBy(*document).orderBy(*order))))


def target_lists(edges: DataFrame) -> DataFrame:
    """src and its targets by number, then text. A list is bounded by what one document mentions."""
    listed = F.array_sort(F.collect_set(F.struct(number_key("dst").alias("k"), "dst")))
    return edges.groupBy("src").agg(F.array_join(F.transform(listed, lambda x: x["dst"]), ",").alias("targets"))


def ordered_distinct(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct mentions of a document and kind with their place by first appearance."""
    first = mentions.groupBy(key, "kind", "mention").agg(F.min(F.struct("line_no", "ord")).alias("at"))
    w = Window.partitionBy(key, "kind").orderBy("at", "mention")
    return first.select(key, "kind", "mention", F.row_number().over(w).alias("place"))
