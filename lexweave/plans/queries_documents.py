"""Queries over placed lines, tables and reports, registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import fold, hierarchy, layout, lines, mentions, tables
from ..operators.finish import document_json
from ..operators.positioned import parsed_positioned
from . import hooks, pipeline
from .queries import _CLASS, _CLEAN, _EDGES, _G, _ITEM, _KEY, _L, _PATH, _S, _TARGETS, QUERIES, SQL, _fold_lines, _glyphs, _spans, _table, _targets, _units, q, query

__all__ = ["QUERIES", "SQL"]
_C = F.col

# Placed lines: left edges by kind of line, nine lines a page

_EDGES_X = (30.0, 45.0, 60.0, 75.0, 45.0, 30.0, 45.0, 200.0, 36.0, 36.0, 120.0, 30.0, 30.0, 30.0, 30.0, 60.0)


def _placed(spark, sf_dir):
    kind = _C("kind")
    text = F.when(kind == 14, "7").when(kind == 15, "A B C").otherwise(_C("text"))
    return _units(spark, sf_dir).select(
        "doc_id", (F.expr("line_no div 9") + 1).cast("int").alias("page"), "line_no", F.element_at(F.array(*map(F.lit, _EDGES_X)), kind + 1).alias("x"), (_C("line_no") % 9 * 12).cast("double").alias("y"),
        F.when(kind == 14, 7.0).otherwise(9.0).alias("font"), (kind == 6).alias("bold"), "kind", text.alias("text"),
    )


_PLACED = f"""{_L}, placed AS (SELECT doc_id, line_no, ([{", ".join(map(str, _EDGES_X))}])[kind + 1]::DOUBLE AS x, (line_no * 37 % 100)::DOUBLE AS y, (line_no // 9 + 1)::INT AS page,
  CASE kind WHEN 14 THEN 7.0 ELSE 9.0 END AS font, CASE kind WHEN 14 THEN '7' WHEN 15 THEN 'A B C' ELSE text END AS text FROM lines)"""


@query()
def q66_positioned_units(spark, sf_dir):
    return parsed_positioned(_placed(spark, sf_dir))


@query(rf"""WITH {_PLACED}, s AS (SELECT *, regexp_matches(text, '^\d+[A-Z]?\.') AND x <= 30.5 AS section_start FROM placed)
SELECT doc_id, line_no, section_start, trim(text) IN ({", ".join(map(q, P.BANNERS))}) OR (regexp_matches(trim(text), '^\d+$') AND font <= 7.5) AS furniture,
  section_start OR (regexp_matches(text, '^\([a-z]\)\s') AND x <= 45) OR regexp_matches(text, {q(P.EXPLANATION)}) OR regexp_matches(text, {q(P.PROVISO)}) OR regexp_matches(text, {q(P.ILLUSTRATION)}) AS post_table,
  regexp_matches({_CLEAN.format("text")}, '^(?:[A-Z]\s+){{2,}}[A-Z]$') AS column_letters, upper(regexp_replace(text, '[|*_\s]', '', 'g')) = 'TABLE' OR regexp_matches(trim(text), '(?i)^Sl\.\s*No\.?\b') AS table_title FROM s""")
def q67_positioned_flags(spark, sf_dir):
    return _placed(spark, sf_dir).select(
        "doc_id", "line_no", lines.is_section_start_at().alias("section_start"), lines.is_header_or_page_number().alias("furniture"), lines.is_post_table_body().alias("post_table"), lines.is_column_letters().alias("column_letters"),
        lines.is_table_title().alias("table_title"),
    )


@query(f"WITH {_PLACED} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, x, line_no)::INT AS place FROM placed")
def q68_reading_order(spark, sf_dir):
    scrambled = _placed(spark, sf_dir).withColumn("y", (_C("line_no") * 37 % 100).cast("double"))
    return lines.in_reading_order(scrambled).select("doc_id", "line_no", "place")


@query()
def q80_document_json(spark, sf_dir):
    """Finished documents of the exact parser."""
    return document_json(fold.parsed(_fold_lines(spark, sf_dir)))


# Tables

_MARKERS = [f"CASE WHEN strpos(body, {q(m)}) > 0 THEN strpos(body, {q(m)}) ELSE 1000000 END" for m in P.DEDUCTION_MARKERS]


@query(rf"""WITH {_L}, said AS (SELECT doc_id, line_no, CASE kind WHEN 9 THEN '(' || kind || ')  item ' || doc_id || ' Minimum of— a tenth' WHEN 8 THEN '7. plain item' WHEN 10 THEN '8.' ELSE {_CLEAN.format("text")} END AS t FROM lines),
parts AS (SELECT doc_id, line_no, {_CLEAN.format("t")} AS t FROM said),
items AS (SELECT doc_id, line_no, coalesce(try_cast(nullif(regexp_extract(t, '^(?:\((\d+)\)|(\d+)\.)\s+(\S.*)$', 1) || regexp_extract(t, '^(?:\((\d+)\)|(\d+)\.)\s+(\S.*)$', 2), '') AS INT), {_ITEM.format("t")}) AS item_no, regexp_extract(t, '^(?:\((\d+)\)|(\d+)\.)\s+(\S.*)$', 3) AS body FROM parts),
cut AS (SELECT *, least({", ".join(_MARKERS)}) AS mark FROM items WHERE item_no IS NOT NULL)
SELECT doc_id, line_no, item_no, CASE WHEN mark < 1000000 THEN trim(substr(body, 1, mark - 1)) ELSE body END AS description, CASE WHEN mark < 1000000 THEN trim(substr(body, mark)) ELSE '' END AS amount FROM cut""")
def q69_loose_rows(spark, sf_dir):
    kind = _C("kind")
    said = F.when(kind == 9, F.concat(F.lit("("), kind.cast("string"), F.lit(")  item "), _C("doc_id").cast("string"), F.lit(" Minimum of— a tenth"))).when(kind == 8, "7. plain item").when(kind == 10, "8.").otherwise(_C("text"))
    return tables.loose_rows(_units(spark, sf_dir).withColumn("text", said), _KEY[:1])


_GATHERED = "gathered AS (SELECT (doc_id // 4)::INT AS doc_id, (doc_id % 4 * 16 + line_no)::INT AS line_no, kind, doc_id AS own, text FROM lines)"


def _gathered(spark, sf_dir):
    """Four documents as one."""
    return _units(spark, sf_dir).select(F.expr("doc_id div 4").cast("int").alias("doc_id"), (_C("doc_id") % 4 * 16 + _C("line_no")).cast("int").alias("line_no"), "kind", _C("doc_id").alias("own"), "text")


@query(f"""WITH {_L}, {_GATHERED}, t AS (SELECT doc_id, line_no, CASE WHEN own % 4 = 0 THEN NULL ELSE doc_id || '-1' END AS unit_id FROM gathered WHERE kind IN (7, 8))
SELECT doc_id, line_no, coalesce(unit_id, 'table') || '-table-' || row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY line_no) AS table_id FROM t""")
def q70_table_ids(spark, sf_dir):
    rows = _gathered(spark, sf_dir).where("kind in (7, 8)").withColumn("unit_id", F.when(_C("own") % 4 != 0, F.concat(_C("doc_id").cast("string"), F.lit("-1"))))
    return tables.table_ids(rows).select("doc_id", "line_no", "table_id")


@query(rf"""WITH {_L}, {_GATHERED}, h AS (SELECT doc_id, line_no, CASE WHEN kind = 15 THEN '**Title ' || own || '**' WHEN kind = 3 THEN '## Other ' || own ELSE text END AS text FROM gathered),
c AS (SELECT *, {_CLASS} AS cls FROM h), s AS (SELECT *, sum(CASE WHEN cls = 'section' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) - CASE WHEN cls = 'section' THEN 1 ELSE 0 END AS stretch FROM c),
t AS (SELECT *, last_value(CASE WHEN cls = 'heading' THEN regexp_replace(text, '^#+\s+|^\*\*|\*\*$', '', 'g') END IGNORE NULLS) OVER (PARTITION BY doc_id, stretch ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title FROM s)
SELECT doc_id, line_no, regexp_extract(text, {q(P.SECTION_START)}, 1) AS number, title FROM t WHERE cls = 'section'""")
def q71_pending_titles(spark, sf_dir):
    own = _C("own").cast("string")
    text = F.when(_C("kind") == 15, F.concat(F.lit("**Title "), own, F.lit("**"))).when(_C("kind") == 3, F.concat(F.lit("## Other "), own)).otherwise(_C("text"))
    return hierarchy.pending_titles(_gathered(spark, sf_dir).withColumn("text", text))


# Units, references and reports


@query(f"WITH {_PATH} SELECT doc_id, unit_id, arg_max(level, place) AS type, arg_max(number, place) AS number, arg_max(section_id, place) AS section_id, arg_max(subsection_id, place) AS subsection_id FROM tree WHERE level IN ('section', 'subsection', 'clause') GROUP BY doc_id, unit_id")
def q72_unit_index(spark, sf_dir):
    return hierarchy.unit_index(hierarchy.units(_units(spark, sf_dir)))


_INDEX = "idx AS (SELECT DISTINCT doc_id::VARCHAR AS unit_id FROM lines UNION SELECT DISTINCT doc_id::VARCHAR || '-1' FROM lines)"


def _index(spark, sf_dir):
    own = _units(spark, sf_dir).select(_C("doc_id").cast("string").alias("unit_id")).distinct()
    return own.unionByName(own.select(F.concat("unit_id", F.lit("-1")).alias("unit_id")))


@query(f"WITH {_TARGETS}, {_INDEX} SELECT doc_id, line_no, anchor, start, target_id FROM targets t WHERE NOT EXISTS (SELECT 1 FROM idx WHERE idx.unit_id = t.target_id)")
def q73_unresolved_report(spark, sf_dir):
    return mentions.unresolved(_targets(spark, sf_dir), _index(spark, sf_dir)).select("doc_id", "line_no", "anchor", "start", "target_id")


@query(f"""WITH {_TARGETS}, {_INDEX} SELECT 'documents' AS counter, count(DISTINCT doc_id) AS n FROM lines UNION ALL SELECT 'lines', count(*) FROM lines UNION ALL SELECT 'references', count(*) FROM targets
UNION ALL SELECT 'unresolved', count(*) FROM targets t WHERE NOT EXISTS (SELECT 1 FROM idx WHERE idx.unit_id = t.target_id)""")
def q74_run_counters(spark, sf_dir):
    refs, units = _targets(spark, sf_dir), _units(spark, sf_dir)
    return pipeline.counters(documents=units.select("doc_id").distinct(), lines=units, references=refs, unresolved=mentions.unresolved(refs, _index(spark, sf_dir)))


@query(f"""WITH {_EDGES}, outgoing AS (SELECT src, string_agg(dst, ',' ORDER BY dk, dst) AS targets FROM edges GROUP BY src),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY sk, src) AS r FROM edges), incoming AS (SELECT dst, count(*) AS n, string_agg(src, ',' ORDER BY r) FILTER (WHERE r <= 8) AS callers FROM ranked GROUP BY dst)
SELECT coalesce(src, dst) AS section, coalesce(targets, '') AS targets, coalesce(n, 0) AS n_callers, coalesce(callers, '') AS callers FROM outgoing FULL JOIN incoming ON src = dst""")
def q75_section_report(spark, sf_dir):
    return mentions.section_report(mentions.outgoing_edges(_units(spark, sf_dir).select("doc_id", "text")))


@query()
def q76_model_references(spark, sf_dir):
    """Detected references and those of a stand-in model, which names each line's first word; anchors seen already stay out."""
    texts = pipeline.open_texts(_units(spark, sf_dir))
    return hooks.with_model_references(mentions.detected(texts, _KEY), texts, _KEY, lambda batch: batch.assign(anchor=batch["text"].str.split().str[0], target_id="model"))


# Layout


@query("""WITH s AS (SELECT n_nationkey AS id, [n_nationkey || '-' || (n_nationkey + 2), (n_nationkey * 2)::VARCHAR, n_nationkey::VARCHAR] AS parts FROM nation),
p AS (SELECT id, list_sort(list_distinct(flatten(list_transform(parts, lambda x: range(split_part(x, '-', 1)::INT, split_part(x, '-', -1)::INT + 1))))) AS pages FROM s)
SELECT id, unnest(pages)::INT AS page, generate_subscripts(pages, 1)::INT AS place FROM p""")
def q77_selected_pages(spark, sf_dir):
    n = _C("n_nationkey")
    spec = F.concat_ws(",", F.concat_ws("-", n.cast("string"), (n + 2).cast("string")), (n * 2).cast("string"), n.cast("string"))
    return _table(spark, sf_dir, "nation", "n_nationkey").select(n.alias("id"), F.posexplode(layout.selected_pages(spec)).alias("place", "page")).select("id", "page", (_C("place") + 1).alias("place"))


@query(f"""WITH {_S}, sizes AS (SELECT page, round(size, 1) AS s, count(*) AS n, min(ord) AS o FROM spans GROUP BY ALL), dom AS (SELECT page, arg_max(s, (n, -o)) AS dominant FROM sizes GROUP BY page)
SELECT ord, size < dominant * 0.85 AS superscript FROM spans JOIN dom USING (page)""")
def q78_superscripts(spark, sf_dir):
    return layout.superscripts(_spans(spark, sf_dir), ["page"]).select("ord", "superscript")


@query(f"""WITH RECURSIVE {_G}, chars AS (SELECT g.*, (ord % 9)::DOUBLE AS y0 FROM glyphs g),
firsts AS (SELECT line, 0 AS n, min(y0) AS y FROM chars WHERE NOT superscript GROUP BY line
  UNION ALL SELECT f.line, f.n + 1, min(g.y0) FROM firsts f JOIN chars g ON g.line = f.line AND NOT g.superscript AND g.y0 - f.y > 3 GROUP BY f.line, f.n, f.y)
SELECT c.ord, arg_min(f.n, (abs(f.y - c.y0), f.n))::INT AS on_line FROM chars c LEFT JOIN firsts f ON f.line = c.line GROUP BY c.ord""")
def q81_glyph_lines(spark, sf_dir):
    return layout.glyph_lines(_glyphs(spark, sf_dir).withColumnRenamed("line", "page"), ["page"]).select("ord", "on_line")


@query(r"""WITH w AS (SELECT n_nationkey AS i, ['(3) abc', '4.def', '5.', '7', '10%', '(6)', '8. x'][n_nationkey % 7 + 1] AS t FROM nation),
m AS (SELECT *, regexp_extract(t, '^(?:\((\d+)\)|(\d+)\.)\s*(.*)$', 1) || regexp_extract(t, '^(?:\((\d+)\)|(\d+)\.)\s*(.*)$', 2) AS n FROM w)
SELECT i, try_cast(nullif(n, '') AS INT) AS item_no, CASE WHEN n <> '' THEN regexp_extract(t, '^(?:\((\d+)\)|(\d+)\.)\s*(.*)$', 3) ELSE t END AS body FROM m""")
def q82_placed_item_numbers(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ("(3) abc", "4.def", "5.", "7", "10%", "(6)", "8. x"))), (_C("n_nationkey") % 7 + 1).cast("int"))
    item = T.item_number(said, placed=True)
    return _table(spark, sf_dir, "nation", "n_nationkey").select(_C("n_nationkey").alias("i"), item["item_no"].alias("item_no"), item["body"].alias("body"))


_FIRST = """cut AS (SELECT *, line // 7 AS region, CASE WHEN x0 - (lag(x0) OVER (PARTITION BY line ORDER BY x0, ord) + 5) > 18 THEN 1 ELSE 0 END AS cut FROM glyphs),
celled AS (SELECT *, sum(cut) OVER (PARTITION BY line ORDER BY x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cell FROM cut),
cells AS (SELECT region, line, cell, min(x0) AS x FROM celled GROUP BY ALL), tails AS (SELECT region, line, max(cell) AS cell, arg_max(x, x) AS x FROM cells GROUP BY ALL),
bounds AS (SELECT region, min(x) - 5 AS bound FROM tails WHERE cell > 0 GROUP BY region)"""


@query(f"""WITH {_G}, {_FIRST}, again AS (SELECT g.*, b.bound, lag(x0) OVER w AS before FROM cut g LEFT JOIN bounds b USING (region) WINDOW w AS (PARTITION BY line ORDER BY x0, ord)),
recut AS (SELECT *, CASE WHEN x0 - (before + 5) > 18 OR (before < bound AND bound <= x0 AND x0 - (before + 5) > 0.1) THEN 1 ELSE 0 END AS new_cell FROM again),
numbered AS (SELECT *, sum(new_cell) OVER (PARTITION BY line ORDER BY x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM recut)
SELECT region::INT AS region, line, n::BIGINT AS cell, string_agg(c, '' ORDER BY x0, ord) AS text FROM numbered GROUP BY region, line, n""")
def q79_region_cells(spark, sf_dir):
    glyphs = _glyphs(spark, sf_dir).withColumn("region", F.expr("line div 7").cast("int"))
    return layout.region_cells(glyphs, ["region"]).select("region", "line", "cell", "text")
