"""Queries over the driver's tables, each with an independent SQL statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import audit, fold, hierarchy, layout, lines, mentions, tables
from ..sources.bridge import lines_sql, statute_lines
from . import hooks, pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_C = F.col


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name, *columns):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _units(spark, sf_dir):
    return statute_lines(spark, sf_dir)


_L = f"lines AS ({lines_sql()})"


# References of a corpus as a graph


def _tags_off(column: str) -> str:
    return rf"regexp_replace(regexp_replace({column}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')"


_EDGES = rf"""{_L}, said AS (SELECT doc_id::VARCHAR AS src, unnest(regexp_extract_all({_tags_off(f"regexp_replace(text, {q(P.RELATION_KINDS['external_act'])}, ' ', 'g')")}, {q(P.RELATION_KINDS["section"])})) AS m FROM lines),
named AS (SELECT src, unnest(regexp_extract_all(regexp_replace(m, '\([^)]*\)', '', 'g'), '(?i)\b(\d+[A-Z]?)\b', 1)) AS dst FROM said),
edges AS (SELECT DISTINCT src, dst, try_cast(regexp_extract(dst, '\d+') AS INT) AS dk, try_cast(regexp_extract(src, '\d+') AS INT) AS sk FROM named WHERE dst <> src)"""


@query(f"WITH {_EDGES} SELECT dst, count(*) AS n FROM edges GROUP BY dst, dk ORDER BY n DESC, dk, dst LIMIT 15")
def q01_top_referenced(spark, sf_dir):
    return mentions.top_referenced(mentions.outgoing_edges(_units(spark, sf_dir).select("doc_id", "text")))


@query(f"WITH {_EDGES} SELECT src, string_agg(dst, ',' ORDER BY dk, dst) AS targets FROM edges GROUP BY src")
def q02_outgoing_targets(spark, sf_dir):
    return mentions.target_lists(mentions.outgoing_edges(_units(spark, sf_dir).select("doc_id", "text")))


@query(f"WITH {_EDGES} SELECT dst, count(*) AS n, arg_min(src, (sk, src)) AS first_src FROM edges GROUP BY dst")
def q03_incoming(spark, sf_dir):
    found = mentions.incoming(mentions.outgoing_edges(_units(spark, sf_dir).select("doc_id", "text")))
    return found.select("dst", "n", _C("first.src").alias("first_src"))


@query(f"WITH {_EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY sk, src) AS r FROM edges) SELECT dst, string_agg(src, ',' ORDER BY r) AS callers FROM r WHERE r <= 8 GROUP BY dst")
def q03b_first_callers(spark, sf_dir):
    return mentions.callers(mentions.outgoing_edges(_units(spark, sf_dir).select("doc_id", "text")))


def _mentions_sql(*kinds: str) -> str:
    def one(kind):
        m = r"regexp_replace(m, '[\s).,;:]+$', '')" if kind == "table" else "trim(m)" if kind == "schedule" else "m"
        return f"SELECT doc_id, line_no, '{kind}' AS kind, ord, {m} AS mention FROM (SELECT doc_id, line_no, unnest(l) AS m, (generate_subscripts(l, 1) - 1)::INT AS ord FROM (SELECT doc_id, line_no, regexp_extract_all({_tags_off('text')}, {q(P.RELATION_KINDS[kind])}) AS l FROM lines))"

    return " UNION ALL ".join(one(k) for k in kinds)


def _mentions(*kinds):
    return lambda spark, sf_dir: mentions.relation_mentions(_units(spark, sf_dir).select("doc_id", "line_no", "text"), kinds)


for _name, _kinds in {"q04_external_acts": ("external_act",), "q05_subsections": ("subsection",), "q06_clauses": ("clause",), "q07_items_chapters_parts": ("item", "chapter", "part"), "q08_schedules_tables": ("schedule", "table"), "q08b_sections": ("section",)}.items():
    QUERIES[_name], SQL[_name] = _mentions(*_kinds), f"WITH {_L} {_mentions_sql(*_kinds)}"


@query(f"WITH {_L}, m AS ({_mentions_sql(*P.RELATION_KINDS)}), d AS (SELECT doc_id, kind, mention, min((line_no, ord)) AS first_at FROM m GROUP BY ALL) SELECT doc_id, kind, mention, (row_number() OVER (PARTITION BY doc_id, kind ORDER BY first_at, mention))::INT AS place FROM d")
def q09_all_mentions(spark, sf_dir):
    return mentions.ordered_distinct(_mentions(*P.RELATION_KINDS)(spark, sf_dir))


# Located references


def _located_sql(pattern: str, of: str = "lines", keep: str = "doc_id, line_no, text") -> str:
    total = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
    return f"""SELECT {keep}, i::INT - 1 AS ord, l[i] AS anchor, ({total("g[1:i]")} + {total("l[1:i-1]")})::INT AS start, ({total("g[1:i]")} + {total("l[1:i]")})::INT AS "end"
    FROM (SELECT {keep}, regexp_extract_all(text, {q(pattern)}) AS l, string_split_regex(text, {q(pattern)}) AS g, unnest(range(1, len(regexp_extract_all(text, {q(pattern)})) + 1)) AS i FROM {of})"""


_SPANS = f"{_L}, spans AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {i} AS prio, * FROM ({_located_sql(P.located(k, False))})" for i, k in enumerate(P.LOCATED_KINDS)) + ")"
_KEPT = _SPANS + ', kept AS (SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans e WHERE e.doc_id = s.doc_id AND e.line_no = s.line_no AND e.prio < s.prio AND e.start <= s.start AND e."end" >= s."end"))'
_SPAN_COLUMNS = ("doc_id", "line_no", "kind", "ord", "anchor", "start", "end")
_SPAN_SQL = 'doc_id, line_no, kind, ord, anchor, start, "end"'
_KEY = ["doc_id", "line_no"]


def _kept(spark, sf_dir):
    return mentions.uncontained(mentions.located_spans(_units(spark, sf_dir), _KEY), _KEY)


@query(f"WITH {_SPANS} SELECT {_SPAN_SQL} FROM spans")
def q10_located_spans(spark, sf_dir):
    return mentions.located_spans(_units(spark, sf_dir), _KEY).select(*_SPAN_COLUMNS)


@query(f"WITH {_KEPT} SELECT {_SPAN_SQL} FROM kept")
def q11_containment(spark, sf_dir):
    return _kept(spark, sf_dir).select(*_SPAN_COLUMNS)


def _g(kind, i, lower=False):
    x = f"nullif(regexp_extract(anchor, {q(P.located(kind, False))}, {i}), '')"
    return f"lower({x})" if lower else x


_TARGETS = (
    _KEPT
    + f""", targets AS (SELECT *, CASE kind
  WHEN 'para_schedule' THEN concat_ws('-', 'schedule-' || upper({_g("para_schedule", 5)}), 'part-' || upper({_g("para_schedule", 4)}), 'para-' || {_g("para_schedule", 1)}, {_g("para_schedule", 2)})
  WHEN 'schedule' THEN concat_ws('-', 'schedule-' || upper({_g("schedule", 2)}), 'part-' || upper({_g("schedule", 1)}))
  WHEN 'subsection' THEN concat_ws('-', doc_id::VARCHAR, {_g("subsection", 1)}, {_g("subsection", 2, True)})
  WHEN 'section' THEN concat_ws('-', {_g("section", 1)}, {_g("section", 2)}, {_g("section", 3, True)}, {_g("section", 4, True)})
  ELSE concat_ws('-', doc_id::VARCHAR || '-1', {_g("clause", 1, True)}) END AS target_id,
  CASE kind WHEN 'para_schedule' THEN 'paragraph' WHEN 'schedule' THEN CASE WHEN {_g("schedule", 1)} IS NULL THEN 'schedule' ELSE 'part' END
  WHEN 'subsection' THEN CASE WHEN {_g("subsection", 2)} IS NULL THEN 'subsection' ELSE 'clause' END
  WHEN 'section' THEN CASE WHEN {_g("section", 4)} IS NOT NULL THEN 'subclause' WHEN {_g("section", 3)} IS NOT NULL THEN 'clause' WHEN {_g("section", 2)} IS NOT NULL THEN 'subsection' ELSE 'section' END
  ELSE 'clause' END AS target_type FROM kept)"""
)


def _targets(spark, sf_dir):
    spans = _kept(spark, sf_dir).withColumn("section_id", _C("doc_id").cast("string")).withColumn("subsection_id", F.concat(_C("doc_id").cast("string"), F.lit("-1")))
    return mentions.resolved(spans)


@query(f"WITH {_TARGETS} SELECT {_SPAN_SQL}, target_id, target_type FROM targets")
def q12_target_ids(spark, sf_dir):
    return _targets(spark, sf_dir).select(*_SPAN_COLUMNS, "target_id", "target_type")


@query(f"""WITH {_TARGETS}, idx AS (SELECT DISTINCT doc_id::VARCHAR AS unit_id FROM lines UNION SELECT DISTINCT doc_id::VARCHAR || '-1' FROM lines)
SELECT doc_id, line_no, anchor, start, target_id, i.unit_id IS NOT NULL AS resolved, CASE WHEN i.unit_id IS NULL THEN 'medium' ELSE 'high' END AS confidence FROM targets t LEFT JOIN idx i ON t.target_id = i.unit_id""")
def q13_resolution(spark, sf_dir):
    docs = _units(spark, sf_dir).select("doc_id").distinct()
    own = docs.select("doc_id", _C("doc_id").cast("string").alias("unit_id"))
    index = own.unionByName(own.withColumn("unit_id", F.concat("unit_id", F.lit("-1"))))
    return mentions.with_confidence(_targets(spark, sf_dir), index, by_document=False).select("doc_id", "line_no", "anchor", "start", "target_id", "resolved", "confidence")


_W90 = "lower(substr(text, greatest(start - 90, 0) + 1, \"end\" + 90 - greatest(start - 90, 0)))"
_B90 = "lower(substr(text, greatest(start - 90, 0) + 1, start - greatest(start - 90, 0)))"


@query(f"""WITH {_KEPT} SELECT doc_id, line_no, anchor, start, CASE WHEN contains(right({_B90}, 40), 'subject to') THEN 'subject_to'
  WHEN contains({_W90}, 'not apply') THEN 'exception_to' WHEN contains({_W90}, 'subject to') THEN 'subject_to' WHEN contains({_W90}, 'notwithstanding') THEN 'overrides'
  WHEN regexp_matches({_W90}, 'within the meaning of|defined in|means') THEN 'definition_reference' WHEN regexp_matches({_W90}, 'in accordance with|provided in') THEN 'procedure_reference'
  WHEN regexp_matches(right({_B90}, 30), 'under|as per') OR contains({_W90}, 'mentioned in') THEN 'depends_on' WHEN contains({_W90}, 'for the purposes of') THEN 'definition_or_scope' ELSE 'related_to' END AS relationship FROM kept""")
def q14_relationship_window(spark, sf_dir):
    return _kept(spark, sf_dir).select("doc_id", "line_no", "anchor", "start", mentions.window90().alias("relationship"))


def _lookback_sql(rules, reach, otherwise):
    before = f"lower(substr(text, greatest(start - {reach}, 0) + 1, start - greatest(start - {reach}, 0)))"
    return "CASE " + " ".join(f"WHEN regexp_matches({before}, {q(p)}) THEN '{label}'" for p, label in rules) + f" ELSE '{otherwise}' END AS relationship"


@query(f"WITH {_KEPT} SELECT doc_id, line_no, anchor, start, {_lookback_sql(P.LOOKBACK60, 60, 'refers_to')} FROM kept")
def q15_relationship_lookback60(spark, sf_dir):
    return _kept(spark, sf_dir).select("doc_id", "line_no", "anchor", "start", mentions.lookback(P.LOOKBACK60, 60, "refers_to").alias("relationship"))


@query(f"WITH {_KEPT} SELECT doc_id, line_no, anchor, start, {_lookback_sql(P.LOOKBACK70, 70, 'related_to')} FROM kept")
def q16_relationship_lookback70(spark, sf_dir):
    return _kept(spark, sf_dir).select("doc_id", "line_no", "anchor", "start", mentions.lookback(P.LOOKBACK70, 70, "related_to").alias("relationship"))


_EXPANDED = r"""flatten(list_transform(list_filter(list_transform(string_split_regex(numbers, '(?i)\s*(?:,|\band\b|\bor\b)\s*'), lambda x: trim(x)), lambda x: x <> ''),
  lambda x: CASE WHEN regexp_matches(x, '(?i)^\(?\d+\)?\s*to\s*\(?\d+\)?$') AND regexp_extract(x, '^\(?(\d+)', 1)::INT <= regexp_extract(x, '(\d+)\)?$', 1)::INT
    THEN list_transform(range(regexp_extract(x, '^\(?(\d+)', 1)::INT, regexp_extract(x, '(\d+)\)?$', 1)::INT + 1), lambda v: v::VARCHAR) ELSE [regexp_replace(x, '^\(+|\)+$', '', 'g')] END))"""


@query(f"""WITH {_L}, e AS ({_located_sql(P.EXPRESS)}), n AS (SELECT *, regexp_extract(anchor, {q(P.EXPRESS)}, 2) AS numbers FROM e)
SELECT doc_id, line_no, start, anchor, array_to_string({_EXPANDED}, ',') AS targets FROM n""")
def q17_range_expansion(spark, sf_dir):
    found = _units(spark, sf_dir).select("doc_id", "line_no", F.explode(mentions.located_matches(_C("text"), P.EXPRESS)).alias("s"))
    return found.select("doc_id", "line_no", "s.start", _C("s.text").alias("anchor"), F.array_join(T.expand_range(F.regexp_extract("s.text", P.EXPRESS, 2)), ",").alias("targets"))


@query(f"""WITH {_TARGETS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, target_id, anchor ORDER BY line_no, start, prio) AS r FROM targets)
SELECT doc_id, line_no, target_id, anchor, format('ref-{{}}-{{:03d}}', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, start, prio)) AS reference_id FROM r WHERE r = 1""")
def q18_numbering_and_merge(spark, sf_dir):
    found = _targets(spark, sf_dir).withColumn("relationship", F.lit("x")).withColumn("unit_id", _C("doc_id").cast("string"))
    place = (_C("line_no") * 100_000 + _C("start") * 10 + _C("prio")).alias("place")
    refs = found.select("doc_id", "unit_id", "line_no", "target_id", "anchor", "relationship", "start", "prio", place.alias("ord"))
    merged = mentions.merge_references(refs.where("line_no = -1"), refs, ["doc_id"])
    return mentions.numbered(merged.drop("src"), ["doc_id"], ["line_no", "start", "prio"]).select("doc_id", "line_no", "target_id", "anchor", "reference_id")


# Hierarchy

_REFS_RX = r"(?i)^(?:\s*\d+[a-z]?\s*\[\s*)+\("
_PIPES = "(length(text) - length(replace(text, '|', '')) >= 2)"
_HIER = " OR ".join(f"regexp_matches(trim(text), {q(p)})" for p in (P.CHAPTER, P.SECTION_START, P.BRACKET, P.EXPLANATION, P.PROVISO, P.ILLUSTRATION))
_BORDERLESS = rf"CASE WHEN {_PIPES} THEN false WHEN regexp_matches(trim(text), '(?i)^Sl\.\s*No\.?\b') THEN true WHEN regexp_matches(trim(text), '^\(?\d+\)?\.?\s{{2,}}\S+') THEN true ELSE regexp_matches(trim(text), '\S\s{{3,}}\S') AND NOT ({_HIER}) END"
_BANNERS = ", ".join(q(b) for b in P.BANNERS)
_CLASS = rf"""CASE WHEN trim(text) = '' THEN 'blank' WHEN regexp_matches(trim(text), {q(P.PAGE)}) THEN 'page' WHEN trim(text) IN ({_BANNERS}) THEN 'banner'
  WHEN regexp_matches(trim(text), {q(P.FOOTNOTE_START)}) THEN 'footnote' WHEN upper(regexp_replace(text, '[|*_\s]', '', 'g')) = 'TABLE' THEN 'table_marker'
  WHEN regexp_matches(text, '(?i)<t[rdh][ >]') THEN 'html_row' WHEN {_PIPES} THEN 'pipe_row' WHEN regexp_matches(trim(text), {q(P.CHAPTER)}) THEN 'chapter' WHEN {_BORDERLESS} THEN 'borderless_row'
  WHEN regexp_matches(trim(text), {q(P.SECTION_START)}) THEN 'section' WHEN regexp_matches(trim(text), {q(P.HEADING)}) OR regexp_matches(trim(text), {q(P.BOLD_LINE)}) THEN 'heading'
  WHEN regexp_matches(trim(text), {q(P.EXPLANATION)}) THEN 'explanation' WHEN regexp_matches(trim(text), {q(P.PROVISO)}) THEN 'proviso' WHEN regexp_matches(trim(text), {q(P.ILLUSTRATION)}) THEN 'illustration'
  WHEN regexp_matches(trim(text), '^(?:\d+[a-z]?\s*\[\s*)?\[?\(\s*(?:[A-Za-z]+|\d+)\s*\)') THEN 'bracket' ELSE 'text' END"""
_CLEAN = r"trim(regexp_replace(replace({0}, chr(160), ' '), '\s+', ' ', 'g'))"
_KIND = rf"CASE WHEN regexp_matches(x, '^\d+$') THEN 'subsection' WHEN x IN ({', '.join(q(r) for r in P.LOWER_ROMAN)}) THEN 'sub_clause' WHEN regexp_matches(x, '^[a-z]+$') THEN 'clause' ELSE 'item' END"
_ROWS = rf"""{_L}, classed AS (SELECT *, {_CLASS} AS cls FROM lines),
bodies AS (SELECT *, CASE WHEN cls = 'section' THEN regexp_extract(trim(text), {q(P.SECTION_START)}, 2) WHEN regexp_matches(trim(text), {q(_REFS_RX)}) THEN regexp_replace(rtrim(regexp_replace(trim(text), {q(P.FOOTNOTE_REF_RUN)}, '')), '\]$', '') ELSE trim(text) END AS body FROM classed),
runs AS (SELECT *, CASE WHEN cls IN ('section', 'bracket') THEN regexp_extract(body, {q(P.BRACKET_RUN)}) ELSE '' END AS run FROM bodies),
opened AS (SELECT *, list_concat(CASE WHEN cls = 'section' THEN [{{'level': 'section', 'number': regexp_extract(trim(text), {q(P.SECTION_START)}, 1)}}] WHEN cls = 'chapter' THEN [{{'level': 'chapter', 'number': regexp_extract(trim(text), {q(P.CHAPTER)}, 1)}}] ELSE [] END,
  list_transform(regexp_extract_all(run, {q(P.BRACKET_TOKEN)}, 1), lambda x: {{'level': {_KIND}, 'number': x}})) AS u FROM runs),
rows AS (SELECT doc_id, line_no, cls, {_CLEAN.format(f"CASE WHEN cls IN ('section', 'bracket') THEN substr(body, length(run) + 1) WHEN cls = 'chapter' THEN regexp_extract(trim(text), {q(P.CHAPTER)}, 2) ELSE trim(text) END")} AS rest,
  unnest(CASE WHEN len(u) = 0 THEN [0] ELSE range(len(u)) END)::INT AS ord, u FROM opened),
tokens AS (SELECT doc_id, line_no, cls, rest, ord, u[ord + 1].level AS level, u[ord + 1].number AS number FROM rows)"""
_LEVELS = hierarchy.LEVELS[1:6]
_PATH = (
    _ROWS
    + ", placed AS (SELECT *, line_no * 1000 + ord AS place FROM tokens), filled AS (SELECT *, "
    + ", ".join(f"max(CASE WHEN level = '{lv}' THEN place END) OVER w AS p_{lv}, last_value(CASE WHEN level = '{lv}' THEN number END IGNORE NULLS) OVER w AS n_{lv}" for lv in _LEVELS)
    + " FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), open AS (SELECT *, "
    + ", ".join(f"CASE WHEN p_{lv} > greatest(-1, {', '.join(f'coalesce(p_{x}, -1)' for x in _LEVELS[:i]) or '-1'}) THEN n_{lv} END AS {lv}_no" for i, lv in enumerate(_LEVELS))
    + " FROM filled), ids AS (SELECT *, "
    + ", ".join(f"CASE WHEN {lv}_no IS NOT NULL THEN concat_ws('-', {', '.join(f'{x}_no' for x in _LEVELS[: i + 1])}) END AS {lv}_id" for i, lv in enumerate(_LEVELS))
    + f" FROM open), path AS (SELECT *, list_filter([{', '.join(f'{lv}_id' for lv in reversed(_LEVELS))}], lambda x: x IS NOT NULL) AS ids FROM ids), tree AS (SELECT *, ids[1] AS unit_id, ids[2] AS parent_id, len(ids)::INT AS depth FROM path)"
)


@query(f"WITH {_L} SELECT doc_id, line_no, {_CLASS} AS cls FROM lines")
def q20_line_classes(spark, sf_dir):
    return _units(spark, sf_dir).select("doc_id", "line_no", lines.line_class().alias("cls"))


def _documents(spark, sf_dir, page_marks=False):
    text = F.when(_C("kind") == 7, F.concat(F.lit("PAGE "), _C("doc_id").cast("string"))).otherwise(_C("text")) if page_marks else _C("text")
    rows = _units(spark, sf_dir).select("doc_id", F.struct("line_no", text.alias("t")).alias("l"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), "\n").alias("text"))


_STRIP = "trim(replace({0}, chr(160), ' '))"
for _p, _to in ((r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"`([^`]+)`", r"\1"), (r"^\s*[-*+]\s+", ""), (r"[*_]{1,3}([^*_]+)[*_]{1,3}", r"\1"), (r"(?i)</?su[bp]>", ""), (r"(?i)<br\s*/?>", " "), (r"</?[^>]+>", ""), (r"[_*]", ""), (r"\(\s+([A-Za-z]+|\d+)\s+\)", r"(\1)")):
    _STRIP = f"regexp_replace({_STRIP}, {q(_p).replace('{', '{{').replace('}', '}}')}, '{_to}', 'g')"
_STRIP = f"trim({_STRIP})"


@query(rf"""WITH {_L}, raw AS (SELECT doc_id, line_no, CASE WHEN kind = 7 THEN 'PAGE ' || doc_id ELSE text END AS raw FROM lines),
p AS (SELECT *, try_cast(nullif(regexp_extract(trim(raw), {q(P.PAGE)}, 1), '') AS INT) AS mark FROM raw),
f AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS page FROM p)
SELECT doc_id, line_no, page::INT AS page, (length(raw) - length(ltrim(raw)))::INT AS indent, {_STRIP.format(r"regexp_replace(trim(raw), '^#{1,6}\s+', '')")} AS text FROM f WHERE mark IS NULL AND trim(raw) <> ''""")
def q21_markdown_scan(spark, sf_dir):
    return lines.markdown_lines(_documents(spark, sf_dir, True)).select("doc_id", "line_no", "page", "indent", "text")


@query(f"WITH {_ROWS} SELECT doc_id, line_no, cls, ord, level, number, rest FROM tokens")
def q22_token_rows(spark, sf_dir):
    return hierarchy.token_rows(_units(spark, sf_dir)).select("doc_id", "line_no", "cls", "ord", "level", "number", "rest")


def _tree(spark, sf_dir):
    return hierarchy.with_ids(hierarchy.open_path(hierarchy.token_rows(_units(spark, sf_dir))))


@query(f"WITH {_PATH} SELECT doc_id, line_no, ord, level, number, unit_id, parent_id, depth FROM tree WHERE level IS NOT NULL")
def q23_units(spark, sf_dir):
    return _tree(spark, sf_dir).where("level is not null").select("doc_id", "line_no", "ord", "level", "number", "unit_id", "parent_id", "depth")


@query(f"WITH {_PATH} SELECT doc_id, line_no, unit_id, rest FROM tree WHERE cls = 'text'")
def q24_continuation(spark, sf_dir):
    return hierarchy.continuation(_units(spark, sf_dir))


@query(f"""WITH {_PATH}, kids AS (SELECT doc_id, parent_id, level, CASE level WHEN 'subsection' THEN 1 WHEN 'clause' THEN 2 WHEN 'sub_clause' THEN 3 WHEN 'item' THEN 4 ELSE 5 END AS prio FROM tree WHERE level IS NOT NULL AND parent_id IS NOT NULL)
SELECT doc_id, parent_id, arg_min(level, prio) AS child_type, count(*) AS n_children, 'text_before_' || arg_min(level, prio) || 's' AS text_key FROM kids GROUP BY doc_id, parent_id""")
def q25_dominant_child(spark, sf_dir):
    return hierarchy.dominant_child(_tree(spark, sf_dir).where("level is not null").withColumnRenamed("level", "type"))


_NOTES = rf"""{_L}, classed AS (SELECT *, {_CLASS} AS cls FROM lines),
sessions AS (SELECT *, sum(CASE WHEN cls <> 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS session FROM classed),
heads AS (SELECT *, first_value(cls) OVER (PARTITION BY doc_id, session ORDER BY line_no) AS head FROM sessions),
notes AS (SELECT doc_id, max(CASE WHEN cls = 'footnote' THEN regexp_extract(trim(text), {q(P.FOOTNOTE_START)}, 1) END) AS number,
  string_agg(CASE WHEN cls = 'footnote' THEN regexp_extract(trim(text), {q(P.FOOTNOTE_START)}, 2) ELSE trim(text) END, ' ' ORDER BY line_no) AS text, min(line_no)::INT AS line_start, max(line_no)::INT AS line_end FROM heads WHERE head = 'footnote' GROUP BY doc_id, session)"""


@query(f"WITH {_NOTES} SELECT doc_id, number, text, line_start, line_end FROM notes")
def q26_footnotes(spark, sf_dir):
    return hierarchy.footnotes(_units(spark, sf_dir))


@query(rf"""WITH {_NOTES}, refs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_extract(trim(text), {q(P.FOOTNOTE_REF_RUN)}), '(\d+[A-Za-z]?)', 1)) AS number, doc_id::VARCHAR || '-' || line_no::VARCHAR AS unit_id FROM lines WHERE regexp_matches(trim(text), {q(_REFS_RX)})),
numbers AS (SELECT DISTINCT doc_id, number FROM notes UNION SELECT doc_id, '17' FROM lines)
SELECT n.doc_id, n.number, coalesce(string_agg(r.unit_id, ',' ORDER BY r.unit_id), '') AS referenced_by FROM numbers n LEFT JOIN refs r ON n.doc_id = r.doc_id AND n.number = r.number GROUP BY n.doc_id, n.number""")
def q27_footnote_links(spark, sf_dir):
    units = _units(spark, sf_dir)
    own = units.select("doc_id", F.concat_ws("-", _C("doc_id").cast("string"), _C("line_no").cast("string")).alias("unit_id"), T.footnote_refs(F.trim("text")).alias("footnote_refs"))
    notes = hierarchy.footnotes(units).select("doc_id", "number").unionByName(units.select("doc_id", F.lit("17").alias("number")))
    return hierarchy.footnote_links(own, notes).select("doc_id", "number", F.array_join("referenced_by", ",").alias("referenced_by"))


@query(f"WITH {_L} SELECT doc_id, line_no, len(regexp_extract_all(text, {q(P.FOOTNOTE_MARKS)}))::INT AS marks FROM lines")
def q28_footnote_marks(spark, sf_dir):
    units = _units(spark, sf_dir)
    return units.select("doc_id", "line_no", F.regexp_count("text", F.lit(P.FOOTNOTE_MARKS)).alias("marks"))


@query(f"WITH {_L}, m AS (SELECT doc_id, len(regexp_extract_all(string_agg(text, chr(10) ORDER BY line_no), {q(P.FOOTNOTE_MARKS)})) AS marks FROM lines GROUP BY doc_id) SELECT count(*) AS documents, count(*) FILTER (WHERE marks > 0) AS with_footnotes, sum(marks)::BIGINT AS marks FROM m")
def q28b_footnote_summary(spark, sf_dir):
    return audit.footnote_summary(_documents(spark, sf_dir))


# Tables

_CELLS = r"list_transform(string_split(trim(text, '| '), '|'), lambda c: trim(regexp_replace(c, '\s+', ' ', 'g')))"
_ITEM = r"try_cast(regexp_extract({0}, '^\(?(\d+)\)?\.?$', 1) AS INT)"


@query(f"WITH {_L} SELECT doc_id, line_no, {_ITEM.format(f'({_CELLS})[1]')} AS item_no, array_to_string({_CELLS}, '|') AS cells FROM lines WHERE {_PIPES}")
def q29_pipe_rows(spark, sf_dir):
    return tables.pipe_rows(_units(spark, sf_dir), ["doc_id"])


_LOOSE = r"list_filter(list_transform(string_split_regex(trim(text), '\s{2,}'), lambda c: trim(regexp_replace(c, '\s+', ' ', 'g'))), lambda c: c <> '')"


@query(f"WITH {_L} SELECT doc_id, line_no, {_ITEM.format(f'({_LOOSE})[1]')} AS item_no, array_to_string({_LOOSE}, '|') AS cells FROM lines WHERE {_BORDERLESS}")
def q30_borderless_rows(spark, sf_dir):
    return tables.borderless_rows(_units(spark, sf_dir), ["doc_id"])


def _repeated(spark, sf_dir):
    """Table lines again: one with the same number, one without any."""
    units, k, kind = _units(spark, sf_dir), _C("k"), _C("kind")
    text = F.when(k == 0, _C("text")).when((k == 1) & kind.isin(8, 9), _C("text")).when((k == 2) & (kind == 8), F.concat(F.lit("|see|note "), _C("doc_id").cast("string"), F.lit("|x|"))).when((k == 2) & (kind == 9), "see   the note")
    return units.withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2))))).select("doc_id", (_C("line_no") * 10 + k).alias("line_no"), text.alias("text")).where("text is not null")


_REPEATED = f"""{_L}, again AS (SELECT doc_id, line_no * 10 + k AS line_no, CASE WHEN k = 0 THEN text WHEN k = 1 AND kind IN (8, 9) THEN text WHEN k = 2 AND kind = 8 THEN '|see|note ' || doc_id || '|x|' WHEN k = 2 AND kind = 9 THEN 'see   the note' END AS text
  FROM (SELECT *, unnest([0, 1, 2]) AS k FROM lines)), said AS (SELECT * FROM again WHERE text IS NOT NULL),
stretches AS (SELECT *, sum(CASE WHEN upper(regexp_replace(text, '[|*_\\s]', '', 'g')) = 'TABLE' OR regexp_matches(trim(text), {q(P.CHAPTER)}) OR regexp_matches(trim(text), '^\\d+[A-Z]?\\.\\s*\\(') OR regexp_matches(trim(text), '^\\s*\\[?\\(\\s*\\d+\\s*\\)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS region FROM said)"""


@query(f"""WITH {_REPEATED}, p AS (SELECT doc_id, region, line_no, {_ITEM.format(f"({_CELLS})[1]")} AS item_no, array_to_string({_CELLS}, '|') AS cells FROM stretches WHERE {_PIPES}),
b AS (SELECT doc_id, region, line_no, {_ITEM.format(f"({_LOOSE})[1]")} AS item_no, array_to_string({_LOOSE}, '|') AS cells FROM stretches WHERE {_BORDERLESS}),
one AS (SELECT doc_id, region, item_no, string_agg(cells, ' ' ORDER BY line_no) AS l FROM p WHERE item_no IS NOT NULL GROUP BY ALL),
two AS (SELECT doc_id, region, item_no, string_agg(cells, ' ' ORDER BY line_no) AS r FROM b WHERE item_no IS NOT NULL GROUP BY ALL),
rows AS (SELECT coalesce(one.doc_id, two.doc_id) AS doc_id, coalesce(one.region, two.region) AS region, coalesce(one.item_no, two.item_no) AS item_no, {_CLEAN.format("coalesce(l, '') || ' ' || coalesce(r, '')")} AS cells
  FROM one FULL JOIN two ON one.doc_id = two.doc_id AND one.region = two.region AND one.item_no = two.item_no
  UNION ALL SELECT doc_id, region, item_no, {_CLEAN.format("cells")} FROM p WHERE item_no IS NULL UNION ALL SELECT doc_id, region, item_no, {_CLEAN.format("cells")} FROM b WHERE item_no IS NULL)
SELECT doc_id, region::BIGINT AS region, item_no, cells, row_number() OVER (PARTITION BY doc_id, region ORDER BY item_no NULLS LAST, cells)::INT AS place FROM rows""")
def q31_merged_rows(spark, sf_dir):
    units, key = tables.with_region(_repeated(spark, sf_dir)), ["doc_id", "region"]
    return tables.merged_rows(tables.pipe_rows(units, key), tables.borderless_rows(units, key), key)


@query(f"""WITH {_L}, r AS (SELECT doc_id, line_no, {_ITEM.format(f"({_CELLS})[1]")} AS item_no, {_CELLS} AS c FROM lines WHERE {_PIPES}),
s AS (SELECT doc_id, line_no, CASE WHEN item_no IS NULL THEN 'Row' ELSE 'Item ' || item_no END || ' - ' || array_to_string(list_filter([CASE WHEN c[1] <> '' THEN 'No: ' || c[1] ELSE '' END, CASE WHEN c[2] <> '' THEN 'Item: ' || c[2] ELSE '' END, CASE WHEN c[3] <> '' THEN 'Rate: ' || c[3] ELSE '' END], lambda x: x <> ''), '; ') || '.' AS line FROM r)
SELECT doc_id, 'Table Table items: ' || string_agg(line, ' ' ORDER BY line_no) AS linearized_text FROM s GROUP BY doc_id""")
def q32_linearized(spark, sf_dir):
    return tables.linearized(tables.pipe_rows(_units(spark, sf_dir), ["doc_id"]), ["doc_id"])


@query(rf"""WITH {_L}, c AS (SELECT doc_id, line_no, regexp_extract_all(text, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1) AS l FROM lines WHERE contains(lower(text), '<tr'))
SELECT doc_id, line_no, (generate_subscripts(l, 1) - 1)::INT AS col, unnest(list_transform(l, lambda x: {_CLEAN.format("regexp_replace(x, '<[^>]+>', ' ', 'g')")})) AS cell FROM c""")
def q33_html_cells(spark, sf_dir):
    return tables.html_cells(_units(spark, sf_dir), ["doc_id"]).select("doc_id", "line_no", "col", "cell")


@query(f"SELECT page_id, {_STRIP.format('html')} AS text FROM pages")
def q34_strip_markup(spark, sf_dir):
    return _table(spark, sf_dir, "pages", "page_id", "html").select("page_id", T.strip_inline_markup("html").alias("text"))


@query(f"SELECT doc_id, {_CLEAN.format('text')} AS text FROM documents")
def q35_clean_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.clean_text("text").alias("text"))


# Audits

_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


@query(f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY ALL")
def q36_token_counts(spark, sf_dir):
    return audit.token_counts(_table(spark, sf_dir, "documents", "doc_id", "text"))


_CUT = "regexp_replace(text, '[a-z]+ing\\b', '', 'g')"
_BAGS = f"""o AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS.format("text")}) AS token FROM documents) GROUP BY ALL),
c AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS.format(_CUT)}) AS token FROM documents) GROUP BY ALL),
missing AS (SELECT o.doc_id, o.token, o.n - coalesce(c.n, 0) AS n FROM o LEFT JOIN c ON o.doc_id = c.doc_id AND o.token = c.token WHERE o.n > coalesce(c.n, 0))"""


def _bags(spark, sf_dir):
    left = _table(spark, sf_dir, "documents", "doc_id", "text")
    return left, left.withColumn("text", F.regexp_replace("text", r"[a-z]+ing\b", ""))


@query(f"""WITH {_BAGS} SELECT d.doc_id, coalesce((SELECT sum(n) FROM o WHERE o.doc_id = d.doc_id), 0)::BIGINT AS words, coalesce((SELECT sum(n) FROM missing m WHERE m.doc_id = d.doc_id), 0)::BIGINT AS missing,
coalesce((SELECT sum(n) FROM missing m WHERE m.doc_id = d.doc_id), 0) / (SELECT sum(n) FROM o WHERE o.doc_id = d.doc_id) AS ratio,
coalesce(coalesce((SELECT sum(n) FROM missing m WHERE m.doc_id = d.doc_id), 0) / (SELECT sum(n) FROM o WHERE o.doc_id = d.doc_id) < 0.02, true) AS passed FROM documents d""")
def q37_loss(spark, sf_dir):
    return audit.loss(*_bags(spark, sf_dir))


@query(f"WITH {_BAGS} SELECT doc_id, token, n FROM missing")
def q37b_bag_difference(spark, sf_dir):
    return audit.bag_difference(*_bags(spark, sf_dir))


@query(rf"""WITH {_BAGS}, w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
p2 AS (SELECT doc_id, (i - 1)::INT AS pos, lower(w[i]) AS token, array_to_string(w[greatest(i - 4, 1) : i + 4], ' ') AS snippet FROM p),
r AS (SELECT p2.*, m.n, row_number() OVER (PARTITION BY p2.doc_id, p2.token ORDER BY pos) AS r FROM p2 JOIN missing m ON p2.doc_id = m.doc_id AND p2.token = m.token)
SELECT doc_id, token, pos, snippet FROM r WHERE r <= n""")
def q38_missing_occurrences(spark, sf_dir):
    left, right = _bags(spark, sf_dir)
    return audit.missing_occurrences(audit.bag_difference(left, right), audit.word_positions(left, ["doc_id"]))


@query(f"WITH {_BAGS} SELECT doc_id, token, n FROM missing ORDER BY n DESC, token, doc_id LIMIT 20")
def q38b_most_missing(spark, sf_dir):
    return audit.most_missing(audit.bag_difference(*_bags(spark, sf_dir)))


# Layout, on spans and glyphs made from parts


def _spans(spark, sf_dir):
    p = _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    return p.select(
        (_C("p_partkey") % 50).cast("int").alias("page"), F.expr("p_partkey div 50").cast("int").alias("line"), _C("p_partkey").alias("ord"), (_C("p_size") % 6 + 9).cast("double").alias("size"),
        (_C("p_size") % 32).cast("int").alias("flags"), F.when(_C("p_size") % 5 == 0, "Times-Bold").when(_C("p_size") % 5 == 1, "Times-Italic").otherwise("Times").alias("font"),
        F.concat("p_name", F.lit("*_`"), "p_brand").alias("text"), (_C("p_size") * 13 % 600).cast("int").alias("x"), (_C("p_partkey") * 7 % 800).cast("int").alias("y"), (_C("p_size") % 2 == 0).alias("bold"),
    )


_S = """spans AS (SELECT (p_partkey % 50)::INT AS page, (p_partkey // 50)::INT AS line, p_partkey AS ord, (p_size % 6 + 9)::DOUBLE AS size, (p_size % 32)::INT AS flags,
  CASE p_size % 5 WHEN 0 THEN 'Times-Bold' WHEN 1 THEN 'Times-Italic' ELSE 'Times' END AS font, p_name || '*_`' || p_brand AS text, (p_size * 13 % 600)::INT AS x, (p_partkey * 7 % 800)::INT AS y, p_size % 2 = 0 AS bold FROM part)"""
_DOM = f"{_S}, sizes AS (SELECT page, round(size, 1) AS s, sum(length(text)) AS n, min(ord) AS o FROM spans GROUP BY ALL), dom AS (SELECT page, arg_max(s, (n, -o)) AS dominant FROM sizes GROUP BY page)"


@query(f"WITH {_DOM} SELECT page, dominant FROM dom")
def q39_dominant_size(spark, sf_dir):
    return layout.dominant_size(_spans(spark, sf_dir), ["page"])


@query(f"WITH {_DOM} SELECT ord, (CASE WHEN size / dominant >= 1.8 THEN 1 WHEN size / dominant >= 1.5 THEN 2 WHEN size / dominant >= 1.25 THEN 3 WHEN size / dominant >= 1.1 THEN 4 END)::INT AS level FROM spans JOIN dom USING (page)")
def q40_heading_level(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return s.join(layout.dominant_size(s, ["page"]), "page").select("ord", T.heading_level("size", "dominant").alias("level"))


def _glyphs(spark, sf_dir):
    p = _table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand")
    x0 = (_C("p_partkey") % 20 * 10 + F.when(_C("p_partkey") % 20 >= _C("p_size") % 20, 40).otherwise(0)).cast("double")
    return p.select(F.expr("p_partkey div 20").cast("int").alias("line"), _C("p_partkey").alias("ord"), F.substring("p_brand", 7, 2).alias("c"), x0.alias("x0"), (x0 + 5).alias("x1"), (_C("p_partkey") % 9).cast("double").alias("y0"), (_C("p_size") % 2 == 0).alias("bold"), (_C("p_size") % 7 == 0).alias("superscript"))


_G = "glyphs AS (SELECT (p_partkey // 20)::INT AS line, p_partkey AS ord, substr(p_brand, 7, 2) AS c, (p_partkey % 20 * 10 + CASE WHEN p_partkey % 20 >= p_size % 20 THEN 40 ELSE 0 END)::DOUBLE AS x0, p_size % 2 = 0 AS bold, p_size % 7 = 0 AS superscript FROM part)"


@query(f"""WITH {_G}, cut AS (SELECT *, CASE WHEN x0 - (lag(x0) OVER (PARTITION BY line ORDER BY x0, ord) + 5) > 18 THEN 1 ELSE 0 END AS cut FROM glyphs),
cells AS (SELECT *, sum(cut) OVER (PARTITION BY line ORDER BY x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cell FROM cut)
SELECT line, cell::BIGINT AS cell, string_agg(c, '' ORDER BY x0, ord) AS text, min(x0) AS x, max(x0) + 5 AS x_end, bool_or(bold) AS bold FROM cells GROUP BY line, cell""")
def q41_cells_by_gap(spark, sf_dir):
    return layout.cells_by_gap(_glyphs(spark, sf_dir), ["line"])


@query(f"WITH {_G}, p AS (SELECT line, ord, CASE WHEN x0 - (lag(x0) OVER (PARTITION BY line ORDER BY ord) + 5) > 1.8 THEN ' ' ELSE '' END || CASE WHEN superscript THEN '^' ELSE '' END || c AS piece FROM glyphs) SELECT line, {_CLEAN.format("string_agg(piece, '' ORDER BY ord)")} AS text FROM p GROUP BY line")
def q41b_glyph_text(spark, sf_dir):
    return layout.glyph_text(_glyphs(spark, sf_dir), ["line"])


@query(f"WITH {_S} SELECT ord, (list_position(list_transform([11.0, 100.0, 250.0, 400.0], lambda a: abs(a - x)), list_min(list_transform([11.0, 100.0, 250.0, 400.0], lambda a: abs(a - x)))) - 1)::INT AS col FROM spans")
def q42_nearest_anchor(spark, sf_dir):
    anchors = F.array(*map(F.lit, (11.0, 100.0, 250.0, 400.0)))
    return _spans(spark, sf_dir).select("ord", layout.nearest_anchor(_C("x").cast("double"), anchors).alias("col"))


@query(f"WITH {_S} SELECT page, (round_even(y / 4.0, 0) * 4)::INT AS row_y, count(*) AS n, min(x) AS x FROM spans GROUP BY ALL")
def q43_visual_rows(spark, sf_dir):
    return layout.visual_rows(_spans(spark, sf_dir), ["page"])


def _grid(spark, sf_dir):
    p = _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    return p.select((_C("p_partkey") % 97).cast("int").alias("table"), F.expr("p_partkey div 97 div 3").cast("int").alias("row"), (F.expr("p_partkey div 97") % 3).cast("int").alias("col"), F.repeat("p_name", F.when(_C("p_partkey") % 97 % 4 == 0, _C("p_size")).otherwise(1).cast("int")).alias("cell"), (_C("p_partkey") % 97 / 97.0).alias("coverage"))


@query("""WITH grid AS (SELECT (p_partkey % 97)::INT AS "table", (p_partkey // 97 // 3)::INT AS row, (p_partkey // 97 % 3)::INT AS col, repeat(p_name, CASE WHEN p_partkey % 97 % 4 = 0 THEN p_size ELSE 1 END) AS cell, (p_partkey % 97) / 97.0::DOUBLE AS coverage FROM part),
g AS (SELECT "table", count(DISTINCT row) AS rows, count(DISTINCT col) AS cols, max(length(cell))::INT AS longest, avg(length(cell)) AS mean, max(coverage) AS coverage FROM grid GROUP BY 1)
SELECT * FROM g WHERE rows >= 2 AND NOT (longest > 400 OR (mean > 150 AND cols <= 3) OR (coverage > 0.6 AND cols <= 3 AND mean > 80))""")
def q44_real_tables(spark, sf_dir):
    return layout.real_tables(_grid(spark, sf_dir), ["table"])


@query(f"""WITH {_S}, b AS (SELECT page, x AS x0, x + 150 AS x1, y AS y0, y + 200 AS y1 FROM spans WHERE ord % 37 = 0)
SELECT ord FROM spans s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = s.page AND s.x < b.x1 AND s.x + 50 > b.x0 AND s.y < b.y1 AND s.y + 12 > b.y0)""")
def q45_outside_boxes(spark, sf_dir):
    s = _spans(spark, sf_dir)
    box = s.where("ord % 37 = 0").select("page", _C("x").alias("x0"), (_C("x") + 150).alias("x1"), _C("y").alias("y0"), (_C("y") + 200).alias("y1"))
    own = s.select("page", "ord", _C("x").alias("x0"), (_C("x") + 50).alias("x1"), _C("y").alias("y0"), (_C("y") + 12).alias("y1"))
    return layout.outside_boxes(own, box, ["page"]).select("ord")


@query(rf"""WITH {_S}, e AS (SELECT *, regexp_replace(text, '([\\*_`])', '\\\1', 'g') AS t FROM spans), i AS (SELECT *, CASE WHEN flags & 2 <> 0 OR contains(font, 'Italic') THEN '_' || t || '_' ELSE t END AS u FROM e),
b AS (SELECT *, CASE WHEN flags & 16 <> 0 OR contains(font, 'Bold') THEN '**' || u || '**' ELSE u END AS v FROM i), s AS (SELECT *, CASE WHEN flags & 1 <> 0 THEN '<sup>' || v || '</sup>' ELSE v END AS styled FROM b)
SELECT page, line, trim(string_agg(styled, '' ORDER BY ord)) AS text FROM s GROUP BY page, line""")
def q46_styled_lines(spark, sf_dir):
    s = _spans(spark, sf_dir)
    flags = s.withColumn("b", T.is_bold("flags", "font")).withColumn("i", T.is_italic("flags", "font")).withColumn("s", T.is_superscript("flags"))
    return layout.rendered_lines(flags.withColumn("styled", T.style_span("text", "b", "i", "s")), ["page", "line"])


@query("""WITH g AS (SELECT (p_partkey % 97)::INT AS "table", (p_partkey // 97)::INT AS row, CASE WHEN p_partkey % 3 = 0 THEN [p_name, p_brand] ELSE [p_name, p_brand, p_size::VARCHAR] END AS cells FROM part),
w AS (SELECT *, len(first_value(cells) OVER (PARTITION BY "table" ORDER BY row)) AS w, row_number() OVER (PARTITION BY "table" ORDER BY row) AS r FROM g),
l AS (SELECT *, '| ' || array_to_string(list_transform(range(1, w + 1), lambda i: coalesce(cells[i], '')), ' | ') || ' |' AS line FROM w)
SELECT "table", string_agg(CASE WHEN r = 1 THEN line || chr(10) || '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |' ELSE line END, chr(10) ORDER BY row) AS markdown FROM l GROUP BY "table" """)
def q47_markdown_tables(spark, sf_dir):
    p = _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    cells = F.when(_C("p_partkey") % 3 == 0, F.array("p_name", "p_brand")).otherwise(F.array("p_name", "p_brand", _C("p_size").cast("string")))
    return tables.markdown_table(p.select((_C("p_partkey") % 97).cast("int").alias("table"), F.expr("p_partkey div 97").cast("int").alias("row"), cells.alias("cells")), ["table"])


@query("SELECT n_nationkey AS id, unnest(range(n_nationkey, n_nationkey + 4))::INT AS page, unnest(range(n_nationkey * 10, n_nationkey * 10 + 4))::INT AS section FROM nation")
def q48_page_sections(spark, sf_dir):
    n, k = _table(spark, sf_dir, "nation", "n_nationkey"), _C("n_nationkey")
    return n.select(k.alias("id"), F.explode(layout.page_sections(k, k + 3, k * 10, k * 10 + 3)).alias("z")).select("id", "z.page", "z.section")


@query(f"""WITH {_S} SELECT ord::INT AS line_no, page::INT AS page, x::DOUBLE AS x, y::DOUBLE AS y, size AS font, bold, {_CLEAN.format("text")} AS text FROM spans""")
def q49_positioned_round_trip(spark, sf_dir):
    """Positioned text is written and read back: what comes out is what went in."""
    s = _spans(spark, sf_dir).drop("font").withColumnRenamed("size", "font")
    docs = s.select(_C("ord").alias("doc_id"), F.concat(F.format_string("PAGE %d", "page"), F.lit("\nnoise\n"), layout.positioned_text(s)).alias("text"))
    return lines.positioned_lines(docs).select(_C("doc_id").cast("int").alias("line_no"), "page", "x", "y", "font", "bold", "text")


# Sequential rules as recursive SQL: one step a row, with the state in a list


@query(f"""WITH RECURSIVE {_S}, xs AS (SELECT page, x::DOUBLE AS x, row_number() OVER (PARTITION BY page ORDER BY x) AS r, count(*) OVER (PARTITION BY page) AS n FROM spans),
fold AS (SELECT DISTINCT page, 0::BIGINT AS r, []::DOUBLE[] AS anchors FROM spans
  UNION ALL SELECT f.page, xs.r, CASE WHEN len(f.anchors) > 0 AND xs.x - f.anchors[-1] <= 55 THEN list_append(f.anchors[1:len(f.anchors) - 1], (f.anchors[-1] + xs.x) / 2) ELSE list_append(f.anchors, xs.x) END FROM fold f JOIN xs ON xs.page = f.page AND xs.r = f.r + 1),
found AS (SELECT f.page, f.anchors FROM fold f JOIN (SELECT page, max(r) AS r FROM xs GROUP BY page) e ON f.page = e.page AND f.r = e.r),
placed AS (SELECT s.page, s.ord, s.x, s.text, list_transform(anchors, lambda a: abs(a - s.x::DOUBLE)) AS gaps, (round_even(y / 4.0, 0) * 4)::INT AS row_y FROM spans s JOIN found USING (page))
SELECT page, row_y, (list_position(gaps, list_min(gaps)) - 1)::INT AS col, string_agg(text, ' ' ORDER BY x, ord, text) AS cell FROM placed GROUP BY ALL""")
def q50_column_anchors(spark, sf_dir):
    s = _spans(spark, sf_dir)
    found = layout.column_anchors(s, ["page"])
    return layout.generic_table(s.withColumn("line_no", _C("ord")), found, ["page"])


@query()
def q51_nested_json(spark, sf_dir):
    return hierarchy.nested_json(hierarchy.units(_units(spark, sf_dir)))


def _fold_lines(spark, sf_dir):
    return _units(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), "line_no", F.lit(0).alias("indent"), F.lit(None).cast("int").alias("heading_level"), F.lit(False).alias("bold"), F.lit(False).alias("list_item"), "text")


@query()
def q52_exact_parser(spark, sf_dir):
    return fold.parsed(_fold_lines(spark, sf_dir))


@query(f"WITH {_L} SELECT doc_id, line_no, text FROM lines")
def q53_hook_identity(spark, sf_dir):
    return hooks.apply_hook(_units(spark, sf_dir).select("doc_id", "line_no", "text"), lambda batch: batch, hooks.ModelConfig("identity", "none"))


_HEAD = r"regexp_matches(trim(text), '(?i)^(?:#+\s*)?(?:Section\s+)?\d+[A-Z]*\.?\s') AND NOT starts_with(trim(text), '(')"


@query(rf"""WITH {_L}, k AS (SELECT *, CASE WHEN {_HEAD} THEN 'section' WHEN regexp_matches(trim(text), '^\(\d+[A-Z]*\)') THEN 'subsection' WHEN regexp_matches(trim(text), '^\([a-z]{{1,3}}\)') THEN 'clause' WHEN regexp_matches(trim(text), '^\([A-Z]{{1,2}}\)') THEN 'item' ELSE 'text' END AS type FROM lines),
n AS (SELECT *, CASE WHEN type = 'section' THEN regexp_extract(trim(text), {q(P.SIMPLE_HEADER)}, 1) WHEN type <> 'text' THEN regexp_extract(trim(text), '^\(([^)]*)\)', 1) END AS number FROM k),
s AS (SELECT *, coalesce(last_value(CASE WHEN type = 'section' THEN number END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '1') AS section FROM n)
SELECT doc_id, line_no, type, number, CASE WHEN type = 'section' THEN number ELSE section || '-' || number END AS unit_id FROM s WHERE type <> 'text'""")
def q54_simple_parser(spark, sf_dir):
    return hierarchy.simple_tree(_units(spark, sf_dir))


@query(f"""WITH {_PATH}, b AS (SELECT doc_id, line_no, cls AS type, unit_id AS parent_id, place, rest FROM tree WHERE cls IN ('explanation', 'proviso', 'illustration'))
SELECT doc_id, line_no, type, parent_id, concat_ws('-', parent_id, type, row_number() OVER (PARTITION BY doc_id, parent_id, type ORDER BY place)::VARCHAR) AS block_id,
CASE type WHEN 'explanation' THEN regexp_extract(rest, {q(P.EXPLANATION)}, 2) WHEN 'proviso' THEN regexp_extract(rest, {q(P.PROVISO)}, 2) ELSE regexp_extract(rest, {q(P.ILLUSTRATION)}, 2) END AS text FROM b""")
def q55_special_blocks(spark, sf_dir):
    return hierarchy.special_blocks(_units(spark, sf_dir))


@query(rf"""WITH {_PATH}, opened_at AS (SELECT doc_id, line_no, arg_max(unit_id, ord) AS unit_id, arg_max(section_id, ord) AS section_id, arg_max(subsection_id, ord) AS subsection_id, arg_max(clause_id, ord) AS clause_id, arg_max(sub_clause_id, ord) AS sub_clause_id, arg_max(item_id, ord) AS item_id FROM tree GROUP BY ALL),
found AS ({_located_sql(P.RELATIVE)}), leveled AS (SELECT *, lower(regexp_extract(anchor, {q(P.RELATIVE)}, 1)) AS level FROM found)
SELECT f.doc_id, f.line_no, anchor, level, coalesce(CASE level WHEN 'section' THEN section_id WHEN 'sub-section' THEN subsection_id WHEN 'clause' THEN clause_id WHEN 'sub-clause' THEN sub_clause_id WHEN 'item' THEN item_id END, item_id, sub_clause_id, clause_id, subsection_id, section_id, 'unknown') AS target_id FROM leveled f JOIN opened_at USING (doc_id, line_no)""")
def q19_relative_references(spark, sf_dir):
    texts = pipeline.open_texts(_units(spark, sf_dir))
    found = texts.select("*", F.explode(mentions.located_matches(_C("text"), P.RELATIVE)).alias("s")).withColumn("anchor", _C("s.text"))
    level = F.lower(F.regexp_extract("anchor", P.RELATIVE, 1))
    return found.select("doc_id", "line_no", "anchor", level.alias("level"), mentions.relative_target(level).alias("target_id"))


_OPENED = """opened_at AS (SELECT doc_id, line_no, arg_max(unit_id, ord) AS unit_id, arg_max(section_id, ord) AS section_id, arg_max(subsection_id, ord) AS subsection_id, arg_max(clause_id, ord) AS clause_id, arg_max(sub_clause_id, ord) AS sub_clause_id, arg_max(item_id, ord) AS item_id FROM tree GROUP BY ALL)"""
_TEXT_COLUMNS = "doc_id, line_no, text, unit_id, section_id, subsection_id, clause_id, sub_clause_id, item_id"
_TOKENS = r"list_filter(list_transform(string_split_regex(numbers, '(?i),|\band\b|\bor\b|to'), lambda x: regexp_replace(trim(x), '^\(+|\)+$', '', 'g')), lambda x: x <> '')"


def _detected_sql(express: str, rules: str, earlier: str = "e.kind = 'external'") -> str:
    """What follows a table `texts` with the open ids: mentions of three classes, one an anchor, with their targets."""
    classes = " UNION ALL ".join(f"SELECT {i} AS cls, '{k}' AS kind, * FROM ({_located_sql(p, 'texts', _TEXT_COLUMNS)})" for i, (k, p) in enumerate((("external", P.EXTERNAL), ("express", P.EXPRESS), ("relative", P.RELATIVE))))
    level = f"lower(regexp_extract(anchor, {q(P.RELATIVE)}, 1))"
    prefix = f"lower(regexp_extract(anchor, {q(P.EXPRESS)}, 1))"
    own = f"CASE {level} WHEN 'section' THEN section_id WHEN 'sub-section' THEN subsection_id WHEN 'clause' THEN clause_id WHEN 'sub-clause' THEN sub_clause_id WHEN 'item' THEN item_id END"
    return f"""found AS ({classes}), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, anchor ORDER BY cls, start) AS r FROM found) WHERE r = 1),
outside AS (SELECT * FROM firsts f WHERE NOT (kind = 'express' AND EXISTS (SELECT 1 FROM firsts e WHERE ({earlier}) AND e.doc_id = f.doc_id AND e.line_no = f.line_no AND contains(e.anchor, f.anchor)))),
numbered AS (SELECT *, regexp_extract(anchor, {q(P.EXPRESS)}, 2) AS numbers FROM outside),
aimed AS (SELECT *, CASE kind WHEN 'external' THEN [concat_ws(':', 'external', trim(regexp_extract(anchor, {q(P.EXTERNAL)}, 2)), regexp_extract(anchor, {q(P.EXTERNAL)}, 1))] WHEN 'express' THEN {express}
  ELSE [coalesce({own}, item_id, sub_clause_id, clause_id, subsection_id, section_id, 'unknown')] END AS targets,
  CASE WHEN kind = 'external' THEN 'external_act' WHEN kind = 'relative' THEN replace({level}, '-', '_') WHEN starts_with({prefix}, 'sub-section') THEN 'subsection' WHEN starts_with({prefix}, 'sub-clause') THEN 'sub_clause'
    WHEN starts_with({prefix}, 'clause') THEN 'clause' WHEN starts_with({prefix}, 'item') THEN 'item' ELSE 'section' END AS target_type, {rules}, CASE WHEN kind = 'relative' THEN 'medium' ELSE 'high' END AS confidence FROM numbered)
SELECT {_TEXT_COLUMNS}, cls, kind, ord, anchor, start, "end", target_type, relationship, confidence"""


@query(f"WITH {_PATH}, {_OPENED}, texts AS (SELECT l.text, o.* FROM lines l JOIN opened_at o USING (doc_id, line_no)), {_detected_sql(_TOKENS, _lookback_sql(P.LOOKBACK60, 60, 'refers_to'))}, unnest(targets) AS target_id, (generate_subscripts(targets, 1) - 1)::INT AS n FROM aimed")
def q56_detected_lookback60(spark, sf_dir):
    return mentions.detected(pipeline.open_texts(_units(spark, sf_dir)), _KEY)


_NONE = ", ".join(f"NULL::VARCHAR AS {c}" for c in ("subsection_id", "clause_id", "sub_clause_id", "item_id"))


@query(f"""WITH {_L}, simple AS ({SQL["q54_simple_parser"].partition("lines AS (" + lines_sql() + "),")[2].join(("WITH ", ""))}),
under AS (SELECT l.doc_id, l.line_no, l.text, last_value(s.unit_id IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unit_id FROM lines l LEFT JOIN simple s USING (doc_id, line_no)),
texts AS (SELECT *, split_part(unit_id, '-', 1) AS section_id, {_NONE} FROM under), {_detected_sql(_EXPANDED, _lookback_sql(P.LOOKBACK70, 70, "related_to"), "e.kind = 'external' OR e.kind = 'express' AND e.start < f.start")}, array_to_string(targets, ',') AS target_id, 0 AS n FROM aimed""")
def q57_agent_pipeline(spark, sf_dir):
    return pipeline.agent(_units(spark, sf_dir))


@query()
def q58_enriched(spark, sf_dir):
    units = _units(spark, sf_dir)
    return pipeline.enriched(pipeline.whole_texts(units), hierarchy.units(units)).drop("text")


@query(rf"""WITH {_L}, m AS (SELECT *, sum(CASE WHEN upper(regexp_replace(text, '[|*_\s]', '', 'g')) = 'TABLE' THEN 1 ELSE 0 END) OVER w AS region,
  last_value(CASE WHEN upper(regexp_replace(text, '[|*_\s]', '', 'g')) = 'TABLE' THEN true WHEN regexp_matches(trim(text), {q(P.CHAPTER)}) OR regexp_matches(trim(text), '^\d+[A-Z]?\.\s*\(') OR regexp_matches(trim(text), '^\s*\[?\(\s*\d+\s*\)') THEN false END IGNORE NULLS) OVER w AS inside
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, line_no, region::BIGINT AS region FROM m WHERE inside AND upper(regexp_replace(text, '[|*_\s]', '', 'g')) <> 'TABLE'""")
def q59_table_regions(spark, sf_dir):
    return tables.regions(_units(spark, sf_dir)).select("doc_id", "line_no", "region")


@query(r"SELECT url, try_cast(regexp_extract(url, '\d+') AS INT) AS n FROM pages WHERE regexp_matches(url, '\d')")
def q60_first_number(spark, sf_dir):
    return _table(spark, sf_dir, "pages", "url").where(_C("url").rlike(r"\d")).select("url", T.first_number("url").alias("n"))


@query("SELECT n_nationkey AS i, 'column_' || CASE WHEN n_nationkey * 3 >= 26 THEN chr((64 + n_nationkey * 3 // 26)::INT) ELSE '' END || chr((65 + n_nationkey * 3 % 26)::INT) AS column_name FROM nation")
def q61_column_keys(spark, sf_dir):
    return _table(spark, sf_dir, "nation", "n_nationkey").select(_C("n_nationkey").alias("i"), T.column_key(_C("n_nationkey") * 3).alias("column_name"))


@query(f"""WITH RECURSIVE {_S}, l AS (SELECT page AS doc_id, ord AS line_no, (x % 60)::DOUBLE AS x, row_number() OVER (PARTITION BY page ORDER BY ord) AS r FROM spans),
fold AS (SELECT DISTINCT doc_id, NULL::BIGINT AS line_no, 0::BIGINT AS r, []::DOUBLE[] AS stack FROM l
  UNION ALL SELECT l.doc_id, l.line_no, l.r, CASE WHEN coalesce(list_max(list_filter(f.stack, lambda v: v <= l.x + 2)) + 2 < l.x, true) THEN list_append(list_filter(f.stack, lambda v: v <= l.x + 2), l.x) ELSE list_filter(f.stack, lambda v: v <= l.x + 2) END
  FROM fold f JOIN l ON l.doc_id = f.doc_id AND l.r = f.r + 1)
SELECT doc_id, line_no, (len(stack) - 1)::INT AS depth FROM fold WHERE r > 0""")
def q62_list_depths(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return layout.list_depths(s.select(_C("page").alias("doc_id"), _C("ord").alias("line_no"), (_C("x") % 60).alias("x")))


@query("""WITH RECURSIVE glyphs AS (SELECT (p_partkey // 20)::INT AS page, (p_partkey % 9)::DOUBLE AS y FROM part),
firsts AS (SELECT page, 0 AS line, min(y) AS y FROM glyphs GROUP BY page
  UNION ALL SELECT f.page, f.line + 1, min(g.y) FROM firsts f JOIN glyphs g ON g.page = f.page AND g.y - f.y > 3 GROUP BY f.page, f.line, f.y)
SELECT page, line::INT AS line, y FROM firsts""")
def q63_line_clusters(spark, sf_dir):
    return layout.line_clusters(_glyphs(spark, sf_dir).withColumnRenamed("line", "page"), ["page"])


@query(rf"""WITH {_L}, bare AS (SELECT doc_id, line_no, CASE WHEN kind = 12 THEN doc_id % 9 || '.' ELSE text END AS text FROM lines),
marked AS (SELECT *, try_cast(nullif(regexp_extract(trim(text), '^(\d+)\.$', 1), '') AS INT) AS item_no FROM bare),
cut AS (SELECT *, sum(CASE WHEN item_no IS NOT NULL OR upper(regexp_replace(text, '[|*_\s]', '', 'g')) = 'TABLE' OR regexp_matches(trim(text), {q(P.CHAPTER)}) OR regexp_matches(trim(text), '^\d+[A-Z]?\.\s*\(') OR regexp_matches(trim(text), '^\s*\[?\(\s*\d+\s*\)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS session FROM marked),
heads AS (SELECT doc_id, session, max(item_no) AS item_no, {_CLEAN.format("string_agg(text, ' ' ORDER BY line_no)")} AS raw_text, min(line_no) AS line_no FROM cut GROUP BY doc_id, session),
known AS (SELECT DISTINCT doc_id, {_ITEM.format(f"({_CELLS})[1]")} AS item_no FROM lines WHERE {_PIPES})
SELECT doc_id, item_no, raw_text, line_no FROM heads h WHERE item_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.doc_id = h.doc_id AND k.item_no = h.item_no)""")
def q64_displaced_rows(spark, sf_dir):
    rows = tables.pipe_rows(_units(spark, sf_dir), ["doc_id"])
    bare = _units(spark, sf_dir).withColumn("text", F.when(_C("kind") == 12, F.concat((_C("doc_id") % 9).cast("string"), F.lit("."))).otherwise(_C("text")))
    return tables.displaced_rows(bare, rows, ["doc_id"])


@query(f"""WITH {_REPEATED}, r AS (SELECT doc_id, region, line_no, {_ITEM.format(f"({_CELLS})[1]")} AS item_no, array_to_string({_CELLS}, '|') AS cells FROM stretches WHERE {_PIPES}
  UNION ALL SELECT doc_id, region, line_no, NULL, array_to_string({_LOOSE}, '|') FROM stretches WHERE {_BORDERLESS}),
o AS (SELECT *, bool_or(item_no IS NOT NULL) OVER (PARTITION BY doc_id, region) AS own, row_number() OVER (PARTITION BY doc_id, region ORDER BY line_no) AS nth FROM r),
s AS (SELECT *, sum(CASE WHEN own THEN (item_no IS NOT NULL)::INT ELSE (nth > 1)::INT END) OVER (PARTITION BY doc_id, region ORDER BY line_no) AS session FROM o WHERE own OR nth = 1 OR trim(replace(cells, '|', '')) <> ''),
c AS (SELECT doc_id, region, session, line_no, unnest(string_split(cells, '|')) AS cell, generate_subscripts(string_split(cells, '|'), 1) AS col FROM s),
j AS (SELECT doc_id, region, session, col, {_CLEAN.format("string_agg(cell, ' ' ORDER BY line_no)")} AS cell FROM c GROUP BY ALL),
n AS (SELECT doc_id, region, session, max(CASE WHEN own THEN item_no WHEN session > 0 THEN session::INT END) AS item_no FROM s GROUP BY ALL)
SELECT doc_id, region::BIGINT AS region, session::BIGINT AS session, string_agg(cell, '|' ORDER BY col) AS cells, any_value(item_no) AS item_no, session = 0 AS is_header FROM j JOIN n USING (doc_id, region, session) GROUP BY doc_id, region, session""")
def q65_row_continuations(spark, sf_dir):
    units, key = tables.with_region(_repeated(spark, sf_dir)), ["doc_id", "region"]
    rows = tables.pipe_rows(units, key).unionByName(tables.borderless_rows(units, key).withColumn("item_no", F.lit(None).cast("int")))
    return tables.with_continuations(rows, key)
