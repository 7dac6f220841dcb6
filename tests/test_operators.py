"""Operators on small fixtures."""

import json

from lexweave.functions import patterns as P
from lexweave.operators import audit, fold, hierarchy, layout, lines, mentions, tables
from lexweave.operators.positioned import parsed_positioned

DOC = ["5. (1) Head text", "(a) alpha", "(i) one", "continued", "(b) beta", "(2) two"]


def _lines(spark, texts, doc=1):
    return spark.createDataFrame([(doc, i + 1, t) for i, t in enumerate(texts)], "doc_id int, line_no int, text string")


def _fold_lines(spark, texts):
    return spark.createDataFrame([(1, 1, i + 1, 0, None, False, False, t) for i, t in enumerate(texts)], "doc_id int, page int, line_no int, indent int, heading_level int, bold boolean, list_item boolean, text string")


def test_window_and_fold_agree(spark):
    want = [("5", ""), ("5-1", "Head text"), ("5-1-a", "alpha"), ("5-1-a-i", "one continued"), ("5-1-b", "beta"), ("5-2", "two")]
    by_window = hierarchy.units(_lines(spark, DOC)).orderBy("place").select("unit_id", "text").collect()
    by_fold = fold.parsed(_fold_lines(spark, DOC)).orderBy("place").select("unit_id", "text_before").collect()
    assert [tuple(r) for r in by_window] == want
    assert [tuple(r) for r in by_fold] == want


def test_roman_after_its_predecessor_is_a_clause(spark):
    found = fold.parsed(_fold_lines(spark, ["5. (1) x", "(h) x", "(i) y", "(u) z", "(v) w"])).where("type = 'clause'").orderBy("place").collect()
    assert [r.unit_id for r in found] == ["5-1-h", "5-1-i", "5-1-u", "5-1-v"]


def test_footnote_bracket_opens_its_subsection(spark):
    row = fold.parsed(_fold_lines(spark, ["5. (1) x", "17[(6) text]"])).where("number = '6'").first()
    assert (row.unit_id, row.text_before, row.footnote_refs) == ("5-6", "text", ["17"])


def test_text_is_conserved_by_the_fold(spark):
    rows = fold.parsed(_fold_lines(spark, [*DOC, "1. Sub. by Act No. 5", "tail"])).collect()
    said = " ".join(f"{r.text_before or ''} {r.text_after or ''}" for r in rows).split()
    assert sorted(said) == sorted("Head text alpha one continued beta two Sub. by Act No. 5 tail".split())


def test_tables_are_conserved_by_the_fold(spark):
    block = ["TABLE", "|No|Head|", "|---|---|", "|1.|pipe one|", "||more|", "1.  loose   5%", "Explanation 1.— inside", "<tr><td>9.</td></tr>", "2. next row", "**Part**"]
    rows = fold.parsed(_fold_lines(spark, [*DOC, *block, "(3) three", "3.", "late row", "6. (1) six", "TABLE", "|(a)|x|", "|(b)|y|", "|(c)|z|"])).orderBy("place").collect()
    found = {r.unit_id: (r.kind, r.number, r.parent_id, r.text_before) for r in rows if r.kind.startswith("table")}
    assert found == {
        "5-2-table-1": ("table", None, "5-2", "No|Head"),
        "5-2-table-1-row-1": ("table_row", "1", "5-2-table-1", "|pipe one more loose Explanation 1.— inside <tr><td>9.</td></tr>|5%"),
        "5-2-table-1-row-2": ("table_row", "2", "5-2-table-1", "|next row **Part**"),
        "5-2-table-1-row-3": ("table_row", "3", "5-2-table-1", "late row"),
        "6-1-table-1": ("table", None, "6-1", "(a)|x"),
        "6-1-table-1-row-1": ("table_row", "1", "6-1-table-1", "(b)|y"),
        "6-1-table-1-row-2": ("table_row", "2", "6-1-table-1", "(c)|z"),
    }
    said = " ".join((r.text_before + " " + r.text_after).replace("|", " ") for r in rows).split()
    assert sorted(said) == sorted("Head text alpha one continued beta two No Head pipe one more loose 5% Explanation 1.— inside <tr><td>9.</td></tr> next row **Part** three late row six (a) x (b) y (c) z".split())


def test_a_section_ends_a_table_of_the_fold(spark):
    lines = [(1, 1, i + 1, 0, None, bold, False, t) for i, (t, bold) in enumerate([("5. Head", False), ("TABLE", False), ("1. row", False), ("6. Title", False), ("TABLE", False), ("1. row", False), ("Seventh", True), ("7. text", False)])]
    rows = fold.parsed(spark.createDataFrame(lines, _fold_lines(spark, ["x"]).schema)).orderBy("place").collect()
    assert [(r.unit_id, r.title, r.text_before) for r in rows if r.kind == "unit"] == [("5", None, "Head"), ("6", None, "Title"), ("7", "Seventh", "text")]
    assert [(r.parent_id, r.text_before) for r in rows if r.kind == "table_row"] == [("5-table-1", "|row"), ("6-table-1", "|row")]


def test_nested_json_parses(spark):
    made = hierarchy.nested_json(hierarchy.units(_lines(spark, DOC))).first()
    tree = json.loads(made.json)["sections"]
    assert tree[0]["id"] == "5" and [c["id"] for c in tree[0]["children"]] == ["5-1", "5-2"]
    assert tree[0]["children"][0]["children"][0]["children"][0]["id"] == "5-1-a-i"


def test_spans_state_where_anchors_stand(spark):
    text = "Under section 5(1) and sub-section (2)(b), clause (c) of Schedule XI."
    spans = mentions.located_spans(_lines(spark, [text]), ["doc_id", "line_no"]).collect()
    assert spans and all(text[s.start : s.end] == s.anchor for s in spans)


def test_containment_and_targets(spark):
    units = _lines(spark, ["paragraph 3(1) of Part A of Schedule XI"])
    kept = mentions.uncontained(mentions.located_spans(units, ["doc_id", "line_no"]), ["doc_id", "line_no"])
    from pyspark.sql import functions as F

    rows = mentions.resolved(kept.withColumn("section_id", F.lit("9")).withColumn("subsection_id", F.lit("9-1"))).collect()
    assert [(r.target_id, r.target_type) for r in rows] == [("schedule-XI-part-A-para-3-1", "paragraph")]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_references_across_a_line_break(spark):
    from lexweave.plans import pipeline

    texts = ["see section 3", "5. (1) Income in accordance with section", "12(1) of this Act", "(i) notwithstanding", "section 6", "Explanation 1.— section 7", "|1.|section 8|"]
    rows = _lines(spark, texts)
    found = pipeline.enriched(pipeline.whole_texts(rows), hierarchy.units(rows)).orderBy("place").collect()
    assert [(r.line_no, r.source_type, r.unit_id, r.target_id, r.relationship) for r in found] == [
        (1, "text", None, "3", "related_to"), (2, "subsection", "5-1", "12-1", "procedure_reference"), (4, "sub_clause", "5-1-i", "6", "overrides"),
        (6, "explanation", "5-1-i", "7", "related_to"), (7, "pipe_row", "5-1-i", "8", "related_to"),
    ]


def test_edges_leave_out_other_acts_and_subsections(spark):
    units = spark.createDataFrame([(205, "section 205(1) and sections 146 or 150, section 135 of the Companies Act, 2013")], "doc_id int, text string")
    assert {r.dst for r in mentions.outgoing_edges(units).collect()} == {"146", "150"}
    assert {"1", "135"} <= {r.dst for r in mentions.outgoing_edges(units, parity=True).collect()}


def test_relationships(spark):
    texts = ["Income under section 5", "Subject to section 5", "section 5 shall not apply", "notwithstanding anything in section 5"]
    spans = mentions.located_spans(_lines(spark, texts), ["doc_id", "line_no"]).withColumn("r", mentions.window90()).orderBy("line_no").collect()
    assert [s.r for s in spans] == ["depends_on", "subject_to", "exception_to", "overrides"]
    assert len(P.LOOKBACK60) == 4 and len(P.LOOKBACK70) == 6


def test_loss_and_empty_document(spark):
    left = spark.createDataFrame([(1, "a b b c"), (2, "")], "doc_id int, text string")
    right = spark.createDataFrame([(1, "b c"), (2, "")], "doc_id int, text string")
    rows = {r.doc_id: r for r in audit.loss(left, right).collect()}
    assert (rows[1].words, rows[1].missing, rows[1].passed) == (4, 2, False)
    assert rows[2].ratio is None and rows[2].passed


def test_html_cells_and_spans(spark):
    rows = tables.html_cells(_lines(spark, ["<tr> <td colspan=2> 2.</td> <td> From 1 to 2</td> <td> 5%</td> </tr>"]), ["doc_id"]).orderBy("col").collect()
    assert [(r.col, r.cell) for r in rows] == [(0, "2."), (2, "From 1 to 2"), (3, "5%")]


def test_merged_rows_keep_every_row(spark):
    texts = ["TABLE", "|No|Head|", "|1.|a|", "||loose|", "|1.|b|", "1.  c   5%", "(2) two", "TABLE", "|1.|d|"]
    key, at = ["doc_id", "region"], tables.with_region(_lines(spark, texts))
    rows = tables.merged_rows(tables.pipe_rows(at, key), tables.borderless_rows(at, key), key).collect()
    assert sorted((r.item_no or 0, r.cells) for r in rows) == [(0, "No|Head"), (0, "|loose"), (1, "1.|a 1.|b 1.|c|5%"), (1, "1.|d")]


def test_row_continuations_stay_in_their_table(spark):
    texts = ["TABLE", "|No|Head|", "|1.|one|", "||more|", "TABLE", "|(x)|Head|", "|(a)|alpha|", "||", "|(b)|beta|"]
    key, at = ["doc_id", "region"], tables.with_region(_lines(spark, texts))
    rows = tables.with_continuations(tables.pipe_rows(at, key), key).orderBy("region", "session").collect()
    assert [(r.region, r.item_no, r.cells, r.is_header) for r in rows] == [
        (1, None, "No|Head", True), (1, 1, "1.|one more", False), (2, None, "(x)|Head", True), (2, 1, "(a)|alpha", False), (2, 2, "(b)|beta", False),
    ]


def test_anchors_and_depths(spark):
    at = spark.createDataFrame([(1, 10.0), (1, 12.0), (1, 100.0)], "page int, x double")
    assert layout.column_anchors(at, ["page"]).first().anchors == [11.0, 100.0]
    listed = spark.createDataFrame([(1, i, x) for i, x in enumerate((10.0, 20.0, 20.5, 10.0))], "doc_id int, line_no int, x double")
    assert [r.depth for r in layout.list_depths(listed).orderBy("line_no").collect()] == [0, 1, 1, 0]


def test_positioned_scan(spark):
    text = "PAGE 2\n[x=  10.00] [y=  20.00] [font= 9.0] [bold=True] Hello  there\nnoise\n[x=  10.00] [y=  30.00] [font= 7.0] [bold=False] 12"
    rows = lines.positioned_lines(spark.createDataFrame([("d", text)], "doc_id string, text string")).collect()
    assert [(r.page, r.x, r.bold, r.text) for r in rows] == [(2, 10.0, True, "Hello there")]


def test_stream_counts_a_replayed_batch_once(spark, tmp_path):
    from lexweave.streaming.mentions import in_degrees, keep_edges, stream_texts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1section.md").write_text("see section 5 and section 7")
    for _ in range(2):
        keep_edges(stream_texts(spark, str(tmp_path / "in")), str(tmp_path / "edges"), str(tmp_path / "mark")).awaitTermination(120)
    assert {r.dst: r.n for r in in_degrees(spark, str(tmp_path / "edges")).collect()} == {"5": 1, "7": 1}


def test_list_depths_go_on_over_pages_and_start_anew_after_a_heading(spark):
    rows = spark.createDataFrame([("d", 1, 10.0, False), ("d", 2, 20.0, False), ("d", 3, 20.5, False), ("d", 4, 5.0, True), ("d", 5, 20.0, False), ("d", 6, 30.0, None)], "doc_id string, line_no int, x double, resets boolean")
    assert [r.depth for r in layout.list_depths(rows).orderBy("line_no").collect()] == [0, 1, 1, None, 0, 1]


def test_missing_words_come_by_page(spark):
    pages = spark.createDataFrame([("d", 2, "a b a"), ("d", 1, "x a")], "doc_id string, page int, text string")
    missing = spark.createDataFrame([("d", "a", 2)], "doc_id string, token string, n long")
    found = audit.missing_occurrences(missing, audit.word_positions(pages, ["doc_id", "page"])).orderBy("page").collect()
    assert [(r.page, r.pos, r.snippet) for r in found] == [(1, 1, "x a"), (2, 0, "a b a")]


def test_anchors_inside_earlier_ones_are_passed_over(spark):
    null = "cast(null as string) "
    texts = _lines(spark, ["section 51 and section 5 of this"]).selectExpr("doc_id", "line_no", "text", "'9' unit_id", "'9' section_id", *(null + c for c in ("subsection_id", "clause_id", "sub_clause_id", "item_id")))
    targets = lambda style: [r.target_id for r in mentions.detected(texts, ["doc_id", "line_no"], style).orderBy("start").collect()]
    assert targets("lookback60") == ["51", "5"] and targets("lookback70") == ["51"]


def test_seven_levels_open_items_of_items(spark):
    texts = ["5. (1) a", "(a) b", "(i) c", "(A) d", "(I) e", "(B) f"]
    ids = lambda levels: [r.unit_id for r in fold.parsed(_fold_lines(spark, texts), levels).orderBy("place").collect()]
    assert ids(7) == ["5", "5-1", "5-1-a", "5-1-a-i", "5-1-a-i-A", "5-1-a-i-A-I", "5-1-a-i-B"]
    assert ids(6)[-2:] == ["5-1-a-i-I", "5-1-a-i-B"]


def _placed(spark, rows):
    """(page, x, y, text) or with bold and font."""
    full = [(1, r[0], i + 1, float(r[1]), float(r[2]), float(r[5]) if len(r) > 5 else 9.0, bool(r[4]) if len(r) > 4 else False, r[3]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id int, page int, line_no int, x double, y double, font double, bold boolean, text string")


def test_positioned_text_opens_units_by_form_and_edge(spark):
    rows = [
        (1, 20, 10, "Income Tax Department"), (1, 20, 12, "1", False, 7), (1, 20, 20, "CHAPTER II - Basis"), (1, 30, 30, "Charge of tax", True), (1, 30, 40, "4. (1) Tax shall be charged"), (1, 45, 50, "(a) first"), (1, 60, 60, "(i) inner"),
        (1, 45, 70, "back to the clause"), (1, 60, 80, "and as reduced by more"), (1, 30, 90, "(2) next"), (1, 30, 100, "Explanation 1.— meaning"), (1, 30, 105, "12. far right is no section? it is"), (1, 100, 110, "13. Not at the margin"),
    ]
    found = parsed_positioned(_placed(spark, rows)).orderBy("place").collect()
    units = [(r.type, r.unit_id, r.parent_id, r.title, r.text_before, r.text_after) for r in found if r.kind == "unit"]
    assert units == [
        ("chapter", "chapter-II", None, "Basis", "", ""),
        ("section", "4", "chapter-II", "Charge of tax", "", ""),
        ("subsection", "4-1", "4", None, "Tax shall be charged", ""),
        ("clause", "4-1-a", "4-1", None, "first", "back to the clause and as reduced by more"),
        ("sub_clause", "4-1-a-i", "4-1-a", None, "inner", ""),
        ("subsection", "4-2", "4", None, "next", ""),
        ("explanation", "4-2-explanation-1", "4-2", None, "meaning", ""),
        ("section", "12", "chapter-II", None, "far right is no section? it is 13. Not at the margin", ""),
    ]


def test_positioned_footnotes_end_at_the_margin_and_at_the_page(spark):
    rows = [(1, 30, 10, "4. body"), (1, 30, 700, "1. Sub. by Act No. 5"), (1, 40, 710, "of 2020"), (2, 40, 10, "continued body"), (2, 30, 700, "2. Ins. by Act"), (2, 30, 710, "(1) text"), (2, 50, 720, "tail")]
    found = {(r.kind, r.number): r.text_before for r in parsed_positioned(_placed(spark, rows)).collect()}
    assert found == {("unit", "4"): "body continued body", ("footnote", "1"): "Sub. by Act No. 5 of 2020", ("footnote", "2"): "Ins. by Act", ("unit", "1"): "text tail"}


def test_positioned_tables_take_rows_by_height_and_columns_by_anchor(spark):
    rows = [
        (1, 30, 10, "5. (1) Rates"), (1, 200, 20, "TABLE"), (1, 30, 30, "Sl. No."), (1, 120, 30, "Income"), (1, 300, 31, "(A)"), (1, 36, 40, "1."), (1, 125, 41, "up to"), (1, 305, 40, "5%"), (1, 120, 50, "a lakh"),
        (1, 36, 60, "2."), (1, 120, 60, "more"), (1, 300, 60, "10%"), (1, 30, 70, "(2) after"), (1, 30, 80, "Sl. No. Other"), (1, 30, 90, "(1) alone"), (2, 40, 10, "(b) on another page"),
    ]
    found = parsed_positioned(_placed(spark, rows)).where("kind like 'table%'").orderBy("place").collect()
    assert [(r.unit_id, r.parent_id, r.number, r.title, r.text_before) for r in found] == [
        ("5-1-table-1", "5-1", None, "TABLE", "Sl. No.|Income|[A]"), ("5-1-table-1-row-1", "5-1-table-1", "1", None, "|up to a lakh|5%"), ("5-1-table-1-row-2", "5-1-table-1", "2", None, "|more|10%"),
        ("5-2-table-1", "5-2", None, "Sl. No. Other", "Sl. No. Other"),
    ]
    assert found[0].text_after == "Subsection (1): Rates Table items: Item 1 — Income: up to a lakh; [A]: 5%. Item 2 — Income: more; [A]: 10%."


def test_positioned_text_loses_no_word(spark):
    import random

    rng = random.Random(3)
    words = ["(1)", "(a)", "(ii)", "(B)", "7.", "word", "TABLE", "Sl. No. x", "Explanation", "5%", "3. Ins. by", "CHAPTER IV", "Provided that"]
    rows = [(1 + i // 40, rng.choice([10, 29, 40, 60, 200]), (i % 40) * 12, " ".join(rng.choice(words) for _ in range(3)), rng.random() < 0.1) for i in range(200)]
    found = parsed_positioned(_placed(spark, rows)).collect()
    assert {r.kind for r in found} <= {"unit", "footnote", "table", "table_row", "orphan"}
    said = " ".join(f"{r.title or ''} {r.text_before} {r.text_after if r.kind == 'unit' else ''}" for r in found)
    assert said.count("word") >= sum(r[3].count("word") for r in rows if not r[4])


def test_one_bad_document_gives_an_error_row(spark):
    rows = spark.createDataFrame([(1, 1, 1, 20.0, 1.0, 9.0, False, "4. fine"), (2, 1, 1, 20.0, 1.0, 9.0, False, None), (3, 1, 1, 20.0, 1.0, 9.0, False, "5. fine too")], "doc_id int, page int, line_no int, x double, y double, font double, bold boolean, text string")
    found = {r.doc_id: (r.kind, r.text_before) for r in parsed_positioned(rows).collect()}
    assert found[1] == ("unit", "fine") and found[3] == ("unit", "fine too") and found[2][0] == "error" and "NoneType" in found[2][1]
    broken = _fold_lines(spark, ["5. (1) x"]).unionByName(_fold_lines(spark, ["6. (1) y"]).selectExpr("2 doc_id", "page", "line_no", "indent", "heading_level", "bold", "list_item", "cast(null as string) text"))
    assert {(r.doc_id, r.kind) for r in fold.parsed(broken).collect()} == {(1, "unit"), (2, "error")}
