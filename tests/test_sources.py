"""Readers and sinks: what is written comes back; streams; model hooks."""

import json

import pytest
from pyspark.sql import functions as F

from lexweave.operators import fold, hierarchy, layout, mentions, tables
from lexweave.operators.finish import document_json
from lexweave.plans import hooks
from lexweave.sources import readers, sinks
from lexweave.streaming import mentions as streaming

LINES = ["CHAPTER II - Basis", "5. (1) Head text", "(a) alpha", "(i) one", "continued", "(b) beta", "17[(2) two]", "Explanation 1.— means", "TABLE", "|No|Head|", "|1.|one|5%|", "1. Sub. by Act No. 5"]


def _fold_lines(spark, texts, doc=1):
    return spark.createDataFrame([(doc, 1, i + 1, 0, None, False, False, t) for i, t in enumerate(texts)], "doc_id int, page int, line_no int, indent int, heading_level int, bold boolean, list_item boolean, text string")


def _lines(spark, texts, doc=1):
    return spark.createDataFrame([(doc, i + 1, t) for i, t in enumerate(texts)], "doc_id int, line_no int, text string")


def test_finished_documents_nest_children_by_kind(spark):
    doc = json.loads(document_json(fold.parsed(_fold_lines(spark, LINES))).first().json)
    section = doc["chapters"][0]["sections"][0]
    assert doc["sections"] == [] and doc["chapters"][0]["title"] == "Basis" and section["id"] == "5"
    one, two = section["subsections"]
    assert one["text_before_clauses"] == "Head text" and one["text_after_clauses"] == ""
    assert [c["id"] for c in one["clauses"]] == ["5-1-a", "5-1-b"] and one["clauses"][1]["text"] == "beta" and one["clauses"][1]["children"] == []
    assert one["clauses"][0]["sub_clauses"][0]["text"] == "one continued"
    assert two["footnote_refs"] == ["17"] and two["text_before_explanations"] == "two" and two["explanations"][0]["text"] == "means"
    assert two["table"]["rows"] == [{"item_no": 1, "column_0": "", "column_1": "one", "column_2": "5%"}] and two["table"]["columns"] == ["No", "Head"]
    assert doc["footnotes"][0] == {"type": "footnote", "number": "1", "page_start": 1, "page_end": 1, "text": "Sub. by Act No. 5"} and doc["footnote_reference_map"] == {"17": ["5-2"]}


def test_loose_tables_and_repeated_sections_are_kept(spark):
    doc = json.loads(document_json(fold.parsed(_fold_lines(spark, ["|a|b|", "TABLE", "|1.|x|", "5. (1) one", "(a) first", "(1) again", "(a) second", "17[(3) three]", "17. Ins. by Act"]))).first().json)
    assert doc["orphan_tables"][0]["table_id"] == "table-table-1" and doc["orphans"][0]["text"] == "|a|b|"
    assert [s["clauses"][0]["text"] for s in doc["sections"][0]["subsections"][:2]] == ["first", "second"]
    assert doc["footnotes"][0]["referenced_by"] == ["5-3"]


def test_documents_are_written_one_by_one(spark, tmp_path):
    both = _fold_lines(spark, LINES).unionByName(_fold_lines(spark, ["6. (1) other"], 2))
    sinks.write_documents(fold.parsed(both), f"{tmp_path}/json")
    back = spark.read.text(f"{tmp_path}/json", wholetext=True)
    assert {r.doc_id: json.loads(r.value)["sections"] == [] for r in back.collect()} == {1: True, 2: False}
    assert back.where("value like '%\n  \"chapters\"%'").count() == 2
    with pytest.raises(Exception, match="already exists"):
        sinks.write_documents(fold.parsed(both), f"{tmp_path}/json")


def test_nested_json_is_read_back_as_units(spark, tmp_path):
    sinks.write_nested_json(hierarchy.units(_lines(spark, LINES[1:7])), f"{tmp_path}/json")
    (tmp_path / "named").mkdir()
    (tmp_path / "named" / "5section.json").write_text("".join(r.value for r in spark.read.text(f"{tmp_path}/json").collect()), encoding="utf-8")
    rows = readers.read_json_units(spark, f"{tmp_path}/named").orderBy("unit_id").collect()
    assert [(r.doc_id, r.unit_id, r.parent_id, r.type) for r in rows][:3] == [("5section", "5", None, "section"), ("5section", "5-1", "5", "subsection"), ("5section", "5-1-a", "5-1", "clause")]
    assert {r.unit_id: r.text for r in rows}["5-1-a-i"] == "one continued"


def test_folders_keep_names_numbers_and_one_section(spark, tmp_path):
    for name, text in (("2section.md", "PAGE 3\n2. (1) two\n\n- 1. item"), ("10section.md", "10. ten"), ("notes.md", "plain"), ("x.txt", "skip")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    files = readers.read_folder(spark, str(tmp_path))
    assert [(r.doc_id, r.number) for r in files.orderBy("number").collect()] == [("notes", 0), ("2section", 2), ("10section", 10)]
    assert [r.text for r in readers.read_folder(spark, str(tmp_path), only=10).collect()] == ["10. ten"]
    lines = readers.read_markdown(spark, str(tmp_path)).where("doc_id = '2section'").orderBy("line_no").collect()
    assert [(r.page, r.line_no, r.text, r.numeric_list_item) for r in lines] == [(3, 2, "2. (1) two", False), (3, 4, "1. item", True)]


def test_positioned_lines_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, 1, 30.0, 10.0, 9.0, False, "5. (1) x"), ("d", 1, 2, 45.25, 22.5, 9.5, True, "Title"), ("d", 2, 3, 30.0, 10.0, 9.0, False, "(2) y")], "doc_id string, page int, line_no int, x double, y double, font double, bold boolean, text string")
    sinks.write_positioned(rows, f"{tmp_path}/out")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.txt").write_text("\n".join(r.value for r in spark.read.text(f"{tmp_path}/out").collect()), encoding="utf-8")
    back = readers.read_positioned(spark, f"{tmp_path}/in").orderBy("line_no").collect()
    assert [(r.page, r.x, r.y, r.font, r.bold, r.text) for r in back] == [(r.page, r.x, r.y, r.font, r.bold, r.text) for r in rows.orderBy("page", "line_no").collect()]


def test_markdown_pages_and_graph_are_written(spark, tmp_path):
    sinks.write_markdown(spark.createDataFrame([("d", 2, "second"), ("d", 1, "first")], "doc_id string, page int, body string"), f"{tmp_path}/md")
    assert "\n".join(r.value for r in spark.read.text(f"{tmp_path}/md").collect()).split() == ["<!--", "Page", "1", "-->", "first", "---", "<!--", "Page", "2", "-->", "second", "---"]
    edges = spark.createDataFrame([("1", "2"), ("3", "2"), ("2", "10"), ("2", "9")], "src string, dst string")
    sinks.write_graph(edges, f"{tmp_path}/graph")
    assert {(r.dst, r.in_degree) for r in spark.read.parquet(f"{tmp_path}/graph/in_degree").collect()} == {("2", 2), ("10", 1), ("9", 1)}
    assert {r.section: (r.targets, r.n_callers, r.callers) for r in spark.read.json(f"{tmp_path}/graph/report").collect()}["2"] == ("9,10", 2, "1,3")


def test_references_are_written_with_their_unresolved_report(spark, tmp_path):
    refs = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "anchor string, resolved boolean")
    assert sinks.write_references(refs, f"{tmp_path}/all") == {"references": 3, "unresolved": 2}
    assert sinks.write_references(refs, f"{tmp_path}/some", include_unresolved=False) == {"references": 1, "unresolved": 2}
    assert spark.read.json(f"{tmp_path}/some/references").count() == 1 and spark.read.json(f"{tmp_path}/all/unresolved").count() == 2


def test_an_edge_of_two_batches_counts_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in (1, 2, 3):
        (tmp_path / "in" / f"{i}.md").write_text("see section 9 and section 9", encoding="utf-8")
    for run in range(2):
        streaming.keep_edges(streaming.stream_texts(spark, f"{tmp_path}/in", files_per_batch=1), f"{tmp_path}/edges", f"{tmp_path}/check-{run}").awaitTermination(120)
    assert [(r.dst, r.n) for r in streaming.in_degrees(spark, f"{tmp_path}/edges").collect()] == [("9", 3)]


def test_hooks_check_add_and_never_lose_rows(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "text one", "{}"), (2, "bad", "{}")], "doc_id int, text string, json string")
    asked = hooks.structure_hook(lambda prompt: "```json\n{\"a\": 1}\n```" if "text one" in prompt and "Tree:\n{}" in prompt else "no json")
    assert {r.doc_id: r.json for r in hooks.apply_hook(rows, asked).collect()} == {1: '{"a": 1}', 2: "{}"}
    failures = spark.sparkContext.accumulator(0)
    assert hooks.apply_hook(rows, lambda batch: 1 / 0, failures=failures).count() == 2 and failures.value >= 1
    monkeypatch.setenv("LEXWEAVE_TEST_KEY", "k")
    assert hooks.ModelConfig.from_environment("m", "LEXWEAVE_TEST_KEY").key == "k" and hooks.ModelConfig.from_environment("m", "LEXWEAVE_NO_KEY").key is None
    (tmp_path / "7.json").write_text("[1]", encoding="utf-8")
    assert [r.text for r in hooks.healed_folder(spark, str(tmp_path), lambda b: b.assign(text=b["text"] + "!")).collect()] == ["[1]!"]


def test_model_references_join_those_found(spark):
    texts = spark.createDataFrame([(1, 1, "under section 5 and rule 7"), (1, 2, "nothing")], "doc_id int, line_no int, text string")
    found = spark.createDataFrame([(1, 1, "section 5", "5", "high")], "doc_id int, line_no int, anchor string, target_id string, confidence string")

    def model(batch):
        named = [(r.doc_id, r.line_no, a, t) for r in batch.itertuples() for a, t in (("section 5", "55"), ("rule 7", ["r7", "r8"]), ("rule 7", "r9")) if a in r.text]
        return batch.iloc[0:0].reindex(range(len(named))).assign(doc_id=[n[0] for n in named], line_no=[n[1] for n in named], anchor=[n[2] for n in named], target_id=[n[3] for n in named])

    out = hooks.with_model_references(found, texts, ["doc_id", "line_no"], model).orderBy("anchor").collect()
    assert [(r.anchor, r.target_id, r.confidence, r.model) for r in out] == [("rule 7", "r7,r8", None, True), ("section 5", "5", "high", False)]
    assert hooks.with_model_references(found, texts, ["doc_id", "line_no"], model, hooks.ModelConfig()).count() == 1
    assert hooks.with_model_references(found, texts, ["doc_id", "line_no"], lambda b: 1 / 0).count() == 1


def test_existing_references_win(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id int, target_id string, anchor string, relationship string, ord int, note string")
    out = mentions.merge_references(make([(1, "5", "section 5", "x", 9, "old"), (1, "6", "section 6", "x", 1, "old")]), make([(1, "5", "section 5", "x", 1, "new"), (1, "5", "section 5", "y", 2, "new")]), ["doc_id"])
    assert {(r.target_id, r.relationship, r.note) for r in out.collect()} == {("5", "x", "old"), ("6", "x", "old"), ("5", "y", "new")}


def test_regions_of_placed_lines_and_known_headers(spark):
    from lexweave.functions import text as T

    rows = spark.createDataFrame([(1, 1, 200.0, "TABLE"), (1, 2, 40.0, "a row"), (1, 3, 30.0, "(2) next"), (1, 4, 40.0, "TABLE"), (1, 5, 40.0, "plain")], "doc_id int, line_no int, x double, text string")
    assert [r.line_no for r in layout.table_regions(rows).collect()] == [2]
    heads = spark.createDataFrame([("Sl. No. Assessee Income Rate of tax Conditions",), ("Sl. No.",)], "h string")
    assert [len(r[0]) for r in heads.select(T.known_columns("h")).collect()] == [5, 0]
    said = spark.createDataFrame([(" a ", None, "b  c")], "x string, y string, z string")
    assert said.select(T.node_text("x", "y", "z")).first()[0] == "a b c"
    marked = tables.table_ids(spark.createDataFrame([(1, "5", 3), (1, "5", 9), (1, None, 4)], "doc_id int, unit_id string, line_no int"))
    assert {r.table_id for r in marked.collect()} == {"5-table-1", "5-table-2", "table-table-1"}
