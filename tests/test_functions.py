"""Scalar functions against values derived by hand."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T

CASES = [
    (T.clean_text, "  a  b\t c ", "a b c"),
    (T.table_marker, "**TABLE**", "TABLE"),
    (T.table_marker, "| Table |", "TABLE"),
    (T.header_text, "(A)", "[A]"),
    (T.strip_inline_markup, "**bold** [link](u) `code` x<sup>2</sup> ( a )", "bold link code x2 (a)"),
    (T.strip_closing_bracket, "text]", "text"),
    (T.without_tail_punctuation, "Table: Sl. No. 3 ).", "Table: Sl. No. 3"),
    (T.without_fence, "```json\n[1]\n```", "[1]"),
    (T.escape_markdown, "a*b_c`d\\e", "a\\*b\\_c\\`d\\\\e"),
    (T.first_number, "107section.md", 107),
    (T.first_number, "notes.md", 0),
    (T.split_pipe_row, "| a | b |", ["a", "b"]),
    (T.tokens, "Ab-1, c", ["ab", "1", "c"]),
    (T.expand_range, "28 to 33, 44 to 49, 51 and 52", [str(x) for x in (*range(28, 34), *range(44, 50), 51, 52)]),
    (T.expand_range, "7 or 8", ["7", "8"]),
    (T.number_tokens, "(a), (b) or 5", ["a", "b", "5"]),
    (T.footnote_refs, "17[(6) text", ["17"]),
    (T.footnote_refs, "plain (6)", []),
    (T.split_borderless, "3.  From 1   5%", ["3.", "From 1", "5%"]),
]


@pytest.mark.parametrize("function, value, want", CASES)
def test_scalar(spark, function, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(function("v")).first()[0] == want


@pytest.mark.parametrize("value, want", [("(3) abc", (3, "abc")), ("4. def", (4, "def")), ("5.", (5, "")), ("7", (7, "")), ("10%", (None, "10%"))])
def test_item_number(spark, value, want):
    assert tuple(spark.createDataFrame([(value,)], "v string").select(T.item_number("v").alias("i")).first()["i"]) == want


def test_heading_levels(spark):
    rows = spark.createDataFrame([(x,) for x in (18.0, 15.0, 12.5, 11.0, 10.9)], "s double").select(T.heading_level("s", F.lit(10.0))).collect()
    assert [r[0] for r in rows] == [1, 2, 3, 4, None]


def test_nulls_pass_through(spark):
    row = spark.createDataFrame([(None,)], "v string").select(*(f("v") for f in (T.clean_text, T.strip_inline_markup, T.table_marker, T.first_number, T.tokens, T.expand_range))).first()
    assert row[0] is None and row[3] == 0
