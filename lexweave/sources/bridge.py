"""Statute-like text from integer keys: the same lines in Spark and in SQL, for tables that hold no statutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES = (
    "{doc}. (1) Subject to section {a}({b}), income shall be computed",
    "(a) referred to in sub-section ({b})({cl})",
    "(i) under sections {a}, {a1} and {a2};",
    "(A) sections {a} to {a5} shall not apply",
    "(b) section {a} of the Companies Act, 2013",
    "(2) for the purposes of this section, clause ({cl}) of Chapter XIX-C",
    "and paragraph {b}(1) of Part A of Schedule XI, notwithstanding anything contained in section {a}",
    "TABLE",
    "|{b}.|cell {a}|{a1}%|",
    "{b}.  From {a}   {a1}%",
    "<tr><td>{b}.</td><td>From {a}</td><td>{a1}%</td></tr>",
    "Explanation 1.— Schedule XI (Table: Sl. No. {b})",
    "17[(3)  see  item (ii) under this clause",
    "Provided that the manner prescribed in section {a} as defined in clause ({cl})",
    '{b}. Sub. for "x" by Act No. {b} of 2026, w.e.f. 1-4-2026.',
    "continued text on Part A and  the said Table [^{b}]",
)
PER_DOC = len(TEMPLATES)


def statute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id INT, line_no INT, kind INT, text STRING), a document every PER_DOC orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    a = F.col("o_custkey") % 500 + 1
    values = {
        "doc": F.expr(f"o_orderkey div {PER_DOC}") + 1, "a": a, "b": F.col("o_custkey") % 7 + 1, "a1": a + 1, "a2": a + 2, "a5": a + 5,
        "cl": F.substring(F.lit("abcdefgh"), (F.col("o_custkey") % 8 + 1).cast("int"), 1),
    }
    kind = (F.col("o_orderkey") % PER_DOC).cast("int")
    text = None
    for i, template in enumerate(TEMPLATES):
        parts = []
        for j, piece in enumerate(_split(template)):
            parts.append(values[piece].cast("string") if j % 2 else F.lit(piece))
        line = F.concat(*parts)
        text = F.when(kind == i, line) if text is None else text.when(kind == i, line)
    return o.select(values["doc"].cast("int").alias("doc_id"), (kind + 1).alias("line_no"), kind.alias("kind"), text.alias("text"))


def _split(template: str) -> list[str]:
    import re

    return re.split(r"\{(\w+)\}", template)


def lines_sql() -> str:
    """The same rows as a SQL common table expression body."""
    names = {"doc": f"(o_orderkey // {PER_DOC} + 1)", "a": "(o_custkey % 500 + 1)", "b": "(o_custkey % 7 + 1)", "a1": "(o_custkey % 500 + 2)", "a2": "(o_custkey % 500 + 3)", "a5": "(o_custkey % 500 + 6)", "cl": "substr('abcdefgh', (o_custkey % 8 + 1)::INT, 1)"}
    cases = []
    for i, template in enumerate(TEMPLATES):
        parts = [f"{names[p]}::VARCHAR" if j % 2 else "'" + p.replace("'", "''") + "'" for j, p in enumerate(_split(template))]
        cases.append(f"WHEN {i} THEN " + " || ".join(parts))
    return f"SELECT (o_orderkey // {PER_DOC} + 1)::INT AS doc_id, (o_orderkey % {PER_DOC} + 1)::INT AS line_no, (o_orderkey % {PER_DOC})::INT AS kind, CASE o_orderkey % {PER_DOC} {' '.join(cases)} END AS text FROM orders"
