"""Readers: folders of texts, JSON documents, page tables. Whole files are rows, so nothing is read on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_number
from ..operators.lines import markdown_lines, positioned_lines


def read_folder(spark: SparkSession, path: str, pattern: str = "*.md", only: int | None = None) -> DataFrame:
    """(doc_id, name, number, text) of each file; ``only`` keeps one number, by file name, before texts are parsed."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).withColumn("name", F.col("_metadata.file_name"))
    out = files.select(F.regexp_replace("name", r"\.[^.]+$", "").alias("doc_id"), "name", first_number("name").alias("number"), F.col("value").alias("text"))
    return out if only is None else out.where(F.col("number") == only)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return markdown_lines(read_folder(spark, path))


def read_positioned(spark: SparkSession, path: str) -> DataFrame:
    return positioned_lines(read_folder(spark, path, "*.txt"))


def read_json_units(spark: SparkSession, path: str, depth: int = 6) -> DataFrame:
    """Units of nested document JSON as rows: the recursive shape is a VARIANT, flattened level by level."""
    docs = read_folder(spark, path, "*.json").select("doc_id", F.expr("try_parse_json(text)").alias("v"))
    kinds = ("chapters", "sections", "subsections", "clauses", "sub_clauses", "items", "sub_items", "children", "explanations", "provisos", "illustrations")
    kids = lambda c: F.flatten(F.filter(F.array(*(F.try_variant_get(c, f"$.{k}", "array<variant>") for k in kinds)), lambda x: x.isNotNull()))
    level = docs.select("doc_id", F.lit(None).cast("string").alias("parent_id"), F.explode(kids(F.col("v"))).alias("v"))
    out = None
    for d in range(1, depth + 1):
        get = lambda name, kind="string": F.try_variant_get("v", f"$.{name}", kind)
        rows = level.select("doc_id", "parent_id", F.lit(d).alias("depth"), get("type").alias("type"), get("number").alias("number"), get("id").alias("unit_id"), get("title").alias("title"), get("text").alias("text"))
        out = rows if out is None else out.unionByName(rows)
        level = level.select("doc_id", F.try_variant_get("v", "$.id", "string").alias("parent_id"), F.explode(kids(F.col("v"))).alias("v"))
    return out.where("type is not null")

