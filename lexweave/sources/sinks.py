"""Sinks: nested JSON, references with their unresolved report, positioned text, Markdown, the reference graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.finish import document_json
from ..operators.hierarchy import nested_json
from ..operators.layout import positioned_text
from ..operators.mentions import section_report


def write_nested_json(units: DataFrame, path: str) -> None:
    """A line a document, from the units of the window path."""
    nested_json(units).select("json").write.mode("errorifexists").text(path)


def write_documents(parsed: DataFrame, path: str, indent: int | None = 2) -> None:
    """Finished documents of a parser, a folder ``doc_id=...`` each, with the JSON over as many lines as indent asks for."""
    document_json(parsed, indent).select("doc_id", "json").repartition("doc_id").write.mode("errorifexists").partitionBy("doc_id").text(path)


def write_references(refs: DataFrame, path: str, include_unresolved: bool = True) -> dict[str, int]:
    """references/ and unresolved/ under path, in one pass over a cached plan; how many rows each has."""
    kept = refs.persist()
    try:
        (kept if include_unresolved else kept.where("resolved")).write.json(f"{path}/references")
        kept.where("not resolved").write.json(f"{path}/unresolved")
        n = {bool(r["resolved"]): r["count"] for r in kept.groupBy("resolved").count().collect()}
        return {"references": sum(n.values()) if include_unresolved else n.get(True, 0), "unresolved": n.get(False, 0)}
    finally:
        kept.unpersist()


def write_positioned(lines: DataFrame, path: str, key: str = "doc_id") -> None:
    """A banner ``PAGE n`` before each page's lines, a file a document partition."""
    body = lines.select(key, "page", "line_no", positioned_text(lines).alias("value"))
    banner = lines.select(key, "page").distinct().select(key, "page", F.lit(-1).alias("line_no"), F.format_string("PAGE %d", "page").alias("value"))
    body.unionByName(banner).repartition(key).sortWithinPartitions(key, "page", "line_no").select("value").write.text(path)


def write_markdown(pages: DataFrame, path: str, key: str = "doc_id") -> None:
    """pages (key, page, body) as ``<!-- Page n -->``, body, rule."""
    text = F.concat(F.format_string("<!-- Page %d -->", "page"), F.lit("\n\n"), F.col("body"), F.lit("\n\n---\n"))
    pages.repartition(key).sortWithinPartitions(key, "page").select(text.alias("value")).write.text(path)


def write_graph(edges: DataFrame, path: str) -> None:
    """edges/ and in_degree/ as Parquet, report/ as JSON: each section with its targets and first callers."""
    edges.write.parquet(f"{path}/edges")
    edges.groupBy("dst").agg(F.count("*").alias("in_degree")).write.parquet(f"{path}/in_degree")
    section_report(edges).write.json(f"{path}/report")
