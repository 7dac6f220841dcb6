"""Extension: the stateless generators over a stream of texts, and an edge table kept by micro-batches.

Generators carry no state, so they run unchanged on readStream; only the in-degree needs an aggregation. Each batch's
distinct edges are written under its number, so a replayed batch overwrites its own, and an edge counts once however many
batches hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mentions import outgoing_edges, relation_mentions


def stream_texts(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    stream = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.select(F.regexp_extract(F.col("_metadata.file_name"), r"\d+", 0).alias("doc_id"), F.col("value").alias("text"))


def stream_mentions(texts: DataFrame) -> DataFrame:
    return relation_mentions(texts)


def keep_edges(texts: DataFrame, folder: str, checkpoint: str):
    """Start a query that writes each batch's edges to folder/batch=n."""

    def write(batch: DataFrame, number: int) -> None:
        outgoing_edges(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n"))
