"""Completeness audits: word bags, loss ratio, missing words with snippets, footnote marks, run counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import tokens


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token, n): partial counts before the only shuffle."""
    return documents.select(key, F.explode(tokens(text)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def bag_difference(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words of left that right lacks, with how many: one union and one group-by instead of a join of two aggregates."""
    both = left.withColumn("w", F.lit(1)).unionByName(right.withColumn("w", F.lit(-1)))
    one = both.select(key, "w", F.explode(tokens("text")).alias("token")).groupBy(key, "token").agg(F.sum("w").alias("n"))
    return one.where("n > 0")


def loss(left: DataFrame, right: DataFrame, key: str = "doc_id", most: float = 0.02) -> DataFrame:
    """(key, words, missing, ratio, passed); an empty left document passes with a null ratio."""
    both = left.withColumn("w", F.lit(1)).unionByName(right.withColumn("w", F.lit(-1)))
    rows = both.select(key, "w", F.explode_outer(tokens("text")).alias("token")).groupBy(key, "token").agg(F.sum("w").alias("d"), F.sum(F.when(F.col("w") == 1, 1).otherwise(0)).alias("own"))
    real = F.col("token").isNotNull()
    out = rows.groupBy(key).agg(F.sum(F.when(real, F.col("own")).otherwise(0)).alias("words"), F.sum(F.when(real, F.greatest("d", F.lit(0))).otherwise(0)).alias("missing"))
    ratio = F.try_divide("missing", "words")
    return out.withColumn("ratio", ratio).withColumn("passed", F.coalesce(ratio < most, F.lit(True)))


def word_positions(pages: DataFrame, key: list[str], reach: int = 4) -> DataFrame:
    """Words with position and the snippet of `reach` words either side, cut from the page's own word array: no window."""
    w = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    rows = pages.select(*key, w.alias("w")).select(*key, "w", F.posexplode("w").alias("pos", "word"))
    start = F.greatest(F.col("pos") - reach, F.lit(0))
    return rows.select(*key, "pos", F.lower("word").alias("word"), F.array_join(F.slice("w", start + 1, F.col("pos") + reach + 1 - start), " ").alias("snippet"))


def missing_occurrences(missing: DataFrame, positions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first n places of each word missing n times, by page where the positions have one."""
    place = [c for c in ("page", "pos") if c in positions.columns]
    w = Window.partitionBy(key, "token").orderBy(*place)
    return positions.withColumnRenamed("word", "token").join(missing, [key, "token"]).withColumn("r", F.row_number().over(w)).where("r <= n").select(key, "token", *place, "snippet")


def most_missing(missing: DataFrame, k: int = 20, key: str = "doc_id") -> DataFrame:
    return missing.orderBy(F.desc("n"), "token", key).limit(k)


def footnote_marks(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    return documents.select(key, F.regexp_count("text", F.lit(P.FOOTNOTE_MARKS)).alias("marks")).withColumn("has_footnotes", F.col("marks") > 0)


def footnote_summary(documents: DataFrame) -> DataFrame:
    return footnote_marks(documents).agg(F.count("*").alias("documents"), F.count_if("has_footnotes").alias("with_footnotes"), F.sum("marks").alias("marks"))
