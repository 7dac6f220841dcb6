"""The corpus pipeline: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of documents
(the last one returns placed pieces). run() writes each stage's rows to the shared folder and rereads them.

Defined cases: a null or empty text has the classifier's prior as its score (kept from 0.3), one empty line, no near copy
and size 0, so the mix does not take it; rows with a null doc_id are judged by their text, lose no lines and are no near
copy of any other; equal rows are one group, of which one stays, and so are rows of one doc_id with near copies, while
its unlike texts stay; of equally near documents the smallest doc_id stays; a very long text passes whole; extra columns
are carried to the mixed documents, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.line_dedup import count_names, dedup_lines
from lexweave.llm.minhash import dedup_documents
from lexweave.llm.mixing import mixed_documents
from lexweave.llm.packing import pack
from lexweave.llm.quality import good_documents
from lexweave.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines held by many documents stay in one; n_chars follows the text."""
    dropped = F.col(count_names(docs.columns)[1])
    return dedup_lines(docs).withColumn("n_chars", F.when(dropped > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return dedup_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in a sequence."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near), ("mixing sources", mixing), ("best-fit packing", packing)]

#: Fitted models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i + 1}")
    return docs
