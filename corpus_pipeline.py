"""A corpus through five stages: quality rules, line dedup, SimHash near-duplicates, decontamination, mixing.

Each stage keeps the columns of documents, whatever else they are, and works on rows with nulls in any column: a null text has
no words, so that the quality rules reject it; a null doc_id is a document like others, after all others in order, and has no
label; rows of one id are documents of their own if their texts differ. An empty table gives an empty one. What each
operator does with ties and repeated rows is said in its module.

Verdicts that depend on a row alone (quality rules, benchmark words) are narrow passes. Line numbers to delete and rows that
are copies go to all tasks while they are few; beyond, texts are shuffled once for each of these two stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import decontamination, line_dedup, mixing, quality_rules, simhash
from glyphloom.llm._shared import shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of `row` with the new text, and its length where n_chars gives it."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; repeated rows have one fate. Without labels of both kinds the base rules decide."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs that an earlier place has; a document of which no word is left goes. Rows equal in
    doc_id and text are one document."""
    found = line_dedup.deduplicate(docs)
    return _with_text(found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, of the smallest doc_id; of equal rows one stays."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that benchmark windows cover; one of which nothing else is left goes. An empty benchmark
    changes nothing."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), clean=True)
    return _with_text(found.where((F.size("spans") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, also repeated ones; a null source is a source."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("mixing", mix),
]

#: SQL has neither the learned rules nor XXH64; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
