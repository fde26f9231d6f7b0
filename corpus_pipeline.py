"""The corpus pipeline: quality rules, near-dedup, secret scans, source mixing, packing.

Every stage takes all documents that the one before kept and returns the columns of documents (the last: pieces); run()
writes each stage's rows as Parquet in the shared folder and reads them for the next, so that a lost executor costs no
more than the stage at hand; what a stage wrote on its way is dropped then. Part of the llm package, but for its place.

Edge cases, stage by stage: a null or empty text has no words, so the quality rules reject it; later stages take a null
text for an empty one and leave it null. Rows with a null doc_id are documents like any other: near-dedup keeps them by
their texts, mixing draws by their texts. Of repeated rows (equal doc_id and text) near-dedup keeps one. Ties go to the
smallest doc_id. Texts are read whole, however long. An empty table goes through as an empty table. Further columns,
whatever their names, stay up to the last stage, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragstone.llm.common import settled, small_batches, table
from ragstone.llm.mixing import mix_sources
from ragstone.llm.neardup import BATCH_BYTES, keep_one
from ragstone.llm.packing import pack_documents
from ragstone.llm.quality import filter_quality
from ragstone.llm.secrets import redact_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest doc_id."""
    return keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked where they stand; every document stays."""
    return redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mixing", source_mixing),
    ("packing", packing),
]

#: Signatures, entropy tests and token ids are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with small_batches(spark, BATCH_BYTES):
            docs = settled(spark, lambda: stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
