"""Corpus pipeline: documents through five stages to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waybill.llm.mixing import mix
from waybill.llm.near_dup import without_near_copies
from waybill.llm.packing import pack
from waybill.llm.pii import without_pii
from waybill.llm.quality import quality_filter
from waybill.llm.queries_files import tokenizer_path
from waybill.llm.registry import prepared, table
from waybill.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    prepared(spark)
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest, of each near-duplicate class."""
    prepared(spark)
    return without_near_copies(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates, addresses and secrets replaced by pseudonyms."""
    prepared(spark)
    return without_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to target weights: documents repeated or left out."""
    prepared(spark)
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    prepared(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("packing", packing),
]

# sampling and tokenizing have no SQL form; tests/llm/test_pipeline.py has a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
