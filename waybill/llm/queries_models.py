"""Queries of the operators that fit a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.llm.registry import query, table
from waybill.llm.toxicity import THRESHOLD, fitted, toxic_scores


@query("op12_toxicity")
def op12_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fitted(docs, labels.filter(~held_out))
    return toxic_scores(docs, model).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "spans",
    )
