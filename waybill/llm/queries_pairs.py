"""Queries of the operators that compare rows with each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.llm.near_dup import near_copies
from waybill.llm.registry import query, table
from waybill.llm.substring import without_repeats
from waybill.llm.variants import spelling_variants
from waybill.llm.vectors import near_vectors


@query("op3_substring")
def op3_substring(spark, sf_dir):
    """Documents without the passages of 13 words and more that smaller ones have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op4_minhash")
def op4_minhash(spark, sf_dir):
    """Near-duplicate class of every document."""
    return near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = """
WITH RECURSIVE unit AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS v, vec_id AS r FROM embeddings
  UNION
  SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.v
), part AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE links.a = vec_id) AS BIGINT) AS n_links,
       component_id, vec_id = component_id AS kept
FROM embeddings JOIN part ON part.v = vec_id
"""


@query("op9_vectors", OP9_SQL)
def op9_vectors(spark, sf_dir):
    """Links and components of all vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_variants")
def op13_variants(spark, sf_dir):
    """Words of all documents, their near words and the forms they stand for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(docs).select(
        "word", "form", "root", "n", "n_near", F.col("form_n").cast("bigint").alias("form_n")
    )
