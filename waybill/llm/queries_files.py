"""Queries of the operators that encode texts or write files."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.llm.alignment import aligned
from waybill.llm.html_text import extract
from waybill.llm.packing import pack
from waybill.llm.pii import pseudonyms
from waybill.llm.registry import query, table
from waybill.llm.token_files import read_ids, write_ids
from waybill.llm.warc import read_archives, records, write_archives
from waybill.session import scratch


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op2_token_ids")
def op2_token_ids(spark, sf_dir):
    """Documents as written to and read back from id files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write_ids(docs, scratch(spark, "ids"), tokenizer_path())
    return read_ids(manifest).select(
        F.col("key").alias("doc_id"),
        "start",
        F.col("n_ids").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query("op8_packing")
def op8_packing(spark, sf_dir):
    """Pieces of all documents in windows of 1024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, tokenizer_path()).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


OP5_SQL = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h
  FROM pages
), firsts AS (SELECT h, n, min(page_id) AS first FROM rows WHERE n >= 100 GROUP BY h, n)
SELECT page_id, CAST(rows.n AS BIGINT) AS payload_bytes, rows.h AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM rows LEFT JOIN firsts ON rows.h = firsts.h AND rows.n = firsts.n
"""


@query("op5_warc", OP5_SQL)
def op5_warc(spark, sf_dir):
    """Pages as read back from WARC archives: each record's last chunk has its totals."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = write_archives(records(pages), scratch(spark, "warc"))
    return (
        read_archives(archives)
        .filter("last")
        .select(
            F.col("key").cast("bigint").alias("page_id"),
            F.col("bytes_so_far").alias("payload_bytes"),
            F.col("digest_so_far").alias("payload_digest"),
            "record_type",
            F.col("refers_to").cast("bigint").alias("refers_to"),
        )
    )


@query("op7_html")
def op7_html(spark, sf_dir):
    """Visible text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return extract(pages).select("page_id", "text", F.length("text").alias("n_chars"))


@query("op10_pii")
def op10_pii(spark, sf_dir):
    """Documents with pseudonyms, and how many values were replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = docs.select("doc_id", pseudonyms(F.col("text")).alias("pii"))
    return done.select("doc_id", F.col("pii.text").alias("text"), "pii.n_replaced")


@query("op11_alignment")
def op11_alignment(spark, sf_dir):
    """Overlap links and groups of two tokenizations of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return aligned(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
