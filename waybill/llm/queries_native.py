"""Queries of the operators that are column functions only."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.llm.common import word_count
from waybill.llm.mixing import mixing_plan, with_copies
from waybill.llm.quality import BASE_RULES, RULES, STOP_WORDS, any_fails, measured
from waybill.llm.registry import query, table

OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INTEGER)
           AS bin
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source
), weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
         CAST(source_size * 3 AS DOUBLE) AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) AS budget
  FROM src
), levelled AS (
  SELECT *,
    budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS FIRST
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(w) OVER (ORDER BY cap / w, source ASC NULLS FIRST
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed
), filled AS (
  SELECT source, source_size,
         CASE WHEN cap * rest <= remaining * w THEN cap
              ELSE max(CASE WHEN cap * rest > remaining * w THEN remaining / rest END) OVER () * w
         END AS target
  FROM levelled
), wanted AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS epochs
  FROM filled
), parted AS (
  SELECT *, target - epochs * source_size AS part FROM wanted
), bins AS (
  SELECT source, bin, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin) AS cum
  FROM base GROUP BY source, bin
), picked AS (
  SELECT p.source, p.source_size, p.target, p.epochs, p.part,
         min({'off': abs(b.cum - p.part), 'bin': b.bin}) AS best
  FROM parted p JOIN bins b ON p.source IS NOT DISTINCT FROM b.source
  GROUP BY ALL
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, p.source_size, p.target,
       CAST(d.size * (p.epochs + CASE WHEN best.off < part AND d.bin <= best.bin THEN 1 ELSE 0 END)
            AS BIGINT) AS taken
FROM base d JOIN picked p ON d.source IS NOT DISTINCT FROM p.source
"""


@query("op1_mixing", OP1_SQL)
def op1_mixing(spark, sf_dir):
    """Words that the mix takes of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = mixing_plan(docs)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return with_copies(sized, plan).select(
        "doc_id",
        "size",
        F.col("__plan.source_size").alias("source_size"),
        F.col("__plan.target").alias("target"),
        (F.col("size") * F.col("__copies")).cast("bigint").alias("taken"),
    )


def _sql_rule(rule) -> str:
    from waybill.llm.quality import RATIOS

    part, whole = RATIOS.get(rule.measure, (rule.measure, None))
    whole = whole or "1"
    out = []
    if rule.low is not None:
        out.append(f"({whole} > 0 AND {part} < CAST({rule.low} AS DOUBLE) * {whole})")
    if rule.high is not None:
        out.append(f"({part} > CAST({rule.high} AS DOUBLE) * {whole})")
    return " OR ".join(out)


OP6_BASE_SQL = r"""
split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win)
  WHERE n > 1
), repeated AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice)
  GROUP BY doc_id
), counts AS (
  SELECT s.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN (STOPS))) AS n_stop_words,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣·]')))
           AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))
           AS n_ellipsis_lines
  FROM split s LEFT JOIN repeated r ON s.doc_id = r.doc_id
)
""".replace("STOPS", ", ".join(f"'{x}'" for x in STOP_WORDS))

OP6_SQL = (
    f"WITH {OP6_BASE_SQL}, judged AS (SELECT *, "
    "n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, "
    + " OR ".join(_sql_rule(r) for r in RULES)
    + " AS rule_failed FROM counts) "
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, "
    "NOT base_failed AND NOT rule_failed AS kept FROM judged"
)


@query("op6_quality", OP6_SQL)
def op6_quality(spark, sf_dir):
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = F.col("quality")
    base = any_fails(q, BASE_RULES)
    return measured(docs).select(
        "doc_id",
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
        q["n_repeat_words"].alias("n_repeat_words"),
        base.alias("base_failed"),
        (~base & ~any_fails(q, RULES)).alias("kept"),
    )
