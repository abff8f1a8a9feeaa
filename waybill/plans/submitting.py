"""Requests from ``conversations`` against a small catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.operators import submit as S
from waybill.functions.payload import json_type
from waybill.plans.bindings import table, utc
from waybill.plans.registry import query

TOOLS = """
SELECT * FROM VALUES
  ('user', CAST(NULL AS ARRAY<STRING>), 'chat', true, 60, map('tier', 'gold')),
  ('assistant', array('draft', 'check'), CAST(NULL AS STRING), CAST(NULL AS BOOLEAN),
   CAST(NULL AS INT), CAST(NULL AS MAP<STRING, STRING>)),
  ('system', CAST(NULL AS ARRAY<STRING>), 'absent', false, 0, map('tier', 'tin'))
AS tools(name, route, template, progress, timeout, metadata)
"""
PARAMS = """
SELECT * FROM VALUES
  ('user', 'text', 'string', true, CAST(NULL AS STRING), CAST(NULL AS ARRAY<STRING>)),
  ('user', 'turn', 'integer', true, CAST(NULL AS STRING), CAST(NULL AS ARRAY<STRING>)),
  ('user', 'mode', 'string', false, '"fast"', array('fast', 'slow')),
  ('assistant', 'text', 'string', true, CAST(NULL AS STRING), CAST(NULL AS ARRAY<STRING>))
AS params(tool, name, type, required, default, options)
"""
TEMPLATES = "SELECT * FROM VALUES ('chat', array('read', 'draft', 'send')) AS t(name, actors)"

DECLARED = {
    "type": "object",
    "properties": {"text": {"type": "string"}, "turn": {"type": "integer"}},
}
START = "2024-03-01 00:00:00"


def catalogue(spark: SparkSession):
    return spark.sql(TOOLS), spark.sql(PARAMS), spark.sql(TEMPLATES)


def requests(spark: SparkSession, sf_dir: str, *, wrong_types: bool = False) -> DataFrame:
    """Every turn is a request: tool = role, argument keys by the parity of the turn."""
    turn = F.col("turn")
    odd = turn % 2 == 1
    number = turn
    fields = F.struct("text", F.when(odd, number).alias("turn"))
    body = F.to_json(fields)
    if wrong_types:
        body = (
            F.when(turn % 4 == 0, F.to_json(F.struct("text", F.lit("one").alias("turn"))))
            .when(turn % 4 == 1, F.to_json(F.struct("text", "turn", F.lit("odd").alias("mode"))))
            .when(turn % 4 == 2, F.to_json(F.struct(F.lit(5).alias("text"), "turn")))
            .otherwise(F.to_json(F.struct("text", "turn", F.lit("slow").alias("mode"))))
        )
    created = F.timestamp_seconds(F.unix_seconds(F.lit(START).cast("timestamp")) + turn)
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn).alias("id"),
        F.col("role").alias("tool"),
        body.alias("arguments"),
        created.alias("created_at"),
    )


REQUEST_SQL = f"""
r AS (
  SELECT 'c' || conv_id || '-' || turn AS id, role AS tool, turn, text,
         TIMESTAMP '{START}' + to_seconds(turn) AS created_at FROM conversations
)
"""


@query("submit_requests", f"""WITH {REQUEST_SQL}, v AS (
  SELECT *, CASE
    WHEN tool NOT IN ('user', 'assistant', 'system') THEN 'unknown tool: ' || tool
    WHEN tool = 'system' THEN 'route error: route template "absent" not found'
    WHEN tool = 'user' AND turn % 2 = 0 THEN 'missing required parameter: turn' END AS rejected
  FROM r
)
SELECT id, tool, rejected,
       CASE tool WHEN 'user' THEN 'read,draft,send' WHEN 'assistant' THEN 'draft,check' END AS actors,
       CASE WHEN tool IN ('user', 'assistant', 'system') THEN tool = 'user' END AS progress,
       CASE tool WHEN 'user' THEN 60 WHEN 'assistant' THEN 300 WHEN 'system' THEN 0 END AS timeout_sec,
       CASE tool WHEN 'user' THEN 'gold' WHEN 'system' THEN 'tin' END AS tier,
       id AS job_id,
       CASE tool WHEN 'user' THEN created_at + INTERVAL 60 SECOND
                 WHEN 'assistant' THEN created_at + INTERVAL 300 SECOND END AS deadline
FROM v""")
def submit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests checked against tools, templates and required parameters."""
    out = S.submit(requests(spark, sf_dir), *catalogue(spark))
    return out.select(
        "id", "tool", "rejected",
        F.array_join("route.actors", ",").alias("actors"),
        "progress", "timeout_sec",
        F.try_element_at("tool_metadata", F.lit("tier")).alias("tier"),
        F.try_element_at("route.metadata", F.lit("job_id")).alias("job_id"),
        utc("deadline").alias("deadline"),
    )


@query("strict_arguments", f"""WITH {REQUEST_SQL}
SELECT id,
  CASE WHEN tool NOT IN ('user', 'assistant', 'system') THEN 'unknown tool: ' || tool
       WHEN tool = 'system' THEN 'route error: route template "absent" not found'
       WHEN tool = 'user' AND turn % 4 = 0 THEN 'invalid argument: turn:type'
       WHEN tool = 'user' AND turn % 4 = 1 THEN 'invalid argument: mode:option'
       WHEN tool IN ('user', 'assistant') AND turn % 4 = 2 THEN 'invalid argument: text:type' END
    AS rejected,
  CASE WHEN turn % 4 = 0 THEN 'string' ELSE 'integer' END AS turn_type,
  CASE WHEN turn % 4 = 1 THEN 'odd' WHEN turn % 4 = 3 THEN 'slow'
       WHEN tool = 'user' THEN 'fast' END AS mode,
  turn % 4 <> 0 AND turn % 4 <> 2 AS nested_ok
FROM r""")
def strict_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and options checked, defaults filled."""
    out = S.submit(requests(spark, sf_dir, wrong_types=True), *catalogue(spark), strict=True)
    doc = F.try_parse_json("payload")
    typed = out.withColumn("doc", doc)
    return typed.select(
        "id", "rejected",
        json_type(F.try_variant_get("doc", "$.turn", "variant")).alias("turn_type"),
        F.get_json_object("payload", "$.mode").alias("mode"),
        S.fits(F.col("doc"), DECLARED).alias("nested_ok"),
    )


@query("missing_parameters", f"""WITH {REQUEST_SQL}
SELECT tool, CASE WHEN tool = 'user' AND turn % 2 = 0 THEN 'turn' ELSE '' END AS missing,
       count(*) AS n FROM r GROUP BY ALL""")
def missing_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required parameters absent, counted per tool."""
    sets = S.param_sets(spark.sql(PARAMS))
    joined = requests(spark, sf_dir).join(sets, "tool", "left")
    missing = F.array_join(S.missing_params(F.col("arguments"), F.col("specs")), ",")
    return joined.groupBy("tool", missing.alias("missing")).agg(F.count(F.lit(1)).alias("n"))
