"""Envelopes as JSON bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions.checks import frame_reason, route_of, text_map
from waybill.functions.payload import json_type, part


def parse_envelopes(raw: DataFrame, col: str = "body") -> DataFrame:
    """Bodies as envelopes; a bad body becomes a row with ``outcome`` and ``reason``.

    ``outcome`` is null for a sound envelope, else the failure class:
    ``parse_error`` (not a JSON object), ``validation_error`` (no id) or
    ``runtime_error`` (frame rule broken, named by ``reason``). A body that does
    not parse keeps an empty id and no payload.
    """
    rest = [c for c in raw.columns if c != col]
    doc = F.col("__doc")
    parsed = raw.withColumn("__doc", F.try_parse_json(F.col(col)))
    kind = json_type(doc)
    id_type = json_type(part(doc, "$.id"))
    bad = (doc.isNull() | (kind != "object")
           | F.coalesce(~id_type.isin("string", "null"), F.lit(False)))
    id_ = F.coalesce(F.try_variant_get(doc, "$.id", "string"), F.lit(""))
    flagged = parsed.withColumn("__bad", bad).withColumn(
        "reason",
        F.when(F.col("__bad"), "invalid_json")
        .when(id_ == "", "missing_id")
        .otherwise(frame_reason(doc)),
    )
    broken = F.col("__bad")
    return flagged.select(
        *rest,
        F.when(broken, "").otherwise(id_).alias("id"),
        F.when(~broken, F.try_variant_get(doc, "$.parent_id", "string")).alias("parent_id"),
        F.when(~broken, route_of(doc)).alias("route"),
        F.when(~broken, text_map(doc, "$.headers")).alias("headers"),
        F.when(~broken, F.to_json(part(doc, "$.payload"))).alias("payload"),
        F.when(broken, "parse_error")
        .when(F.col("reason") == "missing_id", "validation_error")
        .when(F.col("reason").isNotNull(), "runtime_error")
        .alias("outcome"),
        "reason",
    )


def wire_struct(df: DataFrame):
    """Envelope columns as one struct whose absent parts are null."""
    payload = F.col("payload")
    if dict(df.dtypes)["payload"] == "string":
        payload = F.try_parse_json(payload)
    route = F.struct(
        F.col("route.actors").alias("actors"),
        F.col("route.current").alias("current"),
        F.when(F.size("route.metadata") > 0, F.col("route.metadata")).alias("metadata"),
    )
    return F.struct(
        F.col("id").alias("id"),
        F.col("parent_id").alias("parent_id"),
        route.alias("route"),
        F.when(F.size("headers") > 0, F.col("headers")).alias("headers"),
        payload.alias("payload"),
    )


def to_wire(df: DataFrame, col: str = "body") -> DataFrame:
    """Envelopes as JSON bodies; null parent, headers and metadata are left out."""
    return df.select(F.to_json(wire_struct(df)).alias(col))
