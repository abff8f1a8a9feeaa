"""Column layouts shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

HAPPY_END = "happy-end"
ERROR_END = "error-end"

# Status domain of the tracking tables.
STATUSES = ("pending", "running", "succeeded", "failed", "unknown")
FINAL_STATUSES = ("succeeded", "failed")

STRING_MAP = T.MapType(T.StringType(), T.StringType())

ROUTE = T.StructType(
    [
        T.StructField("actors", T.ArrayType(T.StringType())),
        T.StructField("current", T.IntegerType()),
        T.StructField("metadata", STRING_MAP),
    ]
)

DETAILS = T.StructType(
    [
        T.StructField("message", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("traceback", T.StringType()),
    ]
)

# The frame is fixed. The payload is JSON text here; a pipeline with a known
# payload may put a struct in its place.
ENVELOPE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("route", ROUTE),
        T.StructField("headers", STRING_MAP),
        T.StructField("payload", T.StringType()),
    ]
)

TRACE_ENTRY = T.StructType(
    [
        T.StructField("hop", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("actor", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("message_type", T.StringType()),
        T.StructField("dest", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("n_outputs", T.IntegerType()),
        T.StructField("size_in", T.LongType()),
        T.StructField("size_out", T.LongType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("duration_s", T.DoubleType()),
        # when the row was put on this actor's queue
        T.StructField("enqueued_at", T.TimestampType()),
    ]
)

UPDATE = T.StructType(
    [
        T.StructField("envelope_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("actors", T.ArrayType(T.StringType())),
        T.StructField("current_actor_idx", T.IntegerType()),
        T.StructField("envelope_state", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
