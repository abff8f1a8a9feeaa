"""Message texts, keys, names and time values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.schema import FINAL_STATUSES, STATUSES

RFC3339 = "yyyy-MM-dd'T'HH:mm:ssXXX"
KEY_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def object_key(prefix: str, ts: Column, actor: Column, id_: Column) -> Column:
    """Key a terminal row is stored under."""
    return F.concat(
        F.lit(prefix), F.date_format(ts, KEY_TIME), F.lit("/"), actor, F.lit("/"), id_, F.lit(".json")
    )


def size_kb_message(size: Column) -> Column:
    # ties go to the even digit
    kb = F.bround(size / F.lit(1024.0), 2)
    return F.format_string("Received message (%.2f KB)", kb)


def duration_message(ms: Column) -> Column:
    return F.format_string("Completed processing in %dms", ms)


def processing_message(actor: Column) -> Column:
    return F.concat(F.lit("Processing in "), actor)


def metric_name(name: Column) -> Column:
    """Letters, digits, '_' and ':' only, never a digit in front."""
    clean = F.regexp_replace(name, "[^a-zA-Z0-9_:]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def deadline(created: Column, timeout_sec: Column) -> Column:
    """Null when there is no positive timeout."""
    return F.when(timeout_sec > 0, created + F.make_dt_interval(secs=timeout_sec))


def to_rfc3339(ts: Column) -> Column:
    return F.date_format(ts, RFC3339)


def from_rfc3339(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(RFC3339))


def progress_weight(state: Column) -> Column:
    return (
        F.when(state == "received", 10.0)
        .when(state == "processing", 50.0)
        .when(state == "completed", 100.0)
        .otherwise(0.0)
    )


def normalize_status(status: Column) -> Column:
    """Lower case; anything outside the status domain becomes null."""
    lowered = F.lower(status)
    return F.when(lowered.isin(*STATUSES), lowered)


def is_final(status: Column) -> Column:
    return F.coalesce(status.isin(*FINAL_STATUSES), F.lit(False))


def error_text(error: Column, details: Column) -> Column:
    """``error: message``, without the colon when there is no message."""
    return F.concat_ws(": ", error, details["message"])
