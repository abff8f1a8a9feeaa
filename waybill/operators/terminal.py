"""Error envelopes, final reports and the union of both terminals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.route import current_actor
from waybill.functions.text import to_rfc3339
from waybill.schema import ERROR_END, HAPPY_END


def error_payload(error: Column, details: Column, original: Column) -> Column:
    """JSON payload of an error envelope; absent parts are left out."""
    return F.to_json(
        F.struct(
            error.alias("error"),
            details.alias("details"),
            F.try_parse_json(original).alias("original_payload"),
        )
    )


def to_error(done: DataFrame) -> DataFrame:
    """Error rows as error envelopes that wrap the original payload.

    Id, parent and route are kept; rows that never parsed have an empty id, the
    route ``['error-end']`` and no original payload.
    """
    text = F.col("payload")
    if dict(done.dtypes)["payload"] != "string":
        text = F.to_json("payload")
    return done.withColumn(
        "payload",
        F.when(
            F.col("terminal") == ERROR_END, error_payload(F.col("error"), F.col("details"), text)
        ).otherwise(text),
    )


def terminal_union(happy: DataFrame, error: DataFrame) -> DataFrame:
    """Success and error results as one table."""
    return happy.withColumn("terminal", F.lit(HAPPY_END)).unionByName(
        error.withColumn("terminal", F.lit(ERROR_END)), allowMissingColumns=True
    )


def terminal_result(done: DataFrame, returned: str = "returned") -> DataFrame:
    """Result of a terminal: what its handler returned, else the original payload."""
    result = F.col("payload")
    if returned in done.columns:
        result = F.coalesce(F.col(returned), result)
    return done.withColumn("result", result)


def final_report(done: DataFrame, at: Column | None = None) -> DataFrame:
    """One final status row per terminal envelope."""
    ok = F.col("terminal") == HAPPY_END
    route = F.col("route")
    located = ~ok & (F.size(route["actors"]) > 0)
    failed_actor = F.when(located & (current_actor(route) != ""), current_actor(route))
    columns = [
        "id",
        "parent_id",
        F.when(ok, "succeeded").otherwise("failed").alias("status"),
        F.when(ok, F.lit(1.0)).alias("progress"),
        F.when(ok, F.col("payload")).alias("result"),
        F.when(~ok, F.col("error")).alias("error"),
        F.when(~ok, F.col("details")).alias("details"),
        F.when(located, route["actors"]).alias("actors"),
        F.when(located, route["current"]).alias("failed_actor_idx"),
        failed_actor.alias("failed_actor"),
    ]
    if "stored_at" in done.columns:
        columns.append("stored_at")
    if at is not None:
        columns.append(to_rfc3339(at).alias("timestamp"))
    return done.select(*columns)


def final_message(report: DataFrame) -> DataFrame:
    """Report with its message and, for failures with details, an error info struct."""
    stored = F.col("stored_at") if "stored_at" in report.columns else F.lit(None).cast("string")
    done = F.lit("Envelope completed successfully")
    success = F.when(
        stored.isNotNull(), F.concat(done, F.lit(", results stored at "), stored)
    ).otherwise(done)
    error = F.coalesce("error", F.lit(""))
    failure = (
        F.when(error == "", F.lit("Envelope failed"))
        .when(
            F.col("failed_actor").isNotNull(),
            F.format_string("Envelope failed at actor '%s': %s", F.col("failed_actor"), error),
        )
        .otherwise(F.concat(F.lit("Envelope failed: "), error))
    )
    ok = F.col("status") == "succeeded"
    info = F.when(
        ~ok & F.col("details").isNotNull(),
        F.struct(
            "error",
            "details",
            "failed_actor",
            "failed_actor_idx",
            F.col("actors").alias("route"),
        ),
    )
    return report.withColumn("message", F.when(ok, success).otherwise(failure)).withColumn(
        "error_info", info
    )


def as_updates(report: DataFrame, seq: Column, ts: Column) -> DataFrame:
    """Final reports as rows of the update log (progress 100 for both outcomes)."""
    told = final_message(report)
    return told.select(
        F.col("id").alias("envelope_id"),
        seq.cast("bigint").alias("seq"),
        "status",
        "message",
        F.coalesce(F.to_json("error_info"), F.col("result")).alias("result"),
        "error",
        "actors",
        F.col("failed_actor_idx").alias("current_actor_idx"),
        F.lit(None).cast("string").alias("envelope_state"),
        ts.alias("ts"),
    )
