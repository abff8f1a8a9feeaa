"""Tracking: fold the append-only update log into state, progress and history.

Updates are applied per envelope in ``seq`` order. A final status absorbs what
follows: later rows stay in the history, flagged ``late``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.route import actor_name
from waybill.functions.text import deadline, is_final, progress_weight
from waybill.operators.scan import (
    SEQ_CHUNK,
    Running,
    ordinal,
    running,
    seq_chunk,
    time_chunk,
)
from waybill.schema import UPDATE

ID = "envelope_id"
CREATED_SEQ = -1


# what a snapshot row knows beyond a stored envelope
_CARRIED = {"progress_percent": "__base", "current_actor_name": "__name",
            "completed": "__completed", "n_updates": "__count", "last_seq": "__seq"}


# what the fold hands on as it is stored
_FRAME = ("parent_id", "payload", "timeout_sec", "deadline", "created_at")


def _frame(envs: DataFrame) -> list[str]:
    return [c for c in _FRAME if c in envs.columns]


def _created(envs: DataFrame, like: DataFrame) -> DataFrame:
    """First row of each log: the stored route, and the state reached so far if any."""
    born = F.coalesce("updated_at", "created_at") if "updated_at" in envs.columns else "created_at"
    known = {ID: "id", "seq": F.lit(CREATED_SEQ), "actors": "actors", "ts": born}
    for name in ("status", "result", "error", "message", "current_actor_idx"):
        if name in envs.columns:
            known[name] = name
    cells = []
    for field in like.schema.fields:
        value = known.get(field.name, F.lit(None))
        value = F.col(value) if isinstance(value, str) else value
        cells.append(value.cast(field.dataType).alias(field.name))
    kinds = {"__base": "double", "__name": "string", "__completed": "array<int>",
             "__count": "bigint", "__seq": "bigint"}
    cells += [
        (F.col(c) if c in envs.columns else F.lit(None)).cast(kinds[n]).alias(n)
        for c, n in _CARRIED.items()
    ]
    frame = F.struct(F.lit(True).alias("made"), *_frame(envs)).alias("__frame")
    return envs.select(*cells, F.lit(True).alias("__made"), frame)


def apply_order(envs: DataFrame, upd: DataFrame, chunk_rows: int = SEQ_CHUNK) -> DataFrame:
    """Updates with what the log before them says.

    Adds ``late`` (an earlier row was final), ``known`` (the envelope exists),
    ``route_actors`` (longest route so far, first one on ties) and ``raw`` (the
    progress this row alone stands for). One pass carries creation rows and
    updates together, so the stored route needs no join.
    """
    log = upd.withColumn("__made", F.lit(False)).unionByName(
        _created(envs, upd), allowMissingColumns=True
    )
    actors = F.col("actors")
    length = F.coalesce(F.when(actors.isNull(), 0).otherwise(F.size(actors)), F.lit(0))
    chunk = seq_chunk("seq", chunk_rows)
    rows = running(
        log.withColumn("__chunk", chunk),
        [ID],
        ["seq"],
        chunk,
        __final=Running("max", is_final(F.col("status")).cast("int"), before=True),
        __known=Running("max", F.col("__made").cast("int")),
        __route=Running(
            "max",
            F.when(length > 0, F.struct(length.alias("n"), (-F.col("seq")).alias("at"),
                                        actors.alias("actors"))),
        ),
    )
    n = F.coalesce(F.col("__route.n"), F.lit(0))
    idx = F.col("current_actor_idx").cast("double")
    part = F.when(n > 0, (idx * 100 + progress_weight(F.col("envelope_state"))) / n)
    raw = (
        F.when(is_final(F.col("status")), 100.0)
        .when(F.col("__made"), F.coalesce("__base", F.lit(0.0)))
        .otherwise(F.least(F.coalesce(part, F.lit(0.0)), F.lit(100.0)))
    )
    return rows.select(
        *upd.columns,
        "__chunk",
        "__made",
        "__frame",
        *_CARRIED.values(),
        (F.coalesce("__final", F.lit(0)) == 1).alias("late"),
        (F.coalesce("__known", F.lit(0)) == 1).alias("known"),
        F.col("__route.actors").alias("route_actors"),
        raw.alias("raw"),
    )


def progress(envs: DataFrame, upd: DataFrame, chunk_rows: int = SEQ_CHUNK) -> DataFrame:
    """Monotonic progress after every update of a known envelope."""
    # creation rows take part: on resume they hold the progress reached before
    ordered = apply_order(envs, upd, chunk_rows).filter("known")
    applied = F.when(~F.col("late"), F.col("raw"))
    rows = running(ordered, [ID], ["seq"], F.col("__chunk"), progress=Running("max", applied))
    rows = rows.filter(~F.col("__made"))
    extra = ("__chunk", "__made", "__frame", "known", "raw", *_CARRIED.values())
    return rows.drop(*extra).withColumn(
        "progress", F.round(F.coalesce("progress", F.lit(0.0)), 2)
    )


def route_asof(envs: DataFrame, upd: DataFrame, chunk_rows: int = SEQ_CHUNK) -> DataFrame:
    """Authoritative route at every update."""
    rows = apply_order(envs, upd, chunk_rows)
    return rows.filter(~F.col("__made")).select(ID, "seq", "route_actors")


def _last(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))


def _text(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def fold_status(envs: DataFrame, upd: DataFrame, chunk_rows: int = SEQ_CHUNK) -> DataFrame:
    """Current state of every known envelope, one row per id.

    ``envs`` are stored envelopes, or an earlier result of this fold with new
    envelopes added: then only the updates since are read. The fold is a plain
    aggregation (combined on the map side), so a hot envelope costs its reducer
    no more than one row per map task. What is stored with an envelope travels in
    its first row, so the envelopes are not joined again.
    """
    log = apply_order(envs, upd, chunk_rows).filter(~F.col("late"))
    made = F.col("__made")
    idx = F.col("current_actor_idx")
    before = lambda c: F.max(F.when(made, F.col(c)))
    none = F.array().cast("array<int>")
    state = log.groupBy(ID).agg(
        F.max(F.col("known")).alias("known"),
        F.max_by("__frame", F.when(made, F.lit(1))).alias("frame"),
        _last(F.col("status")).alias("status"),
        _last(F.col("result")).alias("result"),
        _last(_text("error")).alias("error"),
        _last(_text("message")).alias("message"),
        _last(idx).alias("current_actor_idx"),
        F.coalesce(
            _last(actor_name(F.col("route_actors"), F.when(~made, idx))), before("__name")
        ).alias("current_actor_name"),
        _last(F.col("route_actors")).alias("route_actors"),
        F.max("raw").alias("progress"),
        F.max("ts").alias("updated_at"),
        (F.coalesce(before("__count"), F.lit(0)) + F.count(F.when(~made, 1))).alias("n_updates"),
        F.greatest(before("__seq"), F.max(F.when(~made, F.col("seq")))).alias("last_seq"),
        F.array_sort(
            F.array_union(
                F.coalesce(before("__completed"), none),
                # actor positions: no more than the route is long
                F.collect_set(F.when(F.col("envelope_state") == "completed", idx)),
            )
        ).alias("completed"),
    )
    folded = state.filter("known")
    total = F.when(F.col("route_actors").isNull(), 0).otherwise(F.size("route_actors"))
    return folded.select(
        F.col(ID).alias("id"),
        *[F.col(f"frame.{c}").alias(c) for c in _frame(envs)],
        F.coalesce("status", F.lit("pending")).alias("status"),
        "result",
        "error",
        "message",
        F.col("route_actors").alias("actors"),
        F.round(F.coalesce("progress", F.lit(0.0)), 2).alias("progress_percent"),
        "current_actor_idx",
        "current_actor_name",
        F.size("completed").alias("actors_completed"),
        total.alias("total_actors"),
        "updated_at",
        "n_updates",
        "completed",
        "last_seq",
    )


# fixed value: the error of an envelope that passed its deadline
TIMED_OUT = "envelope timed out"


def is_due(status: Column, due: Column, now: Column) -> Column:
    """Open and past its deadline."""
    return ~is_final(status) & F.coalesce(due < now, F.lit(False))


def expire(snap: DataFrame, now: Column) -> DataFrame:
    """Snapshot whose open envelopes past their deadline have failed."""
    over = is_due(F.col("status"), F.col("deadline"), now)
    changed = {
        "error": F.lit(TIMED_OUT),
        "progress_percent": F.lit(100.0),
        "updated_at": F.greatest("deadline", "updated_at"),
        "status": F.lit("failed"),
    }
    marked = snap.withColumn("__over", over)
    for name, value in changed.items():
        marked = marked.withColumn(name, F.when(F.col("__over"), value).otherwise(F.col(name)))
    return marked.drop("__over")


def is_active(status: Column, due: Column, now: Column) -> Column:
    """Not final and not past its deadline."""
    return ~is_final(status) & (due.isNull() | (now <= due))


def timeouts(snap: DataFrame, now: Column) -> DataFrame:
    """Updates that fail every open envelope past its deadline, to be appended to the log.

    Each follows the last update of its envelope: the fold of the log with these rows is the
    expired fold of the log. The message stays, as a timeout has none of its own.
    """
    due = snap.filter(is_due(F.col("status"), F.col("deadline"), now))
    values = {
        ID: F.col("id"),
        "seq": F.greatest(F.coalesce("last_seq", F.lit(CREATED_SEQ)), F.lit(CREATED_SEQ)) + 1,
        "status": F.lit("failed"),
        "error": F.lit(TIMED_OUT),
        "ts": F.greatest("deadline", "updated_at"),
    }
    return due.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in UPDATE.fields])


def with_deadline(envs: DataFrame) -> DataFrame:
    return envs.withColumn("deadline", deadline(F.col("created_at"), F.col("timeout_sec")))


def orphan_updates(envs: DataFrame, upd: DataFrame) -> DataFrame:
    """Updates that name no known envelope."""
    return upd.join(envs.select(F.col("id").alias(ID)), ID, "left_anti")


def apply_updates(envs: DataFrame, upd: DataFrame) -> DataFrame:
    """Updates of known envelopes."""
    return upd.join(envs.select(F.col("id").alias(ID)), ID, "left_semi")


def status_counts(snap: DataFrame) -> DataFrame:
    return snap.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def completion(upd: DataFrame) -> DataFrame:
    """Actors completed and longest route per envelope.

    Distinct indices are found on the map side before the per-envelope count.
    """
    done = F.when(F.col("envelope_state") == "completed", F.col("current_actor_idx"))
    size = F.when(F.col("actors").isNotNull(), F.size("actors"))
    return (
        upd.groupBy(ID, done.alias("idx"))
        .agg(F.max(size).alias("size"))
        .groupBy(ID)
        .agg(F.count("idx").alias("actors_completed"),
             F.coalesce(F.max("size"), F.lit(0)).alias("total_actors"))
    )


def transitions(upd: DataFrame, chunk_rows: int = SEQ_CHUNK) -> DataFrame:
    """Rows where the status differs from the one before."""
    rows = running(
        upd, [ID], ["seq"], seq_chunk("seq", chunk_rows),
        from_status=Running("last", F.col("status"), before=True),
    )
    changed = F.col("from_status").isNull() | (F.col("from_status") != F.col("status"))
    return rows.filter(changed).select(
        ID, "seq", "from_status", F.col("status").alias("to_status"), "ts"
    )


def time_in_state(upd: DataFrame, chunk_rows: int = SEQ_CHUNK) -> DataFrame:
    """How long each update's state lasted; null for the last one."""
    rows = running(
        upd, [ID], ["seq"], seq_chunk("seq", chunk_rows), backwards=True,
        until=Running("last", F.col("ts"), before=True),
    )
    micros = F.unix_micros("until") - F.unix_micros("ts")
    return rows.withColumn("seconds", micros / F.lit(1e6))


def actor_latency(upd: DataFrame) -> DataFrame:
    """First receipt to last completion of every actor of every envelope."""
    at = lambda state: F.when(F.col("envelope_state") == state, F.col("ts"))
    return (
        upd.groupBy(ID, "current_actor_idx")
        .agg(F.min(at("received")).alias("received_at"), F.max(at("completed")).alias("completed_at"))
        .withColumn(
            "seconds",
            (F.unix_micros("completed_at") - F.unix_micros("received_at")) / F.lit(1e6),
        )
    )


def history(upd: DataFrame, chunk_seconds: int = 60) -> DataFrame:
    """Updates with their position in the log of their envelope."""
    return ordinal(upd, [ID], ["ts", "seq"], time_chunk("ts", chunk_seconds), "position")


def updates_since(upd: DataFrame, id_: str | None, since) -> DataFrame:
    """Updates strictly after a time, of one envelope or of all."""
    since = F.lit(since).cast("timestamp") if not isinstance(since, Column) else since
    later = upd.filter(F.col("ts") > since)
    return later if id_ is None else later.filter(F.col(ID) == id_)


def retain(upd: DataFrame, snap: DataFrame, cutoff) -> DataFrame:
    """Log without the old updates of envelopes that ended before the cutoff."""
    cutoff = F.lit(cutoff).cast("timestamp") if not isinstance(cutoff, Column) else cutoff
    closed = snap.filter(is_final(F.col("status")) & (F.col("updated_at") < cutoff))
    ids = closed.select(F.col("id").alias("__id"))
    return upd.join(ids, (F.col(ID) == F.col("__id")) & (F.col("ts") < cutoff), "left_anti")


def cascade_delete(upd: DataFrame, deleted: DataFrame) -> DataFrame:
    """Log without the updates of deleted envelopes."""
    return upd.join(deleted.select(F.col("id").alias(ID)), ID, "left_anti")


def recent(snap: DataFrame, n: int, by: str = "updated_at", tie: str = "id") -> DataFrame:
    return snap.orderBy(F.col(by).desc(), F.col(tie)).limit(n)


def due_soon(snap: DataFrame, n: int) -> DataFrame:
    """Envelopes with the nearest deadlines."""
    return snap.filter(F.col("deadline").isNotNull()).orderBy("deadline", "id").limit(n)
