"""Status, progress, history, lineage and delivery over ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions.text import normalize_status
from waybill.operators import delivery as D
from waybill.operators import lineage as L
from waybill.operators import status as S
from waybill.operators.scan import ordinal, seq_chunk
from waybill.plans.bindings import UPD_SQL, table, tracked, updates, utc
from waybill.plans.registry import query

FOLD_COLUMNS = (
    "id", "status", "result", "error", "message", "actors", "total_actors", "progress_percent",
    "current_actor_idx", "current_actor_name", "actors_completed", "updated_at",
)


def flat_fold(snap: DataFrame) -> DataFrame:
    return snap.withColumn("actors", F.array_join("actors", ",")).withColumn(
        "updated_at", utc("updated_at")
    ).select(*FOLD_COLUMNS)


@query("status_fold", f"WITH {UPD_SQL} SELECT {', '.join(FOLD_COLUMNS)} FROM fold")
def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state per envelope."""
    upd = updates(spark, sf_dir)
    return flat_fold(S.fold_status(tracked(upd), upd))


@query("progress_monotonic", f"""WITH {UPD_SQL}
SELECT envelope_id, seq, late, n::INTEGER AS n_actors,
       round(max(CASE WHEN late THEN NULL ELSE raw END)
             OVER (PARTITION BY envelope_id ORDER BY seq), 2) AS progress
FROM scored""")
def progress_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress after each update: never falls, never above 100."""
    upd = updates(spark, sf_dir)
    return S.progress(tracked(upd), upd).select(
        "envelope_id", "seq", "late", F.size("route_actors").alias("n_actors"), "progress"
    )


@query("route_asof", f"""WITH {UPD_SQL}
SELECT envelope_id, seq, CASE n WHEN 5 THEN 'ingest,score,review,sign,store'
       ELSE 'ingest,score,store' END AS actors FROM ordered""")
def route_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authoritative route at each update."""
    upd = updates(spark, sf_dir)
    return S.route_asof(tracked(upd), upd).select(
        "envelope_id", "seq", F.array_join("route_actors", ",").alias("actors")
    )


@query("transitions", f"""WITH {UPD_SQL}
SELECT * FROM (
  SELECT envelope_id, seq, lag(status) OVER (PARTITION BY envelope_id ORDER BY seq) AS from_status,
         status AS to_status, ts FROM upd)
WHERE from_status IS NULL OR from_status <> to_status""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes with repeats collapsed."""
    return S.transitions(updates(spark, sf_dir)).withColumn("ts", utc("ts"))


@query("time_in_state", f"""WITH {UPD_SQL}
SELECT envelope_id, seq, status,
       (epoch_us(lead(ts) OVER (PARTITION BY envelope_id ORDER BY seq)) - epoch_us(ts))
         / 1e6::DOUBLE AS seconds
FROM upd""")
def time_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds until the next update of the same envelope."""
    return S.time_in_state(updates(spark, sf_dir)).select(
        "envelope_id", "seq", "status", "seconds"
    )


@query("actor_latency", f"""WITH {UPD_SQL}
SELECT *, (epoch_us(completed_at) - epoch_us(received_at)) / 1e6::DOUBLE AS seconds FROM (
  SELECT envelope_id, idx AS current_actor_idx, min(ts) FILTER (state = 'received') AS received_at,
         max(ts) FILTER (state = 'completed') AS completed_at FROM upd GROUP BY ALL)""")
def actor_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt to completion per actor and envelope."""
    out = S.actor_latency(updates(spark, sf_dir))
    return out.select(
        "envelope_id", "current_actor_idx", utc("received_at").alias("received_at"),
        utc("completed_at").alias("completed_at"), "seconds",
    )


@query("history_since", f"""WITH {UPD_SQL}
SELECT * FROM (
  SELECT envelope_id, seq, message, ts,
         row_number() OVER (PARTITION BY envelope_id ORDER BY ts, seq) AS position FROM upd)
WHERE ts > TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts, seq""")
def history_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update history with positions, later than a time."""
    rows = S.history(updates(spark, sf_dir))
    later = S.updates_since(rows, None, "2024-01-20 00:00:00")
    return later.select("envelope_id", "seq", "message", utc("ts").alias("ts"), "position").orderBy(
        "ts", "seq"
    )


NOW = "2024-01-15 12:00:00"


UPD_SQL_NOW = UPD_SQL.replace("FROM events)", f"FROM events WHERE ts <= TIMESTAMP '{NOW}')")


@query("timeouts_active", f"""WITH {UPD_SQL_NOW}
SELECT id, status, deadline,
       status NOT IN ('succeeded', 'failed') AND TIMESTAMP '{NOW}' <= deadline AS active,
       CASE WHEN status NOT IN ('succeeded', 'failed') AND TIMESTAMP '{NOW}' > deadline
            THEN 'envelope timed out' END AS timeout_error
FROM fold JOIN env ON env.envelope_id = fold.id""")
def timeouts_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open envelopes before and after their deadline at a given time."""
    now = F.lit(NOW).cast("timestamp")
    upd = updates(spark, sf_dir).filter(F.col("ts") <= now)
    snap = S.fold_status(tracked(upd), upd)
    state = F.col("status"), F.col("deadline"), now
    return snap.select(
        "id", "status", utc("deadline").alias("deadline"), S.is_active(*state).alias("active"),
        F.when(S.is_due(*state), F.lit(S.TIMED_OUT)).alias("timeout_error"),
    )


@query("timeout_updates", f"""WITH {UPD_SQL_NOW}, closing AS (
  SELECT fold.*, deadline, status NOT IN ('succeeded', 'failed') AND deadline < TIMESTAMP '{NOW}' AS due
  FROM fold JOIN env ON env.envelope_id = fold.id)
SELECT id, CASE WHEN due THEN 'failed' ELSE status END AS status, result,
       CASE WHEN due THEN 'envelope timed out' ELSE error END AS error, message, actors,
       CASE WHEN due THEN 100.0::DOUBLE ELSE progress_percent END AS progress_percent,
       CASE WHEN due THEN greatest(deadline, updated_at) ELSE updated_at END AS updated_at
FROM closing""")
def timeout_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its timeouts appended, folded again."""
    now = F.lit(NOW).cast("timestamp")
    upd = updates(spark, sf_dir).filter(F.col("ts") <= now)
    made = S.timeouts(S.fold_status(tracked(upd), upd), now)
    snap = S.fold_status(tracked(upd), upd.unionByName(made.select(*upd.columns)))
    return snap.select(
        "id", "status", "result", "error", "message", F.array_join("actors", ",").alias("actors"),
        "progress_percent", utc("updated_at").alias("updated_at"),
    )


@query("completion_counts", f"""WITH {UPD_SQL}, c AS (
  SELECT envelope_id, count(DISTINCT idx) FILTER (state = 'completed') AS done,
         max(n_actors)::INTEGER AS total FROM upd GROUP BY ALL)
SELECT status, done AS actors_completed, total AS total_actors, count(*) AS n
FROM c JOIN fold ON fold.id = c.envelope_id GROUP BY ALL""")
def completion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes by status, actors completed and route length."""
    upd = updates(spark, sf_dir)
    done = S.completion(upd).withColumnRenamed("envelope_id", "id")
    snap = S.fold_status(tracked(upd), upd).select("id", "status")
    return done.join(snap, "id").groupBy("status", "actors_completed", "total_actors").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("status_counts", f"WITH {UPD_SQL} SELECT status, count(*) AS n FROM fold GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    upd = updates(spark, sf_dir)
    return S.status_counts(S.fold_status(tracked(upd), upd))


KNOWN_USERS = "user_id < 100"


@query("orphan_updates", f"""WITH {UPD_SQL}
SELECT envelope_id, seq, message FROM upd
WHERE envelope_id NOT IN (
  SELECT DISTINCT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) FROM events WHERE {KNOWN_USERS})""")
def orphan_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that name an unknown envelope."""
    upd = updates(spark, sf_dir)
    known = tracked(upd).filter(F.split("id", "-")[0].cast("bigint") < 100)
    return S.orphan_updates(known, upd).select("envelope_id", "seq", "message")


@query("applied_updates", f"""WITH {UPD_SQL}
SELECT envelope_id, count(*) AS n FROM upd
WHERE CAST(split_part(envelope_id, '-', 1) AS BIGINT) < 100 GROUP BY ALL""")
def applied_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of known envelopes, counted."""
    upd = updates(spark, sf_dir)
    known = tracked(upd).filter(F.split("id", "-")[0].cast("bigint") < 100)
    return S.apply_updates(known, upd).groupBy("envelope_id").agg(F.count(F.lit(1)).alias("n"))


@query("duplicates", """
WITH n AS (
  SELECT 'u' || user_id || '-' || event_type AS id, event_id AS seq FROM events
), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM n)
SELECT id, seq, CASE WHEN rn = 1 AND NOT (id LIKE 'u1%-view') THEN 'accepted' ELSE 'rejected' END
  AS verdict FROM f""")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creations refused because the id exists, in the store or earlier in the batch."""
    new = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id"), F.lit("-"), F.col("event_type")).alias("id"),
        F.col("event_id").alias("seq"),
    )
    stored = new.filter(F.col("id").like("u1%-view"))
    accepted, rejected = L.reject_duplicates(new, stored, "seq", seq_chunk("seq"))
    return accepted.withColumn("verdict", F.lit("accepted")).unionByName(
        rejected.withColumn("verdict", F.lit("rejected"))
    )


LINE_ORDER = (
    "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def fanned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parents, their lines as fan-out children numbered from 1."""
    lines = table(spark, sf_dir, "lineitem")
    # parts are spread over their key range, so a hot order is cut along l_partkey
    chunk = F.floor(F.col("l_partkey") / 65536).cast("bigint")
    numbered = ordinal(lines, ["l_orderkey"], list(LINE_ORDER), chunk, "n")
    parent = F.concat(F.lit("o-"), F.col("l_orderkey"))
    children = numbered.select(
        F.concat(parent, F.lit("-"), F.col("n")).alias("id"),
        parent.alias("parent_id"),
        F.col("l_quantity").alias("amount"),
    )
    parents = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o-"), F.col("o_orderkey")).alias("id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.col("o_totalprice").alias("amount"),
    )
    return parents.unionByName(children)


FAN_SQL = f"""
child AS (
  SELECT 'o-' || l_orderkey || '-' || row_number() OVER (
           PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS id,
         'o-' || l_orderkey AS parent_id, l_quantity AS amount
  FROM lineitem
), parent AS (SELECT 'o-' || o_orderkey AS id, o_totalprice AS amount FROM orders)
"""


@query("lineage_children", f"""WITH {FAN_SQL}
SELECT child.id, child.parent_id, child.amount, parent.amount AS parent_amount
FROM child JOIN parent ON parent.id = child.parent_id""")
def lineage_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children next to their parents."""
    return L.children(fanned_orders(spark, sf_dir)).select(
        "id", "parent_id", "amount", F.col("parent.amount").alias("parent_amount")
    )


@query("lineage_family", """
WITH RECURSIVE line AS (
  SELECT event_id, CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id - 1 END AS parent FROM events
), f AS (
  SELECT event_id, event_id AS root, 0::BIGINT AS depth FROM line WHERE parent IS NULL
  UNION ALL
  SELECT line.event_id, f.root, f.depth + 1 FROM line JOIN f ON line.parent = f.event_id
)
SELECT 'e' || event_id AS id, 'e' || root AS root, depth FROM f""")
def lineage_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth over chains of fan-outs."""
    n = F.col("event_id")
    chain = table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), n).alias("id"),
        F.when(n % 8 != 0, F.concat(F.lit("e"), n - 1)).alias("parent_id"),
    )
    return L.family(chain)


@query("order_fanout_width", f"""WITH {FAN_SQL}
SELECT origin, count(*) AS width FROM (
  SELECT parent_id AS origin FROM child UNION ALL SELECT id FROM parent) GROUP BY ALL""")
def order_fanout_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per fanned-out order, the parent included."""
    return L.fanout_width(fanned_orders(spark, sf_dir))


CUTOFF = "2024-01-20 00:00:00"


@query("retention", f"""WITH {UPD_SQL}
SELECT envelope_id, seq FROM upd WHERE NOT (ts < TIMESTAMP '{CUTOFF}' AND EXISTS (
  SELECT 1 FROM fold WHERE fold.id = upd.envelope_id AND status IN ('succeeded', 'failed')
    AND fold.updated_at < TIMESTAMP '{CUTOFF}'))""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log after dropping the old updates of envelopes that ended."""
    upd = updates(spark, sf_dir)
    snap = S.fold_status(tracked(upd), upd)
    return S.retain(upd, snap, CUTOFF).select("envelope_id", "seq")


@query("cascade_delete", f"""WITH {UPD_SQL}
SELECT envelope_id, seq FROM upd
WHERE envelope_id NOT IN (SELECT id FROM fold WHERE status = 'failed')""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log after deleting the failed envelopes."""
    upd = updates(spark, sf_dir)
    gone = S.fold_status(tracked(upd), upd).filter("status = 'failed'")
    return S.cascade_delete(upd, gone).select("envelope_id", "seq")


@query("recent", f"""WITH {UPD_SQL}
SELECT id, status, updated_at FROM fold ORDER BY updated_at DESC, id LIMIT 50""")
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest envelopes."""
    upd = updates(spark, sf_dir)
    snap = S.fold_status(tracked(upd), upd)
    return S.recent(snap, 50).select("id", "status", utc("updated_at").alias("updated_at"))


@query("due_soon", f"""WITH {UPD_SQL}
SELECT envelope_id AS id, deadline FROM env JOIN fold ON fold.id = env.envelope_id
WHERE status NOT IN ('succeeded', 'failed') ORDER BY deadline, 1 LIMIT 50""")
def due_soon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open envelopes with the nearest deadlines."""
    upd = updates(spark, sf_dir)
    snap = S.fold_status(tracked(upd), upd).filter(~S.is_final(F.col("status")))
    return S.due_soon(snap, 50).select("id", utc("deadline").alias("deadline"))


@query("normalize_status", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'pending' END AS status
FROM orders""")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses in lower case; unknown ones become null."""
    code = F.col("o_orderstatus")
    told = F.when(code == "F", "Succeeded").when(code == "O", "PENDING").otherwise("Parked")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", normalize_status(told).alias("status")
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a user as one delivery; errors are nacked."""
    outcome = F.when(F.col("event_type") == "error", "nack").otherwise("ack")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("id"), F.col("event_id").alias("seq"),
        outcome.alias("outcome"),
    )


@query("attempts_redrive", """
SELECT 'u' || user_id AS id, event_id AS seq,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt,
       CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 3
            THEN 'dead-letter' ELSE 'queue' END AS target
FROM events WHERE event_type = 'error'""")
def attempts_redrive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt numbers of nacked deliveries and where each goes."""
    nacked = deliveries(spark, sf_dir).filter(F.col("outcome") == "nack")
    return D.redrive(D.attempts(nacked)).select("id", "seq", "attempt", "target")


@query("redeliverable", """
SELECT id, attempts FROM (
  SELECT 'u' || user_id AS id, count(*) AS attempts, arg_max(event_type, event_id) AS last_type
  FROM events GROUP BY ALL) WHERE last_type = 'error'""")
def redeliverable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose last delivery was nacked."""
    return D.redeliverable(D.attempts(deliveries(spark, sf_dir)))


@query("dedup", """
SELECT DISTINCT 'u' || user_id AS id, event_type AS hop FROM events""")
def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (id, hop)."""
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("id"), F.col("event_type").alias("hop")
    )
    return D.dedup(rows)
