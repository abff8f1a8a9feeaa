"""Operational reports over the hop log read from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions.text import metric_name
from waybill.functions.route import make_route
from waybill.operators import metrics as M
from waybill.operators.actors import Registry
from waybill.operators.hops import run
from waybill.plans.bindings import HOP_SQL, docs, hops, names, table, typed_docs, utc
from waybill.plans.registry import query
from waybill.plans.routing import ROUTES_SQL, native_registry

FAILED_SQL = "(" + ", ".join(f"'{f}'" for f in M.FAILED) + ")"


@query("counters", f"""WITH {HOP_SQL}
SELECT 'received' AS metric, queue AS label, transport AS detail, count(*) AS n
FROM hop WHERE pos = 0 GROUP BY ALL
UNION ALL SELECT 'processed', queue, outcome, count(*) FROM hop
WHERE pos = 0 AND outcome IN ('success', 'empty_response', 'end_consumed') GROUP BY ALL
UNION ALL SELECT 'sent', dest, message_type, count(*) FROM hop
WHERE message_type IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'failed', queue, outcome, count(*) FROM hop
WHERE pos = 0 AND outcome IN {FAILED_SQL} GROUP BY ALL
UNION ALL SELECT 'runtime_errors', queue, error_type, count(*) FROM hop
WHERE pos = 0 AND error_type = 'execution_error' GROUP BY ALL""")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five counters."""
    return M.counters(hops(spark, sf_dir))


@query("received_counter", f"""WITH {HOP_SQL}
SELECT queue, transport, count(*) AS n FROM hop WHERE pos = 0 GROUP BY ALL""")
def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.received(hops(spark, sf_dir))


@query("processed_counter", f"""WITH {HOP_SQL}
SELECT queue, outcome AS status, count(*) AS n FROM hop
WHERE pos = 0 AND outcome IN ('success', 'empty_response', 'end_consumed') GROUP BY ALL""")
def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.processed(hops(spark, sf_dir))


@query("sent_counter", f"""WITH {HOP_SQL}
SELECT dest, message_type, count(*) AS n FROM hop WHERE message_type IS NOT NULL GROUP BY ALL""")
def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sent(hops(spark, sf_dir))


@query("failed_counter", f"""WITH {HOP_SQL}
SELECT queue, outcome AS reason, count(*) AS n FROM hop
WHERE pos = 0 AND outcome IN {FAILED_SQL} GROUP BY ALL""")
def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.failed(hops(spark, sf_dir))


@query("runtime_error_counter", f"""WITH {HOP_SQL}
SELECT queue, error_type, count(*) AS n FROM hop
WHERE pos = 0 AND error_type = 'execution_error' GROUP BY ALL""")
def runtime_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.runtime_errors(hops(spark, sf_dir))


def _histogram_sql(value: str, buckets: tuple[float, ...], total: str) -> str:
    rows = [
        f"SELECT queue, '{b:g}' AS le, count(*) FILTER ({value} <= {b!r}::DOUBLE) AS n, "
        f"{total} AS sum, count(*) AS count FROM hop GROUP BY queue"
        for b in buckets
    ]
    rows.append(
        f"SELECT queue, '+Inf' AS le, count(*) AS n, {total} AS sum, count(*) AS count "
        "FROM hop GROUP BY queue"
    )
    return f"WITH {HOP_SQL} " + " UNION ALL ".join(rows)


@query("duration_histogram",
       _histogram_sql("duration_s", M.DURATION_BUCKETS, "round(sum(duration_s), 3)"))
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative processing-time buckets per queue."""
    hist = M.histogram(hops(spark, sf_dir), "duration_s", ["queue"])
    return hist.withColumn("sum", F.round("sum", 3))


@query("receive_histogram",
       _histogram_sql("duration_s", M.RECEIVE_BUCKETS, "round(sum(duration_s), 3)"))
def receive_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the receive buckets."""
    hist = M.histogram(hops(spark, sf_dir), "duration_s", ["queue"], M.RECEIVE_BUCKETS)
    return hist.withColumn("sum", F.round("sum", 3))


@query("send_histogram",
       _histogram_sql("duration_s", M.SEND_BUCKETS, "round(sum(duration_s), 3)"))
def send_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the send buckets."""
    hist = M.histogram(hops(spark, sf_dir), "duration_s", ["queue"], M.SEND_BUCKETS)
    return hist.withColumn("sum", F.round("sum", 3))


@query("size_histogram",
       _histogram_sql("size", M.SIZE_BUCKETS, "sum(size)::BIGINT").replace("::DOUBLE", ""))
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative size buckets per queue."""
    return M.size_histogram(hops(spark, sf_dir), "size", ["queue"])


def _counted_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small run of two column actors that logs the sizes of its typed payloads."""
    reg = Registry()
    reg.column_actor("prep", lambda p: p.withField("n_chars", p["n_chars"] * 1000))
    reg.column_actor("tag", lambda p: p.withField("lang", F.upper(p["lang"])))
    env = docs(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        make_route(names("prep", "tag")).alias("route"),
        F.struct("n_chars", "lang").alias("payload"),
    )
    return run(env, reg, max_hops=2, sizes=True)


@query("run_size_histogram", """WITH p AS (
  SELECT strlen('{"n_chars":' || n_chars || ',"lang":"' || lang || '"}') AS raw,
         strlen('{"n_chars":' || n_chars * 1000 || ',"lang":"' || lang || '"}') AS done FROM documents
), s AS (
  SELECT 'prep' AS queue, 'received' AS direction, raw AS size FROM p
  UNION ALL SELECT 'prep', 'sent', done FROM p UNION ALL SELECT 'tag', 'received', done FROM p
  UNION ALL SELECT 'tag', 'sent', done FROM p
)""" + " UNION ALL ".join(
    f"\nSELECT queue, direction, '{le}' AS le, count(*) FILTER ({test}) AS n, sum(size)::BIGINT AS sum, "
    "count(*) AS count FROM s GROUP BY queue, direction"
    for le, test in [*[(f"{b:g}", f"size <= {b!r}") for b in M.SIZE_BUCKETS], ("+Inf", "true")]))
def run_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload sizes of a run, by queue and direction."""
    return M.size_histograms(M.from_run(_counted_run(spark, sf_dir)))


@query("run_queue_depth", f"""WITH {ROUTES_SQL}
SELECT 'prep' AS queue, count(*) AS peak, 0::BIGINT AS waiting, 0::BIGINT AS working FROM d
UNION ALL SELECT DISTINCT 'chunk', 0, 0, 0 FROM d WHERE m = 0
UNION ALL SELECT DISTINCT 'tag', 0, 0, 0 FROM d WHERE m < 2""")
def run_queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of a run's queues: the documents wait since 2024 for the first actor, then for none."""
    base = docs(spark, sf_dir)
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60)
    waiting = base.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("__id"),
                          at.alias("enqueued_at"))
    env = typed_docs(base).join(waiting, F.col("id") == F.col("__id")).drop("__id")
    runs = M.queue_depth_runs(M.from_run(run(env, native_registry(), max_hops=3)), seconds=60)
    last = lambda c: F.max_by(c, "start")
    return runs.groupBy("queue").agg(
        F.max("queued").alias("peak"), last("queued").alias("waiting"),
        last("processing").alias("working"),
    )


@query("inflight_depth", f"""WITH {HOP_SQL}, moves AS (
  SELECT queue, enqueued_at AS t FROM hop UNION ALL SELECT queue, started_at FROM hop
  UNION ALL SELECT queue, ended_at FROM hop
), span AS (
  SELECT queue, ceil(epoch_us(min(t)) / 3600e6)::BIGINT AS lo,
         ceil(epoch_us(max(t)) / 3600e6)::BIGINT AS hi FROM moves GROUP BY ALL
), grid AS (
  SELECT queue, to_timestamp(h * 3600)::TIMESTAMP AS t
  FROM span CROSS JOIN LATERAL (SELECT unnest(generate_series(lo, hi)) AS h)
)
SELECT grid.queue, grid.t AS "at",
       count(*) FILTER (enqueued_at <= t AND started_at > t) AS queued,
       count(*) FILTER (started_at <= t AND ended_at > t) AS processing
FROM grid JOIN hop ON hop.queue = grid.queue GROUP BY ALL""")
def inflight_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting and in-flight rows per queue, every hour."""
    return M.queue_depth(hops(spark, sf_dir)).withColumn("at", utc("at"))


@query("depth_runs", f"""WITH {HOP_SQL}, moves AS (
  SELECT queue, ceil(epoch_us(enqueued_at) / 600e6)::BIGINT AS h, 1 AS q, 0 AS p FROM hop
  UNION ALL SELECT queue, ceil(epoch_us(started_at) / 600e6)::BIGINT, -1, 1 FROM hop
  UNION ALL SELECT queue, ceil(epoch_us(ended_at) / 600e6)::BIGINT, 0, -1 FROM hop
), steps AS (SELECT queue, h, sum(q) AS q, sum(p) AS p FROM moves GROUP BY ALL)
SELECT queue, to_timestamp(h * 600)::TIMESTAMP AS start,
       to_timestamp(lead(h) OVER w * 600)::TIMESTAMP AS "end",
       (sum(q) OVER w)::BIGINT AS queued, (sum(p) OVER w)::BIGINT AS processing
FROM steps WINDOW w AS (PARTITION BY queue ORDER BY h)""")
def depth_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting and in-flight rows per queue, as runs of ten-minute points."""
    out = M.queue_depth_runs(hops(spark, sf_dir), seconds=600)
    return out.select("queue", utc("start").alias("start"), utc("end").alias("end"),
                      "queued", "processing")


@query("active_now", f"""WITH {HOP_SQL}
SELECT queue, count(*) FILTER (started_at <= TIMESTAMP '2024-01-15 12:00:00'
       AND ended_at > TIMESTAMP '2024-01-15 12:00:00') AS active FROM hop GROUP BY ALL""")
def active_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-flight rows at one time."""
    return M.active_at(hops(spark, sf_dir), F.lit("2024-01-15 12:00:00").cast("timestamp"))


@query("capacity", f"""WITH {HOP_SQL}, moves AS (
  SELECT queue, enqueued_at AS t FROM hop UNION ALL SELECT queue, started_at FROM hop
  UNION ALL SELECT queue, ended_at FROM hop
), span AS (
  SELECT queue, ceil(epoch_us(min(t)) / 3600e6)::BIGINT AS lo,
         ceil(epoch_us(max(t)) / 3600e6)::BIGINT AS hi FROM moves GROUP BY ALL
), grid AS (
  SELECT queue, to_timestamp(h * 3600)::TIMESTAMP AS t
  FROM span CROSS JOIN LATERAL (SELECT unnest(generate_series(lo, hi)) AS h)
), depth AS (
  SELECT grid.queue, grid.t,
         count(*) FILTER (enqueued_at <= t AND started_at > t) AS queued,
         count(*) FILTER (started_at <= t AND ended_at > t) AS processing
  FROM grid JOIN hop ON hop.queue = grid.queue GROUP BY ALL
)
SELECT queue, t AS "at", queued, processing,
       least(greatest(ceil((queued + processing) / 5.0)::BIGINT, 1), 8)::BIGINT AS workers
FROM depth""")
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers needed per queue and hour."""
    depth = M.queue_depth(hops(spark, sf_dir))
    return M.capacity(depth, target=5, low=1, high=8).withColumn("at", utc("at"))


@query("custom_metrics", f"""WITH {HOP_SQL}
SELECT 'rows_total' AS metric, queue, NULL::VARCHAR AS le, count(*)::DOUBLE AS value
FROM hop GROUP BY ALL
UNION ALL SELECT 'last_value', queue, NULL, arg_max(value, event_id) FROM hop GROUP BY ALL
""" + "".join(
    f"UNION ALL SELECT '_2_value', queue, '{b:g}', count(*) FILTER (value <= {b!r}::DOUBLE)::DOUBLE "
    "FROM hop GROUP BY ALL\n" for b in (1.0, 10.0, 100.0)
) + "UNION ALL SELECT '_2_value', queue, '+Inf', count(*)::DOUBLE FROM hop GROUP BY ALL")
def custom_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined counter, gauge and histogram."""
    rows = hops(spark, sf_dir)
    specs = (
        M.MetricSpec("rows-total", "counter", ("queue",)),
        M.MetricSpec("last.value", "gauge", ("queue",), "value", "event_id"),
        M.MetricSpec("2 value", "histogram", ("queue",), "value", buckets=(1.0, 10.0, 100.0)),
    )
    out = [M.custom_metric(rows, spec) for spec in specs]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("metric_names", """
SELECT l_orderkey, l_linenumber, count(*) AS n,
       CASE WHEN regexp_matches(name, '^[0-9]') THEN '_' || name ELSE name END AS metric
FROM (SELECT l_orderkey, l_linenumber, regexp_replace(
        CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber || 'x.' || l_returnflag
             ELSE 'line ' || l_returnflag || ':' || l_linestatus || '-a' END,
        '[^a-zA-Z0-9_:]', '_', 'g') AS name FROM lineitem) GROUP BY ALL""")
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric names made valid."""
    n = F.col("l_linenumber")
    raw = F.when(n % 2 == 0, F.concat(n, F.lit("x."), F.col("l_returnflag"))).otherwise(
        F.concat(F.lit("line "), F.col("l_returnflag"), F.lit(":"), F.col("l_linestatus"),
                 F.lit("-a"))
    )
    named = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", metric_name(raw).alias("metric")
    )
    return named.groupBy("l_orderkey", "l_linenumber", "metric").agg(F.count(F.lit(1)).alias("n"))


@query("ratios", f"""WITH {HOP_SQL}
SELECT queue, round(count(*) FILTER (outcome = 'success') / count(*)::DOUBLE, 6) AS success_ratio,
       round(count(*) FILTER (outcome IN {FAILED_SQL}) / count(*)::DOUBLE, 6) AS error_ratio
FROM hop WHERE pos = 0 GROUP BY ALL""")
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success and error shares per queue."""
    return M.ratios(hops(spark, sf_dir)).select(
        "queue", F.round("success_ratio", 6).alias("success_ratio"),
        F.round("error_ratio", 6).alias("error_ratio"),
    )


@query("rate_5m", f"""WITH {HOP_SQL}, w AS (
  SELECT queue, epoch(time_bucket(INTERVAL 1 MINUTE, started_at))::BIGINT AS step FROM hop)
SELECT queue, to_timestamp(step - o * 60)::TIMESTAMP AS window_start, count(*) AS n,
       round(count(*) / 300.0::DOUBLE, 6) AS per_second
FROM w, (SELECT unnest([0, 1, 2, 3, 4]) AS o) GROUP BY queue, step - o * 60""")
def rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding five-minute rates."""
    out = M.rate(hops(spark, sf_dir), "started_at", ["queue"])
    return out.select(
        "queue", utc("window_start").alias("window_start"), "n",
        F.round("per_second", 6).alias("per_second"),
    )


@query("latency_p95", f"""WITH {HOP_SQL}
SELECT queue, round(quantile_cont(duration_s, 0.95), 6) AS p95 FROM hop GROUP BY ALL""")
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact P95 of the processing time per queue."""
    out = M.latency_quantile(hops(spark, sf_dir), "duration_s", ["queue"], 0.95, "p95")
    return out.select("queue", F.round("p95", 6).alias("p95"))


@query("latency_p95_tiny", f"""WITH {HOP_SQL}
SELECT queue, round(quantile_cont(value / 1e7::DOUBLE, 0.95) * 1e7::DOUBLE, 6) AS p95
FROM hop GROUP BY ALL""")
def latency_p95_tiny(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact P95 of times far below a millisecond."""
    rows = hops(spark, sf_dir).withColumn("tiny", F.col("value") / F.lit(1e7))
    out = M.latency_quantile(rows, "tiny", ["queue"], 0.95, "p95")
    return out.select("queue", F.round(F.col("p95") * 1e7, 6).alias("p95"))


@query("latency_p95_daily", f"""WITH {HOP_SQL}
SELECT queue, date_trunc('day', started_at)::TIMESTAMP AS day,
       round(quantile_cont(duration_s, 0.95), 6) AS p95 FROM hop GROUP BY ALL""")
def latency_p95_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact P95 per queue and day."""
    rows = hops(spark, sf_dir).withColumn("day", F.date_trunc("day", "started_at"))
    out = M.latency_quantile(rows, "duration_s", ["queue", "day"], 0.95, "p95")
    return out.select("queue", utc("day").alias("day"), F.round("p95", 6).alias("p95"))


@query("bucket_p95", f"""WITH {HOP_SQL}, b AS (
  SELECT queue, le, count(*) FILTER (duration_s <= le) AS n, count(*) AS total
  FROM hop, (SELECT unnest([{', '.join(f'{b!r}::DOUBLE' for b in M.DURATION_BUCKETS)}]) AS le)
  GROUP BY ALL
), s AS (
  SELECT queue, le, n, total, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below
  FROM b WINDOW w AS (PARTITION BY queue ORDER BY le)
)
SELECT queue, round(min(low + (le - low) * (0.95::DOUBLE * total - below) / (n - below)), 6)
  AS quantile
FROM s WHERE n >= 0.95::DOUBLE * total AND below < 0.95::DOUBLE * total GROUP BY ALL""")
def bucket_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P95 interpolated from cumulative buckets."""
    hist = M.histogram(hops(spark, sf_dir), "duration_s", ["queue"])
    out = M.histogram_quantile(hist, ["queue"], 0.95)
    return out.select("queue", F.round("quantile", 6).alias("quantile"))


ALERT_LIMITS = M.Thresholds(error_ratio=0.1, error_for=180, depth=2, depth_for=300,
                            p95_seconds=3.0, runtime_error_rate=0.005)


@query("alerts", f"""WITH {HOP_SQL}, steps AS (
  SELECT queue, epoch(time_bucket(INTERVAL 1 MINUTE, started_at))::BIGINT AS step,
         count(*) FILTER (pos = 0) AS n,
         count(*) FILTER (pos = 0 AND outcome IN {FAILED_SQL}) AS bad,
         count(*) FILTER (pos = 0 AND error_type = 'execution_error') AS broken
  FROM hop GROUP BY ALL
), series AS (
  SELECT queue, step - o * 60 AS start, sum(n) AS n, sum(bad) AS bad, sum(broken) AS broken
  FROM steps, (SELECT unnest([0, 1, 2, 3, 4]) AS o) GROUP BY ALL
), ratio AS (
  SELECT queue, start, bad / nullif(n, 0)::DOUBLE AS share,
         coalesce(bad / nullif(n, 0)::DOUBLE > 0.1, false) AS hit FROM series
), held AS (
  SELECT *, sum(hit::INTEGER) OVER (PARTITION BY queue ORDER BY start
            RANGE BETWEEN 120 PRECEDING AND CURRENT ROW) AS hits FROM ratio
), slow AS (
  SELECT queue, epoch(time_bucket(INTERVAL 5 MINUTE, started_at))::BIGINT AS start,
         quantile_cont(duration_s, 0.95) AS p95 FROM hop WHERE pos = 0 GROUP BY ALL
), lim AS (
  SELECT queue, min(t) AS lo, max(t) AS hi FROM (
    SELECT queue, ceil(epoch_us(enqueued_at) / 60e6)::BIGINT AS t FROM hop
    UNION ALL SELECT queue, ceil(epoch_us(ended_at) / 60e6)::BIGINT FROM hop) GROUP BY ALL
), ticks AS (
  SELECT queue, unnest(generate_series(lo, hi)) AS m FROM lim
), moves AS (
  SELECT queue, ceil(epoch_us(enqueued_at) / 60e6)::BIGINT AS m, 1 AS d FROM hop
  UNION ALL SELECT queue, ceil(epoch_us(started_at) / 60e6)::BIGINT, -1 FROM hop
  UNION ALL SELECT queue, m, 0 FROM ticks
), depth AS (
  SELECT queue, m * 60 AS start, sum(sum(d)) OVER (PARTITION BY queue ORDER BY m) AS queued
  FROM moves GROUP BY queue, m
), deep AS (
  SELECT *, sum((queued > 2)::INTEGER) OVER (PARTITION BY queue ORDER BY start
            RANGE BETWEEN 240 PRECEDING AND CURRENT ROW) AS hits FROM depth
), found AS (
  SELECT 'high_error_ratio' AS alert, queue, start, share AS value FROM held WHERE hits >= 3
  UNION ALL SELECT 'runtime_errors', queue, start, broken / 300.0::DOUBLE FROM series
  WHERE broken / 300.0::DOUBLE > 0.005
  UNION ALL SELECT 'slow_processing', queue, start, p95 FROM slow WHERE p95 > 3
  UNION ALL SELECT 'queue_depth', queue, start, queued::DOUBLE FROM deep WHERE hits >= 5
)
SELECT alert, queue, to_timestamp(start)::TIMESTAMP AS "at", round(value, 6) AS value FROM found""")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold alerts on error ratio, runtime errors, P95 and queue depth."""
    out = M.alerts(hops(spark, sf_dir), ALERT_LIMITS)
    return out.select("alert", "queue", utc("at").alias("at"), F.round("value", 6).alias("value"))
