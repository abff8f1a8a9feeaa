"""Counters, histograms, gauges, rates, quantiles and alerts over a hop log.

Every report aggregates to (label, bucket or minute) on the map side first;
what follows works on that small series, never on the rows again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.text import metric_name
from waybill.operators.scan import Running, exact_quantile, running
from waybill.schema import TRACE_ENTRY

# Bucket bounds in seconds, and in bytes for sizes.
DURATION_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0)
RECEIVE_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0)
SEND_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
SIZE_BUCKETS = tuple(100.0 * 10**k for k in range(8))

PROCESSED = ("success", "empty_response", "end_consumed")
FAILED = (
    "parse_error",
    "validation_error",
    "route_mismatch",
    "runtime_error",
    "routing_error",
    "error_queue_send_failed",
)


def from_run(done: DataFrame, transport: str = "table") -> DataFrame:
    """Hop log of a run in the columns the reports read, terminal steps included.

    Each terminal row adds the row its terminal step would log (``end_consumed``). A row waits
    from the end of the hop before (``enqueued_at``) to its call; where a step has no call of
    its own (column actors), it takes no time. Times stand with the first output of a hop.
    """
    kinds = {f.name: f.dataType for f in TRACE_ENTRY.fields}
    end = {"id": F.col("id"), "actor": F.col("terminal"), "outcome": F.lit("end_consumed"),
           "pos": F.lit(0)}
    entry = F.struct(
        *[end.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()]
    )
    log = done.select(F.explode(F.concat("trace", F.array(entry))).alias("t")).select("t.*")
    ended = F.timestamp_micros(
        F.unix_micros("started_at")
        + F.coalesce(F.round(F.col("duration_s") * 1e6).cast("bigint"), F.lit(0))
    )
    waited = (F.unix_micros("started_at") - F.unix_micros("enqueued_at")) / F.lit(1e6)
    timed = (
        log.withColumnRenamed("actor", "queue")
        .withColumn("transport", F.lit(transport))
        .withColumn("ended_at", ended)
        .withColumn("receive_s", F.greatest(F.lit(0.0), waited))
    )
    first = F.col("pos") == 0
    times = ("enqueued_at", "started_at", "ended_at", "duration_s", "receive_s")
    return timed.withColumns({c: F.when(first, F.col(c)) for c in times})


def _count(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def received(hops: DataFrame) -> DataFrame:
    return _count(hops.filter(F.col("pos") == 0), "queue", "transport")


def processed(hops: DataFrame) -> DataFrame:
    rows = hops.filter((F.col("pos") == 0) & F.col("outcome").isin(*PROCESSED))
    return _count(rows, "queue", F.col("outcome").alias("status"))


def sent(hops: DataFrame) -> DataFrame:
    return _count(hops.filter(F.col("message_type").isNotNull()), "dest", "message_type")


def failed(hops: DataFrame) -> DataFrame:
    rows = hops.filter((F.col("pos") == 0) & F.col("outcome").isin(*FAILED))
    return _count(rows, "queue", F.col("outcome").alias("reason"))


def runtime_errors(hops: DataFrame) -> DataFrame:
    """Errors of the call itself: time limits and broken calls, not raised exceptions."""
    rows = hops.filter((F.col("pos") == 0) & (F.col("error_type") == "execution_error"))
    return _count(rows, "queue", "error_type")


def counters(hops: DataFrame) -> DataFrame:
    """All five counters in one pass: (metric, label, detail, n)."""
    first = F.col("pos") == 0
    label = lambda metric, on, a, b: F.when(
        on, F.struct(F.lit(metric).alias("metric"), a.alias("label"), b.alias("detail"))
    )
    queue, outcome = F.col("queue"), F.col("outcome")
    events = F.array(
        label("received", first, queue, F.col("transport")),
        label("processed", first & outcome.isin(*PROCESSED), queue, outcome),
        label("sent", F.col("message_type").isNotNull(), F.col("dest"), F.col("message_type")),
        label("failed", first & outcome.isin(*FAILED), queue, outcome),
        label("runtime_errors", first & (F.col("error_type") == "execution_error"), queue,
              F.col("error_type")),
    )
    # combine equal rows first, then spread them over the counters they feed
    small = hops.groupBy(
        "pos", "queue", "transport", "outcome", "dest", "message_type", "error_type"
    ).agg(F.count(F.lit(1)).alias("rows"))
    spread = small.select("rows", F.explode(F.array_compact(events)).alias("e"))
    return spread.groupBy("e.metric", "e.label", "e.detail").agg(F.sum("rows").alias("n"))


def histogram(
    df: DataFrame, value: str, by: list[str], buckets: tuple[float, ...] = DURATION_BUCKETS
) -> DataFrame:
    """Cumulative buckets (``le``, ``+Inf`` last) with sum and count of the group."""
    v = F.col(value)
    counts = [F.count_if(v <= F.lit(float(b))) for b in buckets] + [F.count(v)]
    names = [f"{b:g}" for b in buckets] + ["+Inf"]
    grouped = df.groupBy(*by).agg(
        F.array(*counts).alias("__counts"), F.sum(v).alias("sum"), F.count(v).alias("count")
    )
    pairs = F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("le"), F.col("__counts").alias("n")
    )
    return grouped.select(*by, "sum", "count", F.explode(pairs).alias("b")).select(
        *by, F.col("b.le").alias("le"), F.col("b.n").alias("n"), "sum", "count"
    )


def size_histogram(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return histogram(df, value, by, SIZE_BUCKETS)


def sizes(hops: DataFrame) -> DataFrame:
    """(queue, direction, size): what an actor received, once per row it took, and each that it
    sent."""
    row = F.array(
        F.when((F.col("pos") == 0) & F.col("size_in").isNotNull(), F.struct(
            F.lit("received").alias("direction"), F.col("size_in").cast("bigint").alias("size"))),
        F.when(F.col("size_out").isNotNull(), F.struct(
            F.lit("sent").alias("direction"), F.col("size_out").cast("bigint").alias("size"))),
    )
    return hops.select("queue", F.explode(F.array_compact(row)).alias("s")).select("queue", "s.*")


def size_histograms(hops: DataFrame) -> DataFrame:
    """Cumulative size buckets per queue and direction of a hop log."""
    return size_histogram(sizes(hops), "size", ["queue", "direction"])


def time_histograms(hops: DataFrame) -> DataFrame:
    """Cumulative buckets of every time the log has: (queue, time, le, n, sum, count).

    ``runtime`` is the handler's own call, ``receive`` the time from the queue to the actor,
    ``processing`` from there to the next queues and ``send`` the writing to those.
    """
    kinds = {"runtime": ("duration_s", DURATION_BUCKETS), "receive": ("receive_s", RECEIVE_BUCKETS),
             "processing": ("processing_s", DURATION_BUCKETS), "send": ("send_s", SEND_BUCKETS)}
    first = hops.filter(F.col("pos") == 0)
    found = [
        histogram(first, c, ["queue"], buckets).withColumn("time", F.lit(kind))
        for kind, (c, buckets) in kinds.items() if c in hops.columns
    ]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.select("queue", "time", "le", "n", "sum", "count")


def histogram_quantile(hist: DataFrame, by: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets by linear interpolation inside the bucket."""
    order = Window.partitionBy(*by).orderBy("__le")
    rank = F.col("count") * F.lit(q)
    rows = (
        hist.withColumn("__le", F.when(F.col("le") == "+Inf", F.lit("Infinity"))
                        .otherwise(F.col("le")).cast("double"))
        .withColumn("__low", F.coalesce(F.lag("__le").over(order), F.lit(0.0)))
        .withColumn("__below", F.coalesce(F.lag("n").over(order), F.lit(0)))
    )
    hit = (F.col("n") >= rank) & (F.col("__below") < rank)
    inside = F.col("__low") + (F.col("__le") - F.col("__low")) * (
        (rank - F.col("__below")) / (F.col("n") - F.col("__below"))
    )
    value = F.when(F.col("__le") == F.lit(float("inf")), F.col("__low")).otherwise(inside)
    return rows.filter(hit).groupBy(*by).agg(F.min(value).alias("quantile"))


def _grid(ts: Column, seconds: int) -> Column:
    """First grid point at or after a time, in grid steps since the epoch."""
    return F.ceil(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def _gauge_steps(
    df: DataFrame, by: list[str], seconds: int, gauges: dict[str, tuple[Column, Column]]
) -> DataFrame:
    """Values from each grid step with moves (``__at``) to the next one (``__next``).

    Starts and ends are counted per grid step on the map side and summed along the steps that
    have some, so no row is ever compared with every point in time, and a stray time costs a row.
    """
    names, row = list(gauges), []
    for i, (begin, end) in enumerate(gauges.values()):
        for at, sign in ((begin, 1), (end, -1)):
            row.append(
                F.when(
                    at.isNotNull() & begin.isNotNull(),
                    F.struct(_grid(at, seconds).alias("at"), F.lit(i).alias("g"),
                             F.lit(sign).cast("bigint").alias("d")),
                )
            )
    moves = df.select(*by, F.explode(F.array_compact(F.array(*row))).alias("s"))
    delta = moves.groupBy(*by, F.col("s.at").alias("__at")).agg(
        *[F.sum(F.when(F.col("s.g") == i, F.col("s.d")).otherwise(0)).alias(n)
          for i, n in enumerate(names)]
    )
    order = Window.partitionBy(*by).orderBy("__at")
    along = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return delta.select(
        *by, "__at", F.lead("__at").over(order).alias("__next"),
        *[F.sum(n).over(along).alias(n) for n in names],
    )


def gauge_runs(
    df: DataFrame, by: list[str], seconds: int, **gauges: tuple[Column, Column]
) -> DataFrame:
    """Rows open at the grid points from ``start`` up to before ``end`` (null: to no end)."""
    found = _gauge_steps(df, by, seconds, gauges)
    when = lambda c: F.timestamp_seconds(F.col(c) * F.lit(seconds))
    return found.select(*by, when("__at").alias("start"), when("__next").alias("end"), *gauges)


def gauge_over_time(
    df: DataFrame, by: list[str], seconds: int, **gauges: tuple[Column, Column]
) -> DataFrame:
    """Rows open at each grid point: ``start <= t`` and (``end`` null or ``end > t``).

    Every point from the first move to the last; ``gauge_runs`` has the same without repeats.
    """
    found = _gauge_steps(df, by, seconds, gauges)
    points = F.sequence("__at", F.coalesce(F.col("__next") - 1, F.col("__at")))
    dense = found.select(*by, F.explode(points).alias("__point"), *gauges)
    return dense.select(
        *by, F.timestamp_seconds(F.col("__point") * F.lit(seconds)).alias("at"), *gauges
    )


def active(hops: DataFrame, seconds: int = 3600, by: tuple[str, ...] = ("queue",)) -> DataFrame:
    """In-flight rows at every grid point."""
    return gauge_over_time(
        hops, list(by), seconds, active=(F.col("started_at"), F.col("ended_at"))
    )


def active_at(hops: DataFrame, at: Column, by: tuple[str, ...] = ("queue",)) -> DataFrame:
    """In-flight rows at one time."""
    inside = (F.col("started_at") <= at) & (F.col("ended_at").isNull() | (F.col("ended_at") > at))
    return hops.groupBy(*by).agg(F.count_if(inside).alias("active"))


def queue_depth(hops: DataFrame, seconds: int = 3600, by: tuple[str, ...] = ("queue",)) -> DataFrame:
    """Rows waiting and rows in work at every grid point."""
    return gauge_over_time(
        hops,
        list(by),
        seconds,
        queued=(F.col("enqueued_at"), F.col("started_at")),
        processing=(F.col("started_at"), F.col("ended_at")),
    )


def queue_depth_runs(
    hops: DataFrame, seconds: int = 3600, by: tuple[str, ...] = ("queue",)
) -> DataFrame:
    """Rows waiting and rows in work, as runs of grid points with equal numbers."""
    return gauge_runs(
        hops,
        list(by),
        seconds,
        queued=(F.col("enqueued_at"), F.col("started_at")),
        processing=(F.col("started_at"), F.col("ended_at")),
    )


def capacity(depth: DataFrame, target: int, low: int = 0, high: int = 50) -> DataFrame:
    """Workers needed for a depth: ceil(depth / target) within [low, high]."""
    need = F.ceil((F.col("queued") + F.col("processing")) / F.lit(target)).cast("bigint")
    return depth.withColumn("workers", F.least(F.greatest(need, F.lit(low)), F.lit(high)))


@dataclass(frozen=True)
class MetricSpec:
    name: str
    type: str
    labels: tuple[str, ...] = ()
    value: str | None = None
    order: str = "ts"
    buckets: tuple[float, ...] = ()


def custom_metric(df: DataFrame, spec: MetricSpec) -> DataFrame:
    """User metric: (metric, labels..., le, value).

    Counters add up ``value`` (rows when there is none), gauges keep the latest
    value, histograms give one row per bucket.
    """
    by = list(spec.labels)
    kind = spec.type.lower()
    name = metric_name(F.lit(spec.name)).alias("metric")
    if kind == "counter":
        amount = F.col(spec.value).cast("double") if spec.value else F.lit(1.0)
        out = df.groupBy(*by).agg(F.sum(amount).alias("value"))
    elif kind == "gauge":
        out = df.groupBy(*by).agg(
            F.max_by(F.col(spec.value).cast("double"), F.col(spec.order)).alias("value")
        )
    elif kind == "histogram":
        hist = histogram(df, spec.value, by, spec.buckets or DEFAULT_BUCKETS)
        return hist.select(name, *by, "le", F.col("n").cast("double").alias("value"))
    else:
        raise ValueError(f"unknown metric type: {spec.type!r}")
    return out.select(name, *by, F.lit(None).cast("string").alias("le"), "value")


def error_summary(report: DataFrame) -> DataFrame:
    """Failed terminals by failed actor and exception type."""
    return (
        report.filter(F.col("status") == "failed")
        .groupBy("failed_actor", F.col("details.type").alias("error_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ratios(hops: DataFrame) -> DataFrame:
    """Success and error share per queue; null when nothing was received."""
    first = F.col("pos") == 0
    total = F.count_if(first)
    return hops.groupBy("queue").agg(
        (F.count_if(first & F.col("outcome").isin("success")) / F.nullif(total, F.lit(0)))
        .alias("success_ratio"),
        (F.count_if(first & F.col("outcome").isin(*FAILED)) / F.nullif(total, F.lit(0)))
        .alias("error_ratio"),
    )


def sliding(
    series: DataFrame, by: list[str], window: int, slide: int, **sums: str
) -> DataFrame:
    """Sliding-window sums from a series of ``slide``-second steps.

    ``step`` is the start of a step in seconds; a window covers ``window``
    seconds from its start. Each step row feeds window / slide windows, but
    only after the rows have been counted down to steps.
    """
    starts = F.sequence(
        F.col("step") - F.lit(window - slide), F.col("step"), F.lit(slide).cast("bigint")
    )
    spread = series.select(*by, *sums.values(), F.explode(starts).alias("start"))
    return spread.groupBy(*by, "start").agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def steps(df: DataFrame, ts: str, by: list[str], slide: int, **counts: Column) -> DataFrame:
    """Counts per ``slide``-second step."""
    step = (F.floor(F.unix_micros(ts) / F.lit(slide * 1_000_000)) * slide).cast("bigint")
    return df.groupBy(*by, step.alias("step")).agg(*[c.alias(n) for n, c in counts.items()])


def rate(df: DataFrame, ts: str, by: list[str], window: int = 300, slide: int = 60) -> DataFrame:
    """Rows per second over sliding windows."""
    per_step = steps(df, ts, by, slide, n=F.count(F.lit(1)))
    out = sliding(per_step, by, window, slide, n="n")
    return out.select(
        *by,
        F.timestamp_seconds("start").alias("window_start"),
        "n",
        (F.col("n") / F.lit(float(window))).alias("per_second"),
    )


def latency_quantile(
    df: DataFrame, value: str, by: list[str], q: float = 0.95, name: str = "quantile"
) -> DataFrame:
    """Exact quantile per group (see ``exact_quantile``)."""
    return exact_quantile(df, by, value, q, name)


def held_for(series: DataFrame, by: list[str], flag: str, slide: int, seconds: int) -> DataFrame:
    """Rows of a step series whose flag has been true for the whole time before.

    A missing step counts as false. The series has one row per label and step,
    so a label's window is bounded by time, not by rows of the log.
    """
    n = seconds // slide
    back = (
        Window.partitionBy(*by).orderBy("start").rangeBetween(-(seconds - slide), 0)
    )
    hits = F.sum(F.col(flag).cast("int")).over(back)
    return series.withColumn("__hits", F.coalesce(hits, F.lit(0))).filter(
        F.col("__hits") >= n
    ).drop("__hits")


@dataclass(frozen=True)
class Thresholds:
    """Alert limits."""

    error_ratio: float = 0.1
    error_for: int = 300
    depth: int = 1000
    depth_for: int = 600
    p95_seconds: float = 60.0
    runtime_error_rate: float = 0.01


def alerts(
    hops: DataFrame, limits: Thresholds = Thresholds(), window: int = 300, slide: int = 60,
    *, depth: bool = True,
) -> DataFrame:
    """Alerts as (alert, queue, at, value).

    The log is read twice: once down to counts and queue moves per queue and step, from which
    three alerts follow along the steps, and once for the processing times above their limit.
    ``depth`` needs the column ``enqueued_at``.
    """
    series = _alert_steps(hops, window, slide, depth)
    order = Window.partitionBy("queue").orderBy("start")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("queue").orderBy(F.desc("start"))
    counted, moved = F.col("c") > 0, F.col("m") > 0
    share = F.col("bad") / F.nullif(F.col("n"), F.lit(0))
    hit = counted & F.coalesce(share > limits.error_ratio, F.lit(False))
    back = order.rangeBetween(-(limits.error_for - slide), 0)
    deep = moved & (F.col("queued") > limits.depth)
    rows = (
        series.withColumn("queued", F.sum("d").over(upto))
        .withColumn("hits", F.sum(hit.cast("int")).over(back))
        # a deep stretch ends where the queue is not deep any more
        .withColumn("shallow", F.sum((moved & ~deep).cast("int")).over(upto))
        .withColumn("next", F.last(F.when(moved, F.col("start")), ignorenulls=True).over(
            behind.rowsBetween(Window.unboundedPreceding, -1)))
    )
    stretch = Window.partitionBy("queue", "shallow")
    rows = rows.withColumn("since", F.min(F.when(deep, F.col("start"))).over(stretch))
    begin = F.greatest(F.col("start"), F.col("since") + F.lit(limits.depth_for - slide))
    end = F.coalesce(F.col("next"), F.col("start") + slide) - slide
    speed = F.col("broken") / F.lit(float(window))
    found = lambda name, at, value: F.struct(
        F.lit(name).alias("alert"), at.alias("at"), value.cast("double").alias("value"))
    one = lambda on, entry: F.when(on, F.array(entry))
    entries = [
        one(F.col("hits") * slide >= limits.error_for, found("high_error_ratio", F.col("start"), share)),
        one(counted & (speed > limits.runtime_error_rate),
            found("runtime_errors", F.col("start"), speed)),
        F.when(deep & (begin <= end), F.transform(
            F.sequence(begin, end, F.lit(slide).cast("bigint")),
            lambda t: found("queue_depth", t, F.col("queued")))),
    ]
    # only steps with rows of the log have an error ratio
    entries[0] = F.when(counted, entries[0])
    spread = rows.select("queue", F.explode(F.flatten(F.array_compact(F.array(*entries)))).alias("e"))
    out = spread.select("e.alert", "queue", F.timestamp_seconds("e.at").alias("at"), "e.value")
    return out.unionByName(_slow(hops, limits.p95_seconds, window))


def _alert_steps(hops: DataFrame, window: int, slide: int, depth: bool) -> DataFrame:
    """(queue, start, n, bad, broken, c, d, m): sums of the window from ``start`` on, with the
    number of rows (c); moves of the queue (d) and their number (m) at the step itself."""
    first = F.col("pos") == 0
    failed_row = first & F.col("outcome").isin(*FAILED)
    broken = first & (F.col("error_type") == "execution_error")
    step = (F.floor(F.unix_micros("started_at") / F.lit(slide * 1_000_000)) * slide).cast("bigint")
    number = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def entry(at, c, n, bad, ended, d, m):
        names = ("at", "c", "n", "bad", "broken", "d", "m")
        values = (at, c, n, bad, ended, d, m)
        return F.struct(*[v.cast("bigint").alias(k) for k, v in zip(names, values)])

    row = [F.when(F.col("started_at").isNotNull(), entry(
        step, F.lit(1), number(first), number(failed_row), number(broken), zero, zero))]
    if depth:
        grid = lambda c: _grid(F.col(c), slide) * slide
        known = F.col("enqueued_at").isNotNull()
        for name, on, d in (("enqueued_at", known, 1), ("started_at", known, -1),
                            ("ended_at", F.col("started_at").isNotNull(), 0)):
            row.append(F.when(on & F.col(name).isNotNull(),
                              entry(grid(name), zero, zero, zero, zero, F.lit(d), F.lit(1))))
    sums = ("c", "n", "bad", "broken", "d", "m")
    moves = hops.select("queue", F.explode(F.array_compact(F.array(*row))).alias("s"))
    per_step = moves.groupBy("queue", F.col("s.at").alias("at")).agg(
        *[F.sum(f"s.{c}").alias(c) for c in sums])
    # a step's counts feed every window it lies in, its moves only the step itself
    starts = F.when(F.col("c") > 0, F.sequence(
        F.col("at") - F.lit(window - slide), F.col("at"), F.lit(slide).cast("bigint")
    )).otherwise(F.array("at"))
    spread = per_step.select("queue", "at", *sums, F.explode(starts).alias("start"))
    own = F.col("at") == F.col("start")
    return spread.groupBy("queue", "start").agg(
        *[F.sum(c).alias(c) for c in sums[:4]],
        *[F.sum(F.when(own, F.col(c)).otherwise(0)).alias(c) for c in sums[4:]],
    )


def _slow(hops: DataFrame, limit: float, window: int) -> DataFrame:
    """Windows whose exact P95 of the processing time is above the limit.

    Times up to the limit are counted where they are read, with the largest of them; only those
    above it move, and they are ranked in parts of a sixteenth of a doubling.
    """
    v, c = F.col("duration_s"), F.col("__c")
    start = (F.floor(F.unix_micros("started_at") / F.lit(window * 1_000_000)) * window).cast("bigint")
    timed = hops.filter((F.col("pos") == 0) & v.isNotNull() & F.col("started_at").isNotNull())
    counted = timed.groupBy(
        "queue", start.alias("start"), F.when(v > limit, v).alias("__over")
    ).agg(F.count(F.lit(1)).alias("__c"), F.max(v).alias("__v"))
    whole = Window.partitionBy("queue", "start")
    pos = (F.col("__n") - 1) * F.lit(0.95)
    ranked = counted.withColumn("__n", F.sum(c).over(whole)).select(
        "queue", "start", "__over", "__c", "__v",
        F.floor(pos).alias("__lo"), F.ceil(pos).alias("__hi"), (pos - F.floor(pos)).alias("__share"),
        F.sum(F.when(F.col("__over").isNull(), c).otherwise(0)).over(whole).alias("__under"),
    ).filter(F.col("__under") <= F.col("__hi"))
    part = F.when(F.col("__over").isNull(), F.lit(-(1 << 62))).otherwise(
        F.floor(F.log2(F.col("__over")) * 16))
    ends = running(ranked, ["queue", "start"], ["__v"], part.cast("bigint"), __end=Running("sum", c))
    holds = lambda r: (F.col(r) >= F.col("__end") - c) & (F.col(r) < F.col("__end"))
    # of the times up to the limit the largest is the last, and no other can be needed
    last = F.col("__over").isNotNull() | (F.col("__lo") == F.col("__end") - 1)
    low = F.max(F.when(holds("__lo") & last, F.col("__v")))
    high = F.max(F.when(holds("__hi"), F.col("__v")))
    p95 = F.when(low == high, low).otherwise(low + (high - low) * F.max("__share"))
    found = ends.groupBy("queue", "start").agg(p95.alias("value")).filter(F.col("value") > limit)
    return found.select(
        F.lit("slow_processing").alias("alert"), "queue",
        F.timestamp_seconds("start").alias("at"), "value",
    )
