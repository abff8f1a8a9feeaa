"""Running values over ordered rows of a key, safe for hot keys.

A plain window over a key puts all rows of that key into one task. Here the
order axis is cut into chunks: the rows are shuffled by (key, chunk), running
values are computed inside each chunk, and what earlier chunks contribute comes
from a small table with one row per (key, chunk) that is pre-aggregated on the
map side. A key that holds a third of all rows is spread over its chunks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ_CHUNK = 1_000_000


@dataclass(frozen=True)
class Running:
    """A running value: ``max``, ``sum``, ``first`` or ``last`` (both non-null).

    With ``before`` the current row itself is left out.
    """

    kind: str
    value: Column
    before: bool = False


def seq_chunk(seq: Column | str, width: int = SEQ_CHUNK) -> Column:
    """Chunk of a unique sequence number: never more than ``width`` rows."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(seq / F.lit(width)).cast("bigint")


def time_chunk(ts: Column | str, seconds: int = 60) -> Column:
    """Chunk of a timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def running(
    df: DataFrame,
    key: list[str],
    order: list[str],
    chunk: Column,
    *,
    backwards: bool = False,
    **specs: Running,
) -> DataFrame:
    """Add one running column per spec.

    ``chunk`` must not decrease along ``order``; keys and order columns must not
    be null. ``backwards`` runs from the last row to the first, which turns
    ``last``/``before`` into a look ahead. A ``__chunk`` column that is there
    already is used and kept, so that several scans share one shuffle.
    """
    parts = [*key, "__chunk"]
    direction = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    rows = df if "__chunk" in df.columns else df.withColumn("__chunk", chunk)
    inside = Window.partitionBy(*parts).orderBy(*[direction(c) for c in order])
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        Window.partitionBy(*key)
        .orderBy(direction("__chunk"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    rank = F.struct(*[F.col(c) for c in order])
    low, high = (F.max_by, F.min_by) if backwards else (F.min_by, F.max_by)
    totals, carries, values = [], [], []
    for name, spec in specs.items():
        frame = prior if spec.before else upto
        v = spec.value
        if spec.kind == "max":
            totals.append(F.max(v).alias(name))
            carries.append(F.max(name).over(earlier))
            values.append((F.max(v).over(frame), F.greatest))
        elif spec.kind == "sum":
            totals.append(F.sum(v).alias(name))
            carries.append(F.sum(name).over(earlier))
            values.append((F.sum(v).over(frame), _plus))
        elif spec.kind == "last":
            totals.append(high(v, F.when(v.isNotNull(), rank)).alias(name))
            carries.append(F.last(name, ignorenulls=True).over(earlier))
            values.append((F.last(v, ignorenulls=True).over(frame), lambda c, w: F.coalesce(w, c)))
        elif spec.kind == "first":
            totals.append(low(v, F.when(v.isNotNull(), rank)).alias(name))
            carries.append(F.first(name, ignorenulls=True).over(earlier))
            values.append((F.first(v, ignorenulls=True).over(frame), F.coalesce))
        else:
            raise ValueError(f"unknown running value: {spec.kind!r}")

    names = list(specs)
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(parts)]
    carried = (
        rows.groupBy(*parts)
        .agg(*totals)
        .select(*keys, *[c.alias(f"__carry_{n}") for n, c in zip(names, carries)])
    )
    # most keys live in one chunk and carry nothing: only real carries are joined
    some = [F.col(f"__carry_{n}").isNotNull() for n in names]
    carried = carried.filter(reduce(lambda a, b: a | b, some))
    match = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(parts)]
    local = rows.select("*", *[w.alias(f"__in_{n}") for n, (w, _) in zip(names, values)])
    joined = local.join(carried, match, "left")
    return joined.select(
        *df.columns,
        *[
            merge(F.col(f"__carry_{n}"), F.col(f"__in_{n}")).alias(n)
            for n, (_, merge) in zip(names, values)
        ],
    )


def _plus(carry: Column, inside: Column) -> Column:
    return F.when(
        carry.isNotNull() | inside.isNotNull(),
        F.coalesce(carry, F.lit(0)) + F.coalesce(inside, F.lit(0)),
    )


def ordinal(df: DataFrame, key: list[str], order: list[str], chunk: Column, name: str) -> DataFrame:
    """Position of a row within its key, from 1."""
    return running(df, key, order, chunk, **{name: Running("sum", F.lit(1).cast("bigint"))})


# items of a quantile sketch, and the share of ranks on either side of the wanted ones that is
# looked at: three times the sketch's error at 99 % (nearly eight standard deviations) and three
# ranks of a group of SMALL rows; smaller groups are looked at as a whole
SKETCH, MARGIN, SMALL = 2048, 0.01, 512
CUTS = 64  # parts of what lies between the bounds
HOT_GROUPS = 1000  # groups whose bounds are broadcast


def exact_quantile(
    df: DataFrame, by: list[str], value: str, q: float, name: str = "quantile"
) -> DataFrame:
    """Exact interpolated quantile per group; nulls and NaN are no values.

    1. A mergeable sketch per group gives bounds around the wanted ranks and cuts between them.
    2. Rows below the bounds are counted, rows above them left out, both before anything moves:
       the bounds of the ``HOT_GROUPS`` largest groups are broadcast. Rows of smaller groups
       meet their bounds after they were counted by value.
    3. What is left, about one row in fifty, is counted by value and ranked part by part.

    The rows are read twice, and nothing runs while the frame is built. The bounds depend on the
    data, so ranges of any width are told apart. A sketch that misses the ranks, which is next
    to impossible, is an error and never a wrong value.
    """
    v, c = F.col("__v"), F.col("__c")
    group = F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("all"))
    base = df.select(group.alias("__g"), F.col(value).cast("double").alias("__v")).filter(
        v.isNotNull() & ~F.isnan(v)
    )
    bounds = _rank_bounds(base, q)
    hot = bounds.orderBy(F.desc("__n"), "__g").limit(HOT_GROUPS).select(
        F.col("__g").alias("__h"), F.col("__cuts").alias("__hot")
    )
    near = base.join(F.broadcast(hot), F.col("__g") == F.col("__h"), "left")
    cold, first, last = F.col("__hot").isNull(), F.col("__hot")[0], F.col("__hot")[CUTS]
    counted = (
        near.filter(cold | (v <= last))
        .groupBy("__g", F.when(cold | (v >= first), v).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    of = bounds.withColumnRenamed("__g", "__of")
    cuts = F.col("__cuts")
    met = counted.join(of, F.col("__g") == F.col("__of")).filter(v.isNull() | (v <= cuts[CUTS]))
    under = v.isNull() | (v < cuts[0])
    part = F.when(under, F.lit(0)).otherwise(F.size(F.filter(cuts, lambda x: x <= v)))
    values = met.groupBy(
        "__g", part.cast("bigint").alias("__chunk"),
        F.when(under, F.lit(float("-inf"))).otherwise(v).alias("__v"), "__lo", "__hi", "__share",
    ).agg(F.sum("__c").alias("__c"))
    ranked = running(values, ["__g"], ["__v"], F.col("__chunk"), __end=Running("sum", c))
    holds = lambda rank: (F.col("__chunk") > 0) & (
        F.col(rank) >= F.col("__end") - c) & (F.col(rank) < F.col("__end"))
    low, high = (F.max(F.when(holds(r), v)) for r in ("__lo", "__hi"))
    missed = F.raise_error(F.lit("a sketch missed the ranks of a quantile: run it again"))
    between = F.when(low.isNull() | high.isNull(), missed.cast("double")).otherwise(
        F.when(low == high, low).otherwise(low + (high - low) * F.max("__share"))
    )
    found = ranked.groupBy("__g").agg(between.alias(name))
    return found.select(*[F.col("__g")[b].alias(b) for b in by], name)


def _rank_bounds(base: DataFrame, q: float) -> DataFrame:
    """Per group: number of rows, the wanted ranks, and cuts from below the first to above the
    last of them."""
    n = F.col("__n")
    # in the order in which they are used: both uses of the bounds then share one exchange
    sketches = base.groupBy("__g").agg(
        F.count(F.lit(1)).alias("__n"), F.kll_sketch_agg_double("__v", F.lit(SKETCH)).alias("__s")
    )
    place = (n - 1) * F.lit(float(q))
    ranks = sketches.select("__g", "__n", "__s", place.alias("__pos")).select(
        "__g", "__n", "__s",
        F.floor("__pos").alias("__lo"), F.ceil("__pos").alias("__hi"),
        (F.col("__pos") - F.floor("__pos")).alias("__share"),
    )
    along = [i / CUTS for i in range(CUTS + 1)]
    low, high = max(0.0, q - MARGIN), min(1.0, q + MARGIN)
    at = lambda xs: F.kll_sketch_get_quantile_double(
        "__s", F.array(*[F.lit(min(1.0, x)) for x in xs]))
    near, whole = at([low + (high - low) * x for x in along]), at(along)
    return ranks.select(
        "__g", "__n", "__lo", "__hi", "__share",
        F.when(n > SMALL, near).otherwise(whole).alias("__cuts"),
    )
