"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. No source may be read more than
``max_epochs`` times: those above are clamped there and what they leave over is
shared by weight among the others. A document is then taken its source's whole
number of times, and once more if its seeded hash lies below the source's threshold,
which is set from a histogram of words by hash so that the words taken come within
half a histogram bin (or half a document) of the target.

Only (source, hash bin) sums and one row per source are shuffled. A source that holds
a third of all rows is pre-aggregated to at most ``BINS`` rows before its window.

Defined results: a null text has no words; a null source is a source of its own;
sources of weight 0, null or missing take nothing; a source without words has target 0;
rows that repeat a key fall into the same hash bin and are taken equally often; an
empty table gives an empty result; other columns pass through ``mix`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import column, place, sealed, unsealed, word_count
from waybill.session import stored

BINS = 4096  # three hexadecimal digits of the hash


def hash_bin(key: Column, seed: str) -> Column:
    """Seeded place of a document in 0..BINS-1."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 3), 16, 10).cast("int")


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1..cycle, repeating along the code-point order of the sources, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    return sources.select("source", (place % cycle + 1).cast("double").alias("weight"))


def water_fill(sources: DataFrame, max_epochs: int = 3, budget: float | None = None) -> DataFrame:
    """Targets of (source, source_size, weight): one row per source comes back.

    Sources are ordered by how early they reach their cap; the first that stays below
    it sets the level, which is what repeated clamping and resharing converges to.
    """
    cap, w = F.col("__cap"), F.col("__w")
    whole = F.lit(budget) if budget is not None else F.sum("source_size").over(Window.partitionBy())
    rows = sources.select(
        "source",
        "source_size",
        F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0)).alias("__w"),
        (F.col("source_size") * F.lit(max_epochs)).cast("double").alias("__cap"),
        whole.cast("double").alias("__budget"),
    )
    order = Window.orderBy((cap / F.nullif(w, F.lit(0.0))).asc_nulls_last(), "source")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levelled = rows.select(
        "*",
        (F.col("__budget") - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0))).alias("__left"),
        F.sum("__w").over(later).alias("__rest"),
    ).withColumn("__full", cap * F.col("__rest") <= F.col("__left") * w)
    level = F.max(F.when(~F.col("__full"), F.col("__left") / F.nullif("__rest", F.lit(0.0))))
    return levelled.withColumn("__level", level.over(Window.partitionBy())).select(
        "source",
        "source_size",
        F.when(w == 0, F.lit(0.0))
        .when(F.col("__full"), cap)
        .otherwise(F.coalesce(F.col("__level") * w, F.lit(0.0)))
        .alias("target"),
    )


def mixing_plan(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    max_epochs: int = 3,
    budget: float | None = None,
    seed: str = "mix",
) -> DataFrame:
    """One row per source: size, target, whole repetitions and the hash threshold.

    ``weights`` has (source, weight), those of a source given twice added up; without it
    weights 1, 2, 3 repeat along the sources.
    """
    base = docs.select(
        column(source).alias("source"),
        word_count(column(text)).alias("__size"),
        hash_bin(column(key), seed).alias("__bin"),
    )
    # one small row per source and bin; everything below works on these
    bins = stored(base.groupBy("source", "__bin").agg(F.sum("__size").alias("__mass")), "bins")
    sources = bins.groupBy("source").agg(F.sum("__mass").alias("source_size"))
    if weights is None:
        given = cyclic_weights(sources)
    else:
        given = weights.groupBy("source").agg(F.sum("weight").alias("weight"))
    given = given.select(
        F.col("source").alias("__given"), F.col("weight").cast("double").alias("weight")
    )
    named = sources.join(given, F.col("source").eqNullSafe(F.col("__given")), "left")
    targets = water_fill(named.drop("__given"), max_epochs, budget)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    targets = targets.withColumn("epochs", epochs.cast("int")).withColumn(
        "__part", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    upto = (
        Window.partitionBy("source")
        .orderBy("__bin")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    along = bins.select(
        F.col("source").alias("__of"), "__bin", F.sum("__mass").over(upto).alias("__cum")
    )
    off = F.abs(F.col("__cum") - F.col("__part"))
    best = F.min(F.struct(off.alias("off"), F.col("__bin").alias("bin")))
    return (
        targets.join(along, F.col("source").eqNullSafe(F.col("__of")))
        .groupBy("source", "source_size", "target", "epochs", "__part")
        .agg(best.alias("__best"))
        .select(
            "source",
            "source_size",
            "target",
            "epochs",
            F.when(F.col("__best.off") < F.col("__part"), F.col("__best.bin"))
            .otherwise(F.lit(-1))
            .alias("threshold"),
        )
    )


def with_copies(
    docs: DataFrame,
    plan: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """The documents with ``__plan`` (their source's row) and ``__copies`` (times taken)."""
    plan = stored(plan, "mixing").select(F.struct("*").alias("__plan"))
    of = F.col(place(docs, source))
    rows = sealed(docs).join(plan, of.eqNullSafe(F.col("__plan.source")), "left")
    extra = (hash_bin(F.col(place(docs, key)), seed) <= F.col("__plan.threshold")).cast("int")
    return rows.select(*unsealed(docs), "__plan", (F.col("__plan.epochs") + extra).alias("__copies"))


def mix(docs: DataFrame, weights: DataFrame | None = None, **options) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, columns unchanged."""
    plan = mixing_plan(docs, weights, **options)
    key = place(docs, options.get("key", "doc_id"))
    source = place(docs, options.get("source", "source"))
    rows = with_copies(sealed(docs), plan, key=key, source=source, seed=options.get("seed", "mix"))
    times = F.explode(F.array_repeat(F.lit(0), F.coalesce(F.col("__copies"), F.lit(0))))
    return rows.select(*sealed(docs).columns, times.alias("__time")).select(*unsealed(docs))
