"""Chunked scans against plain windows and brute force, with a hot key."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waybill.operators import scan
from waybill.operators.scan import Running, exact_quantile, ordinal, running, seq_chunk


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [
        ("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", i,
         rng.choice([None, rng.randrange(100)]))
        for i in range(600)
    ]
    return spark.createDataFrame(data, "key string, seq bigint, v bigint").cache()


@pytest.mark.parametrize("width", [1, 7, 10_000])
@pytest.mark.parametrize("backwards", [False, True])
def test_running_equals_plain_window(rows, width, backwards):
    specs = {
        "mx": Running("max", F.col("v")), "sm": Running("sum", F.col("v")),
        "fi": Running("first", F.col("v")), "la": Running("last", F.col("v")),
        "bmx": Running("max", F.col("v"), before=True),
        "bla": Running("last", F.col("v"), before=True),
    }
    got = running(rows, ["key"], ["seq"], seq_chunk("seq", width), backwards=backwards, **specs)
    order = Window.partitionBy("key").orderBy(F.desc("seq") if backwards else F.asc("seq"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select(
        "key", "seq", "v", F.max("v").over(upto).alias("mx"), F.sum("v").over(upto).alias("sm"),
        F.first("v", ignorenulls=True).over(upto).alias("fi"),
        F.last("v", ignorenulls=True).over(upto).alias("la"),
        F.max("v").over(prior).alias("bmx"), F.last("v", ignorenulls=True).over(prior).alias("bla"),
    )
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_ordinal(rows):
    got = ordinal(rows, ["key"], ["seq"], seq_chunk("seq", 11), "n")
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("seq")))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        map(tuple, want.collect()), key=repr)


def test_hot_key_is_spread(rows):
    """No window task holds more rows of a key than one chunk."""
    plan = ordinal(rows, ["key"], ["seq"], seq_chunk("seq", 50), "n")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key#" in text and "__chunk" in text


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(5)
    data = [("a", float(x)) for x in rng.normal(0, 100, 301)]
    data += [("b", float(x)) for x in rng.integers(0, 3, 50)] + [("c", 7.5), (None, 1.0), ("a", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r["quantile"] for r in exact_quantile(df, ["g"], "v", q).collect()}
    for g in ("a", "b", "c", None):
        want = np.quantile([v for k, v in data if k == g and v is not None], q)
        assert got[g] == pytest.approx(want)
    assert exact_quantile(df, [], "v", q).first()[0] == pytest.approx(
        np.quantile([v for _, v in data if v is not None], q))


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e12])
def test_exact_quantile_of_many_rows(spark, monkeypatch, scale):
    """More rows than a sketch holds, far more than hot groups, equal values, odd values."""
    monkeypatch.setattr(scan, "HOT_GROUPS", 2)
    rng = np.random.default_rng(8)
    n = 60_000
    g = np.where(rng.random(n) < 0.5, 0, rng.integers(0, 6, n))
    v = np.where(rng.random(n) < 0.2, 1.0, np.exp(rng.normal(0, 3, n))) * scale
    v[g == 5] = 4.0 * scale
    frame = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(frame).unionByName(
        spark.createDataFrame([(1, float("nan")), (9, float("nan")), (2, None)], "g long, v double"))
    for q in (0.0, 0.5, 0.95, 0.999, 1.0):
        got = {r.g: r.p for r in exact_quantile(df, ["g"], "v", q, "p").collect()}
        assert got == pytest.approx(frame.groupby("g").v.quantile(q).to_dict(), rel=1e-12)


def test_a_missed_rank_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(scan, "MARGIN", -0.2)
    df = spark.range(20_000).select(F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception, match="sketch missed"):
        exact_quantile(df, [], "v", 0.5).collect()


def test_quantile_starts_no_job_and_reads_twice(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS v", "'x' AS w").write.parquet(path)
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    df = exact_quantile(spark.read.schema("g long, v double, w string").parquet(path), ["g"], "v", 0.9)
    assert not status.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("other", "")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "w#" not in plan.split("Relation")[0] and "ReadSchema: struct<g:bigint,v:double>" in physical
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= 2
