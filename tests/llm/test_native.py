"""Quality rules and mixing: plain versions and odd rows."""

import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waybill.llm.mixing import mix, mixing_plan, water_fill, with_copies
from waybill.llm.quality import RULES, Rule, any_fails, measured, quality_filter, verdict


def counts(text):
    words = (text or "").encode().split()
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            inside.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(inside))


TEXTS = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x", "a b\na b\n\na b \né ç",
         "# $% a|b", " lead\x0bing sep ", "a b c d a b c e f a b c", "\n".join(["same line"] * 40),
         "w " * 20_000, "nbsp stays one", "v1 v2\r\nv1 v2\r\n"]


def test_measures_equal_plain_counts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    q = F.col("quality")
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r[0]: tuple(r[1:]) for r in
           measured(docs).select("doc_id", *[q[c] for c in cols]).collect()}
    assert got == {i: counts(t) for i, t in enumerate(TEXTS)}


def test_quality_filter_rows_and_columns(spark):
    good = " ".join(f"the word{i}" for i in range(40))
    rows = [(1, good, "n"), (1, good, "n"), (None, good, None), (2, None, "x"), (3, "# " * 80, "y"),
            (4, "short", "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, `n_words.x` string")
    docs = docs.withColumn("__words", F.lit(1))
    kept = quality_filter(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [1, 1, None]
    assert quality_filter(docs.limit(0)).count() == 0
    names = measured(docs).select(verdict(F.col("quality"), RULES).alias("v")).collect()
    assert "symbols" in names[4].v and names[0].v == []
    only = measured(docs).filter(any_fails(F.col("quality"), (Rule("r", "n_words", low=2),)))
    assert sorted(r.doc_id for r in only.collect()) == [2, 4]


def test_long_text_is_filtered_in_linear_time(spark):
    """Counts under a filter are computed once: not again for every window."""
    rows = [(n, " ".join(f"the w{i}" for i in range(n))) for n in (200, 20_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    began = time.perf_counter()
    assert sorted(r.doc_id for r in quality_filter(docs).collect()) == [200, 20_000]
    assert measured(docs).filter("quality.n_words > 1000").count() == 1
    assert time.perf_counter() - began < 20
    plan = quality_filter(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1


def filled(sizes, weights, cap=3):
    """Targets by repeated clamping and resharing."""
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full and weights[i] > 0]
        share = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / share > cap * sizes[i]] if share else []
        for i in free:
            target[i] = left * weights[i] / share
        for i in full:
            target[i] = float(cap * sizes[i])
        if not over:
            return target
        full.update(over)


@pytest.mark.parametrize(
    ("sizes", "weights"),
    [([100, 100, 100], [1, 2, 3]), ([1, 100, 1000], [5, 1, 1]), ([1, 2, 3, 1000], [9, 9, 9, 1]),
     ([0, 10, 20], [3, 1, 1]), ([10, 10], [0, 1]), ([5], [2]), ([0, 0], [1, 1]),
     ([7, 7, 7, 7, 500], [1, 2, 3, 4, 0])],
)
def test_water_fill(spark, sizes, weights):
    rows = [(f"s{i}", s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights))]
    df = spark.createDataFrame(rows, "source string, source_size bigint, weight double")
    got = {r.source: r.target for r in water_fill(df).collect()}
    for i, want in enumerate(filled(sizes, weights)):
        assert math.isclose(got[f"s{i}"], want, abs_tol=1e-9)


def test_mix_takes_what_the_plan_says(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "w " * (i * 13 % 60), "c") for i in range(3000)]
    rows += [(5000, "tiny", "a b c", "c"), (5001, "empty", None, "c"), (5001, "empty", "", "c")]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string, size string")
    plan = mixing_plan(docs)
    taken = with_copies(docs, plan).select("doc_id", "__copies", "__plan.*").collect()
    size = {i: len((t or "").split()) for i, _, t, _ in rows}
    by_source = Counter()
    for r in taken:
        assert 0 <= r["__copies"] <= 3
        by_source[r.source] += size[r.doc_id] * r["__copies"]
    for r in plan.collect():
        assert abs(by_source[r.source] - r.target) <= max(60, r.source_size / 4096)
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(
        {r.doc_id: r["__copies"] for r in taken if r["__copies"] and r.doc_id != 5001})
    assert mix(docs.limit(0)).count() == 0
    # given weights: sources without one take nothing
    weights = spark.createDataFrame([("s0", 1.0), (None, 1.0), ("s1", -2.0)], "source string, weight double")
    assert {r.source for r in mix(docs, weights).collect()} == {"s0", None}
    # a source given twice has the sum of its weights, and its documents do not double
    twice = spark.createDataFrame([("s0", 1.0), ("s0", 2.0), ("s1", 1.0)], "source string, weight double")
    got = [r.source for r in mixing_plan(docs, twice).collect() if r.target]
    once = spark.createDataFrame([("s0", 3.0), ("s1", 1.0)], "source string, weight double")
    assert mixing_plan(docs, twice).count() == mixing_plan(docs, once).count()
    assert mix(docs, twice).count() == mix(docs, once).count() and len(got) == 2
