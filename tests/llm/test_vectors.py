"""Near vectors against all pairs."""

import numpy as np
from pyspark.sql import functions as F
from test_near_dup import roots_of

from waybill.llm.vectors import near_vectors


def brute(rows):
    unit = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, np.float64) / max(map(abs, v))
            unit[i] = x / np.sqrt(x @ x)
    links = [(a, b) for a in unit for b in unit
             if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    root = roots_of([i for i, _ in rows], links)
    return {i: (sum(a == i for a, _ in links), root[i], root[i] == i) for i, _ in rows}


def test_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for size in [400, 30, 12, *[2] * 60, *[1] * 300]:
        base = rng.standard_normal(32)
        for _ in range(size):
            v = base + rng.standard_normal(32) * (0.1 if size > 1 else 0)
            rows.append((n * 7 % 5009, (v * 10.0 ** rng.integers(-3, 4)).tolist()))
            n += 1
    rows += [(6000 + i, rows[0][1]) for i in range(50)]  # equal vectors
    got = near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
    wrong = [i for i in want if want[i] != got[i]]
    assert got.keys() == want.keys() and len(wrong) <= 0.02 * len(want)
    assert all(got[i][1] >= want[i][1] for i in want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (7, [1.0, 0.0]), (8, [1e-300, 0.0]), (9, [1e300, 1e299]), (9, [1e300, 1e299]),
            (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (None, None), (11, [0.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = near_vectors(df.withColumn("dim", F.lit("clash"))).collect()
    assert len(got) == 13
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    assert [by[i] for i in (7, 8, 9)] == [(2, 7, True), (2, 7, False), (2, 7, False)]
    assert all(by[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11))
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [
        (0, None, True)] * 2
    assert near_vectors(df.limit(0)).count() == 0
