"""Repeated passages against all windows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from waybill.llm.queries_pairs import op3_substring
from waybill.llm.substring import SuffixAutomaton, without_repeats


def brute(rows, window=13):
    first = {}
    cut = [(k, (t or "").encode().split()) for k, t in rows]
    for k, words in cut:
        if k is not None:
            for i in range(len(words) - window + 1):
                w = tuple(words[i : i + window])
                first[w] = min(first.get(w, k), k)
    out = []
    for k, words in cut:
        gone = set()
        if k is not None:
            for i in range(len(words) - window + 1):
                if first[tuple(words[i : i + window])] < k:
                    gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((k, len(words), len(gone), kept.decode()))
    return sorted(out, key=repr)


def test_automaton_matches():
    rng = random.Random(2)
    for _ in range(200):
        auto, added = SuffixAutomaton(), []
        for _ in range(rng.randrange(1, 5)):
            words = [rng.randrange(3) for _ in range(rng.randrange(0, 14))]
            auto.add(words)
            added.append(words)
        query = [rng.randrange(3) for _ in range(20)]
        seen = {tuple(a[i:j]) for a in added for i in range(len(a)) for j in range(i, len(a) + 1)}
        want = [max(n for n in range(e + 2) if tuple(query[e + 1 - n : e + 1]) in seen or n == 0)
                for e in range(20)]
        assert auto.matches(query) == want


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=3))
    passages = [" ".join(word() for _ in range(rng.randrange(10, 40))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.4
                         else " ".join(word() for _ in range(rng.randrange(1, 50))))
        text = rng.choice([" ", "\n", "  \t"]).join(parts)
        rows.append((i * 37 % 1009, rows[rng.randrange(i)][1] if i and rng.random() < 0.15 else text))
    rows += [(2000, "x " * 100), (2001, "y x " * 90), (2002, "x " * 13), (2003, "x " * 12)]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 2000), (2, 5), (3, 1)])
def test_equals_all_windows(spark, seed, hot):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted((tuple(r) for r in without_repeats(docs, hot=hot).collect()), key=repr)
    assert got == brute(rows)


def test_op3_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in
            spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op3_substring(spark, sf).collect()), key=repr)
    assert got == sorted(((k, n, g, hashlib.sha256(t.encode()).hexdigest())
                          for k, n, g, t in brute(rows)), key=repr)


def test_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(None, line), (None, None), (1, None), (2, ""), (3, " \n "), (4, line), (5, line),
            (5, line), (5, "z " + line), (6, line + " é"), (7, "q " * 50_000), (8, "q " * 13)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit(1))
    got = sorted((tuple(r) for r in without_repeats(docs).collect()), key=repr)
    assert got == brute(rows)
    assert without_repeats(docs.limit(0)).count() == 0
