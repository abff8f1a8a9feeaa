"""Toxic spans: exact recursions, defined results, and accuracy on held-out labels."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tokens import SF

import __spark_entry__ as contract
from waybill.llm.toxicity import WORD, cover, fitted, marginals, toxic_scores


def paths(emission, transition):
    """Marginals and steps by all paths of one chain."""
    n, total = len(emission), 0.0
    on, steps = np.zeros(n), np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(emission[i] * s for i, s in enumerate(path))
                   + sum(transition[a, b] for a, b in zip(path, path[1:])))
        total += w
        on += w * np.array(path)
        for a, b in zip(path, path[1:]):
            steps[a, b] += w
    return on / total, steps / total


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 9, 25)
        transition = rng.standard_normal((2, 2)) * 2
        chains = [rng.standard_normal(n) * 4 for n in lengths]
        first = np.concatenate([[True] + [False] * (n - 1) for n in lengths])
        p, steps = marginals(np.concatenate(chains), first, transition, steps=True)
        want = [paths(c, transition) for c in chains]
        assert np.allclose(p, np.concatenate([w[0] for w in want]), atol=1e-9)
        assert np.allclose(steps, sum(w[1] for w in want), atol=1e-9)
    assert len(marginals(np.zeros(0), np.zeros(0, bool), transition)[0]) == 0


def test_long_chains_equal_plain_recursion():
    rng = np.random.default_rng(2)
    emission, move = rng.standard_normal(5000) * 20, np.array([[2.0, -6.0], [-3.0, 1.0]])
    p, _ = marginals(emission, np.arange(5000) == 0, move)
    e = np.clip(emission, -30, 30)
    ahead, behind = np.zeros((5000, 2)), np.zeros((5000, 2))
    ahead[0] = (0, e[0])
    for i in range(1, 5000):
        ahead[i] = np.logaddexp.reduce(ahead[i - 1][:, None] + move, axis=0) + (0, e[i])
    for i in range(4998, -1, -1):
        behind[i] = np.logaddexp.reduce(move + (0, e[i + 1]) + behind[i + 1], axis=1)
    both = ahead + behind
    assert np.allclose(p, 1 / (1 + np.exp(both[:, 0] - both[:, 1])), atol=1e-6)


def test_cover_takes_few_signs():
    toxic = [{"w vile", "b3 vil", f"w x{i}"} for i in range(6)]
    toxic += [{"b3 rot", "b4 rott", "w the", f"w y{i}"} for i in range(5)] + [{"w alone"}]
    clean = [{"w the", "b3 rot", f"w z{i}"} for i in range(50)]
    assert cover(toxic, clean, 0.2) == {"w vile", "b4 rott"}
    assert cover(toxic, [set.union(*toxic)] * 9, 0.2) == set()


def rate(rows, labels, held):
    """(recall, precision) of the predictions among labelled rows."""
    rows = [(labels[r.doc_id], r.predicted) for r in rows if r.doc_id in labels and r.held_out == held]
    hit = sum(y and p for y, p in rows)
    return hit / max(1, sum(y for y, _ in rows)), hit / max(1, sum(p for _, p in rows))


def test_held_out_accuracy(spark):
    big = SF.replace("sf0.001", "sf0.1")
    rows = contract.queries()["op12_toxicity"](spark, big).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    assert len(rows) == len(docs)
    recall, precision = rate(rows, labels, True)
    assert recall >= 0.75 and precision >= 0.88, (recall, precision)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        for s in r.spans:
            assert all(c.isalnum() for c in (docs[r.doc_id][s.start], docs[r.doc_id][s.end - 1]))
    # labels that must not be learned from change nothing
    changed = {r.doc_id: r.score for r in rows}
    part = spark.read.parquet(f"{big}/documents.parquet").limit(300)
    kept = spark.read.parquet(f"{big}/labels.parquet").filter(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    model = fitted(spark.read.parquet(f"{big}/documents.parquet"), kept)
    for r in toxic_scores(part, model).collect():
        assert r.score == pytest.approx(changed[r.doc_id], abs=1e-9)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, f"plain words number {i} are here and mild") for i in range(40)]
        + [(100 + i, f"you vile person {i} here") for i in range(20)]
        + [(200, None), (201, ""), (202, "  \n "), (203, "word " * 30_000 + "VILE"), (None, "vile"),
           (204, "so vile vile"), (204, "so mild"), (205, "İİİ vile İ")],
        "doc_id int, text string").withColumn("score", F.lit("clash"))
    rows = [(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(20)]
    rows += [(999, 1), (None, 1), (3, None), (101, 0)]
    labels = spark.createDataFrame(rows, "doc_id int, toxic int")
    model = fitted(docs, labels)
    got = toxic_scores(docs, model).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert min(by[100 + i][0].score for i in range(20)) > 0.7 > max(by[i][0].score for i in range(40))
    assert by[200][0].score == by[201][0].score == by[202][0].score < 0.5
    assert [(s.start, s.end) for s in by[203][0].spans] == [(150_000, 150_004)]
    assert by[None][0].score > 0.7 and sorted(len(r.spans) for r in by[204]) == [0, 1]
    assert by[205][0].spans[-1].end == 8  # lower case of the first letters is longer
    assert max(by[204], key=lambda r: r.score).spans[-1].end == 12
    assert toxic_scores(docs.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        assert {r.score for r in toxic_scores(docs, fitted(docs, none)).collect()} == {0.0}
    assert fitted(docs.limit(0), labels) == b""


def test_words_are_letters_or_digits():
    assert WORD.findall("don't x_y 12ab é") == ["don", "t", "x", "y", "12", "ab", "é"]
