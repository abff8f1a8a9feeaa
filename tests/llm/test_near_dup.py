"""Near-duplicate classes against all pairs, and components against union-find."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.llm.components import components
from waybill.llm.near_dup import (
    idf_table, near_copies, samples, weighted, weighted_jaccard, without_near_copies,
)
from waybill.llm.queries_pairs import op4_minhash
from waybill.llm.words import runs, shingles, word_hashes


def roots_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingled(text):
    words = text.lower().split()
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else Counter()


def brute(rows):
    """Classes by all pairs, with exact document frequencies."""
    bags = {d: shingled(t or "") for d, t in rows}
    df = Counter(s for b in bags.values() for s in b)
    n = sum(1 for b in bags.values() if b)
    idf = lambda s: 1 + 0.25 * np.log(n / df[s]) / max(1e-9, np.log(max(2, n)))
    w = {d: {s: c * idf(s) for s, c in b.items()} for d, b in bags.items()}
    links, texts = [], dict(rows)
    ids = sorted(w)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (texts[a] or "") == (texts[b] or ""):
                links.append((a, b))
            elif w[a] and w[b]:
                shared = sum(min(v, w[b][s]) for s, v in w[a].items() if s in w[b])
                total = sum(w[a].values()) + sum(w[b].values()) - shared
                if shared / total >= 0.8:
                    links.append((a, b))
    return roots_of(ids, links)


def test_word_hashes():
    text = "a bb\tccc\x0b a  é\nbb x " + "y" * 70_000 + " y"
    words = text.encode().split()
    got = word_hashes(text.encode()).tolist()
    assert len(got) == len(words) and len(set(got)) == len(set(words))
    assert all((x == y) == (u == v) for x, u in zip(got, words) for y, v in zip(got, words))
    assert [len(word_hashes(t)) for t in (b"", b" \n", b"x", b" x", b"x ")] == [0, 0, 1, 1, 1]
    h = word_hashes(b"a b c a b c")
    assert len(runs(h, 3)) == 4 and runs(h, 3)[0] == runs(h, 3)[3] and len(runs(h, 7)) == 0
    assert len(shingles("A b", 5)) == 1 and shingles("A b", 5)[0] == shingles("a B", 5)[0]


def test_samples_agree_as_often_as_similar():
    idf = idf_table(np.concatenate([np.random.default_rng(0).integers(0, 9, 1 << 20), [9]]))
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    for swaps in (2, 6, 15):
        other = list(words)
        for i in rng.sample(range(400), swaps):
            other[i] = f"o{i}"
        a, b = (weighted(" ".join(x), idf) for x in (words, other))
        same = np.mean(samples(*a, 3000) == samples(*b, 3000))
        assert abs(same - weighted_jaccard(a, b)) < 0.04


def planted(seed=7, base=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, n = [], 0
    for g in range(base):
        words = [word() for _ in range(rng.randrange(60, 160))]
        for c in range(40 if g == 0 else rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


def test_classes_equal_all_pairs(spark):
    rows = planted()
    got = {r.doc_id: r.class_id for r in near_copies(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)


def test_links_within_a_template_of_unlinked_texts(spark):
    """Every text has many partners just below the limit and one above it."""
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    template, rows = words(100), []
    for _ in range(60):
        shared = words(3)
        rows += [(len(rows) + i, " ".join(template + shared + words(8))) for i in range(2)]
    want = brute(rows)
    assert len(set(want.values())) == 60
    got = {r.doc_id: r.class_id for r in near_copies(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_op4_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in
            spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in op4_minhash(spark, sf).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(None, "a b"), (None, None), (1, None), (2, ""), (3, " \n"), (4, "x"), (5, "X "),
            (6, "q w e"), (6, "q w e"), (6, "z z z"), (7, long), (8, long + " end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("rep", F.lit(1))
    got = {(r.doc_id, r.class_id, r.kept) for r in near_copies(docs).collect()}
    assert got == {(None, None, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True),
                   (5, 4, False), (6, 6, True), (7, 7, True), (8, 7, False)}
    kept = without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == sorted(
        [(0, "a b"), (0, ""), (1, ""), (3, " \n"), (4, "x"), (6, "q w e"), (7, long)])
    assert near_copies(docs.limit(0)).count() == 0
    assert without_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7)]
    rng.shuffle(links)
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == roots_of(nodes, [x for x in links if x[0] != x[1]])
    assert len(got) == len(nodes)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
