"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_tokens import SF

import __spark_entry__ as contract
from waybill.llm.variants import near_words, one_edit, spelling_variants


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 5}


def plain_near(words):
    """Near words by the patterns that deleting or blanking one place leaves."""
    by = defaultdict(set)
    for w in words:
        by["whole", w].add(w)
        for i in range(len(w)):
            by["whole", w[:i] + w[i + 1 :]].add(w)
            by[i, w[:i] + "\0" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (kind, name), group in by.items():
        for a in group:
            for b in group:
                if a != b and (kind != "whole" or name in (a, b)) and abs(len(a) - len(b)) < 2:
                    near[a].add(b)
    return near


def plain(rows):
    n = plain_words(rows)
    near, form, out = plain_near(n), {}, {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    found = {r.word: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = plain([tuple(r) for r in rows])
    assert sum(v[0] is not None for v in want.values()) >= 20
    assert got(contract.queries()["op13_variants"](spark, SF)) == want


def test_small_subtrees_lose_nothing(spark):
    """Many subtrees, equal vectors that only parts can split, and one very frequent stem."""
    rng = random.Random(5)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(400)}  # all of equal vectors
    words |= {"".join(rng.choice("enixé÷") for _ in range(rng.randrange(6, 9))) for _ in range(900)}
    words |= {"station" + c for c in "abcdefghijklmnop"} | {"station", "stations", "x" * 3000, "x" * 2999}
    rows = [(w, rng.randrange(5, 50)) for w in sorted(words)]
    near = plain_near([w for w, _ in rows])
    n = dict(rows)
    df = spark.createDataFrame(rows, "word string, n bigint")
    for subtree in (7, 100, 4096):
        found = {r.word: (r.n_near, r.best_n, r.best) for r in near_words(df, subtree).collect()}
        want = {}
        for w in words:
            if near[w]:
                best = min(near[w], key=lambda x: (-n[x], x))
                want[w] = (len(near[w]), n[best], best)
        assert found == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "short tiny"), (None, "Kolumne kolumne " * 30), (4, "kolumnÉ " * 5),
            (4, "kolumnÉ "), (5, "columne " * 6 + "1kolumnes2 " * 400), (6, "z" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("word", F.lit("clash"))
    assert got(spelling_variants(docs)) == plain(rows)
    assert spelling_variants(docs.limit(0)).count() == 0
    assert spelling_variants(docs.filter("doc_id < 4")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=6), st.text("abé", max_size=6))
def test_one_edit(a, b):
    assert one_edit(a, b) == (distance(a, b) == 1)
