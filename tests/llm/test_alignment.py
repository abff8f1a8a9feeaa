"""Token alignment against a plain version, byte by byte."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_tokens import SF

import __spark_entry__ as contract
from waybill.llm.alignment import (Aligner, Csr, aligned, group_links, groups, overlaps,
                                   row_products, token_links)

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    """The first tokenizer by another library, the second as a whole text."""
    ranks = {base64.b64decode(a): int(b) for a, b in
             map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return (tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={}),
            sentencepiece.SentencePieceProcessor(model_file=B))


def tokens(coders, text):
    """Ids and bytes by both, or None."""
    if not text:
        return None
    a, b = coders
    a_ids, b_ids = a.encode_ordinary(" " + text), b.encode(text)
    a_raw = [a.decode_single_token_bytes(i) for i in a_ids]
    b_raw = []
    for i in b_ids:
        p = b.id_to_piece(i)
        b_raw.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
    whole = (" " + text).encode()
    return (a_ids, a_raw, b_ids, b_raw) if b"".join(a_raw) == b"".join(b_raw) == whole else None


def plain(coders, rows):
    held, out = [], []
    for doc, text in rows:
        found = tokens(coders, text)
        if found is None:
            held.append((doc, 0, 0, "", 0, Counter()))
            continue
        a_ids, a_raw, b_ids, b_raw = found
        of_a = [k for k, raw in enumerate(a_raw) for _ in raw]
        of_b = [k for k, raw in enumerate(b_raw) for _ in raw]
        links = set(zip(of_a, of_b))
        cuts = set(np.cumsum([len(x) for x in a_raw])) & set(np.cumsum([len(x) for x in b_raw]))
        parts = []
        for ids, raws in ((a_ids, a_raw), (b_ids, b_raw)):
            lists, end, part = [], 0, []
            for i, raw in zip(ids, raws):
                end += len(raw)
                part.append(str(i))
                if end in cuts:
                    lists.append(",".join(part))
                    part = []
            parts.append(lists)
        text = ";".join(f"{x}|{y}" for x, y in zip(*parts))
        held.append((doc, len(a_ids), len(b_ids), text, len(cuts),
                     Counter((a_ids[i], b_ids[j]) for i, j in links)))
    count = Counter(pair for row in held for pair in row[5])
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    for doc, n_a, n_b, text, n_groups, pairs in held:
        best = sum(n for p, n in pairs.items() if count[p] == most[p[0]])
        total = sum(n * count[p] for p, n in pairs.items())
        digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        out.append((doc, n_a, n_b, n_groups, sum(pairs.values()), best, total, digest))
    return sorted(out, key=repr)


COLS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def got(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=repr)


def test_query_equals_plain_version(spark, coders):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = plain(coders, [tuple(r) for r in rows])
    assert got(contract.queries()["op11_alignment"](spark, SF)) == want


TEXTS = [None, "", " ", "  two  spaces ", "\n\n x\ty \r\n", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ a▁b",
         "a ▁b", "日本語 テキスト 漢字", "é ​ ﻿ x y \x1c z", "😀👍🏽 ok", "don't I'll 12345 x=y",
         "word " * 5000, "x" * 20_000, "\x00 a\x00 b", "ﬁ ﬂ ① Ⅳ", "ＦＵＬＬ width", "tail  ", "a b", "a b"]


def test_odd_rows(spark, coders):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("pairs", F.lit("clash"))
    assert got(aligned(docs, A, B)) == plain(coders, rows)
    assert aligned(docs.limit(0), A, B).count() == 0
    assert got(aligned(docs.limit(2), A, B)) == plain(coders, rows[:2])


def test_links_of_whole_texts(spark, coders):
    rows = [(i, t) for i, t in enumerate(TEXTS) if not t or len(t) < 100]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    sums = {r[0]: r for r in plain(coders, rows)}
    for r in token_links(docs, A, B).collect():
        _, n_a, n_b, n_groups, n_links, *_ = sums[r.doc_id]
        assert (len(r.a_ids), len(r.b_ids), len(r.overlaps)) == (n_a, n_b, n_links)
        assert len({x.a for x in r.in_group}) == n_a and len({x.b for x in r.in_group}) == n_b
        assert {(x.a, x.b) for x in r.overlaps} <= {(x.a, x.b) for x in r.in_group}
        assert sum(x.bytes for x in r.overlaps) == (len((" " + rows_text(rows, r.doc_id)).encode()) if n_a else 0)
    assert token_links(docs.limit(0), A, B).count() == 0


def rows_text(rows, doc):
    return dict(rows)[doc]


def test_blocks_and_a_small_memory_change_nothing(coders):
    both, texts = Aligner(A, B, memo=3), [t or "" for t in TEXTS]
    assert both.cuttable
    for at in range(0, len(texts), 4):
        for text, places in zip(texts[at : at + 4], both.places(texts[at : at + 4])):
            want = tokens(coders, text)
            assert both.pieces.n_a[places].sum() == (len(want[0]) if want else 0)
            assert both.pieces.n_b[places].sum() == (len(want[2]) if want else 0)


matrices = st.lists(st.lists(st.integers(0, 5), max_size=5, unique=True), max_size=6)


def csr(rows, width):
    return Csr(np.cumsum([0, *map(len, rows)]), np.array([c for r in rows for c in r], np.int64), width)


def dense(m):
    out = np.zeros((len(m.starts) - 1, m.width), int)
    out[m.rows, m.cols] = 1
    return out


@settings(max_examples=200, deadline=None)
@given(matrices, st.lists(st.lists(st.integers(0, 3), max_size=4, unique=True), min_size=6, max_size=6))
def test_row_products(x, y):
    a, b = csr(x, 6), csr(y, 4)
    want = dense(a) @ dense(b)
    i, j, v = row_products(a, b)
    full = np.zeros_like(want)
    full[i, j] = v
    assert (full == want).all() and len(i) == np.count_nonzero(want)
    assert (dense(b.transposed()) == dense(b).T).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=8), st.lists(st.integers(1, 5), max_size=8))
def test_links_of_intervals(a, b):
    n = min(sum(a), sum(b))
    a, b = a + [sum(b) - n] * (sum(b) > n), b + [sum(a) - n] * (sum(a) > n)
    of_a, of_b = ([k for k, w in enumerate(x) for _ in range(w)] for x in (a, b))
    want = Counter(zip(of_a, of_b))
    i, j, shared = overlaps(np.array(a, np.int64), np.array(b, np.int64))
    assert dict(zip(zip(i.tolist(), j.tolist()), shared.tolist())) == want
    ga, gb = groups(np.array(a, np.int64), np.array(b, np.int64))
    i, j = group_links(ga, gb)
    assert set(zip(i.tolist(), j.tolist())) == {
        (x, y) for x in range(len(a)) for y in range(len(b)) if ga[x] == gb[y]}
    cuts = sorted(set(np.cumsum(a).tolist()) & set(np.cumsum(b).tolist()))
    assert ga.tolist() == [sum(c < e for c in cuts) for e in np.cumsum(a).tolist()]
