"""Encoding, id files and packing against the tokenizer's own answers."""

import random
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waybill.llm.packing import best_fit, pack, packed_batches
from waybill.llm.queries_files import op2_token_ids, op8_packing, tokenizer_path
from waybill.llm.token_files import PerfectHash, Shard, read_ids, write_ids
from waybill.llm.tokens import Encoder
from waybill.session import scratch

SF = "/root/testdata/sf0.001"
TEXTS = [
    "", " ", "a", "The cat, sat. on\nthe mat", "two  spaces", " leading", "trailing ", "tab\tin it",
    "line \nend", "a\x1cb \x1c c", "nbsp here  x", "don't we'll", "12 345,6", "<|endoftext|> x",
    "x<|endoftext|>y z", "Ünï çödé, ßtraße!", "日本語 テスト", "a b\n\nc d.\nE f", "\n\n", "!!! ???",
    "word.\nNext,  em", "é combining", "ÿ × ÷ ª º µ", "😀 smile",
]


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def truth(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: ids_of(r.text) + [0] for r in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("memo", [1, 1 << 20])
def test_encoder_equals_library(memo):
    enc = Encoder(tokenizer_path(), memo)
    assert enc.cuttable
    rng = random.Random(5)
    parts = ["The", "cat,", "été", " ", "\n", "  ", "x.\nY", "12", " ", "'s", "\t", "!", "日本"]
    made = [" ".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(400)]
    made += ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(400)]
    for text in TEXTS + made:
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == ids_of(text), repr(text)


@pytest.mark.parametrize("memo", [2, 16, 1 << 18])
def test_encoder_equals_library_on_marks_and_line_ends(memo):
    enc = Encoder(tokenizer_path(), memo)
    rng = random.Random(6)
    parts = ["cat", "Été", " ", " ", "\n", "\n\n", "###", "***.", "<|x", "'s", "don't", "a_b", "7",
             "<|endoftext|>", "--", "\x1c", "\u3000", "\ud55c", "$$$", "|", "cat's", ">>", "\r\n"]
    made = ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(3000)]
    for text in made:
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == ids_of(text), repr(text)


def test_encoder_keeps_common_pieces_and_forgets_rare_ones():
    """A piece met all the time is encoded once, and no more pieces are held than asked for."""
    enc, learnt = Encoder(tokenizer_path(), 64), []
    token = enc._token
    enc._token = lambda word: learnt.append(word) or token(word)
    letters = "abcdefgh"
    for i in range(500):
        enc.encode("x often " + " ".join(f"r{letters[i >> 6]}{letters[i >> 3 & 7]}{letters[i & 7]}" for _ in "12"))
        assert len(enc.memo) + len(enc.memo.before) <= 64
    assert learnt.count(" often") == 1 and len(learnt) == 501


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).choice(2**62, n, replace=False).astype(np.int64)
    table = PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(n))


def test_perfect_hash_refuses_repeats():
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([3, 3], np.int64))


def test_op2_brute_force(spark, truth):
    got = {r.doc_id: r for r in op2_token_ids(spark, SF).collect()}
    assert got.keys() == truth.keys()
    start = 0
    for d in sorted(truth):
        assert (got[d].start, got[d].n_tokens) == (start, len(truth[d]))
        assert got[d].ids_crc32 == crc(truth[d])
        start += len(truth[d])


def test_id_files_odd_rows(spark):
    rows = [(None, "a b"), (None, None), (3, "x"), (3, "x"), (3, None), (-7, ""), (9, "long " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start", F.lit(1))
    manifest = write_ids(docs, scratch(spark, "t"), tokenizer_path(), shard_ids=40)
    back = sorted(read_ids(manifest).collect(), key=lambda r: r.start)
    assert [r.key for r in back] == [None, None, -7, 3, 3, 3, 9]
    want = sorted(tuple(ids_of(t) + [0]) for _, t in rows)
    assert sorted(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in back) == want
    assert [r.start for r in back] == np.cumsum([0, *[r.n_ids for r in back]])[:-1].tolist()
    shard = next(m for m in manifest.collect() if m.first_key is not None and m.last_key == 9)
    one = Shard(shard.path, shard.dtype)
    assert one.get(9).tolist() == ids_of("long " * 5000) + [0]
    assert one.get(123456) is None
    empty = write_ids(docs.limit(0), scratch(spark, "t"), tokenizer_path())
    assert read_ids(empty).count() == 0


def check_pieces(rows, truth, window=1024):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == truth.keys()
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(truth[d])
            assert p.ids_crc32 == crc(truth[d][p.start : p.start + p.length])
            at += p.length
        assert at == len(truth[d])
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(by_seq)


def test_op8_brute_force(spark, truth):
    n = check_pieces(op8_packing(spark, SF).collect(), truth)
    total = sum(map(len, truth.values()))
    assert n <= total / 1024 * 1.05 + 8


def test_best_fit_picks_tightest():
    place, offset, n = best_fit([6, 5, 4, 3, 2], 10)
    assert n == 2
    assert place == [0, 1, 0, 1, 1] and offset == [0, 0, 6, 5, 8]
    rng = random.Random(1)
    lengths = [rng.randrange(1, 65) for _ in range(3000)]
    place, offset, n = best_fit(lengths, 64)
    free = []
    for i in sorted(range(3000), key=lambda i: -lengths[i]):  # plain best fit
        fits = [c for c in free if c >= lengths[i]]
        best = min(fits) if fits else 64
        if fits:
            free.remove(best)
        assert offset[i] == 64 - best
        free.append(best - lengths[i])
    assert n == len(free)


def test_pack_hands_on_little_at_a_time():
    """Full windows are handed on while documents come, and no batch of pieces is large."""
    enc, read = Encoder(tokenizer_path()), []

    def batches():
        for d in range(6):
            read.append(d)
            texts = ["x y " * 40_000, "z"] + ["a b"] * 300
            yield pa.RecordBatch.from_pydict({"key": [d * 1000 + i for i in range(302)], "text": texts})

    seen, first, lengths = set(), None, 0
    for out in packed_batches(batches(), enc, 5, 64, 0, 512):
        first = first or len(read)
        assert 0 < out.num_rows <= 256
        ends = list(zip(out["sequence_id"].to_pylist(), out["offset"].to_pylist()))
        assert not seen & set(ends)
        seen |= set(ends)
        assert [len(x) // 4 for x in out["ids"].to_pylist()] == out["length"].to_pylist()
        lengths += sum(out["length"].to_pylist())
    assert first == 1 and min(seen) == (5, 0)
    assert lengths == 6 * (len(ids_of("x y " * 40_000)) + 1 + 2 + 300 * (len(ids_of("a b")) + 1))


def test_pack_odd_rows(spark):
    rows = [(None, None), (1, "a"), (1, "a"), (2, ""), (3, "x y " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("length", F.lit(1))
    pieces = pack(docs, tokenizer_path(), window=100, block=4).collect()
    assert sum(p.length for p in pieces) == sum(len(ids_of(t)) + 1 for _, t in rows)
    assert all(p.offset + p.length <= 100 for p in pieces)
    assert pack(docs.limit(0), tokenizer_path()).count() == 0
