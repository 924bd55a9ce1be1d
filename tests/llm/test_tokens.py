"""Token files: exact round trips, counts, and their awkward cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, empty, words
from hypothesis import given, settings
from hypothesis import strategies as st

from verisheaf.llm import range_coder as C
from verisheaf.llm.common import stage_path
from verisheaf.llm.token_counts import count_tokens, flat_blocks, write_flat
from verisheaf.llm.token_output import pack_segment, read_tokens, unpack_segment, write_tokens
from verisheaf.llm.tokens import WordEncoder, default_tokenizer


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=200), st.sampled_from([1, 7, 64]))
def test_round_trip(ids, block):
    ids = np.array(ids, dtype=np.uint32)
    assert (C.decode_blocks(C.encode_blocks(ids, block)) == ids).all()


def test_repeats_cost_little():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    blocks = C.encode_blocks(ids)
    assert (C.decode_blocks(blocks) == ids).all() and sum(map(len, blocks)) < len(ids) / 4


def test_blocks_stand_alone_and_are_checked():
    ids = np.random.default_rng(1).integers(0, 3000, 10_000).astype(np.uint32)
    blocks = C.encode_blocks(ids)
    assert len(blocks) == 3 and (C.decode_blocks(blocks[1:2]) == ids[4096:8192]).all()
    broken = bytearray(blocks[0])
    broken[-100] ^= 1
    with pytest.raises(ValueError):
        C.decode_blocks([bytes(broken)])


def test_segment():
    lengths, ids = np.array([3, 1, 6]), np.arange(10, dtype=np.uint32)
    a, b = unpack_segment(pack_segment(lengths, ids))
    assert (a == lengths).all() and (b == ids).all()
    with pytest.raises(ValueError):
        unpack_segment(b"nothing of the kind")


def test_words_are_encoded_as_whole_texts():
    e = WordEncoder(default_tokenizer())
    texts = ["", None, "a b", "x <|endoftext|> y", "a　b ć d ́e", "ΣΑΣ it's don't", "naïve​x", "  lead", "İstanbul", "a\x0bb\x0cc", "\x1ca\x1db", "\U0001f600 z", words(500, 1)]
    ids, ends = e.encode(pa.array(texts, pa.string()), 1)
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1] - 1].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids and ids[ends[i + 1] - 1] == 1


def expected(rows, plain=False):
    e = WordEncoder(default_tokenizer(), plain)
    return [(r.doc_id, e.tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in rows]


def test_token_files(spark):
    df = awkward(spark)
    path = stage_path(spark, "test-tokens")
    write_tokens(df, path)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_tokens(spark, path).collect()), key=lambda x: x[0])
    want = {}
    for doc_id, ids in expected(df.collect()):
        want.setdefault(doc_id, []).append((len(ids) + 1, zlib.crc32(np.array([*ids, 1], dtype="<u4").tobytes())))
    assert [g[1] for g in got] == sorted((r.doc_id for r in df.collect()), key=lambda x: (x is not None, x))
    at = 0
    for start, doc_id, n, crc in got:
        assert start == at and (n, crc) in want[doc_id]
        at += n
    path = stage_path(spark, "test-tokens")
    write_tokens(empty(spark), path)
    assert read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("block_bytes", [2, 64, 1 << 20])
def test_flat_counts(spark, block_bytes):
    df = awkward(spark).where("doc_id <> 7 or doc_id is null") if block_bytes < 1000 else awkward(spark)
    path = stage_path(spark, "test-flat")
    files = write_flat(df, path, file_bytes=4000)
    counts = {(r.file, r.doc_in_file): r for r in count_tokens(flat_blocks(spark, path, files, block_bytes)).collect()}
    got = sorted(((d is not None, d, counts[f.file, i].n_tokens) for f in files.collect() for i, d in enumerate(f.doc_ids)), key=repr)
    assert got == sorted(((d is not None, d, len(ids) + 1) for d, ids in expected(df.collect(), True)), key=repr)
    assert all(r.whole for r in counts.values())


def test_separator_scan(spark):
    """Documents across blocks, blocks without an end, a rest without one, an empty file."""
    make = lambda *ids: bytearray(np.array(ids, dtype="<u2").tobytes())
    rows = [("a", 0, make(1, 2)), ("a", 1, make(3, 4)), ("a", 2, make(9, 5)), ("a", 3, make(9, 9)), ("a", 4, make(7)), ("b", 0, make()), ("c", 0, make(9)), ("d", 0, None)]
    df = spark.createDataFrame(rows, "file string, block int, data binary")
    got = sorted((r.file, r.doc_in_file, r.start, r.n_tokens, r.whole) for r in count_tokens(df, 9).collect())
    assert got == [("a", 0, 0, 5, True), ("a", 1, 5, 2, True), ("a", 2, 7, 1, True), ("a", 3, 8, 1, False), ("c", 0, 0, 1, True)]
    assert count_tokens(df.where("false"), 9).count() == 0
    with pytest.raises(Exception, match="whole number"):
        count_tokens(spark.createDataFrame([("a", 0, bytearray(b"abc"))], df.schema), 9).collect()


def test_frequent_words_are_remembered(monkeypatch):
    """Where there are more different words than an encoder remembers, only the rare ones are encoded again."""
    e = WordEncoder(default_tokenizer(), remembered=400)
    often = " ".join(f"{a}{b}" for a in "bcdfghjklm" for b in ("are", "ist!", "ONE", "über,", "42"))
    texts = [f"{often} " + " ".join(f"{a}{b}{c}" for b in "aeiou" for c in "bcdfghjklmnpqrst") for a in "bcdfghjklmnpqrstvw"]
    seen = []
    monkeypatch.setattr(e, "_ids", lambda words, get=e._ids: seen.append(" ".join(words).split()) or get(words))
    for t in texts:
        ids, _ = e.encode(pa.array([t]), 1)
        assert ids[:-1].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    assert len(e.known) <= 400 and sum(w.count("bare") for w in seen) == 1


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 64, 65, 4095, 4096, 4097, 12_289])
@pytest.mark.parametrize("kinds", [1, 2, 300, 1 << 32])
def test_blocks_of_any_length(n, kinds):
    """Few and many different ids, skewed and even, around the steps at which the coder learns; decoded in any company."""
    draw = np.random.default_rng(n)
    for ids in (draw.integers(0, kinds, n), draw.integers(0, kinds, n) // draw.integers(1, 9, n) ** 4, np.minimum(draw.geometric(0.3, n), kinds - 1)):
        ids = ids.astype(np.uint32)
        blocks = C.encode_blocks(ids)
        assert (C.decode_blocks(blocks) == ids).all()
        assert (C.decode_blocks(blocks[::-1]) == np.concatenate([ids[i : i + C.BLOCK] for i in range(0, n, C.BLOCK)][::-1])).all()
    with pytest.raises(ValueError):
        C.encode_blocks(ids, C.MOST + 1)
