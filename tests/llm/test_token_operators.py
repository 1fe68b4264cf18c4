"""Wavelet shards and packing against plain encodings."""

import functools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from netstate.llm import packing, wavelet
from netstate.llm.common import open_input, small_batches, worker_state
from netstate.llm.tokens import Encoder, encoder

WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))
DOCS = [
    (3, "One two three, two one.\nThree  two\t one", "x"), (1, None, "x"), (2, "", None),
    (7, "word " * 3000, "x"), (5, "ünï çødé 中文 <|endoftext|>   x", "x"),
    (None, "no id", "x"), (9, "same", "x"), (9, "same", "x"), (9, "other", "x"),
    (11, "a <|endoftext|> b<|startoftext|>", "x"), (12, "<|startoftext|><|ENDOFTEXT|>", "x"),
]
SCHEMA = "doc_id long, text string, path string"


def ids_of(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@functools.cache
def library(path):
    return Tokenizer.from_file(path)


@functools.cache
def encoder_of(path):
    return Encoder(path)


@pytest.mark.parametrize("path", [WORDS, BYTES])
@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.lists(st.sampled_from([
    "<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "\n", "endoftext", "It's", "ÉTÉ", "9"]),
    max_size=8).map("".join), st.text(alphabet=" \n\t'ab Ssrél09½²_-.,!$| 　́​İΣß中<>", max_size=40)))
def test_word_by_word_equals_whole_text(path, text):
    known = encoder_of(path)
    plain = library(path).encode(text, add_special_tokens=False).ids
    assert known.encode([text, text]) == [np.asarray(plain, "<u4").tobytes()] * 2


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_given_ids_of_added_tokens(path):
    ids = np.frombuffer(encoder_of(path).encode(["a <|endoftext|> b"])[0], "<u4")
    assert len(ids) == {WORDS: 3, BYTES: 4}[path]


def test_a_small_memo_gives_the_same_ids_and_stays_small():
    texts = [" ".join(f"w{i * 7 + j}x" for j in range(40)) for i in range(200)]
    small = Encoder(BYTES, kept=100)
    for text in texts:
        assert small.encode([text]) == encoder_of(BYTES).encode([text])
        assert len(small.chunks) + len(small.chunks.older) <= 2 * (100 + 40)


def test_an_encoder_takes_the_place_of_what_other_stages_kept():
    worker_state("benchmark_block", dict)["block"] = [0]
    assert encoder(BYTES, 100) is encoder(BYTES, 100)
    assert worker_state("benchmark_block", dict) == {}
    assert encoder(BYTES, 100) is not encoder(BYTES, 200)


def test_small_batches_keep_a_smaller_limit(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", "1024"), ("0", "1024"), ("100", "100")):
            spark.conf.set(name, given)
            small_batches(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_wavelet_rows(spark, docs):
    encode = ids_of(WORDS)
    got = wavelet.read_wavelets(wavelet.write_wavelets(docs, WORDS)).collect()
    assert len(got) == len(DOCS)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum(
        [0, *[r.n_tokens for r in ordered]]).tolist()[:-1]
    assert [r.doc_id for r in ordered] == [None, 1, 2, 3, 5, 7, 9, 9, 9, 11, 12]
    want = sorted((str(d), len(encode(t)), crc(encode(t))) for d, t, _ in DOCS)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want


def test_wavelet_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert wavelet.read_wavelets(wavelet.write_wavelets(empty, WORDS)).count() == 0


def test_wavelet_lookups(spark, docs, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", 256)
    row = wavelet.write_wavelets(docs, WORDS).orderBy("part", "seq").first()
    with open_input(row.path) as file:
        shard = wavelet.Shard(file)
        ids = shard.ids().tolist()
        assert shard.n == row.n_tokens == len(ids)
        rng = random.Random(3)
        for i in [0, len(ids) - 1, *rng.sample(range(len(ids)), 30)]:
            assert shard.access(i) == ids[i]
            assert shard.rank(ids[i], i) == ids[:i].count(ids[i])
            assert shard.select(ids[i], ids[:i].count(ids[i])) == i
        for token in {*ids[:50], 48_000, 1 << 20}:
            assert shard.count(token) == ids.count(token)
            assert shard.count(token, 5, 20) == ids[5:20].count(token)
            assert shard.select(token, ids.count(token)) == -1


def test_several_shards(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"text number {i} " * (i % 7)) for i in range(200)], "doc_id long, text string")
    monkeypatch.setattr(wavelet, "PARTITION_TOKENS", 500)
    got = wavelet.read_wavelets(wavelet.write_wavelets(docs, WORDS)).orderBy("doc_id").collect()
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]]).tolist()[:-1]


def best_fit(lengths, capacity):
    """Item by item, best-fit decreasing."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(lengths=st.lists(st.integers(1, 12), min_size=1, max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    used = {}
    for length, steps in packing.plan(counts, 12).items():
        ends = [s[0] for s in steps[1:]] + [counts[length]]
        for (first, sequence, offset), end in zip(steps, ends, strict=True):
            for i in range(end - first):
                used.setdefault(sequence + i, []).append((offset, length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 12
    assert sorted(12 - sum(n for _, n in p) for p in used.values()) == best_fit(lengths, 12)


def test_packing_rows(spark, docs):
    encode = ids_of(BYTES)
    got = packing.pack(docs, BYTES).collect()
    want = []
    for doc, text, _ in DOCS:
        ids = encode(text)
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want += [(str(doc), i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(
            zip(edges, edges[1:], strict=False))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == \
        sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert crc(np.frombuffer(r.ids, "<u2")) == r.ids_crc32
    for places in sequences.values():
        assert [o for o, _ in sorted(places)] == np.cumsum(
            [0, *[n for _, n in sorted(places)]]).tolist()[:-1]
        assert sum(n for _, n in places) <= 1024
    assert len(sequences) == len(best_fit([w[3] for w in want], 1024))
    assert len(sequences) >= math.ceil(sum(w[3] for w in want) / 1024)


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), BYTES).count() == 0
