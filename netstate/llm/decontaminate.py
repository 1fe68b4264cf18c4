"""Passages of benchmark items inside documents: a prefix-filtered containment join.

An item is cut into windows of ten consecutive words (a shorter item is one
window); a document is hit where a whole window occurs in it.  A window holds
eight shingles of three words, and all of them must occur, so one is enough as
its prefix: the one found in the fewest documents.  Documents are scanned for
prefixes only; where one occurs, its offset in each of its windows gives the
only place for that window, which must lie inside the document, and there its
words are compared.

The benchmark is indexed in blocks of bounded size in the shared folder, and
each batch of documents meets every block, one in memory at a time.  Documents
are never shuffled, so common words, passages and large groups of copies cost
no more than others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from netstate.llm.common import (
    LOWER, UPPER, cut_lineage, new_folder, open_input, open_output, release_memory,
    text_bytes, worker_state)

WINDOW = 10
SHINGLE = 3
#: Windows of one block of the benchmark index, about 100 MB while it is used.
BLOCK_WINDOWS = 500_000
#: Words searched at a time, about 20 MB with their arrays.
BATCH_WORDS = 1 << 17
#: Bytes that are no part of a word become blanks, A-Z become a-z.
_NO_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_WORDS = bytearray(bytes.maketrans(_NO_WORD, b" " * len(_NO_WORD)))
for _a, _b in zip(UPPER, LOWER, strict=True):
    _WORDS[_a] = _b
_WORDS = bytes(_WORDS)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _codes(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` word ids, 0 where a word is unknown."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(width):
        part = ids[i:i + n]
        out = out * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
        out ^= out >> np.uint64(29)
        known &= part != 0
    out[out == 0] = 1
    return np.where(known, out, np.uint64(0))


class Block:
    """Items of the benchmark, as arrays: windows, the shingles in them, their items."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        number: dict[bytes, int] = {}
        windows: list[np.ndarray] = []
        of: list[set[int]] = []
        names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(names)}
        for name, found in items:
            ids = np.asarray([self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                              for w in found], np.int32)
            for at in range(max(1, len(ids) - WINDOW + 1)) if len(ids) else ():
                window = ids[at:at + WINDOW]
                key = window.tobytes()
                if key not in number:
                    number[key] = len(windows)
                    windows.append(window)
                    of.append(set())
                of[number[key]].add(place[name])
        self.names = names
        self.length = np.asarray([len(w) for w in windows], np.int32)
        self.ids = np.zeros((len(windows), WINDOW), np.int32)
        for i, w in enumerate(windows):
            self.ids[i, :len(w)] = w
        self.item_at = np.cumsum([0, *map(len, of)])
        self.items = np.asarray([x for s in of for x in sorted(s)], np.int32)
        self.codes = [_codes(w, min(SHINGLE, len(w))) for w in windows]

    def shingles(self) -> np.ndarray:
        """All codes of which a window may choose, in order."""
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *(
            c for c in self.codes if len(c) > 1)]))

    def choose(self, frequency: dict[int, int]) -> None:
        """Each window's prefix: its rarest shingle, the first of several."""
        offset = np.asarray([
            min(range(len(c)), key=lambda i, c=c: (frequency.get(int(c[i]), 0), i))
            for c in self.codes], np.int32)
        code = np.asarray([c[o] for c, o in zip(self.codes, offset, strict=True)], np.uint64)
        width = np.minimum(self.length, SHINGLE)
        self.prefixes = []
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            at = at[np.argsort(code[at], kind="stable")]
            codes, first = np.unique(code[at], return_index=True)
            self.prefixes.append((int(w), codes, np.append(first, len(at)), at))
        self.offset, self.codes = offset, []

    def word_ids(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int32, len(found))

    def find(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple:
        """Occurrences as (window, start) in word ids; begin and end bound each word's document."""
        windows, starts = [], []
        for width, codes, first, members in self.prefixes:
            seen = _codes(ids, width)
            slot = np.searchsorted(codes, seen)
            slot[slot == len(codes)] = 0
            at = np.flatnonzero(codes[slot] == seen) if len(codes) else slot[:0]
            slot = slot[at]
            many = first[slot + 1] - first[slot]
            which = np.repeat(first[slot] - np.cumsum(many) + many, many) + np.arange(many.sum())
            window = members[which]
            at = np.repeat(at, many)
            start = at - self.offset[window]
            inside = (start >= begin[at]) & (start + self.length[window] <= end[at])
            window, start = window[inside], start[inside]
            same = np.ones(len(window), bool)
            for i in range(WINDOW):
                there = i < self.length[window]
                word = ids[np.minimum(start + i, len(ids) - 1)]
                same &= ~there | (word == self.ids[window, i])
            windows.append(window[same])
            starts.append(start[same])
        none = np.zeros(0, np.int64)
        return (np.concatenate([none, *windows]).astype(np.int64),
                np.concatenate([none, *starts]).astype(np.int64))


def _save(block: Block, path: str) -> str:
    with open_output(path) as out:
        out.write(pickle.dumps(block.__dict__, protocol=5))
    return path


def _load(path: str) -> Block:
    """The block, kept until another one is asked for."""
    kept = worker_state("benchmark_block", dict)
    if path not in kept:
        kept.clear()
        with open_input(path) as file:
            block = Block.__new__(Block)
            block.__dict__ = pickle.loads(file.read())
        kept[path] = block
    return kept[path]


def _batches(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Row ranges of a batch with their words, about BATCH_WORDS at a time."""
    at, found, n, texts = 0, [], 0, batch.column(column)
    for i in range(batch.num_rows):
        found.append(words(texts[i].as_py()))
        n += len(found[-1])
        if n >= BATCH_WORDS:
            yield at, i + 1, found
            at, found, n = i + 1, [], 0
    if found:
        yield at, batch.num_rows, found


def _flat(block: Block, found: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.concatenate([np.zeros(0, np.int32), *map(block.word_ids, found)])
    return ids, sizes


def _document_frequency(docs: DataFrame, path: str) -> dict[int, int]:
    """In how many documents each shingle of a block occurs."""
    def count(batches):
        release_memory()  # of the stage before, in whose worker this runs
        shingles = _load(path).shingles()
        total = np.zeros(len(shingles), np.int64)
        for batch in batches:
            for _, _, found in _batches(batch, "text"):
                ids, sizes = _flat(_load(path), found)
                seen = _codes(ids, SHINGLE)
                slot = np.searchsorted(shingles, seen)
                slot[slot == len(shingles)] = 0
                at = np.flatnonzero(shingles[slot] == seen) if len(shingles) else slot[:0]
                doc = np.repeat(np.arange(len(sizes)), sizes)[at]
                pairs = np.unique(doc * len(shingles) + slot[at])
                total += np.bincount(pairs % max(1, len(shingles)), minlength=len(shingles))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({
            "code": pa.array(shingles[some].view(np.int64)), "n": pa.array(total[some])})

    # One number for each shingle of the block comes back, however many documents there are.
    counts = docs.select(text_bytes().alias("text")).mapInArrow(count, "code long, n long")
    return {r[0] % (1 << 64): r[1] for r in counts.groupBy("code").agg(F.sum("n")).collect()}


def index_benchmark(docs: DataFrame, benchmark: DataFrame,
                    block_windows: int = BLOCK_WINDOWS) -> list[str]:
    """Write the benchmark's blocks to the shared folder; their paths."""
    spark = docs.sparkSession
    named = cut_lineage(benchmark.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item"), text_bytes().alias("text")))
    size = named.agg(F.sum(F.octet_length("text")).alias("n")).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_windows)))  # a word has two bytes at least
    folder, paths = new_folder(spark, "benchmark"), []
    for i in range(blocks):
        own = named.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)
        block = Block([(r["item"], words(bytes(r["text"]))) for r in own.toLocalIterator()])
        if not len(block.length):
            continue
        raw = _save(block, f"{folder}/{i:06d}.shingles")
        block.choose(_document_frequency(docs, raw))
        paths.append(_save(block, f"{folder}/{i:06d}.block"))
    return paths


HITS = "struct<n_words: bigint, n_hit: bigint, items: array<string>, starts: array<int>, " \
       "ends: array<int>>"


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, into: str = "hits",
                   block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with a struct column of what of the benchmark occurs in their text.

    n_words counts the words of the whole text, n_hit those inside any occurrence
    of a window, items the item_ids with an occurring window (as strings, in
    order); starts and ends are the hit runs in words.  A null or empty text has
    no words and no hits.  Items without an id or without words take no part,
    repeated items count once, an empty benchmark hits nothing.  Rows are
    answered one by one, other columns are passed on.
    """
    paths = index_benchmark(docs, benchmark, block_windows)

    def search(batches):
        release_memory()  # of the stage before, in whose worker this runs
        for batch in batches:
            rows = []
            for _, _, found in _batches(batch, "__text"):
                rows += _search(paths, found)
            hits = pa.array(rows, hits_type)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), hits],
                names=[*batch.schema.names[:-1], into])

    hits_type = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    kept = docs.drop(into)
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(f"`{into}` {HITS}").fields])
    return kept.withColumn("__text", text_bytes()).mapInArrow(search, schema)


def _search(paths: list[str], found: list[list[bytes]]) -> list[dict]:
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes)
    begins, total = ends - sizes, int(sizes.sum())
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    cover = np.zeros(total + 1, np.int64)
    items: dict[int, set[str]] = {}
    for path in paths:
        block = _load(path)
        ids, _ = _flat(block, found)
        window, start = block.find(ids, begins[doc_of], ends[doc_of])
        np.add.at(cover, start, 1)
        np.add.at(cover, start + block.length[window], -1)
        for d, w in np.unique(np.stack([doc_of[start], window]), axis=1).T.tolist():
            items.setdefault(d, set()).update(
                block.names[x] for x in block.items[block.item_at[w]:block.item_at[w + 1]])
    hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    # Runs are cut at the ends of documents as well.
    step = np.diff(hit.astype(np.int8))
    out = []
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    for d, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        if d not in items:
            out.append({"n_words": b - a, "n_hit": 0, "items": [], "starts": [], "ends": []})
            continue
        near = slice(np.searchsorted(last, a, side="right"), np.searchsorted(first, b))
        starts = np.maximum(first[near], a) - a
        stops = np.minimum(last[near], b) - a
        out.append({"n_words": b - a, "n_hit": int((stops - starts).sum()),
                    "items": sorted(items[d]), "starts": starts.tolist(),
                    "ends": stops.tolist()})
    return out


def digest(items: Column) -> Column:
    """Lower-case hex SHA-256 of item_ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.sort_array(items), ",").cast("binary"), 256)
