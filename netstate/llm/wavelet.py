"""Token ids as wavelet matrices: one compressed file per shard, read by position.

A wavelet matrix of n ids of b bits holds b planes of n bits.  Plane 0 has the
highest bit of each id in text order; below it the ids are ordered stably by
that bit, and so on.  With ranks (ones before a place) and selects (place of
the k-th one) each plane leads to the next, so that a token, the number of
times an id occurs before a place, and the place of its k-th occurrence are
found in b steps that read a few blocks of the file.

File layout: magic, length of the header (8 bytes), header (JSON: numbers and
the place and size of each block), then blocks, each compressed alone: the
documents, and per plane its bits in blocks of ``BLOCK_BITS`` and the ones
before each block.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from netstate.llm.common import (
    cut_lineage, new_folder, open_input, open_output, per_batch, text_bytes)
from netstate.llm.tokens import encoder, id_type

MAGIC = b"WAVELET1"
BLOCK_BITS = 1 << 18
SHARD_TOKENS = 1 << 22
PARTITION_TOKENS = 1 << 23


def build(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Planes (a byte per eight places, low bit first) and the zeros of each."""
    planes, zeros = [], []
    for level in range(bits - 1, -1, -1):
        ones = (ids & ids.dtype.type(1 << level)) != 0
        planes.append(np.packbits(ones, bitorder="little"))
        low = ids.take(np.flatnonzero(~ones))
        zeros.append(len(low))
        ids = np.concatenate([low, ids.take(np.flatnonzero(ones))])
    return planes, zeros


def restore(planes: list[np.ndarray], zeros: list[int], n: int, dtype) -> np.ndarray:
    """All ids in text order: the planes undone from the lowest bit up."""
    ids = np.zeros(n, dtype)
    for level, (plane, z) in enumerate(zip(reversed(planes), reversed(zeros), strict=True)):
        ones = np.unpackbits(plane, count=n, bitorder="little").view(bool)
        above = np.empty_like(ids)
        above[np.flatnonzero(~ones)] = ids[:z]
        above[np.flatnonzero(ones)] = ids[z:] | ids.dtype.type(1 << level)
        ids = above
    return ids


def write_shard(out, ids: np.ndarray, documents: dict[str, list], bits: int) -> None:
    """Write one shard: ``documents`` has doc_id (may be null) and n_tokens, in order."""
    press = zstandard.ZstdCompressor(level=1).compress
    planes, zeros = build(ids, bits)
    blocks, places, at = [], [], 0

    def put(data: bytes) -> int:
        nonlocal at
        small = press(data)
        blocks.append(small)
        places.append((at, len(small)))
        at += len(small)
        return len(places) - 1

    described = []
    for plane in planes:
        step = BLOCK_BITS // 8
        parts = [plane[i:i + step] for i in range(0, len(plane), step)]
        counts = np.cumsum([0, *(int(np.bitwise_count(p).sum()) for p in parts)], dtype="<u8")
        described.append({"bits": [put(p.tobytes()) for p in parts],
                          "ranks": put(counts.tobytes())})
    header = json.dumps({
        "bits": bits, "type": ids.dtype.str, "tokens": len(ids), "zeros": zeros,
        "planes": described, "documents": put(json.dumps(documents).encode()),
        "blocks": places}).encode()
    header = press(header)
    out.write(MAGIC + len(header).to_bytes(8, "little") + header)
    for block in blocks:
        out.write(block)


class Shard:
    """A shard file read by position; blocks are fetched when they are needed."""

    def __init__(self, file):
        self.file = file
        if file.read_at(8, 0) != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(file.read_at(8, 8), "little")
        self.unpack = zstandard.ZstdDecompressor().decompress
        head = json.loads(self.unpack(file.read_at(size, 16)))
        self.base, self.places = 16 + size, head["blocks"]
        self.bits, self.n, self.zeros = head["bits"], head["tokens"], head["zeros"]
        self.planes, self.dtype = head["planes"], np.dtype(head["type"])
        self.documents = json.loads(self._block(head["documents"]))
        self.kept: dict[int, np.ndarray] = {}

    def _block(self, number: int) -> bytes:
        at, size = self.places[number]
        return self.unpack(self.file.read_at(size, self.base + at))

    def _array(self, number: int, dtype) -> np.ndarray:
        if number not in self.kept:
            self.kept[number] = np.frombuffer(self._block(number), dtype)
        return self.kept[number]

    def _bit(self, level: int, i: int) -> int:
        block, i = divmod(i, BLOCK_BITS)
        return self._array(self.planes[level]["bits"][block], np.uint8)[i >> 3] >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before place i."""
        block, rest = divmod(i, BLOCK_BITS)
        total = int(self._array(self.planes[level]["ranks"], "<u8")[block])
        if rest:
            data = self._array(self.planes[level]["bits"][block], np.uint8)
            total += int(np.bitwise_count(data[:rest >> 3]).sum())
            if rest & 7:
                total += (int(data[rest >> 3]) & ((1 << (rest & 7)) - 1)).bit_count()
        return total

    def _place(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        ranks = self._array(self.planes[level]["ranks"], "<u8").astype(np.int64)
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK_BITS, self.n) - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        data = np.unpackbits(self._array(self.planes[level]["bits"][block], np.uint8),
                             bitorder="little")[:self.n - block * BLOCK_BITS]
        return block * BLOCK_BITS + int(np.flatnonzero(data == bit)[k - int(ranks[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, ones = int(self._bit(level, i)), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _start(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of an id start below the planes, and how many lie before i."""
        lo, hi = 0, i
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi - lo

    def rank(self, token: int, i: int) -> int:
        """How often an id occurs before place i."""
        if not 0 <= token < 1 << self.bits:
            return 0
        return self._start(token, max(0, min(i, self.n)))[1]

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        end = self.n if end is None else end
        return self.rank(token, end) - self.rank(token, start)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id, -1 if there are fewer."""
        if k < 0 or k >= self.count(token):
            return -1
        i = self._start(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            if token >> (self.bits - 1 - level) & 1:
                i = self._place(level, 1, i - self.zeros[level])
            else:
                i = self._place(level, 0, i)
        return i

    def ids(self) -> np.ndarray:
        planes = [np.frombuffer(b"".join(self._block(b) for b in p["bits"]), np.uint8)
                  for p in self.planes]
        return restore(planes, self.zeros, self.n, self.dtype)


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, row, n_tokens, ids): the ids of each whole text, then the end id."""
    dtype = id_type(vocabulary)

    def encode(batch):
        enc, tail = encoder(vocabulary), np.asarray([end_id], "<u4").tobytes()
        ids = [np.frombuffer(x + tail, "<u4").astype(dtype) for x in enc.encode(
            [t.decode("utf-8", "replace") for t in batch["text"]])]
        yield {"doc_id": batch["doc_id"], "row": batch["row"],
               "n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]}

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"), text_bytes().alias("text"))
    return per_batch(rows, "doc_id long, row long, n_tokens long, ids binary", encode)


def write_wavelets(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write documents (doc_id, text) as wavelet shards in ascending doc_id order.

    Returns the manifest (part, seq, path, n_docs, n_tokens), itself a written
    table: a file that a lost task left behind is not in it.  Shards follow
    one another by (part, seq).  A null text is empty (the end id alone), rows
    without a doc_id come first, repeated doc_ids follow one another by their
    row, an empty table has no shard; other columns are ignored.
    """
    spark = docs.sparkSession
    tokens = cut_lineage(encode_documents(docs, vocabulary, end_id))
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    folder, dtype = new_folder(spark, "wavelets"), id_type(vocabulary)
    bits = np.dtype(dtype).itemsize * 8

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, n, texts, ids = TaskContext.get().partitionId(), 0, 0, [], []

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wavelet"
            with open_output(path) as out:
                write_shard(out, np.frombuffer(b"".join(ids), dtype), {
                    "doc_id": [d for d, _ in texts], "n_tokens": [m for _, m in texts]}, bits)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "path": [path], "n_docs": pa.array([len(texts)], pa.int64()),
                "n_tokens": pa.array([n], pa.int64())})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256).to_pydict()
                for doc, m, data in zip(piece["doc_id"], piece["n_tokens"], piece["ids"],
                                        strict=True):
                    texts.append((doc, m))
                    ids.append(data)
                    n += m
                    if n >= SHARD_TOKENS:
                        yield flush()
                        seq, n, texts, ids = seq + 1, 0, [], []
        if texts:
            yield flush()

    parts = max(1, -(-total // PARTITION_TOKENS))
    ordered = tokens.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions(
        "doc_id", "row").select("doc_id", "n_tokens", "ids")
    return cut_lineage(ordered.mapInArrow(
        shards, "part int, seq int, path string, n_docs long, n_tokens long"))


def read_wavelets(manifest: DataFrame) -> DataFrame:
    """Documents of the shards: (doc_id, start, n_tokens, ids_crc32).

    start counts the ids of all documents before it, over all shards; the
    checksum is taken over the ids as little-endian unsigned 32-bit integers.
    """
    def read(batch):
        for path, before in zip(batch["path"], batch["before"], strict=True):
            with open_input(path) as file:
                shard = Shard(file)
                ids, texts = shard.ids().astype("<u4"), shard.documents
            ends = np.cumsum(texts["n_tokens"])
            starts = ends - texts["n_tokens"]
            yield {"doc_id": texts["doc_id"], "start": (starts + before).tolist(),
                   "n_tokens": texts["n_tokens"], "ids_crc32": [
                       zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]}

    # One row per part, as many as partitions were written: a small window.
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    parts = parts.select("part", (F.sum("t").over(
        Window.orderBy("part")) - F.col("t")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq"))
    shards = manifest.withColumn("within", within - F.col("n_tokens")).join(
        parts, "part").select("path", (F.col("before") + F.col("within")).alias("before"))
    n = max(1, manifest.count())
    return per_batch(shards.repartition(n), "doc_id long, start long, n_tokens long, "
                     "ids_crc32 long", read, rows=1)
