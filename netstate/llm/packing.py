"""Best-fit decreasing packing of token pieces into sequences, at any scale.

Which piece goes where depends on lengths alone, and open sequences with the
same room are alike.  So the packing is planned on the number of pieces of
each length: from the longest down, a segment tree over remaining capacities
names the tightest room that still fits, and all open sequences of that room
are filled at once, as they would be one after another.  The plan is as long as
there are (length, room) pairs in use, however many pieces there are.  Pieces then find
their sequence by their number among those of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from netstate.llm.common import cut_lineage, per_batch, text_bytes
from netstate.llm.tokens import MAX_KEPT, encoder, id_type

CAPACITY = 1024
PIECE_SCHEMA = ("doc_id long, piece int, start long, length long, ids binary, ids_crc32 long,"
                " part int, k long")


class RoomTree:
    """A segment tree over capacities 0..top: the ranges of open sequences of each room."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.used = [False] * (2 * self.size)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]

    def _mark(self, room: int) -> None:
        node = room + self.size
        self.used[node] = bool(self.open[room])
        while node > 1:
            node //= 2
            self.used[node] = self.used[2 * node] or self.used[2 * node + 1]

    def add(self, room: int, first: int, count: int) -> None:
        """Sequences first .. first + count - 1 have this much room."""
        self.open[room].append((first, count))
        self._mark(room)

    def take(self, room: int, most: int) -> tuple[int, int]:
        first, count = self.open[room].pop()
        if count > most:
            self.open[room].append((first + most, count - most))
            count = most
        self._mark(room)
        return first, count

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length`` that has an open sequence."""
        node = length + self.size
        if length >= len(self.open):
            return None
        if self.used[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.used[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.size:
            node = 2 * node if self.used[2 * node] else 2 * node + 1
        return node - self.size


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """Per length: (first piece number, first sequence, offset), in piece order."""
    tree, sequences, out = RoomTree(capacity), 0, {}
    for length in sorted(counts, reverse=True):
        steps, done, n = out.setdefault(length, []), 0, counts[length]
        while done < n:
            room = tree.tightest(length)
            if room is None:
                # No open one fits any more at this length: those that will be full of
                # it are opened together, one for a smaller rest.
                new = max(1, (n - done) // (capacity // length))
                tree.add(capacity, sequences, new)
                sequences += new
                continue
            # A sequence that got a piece is now the tightest, so it takes all that fit.
            each = room // length
            full = (n - done) // each
            if not full:
                each, full = n - done, 1
            first, count = tree.take(room, full)
            for i in range(each):
                steps.append((done, first, capacity - room + i * length))
                done += count
            if room > each * length:
                tree.add(room - each * length, first, count)
    return out


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int = 2,
               capacity: int = CAPACITY, kept_chunks: int = MAX_KEPT) -> DataFrame:
    """Encoded documents cut into pieces of at most ``capacity`` tokens, as a written table.

    Columns: doc_id, piece, start, length, ids (binary, little-endian, of
    ``id_type(vocabulary)``), ids_crc32, part and k (number among the pieces of its
    length and part).  Only documents longer than the capacity are cut, so that
    the first piece takes what is over and all others are full.  ``kept_chunks`` bounds
    the memo of a worker: fewer take less memory and more time.
    """
    dtype = id_type(vocabulary)

    def cut(batch):
        enc, tail = encoder(vocabulary, kept_chunks), np.asarray([end_id], "<u4").tobytes()
        seen = counters.setdefault(TaskContext.get().taskAttemptId(), {})
        part = TaskContext.get().partitionId()
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "ids_crc32",
                               "part", "k")}
        texts = [t.decode("utf-8", "replace") for t in batch["text"]]
        for doc, data in zip(batch["doc_id"], enc.encode(texts), strict=True):
            ids = np.frombuffer(data + tail, "<u4")
            first = len(ids) % capacity or capacity
            edges = [0, *range(first, len(ids) + 1, capacity)]
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                seen[b - a] = seen.get(b - a, -1) + 1
                for name, value in (
                        ("doc_id", doc), ("piece", i), ("start", a), ("length", b - a),
                        ("ids", ids[a:b].astype(dtype).tobytes()),
                        ("ids_crc32", zlib.crc32(ids[a:b])), ("part", part),
                        ("k", seen[b - a])):
                    out[name].append(value)
        yield out

    counters: dict[int, dict[int, int]] = {}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return cut_lineage(per_batch(rows, PIECE_SCHEMA, cut))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (length, part, k and any other columns).

    Pieces are placed best-fit decreasing; sequences have no gaps.  No piece
    is moved for it but by (part, length), to learn how many of its length
    come before its part.
    """
    by_part = cut_lineage(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}
    steps = {
        length: tuple(np.asarray(c, np.int64) for c in zip(*rows, strict=True))
        for length, rows in plan(counts, capacity).items()}

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        lengths, numbers = length.to_numpy(), number.to_numpy()
        for one in np.unique(lengths):
            at = np.flatnonzero(lengths == one)
            firsts, sequences, offsets = steps[int(one)]
            step = np.searchsorted(firsts, numbers[at], side="right") - 1
            sequence[at] = sequences[step] + numbers[at] - firsts[step]
            offset[at] = offsets[step]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = by_part.select("length", "part", before.alias("__before"))
    kept = [c for c in pieces.columns if c not in ("part", "k")]
    seated = pieces.join(bases, ["length", "part"]).select(
        *kept, seat("length", F.col("k") + F.col("__before")).alias("__seat"))
    return seated.select(*kept, "__seat.sequence_id", "__seat.offset")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2,
         capacity: int = CAPACITY, kept_chunks: int = MAX_KEPT) -> DataFrame:
    """Pack documents (doc_id, text): one row per piece with its ids and its place.

    A null text is empty (the end id alone), null and repeated doc_ids are packed
    row by row, an empty table gives no pieces; other columns are ignored.
    """
    return place(cut_pieces(docs, vocabulary, end_id, capacity, kept_chunks), capacity)
