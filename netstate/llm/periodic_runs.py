"""Periodic runs of words, found by splitting texts at words too rare to take part.

A run is a stretch with a smallest period q, at least max(24, 3 q) words long,
that can't be extended.  So each of its words occurs three times inside it at
least.  A word that occurs less often in the current segment belongs to no run
and splits it; what is left is counted anew until nothing splits any more.  The
neighbour of a segment is such a word, so that no run reaches beyond its segment.

Surviving segments are scanned lag by lag.  A run of period q holds three
multiples of q in a row, so only these places are compared, then the q words
behind the first two of them at once, by names of blocks: equal blocks of 2^j
words have equal numbers.  Lags that repeat a smaller one are dropped the same
way, so that a long run of one word doesn't cost a scan for each multiple.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from netstate.llm.common import text_bytes

MIN_LENGTH, TIMES = 24, 3
AT_ONCE = 64
#: How rows of planted repeats are told and made.
PLANT_EVERY, LEAST_COPIES, COPY_KINDS = 10, 3, 8


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) of words that each occur in their stretch often enough."""
    todo, out = [(0, len(ids))], []
    while todo:
        a, b = todo.pop()
        if b - a < MIN_LENGTH:
            continue
        _, at, counts = np.unique(ids[a:b], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[at] < TIMES)
        if not len(rare):
            out.append((a, b))
            continue
        edges = np.concatenate([[-1], rare, [b - a]])
        wide = np.flatnonzero(np.diff(edges) > MIN_LENGTH)
        todo += [(a + int(edges[i]) + 1, a + int(edges[i + 1])) for i in wide]
    return sorted(out)


class Names:
    """Numbers of blocks of 2^j words of one segment; equal blocks have equal numbers."""

    def __init__(self, ids: np.ndarray):
        self.levels = [ids]

    def equal(self, at: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from each place are those from the other place."""
        j = n.bit_length() - 1
        while len(self.levels) <= j:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            pairs = last[:-half] * np.int64(len(self.levels[0]) + 1) + last[half:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        level, back = self.levels[j], n - (1 << j)
        return (level[at] == level[other]) & (level[at + back] == level[other + back])


def _prime_factors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] * (n > 1)


def lag_scan(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) inside one segment."""
    ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    names, out = Names(ids), []
    for q in range(1, len(ids) // TIMES + 1):
        heads = ids[::q]
        same = heads[1:] == heads[:-1]
        at = np.flatnonzero(same[:-1] & same[1:]) * q
        if len(at):
            at = at[names.equal(at, at + q, q)]
        for prime in _prime_factors(q) if len(at) else []:
            d = q // prime
            at = at[~names.equal(at, at + d, q - d)]
        if not len(at):
            continue
        breaks = np.flatnonzero(ids[:-q] != ids[q:])
        place = np.unique(np.searchsorted(breaks, at))
        starts = np.concatenate([[-1], breaks])[place] + 1
        ends = np.concatenate([breaks, [len(ids) - q]])[place] + q
        long = ends - starts >= max(MIN_LENGTH, TIMES * q)
        out += [(s, e - s, q) for s, e in zip(
            starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text's words, by start, then period."""
    if len(words) < MIN_LENGTH:
        return []
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    found = [(a + s, n, q) for a, b in segments(ids) for s, n, q in lag_scan(ids[a:b])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds behind its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("best", _RUN),
                    ("collapsed", pa.string())])
_DDL = "struct<start: bigint, length: bigint, period: bigint>"


def find_runs(docs: DataFrame, into: str = "periodic") -> DataFrame:
    """``docs`` with a struct column of the periodic runs of their whole text.

    n_words counts the words (between blanks, tabs and line ends), runs holds
    (start, length, period) in words by start and period, best the run of the
    greatest length / period (ties: smallest start, then period; null without a
    run), collapsed the words without repeats, joined by one blank.  A null or
    empty text has no words and no runs, and its collapsed text is empty.  Rows are
    answered one by one, repeated ones alike; other columns are passed on.
    """
    def search(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            # A few texts at a time become objects: single texts may be very long.
            for at in range(0, batch.num_rows, AT_ONCE):
                part, rows = batch.slice(at, AT_ONCE), []
                for text in texts.slice(at, AT_ONCE):
                    words = text.as_py().split()
                    runs = runs_of(words)
                    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]),
                               default=None)
                    rows.append({
                        "n_words": len(words), "best": best and dict(zip(
                            ("start", "length", "period"), best, strict=True)),
                        "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs],
                        "collapsed": collapse(words, runs).decode("utf-8", "replace")})
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(part.num_columns - 1)),
                     pa.array(rows, _FOUND)], names=[*part.schema.names[:-1], into])

    kept = docs.drop(into)
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(
        f"`{into}` struct<n_words: bigint, runs: array<{_DDL}>, best: {_DDL}, "
        "collapsed: string>").fields])
    return kept.withColumn("__text", text_bytes()).mapInArrow(search, schema)


def plant_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` in which every tenth document, by the crc32 of its id, repeats its words.

    From word a = g % n on, with g a tenth of the crc32, a prefix of the rest is repeated
    three to ten times.  Texts without words and rows without a doc_id stay.
    """
    blank = "[ \t\n\x0b\f\r]+"
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = docs.withColumn("__h", h).withColumn("__words", F.when(
        F.col("__h") % PLANT_EVERY == 0,
        F.filter(F.split(F.col("text").cast("string"), blank), lambda w: w != "")))
    n, g = F.size("__words").cast("long"), F.floor(F.col("__h") / PLANT_EVERY)
    planted = planted.withColumn("__n", n).withColumn(
        "__a", F.when(F.col("__n") > 0, g % F.col("__n"))).withColumn(
        "__p", F.expr(f"1 + (__n - __a) div ({LEAST_COPIES} + "
                      f"(__h div {PLANT_EVERY}) % {COPY_KINDS})"))
    a, p = F.col("__a"), F.col("__p")

    def word(i: Column) -> Column:
        place = F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.get("__words", place.cast("int"))

    tiled = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), word), " ")
    text = F.when(F.col("__n") > 0, tiled).otherwise(F.col("text").cast("string"))
    return planted.withColumn("text", text).select(*docs.columns)
