"""Exact top-k by inner product with a table of distances to pivots.

A vector x of length |x| becomes a point (x, sqrt(M - |x|^2)), a query the point
(q, 0); with M the largest squared length, the points nearest to a query are those
with the highest inner products.  Distances from every point to a set of pivots
are computed once.  By the triangle inequality no point is nearer to a query
than the largest difference of their distances to a pivot.  Candidates are
evaluated in the order of that bound, until the bound of the next one is no
better than the k-th best score; scores are exact integers.

Points are held in blocks of bounded size, grouped by their nearest pivot, and
queries in blocks too.  Each block of queries meets each block of points: the task
that holds a block of points reads the written blocks of queries one by one, so
that queries are neither copied for each block nor sent through the driver.  What
comes out is k rows per query and block, and the best of these are the answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from netstate.llm.common import cut_lineage, open_input, per_batch

SCALE = 256.0
#: Pivots and first thresholds are taken from so many vectors at most.
FIT_VECTORS = 4_096
PIVOTS = 48
BLOCK = 2_048
QUERY_BLOCK = 256
FIRST = 32
#: Tasks that search blocks of points, at most.
TASKS = 1 << 12


def valid(column: str = "embedding"):
    """Not null, no null component, all finite."""
    c = F.col(column)
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < float("inf")))


def quantise(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 x) of each component as little-endian 64-bit integers."""
    def run(batch):
        out = [np.floor(SCALE * np.asarray(v, np.float64)) for v in batch["v"]]
        yield {"vec_id": batch["vec_id"], "v": [x.astype("<i8").tobytes() for x in out],
               "norm": [float((x * x).sum()) for x in out]}

    rows = vectors.where(F.col("vec_id").isNotNull()).where(valid()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("v"))
    return per_batch(rows, "vec_id long, v binary, norm double", run, rows=8192)


def matrix(values: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; missing components are zero."""
    out = np.zeros((len(values), width), np.int64)
    for i, v in enumerate(values):
        row = np.frombuffer(v, "<i8")
        out[i, :len(row)] = row
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is farthest from those before."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        i = int(far.argmax())
        if far[i] <= 0:
            break
        chosen.append(i)
        far = np.minimum(far, ((sample - sample[i]) ** 2).sum(1))
    return sample[chosen]


class Space:
    """The pivots, the first thresholds' vectors and the lift to points."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, longest: float):
        self.ids, self.sample, self.longest = ids, sample, longest
        self.width = sample.shape[1]
        self.pivots = choose_pivots(self.lift(sample), PIVOTS)

    def lift(self, v: np.ndarray) -> np.ndarray:
        f = v.astype(np.float64)
        rest = np.maximum(self.longest - (f * f).sum(1), 0)
        return np.concatenate([f, np.sqrt(rest)[:, None]], axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """To each pivot."""
        square = (points ** 2).sum(1)[:, None] + (self.pivots ** 2).sum(1)[None] \
            - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))


def scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0))
    if top * max(1, queries.shape[-1]) < 2 ** 53:
        return (queries.astype(np.float64) @ points.T.astype(np.float64)).astype(np.int64)
    return queries @ points.T


def _best(found: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores, then smaller ids."""
    if len(found) > 4 * k:
        edge = np.partition(found, len(found) - k)[len(found) - k]
        near = np.flatnonzero(found >= edge)
    else:
        near = np.arange(len(found))
    return near[np.lexsort((ids[near], -found[near]))[:k]]


def search_block(space: Space, query: dict, block: dict, k: int) -> dict[str, list]:
    """The k best points of a block for each query, or as many as can matter."""
    q = np.frombuffer(query["v"], "<i8").reshape(-1, space.width)
    q_ids, floor_ = np.frombuffer(query["ids"], "<i8"), np.frombuffer(query["floor"], "<f8")
    x = np.frombuffer(block["v"], "<i8").reshape(-1, space.width)
    ids = np.frombuffer(block["ids"], "<i8")
    table = np.frombuffer(block["table"], "<f8").reshape(len(ids), -1)
    to_pivots = space.distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1))
    bound = np.zeros((len(q), len(x)))
    for j in range(table.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, j, None] - table[None, :, j]), out=bound)
    # The highest score that a distance allows, with room for rounding.
    length = (q.astype(np.float64) ** 2).sum(1)
    slack = 1e-6 * (1 + space.longest + length)
    highest = (length[:, None] + space.longest - np.square(bound)) / 2 + slack[:, None]
    out = {"query_id": [], "vec_id": [], "score": []}
    for i, query_id in enumerate(q_ids.tolist()):
        order = np.flatnonzero(highest[i] >= floor_[i])
        order = order[np.argsort(-highest[i][order], kind="stable")]
        order = order[ids[order] != query_id]
        at, step, limit = 0, FIRST, floor_[i]
        got, got_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while at < len(order) and highest[i][order[at]] >= limit:
            now = order[at:at + step]
            got = np.concatenate([got, scores(q[i:i + 1], x[now])[0]])
            got_ids = np.concatenate([got_ids, ids[now]])
            keep = _best(got, got_ids, k)
            got, got_ids = got[keep], got_ids[keep]
            if len(got) == k:
                limit = max(limit, float(got[-1]))
            at, step = at + step, min(2 * step, 512)
        out["query_id"] += [query_id] * len(got)
        out["vec_id"] += got_ids.tolist()
        out["score"] += got.tolist()
    return out


def _space(points: DataFrame) -> Space | None:
    longest, width = points.agg(F.max("norm"), F.max(F.octet_length("v"))).first()
    if longest is None:
        return None
    sample = _first_by_hash(points.select("vec_id", "v"), FIT_VECTORS).toPandas()
    return Space(sample["vec_id"].to_numpy(), matrix(list(sample["v"]), width // 8),
                 float(longest))


def _first_by_hash(points: DataFrame, count: int) -> DataFrame:
    """The ``count`` rows with the least hashes of vec_id, written.

    Only rows below a bound are ordered, twice as many as wanted on average: ordering
    takes ``count`` rows of each part, which sum up to the whole table.
    """
    order, share = F.xxhash64("vec_id"), 2 * count / max(1, points.count())
    while share < 1:
        below = points.where(order < int(share * 2 ** 64) - 2 ** 63)
        first = cut_lineage(below.orderBy(order, "vec_id", "v").limit(count))
        if first.count() == count:
            return first
        share *= 4
    return cut_lineage(points.orderBy(order, "vec_id", "v").limit(count))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k best of all other vectors.

    Both have vec_id and embedding.  Components become floor(256 x); a score is
    the integer inner product, ties go to the smaller vec_id, a vector of the
    query's own id is no candidate.  Vectors (and queries) that are null, hold a
    null, NaN or infinite component or have no id take no part; shorter vectors
    count as filled up with zeros.  Rows of one id and equal vectors are one
    candidate; of different vectors under one id each is.  With fewer than k
    candidates all come back, with none the query has no row.  Products of
    components must stay within 64 bits.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    points = cut_lineage(quantise(vectors).dropDuplicates(["vec_id", "v"]))
    asked = cut_lineage(quantise(queries).dropDuplicates(["vec_id", "v"]))
    space, widest = _space(points), asked.agg(F.max(F.octet_length("v"))).first()[0]
    if space is None or widest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if widest // 8 > space.width:
        space.sample = np.pad(space.sample, ((0, 0), (0, widest // 8 - space.width)))
        space = Space(space.ids, space.sample, space.longest)

    def nearest(batch):
        table = space.distances(space.lift(matrix(batch["v"], space.width)))
        yield {"vec_id": batch["vec_id"], "v": batch["v"], "near": table.argmin(1).tolist()}

    near = cut_lineage(per_batch(points.select("vec_id", "v"), "vec_id long, v binary, near int",
                                 nearest, rows=8192))
    sizes = {r[0]: r[1] for r in near.groupBy("near").agg(F.count(F.lit(1))).collect()}
    # One entry per pivot.  A hot group is dealt to as many blocks as it needs.
    pieces = F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, -(-n // BLOCK))])
    dealt = near.select("vec_id", "v", "near", F.pmod(
        F.xxhash64("vec_id", "v"), pieces[F.col("near")]).alias("piece"))

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        v = matrix(list(rows["v"]), space.width)
        return pd.DataFrame({
            "ids": [rows["vec_id"].to_numpy("<i8").tobytes()], "v": [v.tobytes()],
            "table": [space.distances(space.lift(v)).tobytes()]})

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        v = matrix(list(rows["v"]), space.width)
        ids = rows["vec_id"].to_numpy("<i8")
        first = scores(v, space.sample).astype(np.float64)
        first[ids[:, None] == space.ids[None]] = -np.inf
        enough = first.shape[1] > k
        floor_ = np.partition(first, -k, axis=1)[:, -k] if enough else np.full(
            len(ids), -np.inf)
        return pd.DataFrame({"ids": [ids.tobytes()], "v": [v.tobytes()],
                             "floor": [floor_.astype("<f8").tobytes()]})

    n_asked = asked.count()
    deals = max(1, -(-n_asked // QUERY_BLOCK))
    query_blocks = cut_lineage(asked.select(
        "vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(deals)).alias("deal")).groupBy(
        "deal").applyInPandas(ask, "ids binary, v binary, floor binary"))
    files = query_blocks.inputFiles()

    def search(batches):
        from pyarrow import parquet

        for batch in batches:
            for block in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                for file in files:
                    with open_input(file) as opened:
                        for asked_now in parquet.ParquetFile(opened).iter_batches(1):
                            found = search_block(space, asked_now.to_pylist()[0], block, k)
                            yield pa.RecordBatch.from_pydict(
                                {n: pa.array(v, pa.int64()) for n, v in found.items()})

    # A task for each block, as far as that is sensible: each one meets all queries.
    tasks = min(TASKS, sum(-(-n // BLOCK) for n in sizes.values()))
    blocks = dealt.repartition(tasks, "near", "piece").groupBy("near", "piece").applyInPandas(
        gather, "ids binary, v binary, table binary")
    found = blocks.mapInArrow(search, "query_id long, vec_id long, score long")
    # Ranks are limited to k in each part before rows of a query meet.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
