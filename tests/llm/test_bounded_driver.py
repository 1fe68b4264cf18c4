"""Joins and samples that once passed through the driver: what they may send there."""

import random

from pyspark.sql import functions as F

from netstate.llm import near_copies, pivot_search, simhash
from netstate.operators import topology
from netstate.session import cut_lineage


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _steps(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_queries_meet_blocks_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "BLOCK", 20)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 6)
    monkeypatch.setattr(pivot_search, "FIT_VECTORS", 30)
    rng = random.Random(7)
    rows = [(i, [rng.randrange(-9, 9) / 4 for _ in range(6)]) for i in range(150)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = pivot_search.top_k(frame, frame.where("vec_id % 5 = 0"), 3)
    # Queries repeated for each block are larger than any estimate of theirs.
    assert "Join" not in _plan(found) and "Generate" not in _plan(found)
    want = []
    for q, v in rows[::5]:
        scored = sorted((-int(sum(int(256 * a) * int(256 * b) for a, b in zip(v, w, strict=True))), i)
                        for i, w in rows if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:3], 1)]
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == want


def test_a_sample_orders_few_rows(spark):
    points = spark.range(20_000).select(
        F.col("id").alias("vec_id"), F.col("id").cast("string").cast("binary").alias("v"))
    want = [r.vec_id for r in points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(50).collect()]
    first = pivot_search._first_by_hash(points, 50)
    got = [r.vec_id for r in first.orderBy(F.xxhash64("vec_id"), "vec_id").collect()]
    assert got == want
    few = pivot_search._first_by_hash(points.limit(40), 50)
    assert few.count() == 40


def test_variants_of_fingerprints_are_not_broadcast(spark):
    prints = cut_lineage(spark.createDataFrame([(0,), (1,), (7,), (15,), (1 << 40,)], "fp long"))
    found = simhash.links(prints)
    assert "Broadcast" not in _steps(found) and "SortMergeJoin" in _steps(found)
    values = [0, 1, 7, 15, 1 << 40]
    want = [(a, b) for i, a in enumerate(values) for b in values[i + 1:]
            if bin(a ^ b).count("1") <= 3]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_exploded_nodes_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topology, "NODE_BYTES", 0)
    rows = cut_lineage(spark.createDataFrame([(1, 5), (1, 5), (2, 6), (3, 7)], "node long, x int"))
    pairs = cut_lineage(spark.createDataFrame([(1, 2), (1, 9)], "a long, b long"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    found = near_copies._sets(rows, ends, "x")
    assert "Broadcast" not in _steps(found)
    assert sorted(map(tuple, found.collect())) == [(1, 5), (2, 6)]


def test_numbers_of_many_nodes_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topology, "NODE_BYTES", 64 << 10)
    edges = spark.range(0, 60_000, 3).select(
        F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = topology.connected_components(edges, [])
    assert "Broadcast" not in _steps(found)
    assert found.count() == 40_000
    assert found.where("component != node - node % 3").count() == 0
