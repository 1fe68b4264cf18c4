"""Ordered operators (previous, next, running sum, fill) that survive a hot key.

A window over one key runs in one task.  Keys with few rows get just that: one
shuffle, one window.  The time line of a hot key is cut into chunks: the window
runs inside a chunk, one summary row per (key, chunk) is carried to its
neighbours, and the carry is joined back; its rows are shuffled once, by (key,
chunk).  Which keys are hot is counted first, over the key columns alone and
combined before the shuffle.  ``hot_rows=0`` chunks every key without counting;
``chunk_ms=None`` gives the plain window, for time lines known to be short.
A null key is a key of its own, and both forms answer alike for any rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from netstate.session import estimated_bytes

HOUR_MS = 3_600_000
# Rows of one key that a single task may order.
HOT_ROWS = 5_000_000
# Inputs of a smaller estimated size are not counted: one task can order all of it.
SMALL_BYTES = 32 << 20
# Hot keys that are told apart by a lookup; with more of them all keys are chunked.
MAX_HOT_KEYS = 10_000


def by_heat(df: DataFrame, keys: list[str], hot_rows: int, chunk_ms: int | None,
            plain: Callable[[DataFrame], DataFrame],
            chunked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``plain`` for cold keys, ``chunked`` for hot ones; the keys are counted once.

    Several ordered steps in a row share one count and, on cold keys, one
    shuffle when they are put into the two functions together.
    """
    if chunk_ms is None:
        return plain(df)
    if not hot_rows:
        return chunked(df)
    if hot_rows >= HOT_ROWS and estimated_bytes(df) <= SMALL_BYTES:
        return plain(df)
    heat = df.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys)
    found = heat.limit(MAX_HOT_KEYS + 1).collect()
    if not found:
        return plain(df)
    if len(found) > MAX_HOT_KEYS:
        return chunked(df)
    listed = F.broadcast(df.sparkSession.createDataFrame(found, heat.schema))
    hot = _join_null_safe(df, listed, keys, "left_semi")
    cold = _join_null_safe(df, listed, keys, "left_anti")
    return plain(cold).unionByName(chunked(hot))


def _join_null_safe(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equality join in which null keys meet; ``other`` gives its columns but the keys."""
    named = other.select(*[
        F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in other.columns])
    same = reduce(lambda a, b: a & b, [
        F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return df.join(named, same, how).drop(*[f"__k_{k}" for k in keys])


def _order(ts: str, extra: list[str] | None, descending: bool = False) -> list[Column]:
    cols = [F.col(c) for c in [ts, *(extra or [])]]
    return [c.desc() if descending else c.asc() for c in cols]


def _chunked(df: DataFrame, ts: str, chunk_ms: int) -> DataFrame:
    return df.withColumn("__chunk", F.expr(f"`{ts}` div {chunk_ms}"))


def _carry_back(df: DataFrame, keys: list[str], carried: DataFrame) -> DataFrame:
    """Join carries by (key, chunk), which is how the rows are already partitioned."""
    return _join_null_safe(df, carried, [*keys, "__chunk"], "left")


def _neighbour(
    df: DataFrame, keys, ts, values: dict[str, Column], extra_order, chunk_ms, hot_rows,
    forward: bool,
) -> DataFrame:
    shift = F.lead if forward else F.lag

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*reversed(keys)).orderBy(*_order(ts, extra_order))
        return part.select("*", *[shift(c).over(w).alias(n) for n, c in values.items()])

    def chunked(part: DataFrame) -> DataFrame:
        packed = F.struct(*[c.alias(n) for n, c in values.items()])
        rows = _chunked(part, ts, chunk_ms).withColumn("__v", packed)
        inside = Window.partitionBy(*keys, "__chunk").orderBy(*_order(ts, extra_order))
        order = F.struct(*[F.col(c) for c in [ts, *(extra_order or [])]])
        edge = F.min_by if forward else F.max_by
        edges = rows.groupBy(*keys, "__chunk").agg(edge("__v", order).alias("__edge"))
        across = Window.partitionBy(*keys).orderBy("__chunk")
        carried = edges.select(*keys, "__chunk", shift("__edge").over(across).alias("__in"))
        rows = rows.withColumn("__near", shift("__v").over(inside))
        joined = _carry_back(rows, keys, carried).withColumn(
            "__got", F.coalesce("__near", "__in"))
        return joined.select(
            *[F.col(c) for c in df.columns],
            *[F.col("__got")[n].alias(n) for n in values])

    return by_heat(df, keys, hot_rows, chunk_ms, plain, chunked)


def previous_value(df, keys, ts, values, extra_order=None, chunk_ms=HOUR_MS,
                   hot_rows=HOT_ROWS) -> DataFrame:
    """Add each value as it was on the key's previous row (null on the first)."""
    return _neighbour(df, keys, ts, values, extra_order, chunk_ms, hot_rows, forward=False)


def next_value(df, keys, ts, values, extra_order=None, chunk_ms=HOUR_MS,
               hot_rows=HOT_ROWS) -> DataFrame:
    """Add each value as it is on the key's next row (null on the last)."""
    return _neighbour(df, keys, ts, values, extra_order, chunk_ms, hot_rows, forward=True)


def running_sum(
    df: DataFrame, keys: list[str], ts: str, value: Column, name: str,
    extra_order: list[str] | None = None, chunk_ms: int | None = HOUR_MS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the sum of ``value`` from the key's first row to this one (null while all are null)."""
    span = (Window.unboundedPreceding, Window.currentRow)

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*reversed(keys)).orderBy(*_order(ts, extra_order))
        return part.withColumn(name, F.sum(value).over(w.rowsBetween(*span)))

    def chunked(part: DataFrame) -> DataFrame:
        rows = _chunked(part, ts, chunk_ms).withColumn("__v", value)
        inside = Window.partitionBy(*keys, "__chunk").orderBy(
            *_order(ts, extra_order)).rowsBetween(*span)
        totals = rows.groupBy(*keys, "__chunk").agg(F.sum("__v").alias("__total"))
        before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(
            Window.unboundedPreceding, -1)
        carried = totals.select(*keys, "__chunk", F.sum("__total").over(before).alias("__in"))
        rows = rows.withColumn("__near", F.sum("__v").over(inside))
        joined = _carry_back(rows, keys, carried)
        return joined.select(
            *[F.col(c) for c in df.columns],
            F.coalesce(F.col("__near") + F.col("__in"), "__near", "__in").alias(name))

    return by_heat(df, keys, hot_rows, chunk_ms, plain, chunked)


def fill_forward(
    df: DataFrame, keys: list[str], ts: str, values: dict[str, Column],
    extra_order: list[str] | None = None, chunk_ms: int | None = HOUR_MS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add each value as last seen non-null on the key's rows up to this one."""
    span = (Window.unboundedPreceding, Window.currentRow)

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*reversed(keys)).orderBy(
            *_order(ts, extra_order)).rowsBetween(*span)
        return part.select(
            "*", *[F.last(c, ignorenulls=True).over(w).alias(n) for n, c in values.items()])

    def chunked(part: DataFrame) -> DataFrame:
        rows = _chunked(part, ts, chunk_ms)
        inside = Window.partitionBy(*keys, "__chunk").orderBy(
            *_order(ts, extra_order)).rowsBetween(*span)
        order = F.struct(*[F.col(c) for c in [ts, *(extra_order or [])]])
        ends = rows.groupBy(*keys, "__chunk").agg(*[
            F.max_by(c, F.when(c.isNotNull(), order)).alias(f"__e_{n}")
            for n, c in values.items()])
        before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(
            Window.unboundedPreceding, -1)
        carried = ends.select(*keys, "__chunk", *[
            F.last(f"__e_{n}", ignorenulls=True).over(before).alias(f"__in_{n}")
            for n in values])
        near = rows.select("*", *[
            F.last(c, ignorenulls=True).over(inside).alias(f"__near_{n}")
            for n, c in values.items()])
        joined = _carry_back(near, keys, carried)
        return joined.select(
            *[F.col(c) for c in df.columns],
            *[F.coalesce(f"__near_{n}", f"__in_{n}").alias(n) for n in values])

    return by_heat(df, keys, hot_rows, chunk_ms, plain, chunked)
