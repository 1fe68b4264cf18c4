"""Time views over a change log: latest, as of a moment, changes, history.

A log holds one row per (key, timestamp); ``active=false`` is a deletion.
Filters on keys, namespace and time go before a view, all others after it
(``stage='pre'`` in the readers puts them before, which asks for "the last row
that was X").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netstate.operators import ordered
from netstate.operators.filters import active_only, filter_time


def tiebreak(df: DataFrame) -> list[Column]:
    """Order of rows that share key and time: active ones win, then by content."""
    rank = [F.col("active").cast("int").desc()] if "active" in df.columns else []
    return rank + [F.xxhash64(*[F.col(c) for c in df.columns]).desc()]


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order.

    ``row_number() = 1`` lets Spark keep one row per key and partition before
    the shuffle, so a key that owns a large share of the rows stays cheap.  Keys
    run from coarse to fine; the finest leads the sort, which settles most
    comparisons at once.
    """
    w = Window.partitionBy(*reversed(keys)).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    return keep_last(df, keys, [F.col("timestamp").desc(), *tiebreak(df)])


def as_of(df: DataFrame, keys: list[str], end: int) -> DataFrame:
    return latest(filter_time(df, None, end), keys)


def since(df: DataFrame, keys: list[str], start: int) -> DataFrame:
    return latest(filter_time(df, start, None), keys)


def changes(df: DataFrame, start: int, end: int) -> DataFrame:
    return filter_time(df, start, end)


def history(df: DataFrame, end: int | None = None) -> DataFrame:
    return filter_time(df, None, end)


def dedup_key_time(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (key, timestamp): raw and compacted data overlap."""
    return keep_last(df, [*keys, "timestamp"], tiebreak(df))


def resolve_view(view: str | None, start: int | None, end: int | None) -> str:
    if view == "changes":
        return "changes"
    if view in (None, "", "latest"):
        return "changes" if start is not None and end is not None and not view else "latest"
    if view != "all":
        raise ValueError(f"unknown view: {view!r}")
    return "all"


def apply_view(
    df: DataFrame, keys: list[str], view: str | None = None,
    start: int | None = None, end: int | None = None, only_active: bool = True,
) -> DataFrame:
    """Time filter, then the view, then (for latest) the tombstones."""
    kind = resolve_view(view, start, end)
    df = filter_time(df, start, end)
    if kind != "latest":
        return dedup_key_time(df, keys)
    df = latest(df, keys)
    return active_only(df) if only_active else df


def shows_active(view: str | None, start: int | None, end: int | None) -> bool:
    """``active`` is a visible column when rows of the past are shown."""
    return resolve_view(view, start, end) != "latest"


def as_of_join(
    left: DataFrame, right: DataFrame, keys: list[str], columns: list[str],
    ts: str = "timestamp", chunk_ms: int | None = ordered.HOUR_MS, prefix: str = "",
    hot_rows: int = ordered.HOT_ROWS,
) -> DataFrame:
    """For each left row, the right-hand state valid at its time.

    Both sides go into one ordered pass per key in which the last right row is
    carried forward: no range join, no pairs, and a hot key is cut into time
    chunks.
    """
    state = F.struct(F.col(ts).alias("__at"), *[F.col(c) for c in columns])
    right_rows = right.select(*keys, ts, state.alias("__state"), F.lit(0).alias("__side"))
    left_rows = left.select(*keys, ts, F.lit(1).alias("__side"),
                            F.struct(*[F.col(c) for c in left.columns]).alias("__left"))
    both = left_rows.unionByName(right_rows, allowMissingColumns=True)
    filled = ordered.fill_forward(
        both, keys, ts, {"__found": F.col("__state")}, extra_order=["__side"],
        chunk_ms=chunk_ms, hot_rows=hot_rows)
    return filled.where("__side = 1").select(
        "__left.*",
        *[F.col("__found")[c].alias(prefix + c) for c in columns],
        F.col("__found")["__at"].alias("matched_at"),
    )


def state_until_next(
    left: DataFrame, right: DataFrame, keys: list[str], columns: list[str],
    ts: str = "timestamp", window_keys: list[str] | None = None,
    chunk_ms: int | None = ordered.HOUR_MS,
) -> DataFrame:
    """Last right row up to the moment the left key changes next (open end: latest).

    Adds ``next_ts`` and the right-hand columns.
    """
    own = window_keys or keys
    timed = ordered.next_value(left, own, ts, {"next_ts": F.col(ts)}, chunk_ms=chunk_ms)
    far = F.lit((1 << 62)).cast("bigint")
    probe = timed.withColumn("__probe", F.coalesce("next_ts", far))
    state = right.withColumn("__probe", F.col(ts).cast("bigint"))
    joined = as_of_join(
        probe, state, keys, columns, ts="__probe", chunk_ms=chunk_ms)
    return joined.drop("__probe", "matched_at")


def table_info(df: DataFrame) -> DataFrame:
    """Extent of a table's history in one pass."""
    return df.agg(
        F.min("timestamp").alias("firstTime"), F.max("timestamp").alias("lastTime"),
        F.countDistinct("timestamp").alias("intervals"), F.count(F.lit(1)).alias("allRows"),
        F.countDistinct("namespace").alias("namespaceCnt"),
        F.countDistinct("hostname").alias("deviceCnt"),
    )


def uptime_ms(boot_seconds="bootupTimestamp", ts="timestamp") -> Column:
    """Time since boot in ms; devices report the boot moment in seconds."""
    return (F.col(ts) - F.col(boot_seconds) * 1000).cast("bigint")


def uptime(boot_seconds="bootupTimestamp", ts="timestamp") -> Column:
    """Time since boot as an interval."""
    return F.timestamp_millis(F.col(ts)) - F.timestamp_millis(
        (F.col(boot_seconds) * 1000).cast("bigint"))
