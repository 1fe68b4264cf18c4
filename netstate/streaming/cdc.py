"""Change capture: what is new, what changed and what vanished between two captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from netstate.catalog import (
    CHANGE_IGNORED_FIELDS, CHANGE_IGNORED_PER_TABLE, table_spec,
)
from netstate.operators import ordered, views
from netstate.sources import read, write

# Fixed values.
TIME_DRIFT_TOLERANCE_MS = 5_000
HYSTERESIS_FAILURES = 3
NS_HOST = ["namespace", "hostname"]


def compared_columns(df: DataFrame, table: str | None, ignore: list[str] | None) -> list[str]:
    skipped = {*CHANGE_IGNORED_FIELDS, "active", *(ignore or [])}
    if table:
        skipped |= set(CHANGE_IGNORED_PER_TABLE.get(table, []))
    return [c for c in df.columns if c not in skipped and not c.startswith("_")]


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """Hash of the compared fields; lists count as sets, null is a value of its own."""
    parts = []
    for c in sorted(columns):
        value = F.col(c)
        if isinstance(df.schema[c].dataType, T.ArrayType):
            value = F.array_sort(F.array_distinct(value))
        parts += [value, value.isNull()]
    return F.xxhash64(*parts)


def cdc_diff(
    prev: DataFrame, new: DataFrame, keys: list[str], ignore: list[str] | None = None,
    table: str | None = None, kind: str = "record", rewrite: DataFrame | None = None,
    deleted_at: int | None = None, prev_is_latest: bool = False,
) -> DataFrame:
    """Rows to append: additions and changes as they are, vanished keys as tombstones.

    Both captures are reduced to one row per key and meet in one full join on
    the keys, so each side is shuffled once.  Hashes are compared within a key
    only.  ``rewrite`` names the (namespace, hostname) pairs of which every row
    is written again (restarted devices).  Tombstones of a host share one
    timestamp: that of its new rows, else ``deleted_at``.  ``prev_is_latest`` says
    that ``prev`` already has one row per key.
    """
    cols = [c for c in compared_columns(new, table, ignore) if c in prev.columns]
    names = new.columns
    old = prev.where("active")
    if not prev_is_latest:
        old = views.latest(old, keys)
    now = views.latest(new, keys)
    old_side = old.select(
        *keys, F.struct(*[F.col(c) for c in old.columns]).alias("__old"),
        row_hash(old, cols).alias("__old_hash"))
    new_side = now.select(
        *keys, F.struct(*[F.col(c) for c in names]).alias("__new"),
        row_hash(now, cols).alias("__new_hash"))
    both = old_side.join(new_side, keys, "full")
    changed = F.col("__old_hash").isNull() | (F.col("__old_hash") != F.col("__new_hash"))
    if kind == "counters":
        changed = F.lit(True)
    if rewrite is not None:
        again = rewrite.select(*NS_HOST).distinct().withColumn("__again", F.lit(True))
        both = both.join(again, NS_HOST, "left")
        changed = changed | F.coalesce("__again", F.lit(False))
    adds = both.where(F.col("__new").isNotNull() & changed).select("__new.*")
    gone = both.where("__new is null").select("__old.*")
    moments = now.groupBy(*NS_HOST).agg(F.min("timestamp").alias("__at"))
    fallback = F.lit(deleted_at).cast("bigint") if deleted_at is not None else F.col("timestamp")
    tombs = gone.join(moments, NS_HOST, "left").withColumns({
        "active": F.lit(False), "timestamp": F.coalesce("__at", fallback)}).drop("__at")
    return adds.unionByName(tombs.select(*[c for c in names if c in tombs.columns]),
                            allowMissingColumns=True).select(*names)


def restarted_devices(prev: DataFrame, boots: DataFrame) -> DataFrame:
    """(namespace, hostname, boot) of devices whose boot time is not the stored session.

    ``boots`` has (namespace, hostname, boot) in epoch ms; up to five seconds
    of drift are the same session.
    """
    sessions = prev.where("active").groupBy(*NS_HOST).agg(
        F.max("deviceSession").alias("__session"))
    df = boots.join(sessions, NS_HOST, "left")
    drift = F.abs(F.col("boot") - F.coalesce("__session", F.lit(0)))
    return df.where(drift > TIME_DRIFT_TOLERANCE_MS).drop("__session")


def stamp_sessions(rows: DataFrame, prev: DataFrame, boots: DataFrame) -> DataFrame:
    """Session of each written row: the new boot time after a restart, else the stored one."""
    sessions = prev.where("active").groupBy(*NS_HOST).agg(
        F.max("deviceSession").alias("__session"))
    restarted = restarted_devices(prev, boots)
    return (
        rows.drop("deviceSession").join(sessions, NS_HOST, "left")
        .join(restarted, NS_HOST, "left")
        .withColumn("deviceSession", F.coalesce("boot", "__session", F.lit(0)).cast("bigint"))
        .drop("boot", "__session"))


def failure_streaks(polls: DataFrame, keys: list[str] | None = None,
                    chunk_ms: int | None = ordered.HOUR_MS,
                    hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """Add ``streak`` (failures in a row up to this poll) and ``commit``.

    One or two failures in a row are not committed; the third is, and counts as
    an empty answer.  The first poll of a service is always committed.
    """
    keys = keys or [*NS_HOST, "service"]
    good = F.col("status").isin(0, 200)
    first = F.col("__n") == 1

    def number(part: DataFrame, **how) -> DataFrame:
        counted = ordered.running_sum(part, keys, "timestamp", F.lit(1), "__n", **how)
        # The first poll does not start a streak.
        return ordered.fill_forward(
            counted, keys, "timestamp", {"__last_ok": F.when(good | first, F.col("__n"))}, **how)

    df = ordered.by_heat(
        polls, keys, hot_rows, chunk_ms, lambda part: number(part, chunk_ms=None),
        lambda part: number(part, chunk_ms=chunk_ms, hot_rows=0))
    return df.withColumn(
        "streak", (F.col("__n") - F.col("__last_ok")).cast("bigint")
    ).withColumn(
        "commit", first | ~F.col("streak").between(1, HYSTERESIS_FAILURES - 1)
    ).drop("__n", "__last_ok")


def continued_streaks(polls: DataFrame, before: DataFrame) -> DataFrame:
    """``failure_streaks`` of some polls of hosts that go on from earlier ones.

    ``polls`` has (namespace, hostname, timestamp, ok), few per host; ``before``
    the streak of each host after its last earlier poll.
    """
    order = Window.partitionBy(*NS_HOST).orderBy("timestamp")
    df = polls.join(before.select(*NS_HOST, F.col("streak").alias("__before")), NS_HOST, "left")
    first = F.col("__before").isNull() & (F.col("__n") == 1)
    df = df.withColumn("__n", F.row_number().over(order))
    reset = F.max(F.when(F.col("ok") | first, F.col("__n"))).over(order)
    streak = F.when(reset.isNotNull(), F.col("__n") - reset).otherwise(
        F.col("__before") + F.col("__n"))
    return df.withColumn("streak", streak.cast("bigint")).withColumn(
        "commit", ~F.col("streak").between(1, HYSTERESIS_FAILURES - 1)).drop("__n", "__before")


def store_changes(spark: SparkSession, root: str, table: str, snapshot: DataFrame,
                  boots: DataFrame | None = None, polled: DataFrame | None = None,
                  deleted_at: int | None = None) -> DataFrame:
    """Diff a capture of some hosts against the stored state and append the changes.

    Only hosts in ``polled`` (by default those with rows in the capture) are
    compared, so hosts that were not asked do not vanish.  If ``polled`` has a
    column ``commit`` (``failure_streaks``), hosts where it is false are left as
    they are: their poll failed for the first or second time in a row.
    """
    spec = table_spec(table)
    new = write.conform_for_write(snapshot, table)
    if polled is not None and "commit" in polled.columns:
        polled = polled.where("commit")
        new = new.join(polled.select(*NS_HOST).distinct(), NS_HOST, "left_semi")
    hosts = (polled if polled is not None else new).select(*NS_HOST).distinct()
    log = read.read_log(spark, root, table)
    prev = views.latest(log.join(hosts, NS_HOST, "left_semi"), spec.keys)
    rewrite = restarted_devices(prev, boots) if boots is not None else None
    rows = cdc_diff(prev, new, spec.keys, table=table, kind=spec.kind, rewrite=rewrite,
                    deleted_at=deleted_at, prev_is_latest=True)
    if boots is not None:
        rows = stamp_sessions(rows, prev, boots)
    # The write below lands in the directory this plan reads: settle it first.
    from netstate.session import cut_lineage

    rows = cut_lineage(rows)
    write.write_raw(rows, root, table)
    return rows
