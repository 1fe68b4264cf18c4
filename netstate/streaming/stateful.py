"""Change capture as one stateful operator: captures in, changes out, in one pass.

The state of a host is one value, its rows with their keys and hashes, on disk in
the state store (RocksDB): as large as a capture of the host, and read and written
by one call each, as every call from a Python worker is a round trip.  A micro-batch
may hold any number of captures of a host; they are applied one after another in
time order, so no round trips are made between them.  A stored table gives the state
to start from.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from netstate.catalog import table_spec
from netstate.operators import views
from netstate.sources import read, write
from netstate.streaming import cdc

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUTPUT = ("namespace string, hostname string, timestamp bigint, active boolean, silent boolean, "
          "row string")
START = "namespace string, hostname string, keys string, hashes bigint, rows string"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state on disk; running ones are not touched."""
    spark.conf.set(PROVIDER, ROCKSDB)


def _digest(entry, fields: list[T.StructField], skipped: set[str]) -> Column:
    """Hash of an entry's compared fields; lists count as sets, null is a value of its own."""
    parts = []
    for f in sorted(fields, key=lambda f: f.name):
        if f.name in skipped:
            continue
        value = entry[f.name]
        if isinstance(f.dataType, T.ArrayType):
            value = F.array_sort(F.array_distinct(value))
        parts += [value, value.isNull()]
    return F.xxhash64(*parts)


def _text(entry, names: list[str]) -> Column:
    return F.to_json(F.struct(*[entry[n].alias(n) for n in names]),
                     {"ignoreNullFields": "false"})


def captured_changes(
    captures: DataFrame, keys: list[str], table: str | None = None,
    ignore: list[str] | None = None, before: DataFrame | None = None,
    always: bool = False, silent_ms: int | None = None, delay: str = "10 minutes",
) -> DataFrame:
    """Rows to append for a stream of complete captures.

    ``captures`` has (namespace, hostname, timestamp, status, entries): one row per poll
    of a host, entries being all rows it answered with, without namespace, hostname
    and timestamp; ``keys`` names those of their fields that tell rows apart.  New and changed
    rows come out as they are, vanished ones with active=false and the time of the
    capture that lacks them.  ``always`` writes every row of every capture (counters).

    The first and second failed poll in a row (status neither 0 nor 200) change nothing,
    the third is an empty answer, and so is a host's very first poll if it failed.  A
    capture that is not newer than the last one of its host was delivered twice
    and is left out; a null status or null entries are an empty success.  Of rows
    with equal keys one stays.  ``before`` is what the table holds (latest, active rows).

    With ``silent_ms`` a host that has not been polled for so long, as the watermark
    tells, gives one row with silent=true and no values; its state stays.
    """
    spark = captures.sparkSession
    use_rocksdb(spark)
    fields = captures.schema["entries"].dataType.elementType.fields
    names = [f.name for f in fields]
    # As in ``cdc``: a batch and a stream tell changes by the same fields.
    skipped = {*cdc.CHANGE_IGNORED_FIELDS, "active", *(ignore or []),
               *(cdc.CHANGE_IGNORED_PER_TABLE.get(table, []) if table else [])}
    entries = F.coalesce("entries", F.array().cast(captures.schema["entries"].dataType))
    packed = captures.select(
        *cdc.NS_HOST, F.col("timestamp").cast("bigint").alias("timestamp"),
        F.coalesce(F.col("status").cast("bigint"), F.lit(0)).alias("status"),
        F.timestamp_millis("timestamp").alias("event_time"),
        F.transform(entries, lambda e: _text(e, keys)).alias("keys"),
        F.transform(entries, lambda e: _digest(e, fields, skipped)).alias("hashes"),
        F.transform(entries, lambda e: _text(e, names)).alias("rows"))
    if silent_ms is not None:
        packed = packed.withWatermark("event_time", delay)
    start = None
    if before is not None:
        struct = F.struct(*[F.col(n) for n in names])
        start = before.select(*cdc.NS_HOST, struct.alias("e")).select(
            *cdc.NS_HOST, _text(F.col("e"), keys).alias("keys"),
            _digest(F.col("e"), fields, skipped).alias("hashes"),
            _text(F.col("e"), names).alias("rows")).groupBy(*cdc.NS_HOST)
    # Without ``silent_ms`` no timer is set, and late captures are not cut off.
    found = packed.groupBy(*cdc.NS_HOST).transformWithStateInPandas(
        statefulProcessor=_processor(cdc.HYSTERESIS_FAILURES, always, silent_ms),
        outputStructType=OUTPUT, outputMode="Append",
        timeMode="None" if silent_ms is None else "EventTime", initialState=start)
    schema = T.StructType(fields)
    return found.withColumn("row", F.from_json("row", schema)).select(
        *cdc.NS_HOST, "timestamp", "active", "silent",
        *[F.col("row")[n].alias(n) for n in names])


def store_captured_changes(captures: DataFrame, root: str, table: str, checkpoint: str,
                           once: bool = True) -> StreamingQuery:
    """Append the changes of a stream of captures to a stored table.

    A new checkpoint starts from the stored rows.  Of a micro-batch that is run again
    rows are written twice, which every view reads as one.
    """
    spark, spec = captures.sparkSession, table_spec(table)
    fields = captures.schema["entries"].dataType.elementType.fields
    held = views.latest(read.read_log(spark, root, table), spec.keys).where("active")
    changes = captured_changes(
        captures, [k for k in spec.keys if k not in cdc.NS_HOST], table,
        before=held.select(*cdc.NS_HOST, *[F.col(f.name).cast(f.dataType) for f in fields]),
        always=spec.kind == "counters")

    def append(batch: DataFrame, number: int) -> None:
        write.write_raw(batch.where("not silent").drop("silent"), root, table)

    writer = changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _processor(limit: int, always: bool, silent_ms: int | None):
    """The processor; a local class travels by value, executors need not have this package."""
    from pyspark.sql.streaming import StatefulProcessor

    class Changes(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.host = handle.getValueState(
                "host", "streak long, last long, keys array<string>, hashes array<long>, "
                        "rows array<string>")

        def _get(self) -> tuple:
            """Failed polls in a row, time of the last poll, {key: (hash, row)}."""
            state = self.host.get()
            if state is None:
                return None, -1, {}
            streak, last, keys, hashes, found = state
            return streak, last, dict(zip(keys, zip(hashes, found, strict=True), strict=True))

        def _put(self, streak, last, held: dict) -> None:
            self.host.update((streak, last, list(held), [h for h, _ in held.values()],
                              [r for _, r in held.values()]))

        def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
            streak, last, held = self._get()
            for k, h, r in zip(*(initialState[c] for c in ("keys", "hashes", "rows")), strict=True):
                held[k] = (int(h), r)
            self._put(streak, last, held)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
            captures = pd.concat(list(rows)).sort_values("timestamp", kind="stable")
            streak, last, held = self._get()
            out = []
            for capture in captures.itertuples(index=False):
                at = int(capture.timestamp)
                if at <= last:
                    continue
                last = at
                good = capture.status in (0, 200)
                streak = 0 if good or streak is None else streak + 1
                if 0 < streak < limit:
                    continue
                now = {}
                if good:
                    for k, h, r in sorted(zip(
                            capture.keys, map(int, capture.hashes), capture.rows, strict=True)):
                        now[k] = (h, r)
                out += [(at, True, r) for k, (h, r) in now.items()
                        if always or k not in held or held[k][0] != h]
                out += [(at, False, r) for k, (_, r) in held.items() if k not in now]
                held = now
            if last < 0:
                return
            self._put(streak or 0, last, held)
            if silent_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(last + silent_ms)
            if out:
                times, active, rows = zip(*out, strict=True)
                yield self._frame(key, times, active, False, rows)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield self._frame(key, [expiredTimerInfo.getExpiryTimeInMs()], [None], True, [None])

        def _frame(self, key, times, active, silent, rows) -> pd.DataFrame:
            return pd.DataFrame({
                "namespace": key[0], "hostname": key[1], "timestamp": list(times),
                "active": list(active), "silent": silent, "row": list(rows)})

        def close(self) -> None:
            pass

    return Changes()
