"""Structured Streaming jobs around change capture.

A delete is the absence of a row in a complete capture, which no watermark can
tell; captures therefore arrive as whole files and each micro-batch is compared
with the stored state by the batch operator.  Only small per-service counters
live in streaming state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netstate.session import cut_lineage
from netstate.sources import read
from netstate.sources.capture import parse_capture_text
from netstate.streaming import cdc, stats

HYSTERESIS_OUTPUT = (
    "namespace string, hostname string, service string, timestamp bigint, status bigint, "
    "streak bigint, commit boolean"
)


def capture_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Records of capture files as they arrive."""
    rows = (spark.readStream.format("text").option("lineSep", "]\n[")
            .option("maxFilesPerTrigger", files_per_batch).load(path))
    return parse_capture_text(rows)


def cdc_stream(
    snapshots: DataFrame, root: str, table: str, checkpoint: str,
    normalise: Callable[[DataFrame], DataFrame] | None = None, boots: DataFrame | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Append the changes each micro-batch of captures makes to a table.

    The stored table is the state, so a restarted job goes on where it was and
    a batch that is run again finds nothing left to add.  Captures with a
    ``status`` are held back while a host's poll failed once or twice in a row;
    the third failure counts as an empty answer.  The failures of each host
    lie beside the checkpoint, one folder per micro-batch.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if "status" in batch.columns:
            batch = _committed(batch, f"{checkpoint.rstrip('/')}-failures", number)
        # Captures of one host are applied in time order: round n holds every
        # host's n-th capture, so the rounds are as many as one host has files.
        turn = F.dense_rank().over(
            Window.partitionBy("namespace", "hostname").orderBy("timestamp"))
        rounds = batch.withColumn("__round", turn).persist()
        try:
            last = rounds.agg(F.max("__round")).first()[0] or 0
            for n in range(1, last + 1):
                part = rounds.where(F.col("__round") == n).drop("__round")
                rows = normalise(part) if normalise else part
                moment = part.agg(F.max("timestamp")).first()[0]
                cdc.store_changes(batch.sparkSession, root, table, rows, boots,
                                  polled=part, deleted_at=moment)
        finally:
            rounds.unpersist()

    writer = snapshots.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


STREAKS = "namespace string, hostname string, streak long"


def _committed(batch: DataFrame, folder: str, number: int) -> DataFrame:
    """Captures of a micro-batch that are to be stored; the new streaks are written."""
    spark = batch.sparkSession
    polls = cut_lineage(batch.groupBy(*cdc.NS_HOST, "timestamp").agg(
        F.bool_and(F.col("status").isin(0, 200)).alias("ok")))
    if number and read.path_exists(spark, f"{folder}/{number - 1}"):
        before = spark.read.schema(STREAKS).parquet(f"{folder}/{number - 1}")
    else:
        before = spark.createDataFrame([], STREAKS)
    known = cut_lineage(cdc.continued_streaks(polls, before))
    last = known.groupBy(*cdc.NS_HOST).agg(F.max_by("streak", "timestamp").alias("streak"))
    unseen = before.join(last, cdc.NS_HOST, "left_anti")
    last.unionByName(unseen).write.mode("overwrite").parquet(f"{folder}/{number}")
    return batch.join(known.where("commit").select(*cdc.NS_HOST, "timestamp"),
                      [*cdc.NS_HOST, "timestamp"], "left_semi")


def raw_stream_sink(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of change rows to a raw table directory."""
    return (changes.writeStream.format("parquet").partitionBy("sqvers", "namespace", "hostname")
            .option("compression", "zstd").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def dedup_stream(changes: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Drop re-deliveries of one (key, timestamp) that arrive within the delay."""
    timed = changes.withColumn("event_time", F.timestamp_millis("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(
        [*keys, "timestamp"]).drop("event_time")


def poll_stats_stream(polls: DataFrame, period_ms: int = 60_000, delay: str = "10 minutes",
                      ) -> DataFrame:
    """Five-minute statistics, emitted when the watermark passes the window."""
    timed = polls.withColumn("ts", F.timestamp_millis("timestamp")).withWatermark("ts", delay)
    return stats.poll_stats(timed, period_ms, "ts")


def hysteresis_stream(polls: DataFrame) -> DataFrame:
    """``failure_streaks`` of a stream; the state is one counter per service.

    A micro-batch holds few polls of one service, so the group is small.
    """
    limit = cdc.HYSTERESIS_FAILURES

    # A local function travels by value: executors need not have this package.
    def streaks(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
                ) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("timestamp", kind="stable")
        # Polls since the last one that set the streak to zero; the very first one does.
        reset = rows["status"].isin((0, 200)).to_numpy().copy()
        if not state.exists:
            reset[0] = True
        number = np.arange(len(rows))
        last = np.maximum.accumulate(np.where(reset, number, -1))
        streak = np.where(last >= 0, number - last, number + 1 + (
            state.get[0] if state.exists else 0))
        state.update((int(streak[-1]),))
        yield pd.DataFrame({
            "namespace": key[0], "hostname": key[1], "service": key[2],
            "timestamp": rows["timestamp"].to_numpy(), "status": rows["status"].to_numpy(),
            "streak": streak, "commit": (streak == 0) | (streak >= limit)})

    return polls.groupBy("namespace", "hostname", "service").applyInPandasWithState(
        streaks, HYSTERESIS_OUTPUT, "streak long", "append", GroupStateTimeout.NoTimeout)


def run_now(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None
            ) -> DataFrame:
    """Drive a stream over all data there is into a memory table."""
    writer = (df.writeStream.format("memory").queryName(name).outputMode(mode)
              .trigger(availableNow=True))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return df.sparkSession.table(name)
