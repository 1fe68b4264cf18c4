"""Compaction: tumbling time blocks, each holding the whole state of a record table.

A written block has all rows of its time span and, for every key without a row
in it, the key's last earlier row.  So the last block alone answers "latest".
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from netstate.catalog import table_names, table_spec
from netstate.functions import timefn
from netstate.operators import views
from netstate.session import cut_lineage
from netstate.sources import read, write


def with_block(df: DataFrame, period_ms: int) -> DataFrame:
    """Add ``block_start``: blocks are aligned to the epoch, 10:00:00.000-10:59:59.999."""
    return df.withColumn("block_start", F.expr(
        f"timestamp - pmod(timestamp, {period_ms}L)"))


def written_blocks(df: DataFrame) -> list[int]:
    """Blocks that have rows: as many as the time span has periods, however many rows."""
    return sorted(r[0] for r in df.select("block_start").distinct().collect())


def carried_rows(rows: DataFrame, keys: list[str], blocks: list[int]) -> DataFrame:
    """Last row of each key, repeated in every written block until its next own row.

    ``rows`` has ``block_start`` (null for the state before the first block).
    The rows are first cut to one per (key, block), so the window sees at most
    one row per key and block.
    """
    if not blocks:
        return rows.limit(0)
    last = views.keep_last(rows, [*keys, "block_start"],
                           [F.col("timestamp").desc(), *views.tiebreak(rows)])
    w = Window.partitionBy(*keys).orderBy(F.col("block_start").asc_nulls_first())
    nxt = F.coalesce(F.lead("block_start").over(w), F.lit(blocks[-1] + 1))
    low = F.coalesce("block_start", F.lit(blocks[0] - 1))
    spans = last.withColumns({"__from": low, "__to": nxt})
    listed = F.array(*[F.lit(b) for b in blocks]).cast("array<bigint>")
    between = F.filter(listed, lambda b: (b > F.col("__from")) & (b < F.col("__to")))
    return spans.withColumn("__blocks", between).drop("block_start", "__from", "__to").withColumn(
        "block_start", F.explode("__blocks")).drop("__blocks")


def compact_rows(
    df: DataFrame, keys: list[str], period_ms: int, kind: str = "record",
    now_ms: int | None = None, state: DataFrame | None = None,
    blocks: list[int] | None = None,
) -> DataFrame:
    """Rows of all complete blocks with ``block_start``; the block open now is left out.

    ``state`` is the last row of each key before these rows (from the newest
    block written earlier).
    """
    rows = with_block(df, period_ms)
    if now_ms is not None:
        rows = rows.where(F.col("block_start") + period_ms <= now_ms)
    if kind == "counters":
        return rows
    blocks = written_blocks(rows) if blocks is None else blocks
    known = rows
    if state is not None:
        known = rows.unionByName(state.withColumn("block_start", F.lit(None).cast("bigint")),
                                 allowMissingColumns=True)
    return rows.unionByName(carried_rows(known, keys, blocks).select(*rows.columns))


def stored_blocks(spark: SparkSession, root: str, table: str) -> list[tuple[str, int]]:
    """(namespace, block_start) of the blocks written so far."""
    return read.list_blocks(spark, read.table_path(root, table, compacted=True))


def compaction_state(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """Last row per key of the newest block of each namespace."""
    spec = table_spec(table)
    done = read.read_versions(spark, read.table_path(root, table, compacted=True), table)
    if done is None:
        return None
    newest = read.prune_blocks(done, stored_blocks(spark, root, table), 1)
    return views.latest(newest.drop("block_start"), spec.keys)


def late_rows(every: DataFrame, done: DataFrame, keys: list[str], kind: str,
              written: list[int], older: list[int]) -> DataFrame:
    """What rows of blocks up to the newest one add to the compacted table.

    ``every`` has rows with ``block_start``, of which those of ``older`` blocks
    count; ``done`` is the compacted table.  A row that is not there yet goes to
    its own block, and as the state of its key to each later block that has it
    from an older row.  Only blocks from the oldest late one on are read, and of
    these the keys concerned.
    """
    key_time = [*keys, "timestamp"]
    mine = every.where(F.col("block_start").isin(older))
    known = done.where(F.col("block_start").isin(older)).select(*key_time).distinct()
    new = cut_lineage(mine.join(known, key_time, "left_anti"))
    if kind == "counters":
        return new
    touched = written_blocks(new)
    if not touched:
        return new
    span = done.where(F.col("block_start") >= touched[0])
    own = span.where(F.col("timestamp") >= F.col("block_start"))
    before = [b for b in written if b < touched[0]]
    if set(touched) <= set(written):
        own = own.join(new.select(*keys).distinct(), keys, "left_semi")
    elif before:
        # A block that had no row at all gets the whole state, like any other.
        state = views.latest(done.where(F.col("block_start") == before[-1]), keys)
        own = own.unionByName(state.withColumn("block_start", F.lit(None).cast("bigint")))
    blocks = sorted({*touched, *[b for b in written if b >= touched[0]]})
    carried = carried_rows(own.unionByName(new.select(*own.columns)), keys, blocks)
    there = span.select(*key_time, "block_start").distinct()
    return new.unionByName(carried.select(*new.columns).join(
        there, [*key_time, "block_start"], "left_anti"))


def consumed_files(raw: DataFrame, period_ms: int, now_ms: int) -> DataFrame:
    """(file): raw files all of whose rows lie in complete blocks."""
    last = with_block(raw, period_ms).groupBy(F.input_file_name().alias("file")).agg(
        F.max("block_start").alias("last"))
    return last.where(F.col("last") + period_ms <= now_ms).select("file")


def _delete_files(spark: SparkSession, files: DataFrame) -> int:
    """Delete files one by one; names come to the driver a partition at a time."""
    conf, n = spark._jsc.hadoopConfiguration(), 0
    for row in files.toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(row.file)
        n += bool(path.getFileSystem(conf).delete(path, False))
    return n


def compact_table(spark: SparkSession, root: str, table: str, period: str = "1h",
                  now_ms: int | None = None, remove_consumed: bool = True) -> dict:
    """Write the blocks completed since the last run, and late rows of older ones.

    Raw files are deleted once all their rows are written, so that a run reads
    what is new and a view reads the blocks it needs.  ``remove_consumed=False``
    keeps them: answers stay the same, but runs and views read them again.
    """
    started = time.time()
    spec, span = table_spec(table), timefn.period_ms(period)
    now_ms = int(started * 1000) if now_ms is None else now_ms
    raw = read.read_versions(spark, read.table_path(root, table), table)
    stats = {"namespace": "", "service": table, "period": period, "execTime": 0,
             "fileCount": 0, "recCount": 0, "timestamp": now_ms, "active": True}
    if raw is None:
        return stats
    every = with_block(raw, span)
    present = written_blocks(every.where(F.col("block_start") + span <= now_ms))
    written = sorted({b for _, b in stored_blocks(spark, root, table)})
    blocks = [b for b in present if not written or b > written[-1]]
    older = [b for b in present if written and b <= written[-1]]
    parts, late = [], None
    if older:
        done = read.read_versions(spark, read.table_path(root, table, compacted=True), table)
        late = cut_lineage(late_rows(every, done, spec.keys, spec.kind, written, older))
        if blocks or late.limit(1).count():
            parts.append(late)
    if blocks:
        fresh = every.where(F.col("block_start").isin(blocks)).drop("block_start")
        state = compaction_state(spark, root, table)
        if late is not None:
            state = views.latest(state.unionByName(
                late.drop("block_start").select(*state.columns)), spec.keys)
        parts.append(compact_rows(fresh, spec.keys, span, spec.kind, now_ms, state, blocks))
    files = cut_lineage(consumed_files(raw, span, now_ms))
    stats["fileCount"] = files.count()
    if parts:
        names = parts[0].columns
        out = reduce(lambda a, b: a.unionByName(b), [p.select(*names) for p in parts])
        # Rows are counted as they are written.  Each block comes from few tasks, large ones
        # from several.  The plan may read the directory it appends to: its files are listed.
        seen = Observation()
        out = out.observe(seen, F.count(F.lit(1)).alias("n"))
        write.write_compacted(out.hint("rebalance", "namespace", "block_start"), root, table)
        stats["recCount"] = seen.get["n"]
    if remove_consumed:
        _delete_files(spark, files)
    stats["execTime"] = int(time.time() - started)
    return stats


def compact_all(spark: SparkSession, root: str, period: str = "1h",
                now_ms: int | None = None, remove_consumed: bool = True) -> list[dict]:
    """All tables, in any order; one that fails does not stop the others."""
    stats, present = [], read.stored_tables(spark, root)
    for table in [t for t in table_names(stored_only=True) if t in present]:
        if table == "sqCoalescer":
            continue
        try:
            stats.append(compact_table(spark, root, table, period, now_ms, remove_consumed))
        except Exception as exc:
            stats.append({"namespace": "", "service": table, "period": period, "execTime": -1,
                          "fileCount": 0, "recCount": 0, "timestamp": now_ms or 0,
                          "active": True, "error": str(exc).splitlines()[0]})
    write.write_compaction_stats(spark, root, stats)
    return stats
