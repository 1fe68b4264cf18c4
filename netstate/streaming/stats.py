"""Poll statistics: [min, max, average] per service and five-minute window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
FLUSH_WINDOW = "5 minutes"
NEGLIGIBLE = 0.001
MEASURES = ["gatherTime", "totalTime", "svcQsize", "wrQsize", "nodeQsize", "rxBytes"]
KEYS = ["namespace", "hostname", "service"]


def recency_average(samples: Column) -> Column:
    """Fold ``(avg + new) / 2`` over ordered values; tiny results are 0."""
    first = F.get(samples, F.lit(0)).cast("double")
    rest = F.slice(samples, F.lit(2), F.greatest(F.size(samples) - 1, F.lit(0)))
    return F.aggregate(rest, first, lambda avg, x: F.when(
        (avg + x) / 2 < NEGLIGIBLE, F.lit(0.0)).otherwise((avg + x) / 2))


def poll_stats(polls: DataFrame, period_ms: int = 60_000, time_column: str = "ts",
               keys: list[str] | None = None, measures: list[str] | None = None) -> DataFrame:
    """One row per service and window.

    A measure becomes ``[min, max, recency average]`` plus ``<m>Avg``, the plain
    mean.  A window holds one poll per period, so the ordered list is short.
    ``polls`` may be a stream with a watermark on the time column.
    """
    keys = keys or KEYS
    measures = [m for m in (measures or MEASURES) if m in polls.columns]
    aggs = []
    for m in measures:
        ordered = F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(time_column), F.col(m).alias("v")))),
            lambda s: s["v"])
        aggs += [F.min(m).alias(f"{m}Min"), F.max(m).alias(f"{m}Max"),
                 F.avg(m).alias(f"{m}Avg"), ordered.alias(f"{m}All")]
    if "totalTime" in polls.columns:
        aggs.append(F.count(F.when(F.col("totalTime") > period_ms, 1)).alias(
            "pollExcdPeriodCount"))
    out = polls.groupBy(*keys, F.window(time_column, FLUSH_WINDOW)).agg(*aggs)
    for m in measures:
        out = out.withColumn(m, F.array(
            F.col(f"{m}Min").cast("double"), F.col(f"{m}Max").cast("double"),
            recency_average(F.col(f"{m}All").cast("array<double>")))).drop(
            f"{m}Min", f"{m}Max", f"{m}All")
    return out


def flush_points(polls: DataFrame, period_ms: int = 60_000) -> DataFrame:
    """Polls whose statistics are written at once: over period, or a change of status."""
    from netstate.operators import ordered

    df = ordered.previous_value(polls, KEYS, "timestamp", {"__before": F.col("status")})
    changed = F.col("__before").isNotNull() & (F.col("__before") != F.col("status"))
    return df.where((F.col("totalTime") > period_ms) | changed).drop("__before")
