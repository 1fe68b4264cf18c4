"""Generic verbs: unique, top, histogram, counts, failures, natural order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from netstate.functions import text
from netstate.operators.filters import filter_query, match_ospf_state

_NUMERIC = (T.LongType, T.IntegerType, T.FloatType, T.DoubleType, T.ShortType)


class VerbError(ValueError):
    """A verb used on a column it does not fit."""


def _flat(df: DataFrame, column: str) -> DataFrame:
    if isinstance(df.schema[column].dataType, T.ArrayType):
        df = df.withColumn(column, F.explode(column)).where(F.col(column).isNotNull())
    return df


def unique(df: DataFrame, column: str, count: bool = False, query_str: str = "") -> DataFrame:
    """Distinct values of one column (list elements one by one), optionally counted."""
    flat = _flat(df.select(column), column)
    if count:
        out = flat.where(F.col(column).isNotNull()).groupBy(column).agg(
            F.count(F.lit(1)).alias("numRows"))
    else:
        out = flat.distinct()
    return filter_query(out, query_str)


def top(df: DataFrame, what: str, keys: list[str], count: int = 5, reverse: bool = False,
        columns: list[str] | None = None) -> DataFrame:
    """The ``count`` rows with the largest (reverse: smallest) value of a numeric column."""
    if not isinstance(df.schema[what].dataType, _NUMERIC):
        raise VerbError(f"top needs a numeric column, {what} is not")
    order = [F.col(c).asc() if reverse else F.col(c).desc()
             for c in [what, *[k for k in keys if k in df.columns]]]
    out = df.orderBy(*order).limit(count)
    return out.select(*columns) if columns else out


def top_with_ties(tables_df: DataFrame, what: str, count: int = 5,
                  reverse: bool = False) -> DataFrame:
    """Largest (smallest) tables of a listing, the TOTAL row left out; ties by name."""
    order = F.col(what).asc() if reverse else F.col(what).desc()
    return tables_df.where("table != 'TOTAL'").orderBy(order, "table").limit(count)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Values by number of rows, most frequent first."""
    flat = _flat(df.select(column), column)
    return flat.groupBy(column).count().orderBy(F.desc("count"), column)


def natural_sort(df: DataFrame, cols: list[str], view_has_time: bool = False) -> DataFrame:
    """Number-aware order of the key columns; change views go by time."""
    if view_has_time and "timestamp" in df.columns:
        return df.orderBy("timestamp", *[text.natkey(c) for c in cols])
    return df.orderBy(*[text.natkey(c) for c in cols])


# Table -> column holding its state.
STATE_COLUMN = {"device": "status", "interfaces": "state", "bgp": "state", "ospf": "adjState"}


def status_counts(df: DataFrame, table: str) -> DataFrame:
    """Rows per (namespace, state); admin-down interfaces are their own state."""
    state: Column = F.col(STATE_COLUMN[table])
    if table == "interfaces":
        state = F.when(F.col("adminState") != "up", F.lit("adminDown")).otherwise(state)
    return df.groupBy("namespace", state.alias("state")).count()


def poll_freshness(poller: DataFrame) -> DataFrame:
    return poller.groupBy("namespace").agg(
        F.countDistinct("hostname").alias("deviceCnt"),
        F.max("timestamp").alias("lastUpdate"))


def failure_rules() -> dict[str, Column]:
    return {
        "device": F.col("status") == "dead",
        "interfaces": (F.col("state") != "up") & (F.col("adminState") == "up"),
        "mlag": (F.col("state") != "active") | (F.col("mlagSinglePortsCnt") != 0)
        | (F.col("mlagErrorPortsCnt") != 0),
        "ospf": match_ospf_state("other"),
        "bgp": F.col("state") == "NotEstd",
    }


# Table -> columns that say which object failed and what state it is in.
_FAILURE_SUBJECT = {
    "device": ("hostname", "status"), "interfaces": ("ifname", "state"),
    "mlag": ("systemId", "state"), "ospf": ("ifname", "adjState"), "bgp": ("peer", "state"),
}


def failures(tables: dict[str, DataFrame]) -> DataFrame:
    """Failing rows of every table given: (table, namespace, hostname, object, state)."""
    rules = failure_rules()
    parts = []
    for table, df in tables.items():
        subject, state = _FAILURE_SUBJECT[table]
        parts.append(df.where(rules[table]).select(
            F.lit(table).alias("table"), "namespace", "hostname",
            F.col(subject).alias("object"), F.col(state).alias("state")))
    return reduce(DataFrame.unionByName, parts)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in exactly one of the two frames."""
    cols = a.columns
    marked = a.distinct().withColumn("__n", F.lit(1)).unionByName(
        b.select(*cols).distinct().withColumn("__n", F.lit(1)))
    return marked.groupBy(*cols).agg(F.sum("__n").alias("__n")).where("__n = 1").drop("__n")


def key_difference(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``previous`` whose key is missing from ``current``."""
    return previous.join(current.select(*keys).distinct(), keys, "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_non_empty(c, order=None) -> Column:
    """Aggregate: the first value that is neither null nor blank, by ``order``."""
    c = F.col(c) if isinstance(c, str) else c
    value = F.nullif(c, F.lit(""))
    if order is None:
        return F.first(value, ignorenulls=True)
    return F.min_by(value, F.when(value.isNotNull(), order))
