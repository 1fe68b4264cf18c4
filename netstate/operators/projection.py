"""Column selection, computed columns and presentation of times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netstate.catalog import HIDDEN_COLUMNS, UnknownColumnError, default_value, table_spec
from netstate.functions import ip, text, timefn
from netstate.operators.views import shows_active, uptime_ms

# Columns that hold epoch times, and the factor that makes them milliseconds.
TIME_COLUMNS = {
    "timestamp": 1, "bootupTimestamp": 1000, "estdTime": 1, "statusChangeTimestamp": 1,
    "lastChangeTime": 1, "lastUpdate": 1, "firstTime": 1, "lastTime": 1,
}


def field_names(table: str, columns=("default",)) -> list[str]:
    """Names for ``['default']`` (display order), ``['*']`` (all shown) or an own list."""
    spec = table_spec(table)
    wanted = [columns] if isinstance(columns, str) else list(columns or ["default"])
    if wanted == ["default"]:
        return list(spec.display)
    every = [c for c in [*spec.columns, *spec.computed] if c not in HIDDEN_COLUMNS]
    if wanted == ["*"]:
        return list(spec.display) + [c for c in every if c not in spec.display]
    known = {*spec.columns, *spec.computed, *spec.display}
    unknown = [c for c in wanted if c not in known]
    if unknown:
        raise UnknownColumnError(f"{table}: unknown columns {unknown}")
    return wanted


def select_fields(df: DataFrame, table: str, columns=("default",)) -> DataFrame:
    return df.select(*[c for c in field_names(table, columns) if c in df.columns])


def fill_missing_columns(df: DataFrame, fields: dict[str, str] | list[str],
                         table: str | None = None) -> DataFrame:
    """Absent columns become typed nulls."""
    if not isinstance(fields, dict):
        spec = table_spec(table) if table else None
        fields = {
            c: (spec.type_of(c).simpleString() if spec and spec.type_of(c) else "string")
            for c in fields}
    absent = {c: F.lit(None).cast(t) for c, t in fields.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def add_active(df: DataFrame, columns: list[str], view=None, start=None, end=None) -> DataFrame:
    """Show ``active`` first when the view holds rows of the past."""
    shown = [c for c in columns if c != "active"]
    if shows_active(view, start, end):
        shown = ["active", *shown]
    return df.select(*[c for c in shown if c in df.columns])


def merge_fields(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Take an old column's value where the new one is empty; rename if only the old exists."""
    for old, new in renames.items():
        if old not in df.columns:
            continue
        if new not in df.columns:
            df = df.withColumnRenamed(old, new)
            continue
        blank = F.lit(default_value(df.schema[new].dataType)) if new in df.columns else F.lit("")
        value = F.col(new)
        df = df.withColumn(
            new, F.when(value.isNull() | (value == blank), F.col(old)).otherwise(value))
    return df


def _empty(c) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) == 0


# Computed columns that need nothing but their own row.  Those that need other
# tables (port modes, VLAN lists, peer names, move counts) are in the plans.
ROW_RULES = {
    "device": {"uptime": uptime_ms},
    "address": {
        "vrf": lambda: F.when(
            (F.col("master") == "bridge") | (_empty("ipAddressList") & _empty("ip6AddressList")),
            F.lit("")).when(F.col("master") == "", F.lit("default")).otherwise(F.col("master")),
        "ipAddress": lambda: F.concat(
            F.coalesce("ipAddressList", F.array().cast("array<string>")),
            F.coalesce("ip6AddressList", F.array().cast("array<string>"))),
    },
    "routes": {
        "prefixlen": lambda: ip.prefix_len("prefix"),
        "numNexthops": lambda: F.greatest(F.size("oifs"), F.size("nexthopIps")),
    },
    "bgp": {
        "asndot": lambda: text.asn_to_asdot("asn"),
        "peerAsndot": lambda: text.asn_to_asdot("peerAsn"),
        "afiSafi": lambda: F.concat_ws(" ", "afi", "safi"),
    },
    "evpnVni": {"remoteVtepCnt": lambda: F.greatest(F.size("remoteVtepList"), F.lit(0))},
}


def with_derived(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """Add computed columns whose inputs are there; unused ones are pruned by the optimizer."""
    spec = table_spec(table)
    for name, rule in ROW_RULES.get(table, {}).items():
        if columns is not None and name not in columns:
            continue
        if all(c in df.columns for c in spec.computed[name]):
            df = df.withColumn(name, rule())
    return df


def humanize(df: DataFrame, tz: str | None = None) -> DataFrame:
    """Epoch columns to timestamps in the zone asked for."""
    found = {
        c: timefn.epoch_ms_to_ts(F.col(c) * factor, tz)
        for c, factor in TIME_COLUMNS.items()
        if c in df.columns and df.schema[c].dataType.typeName() in ("long", "double", "integer")
    }
    return df.withColumns(found) if found else df
