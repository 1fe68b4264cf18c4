"""Statistic sheets per namespace.

A sheet is declared as a list of statistics; scalar ones become one
``groupBy(namespace).agg(...)``.  Distributions are counted per value before
they are collected, and min/max/median triples come from value counts that are
ranked in parallel, so no group is ever gathered whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

_ON = "namespace"


@dataclass(frozen=True)
class Stat:
    """One aggregate column, e.g. ``count`` of ``field`` where ``where`` holds.

    ``func`` may be any aggregate Spark SQL knows (``stddev``, ``approx_percentile``
    with its arguments in ``field``), or one the user registered.
    """

    name: str
    field: str
    func: str = "count"
    where: str | Column | None = None


@dataclass(frozen=True)
class Distribution:
    """Map value -> rows having it."""

    name: str
    field: str


@dataclass(frozen=True)
class Spread:
    """[min, max, median] of a column, or of a per-group aggregate of it.

    ``per`` names the finer grouping (e.g. hostname) and ``func`` the aggregate
    taken there first.
    """

    name: str
    field: str
    where: str | Column | None = None
    per: tuple[str, ...] = ()
    func: str = "count"


@dataclass(frozen=True)
class Constant:
    name: str
    value: object


def _condition(where) -> Column | None:
    return F.expr(where) if isinstance(where, str) else where


def stat(s: Stat) -> Column:
    """Aggregate Column of a scalar statistic; no matching row counts as 0."""
    cond = _condition(s.where)
    agg = {
        "count": F.count, "nunique": F.countDistinct, "sum": F.sum, "min": F.min, "max": F.max,
    }.get(s.func)
    if agg is None:
        only = f" FILTER (WHERE {s.where})" if s.where is not None else ""
        return F.coalesce(F.expr(f"{s.func}({s.field}){only}"), F.lit(0)).alias(s.name)
    c = F.col(s.field) if cond is None else F.when(cond, F.col(s.field))
    return F.coalesce(agg(c), F.lit(0)).alias(s.name)


def value_counts(df: DataFrame, field: str, group=(_ON,)) -> DataFrame:
    return df.where(F.col(field).isNotNull()).groupBy(*group, field).count()


def distribution(df: DataFrame, field: str, name: str | None = None, group=(_ON,)) -> DataFrame:
    """Per group a map value -> count; counted first, then the counts are collected."""
    counted = value_counts(df, field, group)
    entry = F.struct(F.col(field).cast("string").alias("k"), F.col("count").alias("v"))
    return counted.groupBy(*group).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name or field))


def distribution_rows(df: DataFrame, fields: list[str], group=(_ON,)) -> DataFrame:
    """All distributions as rows ``(group.., field, value, count)`` in one pass."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
        for f in fields]))
    return (
        df.select(*group, pairs.alias("p")).select(*group, "p.field", "p.value")
        .where("value is not null").groupBy(*group, "field", "value").count()
    )


def spread_rows(values: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Exact min, max and median per group without gathering a group.

    Values are counted.  A sketch, off by one rank in ten thousand at most, bounds
    the middle from both sides, whatever the distribution; only the values
    between the bounds, a thousandth of the rows, are ranked.
    """
    known = values.where(F.col(value).isNotNull()).select(
        *group, F.col(value).cast("double").alias("v"))
    counts = known.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("c"))
    ends = known.groupBy(*group).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.percentile_approx("v", [0.4995, 0.5005], 10_000).alias("mid"))
    bucket = F.when(F.col("v") < F.get("mid", F.lit(0)), 0).when(
        F.col("v") <= F.get("mid", F.lit(1)), 1).otherwise(2)
    placed = counts.join(ends, group).withColumn("b", bucket)
    n, low = F.col("n"), F.col("c0")
    middle = low + F.col("c1")
    lo_rank, hi_rank = F.floor((n - 1) / 2), F.floor(n / 2)

    def holder(rank):
        return F.when(rank < low, 0).when(rank < middle, 1).otherwise(2)

    # One row per group says which bounds hold the middle and what lies before them; nearly
    # always these are the inner ones.
    chosen = placed.groupBy(*group).agg(
        F.first("n").alias("n"),
        *[F.sum(F.when(F.col("b") == b, F.col("c")).otherwise(0)).alias(f"c{b}") for b in (0, 1)])
    chosen = chosen.select(
        *group, holder(lo_rank).alias("from"), holder(hi_rank).alias("to"),
        F.when(lo_rank < low, 0).when(lo_rank < middle, low).otherwise(middle).alias("before"))
    inside = placed.join(chosen, group).where("b between from and to")
    upto = Window.partitionBy(*group).orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("first", F.col("before") + F.sum("c").over(upto) - F.col("c"))

    def at(rank):
        return F.max(F.when(
            (rank >= F.col("first")) & (rank < F.col("first") + F.col("c")), F.col("v")))

    return ranked.groupBy(*group).agg(
        F.first("lo").alias("min"), F.first("hi").alias("max"),
        ((at(lo_rank) + at(hi_rank)) / 2).alias("median"))


def distributions(df: DataFrame, wanted: list[Distribution]) -> DataFrame:
    """One row per group with a map column per distribution, counted in one pass.

    What is collected are the distinct values of each field, i.e. the result.
    """
    rows = distribution_rows(df, [s.field for s in wanted])

    def packed(s: Distribution) -> Column:
        entry = F.struct(F.col("value").alias("k"), F.col("count").alias("v"))
        return F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("field") == s.field, entry)))).alias(s.name)

    return rows.groupBy(_ON).agg(*[packed(s) for s in wanted])


def _spread_values(df: DataFrame, wanted: list[Spread]) -> DataFrame:
    """(namespace, stat, value) rows: all plain spreads in one pass, each finer one in its own."""
    parts = []
    plain = [s for s in wanted if not s.per]
    if plain:
        def value(s: Spread) -> Column:
            c = F.col(s.field).cast("double")
            cond = _condition(s.where)
            return c if cond is None else F.when(cond, c)
        pairs = F.explode(F.array(*[
            F.struct(F.lit(s.name).alias("stat"), value(s).alias("value")) for s in plain]))
        parts.append(df.select(_ON, pairs.alias("p")).select(_ON, "p.stat", "p.value"))
    for s in wanted:
        if not s.per:
            continue
        cond = _condition(s.where)
        rows = df if cond is None else df.where(cond)
        agg = F.countDistinct if s.func == "nunique" else getattr(F, s.func)
        parts.append(rows.groupBy(_ON, *s.per).agg(agg(s.field).alias("value")).select(
            _ON, F.lit(s.name).alias("stat"), F.col("value").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def spreads(df: DataFrame, wanted: list[Spread]) -> DataFrame:
    """All spreads of a sheet, ranked together: one column per spread."""
    rows = spread_rows(_spread_values(df, wanted), [_ON, "stat"])
    triple = F.array("min", "max", "median")
    return rows.groupBy(_ON).agg(*[
        F.max(F.when(F.col("stat") == s.name, triple)).alias(s.name) for s in wanted])


def summarize(
    df: DataFrame, stats: list, check: str = "deviceCnt",
    extra: list[DataFrame] | None = None, order: list[str] | None = None,
) -> DataFrame:
    """One row per namespace; namespaces whose ``check`` is 0 are dropped."""
    scalars = [stat(s) for s in stats if isinstance(s, Stat)]
    out = df.groupBy(_ON).agg(*scalars)
    maps = [s for s in stats if isinstance(s, Distribution)]
    if maps:
        out = out.join(distributions(df, maps), _ON, "left")
    wanted = [s for s in stats if isinstance(s, Spread)]
    if wanted:
        zero = F.array(*[F.lit(0.0)] * 3)
        out = out.join(spreads(df, wanted), _ON, "left").withColumns(
            {s.name: F.coalesce(F.col(s.name), zero) for s in wanted})
    for part in extra or []:
        out = out.join(part, _ON, "left")
    for s in stats:
        if isinstance(s, Constant):
            out = out.withColumn(s.name, F.lit(s.value))
    names = order or [_ON, *[s.name for s in stats],
                      *[c for c in out.columns if c != _ON and c not in {s.name for s in stats}]]
    return out.where(F.col(check) > 0).select(*names)


def transpose_summary(sheet: DataFrame) -> DataFrame:
    """Rows = statistic, columns = namespace (all values as text)."""
    names = [c for c in sheet.columns if c != _ON]
    def as_text(c):
        kind = sheet.schema[c].dataType.typeName()
        return F.to_json(c) if kind in ("map", "array", "struct") else F.col(c).cast("string")
    long = sheet.select(_ON, *[as_text(c).alias(c) for c in names]).unpivot(
        _ON, names, "stat", "value")
    return long.groupBy("stat").pivot(_ON).agg(F.first("value"))


def explode_nunique(
    df: DataFrame, list_field: str, name: str, where: Column | None = None,
    group=(_ON,),
) -> DataFrame:
    """Distinct elements of a list column per group (a null elsewhere drops nothing)."""
    items = df.select(*group, F.explode(list_field).alias("item"))
    if where is not None:
        items = items.where(where)
    return items.groupBy(*group).agg(F.countDistinct("item").alias(name))


def top_subnets(df: DataFrame, list_field: str = "ipAddressList", n: int = 3) -> DataFrame:
    """Prefix lengths in use (most frequent first) and the counts of the top ``n``."""
    lens = df.select(_ON, F.explode(list_field).alias("a")).select(
        _ON, F.substring_index("a", "/", -1).alias("plen")).where("plen != ''")
    counted = lens.groupBy(_ON, "plen").count()
    # At most 33 lengths per namespace are collected.
    entry = F.struct((-F.col("count")).alias("c"), F.col("plen").alias("p"))
    ordered = counted.groupBy(_ON).agg(F.array_sort(F.collect_list(entry)).alias("es"))
    return ordered.select(
        _ON,
        F.transform("es", lambda e: e["p"]).alias("subnetsUsed"),
        F.transform(F.slice("es", 1, n),
                    lambda e: F.create_map(e["p"], -e["c"])).alias("subnetTopCounts"),
    )


def with_total(tables_df: DataFrame) -> DataFrame:
    """Append the TOTAL row of a table listing."""
    total = tables_df.agg(
        F.lit("TOTAL").alias("table"), F.min("firstTime").alias("firstTime"),
        F.max("lastTime").alias("lastTime"), F.max("intervals").alias("intervals"),
        F.sum("allRows").alias("allRows"), F.max("namespaceCnt").alias("namespaceCnt"),
        F.max("deviceCnt").alias("deviceCnt"))
    return tables_df.unionByName(total)


def quantile(df: DataFrame, column: str, q: float) -> Column:
    """Interpolated quantile; for listings of bounded length (one row per table)."""
    return F.percentile(F.col(column), q).alias(f"{column}{int(q * 100)}")


def default_route_coverage(routes: DataFrame) -> DataFrame:
    """Per namespace: in each VRF every device has the default route."""
    return per_vrf_route_coverage(routes).groupBy(_ON).agg(
        F.bool_and("covered").alias("deviceWithNoDefRoute"))


def per_vrf_route_coverage(routes: DataFrame) -> DataFrame:
    """(namespace, vrf): do all devices have the default route of each family they route."""
    six = F.col("prefix").contains(":")
    by_host = routes.groupBy(_ON, "vrf", "hostname").agg(*[
        F.coalesce(F.bool_or(F.col("prefix") == default), F.lit(False))
        .alias(f"__default{n}") for n, default in ((4, "0.0.0.0/0"), (6, "::/0"))],
        F.coalesce(F.bool_or(~six), F.lit(False)).alias("__any4"),
        F.coalesce(F.bool_or(six), F.lit(False)).alias("__any6"))
    ok = (F.col("__default4") | ~F.col("__any4")) & (F.col("__default6") | ~F.col("__any6"))
    return by_host.groupBy(_ON, "vrf").agg(
        F.count(F.when(ok, 1)).alias("devicesWithDefault"), F.count("hostname").alias("devices"),
    ).withColumn("covered", F.col("devicesWithDefault") == F.col("devices"))


def interfaces_to_vlans(vlans: DataFrame) -> DataFrame:
    """Invert VLAN -> member list to interface -> sorted VLAN list (at most 4094 each)."""
    members = vlans.select(_ON, "hostname", F.explode("interfaces").alias("ifname"), "vlan")
    return members.groupBy(_ON, "hostname", "ifname").agg(
        F.array_sort(F.collect_set("vlan")).alias("vlanList"))
