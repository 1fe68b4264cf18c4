"""Schema migration of stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netstate.catalog import table_spec

# BGP 1.0 column groups and the address families they stand for.
BGP_1_FAMILIES = {
    "v4": ("ipv4", "unicast"), "v6": ("ipv6", "unicast"), "evpn": ("l2vpn", "evpn"),
}
BGP_1_FIELDS = {
    "PfxRx": "pfxRx", "PfxTx": "pfxTx", "IngressRmap": "ingressRmap",
    "EgressRmap": "egressRmap", "defaultsent": "defOriginate",
}
COMMUNITY_TYPES = {
    "extendedAndStandard": ["standard", "extended"], "extended": ["extended"],
    "standard": ["standard"],
}
LEGACY_NAMES = {"macs": {"origIfname": "oif"}, "*": {"origIfname": "ifname"}}


class MigrationError(ValueError):
    """A stored value that the current type cannot hold."""


def bgp_1_to_2(df: DataFrame) -> DataFrame:
    """One row with column groups per family becomes one row per enabled family."""

    def present(name, default):
        return F.col(name) if name in df.columns else F.lit(default)

    def families(test) -> Column:
        return F.array_compact(F.array(*[
            F.when(test(g), F.lit(f"{afi} {safi}"))
            for g, (afi, safi) in BGP_1_FAMILIES.items()]))

    def flag(group, what):
        return F.coalesce(present(f"{group}{what}", False), F.lit(False))

    adv_only = families(lambda g: flag(g, "Advertised") & ~flag(g, "Received"))
    rcv_only = families(lambda g: ~flag(g, "Advertised") & flag(g, "Received"))
    sent = present("evpnSendCommunity", "")
    communities = reduce(
        lambda acc, kv: F.when(sent == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(acc),
        COMMUNITY_TYPES.items(), F.array().cast("array<string>"))
    types = {"pfxRx": "bigint", "pfxTx": "bigint", "ingressRmap": "string",
             "egressRmap": "string", "defOriginate": "boolean"}
    rows = [
        F.when(
            flag(g, "Enabled"),
            F.struct(
                F.lit(afi).alias("afi"), F.lit(safi).alias("safi"),
                *[present(g + old, None).cast(types[new]).alias(new)
                  for old, new in BGP_1_FIELDS.items()],
                (communities if g == "evpn" else F.array().cast("array<string>"))
                .alias("communityTypes")))
        for g, (afi, safi) in BGP_1_FAMILIES.items()]
    made = ["afi", "safi", *BGP_1_FIELDS.values(), "communityTypes"]
    own = [c for c in df.columns if c not in made + ["afisAdvOnly", "afisRcvOnly", "sqvers"]]
    return df.select(
        *own, F.lit("2.0").alias("sqvers"), adv_only.alias("afisAdvOnly"),
        rcv_only.alias("afisRcvOnly"), F.explode(F.array_compact(F.array(*rows))).alias("__f"),
    ).select(*own, "sqvers", "afisAdvOnly", "afisRcvOnly", "__f.*")


STEPS = {("bgp", "1.0"): bgp_1_to_2}


def rename_legacy(df: DataFrame, table: str) -> DataFrame:
    """Old column names to current ones."""
    for old, new in {**LEGACY_NAMES["*"], **LEGACY_NAMES.get(table, {})}.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def migrate_generic(df: DataFrame, table: str, keep: list[str] | None = None,
                    strict: bool = True) -> DataFrame:
    """Current columns only, absent ones at their default, version stamped.

    A value the current type cannot hold is an error when the row is read
    (``strict``), never a silent null.
    """
    from netstate.sources.write import typed_default

    spec = table_spec(table)
    out = []
    for f in spec.schema.fields:
        if f.name == "sqvers":
            out.append(F.lit(spec.version).alias("sqvers"))
            continue
        if f.name not in df.columns:
            default = F.lit(True) if f.name == "active" else typed_default(f.dataType)
            out.append(default.alias(f.name))
            continue
        source, kind = F.col(f.name), f.dataType.simpleString()
        value = source.try_cast(kind)
        if strict and df.schema[f.name].dataType != f.dataType:
            value = F.when(
                source.isNotNull() & value.isNull(),
                F.raise_error(F.concat(
                    F.lit(f"{table}.{f.name}: cannot migrate to {kind}: "),
                    source.cast("string"))).cast(kind),
            ).otherwise(value)
        out.append(value.alias(f.name))
    kept = [c for c in keep or [] if c in df.columns]
    return df.select(*out, *kept)


def migrate(df: DataFrame, table: str, version: str, keep: list[str] | None = None) -> DataFrame:
    """All steps from a stored version to the current one."""
    if version == table_spec(table).version:
        return df
    df = rename_legacy(df, table)
    step = STEPS.get((table, version))
    return migrate_generic(step(df) if step else df, table, keep)


def migrate_table(spark: SparkSession, root: str, table: str,
                  remove_old: bool = False) -> list[str]:
    """Rewrite every older version of a table under the current version directory.

    An old directory is removed, if asked for, only after its rows are written;
    until then both are read and the time view drops the doubles.  Rows that an
    earlier run has written are not written again.
    """
    from netstate.session import cut_lineage
    from netstate.sources import read, write

    done = []
    for compacted in (False, True):
        path = read.table_path(root, table, compacted)
        for v in read.versions(spark, path):
            if v == table_spec(table).version:
                continue
            old = read.read_version(spark, path, table, v)
            new = migrate(old, table, v, keep=["block_start"])
            spec = table_spec(table)
            if spec.version in read.versions(spark, path):
                now = read.read_version(spark, path, table, spec.version)
                marks = [*spec.keys, "timestamp", *(["block_start"] if compacted else [])]
                new = cut_lineage(new.join(now.select(*marks).distinct(), marks, "left_anti"))
            if compacted:
                write.write_compacted(new, root, table)
            else:
                write.write_raw(new, root, table)
            if remove_old:
                old_dir = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/sqvers={v}")
                old_dir.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old_dir, True)
            done.append(v)
    return done
