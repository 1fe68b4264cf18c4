"""Sections and switchport modes of device configurations.

A configuration is one text per device; sections are found inside that text by
indentation, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from netstate.operators.enrich import NS_HOST
from netstate.operators.views import keep_last

# Fixed value: systems whose configuration uses braces.
BRACE_SYSTEMS = ["junos", "panos"]


def unbrace(c) -> Column:
    """Brace syntax to plain indentation: braces and semicolons go, lines stay."""
    c = F.col(c) if isinstance(c, str) else c
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"^\s*\}\s*$"))
    return F.array_join(
        F.transform(lines, lambda x: F.regexp_replace(x, r"\s*\{\s*$|;\s*$", "")), "\n")


def blocks(c, header: str) -> Column:
    """All blocks whose first line matches: the line and its deeper-indented followers.

    A block inside a block found is part of it.  The possessive loop keeps long
    blocks off the matcher's stack.
    """
    c = F.col(c) if isinstance(c, str) else c
    pattern = rf"(?m)^([ \t]*)(?=\S)(?=[^\n]*(?:{header}))[^\n]*(?:\n(?:\1[ \t]+[^\n]*|[ \t]*(?=\n)))*+"
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def config_sections(df: DataFrame, section: str, column: str = "config",
                    system: str | None = None) -> DataFrame:
    """Configurations cut down to the matching lines and all their children.

    Devices without a match are left out.  ``system`` names a column with the
    operating system, by which brace syntax is recognised.
    """
    body = F.col(column)
    if system:
        braces = F.col(system).startswith("junos") | F.col(system).isin(BRACE_SYSTEMS)
        body = F.when(braces, unbrace(column)).otherwise(body)
    out = F.array_join(blocks(body, section), "\n")
    return df.withColumn(column, out).where(F.col(column) != "")


def _first_number(block: Column, pattern: str, default: int = 0) -> Column:
    return F.coalesce(F.regexp_extract(block, pattern, 1).try_cast("int"), F.lit(default))


def _ios_modes(df: DataFrame) -> DataFrame:
    rows = df.select(*NS_HOST, F.explode(blocks("config", "^interface ")).alias("b"))
    header = F.substring_index("b", "\n", 1)
    body = F.expr("substring(b, locate('\\n', b))")
    rows = rows.select(*NS_HOST, F.trim(F.regexp_replace(header, "^interface", "")).alias(
        "ifname"), body.alias("b")).where("ifname != '' and b != ''")
    access = F.col("b").rlike(r"(?m)^\s+switchport[^\n]*access")
    trunk = F.col("b").rlike(r"(?m)^\s+switchport[^\n]*trunk")
    said = F.regexp_extract("b", r"(?m)^\s+switchport mode (access|trunk)", 1)
    mode = F.when(access & trunk & (said != ""), said).when(trunk, F.lit("trunk")).when(
        access, F.lit("access"))
    rows = rows.withColumn("portmode", mode).where("portmode is not null")
    access_vlan = _first_number(F.col("b"), r"(?m)^\s+switchport access vlan\s+(\d+)")
    native = _first_number(F.col("b"), r"native vlan\s+(\d+)", 1)
    return rows.select(*NS_HOST, "ifname", "portmode", F.when(
        F.col("portmode") == "access", access_vlan).otherwise(native).alias("vlan"))


def _ifupdown_modes(df: DataFrame) -> DataFrame:
    stanzas = df.select(*NS_HOST, F.explode(blocks("config", "^iface ")).alias("b"))
    stanzas = stanzas.withColumn("ifname", F.regexp_extract("b", r"^iface\s+(\S+)", 1))
    access = stanzas.where(F.col("b").contains("bridge-access")).select(
        *NS_HOST, "ifname", F.lit("access").alias("portmode"),
        _first_number(F.col("b"), r"bridge-access\s+(\d+)").alias("vlan"))
    pvid = stanzas.where(F.col("b").contains("bridge-pvid")).select(
        *NS_HOST, "ifname", F.lit("trunk").alias("portmode"),
        _first_number(F.col("b"), r"bridge-pvid\s+(\d+)").alias("vlan"))
    lines = df.select(*NS_HOST, F.explode(
        F.regexp_extract_all("config", F.lit(r"(?m)^[ \t]*bridge-ports[ \t]+([^\n]*)"), 1)
    ).alias("l"))
    ports = lines.select(*NS_HOST, F.explode(F.split(F.trim("l"), r"\s+")).alias("ifname"),
                         F.lit("trunk").alias("portmode"), F.lit(1).alias("vlan"))
    ranked = reduce(DataFrame.unionByName, [
        access.withColumn("r", F.lit(0)), pvid.withColumn("r", F.lit(1)),
        ports.withColumn("r", F.lit(2))]).where("ifname != ''")
    return keep_last(ranked, [*NS_HOST, "ifname"], [F.col("r").asc(), F.col("vlan").desc()]
                     ).drop("r")


def _brace_modes(df: DataFrame) -> DataFrame:
    top = df.select(*NS_HOST, F.explode(blocks(unbrace("config"), "^interfaces$")).alias("t"))
    # One level down: the ports, indented once under "interfaces".
    ports = top.select(*NS_HOST, F.explode(F.regexp_extract_all(
        "t", F.lit(r"(?m)^ {1,4}(\S[^\n]*(?:\n {5,}[^\n]*)*+)"), 1)).alias("b"))
    rows = ports.where(F.col("b").rlike(r"interface-mode access"))
    return rows.select(
        *NS_HOST, F.trim(F.substring_index("b", "\n", 1)).alias("ifname"),
        F.lit("access").alias("portmode"),
        _first_number(F.col("b"), r"members\s+\[?\s*(\d+)").alias("vlan")).where("vlan != 0")


def switchport_modes(configs: DataFrame, system: str = "os") -> DataFrame:
    """(namespace, hostname, ifname, portmode, vlan) of all configured access and trunk ports."""
    name = F.coalesce(F.col(system), F.lit(""))
    braces = reduce(lambda a, b: a | b, [name.contains(x) for x in BRACE_SYSTEMS])
    ifupdown = name.contains("cumulus")
    return reduce(DataFrame.unionByName, [
        _ios_modes(configs.where(~braces & ~ifupdown)),
        _ifupdown_modes(configs.where(ifupdown)),
        _brace_modes(configs.where(braces)),
    ])
