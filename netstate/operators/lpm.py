"""Longest-prefix match of addresses against route tables.

Many addresses meet a table in one ordered pass per block of addresses (a /16 of
IPv4, a /64 of IPv6).  Prefixes inside a block are nested or apart, like brackets:
each opens at its network and closes at its last address.  A running sum gives the
depth at each place, and the prefix that an address lies in is the last one opened
at the address's depth.  So an address stays one row, whatever lengths are in use,
and a block can't outgrow a task: an IPv4 block holds 65,536 addresses at most.
Prefixes shorter than a block cover it whole; the best of them is looked up once per
block and opens it.

Where addresses are looked up in every table, the same pass finds the innermost network
of any table that each lies in.  All addresses in it (and in no network inside it) have
the same best routes, so the tables are asked once per network, not per address.

A few addresses are matched by equality instead: one candidate network per prefix
length in use, joined with (family, length, network words).  The few addresses are
then what moves, not the tables.
Short prefixes (the default route above all) are matched by every address of a
scope; their candidates are salted so that no task gets them all.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from netstate.functions import ip
from netstate.operators.views import keep_last
from netstate.session import estimated_bytes

SALTS = 16
SHORT = {4: 12, 6: 20}
#: Bits that the addresses of a block share.
BLOCK = {4: 16, 6: 64}
#: Addresses of a smaller estimated size are sent to the tables.
FEW_BYTES = 64 << 20
#: Candidates of a match by equality are broadcast up to this size, all their rows counted.
FEW_BROADCAST = 1 << 20


def _masked(fam: Column, hi: Column, lo: Column, plen: Column) -> tuple[Column, Column]:
    v4_mask = F.call_function("shiftright", ip.mask64(plen), F.lit(32)).bitwiseAND(
        F.lit(0xFFFFFFFF))
    return (
        F.when(fam == 6, hi.bitwiseAND(ip.mask64(plen))).otherwise(hi),
        F.when(fam == 6, lo.bitwiseAND(ip.mask64(plen - 64))).otherwise(lo.bitwiseAND(v4_mask)),
    )


def _is_short(fam: Column, plen: Column) -> Column:
    return plen < F.when(fam == 6, F.lit(SHORT[6])).otherwise(F.lit(SHORT[4]))


def spelled_prefix(routes: DataFrame, prefix: str = "prefix") -> Column:
    """The prefix, with the word ``default`` as that of the row's family (else IPv4)."""
    whole = F.lit("0.0.0.0/0")
    if "ipvers" in routes.columns:
        whole = F.when(F.col("ipvers") == 6, F.lit("::/0")).otherwise(whole)
    return F.when(F.col(prefix) == "default", whole).otherwise(F.col(prefix))


def with_prefix_key(routes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Add ``fam, plen, net_hi, net_lo``; rows whose prefix cannot be read are left out."""
    df = routes.withColumn("__p", spelled_prefix(routes, prefix))
    full = F.when(F.col("__p").contains(":"), F.lit(128)).otherwise(F.lit(32))
    plen = F.coalesce(ip.prefix_len("__p"), full)
    hi, lo = ip.words("__p")
    df = df.where(ip.looks_like_address("__p") & (plen <= full)).withColumns({
        "fam": ip.family("__p"), "plen": plen, "__hi": hi, "__lo": lo})
    hi, lo = _masked(F.col("fam"), F.col("__hi"), F.col("__lo"), F.col("plen"))
    return df.withColumns({"net_hi": hi, "net_lo": lo}).drop("__hi", "__lo", "__p")


def prefix_lengths(keyed: DataFrame) -> dict[int, list[int]]:
    """Lengths in use per family: at most 33 + 129 values, whatever the table's size."""
    out: dict[int, list[int]] = {4: [], 6: []}
    for r in keyed.select("fam", "plen").distinct().collect():
        out[r.fam].append(r.plen)
    return {fam: sorted(v) for fam, v in out.items()}


def containing(
    addresses: DataFrame, prefixes: DataFrame, addr: str, scope: list[str],
    lengths: dict[int, list[int]] | None = None,
) -> DataFrame:
    """Every (address, prefix row) where the prefix holds the address.

    ``addresses`` has distinct (scope.., addr); ``prefixes`` comes from
    ``with_prefix_key``.  Pairs are bounded by the prefix lengths, not by the
    tables.
    """
    hi, lo = ip.words(addr)
    rows = addresses.where(ip.looks_like_address(addr)).select(
        *scope, addr, ip.family(addr).alias("fam"), hi.alias("__hi"), lo.alias("__lo"))
    return _by_equality(rows, prefixes, [*scope, addr], scope,
                        lengths or prefix_lengths(prefixes))


def _by_equality(rows: DataFrame, prefixes: DataFrame, kept: list[str], scope: list[str],
                 lengths: dict[int, list[int]], longest: Column | None = None) -> DataFrame:
    """Every (row, prefix) where the prefix holds the row's (fam, __hi, __lo).

    ``longest`` bounds the length of the prefixes wanted.
    """

    def literal(values: list[int]) -> Column:
        return F.array(*map(F.lit, values)).cast("array<int>") if values else F.array().cast(
            "array<int>")

    candidates = F.when(F.col("fam") == 6, literal(lengths[6])).otherwise(literal(lengths[4]))
    if longest is not None:
        candidates = F.filter(candidates, lambda n: n <= longest)
    rows = rows.withColumn("plen", F.explode(candidates))
    hi, lo = _masked(F.col("fam"), F.col("__hi"), F.col("__lo"), F.col("plen"))
    short = _is_short(F.col("fam"), F.col("plen"))
    rows = rows.withColumns({
        "net_hi": hi, "net_lo": lo,
        "__salt": F.when(short, F.pmod(F.xxhash64("__hi", "__lo"), F.lit(SALTS)).cast("int"))
        .otherwise(F.lit(0)),
    }).select(*kept, "fam", "plen", "net_hi", "net_lo", "__salt")
    spread = F.when(short, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0)))
    keyed = prefixes.withColumn("__salt", F.explode(spread))
    # The most selective key leads, so that sorting by it settles most comparisons.
    on = ["net_lo", "net_hi", "plen", "fam", "__salt", *scope]
    # No estimate counts the rows that an explode makes.
    few = estimated_bytes(rows) * max(1, *map(len, lengths.values())) <= FEW_BROADCAST
    rows = F.broadcast(rows) if few else rows.hint("merge")
    return rows.join(keyed, on).drop("__salt", "net_hi", "net_lo")


def _is_wide(fam: Column, plen: Column) -> Column:
    """Shorter than a block."""
    return plen < F.when(fam == 6, F.lit(BLOCK[6])).otherwise(F.lit(BLOCK[4]))


def _block_start(fam: Column, hi: Column, lo: Column) -> tuple[Column, Column]:
    bits = F.when(fam == 6, F.lit(BLOCK[6])).otherwise(F.lit(BLOCK[4]))
    return _masked(fam, hi, lo, bits)


def _last_address(fam: Column, hi: Column, lo: Column, plen: Column) -> tuple[Column, Column]:
    """The highest address of a network."""
    host4 = F.call_function("shiftright", F.bitwise_not(ip.mask64(plen)), F.lit(32)).bitwiseAND(
        F.lit(0xFFFFFFFF))
    return (
        F.when(fam == 6, hi.bitwiseOR(F.bitwise_not(ip.mask64(plen)))).otherwise(hi),
        F.when(fam == 6, lo.bitwiseOR(F.bitwise_not(ip.mask64(plen - 64)))).otherwise(lo.bitwiseOR(host4)),
    )


def merged(
    addresses: DataFrame, prefixes: DataFrame, addr: str, scope: list[str],
    lengths: dict[int, list[int]] | None = None,
) -> DataFrame:
    """(scope.., addr, plen, columns of the prefix) of the longest prefix of each address.

    ``addresses`` has distinct (scope.., addr); ``prefixes`` comes from
    ``with_prefix_key``.  Null scopes meet nothing.  Networks named twice differ
    by their text: the first one wins.
    """
    own = [c for c in prefixes.columns if c not in (*scope, "fam", "plen", "net_hi", "net_lo")]
    found = F.struct("plen", *own)
    hi, lo = ip.words(addr)
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in scope],
                    ip.looks_like_address(addr))
    points = addresses.where(usable).select(
        *scope, addr, ip.family(addr).alias("fam"), hi.alias("__hi"), lo.alias("__lo"))

    # The best wide prefix of each block that has addresses.
    fam = F.col("fam")
    wide = prefixes.where(_is_wide(fam, F.col("plen")))
    lengths = {f: [n for n in found if n < BLOCK[f]] for f, found in (
        lengths or prefix_lengths(wide)).items()}
    block_hi, block_lo = _block_start(fam, F.col("__hi"), F.col("__lo"))
    blocks = points.select(*scope, "fam", block_hi.alias("__hi"), block_lo.alias("__lo")).distinct()
    keys = ["__hi", "__lo"]
    covers = _by_equality(blocks, wide, [*scope, *keys], scope, lengths)
    text = [F.col("prefix")] if "prefix" in own else []
    covers = keep_last(covers, [*scope, "fam", *keys], [F.col("plen").desc(), *text])

    # What opens (0), is asked for (1) and closes (2), in the order of places.
    none = F.lit(None)
    opened = covers.select(
        *scope, "fam", *keys, F.lit(0).alias("__kind"), F.lit(-1).alias("__rank"),
        F.lit(1).alias("__step"), found.alias("__found"))
    inside = prefixes.where(~_is_wide(fam, F.col("plen")))
    end_hi, end_lo = _last_address(fam, F.col("net_hi"), F.col("net_lo"), F.col("plen"))
    sides = F.array(
        F.struct(F.col("net_hi").alias("__hi"), F.col("net_lo").alias("__lo"),
                 F.lit(0).alias("__kind"), F.lit(1).alias("__step"), found.alias("__found")),
        F.struct(end_hi.alias("__hi"), end_lo.alias("__lo"), F.lit(2).alias("__kind"),
                 F.lit(-1).alias("__step"), F.when(F.lit(False), found).alias("__found")))
    brackets = inside.select(*scope, "fam", F.col("plen").alias("__rank"), *text, F.inline(sides))
    asked = points.withColumns({"__kind": F.lit(1), "__rank": F.lit(0), "__step": F.lit(0)})
    rows = asked.unionByName(brackets, True).unionByName(opened, True)
    # Of an address all bits but a block's own are the same in a block.
    rows = rows.withColumn("__block", F.when(fam == 6, F.col("__hi")).otherwise(
        F.call_function("shiftright", F.col("__lo"), F.lit(32 - BLOCK[4]))))
    rows = rows.withColumn("__place", ip.unsigned_key(F.col("__lo")))
    group = ["__block", *reversed(scope), "fam"]
    # Of equal networks the first text is opened last.
    order = ["__place", "__kind", "__rank", *[c.desc() for c in text]]
    rows = rows.withColumn("__depth", F.sum("__step").over(
        Window.partitionBy(*group).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)))
    rows = rows.where("__kind < 2")
    rows = rows.withColumn("__best", F.last("__found", ignorenulls=True).over(
        Window.partitionBy(*group, "__depth").orderBy("__place", "__kind").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)))
    hits = rows.where("__kind = 1 and __depth > 0")
    return hits.select(*scope, addr, F.col("__best.plen").alias("plen"),
                       *[F.col("__best")[c].alias(c) for c in own])


def _in_every_table(
    addresses: DataFrame, wanted: DataFrame, prefixes: DataFrame, addr: str, scope: list[str],
    per: list[str], lengths: dict[int, list[int]] | None, how: str,
) -> DataFrame:
    """Best route of each address in each table (``per``), by way of its innermost network."""
    lengths = lengths or prefix_lengths(prefixes)
    networks = prefixes.select(*scope, "fam", "plen", "net_hi", "net_lo").distinct()
    name = ["__fam", "__len", "__hi", "__lo"]
    named = networks.withColumns({
        "__fam": F.col("fam"), "__len": F.col("plen"), "__nhi": F.col("net_hi"),
        "__nlo": F.col("net_lo")})
    # Short networks hold many addresses: theirs are dealt out.
    short = _is_short(F.col("__fam"), F.col("__len"))
    places = merged(wanted, named, addr, scope, lengths).select(
        *scope, addr, "__fam", "__len", F.col("__nhi").alias("__hi"), F.col("__nlo").alias("__lo"),
        F.when(short, F.pmod(F.xxhash64(addr), F.lit(SALTS)).cast("int")).otherwise(
            F.lit(0)).alias("__salt"))
    rows = networks.select(
        *scope, "fam", F.col("fam").alias("__fam"), F.col("plen").alias("__len"),
        F.col("net_hi").alias("__hi"), F.col("net_lo").alias("__lo"))
    pairs = _by_equality(rows, prefixes, [*scope, *name], scope, lengths, F.col("__len"))
    best = keep_last(pairs, [*scope, *name, *per], _order(pairs))
    best = best.drop("fam").withColumnRenamed("plen", "matchedLen").withColumn(
        "__salt", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
            F.array(F.lit(0)))))
    # Estimates of places and routes are those of small tables before an explode.
    found = addresses.join(places.hint("merge"), [addr, *scope], how)
    return found.join(best.hint("merge"), ["__lo", "__hi", "__len", "__fam", "__salt", *scope], how).select(
        addr, *scope, *[c for c in addresses.columns if c not in (addr, *scope)],
        *[c for c in best.columns if c not in (*scope, *name, "__salt")])


def _order(pairs: DataFrame) -> list[Column]:
    """Longest first; prefixes with host bits may name one network twice: the first text wins."""
    return [F.col("plen").desc(), *(F.col(c) for c in ("prefix",) if c in pairs.columns)]


def lpm_join(
    addresses: DataFrame, routes: DataFrame, addr: str = "address",
    scope: tuple[str, ...] = ("namespace", "hostname", "vrf"),
    per: tuple[str, ...] = ("namespace", "hostname", "vrf"),
    columns: list[str] | None = None, lengths: dict[int, list[int]] | None = None,
    how: str = "inner", merge: bool | None = None,
) -> DataFrame:
    """Best route of each address.

    ``scope`` are columns both sides share (an address is looked up in its own
    scope only); ``per`` are the route columns within which one best route is
    wanted.  Equal addresses of a scope are looked up once.  ``merge`` chooses
    between the ordered pass and the match by equality; left out, the estimated
    size of the addresses does.  The answer is the same.
    """
    keyed = routes if "net_lo" in routes.columns else with_prefix_key(routes)
    scope_cols, per_cols = list(scope), [c for c in per if c not in scope]
    kept = [c for c in (columns or [c for c in routes.columns if c not in (
        "fam", "plen", "net_hi", "net_lo")]) if c not in scope_cols and c not in per_cols]
    wanted = addresses.select(*scope_cols, addr).distinct()
    if merge is None:
        merge = estimated_bytes(wanted) > FEW_BYTES
    if merge and scope_cols and not per_cols:
        best = merged(wanted, keyed.select(
            *scope_cols, *kept, "fam", "plen", "net_hi", "net_lo"), addr, scope_cols, lengths)
        best = best.withColumnRenamed("plen", "matchedLen")
        return addresses.join(best, [addr, *scope_cols], how)
    keyed = keyed.select(*scope_cols, *per_cols, *kept, "fam", "plen", "net_hi", "net_lo")
    if merge and per_cols:
        return _in_every_table(
            addresses, wanted, keyed, addr, scope_cols, per_cols, lengths, how)
    pairs = containing(wanted, keyed, addr, scope_cols, lengths)
    best = keep_last(pairs, [*scope_cols, addr, *per_cols], _order(pairs))
    best = best.drop("fam").withColumnRenamed("plen", "matchedLen")
    return addresses.join(best, [addr, *scope_cols], how)


def lpm(routes: DataFrame, address: str,
        per: tuple[str, ...] = ("namespace", "hostname", "vrf")) -> DataFrame:
    """Best route of one address per (namespace, hostname, vrf): a filter and a keep-best."""
    ipaddress.ip_address(address)
    df = routes.withColumn("__p", spelled_prefix(routes))
    holds = ip.looks_like_address("__p") & (
        ip.addr_in_cidr(F.lit(address), "__p") | ip.is_default("__p", address))
    plen = F.coalesce(ip.prefix_len("__p"), F.lit(128))
    return keep_last(df.where(holds), list(per), [plen.desc(), F.col("prefix").asc()]).drop(
        "__p")


def routes_view(routes: DataFrame) -> DataFrame:
    """Presented routes: normal prefixes, protocol and action names, derived columns."""
    df = routes.where("prefix != '127.0.0.0/8'").withColumn("prefix", spelled_prefix(routes))
    if "protocol" in df.columns:
        df = df.withColumn("protocol", F.when(
            F.col("protocol") == "direct", F.lit("connected")).otherwise(F.col("protocol")))
    if "action" in df.columns:
        df = df.withColumn("action", F.when(
            F.col("action") == "local", F.lit("forward")).otherwise(F.col("action")))
    df = df.withColumn("prefixlen", ip.prefix_len("prefix"))
    if {"oifs", "nexthopIps"} <= set(df.columns):
        df = df.withColumn("numNexthops", F.greatest(
            F.size("oifs"), F.size("nexthopIps"), F.lit(0)))
    return df


def prefix_filter(prefixes: list[str]) -> Column:
    """Routes with exactly these prefixes; an address alone means its host route."""
    terms = []
    for p in prefixes:
        whole = p if "/" in p else f"{p}/128" if ":" in p else f"{p}/32"
        version = 6 if ":" in p else 4
        terms.append((F.col("prefix") == whole) & (F.col("ipvers") == version))
    return reduce(lambda a, b: a | b, terms)
