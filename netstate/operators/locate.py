"""Where does an address attach: ARP, interface ownership, first hop by MAC and LLDP."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netstate.functions import ip, text
from netstate.operators import ordered, views
from netstate.operators.enrich import NS_HOST, _lookup, bond_members, unique_by
from netstate.operators.views import keep_last
from netstate.session import cut_lineage

RESULT = [
    "query", "active", "namespace", "hostname", "vrf", "ipAddress", "vlan", "macaddr", "ifname",
    "bondMembers", "type", "l2miss", "timestamp",
]
# Fixed values.
IGNORED_MAC_PORTS = ["", "vPC Peer-Link"]
ZERO_MAC = "00:00:00:00:00:00"


class AddressError(ValueError):
    """Text that is neither an IP nor a MAC address."""


def normalise_queries(addresses: DataFrame) -> DataFrame:
    """``address`` text to (query, ip, mac); what is neither has both null."""
    mac = text.mac_canonical("address")
    is_ip = ip.ip_struct("address").isNotNull()
    return addresses.select(
        F.col("address").alias("query"),
        F.when(is_ip, F.lower(ip.address_part("address"))).alias("q_ip"),
        F.when(~is_ip & mac.rlike(text.MAC_PATTERN), mac).alias("q_mac"),
    ).distinct()


def check_queries(addresses: list[str]) -> list[str]:
    import ipaddress
    import re

    for a in addresses:
        try:
            ipaddress.ip_address(a)
        except ValueError:
            if not re.fullmatch(r"[0-9A-Fa-f]{2}([:-]?[0-9A-Fa-f]{2}){5}|"
                                r"[0-9A-Fa-f]{4}([.:-][0-9A-Fa-f]{4}){2}", a):
                raise AddressError(f"not an IP or MAC address: {a!r}") from None
    return addresses


def arp_hits(addresses: DataFrame, arp: DataFrame) -> DataFrame:
    q = normalise_queries(addresses)
    by_ip = q.where("q_ip is not null").join(arp, F.col("q_ip") == F.col("ipAddress"))
    by_mac = q.where("q_mac is not null").join(arp, F.col("q_mac") == F.col("macaddr"))
    return by_ip.unionByName(by_mac).drop("q_ip", "q_mac").where(~F.col("oif").endswith("-v0"))


def find_by_arp(
    addresses: DataFrame, arp: DataFrame, ifs: DataFrame, macs: DataFrame,
    past: bool = False,
) -> DataFrame:
    """Endpoints by local ARP entries.

    With ``past`` the frames are histories: each ARP row looks at interfaces
    and MACs as they were until the entry changed again, and an entry that goes
    from local to remote is reported as gone.  A MAC that was on several ports by
    then is reported on each.
    """
    hits = arp_hits(addresses, arp)
    key = ["query", *NS_HOST, "ipAddress"]
    if past:
        local = F.col("active") & ~F.col("remote")
        hits = ordered.previous_value(hits, key, "timestamp", {"was_local": local})
        hits = hits.withColumn("was_local", F.coalesce("was_local", F.lit(False)))
        states = ifs.withColumnRenamed("ifname", "oif")
        hits = views.state_until_next(
            hits, states, [*NS_HOST, "oif"],
            ["master", "type", "vlan", "ipAddressList", "ip6AddressList"], window_keys=key)
        hits = hits.withColumn("if_known", F.col("type").isNotNull())
    else:
        hits = hits.withColumn("was_local", F.lit(False)).withColumn(
            "next_ts", F.lit(None).cast("bigint"))
        packed = ifs.select(*NS_HOST, F.col("ifname").alias("oif"), "master", "type", "vlan",
                            "ipAddressList", "ip6AddressList")
        hits = hits.join(packed, [*NS_HOST, "oif"], "left").withColumn(
            "if_known", F.col("type").isNotNull())
    hits = hits.where((~F.col("remote") | F.col("was_local")) & F.col("if_known"))
    none = F.array().cast("array<string>")
    own = F.concat(F.coalesce("ipAddressList", none), F.coalesce("ip6AddressList", none))
    hits = hits.withColumns({
        "bridged": ip.addr_in_any_cidr("ipAddress", own),
        "vrf": F.when(F.coalesce("master", F.lit("")) == "", F.lit("default")).otherwise(
            F.col("master")),
    })
    base = ["query", "active", *NS_HOST, "vrf", "ipAddress", "macaddr", "timestamp"]
    routed = hits.where(~F.col("bridged")).select(
        *base, F.col("vlan").cast("bigint").alias("vlan"), F.col("oif").alias("ifname"),
        F.lit("routed").alias("type"), F.lit(False).alias("l2miss"))
    svi = hits.where(F.col("bridged") & (F.col("type") == "vlan"))
    moved = svi.where(F.col("active") & F.col("remote")).select(
        *[F.lit(False).alias("active") if c == "active" else F.col(c) for c in base],
        F.col("vlan").cast("bigint").alias("vlan"), F.col("oif").alias("ifname"),
        F.lit("bridged").alias("type"), F.lit(False).alias("l2miss"))
    stays = svi.where(~(F.col("active") & F.col("remote")))
    entries = macs.where(
        ~F.col("oif").isin(IGNORED_MAC_PORTS) & (F.coalesce("flags", F.lit("")) != "remote"))
    entries = entries.select(
        *NS_HOST, "macaddr", F.col("vlan").cast("bigint").alias("vlan"),
        F.col("oif").alias("__oif"), F.col("active").alias("__mac_active"),
        F.col("timestamp").alias("__mac_ts"))
    stays = stays.withColumn("vlan", F.col("vlan").cast("bigint"))
    keys = [*NS_HOST, "macaddr", "vlan"]
    if past:
        joined = _ports_until(stays, entries, keys)
    else:
        joined = stays.join(entries, keys, "left")
    alive = F.coalesce("__mac_active", F.lit(False))
    bridged = joined.select(
        *[c for c in base if c != "timestamp"],
        F.when(F.col("__oif").isNotNull() & ~alive, F.col("__mac_ts")).otherwise(
            F.col("timestamp")).alias("timestamp"),
        "vlan", F.when(alive, F.col("__oif")).otherwise(F.col("oif")).alias("ifname"),
        F.lit("bridged").alias("type"), (~alive).alias("l2miss"))
    return routed.unionByName(moved).unionByName(bridged)


def _ports_until(hits: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the last MAC entry of each port up to ``next_ts`` (null: up to now).

    A row meets the ports its MAC was ever seen on, not the MAC's history; the state of
    each port then comes from one ordered pass, however often the MAC has moved.
    Rows whose MAC was on no port by then have null entries.
    """
    ports = entries.select(*keys, "__oif").distinct()
    own = [c for c in hits.columns if c not in keys]
    asked = hits.withColumn("__probe", F.coalesce("next_ts", F.lit(1 << 62))).withColumn(
        "__row", F.monotonically_increasing_id())
    asked = cut_lineage(asked)
    met = asked.join(ports, keys)
    states = entries.withColumn("__probe", F.col("__mac_ts").cast("bigint"))
    seen = views.as_of_join(met, states, [*keys, "__oif"], ["__mac_active", "__mac_ts"],
                            ts="__probe").where("__mac_ts is not null")
    seen = cut_lineage(seen)
    unseen = asked.join(seen.select("__row").distinct(), "__row", "left_anti")
    kept = [*keys, *own, "__oif", "__mac_active", "__mac_ts"]
    return seen.select(*kept).unionByName(unseen.select(*keys, *own), True)


def find_by_interface(addresses: DataFrame, ifs: DataFrame) -> DataFrame:
    """Endpoints that are interfaces of polled devices."""
    q = normalise_queries(addresses)
    none = F.array().cast("array<string>")
    owned = ifs.withColumn("__a", F.explode_outer(F.concat(
        F.coalesce("ipAddressList", none), F.coalesce("ip6AddressList", none)))).select(
        "active", *NS_HOST, "ifname", "vlan", "macaddr", "timestamp",
        F.when(F.col("master") == "", F.lit("default")).otherwise(F.col("master")).alias("vrf"),
        F.lower(F.coalesce(ip.address_part("__a"), F.lit(""))).alias("ipAddress"))
    by_ip = q.where("q_ip is not null").join(owned, F.col("q_ip") == F.col("ipAddress"))
    by_mac = q.where("q_mac is not null").join(
        owned.where("ipAddress != '0.0.0.0'"), F.col("q_mac") == F.col("macaddr"))
    rows = by_ip.unionByName(by_mac)
    return rows.select(
        "query", "active", *NS_HOST, "vrf", "ipAddress", "macaddr", "timestamp",
        F.col("vlan").cast("bigint").alias("vlan"), "ifname", F.lit("interface").alias("type"),
        F.lit(False).alias("l2miss")).distinct()


def port_peers(lldp: DataFrame, ifs: DataFrame) -> DataFrame:
    """(namespace, hostname, port) -> LLDP peer; a bond has the peer of its members."""
    direct = lldp.where("peerHostname != ''").select(
        *NS_HOST, "ifname", "peerHostname", "peerIfname")
    bonds = ifs.where("master is not null and master not in ('', 'bridge', 'default')").select(
        *NS_HOST, "ifname", F.col("master").alias("bond"))
    via_bond = direct.join(bonds, [*NS_HOST, "ifname"]).select(
        *NS_HOST, F.col("bond").alias("ifname"), "peerHostname", "peerIfname")
    return unique_by(direct.unionByName(via_bond), [*NS_HOST, "ifname"],
                     peerHostname="peerHostname", peerIfname="peerIfname")


def first_hop_attach(found: DataFrame, ifs: DataFrame, lldp: DataFrame,
                     macs: DataFrame) -> DataFrame:
    """Follow the MAC switch by switch until no further one knows it.

    Rounds are joins on the rows still moving; a switch is visited once, so the
    rounds end.
    """
    # Joined again in every round.
    peers = cut_lineage(port_peers(lldp, ifs))
    where_mac = cut_lineage(unique_by(macs, [*NS_HOST, "macaddr", "vlan"], __oif="oif"))
    masters = unique_by(ifs, [*NS_HOST, "ifname"], __master="master")
    start = found.withColumn(
        "port", F.when(F.col("type") == "interface", F.col("ifname")).otherwise(
            text.parent_ifname("ifname")))

    hop = _lookup(start.where("type = 'routed'"), peers, {
        "namespace": "namespace", "hostname": "hostname", "port": "ifname"})
    hop = hop.withColumns({
        "__at": F.coalesce("peerHostname", "hostname"),
        "__on": F.when(F.col("peerHostname").isNotNull(), F.col("peerIfname")).otherwise(
            F.col("port"))})
    hop = _lookup(hop, masters, {
        "namespace": "namespace", "__at": "hostname", "__on": "ifname"})
    moved = F.col("peerHostname").isNotNull() & F.col("__master").isNotNull()
    routed = hop.withColumns({
        "vrf": F.when(moved, F.when(F.col("__master") == "", F.lit("default")).otherwise(
            F.col("__master"))).otherwise(F.col("vrf")),
        "hostname": F.col("__at"), "port": F.col("__on"),
    }).drop("peerHostname", "peerIfname", "__at", "__on", "__master")

    moving = start.where("type = 'bridged'").withColumn(
        "visited", F.array(F.col("hostname"))).withColumn("moves", F.lit(True))
    while True:
        step = _lookup(moving, peers, {
            "namespace": "namespace", "hostname": "hostname", "port": "ifname"})
        step = _lookup(step, where_mac, {
            "namespace": "namespace", "peerHostname": "hostname", "macaddr": "macaddr",
            "vlan": "vlan"})
        on = (F.col("moves") & F.col("__oif").isNotNull()
              & ~F.coalesce(F.array_contains("visited", F.col("peerHostname")), F.lit(False)))
        step = step.withColumn("__go", F.coalesce(on, F.lit(False)))
        step = step.withColumns({
            "visited": F.when(F.col("__go"), F.concat(
                "visited", F.array("peerHostname"))).otherwise(F.col("visited")),
            "hostname": F.when(F.col("__go"), F.col("peerHostname")).otherwise(
                F.col("hostname")),
            "port": F.when(F.col("__go"), F.col("__oif")).otherwise(F.col("port")),
            "moves": F.col("__go"),
        }).drop("peerHostname", "peerIfname", "__oif", "__go")
        moving = cut_lineage(step)
        if not moving.where("moves").limit(1).count():
            break
    bridged = moving.drop("visited", "moves")
    own = start.where("type = 'interface'")
    rows = own.unionByName(routed).unionByName(bridged)
    members = bond_members(ifs).withColumnRenamed("bond", "ifname")
    rows = _lookup(rows, members, {
        "namespace": "namespace", "hostname": "hostname", "port": "ifname"})
    return rows.withColumns({
        "ifname": F.col("port"),
        "bondMembers": F.when(
            F.col("members").isNull() | (F.col("type") == "interface"), F.lit("")
        ).otherwise(F.array_join("members", ", ")),
    }).select(*RESULT).distinct()


def add_primary_interface(found: DataFrame, ifs: DataFrame) -> DataFrame:
    """Unnumbered links: add the loopback (or its ``.0``) that owns the address."""
    groups = found.groupBy("query").agg(
        F.countDistinct("namespace", "hostname", "vrf").alias("__g"),
        F.max(F.when(F.col("type") != "routed", 1).otherwise(0)).alias("__other"),
        F.min(F.struct("namespace", "hostname", "vrf", "ipAddress", "active", "timestamp")
              ).alias("__r"))
    lone = groups.where("__g = 1 and __other = 0").select("query", "__r.*")
    loops = ifs.where("type = 'loopback'").select(*NS_HOST, "ifname")
    dot_zero = loops.select(*NS_HOST, F.concat("ifname", F.lit(".0")).alias("ifname"))
    owned = ifs.join(loops.unionByName(dot_zero).distinct(), [*NS_HOST, "ifname"], "left_semi")
    none = F.array().cast("array<string>")
    owned = owned.select(
        *NS_HOST, F.col("ifname").alias("__if"), F.col("master").alias("__m"),
        F.explode(F.concat(F.coalesce("ipAddressList", none),
                           F.coalesce("ip6AddressList", none))).alias("__a")
    ).withColumn("ipAddress", F.lower(ip.address_part("__a")))
    extra = lone.join(owned, [*NS_HOST, "ipAddress"]).where(
        F.col("__m").isin("", "default") | (F.col("__m") == F.col("vrf")))
    return found.unionByName(extra.select(
        "query", "active", *NS_HOST, "vrf", "ipAddress", F.lit(0).cast("bigint").alias("vlan"),
        F.lit(ZERO_MAC).alias("macaddr"), F.col("__if").alias("ifname"),
        F.lit("").alias("bondMembers"), F.lit("interface").alias("type"),
        F.lit(False).alias("l2miss"), "timestamp"))


def find(
    addresses: DataFrame, arp: DataFrame, ifs: DataFrame, macs: DataFrame, lldp: DataFrame,
    past: bool = False, vlan=None, vrf: str | None = None,
    now: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Attachment points of a table of addresses (column ``address``).

    ``now`` holds the latest interfaces and MACs when the frames are histories.
    """
    by_arp = cut_lineage(find_by_arp(addresses, arp, ifs, macs, past))
    current = now or {"interfaces": ifs, "macs": macs}
    rest = addresses.join(
        by_arp.select(F.col("query").alias("address")).distinct(), "address", "left_anti")
    found = cut_lineage(by_arp.unionByName(find_by_interface(rest, current["interfaces"])))
    out = first_hop_attach(found, current["interfaces"], lldp, current["macs"])
    if vlan is not None:
        out = out.where(F.col("vlan") == vlan)
    if vrf:
        out = out.where(F.col("vrf") == vrf)
    return add_primary_interface(out, current["interfaces"])


def find_asn(bgp: DataFrame, asns: list[int]) -> DataFrame:
    return bgp.where(F.col("asn").isin([int(a) for a in asns]))
