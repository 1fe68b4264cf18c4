"""Joins that complete one table from others.

Every right-hand side is reduced to one row per join key before it is joined,
so no join multiplies rows and a busy key on the left is only ever a lookup.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from netstate.functions import ip, text
from netstate.operators.summary import interfaces_to_vlans
from netstate.operators.views import keep_last

NS_HOST = ["namespace", "hostname"]


def unique_by(df: DataFrame, keys: list[str], **values) -> DataFrame:
    """One row per key: the smallest tuple of the named values (name = source column)."""
    packed = F.struct(*[F.col(src).alias(name) for name, src in values.items()])
    return df.groupBy(*keys).agg(F.min(packed).alias("__v")).select(*keys, "__v.*")


def _blank(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit("")) == ""


def _lookup(df: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Left join of left columns to right columns; the right keys are dropped."""
    renamed = right.withColumnsRenamed({r: f"__r_{r}" for r in on.values()})
    cond = reduce(lambda a, b: a & b, [F.col(l) == F.col(f"__r_{r}") for l, r in on.items()])
    return df.join(renamed, cond, "left").drop(*[f"__r_{r}" for r in on.values()])


# -- OSPF -------------------------------------------------------------------

def ospf_combined(ospf_if: DataFrame, ospf_nbr: DataFrame) -> DataFrame:
    """Interfaces with their neighbours; interfaces without one keep defaults."""
    key = [*NS_HOST, "ifname"]
    nbr_only = ["peerIP", "peerRouterId", "numChanges", "lastChangeTime", "lastUpTime",
                "lastDownTime", "nbrPrio", "bfdStatus", "lsaRetxCnt"]
    nbr = ospf_nbr.select(
        *key, F.col("state").alias("adjState"), F.col("ipAddress").alias("__nbr_ip"),
        *[c for c in nbr_only if c in ospf_nbr.columns])
    df = ospf_if.withColumnRenamed("state", "ifState").join(nbr, key, "left")
    adj = F.coalesce("adjState", F.lit(""))
    passive = F.coalesce("passive", F.lit(False))
    adj = F.when(adj != "", adj).when(passive, F.lit("passive")).otherwise(F.lit("fail"))
    df = df.withColumns({
        "adjState": adj,
        "ipAddress": F.when(_blank("ipAddress"), F.coalesce("__nbr_ip", F.lit("")))
        .otherwise(F.col("ipAddress")),
    })
    is_passive = F.col("adjState") == "passive"
    df = df.withColumn(
        "peerIP", F.when(is_passive, F.lit("")).otherwise(F.coalesce("peerIP", F.lit("-"))))
    for c in ("numChanges", "lastChangeTime"):
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(c, F.lit(0)))
    if "peerRouterId" in df.columns:
        df = df.withColumn("peerRouterId", F.when(is_passive, F.lit("")).otherwise(
            F.coalesce("peerRouterId", F.lit(""))))
    return df.drop("__nbr_ip", "passive")


def address_owners(ifs: DataFrame) -> DataFrame:
    """(namespace, address) -> the interface that owns it; loopbacks do not count."""
    owned = ifs.where("type != 'loopback'").select(
        "namespace", "hostname", "ifname", F.explode("ipAddressList").alias("__a")
    ).withColumn("address", ip.address_part("__a"))
    return unique_by(owned, ["namespace", "address"], ownerHost="hostname", ownerIf="ifname")


def ospf_peernames(ospf: DataFrame, lldp: DataFrame, ifs: DataFrame) -> DataFrame:
    """Peer host and interface: from LLDP, else by address in OSPF, else by address owner."""
    df = ospf.drop("peerHostname", "peerIfname").withColumns({
        "__port": text.parent_ifname("ifname"), "__ip": ip.address_part("peerIP")})
    near = unique_by(lldp, [*NS_HOST, "ifname"], __lh="peerHostname", __li="peerIfname")
    df = _lookup(df, near, {"namespace": "namespace", "hostname": "hostname", "__port": "ifname"})
    own = ospf.withColumn("__a", ip.address_part("ipAddress")).where("__a != ''")
    same = unique_by(own, ["namespace", "vrf", "__a"], __oh="hostname")
    df = _lookup(df, same, {"namespace": "namespace", "vrf": "vrf", "__ip": "__a"})
    df = _lookup(df, address_owners(ifs), {"namespace": "namespace", "__ip": "address"})
    by_lldp, by_ospf = ~_blank("__lh"), ~_blank("__oh")
    known = F.col("adjState") != "passive"
    host = (F.when(by_lldp, F.col("__lh")).when(by_ospf, F.col("__oh"))
            .otherwise(F.coalesce("ownerHost", F.lit(""))))
    port = (F.when(by_lldp, F.coalesce("__li", F.lit("")))
            .when(by_ospf & (F.coalesce("ownerHost", F.lit("")) != F.col("__oh")), F.lit(""))
            .otherwise(F.coalesce("ownerIf", F.lit(""))))
    return df.withColumns({
        "peerHostname": F.when(known, host).otherwise(F.lit("")),
        "peerIfname": F.when(known, port).otherwise(F.lit("")),
    }).drop("__port", "__ip", "__lh", "__li", "__oh", "ownerHost", "ownerIf")


# -- BGP --------------------------------------------------------------------

def bgp_peer_match(bgp: DataFrame) -> DataFrame:
    """Fill the peer host of established sessions: who sources from my peer address."""
    sources = unique_by(
        bgp.where("updateSource != ''"), ["namespace", "updateSource"], __peer="hostname")
    df = _lookup(bgp, sources, {"namespace": "namespace", "peerIP": "updateSource"})
    fill = _blank("peerHostname") & (F.col("state") == "Established")
    return df.withColumn(
        "peerHostname",
        F.coalesce(F.when(fill, F.col("__peer")).otherwise(F.col("peerHostname")), F.lit("")),
    ).drop("__peer")


def bgp_reverse_session(bgp: DataFrame) -> DataFrame:
    """Add the other end's view of a session: its AS numbers, null where there is none."""
    ends = unique_by(
        bgp.where("updateSource != '' and peerIP != ''"),
        ["namespace", "updateSource", "peerIP"], revHost="hostname", revAsn="asn",
        revPeerAsn="peerAsn")
    return _lookup(bgp, ends, {
        "namespace": "namespace", "peerIP": "updateSource", "updateSource": "peerIP"})


# -- LLDP -------------------------------------------------------------------

def lldp_resolve(lldp: DataFrame, ifs: DataFrame) -> DataFrame:
    """Peer port by the peer's MAC or ifIndex where LLDP only gave '-'."""
    macs = unique_by(
        ifs.where("macaddr is not null and macaddr != ''"),
        ["namespace", "hostname", "macaddr"], __by_mac="ifname")
    idx = unique_by(ifs.where("ifindex != 0"), ["namespace", "hostname", "ifindex"],
                    __by_idx="ifname")
    df = _lookup(lldp, macs, {
        "namespace": "namespace", "peerHostname": "hostname", "peerMacaddr": "macaddr"})
    df = _lookup(df, idx, {
        "namespace": "namespace", "peerHostname": "hostname", "peerIfindex": "ifindex"})
    subtype = F.lower(F.coalesce("subtype", F.lit("")))
    found = (
        F.when(subtype.isin("", "mac address"), F.col("__by_mac"))
        .when(subtype.startswith("locally"), F.col("__by_idx")))
    return df.withColumn(
        "peerIfname",
        F.when(F.col("peerIfname") == "-", F.coalesce(found, F.lit("-")))
        .otherwise(F.col("peerIfname")),
    ).drop("__by_mac", "__by_idx")


def lldp_to_bond(lldp: DataFrame, ifs: DataFrame) -> DataFrame:
    """Member ports replaced by their bond, on both ends."""
    bonds = unique_by(
        ifs.where("type in ('bond_slave', 'bond') and master not in ('bridge', 'default', '')"),
        [*NS_HOST, "ifname"], __bond="master")
    mine = _lookup(lldp, bonds, {
        "namespace": "namespace", "hostname": "hostname", "ifname": "ifname"}
    ).withColumn("ifname", F.coalesce("__bond", "ifname")).drop("__bond")
    both = _lookup(mine, bonds, {
        "namespace": "namespace", "peerHostname": "hostname", "peerIfname": "ifname"}
    ).withColumn("peerIfname", F.coalesce("__bond", "peerIfname")).drop("__bond")
    return keep_last(both, [*NS_HOST, "ifname"],
                     [F.col("peerHostname").asc(), F.col("peerIfname").asc()])


def strip_fqdn(df: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Peer names lose their domain when the short name is a known host."""
    known = (hosts if hosts is not None else df).select(
        F.col("hostname").alias("__short")).distinct()
    return (
        df.withColumn("__name", text.strip_domain("peerHostname"))
        .join(known, F.col("__name") == F.col("__short"), "left")
        .withColumn("peerHostname", F.coalesce("__short", "peerHostname"))
        .drop("__name", "__short")
    )


# -- EVPN, device, inventory, namespace -------------------------------------

def evpn_enrich(vnis: DataFrame, ifs: DataFrame, macs: DataFrame) -> DataFrame:
    """VLAN by interface, VRF by the SVI of the VLAN, MAC counts by VLAN."""
    by_name = unique_by(ifs, [*NS_HOST, "ifname"], __vlan="vlan")
    svi = unique_by(
        ifs.where("type = 'vlan' and master is not null and master != ''"),
        [*NS_HOST, "vlan"], __vrf="master")
    counts = macs.where("flags in ('dynamic', 'remote')").groupBy(*NS_HOST, "vlan").agg(
        F.count("macaddr").alias("__macs"))
    host = {"namespace": "namespace", "hostname": "hostname"}
    df = _lookup(vnis, by_name, {**host, "ifname": "ifname"})
    df = df.withColumn("vlan", F.coalesce(
        F.when(F.coalesce("vlan", F.lit(0)) == 0, F.col("__vlan")), "vlan", F.lit(0)
    ).cast("bigint")).drop("__vlan")
    df = _lookup(df, svi, {**host, "vlan": "vlan"})
    df = df.withColumn(
        "vrf", F.when(_blank("vrf"), F.coalesce("__vrf", F.lit(""))).otherwise(F.col("vrf"))
    ).drop("__vrf")
    df = _lookup(df, counts, {**host, "vlan": "vlan"})
    return df.withColumn("numMacs", F.when(
        F.coalesce("numMacs", F.lit(0)) == 0, F.coalesce("__macs", F.lit(0))
    ).otherwise(F.col("numMacs"))).drop("__macs")


# Fixed value: poller status of a device whose system is not supported.
UNSUPPORTED_STATUS = 418


def device_status(devices: DataFrame, poller: DataFrame) -> DataFrame:
    """Devices with poll failures: never polled ones appear, inactive ones are dead.

    ``devices`` is the latest state including tombstones, ``poller`` the latest
    failing rows of the device service.  A poller row may name a device by its
    address.
    """
    addresses = unique_by(devices.where("address != ''"), ["namespace", "address"],
                          __host="hostname")
    failed = _lookup(poller, addresses, {"namespace": "namespace", "hostname": "address"})
    failed = failed.select(
        "namespace", F.coalesce("__host", "hostname").alias("hostname"),
        F.col("status").alias("__code"), F.col("timestamp").alias("__polled"))
    failed = keep_last(failed, NS_HOST, [F.col("__polled").desc(), F.col("__code").desc()])
    known = devices.withColumns({
        "status": F.when(F.col("active"), F.col("status")).otherwise(F.lit("dead"))})
    df = known.withColumn("__known", F.lit(True)).join(failed, NS_HOST, "full")
    missing = F.col("__known").isNull()
    df = df.withColumns({
        "status": F.when(missing, F.lit("neverpoll")).otherwise(F.col("status")),
        "timestamp": F.coalesce("timestamp", "__polled"),
        "active": F.coalesce("active", F.lit(True)),
        "address": F.when(missing, F.col("hostname")).otherwise(F.col("address")),
    })
    if "bootupTimestamp" in df.columns:
        df = df.withColumn("bootupTimestamp", F.coalesce("bootupTimestamp", F.lit(0.0)))
    for c in ("version", "os", "model", "vendor", "architecture", "serialNumber"):
        if c in df.columns:
            df = df.withColumn(c, F.when(missing, F.lit("N/A")).otherwise(F.col(c)))
    for c in ("version", "os", "model"):
        if c in df.columns:
            df = df.withColumn(c, F.when(
                F.coalesce("__code", F.lit(0)) == UNSUPPORTED_STATUS, F.lit("unsupported")
            ).otherwise(F.col(c)))
    return df.drop("__known", "__code", "__polled")


def inventory_ifnames(inventory: DataFrame, ifs: DataFrame) -> DataFrame:
    """Transceiver rows get the name of the interface with the same port number."""
    ports = unique_by(
        ifs.where("type in ('ethernet', 'flexible-ethernet', 'bond_slave')")
        .withColumn("__port", text.port_number("ifname")),
        [*NS_HOST, "__port"], __ifname="ifname")
    number = F.when(
        (F.col("type") == "xcvr") & F.col("name").contains("port-"),
        F.get(F.split("name", "port-"), F.lit(1)))
    df = _lookup(inventory.withColumn("__num", number), ports, {
        "namespace": "namespace", "hostname": "hostname", "__num": "__port"})
    return df.withColumn("name", F.coalesce("__ifname", "name")).drop("__num", "__ifname")


# Flag of a namespace -> table whose rows prove it.
PRESENCE = {"hasOspf": "ospf", "hasBgp": "bgp", "hasVxlan": "evpnVni", "hasMlag": "mlag"}


def namespace_rollup(devices: DataFrame, poller: DataFrame,
                     protocols: dict[str, DataFrame]) -> DataFrame:
    """One row per polled namespace: devices, services, failing services, protocols."""
    hosts = devices.select(*NS_HOST).distinct()
    polled = poller.join(hosts, NS_HOST)
    bad = ~F.col("status").isin(0, 200)
    out = polled.groupBy("namespace").agg(
        F.countDistinct("service").alias("serviceCnt"),
        F.countDistinct(F.when(bad, F.col("service"))).alias("errSvcCnt"),
        F.max("timestamp").alias("lastUpdate"))
    counts = hosts.groupBy("namespace").agg(F.count(F.lit(1)).alias("deviceCnt"))
    out = out.join(counts, "namespace")
    for flag, table in PRESENCE.items():
        if table not in protocols:
            out = out.withColumn(flag, F.lit(False))
            continue
        have = protocols[table].select(*NS_HOST).distinct().join(
            hosts, NS_HOST, "left_semi").select("namespace").distinct()
        out = out.join(have.withColumn(flag, F.lit(True)), "namespace", "left").withColumn(
            flag, F.coalesce(flag, F.lit(False)))
    return out.select("namespace", "deviceCnt", "serviceCnt", "errSvcCnt", *PRESENCE,
                      F.lit(True).alias("active"), "lastUpdate")


# -- ARP, interfaces, MLAG --------------------------------------------------

def arpnd_with_vrf(arp: DataFrame, ifs: DataFrame) -> DataFrame:
    """ARP rows that did not fail, with the VRF of their interface, one per address and port."""
    vrfs = unique_by(ifs, [*NS_HOST, "ifname"], vrf="master")
    df = _lookup(arp.where("state != 'failed'"), vrfs, {
        "namespace": "namespace", "hostname": "hostname", "oif": "ifname"})
    df = df.withColumn("vrf", F.when(F.col("vrf") == "", F.lit("default")).otherwise(F.col("vrf")))
    return keep_last(df, [*NS_HOST, "ipAddress", "oif"],
                     [F.col("timestamp").desc(), F.col("macaddr").asc()])


def _no_addresses(c) -> Column:
    return F.coalesce(F.size(c), F.lit(-1)) <= 0


def interfaces_portmode(ifs: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """Add ``portmode``; ``modes`` are the configured ones (namespace, hostname, ifname,
    portmode, vlan) and also set the VLAN of their port."""
    routed = ~_no_addresses("ipAddressList") | ~_no_addresses("ip6AddressList")
    mode = F.when(routed, F.lit("routed")).otherwise(F.lit("unknown"))
    df = ifs
    if modes is not None:
        configured = unique_by(modes, [*NS_HOST, "ifname"], __mode="portmode", __mvlan="vlan")
        df = _lookup(df, configured, {
            "namespace": "namespace", "hostname": "hostname", "ifname": "ifname"})
        mode = F.coalesce("__mode", mode)
        df = df.withColumn("vlan", F.when(
            F.coalesce("__mvlan", F.lit(0)) != 0, F.col("__mvlan")
        ).otherwise(F.col("vlan")).cast("int"))
    mode = (
        F.when((F.col("ifname") == "bridge") | (F.col("adminState") != "up"), F.lit(""))
        .when((F.col("type") == "vxlan") & (mode == "routed"), F.lit("trunk"))
        .otherwise(mode))
    return df.withColumn("portmode", mode).drop("__mode", "__mvlan")


def interfaces_vlanlist(ifs: DataFrame, vlans: DataFrame) -> DataFrame:
    """Add ``vlanList``: active VLANs of the port, empty on access and routed ports."""
    none = F.array().cast("array<bigint>")
    df = ifs.join(interfaces_to_vlans(vlans), [*NS_HOST, "ifname"], "left")
    plain = F.col("portmode").isin("access", "routed")
    return df.withColumn(
        "vlanList", F.when(plain, none).otherwise(F.coalesce("vlanList", none)))


def drop_parents_of_dot_zero(ifs: DataFrame) -> DataFrame:
    """A ``.0`` subinterface stands for its parent port: the parent row goes, and the
    child takes its name.  Adds ``pifname``, the port an interface sits on."""
    is_sub = F.col("type").isin("subinterface", "vlan")
    child = F.col("ifname").endswith(".0")
    df = ifs.withColumn("pifname", F.when(is_sub, text.parent_ifname("ifname"))
                        .otherwise(F.col("ifname")))
    parents = df.where(child).select(
        *NS_HOST, text.parent_ifname("ifname").alias("ifname")).distinct()
    df = df.join(parents, [*NS_HOST, "ifname"], "left_anti")
    return df.withColumns({
        "type": F.when(child, F.lit("ethernet")).otherwise(F.col("type")),
        "ifname": F.when(child, F.col("pifname")).otherwise(F.col("ifname")),
    })


PEER_FIELDS = ["mtu", "speed", "type", "portmode", "ipAddressList", "ip6AddressList", "vlan",
               "vlanList"]


def interface_peers(ifs: DataFrame, lldp: DataFrame) -> DataFrame:
    """Interfaces with their LLDP peer and, as ``<field>Peer``, the peer interface's state.

    Subinterfaces and SVIs find their peer by port and VLAN, others by name.
    """
    near = unique_by(lldp.where("peerIfname != '-'"), [*NS_HOST, "ifname"],
                     peerHostname="peerHostname", peerIfname="peerIfname")
    df = _lookup(ifs, near, {
        "namespace": "namespace", "hostname": "hostname", "pifname": "ifname"})
    sub = F.col("type").isin("subinterface", "vlan")

    def ends(rows: DataFrame, keys: list[str]) -> DataFrame:
        packed = F.struct(F.col("ifname").alias("__if"),
                          *[F.col(c).alias(f"{c}Peer") for c in PEER_FIELDS])
        return rows.groupBy(*keys).agg(F.min(packed).alias("__p"))

    by_name = _lookup(df.where(~sub), ends(ifs.where(~sub), [*NS_HOST, "ifname"]), {
        "namespace": "namespace", "peerHostname": "hostname", "peerIfname": "ifname"})
    tagged = df.where(sub)
    by_vlan = _lookup(
        tagged, ends(ifs.where(sub), [*NS_HOST, "pifname", "vlan"]), {
            "namespace": "namespace", "peerHostname": "hostname", "peerIfname": "pifname",
            "vlan": "vlan"})
    return by_name.unionByName(by_vlan).withColumn(
        "peerFound", F.col("__p").isNotNull()
    ).select("*", *[F.col("__p")[f"{c}Peer"].alias(f"{c}Peer") for c in PEER_FIELDS]).drop("__p")


def mlag_peers(mlag: DataFrame) -> DataFrame:
    """Per MLAG member: the other member of its pair and its own peer link."""
    members = mlag.where("systemId is not null and systemId != ''")
    # A system id names a pair; the first two hosts by name are it.
    pairs = members.groupBy("namespace", "systemId").agg(
        F.min("hostname").alias("__a"), F.max("hostname").alias("__b"))
    return members.join(pairs, ["namespace", "systemId"]).select(
        "namespace", "hostname", "systemId",
        F.when(F.col("hostname") == F.col("__a"), F.nullif("__b", "__a"))
        .otherwise(F.col("__a")).alias("mlagPeer"),
        text.expand_ifname("peerLink", "nxos").alias("peerLink"),
    ).distinct()


def bond_members(ifs: DataFrame) -> DataFrame:
    """(namespace, hostname, bond) -> sorted member ports."""
    return ifs.where("master is not null and master not in ('', 'bridge', 'default')").groupBy(
        "namespace", "hostname", F.col("master").alias("bond")
    ).agg(F.array_sort(F.collect_set("ifname")).alias("members"))
