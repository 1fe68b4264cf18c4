"""Hop-by-hop path tracing for a table of requests.

All requests advance together: one round is a handful of joins on the frontier
(the devices reached so far), and every round's frontier is written to the
checkpoint folder.  A device is entered once per VRF and path, so the rounds
end.  Each frontier row carries its own hops, which makes every equal-cost path
a row of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from netstate.functions import ip
from netstate.operators import enrich, lpm
from netstate.operators.enrich import NS_HOST, arpnd_with_vrf, mlag_peers, unique_by
from netstate.operators.views import keep_last
from netstate.session import cut_lineage, shuffle_if_large

# Fixed values.
MAX_MTU = 9216
IGNORED_PROTOCOL = "access-internal"
IGNORED_MAC_PORTS = ["bridge", "Vxlan1"]
SVI_PATTERN = r"^(Vlan|vlan|irb\.)"
NEXTHOP_VRF = "_nexthopVrf:"
UNDERLAY_VRF = "default"
ANYCAST_ERROR = "Possible anycast IP without anycast MAC"
PEER_LINK_PORT = "vPC Peer"
SUPERVISOR_PORT = "sup-eth1"
RECURSION = 2

HOP = (
    "struct<hostname:string,iif:string,oif:string,vrf:string,isL2:boolean,overlay:boolean,"
    "mtuMatch:boolean,inMtu:bigint,outMtu:bigint,protocol:string,ipLookup:string,"
    "vtepLookup:string,macLookup:string,nexthopIp:string,hopError:string,timestamp:bigint>"
)
HOP_FIELDS = [f.split(":")[0] for f in HOP[len("struct<"):-1].split(",")]


class PathError(ValueError):
    """A request that cannot be traced."""


def _empty_if_null(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _join(df: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a table that may be large: every round does, so not by way of the driver."""
    return df.join(shuffle_if_large(right), on, how)


def _lookup(df: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    return enrich._lookup(df, shuffle_if_large(right), on)


def _vrf_of(master: Column) -> Column:
    return F.when(master.isin("", "bridge"), F.lit("default")).otherwise(master)


class PathTables:
    """The tables a trace looks things up in: read, keyed and written out once.

    Every round joins these again, so they go to the checkpoint folder instead
    of being derived from the logs each time.
    """

    def __init__(self, ifs: DataFrame, routes: DataFrame, arp: DataFrame, macs: DataFrame,
                 mlag: DataFrame | None = None):
        none = F.array().cast("array<string>")
        ifs = cut_lineage(ifs.select(
            *NS_HOST, "ifname", "state", "mtu", "type", "master", "macaddr", "vlan",
            "ipAddressList", "ip6AddressList", "timestamp"))
        arp, macs = cut_lineage(arp), cut_lineage(macs)
        self.ifs = ifs.where("state = 'up'")
        self.ports = cut_lineage(unique_by(
            self.ifs, [*NS_HOST, "ifname"], mtu="mtu", master="master", vlan="vlan",
            iftype="type", mac="macaddr"))
        self.addresses = cut_lineage(self.ifs.where("type != 'bond_slave'").select(
            *NS_HOST, "ifname", "mtu", "type", "master", "macaddr", "vlan", "timestamp",
            F.explode(F.concat(F.coalesce("ipAddressList", none),
                               F.coalesce("ip6AddressList", none))).alias("cidr")
        ).withColumn("ip", F.lower(ip.address_part("cidr"))))
        fine = routes.where(F.col("protocol") != IGNORED_PROTOCOL)
        self.routes = cut_lineage(lpm.with_prefix_key(fine).select(
            *NS_HOST, "vrf", "prefix", "nexthopIps", "oifs", "protocol", "timestamp",
            "fam", "plen", "net_hi", "net_lo"))
        self.lengths = lpm.prefix_lengths(self.routes)
        with_vrf = cut_lineage(arpnd_with_vrf(arp, shuffle_if_large(ifs)))
        self.arp = cut_lineage(unique_by(
            with_vrf.withColumn("port", F.regexp_replace("oif", r"-v0$", "")),
            [*NS_HOST, "ipAddress", "port"], arpMac="macaddr", arpRemote="remote", arpVrf="vrf"))
        self.arp_any = cut_lineage(unique_by(
            with_vrf, [*NS_HOST, "ipAddress"],
            arpOif="oif", arpMac="macaddr", arpRemote="remote", arpVrf="vrf"))
        self.macs = macs
        self.mac_by_vlan = cut_lineage(unique_by(
            macs.withColumn("vlan", F.col("vlan").cast("bigint")),
            [*NS_HOST, "macaddr", "vlan"], macOif="oif", macVtep="remoteVtepIp",
            macTs="timestamp"))
        self.mac_vtep = unique_by(
            macs.where("coalesce(remoteVtepIp, '') != ''"), [*NS_HOST, "macaddr"],
            macVtep="remoteVtepIp")
        # Owners of an address, of a MAC and of both, as a digest of their names: whether an
        # address is anycast is told without meeting its owners.
        owners = self.addresses.select("namespace", "hostname", "ip", "macaddr").distinct()
        held = self.ifs.where("type != 'bond_slave'").select(
            "namespace", "hostname", "macaddr").distinct()
        self.by_address = cut_lineage(_owner_sets(owners, ["namespace", "ip"]))
        self.by_mac = cut_lineage(_owner_sets(held, ["namespace", "macaddr"]))
        self.by_both = cut_lineage(_owner_sets(owners, ["namespace", "ip", "macaddr"]))
        links = shuffle_if_large(
            mlag.select(*NS_HOST, "systemId", "peerLink")) if mlag is not None else None
        self.peer_links = cut_lineage(mlag_peers(links).select(
            *NS_HOST, F.col("peerLink").alias("__link"))) if mlag is not None else None

    def real_ports(self, df: DataFrame, host: str, port: str) -> DataFrame:
        """Port names that stand for another port: the peer link, the supervisor port."""
        name = F.when(F.col(port).startswith(SUPERVISOR_PORT), F.lit("loopback0")).otherwise(
            F.col(port))
        if self.peer_links is None:
            return df.withColumn(port, name)
        df = _lookup(df, self.peer_links, {"namespace": "namespace", host: "hostname"})
        return df.withColumn(port, F.when(
            F.col(port).startswith(PEER_LINK_PORT), F.coalesce("__link", port)
        ).otherwise(name)).drop("__link")

    def best_routes(self, *wanted: tuple[DataFrame, str, str]) -> DataFrame:
        """Best routes of (rows, address column, VRF column) lookups on each row's device.

        One pass for all of them, written out: (namespace, hostname, vrf, addr, route).
        """
        keys = reduce(DataFrame.unionByName, [
            df.select("namespace", F.col("device").alias("hostname"), F.col(vrf).alias("vrf"),
                      F.col(addr).alias("addr"))
            for df, addr, vrf in wanted]).where("addr is not null and addr != ''").distinct()
        fields = ["prefix", "nexthopIps", "oifs", "protocol", "timestamp"]
        found = lpm.lpm_join(shuffle_if_large(keys), self.routes, "addr", columns=fields, lengths=self.lengths)
        return cut_lineage(found.select(
            "namespace", "hostname", "vrf", "addr", F.struct(*fields).alias("route")))


def _owner_sets(owners: DataFrame, keys: list[str]) -> DataFrame:
    """Per key digests of the sets of its hosts and of its MACs."""
    hosts = owners.select(*keys, "hostname").distinct().groupBy(*keys).agg(
        F.bit_xor(F.xxhash64("hostname")).alias("hosts"))
    if "macaddr" in keys:
        return hosts
    macs = owners.select(*keys, "macaddr").distinct().groupBy(*keys).agg(
        F.bit_xor(F.xxhash64("macaddr")).alias("macs"))
    return _join(hosts, macs, keys)


def _attach(df: DataFrame, found: DataFrame, addr: str, vrf: str, name: str) -> DataFrame:
    return _lookup(df, found.withColumnRenamed("route", name), {
        "namespace": "namespace", "device": "hostname", vrf: "vrf", addr: "addr"})


# -- ends -------------------------------------------------------------------

def first_hop_router(requests: DataFrame, addr: str, t: PathTables) -> DataFrame:
    """Switch ports behind which an address sits: one MAC in local ARP, then local MACs."""
    local = _join(
        requests, t.arp_any.withColumnRenamed("ipAddress", addr), ["namespace", addr]
    ).where("not arpRemote")
    one = local.groupBy("req").agg(F.countDistinct("arpMac").alias("__n")).where("__n = 1")
    local = _join(local, one.select("req"), "req")
    entries = t.macs.where(
        (F.coalesce("remoteVtepIp", F.lit("")) == "") & (F.col("vlan") != 0)
        & ~F.col("oif").isin(IGNORED_MAC_PORTS))
    ports = unique_by(entries, [*NS_HOST, "macaddr"], macOif="oif", macVlan="vlan")
    local = _lookup(local, ports, {
        "namespace": "namespace", "hostname": "hostname", "arpMac": "macaddr"})
    local = local.withColumn("port", F.coalesce(
        "macOif", F.regexp_replace("arpOif", r"-v0$", "")))
    local = _lookup(local, t.ports, {
        "namespace": "namespace", "hostname": "hostname", "port": "ifname"})
    usable = local.where(F.col("iftype").isNotNull() & (
        F.col("macOif").isNotNull() | (F.col("iftype") == "vlan")))
    return usable.select(
        "req", F.col("hostname").alias("device"), F.col("port").alias("ifname"), "mtu",
        F.col("arpVrf").alias("vrf"), F.lit(True).alias("viaArp"),
        F.lit(None).cast("string").alias("cidr"), F.lit(None).cast("bigint").alias("timestamp"))


def svi_owners(requests: DataFrame, addr: str, t: PathTables) -> DataFrame:
    """SVIs whose subnet holds the address, where at most two hosts have one."""
    svis = lpm.with_prefix_key(
        t.addresses.where(F.col("ifname").rlike(SVI_PATTERN)), "cidr")
    wanted = requests.select("namespace", F.col(addr).alias("__a")).distinct()
    pairs = lpm.containing(
        shuffle_if_large(wanted), svis.select("namespace", "hostname", "ifname", "mtu", "master", "cidr",
                            "timestamp", "fam", "plen", "net_hi", "net_lo"),
        "__a", ["namespace"]).where("plen > 0")
    few = pairs.groupBy("namespace", "__a").agg(
        F.countDistinct("hostname").alias("__n")).where("__n <= 2").drop("__n")
    pairs = _join(pairs, few, ["namespace", "__a"])
    rows = _join(requests, pairs.withColumnRenamed("__a", addr), ["namespace", addr])
    return rows.select(
        "req", F.col("hostname").alias("device"), "ifname", "mtu",
        _vrf_of(F.col("master")).alias("vrf"), F.lit(True).alias("viaArp"), "cidr", "timestamp")


def resolve_end(requests: DataFrame, addr: str, t: PathTables, svis: bool) -> DataFrame:
    """Devices an address starts or ends at: owner, else first-hop router, else SVI."""
    own = _join(requests, t.addresses.withColumnRenamed("ip", addr), ["namespace", addr])
    own = keep_last(own, ["req", "hostname"], [
        (F.col("type") == "loopback").desc(), F.col("ifname").asc()])
    found = own.select(
        "req", F.col("hostname").alias("device"), "ifname", "mtu",
        _vrf_of(F.col("master")).alias("vrf"), F.lit(False).alias("viaArp"), "cidr",
        "timestamp")
    makers = [first_hop_router] + ([svi_owners] if svis else [])
    for maker in makers:
        rest = _join(requests, found.select("req").distinct(), "req", "left_anti")
        if not rest.limit(1).count():
            break
        found = cut_lineage(found.unionByName(maker(rest, addr, t)))
    return keep_last(found, ["req", "device"], [F.col("ifname").asc()])


# -- one round --------------------------------------------------------------

def _with_hop(df: DataFrame, **fields: Column) -> DataFrame:
    """Append a hop built from the frontier row and the given fields."""
    values = {
        "hostname": F.col("device"), "iif": F.col("iif"), "oif": F.lit(""),
        "vrf": F.col("vrf"), "isL2": F.col("isL2"), "overlay": F.lit(False),
        "mtuMatch": F.col("mtuMatch"), "inMtu": F.col("inMtu"), "outMtu": F.col("inMtu"),
        "protocol": F.lit(""), "ipLookup": F.lit(""), "vtepLookup": F.lit(""),
        "macLookup": F.lit(""), "nexthopIp": F.lit(""), "hopError": F.col("errors"),
        "timestamp": F.col("ts"),
    }
    values.update(fields)
    hop = F.struct(*[values[f].alias(f) for f in HOP_FIELDS]).cast(HOP)
    return df.withColumn("hops", F.concat("hops", F.array(hop)))


def _add_error(errors: Column, cond: Column, name: str) -> Column:
    joined = F.when(errors == "", F.lit(name)).otherwise(
        F.concat(errors, F.lit(", "), F.lit(name)))
    return F.when(F.coalesce(cond, F.lit(False)), joined).otherwise(errors)


def finish_at_destination(frontier: DataFrame, dests: DataFrame) -> DataFrame:
    """Rows on a destination device get their last hop; others keep ``d_ifname`` null."""
    ends = dests.select(
        "req", F.col("device"), F.col("ifname").alias("d_ifname"), F.col("mtu").alias("d_mtu"),
        F.col("vrf").alias("d_vrf"))
    return _join(frontier, ends, ["req", "device"], "left")


def _expand(rows: DataFrame) -> DataFrame:
    """One row per next hop of ``route``: ``nhip`` and ``nh_oif``, blank where not given."""
    none = F.array().cast("array<string>")
    nhs = F.coalesce(F.col("route.nexthopIps"), none)
    oifs = F.coalesce(F.col("route.oifs"), none)
    blank = F.array(F.struct(F.lit("").alias("nhip"), F.lit("").alias("nh_oif")))
    pairs = F.when(F.greatest(F.size(nhs), F.size(oifs)) == 0, blank).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(nhs), F.size(oifs), F.lit(1)) - 1),
        lambda i: F.struct(F.coalesce(F.get(nhs, i), F.lit("")).alias("nhip"),
                           F.coalesce(F.get(oifs, i), F.lit("")).alias("nh_oif"))))
    return rows.withColumn("__p", F.explode(pairs)).select("*", "__p.*").drop("__p")


def _resolve_recursive(hops: DataFrame, t: PathTables) -> DataFrame:
    """Next hops without a port: look the next hop itself up, two levels deep."""
    done = hops
    for _ in range(RECURSION):
        open_end = (F.col("nh_oif") == "") & (F.col("nhip") != "") & (F.col("vtep") == "")
        again = done.where(open_end)
        if not again.limit(1).count():
            return done
        found = t.best_routes((again, "nhip", "lookupVrf"))
        again = _attach(again.drop("route").withColumnRenamed("nhip", "asked"), found, "asked",
                        "lookupVrf", "route").drop("nh_oif").where("route is not null")
        direct = F.col("route.protocol").isin("direct", "local", "connected", "kernel")
        # A connected route leaves the next hop as it was; any other replaces it.
        more = _expand(again).withColumn("nhip", F.when(
            direct | (F.col("nhip") == ""), F.col("asked")).otherwise(F.col("nhip")))
        done = cut_lineage(done.where(~open_end).unionByName(
            more.withColumn("nh_arp_oif", F.col("nh_oif")).select(*done.columns)))
    return done


def _peers(rows: DataFrame, t: PathTables, routers: DataFrame) -> DataFrame:
    """Next hop to peer device and interface: by ARP and MAC owner, else address owner.

    On a source that is not itself a first-hop router, only its first-hop routers are
    next: of an anycast gateway those the source is attached to.  Where none of
    them has the next hop's address (a central gateway), the packet is bridged to it by
    way of them.  Such rows meet their few routers, not all owners of the address.
    """
    rows = rows.withColumn("__nh", F.when(F.col("nhip") == "", F.col("target")).otherwise(
        F.col("nhip")))
    rows = _lookup(rows.drop("arpMac", "arpRemote", "arpVrf"), t.arp, {
        "namespace": "namespace", "device": "hostname", "__nh": "ipAddress", "nh_arp_oif": "port"})
    rows = rows.withColumn("arpMac", F.when(
        (F.col("via") != "") & (F.col("vtep") == ""), F.col("viaMac")).otherwise(F.col("arpMac")))
    rows = _owner_facts(rows, t)
    own = routers.select("req", F.col("device"), F.lit(True).alias("__router"))
    rows = _join(rows, own.distinct(), ["req", "device"], "left")
    rows = _join(
        rows, routers.select("req", F.lit(True).alias("__routed")).distinct(), "req", "left")
    behind = F.col("first") & F.col("__routed").isNotNull() & F.col("__router").isNull()
    rows = cut_lineage(rows.withColumn("__behind", behind).drop("__router", "__routed"))
    attached = _by_routers(rows.where("__behind").drop("__behind"), t, routers)
    facts = ["__rank", "__anycast"]
    free = _by_owners(rows.where("not __behind").drop("__behind", *facts), t)
    free = free.withColumns({"l2hop": F.lit(False), "anycast": F.lit(False)})
    return free.unionByName(attached)


def _owner_facts(rows: DataFrame, t: PathTables) -> DataFrame:
    """Add how a next hop is owned: __rank 0 by MAC and address, 1 by MAC, 2 by address
    (null: by nobody), and __anycast where the owners by address are others."""
    for name, table, on in (
        ("both", t.by_both, {"__nh": "ip", "arpMac": "macaddr"}),
        ("mac", t.by_mac, {"arpMac": "macaddr"}), ("ip", t.by_address, {"__nh": "ip"}),
    ):
        named = table.select(*[F.col(c) for c in table.columns if c not in ("hosts", "macs")],
                             *[F.col(c).alias(f"__{name}_{c}") for c in ("hosts", "macs")
                               if c in table.columns])
        rows = _lookup(rows, named, {"namespace": "namespace", **on})
    by_mac = F.coalesce("__both_hosts", "__mac_hosts")
    rank = F.when(F.col("__both_hosts").isNotNull(), 0).when(
        F.col("__mac_hosts").isNotNull(), 1).when(F.col("__ip_hosts").isNotNull(), 2)
    other = (by_mac != F.col("__ip_hosts")) & (F.xxhash64("arpMac") != F.col("__ip_macs"))
    return rows.withColumns({
        "__rank": rank, "__anycast": F.coalesce(other, F.lit(False))}).drop(
        "__both_hosts", "__mac_hosts", "__ip_hosts", "__ip_macs")


def _by_routers(rows: DataFrame, t: PathTables, routers: DataFrame) -> DataFrame:
    """Peers of rows on a source: its first-hop routers."""
    ports = routers.select("req", F.col("device").alias("peer"), F.col("ifname").alias("peerIf"),
                           F.col("mtu").alias("peerMtu"))
    met = _join(rows.where("__rank is not null"), ports, "req")
    owned = t.addresses.select(*NS_HOST, "ip", F.lit(True).alias("__by_ip"))
    both = t.addresses.select(*NS_HOST, "ip", "macaddr", F.lit(True).alias("__by_both"))
    macs = t.ifs.where("type != 'bond_slave'").select(
        *NS_HOST, "macaddr", F.lit(True).alias("__by_mac"))
    host = {"namespace": "namespace", "peer": "hostname"}
    met = _lookup(met, both.distinct(), {**host, "__nh": "ip", "arpMac": "macaddr"})
    met = _lookup(met, macs.distinct(), {**host, "arpMac": "macaddr"})
    met = _lookup(met, owned.distinct(), {**host, "__nh": "ip"})
    is_owner = F.coalesce(F.when(F.col("__rank") == 0, F.col("__by_both")).when(
        F.col("__rank") == 1, F.col("__by_mac")).otherwise(F.col("__by_ip")), F.lit(False))
    met = cut_lineage(met.withColumn("__owner", is_owner).drop("__by_ip", "__by_both", "__by_mac"))
    hop_key = ["req", "pathkey", "nhip", "nh_oif"]
    some = met.where("__owner").select(*hop_key).distinct().withColumn("__some", F.lit(True))
    met = _join(met, some, hop_key, "left").where("__owner or __some is null")
    bridged = F.col("__some").isNull() | F.col("__anycast")
    return met.withColumns({
        "peerMac": F.col("arpMac"), "l2hop": bridged, "anycast": F.col("__anycast")}).drop(
        "__nh", "__rank", "__anycast", "__owner", "__some", "arpMac", "arpRemote", "arpVrf")


def _by_owners(rows: DataFrame, t: PathTables) -> DataFrame:
    """Peers of rows in transit: all owners of the next hop."""
    owner = t.addresses.select(
        "namespace", F.col("ip").alias("o_ip"), F.col("hostname").alias("peer"),
        F.col("ifname").alias("peerIf"), F.col("mtu").alias("peerMtu"),
        F.col("macaddr").alias("peerMac"))
    by_ip = _join(rows, owner.withColumnRenamed("o_ip", "__nh"), ["namespace", "__nh"], "left")
    by_ip = by_ip.where("peer is null or peer != device")
    both = F.col("arpMac").isNotNull() & (F.col("arpMac") == F.col("peerMac"))
    by_ip = by_ip.withColumn("rank", F.when(both, 0).when(F.col("peer").isNotNull(), 2))
    mac_owner = t.ifs.where("type != 'bond_slave'").select(
        "namespace", F.col("macaddr").alias("o_mac"), F.col("hostname").alias("peer"),
        F.col("ifname").alias("peerIf"), F.col("mtu").alias("peerMtu"),
        F.col("macaddr").alias("peerMac"))
    by_mac = _join(
        rows.where("arpMac is not null"), mac_owner.withColumnRenamed("o_mac", "arpMac"),
        ["namespace", "arpMac"])
    by_mac = by_mac.where("peer != device").withColumn("rank", F.lit(1))
    cols = [*rows.columns, "peer", "peerIf", "peerMtu", "peerMac", "rank"]
    every = cut_lineage(
        by_ip.where("rank is not null").select(*cols).unionByName(by_mac.select(*cols)))
    hop_key = ["req", "pathkey", "nhip", "nh_oif"]
    best = every.groupBy(*hop_key).agg(F.min("rank").alias("__best"))
    every = _join(every, best, hop_key).where("rank = __best").drop("__best")
    # Several interfaces of one peer share the MAC or the address (unnumbered
    # links): the peer's ARP entry for my own address names the right one.
    mine = unique_by(t.addresses, [*NS_HOST, "ifname"], __myip="ip")
    every = _lookup(every, mine, {
        "namespace": "namespace", "device": "hostname", "nh_oif": "ifname"})
    back = unique_by(t.arp, [*NS_HOST, "ipAddress"], __backport="port")
    every = _lookup(every, back, {
        "namespace": "namespace", "peer": "hostname", "__myip": "ipAddress"})
    picked = keep_last(every, [*hop_key, "peer"], [
        F.coalesce(F.col("peerIf") == F.col("__backport"), F.lit(False)).desc(),
        F.col("peerIf").asc()])
    return picked.drop("__myip", "__backport", "__nh", "rank", "arpMac", "arpRemote", "arpVrf")


def _next_hops(rows: DataFrame, t: PathTables, routers: DataFrame) -> DataFrame:
    """All next hops of live rows (with ``route`` attached), with peer and link facts.

    Adds nhip, nh_oif, vtep, macLookup, protocol, ipLookup and the peer columns.
    """
    transit = F.col("overlay") != ""
    routed = rows.withColumns({
        "protocol": F.when(F.col("isL2") & ~transit, F.lit("l2")).otherwise(
            _empty_if_null("route.protocol")),
        "ipLookup": _empty_if_null("route.prefix"),
        "ts": F.coalesce(F.col("route.timestamp"), F.col("ts")),
    })
    nhs = F.coalesce(F.col("route.nexthopIps"), F.array().cast("array<string>"))
    by_route = ((~F.col("isL2") | transit) & F.exists(nhs, lambda x: x != "")
                & (F.col("protocol") != "hmm"))

    hops = _expand(routed.where(by_route))
    # Overlay by route: the next hop is a VTEP of the named underlay VRF.
    # Overlay by ARP: the next hop is remote and its MAC sits behind a VTEP.
    hops = _lookup(hops, t.arp, {
        "namespace": "namespace", "device": "hostname", "nhip": "ipAddress", "nh_oif": "port"})
    hops = _lookup(hops, t.mac_vtep, {
        "namespace": "namespace", "device": "hostname", "arpMac": "macaddr"})
    hops = hops.withColumns({
        "vtep": F.when(F.col("nh_oif").startswith(NEXTHOP_VRF), F.col("nhip")).when(
            F.coalesce("arpRemote", F.lit(False)) & ~transit, _empty_if_null("macVtep")
        ).otherwise(F.lit("")),
        "macLookup": F.lit(""), "nh_arp_oif": F.col("nh_oif"),
    })

    # Delivery on the link: ARP for the target, then the MAC table of its VLAN.
    local = _lookup(routed.where(~by_route), t.arp_any, {
        "namespace": "namespace", "device": "hostname", "target": "ipAddress"})
    # Bridged to a gateway whose MAC is known: without ARP, in the VLAN it came in on.
    bridged = F.col("via") != ""
    local = local.withColumns({
        "__svi": F.coalesce(F.regexp_replace("arpOif", r"-v0$", ""), F.when(
            bridged, F.col("iif"))),
        "arpMac": F.when(bridged, F.col("viaMac")).otherwise(F.col("arpMac"))})
    local = _lookup(local, t.ports.select(
        *NS_HOST, "ifname", F.col("vlan").cast("bigint").alias("__vlan")), {
        "namespace": "namespace", "device": "hostname", "__svi": "ifname"})
    local = _lookup(local, t.mac_by_vlan, {
        "namespace": "namespace", "device": "hostname", "arpMac": "macaddr", "__vlan": "vlan"})
    local = local.where("arpMac is not null").withColumns({
        "nhip": F.lit(""), "nh_oif": F.coalesce("macOif", "__svi"),
        "vtep": _empty_if_null("macVtep"),
        "macLookup": F.when(F.col("macOif").isNotNull(), F.col("arpMac")).otherwise(F.lit("")),
        "nh_arp_oif": F.col("__svi"),
    })
    cols = [*routed.columns, "nhip", "nh_oif", "vtep", "macLookup", "nh_arp_oif"]
    both = _resolve_recursive(
        cut_lineage(hops.select(*cols).unionByName(local.select(*cols))), t)

    # Entering a tunnel: the way to the VTEP is a lookup of its own.
    entering = both.where("vtep != ''")
    if entering.limit(1).count():
        entering = entering.drop("route", "nhip", "nh_oif", "nh_arp_oif").withColumns({
            "lookupVrf": F.lit(UNDERLAY_VRF), "target": F.col("vtep")})
        found = t.best_routes((entering, "vtep", "lookupVrf"))
        under = _attach(entering, found, "vtep", "lookupVrf", "route").where("route is not null")
        under = _expand(under).withColumn("nh_arp_oif", F.col("nh_oif"))
        both = cut_lineage(both.where("vtep = ''").unionByName(under.select(*both.columns)))
    return _peers(both, t, routers)


def _lookup_vrf(rows: DataFrame, t: PathTables) -> DataFrame:
    """VRF in which a device handles the packet: of the interface it came in on."""
    facts = t.ports.select(*NS_HOST, "ifname", F.col("master").alias("__m"),
                           F.col("vlan").alias("__v"))
    rows = _lookup(rows, facts, {
        "namespace": "namespace", "device": "hostname", "iif": "ifname"})
    svi = unique_by(t.ifs.where("type = 'vlan'"), [*NS_HOST, "vlan"], __svi="master")
    rows = _lookup(rows, svi, {
        "namespace": "namespace", "device": "hostname", "__v": "vlan"})
    found = F.when(F.col("__m") == "bridge", _empty_if_null("__svi")).otherwise(
        _empty_if_null("__m"))
    by_port = F.when(found == "", F.lit("default")).otherwise(found)
    keep = (F.col("first") | F.col("decap") | (F.col("overlay") != "")
            | F.col("__m").isNull())
    return rows.withColumn("vrf", F.when(keep, F.col("vrf")).otherwise(by_port)).drop(
        "__m", "__v", "__svi")


# -- the trace --------------------------------------------------------------

def path(requests: DataFrame, t: PathTables) -> DataFrame:
    """Requests ``(req, namespace, src, dest[, vrf])`` to hops, one row per path and hop.

    Both ends must be of one address family.  A request whose source cannot be
    placed has no rows.
    """
    if "vrf" not in requests.columns:
        requests = requests.withColumn("vrf", F.lit(None).cast("string"))
    requests = requests.where(ip.ip_version("src") == ip.ip_version("dest")).select(
        "req", "namespace", F.lower("src").alias("src"), F.lower("dest").alias("dest"),
        F.col("vrf").alias("wantedVrf"))
    requests = cut_lineage(requests)
    starts = cut_lineage(resolve_end(requests, "src", t, svis=True))
    dests = cut_lineage(resolve_end(requests, "dest", t, svis=False))
    begin = _join(requests, starts, "req")
    in_arp = t.arp_any.select(
        "namespace", F.col("hostname").alias("device"), F.col("ipAddress").alias("dest"),
        F.lit(True).alias("__arp"))
    begin = _join(begin, in_arp, ["namespace", "device", "dest"], "left")
    same = F.when(F.col("viaArp"), F.coalesce("__arp", F.lit(False))).otherwise(
        ip.addr_in_cidr("dest", "cidr"))
    smallest = starts.groupBy("req").agg(F.min("mtu").alias("srcMtu"))
    frontier = _join(begin, smallest, "req").select(
        "req", "namespace", "src", "dest", "device", "srcMtu",
        F.coalesce(F.nullif("wantedVrf", F.lit("")), "vrf").alias("vrf"),
        F.col("ifname").alias("iif"), F.col("mtu").alias("inMtu"), same.alias("isL2"),
        F.lit("").alias("overlay"), F.lit(True).alias("mtuMatch"), F.lit("").alias("errors"),
        F.col("timestamp").alias("ts"), F.lit(False).alias("decap"),
        F.array().cast("array<string>").alias("visited"),
        F.array().cast(f"array<{HOP}>").alias("hops"), F.col("device").alias("pathkey"),
        F.lit(True).alias("first"), same.alias("linkL2"), F.lit("").alias("via"),
        F.lit("").alias("viaMac"))
    frontier = cut_lineage(frontier)
    # Devices that a polled source is attached to.
    polled = _join(requests, starts.where("not viaArp").select("req").distinct(), "req")
    routers = cut_lineage(first_hop_router(polled, "src", t))
    gateways = t.addresses.select(
        "namespace", F.col("hostname").alias("device"), F.col("ip").alias("via"),
        F.col("macaddr").alias("viaMac"), F.lit(True).alias("__gateway")).distinct()
    owns = t.addresses.select(
        "namespace", F.col("hostname").alias("device"), F.col("ip").alias("overlay"),
        F.lit(True).alias("__own")).distinct()
    done = []
    while frontier.limit(1).count():
        # Leave the tunnel on the device that owns its far end.
        rows = _join(frontier, owns, ["namespace", "device", "overlay"], "left")
        out = F.coalesce("__own", F.lit(False))
        rows = rows.withColumns({
            "decap": out, "overlay": F.when(out, F.lit("")).otherwise(F.col("overlay"))}
        ).drop("__own")
        # On the gateway a bridged packet goes on as it would have from its link.
        rows = _join(rows, gateways, ["namespace", "device", "via", "viaMac"], "left")
        there = (F.col("via") != "") & (F.coalesce("__gateway", F.lit(False)) | F.col("decap"))
        rows = rows.withColumns({
            "isL2": F.when(there, F.col("linkL2")).otherwise(F.col("isL2")),
            "via": F.when(there, F.lit("")).otherwise(F.col("via"))}).drop("__gateway")
        rows = _lookup_vrf(finish_at_destination(rows, dests), t)
        transit = F.col("overlay") != ""
        spot = F.concat_ws("|", "device", F.when(transit, F.lit("underlay")).otherwise(
            F.col("vrf")), F.col("isL2").cast("string"))
        rows = cut_lineage(rows.withColumns({
            "spot": spot, "looped": F.array_contains("visited", spot),
            "target": F.when(transit, F.col("overlay")).when(
                F.col("via") != "", F.col("via")).otherwise(F.col("dest")),
            "lookupVrf": F.when(transit, F.lit(UNDERLAY_VRF)).otherwise(F.col("vrf")),
        }))
        ended = rows.where("d_ifname is not null")
        stuck = rows.where("d_ifname is null and looped")
        live = rows.where("d_ifname is null and not looped")
        found = t.best_routes(
            (live, "target", "lookupVrf"), (live, "src", "vrf"), (ended, "src", "d_vrf"))

        errors = _add_error(F.col("errors"), F.col("d_mtu") != F.col("srcMtu"),
                            "Dst MTU != Src MTU")
        errors = _add_error(errors, F.col("rev").isNull() & ~F.col("isL2"), "no reverse path")
        # Delivered on a link by a device that neither routes back nor knows the target.
        known = t.arp_any.select(*NS_HOST, "ipAddress", F.lit(True).alias("__known"))
        arrived = _lookup(_attach(ended, found, "src", "d_vrf", "rev"), known, {
            "namespace": "namespace", "device": "hostname", "dest": "ipAddress"})
        errors = _add_error(
            errors, F.col("rev").isNull() & F.col("isL2") & F.col("__known").isNull()
            & ~F.col("first"), "no reverse path, possible flood")
        arrived = arrived.withColumn("errors", errors).drop("__known")
        arrived = _with_hop(arrived, oif=F.col("d_ifname"), vrf=F.col("d_vrf"),
                            isL2=F.lit(False), outMtu=F.col("d_mtu"))
        done.append(arrived.select("req", "namespace", "hops", F.lit("arrived").alias("end")))

        reason = F.when(transit, F.lit("Loop in underlay")).when(
            F.col("isL2"), F.lit("L2 Loop detected")).otherwise(F.lit("L3 loop"))
        stuck = stuck.withColumn("errors", F.when(F.col("errors") == "", reason).otherwise(
            F.concat("errors", F.lit(", "), reason)))
        done.append(_with_hop(stuck).select(
            "req", "namespace", "hops", F.lit("loop").alias("end")))

        live = _attach(_attach(live, found, "target", "lookupVrf", "route"), found, "src", "vrf",
                       "rev")
        live = live.withColumn("errors", _add_error(
            F.col("errors"), F.col("rev").isNull() & ~F.col("first") & ~F.col("isL2")
            & (F.col("overlay") == ""), "no reverse path")).drop("rev")
        nexts = _next_hops(live, t, routers)
        nexts = t.real_ports(t.real_ports(nexts, "device", "nh_oif"), "peer", "peerIf")
        my = t.ports.select(*NS_HOST, "ifname", F.col("mtu").alias("outMtu"))
        nexts = cut_lineage(_lookup(nexts, my, {
            "namespace": "namespace", "device": "hostname", "nh_oif": "ifname"}))
        dead = _join(live, nexts.select("req", "pathkey").distinct(), ["req", "pathkey"],
                     "left_anti")
        done.append(_with_hop(dead).select(
            "req", "namespace", "hops", F.lit("dead").alias("end")))

        tunnel = F.when(transit, F.col("overlay")).otherwise(F.col("vtep"))
        nh = F.when(F.col("nhip") == "", F.col("target")).otherwise(F.col("nhip"))
        is_l2 = ((F.col("nhip") == "") & (F.col("protocol") == "l2") | F.col("l2hop")) & (
            tunnel == "")
        via = F.when(F.col("l2hop"), nh).otherwise(F.col("via"))
        warned = F.max("anycast").over(Window.partitionBy("req", "pathkey"))
        nexts = nexts.withColumn("__warned", warned)
        hopped = _with_hop(
            nexts.withColumn("visited", F.concat("visited", F.array("spot"))),
            oif=F.col("nh_oif"), isL2=is_l2, overlay=tunnel != "", protocol=F.col("protocol"),
            outMtu=F.coalesce("outMtu", "inMtu"),
            ipLookup=F.when(F.col("protocol") == "l2", F.lit("")).otherwise(F.col("ipLookup")),
            vtepLookup=tunnel, macLookup=F.when(is_l2, F.col("macLookup")).otherwise(F.lit("")),
            nexthopIp=nh, hopError=_add_error(F.col("errors"), F.col("__warned"), ANYCAST_ERROR))
        low = (F.col("peerMtu") < F.col("srcMtu")) | (F.col("outMtu") < F.col("srcMtu"))
        frontier = cut_lineage(hopped.select(
            "req", "namespace", "src", "dest", F.col("peer").alias("device"), "srcMtu", "vrf",
            F.col("peerIf").alias("iif"), F.col("peerMtu").alias("inMtu"),
            is_l2.alias("isL2"), tunnel.alias("overlay"),
            F.coalesce(F.col("peerMtu") == F.col("outMtu"), F.lit(False)).alias("mtuMatch"),
            _add_error(F.lit(""), low, "Hop MTU < Src Mtu").alias("errors"),
            "ts", F.lit(False).alias("decap"), "visited", "hops",
            F.sha2(F.concat_ws("|", "pathkey", "peer", "peerIf", "nh_oif", "nhip"), 256)
            .alias("pathkey"), F.lit(False).alias("first"), "linkL2", via.alias("via"),
            F.when(F.col("l2hop"), F.coalesce("peerMac", F.lit(""))).otherwise(F.col("viaMac"))
            .alias("viaMac")))
    if not done:
        return assemble(frontier.select("req", "namespace", "hops", F.lit("dead").alias("end")))
    return assemble(reduce(DataFrame.unionByName, done))


def assemble(paths: DataFrame) -> DataFrame:
    """Number the paths of each request and turn their hops into rows.

    Paths that broke off are shown only where no other path of the request
    came to an end.
    """
    ended = paths.where("end != 'dead'").select("req").distinct()
    broken = _join(paths.where("end = 'dead'"), ended, "req", "left_anti")
    paths = paths.where("end != 'dead'").unionByName(broken)
    distinct = paths.withColumn("sig", F.to_json("hops")).dropDuplicates(["req", "sig"])
    # Paths of one request, numbered by signature: few rows per window.
    numbered = distinct.withColumn("pathid", F.row_number().over(
        Window.partitionBy("req").orderBy("sig")))
    rows = numbered.select("req", "namespace", "pathid", F.posexplode("hops").alias(
        "hopCount", "h"))
    return rows.select("req", "pathid", "hopCount", "namespace", "h.*")


def path_summary(paths: DataFrame) -> DataFrame:
    """Per request: number and length of paths, devices, ECMP width per hop, MTU."""
    lengths = paths.groupBy("req", "pathid").agg(F.max("hopCount").alias("len")).groupBy(
        "req").agg(F.count(F.lit(1)).alias("totalPaths"), F.max("len").alias("maxPathLength"),
                   F.avg("len").alias("avgPathLength"))
    width = paths.where("hopCount != 0").groupBy("req", "hopCount").agg(
        F.countDistinct("hostname").alias("n")).groupBy("req").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("hopCount", "n"))),
                    lambda s: s["n"]).alias("perHopEcmp"))
    real = F.col("iif") != "lo"
    facts = paths.groupBy("req").agg(
        F.countDistinct("hostname").alias("uniqueDevices"),
        F.max(~F.coalesce("mtuMatch", F.lit(False))).alias("mtuMismatch"),
        F.max("overlay").alias("usesOverlay"),
        F.least(F.min(F.when(real, F.col("inMtu"))), F.min(F.when(real, F.col("outMtu"))))
        .alias("pathMtu"))
    return _join(_join(lengths, width, "req", "left"), facts, "req")


def path_evidence(paths: DataFrame, t: PathTables, failed: DataFrame | None = None) -> DataFrame:
    """Rows behind each hop: (req, pathid, hopCount, hostname, evidence, detail as JSON)."""
    key = ["req", "pathid", "hopCount", "namespace", "hostname"]
    hops = paths.select(*key, "vrf", "ipLookup", "vtepLookup", "nexthopIp", "oif", "macLookup")

    def found(df: DataFrame, kind: str, cols: list[str]) -> DataFrame:
        return df.select(*key, F.lit(kind).alias("evidence"),
                         F.to_json(F.struct(*cols)).alias("detail")).distinct()

    routes = t.routes.select(*NS_HOST, "vrf", F.col("prefix").alias("ipLookup"), "nexthopIps",
                             "oifs", "protocol")
    parts = [found(_join(hops, routes, [*NS_HOST, "vrf", "ipLookup"]), "route",
                   ["vrf", "ipLookup", "nexthopIps", "oifs", "protocol"])]
    tunnels = hops.where("vtepLookup != ''").select(
        *key, F.col("vtepLookup").alias("vtep"), F.lit(UNDERLAY_VRF).alias("u_vrf"),
        F.col("hostname").alias("device"))
    found_routes = t.best_routes((tunnels, "vtep", "u_vrf"))
    under = _attach(tunnels, found_routes, "vtep", "u_vrf", "underlay").where(
        "underlay is not null")
    parts.append(found(under, "underlay", ["vtep", "underlay"]))
    arp = t.arp.select(*NS_HOST, F.col("ipAddress").alias("nexthopIp"),
                       F.col("port").alias("oif"), "arpMac", "arpRemote")
    with_arp = _join(hops, arp, [*NS_HOST, "nexthopIp", "oif"])
    parts.append(found(with_arp, "arpnd", ["nexthopIp", "oif", "arpMac", "arpRemote"]))
    owner = t.addresses.select(
        "namespace", F.col("ip").alias("nexthopIp"), F.col("hostname").alias("ownerHost"),
        "ifname", "mtu", "macaddr")
    parts.append(found(_join(hops, owner, ["namespace", "nexthopIp"]), "interface",
                       ["nexthopIp", "ownerHost", "ifname", "mtu", "macaddr"]))
    macs = t.macs.select(*NS_HOST, F.col("macaddr").alias("macLookup"), "vlan",
                         F.col("oif").alias("macOif"), "remoteVtepIp")
    with_mac = _join(hops.where("macLookup != ''"), macs, [*NS_HOST, "macLookup"])
    parts.append(found(with_mac, "mac",
                       ["macLookup", "vlan", "macOif", "remoteVtepIp"]))
    if failed is not None:
        parts.append(found(_join(hops, failed, NS_HOST), "failed", ["table", "object", "state"]))
    return reduce(DataFrame.unionByName, parts)
