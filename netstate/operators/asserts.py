"""Assertion rules: each names what is wrong with a row; no reason means pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netstate.functions import ip
from netstate.operators import enrich
from netstate.operators.enrich import NS_HOST, _blank
from netstate.operators.filters import FilterError
from netstate.operators.views import keep_last

# Interface types checked by default.
DEFAULT_IF_TYPES = ["ethernet", "bond_slave", "subinterface", "vlan", "bond"]
LOOPBACK_PATTERN = r"^lo|oopback"
ZERO_MAC = "00:00:00:00:00:00"
NO_GROUP = "0.0.0.0"


def _reason(cond: Column, name: str | Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(name) if isinstance(name, str) else name)


def _reasons(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def _verdict(df: DataFrame, result: str) -> DataFrame:
    if result not in ("all", "pass", "fail"):
        raise FilterError(f"unknown result filter: {result!r}")
    df = df.withColumn("result", F.when(F.size("assertReason") == 0, F.lit("pass")).otherwise(
        F.lit("fail")))
    return df if result == "all" else df.where(F.col("result") == result)


# -- interfaces -------------------------------------------------------------

def prepare_interfaces(ifs: DataFrame, iftype=None, state: str = "up") -> DataFrame:
    """Checked types in the checked state, without loopbacks and replaced parents."""
    types = iftype or DEFAULT_IF_TYPES
    df = ifs.where(F.col("type").isin(types) & (F.col("state") == state))
    if "loopback" not in types:
        df = df.where(~F.col("ifname").rlike(LOOPBACK_PATTERN))
    return enrich.drop_parents_of_dot_zero(df)


def assert_interfaces(
    ifs: DataFrame, lldp: DataFrame, mlag: DataFrame | None = None, result: str = "all",
    ignore_missing_peer: bool = False, iftype=None, state: str = "up",
) -> DataFrame:
    """Both ends of every link agree.  ``ifs`` carries ``portmode`` and ``vlanList``.

    Without any interface to check, or without any neighbour that LLDP names a port of,
    the answer is one failing row that says so.
    """
    base = prepare_interfaces(ifs, iftype, state)
    df = enrich.interface_peers(base, lldp)
    hosts = base.select("namespace", F.col("hostname").alias("peerHostname")).distinct()
    df = df.join(hosts.withColumn("__polled", F.lit(True)), ["namespace", "peerHostname"], "left")
    if mlag is not None:
        links = mlag.select(*NS_HOST, F.col("peerLink").alias("master")).where(
            "master != ''").distinct().withColumn("__peerlink", F.lit(True))
        df = df.join(links, [*NS_HOST, "master"], "left")
    else:
        df = df.withColumn("__peerlink", F.lit(None).cast("boolean"))

    found = F.col("peerFound")
    skip = (F.col("master") == "bridge") | F.col("type").isin("bond_slave", "vlan")
    unpolled = ~_blank("peerHostname") & F.col("__polled").isNull()
    compared = found & ~skip
    ether = F.col("type").startswith("ether") & F.col("typePeer").startswith("ether")
    same_type = (
        (F.col("type") == F.col("typePeer"))
        | ((F.col("type") == "vlan") & (F.col("typePeer") == "subinterface")) | ether)
    mine, theirs = F.get("ipAddressList", F.lit(0)), F.get("ipAddressListPeer", F.lit(0))
    ip_ok = (F.size("ipAddressList") == F.size("ipAddressListPeer")) & (
        (F.size("ipAddressList") <= 0) | mine.endswith("/32") | ip.same_subnet(mine, theirs))

    def as_set(c):
        return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<bigint>"))))

    up = (F.col("adminState") == "down") | (
        (F.col("adminState") == "up") & (F.col("state") == "up"))
    reasons = _reasons(
        _reason(~up, F.coalesce(F.nullif("reason", F.lit("")), F.lit("Interface Down"))),
        _reason(~found & ~skip, F.when(unpolled, F.lit("Unpolled Peer")).otherwise(
            F.lit("No Peer Found"))),
        _reason(compared & (F.col("mtu") != F.col("mtuPeer")), "MTU mismatch"),
        _reason(compared & (F.col("speed") != F.col("speedPeer")), "Speed mismatch"),
        _reason(found & ~same_type, "type mismatch"),
        _reason(found & (F.col("portmode") != F.col("portmodePeer")), "portMode Mismatch"),
        _reason(compared & ~ip_ok, "IP address mismatch"),
        _reason(found & F.col("portmode").isin("access", "trunk")
                & (F.col("vlan") != F.col("vlanPeer")), "pvid Mismatch"),
        _reason(found & F.col("__peerlink").isNull()
                & (as_set("vlanList") != as_set("vlanListPeer")), "VLAN set mismatch"),
    )
    df = df.withColumn("assertReason", reasons)
    passed = F.size("assertReason") == 0
    if ignore_missing_peer:
        passed = passed | (F.get("assertReason", F.lit(0)) == "No Peer Found")
    df = df.withColumn("result", F.when(passed, F.lit("pass")).otherwise(F.lit("fail")))
    if result not in ("all", "pass", "fail"):
        raise FilterError(f"unknown result filter: {result!r}")
    out = df if result == "all" else df.where(F.col("result") == result)
    out = out.select(
        *NS_HOST, "ifname", "state", "peerHostname", "peerIfname", "result", "assertReason",
        "timestamp")
    named = lldp.where("peerIfname is null or peerIfname != '-'")
    has = [d.limit(1).agg(F.count(F.lit(1)) > 0).scalar() for d in (base, named)]
    out = out.where(has[0] & has[1])
    if result == "pass":
        return out
    why = F.when(~has[0], F.lit("No data")).when(~has[1], F.lit("No LLDP peering info"))
    none = ifs.sparkSession.range(1).select(why.alias("__why")).where("__why is not null")
    values = {"result": F.lit("fail"), "assertReason": F.array("__why")}
    return out.unionByName(none.select(*[
        values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
        for f in out.schema.fields]))


def assert_mtu(ifs: DataFrame, values: list[int], result: str = "all") -> DataFrame:
    """MTU is one of the given values; the loopback ``lo`` is left out."""
    df = ifs.where("ifname != 'lo'").withColumn(
        "result", F.when(F.col("mtu").isin(values), F.lit("pass")).otherwise(F.lit("fail")))
    out = df.select(*NS_HOST, "ifname", "state", "mtu", "timestamp", "result")
    return out if result == "all" else out.where(F.col("result") == result)


# -- BGP --------------------------------------------------------------------

def assert_bgp(bgp: DataFrame, ifs: DataFrame, result: str = "all",
               state: str = "!dynamic") -> DataFrame:
    """One row per session and reason ('-' for none); dynamic sessions are not checked."""
    from netstate.operators.filters import match_text

    sessions = keep_last(
        enrich.bgp_reverse_session(enrich.bgp_peer_match(bgp.where(match_text("state", state)))),
        [*NS_HOST, "vrf", "peer"], [F.col("afi").asc(), F.col("safi").asc()])
    ports = enrich.unique_by(ifs, [*NS_HOST, "ifname"], __admin="adminState", __state="state")
    df = sessions.join(ports, [*NS_HOST, "ifname"], "left")
    estd = F.col("state") == "Established"
    why = F.col("reason")
    reasons = _reasons(
        _reason(~estd & F.col("__admin").isNotNull(), F.when(
            F.col("__admin") != "up", F.lit("interface admin down")
        ).when(F.col("__state") != "up", F.lit("interface down"))),
        _reason(~estd & F.col("revHost").isNotNull() & (
            (F.col("asn") != F.col("revPeerAsn")) | (F.col("revAsn") != F.col("peerAsn"))),
            "asn mismatch"),
        _reason(~estd & ~_blank(why) & ~why.isin("None", "No error"),
                F.concat(why, F.lit(":"), F.coalesce("notificnReason", F.lit("")))),
        _reason(estd & ((F.size("afisAdvOnly") > 0) | (F.size("afisRcvOnly") > 0)),
                "Not all Afi/Safis enabled"),
    )
    df = df.withColumn("__reasons", reasons)
    df = df.withColumn("result", F.when(
        estd & (F.size("__reasons") == 0), F.lit("pass")).otherwise(F.lit("fail")))
    out = df.select(
        *NS_HOST, "vrf", "peer", "asn", "peerAsn", "state", "peerHostname", "result",
        F.explode_outer("__reasons").alias("assertReason"), "timestamp")
    out = out.withColumn("assertReason", F.coalesce("assertReason", F.lit("-")))
    if result == "fail":
        return out.where("assertReason != '-'")
    return out.where("assertReason = '-'") if result == "pass" else out


# -- OSPF -------------------------------------------------------------------

def assert_ospf(ospf: DataFrame, ifs: DataFrame, result: str = "all") -> DataFrame:
    """``ospf`` is the combined table with peer names."""
    df = ospf.where("ifState != 'adminDown'")
    owners = df.where("routerId != ''").groupBy("namespace", "routerId").agg(
        F.countDistinct("hostname").alias("__owners"),
        F.min("hostname").alias("__first"), F.max("hostname").alias("__last"))
    mtus = enrich.unique_by(ifs, [*NS_HOST, "ifname"], __mtu="mtu")
    df = df.join(owners, ["namespace", "routerId"], "left").join(
        mtus, [*NS_HOST, "ifname"], "left")
    fields = ["ipAddress", "isUnnumbered", "area", "areaStub", "helloTime", "deadTime",
              "networkType", "vrf"]
    ends = df.groupBy(*NS_HOST, "ifname").agg(F.min(F.struct(
        F.col("vrf").alias("__k"), *[F.col(c).alias(f"{c}Peer") for c in fields],
        F.col("__mtu").alias("mtuPeer"))).alias("__p"))
    df = enrich._lookup(df, ends, {
        "namespace": "namespace", "peerHostname": "hostname", "peerIfname": "ifname"})

    good = F.col("adjState").isin("passive", "full")
    down = ~good & (F.col("ifState") == "down")
    failed = ~good & (F.col("ifState") != "down")
    peer = F.col("__p")
    found = failed & peer.isNotNull()

    def differs(c):
        return found & (F.col(c) != peer[f"{c}Peer"])

    numbered = ~F.coalesce("isUnnumbered", F.lit(False))
    subnet = found & (
        (F.coalesce("isUnnumbered", F.lit(False))
         != F.coalesce(peer["isUnnumberedPeer"], F.lit(False)))
        | (numbered & ~ip.same_subnet("ipAddress", peer["ipAddressPeer"])))
    loopback = F.col("ifname").contains("lo") | F.col("ifname").contains("oopbac")
    reasons = _reasons(
        _reason(F.col("__owners") > 1, F.concat(
            F.lit("duplicate routerId "), F.col("__first"), F.lit(".."), F.col("__last"))),
        _reason(down, "ifdown"),
        _reason(good & loopback & (F.col("networkType") != "loopback"),
                "network type !loopback"),
        _reason(subnet, "subnet mismatch"),
        _reason(differs("area"), "area mismatch"),
        _reason(differs("areaStub"), "area stub mismatch"),
        _reason(differs("helloTime"), "Hello timers mismatch"),
        _reason(differs("deadTime"), "Dead timer mismatch"),
        _reason(differs("networkType"), "network type mismatch"),
        _reason(differs("vrf"), "vrf mismatch"),
        _reason(found & (F.col("__mtu") != peer["mtuPeer"]), "MTU mismatch"),
        _reason(failed & peer.isNull(), F.when(
            F.col("networkType") == "loopback", F.lit("Loopback not configured passive")
        ).otherwise(F.lit("No Peer Found"))),
    )
    df = df.withColumn("assertReason", reasons)
    # Still failed though both ends agree: the neighbour was not seen.
    df = df.withColumn("assertReason", F.when(
        failed & (F.col("adjState") == "fail") & (F.size("assertReason") == 0),
        F.array(F.lit("No Peer Found"))).otherwise(F.col("assertReason")))
    return _verdict(df, result).select(
        *NS_HOST, "vrf", "ifname", "adjState", "assertReason", "result", "timestamp")


# -- EVPN -------------------------------------------------------------------

def assert_evpn(vnis: DataFrame, svis: DataFrame, result: str = "all",
                macs: DataFrame | None = None) -> DataFrame:
    """``vnis`` is the enriched table, ``svis`` the VLAN interfaces with vrf and macaddr.

    With ``macs`` the head-end replication list is checked as well.
    """
    addresses = enrich.unique_by(svis, [*NS_HOST, "vlan"], __svi_vrf="vrf", macaddr="macaddr")
    df = vnis.join(addresses, [*NS_HOST, "vlan"], "left").withColumn("vrf", F.col("__svi_vrf"))
    group = F.coalesce("mcastGroup", F.lit(""))
    uses_group = ~group.isin("", NO_GROUP)
    own = F.when(_blank("secVtepIp"), F.col("priVtepIp")).otherwise(F.col("secVtepIp"))
    vteps = F.array_join(F.array_sort(F.concat(
        F.coalesce("remoteVtepList", F.array().cast("array<string>")), F.array(own))), ",")
    per_vni = df.groupBy("namespace", "vni").agg(
        F.countDistinct("replicationType").alias("__repl"),
        F.countDistinct(F.when(uses_group, group)).alias("__groups"),
        F.countDistinct(vteps).alias("__vteps"),
        F.countDistinct("vrf").alias("__vrfs"))
    l2_mac = F.when((F.col("type") == "L2") & (F.col("macaddr") != ZERO_MAC), F.col("macaddr"))
    per_ns = df.groupBy("namespace").agg(
        F.countDistinct(l2_mac).alias("__macs"),
        F.max(uses_group).alias("__mcast"))
    df = df.join(per_vni, ["namespace", "vni"]).join(per_ns, "namespace")
    rules = [
        _reason(F.col("state") != "up", "vni down"),
        _reason(F.col("__mcast") & (F.col("__repl") != 1),
                "inconsistent replication across hosts"),
        _reason(F.col("__mcast") & (F.col("__groups") > 1), "VNI has multiple mcast group"),
        _reason(~F.col("__mcast") & (F.col("__vteps") != 1), "Some VTEPs are unknown to all"),
        _reason(F.col("__vrfs") > 1, "Inconsistent VNI-VRF mapping"),
        _reason((F.col("__macs") != 1) & (F.col("__vrfs") > 0),
                "anycast MAC not unique across VNI"),
    ]
    if macs is not None:
        heads = her_heads(macs)
        df = df.join(heads, [*NS_HOST, "ifname"], "left")
        rules.append(_reason(
            (F.col("type") != "L3") & (F.size(her_missing("__her")) > 0),
            F.concat(F.lit("HER missing for "), F.array_join(her_missing("__her"), ", "))))
    df = df.withColumn("assertReason", _reasons(*rules))
    return _verdict(df, result).select(
        *NS_HOST, "vni", "type", "vlan", "vrf", "macaddr", "state", "result", "assertReason",
        "timestamp")


def her_heads(macs: DataFrame) -> DataFrame:
    """Per VXLAN port the remote VTEPs its zero-MAC entries replicate to.

    A port has one entry per remote VTEP, so the set is bounded by the fabric.
    """
    entries = macs.where((F.col("macaddr") == ZERO_MAC) & (F.col("remoteVtepIp") != ""))
    return entries.groupBy(*NS_HOST, F.col("oif").alias("ifname")).agg(
        F.collect_set("remoteVtepIp").alias("__her"))


def her_missing(heads: str) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_except(
        F.coalesce("remoteVtepList", none), F.coalesce(heads, none)))
