"""What each table's statistic sheet holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netstate.functions import ip
from netstate.operators import summary as S
from netstate.operators.summary import Distribution, Spread, Stat

HOST = "hostname"


def _devices() -> Stat:
    return Stat("deviceCnt", HOST, "nunique")


def generic(df: DataFrame) -> DataFrame:
    return S.summarize(df, [_devices()])


def device(df: DataFrame) -> DataFrame:
    return S.summarize(df, [
        _devices(),
        Stat("downDeviceCnt", HOST, "nunique", "status = 'dead'"),
        Stat("unpolledDeviceCnt", HOST, "nunique", "status = 'neverpoll'"),
        Distribution("vendorCnt", "vendor"), Distribution("modelCnt", "model"),
        Distribution("archCnt", "architecture"), Distribution("versionCnt", "version"),
        Spread("upTimeStat", "uptime", "status != 'neverpoll'"),
    ])


def interfaces(df: DataFrame) -> DataFrame:
    # Loopbacks of some systems report the state "unknown".
    df = df.withColumn("state", F.when(
        F.col("state") == "unknown", F.lit("up")).otherwise(F.col("state")))
    fe80 = ~F.col("item").startswith("fe80:")
    return S.summarize(
        df, [
            _devices(), Stat("interfaceCnt", "ifname"),
            Stat("devicesWithL2Cnt", HOST, "nunique", "master = 'bridge'"),
            Stat("devicesWithVxlanCnt", HOST, "count", "type = 'vxlan'"),
            Stat("ifDownCnt", "ifname", "count", "state != 'up' and adminState = 'up'"),
            Stat("ifAdminDownCnt", "ifname", "count", "adminState != 'up'"),
            Stat("ifWithMultipleIPCnt", "ifname", "count", "size(ipAddressList) > 1"),
            Stat("errDisabledCnt", "ifname", "count",
                 "state = 'errDisabled' and adminState = 'up'"),
            Distribution("uniqueMTUCnt", "mtu"), Distribution("uniqueIfTypesCnt", "type"),
            Distribution("speedCnt", "speed"),
            Spread("ifChangesStat", "numChanges", "type != 'bond'"),
            Spread("ifPerDeviceStat", "ifname", per=(HOST,)),
        ],
        check="interfaceCnt",
        extra=[S.explode_nunique(df, "ipAddressList", "uniqueIPv4AddrCnt"),
               S.explode_nunique(df, "ip6AddressList", "uniqueIPv6AddrCnt", fe80)],
    ).fillna(0, ["uniqueIPv4AddrCnt", "uniqueIPv6AddrCnt"])


def address(df: DataFrame) -> DataFrame:
    fe80 = ~F.col("item").startswith("fe80")
    per_device = {
        "deviceWithv4AddressCnt": df.where(F.size("ipAddressList") > 0),
        "deviceWithv6AddressCnt": df.where(F.exists(
            "ip6AddressList", lambda a: ~a.startswith("fe80"))),
    }
    extra = [
        S.explode_nunique(df, "ipAddressList", "uniqueV4AddressCnt"),
        S.explode_nunique(df, "ip6AddressList", "uniqueV6AddressCnt", fe80),
        *[part.groupBy("namespace").agg(F.countDistinct(HOST).alias(name))
          for name, part in per_device.items()],
        S.top_subnets(df),
    ]
    counts = ["uniqueV4AddressCnt", "uniqueV6AddressCnt", *per_device]
    return S.summarize(
        df, [_devices(), Stat("addressCnt", HOST), Stat("uniqueIfMacCnt", "macaddr", "nunique")],
        check="addressCnt", extra=extra,
        order=["namespace", "deviceCnt", "addressCnt", "uniqueV4AddressCnt",
               "uniqueV6AddressCnt", "uniqueIfMacCnt", "deviceWithv4AddressCnt",
               "deviceWithv6AddressCnt", "subnetsUsed", "subnetTopCounts"],
    ).fillna(0, counts)


def arpnd(df: DataFrame) -> DataFrame:
    df = df.withColumns({
        "v": F.coalesce(ip.ip_version("ipAddress"), F.lit(0)),
        "lla": ip.in_subnet("ipAddress", "fe80::/10")})
    entry = "ipAddress"
    return S.summarize(df, [
        _devices(), Stat("arpNdEntriesCnt", entry),
        Stat("uniqueArpEntriesCnt", entry, "nunique"), Stat("uniqueOifCnt", "oif", "nunique"),
        Stat("arpEntriesCnt", entry, "count", "v = 4"),
        Stat("v6NDEntriesCnt", entry, "count", "v = 6"),
        Stat("v6NDGlobalEntriesCnt", entry, "count", "v = 6 and not lla"),
        Stat("v6NDLLAEntriesCnt", entry, "count", "v = 6 and lla"),
        Stat("remoteV4EntriesCnt", entry, "count", "state = 'remote' and v = 4"),
        Stat("staticV4EntriesCnt", entry, "count", "state = 'permanent' and v = 4"),
        Stat("remoteV6EntriesCnt", entry, "count", "state = 'remote' and v = 6"),
        Stat("staticV6EntriesCnt", entry, "count", "state = 'permanent' and v = 6"),
        Stat("failedEntriesCnt", entry, "count", "state = 'failed'"),
        Stat("failedV4EntriesCnt", entry, "count", "state = 'failed' and v = 4"),
        Stat("failedV6EntriesCnt", entry, "count", "state = 'failed' and v = 6"),
    ], check="arpNdEntriesCnt")


def bgp(df: DataFrame) -> DataFrame:
    from netstate.operators.views import keep_last

    families = df.groupBy("namespace").agg(
        F.countDistinct(F.concat_ws(" ", "afi", "safi")).alias("activeAfiSafiCnt"))
    sessions = keep_last(df, ["namespace", HOST, "vrf", "peer"],
                         [F.col("afi").desc(), F.col("safi").desc()])
    sessions = sessions.withColumn("upMs", F.col("timestamp") - F.col("estdTime"))
    estd = "state = 'Established'"
    return S.summarize(sessions, [
        _devices(), Stat("totalPeerCnt", "peer"), Stat("uniqueAsnCnt", "asn", "nunique"),
        Stat("uniqueVrfsCnt", "vrf", "nunique"),
        Stat("failedPeerCnt", "peer", "count", "state = 'NotEstd'"),
        Stat("iBGPPeerCnt", "peer", "count", "asn = peerAsn"),
        Stat("eBGPPeerCnt", "peer", "count", "asn != peerAsn"),
        Stat("rrClientPeerCnt", "peer", "count", "lower(rrclient) = 'true'"),
        Spread("upTimeStat", "upMs", estd), Spread("updatesRxStat", "updatesRx", estd),
        Spread("updatesTxStat", "updatesTx", estd),
    ], extra=[families])


def evpnVni(df: DataFrame) -> DataFrame:  # noqa: N802 (table name)
    from netstate.operators.summary import spread_rows

    per_vtep = df.select("namespace", HOST, F.explode("remoteVtepList").alias("v")).groupBy(
        "namespace", HOST).agg(F.countDistinct("v").alias("value"))
    vteps = spread_rows(per_vtep, ["namespace"]).select(
        "namespace", F.array("min", "max", "median").alias("remoteVtepsPerVtepStat"))
    l2 = "type = 'L2'"
    l3 = F.max((F.col("type") == "L3") & (F.col("vni") != 0))
    mode = df.groupBy("namespace").agg(
        F.when(l3, F.lit("symmetric")).otherwise(F.lit("asymmetric")).alias("mode"))
    return S.summarize(df, [
        Stat("uniqueVtepCnt", "priVtepIp", "nunique"), Stat("uniqueVniCnt", "vni", "nunique"),
        Stat("uniqueL3VniCnt", "vrf", "nunique", "type = 'L3' and vni != 0"),
        Stat("uniqueL2VniCnt", "vni", "nunique", l2),
        Stat("uniqueMulticastGroups", "mcastGroup", "nunique",
             "mcastGroup != '0.0.0.0' and mcastGroup != ''"),
        Stat("vnisUsingMulticast", "vni", "nunique",
             f"{l2} and replicationType = 'multicast'"),
        Stat("vnisUsingIngressRepl", "vni", "nunique",
             f"{l2} and replicationType = 'ingressBGP'"),
    ], check="uniqueVtepCnt", extra=[mode, vteps])


def lldp(df: DataFrame) -> DataFrame:
    return S.summarize(df, [
        _devices(), Stat("nbrCnt", HOST), Stat("peerHostnameCnt", "peerHostname"),
        Stat("uniquePeerMgmtIPCnt", "mgmtIP", "nunique"),
        Stat("missingPeerInfoCnt", "mgmtIP", "count", "mgmtIP = '-' or mgmtIP = ''"),
    ])


def macs(df: DataFrame) -> DataFrame:
    return S.summarize(df, [
        _devices(), Stat("totalMacsinNSCnt", HOST), Stat("uniqueMacCnt", "macaddr", "nunique"),
        Spread("uniqueVlanperHostStat", "vlan", "vlan != 0", per=(HOST,), func="nunique"),
    ])


def mlag(df: DataFrame) -> DataFrame:
    on = "state = 'active'"
    return S.summarize(df, [
        _devices(), Stat("uniqueSystemIdCnt", "systemId", "nunique"),
        Stat("devicesWithfailedStateCnt", "state", "count", "state != 'active'"),
        Stat("devicesWithBackupInactiveCnt", "backupActive", "count",
             "state = 'active' and not backupActive"),
        Spread("mlagNumDualPortsStat", "mlagDualPortsCnt", on),
        Spread("mlagNumSinglePortStat", "mlagSinglePortsCnt", on),
        Spread("mlagNumErrorPortStat", "mlagErrorPortsCnt", on),
    ])


def ospf(df: DataFrame) -> DataFrame:
    df = df.withColumn("upMs", F.col("timestamp") - F.coalesce("lastChangeTime", F.lit(0)))
    names = ["area", "vrf", "helloTime", "deadTime", "retxTime", "networkType"]
    return S.summarize(df, [
        _devices(), Stat("peerCnt", HOST),
        Stat("stubbyPeerCnt", "areaStub", "count", "areaStub"),
        Stat("passivePeerCnt", "ifname", "count", "adjState = 'passive'"),
        Stat("unnumberedPeerCnt", "isUnnumbered", "count", "isUnnumbered"),
        Stat("failedPeerCnt", "ifname", "count", "adjState not in ('passive', 'full')"),
        *[Distribution(n, n) for n in names if n in df.columns],
        Spread("adjChangesStat", "numChanges"),
        Spread("upTimeStat", "upMs", "adjState = 'full'"),
    ])


def routes(df: DataFrame) -> DataFrame:
    from netstate.operators.summary import default_route_coverage

    return S.summarize(df, [
        _devices(), Stat("uniquePrefixCnt", "prefix", "nunique"),
        Stat("uniqueVrfsCnt", "vrf", "nunique"),
        Spread("routesPerHostStat", "prefix", per=(HOST,)),
        Stat("ifRoutesCnt", "prefix", "count", "prefixlen = 30 or prefixlen = 31"),
        Stat("hostRoutesCnt", "prefix", "count", "prefixlen = 32"),
        Stat("totalV4RoutesinNs", "prefix", "count", "ipvers = 4"),
        Stat("totalV6RoutesinNs", "prefix", "count", "ipvers = 6"),
        Distribution("routingProtocolCnt", "protocol"), Distribution("nexthopCnt", "numNexthops"),
        Spread("routesperVrfStat", "prefix", per=("vrf",)),
    ], extra=[default_route_coverage(df)])


def sqPoller(df: DataFrame) -> DataFrame:  # noqa: N802 (table name)
    return S.summarize(df, [
        _devices(), Stat("entriesCnt", HOST), Distribution("service", "service"),
        Distribution("status", "status"),
        Spread("pollExcdPeriodStat", "pollExcdPeriodCount"),
    ])


def vlan(df: DataFrame) -> DataFrame:
    return S.summarize(df, [
        _devices(), Stat("uniqueVlanCnt", "vlan", "nunique"),
        Stat("activeVlanCnt", "vlan", "nunique", "state = 'active'"),
        Stat("suspendedVlanCnt", "vlan", "nunique", "state = 'suspend'"),
        Spread("vlanPerDeviceStat", "vlan", per=(HOST,)),
        Spread("ifPerVlanStat", "interfaces", per=("vlan",)),
    ])


def namespace(df: DataFrame) -> DataFrame:
    """Across namespaces: one row.  The listing has one row per namespace."""
    yes = {"nsWithMlagCnt": "hasMlag", "nsWithBgpCnt": "hasBgp", "nsWithOspfCnt": "hasOspf",
           "nsWithVxlanCnt": "hasVxlan"}
    return df.agg(
        F.count("namespace").alias("namespacesCnt"),
        F.array(F.min("serviceCnt"), F.max("serviceCnt"), F.median("serviceCnt"))
        .alias("servicePerNsStat"),
        *[F.count(F.when(F.col(c), 1)).alias(n) for n, c in yes.items()],
        F.count(F.when(F.col("errSvcCnt") != 0, 1)).alias("nsWithErrsvcCnt"))


def tables(df: DataFrame) -> DataFrame:
    """Over the table listing with its TOTAL row."""
    return df.agg(
        (F.countDistinct("table") - 1).alias("serviceCnt"),
        F.max(F.when(F.col("table") == "TOTAL", F.col("namespaceCnt"))).alias("namespaceCnt"),
        F.max(F.when(F.col("table") == "device", F.col("deviceCnt"))).alias("deviceCnt"),
        F.min("firstTime").alias("earliestTimestamp"), F.max("lastTime").alias("lastTimestamp"),
        S.quantile(df, "firstTime", 0.99), S.quantile(df, "lastTime", 0.99))


SHEETS = {
    "device": device, "interfaces": interfaces, "address": address, "arpnd": arpnd, "bgp": bgp,
    "evpnVni": evpnVni, "lldp": lldp, "macs": macs, "mlag": mlag, "ospf": ospf,
    "routes": routes, "sqPoller": sqPoller, "vlan": vlan, "namespace": namespace,
    "tables": tables,
}
