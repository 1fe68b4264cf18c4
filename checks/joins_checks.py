"""Statistic sheets, joins between tables, assertions."""

from pyspark.sql import functions as F

from checks.registry import query
from netstate.operators import asserts, enrich, summary as S
from netstate.plans import summaries

KEYS = ["namespace", "hostname"]


def _entries(df, column, *keys):
    """A map column as rows, so that values compare."""
    return df.select(*keys, F.explode(column).alias("value", "n"))


# -- sheets -----------------------------------------------------------------

@query("summary_scalars", """
    select namespace, count(distinct hostname) as "deviceCnt", count(ifname) as "interfaceCnt",
           count(distinct case when master = 'bridge' then hostname end) as "devicesWithL2Cnt",
           count(case when state <> 'up' and "adminState" = 'up' then ifname end) as "ifDownCnt",
           count(case when "adminState" <> 'up' then ifname end) as "ifAdminDownCnt",
           count(case when len(ipAddressList) > 1 then ifname end) as "ifWithMultipleIPCnt"
    from ifs group by 1""", headline=True)
def _(i):
    return S.summarize(i.ifs, [
        S.Stat("deviceCnt", "hostname", "nunique"), S.Stat("interfaceCnt", "ifname"),
        S.Stat("devicesWithL2Cnt", "hostname", "nunique", "master = 'bridge'"),
        S.Stat("ifDownCnt", "ifname", "count", "state != 'up' and adminState = 'up'"),
        S.Stat("ifAdminDownCnt", "ifname", "count", "adminState != 'up'"),
        S.Stat("ifWithMultipleIPCnt", "ifname", "count", "size(ipAddressList) > 1")])


@query("summary_distribution", """
    select namespace, cast(mtu as varchar) as value, count(*) as n from ifs group by 1, 2""")
def _(i):
    return _entries(S.distribution(i.ifs, "mtu"), "mtu", "namespace")


@query("summary_distribution_rows", """
    select namespace, 'type' as field, type as value, count(*) as "count" from ifs group by 1, 2, 3
    union all
    select namespace, 'speed', cast(speed as varchar), count(*) from ifs group by 1, 2, 3""")
def _(i):
    return S.distribution_rows(i.ifs, ["type", "speed"])


@query("summary_spread", """
    select namespace, cast(min(value) as double) as lo, cast(max(value) as double) as hi,
           cast(median(value) as double) as mid from hotlog group by 1""", headline=True)
def _(i):
    rows = S.spread_rows(i.hotlog.select("namespace", "value"), ["namespace"])
    return rows.select("namespace", F.col("min").alias("lo"), F.col("max").alias("hi"),
                       F.col("median").alias("mid"))


@query("summary_spread_per_device", """
    select namespace, cast(min(n) as double) as lo, cast(max(n) as double) as hi,
           cast(median(n) as double) as mid
    from (select namespace, hostname, count(state) as n from hotlog group by 1, 2) t
    group by 1""")
def _(i):
    out = S.summarize(i.hotlog, [
        S.Stat("deviceCnt", "hostname", "nunique"),
        S.Spread("perDevice", "state", per=("hostname",))])
    s = F.col("perDevice")
    return out.select("namespace", F.get(s, F.lit(0)).alias("lo"), F.get(s, F.lit(1)).alias("hi"),
                      F.get(s, F.lit(2)).alias("mid"))


@query("summary_spread_where", """
    select namespace, cast(min("updatesRx") as double) as lo,
           cast(max("updatesRx") as double) as hi, cast(median("updatesRx") as double) as mid
    from bgp where state = 'Established' group by 1""")
def _(i):
    got = S.spreads(i.bgp, [S.Spread("rx", "updatesRx", "state = 'Established'")])
    return got.select("namespace", F.get("rx", F.lit(0)).alias("lo"),
                      F.get("rx", F.lit(1)).alias("hi"), F.get("rx", F.lit(2)).alias("mid"))


@query("summary_spread_with_outliers", """
    select namespace, min(v) as lo, max(v) as hi, cast(median(v) as double) as mid
    from (select namespace, cast(case when timestamp % 97 = 0 then 1e15 else timestamp % 1000 end
          as double) as v from macs) t group by 1""")
def _(i):
    value = F.when(F.col("timestamp") % 97 == 0, F.lit(1e15)).otherwise(F.col("timestamp") % 1000)
    got = S.spread_rows(i.macs.select("namespace", value.alias("value")), ["namespace"])
    return got.select("namespace", F.col("min").alias("lo"), F.col("max").alias("hi"),
                      F.col("median").alias("mid"))


@query("summary_drops_empty", """
    select namespace, count(case when state = 'NotEstd' then peer end) as failed,
           'bgp' as service
    from bgp group by 1 having count(case when state = 'NotEstd' then peer end) > 0""")
def _(i):
    return S.summarize(i.bgp, [S.Stat("failed", "peer", "count", "state = 'NotEstd'"),
                               S.Constant("service", "bgp")], check="failed")


@query("summary_transposed", """
    select stat, ns0, ns1, ns2 from (
      select 'deviceCnt' as stat, namespace, cast(count(distinct hostname) as varchar) as v
      from ifs group by 2
      union all
      select 'downCnt', namespace, cast(count(case when state <> 'up' then 1 end) as varchar)
      from ifs group by 2) t
    pivot (first(v) for namespace in ('ns0', 'ns1', 'ns2'))""")
def _(i):
    sheet = S.summarize(i.ifs, [S.Stat("deviceCnt", "hostname", "nunique"),
                                S.Stat("downCnt", "ifname", "count", "state != 'up'")])
    return S.transpose_summary(sheet)


@query("distinct_list_elements", """
    select namespace, count(distinct a) as n
    from (select namespace, unnest(ip6AddressList) as a from ifs) t
    where not starts_with(a, 'fe80:') group by 1""")
def _(i):
    return S.explode_nunique(i.ifs, "ip6AddressList", "n", ~F.col("item").startswith("fe80:"))


@query("listing_with_total", """
    with t as (
      select 'log' as "table", min(timestamp) as "firstTime", max(timestamp) as "lastTime",
             count(distinct timestamp) as intervals, count(*) as "allRows",
             count(distinct namespace) as "namespaceCnt", count(distinct hostname) as "deviceCnt"
      from log
      union all
      select 'polls', min(timestamp), max(timestamp), count(distinct timestamp), count(*),
             count(distinct namespace), count(distinct hostname) from polls)
    select * from t
    union all
    select 'TOTAL', min("firstTime"), max("lastTime"), max(intervals),
           cast(sum("allRows") as bigint), max("namespaceCnt"), max("deviceCnt") from t""")
def _(i):
    from netstate.operators.views import table_info

    parts = [table_info(i.log).select(F.lit("log").alias("table"), "*"),
             table_info(i.polls).select(F.lit("polls").alias("table"), "*")]
    return S.with_total(parts[0].unionByName(parts[1]))


@query("top_tables", """
    select * from (
      select 'log' as "table", count(*) as "allRows" from log
      union all select 'polls', count(*) from polls
      union all select 'ifs', count(*) from ifs
      union all select 'routes', count(*) from routes) t
    order by "allRows" desc, "table" limit 2""")
def _(i):
    from netstate.operators.verbs import top_with_ties, union_all

    rows = union_all(*[
        getattr(i, n).agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("allRows"))
        for n in ("log", "polls", "ifs", "routes")])
    return top_with_ties(rows.unionByName(rows.agg(
        F.lit("TOTAL").alias("table"), F.sum("allRows").alias("allRows"))), "allRows", 2)


@query("listing_quantile", """
    select quantile_cont(n, 0.99) as n99 from (
      select cast(count(*) as double) as n from log group by hostname) t""")
def _(i):
    per_host = i.log.groupBy("hostname").agg(F.count(F.lit(1)).alias("n"))
    return per_host.agg(S.quantile(per_host, "n", 0.99))


@query("top_prefix_lengths", """
    with c as (
      select namespace, string_split(a, '/')[2] as plen, count(*) as n
      from (select namespace, unnest(ipAddressList) as a from ifs) t group by 1, 2),
    r as (select *, row_number() over (partition by namespace order by n desc, plen) as rn from c)
    select namespace, string_agg(plen, ',' order by rn) as used,
           string_agg(case when rn <= 3 then concat(plen, '=', n) end, ',' order by rn) as top
    from r group by 1""")
def _(i):
    got = S.top_subnets(i.ifs)
    top = F.transform("subnetTopCounts", lambda m: F.concat(
        F.get(F.map_keys(m), F.lit(0)), F.lit("="), F.get(F.map_values(m), F.lit(0))))
    return got.select("namespace", F.array_join("subnetsUsed", ",").alias("used"),
                      F.array_join(top, ",").alias("top"))


@query("vlans_of_interfaces", """
    select namespace, hostname, ifname, string_agg(vlan, ',' order by vlan) as vlans
    from (select distinct namespace, hostname, unnest(interfaces) as ifname, vlan from vlans) t
    group by 1, 2, 3""")
def _(i):
    got = S.interfaces_to_vlans(i.vlans)
    return got.select(*KEYS, "ifname", F.array_join("vlanList", ",").alias("vlans"))


@query("default_route_coverage", """
    select namespace, vrf, count(distinct case when prefix = '0.0.0.0/0' then hostname end)
           as "devicesWithDefault", count(distinct hostname) as devices,
           count(distinct case when prefix = '0.0.0.0/0' then hostname end)
             = count(distinct hostname) as covered
    from routes group by 1, 2""")
def _(i):
    return S.per_vrf_route_coverage(i.routes)


@query("routes_sheet", """
    with r as (select * from routes),
    h as (select namespace, hostname, count(*) as n from r group by 1, 2),
    v as (select namespace, vrf, count(*) as n from r group by 1, 2)
    select r.namespace, count(distinct hostname) as "deviceCnt",
           count(distinct prefix) as "uniquePrefixCnt", count(distinct vrf) as "uniqueVrfsCnt",
           count(case when plen = 32 then 1 end) as "hostRoutesCnt",
           count(case when ipvers = 4 then 1 end) as "totalV4RoutesinNs",
           (select cast(median(n) as double) from h where h.namespace = r.namespace) as per_host,
           (select cast(max(n) as double) from v where v.namespace = r.namespace) as per_vrf
    from r group by 1""", headline=True)
def _(i):
    from netstate.operators.lpm import routes_view

    got = summaries.routes(routes_view(i.routes))
    return got.select(
        "namespace", "deviceCnt", "uniquePrefixCnt", "uniqueVrfsCnt", "hostRoutesCnt",
        "totalV4RoutesinNs", F.get("routesPerHostStat", F.lit(2)).alias("per_host"),
        F.get("routesperVrfStat", F.lit(1)).alias("per_vrf"))


@query("bgp_sheet", """
    select namespace, count(distinct hostname) as "deviceCnt", count(peer) as "totalPeerCnt",
           count(distinct asn) as "uniqueAsnCnt",
           count(case when state = 'NotEstd' then 1 end) as "failedPeerCnt",
           count(case when asn = "peerAsn" then 1 end) as "iBGPPeerCnt",
           count(case when lower(rrclient) = 'true' then 1 end) as "rrClientPeerCnt",
           count(distinct concat(afi, ' ', safi)) as "activeAfiSafiCnt",
           cast(median(case when state = 'Established' then "updatesTx" end) as double) as tx
    from bgp group by 1""")
def _(i):
    got = summaries.bgp(i.bgp)
    return got.select(
        "namespace", "deviceCnt", "totalPeerCnt", "uniqueAsnCnt", "failedPeerCnt",
        "iBGPPeerCnt", "rrClientPeerCnt", "activeAfiSafiCnt",
        F.get("updatesTxStat", F.lit(2)).alias("tx"))


@query("arpnd_sheet", """
    select namespace, count(distinct hostname) as "deviceCnt",
           count("ipAddress") as "arpNdEntriesCnt",
           count(distinct "ipAddress") as "uniqueArpEntriesCnt",
           count(case when state = 'permanent' then 1 end) as "staticV4EntriesCnt",
           count(case when state = 'failed' then 1 end) as "failedV4EntriesCnt",
           cast(0 as bigint) as "v6NDEntriesCnt"
    from arpnd group by 1""")
def _(i):
    return summaries.arpnd(i.arpnd).select(
        "namespace", "deviceCnt", "arpNdEntriesCnt", "uniqueArpEntriesCnt",
        "staticV4EntriesCnt", "failedV4EntriesCnt", "v6NDEntriesCnt")


@query("macs_sheet", """
    with h as (select namespace, hostname, count(distinct case when vlan <> 0 then vlan end) as n
               from macs where vlan <> 0 group by 1, 2)
    select namespace, count(distinct hostname) as "deviceCnt", count(*) as "totalMacsinNSCnt",
           count(distinct macaddr) as "uniqueMacCnt",
           (select cast(min(n) as double) from h where h.namespace = m.namespace) as lo
    from macs m group by 1""")
def _(i):
    return summaries.macs(i.macs).select(
        "namespace", "deviceCnt", "totalMacsinNSCnt", "uniqueMacCnt",
        F.get("uniqueVlanperHostStat", F.lit(0)).alias("lo"))


@query("vlan_sheet", """
    with p as (select namespace, vlan, count(interfaces) as n from vlans group by 1, 2)
    select namespace, count(distinct hostname) as "deviceCnt",
           count(distinct vlan) as "uniqueVlanCnt",
           count(distinct case when state = 'active' then vlan end) as "activeVlanCnt",
           count(distinct case when state = 'suspend' then vlan end) as "suspendedVlanCnt",
           (select cast(median(n) as double) from p where p.namespace = v.namespace) as per_vlan
    from vlans v group by 1""")
def _(i):
    return summaries.vlan(i.vlans).select(
        "namespace", "deviceCnt", "uniqueVlanCnt", "activeVlanCnt", "suspendedVlanCnt",
        F.get("ifPerVlanStat", F.lit(2)).alias("per_vlan"))


@query("evpn_sheet", """
    select namespace, count(distinct "priVtepIp") as "uniqueVtepCnt",
           count(distinct vni) as "uniqueVniCnt",
           count(distinct case when type = 'L2' then vni end) as "uniqueL2VniCnt",
           count(distinct case when type = 'L2' and "replicationType" = 'multicast' then vni end)
           as "vnisUsingMulticast",
           max(case when type = 'L3' then 'symmetric' else 'asymmetric' end) as mode
    from vnis group by 1""")
def _(i):
    return summaries.evpnVni(i.vnis).select(
        "namespace", "uniqueVtepCnt", "uniqueVniCnt", "uniqueL2VniCnt", "vnisUsingMulticast",
        "mode")


@query("poller_sheet", """
    select namespace, cast(status as varchar) as value, count(*) as n from polls group by 1, 2""")
def _(i):
    return _entries(summaries.sqPoller(i.polls), "status", "namespace")


@query("lldp_sheet", """
    select namespace, count(distinct hostname) as "deviceCnt", count(*) as "nbrCnt",
           count(distinct "mgmtIP") as "uniquePeerMgmtIPCnt",
           count(case when "mgmtIP" in ('-', '') then 1 end) as "missingPeerInfoCnt"
    from lldp group by 1""")
def _(i):
    return summaries.lldp(i.lldp).select(
        "namespace", "deviceCnt", "nbrCnt", "uniquePeerMgmtIPCnt", "missingPeerInfoCnt")


# -- joins ------------------------------------------------------------------

@query("ospf_interfaces_with_neighbours", """
    select f.namespace, f.hostname, f.ifname, f.state as "ifState",
           case when n.state is not null then n.state when f.passive then 'passive'
                else 'fail' end as "adjState",
           case when n.state is null and f.passive then ''
                else coalesce(n."peerIP", '-') end as "peerIP",
           coalesce(n."numChanges", 0) as "numChanges"
    from ospf_if f left join ospf_nbr n using (namespace, hostname, ifname)""")
def _(i):
    return enrich.ospf_combined(i.ospf_if, i.ospf_nbr).select(
        *KEYS, "ifname", "ifState", "adjState", "peerIP", "numChanges")


OSPF = """
    o as (select f.*, f.state as ifst,
                 case when n.state is not null then n.state when f.passive then 'passive'
                      else 'fail' end as adj, coalesce(n."peerIP", '-') as pip
          from ospf_if f left join ospf_nbr n using (namespace, hostname, ifname)),
    near as (select namespace, hostname, ifname, min(("peerHostname", "peerIfname")) as p
             from lldp group by 1, 2, 3),
    own as (select namespace, vrf, string_split(ipAddress, '/')[1] as a, min(hostname) as h
            from ospf_if group by 1, 2, 3),
    named as (select o.*, case when adj = 'passive' then ''
                     else coalesce(nullif(near.p[1], ''), own.h, '') end as ph,
                     case when adj = 'passive' then ''
                     when coalesce(near.p[1], '') <> '' then coalesce(near.p[2], '') else '' end
                     as pi
              from o left join near using (namespace, hostname, ifname)
              left join own on own.namespace = o.namespace and own.vrf = o.vrf and own.a = o.pip)
"""


@query("ospf_peer_names", f"""
    with {OSPF}
    select namespace, hostname, ifname, ph as "peerHostname", pi as "peerIfname" from named""")
def _(i):
    ospf = enrich.ospf_combined(i.ospf_if, i.ospf_nbr)
    got = enrich.ospf_peernames(ospf, i.lldp, i.ifs)
    return got.select(*KEYS, "ifname", "peerHostname", "peerIfname")


@query("bgp_peer_match", """
    with s as (select namespace, "updateSource", min(hostname) as h from bgp group by 1, 2)
    select b.namespace, b.hostname, b.peer,
           case when state = 'Established' then coalesce(s.h, '') else '' end as "peerHostname"
    from bgp b left join s on s.namespace = b.namespace and s."updateSource" = b."peerIP"
    """, headline=True)
def _(i):
    return enrich.bgp_peer_match(i.bgp).select(*KEYS, "peer", "peerHostname")


@query("lldp_peer_ports", """
    with m as (select namespace, hostname, macaddr, min(ifname) as p from ifs group by 1, 2, 3),
    x as (select namespace, hostname, ifindex, min(ifname) as p from ifs
          where ifindex <> 0 group by 1, 2, 3)
    select l.namespace, l.hostname, l.ifname,
           case when "peerIfname" <> '-' then "peerIfname"
                when subtype = 'mac address' then coalesce(m.p, '-')
                when subtype like 'locally%' then coalesce(x.p, '-') else '-' end as "peerIfname"
    from lldp l
    left join m on m.namespace = l.namespace and m.hostname = l."peerHostname"
                and m.macaddr = l."peerMacaddr"
    left join x on x.namespace = l.namespace and x.hostname = l."peerHostname"
                and x.ifindex = l."peerIfindex" """)
def _(i):
    return enrich.lldp_resolve(i.lldp, i.ifs).select(*KEYS, "ifname", "peerIfname")


@query("lldp_to_bond", """
    with b as (select namespace, hostname, ifname, min(master) as m from ifs
               where type in ('bond_slave', 'bond')
                 and master not in ('bridge', 'default', '') group by 1, 2, 3),
    l as (select namespace, hostname, case when ifname = 'swp1' then 'swp7' else ifname end
          as ifname, "peerHostname", case when "peerIfname" = 'swp2' then 'swp7'
          else "peerIfname" end as "peerIfname" from lldp)
    select l.namespace, l.hostname, coalesce(b.m, l.ifname) as ifname, l."peerHostname",
           coalesce(p.m, l."peerIfname") as "peerIfname"
    from l left join b on b.namespace = l.namespace and b.hostname = l.hostname
                       and b.ifname = l.ifname
    left join b p on p.namespace = l.namespace and p.hostname = l."peerHostname"
                  and p.ifname = l."peerIfname" """)
def _(i):
    lldp = i.lldp.withColumns({
        "ifname": F.when(F.col("ifname") == "swp1", F.lit("swp7")).otherwise(F.col("ifname")),
        "peerIfname": F.when(F.col("peerIfname") == "swp2", F.lit("swp7")).otherwise(
            F.col("peerIfname"))})
    return enrich.lldp_to_bond(lldp, i.ifs).select(
        *KEYS, "ifname", "peerHostname", "peerIfname")


@query("peer_names_without_domain", """
    with h as (select distinct hostname from lldp)
    select l.namespace, l.hostname, l.ifname,
           coalesce(h.hostname, l."peerHostname") as "peerHostname"
    from lldp l left join h on h.hostname = string_split(l."peerHostname", '.')[1]""")
def _(i):
    return enrich.strip_fqdn(i.lldp).select(*KEYS, "ifname", "peerHostname")


@query("evpn_enrichment", """
    with svi as (select namespace, hostname, cast(vlan as bigint) as vlan, min(vrf) as vrf from svis
            where vrf <> '' group by 1, 2, 3),
    c as (select namespace, hostname, vlan, count(macaddr) as n from macs
          where flags in ('dynamic', 'remote') group by 1, 2, 3),
    v as (select namespace, hostname, vni, cast(vlan as bigint) as vlan, vrf from vnis)
    select v.namespace, v.hostname, v.vni, v.vlan,
           case when v.vrf = '' then coalesce(svi.vrf, '') else v.vrf end as vrf,
           coalesce(c.n, 0) as "numMacs"
    from v left join svi using (namespace, hostname, vlan)
    left join c on c.namespace = v.namespace and c.hostname = v.hostname and c.vlan = v.vlan""")
def _(i):
    svis = i.svis.select(
        *KEYS, "ifname", F.lit("vlan").alias("type"), F.col("vrf").alias("master"), "vlan")
    # Names no VNI has, so that only the VRF lookup applies.
    ports = svis.withColumn("ifname", F.concat(F.lit("none"), "ifname"))
    return enrich.evpn_enrich(i.vnis, ports, i.macs).select(
        *KEYS, "vni", "vlan", "vrf", "numMacs")


@query("device_status", """
    with failed as (
      select p.namespace, coalesce(a.hostname, p.hostname) as hostname, p.status, p.timestamp
      from (select * from polls where service = 'device' and status not in (0, 200)) p
      left join (select namespace, address, min(hostname) as hostname from devices group by 1, 2) a
        on a.namespace = p.namespace and a.address = p.hostname),
    f as (select * from (select *, row_number() over (partition by namespace, hostname
                         order by timestamp desc, status desc) rn from failed) t where rn = 1)
    select coalesce(d.namespace, f.namespace) as namespace,
           coalesce(d.hostname, f.hostname) as hostname,
           case when d.hostname is null then 'neverpoll' when d.active then d.status
                else 'dead' end as status,
           case when f.status = 418 then 'unsupported' when d.hostname is null then 'N/A'
                else d.version end as version,
           coalesce(d.address, f.hostname) as address
    from devices d full join f on d.namespace = f.namespace and d.hostname = f.hostname""")
def _(i):
    failed = i.polls.where("service = 'device' and status not in (0, 200)")
    return enrich.device_status(i.devices, failed).select(*KEYS, "status", "version", "address")


@query("inventory_port_names", """
    with p as (select namespace, hostname, 'Ethernet' || replace(ifname, 'swp', '') || '/1'
               as ifname, replace(ifname, 'swp', '') as num from ifs
               where type in ('ethernet', 'bond_slave'))
    select x.namespace, x.hostname, x.k, coalesce(p.ifname, x.name) as name
    from (select namespace, hostname, timestamp as k, 'port-' || (timestamp % 8) as name,
                 cast(timestamp % 8 as varchar) as num from lldp) x
    left join p on p.namespace = x.namespace and p.hostname = x.hostname and p.num = x.num""")
def _(i):
    inventory = i.lldp.select(
        *KEYS, F.col("timestamp").alias("k"), F.lit("xcvr").alias("type"),
        F.concat(F.lit("port-"), F.col("timestamp") % 8).alias("name"))
    ports = i.ifs.withColumn("ifname", F.concat(
        F.lit("Ethernet"), F.regexp_replace("ifname", "swp", ""), F.lit("/1")))
    return enrich.inventory_ifnames(inventory, ports).select(*KEYS, "k", "name")


@query("namespace_rollup", """
    with d as (select distinct namespace, hostname from devices),
    p as (select polls.* from polls join d using (namespace, hostname))
    select p.namespace, (select count(*) from d where d.namespace = p.namespace) as "deviceCnt",
           count(distinct service) as "serviceCnt",
           count(distinct case when status not in (0, 200) then service end) as "errSvcCnt",
           max(timestamp) as "lastUpdate",
           p.namespace in (select b.namespace from bgp b join d using (namespace, hostname))
           as "hasBgp", false as "hasMlag"
    from p group by 1""")
def _(i):
    return enrich.namespace_rollup(i.devices, i.polls, {"bgp": i.bgp}).select(
        "namespace", "deviceCnt", "serviceCnt", "errSvcCnt", "lastUpdate", "hasBgp", "hasMlag")


@query("arp_with_vrf", """
    with v as (select namespace, hostname, ifname, min(master) as m from ifs group by 1, 2, 3)
    select namespace, hostname, "ipAddress", oif, macaddr,
           case when m = '' then 'default' else m end as vrf
    from (select a.*, v.m, row_number() over (partition by a.namespace, a.hostname, "ipAddress",
                 oif order by timestamp desc, macaddr) as rn
          from arpnd a left join v on v.namespace = a.namespace and v.hostname = a.hostname
               and v.ifname = a.oif
          where state <> 'failed') t where rn = 1""")
def _(i):
    return enrich.arpnd_with_vrf(i.arpnd, i.ifs).select(
        *KEYS, "ipAddress", "oif", "macaddr", "vrf")


@query("port_modes_and_vlans", """
    with vl as (select namespace, hostname, ifname, string_agg(vlan, ',' order by vlan) as vs
                from (select distinct namespace, hostname, unnest(interfaces) as ifname, vlan
                      from vlans) t group by 1, 2, 3),
    md as (select namespace, hostname, ifname, case when speed = 10000 then 'trunk'
                  else 'access' end as mode from ifs where mtu = 1500)
    select f.namespace, f.hostname, f.ifname,
           case when "adminState" <> 'up' then '' else coalesce(md.mode, 'routed') end as portmode,
           case when "adminState" = 'up' and coalesce(md.mode, 'routed') in ('access', 'routed')
                then '' else coalesce(vl.vs, '') end as vlans
    from ifs f left join md using (namespace, hostname, ifname)
    left join vl using (namespace, hostname, ifname)""")
def _(i):
    modes = i.ifs.where("mtu = 1500").select(
        *KEYS, "ifname", F.when(F.col("speed") == 10000, F.lit("trunk")).otherwise(
            F.lit("access")).alias("portmode"), F.lit(0).alias("vlan"))
    got = enrich.interfaces_vlanlist(enrich.interfaces_portmode(i.ifs, modes), i.vlans)
    return got.select(*KEYS, "ifname", "portmode", F.array_join("vlanList", ",").alias("vlans"))


@query("bond_members", """
    select namespace, hostname, master as bond, string_agg(ifname, ',' order by ifname) as members
    from ifs where master not in ('', 'bridge', 'default') group by 1, 2, 3""")
def _(i):
    return enrich.bond_members(i.ifs).select(
        *KEYS, "bond", F.array_join("members", ",").alias("members"))


@query("mlag_pairs", """
    with m as (select concat('ns', s_suppkey % 3) as namespace, concat('h', s_suppkey) as hostname,
                      concat('sys', s_suppkey // 6, '-', s_suppkey % 3) as sys from supplier),
    p as (select namespace, sys, min(hostname) as a, max(hostname) as b from m group by 1, 2)
    select m.namespace, m.hostname, m.sys as "systemId",
           case when m.hostname = p.a then nullif(p.b, p.a) else p.a end as "mlagPeer",
           'port-channel1' as "peerLink"
    from m join p using (namespace, sys)""")
def _(i):
    mlag = i.supplier.select(
        F.concat(F.lit("ns"), F.col("s_suppkey") % 3).alias("namespace"),
        F.concat(F.lit("h"), "s_suppkey").alias("hostname"),
        F.concat(F.lit("sys"), F.expr("s_suppkey div 6"), F.lit("-"), F.col("s_suppkey") % 3)
        .alias("systemId"), F.lit("Po1").alias("peerLink"))
    return enrich.mlag_peers(mlag)


@query("parents_of_dot_zero", """
    with x as (select namespace, hostname, type,
                      case when timestamp % 16 = 1 then 'swp2.0' else ifname end as ifname
               from ifs),
    gone as (select distinct namespace, hostname, string_split(ifname, '.')[1] as ifname
             from x where ifname like '%.0')
    select x.namespace, x.hostname,
           case when x.ifname like '%.0' and type not in ('subinterface', 'vlan') then x.ifname
                else string_split(x.ifname, '.')[1] end as ifname,
           case when x.ifname like '%.0' then 'ethernet' else type end as type
    from x left join gone g on g.namespace = x.namespace and g.hostname = x.hostname
         and g.ifname = x.ifname
    where g.ifname is null""")
def _(i):
    df = i.ifs.withColumn("ifname", F.when(
        F.col("timestamp") % 16 == 1, F.lit("swp2.0")).otherwise(F.col("ifname")))
    return enrich.drop_parents_of_dot_zero(df).select(*KEYS, "ifname", "type")


# -- assertions -------------------------------------------------------------

LINKS = """
    near as (select namespace, hostname, ifname, min(("peerHostname", "peerIfname")) as p
             from lldp where "peerIfname" <> '-' group by 1, 2, 3),
    b as (select *, 'routed' as pm from ifs
          where type in ('ethernet', 'bond_slave', 'subinterface', 'vlan', 'bond')
            and state = 'up'),
    j as (select b.*, near.p[1] as ph, near.p[2] as pi, q.ifname as qif, q.mtu as qmtu,
                 q.speed as qspeed, q.ipAddressList as qip,
                 b.master = 'bridge' or b.type in ('bond_slave', 'vlan') as skip,
                 exists (select 1 from b k where k.namespace = b.namespace
                         and k.hostname = near.p[1]) as known
          from b left join near using (namespace, hostname, ifname)
          left join (select * from b where type <> 'vlan') q on q.namespace = b.namespace
               and q.hostname = near.p[1] and q.ifname = near.p[2] and b.type <> 'vlan')
"""


@query("assert_interfaces", f"""
    with {LINKS}
    select namespace, hostname, ifname, r.reason as reason from j, lateral (
      select unnest([
        case when "adminState" = 'down' or ("adminState" = 'up' and state = 'up') then null
             else 'Interface Down' end,
        case when qif is null and not skip then case when coalesce(ph, '') <> '' and not known
             then 'Unpolled Peer' else 'No Peer Found' end end,
        case when qif is not null and not skip and mtu <> qmtu then 'MTU mismatch' end,
        case when qif is not null and not skip and speed <> qspeed then 'Speed mismatch' end,
        case when qif is not null and not skip
               and not (ipAddressList[1] like '%/32')
               and not (string_split(ipAddressList[1], '/')[2] = string_split(qip[1], '/')[2]
                        and case when ipAddressList[1] like '%/24' then
                          regexp_extract(ipAddressList[1], '^\\d+\\.\\d+\\.\\d+')
                          = regexp_extract(qip[1], '^\\d+\\.\\d+\\.\\d+')
                        else regexp_extract(ipAddressList[1], '^\\d+\\.\\d+\\.\\d+')
                          = regexp_extract(qip[1], '^\\d+\\.\\d+\\.\\d+')
                          and cast(regexp_extract(ipAddressList[1], '\\.(\\d+)/', 1) as int) // 2
                          = cast(regexp_extract(qip[1], '\\.(\\d+)/', 1) as int) // 2 end)
             then 'IP address mismatch' end]) as reason) r
    where r.reason is not null""")
def _(i):
    ifs = i.ifs.withColumns({"portmode": F.lit("routed"),
                             "vlanList": F.array().cast("array<bigint>")})
    got = asserts.assert_interfaces(ifs, i.lldp)
    return got.select(*KEYS, "ifname", F.explode("assertReason").alias("reason"))


@query("assert_mtu_values", """
    select namespace, hostname, ifname, case when mtu in (9216, 9000) then 'pass' else 'fail' end
           as result from ifs""")
def _(i):
    return asserts.assert_mtu(i.ifs, [9216, 9000]).select(*KEYS, "ifname", "result")


@query("assert_bgp", """
    with s as (select * from bgp where state <> 'dynamic'),
    ends as (select namespace, "updateSource", "peerIP",
                    min((hostname, asn, "peerAsn")) as e from s
             where "updateSource" <> '' and "peerIP" <> '' group by 1, 2, 3),
    p as (select namespace, hostname, ifname, min(("adminState", state)) as f from ifs
          group by 1, 2, 3),
    j as (select s.*, e.e, p.f from s
          left join ends e on e.namespace = s.namespace and e."updateSource" = s."peerIP"
               and e."peerIP" = s."updateSource"
          left join p on p.namespace = s.namespace and p.hostname = s.hostname
               and p.ifname = s.ifname),
    r as (select *, list_filter([
        case when state <> 'Established' and f is not null then case when f[1] <> 'up'
             then 'interface admin down' when f[2] <> 'up' then 'interface down' end end,
        case when state <> 'Established' and e is not null
               and (asn <> e[3] or e[2] <> "peerAsn") then 'asn mismatch' end,
        case when state <> 'Established' and reason not in ('', 'None', 'No error')
             then concat(reason, ':', "notificnReason") end,
        case when state = 'Established' and raw_adv[1] <> 'x'
             then 'Not all Afi/Safis enabled' end], lambda x: x is not null) as rs from j)
    select namespace, hostname, peer, case when state = 'Established' and len(rs) = 0
           then 'pass' else 'fail' end as result,
           unnest(case when len(rs) = 0 then ['-'] else rs end) as reason
    from r""")
def _(i):
    none = F.array().cast("array<string>")
    bgp = i.bgp.withColumns({
        "afisAdvOnly": F.when(F.get("raw_adv", F.lit(0)) != "x", F.col("raw_adv")).otherwise(none),
        "afisRcvOnly": none})
    return asserts.assert_bgp(bgp, i.ifs).select(
        *KEYS, "peer", "result", F.col("assertReason").alias("reason"))


@query("assert_ospf", f"""
    with {OSPF},
    base as (select * from named where ifst <> 'adminDown'),
    ids as (select namespace, "routerId", count(distinct hostname) as n, min(hostname) as a,
                   max(hostname) as z from base group by 1, 2),
    m as (select namespace, hostname, ifname, min(mtu) as mtu from ifs group by 1, 2, 3),
    x as (select base.*, ids.n, ids.a, ids.z, m.mtu from base
          join ids using (namespace, "routerId")
          left join m using (namespace, hostname, ifname)),
    j as (select x.*, q.hostname as qh, q.area as qarea, q."areaStub" as qstub,
                 q."helloTime" as qhello, q."networkType" as qnet, q.ipAddress as qip,
                 q.mtu as qmtu,
                 x.adj in ('passive', 'full') as good
          from x left join x q on q.namespace = x.namespace and q.hostname = x.ph
               and q.ifname = x.pi),
    r as (select *, list_filter([
        case when n > 1 then concat('duplicate routerId ', a, '..', z) end,
        case when not good and ifst = 'down' then 'ifdown' end,
        case when not good and ifst <> 'down' and qh is not null
              and regexp_extract(ipAddress, '^\\d+\\.\\d+\\.\\d+')
                  <> regexp_extract(qip, '^\\d+\\.\\d+\\.\\d+') then 'subnet mismatch' end,
        case when not good and ifst <> 'down' and area <> qarea then 'area mismatch' end,
        case when not good and ifst <> 'down' and "areaStub" <> qstub
             then 'area stub mismatch' end,
        case when not good and ifst <> 'down' and "helloTime" <> qhello
             then 'Hello timers mismatch' end,
        case when not good and ifst <> 'down' and "networkType" <> qnet
             then 'network type mismatch' end,
        case when not good and ifst <> 'down' and qh is not null and mtu <> qmtu
             then 'MTU mismatch' end,
        case when not good and ifst <> 'down' and qh is null then 'No Peer Found' end],
        lambda y: y is not null) as rs from j)
    select namespace, hostname, ifname, adj as "adjState",
           array_to_string(case when len(rs) = 0 and not good and ifst <> 'down'
                           then ['No Peer Found'] else rs end, '; ') as reasons
    from r""")
def _(i):
    ospf = enrich.ospf_combined(i.ospf_if, i.ospf_nbr)
    named = enrich.ospf_peernames(ospf, i.lldp, i.ifs)
    return asserts.assert_ospf(named, i.ifs).select(
        *KEYS, "ifname", "adjState", F.array_join("assertReason", "; ").alias("reasons"))


@query("assert_evpn", """
    with s as (select namespace, hostname, vlan, min((vrf, macaddr)) as v from svis
               group by 1, 2, 3),
    d as (select x.namespace, x.hostname, x.vni, x.type, x.state, x."replicationType",
                 x."mcastGroup", s.v[1] as vrf, s.v[2] as macaddr,
                 array_to_string(list_sort(list_concat(x."remoteVtepList", [x."priVtepIp"])), ',')
                 as vteps
          from vnis x left join s on s.namespace = x.namespace and s.hostname = x.hostname
               and s.vlan = x.vlan),
    v as (select namespace, vni, count(distinct "replicationType") as repl,
                 count(distinct case when "mcastGroup" <> '0.0.0.0' then "mcastGroup" end) as grp,
                 count(distinct vteps) as vt, count(distinct vrf) as vrfs from d group by 1, 2),
    n as (select namespace, count(distinct case when type = 'L2' then macaddr end) as macs,
                 bool_or("mcastGroup" <> '0.0.0.0') as mc from d group by 1)
    select d.namespace, d.hostname, d.vni, array_to_string(list_filter([
        case when state <> 'up' then 'vni down' end,
        case when mc and repl <> 1 then 'inconsistent replication across hosts' end,
        case when mc and grp > 1 then 'VNI has multiple mcast group' end,
        case when not mc and vt <> 1 then 'Some VTEPs are unknown to all' end,
        case when vrfs > 1 then 'Inconsistent VNI-VRF mapping' end,
        case when macs <> 1 and vrfs > 0 then 'anycast MAC not unique across VNI' end],
        lambda x: x is not null), '; ') as reasons
    from d join v using (namespace, vni) join n using (namespace)""")
def _(i):
    return asserts.assert_evpn(i.vnis, i.svis).select(
        *KEYS, "vni", F.array_join("assertReason", "; ").alias("reasons"))


@query("head_end_replication", """
    with m as (select namespace, hostname, concat('vni', vlan) as ifname,
                      list(distinct concat('10.2.2.', vlan % 20)) as her
               from macs group by 1, 2, 3)
    select v.namespace, v.hostname, v.vni,
           array_to_string(list_sort(list_filter(v."remoteVtepList",
             lambda x: not list_contains(coalesce(m.her, []), x))), ',') as missing
    from vnis v left join m using (namespace, hostname, ifname)""")
def _(i):
    macs = i.macs.select(
        *KEYS, F.lit("00:00:00:00:00:00").alias("macaddr"),
        F.concat(F.lit("vni"), "vlan").alias("oif"),
        F.concat(F.lit("10.2.2."), F.col("vlan") % 20).alias("remoteVtepIp"))
    df = i.vnis.join(asserts.her_heads(macs), [*KEYS, "ifname"], "left")
    return df.select(*KEYS, "vni", F.array_join(asserts.her_missing("__her"), ",").alias("missing"))
