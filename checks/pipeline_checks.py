"""Change capture, compaction, migration, normalisation, configurations, pseudonyms."""

from pyspark.sql import functions as F

from checks.registry import query
from netstate.operators import config, normalize as N, pseudonymize as P
from netstate.operators.normalize import Compute, Field, Step
from netstate.sources import capture, migrate
from netstate.streaming import cdc, compact, stats

KEYS = ["namespace", "hostname"]
MID = 1_705_276_800_000
DAY = 86_400_000


def _snapshots(i):
    """State before and after the middle; objects in state error are not in the second."""
    from netstate.operators.views import latest

    log = i.log.select(*KEYS, "timestamp", "state").withColumn("active", F.lit(True))
    old = latest(log.where(F.col("timestamp") < MID), KEYS)
    new = latest(log.where(F.col("timestamp") >= MID), KEYS)
    return old, new.where("state != 'error'")


SNAPSHOTS = f"""
    o as (select * from (select namespace, hostname, timestamp, state, value, row_number() over (
            partition by namespace, hostname order by timestamp desc) rn from log
          where timestamp < {MID}) t where rn = 1),
    n as (select * from (select namespace, hostname, timestamp, state, value, row_number() over (
            partition by namespace, hostname order by timestamp desc) rn from log
          where timestamp >= {MID}) t where rn = 1 and state <> 'error')"""


@query("change_capture", f"""
    with {SNAPSHOTS}
    select n.namespace, n.hostname, n.timestamp, n.state, true as active
    from n left join o using (namespace, hostname)
    where o.hostname is null or o.state <> n.state
    union all
    select o.namespace, o.hostname, {MID}, o.state, false
    from o left join n using (namespace, hostname) where n.hostname is null""", headline=True)
def _(i):
    old, new = _snapshots(i)
    got = cdc.cdc_diff(old, new, KEYS, deleted_at=MID)
    return got.select(*KEYS, "timestamp", "state", "active")


@query("change_capture_lists", """
    with o as (select namespace, hostname, "vlanName", interfaces, state from vlans
               where vlan % 5 <> 0),
    n as (select namespace, hostname, "vlanName", list_reverse(interfaces) as interfaces,
                 case when vlan % 7 = 0 then 'gone' else state end as state from vlans
          where vlan % 3 <> 0)
    select namespace, hostname, "vlanName", n.state, true as active
    from n left join o using (namespace, hostname, "vlanName")
    where o.state is null or o.state <> n.state
    union all
    select namespace, hostname, "vlanName", o.state, false
    from o left join n using (namespace, hostname, "vlanName") where n.state is null""")
def _(i):
    base = i.vlans.withColumns({"timestamp": F.lit(5).cast("bigint"), "active": F.lit(True)})
    old = base.where("vlan % 5 <> 0").drop("vlan")
    new = base.where("vlan % 3 <> 0").withColumns({
        "interfaces": F.reverse("interfaces"),
        "state": F.when(F.col("vlan") % 7 == 0, F.lit("gone")).otherwise(F.col("state"))}).drop(
        "vlan")
    return cdc.cdc_diff(old, new, [*KEYS, "vlanName"], table="vlan").select(
        *KEYS, "vlanName", "state", "active")


@query("restart_rewrites_all", f"""
    with {SNAPSHOTS}
    select n.namespace, n.hostname, n.state,
           case when o.state = 'purchase' then 900000 when o.state is null then 0
                else 100000 end as "deviceSession"
    from n left join o using (namespace, hostname)
    where o.hostname is null or o.state <> n.state or o.state = 'purchase'""")
def _(i):
    old, new = _snapshots(i)
    old = old.withColumn("deviceSession", F.lit(100_000).cast("bigint"))
    new = new.withColumn("deviceSession", F.lit(0).cast("bigint"))
    boots = old.select(*KEYS, F.when(F.col("state") == "purchase", F.lit(900_000)).otherwise(
        F.lit(104_000)).cast("bigint").alias("boot"))
    again = cdc.restarted_devices(old, boots)
    rows = cdc.cdc_diff(old, new, KEYS, rewrite=again, deleted_at=MID).where("active")
    return cdc.stamp_sessions(rows, old, boots).select(
        *KEYS, "state", F.col("deviceSession").cast("int").alias("deviceSession"))


@query("failure_hysteresis", """
    with p as (select *, row_number() over (partition by namespace, hostname, service
                      order by timestamp) as n from polls),
    q as (select *, max(case when status in (0, 200) or n = 1 then n end) over (
            partition by namespace, hostname, service order by timestamp) as ok from p)
    select namespace, hostname, service, timestamp, n - ok as streak,
           n = 1 or not (n - ok between 1 and 2) as commit
    from q""")
def _(i):
    # Every key is cut into chunks here, as a hot one would be.
    return cdc.failure_streaks(i.polls, hot_rows=0).select(
        *KEYS, "service", "timestamp", "streak", "commit")


@query("poll_statistics", """
    select namespace, timestamp // 300000 as slot, min("gatherTime")::double as lo,
           max("gatherTime")::double as hi, avg("gatherTime")::double as mean,
           list_reduce(list(cast("gatherTime" as double) order by timestamp),
                       lambda a, b: case when (a + b) / 2 < 0.001 then 0.0 else (a + b) / 2 end)
           as recent,
           count(case when "totalTime" > 60000 then 1 end) as excess
    from polls group by 1, 2""")
def _(i):
    polls = i.polls.withColumn("ts", F.timestamp_millis("timestamp"))
    got = stats.poll_stats(polls, keys=["namespace"], measures=["gatherTime"])
    g = F.col("gatherTime")
    return got.select(
        "namespace", F.expr("unix_millis(window.start) div 300000").alias("slot"),
        F.get(g, F.lit(0)).alias("lo"), F.get(g, F.lit(1)).alias("hi"),
        F.col("gatherTimeAvg").alias("mean"), F.get(g, F.lit(2)).alias("recent"),
        F.col("pollExcdPeriodCount").alias("excess"))


@query("statistics_flushed_at_once", """
    with p as (select *, lag(status) over (partition by namespace, hostname, service
                      order by timestamp) as before from polls)
    select namespace, hostname, service, timestamp from p
    where "totalTime" > 400000 or (before is not null and before <> status)""")
def _(i):
    return stats.flush_points(i.polls, 400_000).select(*KEYS, "service", "timestamp")


@query("compaction_blocks", f"""
    with r as (select *, timestamp - timestamp % {DAY} as block_start from log),
    b as (select distinct block_start as block from r),
    k as (select namespace, hostname, min(block_start) as first from r group by 1, 2),
    grid as (select * from k cross join b where block > first),
    missing as (select g.* from grid g where not exists (
        select 1 from r where r.namespace = g.namespace and r.hostname = g.hostname
        and r.block_start = g.block))
    select namespace, hostname, timestamp, event_id, block_start from r
    union all
    select m.namespace, m.hostname, r.timestamp, r.event_id, m.block
    from missing m asof join r on m.namespace = r.namespace and m.hostname = r.hostname
         and m.block >= r.timestamp""", headline=True)
def _(i):
    got = compact.compact_rows(i.log, KEYS, DAY)
    return got.select(*KEYS, "timestamp", "event_id", "block_start")


@query("compaction_with_earlier_state", f"""
    with r as (select *, timestamp - timestamp % {DAY} as block_start from log
               where timestamp >= {MID} and state = 'click'),
    old as (select * from (select *, row_number() over (partition by namespace, hostname
              order by timestamp desc) rn from log where timestamp < {MID}) t where rn = 1),
    b as (select distinct block_start as block from r),
    every as (select namespace, hostname, timestamp, event_id, cast(null as bigint) as block_start
              from old
              union all select namespace, hostname, timestamp, event_id, block_start from r),
    k as (select distinct namespace, hostname from every),
    missing as (select k.*, b.block from k cross join b where not exists (
        select 1 from r where r.namespace = k.namespace and r.hostname = k.hostname
        and r.block_start = b.block))
    select namespace, hostname, timestamp, event_id, block_start from r
    union all
    select m.namespace, m.hostname, e.timestamp, e.event_id, m.block
    from missing m asof join every e on m.namespace = e.namespace and m.hostname = e.hostname
         and m.block >= e.timestamp""")
def _(i):
    from netstate.operators.views import as_of

    rows = i.log.where((F.col("timestamp") >= MID) & (F.col("state") == "click"))
    state = as_of(i.log, KEYS, MID - 1)
    return compact.compact_rows(rows, KEYS, DAY, state=state).select(
        *KEYS, "timestamp", "event_id", "block_start")


@query("latest_from_last_block", """
    select namespace, hostname, timestamp, event_id from (
      select *, row_number() over (partition by namespace, hostname order by timestamp desc) rn
      from log) t where rn = 1""")
def _(i):
    from netstate.operators.views import latest
    from netstate.sources.read import prune_blocks

    blocks = compact.compact_rows(i.log, KEYS, DAY)
    known = [(r.namespace, r.block_start) for r in blocks.select(
        "namespace", "block_start").distinct().collect()]
    return latest(prune_blocks(blocks, known, DAY), KEYS).select(
        *KEYS, "timestamp", "event_id")


@query("compaction_of_counters", f"""
    select namespace, hostname, service, timestamp, timestamp - timestamp % {DAY} as block_start
    from polls
    where timestamp - timestamp % {DAY} + {DAY} <= (select max(timestamp) from polls)""")
def _(i):
    now = i.polls.agg(F.max("timestamp")).first()[0]
    return compact.compact_rows(
        i.polls, [*KEYS, "service"], DAY, kind="counters", now_ms=now).select(
        *KEYS, "service", "timestamp", "block_start")


@query("migrate_bgp_families", """
    with f as (
      select timestamp, hostname, 'ipv4' as afi, 'unicast' as safi, v4PfxRx as rx, '' as com,
             * exclude (timestamp, hostname) from bgp_v1 where v4Enabled
      union all by name
      select timestamp, hostname, 'ipv6' as afi, 'unicast' as safi, v6PfxRx as rx, '' as com,
             * exclude (timestamp, hostname) from bgp_v1 where v6Enabled
      union all by name
      select timestamp, hostname, 'l2vpn' as afi, 'evpn' as safi, evpnPfxRx as rx,
             case evpnSendCommunity when 'extended' then 'extended' when 'standard'
               then 'standard' else 'standard,extended' end as com,
             * exclude (timestamp, hostname) from bgp_v1 where evpnEnabled)
    select timestamp, hostname, afi, safi, cast(rx as bigint) as "pfxRx",
           concat_ws(',', case when v4Advertised and not v4Received then 'ipv4 unicast' end,
                     case when evpnAdvertised and not evpnReceived then 'l2vpn evpn' end) as adv,
           concat_ws(',', case when not v4Advertised and v4Received then 'ipv4 unicast' end,
                     case when not evpnAdvertised and evpnReceived then 'l2vpn evpn' end) as rcv,
           com as communities
    from f""")
def _(i):
    got = migrate.migrate(i.bgp_v1, "bgp", "1.0")
    return got.select("timestamp", "hostname", "afi", "safi", "pfxRx",
                      F.array_join("afisAdvOnly", ",").alias("adv"),
                      F.array_join("afisRcvOnly", ",").alias("rcv"),
                      F.array_join("communityTypes", ",").alias("communities"))


# -- normalisation ----------------------------------------------------------

@query("json_extraction", """
    select o_orderkey, concat('vrf', o_orderkey % 3) as vrf,
           concat('10.0.', o_custkey % 200, '.0/24') as prefix, lower(o_orderstatus) as protocol,
           o_custkey + 10 as cost, concat('eth', o_orderkey % 4, ',eth', o_orderkey % 5) as ports,
           case when o_orderstatus = 'F' then 'up' else 'down' end as state
    from orders""")
def _(i):
    vrf = F.concat(F.lit("vrf"), F.col("o_orderkey") % 3)
    prefix = F.concat(F.lit("10.0."), F.col("o_custkey") % 200, F.lit(".0/24"))
    vias = F.array(*[
        F.struct(F.concat(F.lit("eth"), F.col("o_orderkey") % n).alias("interface"))
        for n in (4, 5)])
    route = F.struct(F.lower("o_orderstatus").alias("routeType"), F.col("o_custkey").alias(
        "metric"), vias.alias("vias"), F.col("o_orderstatus").alias("flag"))
    data = F.to_json(F.create_map(F.lit("vrfs"), F.create_map(
        vrf, F.struct(F.create_map(prefix, route).alias("routes")))))
    rows = N.extract_json(
        i.orders.select("o_orderkey", data.alias("data")),
        [Step("vrfs", "map", "vrf"), Step("routes", "map", "prefix")],
        [Field("protocol", "routeType"), Field("metric", "metric", "bigint", 0),
         Field("ports", "vias[].interface", "array<string>"),
         Field("state", "flag", default="down", expect={"F": "up"}),
         Compute("cost", "metric", "+", 10)])
    return rows.select("o_orderkey", "vrf", "prefix", "protocol", "cost",
                       F.array_join("ports", ",").alias("ports"), "state")


@query("event_properties", """
    select event_id, cast(json_extract(props, '$.k') as bigint) as k,
           cast(json_extract(props, '$.k') as bigint) * 2 as twice, 'none' as missing
    from events""")
def _(i):
    return N.extract_json(
        i.events.select("event_id", F.col("props").alias("data")), [],
        [Field("k", "k", "bigint"), Field("missing", "nothere", default="none"),
         Compute("twice", "k", "*", 2)])


@query("capture_records", """
    select user_id, event_id, case when event_type = 'error' then 2011 else 0 end as status,
           event_type as cmd from events where event_type <> 'error'""")
def _(i):
    one = F.struct(
        F.when(F.col("event_type") == "error", 2011).otherwise(0).alias("status"),
        F.col("event_id").alias("timestamp"), F.col("event_type").alias("cmd"),
        F.col("user_id").cast("string").alias("hostname"), F.col("props").alias("data"))
    # One file text per event pair: two arrays written back to back.
    texts = i.events.groupBy(F.expr("event_id div 2").alias("pair")).agg(
        F.array_join(F.collect_list(F.to_json(F.array(one))), "\n").alias("value"))
    rows = N.ok_only(capture.parse_capture_text(texts))
    return rows.select(F.col("hostname").cast("bigint").alias("user_id"),
                       F.col("timestamp").alias("event_id"), "status", "cmd")


@query("pick_normalizer", """
    select hostname, case when hostname = 'h7' then 'special' when os = 'eos' then
             case when cast(string_split(version, '.')[1] as int) >= 2
                       and version <> '2.0a' then 'eos-new'  -- a letter is older than none
                  else 'eos-old' end
             when os = 'nxos' then 'nxos' else 'nxos' end as normalizer
    from devices""")
def _(i):
    rules = i.devices.sparkSession.createDataFrame(
        [("h7", None, None, None, "special"), (None, "eos", ">=2.0", None, "eos-new"),
         (None, "eos", "<2.0", None, "eos-old"), (None, "nxos", None, None, "nxos"),
         (None, "cumulus", None, "nxos", None)],
        "hostname string, devtype string, version string, copy string, normalizer string")
    return N.pick_normalizer(
        i.devices.select("hostname", F.col("os").alias("devtype"), "version"), rules
    ).select("hostname", "normalizer")


@query("merge_command_records", """
    with r as (select l_orderkey, l_linenumber, nullif(case when l_returnflag = 'A' then ''
                      else l_returnflag end, '') as flag,
                      row_number() over (partition by l_orderkey order by l_linenumber,
                        l_partkey, l_suppkey) as n from lineitem)
    select l_orderkey, min_by(flag, n) filter (flag is not null) as flag,
           nullif(max_by(flag, n) filter (flag is not null),
                  min_by(flag, n) filter (flag is not null)) as second
    from r group by 1""")
def _(i):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = i.lineitem.select(
        "l_orderkey", F.when(F.col("l_returnflag") == "A", F.lit("")).otherwise(
            F.col("l_returnflag")).alias("flag"), F.row_number().over(order).alias("cmd_no"))
    got = N.merge_commands(rows, ["l_orderkey"])
    return got.select("l_orderkey", "flag", F.col("`flag-_2nd`").alias("second"))


@query("conform_records", """
    select hostname, mtu, state, speed, active, sqvers from (
      select concat('h', c_custkey) as hostname,
             case when c_custkey % 3 = 0 then 0 else c_nationkey end::bigint as mtu,
             c_mktsegment as state, 0::bigint as speed, true as active, '4.0' as sqvers
      from customer) t""")
def _(i):
    raw = i.customer.select(
        F.concat(F.lit("h"), "c_custkey").alias("hostname"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("n/a")).otherwise(
            F.col("c_nationkey").cast("string")).alias("mtu"),
        F.col("c_mktsegment").alias("state"))
    return N.conform_record(raw, "interfaces", namespace=F.lit("dc")).select(
        "hostname", "mtu", "state", "speed", "active", "sqvers")


@query("mac_keys", """
    select namespace, hostname, macaddr, vlan,
           case when "remoteVtepIp" <> '' then case when vlan <> 0 then cast(vlan as varchar)
                  else oif end
                when vlan <> 0 then case when flags = 'static' then concat(vlan, '-', oif)
                  else cast(vlan as varchar) end
                when flags = 'static' then oif else '0' end as key
    from macs""")
def _(i):
    return i.macs.withColumn("bd", F.lit("")).select(
        *KEYS, "macaddr", "vlan", N.mac_key().alias("key"))


@query("merge_mac_entries", """
    with r as (select namespace, hostname, macaddr, oif, "remoteVtepIp" as vtep,
                      case when vlan < 15 then 0 else vlan end as v, vlan as pos from macs),
    f as (select namespace, hostname, macaddr, oif, min_by(v, pos) as first from r where v <> 0
          group by 1, 2, 3, 4),
    x as (select r.*, case when v <> 0 then v else coalesce(f.first, 0) end as g
          from r left join f using (namespace, hostname, macaddr, oif))
    select namespace, hostname, macaddr, oif, max(v) as vlan,
           coalesce(min_by(vtep, pos) filter (vtep <> ''), '') as "remoteVtepIp"
    from x group by namespace, hostname, macaddr, oif, g""")
def _(i):
    rows = i.macs.select(
        *KEYS, "macaddr", "oif", "remoteVtepIp", "flags", F.col("vlan").alias("pos"),
        F.when(F.col("vlan") < 15, F.lit(0)).otherwise(F.col("vlan")).alias("vlan"))
    return N.merge_mac_entries(rows).select(*KEYS, "macaddr", "oif", "vlan", "remoteVtepIp")


@query("mac_lists_to_rows", """
    select p_partkey, concat('m', unnest([p_size, p_size + 1])) as macaddr,
           unnest(['ge-1', 'xe-2']) as oif, unnest([10, 20])::bigint as vlan
    from part""")
def _(i):
    rows = i.part.select(
        "p_partkey", F.array(F.concat(F.lit("m"), "p_size"),
                             F.concat(F.lit("m"), F.col("p_size") + 1)).alias("macaddr"),
        F.array(F.lit("ge-1.10"), F.lit("xe-2.20")).alias("oif"), F.lit("").alias("bd"),
        F.lit(0).cast("bigint").alias("vlan"))
    return N.explode_mac_lists(rows).select("p_partkey", "macaddr", "oif", "vlan")


@query("vlan_transpose", """
    with r as (select namespace, hostname, p, unnest([vlan, vlan + 1]) as vlan
               from (select namespace, hostname, unnest(interfaces) as p, vlan from vlans) t)
    select namespace, hostname, vlan, coalesce(string_agg(distinct case when p <> 'swp0' then p end,
           ',' order by case when p <> 'swp0' then p end), '') as ports,
           case when count(case when p <> 'swp0' then 1 end) > 0 then 'active' else 'suspended' end
           as state
    from r group by 1, 2, 3""")
def _(i):
    rows = i.vlans.select(*KEYS, F.explode("interfaces").alias("p"), "vlan").select(
        *KEYS, F.when(F.col("p") == "swp0", F.lit("bridge")).otherwise(F.col("p")).alias("ifname"),
        F.concat(F.col("vlan"), F.lit("-"), F.col("vlan") + 1).alias("vlans"))
    return N.vlan_ranges_transpose(rows).select(
        *KEYS, "vlan", F.array_join("interfaces", ",").alias("ports"), "state")


@query("vrf_of_members", """
    select namespace, hostname, ifname, case when timestamp % 8 in (1, 2)
           and exists (select 1 from ifs v where v.namespace = i.namespace
                       and v.hostname = i.hostname and v.ifname = 'swp0')
           then 'swp0' else master end as master
    from ifs i""")
def _(i):
    df = i.ifs.withColumns({
        "type": F.when(F.col("ifname") == "swp0", F.lit("vrf")).otherwise(F.col("type")),
        "_interfaceList": F.array(F.lit("swp1"), F.lit("swp2"))})
    return N.assign_vrf(df).select(*KEYS, "ifname", "master")


@query("missing_speeds", """
    select namespace, hostname, ifname,
           case when speed <> 10000 then speed when type in ('ethernet', 'bond', 'bond_slave')
                then -1 else 0 end as speed from ifs""")
def _(i):
    return i.ifs.select(*KEYS, "ifname", N.speed_or_missing(missing=10000).cast("bigint").alias(
        "speed"))


@query("link_change_counts", """
    select o_orderkey, o_custkey % 7 + o_orderkey % 5 as "numChanges",
           case when o_orderstatus = 'P' then 0 else epoch_us(o_orderdate) // 1000 end as at
    from orders""")
def _(i):
    stamp = F.when(F.col("o_orderstatus") == "P", F.lit("never")).otherwise(
        F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss.SSSSSS"))
    df = i.orders.select(
        "o_orderkey", (F.col("o_custkey") % 7).cast("string").alias("linkUpCnt"),
        (F.col("o_orderkey") % 5).cast("string").alias("linkDownCnt"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("Up")).otherwise(F.lit("Down")).alias("state"),
        F.when(F.col("o_orderkey") % 2 == 0, stamp).otherwise(F.lit("")).alias("linkUpTimestamp"),
        F.when(F.col("o_orderkey") % 2 == 1, stamp).otherwise(F.lit("")).alias(
            "linkDownTimestamp"))
    return N.link_changes(df).select("o_orderkey", "numChanges", F.col(
        "statusChangeTimestamp").alias("at"))


@query("route_fixes", """
    select p_partkey, case p_partkey % 4 when 0 then '0.0.0.0/0' when 1 then '10.0.0.1/32'
             when 2 then '2001:db8::1/128' else '10.0.0.0/8' end as prefix,
           case when p_partkey % 4 = 2 then 6 else 4 end::bigint as ipvers,
           case when p_partkey % 3 = 0 then 'red' else 'default' end as vrf,
           case when p_partkey % 5 = 0 then 'blackhole' else 'eth0' end as oif,
           case when p_partkey % 6 = 0 then 20 else p_partkey % 6 end::bigint as metric
    from part""")
def _(i):
    k = F.col("p_partkey")
    routes = i.part.select(
        "p_partkey", F.lit("ns").alias("namespace"), F.lit("h").alias("hostname"),
        F.when(k % 4 == 0, F.lit("default")).when(k % 4 == 1, F.lit("10.0.0.1")).when(
            k % 4 == 2, F.lit("2001:db8::1")).otherwise(F.lit("10.0.0.0/8")).alias("prefix"),
        F.array(F.lit("10.9.9.9")).alias("nexthopIps"), F.array(F.lit("eth0")).alias("oifs"),
        F.lit("").alias("vrf"), (k % 3).cast("string").alias("vrf_id"), (k % 6).alias("metric"),
        F.when(k % 5 == 0, F.lit("blackhole")).otherwise(F.lit("")).alias("action"))
    ids = i.region.where("r_regionkey = 0").select(
        F.lit("ns").alias("namespace"), F.lit("h").alias("hostname"),
        F.lit("0").alias("table_id"), F.lit("red").alias("vrf"))
    return N.fix_routes(routes, ids).select(
        "p_partkey", "prefix", "ipvers", "vrf", F.get("oifs", F.lit(0)).alias("oif"), "metric")


@query("lldp_subtypes", """
    select p_partkey, case p_partkey % 3 when 0 then 'eth1' else '-' end as "peerIfname",
           case p_partkey % 3 when 2 then 7 else 0 end::bigint as "peerIfindex",
           case p_partkey % 3 when 1 then '44:38:39:00:00:01' else '00:00:00:00:00:00' end
           as "peerMacaddr",
           case p_partkey % 3 when 0 then 'interface name' when 1 then 'mac address'
             else 'locally assigned' end as subtype
    from part""")
def _(i):
    k = F.col("p_partkey") % 3
    df = i.part.select(
        "p_partkey", F.when(k == 0, F.lit("eth1")).when(k == 1, F.lit("4438.3900.0001")).otherwise(
            F.lit("7")).alias("peerIfname"),
        F.when(k == 0, F.lit("")).when(k == 1, F.lit("MAC address")).otherwise(
            F.lit("Locally Assigned")).alias("subtype"), F.lit("").alias("peerMacaddr"))
    return N.classify_lldp(df).select(
        "p_partkey", "peerIfname", "peerIfindex", "peerMacaddr", "subtype")


@query("lldp_and_cdp_merged", """
    with r as (select namespace, hostname, ifname, 'p' as peer, unnest([1, 2]) as pos,
                      unnest(['', case when timestamp % 2 = 0 then 'cdp' else '' end]) as d2,
                      unnest(['lldp', '']) as d1 from lldp)
    select namespace, hostname, ifname, max_by(d1, pos) filter (d1 <> '') as description,
           max_by(d2, pos) filter (d2 <> '') as platform
    from r group by 1, 2, 3""")
def _(i):
    def rows(pos, description, platform):
        return i.lldp.select(
            *KEYS, "ifname", F.lit("p").alias("peerHostname"), F.lit("q").alias("peerIfname"),
            F.lit(pos).alias("pos"), description.alias("description"),
            platform.alias("platform"))

    both = rows(1, F.lit("lldp"), F.lit("")).unionByName(rows(2, F.lit(""), F.when(
        F.col("timestamp") % 2 == 0, F.lit("cdp")).otherwise(F.lit(""))))
    return N.merge_lldp_cdp(both).select(*KEYS, "ifname", "description", "platform")


@query("arp_states", """
    select o_orderkey, case when o_custkey % 5 = 0 then 'failed' when o_orderstatus = 'F'
             then 'reachable' when o_orderstatus = 'O' then 'reachable' else 'permanent' end
           as state,
           o_orderstatus = 'O' as remote,
           case when o_custkey % 5 = 0 then '00:00:00:00:00:00' else '44:38:39:00:00:01' end
           as macaddr, 'Vlan10' as oif
    from orders""")
def _(i):
    status = F.col("o_orderstatus")
    df = i.orders.select(
        "o_orderkey", F.when(status == "F", F.lit("STALE")).when(
            status == "O", F.lit("extern_learn")).otherwise(F.lit("permanent")).alias("state"),
        F.lit("").alias("remote"),
        F.when(F.col("o_custkey") % 5 == 0, F.lit("Incomplete")).otherwise(
            F.lit("4438.3900.0001")).alias("macaddr"), F.lit("Vlan10, Po1").alias("oif"))
    return N.canonical_arp(df).select("o_orderkey", "state", "remote", "macaddr", "oif")


@query("vni_maps_to_rows", """
    select s_suppkey, unnest([13, 24])::bigint as vlan, unnest([10013, s_nationkey])::bigint as vni,
           unnest(['', case when s_nationkey = s_nationkey then 'red' end]) as vrf,
           unnest(['L2', 'L3']) as type, 'ingressBGP' as repl,
           unnest([1, 0])::int as vteps
    from supplier""")
def _(i):
    n = F.col("s_nationkey").cast("bigint")
    df = i.supplier.select(
        "s_suppkey", F.create_map(
            F.lit("13"), F.lit(10013).cast("bigint"), F.lit("24"), n).alias("_vlan2VniMap"),
        F.create_map(F.lit("red"), n).alias("_vrf2VniMap"),
        F.create_map(F.lit("13"), F.array(F.lit("10.0.0.1"))).alias("_vlan2VtepMap"),
        F.lit("headendVcs").alias("replicationType"), F.lit("").alias("mcastGroup"))
    return N.explode_vnis(df).select(
        "s_suppkey", "vlan", "vni", "vrf", "type", F.col("replicationType").alias("repl"),
        F.size("remoteVtepList").alias("vteps"))


@query("vni_peers_merged", """
    with p as (select namespace, hostname, timestamp % 10 as peer, vlan % 8 as lo
               from macs),
    a as (select namespace, hostname, concat('p', peer) as peer, unnest(range(lo, lo + 4)) as vni
          from p)
    select v.namespace, v.hostname, v.vni, string_agg(distinct a.peer, ',' order by a.peer) as peers
    from (select distinct namespace, hostname, unnest(range(0, 12))::bigint as vni from macs) v
    left join a on a.namespace = v.namespace and a.hostname = v.hostname and a.vni = v.vni
    group by 1, 2, 3 having string_agg(a.peer, '') is not null""")
def _(i):
    low = F.col("vlan") % 8
    peers = i.macs.select(
        *KEYS, F.concat(F.lit("p"), F.col("timestamp") % 10).alias("peer"),
        F.concat(low, F.lit("-"), low + 3).alias("_vniList"))
    vnis = i.macs.select(*KEYS, F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))).alias("vni")).distinct().withColumn(
        "remoteVtepList", F.array().cast("array<string>"))
    return N.merge_vni_peers(vnis, peers).where("size(remoteVtepList) > 0").select(
        *KEYS, "vni", F.array_join("remoteVtepList", ",").alias("peers"))


@query("inventory_slots", """
    select concat('h', s_suppkey) as hostname, 'port-1' as name, 'xcvr' as type,
           case when s_nationkey = 0 then 'absent' else 'present' end as status,
           lower(s_name) as vendor from supplier
    union all
    select concat('h', s_suppkey), 'linecard-3', 'linecard', 'present', 'Acme' from supplier""")
def _(i):
    df = i.supplier.select(
        F.lit("ns").alias("namespace"), F.concat(F.lit("h"), "s_suppkey").alias("hostname"),
        F.lit(1).alias("timestamp"),
        F.create_map(F.lit("1"), F.create_map(
            F.lit("modelName"), F.when(F.col("s_nationkey") == 0, F.lit("")).otherwise(
                F.lit("QSFP")), F.lit("mfgName"), F.col("s_name"))).alias("_xcvrSlots"),
        F.create_map(F.lit("Linecard3"), F.create_map(
            F.lit("modelName"), F.lit("X1"), F.lit("vendor"), F.lit("Acme"))).alias("_cardSlots"))
    return N.explode_inventory(df).select("hostname", "name", "type", "status", "vendor")


@query("ospf_neighbour_times", """
    select o_orderkey, 1700000000000 - (o_orderkey % 30) * 60000 as up,
           1700000000000 - (o_orderkey % 20) * 3600000 as down,
           greatest(1700000000000 - (o_orderkey % 30) * 60000,
                    1700000000000 - (o_orderkey % 20) * 3600000) as last,
           case when o_orderstatus = 'F' then 'disabled' else 'up' end as bfd
    from orders""")
def _(i):
    k = F.col("o_orderkey")
    df = i.orders.select(
        "o_orderkey", F.concat(k % 30, F.lit("m")).alias("lastUpTime"),
        F.concat(k % 20, F.lit("h0m")).alias("lastDownTime"),
        F.lit(1_700_000_000_000).alias("timestamp"), F.lit("Full").alias("state"),
        F.lit("").alias("areaStub"), F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(
            F.lit("Up")).alias("bfdStatus"))
    return N.ospf_neighbour_times(df).select(
        "o_orderkey", F.col("lastUpTime").alias("up"), F.col("lastDownTime").alias("down"),
        F.col("lastChangeTime").alias("last"), F.col("bfdStatus").alias("bfd"))


@query("ospf_unnumbered", """
    with lo as (select namespace, hostname, min(ipAddressList[1]) as a from ifs
                where ifname = 'swp0' group by 1, 2)
    select i.namespace, i.hostname, i.timestamp,
           case when i.type = 'ethernet' then coalesce(lo.a, '') else i.ipAddressList[1] end
           as "ipAddress", case when i.type = 'vlan' then 'p2p' else 'broadcast' end as kind
    from ifs i left join lo using (namespace, hostname)""")
def _(i):
    df = i.ifs.select(
        *KEYS, "timestamp", F.lit("").alias("vrf"),
        F.when(F.col("ifname") == "swp0", F.lit("lo")).otherwise(F.col("ifname")).alias("ifname"),
        F.get("ipAddressList", F.lit(0)).alias("ipAddress"),
        F.when(F.col("type") == "ethernet", F.lit("UNNUMBERED")).otherwise(F.lit("")).alias(
            "isUnnumbered"),
        F.when(F.col("type") == "vlan", F.lit("POINTOPOINT")).otherwise(
            F.lit("Broadcast")).alias("networkType"), F.lit("Passive").alias("passive"))
    return N.ospf_unnumbered(df).select(
        *KEYS, "timestamp", "ipAddress", F.col("networkType").alias("kind"))


@query("mlag_port_classes", """
    with z as (select l_orderkey, l_returnflag as f, l_linenumber, l_partkey, l_suppkey
               from lineitem)
    select l_orderkey, count(case when f = 'A' then 1 end) as dual,
           count(case when f = 'N' then 1 end) as single,
           count(case when f = 'R' then 1 end) as error
    from z group by 1""")
def _(i):
    flag = F.col("l_returnflag")
    df = i.lineitem.groupBy("l_orderkey").agg(
        F.collect_list(F.concat(F.lit("p"), "l_linenumber")).alias("_localInterfaceList"),
        F.collect_list(F.when(flag == "A", F.lit("active-full")).when(
            flag == "N", F.lit("active-partial")).otherwise(F.lit("disabled"))).alias(
            "_linkStateList"))
    return N.classify_mlag_ports(df).select(
        "l_orderkey", F.col("mlagDualPortsCnt").alias("dual"),
        F.col("mlagSinglePortsCnt").alias("single"), F.col("mlagErrorPortsCnt").alias("error"))


@query("bgp_families_to_rows", """
    select s_suppkey, 'Established' as state, unnest(['ipv4', 'l2vpn']) as afi,
           unnest(['unicast', 'evpn']) as safi, unnest([s_nationkey, 7])::bigint as "pfxRx",
           65536 * 3 + s_nationkey as asn
    from supplier where s_acctbal > 0
    union all
    select s_suppkey, 'NotEstd', '', '', 0, 65536 * 3 + s_nationkey from supplier
    where s_acctbal <= 0""")
def _(i):
    n = F.col("s_nationkey")
    df = i.supplier.select(
        "s_suppkey", F.when(F.col("s_acctbal") > 0, F.lit("Established")).otherwise(
            F.lit("Idle")).alias("state"),
        F.array(F.lit("IPv4"), F.lit("EVPN"), F.lit("IPv4")).alias("afi"),
        F.array(F.lit("Unicast"), F.lit(""), F.lit("SR-TE")).alias("safi"),
        F.array(n, F.lit(7), F.lit(0)).alias("pfxRx"),
        F.array(n, F.lit(7), F.lit(0)).alias("pfxTx"),
        F.concat(F.lit("3."), n).alias("asn"), F.lit("65000").alias("peerAsn"))
    got = N.explode_afi_safi(df)
    return got.select("s_suppkey", "state", "afi", "safi", "pfxRx",
                      F.col("asn").cast("int").alias("asn"))


@query("device_records_merged", """
    with r as (select o_custkey, o_orderkey, nullif(case when o_orderstatus = 'F' then ''
                      else o_orderstatus end, '') as model from orders)
    select concat('h', o_custkey) as hostname, max_by(model, o_orderkey) filter (model is not null)
           as model, 'Ubuntu' as vendor, '18.04' as version, 'alive' as status
    from r group by 1""")
def _(i):
    df = i.orders.select(
        F.lit("ns").alias("namespace"), F.concat(F.lit("h"), "o_custkey").alias("hostname"),
        F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "F", F.lit(
            "")).otherwise(F.col("o_orderstatus")).alias("model"),
        F.lit("Ubuntu 18.04 LTS").alias("os"), F.lit("").alias("vendor"),
        F.lit("").alias("version"))
    return N.merge_device_records(df).select("hostname", "model", "vendor", "version", "status")


# -- configurations ---------------------------------------------------------

@query("config_scrubbed", """
    select doc_id, array_to_string(list_filter(string_split(text, chr(10)),
           lambda x: not regexp_matches(x, 'Time|username|crypto|key-hash|encryption|ou')),
           chr(10)) as config
    from documents""")
def _(i):
    # 'ou' stands for a secret, so that lines of these texts are dropped.
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(
        x.contains("ou"), F.concat(x, F.lit(" username"))).otherwise(x)), "\n")
    return i.documents.select("doc_id", N.scrub_config(marked).alias("config"))


@query("config_sections", """
    with l as (select doc_id, unnest(string_split(text, chr(10))) as x,
                      generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
               from documents),
    h as (select doc_id, pos, x, max(case when pos % 3 = 0 then pos end) over (
            partition by doc_id order by pos) as head from l),
    k as (select doc_id, pos from l where pos % 3 = 0 and regexp_matches(x, '^[A-E]'))
    select h.doc_id, string_agg(case when h.pos % 3 = 0 then concat('L', x) else concat('  ', x)
           end, chr(10) order by h.pos) as config
    from h join k on k.doc_id = h.doc_id and k.pos = h.head group by 1""", headline=True)
def _(i):
    indented = F.array_join(F.transform(F.split("text", "\n"), lambda x, n: F.when(
        n % 3 == 0, F.concat(F.lit("L"), x)).otherwise(F.concat(F.lit("  "), x))), "\n")
    return config.config_sections(
        i.documents.select("doc_id", indented.alias("config")), "^L[A-E]")


@query("switchport_modes", """
    select namespace, hostname, concat('Ethernet', timestamp) as ifname,
           case when timestamp % 3 = 0 then 'trunk' else 'access' end as portmode,
           case when timestamp % 3 = 0 then 7 else vlan end::int as vlan
    from ifs where timestamp % 3 <> 2""")
def _(i):
    block = F.concat(
        F.lit("interface Ethernet"), F.col("timestamp"),
        F.when(F.col("timestamp") % 3 == 0, F.lit(
            "\n  switchport mode trunk\n  switchport trunk native vlan 7")).when(
            F.col("timestamp") % 3 == 1, F.concat(
                F.lit("\n  switchport access vlan "), F.col("vlan"))).otherwise(
            F.lit("\n  no switchport")), F.lit("\n!"))
    # At most eight interfaces make up the configuration of a host.
    configs = i.ifs.groupBy(*KEYS).agg(
        F.array_join(F.collect_list(block), "\n").alias("config"), F.lit("eos").alias("os"))
    return config.switchport_modes(configs)


# -- pseudonyms -------------------------------------------------------------

@query("pseudonyms_keep_prefixes", """
    select o_orderkey, true as kept from orders
    where o_orderkey < (select max(o_orderkey) from orders)""")
def _(i):
    new = i.addresses.select("o_orderkey", "num", P.anon_ipv4("address", "s").alias("a"))
    from netstate.functions import ip

    new = new.withColumn("n", ip.ipv4_num("a"))
    nxt = new.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("num").alias("num2"),
                     F.col("n").alias("n2"))

    def shared(a, b):
        return F.length(F.bin(F.col(a).bitwiseXOR(F.col(b))))

    return new.join(nxt, "o_orderkey").select(
        "o_orderkey", (shared("num", "num2") == shared("n", "n2")).alias("kept"))


@query("pseudonym_mapping", """
    select 'host' as kind, count(distinct hostname) as n from ifs
    union all select 'mac', count(distinct macaddr) from ifs""")
def _(i):
    got = P.mapping(i.ifs, {"hostname": "host", "macaddr": "mac"}, "s")
    return got.groupBy("kind").agg(F.countDistinct("replacement").alias("n"))


@query("pseudonymised_columns")
def _(i):
    return P.pseudonymize(
        i.ifs.select(*KEYS, "ifname", "macaddr", "ipAddressList"),
        {"hostname": "host", "macaddr": "mac", "ipAddressList": "ip"}, "s")


@query("pseudonymised_columns_alike", r"""
    select namespace, count(*) as n, count(distinct hostname) as hosts,
           count(distinct macaddr) as macs, count(distinct ipAddressList[1]) as addresses,
           count(distinct regexp_extract(ipAddressList[1], '^[0-9]+[.][0-9]+[.]')) as sixteens,
           sum(cast(string_split(ipAddressList[1], '/')[2] as bigint)) as lengths
    from ifs group by 1""")
def _(i):
    """What is equal stays equal, also the first sixteen bits; lengths stay."""
    got = P.pseudonymize(
        i.ifs.select(*KEYS, "macaddr", "ipAddressList"),
        {"hostname": "host", "macaddr": "mac", "ipAddressList": "ip"}, "s")
    first = F.get("ipAddressList", F.lit(0))
    return got.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("hostname").alias("hosts"),
        F.countDistinct("macaddr").alias("macs"), F.countDistinct(first).alias("addresses"),
        F.countDistinct(F.regexp_extract(first, r"^[0-9]+[.][0-9]+[.]", 0)).alias("sixteens"),
        F.sum(F.substring_index(first, "/", -1).cast("bigint")).alias("lengths"))


@query("pseudonymised_texts", """
    select doc_id, cast(len(regexp_extract_all(text,
           '(?:^|[^0-9.])((?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){3}'
           || '(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))(?:[^0-9.]|$)')) as int) as addresses
    from documents""")
def _(i):
    got = P.pseudonymize_text(i.documents.select("doc_id", "text"), "text", "s")
    found = F.regexp_extract_all("text", F.lit(
        r"(?:^|[^0-9.])((?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}"
        r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))(?:[^0-9.]|$)"), 0)
    return got.select("doc_id", F.size(found).alias("addresses"))
