"""Queries over tables written to the shared folder, and through the user's object."""

import uuid

from pyspark.sql import functions as F

from checks.joins_checks import LINKS
from checks.registry import query
from netstate.functions import ip, register_sql_functions, text
from netstate.operators import asserts, summary as S
from netstate.plans import NetState, summaries
from netstate.session import ensure_checkpoint_dir
from netstate.sources import migrate, read, write
from netstate.streaming import cdc, compact, stateful, stream

KEYS = ["namespace", "hostname"]
IF_KEYS = [*KEYS, "ifname"]
LOG = [*IF_KEYS, "state", "numChanges", "timestamp", "active"]
SHOWN = [*IF_KEYS, "state", "numChanges", "timestamp"]
MID = 1_705_276_800_000
FAR = 4_000_000_000_000


def _root(i, name: str) -> str:
    return f"{ensure_checkpoint_dir(i.spark)}/{name}-{uuid.uuid4().hex}"


def _two_runs(i, keep: bool = False) -> str:
    """A store compacted twice; a tenth of the old rows comes between the runs."""
    root = _root(i, "store")
    old = F.col("timestamp") < MID
    write.write_raw(i.slog.where(old & ~F.col("late")).select(*LOG), root, "interfaces")
    compact.compact_table(i.spark, root, "interfaces", "1d", MID, not keep)
    write.write_raw(i.slog.where(~old | F.col("late")).select(*LOG), root, "interfaces")
    compact.compact_table(i.spark, root, "interfaces", "1d", FAR, not keep)
    return root


def _latest(where: str = "true") -> str:
    return f"""
    select namespace, hostname, ifname, state, "numChanges", timestamp from (
      select *, row_number() over (partition by namespace, hostname, ifname
                                   order by timestamp desc) rn
      from slog where {where}) t where rn = 1 and active"""


@query("stored_log", """
    select namespace, hostname, ifname, state, "numChanges", timestamp, active from slog""")
def _(i):
    root = _root(i, "log")
    write.write_raw(i.slog.select(*LOG), root, "interfaces")
    return read.read_log(i.spark, root, "interfaces", view="all").select(*LOG)


@query("stored_latest_with_late_rows", _latest(), headline=True)
def _(i):
    net = NetState(i.spark, _two_runs(i), period="1d")
    return net.get("interfaces", [*SHOWN], type=["all"]).select(*SHOWN)


@query("stored_latest_without_removal", _latest())
def _(i):
    net = NetState(i.spark, _two_runs(i, keep=True), period="1d")
    return net.get("interfaces", [*SHOWN], type=["all"]).select(*SHOWN)


@query("stored_as_of_with_late_rows", _latest(f"timestamp <= {MID}"))
def _(i):
    return read.read_table(i.spark, _two_runs(i), "interfaces", end=MID, period="1d").select(
        *SHOWN)


@query("stored_history_with_late_rows", """
    select namespace, hostname, ifname, state, "numChanges", timestamp, active from slog""")
def _(i):
    return read.read_table(i.spark, _two_runs(i), "interfaces", view="all", period="1d",
                           only_active=False).select(*LOG)


@query("stored_window_of_some_hosts", f"""
    select namespace, hostname, ifname, state, "numChanges", timestamp, active from slog
    where namespace = 'ns1' and (hostname = 'h1' or hostname = 'h6')
      and timestamp between {MID} and {MID + 5 * 86_400_000}""")
def _(i):
    return read.read_table(
        i.spark, _two_runs(i), "interfaces", start=MID, end=MID + 5 * 86_400_000, period="1d",
        namespace=["ns1"], hostname=["h1", "h6"]).select(*LOG)


@query("stored_last_blocks_alone", _latest())
def _(i):
    """The newest block of each namespace, without any raw row."""
    root = _two_runs(i)
    return compact.compaction_state(i.spark, root, "interfaces").where("active").select(*SHOWN)


@query("compaction_statistics", """
    select 'sqPoller' as service, '1d' as period, count(*) as "recCount" from polls
    where timestamp - timestamp % 86400000 + 86400000 <= (select max(timestamp) from polls)""")
def _(i):
    root = _root(i, "polls")
    rows = i.polls.select(*KEYS, "service", "status", "timestamp", "active")
    write.write_raw(rows, root, "sqPoller")
    now = i.polls.agg(F.max("timestamp")).first()[0]
    compact.compact_all(i.spark, root, "1d", now)
    return read.read_table(i.spark, root, "sqCoalescer", view="all").select(
        "service", "period", F.col("recCount").cast("bigint").alias("recCount"))


OLD_MACS = [*KEYS, "mackey", "macaddr", "vlan", "origIfname", "timestamp", "active", "sqvers"]


@query("stored_versions_migrated", """
    select namespace, hostname, mackey, macaddr, oif, timestamp, '2.0' as sqvers from macs""")
def _(i):
    """Half of the rows are stored in an old version; the migration is run twice."""
    root = _root(i, "macs")
    old = i.macs.where("vlan % 2 = 0").withColumnRenamed("oif", "origIfname").withColumn(
        "sqvers", F.lit("1.0")).select(*OLD_MACS)
    path = read.table_path(root, "macs")
    old.write.partitionBy("sqvers", *KEYS).parquet(path)
    write.write_raw(i.macs.where("vlan % 2 != 0"), root, "macs")
    migrate.migrate_table(i.spark, root, "macs")
    migrate.migrate_table(i.spark, root, "macs")
    now = read.read_versions(i.spark, path, "macs", only="2.0")
    return read.with_sqvers(now, read.versions(i.spark, path)).select(
        *KEYS, "mackey", "macaddr", "oif", "timestamp", "sqvers")


@query("stored_versions_read_together", """
    select namespace, hostname, mackey, macaddr, oif, timestamp from macs
    where timestamp <> 0""")
def _(i):
    root = _root(i, "macs")
    old = i.macs.where("vlan % 2 = 0").withColumnRenamed("oif", "origIfname").withColumn(
        "sqvers", F.lit("1.0")).select(*OLD_MACS)
    old.write.partitionBy("sqvers", *KEYS).parquet(read.table_path(root, "macs"))
    write.write_raw(i.macs.where("vlan % 2 != 0"), root, "macs")
    return read.read_table(i.spark, root, "macs", view="all").select(
        *KEYS, "mackey", "macaddr", "oif", "timestamp")


@query("legacy_names", """
    select namespace, hostname, oif, '2.0' as sqvers from macs""")
def _(i):
    old = i.macs.withColumnRenamed("oif", "origIfname")
    return migrate.migrate(old, "macs", "1.0").select(*KEYS, "oif", "sqvers")


@query("exported_json", "select namespace, hostname, ifname, mtu, vlan from ifs")
def _(i):
    path = _root(i, "json")
    write.export(i.ifs.select(*IF_KEYS, "mtu", "vlan"), path)
    return i.spark.read.schema(
        "namespace string, hostname string, ifname string, mtu bigint, vlan int").json(path)


@query("exported_csv", """
    select namespace, hostname, ifname,
           concat('["', array_to_string(ipAddressList, '","'), '"]') as addresses from ifs""")
def _(i):
    path = _root(i, "csv")
    write.export(i.ifs.select(*IF_KEYS, F.col("ipAddressList").alias("addresses")), path, "csv")
    return i.spark.read.option("header", True).option("escape", "\\").csv(path)


@query("unreadable_files", "select 'bad.parquet' as file")
def _(i):
    root = _root(i, "audit")
    write.write_raw(i.slog.select(*LOG), root, "interfaces")
    path = i.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/interfaces/bad.parquet")
    out = path.getFileSystem(i.spark._jsc.hadoopConfiguration()).create(path)
    out.writeBytes("no parquet")
    out.close()
    found = read.audit_parquet(i.spark, root)
    return found.select(F.substring_index("path", "/", -1).alias("file"))


# -- through the user's object ----------------------------------------------

def _net(i, **tables) -> NetState:
    return NetState(i.spark, frames=tables)


def _interfaces(i):
    """The interfaces with all stored columns."""
    return write.conform_for_write(i.ifs, "interfaces")


@query("shown_columns", """
    select true as active, hostname, ifname, mtu from ifs where timestamp <> 0""")
def _(i):
    return _net(i, interfaces=_interfaces(i)).get(
        "interfaces", ["hostname", "ifname", "mtu"], view="all", type=["all"])


@query("default_columns", """
    select namespace, hostname, mackey, macaddr, vlan, oif from macs where vlan > 10""")
def _(i):
    macs = write.conform_for_write(i.macs, "macs")
    got = _net(i, macs=macs).get("macs", ["*"], query_str="moveCount = 0 and vlan > 10")
    whole = _net(i, macs=macs).get("macs", [*KEYS, "mackey", "macaddr", "vlan", "oif"],
                                   query_str="moveCount = 0 and vlan > 10")
    return whole.join(got.select(*KEYS, "macaddr", "vlan").distinct(),
                      [*KEYS, "macaddr", "vlan"], "left_semi")


@query("latest_move_counts", """
    with m as (
      select *, lag(state) over (partition by namespace, hostname order by timestamp) as before
      from hotlog),
    c as (select namespace, hostname, max(timestamp) as timestamp,
                 cast(sum(case when before is not null and before <> state then 1 else 0 end)
                      as bigint) as "moveCount" from m group by 1, 2)
    select namespace, hostname, timestamp, "moveCount" from c""")
def _(i):
    macs = i.hotlog.select(
        *KEYS, F.lit("k").alias("mackey"), F.lit("m").alias("macaddr"), "timestamp",
        F.col("state").alias("oif"), F.lit("").alias("remoteVtepIp"), F.lit(True).alias("active"))
    net = _net(i, macs=write.conform_for_write(macs, "macs"))
    return net.get("macs", ["namespace", "hostname", "timestamp", "moveCount"]).select(
        *KEYS, "timestamp", F.col("moveCount").cast("bigint").alias("moveCount"))


@query("unique_vrfs_of_addresses", """
    select case when master = 'bridge' then '' when master = '' then 'default' else master end
           as vrf, count(*) as n
    from ifs where timestamp <> 0 group by 1""")
def _(i):
    got = _net(i, interfaces=_interfaces(i)).get("address", ["namespace", "vrf"])
    return got.groupBy("vrf").agg(F.count(F.lit(1)).alias("n"))


@query("unique_addresses", """
    select a as "ipAddressList", count(*) as "numRows"
    from (select unnest(ipAddressList) as a from ifs where timestamp <> 0) group by 1""")
def _(i):
    net = _net(i, interfaces=_interfaces(i))
    return net.unique("address", "ipAddress", count=True, ipvers="v4")


@query("interfaces_sheet", """
    with a as (select namespace, count(distinct x) as n from (
                 select namespace, unnest(ipAddressList) as x from ifs) group by 1),
    b as (select namespace, count(distinct x) as n from (
            select namespace, unnest(ip6AddressList) as x from ifs) where x not like 'fe80:%'
          group by 1),
    d as (select namespace, hostname, count(*) as n from ifs group by 1, 2)
    select i.namespace, count(distinct hostname) as "deviceCnt", count(*) as "interfaceCnt",
           count(distinct case when master = 'bridge' then hostname end)
             as "devicesWithL2Cnt",
           count(case when state <> 'up' and "adminState" = 'up' then 1 end) as "ifDownCnt",
           count(case when "adminState" <> 'up' then 1 end) as "ifAdminDownCnt",
           min(a.n) as v4, coalesce(min(b.n), 0) as v6,
           cast(min("numChanges") as double) as c_lo, cast(max("numChanges") as double) as c_hi,
           cast(median("numChanges") as double) as c_mid,
           (select cast(median(n) as double) from d where d.namespace = i.namespace) as per_host
    from ifs i join a using (namespace) left join b using (namespace) group by 1""")
def _(i):
    got = summaries.interfaces(_interfaces(i))
    return got.select(
        "namespace", "deviceCnt", "interfaceCnt", "devicesWithL2Cnt", "ifDownCnt",
        "ifAdminDownCnt", F.col("uniqueIPv4AddrCnt").alias("v4"),
        F.col("uniqueIPv6AddrCnt").alias("v6"),
        *[F.get("ifChangesStat", F.lit(n)).alias(c) for n, c in enumerate(
            ("c_lo", "c_hi", "c_mid"))],
        F.get("ifPerDeviceStat", F.lit(2)).alias("per_host"))


@query("address_sheet", """
    with x as (select namespace, unnest(ipAddressList) as a from ifs where timestamp <> 0),
    y as (select namespace, unnest(ip6AddressList) as a from ifs where timestamp <> 0)
    select i.namespace, count(distinct hostname) as "deviceCnt", count(*) as "addressCnt",
           count(distinct macaddr) as "uniqueIfMacCnt",
           (select count(distinct a) from x where x.namespace = i.namespace) as v4,
           (select count(distinct a) from y where y.namespace = i.namespace
            and a not like 'fe80%') as v6,
           count(distinct hostname) as "deviceWithv4AddressCnt",
           count(distinct case when len(list_filter(ip6AddressList,
             lambda z: z not like 'fe80%')) > 0 then hostname end) as "deviceWithv6AddressCnt"
    from ifs i where timestamp <> 0 group by 1""")
def _(i):
    got = _net(i, interfaces=_interfaces(i)).summarize("address")
    return got.select(
        "namespace", "deviceCnt", "addressCnt", "uniqueIfMacCnt",
        F.col("uniqueV4AddressCnt").alias("v4"), F.col("uniqueV6AddressCnt").alias("v6"),
        "deviceWithv4AddressCnt", "deviceWithv6AddressCnt")


_MLAG = """select namespace, hostname, vni as systemId,
           case when state = 'up' then 'active' else 'inactive' end as state,
           vlan % 2 = 0 as backupActive, cast(vlan as bigint) as mlagDualPortsCnt,
           cast(vni as bigint) as mlagSinglePortsCnt, cast(numMacs as bigint) as mlagErrorPortsCnt
    from vnis"""


@query("mlag_sheet", f"""
    with m as ({_MLAG})
    select namespace, count(distinct hostname) as "deviceCnt",
           count(distinct systemId) as "uniqueSystemIdCnt",
           count(case when state <> 'active' then 1 end) as "devicesWithfailedStateCnt",
           count(case when state = 'active' and not backupActive then 1 end)
             as "devicesWithBackupInactiveCnt",
           cast(min(case when state = 'active' then mlagDualPortsCnt end) as double) as lo,
           cast(max(case when state = 'active' then mlagSinglePortsCnt end) as double) as hi,
           cast(median(case when state = 'active' then mlagDualPortsCnt end) as double) as mid
    from m group by 1""")
def _(i):
    got = summaries.mlag(i.sql(_MLAG))
    return got.select(
        "namespace", "deviceCnt", "uniqueSystemIdCnt", "devicesWithfailedStateCnt",
        "devicesWithBackupInactiveCnt",
        F.get("mlagNumDualPortsStat", F.lit(0)).alias("lo"),
        F.get("mlagNumSinglePortStat", F.lit(1)).alias("hi"),
        F.get("mlagNumDualPortsStat", F.lit(2)).alias("mid"))


@query("device_sheet", """
    select namespace, count(distinct hostname) as "deviceCnt",
           count(distinct case when hostname like '%7' then hostname end) as "downDeviceCnt",
           count(distinct vendor) as vendors, count(distinct model) as models,
           cast(max(timestamp) as double) as up
    from devices group by 1""")
def _(i):
    df = i.devices.withColumn("uptime", F.col("timestamp")).withColumn("status", F.when(
        F.col("hostname").endswith("7"), F.lit("dead")).otherwise(F.lit("alive")))
    got = summaries.device(df)

    def kinds(c):
        m = F.col(c)
        return F.size(F.map_keys(m)).cast("bigint")

    return got.select("namespace", "deviceCnt", "downDeviceCnt", kinds("vendorCnt").alias(
        "vendors"), kinds("modelCnt").alias("models"), F.get("upTimeStat", F.lit(1)).alias("up"))


@query("generic_sheet", """
    select concat('ns', o_custkey % 3) as namespace,
           count(distinct concat('h', o_custkey % 40)) as "deviceCnt" from orders group by 1""")
def _(i):
    rows = i.orders.select(
        F.concat(F.lit("ns"), F.col("o_custkey") % 3).alias("namespace"),
        F.concat(F.lit("h"), F.col("o_custkey") % 40).alias("hostname"),
        F.concat(F.lit("swp"), F.col("o_orderkey")).alias("ifname"),
        F.col("o_orderkey").alias("txBytes"), F.col("o_orderkey").alias("timestamp"))
    net = _net(i, ifCounters=write.conform_for_write(rows, "ifCounters"))
    return net.summarize("ifCounters", view="all").select("namespace", "deviceCnt")


@query("sheet_with_a_chosen_aggregate", """
    select namespace, bit_xor(case when state = 'up' then mtu end) as "xorMtu",
           count(*) as "interfaceCnt" from ifs group by 1""")
def _(i):
    return S.summarize(i.ifs, [
        S.Stat("xorMtu", "mtu", "bit_xor", "state = 'up'"), S.Stat("interfaceCnt", "ifname")],
        check="interfaceCnt")


@query("covered_by_default_routes", """
    with v as (select namespace, vrf,
                      count(distinct case when prefix = '0.0.0.0/0' then hostname end)
                        = count(distinct hostname) as c from routes group by 1, 2)
    select namespace, bool_and(c) as "deviceWithNoDefRoute" from v group by 1""")
def _(i):
    return S.default_route_coverage(i.routes)


@query("default_routes_of_both_families", """
    with r as (select namespace, vrf, hostname, prefix from routes
               union all
               select namespace, vrf, hostname,
                      case when metric % 3 = 0 then '::/0' else '2001:db8::/32' end
               from routes where metric % 2 = 0),
    h as (select namespace, vrf, hostname,
                 bool_or(prefix = '0.0.0.0/0') or not bool_or(prefix not like '%:%') as four,
                 bool_or(prefix = '::/0') or not bool_or(prefix like '%:%') as six
          from r group by 1, 2, 3)
    select namespace, vrf, count(case when four and six then 1 end) as "devicesWithDefault",
           count(*) as devices, bool_and(four and six) as covered
    from h group by 1, 2""")
def _(i):
    six = i.routes.where("metric % 2 = 0").withColumn("prefix", F.when(
        F.col("metric") % 3 == 0, F.lit("::/0")).otherwise(F.lit("2001:db8::/32")))
    return S.per_vrf_route_coverage(i.routes.unionByName(six))


@query("config_lines_in_sql", """
    with l as (select doc_id, unnest(string_split(text, chr(10))) as x,
                      generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
               from documents),
    h as (select doc_id, pos, x, max(case when pos % 3 = 0 then pos end) over (
            partition by doc_id order by pos) as head from l),
    k as (select doc_id, pos, row_number() over (partition by doc_id order by pos) as n
          from l where pos % 3 = 0 and regexp_matches(x, '^[A-E]'))
    select h.doc_id::varchar as device, h.pos::bigint as place, k.n::int as section,
           case when h.pos % 3 = 0 then concat('L', x) else concat('  ', x) end as line
    from h join k on k.doc_id = h.doc_id and k.pos = h.head
    where trim(x) <> '' or h.pos % 3 = 0""")
def _(i):
    """Lines of matching sections by a table function, one configuration per partition."""
    register_sql_functions(i.spark)
    lines = i.documents.select(
        F.col("doc_id").cast("string").alias("device"),
        F.posexplode(F.split("text", "\n")).alias("place", "x"))
    lines.select("device", F.col("place").cast("bigint").alias("place"), F.when(
        F.col("place") % 3 == 0, F.concat(F.lit("L"), "x")).otherwise(
        F.concat(F.lit("  "), "x")).alias("line")).createOrReplaceTempView("lines_of_documents")
    return i.spark.sql("""
        select device, place, section, line from section_lines(
          '^L[A-E]', TABLE(lines_of_documents) PARTITION BY device ORDER BY place)
        where trim(line) <> ''""")


@query("interfaces_without_neighbours", """
    select 'No LLDP peering info' as reason, 'fail' as result, count(*) > 0 as checked
    from ifs where state = 'up'
    union all select 'No data', 'fail', false""")
def _(i):
    """One failing row says that there is nothing to compare with, or nothing to check."""
    ifs = i.ifs.withColumns({"portmode": F.lit("routed"),
                             "vlanList": F.array().cast("array<bigint>")})
    unnamed = i.lldp.withColumn("peerIfname", F.lit("-"))
    unnamed = asserts.assert_interfaces(ifs, unnamed).withColumn("checked", F.lit(True))
    nothing = asserts.assert_interfaces(ifs.where("state = 'nowhere'"), i.lldp)
    return unnamed.unionByName(nothing.withColumn("checked", F.lit(False))).select(
        F.get("assertReason", F.lit(0)).alias("reason"), "result", "checked")


_RESULTS = LINKS + """
    , r as (select namespace, hostname, ifname, list_filter([
        case when "adminState" = 'down' or ("adminState" = 'up' and state = 'up') then null
             else 'Interface Down' end,
        case when qif is null and not skip then case when coalesce(ph, '') <> '' and not known
             then 'Unpolled Peer' else 'No Peer Found' end end,
        case when qif is not null and not skip and mtu <> qmtu then 'MTU mismatch' end,
        case when qif is not null and not skip and speed <> qspeed then 'Speed mismatch' end],
        lambda x: x is not null) as rs from j)"""


@query("missing_peers_ignored", f"""
    with {_RESULTS}
    select namespace, hostname, ifname, rs[1] as first,
           len(rs) > 0 and rs[1] in ('Interface Down', 'Unpolled Peer', 'MTU mismatch',
                                     'Speed mismatch') as must_fail
    from r where len(rs) > 0""")
def _(i):
    ifs = i.ifs.withColumns({"portmode": F.lit("routed"),
                             "vlanList": F.array().cast("array<bigint>")})
    got = asserts.assert_interfaces(ifs, i.lldp, ignore_missing_peer=True)
    known = ["Interface Down", "Unpolled Peer", "MTU mismatch", "Speed mismatch"]
    first = F.get("assertReason", F.lit(0))
    return got.where(first.isin(*known, "No Peer Found")).select(
        *IF_KEYS, first.alias("first"), (F.col("result") == "fail").alias("must_fail"))


@query("failed_polls_held_back", """
    with p as (select *, row_number() over (partition by namespace, hostname, service
                      order by timestamp) as n from polls),
    q as (select *, max(case when status in (0, 200) or n = 1 then n end) over (
            partition by namespace, hostname, service order by timestamp) as ok,
            row_number() over (partition by namespace, hostname, service
                               order by timestamp desc) as rn from p),
    l as (select namespace, hostname, service, timestamp, status,
                 n = 1 or not (n - ok between 1 and 2) as commit from q
          where rn = 1 and service = 'bgp')
    select namespace, hostname, false as active, timestamp from l
    where commit and status not in (0, 200)""")
def _(i):
    """Every host had one row; the last poll of some failed, for the third time of a few."""
    root = _root(i, "held")
    polls = cdc.failure_streaks(i.polls.where("service = 'bgp'"))
    last = polls.groupBy(*KEYS).agg(
        F.max_by(F.struct("timestamp", "status", "commit"), "timestamp").alias("l")).select(
        *KEYS, "l.*")
    rows = last.select(*KEYS, F.lit("vlan1").alias("vlanName"), F.lit(1).alias("timestamp"))
    write.write_raw(rows, root, "vlan")
    good = last.where("status in (0, 200)").select(
        *KEYS, F.lit("vlan1").alias("vlanName"), "timestamp")
    found = cdc.store_changes(i.spark, root, "vlan", good, polled=last)
    return found.select(*KEYS, "active").join(last.select(*KEYS, "timestamp"), KEYS)


@query("streamed_failure_streaks", """
    with p as (select *, row_number() over (partition by namespace, hostname, service
                      order by timestamp) as n from polls),
    q as (select *, max(case when status in (0, 200) or n = 1 then n end) over (
            partition by namespace, hostname, service order by timestamp) as ok from p)
    select namespace, hostname, service, timestamp, n - ok as streak,
           n = 1 or not (n - ok between 1 and 2) as commit
    from q""")
def _(i):
    path = _root(i, "polls")
    i.polls.select(*KEYS, "service", "timestamp", "status").write.parquet(path)
    source = i.spark.readStream.schema(
        "namespace string, hostname string, service string, timestamp bigint, status bigint"
    ).parquet(path)
    out, mark = _root(i, "streaks"), _root(i, "mark")
    stream.hysteresis_stream(source).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.parquet(out).select(*KEYS, "service", "timestamp", "streak", "commit")


@query("streamed_changes", """
    with p as (select *, row_number() over (partition by namespace, hostname
                      order by timestamp) as n from vlan_polls),
    q as (select *, max(case when status = 0 or n = 1 then n end) over (
            partition by namespace, hostname order by timestamp) as ok from p),
    c as (select * from q where not (n - ok between 1 and 2)),
    e as (select namespace, hostname, timestamp, v as vlan,
                 case when status = 0 and (event_id + v) % 5 < 3
                      then case when (event_id // 7 + v) % 3 = 0 then 'suspend' else 'active' end
                      end as state
          from c, range(1, 7) t(v)
          union all
          select distinct namespace, hostname, cast(0 as bigint), v,
                 case when v < 4 then 'active' end
          from vlan_polls, range(1, 7) t(v) where user_id % 2 = 0),
    d as (select *, lag(state) over (partition by namespace, hostname, vlan
                                     order by timestamp) as before from e)
    select namespace, hostname, timestamp, vlan, state is not null as active,
           coalesce(state, before) as state
    from d where timestamp > 0 and state is distinct from before""")
def _(i):
    """All polls of all hosts in one micro-batch, from a stored state of every second host."""
    path, out, mark = _root(i, "polls"), _root(i, "changes"), _root(i, "mark")
    entry = F.filter(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda v: F.struct(
        v.cast("bigint").alias("vlan"), F.when((F.expr("event_id div 7") + v) % 3 == 0, F.lit(
            "suspend")).otherwise(F.lit("active")).alias("state"),
        (F.col("event_id") + v).alias("statusChangeTimestamp"))),
        lambda e: (F.col("event_id") + e["vlan"]) % 5 < 3)
    polls = i.vlan_polls.select(*KEYS, "timestamp", "status", F.when(
        F.col("status") == 0, entry).alias("entries"))
    polls.write.parquet(path)
    held = i.vlan_polls.where("user_id % 2 = 0").select(*KEYS).distinct().select(
        *KEYS, F.explode(F.expr("sequence(1L, 3L)")).alias("vlan"),
        F.lit("active").alias("state"), F.lit(0).cast("bigint").alias("statusChangeTimestamp"))
    source = i.spark.readStream.schema(polls.schema).parquet(path)
    changes = stateful.captured_changes(
        source, ["vlan"], ignore=["statusChangeTimestamp"], before=held)
    changes.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.parquet(out).select(
        *KEYS, "timestamp", "vlan", "active", "state")


# -- functions --------------------------------------------------------------

@query("text_validators", r"""
    select s_suppkey, s_suppkey % 4 <> 3 as mac, s_suppkey % 3 = 0 as prefix
    from supplier""")
def _(i):
    k = F.col("s_suppkey")
    tail = F.lpad((k % 100).cast("string"), 2, "0")
    mac = F.when(k % 4 == 0, F.concat(F.lit("44:38:39:00:00:"), tail)).when(
        k % 4 == 1, F.concat(F.lit("4438.3900.00"), tail)).when(
        k % 4 == 2, F.concat(F.lit("44-38-39-00-00-"), tail)).otherwise(
        F.concat(F.lit("44:38:39:zz:00:"), tail))
    prefix = F.when(k % 3 == 0, F.concat(F.lit("10."), k % 250, F.lit(".0.0/16"))).when(
        k % 3 == 1, F.concat(F.lit("10."), k % 250, F.lit(".0.1/16"))).otherwise(F.lit("x/16"))
    return i.supplier.withColumns({"m": mac, "p": prefix}).select(
        "s_suppkey", text.is_mac("m").alias("mac"), ip.is_prefix("p").alias("prefix"))


@query("range_rows_in_sql", """
    select s_suppkey, unnest(generate_series(s_suppkey % 5, s_suppkey % 5 + s_nationkey)) as n
    from supplier""")
def _(i):
    register_sql_functions(i.spark)
    i.supplier.selectExpr(
        "s_suppkey", "concat(s_suppkey % 5, '-', s_suppkey % 5 + s_nationkey) as r"
    ).createOrReplaceTempView("range_texts_of_suppliers")
    return i.spark.sql(
        "select s_suppkey, n from range_texts_of_suppliers, lateral range_rows(r)")


@query("predicates_of_both_families", """
    select namespace, hostname, ifname from ifs
    where timestamp <> 0 and (
      len(list_filter(ip6AddressList, lambda x: x like '2001:db8:%')) > 0
      or len(list_filter(ipAddressList, lambda x: x like '172.16.%')) > 0
      or len(list_filter(ipAddressList, lambda x: x = '192.168.0.1/24')) > 0)""")
def _(i):
    net = _net(i, interfaces=_interfaces(i))
    return net.get("interfaces", IF_KEYS, type=["all"], query_str=(
        "any_in_subnet(ip6AddressList, '2001:db8::/32') or "
        "any_in_subnet(ipAddressList, '172.16.0.0/16') or "
        "any_in_subnet(ipAddressList, '192.168.0.1')")).select(*IF_KEYS)


@query("equal_records_keep_their_number", """
    select l_returnflag as devtype, case when l_returnflag = 'A' then 'a'
           when l_returnflag = 'N' then 'n' end as normalizer, count(*) as n
    from lineitem where l_returnflag <> 'R' group by 1, 2""")
def _(i):
    from netstate.operators.normalize import pick_normalizer

    records = i.lineitem.select(
        F.lit("h").alias("hostname"), F.col("l_returnflag").alias("devtype"),
        F.lit("1.0").alias("version"), F.lit("same").alias("data"))
    rules = i.spark.createDataFrame(
        [(None, "A", "", None, "a"), (None, "N", ">=0.5", None, "n")],
        "hostname string, devtype string, version string, copy string, normalizer string")
    return pick_normalizer(records, rules).groupBy("devtype", "normalizer").agg(
        F.count(F.lit(1)).alias("n"))


_NULLS = """select case when event_id % 3 = 0 then null else concat('h', user_id % 7) end as k,
           @ms(ts) as timestamp, event_id,
           case when event_id % 4 = 0 or user_id % 7 = 2 then null else event_id end as v
    from events"""


@query("ordered_with_nulls", f"""
    with e as ({_NULLS})
    select event_id, k, cast(sum(v) over w as bigint) as total, lag(v) over (
             partition by k order by timestamp) as before,
           last_value(v ignore nulls) over w as filled
    from e window w as (partition by k order by timestamp
                        rows between unbounded preceding and current row)""")
def _(i):
    """Null keys and leading nulls, every key cut into chunks."""
    from netstate.operators import ordered

    df = i.sql(_NULLS)
    df = ordered.running_sum(df, ["k"], "timestamp", F.col("v"), "total", hot_rows=0)
    df = ordered.previous_value(df, ["k"], "timestamp", {"before": F.col("v")}, hot_rows=0)
    df = ordered.fill_forward(df, ["k"], "timestamp", {"filled": F.col("v")}, hot_rows=0)
    return df.select("event_id", "k", "total", "before", "filled")
