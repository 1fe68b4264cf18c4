import pytest
from pyspark.sql import functions as F

from netstate.operators import path as paths
from netstate.operators.filters import FilterError
from netstate.operators.verbs import VerbError
from netstate.catalog import UnknownColumnError, table_names
from netstate.session import cut_lineage
from tests.conftest import rows
from tests.fixture_network import LEAVES, T0


def test_every_stored_table_can_be_shown_and_summarised(net):
    for table in ("device", "interfaces", "routes", "arpnd", "macs", "vlan", "lldp", "mlag",
                  "bgp", "ospf", "evpnVni", "inventory", "devconfig", "fs", "sqPoller",
                  "address"):
        assert set(net.get(table).columns) <= set(net.get(table, ["*"]).columns), table
        assert net.summarize(table).count() == 1, table


def test_catalog_is_complete():
    assert len(table_names()) == 28


def test_latest_as_of_changes(net):
    one = dict(hostname="spine01", ifname="swp99", columns=["ifname", "state"])
    assert net.get("interfaces", **one).count() == 0
    assert rows(net.get("interfaces", end=T0 - 1500, **one)) == [("swp99", "down")]
    seen = net.get("interfaces", start=T0 - 2500, end=T0 - 400, **one)
    assert rows(seen, "active", "state") == [(False, "up"), (True, "down"), (True, "up")]
    assert net.get("interfaces", view="all", **one).count() == 4
    assert net.get("interfaces", start=T0 - 900, **one).count() == 0


def test_filter_stage(net):
    from netstate.plans import getters

    late = getters.base(net.scope(), "interfaces", ifname="swp99", state="down")
    early = getters.base(net.scope(), "interfaces", stage="pre", ifname="swp99", state="down")
    assert (late.count(), early.count()) == (0, 1)


def test_filters(net):
    def count(table, **kw):
        return net.get(table, **kw).count()

    assert count("device", hostname=["~leaf.*"]) == 4
    assert count("device", hostname=["!~leaf.*", "!exit01"]) == 8
    assert count("interfaces", mtu=[">8999", "<9001"]) == 28
    assert count("routes", prefixlen=">24") == count("routes", prefixlen="32")
    assert count("routes", prefixlen="<=24") + count("routes", prefixlen=">24") == count("routes")
    assert count("routes", prefix=["10.1.3.101"]) == 4
    with pytest.raises(FilterError):
        net.get("routes", prefixlen=">129")
    assert count("device", version=[">=4.0"], status=["alive"]) == 2 + 1 - 1
    assert count("device", status=["dead"]) == 1
    assert count("macs", macaddr=["4438.3900.0601"]) == 2
    assert count("arpnd", prefix=["10.1.3.0/24"]) == 4 + 2
    assert count("address", address=["10.0.0.11"]) == 1
    assert count("address", prefix=["10.0.0.0/24"]) == 7
    assert count("interfaces", vlan=["13"], hostname=["leaf01"]) == 2
    assert count("ospf", state="passive") == 7
    assert count("sqPoller", status="fail") == 3
    with pytest.raises(UnknownColumnError):
        net.get("device", ["nothere"])


def test_user_predicate(net):
    assert net.get("interfaces", query_str="any_in_subnet(ipAddressList, '10.255.0.0/16')"
                   ).count() == 20
    with pytest.raises(FilterError):
        net.get("interfaces", query_str="notacolumn == 5")


def test_unique_top_histogram(net):
    assert rows(net.unique("device", "vendor", count=True)) == [
        ("Arista", 1), ("Cisco", 1), ("Cumulus", 10), ("N/A", 1)]
    assert net.unique("vlan", "interfaces").count() == 3
    best = net.top("fs", "usedPercent", count=2).collect()
    assert [r.usedPercent for r in best] == [50, 40]
    with pytest.raises(VerbError):
        net.top("device", "os")
    assert net.histogram("interfaces", "type").first()["count"] >= 20


def test_device_status(net):
    got = dict(rows(net.get("device", ["hostname", "status"])))
    assert got["old01"] == "dead" and got["192.168.0.99"] == "neverpoll"
    assert got["exit01"] == "alive"
    versions = dict(rows(net.get("device", ["hostname", "version"])))
    assert versions["exit01"] == "unsupported"
    up = net.get("device", ["*"], hostname="exit01").first()
    assert up.uptime == 60_000


def test_bgp_peer_names(net):
    got = rows(net.get("bgp", hostname="leaf01"), "peer", "peerHostname")
    assert [p for _, p in got] == ["spine01", "spine02"]
    assert net.get("bgp", ["*"]).first().asndot.startswith("0.650")


def test_lldp_strip_domain_and_bond(net):
    got = rows(net.get("lldp", hostname="leaf01", ifname="swp13"), "peerHostname")
    assert got == [("server101",)]
    bonded = rows(net.get("lldp", hostname="leaf01", use_bond=True), "ifname", "peerIfname")
    assert ("bond13", "bond0") in bonded


def test_portmode_vlanlist(net):
    got = {r[0]: r[1:] for r in rows(
        net.get("interfaces", ["ifname", "portmode", "vlanList"], hostname="leaf01"))}
    assert got["bond13"][0] == "access" and got["bond13"][1] == ()
    assert got["bond24"] == ("trunk", (24,))
    assert got["swp51"][0] == "routed"
    assert got["vlan13"][0] == "routed"


def test_inventory_names(net):
    assert rows(net.get("inventory"), "name") == [("Ethernet1/1/1",), ("fan-1",)]


def test_namespace_and_tables(net):
    ns = net.get("namespace").first()
    assert (ns.deviceCnt, ns.hasBgp, ns.hasMlag, ns.hasVxlan, ns.hasOspf) == (
        13, True, True, True, True)
    assert ns.errSvcCnt == 2
    listing = net.get("tables")
    assert listing.where("table = 'TOTAL'").count() == 1
    assert net.summarize("tables").first().serviceCnt == 16
    assert net.top("tables", "allRows", count=1).first().table == "interfaces"


def test_summaries(net):
    s = net.summarize("interfaces").first()
    assert s.uniqueIPv4AddrCnt == 7 + 20 + 8 + 4
    assert s.ifDownCnt == 1 and s.ifAdminDownCnt == 1
    assert s.ifPerDeviceStat[0] <= s.ifPerDeviceStat[2] <= s.ifPerDeviceStat[1]
    b = net.summarize("bgp").first()
    assert b.totalPeerCnt == 20 and b.failedPeerCnt == 2 and b.iBGPPeerCnt == 0
    assert b.upTimeStat == [5000.0, 5000.0, 5000.0]
    m = net.summarize("mlag").first()
    assert m.mlagNumSinglePortStat == [0.0, 1.0, 0.0]
    a = net.summarize("address").first()
    assert a.subnetsUsed[0] == "31"
    r = net.summarize("routes").first()
    assert r.hostRoutesCnt == 16 + 6 and r.totalV6RoutesinNs == 6
    assert net.summarize("evpnVni").first()["mode"] == "symmetric"
    assert net.summarize("ospf").first().passivePeerCnt == 7


def test_routes_view(net):
    got = net.get("routes", ["*"], hostname="exit01").collect()
    assert [(r.prefix, r.protocol, r.action) for r in got] == [
        ("0.0.0.0/0", "connected", "forward")]
    assert net.get("routes", hostname="spine01", prefix=["127.0.0.0/8"]).count() == 0


def test_lpm(net):
    got = rows(net.lpm("10.1.3.101"), "hostname", "vrf", "prefix")
    assert ("leaf01", "evpn-vrf", "10.1.3.0/24") in got
    assert ("leaf03", "evpn-vrf", "10.1.3.101/32") in got
    assert ("server104", "default", "0.0.0.0/0") in got
    assert {p for _, _, p in rows(net.lpm("2001:db8::5"), "hostname", "vrf", "prefix")} == {
        "2001:db8::/32"}


def test_assert_interfaces(net):
    got = {(r.hostname, r.ifname): r.assertReason
           for r in net.assert_("interfaces").collect()}
    assert "MTU mismatch" in got[("leaf04", "swp52")]
    assert "Speed mismatch" in got[("leaf03", "swp52")]
    assert got[("leaf01", "swp51")] == []
    assert got[("spine02", "swp4")] == ["MTU mismatch"]
    failed = net.assert_("interfaces", result="fail")
    assert failed.where("size(assertReason) = 0").count() == 0
    assert net.assert_("interfaces", what="mtu-value", value=[9216], result="fail",
                       hostname="leaf04").count() > 0


def test_assert_bgp(net):
    bad = rows(net.assert_("bgp", result="fail"), "hostname", "assertReason")
    assert ("exit01", "asn mismatch") in bad and ("exit01", "Hold Timer:expired") in bad
    assert ("leaf01", "Not all Afi/Safis enabled") in bad
    assert net.assert_("bgp", result="pass").count() == 17


def test_assert_ospf(net):
    got = {(r.hostname, r.ifname): r.assertReason for r in net.assert_("ospf").collect()}
    assert "Hello timers mismatch" in got[("leaf02", "swp52")]
    assert any(x.startswith("duplicate routerId") for x in got[("leaf04", "swp51")])
    assert got[("leaf01", "swp51")] == []
    with pytest.raises(FilterError):
        net.assert_("ospf", result="invalid")


def test_assert_evpn(net):
    got = {(r.hostname, r.vni): r.assertReason for r in net.assert_("evpnVni").collect()}
    assert "vni down" in got[("leaf02", 10024)]
    assert "Some VTEPs are unknown to all" in got[("leaf02", 10013)]
    assert got[("leaf01", 10024)] == []
    her = net.assert_("evpnVni", check_her=True, result="fail")
    assert her.where(F.exists("assertReason", lambda x: x.startswith("HER"))).count() > 0


def test_find(net):
    got = rows(net.find(["10.1.3.101"]), "hostname", "ifname", "type", "vlan", "l2miss",
               "bondMembers")
    assert got == [("leaf01", "bond13", "bridged", 13, False, "swp13"),
                   ("leaf02", "bond13", "bridged", 13, False, "swp13")]
    assert rows(net.find(["10.0.0.13"]), "hostname", "ifname", "type") == [
        ("leaf01", "lo", "interface")]
    by_mac = rows(net.find(["4438.3900.0601"]), "hostname", "ifname")
    assert by_mac == [("leaf01", "bond13"), ("leaf02", "bond13")]
    with pytest.raises(ValueError):
        net.find(["notanaddress"])


def test_topology(net):
    edges = net.topology(via=["lldp", "bgp", "ospf"])
    one = edges.where("hostname = 'leaf01' and peerHostname = 'spine01' and ifname = 'swp51'")
    r = one.first()
    assert (r.lldp, r.bgp, r.ospf, r.polled) == (True, True, True, True)
    assert edges.where("hostname='exit01' and peerHostname='spine02' and bgp").count() == 0
    s = {r.service: r for r in net.topology_summary(via=["lldp", "bgp"]).collect()}
    assert s["lldp"].number_of_nodes == 11 and s["lldp"].is_fully_connected
    assert s["bgp"].number_of_edges == 9 and s["bgp"].center == ["spine01"]
    with pytest.raises(ValueError):
        net.topology(via=["lldp"], asn=65011)
    arp = net.topology(via=["arpnd"])
    assert arp.where("hostname='leaf01' and peerHostname='spine01' and arpndBidir").count() == 1


@pytest.fixture(scope="module")
def path_tables(net):
    return net.path_tables()


def test_paths(net, spark, path_tables):
    """Two requests in one trace: inside a VLAN, and across the fabric."""
    requests = spark.createDataFrame(
        [("near", "dc1", "10.1.3.101", "10.1.3.103"), ("far", "dc1", "10.1.3.101", "10.1.4.104")],
        "req string, namespace string, src string, dest string")
    hops = cut_lineage(net.path(requests, tables=path_tables))
    by_path = {}
    for r in hops.orderBy("req", "pathid", "hopCount").collect():
        by_path.setdefault((r.req, r.pathid), []).append(r.hostname)
    far = {tuple(p) for (req, _), p in by_path.items() if req == "far"}
    assert far == {("server101", "leaf01", s, leaf, "server104")
                   for s in ("spine01", "spine02") for leaf in ("leaf03", "leaf04")}
    assert all(p[0] == "server101" for p in by_path.values())
    summary = {r.req: r for r in paths.path_summary(hops).collect()}["far"]
    assert summary.totalPaths == 4 and summary.maxPathLength == 4
    assert summary.perHopEcmp == [1, 2, 2, 1]
    assert summary.uniqueDevices == 7 and summary.pathMtu == 1500
    behind = paths.path_evidence(hops, path_tables)
    kinds = {r.evidence for r in behind.select("evidence").distinct().collect()}
    assert {"route", "arpnd", "interface"} <= kinds
    with pytest.raises(paths.PathError):
        net.path(namespace="dc1", src="10.1.3.101", dest="2001:db8::1")


def test_failures_status_search(net, spark):
    bad = rows(net.failures(), "table", "object")
    assert ("device", "old01") in bad and ("interfaces", "Ethernet1/1/1") in bad
    assert ("mlag", "44:39:39:ff:00:02") in bad
    counts = dict(rows(net.status("interfaces").select("state", "count")))
    assert counts["adminDown"] == 1
    assert net.poll_freshness().first().lastUpdate == T0
    terms = spark.createDataFrame(
        [("mac", "44:38:39:00:06:01"), ("vlan", "13"), ("address", "10.0.0.13"),
         ("asn", "65020")], "kind string, value string")
    found = net.search(terms)
    kinds = dict(rows(found.groupBy("kind").count()))
    assert kinds["mac"] == 2 and kinds["vlan"] == len(LEAVES) and kinds["address"] == 1
    assert net.humanize(net.get("device")).schema["timestamp"].dataType.typeName() == "timestamp"


def test_natural_order(net):
    got = [r.ifname for r in net.natural(
        net.get("interfaces", ["hostname", "ifname"], hostname="spine01"), "interfaces"
    ).collect()]
    assert got == ["lo", "swp1", "swp2", "swp3", "swp4", "swp5"]
