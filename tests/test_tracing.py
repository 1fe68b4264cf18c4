"""Recursion, loops and overlays of path tracing; endpoints through time."""

from pyspark.sql import functions as F

from netstate.operators import locate, path
from netstate.session import cut_lineage
from tests.conftest import rows
from tests.fixture_network import frame


def port(ns, host, name, cidr, vrf="", kind="ethernet", mtu=9000, **more):
    return dict(namespace=ns, hostname=host, ifname=name, type=kind, state="up", master=vrf,
                mtu=mtu, macaddr=f"{host}:{name}", ipAddressList=[cidr], **more)


def route(ns, host, prefix, nhs=(), oifs=(), vrf="default", protocol="bgp"):
    return dict(namespace=ns, hostname=host, vrf=vrf, prefix=prefix, nexthopIps=list(nhs),
                oifs=list(oifs), protocol=protocol, ipvers=4)


def neighbour(ns, host, oif, address, mac):
    return dict(namespace=ns, hostname=host, oif=oif, ipAddress=address, macaddr=mac,
                state="reachable")


def test_recursion_loop_and_overlay(spark):
    ifs = [
        port("rec", "a", "lo", "1.1.1.1/32", kind="loopback"), port("rec", "a", "e0", "10.0.0.0/31"),
        port("rec", "b", "lo", "2.2.2.2/32", kind="loopback"), port("rec", "b", "e0", "10.0.0.1/31"),
        port("loop", "c", "lo", "3.3.3.3/32", kind="loopback"),
        port("loop", "c", "e0", "10.1.0.0/31"), port("loop", "d", "e0", "10.1.0.1/31"),
        port("ovl", "v1", "lo", "10.9.0.1/32", kind="loopback"),
        port("ovl", "v1", "vlan10", "172.16.1.1/24", vrf="red", kind="vlan"),
        port("ovl", "v1", "e0", "10.2.0.0/31"), port("ovl", "s", "e0", "10.2.0.1/31"),
        port("ovl", "s", "e1", "10.2.0.2/31"), port("ovl", "v2", "e0", "10.2.0.3/31"),
        port("ovl", "v2", "lo", "10.9.0.2/32", kind="loopback"),
        port("ovl", "v2", "vlan20", "172.16.2.1/24", vrf="red", kind="vlan"),
    ]
    routes = [
        route("rec", "a", "2.2.2.2/32", ["9.9.9.9"]),
        route("rec", "a", "9.9.9.9/32", ["10.0.0.1"], ["e0"], protocol="ospf"),
        route("rec", "b", "1.1.1.1/32", ["10.0.0.0"], ["e0"]),
        route("loop", "c", "0.0.0.0/0", ["10.1.0.1"], ["e0"]),
        route("loop", "d", "0.0.0.0/0", ["10.1.0.0"], ["e0"]),
        route("ovl", "v1", "172.16.2.0/24", ["10.9.0.2"], ["_nexthopVrf:default"], vrf="red"),
        route("ovl", "v1", "10.9.0.2/32", ["10.2.0.1"], ["e0"]),
        route("ovl", "s", "10.9.0.2/32", ["10.2.0.3"], ["e1"]),
        route("ovl", "v2", "172.16.1.0/24", ["10.9.0.1"], ["_nexthopVrf:default"], vrf="red"),
        route("ovl", "v2", "172.16.2.0/24", [], ["vlan20"], vrf="red", protocol="connected"),
    ]
    arp = [
        neighbour("rec", "a", "e0", "10.0.0.1", "b:e0"),
        neighbour("loop", "c", "e0", "10.1.0.1", "d:e0"),
        neighbour("loop", "d", "e0", "10.1.0.0", "c:e0"),
        neighbour("ovl", "v1", "e0", "10.2.0.1", "s:e0"),
        neighbour("ovl", "s", "e1", "10.2.0.3", "v2:e0"),
    ]
    tables = path.PathTables(
        frame(spark, "interfaces", ifs), frame(spark, "routes", routes),
        frame(spark, "arpnd", arp), frame(spark, "macs", []))
    requests = spark.createDataFrame(
        [("rec", "rec", "1.1.1.1", "2.2.2.2"), ("loop", "loop", "3.3.3.3", "8.8.8.8"),
         ("ovl", "ovl", "172.16.1.1", "172.16.2.1")],
        "req string, namespace string, src string, dest string")
    hops = cut_lineage(path.path(requests, tables))

    def of(req, *cols):
        return [tuple(r) for r in hops.where(F.col("req") == req).orderBy("hopCount").select(
            *cols).collect()]

    assert of("rec", "hostname", "oif", "nexthopIp") == [("a", "e0", "10.0.0.1"), ("b", "lo", "")]
    looped = of("loop", "hostname", "hopError")
    assert [h for h, _ in looped] == ["c", "d", "c"] and "L3 loop" in looped[-1][1]
    assert of("ovl", "hostname", "overlay", "vtepLookup") == [
        ("v1", True, "10.9.0.2"), ("s", True, "10.9.0.2"), ("v2", False, "")]


def test_endpoint_that_moves(spark):
    """Local on h1, then remote there and local on h2: h1 reports it gone."""
    def svi(host):
        return dict(hostname=host, ifname="vlan10", type="vlan", vlan=10, master="red",
                    ipAddressList=["10.0.0.1/24"], timestamp=1)

    mac = "00:00:00:00:00:aa"
    entry = dict(ipAddress="10.0.0.9", oif="vlan10", macaddr=mac, state="reachable")
    arp = frame(spark, "arpnd", [
        dict(entry, hostname="h1", timestamp=100), dict(entry, hostname="h1", timestamp=200,
                                                        remote=True),
        dict(entry, hostname="h2", timestamp=50, remote=True),
        dict(entry, hostname="h2", timestamp=200)])
    ifs = frame(spark, "interfaces", [svi("h1"), svi("h2")])
    macs = frame(spark, "macs", [
        dict(hostname="h1", mackey="10", macaddr=mac, vlan=10, oif="swp1", timestamp=100),
        dict(hostname="h2", mackey="10", macaddr=mac, vlan=10, oif="swp7", timestamp=200)])
    wanted = spark.createDataFrame([("10.0.0.9",)], "address string")
    got = locate.find_by_arp(wanted, arp, ifs, macs, past=True)
    assert rows(got, "hostname", "timestamp", "active", "ifname", "type", "l2miss") == [
        ("h1", 100, True, "swp1", "bridged", False),
        ("h1", 200, False, "vlan10", "bridged", False),
        ("h2", 200, True, "swp7", "bridged", False)]


def test_endpoint_on_several_ports(spark):
    """Each ARP row has the last state of each port up to its end, later moves left out."""
    mac = "00:00:00:00:00:aa"
    svi = dict(hostname="h1", ifname="vlan10", type="vlan", vlan=10, master="red",
               ipAddressList=["10.0.0.1/24"], timestamp=1)
    entry = dict(hostname="h1", ipAddress="10.0.0.9", oif="vlan10", macaddr=mac,
                 state="reachable")
    arp = frame(spark, "arpnd", [dict(entry, timestamp=t) for t in (100, 200, 300)]
                + [dict(entry, ipAddress="10.0.0.8", macaddr="00:00:00:00:00:bb", timestamp=5)])
    moves = [(150, "swp1", True), (160, "swp2", True), (200, "swp1", False), (250, "swp1", True),
             (310, "swp2", False), (400, "swp3", True)]
    macs = frame(spark, "macs", [dict(
        hostname="h1", mackey="10", macaddr=mac, vlan=10, oif=port, timestamp=t, active=on)
        for t, port, on in moves])
    wanted = spark.createDataFrame([("10.0.0.9",), ("10.0.0.8",)], "address string")
    got = locate.find_by_arp(wanted, arp, frame(spark, "interfaces", [svi]), macs, past=True)
    assert rows(got, "ipAddress", "timestamp", "ifname", "l2miss") == sorted([
        ("10.0.0.8", 5, "vlan10", True),
        # Up to 200: swp1 has just gone, swp2 is there.
        ("10.0.0.9", 200, "vlan10", True), ("10.0.0.9", 100, "swp2", False),
        ("10.0.0.9", 200, "swp1", False), ("10.0.0.9", 200, "swp2", False),
        # Up to now.
        ("10.0.0.9", 300, "swp1", False), ("10.0.0.9", 310, "vlan10", True),
        ("10.0.0.9", 300, "swp3", False)], key=str)
