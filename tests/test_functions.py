import ipaddress

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from netstate.functions import ip, register_sql_functions, text, timefn
from netstate.operators import config, ordered, pseudonymize as P, summary
from tests.conftest import rows


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn("v").alias("r")).first().r


@pytest.mark.parametrize("given_, want", [
    ("509A:4C36:A1DF", "50:9a:4c:36:a1:df"), ("509A.4C36.A1DF", "50:9a:4c:36:a1:df"),
    ("509A-4C36-A1DF", "50:9a:4c:36:a1:df"), ("509A4C36A1DF", "50:9a:4c:36:a1:df"),
    ("50-9A-4C-36-A1-DF", "50:9a:4c:36:a1:df"), ("50-9Z-4C-36-A1-DF", "50-9z-4c-36-a1-df"),
    ("50:9a:4c:36:a1:df", "50:9a:4c:36:a1:df"), (None, "00:00:00:00:00:00"),
])
def test_mac_forms(spark, given_, want):
    assert one(spark, given_, text.mac_canonical) == want


def test_ranges_and_versions(spark):
    assert one(spark, "1, 2-5, 10, 12-14", text.range_to_list) == [1, 2, 3, 4, 5, 10, 12, 13, 14]
    assert one(spark, "junk", text.range_to_list) == []
    assert one(spark, [5, 1, 2, 3, 9], text.list_to_range, "array<bigint>") == "1-3, 5, 9"
    df = spark.createDataFrame([(v,) for v in ("4.20.1", "4.3", "10.1", "4.20.1a")], "v string")
    assert [r.v for r in df.orderBy(text.version_key("v")).collect()] == [
        "4.3", "4.20.1a", "4.20.1", "10.1"]


def test_relative_times(spark):
    day = 86_400
    assert one(spark, "1d12h3m23s", timefn.reltime_seconds) == day + 12 * 3600 + 203
    assert one(spark, "01:20:35", timefn.reltime_seconds) == 4835
    assert one(spark, '{"junos:seconds": "9"}', timefn.reltime_seconds) == 9
    assert one(spark, "P1DT2H", timefn.reltime_seconds) == day + 7200
    assert one(spark, "never", timefn.reltime_seconds) is None
    assert timefn.period_ms("15m") == 900_000
    with pytest.raises(ValueError):
        timefn.period_ms("5x")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 32)), min_size=1, max_size=30),
       st.lists(st.tuples(st.integers(0, 2**128 - 1), st.integers(0, 128)), min_size=1,
                max_size=30))
def test_networks_match_the_standard_library(spark, v4, v6):
    cidrs = [f"{ipaddress.IPv4Address(a)}/{n}" for a, n in v4]
    cidrs += [f"{ipaddress.IPv6Address(a)}/{n}" for a, n in v6]
    df = spark.createDataFrame([(c,) for c in cidrs], "c string")
    got = df.select("c", ip.network("c").alias("n")).collect()
    for r in got:
        net = ipaddress.ip_network(r.c, strict=False).network_address
        hi, lo = divmod(int(net), 1 << 64)
        assert (r.n.hi % (1 << 64), r.n.lo % (1 << 64)) == (hi, lo), r.c
    full = df.select(ip.is_prefix("c").alias("p"), "c").collect()
    for r in full:
        try:
            ipaddress.ip_network(r.c)
            want = True
        except ValueError:
            want = False
        assert r.p == want, r.c


def test_lpm_join_against_brute_force(spark):
    from netstate.operators import lpm

    routes = [("ns", f"h{h}", "default", f"{a}.{b}.0.0/{n}") for h in range(2)
              for a in (10, 20) for b in (0, 16, 64) for n in (0, 8, 12, 16)]
    routes += [("ns", "h0", "default", "2001:db8::/32"), ("ns", "h0", "default", "::/0"),
               ("ns", "h0", "default", "2001:db8:0:5::/64")]
    addresses = [("ns", f"h{i % 2}", "default", f"{10 + 10 * (i % 3)}.{i % 80}.1.{i}")
                 for i in range(60)]
    addresses += [("ns", "h0", "default", a) for a in ("2001:db8:0:5::9", "2001:db9::1")]
    cols = "namespace string, hostname string, vrf string, "
    got = lpm.lpm_join(spark.createDataFrame(addresses, cols + "address string"),
                       spark.createDataFrame(list(set(routes)), cols + "prefix string"))
    lens = {(r.hostname, r.address): r.matchedLen for r in got.collect()}
    for _, h, _, a in addresses:
        best = max((ipaddress.ip_network(p, strict=False).prefixlen for _, rh, _, p in routes
                    if rh == h and ipaddress.ip_address(a) in ipaddress.ip_network(
                        p, strict=False)), default=None)
        assert lens.get((h, a)) == best, a


def _best_prefixes(routes, addresses):
    """{(host, address): (prefix, tag)}: longest, then first by text."""
    nets = [(h, ipaddress.ip_network(p, strict=False), p, tag) for _, h, _, p, tag in routes]
    out = {}
    for _, h, _, a in addresses:
        held = [(-n.prefixlen, p, tag) for rh, n, p, tag in nets
                if rh == h and ipaddress.ip_address(a) in n]
        if held:
            out[h, a] = min(held)[1:]
    return out


def test_lpm_in_one_pass_against_brute_force(spark):
    import random

    from netstate.operators import lpm

    rng = random.Random(8)

    def v4(base, spread):
        return str(ipaddress.ip_address(base + rng.randrange(spread)))

    hot = int(ipaddress.ip_address("10.7.0.0"))
    hosts = ["h0", "h0", "h1"]
    # Most routes and addresses lie in one /16 of one table.
    routes = {(rng.choice(hosts), f"{v4(hot, 1 << 16)}/{rng.randrange(9, 33)}") for _ in range(400)}
    routes |= {("h1", f"{v4(1 << 28, 1 << 30)}/{rng.randrange(1, 33)}") for _ in range(60)}
    six = int(ipaddress.ip_address("2001:db8::"))
    routes |= {("h0", f"{ipaddress.ip_address(six + rng.randrange(1 << 70))}/"
                      f"{rng.randrange(20, 129)}") for _ in range(80)}
    routes |= {("h0", "default"), ("h1", "::/0"), ("h0", "10.7.1.9/24"), ("h0", "10.7.1.200/24"),
               ("h0", "10.7.255.255/32"), ("h0", "10.7.0.0/32"), ("h0", "255.255.255.255/32"),
               ("h0", "ffff::/16"), ("h0", "not a prefix"), ("h1", "10.0.0.0/40")}
    routes = [("ns", h, "v", p, i) for i, (h, p) in enumerate(sorted(routes))]
    addresses = [("ns", rng.choice(hosts), "v", v4(hot, 1 << 16)) for _ in range(500)]
    addresses += [("ns", "h1", "v", v4(1 << 28, 1 << 30)) for _ in range(60)]
    addresses += [("ns", rng.choice(hosts), "v", str(ipaddress.ip_address(
        six + rng.randrange(1 << 70)))) for _ in range(80)]
    addresses += [("ns", "h0", "v", a) for a in (
        "10.7.1.1", "10.7.1.1", "0.0.0.0", "255.255.255.255", "10.7.0.0", "10.7.255.255",
        "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "::")]
    usable = [(*r[:3], "0.0.0.0/0" if r[3] == "default" else r[3], r[4]) for r in routes
              if r[3] not in ("not a prefix", "10.0.0.0/40")]
    want = _best_prefixes(usable, addresses)
    cols = "namespace string, hostname string, vrf string, "
    asked = spark.createDataFrame(addresses + [("ns", None, "v", "10.7.0.1"), (
        "ns", "h0", "v", None), ("ns", "h0", "v", "nowhere"), ("ns", "h9", "v", "10.7.0.1")],
        cols + "address string")
    table = spark.createDataFrame(routes, cols + "prefix string, tag int")
    for merge in (True, False):
        got = lpm.lpm_join(asked, table, merge=merge).collect()
        assert len(got) == sum((h, a) in want for _, h, _, a in addresses), merge
        for r in got:
            prefix, tag = want[r.hostname, r.address]
            assert r.tag == tag, (merge, r)
            length = ipaddress.ip_network(prefix, strict=False).prefixlen
            assert r.matchedLen == length, (merge, r)
    left = lpm.lpm_join(asked, table, merge=True, how="left")
    assert left.count() == len(addresses) + 4
    assert lpm.lpm_join(asked, table.limit(0), merge=True).count() == 0
    assert lpm.lpm_join(asked.limit(0), table, merge=True).count() == 0


def test_ordered_chunks_equal_plain_windows(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            (F.col("id") % 7).cast("string")).alias("k"),
        (F.col("id") * 37 % 5000).alias("t"), F.col("id").alias("v"))
    maybe = F.when(F.col("v") % 5 == 0, F.col("v"))
    for fn, args in [
        (ordered.previous_value, ({"x": F.col("v")},)), (ordered.next_value, ({"x": F.col("v")},)),
        (ordered.fill_forward, ({"x": maybe},)), (ordered.running_sum, (F.col("v"), "x")),
    ]:
        plain = rows(fn(df, ["k"], "t", *args, chunk_ms=None))
        assert rows(fn(df, ["k"], "t", *args, chunk_ms=100, hot_rows=0)) == plain, fn.__name__
        # Only 'hot' is chunked, the others are not.
        assert rows(fn(df, ["k"], "t", *args, chunk_ms=100, hot_rows=500)) == plain, fn.__name__


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-1000, 10**9), min_size=1, max_size=80))
def test_spread_is_exact(spark, values):
    import statistics

    df = spark.createDataFrame([("g", v) for v in values], "g string, value bigint")
    r = summary.spread_rows(df, ["g"]).first()
    assert (r["min"], r["max"], r["median"]) == (
        min(values), max(values), statistics.median(values))


def test_sql_functions(spark):
    register_sql_functions(spark)
    r = spark.sql("select in_subnet('10.1.2.3', '10.0.0.0/8') a, ip_version('::1') b, "
                  "mac_canonical('509A.4C36.A1DF') c, prefix_len('10.0.0.0/9') d").first()
    assert tuple(r) == (True, 6, "50:9a:4c:36:a1:df", 9)
    assert [x.n for x in spark.sql("select n from range_rows('1,3-5')").collect()] == [1, 3, 4, 5]


JUNOS = """system {
    host-name x;
}
interfaces {
    ge-0/0/1 {
        unit 0 {
            family ethernet-switching {
                interface-mode access;
                vlan {
                    members 10;
                }
            }
        }
    }
    ge-0/0/2 {
        mtu 9000;
    }
}
"""


def test_config(spark):
    df = spark.createDataFrame([
        ("n", "j", "junos-qfx", JUNOS),
        ("n", "e", "eos", "interface Ethernet1\n   switchport access vlan 5\n!\nrouter bgp 1\n"
                          "   neighbor 1.1.1.1\n      remote-as 2\n   exit\n!"),
    ], "namespace string, hostname string, os string, config string")
    assert rows(config.switchport_modes(df), "hostname", "ifname", "portmode", "vlan") == [
        ("e", "Ethernet1", "access", 5), ("j", "ge-0/0/1", "access", 10)]
    got = dict(rows(config.config_sections(df, "neighbor|host-name", system="os"), "hostname",
                    "config"))
    assert got == {"e": "   neighbor 1.1.1.1\n      remote-as 2", "j": "    host-name x"}
    big = spark.range(1).select(F.concat(F.lit("top\n"), F.repeat(F.lit("  child line\n"), 50_000),
                                         F.lit("end")).alias("config"))
    assert len(config.config_sections(big, "^top").first().config.split("\n")) == 50_001


def test_pseudonyms(spark):
    df = spark.createDataFrame(
        [("sw1.example.com", "50:9a:4c:36:a1:df", "10.1.2.3/24"),
         ("sw1", "509A.4C36.A1DF", "10.1.2.99/24"), ("sw2", "00:00:00:00:00:00", "2001:db8::1")],
        "h string, m string, a string")
    out = P.pseudonymize(df, {"h": "host", "m": "mac", "a": "ip"}, "seed").collect()
    assert out[0].h.split(".")[0] == out[1].h and out[1].h != out[2].h
    assert out[0].m.replace(":", "") == out[1].m.replace(".", "").lower()
    assert out[2].m == "00:00:00:00:00:00"
    assert out[0].a.rsplit(".", 1)[0] == out[1].a.rsplit(".", 1)[0] != "10.1.2"
    assert out[2].a.count(":") == 7
    again = P.pseudonymize(df, {"a": "ip"}, "seed").collect()
    assert again[0].a == out[0].a
    texts = spark.createDataFrame(
        [("hostname sw1\n ip 10.1.2.3 via 10.1.2.3, mac 509a.4c36.a1df v6 2001:db8::1",)],
        "t string")
    got = P.pseudonymize_text(texts, "t", "seed", ["hostname"]).first().t
    assert "10.1.2.3" not in got and "509a.4c36" not in got and "sw1" not in got
    assert got.count(out[0].a.split("/")[0]) == 2
    assert "2001:db8" not in got
