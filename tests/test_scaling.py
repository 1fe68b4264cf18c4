"""Steps that once grew faster than their input: the same answers, and what they may cost."""

import random

from pyspark.sql import functions as F

from netstate import session
from netstate.operators import path, topology as topo


def _sums(edges):
    """Brute force: distance sums of (graph, src, dst) edges."""
    near = {}
    for g, a, b in edges:
        near.setdefault((g, a), set()).add((g, b))
        near.setdefault((g, b), set()).add((g, a))
    out = {}
    for start in near:
        seen, level, total, edge = {start}, 0, 0, {start}
        while edge:
            level += 1
            edge = {n for e in edge for n in near[e]} - seen
            seen |= edge
            total += level * len(edge)
        out[start] = total
    return out


def test_all_slots_of_a_search_advance_together(spark, monkeypatch):
    monkeypatch.setattr(topo, "WORDS", 1)
    monkeypatch.setattr(topo, "BITS", 63)
    monkeypatch.setattr(topo, "NUMBERED", 100)
    rng = random.Random(5)
    edges = [("a", f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(220)]
    edges += [("b", "hub", f"m{i}") for i in range(200)]
    edges += [("b", f"k{i}", f"k{i + 1}") for i in range(4)]
    edges += [("c", "self", "self"), ("a", "n1", "n1"), ("b", "m1", "hub")]
    df = spark.createDataFrame(
        [*edges, (None, "x", "y"), ("a", None, None)], "g string, src string, dst string")
    before = len(session._written)
    got = {(r.g, r.node): r.total for r in topo.distance_sums(df, ["g"]).collect()}
    assert got == _sums(edges)
    # A table for each level, not for each level of each slot (six slots here).
    levels = max(d for d in _depths(edges))
    assert len(session._written) - before <= levels + levels // topo.LEVELS + 6


def test_held_graphs_and_searched_ones_have_the_same_sums(spark, monkeypatch):
    rng = random.Random(8)
    edges = [("a", f"n{i}", f"n{i + rng.randrange(1, 4)}") for i in range(40)]
    edges += [("b", f"m{rng.randrange(40)}", f"m{rng.randrange(40)}") for _ in range(120)]
    edges += [(f"g{i}", "x", "y") for i in range(20)] + [("c", "self", "self")]
    df = spark.createDataFrame(edges, "g string, src string, dst string")
    monkeypatch.setattr(topo, "SOURCES", 70)
    monkeypatch.setattr(topo, "PACK_EDGES", 100)
    # The long graph is held, the wide one is not.
    monkeypatch.setattr(topo, "HELD_EDGES", 100)
    before = len(session._written)
    got = {(r.g, r.node): r.total for r in topo.distance_sums(df, ["g"]).collect()}
    assert got == _sums(edges)
    wide = max(_depths([e for e in edges if e[0] == "b"]))
    assert max(_depths(edges)) > wide + 2
    # A graph that is held needs no table for each level.
    assert len(session._written) - before <= wide + 7
    one = [("", a, b) for g, a, b in edges if g == "a"]
    got = {("", r.node): r.total for r in topo.distance_sums(df.where("g = 'a'"), []).collect()}
    assert got == _sums(one)


def _depths(edges):
    near = {}
    for g, a, b in edges:
        near.setdefault((g, a), set()).add((g, b))
        near.setdefault((g, b), set()).add((g, a))
    for start in near:
        seen, edge, level = {start}, {start}, 0
        while edge:
            level += 1
            edge = {n for e in edge for n in near[e]} - seen
            seen |= edge
        yield level


def test_range_text_reads_its_numbers_once(spark):
    from netstate.functions import text
    from pyspark.sql import functions as F

    def plan(column):
        return column._jc.toString().count("array_distinct")

    assert plan(text.list_to_range(F.col("n"))) == 1
    df = spark.createDataFrame([([3, 1, 2, 7, 2],), ([],), (None,), ([5],)], "n array<bigint>")
    got = [r[0] for r in df.select(text.list_to_range("n")).collect()]
    assert got == ["1-3, 7", "", None, "5"]


def test_prefixes_of_the_other_family_hold_no_address(spark):
    from netstate.functions import ip

    rows = [("10.1.2.3", "fe80::1/64", False), ("fe80::1", "10.1.2.0/24", False),
            ("10.1.2.3", "10.1.2.0/24", True), ("fe80::9", "fe80::1/64", True),
            ("::ffff:10.1.2.3", "::/0", True), (None, "::/0", False), ("10.1.2.3", None, False)]
    got = spark.createDataFrame(rows, "a string, c string, held boolean").select(
        "held", ip.addr_in_cidr("a", "c").alias("got"))
    assert all(r.held == r.got for r in got.collect())


def test_tables_are_asked_once_per_innermost_network(spark, monkeypatch):
    import ipaddress

    from netstate.operators import lpm

    rng = random.Random(3)
    hot, six = int(ipaddress.ip_address("10.7.0.0")), int(ipaddress.ip_address("2001:db8::"))

    def v4():
        return str(ipaddress.ip_address(hot + rng.randrange(1 << 16)))

    def v6():
        return str(ipaddress.ip_address(six + rng.randrange(1 << 70)))

    hosts = ["h0", "h1", "h2", None]
    routes = {(rng.choice(hosts), f"{v4()}/{rng.randrange(6, 33)}") for _ in range(300)}
    routes |= {(rng.choice(hosts), f"{v6()}/{rng.randrange(16, 129)}") for _ in range(80)}
    routes |= {("h0", "0.0.0.0/0"), ("h1", "::/0"), ("h2", "10.7.1.9/24"), ("h2", "10.7.1.7/24"),
               ("h3", "10.7.1.7/24"), ("h3", "no prefix")}
    asked = [v4() for _ in range(200)] + [v6() for _ in range(80)]
    asked += ["10.7.1.1", "10.7.1.1", "99.0.0.1", "fe80::1", None, "nowhere"]
    want = []
    nets = [(h, p, ipaddress.ip_network(p, strict=False)) for h, p in routes if p != "no prefix"]
    for a in asked[:-2]:
        at, best = ipaddress.ip_address(a), {}
        for h, p, n in nets:
            if at in n:
                best[h] = min(best.get(h, (0, "~")), (-n.prefixlen, p))
        want += [(a, h, p, -n) for h, (n, p) in best.items()]
    table = spark.createDataFrame(list(routes), "hostname string, prefix string")
    addresses = spark.createDataFrame([(a,) for a in asked], "address string")

    def found(merge, how="inner"):
        got = lpm.lpm_join(addresses, table, scope=(), per=("hostname",), merge=merge, how=how)
        return sorted(map(tuple, got.select(
            "address", "hostname", "prefix", "matchedLen").collect()), key=str)

    assert found(False) == sorted(want, key=str)
    some = found(False, "left")
    # Addresses themselves never meet the tables.
    monkeypatch.setattr(lpm, "containing", None)
    assert found(True) == sorted(want, key=str)
    assert found(True, "left") == some


def test_candidates_of_many_prefix_lengths_are_not_broadcast(spark, monkeypatch):
    from netstate.operators import lpm

    table = session.cut_lineage(spark.createDataFrame(
        [("h0", "10.0.0.0/8"), ("h0", "0.0.0.0/0"), ("h1", "10.1.0.0/16"), ("h1", "10.1.2.0/24")],
        "hostname string, prefix string"))
    asked = session.cut_lineage(spark.createDataFrame(
        [("10.1.2.3",), ("10.9.9.9",)], "address string"))
    monkeypatch.setattr(lpm, "FEW_BROADCAST", 0, raising=False)
    found = lpm.lpm_join(asked, table, scope=(), per=("hostname",), merge=True)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.select("address", "hostname", "prefix").collect()))
    assert got == [("10.1.2.3", "h0", "10.0.0.0/8"), ("10.1.2.3", "h1", "10.1.2.0/24"),
                   ("10.9.9.9", "h0", "10.0.0.0/8")]


def test_shared_prefixes_are_hashed_once(spark):
    import hashlib
    import ipaddress

    from netstate.operators import pseudonymize as P

    def bits(word, width, scope):
        out = 0
        for i in range(width):
            above = word >> (width - i)
            mark = hashlib.sha256(f"s|ip|{scope}|{i}|{above}".encode()).hexdigest()
            out = out << 1 | (word >> (width - 1 - i) & 1) ^ (int(mark[0], 16) & 1)
        return out

    def want(text):
        address, slash, tail = text.partition("/")
        try:
            at = ipaddress.ip_address(address)
        except ValueError:
            return text
        n = int(at)
        if at.version == 4:
            new = str(ipaddress.IPv4Address(bits(n, 32, "4")))
        else:
            hi, lo = n >> 64, n & (1 << 64) - 1
            signed = hi - (1 << 64) if hi >> 63 else hi
            new = ipaddress.IPv6Address(
                bits(hi, 64, "6") << 64 | bits(lo, 64, f"6|{signed}")).exploded
        return new + slash + tail

    rng = random.Random(2)
    texts = [f"10.{i % 3}.{rng.randrange(256)}.{i}" for i in range(60)] * 2
    texts += [f"2001:db8::{rng.randrange(4):x}:{i:x}/64" for i in range(20)]
    texts += ["fe80::1", "ffff::", "::", "::ffff:10.1.2.3", "0.0.0.0/0", "255.255.255.255",
              "300.1.1.1", "", "swp1", "1::2::3", "10.0.0.1/"]
    df = spark.createDataFrame([(t, [t, None, "10.1.2.3"]) for t in texts] + [(None, None)],
                               "a string, l array<string>")
    got = P.pseudonymize(
        df.withColumn("old", df.a), {"a": "ip", "l": "ip"}, "s").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.a, r.l) == ((None, None) if r.old is None else (
            want(r.old), [want(r.old), None, want("10.1.2.3")])), r
    # No loop over the bits of each row is left in the plan.
    plan = df.select(P.anon_address("a", "s"))._jdf.queryExecution().toString()
    assert "sha2" not in plan and "aggregate(" not in plan


def test_a_trace_sends_no_large_table_through_the_driver(spark):
    """Tables below the limit of broadcasts, once compressed, are joined by shuffle."""
    number = F.col("id").cast("string")
    table = session.cut_lineage(spark.range(20000).select(
        F.lit("ns").alias("namespace"), F.concat(F.lit("h"), number).alias("hostname"),
        F.sha2(number, 256).alias("ipAddress"), number.alias("arpMac")))
    assert 64 << 10 < session.estimated_bytes(table) < 10 << 20
    rows = spark.range(0, 20000, 7).select(
        F.lit("ns").alias("namespace"), F.concat(F.lit("h"), F.col("id")).alias("device"),
        F.sha2(F.col("id").cast("string"), 256).alias("nhip"), F.col("id").alias("req"))
    on = {"namespace": "namespace", "device": "hostname", "nhip": "ipAddress"}
    found = path._lookup(rows, table, on)
    ends = table.select(
        F.col("arpMac").cast("long").alias("req"), F.col("hostname").alias("device"),
        F.lit("lo").alias("ifname"), F.lit(9000).alias("mtu"), F.lit("default").alias("vrf"))
    ended = path.finish_at_destination(rows, ends)
    for df, told in ((found, "arpMac = req"), (ended, "d_ifname = 'lo'")):
        assert df.where(told).count() == df.count() == rows.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan
    few = path._lookup(rows, session.cut_lineage(table.limit(100)), on)
    assert few.where("arpMac is not null").count() == 15
