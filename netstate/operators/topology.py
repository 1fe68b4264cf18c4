"""Adjacency of devices: edges by protocol, graph statistics, components, centre.

A graph is an edge list ``(graph.., src, dst)``; ``graph`` columns (e.g.
namespace and service) name independent graphs that are processed together.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netstate.operators.enrich import NS_HOST, _lookup, unique_by
from netstate.session import cut_lineage, shuffle_if_large

EDGE_KEY = ["namespace", "hostname", "peerHostname"]
SERVICES = ["lldp", "arpnd", "bgp", "ospf"]


# -- edges ------------------------------------------------------------------

def interface_vrfs(ifs: DataFrame) -> DataFrame:
    vrf = F.when(F.col("type").isin("bridge", "bond_slave") | (F.col("master") == ""),
                 F.lit("default")).otherwise(F.col("master"))
    return unique_by(ifs.withColumn("__vrf", vrf), [*NS_HOST, "ifname"], vrf="__vrf")


def lldp_edges(lldp: DataFrame, ifs: DataFrame) -> DataFrame:
    df = lldp.where("peerHostname != ''").select(*EDGE_KEY, "ifname")
    return df.join(interface_vrfs(ifs), [*NS_HOST, "ifname"], "left").distinct().withColumn(
        "lldp", F.lit(True))


def bgp_edges(bgp: DataFrame) -> DataFrame:
    df = bgp.where("state = 'Established' and peerHostname != ''")
    return df.select(*EDGE_KEY, "vrf", "asn", "peerAsn").distinct().withColumn(
        "bgp", F.lit(True))


def ospf_edges(ospf: DataFrame) -> DataFrame:
    df = ospf.where("adjState = 'full' and peerHostname != ''")
    return df.select(*EDGE_KEY, "ifname", "vrf", F.col("area").cast("string").alias("area")
                     ).distinct().withColumn("ospf", F.lit(True))


def arpnd_edges(arp: DataFrame, ifs: DataFrame, macs: DataFrame) -> DataFrame:
    """Who owns the MAC of an ARP entry; the port comes from the MAC table where known."""
    vrfs = unique_by(ifs, [*NS_HOST, "ifname"], __master="master")
    owners = ifs.where("macaddr is not null and macaddr not in ('', '00:00:00:00:00:00')").select(
        "namespace", F.col("hostname").alias("peerHostname"), "macaddr").distinct()
    ports = unique_by(
        macs.where("coalesce(remoteVtepIp, '') = ''"), [*NS_HOST, "macaddr"], __port="oif")
    df = _lookup(arp.where("state != 'failed'"), vrfs, {
        "namespace": "namespace", "hostname": "hostname", "oif": "ifname"})
    df = df.withColumn("vrf", F.when(F.col("__master") == "", F.lit("default")).otherwise(
        F.col("__master")))
    df = df.join(ports, [*NS_HOST, "macaddr"], "left").join(
        owners, ["namespace", "macaddr"], "left")
    df = df.select(
        "namespace", "hostname",
        F.coalesce("peerHostname", "ipAddress").alias("peerHostname"),
        F.coalesce("__port", "oif").alias("ifname"), "vrf").distinct()
    reverse = df.select(
        "namespace", F.col("peerHostname").alias("hostname"),
        F.col("hostname").alias("peerHostname")).distinct().withColumn("arpndBidir", F.lit(True))
    return df.join(reverse, EDGE_KEY, "left").withColumns({
        "arpndBidir": F.coalesce("arpndBidir", F.lit(False)), "arpnd": F.lit(True)})


def evpn_edges(vnis: DataFrame, ifs: DataFrame) -> DataFrame:
    """VTEP to VTEP: remote VTEP addresses resolved to their owners."""
    rows = vnis.select(*NS_HOST, "vni", F.explode("remoteVtepList").alias("peerIP"))
    owners = ifs.select("namespace", "hostname", F.explode("ipAddressList").alias("__a")
                        ).withColumn("peerIP", F.substring_index("__a", "/", 1))
    owner = unique_by(owners, ["namespace", "peerIP"], peerHostname="hostname")
    return rows.join(owner, ["namespace", "peerIP"]).select(*EDGE_KEY, "vni").distinct()


def merge_edges(edges: dict[str, DataFrame]) -> DataFrame:
    """Outer natural merge: rows of the services agree on all columns they share."""
    merged = None
    for df in edges.values():
        if merged is None:
            merged = df
            continue
        shared = [c for c in merged.columns if c in df.columns]
        merged = merged.join(df, shared, "full")
    for name in SERVICES:
        if name in edges:
            merged = merged.withColumn(name, F.coalesce(name, F.lit(False)))
    if "arpndBidir" in merged.columns:
        merged = merged.withColumn("arpndBidir", F.coalesce("arpndBidir", F.lit(False)))
    vrf = F.coalesce("vrf", F.lit("N/A"))
    return merged.withColumn("vrf", F.when(vrf == "bridge", F.lit("-")).otherwise(vrf)).distinct()


def with_polled(edges: DataFrame, polled: bool | None = None) -> DataFrame:
    """Is the peer itself polled, i.e. does it have rows of its own."""
    hosts = edges.select(F.col("hostname").alias("peerHostname")).distinct().withColumn(
        "polled", F.lit(True))
    df = edges.join(hosts, "peerHostname", "left").withColumn(
        "polled", F.coalesce("polled", F.lit(False)))
    return df if polled is None else df.where(F.col("polled") == polled)


def topology(
    via: list[str], lldp: DataFrame, ifs: DataFrame, bgp: DataFrame | None = None,
    ospf: DataFrame | None = None, arp: DataFrame | None = None, macs: DataFrame | None = None,
    polled: bool | None = None, asn=None, area=None,
) -> DataFrame:
    if asn and area:
        raise ValueError("asn and area exclude each other")
    if asn and via and via != ["bgp"]:
        raise ValueError("asn needs via bgp only")
    if area and via and via != ["ospf"]:
        raise ValueError("area needs via ospf only")
    via = ["bgp"] if asn else ["ospf"] if area else via or ["lldp", "bgp", "ospf"]
    makers = {
        "lldp": lambda: lldp_edges(lldp, ifs), "bgp": lambda: bgp_edges(bgp),
        "ospf": lambda: ospf_edges(ospf), "arpnd": lambda: arpnd_edges(arp, ifs, macs),
    }
    return with_polled(merge_edges({s: makers[s]() for s in SERVICES if s in via}), polled)


def service_edges(edges: DataFrame, services: list[str]) -> DataFrame:
    """(namespace, service, src, dst), one row per edge and service that has it."""
    tags = F.explode(F.array_compact(F.array(*[
        F.when(F.col(s), F.lit(s)) for s in services])))
    return edges.select(
        "namespace", tags.alias("service"), F.col("hostname").alias("src"),
        F.col("peerHostname").alias("dst")).distinct()


# -- graph statistics -------------------------------------------------------

def undirected(edges: DataFrame, graph: list[str]) -> DataFrame:
    """Distinct edges with their ends in order."""
    return edges.select(
        *graph, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).distinct()


def directed(edges: DataFrame, graph: list[str]) -> DataFrame:
    """Every undirected edge in both directions, a self loop once."""
    flat = undirected(edges, graph)
    there = F.struct(F.col("src"), F.col("dst"))
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back))
    return flat.select(*graph, F.explode(both).alias("e")).select(*graph, "e.*")


def degrees(edges: DataFrame, graph: list[str]) -> DataFrame:
    """(graph.., node, degree, loops); a self loop counts twice in the degree."""
    ends = undirected(edges, graph).select(
        *graph, (F.col("src") == F.col("dst")).alias("loop"),
        F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy(*graph, "node").agg(
        F.count(F.lit(1)).alias("degree"), F.count(F.when(F.col("loop"), 1)).alias("loops"))


def degree_histogram(edges: DataFrame, graph: list[str]) -> DataFrame:
    """(graph.., degree, nodes)."""
    return degrees(edges, graph).groupBy(*graph, "degree").agg(
        F.count(F.lit(1)).alias("nodes"))


def graph_counts(edges: DataFrame, graph: list[str]) -> DataFrame:
    """Nodes, edges and self loops, all from the degrees."""
    def half(c):
        return F.expr(f"cast(sum({c}) div 2 as bigint)")

    return degrees(edges, graph).groupBy(*graph).agg(
        F.count(F.lit(1)).alias("number_of_nodes"), half("degree").alias("number_of_edges"),
        half("loops").alias("self_loops"))


# Estimated bytes of a table of nodes that may be broadcast.
NODE_BYTES = 1 << 20


def connected_components(edges: DataFrame, graph: list[str]) -> DataFrame:
    """(graph.., node, component): component is the smallest node name in it.

    Nodes get numbers.  Each round every node goes to the neighbour that comes first in an
    order drawn anew, or stays if it comes first itself; edges are renamed accordingly, and
    those inside one node go.  So edges and nodes shrink by a factor each round,
    long chains as well, until no edge is left.  Choices are combined before
    they are shuffled.  Tables of nodes are joined by shuffle unless they are small: their
    numbers take a few bytes in a file and many times that in a broadcast.
    """
    both = cut_lineage(directed(edges, graph))
    nodes = both.select(*graph, F.col("src").alias("node")).distinct()
    nodes = cut_lineage(nodes.withColumn("id", F.monotonically_increasing_id()))

    def number(end: str) -> DataFrame:
        return shuffle_if_large(
            nodes.select(*graph, F.col("node").alias(end), F.col("id").alias(f"__{end}")), NODE_BYTES)

    live = cut_lineage(both.where("src != dst").join(number("src"), [*graph, "src"]).join(
        number("dst"), [*graph, "dst"]).select(
        F.col("__src").alias("src"), F.col("__dst").alias("dst")))
    steps = []
    while live.limit(1).count():
        turn = F.lit(len(steps))
        best = live.groupBy("src").agg(
            F.min_by("dst", F.xxhash64(turn, "dst")).alias("to"),
            F.min(F.xxhash64(turn, "dst")).alias("first"))
        step = cut_lineage(best.select(F.col("src").alias("id"), F.when(
            F.col("first") < F.xxhash64(turn, "src"), F.col("to")).otherwise(
            F.col("src")).alias("to")))
        steps.append(step)
        for end in ("src", "dst"):
            live = live.join(shuffle_if_large(
                step.select(F.col("id").alias(end), F.col("to").alias(f"__{end}")), NODE_BYTES), end)
        live = cut_lineage(live.where("__src != __dst").select(
            F.col("__src").alias("src"), F.col("__dst").alias("dst")).distinct())
    # Where each node ends: from the last round, which has the fewest nodes, back to the first.
    ends = None
    for step in reversed(steps):
        if ends is None:
            ends = step.select("id", F.col("to").alias("root"))
            continue
        later = ends.select(F.col("id").alias("to"), "root")
        ends = step.join(shuffle_if_large(later, NODE_BYTES), "to", "left").select("id", F.coalesce("root", "to").alias("root"))
    if ends is None:
        return nodes.select(*graph, "node", F.col("node").alias("component"))
    named = nodes.join(shuffle_if_large(ends, NODE_BYTES), "id", "left").select(
        *graph, "node", F.coalesce("root", "id").alias("root"))
    named = cut_lineage(named)
    least = named.groupBy("root").agg(F.min("node").alias("component"))
    return named.join(shuffle_if_large(least, NODE_BYTES), "root").select(*graph, "node", "component")


def component_counts(components: DataFrame, graph: list[str]) -> DataFrame:
    sets = components.groupBy(*graph).agg(
        F.countDistinct("component").alias("number_of_disjoint_sets"))
    return sets.withColumn("is_fully_connected", F.col("number_of_disjoint_sets") == 1)


WORDS = 8
BITS = 63 * WORDS
# Nodes that one task numbers, levels whose sums are added up at once.
NUMBERED, LEVELS = 50_000, 16
# Edges of a graph that a task may hold, of several small graphs together, and sources of a task.
HELD_EDGES, PACK_EDGES, SOURCES = 4_000_000, 1_000_000, 4_096


def distance_sums(edges: DataFrame, graph: list[str]) -> DataFrame:
    """(graph.., node, total): sum of shortest distances to all reachable nodes.

    Breadth-first search from all nodes.  A graph of at most ``HELD_EDGES`` edges (each
    counted both ways) is held by a task as numbers, small graphs together, and every
    task searches from its share of the sources; larger graphs are searched level by level
    over tables.  Nodes whose names sort together are searched from together, which often
    brings searches of one region together; sums do not depend on it.
    """
    both = cut_lineage(directed(edges, graph))
    nodes = cut_lineage(both.select(*graph, F.col("src").alias("node")).dropna().distinct())
    parts = nodes.count() // NUMBERED + 1
    # Graphs too large to be held have no pack.
    sizes = cut_lineage(both.groupBy(*graph).agg(F.count(F.lit(1)).alias("__edges")))
    held = sizes.where(F.col("__edges") <= HELD_EDGES).agg(F.sum("__edges")).first()[0] or 0
    pack = F.when(F.col("__edges") <= HELD_EDGES, F.pmod(
        F.xxhash64(*graph, F.lit(0)), F.lit(held // PACK_EDGES + 1)))
    sized = nodes.join(sizes, graph) if graph else nodes.crossJoin(sizes)
    nodes = cut_lineage(sized.withColumn("pack", pack).drop("__edges").repartitionByRange(
        parts, *graph, "node").sortWithinPartitions(*graph, "node").withColumn(
        "id", F.monotonically_increasing_id()))

    def number(end: str, *more: str) -> DataFrame:
        return nodes.select(
            *graph, F.col("node").alias(end), F.col("id").alias(f"__{end}"), *more)

    links = cut_lineage(both.where("src != dst").join(number("src", "pack"), [*graph, "src"]).join(
        number("dst"), [*graph, "dst"]).select(
        F.col("__src").alias("id"), F.col("__dst").alias("to"), "pack"))
    # Nodes without an edge to another have a sum of zero.
    sums = nodes.select("id", F.lit(0).cast("bigint").alias("total"))
    if held:
        sums = sums.unionByName(_held_sums(links.where("pack is not null")))
    apart = nodes.where("pack is null").select("id")
    if apart.limit(1).count():
        sums = sums.unionByName(_searched_sums(
            apart, links.where("pack is null").select("id", "to")))
    return nodes.join(_added(sums, []), "id").select(*graph, "node", "total")


def _held_sums(links: DataFrame) -> DataFrame:
    """(id, total), several rows of a node: sums over the sources of each task.

    ``links`` (id, to, pack) has each edge both ways.  A task holds a pack's edges and,
    for each node, a bit per source that has reached it.
    """
    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(rows["id"].to_numpy("<i8"))
        a = np.searchsorted(ids, rows["id"].to_numpy("<i8")).astype("<i4")
        b = np.searchsorted(ids, rows["to"].to_numpy("<i8")).astype("<i4")
        order = np.lexsort((b, a))
        starts = np.searchsorted(a[order], np.arange(len(ids) + 1)).astype("<i8")
        return pd.DataFrame({"n": [len(ids)], "ids": [ids.tobytes()],
                             "starts": [starts.tobytes()], "to": [b[order].tobytes()]})

    def edges_of(at, starts):
        """Places of all edges of nodes, and where those of each node begin."""
        size = starts[at + 1] - starts[at]
        begin = np.cumsum(size) - size
        return np.repeat(starts[at] - begin, size) + np.arange(size.sum()), begin

    def sums_from(first, last, starts, to, words=4):
        n, total = len(starts) - 1, np.zeros(len(starts) - 1, np.int64)
        fresh, seen = np.zeros((n, words), np.uint64), np.zeros((n, words), np.uint64)
        for slot in range(first, last, 64 * words):
            live = np.arange(slot, min(last, slot + 64 * words))
            seen[:] = 0
            fresh[live, (live - slot) // 64] = np.uint64(1) << ((live - slot) % 64).astype(np.uint64)
            seen[live] = fresh[live]
            level = 0
            while len(live):
                level += 1
                met = to[edges_of(live, starts)[0]]
                if len(met) * 16 < n:
                    met = np.unique(met)
                else:
                    mark = np.zeros(n, bool)
                    mark[met] = True
                    met = np.flatnonzero(mark)
                place, begin = edges_of(met, starts)
                new = np.bitwise_or.reduceat(fresh[to[place]], begin, axis=0) & ~seen[met]
                fresh[live] = 0
                some = new.any(axis=1)
                live, new = met[some], new[some]
                fresh[live] = new
                seen[live] |= new
                total[live] += level * np.bitwise_count(new).sum(axis=1, dtype=np.int64)
        return total

    sources = SOURCES

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], "<i8")
                first = row["piece"] * sources
                total = sums_from(first, min(len(ids), first + sources),
                                  np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["to"], "<i4"))
                for at in range(0, len(ids), 65_536):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at:at + 65_536]), pa.array(total[at:at + 65_536])],
                        names=["id", "total"])

    packs = cut_lineage(links.groupBy("pack").applyInPandas(
        packed, "n long, ids binary, starts binary, to binary"))
    last = F.floor((F.col("n") - 1) / sources)
    tasks = packs.agg(F.sum(last + 1)).first()[0] or 1
    pieces = packs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return pieces.repartition(min(int(tasks), 1 << 12)).mapInArrow(search, "id long, total long")


def _searched_sums(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, total) of graphs of any size: all searches advance together, level by level.

    ``BITS`` sources make a slot; a row is a node and a slot with a bit for each source
    that has just reached it, so rows stand only where a search goes on.  A level is one
    join on edges and one bitwise OR.  Edges run both ways: what arrives at a node was
    there at this level or the one before, or is new, so no more than two levels are kept.
    """
    words, old = [f"x{i}" for i in range(WORDS)], [f"p{i}" for i in range(WORDS)]
    none = F.lit(0).cast("bigint")
    # Ids count up in each part from a multiple of 2^33.
    place = F.expr(f"(id & {(1 << 33) - 1}) % {BITS}")

    def bit(i):
        at = (F.col("place") - 63 * i).cast("int")
        return F.when(at.between(0, 62), F.call_function(
            "shiftleft", F.lit(1).cast("bigint"), at)).otherwise(none)

    def held(df: DataFrame) -> DataFrame:
        return df.select("id", "slot", *[none.alias(w) for w in words],
                         *[F.col(w).alias(p) for w, p in zip(words, old)])

    def weighed(df: DataFrame, level: int) -> DataFrame:
        count = reduce(lambda a, c: a + c, [F.bit_count(w) for w in words])
        return df.select("id", (count * F.lit(level).cast("bigint")).alias("total"))

    fresh = cut_lineage(nodes.select("id", place.alias("place")).select(
        "id", (F.col("id") - F.col("place")).alias("slot"),
        *[bit(i).alias(w) for i, w in enumerate(words)]))
    sums = nodes.select("id", none.alias("total"))
    before, found, level = fresh.limit(0), [], 0
    while fresh.limit(1).count():
        level += 1
        sent = fresh.join(links.hint("merge"), "id").select(
            F.col("to").alias("id"), "slot", *words, *[none.alias(p) for p in old])
        met = sent.unionByName(held(fresh)).unionByName(held(before)).groupBy("id", "slot").agg(
            *[F.bit_or(c).alias(c) for c in [*words, *old]])
        new = met.select("id", "slot", *[
            F.col(w).bitwiseAND(F.bitwise_not(p)).alias(w) for w, p in zip(words, old)])
        before, fresh = fresh, cut_lineage(
            new.where(reduce(lambda a, c: a | c, [F.col(w) != 0 for w in words])))
        found.append(weighed(fresh, level))
        if len(found) == LEVELS:
            sums = cut_lineage(_added(sums, found))
            found = []
    return _added(sums, found)


def _added(sums: DataFrame, found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found, sums).groupBy("id").agg(
        F.sum("total").cast("bigint").alias("total"))


def centers(edges: DataFrame, graph: list[str], components: DataFrame | None = None) -> DataFrame:
    """Nodes with the smallest distance sum, of connected graphs only."""
    components = components if components is not None else connected_components(edges, graph)
    whole = component_counts(components, graph).where("is_fully_connected").select(*graph)
    sums = distance_sums(edges.join(whole, graph, "left_semi"), graph)
    least = sums.groupBy(*graph).agg(F.min("total").alias("least"))
    return sums.join(least, graph).where("total = least").select(*graph, "node", "total")


def summarize_topology(edges: DataFrame, services: list[str]) -> DataFrame:
    """One row per namespace and service with all graph statistics.

    The degree histogram is an array by degree; its length is the largest
    degree plus one.
    """
    graph = ["namespace", "service"]
    flat = cut_lineage(service_edges(edges, services))
    counts = graph_counts(flat, graph)
    hist = degree_histogram(flat, graph)
    packed = hist.groupBy(*graph).agg(
        F.max("degree").alias("__max"),
        F.map_from_entries(F.collect_list(F.struct("degree", "nodes"))).alias("__by"))
    packed = packed.select(*graph, F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("__max")),
        lambda d: F.coalesce(F.try_element_at(F.col("__by"), d), F.lit(0))
    ).alias("degree_histogram"))
    parts = connected_components(flat, graph)
    middle = centers(flat, graph, parts).groupBy(*graph).agg(
        F.array_sort(F.collect_list("node")).alias("center"))
    return counts.join(component_counts(parts, graph), graph).join(packed, graph).join(
        middle, graph, "left")
