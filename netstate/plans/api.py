"""The user-facing object: tables, verbs and filters over one store."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession, functions as F

from netstate.catalog import UNIQUE_DEFAULT, table_spec
from netstate.functions import register_sql_functions, timefn
from netstate.operators import (
    asserts, filters, locate, lpm, path as paths, projection, topology as topo, verbs,
)
from netstate.plans import getters, summaries
from netstate.plans.getters import Scope
from netstate.session import clear_lineage, cut_lineage
from netstate.sources.read import Store


class NetState:
    """``NetState(spark, root).get('routes', namespace=['dc1'], prefixlen='>24')``.

    ``get``, ``unique``, ``top`` and ``histogram`` return lazy DataFrames; calls that
    read their rows several times or in rounds (``summarize``, ``assert_``,
    ``find``, ``path``, ``topology``) work out intermediate tables first, which
    ``close`` deletes.  ``view``, ``start`` and ``end`` (ISO text in ``tz``, or epoch
    ms) may be given here or per call.
    """

    def __init__(self, spark: SparkSession, root: str | None = None,
                 frames: dict[str, DataFrame] | None = None, view: str | None = None,
                 start=None, end=None, tz: str = "UTC", namespace=(), period: str = "1h"):
        self.spark, self.tz = spark, tz
        self.store = Store(spark, root, frames, period)
        self.view, self.start, self.end = view, start, end
        self.namespace = tuple(filters.as_list(namespace))
        register_sql_functions(spark)

    def scope(self, view=None, start=None, end=None) -> Scope:
        return Scope(
            self.store, view or self.view, timefn.to_epoch_ms(start or self.start, self.tz),
            timefn.to_epoch_ms(end or self.end, self.tz), self.namespace)

    def close(self) -> int:
        """Delete the intermediate tables of this session; results read from them are gone."""
        return clear_lineage(self.spark)

    # -- generic verbs --

    def get(self, table: str, columns=("default",), query_str: str = "", view=None, start=None,
            end=None, **fields) -> DataFrame:
        scope = self.scope(view, start, end)
        wants = {c for c in filters.as_list(columns)}
        asked = filters.predicate_names(query_str)
        if table == "macs" and ("moveCount" in wants | asked or wants == {"*"}):
            fields.setdefault("moves", True)
        if table == "interfaces" and "modes" not in fields:
            names = set(projection.field_names(table, columns)) | asked
            fields["modes"] = bool(names & {"portmode", "vlanList", "vlan"})
        df = filters.filter_query(getters.get(scope, table, **fields), query_str)
        names = projection.field_names(table, columns)
        return projection.add_active(df, names, scope.view, scope.start, scope.end)

    show = get

    def summarize(self, table: str, view=None, start=None, end=None, query_str: str = "",
                  **fields) -> DataFrame:
        if table == "macs":
            fields.setdefault("moves", "moveCount" in filters.predicate_names(query_str))
        df = filters.filter_query(
            getters.get(self.scope(view, start, end), table, **fields), query_str)
        # A sheet makes several passes over its rows; the view is worked out once.
        return summaries.SHEETS.get(table, summaries.generic)(cut_lineage(df))

    def unique(self, table: str, columns=None, count: bool = False, query_str: str = "",
               view=None, start=None, end=None, **fields) -> DataFrame:
        names = filters.as_list(columns) or [UNIQUE_DEFAULT.get(table, "hostname")]
        if len(names) != 1:
            raise verbs.VerbError("unique takes one column")
        column = names[0]
        if table == "address" and column == "ipAddress":
            column = {"v4": "ipAddressList", "v6": "ip6AddressList"}.get(
                fields.get("ipvers", ""), column)
        df = self.get(table, [column], view=view, start=start, end=end, **fields)
        return verbs.unique(df, column, count, query_str)

    def top(self, table: str, what: str, count: int = 5, reverse: bool = False,
            columns=("default",), view=None, start=None, end=None, **fields) -> DataFrame:
        spec = table_spec(table)
        shown = projection.field_names(table, columns)
        if what not in shown:
            shown = [*shown[:-1], what, *shown[-1:]]
        if table == "tables":
            listing = getters.tables(self.scope(view, start, end))
            return verbs.top_with_ties(listing, what, count, reverse)
        if table == "macs" and what == "moveCount":
            fields.setdefault("moves", True)
        df = getters.get(self.scope(view, start, end), table, **fields)
        return verbs.top(df, what, spec.keys, count, reverse,
                         [c for c in shown if c in df.columns])

    def histogram(self, table: str, column: str, **kw) -> DataFrame:
        return verbs.histogram(self.get(table, [column], **kw), column)

    # -- assertions --

    def assert_(self, table: str, result: str = "all", view=None, start=None, end=None,
                what: str = "", value=(), ignore_missing_peer: bool = False,
                check_her: bool = False, state=None, type=None, **fields) -> DataFrame:
        scope = self.scope(view, start, end)
        near = {k: v for k, v in fields.items() if k == "namespace"}
        if table == "interfaces" and what == "mtu-value":
            df = getters.interfaces(scope, modes=False, state=state, type=type, **fields)
            return asserts.assert_mtu(df, [int(v) for v in filters.as_list(value)], result)
        if table == "interfaces":
            out = asserts.assert_interfaces(
                cut_lineage(getters.interfaces(scope, type=["all"], **near)),
                getters.lldp(scope, **near),
                getters.base(scope, "mlag", **near), "all", ignore_missing_peer,
                filters.as_list(type) or None, state or "up")
        elif table == "bgp":
            out = asserts.assert_bgp(
                cut_lineage(getters.bgp(scope, **near)), getters.base(scope, "interfaces", **near), "all",
                state or "!dynamic")
        elif table == "ospf":
            out = asserts.assert_ospf(
                cut_lineage(getters.ospf(scope, **near)), getters.base(scope, "interfaces", **near), "all")
        elif table == "evpnVni":
            svis = getters.address(scope, type=["vlan"], **near)
            out = asserts.assert_evpn(
                cut_lineage(getters.evpnVni(scope, **near)), svis, "all",
                getters.base(scope, "macs", **near) if check_her else None)
        else:
            raise verbs.VerbError(f"no assertions for {table}")
        out = filters.filter_fields(out, **fields)
        if result == "all":
            return out
        if result not in ("pass", "fail"):
            raise filters.FilterError(f"unknown result filter: {result!r}")
        if table == "bgp":
            return out.where(F.col("assertReason") != "-" if result == "fail"
                             else F.col("assertReason") == "-")
        return out.where(F.col("result") == result)

    aver = assert_

    # -- routes, endpoints, paths, topology --

    def lpm(self, address: str, view=None, start=None, end=None, columns=("default",),
            **fields) -> DataFrame:
        ipaddress.ip_address(address)
        df = lpm.lpm(getters.routes(self.scope(view, start, end), **fields), address)
        return df.select(*[c for c in projection.field_names("routes", columns)
                           if c in df.columns])

    def lpm_join(self, addresses: DataFrame, address: str = "address", scope_columns=None,
                 view=None, start=None, end=None, **fields) -> DataFrame:
        """Best route of each address, by default in the namespace, host and VRF it names."""
        if scope_columns is None:
            scope_columns = [c for c in ("namespace", "hostname", "vrf")
                             if c in addresses.columns]
        return lpm.lpm_join(
            addresses, getters.routes(self.scope(view, start, end), **fields), address,
            tuple(scope_columns))

    def find(self, addresses, view=None, start=None, end=None, vlan=None, vrf=None,
             **near) -> DataFrame:
        scope = self.scope(view, start, end)
        if not isinstance(addresses, DataFrame):
            words = locate.check_queries(filters.as_list(addresses))
            addresses = self.spark.createDataFrame([(w,) for w in words], "address string")
        now = scope.now()
        current = {"interfaces": getters.base(now, "interfaces", **near),
                   "macs": getters.base(now, "macs", **near)}
        if scope.past():
            # Interfaces may have been stable since long before the window.
            old = Scope(self.store, "all", None, scope.end, scope.namespace)
            return locate.find(
                addresses, getters.base(scope, "arpnd", **near),
                getters.base(old, "interfaces", **near), getters.base(old, "macs", **near),
                getters.lldp(now, **near), True, vlan, vrf, current)
        return locate.find(
            addresses, getters.base(scope, "arpnd", **near), current["interfaces"],
            current["macs"], getters.lldp(now, **near), False, vlan, vrf)

    def path_tables(self, view=None, start=None, end=None, **near) -> paths.PathTables:
        scope = self.scope(view, start, end)
        return paths.PathTables(
            getters.interfaces(scope, type=["all"], modes=False, **near),
            getters.routes(scope, **near), getters.base(scope, "arpnd", **near),
            getters.base(scope, "macs", **near), getters.base(scope, "mlag", **near))

    def path(self, requests=None, namespace: str = "", src: str = "", dest: str = "",
             vrf: str = "", tables: paths.PathTables | None = None, **times) -> DataFrame:
        """Trace one request or a DataFrame of them (req, namespace, src, dest[, vrf])."""
        if requests is None:
            if ipaddress.ip_address(src).version != ipaddress.ip_address(dest).version:
                raise paths.PathError("source and destination are of different families")
            requests = self.spark.createDataFrame(
                [("1", namespace, src, dest, vrf)],
                "req string, namespace string, src string, dest string, vrf string")
        return paths.path(requests, tables or self.path_tables(**times))

    def path_summary(self, **kw) -> DataFrame:
        return paths.path_summary(self.path(**kw))

    def topology(self, via=(), polled: bool | None = None, asn=None, area=None, view=None,
                 start=None, end=None, namespace=(), **fields) -> DataFrame:
        scope = self.scope(view, start, end)
        near = {"namespace": namespace} if namespace else {}
        wanted = filters.as_list(via) or (
            ["bgp"] if asn else ["ospf"] if area else ["lldp", "bgp", "ospf"])
        ifs = cut_lineage(getters.interfaces(scope, state="up", modes=False, **near))
        edges = topo.topology(
            filters.as_list(via), getters.lldp(scope, **near), ifs,
            getters.bgp(scope, **near) if "bgp" in wanted else None,
            getters.ospf(scope, **near) if "ospf" in wanted else None,
            getters.base(scope, "arpnd", **near) if "arpnd" in wanted else None,
            getters.base(scope, "macs", **near) if "arpnd" in wanted else None,
            polled, asn, area)
        return filters.filter_fields(edges, asn=asn, area=area, **fields)

    def topology_summary(self, via=(), **kw) -> DataFrame:
        edges = self.topology(via, **kw)
        services = [s for s in topo.SERVICES if s in edges.columns]
        return topo.summarize_topology(edges, services)

    # -- overviews --

    def status(self, table: str, **kw) -> DataFrame:
        return verbs.status_counts(getters.get(self.scope(**kw), table), table)

    def poll_freshness(self, **kw) -> DataFrame:
        return verbs.poll_freshness(getters.sqPoller(self.scope(**kw)))

    def failures(self, **kw) -> DataFrame:
        scope, stored = self.scope(**kw), self.store.tables()
        needs = {"device": "device", "interfaces": "interfaces", "mlag": "mlag",
                 "ospf": "ospfIf", "bgp": "bgp"}
        found = {}
        for table, physical in needs.items():
            if physical in stored:
                extra = {"modes": False} if table == "interfaces" else {}
                found[table] = getters.get(scope, table, **extra)
        return verbs.failures(found)

    def search(self, terms: DataFrame, **kw) -> DataFrame:
        scope, stored = self.scope(**kw), self.store.tables()
        found = {}
        for table, _ in filters.SEARCH_COLUMNS.values():
            physical = table_spec(table).physical or table
            if physical in stored:
                extra = {"modes": False} if table == "interfaces" else {}
                found[table] = getters.get(scope, table, **extra)
        return filters.search(terms, found)

    def natural(self, df: DataFrame, table: str) -> DataFrame:
        """Presentation order of a result."""
        keys = [k for k in table_spec(table).keys if k in df.columns]
        return verbs.natural_sort(df, keys, "active" in df.columns)

    def humanize(self, df: DataFrame) -> DataFrame:
        return projection.humanize(df, self.tz)
