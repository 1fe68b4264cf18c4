"""How each table is read: which filters wait, which other tables complete it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from netstate.catalog import table_spec
from netstate.operators import config, enrich, filters, lpm, ordered, projection, summary, views
from netstate.sources.read import Store, view_table

# ---------------------------------------------------------------------------
# Poller status codes and their meaning.
# ---------------------------------------------------------------------------
POLL_STATUS = {
    0: "OK", 200: "OK", 1001: "Permission Denied", 1002: "Unauthorized", 1003: "Login Failed",
    1004: "Privilege Escalation Failed", 2006: "Command Not Found", 2007: "Output Empty",
    2008: "Command Incomplete", 2009: "Command Timeout", 2010: "Feature Disabled",
    2011: "Connect Failed", 2012: "Parsing Failed", 2013: "Service Not Supported",
    2014: "Command Not Supported", 2015: "No Route to Host", 2016: "Variable Not Set",
    2017: "Variable Waiting", 2018: "Command Failed", 2019: "Linux Cmd Failed",
    2020: "Network Unreachable", 2021: "Service Not Defined", 2022: "Unknown Failure",
    2023: "Connection Refused", 2024: "Unexpected Disconnect", 1: "Command Not Found",
    16: "Command Not Found", 20: "Command Not Found", 127: "Command Not Found",
    204: "Empty Output", 244: "Empty Output", 400: "Incomplete Command", 401: "Login Failed",
    404: "Command Not Found", 405: "Incomplete Command", 408: "Timeout",
    418: "Feature Disabled", 502: "Parsing Error", -1: "Privilege Escalation Failed",
}


@dataclass(frozen=True)
class Scope:
    """A store and the time view all tables of one query share."""

    store: Store
    view: str | None = None
    start: int | None = None
    end: int | None = None
    namespace: tuple = ()

    def now(self) -> Scope:
        """The same end of time without a start: state that may be older than the window."""
        return replace(self, start=None, view="latest")

    def past(self) -> bool:
        return views.shows_active(self.view, self.start, self.end)


def base(scope: Scope, table: str, only_active: bool = True, stage: str = "post",
         **fields) -> DataFrame:
    if scope.namespace and not fields.get("namespace"):
        fields["namespace"] = list(scope.namespace)
    if fields.get("macaddr"):
        fields["macaddr"] = canonical_macs(fields["macaddr"])
    log = scope.store.log(table, scope.start, scope.end, scope.view)
    return view_table(log, table, scope.view, scope.start, scope.end, ("*",), stage,
                      only_active, **fields)


def _keys(fields: dict, *names: str) -> dict:
    return {k: fields[k] for k in names if fields.get(k)}


def _rest(df: DataFrame, fields: dict, *done: str) -> DataFrame:
    return filters.filter_fields(df, **{k: v for k, v in fields.items() if k not in done})


def simple(scope: Scope, table: str, **fields) -> DataFrame:
    return projection.with_derived(base(scope, table, **fields), table)


# -- tables of their own rows -----------------------------------------------

def arpnd(scope: Scope, prefix=None, **fields) -> DataFrame:
    df = base(scope, "arpnd", **fields)
    return df.where(filters.match_subnets("ipAddress", prefix)) if prefix else df


def routes(scope: Scope, prefix=None, prefixlen=None, **fields) -> DataFrame:
    df = base(scope, "routes", **fields)
    if prefix:
        df = df.where(lpm.prefix_filter(filters.as_list(prefix)))
    df = lpm.routes_view(df)
    if prefixlen not in (None, ""):
        df = df.where(filters.match_prefixlen(str(prefixlen)))
    return df


def vlan(scope: Scope, **fields) -> DataFrame:
    df = base(scope, "vlan")
    df = projection.merge_fields(df, {"ifname": "vlanName"})
    return filters.filter_fields(df, **fields)


def macs(scope: Scope, moveCount=None, local: bool = False, moves: bool = False,  # noqa: N803
         move_window_ms: int | None = None, remoteVtepIp=None, vlan=None,  # noqa: N803
         **fields) -> DataFrame:
    if not (moves or moveCount):
        df = base(scope, "macs", **fields)
    else:
        keyed = _keys(fields, "namespace", "hostname", "macaddr", "mackey")
        log = filters.apply_filter(
            scope.store.log("macs", scope.start, scope.end, "all"),
            filters.table_filter("macs", **keyed))
        df = move_count(log, scope, move_window_ms)
        df = _rest(df, fields, *keyed)
        if moveCount:
            df = filters.apply_filter(df, filters.match_number("moveCount", moveCount))
    if vlan:
        df = filters.apply_filter(df, filters.match_number("vlan", vlan))
    if filters.as_list(remoteVtepIp) == ["any"]:
        df = df.where(filters.match_mac_locality(remote=True))
    elif remoteVtepIp:
        df = filters.filter_fields(df, remoteVtepIp=remoteVtepIp)
    return df.where(filters.match_mac_locality(remote=False)) if local else df


def move_count(log: DataFrame, scope: Scope | None = None,
               window_ms: int | None = None) -> DataFrame:
    """Add ``moveCount``: how often a MAC changed its port or VTEP.

    History views count on every row, the latest view keeps the newest row of
    every MAC.  With a window only moves in the time before the newest row of
    the table count.
    """
    key = ["namespace", "hostname", "mackey", "macaddr"]
    start, end = (scope.start, scope.end) if scope else (None, None)
    past = scope.past() if scope else True
    df = views.dedup_key_time(filters.filter_time(log, start, end), key)
    recent = F.lit(True)
    if not past and window_ms is not None:
        newest = df.agg(F.max("timestamp")).first()[0]
        if newest is not None:
            recent = F.col("timestamp") > newest - window_ms
    port = F.concat(F.coalesce("oif", F.lit("")), F.lit("-"),
                    F.coalesce("remoteVtepIp", F.lit("")))
    moved = F.when(
        recent & F.col("__before").isNotNull() & (F.col("__before") != port), 1).otherwise(0)

    def count(part: DataFrame, **how) -> DataFrame:
        seen = ordered.previous_value(part, key, "timestamp", {"__before": port}, **how)
        return ordered.running_sum(
            seen.withColumn("__moved", moved), key, "timestamp", F.col("__moved"), "moveCount",
            **how).drop("__before", "__moved")

    df = ordered.by_heat(
        df, key, ordered.HOT_ROWS, ordered.HOUR_MS,
        lambda part: count(part, chunk_ms=None), lambda part: count(part, hot_rows=0))
    if past:
        return df
    return filters.active_only(views.latest(df, key))


def sqPoller(scope: Scope, status: str = "", pollExcdPeriodCount: str = "",  # noqa: N802, N803
             **fields) -> DataFrame:
    df = base(scope, "sqPoller", **fields)
    if status:
        df = df.where(filters.match_poll_status(status))
    if pollExcdPeriodCount:
        df = df.where(filters.match_excess_periods(pollExcdPeriodCount))
    codes = F.create_map(*[F.lit(x) for kv in POLL_STATUS.items() for x in kv])
    return df.withColumn("statusStr", F.coalesce(
        F.try_element_at(codes, F.col("status").cast("int")), F.col("status").cast("string")))


# -- tables completed from others -------------------------------------------

def address(scope: Scope, address=None, prefix=None, ipvers: str = "", vrf=None,
            **fields) -> DataFrame:
    df = projection.with_derived(base(scope, "address", **fields), "address")
    have4, have6 = F.size("ipAddressList") > 0, F.size("ip6AddressList") > 0
    df = df.where(have4 | have6)
    if vrf:
        df = filters.apply_filter(df, filters.match_text("vrf", vrf))
    if address:
        df = df.where(filters.match_address(address))
    elif prefix:
        v4 = [p for p in filters.as_list(prefix) if ":" not in p]
        v6 = [p for p in filters.as_list(prefix) if ":" in p]
        terms = [filters.match_subnets(c, ps, is_list=True) for c, ps in (
            ("ipAddressList", v4), ("ip6AddressList", v6)) if ps]
        df = df.where(terms[0] if len(terms) == 1 else terms[0] | terms[1])
    wanted = {"v4": have4, "v6": have6, "l2": F.length("macaddr") > 0}
    return df.where(wanted[ipvers]) if ipvers in wanted else df


def device(scope: Scope, status=None, version=None, ignore_neverpoll: bool = False,
           **fields) -> DataFrame:
    # Host filters wait: a poller row may name a device by the address of another row.
    keyed = _keys(fields, "namespace")
    known = base(scope, "device", only_active=False, **keyed)
    if ignore_neverpoll or scope.past():
        df = known if scope.past() else known.withColumn("status", F.when(
            F.col("active"), F.col("status")).otherwise(F.lit("dead")))
    else:
        failed = sqPoller(scope, status="fail", service="device",
                          **_keys(fields, "namespace"))
        df = enrich.device_status(known, failed)
    df = _rest(projection.with_derived(df, "device"), fields, *keyed)
    if status:
        df = filters.apply_filter(df, filters.match_text("status", status))
    return df.where(filters.match_version(version)) if version else df


def devconfig(scope: Scope, section: str | None = None, **fields) -> DataFrame:
    df = base(scope, "devconfig", **fields)
    if not section:
        return df
    systems = device(scope.now(), ignore_neverpoll=True).select("namespace", "hostname", "os")
    return config.config_sections(df.join(systems, ["namespace", "hostname"]), section,
                                  system="os").drop("os")


def port_modes(scope: Scope) -> DataFrame:
    systems = device(scope.now(), ignore_neverpoll=True).select("namespace", "hostname", "os")
    return config.switchport_modes(
        base(scope.now(), "devconfig").join(systems, ["namespace", "hostname"], "left"))


def interfaces(scope: Scope, state=None, type=None, ifname=None, vrf=None, master=None,
               bond=None, vlan=None, portmode=None, macaddr=None, modes: bool = True,
               **fields) -> DataFrame:
    """``modes=False`` leaves out port modes and VLAN lists (and the tables they need)."""
    owners = [*filters.as_list(master), *filters.as_list(vrf), *filters.as_list(bond)]
    if ifname:
        fields["ifname"] = ifname
    if owners:
        fields["master"] = owners
    df = base(scope, "interfaces", **fields)
    df = filters.apply_filter(df, filters.match_interface_type(type, ifname))
    if modes or vlan or portmode:
        df = enrich.interfaces_portmode(df, port_modes(scope))
        df = enrich.interfaces_vlanlist(df, globals()["vlan"](scope.now()))
    df = filters.filter_fields(df, state=state, portmode=portmode)
    if macaddr:
        df = filters.apply_filter(df, filters.match_text("macaddr", canonical_macs(macaddr)))
    return df.where(filters.match_vlan(vlan)) if vlan else df


def lldp(scope: Scope, use_bond: bool = False, **fields) -> DataFrame:
    keyed = _keys(fields, "namespace", "hostname", "ifname")
    ifs = base(scope.now(), "interfaces", **_keys(fields, "namespace"))
    df = enrich.lldp_resolve(base(scope, "lldp", **keyed), ifs)
    df = enrich.strip_fqdn(df, base(scope.now(), "lldp"))
    if use_bond:
        df = enrich.lldp_to_bond(df, ifs)
    return _rest(df, fields, *keyed)


def bgp(scope: Scope, vrf=None, peer=None, hostname=None, afiSafi=None,  # noqa: N803
        **fields) -> DataFrame:
    df = base(scope, "bgp", **fields)
    df = df.withColumn("peer", F.when(
        F.coalesce("origPeer", F.lit("")) != "", F.col("origPeer")).otherwise(F.col("peer")))
    df = projection.with_derived(enrich.bgp_peer_match(df), "bgp")
    return filters.filter_fields(df, vrf=vrf, peer=peer, hostname=hostname, afiSafi=afiSafi)


def ospf(scope: Scope, state: str = "", hostname=None, names: bool = True,
         **fields) -> DataFrame:
    keyed = _keys(fields, "namespace", "vrf", "ifname")
    df = enrich.ospf_combined(base(scope, "ospfIf", **keyed), base(scope, "ospfNbr", **keyed))
    if names:
        near = lldp(scope, use_bond=True, **_keys(fields, "namespace"))
        owners = base(scope.now(), "interfaces", **_keys(fields, "namespace"))
        df = enrich.ospf_peernames(df, near, owners)
    if state:
        df = df.where(filters.match_ospf_state(state))
    df = filters.filter_fields(df, hostname=hostname)
    return _rest(df, fields, *keyed)


def evpnVni(scope: Scope, **fields) -> DataFrame:  # noqa: N802
    keyed = _keys(fields, "namespace", "hostname", "vni")
    near = _keys(fields, "namespace")
    df = enrich.evpn_enrich(
        base(scope, "evpnVni", **keyed), base(scope.now(), "interfaces", **near),
        base(scope, "macs", **near))
    return _rest(projection.with_derived(df, "evpnVni"), fields, *keyed)


def inventory(scope: Scope, **fields) -> DataFrame:
    keyed = _keys(fields, "namespace", "hostname")
    df = enrich.inventory_ifnames(base(scope, "inventory", **keyed),
                                  base(scope.now(), "interfaces", **keyed))
    return _rest(df, fields, *keyed)


def namespace(scope: Scope, os=None, model=None, vendor=None, version=None,
              **fields) -> DataFrame:
    devices = device(scope, os=os, model=model, vendor=vendor, version=version,
                     **_keys(fields, "namespace"))
    stored = scope.store.tables()
    protocols = {}
    if {"ospfIf"} & set(stored):
        protocols["ospf"] = base(scope, "ospfIf")
    for table in ("bgp", "evpnVni", "mlag"):
        if table in stored:
            protocols[table] = base(scope, table)
    df = enrich.namespace_rollup(devices, sqPoller(scope), protocols)
    return _rest(df, fields, "namespace")


def tables(scope: Scope) -> DataFrame:
    """Extent of every stored table, with a TOTAL row."""
    parts = [
        views.table_info(_with_host(scope.store.log(t, scope.start, scope.end, "all"))).select(
            F.lit(t).alias("table"), "*")
        for t in scope.store.tables()]
    listing = parts[0]
    for p in parts[1:]:
        listing = listing.unionByName(p)
    return summary.with_total(listing.where("allRows > 0"))


def _with_host(df: DataFrame) -> DataFrame:
    return projection.fill_missing_columns(df, {"hostname": "string"})


GETTERS = {
    "arpnd": arpnd, "routes": routes, "vlan": vlan, "macs": macs, "sqPoller": sqPoller,
    "address": address, "device": device, "devconfig": devconfig, "interfaces": interfaces,
    "lldp": lldp, "bgp": bgp, "ospf": ospf, "evpnVni": evpnVni, "inventory": inventory,
    "namespace": namespace, "tables": tables,
}


def get(scope: Scope, table: str, **fields) -> DataFrame:
    table_spec(table)
    if table in GETTERS:
        return GETTERS[table](scope, **fields)
    return simple(scope, table, **fields)


def canonical_macs(words) -> list[str]:
    """MAC words in any format to the stored one; signs of the grammar are kept."""
    import re

    out = []
    for w in filters.as_list(words):
        sign, body = re.match(r"^(!~|~|!)?(.*)$", w).groups()
        if sign in ("~", "!~"):
            out.append(w)
            continue
        digits = re.sub(r"[.:-]", "", body.lower())
        if re.fullmatch(r"[0-9a-f]{12}", digits):
            body = ":".join(digits[i:i + 2] for i in range(0, 12, 2))
        out.append((sign or "") + body)
    return out
