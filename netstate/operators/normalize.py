"""Raw captures to table rows: the shaping that is common to all systems."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from netstate.functions import text, timefn
from netstate.operators.enrich import NS_HOST, _lookup, unique_by
from netstate.operators.filters import _VERSION_WORD, compare
from netstate.operators.verbs import first_non_empty
from netstate.operators.views import keep_last
from netstate.session import broadcast_if_small
from netstate.sources.write import conform_for_write

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
OK_STATUS = [0, 200]
ZERO_MAC = "00:00:00:00:00:00"
NO_SPEED = 0
MISSING_SPEED = -1
MISSING_SPEED_IF_TYPES = ["ethernet", "bond", "bond_slave"]
STATIC_MAC_FLAGS = ["static", "permanent", "router"]
ARP_REACHABLE = ["stale", "delay"]
ARP_LEARNED = ["extern_learn", "offload"]
ARP_LETTERS = {
    "s": "permanent", "static": "permanent", "c": "reachable", "e": "reachable",
    "stale": "reachable", "reachable": "reachable",
}
SCRUBBED_CONFIG = r"Time|username|crypto|key-hash|encryption"
MLAG_DUAL = ["active-full", "dual"]
MLAG_SINGLE = ["active-partial", "single"]
MLAG_ERROR = ["disabled", "inactive", "errDisabled", "protoDown"]
AFI_NAMES = {"evpn": "l2vpn"}
SAFI_NAMES = {"flow specification": "flowspec"}
IGNORED_SAFI = "sr-te"
DEFAULT_LINUX_METRIC = 20


# -- NRM-1: JSON extraction -------------------------------------------------

@dataclass(frozen=True)
class Step:
    """One level down: ``path`` names a container (empty: the value itself).

    ``each`` is ``map`` (one row per entry, its key kept as column ``key``),
    ``list`` (one row per element) or empty (just descend).
    """

    path: str = ""
    each: str = ""
    key: str = ""


@dataclass(frozen=True)
class Field:
    """A value of the innermost element.

    ``path`` uses dots; ``[]`` after a name goes through a list and keeps a
    list.  ``expect`` maps the value found to another; a value it does not list
    becomes the default.
    """

    name: str
    path: str
    type: str = "string"
    default: object = None
    expect: dict | None = None


@dataclass(frozen=True)
class Compute:
    """``name = left op right`` over fields extracted before (or numbers)."""

    name: str
    left: str
    op: str
    right: str | float


def _json(c: Column, path: str) -> Column:
    if not path:
        return c
    return F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path.split(".")))


def _value(element: Column, path: str) -> Column:
    head, mark, rest = path.partition("[]")
    if not mark:
        return _json(element, path)
    items = F.from_json(_json(element, head.rstrip(".")), "array<string>")
    return F.transform(
        F.coalesce(items, F.array().cast("array<string>")),
        lambda e: _json(e, rest.lstrip(".")))


def extract_json(df: DataFrame, steps: list[Step], fields: list[Field | Compute],
                 column: str = "data") -> DataFrame:
    """Nested JSON text to flat rows, one per innermost element.

    Container keys become columns, lists inside the element stay lists, a
    missing value takes its default.
    """
    keep = [c for c in df.columns if c != column]
    rows = df.withColumn("__e", F.col(column))
    keys: list[str] = []
    for s in steps:
        inner = _json(F.col("__e"), s.path)
        if s.each == "map":
            rows = rows.select(*keep, *keys, F.explode(
                F.from_json(inner, "map<string,string>")).alias("__k", "__e"))
            if s.key:
                rows = rows.withColumnRenamed("__k", s.key)
                keys.append(s.key)
            else:
                rows = rows.drop("__k")
        elif s.each == "list":
            rows = rows.select(*keep, *keys, F.explode(
                F.from_json(inner, "array<string>")).alias("__e"))
        else:
            rows = rows.withColumn("__e", inner).where("__e is not null")
    for f in fields:
        if isinstance(f, Compute):
            left = F.col(f.left)
            right = F.col(f.right) if isinstance(f.right, str) else F.lit(f.right)
            value = {"+": left + right, "-": left - right, "*": left * right,
                     "/": F.try_divide(left, right)}[f.op]
            rows = rows.withColumn(f.name, value)
            continue
        value = _value(F.col("__e"), f.path)
        if "[]" in f.path:
            item = f.type.removeprefix("array<").removesuffix(">")
            fill = None if f.default is None else F.lit(f.default).cast(item)
            value = F.transform(value, lambda x: F.coalesce(
                x.try_cast(item), fill) if fill is not None else x.try_cast(item))
        else:
            if f.expect is not None:
                value = reduce(
                    lambda acc, kv: F.when(value == str(kv[0]), F.lit(kv[1]).cast("string"))
                    .otherwise(acc),
                    f.expect.items(), F.lit(None).cast("string"))
            value = value.try_cast(f.type)
            if f.default is not None:
                value = F.coalesce(value, F.lit(f.default).cast(f.type))
        rows = rows.withColumn(f.name, value)
    return rows.select(*[c for c in keep if c in rows.columns], *keys,
                       *[f.name for f in fields])


# -- NRM-2, 3, 4, 5 ---------------------------------------------------------

def pick_normalizer(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``normalizer``: by host name, else by device type and version.

    ``rules`` has (hostname, devtype, version, copy, normalizer); ``version`` is
    a comparison word such as ``>=4.20`` and ``copy`` names the device type
    whose rule is used instead.
    """
    own = rules.where("copy is null or copy = ''").drop("copy")
    copied = rules.where("copy is not null and copy != ''").select(
        F.col("devtype").alias("__dev"), F.col("copy").alias("devtype"))
    copies = own.drop("hostname").join(copied, "devtype").select(
        F.lit(None).cast("string").alias("hostname"), F.col("__dev").alias("devtype"),
        "version", "normalizer")
    every = own.select("hostname", "devtype", "version", "normalizer").unionByName(copies)
    op = F.coalesce(F.nullif(F.regexp_extract("version", _VERSION_WORD.pattern, 1), F.lit("")),
                    F.lit("="))
    bound = F.regexp_extract("version", _VERSION_WORD.pattern, 2)
    keyed = every.select(
        F.col("hostname").alias("__h"), F.col("devtype").alias("__d"), op.alias("__op"),
        F.nullif(bound, F.lit("")).alias("__bound"), "normalizer",
    ).withColumn("__bkey", text.version_key("__bound"))
    # Few devices send many records: each kind is looked up once, payloads stay put.
    asked = ["hostname", "devtype", "version"]
    mine = df.select(*asked).distinct().withColumn("__vkey", text.version_key("version"))
    ops = {"=": "==", "!": "!=", "!=": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
    fits = F.col("__bound").isNull()
    for sign, word in ops.items():
        fits = fits | ((F.col("__op") == sign) & compare(F.col("__vkey"), word, F.col("__bkey")))
    by_host = mine.join(
        broadcast_if_small(keyed.where("__h is not null and __h != ''")),
        F.col("hostname") == F.col("__h")).withColumn("__rank", F.lit(0))
    by_type = mine.join(
        broadcast_if_small(keyed.where("__h is null or __h = ''")),
        F.col("devtype") == F.col("__d")).where(fits).withColumn(
        "__rank", F.when(F.col("__bound").isNotNull(), 1).otherwise(2))
    best = keep_last(by_host.unionByName(by_type), asked,
                     [F.col("__rank").asc(), F.col("normalizer").asc()])
    found = best.select(*[F.col(c).alias(f"__{c}") for c in asked], "normalizer")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in asked])
    return df.drop("normalizer").join(found, same).select(
        *[c for c in df.columns if c != "normalizer"], "normalizer")


def merge_commands(df: DataFrame, keys: list[str], order: str = "cmd_no") -> DataFrame:
    """Records of several commands to one per key: the first value that says something.

    A later, different value is kept as ``<field>-_2nd``.
    """
    fields = [c for c in df.columns if c not in (*keys, order)]
    aggs = []
    for f in fields:
        value = F.nullif(F.col(f), F.lit(""))if df.schema[f].dataType.typeName() == "string" \
            else F.col(f)
        when = F.when(value.isNotNull(), F.col(order))
        aggs += [F.min_by(value, when).alias(f), F.max_by(value, when).alias(f"{f}-_2nd")]
    merged = df.groupBy(*keys).agg(*aggs)
    out = merged
    for f in fields:
        second = F.col(f"`{f}-_2nd`")
        out = out.withColumn(f"{f}-_2nd", F.when(second != F.col(f), second))
    return out


def conform_record(df: DataFrame, table: str, namespace: Column | None = None,
                   hostname: Column | None = None) -> DataFrame:
    """Stamp the header columns, default what is missing, cast the rest."""
    if namespace is not None:
        df = df.withColumn("namespace", namespace)
    if hostname is not None:
        df = df.withColumn("hostname", hostname)
    return conform_for_write(df, table)


def ok_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("status").isin(OK_STATUS))


# -- MACs -------------------------------------------------------------------

def mac_key(bd="bd", vlan="vlan", oif="oif", vtep="remoteVtepIp", flags="flags",
            macaddr="macaddr") -> Column:
    """Key that tells entries of one MAC apart (bridge domain, VLAN, port, VTEP)."""
    number = F.coalesce(F.col(vlan).cast("string").try_cast("bigint"), F.lit(0))
    has_vlan, vlan_text = number != 0, number.cast("string")
    bd_c, oif_c = F.coalesce(bd, F.lit("")), F.coalesce(oif, F.lit(""))
    vtep_c = F.coalesce(vtep, F.lit(""))
    static = F.coalesce(F.col(flags).isin(STATIC_MAC_FLAGS), F.lit(False))

    def dash(a, b):
        return F.concat(a, F.lit("-"), b)

    return (
        F.when((bd_c != "") & ~has_vlan, bd_c)
        .when(bd_c != "", dash(bd_c, vlan_text))
        .when((vtep_c != "") & (F.col(macaddr) == ZERO_MAC), dash(oif_c, vtep_c))
        .when((vtep_c != "") & has_vlan, vlan_text)
        .when(vtep_c != "", oif_c)
        .when(has_vlan & static, dash(vlan_text, oif_c))
        .when(has_vlan, vlan_text)
        .when(static, oif_c)
        .otherwise(F.lit("0"))
    )


def merge_mac_entries(df: DataFrame, order: str = "pos") -> DataFrame:
    """Entries of one MAC and port become one where at most one VLAN is known."""
    key = [*NS_HOST, "macaddr", "oif"]
    number = F.coalesce(F.col("vlan").cast("string").try_cast("bigint"), F.lit(0))
    df = df.withColumn("__v", number)
    # With several VLANs each keeps its own row; rows without one join the first.
    first = df.where("__v != 0").groupBy(*key).agg(
        F.min_by("__v", order).alias("__first"))
    df = df.join(first, key, "left")
    real = F.col("macaddr") != ZERO_MAC
    group = F.when(~real, F.concat(F.lit("z"), F.col(order).cast("string"))).otherwise(
        F.when(F.col("__v") != 0, F.col("__v")).otherwise(F.coalesce("__first", F.lit(0)))
        .cast("string"))
    rest = [c for c in df.columns if c not in (*key, "vlan", "remoteVtepIp", "flags", "__v",
                                               "__first", order)]
    out = df.withColumn("__g", group).groupBy(*key, "__g").agg(
        F.max("__v").alias("vlan"), first_non_empty("remoteVtepIp", F.col(order)).alias("__vtep"),
        F.min_by("flags", order).alias("flags"), F.min(order).alias(order),
        *[F.min_by(c, order).alias(c) for c in rest])
    vtep = F.coalesce("__vtep", F.lit(""))
    offloaded = F.col("flags").contains("offload") | F.col("flags").contains("extern_learn")
    merged_remote = (F.col("macaddr") != ZERO_MAC) | offloaded
    return out.withColumns({
        "remoteVtepIp": vtep,
        "flags": F.when((vtep != "") & merged_remote, F.lit("remote")).otherwise(F.col("flags")),
    }).drop("__vtep", "__g")


def explode_mac_lists(df: DataFrame) -> DataFrame:
    """Parallel MAC and port lists to rows; a port ``p.v`` without bridge domain gives VLAN v."""
    rows = df.withColumn("__z", F.explode(F.arrays_zip("macaddr", "oif"))).withColumns({
        "macaddr": F.col("__z.macaddr"), "__p": F.col("__z.oif")})
    no_bd = F.coalesce("bd", F.lit("")) == ""
    tagged = no_bd & F.col("__p").contains(".")
    return rows.withColumns({
        "oif": F.when(no_bd, F.substring_index("__p", ".", 1)).otherwise(F.col("__p")),
        "vlan": F.when(tagged, F.substring_index("__p", ".", -1).try_cast("bigint")).otherwise(
            F.col("vlan")),
        "flags": F.lit(""),
    }).drop("__z", "__p")


# -- VLANs, interfaces ------------------------------------------------------

def vlan_transpose(df: DataFrame) -> DataFrame:
    """Interface -> VLAN list to VLAN -> interface list; the bridge alone means suspended.

    ``vlanName`` holds the interface, as in the capture.  The list of a VLAN is
    bounded by the ports of one device.
    """
    rows = df.select(*NS_HOST, F.col("vlanName").alias("port"), F.explode("vlan").alias("v"))
    rows = rows.withColumn("vlan", F.col("v").cast("bigint"))
    port = F.when(F.col("port") != "bridge", F.col("port"))
    return rows.groupBy(*NS_HOST, "vlan").agg(
        F.array_sort(F.collect_set(port)).alias("interfaces")
    ).select(
        *NS_HOST, F.concat(F.lit("vlan"), F.col("vlan")).alias("vlanName"), "vlan", "interfaces",
        F.when(F.size("interfaces") > 0, F.lit("active")).otherwise(F.lit("suspended"))
        .alias("state"))


def vlan_ranges_transpose(df: DataFrame) -> DataFrame:
    """The same for VLANs written as ranges (``'1,5-7'``) in column ``vlans``."""
    return vlan_transpose(df.select(
        *NS_HOST, F.col("ifname").alias("vlanName"), text.range_to_list("vlans").alias("vlan")))


def assign_vrf(ifs: DataFrame) -> DataFrame:
    """Members listed by VRF rows get the VRF as master."""
    members = ifs.where("type = 'vrf' and ifname != 'default'").select(
        *NS_HOST, F.col("ifname").alias("__vrf"), F.explode("_interfaceList").alias("__m"))
    owner = unique_by(members, [*NS_HOST, "__m"], __master="__vrf")
    df = _lookup(ifs, owner, {
        "namespace": "namespace", "hostname": "hostname", "ifname": "__m"})
    return df.withColumn("master", F.coalesce("__master", "master")).drop("__master")


def speed_or_missing(speed="speed", iftype="type", missing=0) -> Column:
    """Unknown speed: -1 on ports that ought to have one, else 0."""
    value = F.col(speed).cast("string").try_cast("bigint")
    gap = value.isNull() | (value == missing)
    return F.when(gap, F.when(F.col(iftype).isin(MISSING_SPEED_IF_TYPES), F.lit(MISSING_SPEED))
                  .otherwise(F.lit(NO_SPEED))).otherwise(value)


def link_changes(df: DataFrame) -> DataFrame:
    """Up and down counts to ``numChanges``; the stamp of the present state as time."""
    stamp = F.when(F.lower("state") == "up", F.col("linkUpTimestamp")).otherwise(
        F.col("linkDownTimestamp"))
    parsed = F.try_to_timestamp(F.trim(stamp), F.lit("yyyy/MM/dd HH:mm:ss.SSSSSS"))
    never = F.coalesce(stamp, F.lit("")).contains("never") | (F.coalesce(stamp, F.lit("")) == "")
    return df.withColumns({
        "numChanges": F.coalesce(F.col("linkUpCnt").try_cast("bigint"), F.lit(0))
        + F.coalesce(F.col("linkDownCnt").try_cast("bigint"), F.lit(0)),
        "state": F.lower("state"),
        "statusChangeTimestamp": F.when(never, F.lit(0)).otherwise(
            F.coalesce(F.unix_millis(parsed), F.lit(0))),
    })


# -- routes, LLDP, ARP ------------------------------------------------------

def fix_routes(routes: DataFrame, vrf_ids: DataFrame | None = None) -> DataFrame:
    """Versions, default and host prefixes, VRF by table id, blackholes, empty lists."""
    df = routes
    if vrf_ids is not None:
        known = unique_by(vrf_ids, [*NS_HOST, "table_id"], __vrf="vrf")
        df = _lookup(df, known, {
            "namespace": "namespace", "hostname": "hostname", "vrf_id": "table_id"})
        by_id = F.when(F.coalesce("vrf_id", F.lit("")) != "", F.coalesce(
            F.nullif("__vrf", F.lit("")), F.lit("default")))
        df = df.withColumn("vrf", F.coalesce(by_id, "vrf")).drop("__vrf")
    blank = F.array(F.lit(""))

    def or_blank(c):
        return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(blank)

    nhs = or_blank("nexthopIps")
    prefix = F.when(F.col("prefix") != "default", F.col("prefix")).when(
        F.exists(nhs, lambda x: x.contains(":")), F.lit("::/0")).otherwise(F.lit("0.0.0.0/0"))
    v6 = prefix.contains(":")
    whole = F.when(prefix.contains("/"), prefix).when(v6, F.concat(prefix, F.lit("/128"))
                                                      ).otherwise(F.concat(prefix, F.lit("/32")))
    metric = F.coalesce(F.nullif(F.col("metric").cast("bigint"), F.lit(0)),
                        F.lit(DEFAULT_LINUX_METRIC)).cast("bigint")
    return df.withColumns({
        "vrf": F.coalesce(F.nullif("vrf", F.lit("")), F.lit("default")),
        "ipvers": F.when(v6, F.lit(6)).otherwise(F.lit(4)).cast("bigint"),
        "prefix": whole, "nexthopIps": nhs,
        "oifs": F.when(F.col("action") == "blackhole", F.array(F.lit("blackhole"))).otherwise(
            or_blank("oifs")),
        "metric": metric, "preference": metric,
        "action": F.coalesce(F.nullif("action", F.lit("")), F.lit("forward")),
    })


def classify_lldp(df: DataFrame) -> DataFrame:
    """Peer port, MAC and index by the kind of port id announced."""
    kind = F.lower(F.coalesce(F.col("subtype").cast("string"), F.lit("")))
    by_name = kind.isin("interface name", "", "5", "7")
    by_mac = kind == "mac address"
    local = kind.startswith("locally") | kind.startswith("1")
    number = F.col("peerIfname").try_cast("bigint")
    indexed = local & F.col("peerIfname").rlike(r"^\d+$")
    return df.withColumns({
        "peerMacaddr": F.when(by_mac, text.mac_canonical("peerIfname")).otherwise(
            F.when(by_name | local, F.lit(ZERO_MAC)).otherwise(F.col("peerMacaddr"))),
        "peerIfindex": F.when(indexed, number).otherwise(F.lit(0)).cast("bigint"),
        "peerIfname": F.when(by_mac | indexed, F.lit("-")).otherwise(F.col("peerIfname")),
        "subtype": F.when(by_mac, F.lit("mac address")).when(
            indexed, F.lit("locally assigned")).when(
            by_name | local, F.lit("interface name")).otherwise(kind),
    })


def merge_lldp_cdp(df: DataFrame, order: str = "pos") -> DataFrame:
    """One row per port and peer; what one protocol left out comes from the other."""
    key = [*NS_HOST, "ifname", "peerHostname", "peerIfname"]
    rest = [c for c in df.columns if c not in (*key, order)]
    # The later row wins, blanks are filled from the earlier one.
    def pick(c):
        value = F.nullif(F.col(c), F.lit("")) if df.schema[c].dataType.typeName() == "string" \
            else F.col(c)
        return F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(c)
    return df.groupBy(*key).agg(*[pick(c) for c in rest])


def canonical_arp(df: DataFrame, letters: bool = False) -> DataFrame:
    """Neighbour states to reachable, permanent or failed; remote entries flagged.

    ``letters`` is for systems that show the state as a letter.
    """
    state = F.lower(F.coalesce("state", F.lit("")))
    if letters:
        table = F.create_map(*[F.lit(x) for kv in ARP_LETTERS.items() for x in kv])
        return df.withColumn("state", F.coalesce(F.try_element_at(table, state), F.lit("failed")))
    mac = F.lower(F.coalesce("macaddr", F.lit("")))
    missing = mac.isin("", "incomplete")
    remote = F.coalesce(F.col("remote").cast("string").isin("offload", "true"), F.lit(False))
    learned = state.isin(ARP_LEARNED)
    return df.withColumns({
        "state": F.when(missing, F.lit("failed")).when(
            state.isin(*ARP_REACHABLE, *ARP_LEARNED, ""), F.lit("reachable")).otherwise(state),
        "remote": remote | learned,
        "macaddr": F.when(missing, F.lit(ZERO_MAC)).otherwise(text.mac_canonical("macaddr")),
        "oif": F.trim(F.substring_index("oif", ",", 1)),
    })


# -- EVPN, inventory, OSPF, MLAG, BGP, device -------------------------------

def explode_vnis(df: DataFrame) -> DataFrame:
    """VLAN -> VNI map to one row per VLAN, with VRF (VRF -> VNI map) and VTEPs (VLAN map).

    Columns: _vlan2VniMap map<string,bigint>, _vrf2VniMap map<string,bigint>,
    _vlan2VtepMap map<string,array<string>>.
    """
    repl = F.col("replicationType")
    group = F.coalesce("mcastGroup", F.lit(""))
    multicast = ~group.isin("", "0.0.0.0")
    rows = df.withColumns({
        "replicationType": F.when(repl == "headendVcs", F.lit("ingressBGP")).when(
            multicast, F.lit("multicast")).otherwise(F.lit("")),
        "mcastGroup": F.when((repl != "headendVcs") & multicast, group).otherwise(
            F.lit("0.0.0.0")),
    }).select("*", F.explode("_vlan2VniMap").alias("__vlan", "vni"))
    by_vni = F.map_from_entries(F.transform(
        F.map_entries("_vrf2VniMap"),
        lambda e: F.struct(e["value"].alias("k"), e["key"].alias("v"))))
    vrf = F.coalesce(F.try_element_at(by_vni, F.col("vni")), F.lit(""))
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "vlan": F.col("__vlan").cast("bigint"), "vrf": vrf,
        "type": F.when(vrf != "", F.lit("L3")).otherwise(F.lit("L2")),
        "remoteVtepList": F.coalesce(
            F.try_element_at(F.col("_vlan2VtepMap"), F.col("__vlan")), none),
    }).drop("__vlan", "_vlan2VniMap", "_vrf2VniMap", "_vlan2VtepMap")


def merge_vni_peers(vnis: DataFrame, peers: DataFrame) -> DataFrame:
    """Peers announce VNI ranges; each VNI gets the peers that announce it."""
    announced = peers.select(
        *NS_HOST, "peer", F.explode(text.range_to_list("_vniList")).alias("vni"))
    lists = announced.groupBy(*NS_HOST, "vni").agg(
        F.array_sort(F.collect_set("peer")).alias("remoteVtepList"))
    return vnis.drop("remoteVtepList").join(lists, [*NS_HOST, "vni"], "left").withColumn(
        "remoteVtepList", F.coalesce("remoteVtepList", F.array().cast("array<string>")))


SLOT_KINDS = {
    "_xcvrSlots": "xcvr", "_fanTraySlots": "fan", "_powerSupplySlots": "power",
    "_cardSlots": "card",
}
_SLOT_PREFIX = {"xcvr": "port", "fan": "fan", "power": "power"}


def explode_inventory(df: DataFrame) -> DataFrame:
    """Slot maps (slot -> attributes) to rows.

    Each map is ``map<string, map<string,string>>``; absent maps give no rows.
    """
    parts = []
    for column, kind in SLOT_KINDS.items():
        if column not in df.columns:
            continue
        rows = df.select(*NS_HOST, "timestamp", F.explode(column).alias("slot", "a"))

        def attr(name):
            return F.coalesce(F.try_element_at(F.col("a"), F.lit(name)), F.lit(""))

        model = attr("modelName") if kind in ("xcvr", "card") else attr("name")
        absent = model.isin("", "Not Inserted") if kind in ("xcvr", "card") else F.lit(False)
        name = (
            F.concat(F.lit(f"{_SLOT_PREFIX[kind]}-"), "slot") if kind in _SLOT_PREFIX
            else F.lower(F.regexp_replace("slot", r"(\d+)$", "-$1")))
        slot_type = F.lit(kind) if kind in _SLOT_PREFIX else F.lower(
            F.regexp_replace("slot", r"\d+$", ""))
        vendor = F.lower(attr("mfgName")) if kind == "xcvr" else attr("vendor")
        serial = attr("serialNum")
        parts.append(rows.select(
            *NS_HOST, name.alias("name"), slot_type.alias("type"),
            F.when(model == "Not Inserted", F.lit("")).otherwise(
                F.lower(model) if kind == "card" else model).alias("model"),
            F.when(absent, F.lit("absent")).otherwise(F.lit("present")).alias("status"),
            F.when(serial == "N/A", F.lit("")).otherwise(serial).alias("serial"),
            vendor.alias("vendor"), attr("hardwareRev").alias("version"), "timestamp"))
    return reduce(DataFrame.unionByName, parts)


def ospf_neighbour_times(df: DataFrame) -> DataFrame:
    """Up-time texts to moments; the later one is the last change."""
    up = F.coalesce(timefn.reltime_to_epoch("lastUpTime", "timestamp"), F.lit(0))
    down = F.coalesce(timefn.reltime_to_epoch("lastDownTime", "timestamp"), F.lit(0))
    bfd = F.lower(F.coalesce("bfdStatus", F.lit("")))
    return df.withColumns({
        "lastUpTime": up, "lastDownTime": down, "lastChangeTime": F.greatest(up, down),
        "state": F.lower("state"), "areaStub": F.col("areaStub") == "[Stub]",
        "vrf": F.lit("default"),
        "bfdStatus": F.when(bfd == "", F.lit("disabled")).otherwise(bfd),
    })


def ospf_unnumbered(df: DataFrame) -> DataFrame:
    """Unnumbered interfaces take the loopback address of their VRF; names are unified."""
    df = df.withColumn("vrf", F.coalesce(F.nullif("vrf", F.lit("")), F.lit("default")))
    loops = unique_by(df.where("ifname = 'lo'"), [*NS_HOST, "vrf"], __lo="ipAddress")
    df = df.join(loops, [*NS_HOST, "vrf"], "left")
    kind = F.lower("networkType")
    unnumbered = F.col("isUnnumbered") == "UNNUMBERED"
    return df.withColumns({
        "networkType": F.when(kind == "pointopoint", F.lit("p2p")).otherwise(kind),
        "passive": F.col("passive") == "Passive",
        "ipAddress": F.when(unnumbered, F.coalesce("__lo", F.lit(""))).otherwise(
            F.col("ipAddress")),
        "isUnnumbered": unnumbered,
    }).drop("__lo")


def classify_mlag_ports(df: DataFrame, ports="_localInterfaceList", states="_linkStateList",
                        ) -> DataFrame:
    """Ports by the state of their link: dual, single and error lists with counts."""
    pairs = F.arrays_zip(F.col(ports).alias("port"), F.col(states).alias("state"))

    def of(names):
        return F.transform(F.filter(pairs, lambda z: z["state"].isin(names)), lambda z: z["port"])

    out = df.withColumns({
        "mlagDualPortsList": of(MLAG_DUAL), "mlagSinglePortsList": of(MLAG_SINGLE),
        "mlagErrorPortsList": of(MLAG_ERROR)})
    return out.withColumns({
        f"mlag{k}PortsCnt": F.size(f"mlag{k}PortsList").cast("bigint")
        for k in ("Dual", "Single", "Error")}).drop(ports, states)


def explode_afi_safi(df: DataFrame) -> DataFrame:
    """Sessions with parallel family lists to one row per family.

    Sessions that are not established are one row with blank families.
    """
    def renamed(c, names):
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        return F.coalesce(F.try_element_at(table, F.lower(c)), F.lower(c))

    estd = F.col("state") == "Established"
    zipped = F.arrays_zip("afi", "safi", "pfxRx", "pfxTx")
    clean = F.transform(zipped, lambda z: F.struct(
        renamed(z["afi"], AFI_NAMES).alias("afi"),
        F.when(F.lower(z["afi"]) == "evpn", F.lit("evpn")).otherwise(
            renamed(F.coalesce(z["safi"], F.lit("")), SAFI_NAMES)).alias("safi"),
        z["pfxRx"].cast("bigint").alias("pfxRx"), z["pfxTx"].cast("bigint").alias("pfxTx")))
    kept = F.filter(clean, lambda z: ~z["safi"].contains(IGNORED_SAFI))
    single = F.array(F.struct(
        F.lit("").alias("afi"), F.lit("").alias("safi"),
        F.lit(0).cast("bigint").alias("pfxRx"), F.lit(0).cast("bigint").alias("pfxTx")))
    others = [c for c in df.columns if c not in ("afi", "safi", "pfxRx", "pfxTx")]
    rows = df.select(*others, F.inline(F.when(estd, kept).otherwise(single)))
    return rows.withColumns({
        "state": F.when(F.col("state") == "Established", F.col("state")).otherwise(
            F.lit("NotEstd")),
        "asn": text.asdot_to_asn("asn"), "peerAsn": text.asdot_to_asn("peerAsn")})


def merge_device_records(df: DataFrame, order: str = "pos") -> DataFrame:
    """Partial records of one device to one row: the last value that says something."""
    rest = [c for c in df.columns if c not in (*NS_HOST, order)]

    def pick(c):
        value = F.nullif(F.col(c), F.lit("")) if df.schema[c].dataType.typeName() == "string" \
            else F.col(c)
        return F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(c)

    out = df.groupBy(*NS_HOST).agg(*[pick(c) for c in rest])
    words = F.split("os", r"\s+")
    long_name = F.coalesce(F.col("vendor"), F.lit("")) == ""
    long_name = long_name & (F.size(words) > 1)
    return out.withColumns({
        "vendor": F.when(long_name, F.get(words, F.lit(0))).otherwise(F.col("vendor")),
        "version": F.when(long_name, F.get(words, F.lit(1))).otherwise(F.col("version")),
        "status": F.lit("alive"),
    })


def scrub_config(c="config") -> Column:
    """Configuration without the lines that change by themselves or hold secrets."""
    lines = F.split(F.col(c) if isinstance(c, str) else c, r"\r?\n")
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(SCRUBBED_CONFIG)), "\n")
