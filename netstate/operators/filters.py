"""The filter grammar: one set of words for every table, compiled to Columns.

``v`` equals, ``!v`` differs, ``~re`` matches the whole value, ``!~re`` does
not; numbers also take ``<``, ``<=``, ``>``, ``>=``, and ``['>a', '<b']`` side
by side is an interval.  Words of one field are OR'ed, negations are AND'ed,
fields are AND'ed.  The regular expressions are Java's.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from netstate.catalog import KERNEL_UNREACHABLE_METRIC, table_spec
from netstate.functions import ip, text

_NUMBER_WORD = re.compile(r"^\s*(<=|>=|==|!=|<|>|!|=)?\s*(-?\d+(?:\.\d+)?)\s*$")
_NUMERIC = (T.LongType, T.IntegerType, T.FloatType, T.DoubleType)


class FilterError(ValueError):
    """A filter word or a free-form predicate that cannot be used."""


def as_list(value) -> list:
    if value is None or value == "":
        return []
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def _any(conds: list[Column]) -> Column | None:
    return reduce(lambda a, b: a | b, conds) if conds else None


def _all(conds: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conds) if conds else None


def combine(matches: list[Column], nots: list[Column]) -> Column | None:
    parts = [c for c in (_any(matches), _all(nots)) if c is not None]
    return _all(parts)


def parse_number_word(word) -> tuple[str, float | int]:
    if not isinstance(word, str):
        return "==", word
    found = _NUMBER_WORD.match(word)
    if not found:
        raise FilterError(f"not a number filter: {word!r}")
    op = {"": "==", "=": "==", "!": "!="}.get(found[1] or "", found[1] or "==")
    digits = found[2]
    return op, float(digits) if "." in digits else int(digits)


def compare(c: Column, op: str, value) -> Column:
    return {
        "==": lambda: c == value, "!=": lambda: c != value, "<": lambda: c < value,
        "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value,
    }[op]()


def number_terms(words) -> tuple[list[list[tuple]], list[tuple]]:
    """Words to (alternatives, negations); an alternative is one term or an interval."""
    parsed = [parse_number_word(w) for w in as_list(words)]
    alternatives, nots, i = [], [], 0
    while i < len(parsed):
        op, _ = parsed[i]
        if op == "!=":
            nots.append(parsed[i])
        elif op.startswith(">") and i + 1 < len(parsed) and parsed[i + 1][0].startswith("<"):
            alternatives.append([parsed[i], parsed[i + 1]])
            i += 1
        else:
            alternatives.append([parsed[i]])
        i += 1
    return alternatives, nots


def match_number(c, words) -> Column | None:
    c = F.col(c) if isinstance(c, str) else c
    alternatives, nots = number_terms(words)
    equals = [a[0][1] for a in alternatives if len(a) == 1 and a[0][0] == "=="]
    ranged = [a for a in alternatives if not (len(a) == 1 and a[0][0] == "==")]
    # Plain values become one IN list, which the Parquet scan can use.
    matches = [c.isin(equals)] if equals else []
    matches += [_all([compare(c, op, v) for op, v in a]) for a in ranged]
    return combine(matches, [compare(c, op, v) for op, v in nots])


def full_match(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})$")


def match_text(c, words, ignore_regex: bool = False) -> Column | None:
    c = F.col(c) if isinstance(c, str) else c
    words = as_list(words)
    if ignore_regex and any(str(w).startswith(("~", "!~")) for w in words):
        return None
    equals, matches, nots = [], [], []
    for w in map(str, words):
        if w.startswith("!~"):
            nots.append(~full_match(c, w[2:]))
        elif w.startswith("~"):
            matches.append(full_match(c, w[1:]))
        elif w.startswith("!"):
            nots.append(c != w[1:])
        else:
            equals.append(w)
    if equals:
        matches.insert(0, c.isin(equals))
    return combine(matches, nots)


def match_bool(c, words) -> Column | None:
    c = F.col(c) if isinstance(c, str) else c
    matches, nots = [], []
    for w in as_list(words):
        negated = isinstance(w, str) and w.startswith("!")
        value = str(w).lstrip("!").lower() == "true"
        (nots if negated else matches).append(c != value if negated else c == value)
    return combine(matches, nots)


def any_in_list(c, values) -> Column:
    """List column holds any of the values."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.arrays_overlap(c, F.array(*[F.lit(v) for v in as_list(values)])),
                      F.lit(False))


def filter_expr(schema: T.StructType, ignore_regex: bool = False, **fields) -> Column | None:
    """Column of the whole grammar; fields outside the schema are ignored."""
    parts = []
    for name, words in fields.items():
        if name not in schema.fieldNames() or not as_list(words):
            continue
        dtype = schema[name].dataType
        if isinstance(dtype, _NUMERIC):
            parts.append(match_number(name, words))
        elif isinstance(dtype, T.BooleanType):
            parts.append(match_bool(name, words))
        elif isinstance(dtype, T.ArrayType):
            parts.append(any_in_list(name, words))
        else:
            parts.append(match_text(name, words, ignore_regex))
    return _all([p for p in parts if p is not None])


def apply_filter(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.where(condition)


def filter_fields(df: DataFrame, ignore_regex: bool = False, **fields) -> DataFrame:
    return apply_filter(df, filter_expr(df.schema, ignore_regex, **fields))


def filter_namespace(df: DataFrame, words) -> DataFrame:
    """On the partition column, so that whole directories are pruned."""
    return apply_filter(df, match_text("namespace", words))


def filter_hostname(df: DataFrame, words) -> DataFrame:
    return apply_filter(df, match_text("hostname", words))


def filter_time(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Epoch-ms bounds, both inclusive."""
    if start is None and end is None:
        return df.where(F.col("timestamp") != 0)
    if start is not None:
        df = df.where(F.col("timestamp") >= start)
    if end is not None:
        df = df.where(F.col("timestamp") <= end)
    return df


def filter_query(df: DataFrame, predicate: str | None) -> DataFrame:
    """Free-form SQL predicate; one that does not fit the table is a FilterError."""
    if not predicate:
        return df
    try:
        return df.where(F.expr(predicate))
    except (ParseException, AnalysisException) as exc:
        raise FilterError(f"bad predicate {predicate!r}: {exc}") from exc


def predicate_names(predicate: str | None) -> set[str]:
    """Names a predicate uses, columns among them; texts in quotes are no names."""
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", " ", predicate or "")
    return set(re.findall(r"[A-Za-z_]\w*", bare))


def active_only(df: DataFrame) -> DataFrame:
    """Drop tombstones; always after the view, never before it."""
    return df.where("active")


def match_vlan(words, vlan="vlan", vlan_list="vlanList") -> Column:
    """VLAN words over the scalar VLAN or any element of the list."""
    v, vs = F.col(vlan), F.coalesce(F.col(vlan_list), F.array().cast("array<bigint>"))
    alternatives, nots = number_terms(words)

    def holds(terms):
        def test(x):
            return _all([compare(x, op, n) for op, n in terms])
        return test(v) | F.exists(vs, test)

    def lacks(n):
        return (v != n) & F.forall(vs, lambda x: x != n)

    matches = [holds(a) for a in alternatives]
    rejects = [lacks(n) for _, n in nots]
    has_vlan = (F.size(vs) > 0) | (v != 0)
    return _all([c for c in (combine(matches, rejects), has_vlan) if c is not None])


def match_prefixlen(word, c="prefixlen") -> Column:
    op, n = parse_number_word(word)
    if not isinstance(n, int) or not 0 <= n <= 128:
        raise FilterError(f"invalid prefix length: {word!r}")
    return compare(F.col(c) if isinstance(c, str) else c, op, n)


_VERSION_WORD = re.compile(r"^(<=|>=|!=|!|<|>|=)?(.*)$")


def match_version(words, c="version") -> Column:
    """Version words, AND'ed; ordering is that of ``version_key``."""
    conds = []
    for w in as_list(words):
        op, wanted = _VERSION_WORD.match(w).groups()
        op = {None: "==", "=": "==", "!": "!="}.get(op, op)
        conds.append(compare(text.version_key(c), op, text.version_key(F.lit(wanted))))
    return _all(conds)


def match_ospf_state(word: str, c="adjState") -> Column:
    c = F.col(c)
    good, passive = c.isin("full", "passive"), c == "passive"
    states = {
        "full": good, "passive": passive, "other": ~good,
        "!full": c != "full", "!passive": ~passive, "!other": good,
    }
    if word not in states:
        raise FilterError(f"unknown OSPF state: {word!r}")
    return states[word]


def match_poll_status(word: str, c="status") -> Column:
    good = F.col(c).isin(0, 200)
    if word not in ("pass", "fail", "all", ""):
        raise FilterError(f"unknown poller status: {word!r}")
    return good if word == "pass" else ~good if word == "fail" else F.lit(True)


def match_excess_periods(word: str, c="pollExcdPeriodCount") -> Column:
    return F.col(c) != 0 if word.startswith("!") else F.col(c) == 0


def match_mac_locality(remote: bool, c="remoteVtepIp") -> Column:
    known = F.coalesce(F.col(c), F.lit(""))
    return known != "" if remote else known == ""


def match_address(addresses) -> Column:
    """MACs in any format and addresses (with or without length), OR'ed."""
    conds = []
    for a in as_list(addresses):
        if ":" in a and re.fullmatch(r"[0-9A-Fa-f:]*", a) and (
            "::" in a or a.count(":") == 7 or "/" in a
        ):
            conds.append(_starts("ip6AddressList", a))
        elif re.fullmatch(r"\d+\.\d+\.\d+\.\d+(?:/\d+)?", a):
            conds.append(_starts("ipAddressList", a))
        else:
            conds.append(F.col("macaddr") == text.mac_canonical(F.lit(a)))
    if not conds:
        raise FilterError("no address given")
    return F.coalesce(_any(conds), F.lit(False))


def _starts(list_col: str, address: str) -> Column:
    stem = address if "/" in address else address + "/"
    return F.coalesce(F.exists(list_col, lambda x: x.startswith(stem)), F.lit(False))


def match_subnets(addr_col, cidrs, is_list: bool = False) -> Column:
    """Address (or any of a list) inside any of the literal prefixes."""
    test = ip.any_in_subnet if is_list else ip.in_subnet
    return _any([test(addr_col, p) for p in as_list(cidrs)])


def match_interface_type(iftype=None, ifname=None) -> Column | None:
    """Internal interfaces stay hidden unless a type or a name is asked for."""
    types = as_list(iftype)
    if as_list(ifname) or types == ["all"]:
        return None
    return match_text("type", types) if types else F.col("type") != "internal"


def drop_kernel_unreachable(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("metric"), F.lit(0)) != KERNEL_UNREACHABLE_METRIC)


# -- keyword search ---------------------------------------------------------

# Kind of term -> (table, columns it is looked up in).
SEARCH_COLUMNS = {
    "mac": ("macs", ["macaddr"]),
    "route": ("routes", ["prefix"]),
    "arpnd": ("arpnd", ["ipAddress", "macaddr"]),
    "address": ("address", ["ipAddress", "macaddr"]),
    "vtep": ("evpnVni", ["priVtepIp"]),
    "vni": ("evpnVni", ["vni"]),
    "asn": ("bgp", ["asn", "peerAsn"]),
    "vlan": ("vlan", ["vlan"]),
    "mtu": ("interfaces", ["mtu"]),
}


def search(terms: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Terms ``(kind, value)`` against the table of their kind, one equi-join per column.

    Returns ``(kind, value, namespace, hostname, column)``, one row per row found.
    """
    found = []
    for kind, (table, columns) in SEARCH_COLUMNS.items():
        if table not in tables:
            continue
        wanted = terms.where(F.col("kind") == kind).distinct()
        for name in columns:
            source = tables[table]
            if name not in source.columns:
                continue
            is_list = isinstance(source.schema[name].dataType, T.ArrayType)
            values = source.select(
                "namespace", "hostname", (F.explode(name) if is_list else F.col(name)).alias(
                    "value")).withColumn("value", F.col("value").cast("string"))
            if kind == "address" and name == "ipAddress":
                values = values.withColumn("value", ip.address_part("value"))
            found.append(
                wanted.join(values, "value").select(
                    "kind", "value", "namespace", "hostname", F.lit(name).alias("column"))
            )
    return reduce(DataFrame.unionByName, found)


def search_values(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """Without terms: the distinct (namespace, value) pairs of a kind."""
    table, columns = SEARCH_COLUMNS[kind]
    parts = [
        tables[table].select("namespace", F.col(c).cast("string").alias("value"))
        for c in columns if c in tables[table].columns
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def table_filter(table: str, **fields) -> Column | None:
    """``filter_expr`` against the catalog schema of a table."""
    return filter_expr(table_spec(table).schema, **fields)
