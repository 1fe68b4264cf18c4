"""Consistent, seeded replacement of host names, MACs and addresses.

Equal input and seed give equal output on every executor, so no mapping has to
be collected; the mapping table is only an output.  Addresses keep their common
prefixes: each bit is flipped by a keyed hash of the bits above it, in Arrow batches.
"""

from __future__ import annotations

import re
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from netstate.functions import ip, text

# Fixed values.
MAC_TEXT = (
    r"(?i)\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b|\b[0-9a-f]{4}\.[0-9a-f]{4}\.[0-9a-f]{4}\b"
)
IPV4_TEXT = (
    r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.])"
)
IPV6_TEXT = (
    r"(?i)(?<![0-9a-f:.])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])"
    r"|(?<![0-9a-f:.])(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6}(?![0-9a-f:])"
    r"|(?<![0-9a-f:.])(?:[0-9a-f]{1,4}:){1,7}:(?![0-9a-f:])"
    r"|(?<![0-9a-f:.])::(?:[0-9a-f]{1,4}:){0,6}[0-9a-f]{1,4}(?![0-9a-f:])"
)
KEPT_MACS = ["00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _digest(seed: str, kind: str, c: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|{kind}|"), c), 256)


def anon_host(c, seed: str) -> Column:
    """Short and full names of one host stay one host."""
    c = _col(c)
    short = F.concat(F.lit("host-"), F.substring(
        _digest(seed, "host", text.strip_domain(F.lower(c))), 1, 12))
    rest = F.substring(F.lower(c), F.length(text.strip_domain(c)) + 2, 1 << 20)
    full = F.concat(short, F.lit(".d-"), F.substring(_digest(seed, "domain", rest), 1, 8),
                    F.lit(".example"))
    return F.when(c.isNull() | (c == ""), c).when(c.contains("."), full).otherwise(short)


def anon_mac(c, seed: str) -> Column:
    """New MAC in the form of the old one; zero and broadcast stay."""
    c = _col(c)
    canon = text.mac_canonical(c)
    new = F.concat(F.lit("02"), F.substring(_digest(seed, "mac", canon), 1, 10))
    dotted = F.regexp_replace(new, r"(....)(?=.)", "$1.")
    paired = F.regexp_replace(new, r"(..)(?=.)", "$1:")
    out = (F.when(c.contains("."), dotted)
           .when(c.contains("-"), F.regexp_replace(paired, ":", "-"))
           .when(c.contains(":"), paired).otherwise(new))
    return F.when(canon.isin(KEPT_MACS) | ~canon.rlike(text.MAC_PATTERN) | c.isNull(), c
                  ).otherwise(out)


def _address_udf(seed: str, families: tuple[int, ...], returns: str):
    """Arrow function that replaces addresses of the families; other texts stay.

    Each bit is flipped by a keyed hash of the bits above it, so common prefixes stay.  A
    prefix that addresses of a batch share is hashed once.  The function is a local
    one: it travels by value, executors need not have this package.
    """
    four, six = ip.V4_PATTERN, ip.V6_PATTERN

    def number(text: str) -> int | None:
        """Bits of an address, read as ``functions.ip`` does."""
        if ":" not in text:
            if not re.search(four, text, re.ASCII):
                return None
            a, b, c, d = map(int, text.split("."))
            return a << 24 | b << 16 | c << 8 | d
        if "." in text:
            tail = re.search(r"\d+\.\d+\.\d+\.\d+$", text, re.ASCII)
            low = number(tail[0]) if tail else None
            if low is None:
                return None
            text = f"{text[:tail.start()]}{low >> 16:x}:{low & 65535:x}"
        if not re.search(six, text):
            return None
        halves = text.split("::")
        left, right = ([g for g in h.split(":") if g] for h in [*halves, ""][:2])
        missing = 8 - len(left) - len(right)
        if missing < 1 if len(halves) == 2 else missing != 0:
            return None
        return int("".join(g.zfill(4) for g in [*left, *["0"] * missing, *right]), 16)

    def permute(values: list[int], bits: int, scope: str, within: list[int]) -> list[int]:
        """Numbers of so many bits, each permuted among those of equal ``within``."""
        words, groups = np.array(values, np.uint64), np.array(within, np.uint64).view(np.int64)
        order = np.lexsort((words, groups))
        words, groups = words[order], groups[order]
        apart = np.ones(len(words), bool)
        apart[1:] = groups[1:] != groups[:-1]
        starts = {g: f"{seed}|ip|{scope.format(g)}".encode() for g in groups[apart].tolist()}
        flips = np.zeros(len(words), np.uint64)
        for i in range(bits):
            above = words >> np.uint64(bits - i) if i else np.zeros(len(words), np.uint64)
            first = apart.copy()
            first[1:] |= above[1:] != above[:-1]
            at = np.flatnonzero(first)
            marks = (sha256(b"%b|%d|%d" % (starts[g], i, v)).digest()[0]
                     for g, v in zip(groups[at].tolist(), above[at].tolist(), strict=True))
            # The last bit of the first hexadecimal digit.
            bit = np.fromiter(marks, np.uint64, len(at)) >> np.uint64(4) & np.uint64(1)
            flips |= np.repeat(bit, np.diff(at, append=len(words))) << np.uint64(bits - 1 - i)
        out = np.empty_like(words)
        out[order] = words ^ flips
        return out.tolist()

    def replaced(texts: pa.Array) -> pa.Array:
        distinct = texts.dictionary_encode()
        new = distinct.dictionary.to_pylist()
        met: dict[int, list[tuple[int, int, str]]] = {4: [], 6: []}
        for at, text in enumerate(new):
            address, slash, _ = text.partition("/")
            family = 6 if ":" in text else 4
            found = number(address) if family in families else None
            if found is not None:
                tail = "/" + text.rpartition("/")[2] if slash else ""
                met[family].append((at, found, tail))
        lows = permute([n for _, n, _ in met[4]], 32, "4", [0] * len(met[4]))
        for (at, _, tail), n in zip(met[4], lows, strict=True):
            new[at] = f"{n >> 24}.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}{tail}"
        highs = [n >> 64 for _, n, _ in met[6]]
        lows = permute([n & (1 << 64) - 1 for _, n, _ in met[6]], 64, "6|{}", highs)
        highs = permute(highs, 64, "6", [0] * len(highs))
        for (at, _, tail), hi, lo in zip(met[6], highs, lows, strict=True):
            digits = f"{hi:016x}{lo:016x}"
            new[at] = ":".join(digits[i:i + 4] for i in range(0, 32, 4)) + tail
        return pa.array(new, pa.string()).take(distinct.indices)

    def replaced_lists(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(
            pa.array([0, *ends.tolist()], pa.int32()), replaced(lists.flatten()),
            mask=lists.is_null())

    def run(column: pa.Array) -> pa.Array:
        return replaced_lists(column) if pa.types.is_list(column.type) else replaced(column)

    return F.arrow_udf(run, returns)


def anon_ipv4(c, seed: str) -> Column:
    """Addresses that shared their first n bits still do; a length after '/' stays."""
    return _address_udf(seed, (4,), "string")(_col(c))


def anon_ipv6(c, seed: str) -> Column:
    return _address_udf(seed, (6,), "string")(_col(c))


def anon_address(c, seed: str) -> Column:
    return _address_udf(seed, (4, 6), "string")(_col(c))


KINDS = {"host": anon_host, "mac": anon_mac, "ip": anon_address}


def mapping(df: DataFrame, columns: dict[str, str], seed: str) -> DataFrame:
    """(kind, original, replacement) of every distinct value of the columns."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(c).alias("original"))
        for c, kind in columns.items()]))
    distinct = df.select(pairs.alias("p")).select("p.*").where(
        "original is not null and original != ''").distinct()
    new = reduce(
        lambda acc, kv: F.when(F.col("kind") == kv[0], kv[1]("original", seed)).otherwise(acc),
        KINDS.items(), F.lit(None).cast("string"))
    return distinct.withColumn("replacement", new)


def pseudonymize(df: DataFrame, columns: dict[str, str], seed: str) -> DataFrame:
    """Replace whole columns; ``columns`` maps a column to host, mac or ip.

    List columns are replaced element by element.
    """
    def replaced(c: str, kind: str) -> Column:
        if df.schema[c].dataType.typeName() != "array":
            return KINDS[kind](c, seed)
        if kind == "ip":
            return _address_udf(seed, (4, 6), "array<string>")(F.col(c))
        return F.transform(c, lambda x: KINDS[kind](x, seed))

    return df.withColumns({c: replaced(c, kind) for c, kind in columns.items()})


def _longest_first(found: Column) -> Column:
    """The distinct matches; longest first, so none is cut apart."""
    return F.array_sort(
        F.array_distinct(found),
        lambda a, b: F.when(F.length(a) > F.length(b), F.lit(-1)).when(
            F.length(a) < F.length(b), F.lit(1)).when(a < b, F.lit(-1)).when(
            a > b, F.lit(1)).otherwise(F.lit(0)))


def _replace_all(body: Column, found: Column, new: Column) -> Column:
    """Replace each match in a text by its own."""
    # Matches become marks first, so that a replacement is never replaced again.
    pairs = F.zip_with(found, new, lambda x, y: F.struct(x.alias("old"), y.alias("new")))
    marks = F.transform(pairs, lambda p, i: F.struct(
        p["old"].alias("old"), p["new"].alias("new"),
        F.concat(F.lit("\u0001"), i.cast("string"), F.lit("\u0002")).alias("mark")))
    marked = F.aggregate(marks, body, lambda t, m: F.replace(t, m["old"], m["mark"]))
    return F.aggregate(marks, marked, lambda t, m: F.replace(t, m["mark"], m["new"]))


def pseudonymize_text(df: DataFrame, column: str, seed: str,
                      hosts: list[str] | None = None) -> DataFrame:
    """MACs and addresses inside free text (command output, configurations).

    ``hosts`` are keywords before a host name (``hostname sw1``).
    """
    found = F.col("__found")
    steps = [
        (MAC_TEXT, 0, F.transform(found, lambda x: anon_mac(x, seed))),
        (IPV6_TEXT, 0, _address_udf(seed, (6,), "array<string>")(found)),
        (IPV4_TEXT, 0, _address_udf(seed, (4,), "array<string>")(found))]
    steps += [(rf"\b{word}\s+([A-Za-z0-9][A-Za-z0-9.-]*)", 1,
               F.transform(found, lambda x: anon_host(x, seed))) for word in hosts or []]
    for pattern, group, new in steps:
        matches = F.regexp_extract_all(column, F.lit(pattern), group)
        df = df.withColumn("__found", _longest_first(matches)).withColumn("__new", new)
        df = df.withColumn(column, _replace_all(F.col(column), found, F.col("__new"))).drop(
            "__found", "__new")
    return df
