"""Text helpers: MAC forms, AS numbers, ranges, interface names, sort keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
ZERO_MAC = "00:00:00:00:00:00"
MAC_PATTERN = r"^(?:[0-9a-f]{2}:){5}[0-9a-f]{2}$"

NXOS_NAMES = {"Eth": "Ethernet", "Po": "port-channel", "Lo": "loopback"}
EOS_NAMES = {"Eth": "Ethernet", "Po": "Port-Channel", "Vx": "Vxlan"}
IOS_NAMES = {
    "Ap": "AppGigabitEthernet", "BE": "Bundle-Ether", "BV": "BVI", "Eth": "Ethernet",
    "Fas": "FastEthernet", "Fa": "FastEthernet", "Fi": "FiftyGigE", "Fo": "FortyGigE",
    "FH": "FourHundredGigE", "Gi": "GigabitEthernet", "Gig": "GigabitEthernet",
    "Hu": "HundredGigE", "Lo": "Loopback", "Mg": "MgmtEth", "Nu": "Null",
    "Po": "Port-channel", "TE": "TenGigE", "Te": "TenGigabitEthernet",
    "Ten": "TenGigabitEthernet", "TF": "TwentyFiveGigE", "TH": "TwoHundredGigE",
    "Two": "TwoGigabitEthernet", "Tw": "TwoGigabitEthernet", "tsec": "tunnel-ipsec",
    "tmte": "tunnel-mte", "tt": "tunnel-te", "tp": "tunnel-tp", "Vl": "Vlan", "CPU": "cpu",
}
_NAME_MAPS = {"nxos": NXOS_NAMES, "eos": EOS_NAMES, "ios": IOS_NAMES}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mac_canonical(c) -> Column:
    """Dotted, dashed, three-group and bare MACs to ``aa:bb:cc:dd:ee:ff``.

    Other text comes back in lower case; null becomes the zero MAC.
    """
    low = F.lower(_col(c))
    digits = F.regexp_replace(low, r"[^0-9a-f]", "")
    pairs = F.regexp_replace(digits, r"(..)(?=.)", "$1:")
    known = low.rlike(
        r"^[0-9a-f]{4}([.:-])[0-9a-f]{4}\1[0-9a-f]{4}$|^(?:[0-9a-f]{2}-){5}[0-9a-f]{2}$"
        r"|^[0-9a-f]{12}$"
    )
    return F.when(low.isNull(), F.lit(ZERO_MAC)).when(known, pairs).otherwise(low)


def is_mac(c) -> Column:
    return F.coalesce(_col(c).isNotNull() & mac_canonical(c).rlike(MAC_PATTERN), F.lit(False))


def asdot_to_asn(c) -> Column:
    """``hi.lo`` text to a number; plain numbers pass through."""
    c = _col(c).cast("string")
    high = F.substring_index(c, ".", 1).try_cast("bigint")
    low = F.substring_index(c, ".", -1).try_cast("bigint")
    return F.when(c.contains("."), high * 65536 + low).otherwise(c.try_cast("bigint"))


def asn_to_asdot(c) -> Column:
    c = _col(c)
    high = F.floor(c / 65536).cast("bigint")
    return F.concat(high.cast("string"), F.lit("."), F.pmod(c, F.lit(65536)).cast("string"))


def range_to_list(c) -> Column:
    """``'1,2-5'`` to ``[1,2,3,4,5]``; text that is not a range list gives ``[]``."""
    c = _col(c)
    empty = F.array().cast("array<bigint>")
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    valid = F.forall(parts, lambda p: p.rlike(r"^\d+(?:\s*-\s*\d+)?$"))

    def expand(p):
        first = F.trim(F.substring_index(p, "-", 1)).try_cast("bigint")
        last = F.trim(F.substring_index(p, "-", -1)).try_cast("bigint")
        return F.when(last >= first, F.sequence(first, last)).otherwise(empty)

    return F.when(valid, F.flatten(F.transform(parts, expand))).otherwise(empty)


def list_to_range(c) -> Column:
    """Integers to compact text: ``[1,2,3,7]`` becomes ``'1-3, 7'``."""
    def spans(nums: Column) -> Column:
        size = F.size(nums)
        starts = F.filter(nums, lambda n, i: (i == 0) | (
            F.element_at(nums, F.greatest(i, F.lit(1))) != n - 1))
        ends = F.filter(nums, lambda n, i: (i == size - 1) | (
            F.element_at(nums, F.least(i + 2, size)) != n + 1))
        return F.transform(
            F.arrays_zip(starts.alias("s"), ends.alias("e")),
            lambda z: F.when(z["s"] == z["e"], z["s"].cast("string")).otherwise(
                F.concat(z["s"].cast("string"), F.lit("-"), z["e"].cast("string"))),
        )

    # The sorted numbers are bound once: the filters ask for them again for each number.
    nums = F.array_sort(F.array_distinct(_col(c).cast("array<bigint>")))
    return F.array_join(F.get(F.transform(F.array(nums), spans), F.lit(0)), ", ")


def expand_ifname(c, nos: str) -> Column:
    """Short interface name to the long one of the given system."""
    c = _col(c)
    names = _NAME_MAPS[nos]
    head = F.regexp_extract(c, r"^([A-Za-z]+)", 1)
    if nos == "ios":
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        long_name = F.try_element_at(table, head)
        rest = F.substring(c, F.length(head) + 1, F.length(c))
        out = F.when(long_name.isNotNull(), F.concat(long_name, rest)).otherwise(c)
    else:
        out = c
        for short, long_name in names.items():
            # 'Ethernet1' already carries the long form; 'Eth1/1' does not.
            already = F.lower(head).startswith(long_name.lower()[:len(short) + 2])
            out = F.when(
                c.startswith(short) & ~already,
                F.concat(F.lit(long_name), F.substring(c, len(short) + 1, 1 << 30)),
            ).otherwise(out)
    return F.coalesce(out, F.lit(""))


def natkey(c, width: int = 20) -> Column:
    """Sort key with every digit run padded, so that eth2 sorts before eth10."""
    zeros = "0" * width
    padded = F.regexp_replace(_col(c).cast("string"), r"(\d+)", f"{zeros}$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def version_key(c) -> Column:
    """Comparable key of a dotted version; a letter suffix sorts before the bare number."""
    text = F.lower(_col(c).cast("string"))
    split_up = F.regexp_replace(text, r"(\d)([a-z])|([a-z])(\d)", "$1$3.$2$4")
    parts = F.filter(F.split(split_up, r"[.\-_+() ]+"), lambda p: p != "")
    keyed = F.transform(
        parts,
        lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("2"), F.lpad(p, 12, "0")))
        .otherwise(F.concat(F.lit("0"), p)),
    )
    # A missing part sorts above letters and below numbers.
    return F.concat(F.array_join(keyed, "."), F.lit(".1"))


def port_number(c) -> Column:
    """Port index of an inventory or interface name (``port-1/2``, ``xe-1/2``, ``Ethernet1/2``)."""
    c = _col(c)
    ethernet = F.regexp_extract(c, r"Ethernet(.*)$", 1)
    return (
        F.when(c.contains("-"), F.get(F.split(c, "-"), F.lit(1)))
        .when(c.contains("Ethernet") & c.contains("/"),
              F.regexp_extract(ethernet, r"^(.*)/[^/]*$", 1))
        .when(c.contains("Ethernet"), ethernet)
        .otherwise(c)
    )


def strip_domain(c) -> Column:
    return F.substring_index(_col(c), ".", 1)


parent_ifname = strip_domain


def content_hash(*cols) -> Column:
    """Order-free for list columns: equal content gives an equal hash."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
