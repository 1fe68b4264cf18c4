"""IP address arithmetic as Column expressions (both families, no UDF).

An address is a struct ``(fam, hi, lo)``: IPv4 keeps its 32 bits in ``lo``,
IPv6 its upper and lower 64 bits in ``hi`` and ``lo``.  The masked form of an
address is what prefixes are joined on.  Text that is not an address is null.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

# Fixed values.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
V4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
V6_PATTERN = r"^(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}$"
IP_STRUCT = "struct<fam:int,hi:bigint,lo:bigint>"

_SIGN = -(1 << 63)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def address_part(c) -> Column:
    """Text before the slash."""
    return F.substring_index(_col(c), "/", 1)


def prefix_len(c) -> Column:
    """Number after the slash; null where there is none."""
    c = _col(c)
    return F.when(c.contains("/"), F.substring_index(c, "/", -1).try_cast("int"))


def ip_version(c) -> Column:
    """6 for text with a colon, 4 for text with a dot, else null."""
    c = _col(c)
    return F.when(c.contains(":"), F.lit(6)).when(c.contains("."), F.lit(4))


def is_ipvers(c, version: int) -> Column:
    return F.coalesce(ip_version(c) == version, F.lit(False))


def host_prefix(c) -> Column:
    """Add /32 or /128 to an address written without a length."""
    c = _col(c)
    return (
        F.when(c.contains("/"), c)
        .when(c.contains(":"), F.concat(c, F.lit("/128")))
        .otherwise(F.concat(c, F.lit("/32")))
    )


def ipv4_num(c) -> Column:
    """Dotted text (a length is ignored) to a long; null if not IPv4."""
    addr = address_part(c)
    octets = [
        F.substring_index(addr, ".", 1),
        F.substring_index(F.substring_index(addr, ".", 2), ".", -1),
        F.substring_index(F.substring_index(addr, ".", -2), ".", 1),
        F.substring_index(addr, ".", -1),
    ]
    n = [o.try_cast("bigint") for o in octets]
    value = n[0] * 16777216 + n[1] * 65536 + n[2] * 256 + n[3]
    return F.when(addr.rlike(V4_PATTERN), value)


def ipv4_text(n) -> Column:
    n = _col(n)
    return F.concat_ws(
        ".", *[
            F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)
        ]
    )


def let(value: Column, body) -> Column:
    """Bind ``value`` once so that ``body`` can use it many times cheaply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v6_groups(text: Column) -> Column:
    """Eight group values of IPv6 text; null if it is not IPv6."""

    def from_halves(halves: Column) -> Column:
        def groups(i):
            part = F.coalesce(F.get(halves, F.lit(i)), F.lit(""))
            return F.filter(F.split(part, ":"), lambda g: g != "")

        def fill(sides: Column) -> Column:
            left, right = sides["l"], sides["r"]
            missing = F.lit(8) - F.size(left) - F.size(right)
            shortened = F.size(halves) == 2
            whole = F.concat(
                left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
            return F.when(
                (shortened & (missing >= 1)) | (~shortened & (missing == 0)),
                F.transform(whole, lambda g: F.conv(g, 16, 10).cast("bigint")),
            )

        return let(F.struct(groups(0).alias("l"), groups(1).alias("r")), fill)

    return F.when(text.rlike(V6_PATTERN), let(F.split(text, "::"), from_halves))


def _dotted_tail_as_hex(addr: Column) -> Column:
    low = ipv4_num(F.regexp_extract(addr, r"(\d+\.\d+\.\d+\.\d+)$", 1))
    as_hex = F.concat(
        F.regexp_replace(addr, r"\d+\.\d+\.\d+\.\d+$", ""),
        F.hex(F.shiftright(low, 16)), F.lit(":"), F.hex(low.bitwiseAND(F.lit(65535))),
    )
    return F.when(addr.contains("."), as_hex).otherwise(addr)


def _v6_struct(addr: Column) -> Column:
    def pack(g, first):
        w = [F.get(g, F.lit(first + i)) for i in range(4)]
        return (F.shiftleft(w[0], 48).bitwiseOR(F.shiftleft(w[1], 32))
                .bitwiseOR(F.shiftleft(w[2], 16)).bitwiseOR(w[3]))

    return let(
        _v6_groups(_dotted_tail_as_hex(addr)),
        lambda g: F.when(
            g.isNotNull(),
            F.struct(F.lit(6).alias("fam"), pack(g, 0).alias("hi"), pack(g, 4).alias("lo")),
        ),
    ).cast(IP_STRUCT)


def ip_struct(c) -> Column:
    """Address text (a length is ignored) to the ``(fam, hi, lo)`` struct."""
    addr = address_part(c)
    v4 = F.struct(F.lit(4).alias("fam"), F.lit(0).cast("bigint").alias("hi"),
                  ipv4_num(addr).alias("lo"))
    return (
        F.when(addr.contains(":"), _v6_struct(addr))
        .when(addr.rlike(V4_PATTERN), v4.cast(IP_STRUCT))
    )


def mask64(bits: Column) -> Column:
    """Long whose first ``bits`` bits are set (0..64)."""
    return (
        F.when(bits <= 0, F.lit(0).cast("bigint"))
        .when(bits >= 64, F.lit(-1).cast("bigint"))
        .otherwise(F.call_function("shiftleft", F.lit(-1).cast("bigint"),
                                   (F.lit(64) - bits).cast("int")))
    )


def mask_address(addr: Column, plen: Column) -> Column:
    """Network of ``plen`` bits holding the address struct."""

    def masked(a: Column) -> Column:
        v4_mask = F.call_function("shiftright", mask64(plen), F.lit(32)).bitwiseAND(
            F.lit(0xFFFFFFFF))
        v6 = a["fam"] == 6
        return F.when(
            a.isNotNull(),
            F.struct(
                a["fam"].alias("fam"),
                F.when(v6, a["hi"].bitwiseAND(mask64(plen))).otherwise(a["hi"]).alias("hi"),
                F.when(v6, a["lo"].bitwiseAND(mask64(plen - 64)))
                .otherwise(a["lo"].bitwiseAND(v4_mask)).alias("lo"),
            ),
        )

    return let(addr, masked)


# Address or prefix text worth parsing; cheap, and one reference to its input, so
# that filters on it stay small when they are pushed into a scan.
ADDRESS_TEXT = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9a-fA-F.]*:[0-9a-fA-F:.]*)(?:/\d{1,3})?$"


def looks_like_address(c) -> Column:
    return _col(c).rlike(ADDRESS_TEXT)


def family(c) -> Column:
    return F.when(_col(c).contains(":"), F.lit(6)).otherwise(F.lit(4))


def words(c) -> tuple[Column, Column]:
    """Upper and lower word of address text, never null (-1 if it cannot be read).

    Not being null matters: a join on these adds no null test that would be
    pushed down and parse the text once more.  IPv4 stays in generated code.
    """
    c = _col(c)
    is6 = c.contains(":")
    six = _v6_struct(address_part(c))
    hi = F.when(is6, six["hi"]).otherwise(F.lit(0).cast("bigint"))
    lo = F.when(is6, six["lo"]).otherwise(ipv4_num(c))
    none = F.lit(-1).cast("bigint")
    return F.coalesce(hi, none), F.coalesce(lo, none)


def _same_v4_network(a: Column, b: Column, plen: Column) -> Column:
    shift = (F.lit(32) - plen).cast("int")
    return plen.between(0, 32) & (
        F.call_function("shiftright", ipv4_num(a), shift)
        == F.call_function("shiftright", ipv4_num(b), shift))


def full_len(addr: Column) -> Column:
    return F.when(addr["fam"] == 6, F.lit(128)).otherwise(F.lit(32))


def network(cidr) -> Column:
    """Masked struct of a prefix; host bits are dropped, never an error."""
    cidr = _col(cidr)

    def masked(a: Column) -> Column:
        plen = F.coalesce(prefix_len(cidr), full_len(a))
        return F.when(plen.between(F.lit(0), full_len(a)), mask_address(a, plen))

    return let(ip_struct(cidr), masked)


def cidr_bounds(cidr) -> Column:
    """``struct(lo, hi, plen)`` of an IPv4 prefix as longs."""
    cidr = _col(cidr)
    plen = F.coalesce(prefix_len(cidr), F.lit(32))
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - plen)
    n = ipv4_num(cidr)
    lo = n - F.pmod(n, size)
    return F.when(
        n.isNotNull() & plen.between(0, 32),
        F.struct(lo.alias("lo"), (lo + size - 1).alias("hi"), plen.alias("plen")),
    )


def same_subnet(a, b) -> Column:
    """Networks of two interface addresses are equal (length included)."""
    a, b = _col(a), _col(b)
    la, lb = prefix_len(host_prefix(a)), prefix_len(host_prefix(b))
    v6 = a.contains(":") | b.contains(":")
    return F.coalesce(
        (la == lb) & F.when(v6, network(a) == network(b)).otherwise(_same_v4_network(a, b, la)),
        F.lit(False))


def _literal_address(n: ipaddress._BaseAddress) -> tuple[int, int, int]:
    value = int(n)
    if n.version == 4:
        return 4, 0, value

    def signed(x):
        return x - (1 << 64) if x >= (1 << 63) else x
    return 6, signed(value >> 64), signed(value & ((1 << 64) - 1))


def literal_words(text: str) -> tuple[int, int, int]:
    """Family, upper and lower word of a literal address."""
    return _literal_address(ipaddress.ip_address(text.split("/")[0]))


def literal_struct(text: str) -> Column:
    fam, hi, lo = literal_words(text)
    return F.struct(F.lit(fam).alias("fam"), F.lit(hi).cast("bigint").alias("hi"),
                    F.lit(lo).cast("bigint").alias("lo"))


def in_subnet(c, cidr: str) -> Column:
    """Address column inside a literal prefix; empty or invalid text is false."""
    net = ipaddress.ip_network(cidr, strict=False)
    fam, hi, lo = _literal_address(net.network_address)
    if fam == 4:
        # Plain range test: stays in generated code.
        n = ipv4_num(c)
        return F.coalesce(n.between(lo, lo + net.num_addresses - 1), F.lit(False))
    wanted = F.struct(F.lit(fam).alias("fam"), F.lit(hi).cast("bigint").alias("hi"),
                      F.lit(lo).cast("bigint").alias("lo"))
    return F.coalesce(
        mask_address(ip_struct(c), F.lit(net.prefixlen)) == wanted, F.lit(False))


def any_in_subnet(array_col, cidr: str) -> Column:
    """Any element of an address list inside a literal prefix."""
    return F.coalesce(F.exists(_col(array_col), lambda a: in_subnet(a, cidr)), F.lit(False))


def addr_in_cidr(addr, cidr) -> Column:
    """Address inside the row's own prefix; the IPv4 default prefix never counts."""
    addr, cidr = _col(addr), _col(cidr)

    def v6_inside() -> Column:
        masked = let(ip_struct(addr), lambda a: mask_address(
            a, F.coalesce(prefix_len(cidr), full_len(a))))
        return masked == network(cidr)

    v6 = addr.contains(":") & cidr.contains(":")
    mixed = addr.contains(":") != cidr.contains(":")
    plen = F.coalesce(prefix_len(cidr), F.lit(32))
    # Nothing is parsed where the families differ.
    inside = F.when(mixed, F.lit(False)).when(v6, v6_inside()).otherwise(
        _same_v4_network(addr, cidr, plen))
    return F.coalesce(inside & (cidr != "0.0.0.0/0"), F.lit(False))


def is_default(cidr, address: str) -> Column:
    """The prefix is the default route of the literal address's family."""
    return _col(cidr).rlike(r"^[0:]+:[0:]*/0$" if ":" in address else r"^0\.0\.0\.0/0$")


def addr_in_any_cidr(addr, cidrs) -> Column:
    """Address inside any prefix of the row's own list."""
    return F.coalesce(F.exists(_col(cidrs), lambda p: addr_in_cidr(_col(addr), p)), F.lit(False))


def is_prefix(c) -> Column:
    c = _col(c)
    return F.coalesce(
        c.contains("/") & network(c).isNotNull()
        & (mask_address(ip_struct(c), prefix_len(c)) == ip_struct(c)), F.lit(False))


def unsigned_key(c: Column) -> Column:
    """Order-preserving form of a 64-bit word read as unsigned."""
    return c.bitwiseXOR(F.lit(_SIGN))
