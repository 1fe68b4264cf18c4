"""The same helpers as temporary SQL functions, for free-form predicates."""

from __future__ import annotations

from pyspark.sql import SparkSession

def _let(value: str, name: str, body: str) -> str:
    """SQL for the body with a name bound to a value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hex(a: str) -> str:
    """SQL for an address as 8 or 32 hex digits, null for what is no address."""
    v4 = ("CASE WHEN h rlike '^[0-9]{1,3}([.][0-9]{1,3}){3}$' "
          "AND forall(split(h, '[.]'), o -> cast(o AS INT) < 256) "
          "THEN array_join(transform(split(h, '[.]'), o -> lpad(hex(cast(o AS INT)), 2, '0')), "
          "'') END")
    left = "filter(split(substring_index(h, '::', 1), ':'), x -> x <> '')"
    right = ("CASE WHEN contains(h, '::') THEN filter(split(substring_index(h, '::', -1), ':'), "
             "x -> x <> '') ELSE cast(array() AS ARRAY<STRING>) END")
    fill = "greatest(0, IF(contains(h, '::'), 8 - size(l) - size(r), 0))"
    groups = _let(left, "l", _let(right, "r", f"concat(l, array_repeat('0', {fill}), r)"))
    v6 = _let(groups, "g", "CASE WHEN size(g) = 8 AND forall(g, x -> x rlike '^[0-9a-f]{1,4}$') "
              "AND size(split(h, '::')) < 3 AND NOT h rlike ':::|^:[^:]|[^:]:$' "
              "THEN upper(array_join(transform(g, x -> lpad(x, 4, '0')), '')) END")
    # The tail of an address like ::ffff:1.2.3.4 as two groups.
    tail = ("CASE WHEN b rlike ':[0-9]{1,3}([.][0-9]{1,3}){3}$' THEN concat("
            "regexp_extract(b, '^(.*:)[0-9.]+$', 1), "
            + _let("transform(split(regexp_extract(b, '([0-9.]+)$', 1), '[.]'), "
                   "o -> cast(o AS INT))", "q",
                   "CASE WHEN forall(q, o -> o < 256) THEN concat(lower(hex(q[0] * 256 + q[1])),"
                   " ':', lower(hex(q[2] * 256 + q[3]))) ELSE 'x' END")
            + ") ELSE b END")
    bare = f"lower(substring_index({a}, '/', 1))"
    return _let(_let(bare, "b", tail), "h", f"CASE WHEN contains(h, ':') THEN {v6} ELSE {v4} END")


def _inside(a: str, cidr: str) -> str:
    """SQL for whether an address lies in a prefix; a prefix without length is one address."""
    bits = (f"CASE WHEN contains({cidr}, '/') THEN try_cast(substring_index({cidr}, '/', -1) "
            "AS INT) ELSE 4 * length(n) END")
    rest = ("(p % 4 = 0 OR shiftright(cast(conv(substr(m, p div 4 + 1, 1), 16, 10) AS INT), "
            "4 - p % 4) = shiftright(cast(conv(substr(n, p div 4 + 1, 1), 16, 10) AS INT), "
            "4 - p % 4))")
    same = ("length(m) = length(n) AND p BETWEEN 0 AND 4 * length(n) "
            f"AND left(m, cast(p div 4 AS INT)) = left(n, cast(p div 4 AS INT)) AND {rest}")
    return "coalesce(" + _let(_hex(a), "m", _let(_hex(cidr), "n", _let(bits, "p", same))) \
        + ", false)"


SQL_FUNCTIONS = {
    "ip_version": (
        "(a STRING) RETURNS INT",
        "CASE WHEN contains(a, ':') THEN 6 WHEN contains(a, '.') THEN 4 END",
    ),
    "ipv4_num": (
        "(a STRING) RETURNS BIGINT",
        _let(_hex("a"), "w", "CASE WHEN length(w) = 8 THEN cast(conv(w, 16, 10) AS BIGINT) END"),
    ),
    "in_subnet": (
        "(a STRING, cidr STRING) RETURNS BOOLEAN", _inside("a", "cidr"),
    ),
    "any_in_subnet": (
        "(s ARRAY<STRING>, cidr STRING) RETURNS BOOLEAN",
        f"coalesce(exists(s, e -> {_inside('e', 'cidr')}), false)",
    ),
    "mac_canonical": (
        "(m STRING) RETURNS STRING",
        "CASE WHEN m IS NULL THEN '00:00:00:00:00:00' "
        "WHEN lower(m) rlike '^([0-9a-f]{4}[.:-]){2}[0-9a-f]{4}$|^([0-9a-f]{2}-){5}[0-9a-f]{2}$"
        "|^[0-9a-f]{12}$' "
        "THEN regexp_replace(regexp_replace(lower(m), '[^0-9a-f]', ''), '(..)(?=.)', '$1:') "
        "ELSE lower(m) END",
    ),
    "prefix_len": (
        "(p STRING) RETURNS INT",
        "CASE WHEN contains(p, '/') THEN try_cast(substring_index(p, '/', -1) AS INT) END",
    ),
    "range_to_list": (
        "(r STRING) RETURNS ARRAY<BIGINT>",
        "CASE WHEN r rlike '^ *[0-9]+( *- *[0-9]+)?( *, *[0-9]+( *- *[0-9]+)?)* *$' THEN "
        "flatten(transform(split(r, ','), p -> sequence("
        "try_cast(trim(substring_index(p, '-', 1)) AS BIGINT), "
        "try_cast(trim(substring_index(p, '-', -1)) AS BIGINT)))) "
        "ELSE cast(array() AS ARRAY<BIGINT>) END",
    ),
}

# Table function: one row per number of a range text.
TABLE_FUNCTIONS = {
    "range_rows": (
        "(r STRING) RETURNS TABLE(n BIGINT)",
        "SELECT n FROM (SELECT explode(transform(split(r, ','), p -> sequence("
        "try_cast(trim(substring_index(p, '-', 1)) AS BIGINT), "
        "try_cast(trim(substring_index(p, '-', -1)) AS BIGINT)))) AS ns) "
        "LATERAL VIEW explode(ns) e AS n",
    ),
}


def section_lines():
    """Table function over configuration lines: those of matching sections.

    ``section_lines('pattern', TABLE(t) PARTITION BY device ORDER BY place)`` reads the columns
    device, place and line and returns (device, place, line, section): each
    line that matches and the deeper indented ones below it, numbered by section.  A section
    inside another is part of it, a blank line belongs to the section around it.
    Configurations that come line by line, however long, are read as a stream; nothing is
    kept between batches but the section that is open.
    """
    import re

    import pyarrow as pa
    from pyspark.sql.functions import arrow_udtf

    @arrow_udtf(returnType="device string, place bigint, line string, section int")
    class SectionLines:
        def __init__(self):
            self.open, self.number, self.blanks = None, 0, []

        def eval(self, pattern: pa.Array, table: pa.RecordBatch):
            wanted = re.compile(pattern[0].as_py())
            found = []
            for device, place, line in zip(*(
                    table.column(c).to_pylist() for c in ("device", "place", "line")),
                    strict=True):
                line = line or ""
                if not line.strip():
                    # Part of a section only if the section goes on behind it.
                    if self.open is not None:
                        self.blanks.append((device, place, line, self.number))
                    continue
                depth = len(line) - len(line.lstrip(" \t"))
                if self.open is not None and depth <= self.open:
                    self.open = None
                if self.open is None and wanted.search(line):
                    self.open, self.number, self.blanks = depth, self.number + 1, []
                if self.open is not None:
                    found += [*self.blanks, (device, place, line, self.number)]
                self.blanks = []
            columns = zip(*found, strict=True) if found else ([],) * 4
            yield pa.Table.from_arrays([
                pa.array(list(c), t) for c, t in zip(columns, (
                    pa.string(), pa.int64(), pa.string(), pa.int32()), strict=True)],
                names=["device", "place", "line", "section"])

    return SectionLines


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary functions of this session."""
    for name, (signature, body) in {**SQL_FUNCTIONS, **TABLE_FUNCTIONS}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature} RETURN {body}")
    spark.udtf.register("section_lines", section_lines())
    return sorted([*SQL_FUNCTIONS, *TABLE_FUNCTIONS, "section_lines"])
