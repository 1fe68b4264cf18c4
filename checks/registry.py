"""Registry of queries and the projections they read.

A projection derives a network table from the given tables.  It is written once
in SQL that both engines run; three macros cover what they spell differently:
``@ms(ts)`` epoch milliseconds, ``@div(a, b)`` integer division and
``@list(a, b)`` a list literal.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

PROJECTIONS: dict[str, str] = {}
QUERIES: dict[str, Query] = {}


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Inputs], DataFrame]
    sql: str | None
    headline: bool = False


def _split_args(body: str) -> list[str]:
    out, depth, current = [], 0, ""
    for ch in body:
        if ch == "," and depth == 0:
            out.append(current.strip())
            current = ""
            continue
        depth += ch in "([" or 0
        depth -= ch in ")]" or 0
        current += ch
    return [*out, current.strip()]


_SPELLINGS = {
    "spark": {
        "ms": lambda a: f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {a[0]})",
        "div": lambda a: f"(({a[0]}) div ({a[1]}))",
        "list": lambda a: f"array({', '.join(a)})",
    },
    "duckdb": {
        "ms": lambda a: f"(epoch_us({a[0]}) // 1000)",
        "div": lambda a: f"(({a[0]}) // ({a[1]}))",
        "list": lambda a: f"list_value({', '.join(a)})",
    },
}


def spell(sql: str, engine: str) -> str:
    """Replace the macros, innermost last so that they may nest."""
    while True:
        found = list(re.finditer(r"@(ms|div|list)\(", sql))
        if not found:
            return sql
        m = found[-1]
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        args = _split_args(sql[m.end():i - 1])
        sql = sql[:m.start()] + _SPELLINGS[engine][m[1]](args) + sql[i:]


def projection(name: str, sql: str) -> None:
    PROJECTIONS[name] = sql


def needed(sql: str) -> list[str]:
    """Projections a statement uses, dependencies first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:from|join)\s+(\w+)", text, re.IGNORECASE):
            if name in PROJECTIONS and name not in out:
                visit(PROJECTIONS[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def duckdb_sql(sql: str) -> str:
    """The statement with its projections as common table expressions."""
    ctes = [f"{n} AS ({spell(PROJECTIONS[n], 'duckdb')})" for n in needed(sql)]
    body = spell(sql, "duckdb").strip()
    if not ctes:
        return body
    if re.match(r"with\s+recursive\b", body, re.IGNORECASE):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + re.sub(
            r"(?i)^with\s+recursive", "", body)
    if re.match(r"with\b", body, re.IGNORECASE):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Inputs:
    """Given tables and projections as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in PROJECTIONS:
            return self.sql(PROJECTIONS[name])
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def sql(self, sql: str) -> DataFrame:
        text = spell(sql, "spark")
        ctes = [f"{n} AS ({spell(PROJECTIONS[n], 'spark')})" for n in needed(sql)]
        names = [t for t in TABLES if re.search(
            rf"\b(?:from|join)\s+{t}\b", " ".join([text, *ctes]), re.IGNORECASE)]
        for t in names:
            pattern = rf"(?i)\b(from|join)\s+{t}\b"
            text = re.sub(pattern, rf"\1 {{{t}}}", text)
            ctes = [re.sub(pattern, rf"\1 {{{t}}}", c) for c in ctes]
        if ctes:
            text = "WITH " + ", ".join(ctes) + " " + text
        return self.spark.sql(text, **{t: self.table(t) for t in names})


def query(name: str, sql: str | None = None, headline: bool = False):
    def wrap(fn):
        QUERIES[name] = Query(name, fn, sql, headline)
        return fn
    return wrap
