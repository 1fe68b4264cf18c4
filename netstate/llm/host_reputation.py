"""Verdicts on urls: rules first, then the reputation of their host.

Only DataFrame functions.  Pages that a rule judges are the labelled outcomes
(or a table of outcomes that the caller has).  A host's rate of blocked pages is
shrunk by a beta-binomial prior: its mean is the posterior mean of the registered
domain, whose own prior comes from the suffix, whose prior comes from all
outcomes.  How strongly a level is drawn to the one above is estimated from how far
its groups scatter around it (method of moments).  A host is blocked only if
its rate exceeds ``MAX_BLOCKED`` by a posterior bound: mean minus Z standard
deviations, which holds with a probability of Z^2 / (1 + Z^2) whatever the shape
(Cantelli).

Only blocked hosts are joined back to the pages.  Those that hold more than a
partition's share of all pages are at most as many as there are partitions and
are broadcast, the pages of all others are joined by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netstate.llm.common import cut_lineage, shuffle_partitions
from netstate.llm.line_dedup import LOWER, UPPER

MAX_BLOCKED, Z = 0.5, 2.0
#: Bounds of the correlation inside groups, and what is taken where nothing tells it.
LEAST_TIE, MOST_TIE, DEFAULT_TIE = 0.001, 0.9, 0.1

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, in lower case; else empty."""
    found = F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without a host part."""
    return F.coalesce(F.regexp_extract(
        url.cast("string"), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def domain_of(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The registered domain: the label before the suffix, and the suffix.

    A suffix is the last label, or one of ``suffixes``, which have two (co.uk).
    """
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(
        two) if suffixes else two


def apply_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` with __host, __path, __rule and __ruled: the longest rule that fits.

    A rule (verdict, host, path) fits its host and all hosts below it if the url's path
    starts with its own.  Of equally long ones that with the longer host wins, then
    the first in order.  The list is meant to be short: each page is held against it.
    """
    out = pages.withColumn("__host", host_of(F.col("url"))).withColumn(
        "__path", path_of(F.col("url")))
    name = verdict = None
    host, path = F.col("__host"), F.col("__path")
    for ruled, of, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        name = F.when(fits, of + start) if name is None else name.when(fits, of + start)
        verdict = F.when(fits, ruled) if verdict is None else verdict.when(fits, ruled)
    nothing = F.lit(None).cast("string")
    return out.withColumn("__rule", nothing if name is None else name).withColumn(
        "__ruled", nothing if verdict is None else verdict)


def _tie(groups: DataFrame) -> Column:
    """Strength of a level's prior from its groups (n, bad) and their prior means m."""
    n, bad, m = F.col("n"), F.col("bad"), F.col("m")
    noise = m * (1 - m)
    over = F.sum((bad - n * m) * (bad - n * m) - n * noise)
    share = F.sum(n * (n - 1) * noise)
    rho = F.when(share > 0, F.least(F.lit(MOST_TIE), F.greatest(F.lit(LEAST_TIE), over / share)))
    rho = F.coalesce(rho, F.lit(DEFAULT_TIE))
    return groups.where("n > 0").agg(((1 - rho) / rho).alias("strength")).scalar()


def _shrunk(groups: DataFrame) -> DataFrame:
    """Groups with their posterior mean instead of the prior one, and the strength."""
    known = groups.withColumn("strength", _tie(groups))
    return known.withColumn("mean", (F.col("bad") + F.col("strength") * F.col("m")) / (
        F.col("n") + F.col("strength")))


def reputations(outcomes: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(host, pages, n, bad, mean, lower) of each host of ``outcomes`` (host, bad).

    bad is 1 or 0, or null for pages without an outcome, whose hosts are judged by
    what is known of their domain.  mean is the posterior mean of the rate of bad
    pages and lower its bound.  Without any outcome all hosts have the mean 0.5.
    """
    hosts = outcomes.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = cut_lineage(hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn(
        "domain", domain_of(F.col("host"), suffixes)))

    def totals(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    domains = cut_lineage(totals(hosts, "domain", "suffix"))
    tops = cut_lineage(totals(domains, "suffix"))
    overall = tops.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (
        F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m")).scalar()
    tops = _shrunk(tops.withColumn("m", overall)).select("suffix", F.col("mean").alias("m"))
    domains = cut_lineage(domains.join(cut_lineage(tops), "suffix"))
    domains = _shrunk(domains).select("domain", F.col("mean").alias("m"))
    hosts = _shrunk(cut_lineage(hosts.join(cut_lineage(domains), "domain")))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return hosts.select("host", "pages", "n", "bad", "mean",
                        (F.col("mean") - Z * spread).alias("lower"))


def judge(pages: DataFrame, rules: list[Rule], outcomes: DataFrame | None = None,
          suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` (url) with host, path, rule and verdict, allow or block.

    The verdict is that of the longest rule that fits, else block where the host's
    bound exceeds ``MAX_BLOCKED``, else allow.  ``outcomes`` (url, bad: 1, 0) are
    labelled pages; without them the pages that rules judge are.  A null url, or one
    without ://, has an empty host, which is judged like any other host.  Each
    row has an answer, repeated ones the same; columns that are called like the
    answer's are replaced, all others are passed on.  An empty table has an empty answer.
    """
    found = apply_rules(pages, rules)
    bad = F.when(F.col("__ruled").isNotNull(), (F.col("__ruled") == "block").cast("long"))
    seen = found.select(F.col("__host").alias("host"), bad.alias("bad"))
    if outcomes is not None:
        seen = seen.withColumn("bad", F.lit(None).cast("long")).unionByName(outcomes.select(
            host_of(F.col("url")).alias("host"), F.col("bad").cast("long").alias("bad")))
    known = cut_lineage(reputations(seen, suffixes))
    blocked = known.where(F.col("lower") > MAX_BLOCKED).select(
        F.col("host").alias("__of"), (F.col("pages") * shuffle_partitions(pages.sparkSession)
                                      > known.agg(F.sum("pages")).scalar()).alias("__hot"))
    blocked = cut_lineage(blocked)
    # At most one hot host for each partition, as each holds more than a partition's share.
    hot = blocked.where("__hot").select("__of", F.lit("block").alias("__method"))
    cold = blocked.where("not __hot").select("__of", F.lit("block").alias("__method"))
    by_host = F.col("__host") == F.col("__of")
    marked = found.join(F.broadcast(hot), by_host, "left").drop("__of")
    open_ = F.col("__ruled").isNull() & F.col("__method").isNull()
    settled = marked.where(~open_)
    rest = marked.where(open_).drop("__method").join(cold, by_host, "left").drop("__of")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return settled.unionByName(rest).select(
        *kept, F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("__rule").alias("rule"),
        F.coalesce("__ruled", "__method", F.lit("allow")).alias("verdict"))
