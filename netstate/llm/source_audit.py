"""How the sources of each language differ, from terms counted once per distinct text.

Texts that are the same within a language are one text with a number of copies
per source; it is split into terms once, and its counts are weighted.  Texts are
told apart by 128 bits of hash; only one copy of a text moves to its group.

A pair of sources differs at all kept terms, though most occur in neither.  Where
a term does not occur, a source has one fixed probability, so the sum over all
terms is that of two sources without terms, corrected for each one's own terms by
a histogram of their probabilities and for shared terms by a join.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from netstate.llm.common import ASCII_LOWER, cut_lineage, text_bytes

SCALE = 1_000_000_000
MIN_DOCUMENTS, TOP = 3, 200
MAX_HELD, AT_ONCE = 200_000, 64
#: ASCII bytes that are no letters; the bytes of other characters are term bytes.
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_TERMS = bytes(0x20 if b in _NO_LETTERS else ASCII_LOWER[b] for b in range(256))


def _named(docs: DataFrame) -> DataFrame:
    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    return docs.select(plain("lang"), plain("source"), text_bytes().alias("text"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(lang, text, copies): each distinct text of a language with its copies per source."""
    rows = _named(docs).withColumn("h1", F.xxhash64("text")).withColumn(
        "h2", F.xxhash64(F.lit(1), "text"))
    key = ["lang", "h1", "h2"]
    # Both sides are grouped by the same key, so that they meet without moving again.
    copies = rows.groupBy(*key, "source").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(
        F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = rows.groupBy(*key).agg(F.first("text").alias("text"))
    return texts.join(copies, key).select("lang", "text", "copies")


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of distinct texts, in parts still to be added up."""
    fields = [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
              ("n", pa.int64()), ("docs", pa.int64())]

    def flush(held):
        for (lang, source), (n, docs) in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                pa.array([t.decode("utf-8", "replace") for t in n], pa.string()),
                pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                schema=pa.schema(fields))
        held.clear()

    def run(batches):
        held = defaultdict(lambda: (Counter(), Counter()))
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                for row in batch.slice(at, AT_ONCE).to_pylist():
                    words = row["text"].translate(_TERMS).split()
                    own = None
                    for copy in row["copies"]:
                        n, docs = held[row["lang"], copy["source"]]
                        if copy["n"] == 1:
                            n.update(words)
                            docs.update(set(words))
                            continue
                        own = Counter(words) if own is None else own
                        for term, times in own.items():
                            n[term] += times * copy["n"]
                            docs[term] += copy["n"]
                if sum(len(n) for n, _ in held.values()) > MAX_HELD:
                    yield from flush(held)
        yield from flush(held)

    return texts.mapInArrow(
        run, "lang string, source string, term string, n long, docs long")


def _p(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + V)), exact at any size."""
    return F.expr(f"1 + cast((cast({count} + 1 as decimal(20, 0)) * {SCALE}) div "
                  f"({total} + vocabulary) as bigint)")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _pairs(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of sources of a language."""
    one = groups.select("lang", "source", "vocabulary", F.col("p0").alias("s0"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("t0"))
    # As many rows as the answer has: what two sources without terms differ by.
    none = one.join(two, "lang").where("source != item").select(
        "lang", "source", "item", F.when(F.col("vocabulary") > 0, F.expr(
            "vocabulary * (((s0 - t0) * (s0 - t0)) div t0)")).otherwise(0).alias("value"))

    own = kept.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("times"))
    met = own.join(two, "lang").where("source != item")
    there = F.col("times") * (_f("p", "t0") - _f("p0", "t0"))
    back = F.col("times") * (_f("t0", "p") - _f("t0", "p0"))
    alone = met.groupBy("lang", "source", "item").agg(
        F.sum(there).alias("there"), F.sum(back).alias("back"))

    left = kept.select("lang", "term", "source", "p", "p0")
    right = kept.select("lang", "term", F.col("source").alias("item"),
                        F.col("p").alias("t"), F.col("p0").alias("t0"))
    shared = left.join(right, ["lang", "term"]).where("source < item")
    shared = shared.groupBy("lang", "source", "item").agg(
        F.sum(_f("p", "t") - _f("p", "t0") - _f("p0", "t") + _f("p0", "t0")).alias("there"),
        F.sum(_f("t", "p") - _f("t", "p0") - _f("t0", "p") + _f("t0", "p0")).alias("back"))

    parts = alone.unionByName(shared)
    both = none.unionByName(
        parts.select("lang", "source", "item", F.col("there").alias("value"))).unionByName(
        parts.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                     F.col("back").alias("value")))
    return both.groupBy("lang", "source", "item").agg(
        F.sum(F.col("value").cast("decimal(20, 0)")).cast("long").alias("value"))


def audit_sources(docs: DataFrame, min_documents: int = MIN_DOCUMENTS,
                  top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source).

    Part "pair" ranks the other sources of a language by how far they are from a
    source, part "term" the ``top`` terms that a source uses more than its language
    does.  A language keeps the terms of at least ``min_documents`` of its documents.
    Null columns are empty strings, names of their own.  Texts without letters
    have no terms, but their group occurs; a language without kept terms has pairs
    of value 0.  Repeated rows count as often as they occur.  An empty table has an
    empty answer; other columns are ignored.
    """
    counts = term_counts(distinct_texts(docs)).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.withColumn("all_docs", F.sum("docs").over(of_term)).withColumn(
        "all_n", F.sum("n").over(of_term)).withColumn(
        "first", (F.row_number().over(of_term.orderBy("source")) == 1).cast("long"))
    kept = cut_lineage(kept.where(F.col("all_docs") >= min_documents).select(
        "lang", "source", "term", "n", "all_n", "first"))

    langs = kept.groupBy("lang").agg(
        F.sum("first").alias("vocabulary"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _named(docs).select("lang", "source").distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "vocabulary", "lang_total"])
    groups = cut_lineage(groups.withColumn(
        "p0", F.when(F.col("vocabulary") > 0, _p("0", "total")).otherwise(0)))

    kept = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _p("n", "total").alias("p"), "p0",
        _p("all_n", "lang_total").alias("q"))
    terms = kept.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _f("p", "q").alias("value"))
    pairs = _pairs(groups, kept).select("lang", "source", F.lit("pair").alias("part"), "item",
                                        "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(
        F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(
        terms.withColumn("rank", rank).where(F.col("rank") <= top))
