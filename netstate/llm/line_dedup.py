"""Lines repeated across documents, dropped all but in the first document.

Only DataFrame functions.  Each line of ten or more code points becomes a row of
hashes, document and position; no text is shuffled.  Rows are partitioned by
the range of their hash and sorted by hash, document and position, so that a
running first value names the first document of each line.  What a document
loses comes back as a run-length bitmap.

A line that holds a large share of all rows would fill one partition.  A sample
of documents names such lines; their first document is found by an aggregate
that combines before it shuffles, and their later rows are dealt out evenly.
The sample steers the plan only: the answer is the same whatever it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netstate.llm.common import shuffle_partitions

MIN_LENGTH = 10
SAMPLED_DOCUMENTS = 20_000
MAX_HOT = 1_000
#: What is stripped from both ends, and the letters lower-cased.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")


def _ascii_lower(c: Column) -> Column:
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, pos, h1, h2) of the lines that may be dropped.

    tie tells apart texts under the same doc_id; the two hashes make 128 bits.
    """
    lines = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), _tie().alias("tie"),
        F.posexplode(_lines()).alias("pos", "line"))
    key = _ascii_lower(F.btrim("line", F.lit(BLANKS)))
    rows = lines.select("doc_id", "tie", "pos", key.alias("key"))
    rows = rows.where(F.char_length("key") >= MIN_LENGTH)
    return rows.select("doc_id", "tie", "pos", F.xxhash64("key").alias("h1"),
                       F.xxhash64(F.lit(1), "key").alias("h2"))


def _tie() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _hot_hashes(docs: DataFrame, partitions: int) -> list[int]:
    """Hashes that seem to hold over a quarter of a partition's share; at most MAX_HOT."""
    n = docs.count()
    if not n:
        return []
    sample = docs.sample(fraction=min(1.0, SAMPLED_DOCUMENTS / n), seed=7)
    counts = line_rows(sample).groupBy("h1").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "h1").limit(MAX_HOT).collect()
    total = line_rows(sample).count()
    return [r["h1"] for r in top if r["n"] >= max(20, total / (4 * partitions))]


def dropped_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, n_dropped, runs): per document with dropped lines, which ones.

    runs is its keep bitmap, run-length compressed: (start, length) of each run of
    dropped lines, in order; all other lines are kept.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    rows, hot = line_rows(docs), _hot_hashes(docs, partitions)
    # Hashes are uniform, so equal ranges of them are partitions of equal size.
    share = F.shiftrightunsigned("h1", 11).cast("double") / F.lit(float(1 << 53))
    place, known = F.floor(share * partitions).cast("int"), F.lit(None).cast("long")
    if hot:
        first = rows.where(F.col("h1").isin(hot)).groupBy("h1", "h2").agg(
            F.min("doc_id").alias("known"))
        # At most MAX_HOT hashes, whatever the size of the table.
        rows = rows.join(F.broadcast(first), ["h1", "h2"], "left").where(
            "known is null or doc_id > known")
        known = F.col("known")
        place = F.when(known.isNotNull(), F.pmod(
            F.xxhash64("doc_id", "pos"), F.lit(partitions)).cast("int")).otherwise(place)
    ranged = rows.select("doc_id", "tie", "pos", "h1", "h2", known.alias("known"),
                         place.alias("range")).repartitionById(partitions, "range")
    order = Window.partitionBy("range", "h1", "h2").orderBy("doc_id", "pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = ranged.withColumn("first", F.coalesce("known", F.first("doc_id").over(order)))
    dropped = found.where("doc_id > first").select("doc_id", "tie", "pos")
    lost = dropped.groupBy("doc_id", "tie").agg(
        F.array_distinct(F.sort_array(F.collect_list("pos"))).alias("lost"))
    return lost.select("doc_id", "tie", F.size("lost").alias("n_dropped"),
                       _runs("lost").alias("runs"))


def _runs(lost: str) -> Column:
    """Ascending positions as (start, length) of runs."""
    size = F.size(lost)
    starts = F.filter(lost, lambda x, i: (i == 0) | (
        F.element_at(lost, F.greatest(i, F.lit(1))) != x - 1))
    ends = F.filter(lost, lambda x, i: (i == size - 1) | (
        F.element_at(lost, F.least(i + 2, size)) != x + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(
        a.alias("start"), (b - a + 1).alias("length")))


def _kept_text() -> Column:
    """The lines between the dropped runs, joined."""
    n = F.size("__lines")
    edges = F.concat(
        F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"))), F.col("__runs"))
    begins = F.transform(edges, lambda r: r["start"] + r["length"])
    stops = F.concat(F.transform("__runs", lambda r: r["start"]), F.array(n))
    kept = F.zip_with(begins, stops, lambda a, b: F.when(
        b > a, F.array_join(F.slice("__lines", a + 1, b - a), "\n")))
    joined = F.array_join(F.filter(kept, lambda x: x.isNotNull()), "\n")
    return F.when(F.col("__runs").isNull(), F.col("__text")).otherwise(joined)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with their text without repeated lines, plus __n_lines and __n_dropped.

    A line's key is the line without blanks at its ends, A-Z lower-cased.  Keys of at
    least ten code points found under several doc_ids stay only in the smallest
    of these.  A null or empty text is one empty line and becomes an empty text;
    texts without a doc_id stay whole and count for no other; texts under the
    same doc_id are one document to others and keep what they share.  Other
    columns are passed on.
    """
    keep = [F.col(c) for c in docs.columns if c != "text"]
    runs = dropped_runs(docs).select(
        F.col("doc_id").alias("__doc"), F.col("tie").alias("__tie"),
        F.col("n_dropped").alias("__n"), F.col("runs").alias("__runs"))
    joined = docs.withColumn("__own", _tie()).join(
        runs, (F.col("doc_id") == F.col("__doc")) & (F.col("__own") == F.col("__tie")), "left")
    lines = joined.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    lines = lines.withColumn("__lines", F.split("__text", "\n"))
    return lines.select(
        *keep, _kept_text().alias("text"), F.size("__lines").cast("long").alias("__n_lines"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("__n_dropped"))
