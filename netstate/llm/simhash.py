"""Near copies by SimHash: fingerprints at three or fewer differing bits.

A fingerprint is cut into two segments of 32 bits.  Three differing bits leave
at most one in one of the segments, so two linked fingerprints either share a
segment or differ there in one bit.  For the latter, each segment is indexed
with each of its bits left out: an equality join brings a fingerprint with a
zero at that place to those with a one there, each pair once.  The join
verifies the whole distance, so that only links leave it.  These joins go by
shuffle: a fingerprint has 32 rows in each segment, which no estimate of size counts.

Equal fingerprints are one row from the start, groups of exact copies cost
nothing later.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from netstate.llm.common import ASCII_LOWER, cut_lineage, per_batch, text_bytes
from netstate.operators.topology import NODE_BYTES, connected_components
from netstate.session import shuffle_if_large

SEED = 42
WIDTH = 3
MAX_BITS = 3
SEGMENT = 32


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The signed 64-bit SimHash of a text: word shingles, repeats included."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends.tolist()]
    last = max(1, len(words) - width + 1)
    stops = (ends[-last:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), 0
    for at in range(0, last, 65536):
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(
                starts[at:at + 65536], stops[at:at + 65536], strict=False)),
            np.uint64, min(65536, last - at))
        total += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each document's whole text."""
    def prints(batch):
        yield {"doc_id": batch["doc_id"], "fp": [fingerprint(t) for t in batch["text"]]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return per_batch(rows, "doc_id long, fp long", prints)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): each pair of different fingerprints (column fp) with at most three
    differing bits, a < b."""
    def near(x: Column, y: Column) -> Column:
        return F.bit_count(x.bitwiseXOR(y)) <= MAX_BITS

    mask = F.lit((1 << SEGMENT) - 1)
    halves = prints.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("segment"), F.col("fp").bitwiseAND(mask).alias("value")),
        F.struct(F.lit(1).alias("segment"),
                 F.shiftrightunsigned("fp", SEGMENT).alias("value")))).alias("h"))
    halves = halves.select("fp", "h.segment", "h.value")
    left, right = halves.withColumnRenamed("fp", "a"), halves.withColumnRenamed("fp", "b")
    same = left.join(right.hint("merge"), ["segment", "value"]).where(
        (F.col("a") < F.col("b")) & near(F.col("a"), F.col("b")))

    # Without bit i; one number holds segment, i and the value.
    one = F.expr("shiftleft(1L, i)")
    variants = halves.select(
        "fp", "segment", "value", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT - 1))).alias("i"))
    variants = variants.select(
        "fp", (F.col("value").bitwiseAND(one) != 0).alias("bit"),
        (F.shiftleft(F.col("segment") * SEGMENT + F.col("i").cast("long"), SEGMENT).bitwiseOR(
            F.col("value").bitwiseAND(F.expr("~shiftleft(1L, i)")))).alias("key"))
    zeros = variants.where("not bit").select("key", F.col("fp").alias("a"))
    ones = variants.where("bit").select("key", F.col("fp").alias("b"))
    other = zeros.join(ones.hint("merge"), "key").where(near(F.col("a"), F.col("b")))
    pairs = same.select("a", "b").unionByName(
        other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for documents (doc_id, text).

    component_id is the smallest doc_id reachable over links, the own one included.
    Texts without words (null, empty, blanks) have fingerprint zero and are
    linked like any other.  Rows without a doc_id link others but are nobody's
    component; a component of such rows alone has a null id.  Repeated rows are
    linked to each other, an empty table gives no rows, other columns are ignored.
    """
    rows = cut_lineage(fingerprints(docs))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    found = cut_lineage(links(prints))
    # Components over fingerprints, then their smallest document.
    components = connected_components(
        found.select(F.col("a").alias("src"), F.col("b").alias("dst")), [])
    components = shuffle_if_large(components.withColumnRenamed("node", "fp"), NODE_BYTES)
    of = cut_lineage(prints.join(components, "fp", "left").select(
        "fp", "doc_id", F.coalesce("component", "fp").alias("component")))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = of.join(shuffle_if_large(least, NODE_BYTES), "component").select("fp", "component_id")
    return rows.join(shuffle_if_large(ids, NODE_BYTES), "fp").select("doc_id", "fp", "component_id")
