"""Near copies by shingle sets: five-word shingles, Jaccard similarity of 0.8 or more.

Each text becomes the set of its shingles' hashes.  Equal sets are one node from
the start.  MinHash bands name candidates; a pair at 0.8 shares a band with a
probability of 0.998, one at 0.9 or more nearly always.  A pair is first held
against its sketches, a byte of each of 120 MinHashes (one at 0.8 fails this once in
three million), so that few sets move, and then verified on the sets themselves.

A band value may be shared by a large group: copies of one text, or texts with a
common frame.  Each node meets the smallest node under its value, which
settles groups of copies.  Nodes of different components under a value then
meet each other where there are at most ``SMALL`` of them.  A larger group is
divided by bands of further hashes, which again keep a pair at 0.8 together
with a probability of 0.998 but part less similar ones, and so on until all groups
are small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from netstate.llm.common import ASCII_LOWER, cut_lineage, per_batch, text_bytes
from netstate.operators import topology
from netstate.operators.topology import connected_components
from netstate.session import shuffle_if_large

SEED = 42
WIDTH = 5
#: The least similarity, as a fraction.
LEAST = 4, 5
BANDS, BAND_ROWS = 20, 6
#: Of 120 sketch bytes a pair at 0.8 shares 96 on average; this is five deviations less.
MIN_SHARED = 74
SMALL = 32
AT_ONCE = 512


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; few words are one shingle."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(
            [0, *ends[:last - 1].tolist()], (ends[-last:] - 1).tolist(), strict=True)),
        np.uint64, last))


def least_hashes(hashes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The MinHashes of a set, a row for each band."""
    rng = np.random.default_rng(seed)
    factors, terms = rng.integers(0, 1 << 63, (2, BANDS * BAND_ROWS), np.uint64)
    factors = factors << np.uint64(1) | np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), AT_ONCE):
        mixed = hashes[at:at + AT_ONCE, None] * factors + terms
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, (mixed * factors).min(0), out=least)
    return least.reshape(BANDS, BAND_ROWS)


def bands(least: np.ndarray) -> list[int]:
    """The signed band values of MinHashes."""
    values = [xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(least)]
    return np.asarray(values, np.uint64).view(np.int64).tolist()


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands, sketch, shingles) of each document's whole text.

    Texts of equal sets have the same node; shingles are 32 bits of each hash.  A
    text without words has no bands.
    """
    def run(batch):
        sets = [shingle_hashes(t) for t in batch["text"]]
        names = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
        least = [least_hashes(s) for s in sets]
        yield {"doc_id": batch["doc_id"],
               "node": np.asarray(names, np.uint64).view(np.int64).tolist(),
               "bands": [bands(m) if len(s) else [] for m, s in zip(least, sets, strict=True)],
               "sketch": [m.ravel().astype(np.uint8).view(np.int8).tolist() for m in least],
               "shingles": [np.unique(s.astype(np.uint32)).view(np.int32) for s in sets]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return per_batch(
        rows, "doc_id long, node long, bands array<long>, sketch array<byte>, "
              "shingles array<int>", run, 256)


def further_bands(sets: DataFrame, level: int) -> DataFrame:
    """(node, value) of the bands of further hashes of sets (node, shingles)."""
    def run(batches):
        for batch in batches:
            # A view of the numbers: lists of long texts would be large as objects.
            lists = batch.column(1)
            values = lists.values.to_numpy().view(np.uint32)
            edges = lists.offsets.to_numpy()
            for at in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(at, 256).to_numpy()
                found = [bands(least_hashes(values[a:b].astype(np.uint64), SEED + level))
                         for a, b in zip(edges[at:at + len(part)], edges[at + 1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part, BANDS)), pa.array(np.ravel(found))],
                    names=["node", "further"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, further long")


def _sets(rows: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """One row of each wanted node; what is wanted may come from an explode."""
    return rows.select("node", *columns).join(
        _small(wanted.select("node").distinct()), "node", "left_semi").dropDuplicates(["node"])


def _small(df: DataFrame) -> DataFrame:
    """A table that may be broadcast if it is small."""
    return shuffle_if_large(df, topology.NODE_BYTES)


def _both(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Pairs with a column of both nodes, as x and y."""
    left = sets.select(F.col("node").alias("a"), F.col(name).alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col(name).alias("y"))
    return pairs.join(_small(left), "a").join(_small(right), "b")


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough."""
    def ends(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array("a", "b")).alias("node"))

    pairs = cut_lineage(pairs.distinct())
    facts = F.struct(F.size("shingles").alias("n"), "sketch")
    sketches = cut_lineage(_sets(rows.withColumn("facts", facts), ends(pairs), "facts"))
    # Sizes and sketches exclude most pairs that can't be similar.
    least, most = F.least(F.col("x.n"), F.col("y.n")), F.greatest(F.col("x.n"), F.col("y.n"))
    shared = F.size(F.filter(F.zip_with("x.sketch", "y.sketch", lambda p, q: p == q), _true))
    near = cut_lineage(_both(pairs, sketches, "facts").where(
        least * LEAST[1] >= most * LEAST[0]).where(shared >= MIN_SHARED).select("a", "b"))
    sets = cut_lineage(_sets(rows, ends(near), "shingles"))
    met = _both(near, sets, "shingles")
    both = F.size(F.array_intersect("x", "y"))
    return met.where(both * LEAST[1] >= (
        F.size("x") + F.size("y") - both) * LEAST[0]).select("a", "b")


def _true(c: Column) -> Column:
    return c


def _components(links: DataFrame) -> DataFrame:
    """(node, component) of linked nodes."""
    return connected_components(
        links.select(F.col("a").alias("src"), F.col("b").alias("dst")), [])


def _shared(kept: DataFrame) -> DataFrame:
    """(node, value) under values of several nodes, with their number and smallest node."""
    groups = kept.groupBy("value").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("a")).where("n > 1")
    return kept.join(_small(groups), "value")


def _all_pairs(of: DataFrame) -> DataFrame:
    """Pairs of different components in small groups (node, value, component)."""
    following = Window.partitionBy("value").orderBy("node").rowsBetween(1, SMALL)
    met = of.withColumn("others", F.collect_list(F.struct("node", "component")).over(following))
    met = met.select("node", "component", F.explode("others").alias("o")).where(
        F.col("o.component") != F.col("component"))
    return met.select(F.col("node").alias("a"), F.col("o.node").alias("b"))


def near_copies(docs: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) for documents (doc_id, text).

    ``linked`` has further pairs (a, b) of doc_ids to verify, such as another method finds.

    component_id is the smallest doc_id reachable over pairs of similar texts, the own
    one included.  Texts without words are alike.  Rows without a doc_id link
    others but are nobody's component; a component of such rows alone has a null id.
    """
    rows = cut_lineage(nodes(docs))
    kept = cut_lineage(_shared(rows.select("node", F.explode("bands").alias("value")).distinct()))
    links = level = None
    while links is None or kept.limit(1).count():
        stars = kept.where("a != node").select("a", F.col("node").alias("b"))
        if links is not None:
            stars = _apart(stars, found)
        first = verified(stars, rows)
        links = cut_lineage(first if links is None else links.unionByName(first))

        found = cut_lineage(_components(links).select("node", "component"))
        of = kept.select("node", "value").join(_small(found), "node", "left").select(
            "node", "value", F.coalesce("component", "node").alias("component"))
        groups = of.groupBy("value").agg(
            F.count(F.lit(1)).alias("n"), F.min("component").alias("low"),
            F.max("component").alias("high")).where("low != high").select("value", "n")
        of = cut_lineage(of.join(_small(groups), "value"))
        links = cut_lineage(links.unionByName(
            verified(_all_pairs(of.where(F.col("n") <= SMALL)), rows)))

        large = of.where(F.col("n") > SMALL).select("node", "value")
        level = 1 if level is None else level + 1
        if large.limit(1).count():
            found = cut_lineage(_components(links).select("node", "component"))
            more = further_bands(_sets(rows, large, "shingles"), level)
            parts = large.join(cut_lineage(more).hint("merge"), "node").select(
                "node", F.xxhash64("value", "further").alias("value")).distinct()
            kept = cut_lineage(_shared(parts))
        else:
            kept = kept.limit(0)

    if linked is not None:
        ends = rows.select("doc_id", "node")
        for end, node in (("a", "x"), ("b", "y")):
            linked = linked.join(ends.select(
                F.col("doc_id").alias(end), F.col("node").alias(node)).hint("merge"), end)
        named = linked.where("x != y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        links = links.unionByName(verified(named, rows))

    found = _components(links)
    of = rows.select("doc_id", "node").join(_small(found), "node", "left").select(
        "doc_id", F.coalesce("component", "node").alias("component"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return of.join(least.hint("merge"), "component").select("doc_id", "component_id")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs that no component joins yet."""
    for end in ("a", "b"):
        pairs = pairs.join(_small(found.select(F.col("node").alias(end), F.col(
            "component").alias(f"__{end}"))), end, "left").withColumn(f"__{end}", F.coalesce(f"__{end}", end))
    return pairs.where("__a != __b").select("a", "b")
