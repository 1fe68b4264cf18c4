"""Line dedup, SimHash components and benchmark passages against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from netstate.llm import decontaminate, line_dedup, simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(n, seed):
    rng = random.Random(seed)
    shared = ["The same long line here", "  THE SAME LONG LINE HERE\t", "Été, une ligne répétée",
              "ÉTÉ, UNE LIGNE RÉPÉTÉE", "short", "", "hot line in every text"]
    out = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.6 else f"line {rng.randrange(40)} of some"
                 for _ in range(rng.randrange(12))]
        out.append((i * 3, "\n".join([*lines, "hot line in every text"])))
    return [*out, (100_000, None), (100_001, ""), (None, "The same long line here\nx"),
            (100_002, "x\n" * 500 + "The same long line here\n" * 3)]


def deduped(docs):
    owner = {}
    for doc, text in docs:
        for line in (text or "").split("\n") if doc is not None else ():
            key = line.strip(" \t\n\x0b\f\r").translate(LOW)
            if len(key) >= 10:
                owner[key] = min(doc, owner.get(key, doc))
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        keys = [x.strip(" \t\n\x0b\f\r").translate(LOW) for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True)
                if doc is None or len(k) < 10 or owner[k] == doc]
        out.append((str(doc), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("hot", [True, False])
def test_line_dedup(spark, monkeypatch, hot):
    docs = texts(60, 1)
    if not hot:
        monkeypatch.setattr(line_dedup, "_hot_hashes", lambda *a: [])
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("first", F.lit(1))
    if hot:
        assert line_dedup._hot_hashes(frame, 4)
    got = line_dedup.dedup_lines(frame)
    assert got.columns == ["doc_id", "first", "text", "__n_lines", "__n_dropped"]
    assert sorted((str(r.doc_id), r["__n_lines"], r["__n_dropped"], r.text)
                  for r in got.collect()) == deduped(docs)


def test_line_dedup_edges(spark):
    schema = "doc_id long, text string"
    assert line_dedup.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    twice = [(1, "a long line here"), (1, "a long line here"), (2, "A LONG LINE HERE")]
    got = line_dedup.dedup_lines(spark.createDataFrame(twice, schema)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [
        (1, "a long line here"), (1, "a long line here"), (2, "")]


def test_line_dedup_runs_no_python(spark):
    frame = spark.createDataFrame(texts(5, 2), "doc_id long, text string")
    frame = spark.createDataFrame(frame.collect(), frame.schema)
    plan = line_dedup.dedup_lines(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(?!Row)", plan.replace("LogicalRDD", ""))


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) \
        if hashes else 0


def components(prints):
    """Smallest id reachable over three or fewer bits."""
    ids = sorted((d, f) for d, f in prints)
    parent = {d: d for d, _ in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(ids):
        for b, y in ids[:i]:
            if (x ^ y).bit_count() <= 3:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: find(d) for d, _ in ids}


def test_simhash(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "ONE"), (5, "é É"), (6, "one two")]
    for i in range(40):
        base = [rng.choice(words) for _ in range(150)]
        for j in range(4):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((100 + 10 * i + j, " ".join(copy)))
    docs.append((900, docs[10][1]))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id)
           for r in simhash.near_duplicates(frame).collect()}
    prints = [(d, fingerprint(t)) for d, t in docs]
    want = components(prints)
    assert len(set(want.values())) < len(docs) - 20
    assert got == {d: (f, want[d]) for d, f in prints}


def test_simhash_links_at_the_edge(spark):
    base = 0x0123456789ABCDEF
    signed = [x - (1 << 64) if x >> 63 else x for x in (
        base, base ^ 0b111, base ^ (0b11 << 40) ^ 1, base ^ 0b1111, base ^ (1 << 63),
        base ^ (1 << 63) ^ (1 << 31) ^ (1 << 5))]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.links(frame).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed
            if a != b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert got == want


def test_simhash_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    lost = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(lost).collect()] == [None, None]


def hits(docs, items):
    pattern = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        found = pattern.findall((text or "").translate(LOW))
        for i in range(max(1, len(found) - 9)) if found and item is not None else ():
            windows.setdefault(tuple(found[i:i + 10]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        found = pattern.findall((text or "").translate(LOW))
        hit, seen = set(), set()
        for size in sizes:
            for i in range(len(found) - size + 1):
                of = windows.get(tuple(found[i:i + size]))
                if of:
                    hit.update(range(i, i + size))
                    seen |= of
        out.append((str(doc), len(found), len(hit), ",".join(sorted(seen))))
    return sorted(out)


@pytest.mark.parametrize("block_windows", [500_000, 100])
def test_benchmark_hits(spark, block_windows):
    rng = random.Random(9)
    words = ["the", "of", "and", "Été", "x1", *(f"w{i}" for i in range(30))]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", ",", ". ", "\n"]) for _ in range(n))

    items = [(i, prose(rng.choice([0, 2, 5, 9, 10, 11, 25]))) for i in range(25)]
    items += [(3, items[3][1]), (None, prose(12)), (40, None), (41, "rareword"), (42, prose(10))]
    items.append((43, items[-1][1]))
    docs = []
    for i in range(80):
        parts = [prose(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            parts += [(rng.choice(items)[1] or "").upper(), prose(rng.randrange(10))]
        docs.append((i, " | ".join(parts)))
    docs += [(200, None), (201, ""), (202, "rareword RAREWORD rarewords"), (None, items[5][1]),
             (203, items[7][1] * 40), (203, items[7][1] * 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.benchmark_hits(frame, bench, block_windows=block_windows)
    assert got.columns == ["doc_id", "text", "hits"]
    rows = got.collect()
    assert sorted((str(r.doc_id), r.hits.n_words, r.hits.n_hit, ",".join(r.hits["items"]))
                  for r in rows) == hits(docs, items)
    for r in rows:
        assert sum(b - a for a, b in zip(r.hits.starts, r.hits.ends, strict=True)) == r.hits.n_hit
    first = got.select(decontaminate.digest(F.col("hits.items")).alias("d"), "hits").first()
    assert first.d == hashlib.sha256(",".join(first.hits["items"]).encode()).hexdigest()


def test_benchmark_hits_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.benchmark_hits(docs, none).first().hits.n_hit == 0
    assert decontaminate.benchmark_hits(docs.where("false"), none).count() == 0


def test_words_of_a_batch_are_searched_in_small_pieces():
    texts = [" ".join(f"w{(i * j) % 977}" for j in range(1000)).encode() for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    pieces = list(decontaminate._batches(batch, "text"))
    assert [p[0] for p in pieces] == [0, *(p[1] for p in pieces[:-1])] and pieces[-1][1] == 300
    assert [w for p in pieces for w in p[2]] == [decontaminate.words(t) for t in texts]
    assert max(sum(map(len, p[2])) for p in pieces) < (1 << 17) + 1000
