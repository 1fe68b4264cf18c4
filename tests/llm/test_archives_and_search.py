"""ZIP archives of WARC records and exact search."""

import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from netstate.llm import pivot_search, warc_zip


class Bytes:
    """A file in memory, as ``open_input`` gives it."""

    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at:at + n]


BIG = "<html>" + "x" * 200


def test_archive_rows(spark):
    pages = [(5, "http://a/ü", BIG), (2, "u\r\nX: y", BIG), (9, None, BIG), (1, "u", "tiny"),
             (3, "u", "tiny"), (4, "u", None), (6, "u", ""), (7, "u", "é\x00\r\n\r\nWARC" * 30),
             (None, "u", BIG), (8, "u", "y" * 100), (10, "u", "y" * 100), (11, "u", "z" * 99),
             (12, "u", "z" * 99), (8, "u", "y" * 100)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn(
        "digest", F.lit("clash"))
    got = warc_zip.read_archives(warc_zip.write_archives(frame)).collect()
    first = {}
    for page, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        to = first.get(data)
        refers = None if to is None or to == page else to
        want.append((str(page), "revisit" if refers is not None else "response", str(refers),
                     None if refers is not None else data, len(data),
                     hashlib.sha256(data).hexdigest()))
    assert sorted(map(str, [(str(r.page_id), r.record_type, str(r.refers_to),
                             None if r.payload is None else bytes(r.payload), r.payload_bytes,
                             r.payload_digest) for r in got])) == sorted(map(str, want))


def test_archive_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_zip.read_archives(warc_zip.write_archives(empty)).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_directory_and_ranges(monkeypatch, wide):
    if wide:  # as for huge archives
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    raw = [warc_zip.record(i, "u", b"p" * i, None, False, "d") for i in range(50)]
    warc_zip.write_archive(out, [(i, "response", r) for i, r in enumerate(raw)])
    file = Bytes(out.getvalue())
    members = warc_zip.directory(file)
    assert set(members) == {warc_zip.DATA, warc_zip.INDEX}
    monkeypatch.setattr(warc_zip, "RANGE_BYTES", 1000)
    ranges = list(warc_zip.record_ranges(file))
    assert len(ranges) > 3
    found = [r for at, n in ranges for r in warc_zip.records_in(file.read_at(n, at))]
    assert found == raw


def test_archives_of_others():
    out = io.BytesIO()
    raw = [warc_zip.record(i, "u", b"p" * i, None, False, "d") for i in range(5)]
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("notes.txt", "x" * 100, compress_type=zipfile.ZIP_DEFLATED)
        archive.writestr("archive/other.warc.gz", b"".join(map(warc_zip._gzip, raw)))
        archive.comment = b"a comment"
    file = Bytes(out.getvalue())
    (at, n), = warc_zip.record_ranges(file)
    assert list(warc_zip.records_in(file.read_at(n, at))) == raw
    with pytest.raises(ValueError):
        warc_zip.directory(Bytes(b"no archive"))


def nearest(vectors, queries, k):
    """All pairs."""
    import math

    def clean(rows):
        return sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
                       if i is not None and v is not None
                       and all(x is not None and math.isfinite(x) for x in v)})

    out = []
    for q, v in clean(queries):
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i)
                       for i, w in clean(vectors) if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>"


def vectors(n, seed, size=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    out = []
    for i in range(n):
        base = rng.choice(centres)
        v = [round(x + rng.gauss(0, 0.2), 3) for x in base]
        out.append((i, out[0][1] if out and i % 3 == 0 else v))
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "BLOCK", 40)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(pivot_search, "FIT_VECTORS", 60)
    rows = vectors(400, 1)
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 12), (503, [float("inf")] * 12),
             (504, []), (505, [2.0, -1.0]), (None, [1.0] * 12), (506, [0.5] * 14), (0, rows[0][1])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit("clash"))
    asked = frame.where("vec_id % 10 = 0 or vec_id > 499")
    got = sorted(tuple(r) for r in pivot_search.top_k(frame, asked).select(
        "query_id", "rank", "vec_id", "score").collect())
    # Floats as Spark holds them.
    stored = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert got == nearest(stored, [x for x in stored if x[0] is not None and (
        x[0] % 10 == 0 or x[0] > 499)], 5)


def test_top_k_of_few(spark):
    rows = [(50, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in pivot_search.top_k(frame, frame.where("vec_id = 50")).select(
        "query_id", "rank", "vec_id", "score").collect())
    assert got == nearest(rows, rows[:1], 5)
    empty = frame.where("false")
    assert pivot_search.top_k(empty, empty).count() == 0
    assert pivot_search.top_k(frame, empty).count() == 0
    assert pivot_search.top_k(frame.where("vec_id = 50"), frame.where("vec_id = 50")).count() == 0


def test_few_candidates_are_evaluated():
    """Grouped points are passed over by their bounds."""
    import numpy as np

    rng = np.random.default_rng(0)
    points = np.round(rng.normal(0, 3, (64, 8)) + np.repeat(
        rng.normal(0, 200, (8, 8)), 8, axis=0)).astype(np.int64)
    space = pivot_search.Space(np.arange(64), points, float((points ** 2).sum(1).max()))
    seen = []
    true = pivot_search.scores
    pivot_search.scores = lambda q, x: seen.append(len(x)) or true(q, x)
    first, pivot_search.FIRST = pivot_search.FIRST, 8
    try:
        found = pivot_search.search_block(
            space, {"v": points[:1].tobytes(), "ids": np.asarray([0]).tobytes(),
                    "floor": np.asarray([-np.inf]).tobytes()},
            {"v": points.tobytes(), "ids": np.arange(64).tobytes(),
             "table": space.distances(space.lift(points)).tobytes()}, 5)
    finally:
        pivot_search.scores, pivot_search.FIRST = true, first
    assert sum(seen) < 64
    want = sorted((-int(points[0] @ points[i]), i) for i in range(1, 64))[:5]
    assert sorted(zip((-s for s in found["score"]), found["vec_id"], strict=True)) == want
