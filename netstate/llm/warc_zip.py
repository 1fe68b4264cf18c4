"""WARC records in ZIP archives: written, indexed, read by range.

An archive stores (uncompressed) a member ``archive/data.warc.gz``, in which each
record is a gzip member of its own, and an index ``indexes/index.cdxj`` with a
line per record.  The reader finds both through the central directory (ZIP64
included) and fetches runs of records by their place in the file; nothing is
extracted.  Files live in the shared folder, manifests are written tables.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netstate.llm.common import (
    cut_lineage, new_folder, open_input, open_output, per_batch, text_bytes)

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MIN_PAYLOAD = 100
ARCHIVE_BYTES = 16 << 20
RANGE_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
RECORD = ("page_id long, record_type string, refers_to long, payload binary,"
          " payload_bytes long, payload_digest string")


# Records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
           is_revisit: bool, digest: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names another."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http if is_revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if is_revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/"
                  "identical-payload-digest"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(data: bytes) -> dict:
    """The columns of RECORD from the bytes of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split(
        "\r\n")[1:] if ": " in line)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    out = {"page_id": _page(fields.get("WARC-Record-ID")), "record_type": kind}
    if kind == "revisit":
        size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n")
                    if line.lower().startswith(b"content-length:"))
        return out | {"refers_to": _page(fields.get("WARC-Refers-To")), "payload": None,
                      "payload_bytes": size, "payload_digest": fields[
                          "WARC-Payload-Digest"].removeprefix("sha256:")}
    return out | {"refers_to": None, "payload": payload, "payload_bytes": len(payload),
                  "payload_digest": hashlib.sha256(payload).hexdigest()}


# Archives


def _gzip(data: bytes) -> bytes:
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def write_archive(out, records: list[tuple[int | None, str, bytes]]) -> None:
    """Write (page_id, type, record) as one archive to a stream."""
    data, index = io.BytesIO(), []
    for page_id, kind, raw in records:
        small = _gzip(raw)
        index.append(json.dumps({"page_id": page_id, "type": kind, "offset": data.tell(),
                                 "length": len(small)}))
        data.write(small)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
        for name, content in ((DATA, data.getvalue()), (INDEX, "\n".join(index).encode())):
            archive.writestr(zipfile.ZipInfo(name), content)


def _sizes(extra: bytes, *fields: int) -> list[int]:
    """Directory fields, taken from the ZIP64 extra field where they are all ones."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = extra[at + 4:at + 4 + size]
        at += 4 + size
    out = []
    for value in fields:
        if value == 0xFFFFFFFF and len(wide) >= 8:
            value, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
        out.append(value)
    return out


def directory(file) -> dict[str, tuple[int, int, int]]:
    """Members of an archive: name to (method, place of the data, stored size)."""
    size = file.size()
    tail_at = max(0, size - (1 << 16) - 22 - 20)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no central directory")
    entries, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator:locator + 4] == b"PK\x06\x07" and (
            entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
        wide = file.read_at(56, struct.unpack_from("<Q", tail, locator + 8)[0])
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory")
        entries, length, start = struct.unpack_from("<QQQ", wide, 32)
    raw, at, out = file.read_at(length, start), 0, {}
    for _ in range(entries):
        if raw[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", raw, at + 10)
        packed, plain, name, extra, note = struct.unpack_from("<IIHHH", raw, at + 20)
        header, = struct.unpack_from("<I", raw, at + 42)
        title = raw[at + 46:at + 46 + name].decode("utf-8", "replace")
        plain, packed, header = _sizes(
            raw[at + 46 + name:at + 46 + name + extra], plain, packed, header)
        local = file.read_at(30, header)
        skip = sum(struct.unpack_from("<HH", local, 26))
        out[title] = (method, header + 30 + skip, packed)
        at += 46 + name + extra + note
    return out


def record_ranges(file) -> Iterator[tuple[int, int]]:
    """(offset, length) in the file of runs of whole records, about RANGE_BYTES each.

    The index names the places; a member without one is one run.
    """
    members = directory(file)
    for name, (method, start, size) in members.items():
        if not name.endswith(".warc.gz") or not size:
            continue
        if method:
            raise ValueError(f"{name} is not stored")
        if INDEX not in members or name != DATA:
            yield start, size
            continue
        _, at, length = members[INDEX]
        begin = end = 0
        for line in file.read_at(length, at).split(b"\n"):
            if not line:
                continue
            entry = json.loads(line)
            if entry["offset"] != end or end - begin >= RANGE_BYTES:
                if end > begin:
                    yield start + begin, end - begin
                begin = entry["offset"]
            end = entry["offset"] + entry["length"]
        if end > begin:
            yield start + begin, end - begin


def records_in(data: bytes) -> Iterator[bytes]:
    """The records of a run of gzip members."""
    view, at = memoryview(data), 0
    while at < len(view):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("broken record")
            step = view[at:at + 65536]
            parts.append(one.decompress(step))
            at += len(step) - len(one.unused_data)
        yield b"".join(parts)


# Tables


def record_types(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to): refers_to is null for a response.

    Of equal payloads of at least 100 bytes the smallest page_id is the response.
    """
    rows = pages.select("page_id", "digest", "size").where(F.col("size") >= MIN_PAYLOAD)
    first = rows.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(
        "n > 1 and first is not null")
    return rows.join(first, "digest").where("not (page_id <=> first)").select(
        F.col("page_id").alias("__page"), F.col("digest").alias("__digest"),
        F.col("first").alias("refers_to")).distinct()


def write_archives(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) as archives; (path, n_records) of each.

    A null html is an empty payload.  Equal payloads under one page_id are all
    responses, a page without an id is a revisit if its payload has a response
    with one, an empty table writes nothing; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"), text_bytes("html").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"),
                       F.octet_length("payload").cast("long").alias("size"))
    typed = rows.drop("size").join(
        record_types(rows), F.col("page_id").eqNullSafe(F.col("__page"))
        & (F.col("digest") == F.col("__digest")), "left").drop("__page", "__digest")
    folder = new_folder(spark, "archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.zip"
            with open_output(path) as out:
                write_archive(out, held)
            return pa.RecordBatch.from_pydict({
                "path": [path], "n_records": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    revisit = row["refers_to"] is not None
                    raw = record(row["page_id"], row["url"], row["payload"],
                                 row["refers_to"], revisit, row["digest"])
                    held.append((row["page_id"], "revisit" if revisit else "response", raw))
                    size += len(raw)
                    if size >= ARCHIVE_BYTES:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return cut_lineage(typed.select(
        "page_id", F.regexp_replace("url", "\\x00", "%00").alias("url"), "payload", "digest",
        "refers_to").mapInArrow(write, "path string, n_records long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of archives (column path): RECORD, payload null for revisits.

    The index of each archive gives ranges, the ranges are read in parallel.
    """
    def ranges(batch):
        for path in batch["path"]:
            with open_input(path) as file:
                found = list(record_ranges(file))
            yield {"path": [path] * len(found), "offset": [a for a, _ in found],
                   "length": [n for _, n in found]}

    def read(batch):
        for path, offset, length in zip(
                batch["path"], batch["offset"], batch["length"], strict=True):
            with open_input(path) as file:
                found = [parse_record(r) for r in records_in(file.read_at(length, offset))]
            yield {f: [r[f] for r in found] for f in found[0]}

    spark = manifest.sparkSession
    tasks = max(1, min(manifest.count(), 8 * spark.sparkContext.defaultParallelism))
    places = cut_lineage(per_batch(manifest.select("path").repartition(tasks),
                                   "path string, offset long, length long", ranges, rows=16))
    return per_batch(places.repartition(max(1, places.count())), RECORD, read, rows=1)
