"""Secrets in texts, also under nested layers of encoding.

A worklist starts with the text itself.  Each layer is scanned, then unwrapped:
percent escapes and Unicode escapes give one new layer each with every escape
decoded in place, a run of base64 gives layers of its own, and so does each compressed
stream in a decoded layer, up to its end, its cut or its first bad byte.  Words
may stand before base64 without a blank ('/data/cGFz...'), so a run is decoded
from each of its first four characters: whatever place the base64 begins at, one
of these holds it.  Runs on lines that follow each other are also taken together.
Decoded bytes are kept whatever they are: a byte that is no UTF-8 becomes a
surrogate (PEP 383), from which it can be had back.  Layers are unwrapped until
nothing new appears; a layer seen before is not taken up again, so cycles end.
Each character of a layer knows the piece of the original text it came from.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, functions as F

from netstate.llm.common import per_batch, text_bytes

#: The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII)
ASSIGN_HINT = re.compile(r"[:=]")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Layers.
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}"
                     r"|(?:\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++"
                     r"(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LEAST_BASE64 = 16
STANDARD = bytes.maketrans(b"-_", b"+/")
#: Decoded bytes without any of these hold neither a secret nor a layer.
WORTH = re.compile(
    rb"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx]|&#"
    rb"|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-][ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]"
    rb"|\x1f\x8b|BZh[1-9]|\xfd7zXZ\x00|x[\x01^\x9c\xda]")
#: Starts of compressed streams in decoded text; the second byte of zlib's may have become
#: a letter with the byte behind it.
COMPRESSED = re.compile(
    "(?P<gzip>\x1f\udc8b)|(?P<bz2>BZh[1-9])|(?P<xz>\udcfd7zXZ\x00)"
    "|(?P<zlib>x[\x01^\udc9c\udcda\u0680-\u06bf])")
DECOMPRESSORS = {"gzip": lambda: zlib.decompressobj(31), "bz2": bz2.BZ2Decompressor,
                 "xz": lzma.LZMADecompressor, "zlib": lambda: zlib.decompressobj(15)}
BROKEN = (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError)
NO_BYTE = re.compile("[\ud800-\udc7f\udd00-\udfff]")
#: Characters of a compressed stream taken at a time, at first and later.
FIRST_STEP, STEP = 1 << 10, 1 << 16


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) found in the text as it stands, leftmost and not overlapping."""
    out = []
    if ASSIGN_HINT.search(text):
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            out += [("assign", *m.span()) for m in ASSIGN.finditer(text)
                    if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)
                if len(m[0]) >= LEAST_ACCESS]
    # A run of hex digits is taken whole, so its least length may stand in the pattern.
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


class Layer:
    """A decoded text; first and last[i] bound the original piece of character i.

    Both are None where the layer is the original itself.  tail is the end of the
    run that holds a base64 layer, with its padding.
    """

    def __init__(self, text: str, first: np.ndarray | None = None,
                 last: np.ndarray | None = None, tail: int | None = None):
        self.text, self.first, self.last, self.tail = text, first, last, tail

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.first is None:
            return start, end
        return int(self.first[start:end].min()), int(self.last[start:end].max())

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self.first is None:
            here = np.arange(len(self.text), dtype=np.int64)
            return here, here + 1
        return self.first, self.last


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match that ``decode`` answers put in place."""
    parts, first, last, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new is None:
            continue
        if not parts:
            whole = layer.whole()
        parts += [layer.text[at:m.start()], new]
        a, b = layer.span(*m.span())
        first += [whole[0][at:m.start()], np.full(len(new), a, np.int64)]
        last += [whole[1][at:m.start()], np.full(len(new), b, np.int64)]
        at = m.end()
    if not parts:
        return None
    parts.append(layer.text[at:])
    first.append(whole[0][at:])
    last.append(whole[1][at:])
    return Layer("".join(parts), np.concatenate(first), np.concatenate(last))


def _text(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


def _bytes(text: str) -> bytes:
    """The bytes of a decoded text."""
    try:
        return text.encode("utf-8", "surrogateescape")
    except UnicodeEncodeError:
        return NO_BYTE.sub("?", text).encode("utf-8", "surrogateescape")


def _percent(run: str) -> str:
    return _text(bytes.fromhex(run.replace("%", "")))


def _unicode(run: str) -> str | None:
    try:
        if run[:2] == "&#":
            return chr(int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1]))
        if run[:2] == "\\x":
            return _text(bytes.fromhex(run.replace("\\x", "")))
        if run[:3] == "\\u{":
            return chr(int(run[3:-1], 16))
        if run[:2] == "\\U":
            return chr(int(run[2:], 16))
        units = bytes.fromhex(run.replace("\\u", ""))
        return units.decode("utf-16-be", "surrogatepass")
    except (ValueError, OverflowError):
        return None


def _stream(make, text: str, at: int) -> tuple[bytes, int, bool]:
    """What the one stream at a place holds, where it ends, and whether it is complete."""
    stream, out, fed, step = make(), [], [], FIRST_STEP
    while at < len(text):
        data = _bytes(text[at:at + step])
        try:
            out.append(stream.decompress(data))
        except BROKEN:
            break
        if stream.eof:
            used = data[:len(data) - len(stream.unused_data)]
            return b"".join(out), min(at + len(_text(used)), len(text)), True
        fed.append(data)
        at, step = at + step, STEP
    else:
        return b"".join(out), len(text), False
    # Once more, byte by byte up to the bad one.
    stream, used = make(), 0
    for before in fed:
        stream.decompress(before)
    try:
        while used < len(data) and not stream.eof:
            out.append(stream.decompress(data[used:used + 1]))
            used += 1
    except BROKEN:
        pass
    return b"".join(out), min(at + len(_text(data[:used])), len(text)), False


def _inflated(layer: Layer) -> list[Layer]:
    """A layer for each compressed stream, one with those of its kind right behind it."""
    out, at = [], 0
    while m := COMPRESSED.search(layer.text, at):
        make, parts, end, more = DECOMPRESSORS[m.lastgroup], [], m.start(), True
        while more:
            data, end, more = _stream(make, layer.text, end)
            parts.append(data)
            behind = COMPRESSED.match(layer.text, end)
            more = more and behind is not None and behind.lastgroup == m.lastgroup
        at, text = m.start() + 1, _text(b"".join(parts))
        if text:
            a, b = layer.span(m.start(), max(end, m.end()))
            if layer.tail is not None and (m.start() == 0 or end == len(layer.text)):
                b = layer.tail
            out.append(Layer(text, np.full(len(text), a, np.int64),
                             np.full(len(text), b, np.int64)))
    return out


def _sizes(text: str) -> np.ndarray:
    """How many bytes each character of a decoded text comes from."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    wide = (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return np.where((code >= 0xDC80) & (code <= 0xDCFF), 1, wide + 1)


def _from_base64(layer: Layer) -> list[Layer]:
    out = []
    runs = [BASE64.finditer(layer.text)]
    if "\n" in layer.text:
        runs.append(WRAPPED.finditer(layer.text))
    for m in chain.from_iterable(runs):
        run = m[0].encode().translate(STANDARD, b" \t\r\n=")
        if len(run) < LEAST_BASE64:
            continue
        for skip in range(4):
            size = len(run) - skip
            size -= size % 4 == 1
            data = binascii.a2b_base64(run[skip:skip + size] + b"=" * (-size % 4))
            if not WORTH.search(data):
                continue
            text = _text(data)
            # Byte j comes from the characters that hold its bits.
            sizes = _sizes(text)
            stop = np.cumsum(sizes)
            begin = stop - sizes
            at = m.start() + np.flatnonzero(~np.isin(
                np.frombuffer(m[0].encode(), np.uint8), np.frombuffer(b" \t\r\n=", np.uint8)))
            left, right = at[skip + begin * 4 // 3], at[skip + ((stop - 1) * 8 + 7) // 6]
            whole = layer.whole()
            out.append(Layer(text, whole[0][left], whole[1][right], layer.span(*m.span())[1]))
    return out


def unwrap(layer: Layer) -> list[Layer]:
    """The layers one step below."""
    out = []
    if "%" in layer.text:
        out.append(_replaced(layer, PERCENT, _percent))
    if "\\" in layer.text or "&#" in layer.text:
        out.append(_replaced(layer, UNICODE, _unicode))
    if layer.first is not None:
        out += _inflated(layer)
    return [x for x in out if x is not None] + _from_base64(layer)


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, each by start, then kind, then end."""
    def key(span):
        return span[1], KINDS.index(span[0]), span[2]

    base = base_spans(text)
    found, work = set(base), deque([Layer(text)])
    seen = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    while work:
        for below in unwrap(work.popleft()):
            where = below.span(0, len(below.text)) if below.text else (0, 0)
            # The same words under another piece of the text are another layer.
            mark = hashlib.sha256(
                f"{where}".encode() + below.text.encode("utf-8", "surrogatepass")).digest()
            if mark in seen or not below.text:
                continue
            seen.add(mark)
            found.update((kind, *below.span(a, b)) for kind, a, b in base_spans(below.text))
            work.append(below)
    return sorted(base, key=key), sorted(found, key=key)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for documents (doc_id, text), whole texts.

    Both are arrays of (kind, start, end), in code points of the text, ends exclusive:
    base those of the text as it stands, spans those of all layers too.  A null
    or empty text has none, rows are answered one by one (also repeated ones and
    such without a doc_id), other columns are ignored.
    """
    span = "array<struct<kind: string, start: int, end: int>>"

    def run(batch):
        found = [scan(t.decode("utf-8", "replace")) for t in batch["text"]]
        yield {"doc_id": batch["doc_id"], **{
            name: [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[i]]
                   for f in found] for i, name in enumerate(("base", "spans"))}}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return per_batch(rows, f"doc_id long, base {span}, spans {span}", run)
