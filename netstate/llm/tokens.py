"""Encoding of whole texts with a public tokenizer, word by word from a memo.

Encoding a text costs about a microsecond per byte, nearly all of it spent on words
seen before.  Both tokenizers used here cut a text into pieces that are merged
alone, and a blank or newline that stands between two other characters always
lies on such a cut.  So a text is split there, and the ids of a chunk are kept.
In plain Latin text a full stop or comma between a word and a blank is split off
too.  A chunk of plain text that is not kept yet is cut by the tokenizer's own
pattern and merged by its model, any other goes through the whole tokenizer.
Texts with two white-space characters in a row are split by a pattern that
looks at both neighbours.  A text that holds the name of an added token (such as
``<|endoftext|>``) goes through the whole tokenizer, which gives it that token's id.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from netstate.llm.common import forget_others, release_memory, worker_state

MAX_KEPT = 500_000
MAX_KEPT_LENGTH = 48
MAX_PLAIN = 4_096
GROUP = 512
#: So many characters of text are split and looked up at once.
AT_ONCE = 1 << 22
_TWO_BLANKS = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
# Characters of plain text; classes of its bytes: word, blank, stop or comma, other.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_NOT_PLAIN = re.compile(rf"[^\n -~{_LATIN}]")
_IN_WORD = bytes(b for b in range(256) if re.match(rf"[0-9{_LATIN}]", chr(b)))
_PLAIN_BYTES = bytes([0x0A, *range(0x20, 0x7F), *(b for b in _IN_WORD if b > 0x7F)])
_CLASSES = bytes(ord("a" if b in _IN_WORD else " " if b in b" \n" else "." if b in b".," else "x")
                 for b in range(256))
# Stands before a chunk that has no blank before it.
_BARE = "\x01"
# How each kind of tokenizer cuts a text, here for plain Latin text.
_CLITICS = "'s|'t|'re|'ve|'m|'ll|'d"
_CUTS = {
    "words": re.compile(rf"{_CLITICS}|[{_LATIN}]+|[0-9]|[^\s0-9{_LATIN}]+"),
    "bytes": re.compile(rf"{_CLITICS}| ?[{_LATIN}]+| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+"),
}


def _byte_letters() -> dict[int, str]:
    """A printable letter for each byte, as byte-level tokenizers write them."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _kind(path: str) -> str | None:
    """'words' or 'bytes' for the two designs whose cuts are known, else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get(
            "add_prefix_space"):
        return "bytes"
    steps = [p.get("type") for p in pre.get("pretokenizers", [])]
    norms = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    if steps == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]:
        return "words"
    return None


class Memo(dict):
    """A bounded memo: what was not asked for while ``kept`` others came is forgotten."""

    def __init__(self, kept: int):
        super().__init__()
        self.kept = kept
        self.older: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """Keys that are not kept; those of the older half move to the newer one."""
        if not self.older and len(self) < self.kept:
            return list(keys.difference(self))
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
        out = []
        for key in keys.difference(self):
            got = self.older.get(key)
            if got is None:
                out.append(key)
            else:
                self[key] = got
        return out


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept: int = MAX_KEPT):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        # Added tokens that are looked for in normalised text can be spelled in other ways.
        self.kind = None if any(t.normalized for t in added) else _kind(path)
        self.cut = _CUTS.get(self.kind)
        # The same model over pieces that are cut and spelled in letters already.
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = _byte_letters()
        self.letters = [letters[b] for b in range(256)]
        self.spelling = {b: x for b, x in letters.items() if b != 0x0A}
        self.end = self.model.encode(self.letters[0], add_special_tokens=False).ids[0]
        # Ids that tell where a word ends, or begins, among those of many words.
        vocabulary = self.model.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        for token, i in vocabulary.items():
            self.edge[i] = (token.endswith(suffix) if self.kind == "words" and suffix
                            else self.kind == "bytes" and token[0] == self.letters[0x20])
        self.chunks = Memo(kept)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def _pieces(self, text: str) -> list[str]:
        """Pieces of plain text, each byte of one as a letter."""
        found = self.cut.findall(text.lower() if self.kind == "words" else text)
        return [p if p.isascii() and p[0] > " " else "".join(
            [self.letters[b] for b in p.encode()]) for p in found]

    def _merge(self, pieces: list[str]) -> tuple[bytes, np.ndarray]:
        """ids of pieces, one after another, and how many each piece has.

        The letter of byte zero, which plain text can't hold, ends each piece.
        """
        end = self.letters[0]
        groups = [f" {end} ".join([*pieces[i:i + GROUP], ""]) for i in range(
            0, len(pieces), GROUP)]
        found = self.model.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.asarray(x.ids, "<u4") for x in found)])
        ends = np.flatnonzero(ids == self.end)
        return ids[ids != self.end].tobytes(), np.diff(ends, prepend=-1) - 1

    def _merge_words(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """``_merge`` of whole words, whose ids tell them apart: a word has one edge."""
        groups = [" ".join(words[i:i + GROUP]) for i in range(0, len(words), GROUP)]
        found = self.model.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.asarray(x.ids, "<u4") for x in found)])
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return self._merge(words)
        sizes = np.diff(at, prepend=-1) if self.kind == "words" else np.diff(at, append=len(ids))
        return ids.tobytes(), sizes

    def _keep(self, keys: list[str], data: bytes, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes) * 4
        self.chunks.update(zip(keys, map(data.__getitem__, map(
            slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))

    def _learn(self, keys: list[str]) -> None:
        """Keep the ids of chunks; one stands behind a blank unless it starts with a mark
        or a newline."""
        words = [k for k in keys if k.isalpha() and (k.isascii() or not _NOT_PLAIN.search(k))]
        if words:
            text = "\n".join(words)
            text = text.lower() if self.kind == "words" else text
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(self.spelling)
            spelled = text.split("\n")
            if self.kind == "bytes":
                spelled = [self.letters[0x20] + k for k in spelled]
            self._keep(words, *self._merge_words(spelled))
        alone = set(words)
        known, pieces, counts = [], [], []
        for key in keys:
            if key in alone:
                continue
            text = key[1:] if key[:1] == _BARE else key if key[:1] == "\n" else " " + key
            if len(text) >= MAX_PLAIN or _NOT_PLAIN.search(text):
                self.chunks[key] = self.whole(text)
                continue
            cut = self._pieces(text)
            known.append(key)
            counts.append(len(cut))
            pieces += cut
        data, sizes = self._merge(pieces)
        totals = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *counts])]
        if known:
            self._keep(known, data, np.diff(totals))

    def _split(self, text: str) -> str | list[str]:
        """Chunks of a text, as keys of the memo: between blanks, or listed if they hold some."""
        try:
            raw = text.encode("latin-1")
            plain = not raw.translate(None, _PLAIN_BYTES)
        except UnicodeEncodeError:
            plain = False
        kinds = raw.translate(_CLASSES) if plain else b""
        if b"  " in kinds or not plain and _TWO_BLANKS.search(text):
            parts = _CUT.split(text)
            parts[1:] = [p if p[0] == "\n" else p[1:] for p in parts[1:]]
            parts[0] = _BARE + parts[0]
            return parts
        if plain:
            if self.kind == "words":
                text = text.lower()
            # A stop or comma is split off if each of them stands behind a word.
            if not (kinds[:2] == b". " or b" . " in kinds or b"x. " in kinds
                    or b".. " in kinds):
                for mark in ".,":
                    for blank in " \n":
                        text = text.replace(mark + blank, f" {_BARE}{mark}{blank}")
        return _BARE + text.replace("\n", " \n")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text."""
        out, at, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= AT_ONCE or i == len(texts) - 1:
                out += self._encode(texts[at:i + 1])
                at, size = i + 1, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        """``encode`` of texts that are held at once.

        Arrow splits all of them and numbers their distinct chunks; the ids of these are
        looked up once, and those of the texts taken from them.
        """
        alone = [self.kind is None or _BARE in t or any(a in t for a in self.added)
                 for t in texts]
        parts = [None if one or not t else self._split(t)
                 for t, one in zip(texts, alone, strict=True)]
        listed = [p for p in parts if isinstance(p, list)]
        joined = [p for p in parts if isinstance(p, str)]
        flat = pc.split_pattern(pa.array([" ".join(joined)] if joined else [], pa.large_string()),
                                " ").flatten()
        numbered = pa.concat_arrays([flat, pa.array(
            [c for p in listed for c in p], pa.large_string())]).dictionary_encode()
        chunks, number = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        new = self.chunks.missing(set(chunks))
        self._learn(new)
        data = [self.chunks[c] for c in chunks]
        sizes = np.fromiter(map(len, data), np.int32, len(data)) // 4
        pool = np.frombuffer(b"".join(data), "<u4")
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        # Long chunks are not worth keeping.
        for key in new:
            if len(key) > MAX_KEPT_LENGTH:
                del self.chunks[key]
        wide = sizes[number]
        ends = np.cumsum(wide, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool.take(np.repeat(begins[number] - (ends - wide), wide) + np.arange(
            total, dtype=np.int32))
        # Where each text ends among the chunks, and so among the ids.
        last = np.cumsum([p.count(" ") + 1 for p in joined] + [len(p) for p in listed], dtype=int)
        stops = np.concatenate([[0], ends[last - 1]]) if len(last) else np.zeros(1, int)
        found = [ids[a:b].tobytes() for a, b in zip(stops[:-1], stops[1:], strict=True)]
        plain, apart = iter(found[:len(joined)]), iter(found[len(joined):])
        return [self.whole(t) if one else b"" if p is None else next(
            plain if isinstance(p, str) else apart)
            for t, p, one in zip(texts, parts, alone, strict=True)]


def encoder(path: str, kept: int = MAX_KEPT) -> Encoder:
    """The worker's encoder for a vocabulary file; its memo keeps about ``kept`` chunks twice.

    Before one is made, the worker gives back what stages before it held, and then
    what reading the vocabulary took.
    """
    known = worker_state("encoders", dict)
    if (path, kept) not in known:
        forget_others("encoders")
        known[path, kept] = Encoder(path, kept)
        release_memory()
    return known[path, kept]


def id_type(path: str) -> str:
    """The smallest unsigned type that holds every id of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = [*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]
    return "<u2" if max(ids) < 1 << 16 else "<u4"
