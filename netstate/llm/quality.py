"""Quality of documents from overlapping heuristics, without labels.

Heuristic labellers look at the whole text and vote good, bad or nothing.
Expectation-maximisation over all documents estimates how accurate each is and
how likely a document with given votes is good.  These posteriors are the
labels of a linear scorer over hashed features of words, which is fitted on a
bounded sample and then scores every document.

The votes of all documents are counted by pattern, so the estimation is exact
and as small as the number of patterns.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from netstate.llm.common import per_batch, text_bytes

BUCKETS = 1 << 15
#: The scorer is fitted on so many documents at most, chosen by the hash of their row.
FIT_DOCUMENTS = 6_000
EPOCHS = 12
RATE = 0.5
KEEP_SCORE = 0.5
MAX_KEPT = 200_000
GOOD, BAD, NONE = 1, 0, -1

_PLAIN_MARKS = frozenset(".,;:!?'\"()-…¿¡«»„“”’")
_SENTENCE_END = re.compile(r"[.!?…]['\")\]]?$")


def measures(tokens: list[str], text: str) -> dict[str, float]:
    """Shares that the labellers look at; tokens are the text's words."""
    n = max(1, len(tokens))
    cased = sum(1 for t in tokens if t.upper() != t.lower())
    counts = Counter(tokens)
    chars = max(1, sum(map(len, tokens)))
    letters = sum(map(str.isalpha, text))
    ends = sum(1 for t in tokens if _SENTENCE_END.search(t))
    return {
        "words": float(len(tokens)),
        "letters": letters / chars,
        "shouted": sum(1 for t in tokens if len(t) > 1 and t.isupper()) / max(1, cased),
        "repeated": sum(1 for a, b in zip(tokens, tokens[1:], strict=False) if a == b) / n,
        "distinct": len(counts) / n ** 0.9,
        "no_word": sum(1 for t in tokens if not any(map(str.isalnum, t))) / n,
        "decorated": sum(1 for t in tokens if len(t) > 2 and not t[-1].isalnum()
                         and not t[-2].isalnum()) / n,
        "ends": ends / n,
        "short": sum(1 for t in tokens if len(t) < 4 and t.isalpha()) / n,
        "symbols": sum(k for c, k in Counter(text).items() if not (
            c.isalnum() or c.isspace() or c in _PLAIN_MARKS)) / chars,
        "length": chars / n,
    }


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: The labellers, each with a name and its vote on the measures.  Most know one kind of
#: junk and are silent on all else.
LABELLERS = {
    "letters": lambda m: _vote(m["letters"] < 0.7, False),
    "shouted": lambda m: _vote(m["shouted"] > 0.5, False),
    "repeated": lambda m: _vote(m["repeated"] > 0.2, False),
    "distinct": lambda m: _vote(m["words"] > 30 and m["distinct"] < 0.25, False),
    "no_word": lambda m: _vote(m["no_word"] > 0.15, False),
    "decorated": lambda m: _vote(m["decorated"] > 0.3, False),
    "symbols": lambda m: _vote(m["symbols"] > 0.05, False),
    "length": lambda m: _vote(m["words"] > 5 and not 2 < m["length"] < 14, False),
    "short": lambda m: _vote(m["words"] > 20 and m["short"] < 0.05, m["short"] > 0.12),
    "sentences": lambda m: _vote(m["words"] > 60 and m["ends"] < 0.01,
                                 m["words"] > 5 and 0.02 < m["ends"] < 0.3),
    "prose": lambda m: _vote(False, m["words"] > 0 and m["repeated"] < 0.05 and m["no_word"] < 0.03
                             and m["letters"] > 0.85 and m["shouted"] < 0.1),
}


def votes(text: str) -> list[int]:
    m = measures(text.split(), text)
    return [label(m) for label in LABELLERS.values()]


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> tuple:
    """How labellers vote on good and bad documents, by expectation-maximisation.

    patterns: votes and their number of documents.  Returns (share of good
    documents, accuracy of each labeller's votes, posterior by pattern).  A
    labeller's silence is a vote too: it says little of one that is seldom heard.
    """
    keys = sorted(patterns)
    if not keys:
        return 0.5, [], {}
    v = np.asarray(keys)
    n = np.asarray([patterns[k] for k in keys], float)
    # Junk of one kind upsets few labellers, so one bad vote starts as an even chance.
    good = np.asarray([0.95, 0.5, 0.1])[np.minimum((v == BAD).sum(1), 2)]
    cast = np.stack([v == x for x in (NONE, BAD, GOOD)], axis=2)
    for _ in range(rounds):
        share = np.clip((n * good).sum() / n.sum(), 1e-3, 1 - 1e-3)
        # Each vote was seen once before any is.
        on_good = (np.einsum("p,plv->lv", n * good, cast) + 1) / ((n * good).sum() + 3)
        on_bad = (np.einsum("p,plv->lv", n * (1 - good), cast) + 1) / (
            (n * (1 - good)).sum() + 3)
        margin = np.log1p(-share) - np.log(share) + np.einsum(
            "plv,lv->p", cast, np.log(on_bad) - np.log(on_good))
        good = 1 / (1 + np.exp(np.clip(margin, -50, 50)))
    heard = share * on_good[:, 1:].sum(1) + (1 - share) * on_bad[:, 1:].sum(1)
    accuracy = (share * on_good[:, 2] + (1 - share) * on_bad[:, 1]) / heard
    return float(share), accuracy.tolist(), dict(zip(keys, good.tolist(), strict=True))


def _shape(token: str) -> str:
    """Letters as A or a, digits as 0, other characters as they are, runs shortened."""
    out = []
    for c in token[:32]:
        s = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else \
            "a" if c.isalpha() else c
        if len(out) < 2 or out[-1] != s or out[-2] != s:
            out.append(s)
    return "".join(out)


def _bucket(kind: str, value: str) -> int:
    return xxhash.xxh32_intdigest(f"{kind}:{value}".encode("utf-8", "replace")) % BUCKETS


class Features:
    """Hashed features of a text: words, shapes, neighbouring shapes, how often words recur."""

    def __init__(self):
        self.kept: dict[str, tuple[int, int]] = {}

    def _of(self, token: str) -> tuple[int, int]:
        got = self.kept.get(token)
        if got is None:
            if len(self.kept) >= MAX_KEPT:
                self.kept.clear()
            got = _bucket("word", token.lower()), _bucket("shape", _shape(token))
            if len(token) < 64:
                self.kept[token] = got
        return got

    def __call__(self, text: str) -> np.ndarray:
        tokens = text.split()
        if not tokens:
            return np.zeros(0, np.int64)
        both = np.asarray([self._of(t) for t in tokens], np.int64)
        pairs = (both[1:, 1] * 31 + both[:-1, 1] * 17 + 7) % BUCKETS
        # What holds for the text as a whole weighs as one: shares in ten steps.
        repeats = float((both[1:, 0] == both[:-1, 0]).mean()) if len(both) > 1 else 0.0
        distinct = len(np.unique(both[:, 0])) / len(both) ** 0.9
        whole = [_bucket(kind, str(min(10, int(10 * value)))) for kind, value in (
            ("repeats", repeats), ("distinct", distinct))]
        flat = np.concatenate([both.ravel(), pairs])
        return np.concatenate([flat, np.repeat(whole, math.isqrt(len(flat)) + 1)])


def fit_scorer(samples: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic scorer, by full-batch AdaGrad.

    A sample has its features, how often it has each, and its label.  As in scoring, a
    text's counts are divided by the root of their sum.
    """
    weights, offset = np.zeros(BUCKETS), 0.0
    samples = [s for s in samples if len(s[0])]
    if not samples:
        return weights, offset
    y = np.asarray([y for _, _, y in samples])
    flat = np.concatenate([f for f, _, _ in samples])
    row = np.repeat(np.arange(len(samples)), [len(f) for f, _, _ in samples])
    value = np.concatenate([n / np.sqrt(n.sum()) for _, n, _ in samples])
    # Both classes weigh the same.
    good = max(y.sum(), 1e-9)
    bad = max((1 - y).sum(), 1e-9)
    importance = y / good + (1 - y) / bad
    seen, seen_offset = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(EPOCHS):
        margin = np.bincount(row, weights[flat] * value, len(samples)) + offset
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y) * importance
        slope = np.bincount(flat, error[row] * value, BUCKETS)
        seen += slope ** 2
        weights -= RATE * slope / np.sqrt(seen)
        seen_offset += error.sum() ** 2
        offset -= RATE * error.sum() / np.sqrt(seen_offset)
    return weights, float(offset)


def label_votes(docs: DataFrame) -> DataFrame:
    """(doc_id, words, votes) of each document's whole text."""
    def run(batch):
        texts = [t.decode("utf-8", "replace") for t in batch["text"]]
        yield {"doc_id": batch["doc_id"], "votes": [votes(t) for t in texts]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return per_batch(rows, "doc_id long, votes array<int>", run)


def score_quality(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, score, keep) for documents (doc_id, text).

    score is the scorer's probability that the document is good, from its whole
    text; keep is score >= 0.5.  A text without words (null, empty, blanks) has
    score 0.  Rows are answered one by one (also repeated ones and such without a
    doc_id); if no labeller ever votes all others score 0.5; an empty table gives
    no rows; other columns are ignored.
    """
    n = docs.count()
    counted = label_votes(docs).groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    # At most 9 * 2 ** 9 patterns, a few dozen in practice.
    patterns = {tuple(r["votes"]): r["n"] for r in counted.collect()}
    posterior = estimate(patterns)[2]
    share = min(1.0, fit_documents / max(1, n))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)

    def sample(batch):
        make = Features()
        texts = [t.decode("utf-8", "replace") for t in batch["text"]]
        # A whole text, however long, has at most BUCKETS features with their counts.
        feats = [np.unique(make(t), return_counts=True) for t in texts]
        yield {"f": [f.astype("<i4").tobytes() for f, _ in feats],
               "n": [n.astype("<i4").tobytes() for _, n in feats],
               "y": [posterior.get(tuple(votes(t)), 0.5) for t in texts]}

    fit_rows = docs.where(place < share).select(text_bytes().alias("text"))
    found = per_batch(fit_rows, "f binary, n binary, y double", sample).limit(
        2 * fit_documents).collect()
    weights, offset = fit_scorer(
        [(np.frombuffer(r["f"], "<i4").astype(np.int64), np.frombuffer(r["n"], "<i4"), r["y"])
         for r in sorted(found, key=lambda r: (bytes(r["f"]), bytes(r["n"])))])
    weights = weights.astype(np.float32)

    def score(batch):
        if "made" not in memo:
            memo["made"] = Features()
        out = []
        for t in batch["text"]:
            f = memo["made"](t.decode("utf-8", "replace"))
            margin = float(weights[f].sum()) / max(1, len(f)) ** 0.5 + offset
            out.append(float(1 / (1 + np.exp(-np.clip(margin, -50, 50)))) if len(f) else 0.0)
        yield {"doc_id": batch["doc_id"], "score": out, "keep": [s >= KEEP_SCORE for s in out]}

    memo: dict[str, Features] = {}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return per_batch(rows, "doc_id long, score double, keep boolean", score)
