"""Language identification as a mixture of languages per document.

A model of each language gives the likelihood of a word by its letter n-grams.
A document is a mixture: expectation-maximisation finds the share of each
language that explains its words best.  The set of languages is the one whose
likelihood, less a penalty for each further language, is highest; the
prediction is the language with the largest share in that set.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from netstate.llm.common import release_memory, text_bytes

NGRAMS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.05
#: The model is fitted on about so many labelled documents of each language.
FIT_DOCUMENTS = 4_000
ROUNDS = 8
PENALTY = 6.0
MAX_KEPT = 300_000
BATCH_WORDS = 1 << 18
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Documents kept from fitting: one in three by the checksum of the id, and null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


#: Runs of letters; a very long one in pieces, so that it is not one vote.
_WORD = re.compile(r"[^\W\d_]{1,40}")
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def words(text: str) -> list[str]:
    """The words of a text in lower case; none if it has no letters."""
    # A pattern can't tell letters from signs like superscript numbers.
    return _WORD.findall(text.lower()) if any(map(str.isalpha, text)) else []


def buckets(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words with their ends marked, and each one's word."""
    text = "".join([f"<{w}>" for w in found])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 2
    word = np.repeat(np.arange(len(found)), sizes)
    left = np.cumsum(sizes)[word] - np.arange(len(code))
    out, of = [], []
    for n in NGRAMS:
        whole = np.flatnonzero(left >= n)
        key = np.full(len(whole), n, np.uint32)
        for i in range(n):
            key = (key ^ code[whole + i]) * np.uint32(_MIX[i])
            key ^= key >> np.uint32(15)
        out.append((key >> np.uint32(7)) % np.uint32(BUCKETS))
        of.append(word[whole])
    return np.concatenate(out), np.concatenate(of)


class Model:
    """log_p: the log-likelihood of each bucket under each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(0, keepdims=True)
        self.log_p = np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS)).astype(
            np.float32)


def fit(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Model:
    """Count n-grams of documents (doc_id, text, lang) that are not held out.

    Of a language with more than ``fit_documents`` documents, a share chosen by the
    hash of the id is read, about that many.  Documents without a language or
    without letters teach nothing; without any the model knows no language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    number = {name: i for i, name in enumerate(languages)}
    share = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    limits = F.create_map(*[F.lit(x) for name in languages for x in (
        name, min(1.0, fit_documents / sizes[name]))])
    chosen = labelled.where(share < limits[F.col("lang")]).select(
        "lang", text_bytes().alias("text"))

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                found = words(text.as_py().decode("utf-8", "replace"))
                for at in range(0, len(found), BATCH_WORDS):
                    total[number[lang.as_py()]] += np.bincount(
                        buckets(found[at:at + BATCH_WORDS])[0], minlength=BUCKETS)
        which, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array(which.astype(np.int32)), "bucket": pa.array(bucket.astype(np.int32)),
            "n": pa.array(total[which, bucket])})

    # The model has a number for each language and bucket, whatever the corpus holds.
    found = chosen.mapInArrow(count, "lang int, bucket int, n long").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found["bucket"], found["lang"]] = found["n"]
    taught = counts.sum(0) > 0
    return Model([x for x, ok in zip(languages, taught, strict=True) if ok], counts[:, taught])


class Scorer:
    """Shares of languages for batches of documents; words are kept with their likelihoods."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), np.float32)

    def _learn(self, found: Iterable[list[str]]) -> None:
        """Keep the log-likelihoods of words that are new."""
        if len(self.rows) > MAX_KEPT:
            self.forget()
        new = list(set().union(*found).difference(self.rows))
        if not new:
            return
        bucket, word = buckets(new)
        values = np.stack([
            np.bincount(word, self.model.log_p[bucket, i], len(new))
            for i in range(len(self.model.languages))], axis=1)
        self.rows.update(zip(new, range(len(self.table), len(self.table) + len(new)),
                             strict=True))
        self.table = np.concatenate([self.table, values.astype(np.float32)])

    def score(self, texts: list[str]) -> list[tuple[str, float, list[str], list[float]]]:
        """(prediction, score, languages, shares) of each text."""
        out = [(UNKNOWN, 0.0, [], [])] * len(texts)
        found = [words(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        some = np.flatnonzero(sizes)
        if not len(some) or not self.model.languages:
            return out
        self._learn(found)
        rows = np.fromiter((i for w in found for i in map(self.rows.__getitem__, w)), np.int64,
                           int(sizes.sum()))
        chosen, shares = choose(self.table[rows], sizes[some])
        names = self.model.languages
        for i, picked, share in zip(some.tolist(), chosen, shares, strict=True):
            order = sorted(picked, key=lambda x: (-share[x], names[x]))
            out[i] = (names[order[0]], float(min(1.0, max(0.0, share[order[0]]))),
                      [names[x] for x in order], [float(share[x]) for x in order])
        return out


def mixture(log_p: np.ndarray, at: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple:
    """Shares (documents x languages) and log-likelihoods by expectation-maximisation.

    log_p has a row per word, ``at`` the first row of each document; only the
    allowed languages of each document get a share.
    """
    top = np.max(log_p, axis=1, keepdims=True)
    p = np.exp(log_p - top)
    share = allowed / allowed.sum(1, keepdims=True)
    tiny = np.finfo(np.float32).tiny
    for _ in range(ROUNDS):
        parts = p * np.repeat(share, sizes, axis=0)
        parts /= np.maximum(parts.sum(1, keepdims=True), tiny)
        share = np.add.reduceat(parts, at, axis=0) / sizes[:, None]
        share = np.maximum(share, 0) * allowed
        share /= np.maximum(share.sum(1, keepdims=True), tiny)
    total = (p * np.repeat(share, sizes, axis=0)).sum(1)
    per_word = np.log(np.maximum(total, tiny)) + top[:, 0]
    return share, np.add.reduceat(per_word.astype(np.float64), at)


def choose(log_p: np.ndarray, sizes: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """Per document the languages of the best penalised likelihood, and all shares.

    A document that one language explains so well that no mixture can earn its
    penalty is settled without fitting one: the likelihood of a mixture is at
    most that of the best language of each word, and, being concave in the
    shares, at most the slope towards another language above that of one alone.
    """
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = log_p.shape[1]
    alone = np.add.reduceat(log_p.astype(np.float64), at, axis=0)
    first, best = alone.argmax(1), alone.max(1)
    share = np.zeros((len(sizes), n), np.float32)
    share[np.arange(len(sizes)), first] = 1
    chosen = [[int(x)] for x in first]
    # One word more may be due to chance: each further language must earn this much.
    price = PENALTY * np.log(sizes + 1.0) + 4.0
    own = np.take_along_axis(log_p, np.repeat(first, sizes)[:, None], axis=1)
    better = log_p - own
    gain = np.add.reduceat(better.max(1).astype(np.float64), at)
    slope = np.add.reduceat(np.exp(np.minimum(better, 60)).astype(np.float64), at, axis=0)
    gain = np.minimum(gain, slope.max(1) - sizes)
    open_ = np.flatnonzero(gain > price)
    if not len(open_) or n == 1:
        return chosen, share
    log_p, starts = _rows_of(log_p, at, sizes, open_)
    full, _ = mixture(log_p, starts, sizes[open_], np.ones((len(open_), n), np.float32))
    order = np.argsort(-full, axis=1, kind="stable")
    for k in range(2, n + 1):
        # A language with less than half a word is not worth a try.
        tried = np.flatnonzero(
            full[np.arange(len(open_)), order[:, k - 1]] * sizes[open_] > 0.5)
        if not len(tried):
            break
        docs = open_[tried]
        allowed = np.zeros((len(tried), n), np.float32)
        np.put_along_axis(allowed, order[tried, :k], 1, axis=1)
        part, begins = _rows_of(log_p, starts, sizes[open_], tried)
        got, likely = mixture(part, begins, sizes[docs], allowed)
        likely = likely - price[docs] * (k - 1)
        for j, i in enumerate(docs.tolist()):
            if likely[j] > best[i]:
                best[i], share[i] = likely[j], got[j]
                chosen[i] = [int(x) for x in order[tried[j], :k]]
    return chosen, share


def _rows_of(log_p: np.ndarray, at: np.ndarray, sizes: np.ndarray, picked: np.ndarray) -> tuple:
    """The rows of some documents and where each of them starts."""
    n = sizes[picked]
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    rows = np.repeat(at[picked] - starts, n) + np.arange(n.sum())
    return log_p[rows], starts


def identify(docs: DataFrame, model: Model, into: str = "language") -> DataFrame:
    """``docs`` with a struct column: lang, score, languages and shares of the whole text.

    lang is a learned language, "und" (score 0) where the text is null or has no
    letters or no language was learned; score is its share.  Rows are answered
    one by one, other columns are passed on.
    """
    kept = docs.drop(into)
    result = pa.struct([("lang", pa.string()), ("score", pa.float64()),
                        ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            texts, rows = batch.column(batch.num_columns - 1), []
            held, size = [], 0
            for i in range(batch.num_rows):
                held.append(texts[i].as_py().decode("utf-8", "replace"))
                size += len(held[-1])
                if size >= 4 * BATCH_WORDS or i == batch.num_rows - 1:
                    rows += scorer.score(held)
                    held, size = [], 0
            found = pa.array([dict(zip(("lang", "score", "languages", "shares"), r, strict=True))
                              for r in rows], result)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), found],
                names=[*batch.schema.names[:-1], into])
        scorer.forget()
        release_memory()

    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(
        f"`{into}` struct<lang: string, score: double, languages: array<string>, "
        "shares: array<double>>").fields])
    return kept.withColumn("__text", text_bytes()).mapInArrow(run, schema)
