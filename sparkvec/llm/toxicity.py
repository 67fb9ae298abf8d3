"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words and, for words of over ``STEM`` letters, their first ``STEM`` letters; each is hashed to one of
``BUCKETS`` features, 1 if present. The score is the logistic of
``w0 + sum w_i + sum_{i<j} <v_i, v_j>``, so a pair of terms (an insult and the mention of a group) can weigh what neither
does alone. Linear weights are learnt with an L1 proximal step, so the many terms of a long text that say nothing
stay at exactly 0 and do not add up; factors go through the same step, and terms left with nothing leave the training.

Training reads a bounded sample of labelled documents (``TRAIN_ROWS``, at most ``BUCKETS`` features each, hashed on the
executors); scoring reads every text whole, in blocks of bounded size.

Defined results: null and empty texts have no terms and score the logistic of w0; repeated rows score alike; labels of
unknown documents and null labels are ignored; without labels of both kinds all score the share of toxic ones, 0
without any; an empty table gives no rows; other columns, lang and source among them, are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.llm.common import labelled_sample, remainder, table
from sparkvec.llm.decontaminate import split_words

TRAIN_ROWS = 6000
BUCKETS = 1 << 18
RANK = 4
STEM = 5
EPOCHS = 300
RATE = 0.1
L1 = 1e-3
#: Epochs after which terms whose weight and factors are all 0 leave the training.
PRUNE = 6
#: Training documents that must hold a term before it is a feature.
LEAST_DOCS = 4
FOLDS, HELD = 5, 0
CACHE = 400_000


class _Hashed(dict):
    """Buckets of a word and of its stem, -1 if it has none; bounded."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= CACHE:
            self.clear()
        try:
            letters = word.decode()
        except UnicodeDecodeError:
            letters = word.decode("latin-1")
        stem = zlib.crc32(b"^" + letters[:STEM].encode()) % BUCKETS if len(letters) > STEM else -1
        found = (zlib.crc32(word) % BUCKETS, stem)
        self[word] = found
        return found


_HASHED = _Hashed()


def features(text: bytes) -> np.ndarray:
    """Sorted distinct buckets of a text's terms."""
    words = set(split_words(text))
    if not words:
        return np.zeros(0, np.int64)
    found = np.array([_HASHED[w] for w in words], dtype=np.int64).reshape(-1)
    return np.unique(found[found >= 0])


class Machine:
    """``w0``, and for the sorted buckets ``known`` their weights ``w`` and factors ``v``."""

    def __init__(self, w0: float, known: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.w0, self.known, self.w, self.v = w0, known, w, v
        self.at = np.full(BUCKETS, -1, np.int32)
        self.at[known] = np.arange(len(known))

    def __reduce__(self):
        return Machine, (self.w0, self.known, self.w, self.v)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        rows = [self.at[features(t)] for t in texts]
        rows = [r[r >= 0] for r in rows]
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return _logistic(_raw(self.w0, self.w, self.v, owner, np.concatenate(rows) if rows else np.zeros(0, np.int32), len(rows))[0])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _raw(w0: float, w: np.ndarray, v: np.ndarray, owner: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(score before the logistic, sum of factors) of each text from its (owner, feature) pairs."""
    linear = np.bincount(owner, weights=w[at], minlength=n)
    sums = np.stack([np.bincount(owner, weights=v[at, k], minlength=n) for k in range(v.shape[1])], axis=1)
    squares = np.bincount(owner, weights=(v**2).sum(axis=1)[at], minlength=n)
    return w0 + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def train(rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, l1: float = L1, rank: int = RANK) -> Machine:
    """Full-batch Adagrad on the log loss over the features of each text, both kinds weighed alike, with proximal L1 on weights
    and factors."""
    y = np.array(labels, dtype=np.float64)
    share = float(y.mean()) if len(y) else 0.0
    none = np.zeros(0, np.int64)
    if len(set(labels)) < 2:
        return Machine(60.0 if share else -60.0, none, np.zeros(0), np.zeros((0, rank)))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    known, at, counts = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    often = counts >= LEAST_DOCS
    kept = often[at]
    owner, at = owner[kept], (np.cumsum(often) - 1)[at[kept]]
    known = known[often]
    n, d = len(rows), len(known)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / n
    rng = np.random.default_rng(7)
    w0, w, v = 0.0, np.zeros(d), rng.normal(0, 0.01, (d, rank))
    g0, gw, gv = 1e-8, np.full(d, 1e-8), np.full((d, rank), 1e-8)
    for epoch in range(epochs):
        if epoch and epoch % PRUNE == 0:
            live = (w != 0) | (v != 0).any(axis=1)
            kept = live[at]
            owner, at = owner[kept], (np.cumsum(live) - 1)[at[kept]]
            known, w, v, gw, gv, d = known[live], w[live], v[live], gw[live], gv[live], int(live.sum())
        z, sums = _raw(w0, w, v, owner, at, n)
        delta = weight * (_logistic(z) - y)
        d0, dw = delta.sum(), np.bincount(at, weights=delta[owner], minlength=d)
        dv = np.stack([np.bincount(at, weights=delta[owner] * sums[owner, k], minlength=d) for k in range(rank)], axis=1) - v * dw[:, None]
        g0, gw, gv = g0 + d0**2, gw + dw**2, gv + dv**2
        w0 -= rate * d0 / np.sqrt(g0)
        step = rate / np.sqrt(gw)
        w = w - step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        step = 0.2 * rate / np.sqrt(gv)
        v = v - step * dv
        v = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
    live = (w != 0) | (v != 0).any(axis=1)
    return Machine(float(w0), known[live], w[live], v[live])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Train on at most ``rows`` labelled documents outside the held-out fold."""
    known = F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD)
    chosen = labelled_sample(labels, docs, known, ["toxic"], rows, "toxic")
    found = docs.select("doc_id", F.col("text").cast("string").alias("_text")).join(F.broadcast(chosen), "doc_id")
    hashed = found.select("doc_id", "toxic", "_text").mapInArrow(_hash_batches, "doc_id long, toxic int, found binary")
    rows = hashed.groupBy("doc_id").agg(F.min("found").alias("found"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return train([np.frombuffer(r["found"], dtype="<i4").astype(np.int64) for r in rows], [int(r["toxic"] == 1) for r in rows])


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the sample's texts as bytes, so that no text goes to the driver."""
    for batch in batches:
        found = [features(t.as_py() or b"").astype("<i4").tobytes() for t in batch.column(2).cast(pa.binary())]
        yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "toxic", "found"])


def _score(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary())
            score = np.concatenate([machine.value.scores([t.as_py() or b"" for t in texts.slice(at, 256)]) for at in range(0, len(texts), 256)] or [np.zeros(0)])
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(_score(sent), "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
