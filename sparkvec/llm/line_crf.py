"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are shares of byte kinds, word lengths, repetition within the line, and the same of
the lines before and after it; transitions tie neighbouring labels. It is trained on documents labelled as a whole: each
line of a training document takes its document's label, and the weights maximise the conditional likelihood, in which both
kinds of documents and all documents of a kind count alike, with forward-backward gradients and Adam. A document's quality is the mean of its lines' forward-backward marginals
of good, weighted by length in bytes, so white space weighs little and a long bad passage much.

Training reads a bounded sample of labelled documents (``TRAIN_ROWS``), whose features are counted on the executors, 14 numbers a
line; scoring reads every document whole. Recursions run over all documents of an Arrow batch at once, in blocks of bounded bytes.

Defined results: a text without words, null or empty, scores the share of good labels in the training sample; repeated
rows score alike; labels of unknown documents and null labels are ignored; without labels of both kinds all score that share,
0.5 without any; an empty table gives no rows; other columns, lang and source among them, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.llm.common import labelled_sample, remainder, table

TRAIN_ROWS = 4000
BLOCK_BYTES = 1 << 21
EPOCHS = 160
RATE = 0.05
PENALTY = 1e-3
FOLDS, HELD = 3, 1

_KIND = np.full(256, 0, np.uint8)  # letters and all beyond ASCII
for _k, _set in enumerate((b" \t\r\x0b\x0c", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&|<>", b".,;:'\"()-", b"!?"), start=1):
    _KIND[np.frombuffer(_set, np.uint8)] = _k
for _b in range(0x21, 0x7F):
    if not chr(_b).isalnum() and _KIND[_b] == 0:
        _KIND[_b] = 7
KINDS = 8
#: Own features of a line: a constant, shares of the kinds, two word-length and two repetition measures, log length.
OWN = KINDS + 6
FEATURES = 3 * OWN


def _line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Own features of non-empty lines [start, end) of a byte array."""
    n, length = len(starts), (ends - starts).astype(np.float64)
    out = np.zeros((n, OWN))
    kind = _KIND[data]
    bounds = np.stack([starts, ends], axis=1).reshape(-1)

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return (sums[bounds[1::2]] - sums[bounds[::2]]).astype(np.float64)

    for k in range(KINDS):
        out[:, k] = total(kind == k) / length
    space = kind == 1
    begins = ~space & np.concatenate([[True], space[:-1] | (data[:-1] == 10)]) & (data != 10)
    words = np.maximum(total(begins), 1)
    out[:, KINDS] = 1.0
    out[:, KINDS + 1] = np.log1p(total(~space) / words)
    out[:, KINDS + 2] = np.log(length) / 10
    # Repetition: words equal to the word before, or to the one eight before, by a hash of length and first and last bytes.
    at = np.flatnonzero(begins)
    stop = np.flatnonzero(~space & (data != 10) & np.concatenate([space[1:] | (data[1:] == 10), [True]]))
    if len(at):
        size = stop - at
        code = size * 16_777_216 + data[at].astype(np.int64) * 65_536 + data[stop].astype(np.int64) * 256 + data[(at + stop) // 2]
        line = np.searchsorted(starts, at, side="right") - 1
        for column, back in ((KINDS + 3, 1), (KINDS + 4, 8)):
            if len(at) > back:
                same = (code[back:] == code[:-back]) & (line[back:] == line[:-back])
                out[:, column] = np.bincount(line[back:], weights=same, minlength=n)[:n] / words
        short = np.bincount(line, weights=size < 3, minlength=n)[:n]
        out[:, KINDS + 5] = short / words
    return out


def own_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features of all lines with words, their lengths, number of such lines of each text)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    space = np.concatenate([[0], np.cumsum((_KIND[data] != 1) & (data != 10))])
    full = space[ends] > space[starts]
    starts, ends = starts[full], ends[full]
    counts = np.bincount(np.searchsorted(np.cumsum(lengths), starts, side="right"), minlength=len(texts))
    if not len(starts):
        return np.zeros((0, OWN)), np.zeros(0), counts
    return _line_features(data, starts, ends), (ends - starts).astype(np.float64), counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features of each line beside those of the lines before and after it in its text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    before, after = np.zeros_like(own), np.zeros_like(own)
    linked = owner[1:] == owner[:-1]
    before[1:][linked] = own[:-1][linked]
    after[:-1][linked] = own[1:][linked]
    return np.concatenate([own, before, after], axis=1)


class Chain:
    """Weights: ``w`` scores a line as good, ``t`` (2 x 2) neighbouring labels. ``prior``: for texts without lines."""

    def __init__(self, w: np.ndarray, t: np.ndarray, prior: float):
        self.w, self.t, self.prior = w, t, prior

    def marginals(self, scores: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginal of good of each line, expected counts of label pairs, log partition of each text). ``weight``: of each
        line's text in the counts."""
        n, first = len(counts), np.concatenate([[0], np.cumsum(counts)[:-1]])
        order = np.argsort(-counts, kind="stable")
        unary = np.stack([np.zeros_like(scores), scores], axis=1)
        alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
        # more[k] texts have more than k lines
        more = (n - np.searchsorted(np.sort(counts), np.arange(counts.max(initial=0)), side="right")).tolist()
        for k, m in enumerate(more):
            at = first[order[:m]] + k
            alpha[at] = unary[at] if k == 0 else unary[at] + np.logaddexp(alpha[at - 1, :1] + self.t[0], alpha[at - 1, 1:] + self.t[1])
        for k in range(len(more) - 2, -1, -1):
            at = first[order[: more[k + 1]]] + k
            step = unary[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(step[:, :1] + self.t[:, 0], step[:, 1:] + self.t[:, 1])
        log_z = np.zeros(n)
        some = counts > 0
        last = (first + counts - 1)[some]
        log_z[some] = np.logaddexp(alpha[last, 0], alpha[last, 1])
        line_z = np.repeat(log_z, counts)
        good = np.exp(np.clip(alpha[:, 1] + beta[:, 1] - line_z, -700, 0))
        pairs = np.zeros((2, 2))
        owner = np.repeat(np.arange(n), counts)
        at = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
        for a in (0, 1):
            for b in (0, 1):
                each = np.exp(np.clip(alpha[at, a] + self.t[a, b] + unary[at + 1, b] + beta[at + 1, b] - line_z[at], -700, 0))
                pairs[a, b] = each.sum() if weight is None else each @ weight[at]
        return good, pairs, log_z

    def quality(self, texts: list[bytes]) -> np.ndarray:
        own, lengths, counts = own_features(texts)
        good, _, _ = self.marginals(with_neighbours(own, counts) @ self.w, counts)
        owner = np.repeat(np.arange(len(texts)), counts)
        weight = np.bincount(owner, weights=lengths, minlength=len(texts))
        total = np.bincount(owner, weights=lengths * good, minlength=len(texts))
        return np.where(weight > 0, np.clip(total / np.maximum(weight, 1), 0, 1), self.prior)


def train(own: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY) -> Chain:
    """Maximise the likelihood of all lines' labels from each text's own features; a text's lines share its weight, and both kinds
    of texts count alike."""
    prior = float(np.mean(labels)) if labels else 0.5
    chain = Chain(np.zeros(FEATURES), np.zeros((2, 2)), prior)
    if len(set(labels)) < 2:
        chain.w[KINDS] = np.log((prior + 1e-3) / (1 - prior + 1e-3)) if labels else 0.0
        return chain
    counts, y = np.array([len(x) for x in own], dtype=np.int64), np.array(labels)
    x = with_neighbours(np.concatenate(own), counts)
    per_text = np.where(y == 1, 0.5 / max(prior, 1e-9), 0.5 / max(1 - prior, 1e-9)) / np.maximum(counts, 1)
    weight = np.repeat(per_text, counts)
    target = np.repeat(y, counts).astype(np.float64)
    scale = max(per_text @ counts, 1e-9)
    owner = np.repeat(np.arange(len(counts)), counts)
    twin = np.flatnonzero(owner[1:] == owner[:-1])
    seen = np.diag([weight[twin] @ (1 - target[twin]), weight[twin] @ target[twin]])
    theta = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        chain.w, chain.t = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        good, pairs, _ = chain.marginals(x @ chain.w, counts, weight)
        gradient = np.concatenate([x.T @ (weight * (target - good)), (seen - pairs).reshape(-1)]) / scale - penalty * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    chain.w, chain.t = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
    return chain


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own features of the sample's texts as bytes, so that no text goes to the driver."""
    for batch in batches:
        found = [own_features([t.as_py() or b""])[0].astype("<f4").tobytes() for t in batch.column(2).cast(pa.binary())]
        yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "quality", "found"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Chain:
    """Train on at most ``rows`` labelled documents outside the held-out fold."""
    known = F.col("quality").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD)
    chosen = labelled_sample(labels, docs, known, ["quality"], rows, "quality")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("_text")).join(F.broadcast(chosen), "doc_id")
    found = texts.select("doc_id", "quality", "_text").mapInArrow(_feature_batches, "doc_id long, quality int, found binary")
    each = found.groupBy("doc_id").agg(F.min("found").alias("found"), F.max("quality").alias("quality")).orderBy("doc_id").collect()
    return train([np.frombuffer(r["found"], "<f4").reshape(-1, OWN).astype(np.float64) for r in each], [int(r["quality"] == 1) for r in each])


def _score(chain: Chain, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary())
            out, block, held = [], [], 0
            for text in texts:
                block.append(text.as_py() or b"")
                held += len(block[-1])
                if held > block_bytes:
                    out.append(chain.quality(block))
                    block, held = [], 0
            if block:
                out.append(chain.quality(block))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_documents(docs: DataFrame, chain: Chain, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(_score(chain, block_bytes), "doc_id long, held_out boolean, score double, predicted int")


def op10_line_crf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
