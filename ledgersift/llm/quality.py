"""A quality classifier on subword embeddings.

Words and the character n-grams inside them are hashed into a table of learned
vectors; a document is the mean of its vectors, and a softmax over two classes
scores it. The table is trained by numpy stochastic gradient descent on a
bounded sample of labelled texts; scoring is a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.llm.rolling import prefix_sums, span_hash

#: Labelled rows used for fitting, at most; the labels beyond are not needed for a table of this size.
SAMPLE_ROWS = 4000
#: Characters of the sample, at most; rows beyond it, in the order of their hash, are left out whole.
SAMPLE_CHARS = 40_000_000
BUCKETS = 1 << 16
DIMENSIONS = 12
EPOCHS = 6
RATE = 0.25
NGRAMS = (3, 4)
BATCH_BYTES = 1 << 20
SEED = 11

_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, index of its text) for UTF-8 texts.

    Features are whole words as written, and the 3- and 4-grams of bytes inside
    the lower-cased words with their bounding spaces.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes)])
    space = _SPACE[raw]
    low = _BYTE[_LOWER[raw]]
    ids, of = [], []
    for n in NGRAMS:
        if len(raw) < n:
            continue
        count = len(raw) - n + 1
        code = low[:count] * np.uint64(n)
        inner = np.zeros(count, bool)
        for k in range(1, n):
            code = (code ^ (code >> np.uint64(29))) * _MIX + low[k:k + count]
            if k < n - 1:
                inner |= space[k:k + count]
        keep = ~inner & ~(space[:count] & space[n - 1:n - 1 + count])
        # A space stands between two texts, so the second byte tells whose the n-gram is.
        ids.append(code[keep])
        of.append(owner[1:count + 1][keep])
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(starts):
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        ids.append(span_hash(prefix_sums(raw), starts, ends, raw))
        of.append(owner[starts])
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.concatenate(ids)
    code = (code ^ (code >> np.uint64(32))) * _MIX
    return (code >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1), np.concatenate(of)


@dataclass
class QualityModel:
    """Per bucket the margin of class 1 that its vector adds, and the bias."""

    margins: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        ids, of = features(texts)
        total = np.bincount(of, self.margins[ids], len(texts))
        n = np.bincount(of, minlength=len(texts))
        z = total / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray) -> QualityModel:
    """Fit by stochastic gradient descent, one document a step, the rate falling to zero.

    Without both classes the model is the bias alone.
    """
    labels = np.asarray(labels, np.int64)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(rate / (1 - rate)))
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, 2), np.float32)
    offset = np.array([0.0, bias], np.float32)
    if len(set(labels.tolist())) < 2:
        return QualityModel(np.zeros(BUCKETS), bias)
    # Few bytes per distinct feature, in two arrays: this stands in the driver's memory.
    found = (np.unique(features([text])[0], return_counts=True) for text in texts)
    pairs = [(ids.astype(np.uint16), n.astype(np.uint32)) for ids, n in found]
    edges = np.cumsum([0] + [len(ids) for ids, _ in pairs])
    held, times = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    del pairs
    # The rarer class weighs more, so that both count alike.
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    step, steps = 0, EPOCHS * len(texts)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)):
            lr = RATE * (1 - step / steps)
            step += 1
            ids, n = held[edges[i]:edges[i + 1]], times[edges[i]:edges[i + 1]]
            if not len(ids):
                continue
            share = (n / n.sum()).astype(np.float32)
            hidden = share @ table[ids]
            z = hidden @ out + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]]
            back = out @ p
            out -= lr * np.outer(hidden, p)
            offset -= lr * 0.1 * p
            # A mean over thousands of features would hardly move any of them.
            table[ids] -= np.outer(share * min(len(ids), 50), lr * back)
    margin = out[:, 1] - out[:, 0]
    return QualityModel((table @ margin).astype(np.float64), float(offset[1] - offset[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Train on at most about ``rows`` labelled texts, chosen by a hash of the id.

    Only rows whose crc32(doc_id) mod 3 is not 1 take part; the others are held out.
    Labels that are null are left out, a doc_id labelled twice counts once with
    its smallest label.
    """
    usable = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    share = min(1.0, rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    # The window sees a bounded number of rows.
    order = Window.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id")
    sample = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
        .withColumn("place", F.row_number().over(order)).withColumn("chars", F.sum(F.length("text")).over(order))
        .where((F.col("place") <= rows) & (F.col("chars") <= SAMPLE_CHARS))
        .orderBy("place").select("text", "quality").toArrow()
    )
    labels = np.array(sample.column("quality").to_pylist(), np.int64)
    texts = [t.as_py().encode() for t in sample.column("text")]
    del sample
    return train(texts, labels)


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that no training sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_texts(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Add ``score`` (0 to 1) to (doc_id, text); null counts as empty.

    Each text is scored whole and by itself, so repeated rows get equal scores.
    """
    holder = docs.sparkSession.sparkContext.broadcast((model.margins.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = QualityModel(*holder.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(held, batch.column(1)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``, in its columns; no shuffle."""
    holder = docs.sparkSession.sparkContext.broadcast((model.margins.astype(np.float32), model.bias))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = QualityModel(*holder.value)
        for batch in batches:
            yield batch.filter(pa.array(_scores(held, batch.column(at)) >= least))

    return docs.mapInArrow(run, docs.schema)


def _scores(model: QualityModel, texts: pa.Array) -> np.ndarray:
    encoded = [(t or "").encode() for t in texts.to_pylist()]
    scores, start, size = np.zeros(len(encoded)), 0, 0
    for i, text in enumerate(encoded):
        size += len(text)
        if size >= BATCH_BYTES or i + 1 == len(encoded):
            scores[start:i + 1] = model.score(encoded[start:i + 1])
            start, size = i + 1, 0
    return scores
