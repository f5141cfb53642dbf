"""Quality: supervised subword embeddings.

Each feature of a text (a word, a pair of neighbouring words, a character n-gram
inside a word with its edges) hashes to a row of an embedding matrix.  A text is
the mean of its features' vectors; a softmax layer over the mean gives the class
probabilities.  Vectors and layer are learned together by stochastic gradient
descent in numpy.

The hash of a pair is symmetric and depends on the two words' exclusive or, so a
word followed by itself always has the same feature: repetition can be learned.

Scoring uses that mean and softmax layer are linear before the softmax: a row of
the matrix times the difference of the two classes' weights is one number, and
the logit of a text is the mean of its features' numbers.

Bound: at most ``SAMPLE`` labelled rows (half of each class) are read to fit;
class weights restore the labelled share.  All rows and whole texts are scored.

Defined cases: null and empty texts have no features; their logit is the bias.
Without labelled rows of both classes every score is the share of label 1 (0.5
without any).  Columns of the input with the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .blocks import WHITE, Block, blocks, mix64, words

SAMPLE = 3000
BUCKET_BITS = 17
DIMENSIONS = 12
EPOCHS = 6
BATCH = 32
RATE = 0.8
NGRAMS = (2, 3, 4)
SEED = 7

_SPACE = np.uint8(0x20)


def features(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text index) arrays, one pair of arrays for each kind of feature."""
    shift = np.uint64(64 - BUCKET_BITS)
    found = words(block, lower=False)
    doc = found.doc()
    yield mix64(found.hash + np.uint64(1)) >> shift, doc
    if len(doc) > 1:
        same = doc[1:] == doc[:-1]
        yield mix64((found.hash[1:] ^ found.hash[:-1]) + np.uint64(2))[same] >> shift, doc[1:][same]
    data = np.where(WHITE[block.data], _SPACE, block.data).astype(np.uint64)
    white = WHITE[block.data]
    of = np.repeat(np.arange(len(block)), np.diff(block.offsets))
    for n in NGRAMS:
        if len(data) < n:
            continue
        size = len(data) - n + 1
        code = np.full(size, n, dtype=np.uint64)
        inner = np.zeros(size, dtype=bool)
        for k in range(n):
            code = code * np.uint64(257) + data[k : k + size]
            if 0 < k < n - 1:
                inner |= white[k : k + size]
        own = ~inner & (of[:size] == of[n - 1 :]) & ~(white[:size] & white[n - 1 :])
        yield (code[own] * np.uint64(0x9E3779B97F4A7C15)) >> shift, of[:size][own]


@dataclass
class Model:
    """What is left of the network for scoring: one number for each feature bucket."""

    table: np.ndarray
    bias: float

    def logits(self, block: Block) -> np.ndarray:
        total, count = np.zeros(len(block)), np.zeros(len(block))
        for bucket, doc in features(block):
            total += np.bincount(doc, self.table[bucket.astype(np.int64)], minlength=len(block))
            count += np.bincount(doc, minlength=len(block))
        return self.bias + total / np.maximum(count, 1)

    def scores(self, block: Block) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(block), -50, 50)))


def fit(sample: list[tuple[int, str, int]], share: float, epochs: int = EPOCHS) -> Model:
    """Learn vectors and softmax layer from (id, text, label) rows by minibatch gradient descent.

    ``share`` is the share of label 1 among all labelled rows.
    """
    size = 1 << BUCKET_BITS
    y = np.array([label for _, _, label in sample], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(size, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    # Sparse rows: the distinct buckets of each text with their shares.
    bucket_parts, doc_parts = [], []
    for block in blocks(pa.array([t for _, t, _ in sample], pa.large_string())):
        pairs = np.concatenate([doc.astype(np.uint64) << np.uint64(BUCKET_BITS) | bucket for bucket, doc in features(block)] or [np.zeros(0, np.uint64)])
        pair, count = np.unique(pairs, return_counts=True)
        bucket_parts.append(np.stack([pair & np.uint64(size - 1), count.astype(np.uint64)]))
        doc_parts.append((pair >> np.uint64(BUCKET_BITS)).astype(np.int64) + block.first)
    bucket, count = np.concatenate(bucket_parts, axis=1).astype(np.int64)
    doc = np.concatenate(doc_parts)
    value = (count / np.bincount(doc, count, minlength=len(y))[doc]).astype(np.float32)
    start = np.searchsorted(doc, np.arange(len(y) + 1))
    rng = np.random.default_rng(SEED)
    vectors = (rng.random((size, DIMENSIONS), dtype=np.float32) - 0.5) / DIMENSIONS
    layer = np.zeros((DIMENSIONS, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    weight = np.where(y == 1, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6)).astype(np.float32)
    steps, step = epochs * -(-len(y) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            span = np.concatenate([np.arange(start[r], start[r + 1]) for r in rows])
            local = np.repeat(np.arange(len(rows)), start[rows + 1] - start[rows])
            b, v = bucket[span], value[span]
            hidden = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
            filled = np.flatnonzero(np.diff(np.append(-1, local)))
            if len(span):
                hidden[local[filled]] = np.add.reduceat(vectors[b] * v[:, None], filled, axis=0)
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = p
            error[np.arange(len(rows)), y[rows]] -= 1
            error *= weight[rows][:, None]
            back = error @ layer.T
            layer -= rate * hidden.T @ error
            bias -= rate * 0.1 * error.mean(axis=0)
            step_vectors = (rate * v)[:, None] * back[local]
            o = np.argsort(b, kind="stable")
            first = np.flatnonzero(np.diff(np.append(-1, b[o])))
            if len(span):
                vectors[b[o][first]] -= np.add.reduceat(step_vectors[o], first, axis=0)
    difference = layer[:, 1] - layer[:, 0]
    return Model(vectors @ difference, float(bias[1] - bias[0]))


def fitted(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """A model from the labelled training rows (``labels.quality``)."""
    from pyspark.sql import functions as F

    train = labels.where(common.crc_mod(F.col("doc_id"), 5) != 0)
    share = train.where(F.col("quality").isin(0, 1)).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return fit(common.labelled_sample(docs, labels, "quality", bound), 0.5 if share is None else float(share))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score``, the probability of label 1."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BUCKET_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                part = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(shared.value.scores(block))], kept + ["score"])

    return docs.transform(common.arrow(run, schema))
