"""Quality classifier on supervised subword embeddings.

A word's tokens are its hash, its character 3- to 5-grams (with word ends marked), and one token for its
shape; a word equal to the one before it adds a token of its own. Every token has a learned vector in a hashed table, a document is
the mean of its tokens' vectors, and softmax over two outputs gives the score. Vectors and outputs are
trained by numpy stochastic gradient descent on a bounded, balanced sample of labelled training rows
(`per_class`). Scoring is linear in the mean, so it needs one number per token: the table's projection.

Defined results: a null or empty text has no tokens and gets the bias alone, with one fixed token "empty" as
its only feature; without training rows of both labels every score is 0.5; repeated rows score alike; an
empty table gives an empty result; whole texts are read, whatever their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, read
from .samples import labelled_sample

BUCKETS, DIM = 1 << 17, 8
THRESHOLD = 0.3
#: Words a task keeps ready; beyond it the table starts anew. Words of more than so many bytes are not kept.
CACHE, LONG = 300_000, 100
MASK = BUCKETS - 1
SAME, EMPTY = crc32(b"\0same") & MASK, crc32(b"\0empty") & MASK


def shape(word: bytes) -> bytes:
    body = word.strip(b".,;:!?")
    kind = b"U" if body.isupper() and len(body) > 1 else b"T" if body.istitle() else b"d" if body.isdigit() else b"l" if body.isalpha() else b"x"
    return b"\0shape" + kind + bytes([min(len(word), 12), min(len(word) - len(body), 255)])


def word_ids(word: bytes) -> list[int]:
    w = b"<" + word + b">"
    ids = [crc32(word) & MASK, crc32(shape(word)) & MASK]
    for n in (3, 4, 5):
        ids += [crc32(w[i : i + n]) & MASK for i in range(len(w) - n + 1)]
    return ids


def features(text: bytes | None) -> tuple[list[int], list[int]]:
    words = (text or b"").split()
    if not words:
        return [EMPTY], [1]
    counts: Counter = Counter()
    for w, n in Counter(words).items():
        for i in word_ids(w):
            counts[i] += n
    if same := sum(a == b for a, b in zip(words, words[1:], strict=False)):
        counts[SAME] += same * 20  # weighs as much as the words' other tokens
    return list(counts.keys()), list(counts.values())


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (0, 1))], names=["label", "ids", "counts"])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 32, rate: float = 2.0, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(projection of every bucket, bias) of the difference of the two outputs."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-0.5 / DIM, 0.5 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    out[1], out[0] = rng.normal(0, 0.3, DIM), rng.normal(0, 0.3, DIM)
    steps, done = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at : at + batch]]
            ids = np.concatenate([r[1] for r in part])
            weight = np.concatenate([r[2] / r[2].sum() for r in part]).astype(np.float32)
            doc = np.repeat(np.arange(len(part)), [len(r[1]) for r in part])
            starts = np.concatenate([[0], np.cumsum([len(r[1]) for r in part])[:-1]])
            h = np.add.reduceat(table[ids] * weight[:, None], starts, axis=0)
            z = h @ out.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [r[0] for r in part]] -= 1
            lr = rate * (1 - done / steps)
            to_h = p @ out
            out -= lr * (p.T @ h) / len(part)
            bias -= 0.1 * lr * p.mean(axis=0)
            np.add.at(table, ids, (-lr * 4.0) * to_h[doc] * weight[:, None])
            done += 1
    side = out[1] - out[0]
    return (table @ side).astype(np.float64), float(bias[1] - bias[0])


def fit(sample: DataFrame) -> tuple[np.ndarray, float]:
    """sample: text (binary), label; its features (bounded by the sample) come to the driver."""
    got = sample.select("text", "label").mapInArrow(_featurize, "label int, ids array<int>, counts array<int>").toArrow()
    labels = got.column("label").to_pylist()
    rows = [(y, i.values.to_numpy(), c.values.to_numpy()) for y, i, c in zip(labels, got.column("ids"), got.column("counts"), strict=True)]
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS), 0.0
    return train(sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes())))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, bias = shared.value
        table = projection.tolist()

        class Sums(dict):
            def __missing__(self, word: bytes) -> complex:
                ids = word_ids(word)
                got = complex(sum([table[i] for i in ids]), len(ids))
                if len(self) >= CACHE:
                    self.clear()
                if len(word) <= LONG:
                    self[word] = got
                return got

        cache = Sums()
        for b in batches:
            scores = []
            for t in b.column(1):
                words = (t.as_py() or b"").split()
                if words:
                    total = sum(map(cache.__getitem__, words))
                    same = 20 * sum(map(bytes.__eq__, words[1:], words))
                    z = (total.real + same * table[SAME]) / (total.imag + same) + bias
                else:
                    z = table[EMPTY] + bias
                scores.append(1.0 / (1.0 + np.exp(-min(max(z, -500.0), 500.0))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double")


def op2_quality(spark, sf_dir: str, per_class: int = 2000) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    held: Column = crc_mod(F.col("doc_id"), 5) == 0
    model = fit(labelled_sample(docs, labels, "quality", ~held, per_class))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
