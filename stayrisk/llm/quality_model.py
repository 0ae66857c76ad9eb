"""Operator 4: quality classifier on random-indexing word vectors.

Words and runs of symbols hash into ``BUCKETS``.  Every bucket has a sparse
random index vector (one +1, one -1 among ``DIMS``); a bucket's word vector is
the sum of the index vectors of its neighbours within two places, over the
whole corpus.  Tasks sum their texts and hand on blocks of the table, which are
added up in a second step.  A document is the mean and the spread of its words'
vectors; a two-layer network, fitted on a bounded sample of labelled rows, maps
them to a probability whose temperature is calibrated on a part kept back.

Cases: null and empty texts have zero vectors and get the score of that input;
labels that are null, or of ids without a row, teach nothing; without labels
every score is 0.5; null and repeated ids are fine (a null id is not held out);
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (LETTERS, NOT_BLANK, Words, binary_temperature, chunks, fold, held_out, labelled_texts, mix64,
                     partitions, sigmoid, split_words)

BUCKETS = 1 << 14
DIMS = 32
REACH = 2
PER_LABEL = 3000
HIDDEN = 24
STEPS = 1600  # of Adam, at any number of rows
MINIBATCH = 256
BLOCK = 256
#: Blank, symbol or letter: words and runs of symbols are tokens of their own.
KINDS = (NOT_BLANK + LETTERS).astype(np.uint8)


def buckets(col: pa.Array) -> tuple[np.ndarray, Words]:
    words = split_words(col, kinds=KINDS)
    return (words.hash >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), words


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Place of the +1 and of the -1 of each bucket's index vector."""
    h = mix64(np.arange(1, BUCKETS + 1, dtype=np.uint64))
    plus = (h % np.uint64(DIMS)).astype(np.int64)
    return plus, (plus + 1 + ((h >> np.uint64(32)) % np.uint64(DIMS - 1)).astype(np.int64)) % DIMS


def add_contexts(table: np.ndarray, bucket: np.ndarray, text: np.ndarray) -> None:
    """Add to ``table`` (flat, buckets x dims) the neighbours of every word."""
    plus, minus = index_vectors()
    for step in range(1, REACH + 1):
        same = text[step:] == text[:-step]
        left, right = bucket[:-step][same], bucket[step:][same]
        for a, b in ((left, right), (right, left)):
            table += np.bincount(a * DIMS + plus[b], minlength=len(table))
            table -= np.bincount(a * DIMS + minus[b], minlength=len(table))


def _contexts(batches):
    table = np.zeros(BUCKETS * DIMS, np.int64)
    for b in chunks(batches):
        bucket, words = buckets(b.column("text"))
        add_contexts(table, bucket, words.text_of())
    parts = table.astype(np.float32).reshape(-1, BLOCK * DIMS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "sums"])


def _add_blocks(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column("block").to_pylist(), b.column("sums")):
            part = np.frombuffer(v.as_buffer(), np.float32).astype(np.float64)
            total[k] = total[k] + part if k in total else part
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors (buckets x dims) from the contexts of the whole table."""
    n = BUCKETS // BLOCK
    rows = (docs.select("text").mapInArrow(_contexts, "block int, sums binary")
            .repartition(min(n, max(2, partitions(docs.sparkSession))), "block").mapInArrow(_add_blocks, "block int, sums binary").collect())
    table = np.zeros((BUCKETS, DIMS))
    for r in rows:
        table[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"], np.float32).reshape(-1, DIMS)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(col: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each text's word vectors."""
    bucket, words = buckets(col)
    n = np.diff(words.first)
    v = vectors[bucket]
    out = np.zeros((len(n), 2 * DIMS))
    some = np.flatnonzero(n)
    if len(some):
        at = words.first[:-1][some]
        mean = np.add.reduceat(v, at, axis=0, dtype=np.float64) / n[some, None]
        square = np.add.reduceat(v * v, at, axis=0, dtype=np.float64) / n[some, None]
        out[some, :DIMS] = mean
        out[some, DIMS:] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


def gradient(p: list, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list:
    """Derivatives of the weighted log loss (sum of ``weight`` parts) plus the
    small L2 price of both layers' weights."""
    h = np.tanh(x @ p[0] + p[1])
    e = (sigmoid(h @ p[2] + p[3]) - y) * weight
    back = np.outer(e, p[2]) * (1 - h * h)
    return [x.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 5) -> tuple:
    """Two-layer network (tanh, logistic) by ``STEPS`` steps of Adam on
    minibatches: (mean, scale, w1, b1, w2, b2)."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    weight = weight / weight.mean()
    while t < STEPS:
        order = rng.permutation(len(x))
        for k in range(0, min(len(x), (STEPS - t) * MINIBATCH), MINIBATCH):
            at = order[k:k + MINIBATCH]
            t += 1
            for i, g in enumerate(gradient(p, x[at], y[at], weight[at] / len(at))):
                m[i] += 0.1 * (g - m[i])
                s[i] += 0.001 * (g * g - s[i])
                p[i] -= 0.005 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(s[i] / (1 - 0.999 ** t)) + 1e-8)
    return mean, scale, *p


def forward(net: tuple, x: np.ndarray) -> np.ndarray:
    mean, scale, w1, b1, w2, b2 = net
    return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality", learn=None, per_label: int = PER_LABEL):
    """(network, temperature), or None without any label."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(pool(b.column("text"), shared.value)), pa.list_(pa.float64())), *[b.column(c) for c in ("y", "weight", "fold", "doc_id")]],
                names=["x", "y", "weight", "fold", "doc_id"])

    sample = labelled_texts(docs, labels, label, F.lit(True) if learn is None else learn, per_label).withColumn("fold", fold(8))
    got = sample.select("text", "y", "weight", "fold", "doc_id").mapInArrow(
        run, "x array<double>, y int, weight double, fold int, doc_id long").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    x = np.array(got.column("x").to_pylist())
    y, weight, part = (got.column(c).to_numpy() for c in ("y", "weight", "fold"))
    back = part == 0
    if back.all() or len(np.unique(y[~back])) < len(np.unique(y)):
        back[:] = False
    net = fit_network(x[~back], y[~back].astype(float), weight[~back])
    return net, binary_temperature(forward(net, x[back]), y[back].astype(float))


def score(docs: DataFrame, vectors: np.ndarray, model) -> DataFrame:
    """``docs`` with ``score`` in place of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        vectors, model = shared.value
        for b in chunks(batches):
            if model is None:
                p = np.full(b.num_rows, 0.5)
            else:
                p = sigmoid(forward(model[0], pool(b.column("text"), vectors)) / model[1])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(p, pa.float64())], names=[*rest, "score"])

    kinds = ", ".join(f"`{n}` {k}" for n, k in docs.select(*rest).dtypes)
    return docs.mapInArrow(run, f"{kinds}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    out = held_out(5, 0)
    vectors = word_vectors(docs)
    model = fit(docs, labels, vectors, learn=~out)
    scored = score(docs.select("doc_id", out.alias("held_out"), "text"), vectors, model)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
