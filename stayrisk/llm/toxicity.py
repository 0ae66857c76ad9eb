"""Operator 10: toxicity by multiple-instance learning.

A document is a bag of sentences (split at . ! ? and line ends); a sentence is
a bag of hashed words and word beginnings with a logistic score p.  The
document's score is the noisy-or 1 - prod(1 - p).  Only documents carry labels:
the gradient of the document loss flows to the sentences through the noisy-or,
so the model learns which sentences offend, and then points them out.  It is
fitted on a bounded sample of labelled rows by full-batch Adagrad with an L1
proximal step; temperature and shift of the document's logit are calibrated on
a part kept back, at the labels' own frequency.

Cases: null and empty texts have no sentence and score 0; labels that are null,
or of ids without a row, teach nothing; without labels every score is 0; null
and repeated ids are fine (a null id is not held out); an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, chunks, fold, held_out, labelled_texts, logit, mix64, sigmoid, spans_hash, split_bytes, utf8

FEATURES = 1 << 18
BEGINNINGS = (4, 5, 6, 7, 8)
PER_LABEL = 2000
STEPS = 250
RATE = 1.0
L1_DOCS = 0.2
SLOW_DOCS = 3.0
START = -6.0
OFFENDS = 0.5
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def sentences(col: pa.Array):
    """(feature buckets, sentence of each, text of each sentence, sentence
    bounds in the bytes, bytes) over all texts; sentences without words do not
    count."""
    data, off = utf8(pc.utf8_lower(pc.fill_null(col, "")))
    words = split_bytes(data, off, LETTERS)
    stops = np.cumsum(_STOP[data]) if len(data) else np.zeros(0, np.int64)
    text = words.text_of()
    mark = stops[words.start] if len(words.start) else np.zeros(0, np.int64)
    new = np.concatenate([[True], (np.diff(mark) != 0) | (np.diff(text) != 0)]) if len(text) else np.zeros(0, bool)
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(text)]]) - 1 if len(first) else first
    bounds = np.stack([words.start[first], words.end[last]], axis=1)
    # a word and its beginnings, each salted by its kind
    hashes, owner = [words.hash], [sentence]
    length = words.end - words.start
    for n in BEGINNINGS:
        at = np.flatnonzero(length >= n)
        if len(at):
            hashes.append(mix64(spans_hash(data, words.start[at], words.start[at] + n) + np.uint64(n)))
            owner.append(sentence[at])
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    bucket = (hashes[order] >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)
    return bucket, owner[order], text[first], bounds, data


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def noisy_or(z: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """P(any sentence offends) per text from sentence logits."""
    return -np.expm1(-np.bincount(text, _softplus(z), minlength=n))


def bag_gradient(w, b, bucket, sentence, text, y) -> tuple[np.ndarray, float]:
    """Derivatives of the mean document log loss, P(document) the noisy-or of its
    sentences' probabilities, in the feature weights and the bias."""
    z = np.bincount(sentence, w[bucket], minlength=len(text)) + b
    p = sigmoid(z)
    clean = np.exp(-np.bincount(text, _softplus(z), minlength=len(y)))  # P(no sentence offends)
    pull = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0) / len(y)
    g_sentence = pull[text] * p
    return np.bincount(bucket, g_sentence[sentence], minlength=len(w)), float(g_sentence.sum())


def fit_bags(bucket, sentence, text, y, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(feature weights, bias): minimises the mean document log loss.  The L1
    price is that of ``L1_DOCS`` documents, so what few documents hold is not
    learnt, and the step of a rare feature is short."""
    w, b = np.zeros(FEATURES), START
    squares, bias_squares = np.zeros(FEATURES), 0.0
    price, floor = L1_DOCS / len(y), SLOW_DOCS / len(y)
    for _ in range(steps):
        g, gb = bag_gradient(w, b, bucket, sentence, text, y)
        squares += g * g
        bias_squares += gb * gb
        step = RATE / (np.sqrt(squares) + floor)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * price, 0)
        b -= 0.2 * RATE * gb / (np.sqrt(bias_squares) + 1e-9)
    return w, float(b)


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(temperature, shift) of the best weighted log loss of sigmoid((z + shift) / T)."""
    if len(y) < 2 or y.min() == y.max():
        return 1.0, 0.0
    best = (np.inf, 1.0, 0.0)
    for t in np.exp(np.linspace(np.log(0.25), np.log(6.0), 25)):
        for shift in np.linspace(-6, 6, 25):
            v = (z + shift) / t
            best = min(best, (float((weight * (np.logaddexp(0, v) - y * v)).sum()), float(t), float(shift)))
    return best[1], best[2]


def _bags(batches):
    for b in chunks(batches):
        bucket, sentence, text, _, _ = sentences(b.column("text"))
        by_text = text[sentence] if len(sentence) else sentence
        cut = np.searchsorted(by_text, np.arange(b.num_rows + 1))
        begin = np.searchsorted(text, np.arange(b.num_rows))
        rows = [(bucket[i:j], sentence[i:j] - k) for i, j, k in zip(cut[:-1], cut[1:], begin)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
             *[b.column(c) for c in ("y", "weight", "fold", "doc_id")]], names=["words", "sentence", "y", "weight", "fold", "doc_id"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn=None, per_label: int = PER_LABEL):
    """(feature weights, bias, temperature, shift), or None without any label."""
    sample = labelled_texts(docs, labels, label, F.lit(True) if learn is None else learn, per_label).withColumn("fold", fold(8))
    got = sample.select("text", "y", "weight", "fold", "doc_id").mapInArrow(
        _bags, "words array<int>, sentence array<int>, y int, weight double, fold int, doc_id long").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    y, weight, part = (got.column(c).to_numpy() for c in ("y", "weight", "fold"))
    flat = {c: got.column(c).combine_chunks() for c in ("words", "sentence")}
    cut = flat["words"].offsets.to_numpy().astype(np.int64)
    cut, words, sentence = cut - cut[0], flat["words"].flatten().to_numpy(), flat["sentence"].flatten().to_numpy()
    size = np.diff(cut)
    # a feature of one document cannot pay the L1 price: leave it out
    pairs = np.unique(words.astype(np.int64) * len(y) + np.repeat(np.arange(len(y)), size))
    common = np.bincount(pairs // len(y), minlength=FEATURES) > 1

    def joined(at):
        """Features, their sentences and the sentences' documents for some rows."""
        n = np.array([sentence[cut[k + 1] - 1] + 1 if size[k] else 0 for k in at], np.int64)
        base = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        picked = np.concatenate([np.arange(cut[k], cut[k + 1]) for k in at])
        own = sentence[picked] + np.repeat(base[:-1], size[at])
        seen = common[words[picked]]
        return words[picked][seen].astype(np.int64), own[seen], np.repeat(np.arange(len(at)), n)

    back = part == 0
    if back.all() or len(np.unique(y[~back])) < len(np.unique(y)):
        back[:] = False
    learnt = np.flatnonzero(~back)
    w, b = fit_bags(*joined(learnt), y[learnt].astype(float))
    kept = np.flatnonzero(back)
    scale = 1.0, 0.0
    if len(kept):
        bucket, sentence, text = joined(kept)
        z = np.bincount(sentence, w[bucket], minlength=len(text)) + b
        scale = calibrate(logit(noisy_or(z, text, len(kept))), y[kept].astype(float), weight[kept])
    return w.astype(np.float32), b, *scale


OUT = "doc_id long, held_out boolean, score double, sentences array<struct<number:int,score:double,text:string>>"


def score(docs: DataFrame, model, offends: float = OFFENDS) -> DataFrame:
    """``doc_id, held_out, score`` and the offending ``sentences`` (number,
    score, lower-cased text) of ``docs`` (``doc_id, held_out, text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in chunks(batches):
            found: list[list] = [[] for _ in range(b.num_rows)]
            p = np.zeros(b.num_rows)
            if shared.value is not None:
                w, bias, temperature, shift = shared.value
                bucket, sentence, text, bounds, data = sentences(b.column("text"))
                z = np.bincount(sentence, w[bucket], minlength=len(text)) + bias
                p = noisy_or(z, text, b.num_rows)
                some = np.bincount(text, minlength=b.num_rows) > 0
                p = np.where(some, sigmoid((logit(p) + shift) / temperature), 0.0)
                begin = np.searchsorted(text, np.arange(b.num_rows))
                for k in np.flatnonzero(z >= logit(np.array(offends))):
                    i, j = bounds[k]
                    found[text[k]].append({"number": int(k - begin[text[k]]), "score": float(sigmoid(z[k])),
                                           "text": data[i:j].tobytes().decode("utf-8", "replace")})
            kind = pa.list_(pa.struct([("number", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array(found, kind)],
                                             names=["doc_id", "held_out", "score", "sentences"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, OUT)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, sentences`` for every row."""
    out = held_out(3, 1)
    model = fit(docs, labels, learn=~out)
    scored = score(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "sentences")
