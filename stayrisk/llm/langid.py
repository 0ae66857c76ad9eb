"""Operator 2: language of a text by sparse multinomial logistic regression on
TF-IDF character n-grams.

Letters are lower-cased, everything else is a space; 1- to 3-grams hash into
``FEATURES`` columns.  Document frequencies come from every training row.  The
model is fitted on a bounded, repeatable sample (``PER_LANG`` rows per language,
each whole and as one short piece, so short texts are known too) with
follow-the-regularised-leader and elastic-net penalties; a tenth of the sample
is kept back to calibrate the temperature of the softmax.

Cases: a null text or one without a letter is ``und`` with score 0; rows with a
null language are not learned from; without any training row every answer is
``und``; null and repeated ids are fine (a null id is not held out); an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, chunks, held_out, mix64

FEATURES = 1 << 15
GRAMS = (1, 2, 3)
PER_LANG = 600
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.5, 1.0
_BITS = FEATURES.bit_length() - 1


def features(col: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashed n-grams of each text, whether it has a letter)."""
    col = pc.utf8_lower(pc.fill_null(col, ""))
    texts = col.to_pylist()
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = np.zeros(0x110000, bool)
    used = np.flatnonzero(np.bincount(code, minlength=1))
    letter[[c for c in used.tolist() if chr(c).isalpha()]] = True
    is_letter = letter[code]
    any_letter = np.concatenate([[0], np.cumsum(is_letter)])
    has = any_letter[first[1:]] > any_letter[first[:-1]]
    code = np.where(is_letter, code, 32).astype(np.uint64)
    per_gram = []
    for n in GRAMS:
        size = max(0, len(code) - n + 1)
        h = np.full(size, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + code[j:j + size]
        per_gram.append((mix64(h) >> np.uint64(64 - _BITS)).astype(np.int32))
    return [np.concatenate([g[a:max(a, b - n + 1)] for n, g in zip(GRAMS, per_gram)])
            for a, b in zip(first[:-1], first[1:])], has


def _document_frequencies(batches):
    df, rows = np.zeros(FEATURES, np.int64), 0
    for b in chunks(batches):
        for f in features(b.column("text"))[0]:
            df += np.bincount(f, minlength=FEATURES) > 0
            rows += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], rows), pa.int64())], names=["f", "df"])


def _examples(batches):
    """Sparse term counts of each sampled text, whole and as one short piece."""
    for b in chunks(batches):
        texts = pc.fill_null(b.column("text"), "").to_pylist()
        at = pc.fill_null(b.column("at"), 0).to_pylist()
        pieces = [t[(s := a % max(1, len(t))):s + 20 + a % 181] for t, a in zip(texts, at)]
        for part in (b.column("text"), pa.array(pieces, pa.string())):
            feats, has = features(part)
            rows = [np.unique(f, return_counts=True) if ok else (np.zeros(0, np.int32), np.zeros(0, np.int64)) for f, ok in zip(feats, has)]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), b.column("fold"), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))], names=["lang", "fold", "f", "n"])


def _weigh(f: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n) * idf[f]
    return x / max(np.sqrt(x @ x), 1e-12)


def fit_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """Weights (features x classes) by FTRL-proximal over (columns, values,
    class) examples; the L1 part keeps them sparse."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def weights(at):
        return np.where(np.abs(z[at]) <= L1 * 0.01, 0.0, -(z[at] - np.sign(z[at]) * L1 * 0.01) / ((BETA + np.sqrt(n[at])) / ALPHA + L2 * 0.01))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            f, x, y = examples[k]
            w = weights(f)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - s * w
            n[f] += g * g
    return weights(slice(None))


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(train: DataFrame, per_lang: int = PER_LANG) -> tuple:
    """(languages, weights, idf, temperature) from ``doc_id, text, lang``."""
    train = train.filter(F.col("lang").isNotNull())
    df = {r["f"]: r["df"] for r in train.select("text").mapInArrow(_document_frequencies, "f int, df long")
          .groupBy("f").agg(F.sum("df").alias("df")).collect()}
    rows = df.pop(-1, 0)
    counts = np.zeros(FEATURES)
    counts[list(df)] = list(df.values())
    idf = np.log((1 + rows) / (1 + counts)) + 1
    sample = bounded_sample(train.select("doc_id", "text", "lang"), "lang", per_lang).select(
        "text", "lang", F.pmod(F.xxhash64(F.lit(23), "doc_id", "text"), F.lit(10)).cast("int").alias("fold"),
        F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 30)).alias("at"))
    got = sample.mapInArrow(_examples, "lang string, fold int, f array<int>, n array<float>").toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    learn, check = [], []
    for lang, k, f, n in zip(*(got.column(c).to_pylist() for c in ("lang", "fold", "f", "n"))):
        if f:
            f = np.array(f, np.int64)
            (check if k == 0 else learn).append((f, _weigh(f, np.array(n), idf), langs.index(lang)))
    learn.sort(key=lambda e: (e[2], len(e[0]), e[0][0], float(e[1][0])))
    weights = fit_ftrl(learn or check, len(langs)) if langs else np.zeros((FEATURES, 0))
    grid = np.exp(np.linspace(np.log(0.02), np.log(4.0), 60))
    temperature = 1.0
    if check:
        v = np.stack([x @ weights[f] for f, x, _ in check])
        y = np.array([e[2] for e in check])
        loss = [-np.log(np.maximum(_softmax(v / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return langs, weights.astype(np.float32), idf.astype(np.float32), temperature


def predict(docs: DataFrame, model: tuple) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        langs, weights, idf, temperature = shared.value
        for b in chunks(batches):
            feats, has = features(b.column("text"))
            names, scores = [], []
            for f, ok in zip(feats, has):
                if not ok or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                x = np.log1p(np.bincount(f, minlength=FEATURES).astype(np.float32)) * idf
                p = _softmax((x @ weights).astype(np.float64) / max(float(np.sqrt(x @ x)), 1e-12) / temperature)
                names.append(langs[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*rest, "lang_pred", "score"])

    kinds = ", ".join(f"`{n}` {k}" for n, k in docs.select(*rest).dtypes)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows of ``docs`` that are not held out and predict them all:
    ``doc_id, held_out, lang_pred, score``."""
    out = held_out(4, 2)
    model = fit(docs.filter(~out))
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model)
