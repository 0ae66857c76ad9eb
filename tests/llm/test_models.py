"""Language id, quality and toxicity: held-out accuracy and defined edge cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayrisk.llm import langid, quality_model, toxicity


@pytest.fixture(scope="module")
def bigger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_language_held_out(bigger):
    docs, _ = bigger
    r = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    h = r[r.held_out]
    assert len(h) > 200 and (h.lang == h.lang_pred).mean() > 0.98 and r.score.between(0, 1).all()
    assert (r.held_out == r.doc_id.map(lambda i: __import__("zlib").crc32(str(i).encode()) % 4 == 2)).all()


def test_language_edges(spark, edge_docs, no_docs):
    r = {x["doc_id"]: x for x in langid.identify(edge_docs).collect()}
    assert len(r) == edge_docs.select("doc_id").distinct().count()
    for i in (1, 2, 3):
        assert r[i]["lang_pred"] == "und" and r[i]["score"] == 0.0
    assert r[11]["lang_pred"] in ("en", "fr", "de") and not r[None]["held_out"]
    assert langid.identify(no_docs).count() == 0
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {x["lang_pred"] for x in langid.identify(unlabelled).collect()} == {"und"}


def test_quality_held_out(bigger):
    docs, labels = bigger
    r = quality_model.classify(docs, labels).join(labels, "doc_id").toPandas()
    h = r[r.held_out]
    assert auc(h.score.to_numpy(), h.quality.to_numpy()) > 0.85
    assert (r.predicted == (r.score >= 0.3)).all()


def test_toxicity_held_out_and_sentences(spark):
    """Bags with one offending sentence: flagged, and the sentence is found."""
    rng = np.random.default_rng(2)
    words = ["sol", "mar", "tel", "ruk", "pan", "vid", "lom", "fes"]
    say = lambda n: " ".join(rng.choice(words, n)) + "."
    rows, marks = [], []
    for i in range(600):
        s = [say(rng.integers(3, 9)) for _ in range(rng.integers(2, 12))]
        bad = i % 4 == 0
        if bad:
            s.insert(int(rng.integers(0, len(s))), f"You {rng.choice(['grumble', 'snarly'])} {rng.choice(words)}.")
        rows.append((i, " ".join(s)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    r = toxicity.classify(docs, labels).join(labels, "doc_id").toPandas()
    h = r[r.held_out]
    assert (h.predicted == h.toxic).mean() > 0.98
    found = r[(r.toxic == 1) & (r.predicted == 1)]
    assert all(any("you" in s["text"] for s in x) for x in found.sentences)


def test_model_edges(spark, edge_docs, no_docs):
    marks = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (100, 1, 0), (101, 0, 1), (None, 1, 1), (8, None, None), (7777, 1, 0)],
                                  "doc_id long, quality int, toxic int")
    for op, empty in ((quality_model, 0.5), (toxicity, 0.0)):
        r = op.classify(edge_docs, marks).collect()
        assert len(r) == edge_docs.count() and all(0 <= x["score"] <= 1 for x in r)
        none = op.classify(edge_docs, marks.limit(0)).collect()
        assert {x["score"] for x in none} == {empty}
        assert op.classify(no_docs, marks).count() == 0
    assert {x["score"] for x in toxicity.classify(edge_docs, marks).filter("doc_id in (1, 2, 3)").collect()} == {0.0}


def test_noisy_or_and_contexts_match_plain_loops():
    z, text = np.array([-1.0, 0.5, 2.0]), np.array([0, 0, 2])
    p = 1 / (1 + np.exp(-z))
    assert toxicity.noisy_or(z, text, 3) == pytest.approx([1 - (1 - p[0]) * (1 - p[1]), 0, p[2]])
    bucket, words = quality_model.buckets(pa.array(["ab cd!! ef", None, "gh ab"]))
    table = np.zeros(quality_model.BUCKETS * quality_model.DIMS, np.int64)
    quality_model.add_contexts(table, bucket, words.text_of())
    plus, minus = quality_model.index_vectors()
    want = np.zeros((quality_model.BUCKETS, quality_model.DIMS), np.int64)
    owner = words.text_of()
    for i in range(len(bucket)):
        for j in range(len(bucket)):
            if i != j and abs(i - j) <= quality_model.REACH and owner[i] == owner[j]:
                want[bucket[i], plus[bucket[j]]] += 1
                want[bucket[i], minus[bucket[j]]] -= 1
    assert (table.reshape(want.shape) == want).all()


def test_sample_goes_by_row(spark):
    """Rows of one id or without id are sampled like any others; equal rows come
    once with their number as weight; labels need not be listed."""
    from pyspark.sql import functions as F

    from stayrisk.llm.common import bounded_sample
    n = 20_000
    d = spark.range(2 * n).select(
        F.when(F.col("id") < n, 7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") < n, "en").otherwise("fr").alias("lang"))
    d = d.union(spark.range(5000).select(F.lit(3).cast("long"), F.lit("same"), F.lit("de"))).union(spark.range(3).select("id", F.lit("x"), F.lit(None)))
    got = bounded_sample(d, "lang", 600).repartition(3)
    r = {x["lang"]: (x["n"], x["w"]) for x in got.groupBy("lang").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert set(r) == {"en", "fr", "de"} and r["de"] == (1, 5000.0)
    for lang in ("en", "fr"):
        assert abs(r[lang][0] - 600) <= 60 and abs(r[lang][1] - n) <= 0.1 * n
    assert sorted(map(str, got.collect())) == sorted(map(str, bounded_sample(d.repartition(7), "lang", 600).collect()))
    model = langid.fit(d)
    assert model[0] == ["de", "en", "fr"]


def test_language_features_and_one_ftrl_step_match_plain_loops():
    """Document frequencies by loop, and FTRL-proximal by its formulas."""
    import math

    texts = ["Abc ab.", "été à Paris", "12 34", ""]
    feats, has = langid.features(pa.array(texts))
    (counts,) = langid._document_frequencies(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    df = dict(zip(counts.column("f").to_pylist(), counts.column("df").to_pylist()))
    assert df.pop(-1) == 4
    assert df == {c: sum(c in set(f.tolist()) for f in feats) for c in {int(x) for f in feats for x in f}}
    assert list(has) == [True, True, False, False]
    ex = [(np.array([3, 5]), np.array([0.6, 0.8]), 0), (np.array([5, 9]), np.array([1.0, 0.5]), 1), (np.array([3]), np.array([1.0]), 1)]
    got = langid.fit_ftrl(ex, 2, epochs=2)
    z, n = {}, {}

    def weight(f, k):
        v = z.get((f, k), 0.0)
        l1, l2 = langid.L1 * 0.01, langid.L2 * 0.01
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((langid.BETA + math.sqrt(n.get((f, k), 0.0))) / langid.ALPHA + l2)

    rng = np.random.default_rng(3)
    for _ in range(2):
        for i in rng.permutation(3):
            fs, xs, y = ex[i]
            w = {(f, k): weight(f, k) for f in fs.tolist() for k in (0, 1)}
            s = [sum(x * w[f, k] for f, x in zip(fs.tolist(), xs)) for k in (0, 1)]
            p = [math.exp(v - max(s)) for v in s]
            for f, x in zip(fs.tolist(), xs):
                for k in (0, 1):
                    g = x * (p[k] / sum(p) - (k == y))
                    was = n.get((f, k), 0.0)
                    z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / langid.ALPHA * w[f, k]
                    n[f, k] = was + g * g
    for f in (3, 5, 9):
        for k in (0, 1):
            assert got[f, k] == pytest.approx(weight(f, k), abs=1e-12)
    assert np.count_nonzero(got) <= 6


def test_network_gradient_and_fit(monkeypatch):
    """Back-propagation against differences of the loss; the fit separates what
    one hidden layer can, in the same number of steps at any size."""
    rng = np.random.default_rng(9)
    x, y, w = rng.normal(size=(7, 3)), np.array([0, 1, 1, 0, 1, 0, 0.0]), rng.random(7) + 0.1
    p = [rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]

    def loss(q):
        z = np.tanh(x @ q[0] + q[1]) @ q[2] + q[3]
        return (w * (np.logaddexp(0, z) - y * z)).sum() + 0.5e-4 * ((q[0] ** 2).sum() + (q[2] ** 2).sum())

    for i, g in enumerate(quality_model.gradient(p, x, y, w)):
        for at in np.ndindex(p[i].shape):
            ends = []
            for d in (1e-6, -1e-6):
                q = [a.copy() for a in p]
                q[i][at] += d
                ends.append(loss(q))
            assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)
    calls = []
    whole = quality_model.gradient
    monkeypatch.setattr(quality_model, "gradient", lambda *a: calls.append(1) or whole(*a))
    for n in (60, 700):
        x = rng.normal(size=(n, 2))
        y = (x[:, 0] * x[:, 1] > 0).astype(float)
        z = quality_model.forward(quality_model.fit_network(x, y, np.ones(n)), x)
        assert ((z > 0) == (y > 0)).mean() > 0.95
    assert len(calls) == 2 * quality_model.STEPS


def test_noisy_or_gradient():
    """Derivatives of the document loss against differences, by feature and bias."""
    rng = np.random.default_rng(4)
    text = np.array([0, 0, 1, 2, 2, 2])  # document of each sentence; document 3 has none
    sentence = np.array([0, 0, 1, 2, 2, 3, 4, 5, 5])
    bucket = rng.integers(0, 6, len(sentence))
    y = np.array([1.0, 0.0, 1.0, 0.0])
    w, b = rng.normal(size=6), -0.7

    def loss(w, b):
        total = 0.0
        for d in range(4):
            clean = 1.0
            for s in np.flatnonzero(text == d):
                clean *= 1 - 1 / (1 + np.exp(-(w[bucket[sentence == s]].sum() + b)))
            total -= np.log(1 - clean) if y[d] else np.log(clean)
        return total / 4

    g, gb = toxicity.bag_gradient(w, b, bucket, sentence, text, y)
    for k in range(6):
        e = np.eye(6)[k] * 1e-6
        assert g[k] == pytest.approx((loss(w + e, b) - loss(w - e, b)) / 2e-6, abs=1e-6)
    assert gb == pytest.approx((loss(w, b + 1e-6) - loss(w, b - 1e-6)) / 2e-6, abs=1e-6)
