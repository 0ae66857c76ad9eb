"""Second-order boosting against a plain version that grows one node at a time."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from stayrisk.operators import boost as bo


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=500), rng.exponential(size=500), rng.integers(0, 2, 500).astype(float), rng.normal(size=500)])
    x[rng.random(500) < 0.2, 1] = np.nan
    logit = 1.5 * x[:, 0] + np.where(np.isnan(x[:, 1]), 1.2, -x[:, 1]) + x[:, 2] * x[:, 3]
    y = (rng.random(500) < 1 / (1 + np.exp(-logit))).astype(float)
    w = np.where(y == 1, 1.3, 0.8)
    rows = [(s, float(a), float(b), i, [float(v) for v in r]) for s in (0, 1) for i, (a, b, r) in enumerate(zip(y, w, x)) if s == 0 or i % 3]
    return spark.createDataFrame(rows, "subset int, y double, w double, code long, x array<double>").repartition(5), x, y, w


def plain_fit(x, y, w, cuts, how):
    """Trees as nested dicts, one node after another, every cut by a loop."""
    base = math.log(np.average(y, weights=w) / (1 - np.average(y, weights=w)))
    score = lambda g, h: g * g / (h + how.l2)

    def candidates(rows, g, h, symmetric=False):
        for f in range(x.shape[1]):
            v = x[rows, f]
            for b, c in enumerate(cuts[f]):
                for side in (False, True):
                    left = np.where(np.isnan(v), side, v <= c)
                    gl, hl, gs, hs = g[rows][left].sum(), h[rows][left].sum(), g[rows].sum(), h[rows].sum()
                    if symmetric or min(hl, hs - hl) >= how.least_weight:
                        yield 0.5 * (score(gl, hl) + score(gs - gl, hs - hl) - score(gs, hs)), f, c, side

    def goes_left(rows, cut):
        v = x[rows, cut[1]]
        return np.where(np.isnan(v), cut[3], v <= cut[2])

    margin = np.full(len(x), base)
    for _ in range(how.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        leaves = [np.arange(len(x))]
        if how.growth == "leaf":
            done, depth = [], {0: 0}
            open_ = [(np.arange(len(x)), 0)]
            while len(open_) + len(done) < how.leaves:
                best = None
                for i, (rows, d) in enumerate(open_):
                    if d < how.depth and len(rows):
                        c = max(candidates(rows, g, h), key=lambda c: c[0], default=(0,))
                        if c[0] > 0 and (best is None or c[0] > best[1][0]):
                            best = (i, c)
                if best is None:
                    break
                rows, d = open_.pop(best[0])
                left = goes_left(rows, best[1])
                open_ += [(rows[left], d + 1), (rows[~left], d + 1)]
            leaves = [r for r, _ in open_] + done
        else:
            for _level in range(how.depth):
                if how.growth == "symmetric":
                    gains = {}
                    for rows in leaves:
                        for c in candidates(rows, g, h, True):
                            gains[c[1:]] = gains.get(c[1:], 0) + c[0]
                    f, gain = max(gains.items(), key=lambda k: k[1])
                    cuts_of = [(gain, *f)] * len(leaves) if gain > 0 else []
                else:
                    cuts_of = [max(candidates(rows, g, h), key=lambda c: c[0], default=(0,)) for rows in leaves]
                after = []
                for rows, c in zip(leaves, cuts_of or [(0,)] * len(leaves)):
                    if c[0] > 0:
                        left = goes_left(rows, c)
                        after += [rows[left], rows[~left]]
                    else:
                        after.append(rows)
                leaves = after
        for rows in leaves:
            if len(rows):
                margin[rows] -= how.step * g[rows].sum() / (h[rows].sum() + how.l2)
    return margin


GROWTHS = [bo.Growth("level", rounds=4, depth=3), bo.Growth("leaf", rounds=3, depth=5, leaves=6, least_weight=3.0),
           bo.Growth("symmetric", rounds=3, depth=3, l2=2.0)]


@pytest.fixture(scope="module")
def fitted(data):
    return bo.fit_many(data[0], [(s, how) for how in GROWTHS for s in (0, 1)], binary=[2])


def margins_of(spark, model, x):
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, x array<double>")
    d = d.select("i", array_to_vector("x").alias("features"))
    return np.array([r["m"] for r in d.select("i", bo.margins([model], F.col("features"))[0].alias("m")).orderBy("i").collect()])


@pytest.mark.parametrize("k", range(3))
def test_equals_the_plain_version(spark, data, fitted, k):
    _, x, y, w = data
    for s, rows in ((0, np.arange(500)), (1, np.arange(500)[np.arange(500) % 3 > 0])):
        model = fitted[2 * k + s]
        cuts = [np.array(c) for c in model.state()["cuts"]]
        want = plain_fit(x[rows], y[rows], w[rows], cuts, GROWTHS[k])
        assert np.abs(margins_of(spark, model, x[rows]) - want).max() < 1e-6


def test_tree_shapes(fitted):
    leaf, symmetric = fitted[2].trees(), fitted[4].trees()
    assert all(0 < (t.feature >= 0).sum() <= 5 for t in leaf)
    for t in symmetric:  # one cut a level
        for level in range(3):
            nodes = [i for i in range(1 << level, 2 << level) if t.feature[i] >= 0]
            assert len({(t.feature[i], t.bin[i], t.missing_left[i]) for i in nodes}) <= 1


def test_partitioning_does_not_matter(spark, data, monkeypatch):
    """Any number of partial histograms, added in a tree, gives the same model."""
    monkeypatch.setattr(bo, "FAN_IN", 2)
    how = replace(GROWTHS[0], rounds=2, row_share=0.7, feature_share=0.75)
    a = bo.fit_many(data[0].filter("subset = 0").coalesce(1), [(0, how)], [2])[0]
    b = bo.fit_many(data[0].filter("subset = 0").repartition(7), [(0, how)], [2])[0]
    assert a.state() == b.state()


def test_a_pass_is_one_scan_for_all_nodes_and_models(spark, data, monkeypatch):
    seen = []
    whole = bo.one_pass
    monkeypatch.setattr(bo, "one_pass", lambda m, jobs, *a: seen.append(len(jobs)) or whole(m, jobs, *a))
    bo.fit_many(data[0], [(0, bo.Growth("level", rounds=2, depth=3)), (1, bo.Growth("symmetric", rounds=2, depth=2))], [2])
    assert len(seen) == 6 and seen[:4] == [2] * 4


def test_one_class_constant_and_empty(spark):
    schema = "subset int, y double, w double, code long, x array<double>"
    one = spark.createDataFrame([(0, 1.0, 1.0, i, [1.0, float("nan")]) for i in range(20)], schema)
    m = bo.fit_many(one, [(0, GROWTHS[0]), (5, GROWTHS[0])])
    assert all(not (t.feature >= 0).any() for t in m[0].trees()) and m[1].trees() == []
    assert margins_of(spark, m[0], np.array([[1.0, np.nan], [7.0, 2.0]])).min() > 5
    assert bo.fit_many(one.limit(0), [(0, GROWTHS[0])])[0].trees() == []


def test_saved_model_scores_alike(spark, fitted, tmp_path):
    m = fitted[0].named("x", 0.6)
    m.save(str(tmp_path / "m"))
    again = bo.BoostedModel.load(str(tmp_path / "m"))
    d = spark.createDataFrame([([0.1, 0.2, 1.0, -1.0],), ([float("nan")] * 4,)], "x array<double>").select(array_to_vector("x").alias("features"))
    a, b = ([tuple(r) for r in t.transform(d).collect()] for t in (m, again))
    assert str(a) == str(b) and m.gain_shares(4).sum() == pytest.approx(1)
    r = m.transform(d).first()
    assert r["prob_x"][1] == pytest.approx(1 / (1 + math.exp(-r["raw_x"]))) and r["pred_x"] == float(r["prob_x"][1] >= 0.6)


def test_passes_read_blocks_and_bytes_shared_by_features(spark, data):
    """Spark hands blocks of rows to a pass, not rows; small features share a byte."""
    layout = bo.Layout([5, 66, 3, 66])
    cuts = {s: [np.array([-1.0, 0.0, 1.0]), np.linspace(0, 3, 64), np.array([0.5]), np.linspace(-2, 2, 64)] for s in (0, 1)}
    assert len(layout.groups) == 3
    blocks = bo.binned(data[0].coalesce(1), cuts, layout).collect()
    assert len(blocks) == 4 and sum(len(r["y"]) for r in blocks) == 8 * data[0].count()
    x = data[1]
    got = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(-1, 3) for r in blocks if r["subset"] == 0])
    ids = np.concatenate([np.frombuffer(r["code"], np.int64) for r in blocks if r["subset"] == 0])
    columns = bo.Columns(got, layout)
    for f in range(4):
        assert (columns[f] == bo.bins_of(x[ids, f], cuts[0][f])).all()


def test_histograms_of_shared_bytes_and_walks_by_column():
    rng = np.random.default_rng(3)
    sizes = [3, 3, 66, 5, 2]
    bins = np.array([rng.integers(0, s, 2000) for s in sizes], np.uint8)
    layout, w = bo.Layout(sizes), rng.integers(-9, 9, 2000)
    packed = layout.packed(bins)
    out = np.zeros((2, 1, sum(sizes)), np.int64)
    for byte, codes in enumerate(layout.codes):
        one = np.bincount(packed[:, byte], w, minlength=codes).astype(np.int64)
        layout.spread(byte, np.array([[one], [2 * one]]), out)
    for f, s in enumerate(sizes):
        want = np.bincount(bins[f], w, minlength=s)
        assert (out[0, 0, layout.first[f]:layout.first[f + 1]] == want).all() and (out[1, 0, layout.first[f]:layout.first[f + 1]] == 2 * want).all()
    t = bo.Tree(3)
    for node, (f, b, missing_left) in {1: (2, 30, False), 2: (0, 1, True), 3: (3, 2, False), 6: (2, 50, True)}.items():
        t.feature[node], t.bin[node], t.missing_left[node] = f, b, missing_left
    for levels in (1, 2, 3):
        at, ends = t.reach(bo.Columns(packed, layout), 2000, levels)
        for i in range(2000):
            node = 1
            for _ in range(levels):
                if t.feature[node] >= 0:
                    v = bins[t.feature[node], i]
                    node = 2 * node + (0 if (t.missing_left[node] if v == 0 else v <= t.bin[node]) else 1)
            assert ends[at[i]] == node


def test_one_hot_groups_share_a_code_and_bits_take_two():
    """A one-hot group takes a code per slot, not three per feature, and its
    histograms and bins are those of its features."""
    rng = np.random.default_rng(4)
    hot = rng.integers(0, 12, 3000)
    bins = np.array([*[1 + (hot == i) for i in range(12)], *rng.integers(1, 3, (8, 3000)), rng.integers(0, 60, 3000)], np.uint8)
    sizes = [3] * 20 + [60]
    layout, w = bo.Layout(sizes, range(20), [list(range(12))]), rng.integers(-9, 9, 3000)
    assert len(layout.groups) == 3 and len(bo.Layout(sizes).groups) == 5
    packed = layout.packed(bins)
    out = np.zeros((2, 1, sum(sizes)), np.int64)
    for byte, codes in enumerate(layout.codes):
        one = np.bincount(packed[:, byte], w, minlength=codes).astype(np.int64)
        layout.spread(byte, np.array([[one], [2 * one]]), out)
    columns = bo.Columns(packed, layout)
    for f, s in enumerate(sizes):
        assert (columns[f] == bins[f]).all()
        assert (out[0, 0, layout.first[f]:layout.first[f + 1]] == np.bincount(bins[f], w, minlength=s)).all()
    bins[1] = 2
    with pytest.raises(ValueError, match="one of a group"):
        layout.packed(bins)


def test_fits_do_not_depend_on_what_the_layout_is_told(spark):
    rng = np.random.default_rng(5)
    hot, v, y = rng.integers(0, 4, 600), rng.normal(size=600), rng.integers(0, 2, 600)
    rows = spark.createDataFrame([(0, float(y[i]), 1.0, i, [*[float(hot[i] == k) for k in range(4)], float(v[i])]) for i in range(600)],
                                 "subset int, y double, w double, code long, x array<double>")
    jobs = [(0, how) for how in GROWTHS]
    plain, told = bo.fit_many(rows, jobs, range(4)), bo.fit_many(rows, jobs, range(4), exclusive=[list(range(4))])
    assert [m.state() for m in plain] == [m.state() for m in told]


@pytest.mark.parametrize("shared", [True, False])
def test_walks_with_and_without_one_cut_a_level(shared):
    """Both ways of walking a tree end where a row by row walk does, also where
    branches end early."""
    rng = np.random.default_rng(6)
    bins = rng.integers(0, 9, (5, 500)).astype(np.uint8)
    for depth in (1, 4, 9):
        t = bo.Tree(depth)
        cuts = [(rng.integers(0, 5), rng.integers(1, 8), bool(rng.integers(0, 2))) for _ in range(1 << depth)]
        for node in range(1, 1 << depth):
            if (node == 1 or t.feature[node // 2] >= 0) and rng.random() < 0.9:
                t.feature[node], t.bin[node], t.missing_left[node] = cuts[node.bit_length()] if shared else cuts[node]
        assert (t._cut_of_each_level(depth) is not None) == (shared or depth == 1)
        at, ends = t.reach(list(bins), 500, depth)
        for i in range(500):
            node = 1
            while t.feature[node] >= 0:
                b = bins[t.feature[node], i]
                node = 2 * node + (0 if (t.missing_left[node] if b == 0 else b <= t.bin[node]) else 1)
            assert ends[at[i]] == node


def test_finished_trees_travel_as_one_array_a_field():
    import pickle
    job = bo._Job(0, bo.Growth(rounds=99, depth=6))
    for k in range(60):
        t = bo.Tree(6)
        t.feature[1], t.value[:] = k, k
        job.trees.append(t)
    job.begin()
    sent = pickle.dumps(job)
    again = pickle.loads(sent)
    assert sent.count(b"ndarray") + sent.count(b"_reconstruct") <= 4 and len(again.trees) == 60
    assert all((getattr(a, f) == getattr(b, f)).all() for a, b in zip(job.trees, again.trees) for f in bo.Tree.FIELDS)


def test_rows_are_read_twice_before_the_passes(spark, data, monkeypatch):
    """One aggregate gives cuts and sums, one scan the blocks, with the same result
    as when the length of the rows is looked up first."""
    rows, seen = data[0], []
    looked = bo.ready(rows, written=True)
    kind, collect = type(rows), type(rows).collect
    monkeypatch.setattr(kind, "collect", lambda df: seen.append(df) or collect(df))
    monkeypatch.setattr(kind, "first", lambda df: pytest.fail("the rows are read once more"))
    known = bo.ready(rows, written=True, slots=4)
    assert len(seen) == 1
    assert (known.stats, known.slots) == (looked.stats, looked.slots) and known.layout.groups == looked.layout.groups
    assert all(np.array_equal(a, b) for s in (0, 1) for a, b in zip(known.cuts[s], looked.cuts[s]))
    assert known.stats[1]["n"] == rows.filter("subset = 1").count() and known.stats[0]["top"] == 1.3


def test_a_task_takes_a_trees_cuts_once_for_all_chunks(data, monkeypatch):
    """A walk costs no tree search per chunk of rows, and chunks add up."""
    import pyarrow as pa
    import pyspark
    rng = np.random.default_rng(7)
    layout, n = bo.Layout([9] * 4), 256
    bins = rng.integers(0, 9, (4, 3 * n)).astype(np.uint8)
    y, w, code = rng.integers(0, 2, 3 * n).astype(float), np.ones(3 * n), np.arange(3 * n)
    part = lambda v, k: v[k * n:(k + 1) * n].tobytes()
    batches = [pa.RecordBatch.from_pydict({"subset": pa.array([0], pa.int32()), "y": [part(y, k)], "w": [part(w, k)], "code": [part(code, k)],
                                           "bins": [part(layout.packed(bins), k)]}) for k in range(3)]
    job = bo._Job(0, bo.Growth(depth=2), scale=1024.0)
    for f in (0, 1):
        t = bo.Tree(2)
        t.feature[1:4], t.bin[1:4], t.value[:] = [f, 2, 3], [3, 4, 5], rng.normal(size=8)
        job.trees.append(t)
    job.begin()
    task = type("Task", (), {"partitionId": lambda self: 0})
    monkeypatch.setattr(pyspark, "TaskContext", type("Context", (), {"get": staticmethod(task)}))
    searched, search = [], bo.Tree._cut_of_each_level
    monkeypatch.setattr(bo.Tree, "_cut_of_each_level", lambda t, levels: searched.append(t) or search(t, levels))
    got = next(bo._histograms([job], layout)(batches))
    assert len(searched) == 3  # two finished trees and the open one
    margins = bo.margin(0.0, [bo.Walk(t, 2) for t in job.trees], bo.Bins(bins), 3 * n)
    p = 1 / (1 + np.exp(-margins))
    want = np.bincount(bins[0], np.rint((p - y) * 1024), minlength=9)
    assert (np.frombuffer(got.column("sums")[0].as_py(), np.int64).reshape(2, 1, 36)[0, 0, :9] == want).all()


def test_subsets_fitted_beside_each_other_and_alone(spark, data):
    """Groups of subsets have passes of their own; trees are the same."""
    rows = data[0]
    ready = bo.ready(rows, written=True, slots=4)
    jobs = [(s, bo.Growth(how.growth, 2, how.depth, how.leaves)) for how in GROWTHS for s in (0, 1)]
    made = bo._groups([bo._Job(*j) for j in jobs], ready.stats, 500)
    assert len(bo._groups([bo._Job(*j) for j in jobs], ready.stats)) == 1
    assert sorted({j.subset for j in g} == {s} for s, g in zip((0, 1), sorted(made, key=lambda g: g[0].subset))) == [True, True]
    both = bo.fit_ready(ready, jobs, 500)
    assert [m.state() for m in both] == [m.state() for m in bo.fit_ready(ready, jobs)]
    for s in (0, 1):
        alone = bo.fit_ready(ready, [j for j in jobs if j[0] == s])
        assert [m.state() for m in alone] == [m.state() for m, j in zip(both, jobs) if j[0] == s]


def test_carried_margins_and_counting_one_child_leave_the_trees_as_they_are(spark, data, monkeypatch):
    """On large tables a pass walks only trees since the margins were last written, and
    counts the rows of the lighter child; models are equal, and what was written is gone."""
    import os
    from stayrisk.operators import learn
    ready = bo.ready(data[0], written=True, slots=4)
    models = [(s, replace(how, rounds=7, depth=3, row_share=share)) for how in GROWTHS for s, share in ((0, 1.0), (1, 0.7))]
    monkeypatch.setattr(bo, "CARRIED", 2)
    monkeypatch.setattr(bo, "_carry_pays", lambda jobs: sum(len(j.walked()) for j in jobs) >= 2 * len(jobs))
    walked, counted, written, write, one_pass = [], [], [], learn.write_table, bo.one_pass
    monkeypatch.setattr(learn, "write_table", lambda df, kind: written.append((kind, write(df, kind))) or written[-1][1])

    def seen(matrix, jobs, *rest):
        walked.append(max(len(j.walked()) for j in jobs))
        counted.extend((len(j.to_count()), len(j.open)) for j in jobs if j.level)
        return one_pass(matrix, jobs, *rest)

    monkeypatch.setattr(bo, "one_pass", seen)
    plain = [m.state() for m in bo.fit_ready(ready, models)]
    assert max(walked) == 6 and all(a == b for a, b in counted) and not written
    walked.clear(), counted.clear()
    assert [m.state() for m in bo.fit_ready(ready, models, 500)] == plain
    assert max(walked) <= 4 and all(a <= b for a, b in counted) and any(2 * a == b for a, b in counted)
    assert len(written) >= 4 and not any(os.path.exists(path) for _, path in written)


def test_best_cut_of_all_features_at_once():
    """Equal to a search of one feature after another, bins 0 on either side."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    sizes, n = np.array([6, 3, 2, 9]), 3
    whole = rng.integers(-50, 50, (2, n, 400)), rng.integers(1, 60, (n, 400))
    for growth in ("level", "symmetric"):
        job = bo._Job(0, bo.Growth(growth, depth=4, least_weight=5.0))
        job.begin()
        job.open, job.level = np.array([4, 5, 7]), 2
        sums = np.zeros((2, n, 20), np.int64)
        for f, (a, s) in enumerate(zip(np.concatenate([[0], np.cumsum(sizes)]), sizes)):
            bins = rng.integers(0, s, 400)
            for i in range(n):
                sums[0, i, a:a + s] = np.bincount(bins, whole[0][0, i], minlength=s)
                sums[1, i, a:a + s] = np.bincount(bins, whole[1][i], minlength=s)
        t = pa.table({"job": pa.array([0], pa.int32()), "block": pa.array([0], pa.int32()), "part": [0], "sums": [sums.tobytes()]})
        got = bo._cuts_of([job], sizes)(t).to_pylist()
        best = [(-math.inf,)] * n
        for f, (a, s) in enumerate(zip(np.concatenate([[0], np.cumsum(sizes)]), sizes)):
            for side in (False, True):
                for b in range(1, s - 1):
                    left = sums[:, :, a + 1:a + b + 1].sum(axis=2) + (sums[:, :, a] if side else 0)
                    total = sums[:, :, a:a + s].sum(axis=2)
                    gain = bo.gains(left[0], left[1], total[0], total[1], 1.0)
                    if growth == "symmetric":
                        gain = np.full(n, gain.sum())
                    else:
                        gain = np.where(np.minimum(left[1], total[1] - left[1]) < 5.0, -math.inf, gain)
                    best = [(gain[i], f, b, side, left[0][i], left[1][i]) if gain[i] > best[i][0] + 1e-9 else best[i] for i in range(n)]
        for r, node, want in zip(got, (4, 5, 7), best):
            assert r["node"] == node and (r["feature"], r["bin"], r["missing_left"], r["left_g"], r["left_h"]) == want[1:]
            assert abs(r["gain"] - want[0]) < 1e-9
