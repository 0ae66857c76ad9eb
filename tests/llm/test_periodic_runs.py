"""Runs against a search of every period, the query against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stayrisk.llm import periodic_runs as pr


def plain_runs(w):
    """Every (start, length, period), by trying all periods."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if n >= max(6, 4 * q) and not any(all(w[s + x] == w[s + x + d] for x in range(n - d)) for d in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(texts):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    found = pr.find_runs(np.array([x for t in texts for x in t], np.int64), first)
    return [[(s - a, n, q) for s, n, q in found.tolist() if a <= s < z] for a, z in zip(first, first[1:])]


def noisy(rnd):
    """Words of a small alphabet with repeated stretches, some with an error."""
    w = []
    for _ in range(rnd.randint(0, 6)):
        part = [rnd.randint(0, rnd.choice([1, 2, 5, 50])) for _ in range(rnd.randint(1, 40))]
        w += part[:rnd.randint(1, len(part))] if rnd.random() < 0.4 else (part * 9)[:rnd.randint(1, 9 * len(part))]
        if w and rnd.random() < 0.3:
            w[rnd.randrange(len(w))] = 99
    return w


@pytest.mark.parametrize("seed", range(60))
def test_all_runs_of_random_texts(seed):
    rnd = random.Random(seed)
    texts = [noisy(rnd) for _ in range(rnd.randint(0, 5))]
    assert runs_of(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4))
def test_all_runs_of_small_alphabets(texts):
    assert runs_of(texts) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("q", range(1, 40))
def test_every_period_at_the_least_length_and_any_start(q):
    """Exactly max(6, 4q) words between others, wherever the blocks lie."""
    n = max(6, 4 * q)
    for before in range(0, 2 * q + 3):
        w = [1000 + i for i in range(before)] + [i % q for i in range(n)] + [-1, -2, -3]
        assert runs_of([w]) == [[(before, n, q)]]
        assert runs_of([w[:before + n - 1]]) == [[]]


def test_runs_do_not_cross_texts():
    assert runs_of([[1] * 5, [1] * 5, [], [1] * 6]) == [[], [], [], [(0, 6, 1)]]


def test_a_million_equal_words_and_a_long_period():
    (runs,) = runs_of([[7] * 1_000_000])
    assert runs == [(0, 1_000_000, 1)]
    (runs,) = runs_of([list(range(20_000)) * 5])
    assert runs == [(0, 100_000, 20_000)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60, unique=True), st.data())
def test_wavelet_tree(values, data):
    t = pr.WaveletTree(np.array(values))
    lo = data.draw(st.integers(0, len(values)))
    hi = data.draw(st.integers(lo, len(values)))
    x = data.draw(st.integers(0, 2 * 10**6))
    want = min((v for v in values[lo:hi] if v >= x), default=-1)
    assert t.successor(np.array([lo]), np.array([hi]), np.array([x])).tolist() == [want]


def plain_row(doc_id, text):
    o = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, w = len(o), list(o)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            w[i] = o[a + (i - a) % p]
    runs = plain_runs(w) if n < 4000 else None
    if runs is None:
        return None
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_matches_plain_python(spark, docs, edge_docs):
    for d in (docs, edge_docs):
        got = [tuple(r[c] for c in COLUMNS) for r in pr.periodic_runs(d, plant=True, full=False).collect()]
        want = [plain_row(r["doc_id"], r["text"]) for r in d.collect()]
        long = {r["doc_id"] for r in d.collect()} - {w[0] for w in want if w}
        want = [w for w in want if w]
        assert sorted(map(str, (g for g in got if g[0] not in long))) == sorted(map(str, want))
        assert len(got) == d.count() and len(want) > len(got) * 0.9


def test_full_output_and_empty(spark, no_docs):
    r = pr.periodic_runs(spark.createDataFrame([(1, "x " + "la di " * 5 + "end")], "doc_id long, text string")).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 10, 2)] and r["collapsed"] == "x la di end" and r["n_words"] == 12
    assert pr.periodic_runs(no_docs).count() == 0
