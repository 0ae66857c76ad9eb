"""Token histogram and LM scores against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stayrisk.llm import lm_score, token_counts


def test_histogram_answers_every_limit(spark, docs):
    encode = token_counts.encoder(token_counts.read_vocabulary(token_counts.VOCABULARY)).encode_ordinary
    n = sorted(len(encode(r["text"] or "")) for r in docs.collect())
    table = token_counts.suffix_table(token_counts.length_histogram(docs)).cache()
    for r in table.collect():
        limit = r["n_tokens"]
        assert r["n_docs"] == n.count(limit) and r["docs_longer"] == sum(x > limit for x in n)
        assert r["tokens_longer"] == sum(x for x in n if x > limit) and r["truncated_total"] == sum(min(x, limit) for x in n)
        assert (r["total_docs"], r["total_tokens"]) == (len(n), sum(n))
        assert r["share_at_most"] == pytest.approx(sum(x <= limit for x in n) / len(n))
    limits = [0, 1, n[0], n[7] + 1, 333, n[-1], n[-1] + 50]
    assert token_counts.truncated_totals(table, limits) == [(k, sum(min(x, k) for x in n)) for k in limits]
    shares = [0.01, 0.25, 0.5, 0.9, 1.0]
    assert token_counts.quantiles(table, shares) == [(q, n[max(0, math.ceil(q * len(n)) - 1)]) for q in shares]


def test_histogram_edges(spark, edge_docs, no_docs):
    t = token_counts.suffix_table(token_counts.length_histogram(edge_docs))
    assert t.agg({"n_docs": "sum"}).first()[0] == edge_docs.count() and t.filter("n_tokens = 0").first()["n_docs"] == 2
    empty = token_counts.suffix_table(token_counts.length_histogram(no_docs))
    assert empty.count() == 0 and token_counts.truncated_totals(empty, [9]) == [(9, 0)] and token_counts.quantiles(empty, [0.5]) == [(0.5, None)]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def base_scores(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((-1 if i is None else i, held(i), len(ws), sum(c[w] > 0 for w in ws), n,
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words)


@pytest.mark.parametrize("common", [1 << 19, 64])
def test_base_scores(spark, docs, edge_docs, common, monkeypatch):
    fit = lm_score.fit
    monkeypatch.setattr(lm_score, "fit", lambda d: fit(d, common))
    for d in (docs, edge_docs):
        got = lm_score.score(d).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                       round(r["base_score"], 6)) for r in got) == base_scores([(r["doc_id"], r["text"]) for r in d.collect()])


def test_empty_and_untrained(spark, no_docs):
    assert lm_score.score(no_docs).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_score.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert r["base_score"] == 0.0 and r["train_tokens"] == 0 and r["score"] == pytest.approx(3 * 8 * math.log10(0.5))


class PlainTree:
    """Context-tree weighting of one decision node, by recursion over contexts."""

    def __init__(self, events):  # (context nearest first, bit)
        self.events = events

    def counts(self, c):
        bits = [b for ctx, b in self.events if ctx[:len(c)] == c]
        return len(bits) - sum(bits), sum(bits)

    def kt(self, c):
        a, b = self.counts(c)
        return math.exp(math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1)) / math.pi if a + b else 1.0

    def weighted(self, c):
        own = self.kt(c)
        if len(c) == lm_score.DEPTH:
            return own
        below = math.prod(self.weighted((*c, x)) for x in {ctx[len(c)] for ctx, _ in self.events if ctx[:len(c)] == c})
        return 0.5 * own + 0.5 * below

    def one(self, ctx, c=()):
        a, b = self.counts(c)
        estimate = (b + .5) / (a + b + 1)
        deeper = (*c, ctx[len(c)]) if len(c) < lm_score.DEPTH else None
        if deeper is None or sum(self.counts(deeper)) == 0:
            return estimate
        w = 0.5 * self.kt(c) / self.weighted(c)
        return w * estimate + (1 - w) * self.one(ctx, deeper)


def test_context_tree_matches_recursion(spark):
    train, tests = ["abab cab", "abba", "", "béa"], ["abc", "zab", "", "bab cab"]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:4]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    d = spark.createDataFrame(list(zip(ids + held, train + tests)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(d).collect()}
    events = defaultdict(list)

    def steps(text):
        data = text.encode() + bytes([lm_score.END])
        for i, x in enumerate(data):
            ctx = tuple(data[i - k] if i >= k else lm_score.END for k in range(1, lm_score.DEPTH + 1))
            for b in range(8):
                yield (b, x >> (8 - b)), ctx, (x >> (7 - b)) & 1

    for t in train:
        for node, ctx, bit in steps(t):
            events[node].append((ctx, bit))
    for i, t in zip(held, tests):
        want = 0.0
        for node, ctx, bit in steps(t):
            p = PlainTree(events[node]).one(ctx) if events[node] else 0.5
            want += math.log10(p if bit else 1 - p)
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_a_context_sums_to_one():
    rng = np.random.default_rng(0)
    key, n = np.unique(rng.integers(97, 101, 4000).astype(np.int64) | (rng.integers(97, 101, 4000).astype(np.int64) << 8), return_counts=True)
    root = np.unique(key & 255), np.bincount(key & 255, n)[np.unique(key & 255)].astype(np.int64)
    tree = lm_score.context_tree([root, (key, n)])
    every = np.arange(256, dtype=np.int64) | (98 << 8)
    assert (10 ** lm_score.log_probability(every, tree)).sum() == pytest.approx(1.0, abs=1e-5)


def test_every_cell_counts_at_any_size(spark, tmp_path):
    """A corpus of more than 786,432 cells loses none: its scores are those of
    the whole tree in one array.  Texts come eight times, so that the deepest
    contexts tell what follows."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 117, 2000))) for _ in range(200)]
    spark.createDataFrame(list(enumerate(texts * 8)), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/d")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(spark.read.parquet(f"{tmp_path}/d")).collect()}
    each = [lm_score.cells(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
    cell = np.concatenate([c for i, c in enumerate(each * 8) if zlib.crc32(str(i).encode()) % 7 != 2])
    levels = [np.unique(cell & lm_score.mask(d), return_counts=True) for d in range(lm_score.DEPTH + 1)]
    assert sum(len(k) for k, _ in levels[1:]) > 3 << 18
    tree = lm_score.context_tree(levels)
    for i, c in enumerate(each):
        assert got[i] == pytest.approx(lm_score.log_probability(c, tree).sum(), abs=1e-6 * len(c))


@pytest.mark.parametrize("blank", [" ", "\n", "　", "  ", "\t \n"])
@pytest.mark.parametrize("n", [token_counts.LONG_RUN, 9000])
def test_long_blank_runs_count_as_the_library_does(blank, n):
    coder = token_counts.encoder(token_counts.read_vocabulary(token_counts.VOCABULARY))
    run = (blank * n)[:n]
    for text in (run, f"a{run}b", f"{run}'t", f"x. {run}", f"ab {run}cd{run} 12\n{run}é", f"{run}9"):
        assert token_counts.token_count(coder, text) == len(coder.encode_ordinary(text))


def test_very_long_texts_of_one_kind(spark):
    texts = [" " * 1_000_000, "a " + " " * 10_000_000 + "b", "\n" * 1_000_000 + "x", "a" * 1_000_000, "#" * 1_000_000, "　" * 1_000_000]
    got = token_counts.length_histogram(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert got.agg({"n_docs": "sum"}).first()[0] == 6 and got.agg({"n_tokens": "max"}).first()[0] >= 9_999_999
