"""Operator 13: runs of periodically repeated words, by internal pattern matching.

A run is a stretch of words with smallest period q, at least max(6, 4q) long,
that no neighbouring word extends.  Texts are independent: a task handles some
at a time, about half a megabyte of words or one longer text.

Blocks of 2^k words (k >= 2) start at every multiple of half their length.  A run
of period q <= 2^k holds, for the smallest such k, one of them with q more words
behind it.  There the block occurs again q words later and, as q is the smallest
period and no longer than the block, not sooner.  So each block asks for its next
occurrence in the neighbouring window of 2^k starts: all occurrences there are
the progression which that first one begins, its difference the one candidate
period.  The question is a range successor query: occurrences of a block are a
range of the suffix array, and a wavelet tree over the suffix array's positions
finds the smallest position of a range beyond a given one.  A candidate is
extended to both sides by comparing block names of falling length.

The suffix array sorts by doubling; the ranks after each doubling name the blocks.
Positions whose four words occur once in their text can be in no run's interior
and are left out before, so prose costs two sorts and no query.

Cases: null, empty and blank texts have no words, no runs and the hash of nothing
twice; repeated rows and ids are handled row by row; a row without an id keeps
its words; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, split_bytes, utf8

LEAST = 6
EXPONENT = 4
PLANT_EVERY = 10
FIRST = 2  # blocks of four words are the shortest


class WaveletTree:
    """Wavelet tree of distinct integers (levels as one bit array each), for
    range successor queries on many ranges at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.levels, v = [], values.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            one = (v >> b) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - one)])
            self.levels.append((b, zeros))
            v = np.concatenate([v[one == 0], v[one == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of places ``lo`` to ``hi`` (excluded) are less than ``x``."""
        lo, hi, n = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for b, zeros in self.levels:
            a, c = zeros[lo], zeros[hi]
            right = ((x >> b) & 1).astype(bool)
            n += np.where(right, c - a, 0)
            lo = np.where(right, zeros[-1] + lo - a, a)
            hi = np.where(right, zeros[-1] + hi - c, c)
        return np.where(x >> self.bits > 0, -1, n)

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k`` (from 0) among the places ``lo`` to ``hi``."""
        lo, hi, k, v = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
        for b, zeros in self.levels:
            a, c = zeros[lo], zeros[hi]
            right = k >= c - a
            k = np.where(right, k - (c - a), k)
            v |= right.astype(np.int64) << b
            lo = np.where(right, zeros[-1] + lo - a, a)
            hi = np.where(right, zeros[-1] + hi - c, c)
        return v

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value not below ``x`` at places ``lo`` to ``hi``, or -1."""
        k = self.below(lo, hi, x)
        found = (k >= 0) & (k < hi - lo)
        out = np.full(len(lo), -1, np.int64)
        out[found] = self.kth(lo[found], hi[found], k[found])
        return out


def names(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys, name of each: the number of lesser distinct keys)."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])]) if len(s) else np.zeros(0, np.int64)
    name = np.empty(len(key), np.int64)
    name[order] = new
    return order, name


class Blocks:
    """Names of the blocks of 4, 8, ... words at the positions whose four words
    occur again in their text, and the suffix array of those positions.

    ``word`` are the word numbers of several texts on end, ``first`` where each
    text begins (and the last ends).  A block that would cross its text's end
    has a name that no other block has."""

    def __init__(self, word: np.ndarray, first: np.ndarray):
        n = len(word)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.end = first[1:][text] if n else np.zeros(0, np.int64)
        self.word = text * (int(word.max(initial=0)) + 1) + word  # equal only within a text
        self.first = first
        _, one = names(self.word)
        two = self._join(one, 1, n)
        four = self._join(two, 2, n)
        # only blocks that occur twice
        times = np.bincount(four, minlength=1)
        self.at = np.flatnonzero((times[four] > 1) & (np.arange(n) + 4 <= self.end)) if n else np.zeros(0, np.int64)
        self.place = np.full(n + 1, -1, np.int64)
        self.place[self.at] = np.arange(len(self.at))
        _, name = names(four[self.at])
        self.levels, self.order = {FIRST: name.astype(np.int32)}, np.arange(len(name))
        k = FIRST
        while len(self.at) and np.bincount(name).max() > 1:
            # twice the length: the name here and 2^k words on (none there: one of its own)
            ahead = self._there(self.at + (1 << k))
            m = len(self.at)
            follow = np.where(ahead >= 0, name[ahead], m + np.arange(m))
            self.order, name = names(name * (2 * m) + follow)
            k += 1
            self.levels[k] = name.astype(np.int32)
        self.top = k

    def _join(self, name: np.ndarray, size: int, n: int) -> np.ndarray:
        """Names of blocks of ``2 * size`` words from those of ``size``."""
        ahead = np.arange(n) + size
        follow = np.where(ahead < self.end, name[np.minimum(ahead, max(n - 1, 0))], n + np.arange(n))
        return names(name * (2 * n + 1) + follow)[1]

    def _there(self, at: np.ndarray) -> np.ndarray:
        """Number of the kept position ``at``, or -1."""
        return np.where((at >= 0) & (at < len(self.place)), self.place[np.clip(at, 0, len(self.place) - 1)], -1)

    def ranges(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For every kept position the range of the suffix array that holds the
        occurrences of its block of 2^k words."""
        name = self.levels[k]
        count = np.bincount(name, minlength=1)
        lo = np.cumsum(count) - count
        return lo[name], lo[name] + count[name]

    def same(self, i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
        """Whether the blocks of 2^k words at ``i`` and ``j`` are kept and equal."""
        a, b = self._there(i), self._there(j)
        ok = (a >= 0) & (b >= 0)
        out = np.zeros(len(i), bool)
        out[ok] = self.levels[k][a[ok]] == self.levels[k][b[ok]]
        return out

    def _same_word(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = len(self.word)
        ok = (i >= 0) & (j >= 0) & (i < n) & (j < n)
        out = np.zeros(len(i), bool)
        out[ok] = self.word[i[ok]] == self.word[j[ok]]
        return out

    def extend(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """How many words from ``i`` and ``j`` on are equal, to the right
        (``step`` 1) or, before them, to the left (-1)."""
        n = np.zeros(len(i), np.int64)
        for k in range(self.top, FIRST - 1, -1):
            back = (1 << k) if step < 0 else 0
            todo = np.arange(len(i))
            while len(todo):
                moved = step * n[todo] - back
                todo = todo[self.same(i[todo] + moved, j[todo] + moved, k)]
                n[todo] += 1 << k
        todo = np.arange(len(i))
        while len(todo):  # fewer than four more words
            moved = step * n[todo] - (step < 0)
            todo = todo[self._same_word(i[todo] + moved, j[todo] + moved)]
            n[todo] += 1
        return n


def find_runs(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All runs of texts given as word numbers on end and where each begins:
    rows (start, length, period) in ascending order; starts count from the first
    word of all."""
    blocks = Blocks(word, first)
    if not len(blocks.at):
        return np.zeros((0, 3), np.int64)
    tree = WaveletTree(blocks.at[blocks.order])
    found = []
    for k, name in blocks.levels.items():
        half = 1 << (k - 1)
        lo, hi = blocks.ranges(k)
        ask = np.flatnonzero((blocks.at % half == 0) & (hi - lo > 1))
        at = blocks.at[ask]
        after = tree.successor(lo[ask], hi[ask], at + 1)
        near = (after >= 0) & (after - at <= 1 << k)
        at, period = at[near], after[near] - at[near]
        if len(at):
            left = blocks.extend(at, at + period, -1)
            right = blocks.extend(at, at + period, 1)
            found.append(np.column_stack([at - left, left + right + period, period]))
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[runs[:, 1] >= np.maximum(LEAST, EXPONENT * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated_from(n: int, h: int) -> tuple[int, int]:
    """(a, p): every word i >= a is to become word a + (i - a) % p."""
    g = h // PLANT_EVERY
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def rewritten(doc_id, n: int) -> np.ndarray:
    """For each of ``n`` words, the number of the word in its place."""
    at = np.arange(n)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % PLANT_EVERY == 0:
            a, p = repeated_from(n, h)
            at[a:] = a + (at[a:] - a) % p
    return at


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """True for the words that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] > 0


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def _analyse(b: pa.RecordBatch, plant: bool, full: bool) -> pa.RecordBatch:
    data, off = utf8(b.column("text"))
    words = split_bytes(data, off)
    raw, ids = data.tobytes(), b.column("doc_id").to_pylist()
    # words numbered by their bytes
    ends = np.concatenate([np.column_stack([words.start, words.end]).ravel(), [len(data)]]).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    number = pieces.take(pa.array(np.arange(0, len(ends) - 1, 2))).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = words.first
    at = np.concatenate([np.zeros(0, np.int64), *[first[t] + rewritten(i if plant else None, first[t + 1] - first[t]) for t, i in enumerate(ids)]]).astype(np.int64)
    runs = find_runs(number[at], first)
    cut = np.searchsorted(runs[:, 0], first)
    keep = ~dropped(runs, len(at))
    rows = []
    for t, doc_id in enumerate(ids):
        a, z = first[t], first[t + 1]
        mine = runs[cut[t]:cut[t + 1]] - [a, 0, 0]
        own = at[a:z]
        if not len(mine) and (own == np.arange(a, z)).all():
            collapsed = b" ".join(raw[off[t]:off[t + 1]].split())  # splits bytes at just these six blanks
        else:
            own = own[keep[a:z]]
            collapsed = b" ".join([raw[s:e] for s, e in zip(words.start[own].tolist(), words.end[own].tolist())])
        if len(mine):
            s, n, q = mine[np.lexsort((mine[:, 2], mine[:, 0], -mine[:, 1]))[0]].tolist()
            best = (s, n, q, 1000 * n // q)
        else:
            best = (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in mine.tolist())
        rows.append((doc_id, int(z - a), len(mine), *best, _sha(lines.encode()), _sha(collapsed),
                     [dict(zip(("start", "length", "period"), r)) for r in mine.tolist()] if full else None,
                     collapsed.decode() if full else None))
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string(), run_type, pa.string()]
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=columns)


def periodic_runs(docs: DataFrame, plant: bool = False, full: bool = True) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): the number of runs, the
    longest (``start, length, period, exponent_milli``; ties: least start, then
    period), hashes of all runs and of the text without repetitions, and, if
    ``full``, both themselves (``runs``, ``collapsed``).  ``plant`` first makes
    the words of every tenth document periodic, by its id's crc32."""
    def run(batches):
        for b in chunks(batches):
            yield _analyse(b, plant, full)

    d = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
    return d if full else d.drop("runs", "collapsed")
