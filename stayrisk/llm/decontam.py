"""Operator 5: benchmark decontamination by greedy string tiling.

Texts and test items become sequences of word hashes (lower case, punctuation
as gaps).  Windows of ``MIN_MATCH`` words, hashed by a running Karp-Rabin sum,
are the seeds: a document meets an item only over shared seeds, if these touch
enough of the item's words.  For each such pair the longest match that
overlaps no marked word, on either side, is marked as a tile, again and again,
until none of ``MIN_MATCH`` words is left; the same sum over longer windows
finds that match without a list of all.  An item leaks into a document if
the tiles cover at least ``MIN_COVERAGE`` of its words, in any order, so
reordered passages count.

Documents stream through tasks once per block of the benchmark.  A block holds
about ``BLOCK_WORDS`` words, which bounds what is broadcast; a benchmark of any
size is a number of blocks.

Cases: null or empty texts match nothing; items with fewer than ``MIN_MATCH``
words are too short to tell and match nothing; equal rows of the benchmark
count once; null ids are carried along; empty tables give no pairs and every
document is clean.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, chunks, mix64, split_words, word_array, written

MIN_MATCH = 4
MIN_COVERAGE = 0.6
BLOCK_WORDS = 1 << 20
_FILTER_BITS = 22
_LISTED = 1 << 22
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _words(col: pa.Array):
    return split_words(pc.utf8_lower(pc.fill_null(col, "")), kinds=LETTERS)


def seeds(tokens: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every window of ``width`` tokens inside one text."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * np.uint64(_BASE) + tokens[j:j + n]
    inside = np.ones(len(tokens) + 1, bool)
    for j in range(1, width):
        inside[np.maximum(first[1:] - j, 0)] = False
    at = np.flatnonzero(inside[:n])
    return mix64(h[at]), at


class Block(NamedTuple):
    """Items of one benchmark block: seeds in order with (item, place), and the
    words of all items on end."""
    ids: list
    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray
    words: np.ndarray
    first: np.ndarray
    width: int


def make_block(items: pa.Table, width: int = MIN_MATCH) -> Block:
    text = items.column("text").combine_chunks()
    words = _words(text if isinstance(text, pa.Array) else pa.array([], pa.string()))
    h, at = seeds(words.hash, words.first, width)
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    item = np.searchsorted(words.first, at, side="right") - 1
    maybe = np.zeros(1 << _FILTER_BITS, bool)
    maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Block(items.column("item_id").to_pylist(), h, item.astype(np.int32), (at - words.first[item]).astype(np.int32),
                 maybe, words.hash, words.first, width)


class _Rolling:
    """Karp-Rabin hashes of a sequence's windows, of any width, in O(1) each."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.tokens = tokens
        power, inverse = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
        power[0] = inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * np.cumprod(power, dtype=np.uint64)[:n], dtype=np.uint64)])
        self.marked = np.zeros(n, bool)

    def free(self) -> np.ndarray:
        """Unmarked words from each place on."""
        stop = np.append(np.flatnonzero(self.marked), len(self.marked))
        at = np.arange(len(self.marked))
        return stop[np.searchsorted(stop, at)] - at

    def windows(self, free: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the unmarked windows of ``width`` words."""
        at = np.flatnonzero(free >= width)
        return at, (self.sums[at + width] - self.sums[at]) * self.inverse[at]


def _longest(item: _Rolling, text: _Rolling, free: tuple[np.ndarray, np.ndarray], width: int, most: int) -> int:
    """Greatest window length up to ``most`` that unmarked words of both have
    in common, or ``width`` - 1.  A common window holds shorter common ones, so
    the lengths are halved."""
    low, high, probe = width - 1, most, most
    while low < high:
        if np.isin(text.windows(free[1], probe)[1], item.windows(free[0], probe)[1]).any():
            low = probe
        else:
            high = probe - 1
        probe = (low + high + 1) // 2
    return low


def tile(item: np.ndarray, text: np.ndarray, width: int, marked: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: tiles (length,
    place in the item, place in the text), longest first, ties by place.  Words
    that are ``marked`` in the text take no part.

    No list of matches is made: Karp-Rabin windows give the greatest length
    that unmarked words still have in common, and the tiles of that length are
    marked in order.  Memory is a few numbers a word, however often words
    repeat; the rounds are as many as different tile lengths, of which an item
    of n words has fewer than sqrt(2 n)."""
    a, b = _Rolling(item), _Rolling(text)
    if marked is not None:
        b.marked |= marked
    tiles = []
    most = min(len(item), len(text))
    while most >= width:
        free = a.free(), b.free()
        most = _longest(a, b, free, width, min(most, int(free[0].max()), int(free[1].max())))
        if most < width:
            break
        at_a, hash_a = a.windows(free[0], most)
        at_b, hash_b = b.windows(free[1], most)
        meet = np.isin(hash_b, hash_a)
        at_b, hash_b = at_b[meet], hash_b[meet]
        order = np.argsort(hash_b, kind="stable")
        at_b, hash_b = at_b[order], hash_b[order]
        begin, end = np.searchsorted(hash_b, hash_a, "left"), np.searchsorted(hash_b, hash_a, "right")
        following: dict[int, int] = {}  # first window of a hash that may be unmarked still
        for i, low, high in zip(at_a.tolist(), begin.tolist(), end.tolist()):
            if a.marked[i] or a.marked[i + most - 1]:
                continue
            k = following.get(low, low)
            # a window meets a marked one of its own length at an end
            while k < high and (b.marked[at_b[k]] or b.marked[at_b[k] + most - 1]):
                k += 1
            following[low] = k
            if k < high:
                j = int(at_b[k])
                tiles.append((most, i, j))
                a.marked[i:i + most] = True
                b.marked[j:j + most] = True
        most -= 1
    return tiles


def _seeded_pairs(words, block: Block, min_coverage: float):
    """(text number, item number) whose shared seeds touch enough words of the
    item.  Each different seed of a text counts once, so a text alone lists at
    most the block's seeds; texts are taken together up to ``_LISTED``."""
    h, at = seeds(words.hash, words.first, block.width)
    near = block.maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
    h, text = h[near], np.searchsorted(words.first, at[near], side="right") - 1
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(text) != 0) | (h[1:] != h[:-1])
    h, text = h[new], text[new]
    low, high = np.searchsorted(block.hash, h, "left"), np.searchsorted(block.hash, h, "right")
    hit = high > low
    low, times, text = low[hit], (high - low)[hit], text[hit]
    if not len(text):
        return
    total = np.diff(block.first)
    done = np.concatenate([[0], np.cumsum(times)])
    ends = np.append(np.flatnonzero(np.diff(text)) + 1, len(text))  # after each text's last seed
    x = 0
    while x < len(text):
        fits = ends[(ends > x) & (done[ends] - done[x] <= _LISTED)]
        y = int(fits[-1]) if len(fits) else int(ends[ends > x][0])
        match = np.repeat(low[x:y] - (done[x:y] - done[x]), times[x:y]) + np.arange(done[y] - done[x])
        pair = np.repeat(text[x:y], times[x:y]) * len(block.ids) + block.item[match]
        place = block.place[match]
        order = np.lexsort((place, pair))
        pair, place = pair[order], place[order]
        begin = np.flatnonzero(np.concatenate([[True], np.diff(pair) != 0]))
        reach = np.full(len(pair), block.width)
        reach[:-1] = np.minimum(np.diff(place), block.width)
        reach[np.append(begin[1:], len(pair)) - 1] = block.width
        touched = np.add.reduceat(reach, begin)
        pair = pair[begin]
        item = pair % len(block.ids)
        good = touched >= min_coverage * total[item]
        yield from zip((pair[good] // len(block.ids)).tolist(), item[good].tolist())
        x = y


def leaks(col: pa.Array, block: Block, min_coverage: float = MIN_COVERAGE):
    """(text number, item number, coverage, tiles) of every leak into the texts."""
    words = _words(col)
    of, own = -1, None
    for t, m in _seeded_pairs(words, block, min_coverage):
        tokens = words.hash[words.first[t]:words.first[t + 1]]
        if t != of:
            of, own = t, seeds(tokens, np.array([0, len(tokens)]), block.width)[0]
        item = block.words[block.first[m]:block.first[m + 1]]
        met = np.flatnonzero(np.isin(own, seeds(item, np.array([0, len(item)]), block.width)[0]))
        # the words that shared seeds touch, and one marked word after each stretch
        touched = np.zeros(len(tokens) + 1, bool)
        for k in range(block.width):
            touched[met + k] = True
        place = np.flatnonzero(touched | np.append(False, touched[:-1]))
        tiles = tile(item, np.append(tokens, np.uint64(0))[place], block.width, ~touched[place])
        covered = sum(x[0] for x in tiles) / len(item)
        if covered >= min_coverage:
            yield t, m, covered, [(n, i, int(place[j])) for n, i, j in tiles]


def _blocks(benchmark: DataFrame, width: int, block_words: int):
    """Benchmark blocks, one at a time, as broadcast variables."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").distinct()
    total = items.agg(F.sum(F.size(word_array(F.col("text"))))).first()[0] or 0
    n = max(1, math.ceil(total / block_words))
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        part = items.filter(deal == k).toArrow()
        yield spark.sparkContext.broadcast(tuple(make_block(part.sort_by([("item_id", "ascending")]), width)))


PAIRS = "doc_id long, item_id long, coverage double, n_tiles int, spans array<struct<item_word:int,text_word:int,words:int>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE,
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs of ``docs`` (``doc_id, text``) and ``benchmark`` (``item_id,
    text``) where the item leaks: ``doc_id, item_id, coverage, n_tiles, spans``
    (tiles as word places in the item and in the text)."""
    def scan(shared):
        def run(batches):
            block = Block(*shared.value)
            for b in chunks(batches):
                found = list(leaks(b.column("text"), block, min_coverage))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array([x[0] for x in found])),
                         pa.array([block.ids[x[1]] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64()),
                         pa.array([len(x[3]) for x in found], pa.int32()),
                         pa.array([[{"item_word": a, "text_word": c, "words": n} for n, a, c in x[3]] for x in found],
                                  pa.list_(pa.struct([("item_word", pa.int32()), ("text_word", pa.int32()), ("words", pa.int32())])))],
                        names=["doc_id", "item_id", "coverage", "n_tiles", "spans"])
        return run

    out = None
    for shared in _blocks(benchmark, width, block_words):
        part = written(docs.select("doc_id", "text").mapInArrow(scan(shared), PAIRS), "leaks")
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, width: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, columns unchanged."""
    def scan(shared):
        def run(batches):
            block = Block(*shared.value)
            for b in chunks(batches):
                bad = {x[0] for x in leaks(b.column("text"), block, min_coverage)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)]))
        return run

    for k, shared in enumerate(_blocks(benchmark, width, block_words)):
        docs = (docs if not k else written(docs, "clean")).mapInArrow(scan(shared), docs.schema)
    return docs
