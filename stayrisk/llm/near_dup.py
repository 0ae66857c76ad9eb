"""Operator 7: near-duplicates by Order MinHash and banded alignment.

A text is the sequence of its lower-cased words; its k-mers are 5-word windows
labelled with their occurrence number.  Each of ``SKETCHES`` hash functions
picks the ``PICKED`` smallest labelled k-mers and keeps them in text order; the
hash of that list is a bucket.  Order and repeats count, so buckets follow edit
similarity.  Two texts of similarity s share a bucket with probability about
1 - (1 - s^3)^16: 0.99999 at 0.8.

The similarity of two texts is m / (|A| + |B| - m), m the longest common
subsequence of their labelled k-mers, found by alignment inside the band that a
similarity of ``THRESHOLD`` allows.  Texts of at least that similarity are
linked; a group is a connected component.

1. Equal texts collapse to one node (128-bit hash of the word sequence).
2. The hub of a bucket is its member that meets the most company in all its
   buckets.  Every other member is aligned with its hub (a star), so a group of
   thousands of copies costs a linear number of alignments.
3. A hub that carries edits of its own gives way to the member nearest to the
   k-mers that most of the star agree on, with a second star around it.
4. These links give components.  What is left are pairs of two components under
   one hub H, of which one, A, is not linked to H.  With E(X) the k-mers in which
   X and H differ, A and B differ in exactly those in which E(A) and E(B) do, so
   a link needs an overlap of at least (|E(A)| + |E(B)| - (|A| + |B|) / 9) / 2.
   A prefix filter on these sets, rarest k-mer first, finds all pairs that can
   reach it: a member's row tells the place of a k-mer among its own, and a pair
   meets only where both places lie in the prefixes that the pair's two
   overlaps allow.  An edited copy's prefix is k-mers of its own, so unlinked
   copies of one text do not meet each other.  The found pairs are aligned.
5. Their links join components.

Cases: texts without words are never grouped (each is its own class); texts of
fewer than five words are one k-mer, so only equal ones meet; a null id takes
part by its text and never names a class that has another id (a class of null
ids only has a null ``class_id``, and all its rows are kept); rows sharing an
id and a text are one document; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, mix64, split_words, written

K = 5
THRESHOLD = 0.8
SKETCHES = 16
PICKED = 3
LENGTH_STEP = 1.08
HUB_SHARE = 256  # members of a hub that read one copy of its text
_CANDIDATES = 24
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _u(x: int) -> np.uint64:
    return np.uint64(x & _MASK)


def kmers(words: Words, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(labelled k-mer hashes of all texts on end, first k-mer of each text).
    A text of 1 to k - 1 words has one k-mer, its whole sequence."""
    n_words = np.diff(words.first)
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    start = words.first[:-1][text] + np.arange(first[-1]) - first[:-1][text]
    length = np.minimum(k, n_words[text])
    padded = np.concatenate([words.hash, np.zeros(k, np.uint64)])
    h = np.zeros(first[-1], np.uint64)
    for j in range(k):
        part = mix64(padded[start + j] + _u(_GOLD * (j + 1)))
        h += np.where(j < length, part, np.uint64(0))
    h = mix64(h + length.astype(np.uint64))
    # occurrence labels: only k-mers found twice in their text need any work
    own = mix64(h ^ (text.astype(np.uint64) * _u(_GOLD)))
    s = np.sort(own)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if len(twice):
        at = np.flatnonzero(np.isin(own, twice))
        order = at[np.argsort(own[at], kind="stable")]
        new = np.concatenate([[True], own[order][1:] != own[order][:-1]])
        run = np.flatnonzero(new)
        nth = np.arange(len(order)) - np.repeat(run, np.diff(np.concatenate([run, [len(order)]])))
        h[order] = np.where(nth > 0, mix64(h[order] + nth.astype(np.uint64) * _u(_GOLD)), h[order])
    return h, first


def sketches(h: np.ndarray, first: np.ndarray, count: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """Order MinHash of each text: one bucket hash per hash function."""
    n = np.diff(first)
    out = np.zeros((len(n), count), np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    # about _CANDIDATES values of a text lie under its limit; the exact minimum
    # of a text with fewer than `picked` there is taken from all its values
    share = np.minimum(1.0, _CANDIDATES / np.maximum(n, 1))
    limit = np.where(share >= 1, _MASK, (share * 2.0 ** 63).astype(np.uint64) * np.uint64(2)).astype(np.uint64)
    per_kmer = limit[text]
    need = np.minimum(n, picked)
    for t in range(count):
        v = (h ^ _u(_GOLD * (2 * t + 1))) * _u(0xD1342543DE82EF95 * (4 * t + 1) | 1)
        v ^= v >> np.uint64(29)
        v *= _u(0xBF58476D1CE4E5B9)
        at = np.flatnonzero(v <= per_kmer)
        short = np.flatnonzero(np.bincount(text[at], minlength=len(n)) < need)
        if len(short):
            at = np.sort(np.concatenate([at[~np.isin(text[at], short)], *[np.arange(first[i], first[i + 1]) for i in short]]))
        order = at[np.lexsort((v[at], text[at]))]
        owner = text[order]
        begin = np.searchsorted(owner, np.arange(len(n)))
        rank = np.arange(len(order)) - begin[owner]
        chosen = np.sort(order[rank < picked])  # back in text order
        owner = text[chosen]
        place = np.arange(len(chosen)) - np.searchsorted(owner, np.arange(len(n)))[owner]
        part = mix64(h[chosen] * np.uint64(3) + _u(_GOLD * (t + 1)) * (place + 1).astype(np.uint64))
        for j in range(picked):
            out[owner[place == j], t] += part[place == j]
        out[:, t] = mix64(out[:, t] + _u(t + 1))
    return out


def node_ids(words: Words) -> list[bytes]:
    """128-bit hash of each text's word sequence."""
    place = np.arange(len(words.hash)) - words.first[:-1][words.text_of()]
    sums = []
    for salt in (1, 2):
        v = mix64(words.hash + mix64((place + 1).astype(np.uint64) * _u(_GOLD * salt + salt)))
        total = np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])
        sums.append(mix64(total[words.first[1:]] - total[words.first[:-1]] + np.diff(words.first).astype(np.uint64)))
    return [a.tobytes() for a in np.stack(sums, axis=1)]


SKETCH_SCHEMA = "doc_id long, text_hash long, node binary, n int, buckets array<long>"


def _sketch(k: int):
    def run(batches):
        for b in chunks(batches):
            words = split_words(b.column("text"), lower=True)
            h, first = kmers(words, k)
            n = np.diff(first)
            sk = sketches(h, first)
            buckets = [row.view(np.int64) if m else [] for row, m in zip(sk, n)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(node_ids(words), pa.binary()),
                 pa.array(n, pa.int32()), pa.array(buckets, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "node", "n", "buckets"])
    return run


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity of two labelled k-mer sequences by banded alignment; below
    ``threshold`` the value may be an upper or lower bound, never above it."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < threshold * (total - len(i)):
        return len(i) / (total - len(i))
    order = np.argsort(i)
    i, j = i[order], j[order]
    band = int((1 - threshold) / (1 + threshold) * total + 1e-9)
    j = j[np.abs(i - j) <= band]
    tails: list[int] = []  # longest increasing run of j: labels make matches unique
    for x in j.tolist():
        at = bisect_left(tails, x)
        if at == len(tails):
            tails.append(x)
        else:
            tails[at] = x
    return len(tails) / (total - len(tails))


def _texts_kmers(texts: pa.Array, k: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for b in chunks([pa.RecordBatch.from_arrays([texts], names=["text"])]):
        h, first = kmers(split_words(b.column("text"), lower=True), k)
        out += np.split(h, first[1:-1])
    return out


def _align(k: int, threshold: float):
    """Align ``text_a`` with ``text_b``; with ``wide``, hand on the k-mers in
    which the two differ."""
    def run(batches):
        for b in batches:
            sides = []
            for c in ("text_a", "text_b"):
                code = b.column(c).dictionary_encode()
                grams = _texts_kmers(code.dictionary, k)
                sides.append([grams[i] for i in code.indices.to_pylist()])
            n_a, n_b = ([len(x) for x in side] for side in sides)
            linked = [similarity(x, y, threshold) >= threshold for x, y in zip(*sides)]
            differ = [np.setxor1d(x, y, assume_unique=True).view(np.int64) if wide else None
                      for x, y, wide in zip(*sides, b.column("wide").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("a"), b.column("b"), pa.array(linked, pa.bool_()), pa.array(n_a, pa.int32()), pa.array(n_b, pa.int32()),
                 pa.array(differ, pa.list_(pa.int64()))], names=["a", "b", "linked", "n_a", "n_b", "differ"])
    return run


ALIGNED = "a binary, b binary, linked boolean, n_a int, n_b int, differ array<long>"


def aligned(pairs: DataFrame, texts: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """``pairs`` (``a, b``: nodes, ``wide``) with whether their texts are
    similar enough, their lengths and, if wide, the k-mers in which they differ."""
    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))
    # a hub of many members hands out copies of its text, so they are not one task's work
    big = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_SHARE).alias("copies")).filter("copies > 1")
    dealt = (pairs.join(big, "a", "left").withColumn("copy", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1))))
             .select("a", "b", "wide", "copy"))
    hubs = side("a").join(big, "a", "left").select(
        "a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    both = dealt.join(side("b"), "b").join(hubs, ["a", "copy"]).select("a", "b", "wide", "text_a", "text_b")
    return both.mapInArrow(_align(k, threshold), ALIGNED)


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each connected component, for all
    nodes of ``edges`` (``a, b``).  Labels spread over edges and then jump to
    their label's label, so rounds grow with the logarithm of a path."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(heard.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        near = written(near, "labels")
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        far = written(near.join(jump, "label", "left").select(
            "node", "was", F.least("label", "further").alias("label")), "labels")
        labels = far.select("node", "label")
        if far.filter("label <> was").isEmpty():
            return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` after ``edges`` have joined some of their components."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    e = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    top = components(e.filter("a <> b")).withColumnRenamed("label", "top")
    alone = top.join(labels, "node", "left_anti").select("node", F.col("top").alias("label"))  # nodes without a link before
    known = labels.join(top.withColumnRenamed("node", "label"), "label", "left")
    return known.select("node", F.coalesce("top", "label").alias("label")).union(alone)


def _alike(n: Column, m: Column, threshold: float) -> Column:
    """Lengths that allow a similarity of ``threshold``."""
    return F.least(n, m) >= F.lit(threshold) * F.greatest(n, m)


def centres(spokes: DataFrame) -> DataFrame:
    """``a, centre``: for each star whose hub is not the member nearest to the
    star's majority, that member."""
    s = spokes.filter(F.col("differ").isNotNull())
    grams = s.select("a", "b", F.explode("differ").alias("kmer"))
    members = s.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    # the hub is wrong where most members differ from it
    wrong = (grams.groupBy("a", "kmer").agg(F.count(F.lit(1)).alias("held")).join(members, "a")
             .filter(F.col("held") * 2 > F.col("members")).select("a", "kmer"))
    wrong = written(wrong, "majority")
    n_wrong = wrong.groupBy("a").agg(F.count(F.lit(1)).alias("n_wrong"))
    right = grams.join(wrong, ["a", "kmer"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("right"))
    far = s.join(n_wrong, "a").join(right, ["a", "b"]).select(
        "a", "b", "n_wrong", (F.size("differ") + F.col("n_wrong") - 2 * F.col("right")).alias("far"))
    best = far.groupBy("a").agg(F.min(F.struct("far", "b")).alias("best"), F.first("n_wrong").alias("n_wrong"))
    return best.filter(F.col("best.far") < F.col("n_wrong")).select("a", F.col("best.b").alias("centre"))


def open_pairs(spokes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes under one hub, at least one of them not linked to it and
    not of one component (``labels``: ``node, label``), that can be similar
    enough.  ``spokes`` is ``aligned`` (hub ``a``, member ``b``)."""
    part = F.lit((1 - threshold) / (1 + threshold))  # |A d B| <= part * (|A| + |B|)
    s = (spokes.filter(F.col("differ").isNotNull())
         .select("a", "b", "linked", "n_b", "differ", F.size("differ").alias("e"),
                 (F.size("differ") - part * F.col("n_b")).alias("spare"),
                 # similar as a set but not in order: the bound below does not hold
                 (~F.col("linked") & (F.size("differ") <= part * (F.col("n_a") + F.col("n_b")))).alias("shuffled")))
    s = s.join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    # the least that a partner of similar length has to spare; similar texts are
    # at most `reach` length classes apart
    reach = math.ceil(math.log(1 / threshold) / math.log(LENGTH_STEP))
    s = s.withColumn("length", F.floor(F.log(F.col("n_b").cast("double")) / F.log(F.lit(LENGTH_STEP))))
    met = s.groupBy("a", "length").agg(F.min("spare").alias("least"), F.max(~F.col("linked")).alias("open"))
    near = F.explode(F.sequence(F.col("length") - reach, F.col("length") + reach)).alias("length")
    met = met.select("a", near, "least", "open").groupBy("a", "length").agg(F.min("least").alias("least"), F.max("open").alias("open"))
    s = written(s.join(met.filter("open"), ["a", "length"]), "open-spokes")

    def prefix(e, spare, other):  # the overlap with a partner is at least (spare + its spare) / 2
        return e - F.greatest(F.lit(1), F.ceil((spare + other) / 2 - 1e-6)) + 1

    grams = s.filter(~F.col("shuffled")).select("a", "b", F.explode("differ").alias("kmer"))
    held = grams.groupBy("a", "kmer").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    grams = written(grams.join(held, ["a", "kmer"]), "open-kmers")
    shared = s.select("a", "b", "linked", "n_b", "e", "spare", "label", prefix(F.col("e"), F.col("spare"), F.col("least")).alias("most")).join(
        grams.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")), ["a", "b"])
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("held", "kmer"))
    # k-mers that nobody else holds come first in the order
    ranked = grams.join(shared, ["a", "b"]).withColumn("rank", rank + F.col("e") - F.col("shared")).filter("rank <= most")
    first = written(ranked.select("a", "b", "linked", "n_b", "e", "spare", "label", "kmer", "rank"), "open-prefix")
    x, y = first.filter(~F.col("linked")).alias("x"), first.alias("y")
    same = ((F.col("x.a") == F.col("y.a")) & (F.col("x.b") != F.col("y.b")) & (F.col("x.label") != F.col("y.label"))
            & _alike(F.col("x.n_b"), F.col("y.n_b"), threshold))
    once = F.col("y.linked") | (F.col("x.b") < F.col("y.b"))  # two open nodes meet from one side only
    inside = ((F.col("x.rank") <= prefix(F.col("x.e"), F.col("x.spare"), F.col("y.spare")))
              & (F.col("y.rank") <= prefix(F.col("y.e"), F.col("y.spare"), F.col("x.spare"))))
    pairs = x.join(y, same & once & (F.col("x.kmer") == F.col("y.kmer")) & inside)
    odd = s.filter("shuffled").alias("x").join(s.alias("y"), same)
    both = lambda d: d.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b"))
    return both(pairs).union(both(odd)).distinct()


def near_dups(docs: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """Class of every document of ``docs`` (``doc_id, text``): ``doc_id,
    class_id`` (smallest id of the group), ``text_id`` (smallest id with an
    equal text), ``kept`` (true for the document that stays), ``text_hash``."""
    source = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = written(source.mapInArrow(_sketch(k), SKETCH_SCHEMA), "sketches")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n", "buckets")).alias("r")
    nodes = written(rows.filter("n > 0").groupBy("node").agg(one).select("node", "r.doc_id", "r.text_hash", "r.n", "r.buckets"), "nodes")

    members = nodes.select(F.explode("buckets").alias("bucket"), "node", "n")
    held = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    met = written(members.join(held, "bucket").select("bucket", "node", "n", "held"), "met")
    central = met.groupBy("node").agg(F.sum(F.col("held") - 1).alias("company"))
    met = written(met.join(central, "node"), "buckets")
    hubs = met.groupBy("bucket").agg(F.max(F.struct("company", "node", "n")).alias("hub"))
    # a star per hub, over all the buckets it is the hub of
    stars = met.join(hubs, "bucket").filter(F.col("node") != F.col("hub.node")).select(
        F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    stars = written(stars, "stars")
    several = stars.groupBy("a").agg((F.count(F.lit(1)) > 1).alias("wide"))
    wanted = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct().join(nodes, "node").select("node", "doc_id", "text_hash")
    w, s = wanted.alias("w"), source.alias("s")
    texts = s.join(w, (F.col("s.text_hash") == F.col("w.text_hash")) & F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")))
    texts = written(texts.groupBy("w.node").agg(F.first("s.text").alias("text")), "texts")

    spokes = written(aligned(stars.join(several, "a"), texts, k, threshold), "spokes")
    moved = written(centres(spokes), "centres")
    again = stars.union(stars.select("a", F.col("a").alias("b")).distinct()).join(moved, "a").filter(F.col("b") != F.col("centre"))
    again = again.select(F.col("centre").alias("a"), "b").distinct()
    # a centre that is an unmoved hub has met some of them already
    again = written(again.join(stars.join(moved, "a", "left_anti"), ["a", "b"], "left_anti"), "stars")
    closer = written(aligned(again.withColumn("wide", F.lit(True)), texts, k, threshold), "spokes")
    links = spokes.union(closer).filter("linked").select("a", "b")
    final = spokes.join(moved, "a", "left_anti").union(closer)
    seen = stars.union(again).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    labels = components(links)
    pairs = written(open_pairs(final, labels, threshold).join(seen, ["a", "b"], "left_anti"), "pairs")
    more = written(aligned(pairs.withColumn("wide", F.lit(False)), texts, k, threshold), "more-spokes").filter("linked").select("a", "b")
    labels = joined(labels, more)

    by_node = nodes.select("node", F.col("doc_id").alias("text_id")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = by_node.groupBy("label").agg(F.min("text_id").alias("class_id"))
    classes = written(by_node.join(groups, "label").select("node", "text_id", "class_id"), "classes")
    out = rows.join(classes, "node", "left")
    own = F.col("n") == 0
    class_id = F.when(own, F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.when(own, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"),
                      F.coalesce(F.col("doc_id") == class_id, class_id.isNull()).alias("kept"), "text_hash")


def keep_one(docs: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged: one document of each
    group.  Rows that share the kept id and its text stay together."""
    gone = near_dups(docs, k, threshold).filter(~F.col("kept")).select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # names of further columns cannot clash
    same = ((F.xxhash64(F.coalesce(rows["row.text"], F.lit(""))) == gone["text_hash"])
            & rows["row.doc_id"].eqNullSafe(gone["doc_id"]))
    return rows.join(gone, same, "left_anti").select("row.*")
