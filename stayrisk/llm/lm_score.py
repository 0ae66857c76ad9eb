"""Operator 9: language-model scores by context-tree weighting over bytes.

The model.  A byte is eight binary decisions (a node of a 255-node tree); its
context is the last ``DEPTH`` bytes, nearest first, with the end sign before the
start of a text.  A node has at every context depth a Krichevsky-Trofimov
estimate from its counts of zeros and ones, and the tree mixes all depths:
P_w = 1/2 P_kt + 1/2 prod P_w(children).  Counts come from all training texts;
block probabilities depend on counts alone, so the exact weights follow from
the added-up counts.  A byte is predicted by the nodes on its path, down to the
deepest context that training has seen there.

Model size.  The model has every (context, byte) cell that training holds, at
any size of the corpus.  The cells are a written table, dealt out by their
``TOP + 1`` nearest context bytes, so a task has whole subtrees: a first pass
returns each subtree's block probability, the contexts of up to ``TOP`` bytes
(as many as there are byte triples) are mixed from the sums and broadcast, and a
second pass has the probability of each distinct cell.  Texts are taken in parts
of about ``PART`` bytes; a part's distinct cells are dealt by hash to shards, whose
number follows the corpus, and each shard answers its parts.

The base.  Add-one unigram scores need the training count of every token.
Words are counted by 64-bit hash.  The most frequent ones (up to
``COMMON_WORDS``) are broadcast; the counts of all others, of which no one is
frequent, are joined to the documents' own word lists by hash.

Cases: null and empty texts have the end token only and the score of an
immediate end; without training rows every base score is 0 and every bit has
probability 1/2; null and repeated ids are fine (a null id is not held out); an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, mix64, partitions, split_bytes, sums_by_text, utf8, written

DEPTH = 5
END = 255  # never a byte of UTF-8
TOP = 2
COMMON_WORDS = 1 << 19
CHUNK = 1 << 20
PART = 1 << 24
FLUSH = 1 << 21
LIST = 1 << 16


def cells(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell of every byte and of every text's end, first cell of each text).
    A cell holds the byte in its low 8 bits, the byte before in the next 8 and
    so on; ``cell & mask(d)`` is the cell of context depth ``d``."""
    n = np.diff(off) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    x = np.full(first[-1], END, np.uint8)
    inside = np.ones(len(x), bool)
    inside[first[1:] - 1] = False
    x[inside] = data
    place = np.arange(len(x)) - np.repeat(first[:-1], n)
    cell = x.astype(np.int64)
    for d in range(1, DEPTH + 1):
        back = np.full(len(x), END, np.int64)
        back[d:] = x[:max(0, len(x) - d)]
        cell |= np.where(place >= d, back, END) << (8 * d)
    return cell, first


def mask(d: int) -> int:
    return (1 << (8 * (d + 1))) - 1


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2, by Stirling's series at x + 7."""
    low = np.ones_like(x)
    for k in range(7):
        low *= x + k
    z = x + 7.0
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - np.log(low)


def _kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a block."""
    small = (zeros + ones) == 0
    out = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)
    return np.where(small, 0.0, out)


def by_depth(cell: np.ndarray, n: np.ndarray, depths) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted cells, counts) at each of ``depths``, from deeper cells and their counts."""
    out = []
    for d in depths:
        key, at = np.unique(cell & mask(d), return_inverse=True)
        out.append((key, np.bincount(at, n, minlength=len(key)).astype(np.int64)))
    return out


def _up(d: int, b: int) -> int:
    """Mask of a node of bit level ``b`` that leaves its context's ``d`` nearest bytes."""
    return (1 << (8 * d + b)) - 1


def _bottom_up(levels: list, b: int, low: int, below=None):
    """Nodes of bit level ``b`` at depths ``low``, ``low + 1``, ...: ids, zeros,
    ones and share of the own estimate, and the block probabilities of the
    first depth.  ``below``: nodes of the last depth and the sums of their
    children's blocks."""
    ids, zeros, ones = [], [], []
    for cell, n in levels:
        node = cell >> (8 - b)
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        bit = (cell >> (7 - b)) & 1
        add = lambda v: np.add.reduceat(v, start) if len(start) else np.zeros(0)
        ids.append(node[start])
        one, total = add(n * bit), add(n)
        ones.append(one.astype(np.float64))
        zeros.append((total - one).astype(np.float64))
    half, weight, block = math.log(0.5), [None] * len(ids), None
    for d in range(len(ids) - 1, -1, -1):
        own = _kt_log(zeros[d], ones[d])
        kids, sums = np.zeros(len(own), bool), np.zeros(len(own))
        if block is not None or below is not None:
            child, value = (ids[d + 1] & _up(low + d, b), block) if block is not None else below
            up = np.searchsorted(ids[d], child)
            kids[up] = True
            sums = np.bincount(up, value, minlength=len(own))
        block = np.where(kids, np.logaddexp(half + own, half + sums), own)
        weight[d] = np.where(kids, np.exp(half + own - block), 1.0)
    return ids, zeros, ones, weight, block


def mixed_tree(levels: list, low: int = 0, above=None, below=None) -> tuple[list, list]:
    """The mixed estimates of a tree from its (sorted cells, counts) at depths
    ``low``, ``low + 1``, ...: for each bit level and depth the sorted nodes, and
    for each node the probability of a one if no deeper context knows the node.
    Also what the last depth hands on: nodes, what has been said, the share left
    (``above`` is that of depth ``low - 1``).  ``below`` as in ``_bottom_up``, by
    bit level."""
    out, hand = [], []
    for b in range(8):
        ids, zeros, ones, weight, _ = _bottom_up(levels, b, low, below[b] if below else None)
        # from the root down: what shallower depths have said, and the share left
        level, parent = [], above[b] if above else None
        for d in range(len(ids)):
            said, left = np.zeros(len(ids[d])), np.ones(len(ids[d]))
            if parent is not None:
                up = np.searchsorted(parent[0], ids[d] & _up(low + d - 1, b))
                said, left = parent[1][up], parent[2][up]
            estimate = (ones[d] + 0.5) / (zeros[d] + ones[d] + 1.0)
            level.append((ids[d], said + left * estimate))
            parent = ids[d], said + left * weight[d] * estimate, left * (1 - weight[d])
        out.append(level)
        hand.append(parent)
    return out, hand


def context_tree(levels: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """``mixed_tree`` of all depths from 0."""
    return mixed_tree(levels)[0]


def log_probability(cell: np.ndarray, tree: list) -> np.ndarray:
    """log10 probability of each cell's byte in its context."""
    out = np.zeros(len(cell))
    for b, level in enumerate(tree):
        p, todo = np.full(len(cell), 0.5), np.arange(len(cell))
        for d in range(len(level) - 1, -1, -1):
            ids, q = level[d]
            if not len(ids) or not len(todo):
                continue
            node = (cell[todo] & mask(d)) >> (8 - b)
            at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
            hit = ids[at] == node
            p[todo[hit]] = q[at[hit]]
            todo = todo[~hit]
        out += np.log10(np.where((cell >> (7 - b)) & 1, p, 1 - p))
    return out


WORD, TEXT = 0, 1


def _merged(parts):
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _statistics(batches):
    """Counts of word hashes, and the number of texts."""
    names = ["kind", "key", "n"]

    def out(kind, key, n):
        for k in range(0, len(key), LIST):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[k:k + LIST]), kind), pa.int32()), pa.array(key[k:k + LIST], pa.int64()),
                                              pa.array(n[k:k + LIST], pa.int64())], names=names)

    held: list = []
    texts = 0
    for b in chunks(batches, limit=CHUNK):
        texts += b.num_rows
        held.append(np.unique(split_bytes(*utf8(b.column("text"), lower=True)).hash.view(np.int64), return_counts=True))
        if sum(len(k) for k, _ in held) > FLUSH:
            held = [_merged(held)]
            if len(held[0][0]) > FLUSH // 2:
                yield from out(WORD, *held.pop())
    if held:
        yield from out(WORD, *_merged(held))
    yield from out(TEXT, np.zeros(1, np.int64), np.array([texts]))


SUBTREE = range(TOP + 1, DEPTH + 1)


def _whole(batches):
    """(shards, cells, training counts) of a whole partition, by cell."""
    got = [tuple(b.column(c).to_numpy() for c in ("shard", "key", "n")) for b in batches if b.num_rows]
    if not got:
        return (np.zeros(0, np.int64),) * 3
    shard, key, n = (np.concatenate(x) for x in zip(*got))
    order = np.argsort(key)
    return shard[order], key[order], n[order]


def _blocks(batches):
    """Block probability of each node of depth ``TOP + 1``, under its parent."""
    _, key, n = _whole(batches)
    levels = by_depth(key, n, SUBTREE)
    for b in range(8):
        ids, *_, block = _bottom_up(levels, b, TOP + 1)
        for k in range(0, len(block), LIST):
            own = ids[0][k:k + LIST] & _up(TOP, b)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b), pa.int32()), pa.array(own, pa.int64()), pa.array(block[k:k + LIST])],
                                             names=["level", "node", "block"])


def _logs(shared):
    def run(batches):
        top, hand = shared.value
        shard, key, n = _whole(batches)
        under = mixed_tree(by_depth(key[n > 0], n[n > 0], SUBTREE), TOP + 1, hand)[0]
        tree = [above + below for above, below in zip(top, under)]
        for k in range(0, len(key), LIST):
            log = log_probability(key[k:k + LIST], tree).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(shard[k:k + LIST]), pa.array(key[k:k + LIST]), pa.array(log)], names=["shard", "key", "log"])
    return run


def _of_lists(t: pa.Table, name: str) -> np.ndarray:
    return pc.list_flatten(t.column(name)).to_numpy()


def _cells(t: pa.Table) -> np.ndarray:
    """Cells (48 bits) from their high 32 and low 16 bits."""
    return (_of_lists(t, "high").view(np.uint32).astype(np.int64) << 16) | _of_lists(t, "low").view(np.uint16)


def _distinct(asked: pa.Table) -> pa.Table:
    """Distinct cells of a shard with their training counts."""
    key, n = _merged([(_cells(asked), _of_lists(asked, "seen"))])
    return pa.table({"shard": np.full(len(key), asked.column("shard")[0].as_py(), np.int64), "key": key, "n": n})


def _answers(asked: pa.Table, logs: pa.Table) -> pa.Table:
    """A shard's lists of cells as lists of log probabilities."""
    key, log = logs.column("key").to_numpy(), logs.column("log").to_numpy()
    order = np.argsort(key)
    wanted = _cells(asked)
    cut = np.concatenate([[0], np.cumsum(pc.list_value_length(asked.column("high")).to_numpy())]).astype(np.int32)
    found = log[order][np.searchsorted(key[order], wanted)]
    return pa.table({"part": asked.column("part"), "shard": asked.column("shard"), "logs": pa.ListArray.from_arrays(pa.array(cut), pa.array(found))})


def cell_logs(known: DataFrame) -> DataFrame:
    """``shard, key, log``: log10 probability of every cell of ``known`` (``shard,
    key, n``: distinct deepest cells with their training counts, 0 if training
    has none)."""
    spark = known.sparkSession
    shards = max(partitions(spark), known.count() >> 18)
    nearest = F.shiftright("key", 8).bitwiseAND(F.lit(mask(TOP)))  # TOP + 1 context bytes
    dealt = lambda d: d.repartition(shards, nearest)
    trained = known.filter("n > 0")
    # sums of decimals do not depend on the order of the rows
    below = (dealt(trained).mapInArrow(_blocks, "level int, node long, block double").groupBy("level", "node")
             .agg(F.sum(F.col("block").cast("decimal(28,9)")).cast("double").alias("block")).toArrow())
    level, node, block = (below.column(c).to_numpy() for c in ("level", "node", "block"))
    top = trained.groupBy(F.col("key").bitwiseAND(F.lit(mask(TOP))).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    levels = by_depth(top.column("key").to_numpy(), top.column("n").to_numpy(), range(TOP + 1))
    shared = spark.sparkContext.broadcast(mixed_tree(levels, below=[(node[level == b], block[level == b]) for b in range(8)]))
    return dealt(known).mapInArrow(_logs(shared), "shard long, key long, log float")


def fit(train: DataFrame, common_words: int = COMMON_WORDS) -> tuple[dict, DataFrame]:
    """(what scoring tasks need, ``key, n`` of the words outside it)."""
    counts = written(train.select("text").mapInArrow(_statistics, "kind int, key long, n long")
                     .groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.filter(F.col("kind") == WORD)
    by_size = words.groupBy(F.floor(F.log2("n")).cast("int").alias("octave")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()
    texts = counts.filter(F.col("kind") == TEXT).agg(F.sum("n")).first()[0] or 0
    least, room = 1, common_words
    for r in sorted(by_size, key=lambda r: -r["octave"]):
        if r["k"] > room:
            least = 1 << (r["octave"] + 1)
            break
        room -= r["k"]
    top = words.filter(F.col("n") >= least).select("key", "n").toArrow()
    key, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(key)
    model = {"words": key[order], "logs": np.log10(n[order] + 1.0), "texts": texts,
             "tokens": sum(r["n"] for r in by_size) + texts, "distinct": sum(r["k"] for r in by_size) + (texts > 0)}
    return model, words.filter(F.col("n") < least).select("key", "n")


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, n_bytes long, score double"
PARTS = ("part long, row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, n_bytes long, text string, "
         "keys array<long>, times array<int>, shard long, high array<int>, low array<short>, seen array<int>")


def by_shard(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of sorted cells by shard, first place of each shard)."""
    shard = (mix64(key.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _parts(shared, shards):
    """Rows of the texts, numbered and in parts, with their sums over common
    words; and rows (``row`` is null) with the distinct cells of a part and how
    often its training texts have them, a row for each shard."""
    schema = pa.schema([("part", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("logs", pa.float64()), ("n_bytes", pa.int64()), ("text", pa.string()), ("keys", pa.list_(pa.int64())),
                        ("times", pa.list_(pa.int32())), ("shard", pa.int64()), ("high", pa.list_(pa.int32())), ("low", pa.list_(pa.int16())), ("seen", pa.list_(pa.int32()))])

    def batch(n, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def cell_rows(part, held):
        key, n = _merged(held)
        order, cut = by_shard(key, shards)
        some = np.flatnonzero(np.diff(cut))
        off = pa.array(np.append(cut[some], len(key)).astype(np.int32))
        lists = {"high": (key[order] >> 16).astype(np.uint32).view(np.int32), "low": key[order].astype(np.uint16).view(np.int16), "seen": n[order].astype(np.int32)}
        yield batch(len(some), part=np.full(len(some), part), shard=some, **{c: pa.ListArray.from_arrays(off, pa.array(v)) for c, v in lists.items()})

    def run(batches):
        m = shared.value
        row = part = TaskContext.get().partitionId() << 33
        held, size = [], 0
        for b in chunks(batches, limit=CHUNK):
            data, off = utf8(b.column("text"), lower=True)
            if held and size + len(data) > PART:
                yield from cell_rows(part, held)
                part, held, size = row, [], 0
            size += len(data)
            cell, first = cells(data, off)
            kinds, which = np.unique(cell, return_inverse=True)
            learnt = np.repeat(~b.column("held_out").to_numpy(zero_copy_only=False), np.diff(first))
            held.append((kinds, np.bincount(which, learnt, minlength=len(kinds))))
            words = split_bytes(data, off)
            text = words.text_of()
            unique, back = np.unique(words.hash, return_inverse=True)
            at = np.minimum(np.searchsorted(m["words"], unique), max(len(m["words"]) - 1, 0))
            known = (m["words"][at] == unique) if len(m["words"]) else np.zeros(len(unique), bool)
            logs = np.where(known, m["logs"][at], 0.0) if len(m["words"]) else np.zeros(len(unique))
            n = b.num_rows
            # the rest of each text's words, with how often it has them
            other = np.flatnonzero(~known[back])
            pair, times = np.unique(np.stack([text[other], back[other]], axis=1), axis=0, return_counts=True) if len(other) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
            cut = np.searchsorted(pair[:, 0], np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v, kind)) for v, kind in ((unique[pair[:, 1]].view(np.int64), pa.int64()), (times, pa.int32()))]
            yield batch(n, part=np.full(n, part), row=np.arange(row, row + n), doc_id=b.column("doc_id"), held_out=b.column("held_out"),
                        n_tokens=np.diff(words.first) + 1, n_known=np.bincount(text, known[back], minlength=n).astype(np.int64),
                        logs=np.bincount(text, logs[back], minlength=n), n_bytes=np.diff(off), text=b.column("text"), keys=lists[0], times=lists[1])
            row += n
        if held:
            yield from cell_rows(part, held)
    return run


def _score(shards):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Scores of a part's texts from the log probabilities of its cells."""
        held = []
        for b in chunks(docs.to_batches(), limit=CHUNK):
            cell, first = cells(*utf8(b.column("text"), lower=True))
            kinds, which = np.unique(cell, return_inverse=True)
            held.append((kinds, which.astype(np.int32), first))
        key = np.unique(np.concatenate([h[0] for h in held]))
        log = np.empty(len(key))
        log[by_shard(key, shards)[0]] = _of_lists(answers.sort_by("shard"), "logs")
        score = [sums_by_text(log[np.searchsorted(key, kinds)][which], first) for kinds, which, first in held]
        return docs.drop_columns(["part", "text"]).append_column("score", pa.array(np.concatenate(score)))
    return run


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    and ``bits_per_byte`` (code length of the model) for every row of ``docs``."""
    out = held_out(7, 2)
    model, rare = fit(docs.filter(~out))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shards = max(partitions(docs.sparkSession), model["tokens"] >> 20)
    parts = written(docs.select("doc_id", out.alias("held_out"), "text").mapInArrow(_parts(shared, shards), PARTS), "lm-parts")
    lists = parts.filter("row is null")
    known = lists.select("shard", "high", "low", "seen").groupBy("shard").applyInArrow(_distinct, "shard long, key long, n long")
    logs = written(cell_logs(written(known, "lm-cells")), "lm-logs")
    answers = (lists.select("part", "shard", "high", "low").groupBy("shard").cogroup(logs.withColumnRenamed("shard", "of").groupBy("of"))
               .applyInArrow(_answers, "part long, shard long, logs array<float>"))
    texts = parts.filter("row is not null")
    d = (texts.select("part", "row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "n_bytes", "text").groupBy("part")
         .cogroup(answers.withColumnRenamed("part", "of").groupBy("of")).applyInArrow(_score(shards), SCORED))
    asked = (texts.select("row", F.explode(F.arrays_zip("keys", "times")).alias("w"))
             .select("row", F.col("w.keys").alias("key"), F.col("w.times").alias("times")))
    more = (asked.join(rare, "key").groupBy("row")
            .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum("times").alias("more_known")))
    texts, tokens, distinct = model["texts"], model["tokens"], model["distinct"]
    d = d.join(more, "row", "left")
    base = (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(math.log10(texts + 1))
            - F.col("n_tokens") * F.lit(math.log10(tokens + distinct + 1)))
    known = F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(texts > 0))
    bits = -F.col("score") * F.lit(math.log2(10)) / (F.col("n_bytes") + 1)
    return d.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
                    base.alias("base_score"), "score", bits.alias("bits_per_byte"))
