"""Operator 8: drop lines that many documents repeat, by probing a sharded
minimal perfect hash.

A line's key is the line stripped of blanks, A-Z lower-cased.  Keys of at least
``MIN_CHARS`` code points become 128-bit hashes.  The distinct hashes, with
their document counts and largest ids, are cut into shards; a task builds for
its shard a minimal perfect hash (levels of bit arrays, each placing the keys
that sit alone in their slot) over compact arrays of fingerprints, counts and
keepers.  Lines then travel as (hash, place) to their shard's arrays and probe
them; there is no join of lines with lines.  A shard that more probes ask for
than ``SPLIT`` times the mean is copied and its probes are dealt over the
copies, so a line found in a third of all documents is not one task's work.
Dropped places go back to the documents as sorted line numbers.

Documents are told apart by (id, text hash), so null or repeated ids are fine:
a null id does not count as a document and never is the keeper; rows equal in
id and text have the same lines dropped.  Null or empty text is one empty
line.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WHITESPACE, mix64, partitions, written

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 1 << 16
SPLIT = 3
_LEVEL = 0x9E3779B97F4A7C15
_BLOCK = 512  # bits between stored ranks
_NO_KEEPER = np.iinfo(np.int64).min


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(WHITESPACE)), UPPER, UPPER.lower())


class PerfectHash:
    """Minimal perfect hash of distinct (a, b) pairs of 64-bit integers:
    ``index`` maps each of n keys to its own place in 0..n-1.  Other keys map
    to some place or to -1; a fingerprint tells most of them."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        ones = np.unpackbits(np.concatenate([bits, np.zeros(-len(bits) % (_BLOCK // 8), np.uint8)])).reshape(-1, _BLOCK)
        self.ranks = np.concatenate([[0], np.cumsum(ones.sum(axis=1, dtype=np.int64))])
        self._within = (np.cumsum(ones, axis=1, dtype=np.int16) - ones).ravel()
        self._one = ones.ravel().astype(bool)

    @staticmethod
    def _slot(a, b, level: int, size: int):
        step = np.uint64(_LEVEL * (level + 1) % (1 << 64))
        return (mix64(a ^ mix64(b + step)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, gamma: float = 1.7) -> "PerfectHash":
        sizes, parts = [], []
        while len(a):
            size = max(8, -(-int(gamma * len(a)) // 8) * 8)
            slot = cls._slot(a, b, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone))
            left = ~alone[slot]
            a, b = a[left], b[left]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint8))

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        todo, base = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._slot(a[todo], b[todo], level, size)
            hit = self._one[at]
            found = at[hit]
            out[todo[hit]] = self.ranks[found // _BLOCK] + self._within[found]
            todo, base = todo[~hit], base + size
        return out


def fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix64(b ^ mix64(a)) >> np.uint64(32)).astype(np.uint32)


SHARD_SCHEMA = "shard long, sizes array<int>, bits binary, prints binary, counts binary, keepers binary, asked long"


def build_shard(t: pa.Table) -> pa.Table:
    """Arrays of one shard from its rows ``shard, a, b, n, keeper, asked``."""
    a, b = (t.column(c).to_numpy().view(np.uint64) for c in "ab")
    mph = PerfectHash.build(a, b)
    place = mph.index(a, b)
    prints, counts, keepers = np.zeros(len(a), np.uint32), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    prints[place] = fingerprint(a, b)
    counts[place] = t.column("n").to_numpy()
    keepers[place] = t.column("keeper").fill_null(_NO_KEEPER).to_numpy()
    row = {"shard": t.column("shard")[0].as_py(), "sizes": mph.sizes, "bits": mph.bits.tobytes(), "prints": prints.tobytes(),
           "counts": counts.tobytes(), "keepers": keepers.tobytes(), "asked": int(t.column("asked").to_numpy().sum())}
    kinds = {"sizes": pa.list_(pa.int32()), "shard": pa.int64(), "asked": pa.int64()}
    return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})


def _probe(min_docs: int):
    def probe(asks: pa.Table, shard: pa.Table) -> pa.Table:
        """Places whose line is in ``min_docs`` documents or more and is kept elsewhere."""
        a, b = (asks.column(c).to_numpy().view(np.uint64) for c in "ab")
        get = lambda c, kind: np.frombuffer(shard.column(c)[0].as_py(), kind)
        at = PerfectHash(shard.column("sizes")[0].as_py(), get("bits", np.uint8)).index(a, b)
        known = at >= 0
        known[known] = get("prints", np.uint32)[at[known]] == fingerprint(a, b)[known]
        at = np.where(known, at, 0)
        ids = asks.column("doc_id")
        keeper = get("keepers", np.int64)[at]
        kept = (ids.fill_null(0).to_numpy() == keeper) & ids.is_valid().to_numpy() & (keeper != _NO_KEEPER)
        drop = known & (get("counts", np.int64)[at] >= min_docs) & ~kept
        return asks.select(["doc_id", "text_hash", "line"]).filter(pa.array(drop))
    return probe


def line_index(lines: DataFrame, n_shards: int) -> DataFrame:
    """The sharded index of ``lines`` (``doc_id, a, b``): one row per shard."""
    counts = lines.groupBy("a", "b").agg(
        F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"), F.count(F.lit(1)).alias("asked"))
    return (counts.withColumn("shard", F.pmod("a", F.lit(n_shards)))
            .groupBy("shard").applyInArrow(build_shard, SHARD_SCHEMA))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, text_hash, drops``: sorted numbers of the lines to drop, for
    the documents that lose any."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    lines = (docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line", "value"))
             .filter(F.length("value") >= min_chars)
             .select("doc_id", "text_hash", "line", line_key(F.col("value")).alias("key"))
             .filter(F.length("key") >= min_chars)
             .select("doc_id", "text_hash", "line", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b")))
    lines = written(lines, "lines")
    total = lines.count()
    n_shards = max(partitions(spark), math.ceil(total / SHARD_KEYS), 1)
    index = written(line_index(lines, n_shards), "line-index")
    # copies of the shards that get far more probes than the mean
    copies = F.greatest(F.lit(1), F.ceil(F.col("asked") / F.lit(SPLIT * max(1, total // n_shards))))
    index = index.withColumn("copies", copies)
    hot = written(index.filter("copies > 1").select("shard", "copies"), "hot-shards")
    asks = (lines.withColumn("shard", F.pmod("a", F.lit(n_shards))).join(hot, "shard", "left")
            .withColumn("copy", F.pmod(F.xxhash64("doc_id", "text_hash", "line"), F.coalesce("copies", F.lit(1))))
            .drop("copies"))
    dealt = index.select(*[c for c in index.columns if c != "copies"], F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    drops = (asks.groupBy("shard", "copy").cogroup(dealt.groupBy("shard", "copy"))
             .applyInArrow(_probe(min_docs), "doc_id long, text_hash long, line int"))
    return (drops.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("drops")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = False) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; all other columns
    pass through.  With ``counts``, also ``n_lines`` (before) and ``n_dropped``."""
    drops = dropped_lines(docs, min_chars, min_docs)
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(text).alias("key"))  # names of further columns cannot clash
    d = d.join(drops, d["row.doc_id"].eqNullSafe(drops["doc_id"]) & (d["key"] == drops["text_hash"]), "left").select("row", "drops")
    lines = F.split(F.coalesce("row.text", F.lit("")), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    slim = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    kept = F.when(F.col("drops").isNull(), F.col("row.text")).otherwise(slim)
    out = [kept.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    if counts:
        out += [F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped")]
    return d.select(*out)


ORACLE_SQL = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT rid, doc_id, i, ls[i] AS line,
         translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)),
often AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.rid, l.doc_id, l.i, l.line, (o.k IS NOT NULL AND l.doc_id IS DISTINCT FROM o.keeper) AS gone
  FROM lines l LEFT JOIN often o ON l.k = o.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
