"""Helpers shared by the training-data operators: written intermediates and
vectorised word splitting over Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

WHITESPACE = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHUNK_BYTES = 1 << 19


_SCOPE = ["tables"]


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's written intermediates, in the shared folder."""
    return f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{_SCOPE[-1]}"


@contextmanager
def scratch(spark: SparkSession):
    """Intermediates written inside are deleted at the end: compute or write
    what depends on them before."""
    _SCOPE.append(f"scope-{uuid.uuid4().hex[:12]}")
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    try:
        yield
    finally:
        _SCOPE.pop()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts lineage: a lost
    executor costs a re-read, not a recomputation)."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null id: null)."""
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(n))


def held_out(n: int, remainder: int, col: str = "doc_id") -> Column:
    """True where the id's crc32 leaves ``remainder``; a null id is not held out."""
    return F.coalesce(crc_mod(col, n) == remainder, F.lit(False))


def word_array(text: Column) -> Column:
    """Words of a text as an array; empty for null or blank text."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_GAP))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``limit`` bytes of text; one
    longer text is a piece of its own.  Memory then follows the longest text,
    not the batch."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < b.num_rows:
            done = size[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield b.slice(i, j - i)
            i = j


def utf8(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts on end, offsets of each text); null is empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return data, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of a 64-bit hash (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: Kind of each byte for splitting: 0 is a gap; a word is a run of one kind.
NOT_BLANK = np.ones(256, np.uint8)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = 0
LETTERS = np.zeros(256, np.uint8)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class Words(NamedTuple):
    """Words of several texts on end: 64-bit hashes, byte ranges, and the first
    word of each text (``first`` has one entry more than there are texts)."""
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, from prefix sums of a polynomial in an
    odd base (invertible modulo 2^64), so equal ranges hash alike anywhere."""
    n = len(data)
    powers = np.cumprod(np.full(n, _BASE, np.uint64))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers, out=prefix[1:])
    back = np.cumprod(np.full(n + 1, _INVERSE, np.uint64))
    return mix64((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64))


def split_bytes(data: np.ndarray, off: np.ndarray, kinds: np.ndarray = NOT_BLANK) -> Words:
    """Split texts, given as bytes and offsets, into runs of one kind."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64))
    kind = kinds[data]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    word = kind > 0
    start = np.flatnonzero(word & edge[:-1])
    end = np.flatnonzero(word & edge[1:]) + 1
    return Words(spans_hash(data, start, end), start, end, np.searchsorted(start, off))


def split_words(col: pa.Array, lower: bool = False, kinds: np.ndarray = NOT_BLANK) -> Words:
    """Split each text of an Arrow column; by default at runs of space, tab,
    LF, VT, FF and CR."""
    return split_bytes(*utf8(col, lower), kinds)


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text's range."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p) - np.log1p(-p)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def binary_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Temperature that minimises log loss of ``sigmoid(z / T)`` on a grid
    (1 if there is nothing to fit)."""
    if len(y) < 2 or y.min() == y.max():
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 61))
    loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def bounded_sample(df: DataFrame, label: str, per_label: int, seed: int = 17) -> DataFrame:
    """About ``per_label`` different rows of each label value (all, if there are
    fewer), chosen by a hash of the whole row: the same rows at any partitioning,
    whatever ids repeat or are null.  Equal rows come once; ``weight`` is the
    number of rows a chosen row stands for.  Shares of the label values are
    joined, not listed, so there may be any number of them."""
    top = (1 << 53) - 1
    place = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns], *[F.col(c).isNull() for c in df.columns]).bitwiseAND(F.lit(top))
    rows = df.filter(F.col(label).isNotNull()).withColumn("_place", place)
    shares = rows.groupBy(label).agg(F.count_distinct("_place").alias("_n"))
    shares = written(shares.select(F.col(label).alias("_label"), F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("_n")).alias("_share")), "shares")
    kept = rows.join(shares, (rows[label] == shares["_label"]) & (F.col("_place") <= F.col("_share") * top))
    return (kept.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"), F.first("_share").alias("_share"))
            .select(*df.columns, (F.col("_copies") / F.col("_share")).alias("weight")))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_label: int) -> DataFrame:
    """Bounded training sample ``doc_id, text, y, weight``: one row for each of
    about ``per_label`` labelled documents per label value.  Labels are sampled
    first, so only a bounded table is broadcast and texts are not shuffled."""
    marks = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
             .groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("y")))
    marks = written(bounded_sample(marks, "y", per_label), "marks")
    texts = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("weight").alias("weight"))


def fold(n: int, key: str = "doc_id", seed: int = 23) -> Column:
    """A repeatable fold number, unrelated to the held-out remainder."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(n)).cast("int")
