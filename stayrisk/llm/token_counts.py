"""Operator 6: exact token counts from a length histogram.

Tasks encode whole texts with a byte-level BPE vocabulary (tiktoken ranks, a
file named by path, read once by the driver and broadcast) and hand on only how
many documents have each encoded length.  The histogram's suffix sums, taken in
blocks of lengths, answer totals, quantiles and truncated totals for every
context limit without another look at the texts.

Cases: null and empty texts have 0 tokens and are counted; runs of blanks of any
length are encoded (the library's pattern would recurse once per blank); repeats
count each time; an empty table gives an empty histogram, totals of 0 and null
quantiles.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import global_running_sum
from .common import chunks, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of this public vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH_BLOCK = 1024
LONG_RUN = 4096


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int], pattern: str = PATTERN):
    import tiktoken
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(coder, text: str, long_run=None) -> int:
    """Tokens of a whole text.  The pattern takes a run of blanks, without its
    last one if a word follows, as one piece, so a long run is encoded as that
    piece and the texts around it on their own."""
    if len(text) < LONG_RUN:
        return len(coder.encode_ordinary(text))
    if long_run is None:
        import regex
        long_run = regex.compile(r"\p{White_Space}{%d,}" % LONG_RUN)
    n, done = 0, 0
    for run in long_run.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(coder.encode_ordinary(text[done:run.start()])) + len(coder._encode_single_piece(text[run.start():end].encode()))
        done = end
    return n + len(coder.encode_ordinary(text[done:]))


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``n_tokens, n_docs``: documents of each encoded length."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        import regex
        coder, counts = encoder(shared.value), {}
        long_run = regex.compile(r"\p{White_Space}{%d,}" % LONG_RUN)
        for b in chunks(batches):
            for text in pc.fill_null(b.column("text"), "").to_pylist():
                n = token_count(coder, text, long_run)
                counts[n] = counts.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return (docs.select("text").mapInArrow(run, "n_tokens long, n_docs long")
            .groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))


def suffix_table(histogram: DataFrame) -> DataFrame:
    """One row per length L of ``histogram``: ``n_tokens`` (L), ``n_docs``,
    ``docs_longer``, ``tokens_longer`` (documents above L, their tokens),
    ``total_docs``, ``total_tokens``, ``truncated_total`` (tokens left if every
    text is cut at L) and ``share_at_most`` (documents of at most L tokens)."""
    h = written(histogram, "lengths")
    docs, tokens = h.agg(F.sum("n_docs"), F.sum(F.col("n_docs") * F.col("n_tokens"))).first()
    docs, tokens = docs or 0, tokens or 0
    s = global_running_sum(h, [F.desc("n_tokens")], {"_block": -F.floor(F.col("n_tokens") / LENGTH_BLOCK)},
                           {"docs_longer": F.col("n_docs"), "tokens_longer": F.col("n_docs") * F.col("n_tokens")})
    return s.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer", F.lit(docs).cast("long").alias("total_docs"),
        F.lit(tokens).cast("long").alias("total_tokens"),
        (F.lit(tokens) - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).cast("long").alias("truncated_total"),
        ((F.lit(docs) - F.col("docs_longer")) / F.lit(max(docs, 1))).cast("double").alias("share_at_most"))


def truncated_totals(table: DataFrame, limits: list[int]) -> list[tuple[int, int]]:
    """(limit, tokens left if every text is cut there), for any limits.  Between
    two lengths the total is linear: the next longer length tells how many
    documents are still cut."""
    out = []
    for limit in limits:
        r = table.filter(F.col("n_tokens") <= limit).agg(F.max(F.struct("n_tokens", "truncated_total", "docs_longer"))).first()[0]
        if r is None:  # every text is longer
            docs = table.agg(F.max("total_docs")).first()[0] or 0
            out.append((limit, limit * docs))
        else:
            out.append((limit, r["truncated_total"] + (limit - r["n_tokens"]) * r["docs_longer"]))
    return out


def quantiles(table: DataFrame, shares: list[float]) -> list[tuple[float, int | None]]:
    """(share, smallest length that at least this share of documents does not exceed)."""
    return [(q, table.filter(F.col("total_docs") - F.col("docs_longer") >= F.ceil(F.lit(q) * F.col("total_docs"))).agg(F.min("n_tokens")).first()[0]) for q in shares]
