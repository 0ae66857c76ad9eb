"""Token files: exact round trip against whole-text encoding."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stayrisk.llm import token_files as tf


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(tf.tokenizer_json())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [tf.END_ID]


def expected(rows, encode):
    """(doc_id, n_tokens, crc) in order and the start of each; ties in id are free."""
    out = sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(encode(r["text"]))) for r in rows)
    return [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in out]


def check(got, want):
    got = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == [w[0] for w in want]  # ascending
    assert sorted((i, r["n_tokens"], r["ids_crc32"]) for i, r in zip(ids, got)) == sorted(want)


@pytest.mark.parametrize("file_ids", [tf.FILE_IDS, 3000])
def test_round_trip(spark, docs, edge_docs, encode, tmp_path, file_ids):
    for k, d in enumerate((docs, edge_docs)):
        tf.write_files(d, f"{tmp_path}/{k}", file_ids=file_ids)
        rows = tf.read_files(spark, f"{tmp_path}/{k}").collect()
        check(rows, expected(d.collect(), encode))
        for r in rows:
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_empty(spark, no_docs):
    assert tf.round_trip(no_docs).count() == 0


def test_no_hot_task_for_equal_rows(spark, tmp_path):
    """Rows alike in id and text still spread over the files."""
    d = spark.createDataFrame([(None, "one two three four")] * 2000 + [(5, "x")], "doc_id long, text string")
    tf.write_files(d, f"{tmp_path}/same", file_ids=1000)
    index = spark.read.format("binaryFile").load(f"{tmp_path}/same").collect()
    n = [len(tf.TokenFile(bytes(r["content"])).index["n"]) for r in index if r["length"]]
    assert sum(n) == 2001 and len(n) >= 6 and max(n) < 800


words = st.text(alphabet=st.one_of(st.sampled_from("<|endoftext|>StARTOF.,-_(=0 \x1c\x7f \t\n\r\x0b\x0c 　\u0085̸́ΣσςİßDŽ'<|>sStT9é漢😀"), st.characters(exclude_categories=("Cs",))), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(words, st.text("aBz9 .,'s<|endoftext|>=\u0338\u0301\n", max_size=30), st.sampled_from(
    ["a<|endoftext|>b <|ENDOFTEXT|>", "x'S 'Stop don'T", "=\u0338 I\u0307", "12,3.4--5e6", "A\u0301,b"])), max_size=6))
def test_words_encode_like_whole_texts(texts):
    global _CODER, _WHOLE
    if "_CODER" not in globals():
        from tokenizers import Tokenizer
        _CODER, _WHOLE = tf.PieceEncoder(tf.tokenizer_json()), Tokenizer.from_str(tf.tokenizer_json())
    ids, at = _CODER.encode(pa.array(texts, pa.string()))
    assert len(at) == len(texts) + 1
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == _WHOLE.encode(t, add_special_tokens=False).ids + [tf.END_ID]


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 300_000, "#" * 300_000, "ab " * 100_000])
def test_very_long_texts(text, encode):
    ids, at = tf.PieceEncoder(tf.tokenizer_json()).encode(pa.array([None, text, ""]))
    assert ids[at[1]:at[2]].tolist() == encode(text) and at.tolist() == [0, 1, len(ids) - 1, len(ids)]


def test_encoding_memory_is_bounded():
    """8 MB of short pieces: a task's arrays stay small, whatever the batch holds."""
    coder, text = tf.PieceEncoder(tf.tokenizer_json()), " ".join(["an", "a1", "it", "-x"] * 320)
    batch = pa.RecordBatch.from_pydict({"text": [text] * 2200})
    tracemalloc.start()
    try:
        for b in tf.chunks(iter([batch]), limit=tf.PIECE_BYTES):
            coder.encode(b.column("text"))
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from([tf.BITS, tf.BYTES]))
def test_planes(values, kind):
    v = np.array(values, np.uint32)
    planes = tf.planes_of(v, kind)
    assert len(planes) == (32 if kind == tf.BITS else 4)
    assert (tf.from_planes(planes, len(v), kind, "<u4") == v).all()
    if kind == tf.BITS and len(v):
        for k, p in enumerate(planes):
            bits = np.unpackbits(np.frombuffer(p, np.uint8), count=len(v)) if p else np.zeros(len(v))
            assert (bits == (v >> k) & 1).all()


def test_random_access_across_chunks():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n, dtype=np.uint32) for n in (1, 30, 500, 1, 64, 63, 7)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [3, None, 4, 4, 9, 10, 11], "ids": [tf.packed(tf._Codec(), d) for d in docs]})
    content = b"".join(r + b"\n" for r in tf.file_records(iter([batch]), chunk_ids=64))
    f = tf.TokenFile(content)
    assert f.index["counts"].tolist() == [64] * 10 + [666 - 640]
    assert all((a == b).all() for a, b in zip(f.documents(), docs))
    assert all((f.document(i) == d).all() for i, d in enumerate(docs))
