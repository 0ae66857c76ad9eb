"""Operator 12: token ids in bit-plane shuffled, compressed binary files.

Tasks encode whole texts and end each with an end id.  The rows, written once,
are dealt in id order into ranges of about ``FILE_IDS`` ids; a task streams its
range into one file.  Spark's own sinks and readers move the bytes (text sink,
``binaryFile`` source), so files appear by its commit protocol, in any store it
reaches, and a lost task writes its file again.

File: chunk records, an index record, a trailer; Spark's sink puts LF after each.
A chunk is ``CHUNK_IDS`` ids (the last: fewer) of 16 bits, or of 32 where the
vocabulary needs them, transposed into bit planes (plane k holds bit k of every
id) or byte planes, whichever compresses a file's first chunk better, each plane
a zstandard frame of its own; planes of zeros take no room.  The index holds, as
byte planes too, the chunks' places, kinds, plane sizes and ids, the width, and
the file's documents with their ids and lengths, so one document is read by its
chunks alone.  The trailer tells where the index is.  Between the tasks a
document's ids travel as compressed byte planes, too.

Encoding: the library is asked for each distinct piece of text of a task once.
Words are pieces of their own; the vocabulary's pattern allows to cut plain words
(printable ASCII without apostrophe and ``<``, and letters of Latin-1) further,
between letters, digits and other characters, so a text's ids are its pieces'
ids (tested on random texts).  A tokenizer with another pattern encodes by words,
which must not be joined across blanks.

Cases: null and empty texts are one end id; a null id comes first; rows that
share an id ascend by a hash of their ids, equal rows are next to each other;
one text may be longer than a file or a chunk; an empty table writes no ids and
reads no rows.  Further columns are not written.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, scratch_root, utf8, written

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
CHUNK_IDS = 1 << 16
FILE_IDS = 1 << 20
CACHED_PIECES = 1 << 20
PIECE_BYTES = 1 << 21
JOINED = 512
LEVEL = 3
MAGIC = b"idplane1"
BITS, BYTES = 0, 1
#: Kind of a byte: 0 blank, 1 letter, 2 digit, 3 other; 4 keeps its word whole.
KIND = np.full(256, 4, np.uint8)
KIND[33:127] = 3
KIND[[32, 9, 10, 11, 12, 13]] = 0
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2
KIND[[ord("'"), ord("<")]] = 4
LATIN = 0xC3  # first byte of the letters from U+00C0 to U+00FF; two of these are signs
SIGNS = (0x97, 0xB7)
WHOLE = r"['<\x00-\x20\x7f-\x{bf}\x{d7}\x{f7}]|[^\x00-\x{ff}]"  # RE2
#: Fixed value: the pattern of this public vocabulary, for which words may be cut.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_json(name: str = TOKENIZER) -> str:
    """The tokenizer file's text; a path, or the name of a public vocabulary."""
    if not os.path.isabs(name):
        import public_tokenizers
        name = public_tokenizers.path(name)
    with open(name, encoding="utf-8") as f:
        return f.read()


def id_type(tokenizer: str, end_id: int = END_ID) -> str:
    """The least of 16 and 32 bits that holds every id."""
    from tokenizers import Tokenizer
    return "<u2" if max(Tokenizer.from_str(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def pieces(data: np.ndarray, off: np.ndarray, cut: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends of the pieces that are encoded on their own, first
    piece of each text).  Plain words are cut (if ``cut``) and lower-cased."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return data, z, z, np.zeros(len(off), np.int64)
    kind = KIND[data]

    def edges(k):
        edge = np.ones(n + 1, bool)
        edge[1:-1] = k[1:] != k[:-1]
        edge[off] = True
        return edge

    if not cut:
        kind = np.minimum(kind, 1)
        edge = edges(kind)
    else:
        pair = np.flatnonzero(data == LATIN)
        pair = pair[~np.isin(data[pair + 1], SIGNS)]
        kind[pair] = kind[pair + 1] = 1
        word = np.flatnonzero(edges(kind > 0))
        whole = np.repeat(np.maximum.reduceat(kind == 4, word[:-1]), np.diff(word))
        up = (data >= 65) & (data <= 90)
        up[pair + 1] = data[pair + 1] < 0x9F
        data = np.where(up & ~whole, data + 32, data).astype(np.uint8)
        kind = np.where(whole, 5, kind)
        edge = edges(kind)
        digit = kind == 2
        edge[:-1] |= digit
        edge[1:] |= digit
    filled = kind > 0
    place = np.int32 if n < 1 << 31 else np.int64
    start, end = np.flatnonzero(filled & edge[:-1]).astype(place), np.flatnonzero(filled & edge[1:]).astype(place) + place(1)
    return data, start, end, np.searchsorted(start, off.astype(place))


class PieceEncoder:
    """Ids of texts, piece by piece; pieces met before come from a table."""

    def __init__(self, tokenizer: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tokenizer, self._end = Tokenizer.from_str(tokenizer), end_id
        spec = json.loads(tokenizer)
        self.cut = CUT_PATTERN in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\") and spec["model"].get("end_of_word_suffix") == "</w>"
        if self.cut:
            # plain pieces come normalised and cut: only blanks are left to split at
            spec.update(normalizer=None, post_processor=None, added_tokens=[], pre_tokenizer={"type": "Sequence", "pretokenizers": [
                {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
            self._plain = Tokenizer.from_str(json.dumps(spec))
            self._ends = np.zeros(self._plain.get_vocab_size() + len(json.loads(tokenizer)["added_tokens"]), bool)
            self._ends[[i for w, i in self._plain.get_vocab().items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """An empty table; its piece 0 is the end of a text."""
        self._known, self._ids = pa.array([b"\n"], pa.large_binary()), np.array([self._end], np.uint32)
        self._begin, self._size = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids of all words in that order on end, number of each)."""
        words = words.cast(pa.large_string())
        plain = ~pc.match_substring_regex(words, WHOLE).to_numpy(zero_copy_only=False) & self.cut
        words = words.to_pylist()
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        ids, sizes = [], []
        for k in range(0, int(plain.sum()), JOINED):
            group = order[k:min(k + JOINED, int(plain.sum()))]
            (e,) = self._plain.encode_batch_fast([" ".join([words[i] for i in group])], add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            last = np.flatnonzero(self._ends[ids[-1]])  # every plain piece ends with one end-of-word token
            if len(last) != len(group):
                raise ValueError("the vocabulary's words do not end in end-of-word tokens")
            sizes.append(np.diff(last, prepend=-1))
        each = [e.ids for e in self._tokenizer.encode_batch_fast([words[i] for i in order[int(plain.sum()):]], add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        ids.append(np.fromiter(chain.from_iterable(each), np.uint32, int(sizes[-1].sum())))
        return order, np.concatenate(ids), np.concatenate(sizes)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of some distinct words."""
        if len(self._known) > CACHED_PIECES:
            self._forget()
        # the few words are hashed, not the long table
        at = pc.index_in(self._known, value_set=words)
        known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        out = np.full(len(words), -1)
        out[at.drop_null().to_numpy()] = known
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            order, ids, size = self._ids_of(fresh)
            out[new[order]] = len(self._known) + np.arange(len(order))
            self._begin = np.concatenate([self._begin, len(self._ids) + np.cumsum(size) - size])
            self._size, self._ids = np.concatenate([self._size, size]), np.concatenate([self._ids, ids])
            self._known = pa.concat_arrays([self._known, fresh.take(pa.array(order))])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, where each text begins and the last ends)."""
        data, start, end, first = pieces(*utf8(texts), cut=self.cut)
        # pieces and gaps as one array over the same bytes; then the pieces only
        n = len(start)
        ends = np.empty(2 * n + 1, start.dtype)
        ends[:-1:2], ends[1::2], ends[-1] = start, end, len(data)
        spans = pa.Array.from_buffers(pa.large_binary() if ends.itemsize == 8 else pa.binary(), 2 * n, [None, pa.py_buffer(ends), pa.py_buffer(data)])
        coded = spans.take(pa.array(np.arange(0, 2 * n, 2, dtype=start.dtype))).dictionary_encode()
        del data, start, end, ends, spans  # the chunk's arrays are many times its text
        number = self._numbers(coded.dictionary.cast(pa.large_binary()))
        # an end after the pieces of each text
        which = np.insert(number[coded.indices.to_numpy()] if len(number) else np.zeros(0, np.int64), first[1:], 0)
        del coded
        size = self._size[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self._begin[which] - upto[:-1], size)
        at += np.arange(upto[-1])
        return self._ids[at], upto[first + np.arange(len(first))]


def packed(codec: "_Codec", ids: np.ndarray) -> bytes:
    """A document's ids on their way to its file."""
    planes = codec.pack(ids, BYTES)
    return np.array([len(ids), *map(len, planes)], "<u4").tobytes() + b"".join(planes)


def unpacked(codec: "_Codec", blob: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    n, *sizes = np.frombuffer(blob, "<u4", 1 + width)
    return codec.unpack(blob[4 + 4 * width:], sizes, int(n), BYTES, dtype)


def encoded(docs: DataFrame, tokenizer: str, dtype: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids`` (:func:`packed`), ``n_tokens``, ``row`` (a number within
    the task) and ``digest``, a hash of the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        coder, codec, row = PieceEncoder(shared.value, end_id), _Codec(), 0
        for b in chunks(batches, limit=PIECE_BYTES):
            ids, at = coder.encode(b.column("text"))
            ids = ids.astype(dtype)
            blobs = [packed(codec, ids[a:z]) for a, z in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(blobs, pa.binary()), pa.array(np.diff(at), pa.int64()), pa.array(np.arange(row, row + b.num_rows), pa.int64())],
                names=["doc_id", "ids", "n_tokens", "row"])
            row += b.num_rows

    return (docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n_tokens long, row long")
            .withColumn("digest", F.xxhash64("ids")))


def planes_of(values: np.ndarray, kind: int) -> list[bytes]:
    """Planes of unsigned integers, lowest first; empty where all zero."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    if kind == BYTES:
        return [p.tobytes() if p.any() else b"" for p in raw]
    out = []
    for byte in raw:
        bits = np.packbits((byte[None, :] >> np.arange(8, dtype=np.uint8)[:, None]) & 1, axis=1) if byte.any() else np.zeros((8, 0), np.uint8)
        out += [p.tobytes() if p.any() else b"" for p in bits]
    return out


def from_planes(planes: list[bytes], n: int, kind: int, dtype: str) -> np.ndarray:
    """The integers of ``planes_of``."""
    width = np.dtype(dtype).itemsize
    raw = np.zeros((width, n), np.uint8)
    for k, p in enumerate(planes):
        if not p:
            continue
        if kind == BYTES:
            raw[k] = np.frombuffer(p, np.uint8)
        else:
            raw[k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << np.uint8(k % 8)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


class _Codec:
    """Zstandard frames of planes, one context a task."""

    def __init__(self, level: int = LEVEL):
        import zstandard
        self._pack = zstandard.ZstdCompressor(level=level).compress
        self._unpack = zstandard.ZstdDecompressor().decompress

    def pack(self, values: np.ndarray, kind: int) -> list[bytes]:
        return [self._pack(p) if p else b"" for p in planes_of(values, kind)]

    def smallest(self, values: np.ndarray) -> tuple[int, list[bytes]]:
        both = [(kind, self.pack(values, kind)) for kind in (BITS, BYTES)]
        return min(both, key=lambda x: sum(map(len, x[1])))

    def unpack(self, blob, sizes, n: int, kind: int, dtype: str) -> np.ndarray:
        ends = np.cumsum(sizes)
        planes = [self._unpack(blob[e - s:e]) if s else b"" for s, e in zip(sizes, ends)]
        return from_planes(planes, n, kind, dtype)


def _column(codec: _Codec, values) -> bytes:
    """A column of the index: its length, its plane sizes, its byte planes."""
    values = np.asarray(values, np.int64)
    planes = codec.pack(values, BYTES)
    return np.array([len(values), *map(len, planes)], "<i8").tobytes() + b"".join(planes)


def _read_columns(codec: _Codec, blob: bytes, count: int) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(count):
        n, *sizes = np.frombuffer(blob, "<i8", 9, at)
        at += 72
        out.append(codec.unpack(blob[at:at + sum(sizes)], sizes, int(n), BYTES, "<i8") if n else np.zeros(0, np.int64))
        at += int(sum(sizes))
    return out


def file_records(batches: Iterator[pa.RecordBatch], dtype: str = "<u4", chunk_ids: int = CHUNK_IDS) -> Iterator[bytes]:
    """Records of one file from its documents (``doc_id, ids``) in order."""
    codec, held, room, width = _Codec(), [], 0, np.dtype(dtype).itemsize
    place, starts, kinds, sizes, counts = 0, [], [], [], []
    docs: dict[str, list] = {"doc_id": [], "known": [], "n": []}

    def record(ids: np.ndarray) -> bytes:
        nonlocal place
        kind, planes = (kinds[0], codec.pack(ids, kinds[0])) if kinds else codec.smallest(ids)
        starts.append(place)
        kinds.append(kind)
        sizes.extend([*map(len, planes), *[0] * (32 - len(planes))])
        counts.append(len(ids))
        blob = b"".join(planes)
        place += len(blob) + 1  # the sink's LF
        return blob

    for b in batches:
        for doc_id, blob in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
            ids = unpacked(codec, blob, dtype)
            for key, v in zip(docs, (doc_id or 0, doc_id is not None, len(ids))):
                docs[key].append(v)
            held.append(ids)
            room += len(ids)
            if room >= chunk_ids:
                rest = np.concatenate(held)
                while len(rest) >= chunk_ids:
                    yield record(rest[:chunk_ids])
                    rest = rest[chunk_ids:]
                held, room = [rest], len(rest)
    if not docs["n"]:
        return
    if room:
        yield record(np.concatenate(held))
    index = b"".join(_column(codec, c) for c in ([width], starts, kinds, sizes, counts, *docs.values()))
    yield index
    yield np.array([place, len(index)], "<i8").tobytes() + MAGIC


INDEX_COLUMNS = ("width", "starts", "kinds", "sizes", "counts", "doc_id", "known", "n")


class TokenFile:
    """Random access to one file's bytes."""

    def __init__(self, content: bytes):
        body = content[:-1]  # the sink's LF after the trailer
        if body[-8:] != MAGIC:
            raise ValueError("not a token file")
        place, size = np.frombuffer(body[-24:-8], "<i8")
        self._content, self._codec = content, _Codec()
        self.index = dict(zip(INDEX_COLUMNS, _read_columns(self._codec, content[place:place + size], len(INDEX_COLUMNS))))
        self._first = np.concatenate([[0], np.cumsum(self.index["counts"])])
        self.doc_starts = np.concatenate([[0], np.cumsum(self.index["n"])])

    def chunk(self, k: int) -> np.ndarray:
        x = self.index
        sizes = x["sizes"][32 * k:32 * k + 32]
        at = int(x["starts"][k])
        return self._codec.unpack(self._content[at:at + int(sizes.sum())], sizes, int(x["counts"][k]), int(x["kinds"][k]), f"<u{x['width'][0]}")

    def documents(self) -> Iterator[np.ndarray]:
        """Ids of each document in turn; a chunk is unpacked once."""
        k, held, base = 0, np.zeros(0, f"<u{self.index['width'][0]}"), 0
        for a, b in zip(self.doc_starts[:-1], self.doc_starts[1:]):
            parts = [held[a - base:b - base]]
            while self._first[k] < b:  # the chunk at hand, ``held``, begins at id ``base``
                held, base, k = self.chunk(k), self._first[k], k + 1
                parts.append(held[:b - base])
            yield np.concatenate(parts) if len(parts) > 1 else parts[0]

    def document(self, i: int) -> np.ndarray:
        """Ids of document ``i`` from its chunks alone."""
        a, b = self.doc_starts[i], self.doc_starts[i + 1]
        k, last = np.searchsorted(self._first, a, side="right") - 1, np.searchsorted(self._first, b)
        ids = np.concatenate([self.chunk(j) for j in range(k, last)])
        return ids[a - self._first[k]:b - self._first[k]]


def write_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Write the ids of ``docs`` (``doc_id, text``) under ``path`` as files of
    about ``file_ids`` ids, whole documents in ascending id order."""
    tokenizer = tokenizer_json(tokenizer)
    dtype = id_type(tokenizer, end_id)
    rows = written(encoded(docs, tokenizer, dtype, end_id), "token-ids")
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), "digest", "row"]
    dealt = rows.repartitionByRange(max(1, math.ceil(total / file_ids)), *order).sortWithinPartitions(*order)

    def run(batches):
        for r in file_records(batches, dtype):
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.binary())], names=["record"])

    records = dealt.select("doc_id", "ids").mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 0).text(path)


def read_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the files under ``path``: ``doc_id, start`` (ids of all
    documents before it), ``n_tokens, ids_crc32`` and, if wanted, ``ids`` as an
    array.  Files follow each other by the number of Spark's part."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def sizes(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                if content:
                    yield pa.RecordBatch.from_pydict({"path": [name], "total": [int(TokenFile(content).doc_starts[-1])]})

    def documents(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                if not content:
                    continue
                f = TokenFile(content)
                ids, known, n = (f.index[c] for c in ("doc_id", "known", "n"))
                out = {"path": [], "doc_id": [], "place": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                held = 0
                for i, x in enumerate(f.documents()):
                    values = (name, ids[i].item() if known[i] else None, f.doc_starts[i].item(), n[i].item(), zlib.crc32(x.astype("<u4").tobytes()), x.tolist() if with_ids else None)
                    for key, v in zip(out, values):
                        out[key].append(v)
                    held += len(x)
                    if held > FILE_IDS:
                        yield pa.RecordBatch.from_pydict(out, schema)
                        out, held = {k: [] for k in out}, 0
                yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("path", pa.string()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                        ("ids", pa.list_(pa.int64()))])
    before = file_offsets(written(files.mapInArrow(sizes, "path string, total long"), "token-index"))
    rows = files.mapInArrow(documents, "path string, doc_id long, place long, n_tokens long, ids_crc32 long, ids array<long>")
    return (rows.join(before, "path")
            .select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])))


def file_offsets(index: DataFrame) -> DataFrame:
    """``path, before`` (ids of all files before it) from ``path, total``.  Parts
    are added up by thousands first, so a window holds 1,024 files or one row for
    each 1,024 of them."""
    part = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"part-(\d+)", 1).cast("long")
    d = index.withColumn("part", part).withColumn("group", F.floor(F.col("part") / 1024))
    upto = Window.unboundedPreceding, -1
    groups = d.groupBy("group").agg(F.sum("total").alias("all"))
    groups = groups.select("group", F.coalesce(F.sum("all").over(Window.orderBy("group").rowsBetween(*upto)), F.lit(0)).alias("base"))
    own = F.sum("total").over(Window.partitionBy("group").orderBy("part").rowsBetween(*upto))
    return (d.withColumn("own", F.coalesce(own, F.lit(0))).join(groups, "group")
            .select("path", (F.col("base") + F.col("own")).alias("before")))


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write the files to the shared folder and read all documents back."""
    import uuid

    spark = docs.sparkSession
    path = f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex[:12]}"
    write_files(docs, path, tokenizer, end_id)
    return read_files(spark, path, with_ids=False)
