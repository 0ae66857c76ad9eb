"""Merkle manifest against a plain recursion over lists."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stayrisk.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def climb(nodes):
    """The root of ``nodes`` and the (left, right) siblings of each."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = at[i] - at[i] % 16
            p.append(("".join(nodes[run:at[i]]), "".join(nodes[at[i] + 1:run + 16])))
        nodes = [sha(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)]
        at = [a // 16 for a in at]
    return nodes[0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = climb([leaf(r, r["text"]) for r in by[s]])
    root, tops = climb([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for r, path in zip(by[s], trees[s][1]):
            start = h = leaf(r, r["text"])
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                h = leaf(r, lower(r["text"]))
            for a, b in path + top:
                h = sha(a, h, b)
            out.append((-1 if r["doc_id"] is None else r["doc_id"], start, trees[s][0], root, "".join(a + b for a, b in path + top), h))
    return sorted(out)


def found(docs):
    cols = ("leaf", "subroot", "root", "proof", "folded_root")
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *[r[c] for c in cols])
                  for r in merkle.manifest(docs, merkle.tampered()).collect())


def test_matches_recursion(docs, edge_docs):
    for d in (docs, edge_docs):
        assert found(d) == plain(d.collect())


def test_three_levels_many_sources_and_repeats(spark):
    """A source over two rounds of blocks, one of a lone leaf, a null one, more
    than 16 sources, 300 rows of one id and 300 without id, equal rows."""
    rows = [(i, f"Text {i}", "en", "big", i) for i in range(0, 5000)]
    rows += [(9_999_999_999, f"Same {i % 280}", None, "big", 1) for i in range(300)]
    rows += [(None, f"None {i % 290}", "en", None, 1) for i in range(300)]
    rows += [(7, "Lone", "en", f"s{k}é", None) for k in range(40)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("x")).withColumn("pos", F.lit(3)).withColumn("seg", F.lit("y"))
    assert found(d) == plain(d.collect())


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257])
def test_sizes_at_the_edges(spark, n):
    d = spark.createDataFrame([(i - 3, None if i % 7 == 0 else f"T{i}", None, "a", 2) for i in range(n)], SCHEMA)
    got = found(d)
    assert got == plain(d.collect())
    assert n > 1 or (got[0][1] == got[0][3] and got[0][4] == "")


def test_empty(no_docs):
    assert found(no_docs) == []


def test_block_tasks_stay_small(spark):
    """No block of a hot source holds more than 256 nodes."""
    rows = merkle.placed(merkle.leaves(spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(1).alias("n_chars"))))
    blocks = merkle.build(rows, rows.groupBy("seg").agg(F.count(F.lit(1)).alias("n")), "test")
    assert blocks[0].agg(F.max(F.size("items"))).first()[0] == 256 and [b.count() for b in blocks] == [12, 1]
