"""Pivotal mixing: targets by a plain loop, words conserved, expectations kept."""

import re

import pytest
from pyspark.sql import functions as F

from stayrisk.llm import mixing


def water_fill(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by resharing the excess until nobody is above the cap."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * level > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in names}
        full.update(over)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_sizes_and_totals(spark, docs):
    rows = mixing.mix(docs).collect()
    plain = {r["doc_id"]: (r["source"], size(r["text"])) for r in docs.collect()}
    sizes: dict = {}
    for s, n in plain.values():
        sizes[s] = sizes.get(s, 0) + n
    want = water_fill(sizes)
    taken: dict = {}
    for r in rows:
        assert (r["source"], r["size"]) == plain[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        ratio = r["target"] / r["source_size"]
        assert r["copies"] in (int(ratio), int(ratio) + 1) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(rows) == len(plain)
    longest = {s: max(n for t, n in plain.values() if t == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)


def test_many_documents_come_near_the_target_and_reruns_agree(spark):
    d = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    rows = mixing.mix(d).collect()
    by: dict = {}
    for r in rows:
        t = by.setdefault(r["source"], [r["target"], 0])
        t[1] += r["taken"]
    assert all(abs(t - got) <= 97 for t, got in by.values())
    again = mixing.mix(d.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_expected_copies_do_not_depend_on_size(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 2 == 0, 3).otherwise(40)).alias("text"),
                                 F.concat(F.lit("s"), (F.col("id") % 2 * 0 + F.col("id") % 3).cast("string")).alias("source"))
    r = mixing.mix(d).groupBy("source", "size").agg(F.avg("copies").alias("mean"), F.first(F.col("target") / F.col("source_size")).alias("want")).collect()
    assert all(abs(x["mean"] - x["want"]) < 0.06 for x in r)


def test_edges(spark, edge_docs, no_docs):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert {r["size"] for r in rows if r["doc_id"] == 1} == {0}
    assert mixing.mix(no_docs).count() == 0


def test_repeated_rows_share_their_copies(spark):
    d = spark.createDataFrame([(1, "a b c", "s")] * 9000 + [(2, "d e", "t")], "doc_id long, text string, source string")
    r = mixing.mix(d).filter("doc_id = 1").agg(F.count("*").alias("n"), F.sum("taken").alias("t"), F.first("target").alias("w")).first()
    assert r["n"] == 9000 and abs(r["t"] - r["w"]) <= 3
