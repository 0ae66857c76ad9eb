"""The pipeline stage by stage against plain versions."""

import re

import corpus_pipeline as C
from stayrisk.llm import mixing, quality_rules

from .test_near_dup_and_leaks import groups
from .test_rules_and_lines import deduped, verdict


def test_stages_on_the_smallest_table(spark, sf, docs):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "near_dups", "decontamination", "mix_sources"]
    d, columns = docs, docs.columns
    kept = C.quality(spark, d, sf)
    assert kept.columns == columns
    rows = {r["doc_id"]: r for r in d.collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if verdict(r["text"])}

    import hashlib
    lined = C.lines(spark, kept, sf)
    assert lined.columns == columns
    plain = [(r["doc_id"], r["text"]) for r in kept.collect()]
    got = {r["doc_id"]: r for r in lined.collect()}
    assert sorted((i, hashlib.sha256(r["text"].encode()).hexdigest()) for i, r in got.items()) == sorted((x[0], x[3]) for x in deduped(plain))
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    lined = spark.createDataFrame(list(got.values()), lined.schema)
    one = C.near_duplicates(spark, lined, sf)
    assert one.columns == columns
    classes = groups([(i, r["text"]) for i, r in got.items()])
    assert {r["doc_id"] for r in one.collect()} == {i for i, c in classes.items() if i == c}

    clean = C.decontaminate(spark, one, sf)
    assert clean.columns == columns
    bench = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {r["doc_id"] for r in one.collect() if any(" ".join(b) in " ".join(re.findall(r"\w+", r["text"].lower())) for b in bench)}
    left = {r["doc_id"] for r in clean.collect()}
    assert not whole & left and len(left) >= one.count() - len(whole) - 2

    last = C.mix(spark, clean, sf).collect()
    assert {r["doc_id"] for r in last} <= left and all(r["copies"] in (1, 2) for r in last)


def test_run_and_edges(spark, sf, edge_docs, no_docs):
    assert C.run(spark, sf).count() > 0
    for d in (edge_docs, no_docs):
        for _, stage in C.STAGES:
            d = spark.createDataFrame(stage(spark, d, sf).collect(), stage(spark, d, sf).schema) if d is not no_docs else stage(spark, d, sf)
        assert d.count() <= edge_docs.count()
    assert quality_rules.keep(no_docs).columns == no_docs.columns and mixing.mix(no_docs).count() == 0
