"""Quality rules and line dedup against plain Python; their SQL twins on sf0.001."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayrisk.llm import line_dedup, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"


def features(text):
    t = text or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def verdict(text):
    n, chars, symbols, dup, repeat = features(text)
    t = text or ""
    capitals, lines = len(re.findall("[A-Z]", t)), len(t.split("\n"))
    return not (n < 20 or 100 * repeat > 30 * n or 100 * symbols > 20 * n or chars < 2 * n or chars > 20 * n
                or 100 * capitals > 50 * chars or 100 * dup > 50 * lines)


def test_rule_features_and_verdict(spark, docs, edge_docs):
    again = " ".join(f"w{i}" for i in range(12))
    more = spark.createDataFrame([(900, f"{again} mid {again} {again}"), (901, "a a a a a a a a a a a a"), (902, "l m\nl m\n\nl m")], "doc_id long, text string")
    for d in (docs.select("doc_id", "text"), edge_docs.select("doc_id", "text"), more):
        rows, plain = quality_rules.measure(d).collect(), d.collect()
        got = sorted(tuple(-1 if v is None else v for v in r) for r in rows)
        want = sorted((-1 if r["doc_id"] is None else r["doc_id"], *features(r["text"]),
                       features(r["text"])[0] < 20 or 100 * features(r["text"])[4] > 30 * features(r["text"])[0], verdict(r["text"])) for r in plain)
        assert got == want


def test_cascade_keeps_rows_whole_in_any_order(spark, edge_docs, no_docs):
    kept = quality_rules.keep(edge_docs)
    assert kept.columns == edge_docs.columns
    assert kept.count() == sum(verdict(r["text"]) for r in edge_docs.collect())
    text = F.coalesce("text", F.lit(""))
    for names in ([r.name for r in quality_rules.RULES], [r.name for r in quality_rules.RULES[::-1]]):
        passed = quality_rules.bind(quality_rules.word_array(text), lambda w: quality_rules.cascade(text, w, names))
        assert edge_docs.filter(passed).count() == kept.count()
    assert quality_rules.keep(no_docs).count() == 0 and quality_rules.measure(no_docs).count() == 0


def test_order_is_by_rejection_per_cost_among_survivors():
    rows = [((True, True, False), 50), ((False, True, False), 10), ((False, False, True), 20), ((False, False, False), 20)]
    # the second rule rejects most; what it leaves of the first is nothing
    assert quality_rules.rule_order([1.0, 1.0, 1.0], rows) == [(1, 0.6), (2, 0.5), (0, 0.0)]
    assert quality_rules.rule_order([1.0, 4.0, 1.0], rows) == [(0, 0.5), (2, 0.4), (1, 10 / 30)]
    assert quality_rules.rule_order([4.0, 1.0], [((False, False), 3)]) == [(1, 0.0), (0, 0.0)]
    assert quality_rules.rule_order([1.0, 1.0], []) == [(0, 0.0), (1, 0.0)]


def test_plan_puts_the_cheap_rule_first_and_the_dear_one_last_every_time(docs):
    dear = quality_rules.Rule("dear", lambda t, w: F.size(w) < 60, lambda t, w: 1000 * F.length(t))
    cheap = quality_rules.Rule("cheap", lambda t, w: F.size(w) < 50, lambda t, w: F.lit(1))
    covered = quality_rules.Rule("covered", lambda t, w: F.size(w) < 49)
    for rules in ((dear, cheap, covered), (covered, dear, cheap)) * 2:
        p = quality_rules.plan(docs, rules)
        assert [x["name"] for x in p] == ["cheap", "dear", "covered"] and p[2]["rejected"] == 0
    p = quality_rules.plan(docs)
    assert {x["name"] for x in p} == {r.name for r in quality_rules.RULES}
    assert all(quality_rules.plan(docs) == p for _ in range(9))


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def deduped(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                holders[key(line)].add(i)
    often = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in often or often[key(x)] == i]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_matches_plain(spark, docs, edge_docs):
    hot, odd = "The Same Line In Many Documents, Again And Again.", "é" * 39 + "ñ"
    rows = [(i, f"own line {i} of this very document, not shared at all\n \t{hot.upper() if i % 2 else hot} \n{odd if i < 4 else 'z'}\n{hot}") for i in range(300)]
    rows += [(None, hot), (None, hot), (7, rows[7][1]), (500, None), (501, ""), (502, "\n\n")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for d in (made, docs.select("doc_id", "text"), edge_docs.select("doc_id", "text")):
        plain = [(r["doc_id"], r["text"]) for r in d.collect()]
        got = line_dedup.dedup_lines(d, counts=True).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == deduped(plain)


def test_line_dedup_keeps_other_columns(edge_docs, no_docs):
    out = line_dedup.dedup_lines(edge_docs)
    assert out.columns == edge_docs.columns and out.exceptAll(edge_docs).count() == 0
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_perfect_hash_is_minimal():
    rnd = np.random.default_rng(1)
    a, b = (rnd.integers(0, 2 ** 63, 20000, dtype=np.uint64) for _ in range(2))
    a[:50] = a[0]  # told apart by the second half
    mph = line_dedup.PerfectHash.build(a, b)
    assert sorted(mph.index(a, b).tolist()) == list(range(20000))
    again = line_dedup.PerfectHash(mph.sizes, np.frombuffer(mph.bits.tobytes(), np.uint8))
    assert (again.index(a, b) == mph.index(a, b)).all()


def test_hot_shards_are_copied(spark):
    """A line of two thirds of the documents spreads over copies of its shard."""
    hot = "a line that two thirds of all documents hold, word for word"
    rows = [(i, hot if i % 3 else f"a line that only document number {i} holds, and no other") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.dedup_lines(d, counts=True).agg(F.sum("n_dropped")).first()[0] == 2000 - 1


@pytest.mark.parametrize("name", ["op3_quality_rules", "op8_line_dedup"])
def test_sql_twin(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    a, b = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLE[name]).df()
    order = lambda x: x[sorted(x.columns)].sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(a), order(b))
