"""Operator 3: quality rules as a short-circuit cascade, in native expressions.

A rule is a predicate over a text's words that is true for a text to reject.
On a random sample the operator counts each rule's cost (work units) and
selectivity (share rejected of what earlier rules pass) and orders the rules by
rejection per cost.  The
cascade is one ``CASE``: a later rule's expression is evaluated only where all
earlier ones passed.  The verdict is a conjunction, so the order changes the
time, never the result.

Cases: null and empty texts have no words and are rejected as too short; ids
may be null or repeated; other columns pass through; an empty table gives no
rows (and keeps the rules in their stated order).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, word_array, written

GRAM = 8
SAMPLE_ROWS = 2000


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WHITESPACE)) != "")
    return bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column, gram: int = GRAM) -> Column:
    """Words covered by windows of ``gram`` words that occur twice or more.
    Windows are compared by 64-bit hashes inside one text.  Only a text with a
    repeated window pays for the sort that finds the positions."""
    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def at(sorted_: Column) -> Column:
            n = F.size(sorted_)
            twice = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (
                ((k > 0) & (F.get(sorted_, k - 1)["h"] == F.get(sorted_, k)["h"]))
                | ((k < n - 1) & (F.get(sorted_, k + 1)["h"] == F.get(sorted_, k)["h"]))))
            where = F.array_sort(F.transform(twice, lambda k: F.get(sorted_, k)["i"]))
            return bind(where, lambda w: F.aggregate(
                F.transform(w, lambda p, j: F.when(j == F.size(w) - 1, F.lit(gram)).otherwise(
                    F.least(F.lit(gram), F.get(w, j + 1) - p))),
                F.lit(0).cast("long"), lambda a, x: a + x))
        return bind(placed, at)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (gram - 1)), lambda i: F.xxhash64(F.slice(words, i, gram)))
    found = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) <= gram, F.lit(0).cast("long")).otherwise(found)


class Rule(NamedTuple):
    """``rejects(text, words)`` is true for a text to reject; ``work(text,
    words)`` counts the work that takes: characters read, times passes."""
    name: str
    rejects: Callable[[Column, Column], Column]
    work: Callable[[Column, Column], Column] = lambda t, w: F.length(t)


def too_short(words_n: Column) -> Column:
    return words_n < 20


def too_repetitive(repeat: Column, words_n: Column) -> Column:
    return 100 * repeat > 30 * words_n


def too_symbolic(symbols: Column, words_n: Column) -> Column:
    return 100 * symbols > 20 * words_n


def too_many_dup_lines(dup: Column, lines: Column) -> Column:
    return 100 * dup > 50 * lines


def odd_word_length(chars: Column, words_n: Column) -> Column:
    return (chars < 2 * words_n) | (chars > 20 * words_n)


def too_loud(capitals: Column, chars: Column) -> Column:
    return 100 * capitals > 50 * chars


# Passes of a rule over its characters, from times of each rule alone on 2,000
# documents: a pass for a plain pattern; capitals are cut out of small pieces;
# every word is hashed in ``GRAM`` windows, which are then compared.
PIECES, WINDOWS = 4, 2 * GRAM
RULES = (
    Rule("short", lambda t, w: too_short(F.size(w)), lambda t, w: F.lit(1)),
    Rule("symbols", lambda t, w: too_symbolic(n_symbols(t), F.size(w))),
    Rule("word_length", lambda t, w: odd_word_length(word_chars(w), F.size(w)), lambda t, w: word_chars(w)),
    Rule("capitals", lambda t, w: too_loud(F.length(F.regexp_replace(t, "[^A-Z]+", "")), word_chars(w)), lambda t, w: PIECES * F.length(t)),
    Rule("dup_lines", lambda t, w: too_many_dup_lines(n_dup_lines(t), F.size(F.split(t, "\n")))),
    Rule("repeats", lambda t, w: too_repetitive(n_repeat_words(w), F.size(w)), lambda t, w: WINDOWS * word_chars(w)),
)


def rule_order(costs: list[float], patterns: list[tuple[tuple[bool, ...], int]]) -> list[tuple[int, float]]:
    """(rule number, share rejected) in cascade order.  The next rule is always
    the one that rejects most per cost among the sample's rows that no earlier
    rule rejects; ties go to the cheaper, then the first.  ``patterns`` counts
    sample rows by the rules that reject them."""
    left, out = list(range(len(costs))), []
    while left:
        alive = sum(n for _, n in patterns)
        share = {r: sum(n for hit, n in patterns if hit[r]) / alive if alive else 0.0 for r in left}
        best = min(left, key=lambda r: (-share[r] / costs[r], costs[r], r))
        out.append((best, share[best]))
        left.remove(best)
        patterns = [(hit, n) for hit, n in patterns if not hit[best]]
    return out


def plan(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[dict]:
    """Rules in cascade order: ``name, cost`` (work units a row), ``rejected``
    (share of the rows that the rules before it pass), by rejection per cost.
    About ``sample_rows`` rows from all over the table are measured, in one
    aggregate of a row per set of rules that reject; the sample decides the
    order alone.  Costs are counted, not timed: reruns give the same order."""
    n = docs.count()
    if not n:
        return [{"name": r.name, "cost": 0.0, "rejected": 0.0} for r in rules]
    text = F.coalesce("text", F.lit(""))
    part = docs.sample(min(1.0, sample_rows / n), seed) if n > sample_rows else docs
    sample = written(part.select(text.alias("text"), word_array(text).alias("words")), "rules-sample")
    t, w = F.col("text"), F.col("words")
    hits = F.array(*[F.coalesce(r.rejects(t, w), F.lit(False)) for r in rules])
    work = [F.sum(r.work(t, w).cast("long")).alias(f"work{k}") for k, r in enumerate(rules)]
    found = sample.groupBy(hits.alias("hits")).agg(F.count(F.lit(1)).alias("n"), *work).collect()
    rows = max(1, sum(r["n"] for r in found))
    costs = [max(1.0, sum(r[f"work{k}"] for r in found) / rows) for k in range(len(rules))]
    order = rule_order(costs, [(tuple(r["hits"]), r["n"]) for r in found])
    return [{"name": rules[r].name, "cost": costs[r], "rejected": share} for r, share in order]


def cascade(text: Column, words: Column, order: list[str], rules=RULES) -> Column:
    """True if no rule rejects; rules are tried in ``order``."""
    by = {r.name: r for r in rules}
    out = None
    for name in order:
        hit = by[name].rejects(text, words)
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass every rule, columns unchanged."""
    order = [r["name"] for r in plan(docs, rules)]
    text = F.coalesce("text", F.lit(""))
    return docs.filter(bind(word_array(text), lambda w: cascade(text, w, order, rules)))


def measure(docs: DataFrame) -> DataFrame:
    """Rule features and verdict of every row: ``doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.  What a rule
    needs beyond these is worked out inside the cascade, where it is reached."""
    text = F.coalesce("text", F.lit(""))
    order = [r["name"] for r in plan(docs)]
    d = docs.select("doc_id", text.alias("text"), word_array(text).alias("words"))
    d = d.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), word_chars(F.col("words")).alias("word_chars"),
        n_symbols(F.col("text")).alias("n_symbols"), n_dup_lines(F.col("text")).alias("n_dup_lines"),
        n_repeat_words(F.col("words")).alias("n_repeat_words"), "text")
    known = (
        Rule("short", lambda t, w: too_short(F.col("n_words"))),
        Rule("symbols", lambda t, w: too_symbolic(F.col("n_symbols"), F.col("n_words"))),
        Rule("word_length", lambda t, w: odd_word_length(F.col("word_chars"), F.col("n_words"))),
        Rule("capitals", lambda t, w: too_loud(F.length(F.regexp_replace(t, "[^A-Z]+", "")), F.col("word_chars"))),
        Rule("dup_lines", lambda t, w: too_many_dup_lines(F.col("n_dup_lines"), F.size(F.split(t, "\n")))),
        Rule("repeats", lambda t, w: too_repetitive(F.col("n_repeat_words"), F.col("n_words"))),
    )
    failed = too_short(F.col("n_words")) | too_repetitive(F.col("n_repeat_words"), F.col("n_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), cascade(F.col("text"), F.array(), order, known).alias("kept"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
grams AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS capitals, len(ls) AS n_lines
  FROM w LEFT JOIN covered c ON w.rid = c.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 20 * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * capitals > 50 * word_chars
            OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM m
"""
