"""Near-duplicates against all pairs, tiling against a plain greedy search."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from stayrisk.llm import decontam, near_dup
from stayrisk.llm.common import split_words


def labelled(text, k=5):
    w = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    grams = [tuple(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
    seen: Counter = Counter()
    out = []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def ordered_similarity(a, b):
    """Longest common subsequence by the full dynamic programme."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def groups(rows):
    grams = {i: labelled(t or "") for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i, _ in rows if grams[i]]
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            a, b = grams[i], grams[j]
            common = sum((Counter(a) & Counter(b)).values())
            if common >= 0.8 * (len(a) + len(b) - common) and ordered_similarity(a, b) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def families(seed=2):
    """Texts with edited copies around the threshold, chains, and one passage in many."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "nu", "re", "so"]) for _ in range(rnd.randint(2, 5)))
    passage, rows = [word() for _ in range(14)], []
    for f in range(12):
        base = [word() for _ in range(rnd.randint(60, 120))]
        if f % 2:
            base[5:5] = passage
        rows.append(" ".join(base))
        for _ in range(rnd.randint(2, 14)):
            copy = list(base)
            for _ in range(rnd.randint(0, 5)):
                at = rnd.randrange(len(copy))
                if rnd.random() < 0.3:
                    del copy[at]
                else:
                    copy[at] = word()
            rows.append(" ".join(copy).upper() if rnd.random() < 0.2 else " ".join(copy))
        rows.append(" ".join(base[len(base) // 2:] + base[:len(base) // 2]))  # the halves swapped
    rows += [" ".join(passage + [word() for _ in range(25)]) for _ in range(40)]
    rows += ["one two three", "one two three", "One  two\nthree", "", "", "  ", "four five"]
    order = list(range(len(rows)))
    rnd.shuffle(order)
    return [(i, rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("seed", [2, 9])
def test_classes_equal_all_pairs(spark, seed):
    rows = families(seed)
    got = near_dup.near_dups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = groups(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_two_stars_of_one_centre(spark, monkeypatch):
    """Copies that share edits: stars move to the hub of another star, and a
    member of both comes to the pair filter once."""
    rnd = random.Random(0)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "nu", "re", "so"]) for _ in range(rnd.randint(2, 5)))
    rows = []
    for _ in range(8):
        base = [word() for _ in range(90)]
        shared = [(rnd.randrange(90), word()) for _ in range(6)]
        rows.append(" ".join(base))
        for _ in range(40):
            copy = list(base)
            for at, w in rnd.sample(shared, rnd.randint(0, 2)) + [(rnd.randrange(90), word()) for _ in range(rnd.randint(0, 3))]:
                copy[at] = w
            rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    stars, open_pairs = [], near_dup.open_pairs

    def noted(spokes, *rest):
        stars.extend((bytes(r["a"]), bytes(r["b"])) for r in spokes.select("a", "b").collect())
        return open_pairs(spokes, *rest)

    monkeypatch.setattr(near_dup, "open_pairs", noted)
    got = near_dup.near_dups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(stars) == len(set(stars)) > 300
    # families have no word in common by more than chance: all pairs of each
    want = {}
    for f in range(0, len(rows), 41):
        want |= groups(rows[f:f + 41])
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_documents_of_the_smallest_table(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: r["class_id"] for r in near_dup.near_dups(docs).collect()} == groups(rows)


def test_similarity_is_the_banded_optimum():
    rnd = random.Random(1)
    for _ in range(200):
        a = [rnd.randrange(12) for _ in range(rnd.randint(8, 40))]
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randrange(len(b))
            b[at:at + 1] = rnd.choice([[], [rnd.randrange(12)], [rnd.randrange(12), 99]])
        x, y = " ".join(map(str, a)), " ".join(map(str, b))
        k = lambda t: near_dup.kmers(split_words(pa.array([t]), lower=True))[0]
        want = ordered_similarity(labelled(x), labelled(y))
        got = near_dup.similarity(k(x), k(y))
        assert (got >= 0.8) == (want >= 0.8)
        if want >= 0.8:
            assert got == pytest.approx(want)


def test_near_dup_edges(spark, edge_docs, no_docs):
    got = near_dup.near_dups(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["class_id"] == 1 and by[2]["class_id"] == 2 and by[3]["class_id"] == 3  # no words: never grouped
    assert by[5]["class_id"] == by[9]["class_id"] == 5 and by[None]["class_id"] == 5 and not by[None]["kept"]
    assert by[7]["class_id"] == 6 and not by[7]["kept"]
    kept = near_dup.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert near_dup.near_dups(no_docs).count() == 0 and near_dup.keep_one(no_docs).count() == 0


def greedy_cover(item, text, width):
    """Words of ``item`` covered by greedy string tiling, by plain search."""
    in_item, in_text, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while (i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]
                       and i + n not in in_item and j + n not in in_text):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < width:
            return covered
        covered += n
        in_item.update(range(i, i + n))
        in_text.update(range(j, j + n))


def test_tiling_matches_plain_search():
    rnd = random.Random(5)
    for _ in range(60):
        item = [rnd.choice("abcdefgh") for _ in range(rnd.randint(6, 25))]
        text = [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 10))]
        for _ in range(3):
            at = rnd.randrange(len(item))
            text += item[at:at + rnd.randint(2, 12)] + [rnd.choice("abcdxyz")]
        block = decontam.make_block(pa.table({"item_id": pa.array([3]), "text": [" ".join(item)]}))
        found = list(decontam.leaks(pa.array([" ".join(text)]), block, 0.01))
        got = round(found[0][2] * len(item)) if found else 0
        assert got == greedy_cover(item, text, decontam.MIN_MATCH)


def test_tiling_of_few_different_words_matches_plain_search():
    rnd = random.Random(6)
    for n in (1, 2, 2, 3) * 12:
        item = [rnd.choice("abc"[:n]) for _ in range(rnd.randint(4, 22))]
        text = [rnd.choice("abcx"[:n + rnd.randint(0, 1)]) for _ in range(rnd.randint(0, 40))]
        block = decontam.make_block(pa.table({"item_id": pa.array([1, 3]), "text": ["x y z x y", " ".join(item)]}))
        found = [f for f in decontam.leaks(pa.array(["", " ".join(text), None]), block, 0.01) if f[1] == 1]
        assert sum(m for f in found for m, _, _ in f[3]) == greedy_cover(item, text, decontam.MIN_MATCH)
        for t, _, covered, tiles in found:
            assert t == 1 and covered == pytest.approx(sum(m for m, _, _ in tiles) / len(item))
            assert all(item[i:i + m] == text[j:j + m] for m, i, j in tiles)
            places = [j + k for m, _, j in tiles for k in range(m)]
            assert len(set(places)) == len(places)


def test_a_million_equal_words_take_bounded_memory():
    import tracemalloc
    items = [" ".join(["w"] * 200), " ".join(["w"] * 100 + ["v"] + ["w"] * 99), " ".join(["v"] * 50)]
    block = decontam.make_block(pa.table({"item_id": pa.array([1, 2, 3]), "text": items}))
    text = pa.array(["w " * 1_000_000])
    tracemalloc.start()
    found = list(decontam.leaks(text, block))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(t, m, c) for t, m, c, _ in found] == [(0, 0, 1.0), (0, 1, 0.995)]
    assert found[1][3] == [(100, 0, 0), (99, 101, 100)]
    assert peak < 300e6  # 1.97e8 seed matches with the first item alone


def test_leaks_whole_reordered_and_clean(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rnd = random.Random(4)
    rows = []
    for i, t in items:
        w = t.split()
        cut = [0, len(w) // 3, 2 * len(w) // 3, len(w)]
        parts = [w[a:b] for a, b in zip(cut, cut[1:])]
        rnd.shuffle(parts)
        rows += [(i * 10, "before " + t.upper() + " after"), (i * 10 + 1, " filler words ".join(" ".join(p) for p in parts)),
                 (i * 10 + 2, " ".join(w[:len(w) // 4]) + " and then something else"), (i * 10 + 3, None), (i * 10 + 4, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (decontam.BLOCK_WORDS, 300):
        found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(d, bench, block_words=words).collect()}
        assert {(i * 10, i) for i, _ in items} <= found and {(i * 10 + 1, i) for i, _ in items} <= found
        assert not [x for x in found if x[0] % 10 > 1]
    assert sorted(r["doc_id"] % 10 for r in decontam.clean(d, bench).collect()) == [2] * len(items) + [3] * len(items) + [4] * len(items)


def test_leak_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (None, "one two three four five six"), (None, "one two three four five six")], "item_id long, text string")
    assert decontam.find_leaks(edge_docs, bench).count() == 0
    out = decontam.clean(edge_docs, bench)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    hit = spark.createDataFrame([(None, "One, two; three. FOUR five six!")] * 2, "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(hit, bench).collect()] == [(None, None)] * 2
    assert decontam.find_leaks(no_docs, bench).count() == 0 and decontam.clean(no_docs, bench).count() == 0
    assert decontam.find_leaks(edge_docs, bench.limit(0)).count() == 0 and decontam.clean(edge_docs, bench.limit(0)).count() == edge_docs.count()


def test_joined_components(spark):
    """Edges between labelled and unlabelled nodes merge their components."""
    b = lambda *xs: [bytes([x]) for x in xs]
    labels = spark.createDataFrame(list(zip(b(1, 2, 3, 4, 5, 6), b(1, 1, 3, 3, 5, 5))), "node binary, label binary")
    edges = spark.createDataFrame(list(zip(b(2, 6, 9), b(4, 8, 10))), "a binary, b binary")
    got = {r["node"][0]: r["label"][0] for r in near_dup.joined(labels, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 8: 5, 9: 9, 10: 9}
    assert {r["node"][0]: r["label"][0] for r in near_dup.joined(labels, edges.limit(0)).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
