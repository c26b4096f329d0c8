"""The similarity join against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from lodestrata.llm import jaccard
from lodestrata.llm.common import joined_evenly
from lodestrata.llm.components import components


def plain(rows: list[tuple], words: int = 4, percent: int = 85):
    """(doc_id, set size, component) of each row, by looking at all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[top(i)] = top(j)
    least: dict = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(k)] = min(least.get(top(k), doc), doc)
    return Counter((doc, len(sets[k]), least.get(top(k))) for k, (doc, _) in enumerate(rows))


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS node", "3 AS label")
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked_rows(df, **how).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_like_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    rows, k = [], 0
    for _ in range(25):  # groups of copies with some words changed, around the bound
        base = [word() for _ in range(rng.choice([3, 6, 20, 80, 200]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((k, " ".join(copy)))
            k += 1
    base = [word() for _ in range(150)]
    for _ in range(70):  # one large group, in which lists are long and pairs lie on both sides of the bound
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = word()
        rows.append((k, " ".join(copy)))
        k += 1
    rng.shuffle(rows)
    want = plain(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, long=20) == want  # lists cut into blocks


def test_odd(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(spark, rows) == plain(rows)
    assert jaccard.linked_rows(no_docs).count() == 0


def test_other_parameters(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "a b c"), (4, "A  b\tc"), (5, "c b a")]
    assert found(spark, rows, words=2, percent=70) == plain(rows, 2, 70)


def test_the_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op9_jaccard_join(spark, data).collect())
    assert got == plain(rows)


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, 500)] + [(700, k) for k in range(701, 760)]
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_answers_derived_from_a_leader_are_right(spark):
    rng = random.Random(4)
    base = list(range(200))
    sets = {k: set(rng.sample(base, 200 - k % 20)) | set(range(1000 + 90 * k, 1000 + 90 * k + 3 * (k % 25))) for k in range(40)}
    pairs = [(a, b, len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a in sets for b in sets if a < b]
    seen = spark.createDataFrame([p for p in pairs if p[0] in (0, 1)], "a long, b long, n_a long, n_b long, both long")
    left = spark.createDataFrame([p[:4] for p in pairs if p[0] > 1], "a long, b long, n_a long, n_b long")
    got = {(r.a, r.b): r.linked for r in jaccard.settled_by_leaders(left, seen, 80).collect()}
    want = {p[:2]: 100 * p[4] >= 80 * (p[2] + p[3] - p[4]) for p in pairs if p[0] > 1}
    assert got.keys() == want.keys()
    assert all(got[k] in (None, want[k]) for k in want)
    assert sum(x is not None for x in got.values()) > len(got) / 10 and {True, False} <= set(want.values())


def test_sets_whose_digests_clash(spark, monkeypatch):
    rows = [(k, " ".join(f"w{k % 5}_{i}" for i in range(30))) for k in range(12)]
    real = jaccard._digests
    monkeypatch.setattr(jaccard, "_digests", lambda t, c: (real(t, c)[0] % 2 + 1 if len(t) else real(t, c)[0], real(t, c)[1]))
    want = plain(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked_rows(df).collect()) == want


def test_hot_keys_are_joined_in_place(spark):
    rows = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k")
    known = rows.groupBy("k").count().selectExpr("k", "count AS met", "k * 2 AS v")
    out = joined_evenly(rows, known, "met", ["k"])
    assert sorted((r.id, r.v) for r in out.collect()) == sorted((i, -2 if i % 3 == 0 else 2 * i) for i in range(6000))
    assert joined_evenly(rows.limit(0), known.limit(0), "met", ["k"]).count() == 0


def test_a_very_long_text(spark):
    long = " ".join(f"word{k % 5000}x{k}" for k in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, "a b c d e"), (4, "x" * 3_000_000)]
    assert found(spark, rows) == plain(rows)
