"""Vector searches against brute force."""

from __future__ import annotations

import numpy as np

from lodestrata.llm import bitsliced, neighbours
from lodestrata.llm.vectors import usable


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string")


def _odd(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(np.float32(v)) for v in rng.normal(size=8)], 1, "x") for k in range(300)]
    rows += [(k, rows[5][1], 1, "x") for k in range(300, 400)]  # a hundred equal vectors
    rows += [(400, None, 1, "x"), (401, [], 1, "x"), (402, [1.0, None] + [0.0] * 6, 1, "x"), (403, [float("nan")] * 8, 1, "x"), (404, [float("inf")] * 8, 1, "x"), (405, [0.0] * 8, 1, "x"), (None, rows[0][1], 1, "x"), (406, [1.0, 2.0], 1, "x"), (407, [2.0, 1.0], 1, "x")]
    rows += [rows[7]]
    return rows


def test_bit_sliced_is_exact(spark):
    rows = _odd(spark)
    df = _vectors(spark, rows)
    got = {}
    for r in bitsliced.search(df.filter("vec_id % 20 = 0 or vec_id >= 405"), df, 10, blocks=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {k: np.floor(1024 * np.array(v, np.float64)).astype(int) for k, v, *_ in rows if k is not None and v and None not in v and np.isfinite(v).all()}
    for q in [k for k in good if k % 20 == 0 or k >= 405]:
        scores = sorted(((-int(good[q] @ v), k) for k, v in good.items() if k != q and len(v) == len(good[q])))[:10]
        assert sorted(got[q]) == [(i + 1, k, -s) for i, (s, k) in enumerate(scores)]


def test_slices_hold_any_numbers():
    rng = np.random.default_rng(2)
    for size, high in ((1, 3), (70, 1 << 20), (1000, 5), (130, 1), (300, 1 << 40), (200, 1 << 31)):
        values = rng.integers(-high, high + 1, (size, 6))
        values[: size // 20] *= 1000  # some rows far outside
        block = bitsliced.SlicedBlock(np.arange(size), values.astype(float), 7)
        for query in (rng.integers(-high, high + 1, 6), np.zeros(6, int)):
            rows, scores = block.top(query.astype(float), 7)
            exact = [min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(v, query.tolist(), strict=True)))) for v in values.tolist()]
            assert [(-int(s), int(r)) for r, s in zip(rows, scores, strict=True)] == sorted((-s, k) for k, s in enumerate(exact))[:7]


def _table(data):
    import pyarrow.parquet as pq

    rows = pq.read_table(data, columns=["embedding"])["embedding"].to_pylist()
    return np.array([r for r in rows if r and len(r) == 64 and None not in r], np.float64)


def test_few_rows_are_at_the_boundary():
    values = np.floor(1024 * _table("/root/testdata/sf0.1/embeddings.parquet"))
    for outlier in (False, True):
        if outlier:  # one huge component must not make the slices coarse for all others
            values[7, 3] = 70_000 * 1024
        block = bitsliced.SlicedBlock(np.arange(len(values)), values, 10)
        shares = []
        for query in values[::50]:
            at = block.boundary(query, 11)
            shares.append(len(at) / len(values))
            assert set(np.lexsort((np.arange(len(values)), -(values @ query)))[:11]) <= set(at.tolist())
        assert block.skipped.all() and np.mean(shares) < 0.1, np.mean(shares)


def test_large_components_take_part(spark, oracle):
    import duckdb

    rows = [(1, [70_000.0, 1.0]), (2, [1.0, 2.0]), (3, [-70_000.0, 0.5]), (100, [1.0, 2.0]), (200, [3.0, -65_536.0]), (300, [0.0, 0.0])]
    got = bitsliced.search(_vectors(spark, [(*r, 1, "") for r in rows]).filter("vec_id % 100 = 0"), _vectors(spark, [(*r, 1, "") for r in rows]), 10).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(tuple(r) for r in got) == sorted(con.execute(bitsliced.OP6_SQL).fetchall())
    assert {(r.query_id, r["rank"]): r.vec_id for r in got}[(100, 1)] == 1


def test_huge_doubles_saturate(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [1.0, 1.0]), (100, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in sorted(bitsliced.search(df.filter("vec_id = 100"), df, 10).collect(), key=lambda r: r["rank"])]
    assert got == [(1, 2**63 - 1), (3, 3 * 1024 * 1024), (2, -(2**63))]


def test_nearest_of_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(5)
    for scale in (1e-200, 1e200):
        rows = [(k, [float(v) for v in rng.normal(size=6) * scale]) for k in range(30)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = {}
        for r in neighbours.search(df, df, 40, blocks=3).collect():
            found.setdefault(r.query_id, []).append(r.vec_id)
        assert all(sorted(own) == [k for k in range(30) if k != q] for q, own in found.items()) and len(found) == 30


def test_few_candidates_are_all_found(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(v) for v in rng.normal(size=64)]) for k in range(15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert neighbours.search(df.filter("vec_id < 3"), df, 20).count() == 3 * 14


def test_recall_and_visits_over_blocks(spark):
    x = _table("/root/testdata/sf0.1/embeddings.parquet")
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids = np.array([r.vec_id for r in df.select("vec_id").collect()])
    got = {}
    for r in neighbours.search(df.filter("vec_id % 20 = 0"), df, 20, blocks=4).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        s = x @ x[at]
        s[at] = -np.inf
        hits += len(got[ids[at]] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
        total += 20
    scale = np.abs(x).max()
    longest = np.sqrt(((x / scale) ** 2).sum(1).max())
    share = neighbours.fitted_share(x, 20, scale, longest)
    assert hits / total >= 0.9 and share < 0.35, (hits / total, share)


def test_nearest_recall_and_order(spark):
    rows = _odd(spark)
    df = _vectors(spark, rows)
    found = {}
    for r in neighbours.search(df.filter("vec_id % 20 = 0"), df, 20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {k: np.array(v, np.float64) for k, v, *_ in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    hits = total = 0
    for q in [k for k in good if k % 20 == 0 and len(good[k]) == 8]:
        own = sorted(found[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert [(-s, k) for _, k, s in own] == sorted((-s, k) for _, k, s in own)
        assert all(abs(s - float(good[q] @ good[k])) < 1e-9 and k != q for _, k, s in own)
        near = sorted((-float((good[q] * v).sum()), k) for k, v in good.items() if k != q and len(v) == 8)[:20]
        # equal vectors are as good as each other
        least = -near[-1][0]
        hits += sum(s >= least - 1e-9 for _, _, s in own)
        total += 20
    assert hits / total >= 0.9


def test_recall_on_the_table(spark, data):
    rows = neighbours.op1_nearest(spark, data).collect()
    table = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    ids = np.array(sorted(table))
    x = np.array([table[k] for k in ids])
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ table[q]
        s[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
        total += 20
    assert hits / total >= 0.9


def test_empty(spark):
    df = _vectors(spark, _odd(spark)).limit(0)
    assert bitsliced.search(df, df, 10).count() == 0
    assert neighbours.search(df, df, 10).count() == 0


def test_usable_keeps_one_row_of_an_id(spark):
    df = _vectors(spark, [(1, [2.0, 1.0], 0, ""), (1, [1.0, 5.0], 0, ""), (2, [0.0, 0.0], 0, "")])
    assert [(r.vec_id, r.embedding) for r in usable(df, zeros=False).collect()] == [(1, [1.0, 5.0])]
    assert usable(df, zeros=True).count() == 2
