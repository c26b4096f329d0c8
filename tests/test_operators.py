"""Cases that the driver's tables don't hold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import binary
from lodestrata.functions.binary import fnv1a
from lodestrata.operators import kv, metrics, order, raftlog, ring, validate
from lodestrata.sources import frames as fr


def test_fnv_of_any_text(spark):
    def plain(text: str) -> int:
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    texts = ["", "a", "node-1#0", "é", "日本", "x" * 300, "\x00a\n", " "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv1a(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in rows} == {t: plain(t) for t in texts}


def test_ring_distribution(spark):
    nodes = spark.createDataFrame([(f"node-{k}",) for k in (1, 2, 3)], "node_id string")
    keys = spark.range(100_000).select(F.concat(F.lit("source-"), F.col("id")).alias("source"))
    load = {r.node_id: r["keys"] for r in ring.load(keys, ring.points(nodes)).collect()}
    assert sorted(load.values()) == [21204, 35416, 43380]
    assert {r.node_id for r in ring.route(keys.limit(3), ring.points(nodes.limit(0))).collect()} == {None}
    only = ring.route(keys.limit(50), ring.points(nodes.filter("node_id = 'node-1'")))
    assert {r.node_id for r in only.collect()} == {"node-1"} and only.count() == 50


def test_log_merge_as_one_by_one(spark):
    rng, follower, leader, want = random.Random(5), [], [], []
    for case in range(60):
        terms = sorted(rng.randint(1, 4) for _ in range(rng.randint(0, 8)))
        start = rng.randint(0, len(terms))
        new = terms[start:]
        if new and rng.random() < 0.6:
            new[rng.randrange(len(new))] += 1
        new += [5] * rng.randint(0, 3)
        old = list(terms)
        for k, t in enumerate(new):
            i = start + k
            if i < len(old) and old[i] != t:
                old = old[:i]
            if i >= len(old):
                old.append(t)
        follower += [(case, i + 1, t) for i, t in enumerate(terms)]
        leader += [(case, start + k + 1, t) for k, t in enumerate(new)]
        want += [(case, i + 1, t) for i, t in enumerate(old)]
    schema = "node long, index long, term long"
    got = raftlog.merged(spark.createDataFrame(follower, schema), spark.createDataFrame(leader, schema), "node")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_truncate_then_append_again(spark):
    rows = [("a", 1, 1, 1, None), ("a", 2, 1, 2, None), ("a", 3, 1, 3, None), ("a", 4, 2, None, 2), ("a", 5, 1, 2, None)]
    records = spark.createDataFrame(rows, "log string, seq long, rec_type int, index long, from_index long")
    assert sorted(r.seq for r in raftlog.truncated(records, "log").collect()) == [1, 5]
    with pytest.raises(ValueError):
        raftlog.truncated(records)


def test_quorums(spark):
    def test(voters, new, acks, joint):
        row = spark.createDataFrame([(voters, new, acks, joint)], "v array<string>, n array<string>, a array<string>, j boolean")
        return row.select(raftlog.quorum(F.col("v"), F.col("n"), F.col("a"), F.col("j")).alias("q")).first().q

    assert test(["a", "b"], [], ["a"], False)
    assert not test(["a", "b"], [], [], False)
    assert test([], [], [], False)
    assert not test(["a", "b"], ["c", "d"], ["a"], True)
    assert test(["a", "b"], ["c", "d"], ["a", "c"], True)


def test_voters_keep_repeats_when_others_leave(spark):
    row = spark.createDataFrame([(["a", "b", "b", "c"],)], "v array<string>")
    left = row.select(raftlog.voters_without(F.col("v"), F.array(F.lit("c"))).alias("v")).first().v
    assert left == ["a", "b", "b"]


def test_percentiles_by_bucket(spark):
    us = [1000] * 50 + [10000] * 40 + [100000] * 10
    rows = spark.createDataFrame([(x,) for x in us], "us long")
    got = {r.pct: r.us for r in metrics.log2_percentiles(metrics.log2_histogram(rows, "us"), (50, 90, 99)).collect()}
    assert got == {50: 1024, 90: 16384, 99: 131072}
    assert [tuple(r) for r in metrics.log2_percentiles(metrics.log2_histogram(rows.limit(0), "us"), (50, 99)).collect()] == [(50, 0), (99, 0)]


def test_lag_is_never_negative(spark):
    rows = spark.createDataFrame([(1000, 600, False), (1000, 1200, True)], "primary_offset long, replica_offset long, reconnected boolean")
    assert tuple(metrics.replication_lag(rows.limit(1)).first()) == (400, 0)
    assert tuple(metrics.replication_lag(rows).first()) == (0, 1)


def test_commands_default_to_set(spark):
    rows = spark.createDataFrame([("", "k"), ("del", "k"), ("incr", "k"), ("set", ""), (None, "k")], "op string, key string")
    assert [(r.effective_op, r.status) for r in validate.commands(rows).collect()] == [("set", 204), ("del", 204), ("incr", 400), ("set", 400), ("set", 204)]


def test_null_keys_have_no_owner(spark, monkeypatch):
    nodes = spark.createDataFrame([("n1",), ("n2",)], "node_id string")
    keys = spark.createDataFrame([("k1",), (None,), ("",), ("k1",)], "source string")
    few = [(r.source, r.key_hash, r.node_id) for r in ring.route(keys, ring.points(nodes)).collect()]
    assert len(few) == 4 and [x for x in few if x[0] is None] == [(None, None, None)] and all(x[2] for x in few if x[0] is not None)
    shown = {r.source: r.route for r in ring.decisions(ring.route(keys, ring.points(nodes)), nodes.selectExpr("node_id", "false AS healthy", "'a' AS addr"), "none").collect()}
    assert shown == {None: "not_found", "k1": "unavailable", "": "unavailable"}
    monkeypatch.setattr(ring, "POINTS", 3)  # a ring that is too large to send
    assert sorted(map(str, few)) == sorted(str((r.source, r.key_hash, r.node_id)) for r in ring.route(keys, ring.points(nodes)).collect())


def test_repeated_chunks(spark):
    rows = [(1, 0, b"ab", 1), (1, 0, b"xy", 2), (1, 2, b"cd", 3), (1, 2, b"ce", 4), (2, 0, b"\xff\x00", 1), (2, 2, b"z", 1)]
    chunks = spark.createDataFrame(rows, "t long, offset long, data binary, at long")
    assert {r.t: (r.size, bytes(r.data)) for r in raftlog.reassembled(chunks, "t", "at").collect()} == {1: (4, b"xyce"), 2: (3, b"\xff\x00z")}
    assert {r.t: bytes(r.data) for r in raftlog.reassembled(chunks, "t").collect()} == {1: b"xyce", 2: b"\xff\x00z"}


def test_running_sums_with_nulls_negatives_and_large_numbers(spark):
    rows = [(None, 5), (-70_000, 1), (-1, 2), (0, 3), (2**60, 4), (2**60 + 1, 7)]
    df = spark.createDataFrame(rows, "at long, n long")
    got = {r["at"]: r.before for r in order.running_before(df, "at", F.col("n"), "before").collect()}
    assert got == {None: 0, -70_000: 5, -1: 6, 0: 8, 2**60: 11, 2**60 + 1: 15}


def test_find_in_the_folded_state(spark):
    rows = [(1, "set", "a", "1"), (2, "set", "b", "2"), (3, "del", "a", None), (4, "set", "c", "3"), (5, "set", "c", "4")]
    commands = spark.createDataFrame(rows, "index long, op string, key string, value string")
    found = lambda k, upto=None: [r.value for r in kv.find(commands, k, upto).collect()]
    assert (found("a"), found("a", 2), found("b"), found("c"), found("none")) == ([], ["1"], ["2"], ["4"], [])


def test_records_as_expressions_are_the_formats(spark):
    rows = [(1, "set", "ké", "vß"), (2, "del", "k", None), (2**40, "meta", "m", None)]
    df = spark.createDataFrame(rows, "i long, op string, k string, v string")
    kinds = {"set": fr.SET, "del": fr.DEL, "meta": fr.MARK}
    for r in df.select("*", binary.kv_record(F.col("op"), F.col("i"), F.col("k"), F.col("v")).alias("b"), binary.meta_record(F.col("i"), F.col("k")).alias("m")).collect():
        assert bytes(r.b) == fr.kv_record(kinds[r.op], r.i, r.k, r.v) and bytes(r.m) == fr.meta(r.i, r.k)
        assert fr.parse_kv_record(bytes(r.b)) == (r.op, r.i, r.k, r.v)
    logs = spark.createDataFrame([(1, 5, 2, 0, b"x", None, v) for v in (1, 2, 3)] + [(2, None, None, None, None, 9, 1)], "t int, i long, m long, e int, d binary, f long, v int")
    made = logs.select(binary.log_record(F.col("t"), F.col("i"), F.col("m"), F.col("e"), F.col("d"), F.col("f"), F.col("v")).alias("b")).collect()
    assert [bytes(r.b) for r in made] == [fr.log_entry(5, 2, 0, b"x", v) for v in (1, 2, 3)] + [fr.truncate_marker(9)]
    framed = spark.createDataFrame([(7, b"data")], "t long, d binary").select(binary.framed(F.col("t"), F.col("d")).alias("f")).first().f
    assert bytes(framed) == fr.frame(7, b"data")


def test_malformed_commands(spark):
    texts = ['{"op":"set","key":"a","value":"b"}', '{"op":"set"', "null", "[]", "7", '{"op":"set","key":1}', '{"op":"del","key":"a"} x', '{"OP":"set","Key":"z"}', "{}", ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts, 1)], "index long, data string")
    got = {r["index"]: (r.effect, r.op, r.key, r.value) for r in kv.applied(rows).collect()}
    assert [got[k][0] for k in range(1, 11)] == ["set", "skipped", "none", "skipped", "skipped", "skipped", "skipped", "set", "none", "skipped"]
    assert got[8][1:] == ("set", "z", "") and got[1][1:] == ("set", "a", "b")
    assert kv.applied_upto(rows).first().last_applied == 9 and kv.applied_upto(rows.limit(0)).first().last_applied == 0
