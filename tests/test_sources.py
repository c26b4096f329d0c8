"""Framed logs as data sources, in batches and followed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import kv
from lodestrata.plans import catalog
from lodestrata.sources import eventlog, files, requests
from lodestrata.sources import frames as fr


def _event(k: int, source: str = "s") -> bytes:
    return fr.frame(k, fr.event(f"{source}{k % 3}", f"v{k}"))


def test_batch_source_and_files_agree(spark, tmp_path):
    eventlog.register(spark)
    (tmp_path / "a.wal").write_bytes(b"".join(_event(k) for k in range(10)))
    (tmp_path / "b.wal").write_bytes(b"".join(_event(k) for k in range(10, 15))[:-3])
    one = spark.read.format("eventlog").load(str(tmp_path)).select("offset", "ts_ns", "source", "payload")
    two = files.read_events(spark, str(tmp_path)).select("offset", "ts_ns", "source", "payload")
    assert sorted(one.collect()) == sorted(two.collect())
    assert one.count() == 14
    kept = spark.read.format("eventlog").option("mode", "PERMISSIVE").load(str(tmp_path))
    assert kept.filter("status = 'truncated'").count() == 1


def test_start_offset(spark, tmp_path):
    eventlog.register(spark)
    (tmp_path / "a.wal").write_bytes(b"".join(_event(k) for k in range(4)))
    second = len(_event(0))
    rows = spark.read.format("eventlog").option("startOffset", second).load(str(tmp_path))
    assert sorted(r.payload for r in rows.collect()) == ["v1", "v2", "v3"]


def test_damage_fails_fast_or_is_marked(spark, tmp_path):
    (tmp_path / "a.wal").write_bytes(_event(0) + b"\0" * 40)
    with pytest.raises(Exception, match="bad_magic"):
        files.read_frames(spark, str(tmp_path), "FAILFAST").collect()
    assert [r.status for r in files.read_frames(spark, str(tmp_path)).orderBy("offset").collect()] == ["ok", "bad_magic"]
    assert files.read_frames(spark, str(tmp_path), "DROPMALFORMED").count() == 1


def test_write_and_read_back(spark, tmp_path):
    eventlog.register(spark)
    rows = spark.range(50).select(F.col("id").alias("ts_ns"), F.concat(F.lit("k"), F.col("id") % 5).alias("source"), F.lit("é").alias("payload"))
    rows.write.format("eventlog").mode("append").option("path", str(tmp_path / "log")).save()
    back = spark.read.format("eventlog").load(str(tmp_path / "log")).select("ts_ns", "source", "payload")
    assert sorted(back.collect()) == sorted(rows.collect())


def _taken(reader, start, end) -> list[str]:
    return [r[4] for part in reader.partitions(start, end) for r in reader.read(part)]


def test_follow_waits_for_torn_tail_and_restarts_after_compaction(tmp_path):
    log = tmp_path / "a.wal"
    raw = b"".join(_event(k) for k in range(5))
    log.write_bytes(raw[:-4])
    reader = eventlog._Follower({"path": str(log)})
    at = reader.latestOffset()
    assert _taken(reader, reader.initialOffset(), at) == ["v0", "v1", "v2", "v3"]
    with log.open("ab") as f:
        f.write(raw[-4:])
    end = reader.latestOffset()
    assert _taken(reader, at, end) == ["v4"] == _taken(eventlog._Follower({"path": str(log)}), at, end)
    # replaced by a file that is longer than what was taken: it is another file, and read from its start
    (tmp_path / "new").write_bytes(b"".join(_event(k) for k in range(20, 30)))
    (tmp_path / "new").rename(log)
    last = reader.latestOffset()
    assert _taken(reader, end, last) == [f"v{k}" for k in range(20, 30)]
    with pytest.raises(ValueError, match="replaced"):  # the batch before can't be read any more, and doesn't pass for another
        reader.partitions(at, end)


def test_follow_segments(tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.wal").write_bytes(b"".join(_event(10 * k + j) for j in range(4)))
    reader = eventlog._Follower({"path": str(tmp_path)})
    one = reader.latestOffset()
    assert len(reader.partitions(reader.initialOffset(), one)) == 3 and len(_taken(reader, reader.initialOffset(), one)) == 12
    with (tmp_path / "2.wal").open("ab") as f:
        f.write(_event(24))
    (tmp_path / "3.wal").write_bytes(_event(30) + _event(31)[:-1])
    two = reader.latestOffset()
    assert _taken(reader, one, two) == ["v24", "v30"] and _taken(reader, two, two) == []


def test_many_segments_share_partitions(tmp_path):
    for k in range(1000):
        (tmp_path / f"{k:04d}.wal").write_bytes((_event(2 * k) + _event(2 * k + 1))[: -3 if k % 3 == 0 else None])
    (tmp_path / "0500.wal").write_bytes(_event(1000) + b"\0" * 40)
    want = [f"v{k}" for k in range(2000) if k % 6 != 1 and k != 1001]
    reader = eventlog._Reader({"path": str(tmp_path), "mode": "PERMISSIVE"})
    parts = reader.partitions()
    assert len(parts) == 128 and {len(p.spans) for p in parts} == {7, 8}
    rows = [r for p in parts for r in reader.read(p)]
    assert [r[4] for r in rows if r[5] == "ok"] == want  # damage ends its own segment only
    assert sorted(r[5] for r in rows if r[5] != "ok") == ["bad_magic"] + ["truncated"] * 334
    assert {r[1] for r in rows if r[2] == 24} == {0} and {r[1] for r in rows if r[2] == 23} == {len(_event(22))}
    (tmp_path / "0500.wal").write_bytes(_event(1000))
    follower = eventlog._Follower({"path": str(tmp_path)})
    end = follower.latestOffset()
    assert len(follower.partitions(follower.initialOffset(), end)) == 128 and _taken(follower, follower.initialOffset(), end) == want


def test_partitions_grow_with_bytes():
    spans = [eventlog._Span(f"{k:04d}", 0) for k in range(2000)]
    for sizes in ([100] * 2000, [16 << 20] * 2000, [(64 << 20) * (k == 700) + 100 for k in range(2000)], [(k % 50) << 20 for k in range(2000)]):
        parts = eventlog._packed(spans, sizes)
        assert [s for p in parts for s in p.spans] == spans
        assert 64 <= len(parts) <= max(128, 1 + sum(size + (1 << 16) for size in sizes) // (32 << 20))
        held = [sum(sizes[int(s.path)] for s in p.spans) for p in parts]
        assert max(held) <= max(sizes) + (32 << 20)
    assert [p.spans for p in eventlog._packed(spans[:100], [1 << 40] + [1] * 99)] == [[s] for s in spans[:100]]
    assert [p.spans for p in eventlog._packed([], [])] == [[]]


def test_damage_in_a_followed_log_fails(tmp_path):
    (tmp_path / "a.wal").write_bytes(_event(0) + b"\0" * 40)
    reader = eventlog._Follower({"path": str(tmp_path)})
    with pytest.raises(ValueError, match="bad_magic"):
        _taken(reader, reader.initialOffset(), reader.latestOffset())


def test_frames_of_a_file_like_frames_in_memory(tmp_path):
    raw = b"".join(_event(k) for k in range(4))
    for content in (raw, raw[:-3], raw + b"\0" * 30, raw[:-1] + b"\0", b"", raw[:10]):
        (tmp_path / "f").write_bytes(content)
        with (tmp_path / "f").open("rb") as f:
            assert list(fr.frames_of(f)) == list(fr.frames(content))


def test_raw_payloads_and_segments(spark, tmp_path):
    rows = spark.range(30).selectExpr("id % 3 AS part", "id AS ts_ns", "cast(concat('raw', id) AS binary) AS data")
    eventlog.written(rows, str(tmp_path / "log"), "part")
    back = files.read_frames(spark, str(tmp_path / "log"))
    assert sorted((r.ts_ns, bytes(r.data), r.status) for r in back.collect()) == [(k, f"raw{k}".encode(), "ok") for k in range(30)]
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "log").glob("*.wal")) == ["0", "1", "2"]
    again = eventlog.written(spark.createDataFrame([(99, "s", "p")], "ts_ns long, source string, payload string"), str(tmp_path / "log"))
    assert [(r.offset, r.source, r.payload) for r in again.collect()] == [(0, "s", "p")]


def test_many_appended_segments_are_read_back(spark, tmp_path):
    rows = spark.range(1200).selectExpr("id div 3 AS part", "id AS ts_ns", "concat('s', id % 7) AS source", "repeat('é', cast(id % 5 AS int)) AS payload")
    back = eventlog.written(rows, str(tmp_path / "log"), "part")
    assert back.rdd.getNumPartitions() <= 128 and len(list((tmp_path / "log").glob("*.wal"))) == 400
    size = lambda k: len(fr.frame(k, fr.event(f"s{k % 7}", "é" * (k % 5))))
    want = [(k, sum(size(j) for j in range(k - k % 3, k)), f"s{k % 7}", "é" * (k % 5), "ok") for k in range(1200)]
    assert sorted((r.ts_ns, r.offset, r.source, r.payload, r.status) for r in back.collect()) == want
    assert back.filter(catalog._segment() != (F.col("ts_ns") / 3).cast("int").cast("string")).count() == 0


def test_follow_as_a_stream(spark, tmp_path):
    eventlog.register(spark)
    log = tmp_path / "a.wal"
    log.write_bytes(b"".join(_event(k) for k in range(6)))
    rows = spark.readStream.format("eventlog").load(str(log))
    query = rows.writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("followed").count() == 6


def test_snapshots_listed_and_read(spark, tmp_path):
    for index in (3, 12):
        (tmp_path / f"snapshot-{index}-1.snap").write_bytes(fr.snapshot(index, 1, {"k": str(index)}))
    (tmp_path / "snapshot-x.snap").write_bytes(b"")
    assert [r["index"] for r in files.list_snapshots(spark, str(tmp_path)).collect()] == [12, 3]
    rows = files.read_snapshots(spark, str(tmp_path), glob="snapshot-1*.snap").collect()
    assert [(r["index"], r.key, r.value, r.status) for r in rows] == [(12, "k", "12", "ok")]
    (tmp_path / "meta").write_bytes(fr.meta(4, "n1"))
    assert [(r.term, r.voted_for) for r in files.read_meta(spark, str(tmp_path), glob="meta").collect()] == [(4, "n1")]


def test_requests(spark, tmp_path):
    lines = ['{"source":"a","payload":"b"}', '{"source":"a","payload":""}', '{"source":"a"', '{"source":"a","payload":"b","x":"y"}', '{"source":1,"payload":"b"}', "null", "[]", '{"source":"a\\"b","payload":"{c}"} tail']
    (tmp_path / "r.txt").write_text("\n".join(lines))
    got = {r.raw: r.status for r in requests.read_requests(spark, str(tmp_path / "r.txt")).collect()}
    assert [got[x] for x in lines] == [202, 422, 400, 400, 400, 422, 400, 202]


def test_generated(spark):
    assert requests.generated(spark, 100).count() == 100


def test_compaction_keeps_the_view(spark):
    rows = [(0, "a", "v1"), (1, "b", "only-value"), (2, "a", "v2"), (3, "a", "v3")]
    log = spark.createDataFrame([(o, s, p, None) for o, s, p in rows], "offset long, source string, payload string, received_at timestamp")
    small = kv.compacted(log)
    assert small.count() == 2
    assert sorted(kv.latest(small).collect()) == sorted(kv.latest(log).collect())
    assert {r.source: r.payload for r in kv.latest(log).collect()} == {"a": "v3", "b": "only-value"}
    admitted = {r.source: r.admitted for r in kv.admitted(log, 1).collect()}
    assert admitted == {"a": True, "b": False}
