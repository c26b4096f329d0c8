"""Streams give what the batch operators give."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import kv
from lodestrata.plans import adapt
from lodestrata.streaming import queries as streams


def _parted(spark, data, tmp_path, rows, n=4):
    """rows written as n files, and a stream over them, one file a batch."""
    path = str(tmp_path / "in")
    rows.repartition(n).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_upsert(spark, data, tmp_path):
    log = adapt.log(spark, data)
    followed = _parted(spark, data, tmp_path, log)
    streams.upsert(followed, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = streams.view(spark, str(tmp_path / "out"))
    assert sorted(got.select("source", "offset", "payload").collect()) == sorted(kv.latest(log).select("source", "offset", "payload").collect())


def test_append_takes_each_event_once_over_restarts(spark, data, tmp_path):
    log = adapt.log(spark, data)
    followed = _parted(spark, data, tmp_path, log)
    for _ in range(2):
        streams.append(followed, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == log.count()


def test_upsert_folds_its_changes(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FOLD_AFTER", 2)
    log = adapt.log(spark, data)
    followed = _parted(spark, data, tmp_path, log, 7)
    streams.upsert(followed, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["base=000000003", "base=000000005", *(f"delta={k:09d}" for k in (3, 4, 5, 6))]
    got = streams.view(spark, str(tmp_path / "out"))
    assert sorted(got.select("source", "offset", "payload").collect()) == sorted(kv.latest(log).select("source", "offset", "payload").collect())


def test_applied_skips_repeated_and_late_commands(spark, data, tmp_path):
    commands = adapt.commands(spark, data)
    followed = _parted(spark, data, tmp_path, commands.unionByName(commands.filter("index % 3 = 0")))
    query = streams.applied(followed).writeStream.format("memory").queryName("applied_test").outputMode("complete").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.key, r.value, r["index"]) for r in spark.table("applied_test").filter("live").collect()}
    assert got == {(r.key, r.value, r["index"]) for r in kv.fold(commands).collect()}


def test_a_writer_reads_its_writes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "offset long, source string, payload string, received_at timestamp"
    rows = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = streams.upsert(rows, str(tmp_path / "out"), str(tmp_path / "c"), processingTime="1 second")
    try:
        for k in range(2):
            (tmp_path / "in" / f"{k}.json").write_text(f'{{"offset":{k},"source":"a","payload":"v{k}"}}')
            assert [r.payload for r in streams.read_own(query, lambda: streams.view(spark, str(tmp_path / "out"))).collect()] == [f"v{k}"]
    finally:
        query.stop()


def test_overloaded_events_stay_in_the_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.txt").write_text("".join(f'{{"source":"s{k}","payload":"b"}}\n' for k in range(5)) + '{"source":""}\n')
    from lodestrata.sources.requests import follow_requests

    streams.ingest(follow_requests(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c"), 3, "source").awaitTermination()
    got = [(r.source, r.outcome, r.status) for r in spark.read.parquet(str(tmp_path / "log")).orderBy("source").collect()]
    assert got == [(f"s{k}", *(("ok", 202) if k < 3 else ("overloaded", 429))) for k in range(5)]


def test_snapshots_at_thresholds(spark, data, tmp_path):
    commands = adapt.commands(spark, data)
    streams.snapshots(_parted(spark, data, tmp_path, commands), str(tmp_path / "s"), str(tmp_path / "c"), threshold=400).awaitTermination()
    top = commands.agg(F.max("index")).first()[0]
    kept = top - top % 400
    got = spark.read.parquet(str(tmp_path / "s" / f"snapshot-{kept}"))
    assert sorted(got.collect()) == sorted(kv.fold(commands, kept).select("key", "value").collect())
    whole = streams.restored(spark, str(tmp_path / "s"))
    assert sorted(whole.select("key", "value").collect()) == sorted(kv.fold(commands).select("key", "value").collect())


def test_ingest_and_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.txt").write_text('{"source":"a","payload":"b"}\n{"source":"","payload":"b"}\n')
    from lodestrata.sources.requests import follow_requests

    seen = []
    rows = streams.ingested(follow_requests(spark, str(tmp_path / "in")))
    streams.each_batch(rows, lambda batch, n: seen.extend(batch.select("status", F.col("received_at").isNotNull().alias("stamped")).collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted((r.status, r.stamped) for r in seen) == [(202, True), (422, False)]
