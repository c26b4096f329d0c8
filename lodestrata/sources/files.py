"""Framed logs, snapshots and metadata read from any file system that Spark reads.

A file becomes one binary row and its records are unpacked where the row lies,
so files are the units of parallelism and must be below 2 GB each, which is what
logs cut into segments are. `mode` is PERMISSIVE (what isn't sound becomes a row
with its status), DROPMALFORMED or FAILFAST.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.binary import decode_event
from lodestrata.sources import frames as fr

_FRAME = "file string, offset long, ts_ns long, data binary, crc long, status string"
_LOG = "file string, seq long, rec_type int, index long, term long, entry_type int, data binary, from_index long, status string"
_KV = "file string, offset long, op string, raft_index long, key string, value string, status string"
_SNAPSHOT = "file string, index long, term long, key string, value string, phase int, voters array<string>, new_voters array<string>, status string"
_META = "file string, term long, voted_for string, status string"


def _binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), "content")


def _unpacked(files: DataFrame, rows, schema: str, mode: str) -> DataFrame:
    names, types = zip(*((n, _ARROW[t]) for n, t in (f.split() for f in schema.split(", "))), strict=True)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def unpack(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = []
                for row in rows(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    if row[-1] != fr.OK and mode == "FAILFAST" and row[-1] != fr.TRUNCATED:
                        raise ValueError(f"{file}: {row[-1]}")
                    if row[-1] == fr.OK or mode == "PERMISSIVE":
                        held.append((file, *row))
                    if len(held) >= 8192:
                        yield batch_of(held)
                        held = []
                yield batch_of(held)

    return files.mapInArrow(unpack, schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def _sound(parse, data: bytes, width: int):
    try:
        return (*parse(data), fr.OK)
    except (ValueError, UnicodeDecodeError) as bad:
        return (*[None] * width, str(bad))


def frames_in(files: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Every frame of framed logs (file, content); a torn tail is no failure."""
    return _unpacked(files, fr.frames, _FRAME, mode)


def read_frames(spark: SparkSession, path: str, mode: str = "PERMISSIVE", glob: str = "*") -> DataFrame:
    return frames_in(_binary(spark, path, glob), mode)


def read_events(spark: SparkSession, path: str, mode: str = "FAILFAST", glob: str = "*") -> DataFrame:
    return events_in(_binary(spark, path, glob), mode)


def events_in(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """(file, offset, ts_ns, received_at, source, payload): the events of framed logs, at the time of the frame."""
    rows = frames_in(files, mode).filter(F.col("status") == fr.OK).withColumn("__event", decode_event(F.col("data")))
    return rows.select("file", "offset", "ts_ns", F.timestamp_micros(F.expr("ts_ns div 1000")).alias("received_at"), "__event.source", "__event.payload")


def read_log(spark: SparkSession, path: str, mode: str = "FAILFAST", glob: str = "*") -> DataFrame:
    return log_in(_binary(spark, path, glob), mode)


def log_in(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Entries and truncate markers of a replicated log, as written; seq counts records of a file."""

    def rows(content: bytes):
        for seq, (_, _, data, _, status) in enumerate(fr.frames(content)):
            yield (seq, *(_sound(fr.parse_log_record, data, 6) if status == fr.OK else (*[None] * 6, status)))

    return _unpacked(files, rows, _LOG, mode)


def read_kv(spark: SparkSession, path: str, mode: str = "FAILFAST", glob: str = "*") -> DataFrame:
    return kv_in(_binary(spark, path, glob), mode)


def kv_in(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Set, delete and checkpoint records of a keyed store's log."""

    def rows(content: bytes):
        for offset, _, data, _, status in fr.frames(content):
            yield (offset, *(_sound(fr.parse_kv_record, data, 4) if status == fr.OK else (*[None] * 4, status)))

    return _unpacked(files, rows, _KV, mode)


def read_snapshots(spark: SparkSession, path: str, mode: str = "FAILFAST", glob: str = "*.snap") -> DataFrame:
    return snapshots_in(_binary(spark, path, glob), mode)


def snapshots_in(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """A row for each pair of each snapshot, with the snapshot's index, term and configuration."""

    def rows(content: bytes):
        index, term, pairs, config, _, status = _sound(fr.parse_snapshot, content, 5)
        config = config or {}
        for key, value in (pairs or {None: None}).items():
            yield index, term, key, value, config.get("Phase"), config.get("Voters"), config.get("NewVoters"), status

    return _unpacked(files, rows, _SNAPSHOT, mode)


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(file, index, term, size): snapshots by their names, newest first; others are passed over. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "snapshot-*.snap").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    part = lambda k: F.regexp_extract("file", r"snapshot-(\d+)-(\d+)\.snap$", k)
    return files.filter(part(1) != "").select("file", part(1).cast("long").alias("index"), part(2).cast("long").alias("term"), "size").orderBy(F.col("index").desc())


def read_meta(spark: SparkSession, path: str, mode: str = "FAILFAST", glob: str = "*") -> DataFrame:
    return meta_in(_binary(spark, path, glob), mode)


def meta_in(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    return _unpacked(files, lambda content: [_sound(fr.parse_meta, content, 2)], _META, mode)
