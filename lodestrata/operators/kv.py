"""A log read as a keyed table: latest writes, folds of commands, compaction, recovery."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lodestrata.functions.binary import frame_size
from lodestrata.operators import validate
from lodestrata.operators.order import running_before
from lodestrata.schema import APPLIED_KEY


def latest(log: DataFrame, key: str = "source", order: str = "offset", values: tuple = ("payload", "received_at")) -> DataFrame:
    """The last record of each key by log offset, whatever its time says."""
    picked = F.max_by(F.struct(*values), order).alias("last")
    return log.groupBy(key).agg(F.max(order).alias(order), picked).select(key, order, *(F.col(f"last.{v}").alias(v) for v in values))


def get(log: DataFrame, wanted: str, key: str = "source", **how) -> DataFrame:
    """One key's record; the filter stands before the fold and reaches the scan."""
    return latest(log.filter(F.col(key) == wanted), key, **how)


def live_count(log: DataFrame, key: str = "source") -> DataFrame:
    return log.agg(F.count_distinct(key).alias("live_keys"))


def compacted(log: DataFrame, key: str = "source", order: str = "offset") -> DataFrame:
    """The log with only the latest record of each key.

    One pass: tasks keep the latest record of each key that they see, and only
    those are shuffled. (A semi-join on offsets scans twice and, beyond what can
    be sent to every task, shuffles the whole log.)
    """
    return log.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*log.columns), order).alias("__last")).select("__last.*")


def compaction_stats(log: DataFrame, key: str = "source", order: str = "offset") -> DataFrame:
    """Records and bytes before and after compaction, in one pass and one shuffle of sums by key."""
    size = frame_size(F.col(key), F.col("payload"))
    per = log.groupBy(key).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.max_by(size, order).alias("live"))
    total, live = F.sum("n"), F.count("*")
    return per.agg(total.alias("records"), live.alias("live_records"), (total - live).alias("dead_records"), F.sum("bytes").alias("bytes"), F.sum("live").alias("live_bytes"))


def offsets(events: DataFrame, order: str) -> DataFrame:
    """Each event's byte offset in a framed log."""
    return running_before(events, order, frame_size(F.col("source"), F.col("payload")), "byte_offset")


def fold(commands: DataFrame, upto: int | None = None) -> DataFrame:
    """The live keys after set and delete commands, up to an index if one is given.

    Other ops change nothing. Commands on the reserved key are no user's.
    """
    rows = commands.filter(F.col("op").isin("set", "del") & (F.col("key") != APPLIED_KEY))
    if upto is not None:
        rows = rows.filter(F.col("index") <= upto)
    last = rows.groupBy("key").agg(F.max_by(F.struct("op", "value"), "index").alias("last"), F.max("index").alias("index"))
    return last.filter("last.op = 'set'").select("key", F.col("last.value").alias("value"), "index")


def find(commands: DataFrame, wanted: str, upto: int | None = None) -> DataFrame:
    """One key's value in the folded state, no row if it was deleted; the filter stands before the fold and reaches the scan."""
    return fold(commands.filter(F.col("key") == wanted), upto)


def decoded(entries: DataFrame) -> DataFrame:
    """entries (index, data as JSON text) with op, key, value and whether the command is well formed.

    Unlike a request's, a command's other fields are ignored, and nothing may
    follow the object. A field that is absent or null is empty; one that is no
    string makes the command malformed.
    """
    object_ = validate.command_object(F.col("data"))
    rows = entries.withColumn("__command", object_)
    good = F.col("__command").isNotNull()
    return rows.withColumns({"op": F.col("__command.op"), "key": F.col("__command.key"), "value": F.col("__command.value"), "well_formed": good}).drop("__command")


def applied(entries: DataFrame) -> DataFrame:
    """decoded entries with what applying each does: set, del, none (an op that is neither, which still counts as applied), or skipped (malformed)."""
    rows = decoded(entries)
    effect = F.when(~F.col("well_formed"), "skipped").when(F.col("op").isin("set", "del"), F.col("op")).otherwise("none")
    return rows.withColumn("effect", effect)


def applied_upto(entries: DataFrame) -> DataFrame:
    """How far a log is applied: the last index that wasn't skipped, 0 without any."""
    return applied(entries).filter("effect <> 'skipped'").agg(F.coalesce(F.max("index"), F.lit(0)).alias("last_applied"))


def last_applied(marks: DataFrame) -> DataFrame:
    """The raft index in the last checkpoint record, by log offset."""
    return marks.agg(F.max_by("raft_index", "offset").alias("last_applied"))


def admitted(log: DataFrame, max_keys: int, key: str = "source", order: str = "offset") -> DataFrame:
    """Whether each key was let in under a limit on the number of keys, by first appearance; for logs without deletes."""
    first = log.groupBy(key).agg(F.min(order).alias("first_offset"))
    ranked = running_before(first, "first_offset", F.lit(1), "earlier")
    return ranked.select(key, "first_offset", (F.col("earlier") < max_keys).alias("admitted"))


def admitted_with_deletes(commands: DataFrame, max_keys: int, by: str, key: str = "key", order: str = "index") -> DataFrame:
    """commands (by, order, op, key) with whether each was let in, in logs that also delete.

    A new key is let in while fewer than max_keys are live; an overwrite always
    is; a delete makes room. Whether a command is let in depends on all before
    it in its log, so a log (`by`) goes through one task in order, as a stream:
    the task holds the live keys, at most max_keys.
    """
    names = [by, order, "op", key]
    rows = commands.select(*names).repartition(by).sortWithinPartitions(by, order)

    def step(batches):
        log, live = object(), set()
        for batch in batches:
            out = []
            for of, op, name in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (by, "op", key)), strict=True):
                if of != log:
                    log, live = of, set()
                let_in = op != "set" or name in live or len(live) < max_keys
                if op == "set" and let_in:
                    live.add(name)
                elif op == "del":
                    live.discard(name)
                out.append(let_in)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*names, "admitted"])

    return rows.mapInArrow(step, StructType([*rows.schema.fields, StructField("admitted", BooleanType())]))


def unapplied(entries: DataFrame, last: int) -> DataFrame:
    """Entries that were not applied yet, each once though delivered again."""
    return entries.filter(F.col("index") > last).dropDuplicates(["index"])


def recovered(snapshot: DataFrame, snapshot_index: int, *logs: DataFrame) -> DataFrame:
    """State from a snapshot and the commands of logs after it, as one fold.

    The snapshot's rows count as sets at its index; commands up to that index
    are in it already.
    """
    rows = snapshot.select(F.lit(snapshot_index).cast("long").alias("index"), F.lit("set").alias("op"), "key", "value")
    for log in logs:
        rows = rows.unionByName(log.filter(F.col("index") > snapshot_index).select("index", "op", "key", "value"))
    return fold(rows)
