"""The engine on unbounded input: ingest, the keyed view, ordered application, snapshots.

State lies in the checkpoint location that a call names; give one in a folder
that all executors share (`storage.scratch` makes one).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata import storage
from lodestrata.operators import kv, validate
from lodestrata.schema import APPLIED_KEY

#: Batches whose changes are kept apart before they are folded into the table.
FOLD_AFTER = 16


def ingested(requests: DataFrame) -> DataFrame:
    """Accepted requests as events, stamped on arrival; what is refused keeps its status for a counter."""
    return requests.withColumn("received_at", F.when(F.col("status") == 202, F.current_timestamp()))


def ingest(requests: DataFrame, log: str, checkpoint: str, capacity: int, order: str, **trigger) -> StreamingQuery:
    """Accepted requests to a log, each batch with its outcomes: what finds no room among `capacity` events a batch is overloaded, but in the log all the same."""

    def take(batch: DataFrame, number: int) -> None:
        rows = ingested(batch).filter("status = 202").withColumn("batch", F.lit(number))
        rows = validate.outcomes(validate.queued(rows, "batch", order, capacity), F.lit(True), F.col("queued"))
        rows.drop("batch").write.mode("overwrite").parquet(f"{log}/batch={number}")

    return requests.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**_when(trigger)).start()


def _when(trigger: dict) -> dict:
    return trigger or {"availableNow": True}


def append(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Events to Parquet, each once; the trigger stands for how often a log is made durable."""
    return events.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(**_when(trigger)).start(path)


def upsert(log: DataFrame, path: str, checkpoint: str, key: str = "source", order: str = "offset", values: tuple = ("payload", "received_at"), **trigger) -> StreamingQuery:
    """The keyed table as Parquet: a base, and the changes of the batches since.

    A batch writes the keys that it touches and no others; every FOLD_AFTER
    batches the changes are folded into a new base, and what it replaces but one
    is removed. A batch that runs again writes the same. `view` reads the table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kv.latest(batch, key, order, values).write.mode("overwrite").parquet(f"{path}/delta={number:09d}")
        if number % FOLD_AFTER == FOLD_AFTER - 1 and not storage.is_whole(spark, f"{path}/base={number:09d}"):
            kv.latest(view(spark, path, key, order, values), key, order, values).write.mode("overwrite").parquet(f"{path}/base={number:09d}")
            for name in storage.listed(spark, path):
                if name < f"base={number - FOLD_AFTER:09d}" or f"delta={0:09d}" <= name < f"delta={number - FOLD_AFTER:09d}":
                    storage.removed(spark, f"{path}/{name}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**_when(trigger)).start()


def view(spark: SparkSession, path: str, key: str = "source", order: str = "offset", values: tuple = ("payload", "received_at")) -> DataFrame:
    """The table that `upsert` keeps: the last whole base and the changes after it."""
    names = [n for n in storage.listed(spark, path) if storage.is_whole(spark, f"{path}/{n}")]
    bases = [n for n in names if n.startswith("base=")]
    since = bases[-1].removeprefix("base=") if bases else ""
    used = bases[-1:] + [n for n in names if n.startswith("delta=") and n.removeprefix("delta=") > since]
    if not used:
        raise ValueError(f"nothing was written to {path}")
    return kv.latest(spark.read.parquet(*(f"{path}/{n}" for n in used)).select(key, order, *values), key, order, values)


def read_own(query: StreamingQuery, read: Callable[[], DataFrame]) -> DataFrame:
    """read() once a running query has taken all that was there when this was called, so that a writer finds its writes."""
    query.processAllAvailable()
    return read()


def each_batch(rows: DataFrame, use: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """A user's processor, given every batch and its number."""
    return rows.writeStream.foreachBatch(use).option("checkpointLocation", checkpoint).trigger(**_when(trigger)).start()


def applied(commands: DataFrame) -> DataFrame:
    """(key, value, index, live): each key's state, commands applied in index order; a streaming aggregation.

    A command that arrives again, or late with a lower index, changes nothing.
    """
    rows = commands.filter(F.col("op").isin("set", "del") & (F.col("key") != APPLIED_KEY))
    last = rows.groupBy("key").agg(F.max_by(F.struct("op", "value"), "index").alias("last"), F.max("index").alias("index"))
    live = F.col("last.op") == "set"
    return last.select("key", F.when(live, F.col("last.value")).alias("value"), "index", live.alias("live"))


def applied_table(commands: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """`applied`, kept as `upsert` keeps a table: view(spark, path, "key", "index", ("value", "live"))."""
    rows = commands.filter(F.col("op").isin("set", "del") & (F.col("key") != APPLIED_KEY))
    live = F.col("op") == "set"
    return upsert(rows.select("key", "index", F.when(live, F.col("value")).alias("value"), live.alias("live")), path, checkpoint, "key", "index", ("value", "live"), **trigger)


def _last_snapshot(spark: SparkSession, path: str) -> int:
    kept = [int(n.removeprefix("snapshot-")) for n in storage.listed(spark, path) if n.startswith("snapshot-") and storage.is_whole(spark, f"{path}/{n}")]
    return max(kept, default=0)


def _log_since(spark: SparkSession, path: str, index: int) -> DataFrame | None:
    where = f"{path}/log-{index}"
    names = [n for n in storage.listed(spark, where) if storage.is_whole(spark, f"{where}/{n}")]
    return spark.read.parquet(*(f"{where}/{n}" for n in names)).filter(F.col("index") > index) if names else None


def snapshots(commands: DataFrame, path: str, checkpoint: str, threshold: int = 10_000, **trigger) -> StreamingQuery:
    """A snapshot of the folded state whenever `threshold` more indices were applied, and the log since the last one.

    Indices are dense from 1. A snapshot waits until none below it is missing. A
    batch reads the log since the last snapshot only, and a snapshot is folded
    from the one before and that.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = _last_snapshot(spark, path)
        rows = batch.select("index", "op", "key", "value")
        rows.filter(F.col("index") > last).write.mode("overwrite").parquet(f"{path}/log-{last}/batch={number}")
        log = _log_since(spark, path, last)
        top = log.agg(F.max("index")).first()[0]
        kept = (top or 0) - (top or 0) % threshold
        if kept > last and log.filter(F.col("index") <= kept).select("index").distinct().count() == kept - last:
            state = kv.fold(log, kept) if not last else kv.recovered(spark.read.parquet(f"{path}/snapshot-{last}"), last, log.filter(F.col("index") <= kept))
            log.filter(F.col("index") > kept).write.mode("overwrite").parquet(f"{path}/log-{kept}/before={number}")
            state.select("key", "value").write.mode("overwrite").parquet(f"{path}/snapshot-{kept}")

    return commands.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**_when(trigger)).start()


def restored(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, index): the state from the last snapshot that `snapshots` took and the log after it."""
    last = _last_snapshot(spark, path)
    log = _log_since(spark, path, last)
    empty = spark.createDataFrame([], "index long, op string, key string, value string")
    base = spark.read.parquet(f"{path}/snapshot-{last}") if last else empty.select("key", "value")
    return kv.recovered(base, last, empty if log is None else log)
