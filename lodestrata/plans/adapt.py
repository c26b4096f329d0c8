"""The driver's `events` table seen as the engine's records.

An event is a log record: its id is the offset, its user the key, its properties
the payload, its value a latency. Errors delete, other types set.

Some of these tables take part of the events on purpose: they stand for what a
service would hold (a follower that lags, a leader whose log was compacted, marks
that only some records leave). The operators run over all of what they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return rows.select(F.col("event_id").alias("offset"), F.col("user_id").cast("string").alias("source"), F.col("props").alias("payload"), F.col("ts").alias("received_at"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "del").otherwise("set")
    return events(spark, sf_dir).select((F.col("event_id") + 1).alias("index"), op.alias("op"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"))


def spelt_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index, data): commands as JSON in eight spellings; 4 to 6 are malformed."""
    key, value = F.col("user_id").cast("string"), F.regexp_replace("props", '"', "'")
    kind = F.col("event_id") % 8
    made = lambda op, k, v, more="": F.concat(F.lit('{"op":"' + op + '","key":'), k, v, F.lit(more + "}"))
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    valued = F.concat(F.lit(',"value":'), text(value))
    data = (
        F.when(kind == 1, made("del", text(key), F.lit("")))
        .when(kind == 2, made("incr", text(key), valued))
        .when(kind == 3, made("set", text(key), valued, ',"by":{"op":1}'))
        .when(kind == 4, F.concat(F.lit('{"op":"set","key":'), text(key)))
        .when(kind == 5, made("set", key, valued))
        .when(kind == 6, F.concat(made("set", text(key), valued), F.lit(" and more")))
        .when(kind == 7, made("set", text(key), F.lit(',"value":null')))
        .otherwise(made("set", text(key), valued))
    )
    return events(spark, sf_dir).select((F.col("event_id") + 1).alias("index"), data.alias("data"))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(phase, us, seconds, status): an event's value as a request's milliseconds, its type as the answer."""
    status = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, 503).when(F.col("event_id") % 3 == 1, 429).otherwise(0)).otherwise(202)
    us = F.floor(F.col("value") * 1000).cast("long")
    return events(spark, sf_dir).select(F.col("event_type").alias("phase"), us.alias("us"), (F.col("value") / 1000).alias("seconds"), status.alias("status"), "event_id")


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in ten spellings, sound and unsound."""
    user, props = F.col("user_id").cast("string"), F.regexp_replace("props", '"', "'")
    kind = F.col("event_id") % 10
    field = lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    both = F.concat(field("source", user), F.lit(","), field("payload", props))
    raw = (
        F.when(kind == 1, F.concat(F.lit("{"), field("source", user), F.lit("}")))
        .when(kind == 2, F.concat(F.lit("{"), both, F.lit(',"more":"x"}')))
        .when(kind == 3, F.concat(F.lit('{"source":'), user, F.lit(","), field("payload", props), F.lit("}")))
        .when(kind == 4, F.concat(F.lit("{"), both))
        .when(kind == 5, F.concat(F.lit("{"), both, F.lit("} and more")))
        .when(kind == 6, F.concat(F.lit("{"), field("SOURCE", user), F.lit(","), field("Payload", props), F.lit("}")))
        .when(kind == 7, F.concat(F.lit('{"source":null,'), field("payload", props), F.lit("}")))
        .when(kind == 8, F.concat(F.lit('{"source":"first",'), both, F.lit("}")))
        .otherwise(F.concat(F.lit("{"), both, F.lit("}")))
    )
    return events(spark, sf_dir).select("event_id", raw.alias("raw"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of 500 records each, in which every 97th record cuts off a suffix."""
    e = F.col("event_id")
    index = e % 500 - 25 * F.floor(e % 500 / 97)
    marker = e % 97 == 0
    return events(spark, sf_dir).select(F.floor(e / 500).alias("log"), e.alias("seq"), F.when(marker, 2).otherwise(1).alias("rec_type"), index.alias("index"), (1 + F.floor(e % 500 / 97)).alias("term"), F.when(marker, index - 20).alias("from_index"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log of entries whose term grows every hundred."""
    return events(spark, sf_dir).select(F.col("event_id").alias("index"), F.floor(1 + F.col("event_id") / 100).alias("term"), "event_type")


def follower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nodes' logs: followers hold the first 70 of each hundred entries."""
    e = F.col("event_id")
    return events(spark, sf_dir).filter(F.floor(e / 10) % 100 < 70).select((F.floor(e / 1000) * 10 + e % 10).alias("node"), (F.floor(e / 10) % 100).alias("index"), (1 + F.floor(e / 100) % 10).alias("term"), F.lit("follower").alias("origin"))


def leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """... and leaders the last 70, with other terms from an index on that differs by node."""
    e = F.col("event_id")
    index = F.floor(e / 10) % 100
    term = 1 + F.floor(e / 100) % 10 + F.when(index >= 40 + 4 * (e % 10), 1).otherwise(0)
    return events(spark, sf_dir).filter(index >= 30).select((F.floor(e / 1000) * 10 + e % 10).alias("node"), index.alias("index"), term.alias("term"), F.lit("leader").alias("origin"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leader's view for each event: what its peers hold, old and new."""
    e = F.col("event_id")
    peers = lambda *m: F.array(*(F.least(e * k % p, F.lit(12)).cast("long") for k, p in m))
    return events(spark, sf_dir).select(e.alias("id"), peers((1, 7), (3, 13), (5, 11), (2, 17)).alias("matches"), peers((7, 13), (1, 5)).alias("new_matches"), F.lit(12).cast("long").alias("last_index"), (1 + e % 4).alias("current_term"), (e % 3).alias("commit_index"), (e % 2 == 1).alias("joint"))


def state_entries(states_: DataFrame) -> DataFrame:
    """Twelve entries for each state, four to a term."""
    rows = states_.select("id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("i"))
    return rows.select("id", F.col("i").cast("long").alias("index"), (1 + F.floor(F.col("i") / 4)).alias("term"))


def voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    names = lambda *m: F.array(*(F.concat(F.lit("n"), (e * k % p).cast("string")) for k, p in m))
    return events(spark, sf_dir).select("event_id", names((1, 3), (1, 5), (3, 7)).alias("voters"), names((1, 4), (2, 9)).alias("new_voters"), names((1, 3), (1, 4), (5, 6)).alias("acks"), (e % 2 == 1).alias("joint"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf_dir).select((e * 100).alias("index"), (1 + F.floor(e / 1000)).alias("term"), F.floor(F.col("value") * 10000).alias("size"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), (F.col("value") / 100).alias("seconds"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as nodes; every fifth is unhealthy."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.concat(F.lit("node-"), F.col("n_nationkey").cast("string")).alias("node_id"), F.concat(F.lit("host-"), F.col("n_nationkey").cast("string"), F.lit(":7000")).alias("addr"), (F.col("n_nationkey") % 5 != 4).alias("healthy"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and health of nodes over time, from each user's events."""
    role = F.when(F.col("event_type") == "purchase", "leader").when(F.col("event_type") == "signup", "candidate").otherwise("follower")
    return events(spark, sf_dir).select(F.col("user_id").cast("string").alias("node_id"), F.col("event_id").alias("moment"), role.alias("role"), (F.col("event_type") != "error").alias("healthy"), (1 + F.floor(F.col("event_id") / 100)).alias("term"))
