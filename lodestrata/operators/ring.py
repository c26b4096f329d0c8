"""Consistent-hash routing as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.binary import fnv1a

VNODES = 150
#: The hash space is cut into 2 ** (32 - CELL) cells, by which keys meet intervals.
CELL = 20
#: A ring up to so many points goes to every task.
POINTS = 1 << 16


def points(nodes: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """(point, node_id): each node's hashed points; two nodes that hash alike share one, the greater id takes it."""
    spread = nodes.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
    hashed = spread.select("node_id", fnv1a(F.concat_ws("#", "node_id", "v")).alias("point"))
    return hashed.groupBy("point").agg(F.max("node_id").alias("node_id"))


def without(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    return nodes.join(gone.select("node_id").distinct(), "node_id", "left_anti")


def intervals(ring: DataFrame) -> DataFrame:
    """(low, high, node_id): the hashes above low up to high belong to the node; the last wraps to the first.

    One row for each point and a second for the wrap; the ring is a table of
    nodes, not of keys.
    """
    order = Window.orderBy("point")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ring.select(F.coalesce(F.lag("point").over(order), F.lit(-1).cast("long")).alias("low"), F.col("point").alias("high"), "node_id", F.max("point").over(whole).alias("top"), F.min("point").over(whole).alias("least"))
    wrap = rows.filter("high = least").select(F.col("top").alias("low"), F.lit((1 << 32) - 1).alias("high"), "node_id")
    return rows.select("low", "high", "node_id").unionByName(wrap)


def route(keys: DataFrame, ring: DataFrame, key: str = "source") -> DataFrame:
    """keys with key_hash and node_id, both null for a null key, node_id null on an empty ring.

    Keys are hashed where they are scanned. Intervals are spread over the cells
    of the hash space that they touch, so that keys meet them by an equality of
    cells; a ring of up to POINTS goes to every task, and keys stay where they
    are. For larger ones the distinct keys are shuffled.
    """
    cells = intervals(ring).withColumn("cell", F.explode(F.sequence(F.shiftright(F.col("low") + 1, CELL), F.shiftright("high", CELL))))
    inside = (F.col("key_hash") > F.col("low")) & (F.col("key_hash") <= F.col("high"))

    def owned(rows: DataFrame, places: DataFrame) -> DataFrame:
        hashed = rows.withColumn("key_hash", fnv1a(F.col(key))).withColumn("__cell", F.shiftright("key_hash", CELL))
        met = hashed.join(places, (F.col("__cell") == F.col("cell")) & inside, "left")
        return met.select(*(c for c in rows.columns if c not in ("key_hash", "node_id")), "key_hash", "node_id")

    if ring.limit(POINTS + 1).count() <= POINTS:
        return owned(keys, F.broadcast(cells))
    by_key = owned(keys.select(key).filter(F.col(key).isNotNull()).distinct(), cells).withColumnRenamed(key, "__key")
    return keys.join(by_key, F.col(key) == F.col("__key"), "left").drop("__key")


def load(keys: DataFrame, ring: DataFrame, key: str = "source") -> DataFrame:
    return route(keys.select(key).distinct(), ring, key).filter(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.count("*").alias("keys"))


def decisions(routed: DataFrame, nodes: DataFrame, own: str) -> DataFrame:
    """routed with where each write goes: local, forward, 503 where the owner is unhealthy (never another node), not_found without an owner."""
    known = nodes.select("node_id", "healthy", "addr")
    place = F.when(F.col("node_id").isNull(), "not_found").when(F.col("node_id") == own, "local").when(F.col("healthy"), "forward").otherwise("unavailable")
    return routed.join(F.broadcast(known) if nodes.limit(POINTS + 1).count() <= POINTS else known, "node_id", "left").withColumn("route", place)


def leader_redirect(requests: DataFrame, addresses: DataFrame) -> DataFrame:
    """Requests at followers with the leader's address: 307, or 503 without one."""
    joined = requests.join(addresses.select(F.col("node_id").alias("leader_id"), "url"), "leader_id", "left")
    return joined.withColumn("status", F.when(F.col("url").isNotNull(), 307).otherwise(503))


def ring_size(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_distinct("node_id").alias("ring_size"))
