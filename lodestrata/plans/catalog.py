"""The engine's registered queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import storage
from lodestrata.functions import binary, text
from lodestrata.operators import changes, kv, metrics, raftlog, ring, validate
from lodestrata.plans import adapt
from lodestrata.sources import eventlog, files
from lodestrata.sources import frames as fr
from lodestrata.streaming import queries as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The SQL views that stand for `adapt`.
LOG = "log AS (SELECT event_id AS \"offset\", CAST(user_id AS VARCHAR) AS source, props AS payload, ts AS received_at FROM events)"
COMMANDS = "commands AS (SELECT event_id + 1 AS idx, CASE WHEN event_type = 'error' THEN 'del' ELSE 'set' END AS op, CAST(user_id AS VARCHAR) AS key, props AS value FROM events)"
LATENCIES = "lat AS (SELECT event_type AS phase, CAST(floor(value * 1000) AS BIGINT) AS us, value / 1000 AS seconds, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 503 WHEN 1 THEN 429 ELSE 0 END ELSE 202 END AS status, event_id FROM events)"
RECORDS = "records AS (SELECT event_id // 500 AS log, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 2 ELSE 1 END AS rec_type, event_id % 500 - 25 * ((event_id % 500) // 97) AS idx, 1 + (event_id % 500) // 97 AS term, CASE WHEN event_id % 97 = 0 THEN event_id % 500 - 25 * ((event_id % 500) // 97) - 20 END AS from_index FROM events)"
ENTRIES = "entries AS (SELECT event_id AS idx, 1 + event_id // 100 AS term FROM events)"
FOLLOWER = "follower AS (SELECT (event_id // 1000) * 10 + event_id % 10 AS node, (event_id // 10) % 100 AS idx, 1 + (event_id // 100) % 10 AS term, 'follower' AS origin FROM events WHERE (event_id // 10) % 100 < 70)"
LEADER = "leader AS (SELECT (event_id // 1000) * 10 + event_id % 10 AS node, (event_id // 10) % 100 AS idx, 1 + (event_id // 100) % 10 + CASE WHEN (event_id // 10) % 100 >= 40 + 4 * (event_id % 10) THEN 1 ELSE 0 END AS term, 'leader' AS origin FROM events WHERE (event_id // 10) % 100 >= 30)"
STATES = """states AS (SELECT event_id AS id,
  [least(event_id * 1 % 7, 12), least(event_id * 3 % 13, 12), least(event_id * 5 % 11, 12), least(event_id * 2 % 17, 12)] AS matches,
  [least(event_id * 7 % 13, 12), least(event_id * 1 % 5, 12)] AS new_matches, 12 AS last_index,
  1 + event_id % 4 AS current_term, event_id % 3 AS commit_index, event_id % 2 = 1 AS joint FROM events)"""
VOTERS = """v AS (SELECT event_id, ['n' || event_id * 1 % 3, 'n' || event_id * 1 % 5, 'n' || event_id * 3 % 7] AS voters,
  ['n' || event_id * 1 % 4, 'n' || event_id * 2 % 9] AS new_voters,
  ['n' || event_id * 1 % 3, 'n' || event_id * 1 % 4, 'n' || event_id * 5 % 6] AS acks, event_id % 2 = 1 AS joint FROM events)"""
SNAPSHOTS = "snaps AS (SELECT event_id * 100 AS idx, 1 + event_id // 1000 AS term, CAST(floor(value * 10000) AS BIGINT) AS size, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, value / 100 AS seconds FROM events)"
NODES = "nodes AS (SELECT 'node-' || n_nationkey AS node_id, 'host-' || n_nationkey || ':7000' AS addr, n_nationkey % 5 <> 4 AS healthy FROM nation)"
SERIES = "series AS (SELECT CAST(user_id AS VARCHAR) AS node_id, event_id AS moment, CASE event_type WHEN 'purchase' THEN 'leader' WHEN 'signup' THEN 'candidate' ELSE 'follower' END AS role, event_type <> 'error' AS healthy, 1 + event_id // 100 AS term FROM events)"
FNV = "list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"
RING = f"""points AS (SELECT point, max(node_id) AS node_id FROM (
  SELECT node_id, {FNV.format("node_id || '#' || i")} AS point FROM nodes, range(150) r(i)) GROUP BY point),
owners AS (SELECT source, key_hash, coalesce(
    (SELECT node_id FROM points WHERE point >= key_hash ORDER BY point LIMIT 1), (SELECT node_id FROM points ORDER BY point LIMIT 1)) AS node_id
  FROM (SELECT source, {FNV.format('source')} AS key_hash FROM (SELECT DISTINCT source FROM log)))"""
SIZE = "(24 + strlen(source) + strlen(payload))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.withColumnsRenamed(names)


# --- the keyed view -------------------------------------------------------------------------------------------------


@query("kv_latest", f"WITH {LOG} SELECT source, \"offset\" AS log_offset, payload, received_at FROM log QUALIFY row_number() OVER (PARTITION BY source ORDER BY \"offset\" DESC) = 1")
def kv_latest(spark, d):
    return _renamed(kv.latest(adapt.log(spark, d)), offset="log_offset")


@query("kv_get", f"WITH {LOG} SELECT source, max(\"offset\") AS log_offset, arg_max(payload, \"offset\") AS payload FROM log WHERE source = '8' GROUP BY source")
def kv_get(spark, d):
    return _renamed(kv.get(adapt.log(spark, d), "8", values=("payload",)), offset="log_offset")


@query("kv_json", f"WITH {LOG} SELECT source, '{{\"source\":\"' || source || '\",\"payload\":\"' || replace(arg_max(payload, \"offset\"), '\"', '\\\"') || '\",\"received_at_unix_ns\":' || max(\"offset\") * 1000 || '}}' AS json FROM log GROUP BY source")
def kv_json(spark, d):
    rows = kv.latest(adapt.log(spark, d), values=("payload",))
    return rows.select("source", text.event_json(F.col("source"), F.col("payload"), F.col("offset") * 1000).alias("json"))


@query("kv_live_count", f"WITH {LOG} SELECT count(DISTINCT source) AS live_keys FROM log")
def kv_live_count(spark, d):
    return kv.live_count(adapt.log(spark, d))


@query("compacted_log", f"WITH {LOG} SELECT \"offset\" AS log_offset, source, payload FROM log QUALIFY max(\"offset\") OVER (PARTITION BY source) = \"offset\"")
def compacted_log(spark, d):
    return _renamed(kv.compacted(adapt.log(spark, d)), offset="log_offset").select("log_offset", "source", "payload")


@query("compaction_stats", f"""WITH {LOG}, r AS (SELECT *, {SIZE} AS size, max("offset") OVER (PARTITION BY source) = "offset" AS live FROM log)
SELECT count(*) AS records, count(*) FILTER (live) AS live_records, count(*) FILTER (NOT live) AS dead_records,
       sum(size)::BIGINT AS bytes, (sum(size) FILTER (live))::BIGINT AS live_bytes FROM r""")
def compaction_stats(spark, d):
    return kv.compaction_stats(adapt.log(spark, d))


@query("wal_offsets", f"WITH {LOG} SELECT \"offset\" AS event_id, coalesce(sum({SIZE}) OVER (ORDER BY \"offset\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM log")
def wal_offsets(spark, d):
    return kv.offsets(adapt.log(spark, d), "offset").select(F.col("offset").alias("event_id"), "byte_offset")


@query("fold_set_del", f"WITH {COMMANDS} SELECT key, value, idx AS log_index FROM commands QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC) = 1 AND op = 'set'")
def fold_set_del(spark, d):
    return _renamed(kv.fold(adapt.commands(spark, d)), index="log_index")


@query("fold_as_of", f"WITH {COMMANDS} SELECT key, value, idx AS log_index FROM commands WHERE idx <= 600 QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC) = 1 AND op = 'set'")
def fold_as_of(spark, d):
    return _renamed(kv.fold(adapt.commands(spark, d), 600), index="log_index")


@query("last_applied", "SELECT arg_max(event_id + 1, event_id) AS last_applied FROM events WHERE event_type = 'view'")
def last_applied(spark, d):
    # views stand for the checkpoint marks among a store's records
    rows = adapt.events(spark, d).filter("event_type = 'view'")
    return kv.last_applied(rows.select((F.col("event_id") + 1).alias("raft_index"), F.col("event_id").alias("offset")))


@query("admission_max_keys", f"WITH {LOG}, f AS (SELECT source, min(\"offset\") AS first_offset FROM log GROUP BY source) SELECT source, first_offset, row_number() OVER (ORDER BY first_offset) <= 100 AS admitted FROM f")
def admission_max_keys(spark, d):
    return kv.admitted(adapt.log(spark, d), 100)


@query("dedup_apply", f"WITH {COMMANDS} SELECT DISTINCT idx AS log_index, op, key FROM (SELECT * FROM commands UNION ALL SELECT * FROM commands WHERE idx % 3 = 0) WHERE idx > 500")
def dedup_apply(spark, d):
    rows = adapt.commands(spark, d)
    return _renamed(kv.unapplied(rows.unionByName(rows.filter("index % 3 = 0")), 500).select("index", "op", "key"), index="log_index")


@query("recover_state", f"""WITH {COMMANDS}, base AS (SELECT key, value FROM commands WHERE idx <= 400 QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC) = 1 AND op = 'set'),
u AS (SELECT 400 AS idx, 'set' AS op, key, value FROM base UNION ALL SELECT idx, op, key, value FROM commands WHERE idx > 400)
SELECT key, value, idx::BIGINT AS log_index FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC) = 1 AND op = 'set'""")
def recover_state(spark, d):
    rows = adapt.commands(spark, d)
    even, odd = rows.filter("index % 2 = 0"), rows.filter("index % 2 = 1")
    return _renamed(kv.recovered(kv.fold(rows, 400).select("key", "value"), 400, even, odd), index="log_index")


@query("user_keys", f"WITH {COMMANDS}, k AS (SELECT CASE WHEN idx % 7 = 0 THEN '__raft_last_applied__' ELSE key END AS key FROM commands) SELECT key, count(*) AS n FROM k WHERE key <> '__raft_last_applied__' GROUP BY key")
def user_keys(spark, d):
    key = F.when(F.col("index") % 7 == 0, F.lit("__raft_last_applied__")).otherwise(F.col("key"))
    return validate.user_keys(adapt.commands(spark, d).select(key.alias("key"))).groupBy("key").agg(F.count("*").alias("n"))


_FOLDED = "SELECT key, value, idx AS log_index FROM commands QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC) = 1 AND op = 'set'"


@query("kv_find", f"WITH {COMMANDS}, f AS ({_FOLDED}), wanted(key) AS (VALUES ('3'), ('8'), ('21'), ('none')) SELECT w.key AS wanted, f.value, f.log_index FROM wanted w JOIN f ON f.key = w.key")
def kv_find(spark, d):
    found = [_renamed(kv.find(adapt.commands(spark, d), k), index="log_index", key="wanted") for k in ("3", "8", "21", "none")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


#: Commands as JSON in eight spellings; 4 to 6 are malformed, 2 and 7 sound but odd.
SPELT = """spelt AS (SELECT event_id + 1 AS idx, event_id % 8 AS kind, CAST(user_id AS VARCHAR) AS key, replace(props, '"', chr(39)) AS value FROM events),
decoded AS (SELECT idx, kind NOT IN (4, 5, 6) AS well_formed, CASE WHEN kind IN (4, 5, 6) THEN NULL WHEN kind = 1 THEN 'del' WHEN kind = 2 THEN 'incr' ELSE 'set' END AS op,
  CASE WHEN kind IN (4, 5, 6) THEN NULL ELSE key END AS key, CASE WHEN kind IN (4, 5, 6) THEN NULL WHEN kind IN (1, 7) THEN '' ELSE value END AS value FROM spelt)"""


@query("command_decode", f"WITH {SPELT} SELECT idx AS log_index, op, key, value, well_formed, CASE WHEN NOT well_formed THEN 'skipped' WHEN op = 'incr' THEN 'none' ELSE op END AS effect FROM decoded")
def command_decode(spark, d):
    return _renamed(kv.applied(adapt.spelt_commands(spark, d)).select("index", "op", "key", "value", "well_formed", "effect"), index="log_index")


@query("command_apply", f"WITH {SPELT} SELECT key, value, idx AS log_index FROM decoded WHERE op IN ('set', 'del') QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC) = 1 AND op = 'set'")
def command_apply(spark, d):
    return _renamed(kv.fold(kv.decoded(adapt.spelt_commands(spark, d)).filter("well_formed")), index="log_index")


@query("command_applied_upto", f"WITH {SPELT} SELECT coalesce(max(idx), 0) AS last_applied FROM decoded WHERE well_formed")
def command_applied_upto(spark, d):
    return kv.applied_upto(adapt.spelt_commands(spark, d))


@query("admission_with_deletes", """WITH RECURSIVE c AS (SELECT event_id // 100 AS log, event_id % 100 AS idx, CASE WHEN event_type IN ('error', 'purchase') THEN 'del' ELSE 'set' END AS op, CAST(user_id % 12 AS VARCHAR) AS key FROM events),
steps AS (
  SELECT DISTINCT log, -1::BIGINT AS idx, NULL::VARCHAR AS op, NULL::VARCHAR AS key, true AS admitted, []::VARCHAR[] AS live FROM c
  UNION ALL
  SELECT c.log, c.idx, c.op, c.key, c.op = 'del' OR list_contains(s.live, c.key) OR len(s.live) < 5,
         CASE WHEN c.op = 'del' THEN list_filter(s.live, lambda x: x <> c.key) WHEN list_contains(s.live, c.key) OR len(s.live) >= 5 THEN s.live ELSE list_append(s.live, c.key) END
  FROM steps s JOIN c ON c.log = s.log AND c.idx = s.idx + 1)
SELECT log, idx AS log_index, op, key, admitted FROM steps WHERE idx >= 0""")
def admission_with_deletes(spark, d):
    e = adapt.events(spark, d)
    op = F.when(F.col("event_type").isin("error", "purchase"), "del").otherwise("set")
    rows = e.select(F.expr("event_id div 100").alias("log"), (F.col("event_id") % 100).alias("index"), op.alias("op"), (F.col("user_id") % 12).cast("string").alias("key"))
    return _renamed(kv.admitted_with_deletes(rows, 5, "log"), index="log_index")


# --- codecs and text ------------------------------------------------------------------------------------------------


@query("event_codec", f"WITH {LOG} SELECT \"offset\" AS event_id, lower(printf('%04x', strlen(source)) || hex(source::BLOB) || printf('%04x', strlen(payload)) || hex(payload::BLOB)) AS encoded, source, payload FROM log")
def event_codec(spark, d):
    rows = adapt.log(spark, d).withColumn("data", binary.encode_event(F.col("source"), F.col("payload")))
    back = binary.decode_event(F.col("data"))
    return rows.select(F.col("offset").alias("event_id"), F.lower(F.hex("data")).alias("encoded"), back["source"].alias("source"), back["payload"].alias("payload"))


@query("processor_projection", "SELECT CAST(user_id AS VARCHAR) AS source, ts AS received_at, strlen(props)::INTEGER AS payload_length FROM events")
def processor_projection(spark, d):
    return adapt.log(spark, d).select("source", "received_at", F.octet_length("payload").alias("payload_length"))


@query("duration_text", f"WITH {LATENCIES} SELECT event_id, CASE WHEN us >= 1000 THEN printf('%.2fms', us / 1000.0) ELSE us || 'µs' END AS shown FROM lat")
def duration_text(spark, d):
    return adapt.latencies(spark, d).select("event_id", text.duration(F.col("us")).alias("shown"))


@query("parse_peers", "SELECT n_nationkey, 'p' || n_nationkey AS id, 'h' || n_regionkey || ':70' AS addr FROM nation UNION ALL SELECT n_nationkey, 'q', '10.0.0.' || n_nationkey FROM nation")
def parse_peers(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    listed = F.concat(F.lit(" p"), F.col("n_nationkey"), F.lit(":h"), F.col("n_regionkey"), F.lit(":70 ,bad,:x,y:, q:10.0.0."), F.col("n_nationkey"))
    return n.select("n_nationkey", F.explode(text.peers(listed)).alias("p")).select("n_nationkey", "p.id", "p.addr")


@query("parse_url_map", "SELECT n_nationkey, 'p' || n_nationkey AS id, 'http://h/?a=' || n_regionkey AS url FROM nation")
def parse_url_map(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    listed = F.concat(F.lit("p"), F.col("n_nationkey"), F.lit("=http://h/?a="), F.col("n_regionkey"), F.lit(", bad"))
    return n.select("n_nationkey", F.explode(text.url_map(listed)).alias("p")).select("n_nationkey", "p.id", "p.url")


# --- validation -----------------------------------------------------------------------------------------------------


@query("validate_status", "SELECT event_id, CASE WHEN event_id % 10 IN (2, 3, 4) THEN 400 WHEN event_id % 10 IN (1, 7) THEN 422 ELSE 202 END AS status, CASE WHEN event_id % 10 NOT IN (2, 3, 4) THEN CASE WHEN event_id % 10 = 7 THEN '' ELSE CAST(user_id AS VARCHAR) END END AS source FROM events")
def validate_status(spark, d):
    return validate.requests(adapt.raw_requests(spark, d)).select("event_id", "status", "source")


@query("validate_command", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'set' WHEN event_id % 5 = 1 THEN 'incr' ELSE 'del' END AS effective_op, CASE WHEN event_id % 5 = 1 OR event_id % 7 = 0 THEN 400 ELSE 204 END AS status FROM events")
def validate_command(spark, d):
    e = F.col("event_id")
    rows = adapt.events(spark, d).select("event_id", F.when(e % 5 == 0, "").when(e % 5 == 1, "incr").otherwise("del").alias("op"), F.when(e % 7 == 0, "").otherwise(F.col("user_id").cast("string")).alias("key"))
    return validate.commands(rows).select("event_id", "effective_op", "status")


@query("validate_config_change", "SELECT event_id, CASE WHEN event_id % 3 = 2 OR event_id % 4 = 0 THEN 400 ELSE 200 END AS status FROM events")
def validate_config_change(spark, d):
    e = F.col("event_id")
    action = F.when(e % 3 == 0, "add").when(e % 3 == 1, "remove").otherwise("replace")
    rows = adapt.events(spark, d).select("event_id", action.alias("action"), F.when(e % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("n"))).alias("nodes"))
    return validate.config_changes(rows).select("event_id", "status")


@query("log_up_to_date", "SELECT event_id, (event_id % 5, event_id % 7) >= (event_id % 3, event_id % 11) AS up_to_date FROM events")
def log_up_to_date(spark, d):
    e = F.col("event_id")
    return adapt.events(spark, d).select("event_id", validate.log_up_to_date(e % 5, e % 7, e % 3, e % 11).alias("up_to_date"))


@query("lease_holds", "SELECT event_id, value < 20 AS holds FROM events")
def lease_holds(spark, d):
    return adapt.events(spark, d).select("event_id", validate.lease_holds(F.col("value"), F.lit(20)).alias("holds"))


@query("magic_check", "SELECT event_id % 4 = 0 AS sound, count(*) AS n FROM events GROUP BY 1")
def magic_check(spark, d):
    magic = F.when(F.col("event_id") % 4 == 0, F.lit(0xCAFEBABE)).otherwise(F.col("event_id"))
    return adapt.events(spark, d).select(validate.magic_ok(magic).alias("sound")).groupBy("sound").agg(F.count("*").alias("n"))


@query("ingest_outcomes", """WITH t AS (SELECT *, event_id % 13 <> 0 AS durable, sum(CASE WHEN event_id % 13 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_id // 50 ORDER BY event_id) AS place FROM events)
SELECT event_id, CASE WHEN NOT durable THEN 'wal_error' WHEN place > 40 THEN 'overloaded' ELSE 'ok' END AS outcome, CASE WHEN NOT durable THEN 500 WHEN place > 40 THEN 429 ELSE 202 END AS status, durable AS visible FROM t""")
def ingest_outcomes(spark, d):
    rows = adapt.events(spark, d).select("event_id", F.expr("event_id div 50").alias("interval"), (F.col("event_id") % 13 != 0).alias("durable"))
    shed = validate.queued(rows.filter("durable"), "interval", "event_id", 40).unionByName(rows.filter("NOT durable").withColumn("queued", F.lit(False)))
    return validate.outcomes(shed, F.col("durable"), F.col("queued")).select("event_id", "outcome", "status", "visible")


@query("ingest_visible", """WITH t AS (SELECT * FROM events WHERE event_id % 13 <> 0) SELECT CAST(user_id AS VARCHAR) AS source, max(event_id) AS log_offset, arg_max(props, event_id) AS payload FROM t GROUP BY user_id""")
def ingest_visible(spark, d):
    rows = adapt.log(spark, d).withColumns({"durable": F.col("offset") % 13 != 0, "queued": F.col("offset") % 7 != 0})
    seen = validate.outcomes(rows, F.col("durable"), F.col("queued")).filter("visible")
    return _renamed(kv.latest(seen, values=("payload",)), offset="log_offset")


# --- routing --------------------------------------------------------------------------------------------------------


@query("ring_points", f"WITH {LOG}, {NODES}, {RING} SELECT point, node_id FROM points")
def ring_points(spark, d):
    return ring.points(adapt.nodes(spark, d))


@query("ring_route", f"WITH {LOG}, {NODES}, {RING} SELECT source, key_hash, node_id FROM owners")
def ring_route(spark, d):
    return ring.route(adapt.log(spark, d).select("source").distinct(), ring.points(adapt.nodes(spark, d)))


@query("ring_load", f"WITH {LOG}, {NODES}, {RING} SELECT node_id, count(*) AS keys FROM owners GROUP BY node_id")
def ring_load(spark, d):
    return ring.load(adapt.log(spark, d), ring.points(adapt.nodes(spark, d)))


@query("ring_remove", f"WITH {LOG}, nodes AS (SELECT 'node-' || n_nationkey AS node_id FROM nation WHERE n_nationkey % 2 = 0), {RING} SELECT source, node_id FROM owners")
def ring_remove(spark, d):
    nodes = adapt.nodes(spark, d)
    gone = spark.read.parquet(f"{d}/nation.parquet").filter("n_nationkey % 2 = 1").select(F.concat(F.lit("node-"), F.col("n_nationkey").cast("string")).alias("node_id"))
    return ring.route(adapt.log(spark, d).select("source").distinct(), ring.points(ring.without(nodes, gone))).select("source", "node_id")


@query("ring_size", f"WITH {NODES} SELECT count(DISTINCT node_id) AS ring_size FROM nodes")
def ring_size(spark, d):
    return ring.ring_size(adapt.nodes(spark, d))


@query("route_decision", f"WITH {LOG}, {NODES}, {RING} SELECT l.\"offset\" AS event_id, o.node_id, CASE WHEN o.node_id = 'node-0' THEN 'local' WHEN n.healthy THEN 'forward' ELSE 'unavailable' END AS route FROM log l JOIN owners o ON o.source = l.source JOIN nodes n ON n.node_id = o.node_id")
def route_decision(spark, d):
    nodes = adapt.nodes(spark, d)
    routed = ring.route(adapt.log(spark, d), ring.points(nodes))
    return ring.decisions(routed, nodes, "node-0").select(F.col("offset").alias("event_id"), "node_id", "route")


@query("route_read", f"""WITH {LOG}, {NODES}, {RING}, wanted AS (SELECT DISTINCT CAST(user_id + 5 AS VARCHAR) AS source FROM events),
w AS (SELECT source, {FNV.format('source')} AS h FROM wanted),
o AS (SELECT source, coalesce((SELECT node_id FROM points WHERE point >= h ORDER BY point LIMIT 1), (SELECT node_id FROM points ORDER BY point LIMIT 1)) AS node_id FROM w),
v AS (SELECT source, arg_max(payload, "offset") AS payload FROM log GROUP BY source)
SELECT o.source, CASE WHEN o.node_id <> 'node-0' AND NOT n.healthy THEN 503 WHEN v.source IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN o.node_id = 'node-0' OR n.healthy THEN v.payload END AS payload
FROM o JOIN nodes n ON n.node_id = o.node_id LEFT JOIN v ON v.source = o.source""")
def route_read(spark, d):
    nodes = adapt.nodes(spark, d)
    wanted = adapt.events(spark, d).select((F.col("user_id") + 5).cast("string").alias("source")).distinct()
    placed = ring.decisions(ring.route(wanted, ring.points(nodes)), nodes, "node-0")
    view = kv.latest(adapt.log(spark, d), values=("payload",)).select("source", "offset", "payload")
    down = F.col("route") == "unavailable"
    out = placed.join(view, "source", "left")
    return out.select("source", F.when(down, 503).when(F.col("offset").isNull(), 404).otherwise(200).alias("status"), F.when(~down, F.col("payload")).alias("payload"))


@query("route_not_found", f"""WITH {LOG}, {NODES}, {RING} SELECT l."offset" AS event_id, CASE WHEN l."offset" % 3 > 0 THEN o.node_id END AS node_id,
  CASE WHEN l."offset" % 3 = 0 THEN 'not_found' WHEN o.node_id = 'node-0' THEN 'local' WHEN n.healthy THEN 'forward' ELSE 'unavailable' END AS route
FROM log l JOIN owners o ON o.source = l.source JOIN nodes n ON n.node_id = o.node_id""")
def route_not_found(spark, d):
    nodes = adapt.nodes(spark, d)
    keyed = adapt.log(spark, d).withColumn("source", F.when(F.col("offset") % 3 > 0, F.col("source")))  # null keys have no owner
    return ring.decisions(ring.route(keyed, ring.points(nodes)), nodes, "node-0").select(F.col("offset").alias("event_id"), "node_id", "route")


@query("route_empty_ring", "SELECT CAST(n_nationkey AS VARCHAR) AS source, NULL::VARCHAR AS node_id, 'not_found' AS route FROM nation")
def route_empty_ring(spark, d):
    nodes = adapt.nodes(spark, d).limit(0)
    keys = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("source"))
    return ring.decisions(ring.route(keys, ring.points(nodes)), nodes, "node-0").select("source", "node_id", "route")


@query("leader_redirect", "SELECT e.event_id, CASE WHEN n.n_nationkey IS NULL THEN 503 ELSE 307 END AS status, 'http://host-' || n.n_nationkey AS url FROM events e LEFT JOIN nation n ON n.n_nationkey = e.event_id % 30")
def leader_redirect(spark, d):
    asked = adapt.events(spark, d).select("event_id", F.concat(F.lit("node-"), (F.col("event_id") % 30).cast("string")).alias("leader_id"))
    known = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("node-"), F.col("n_nationkey").cast("string")).alias("node_id"), F.concat(F.lit("http://host-"), F.col("n_nationkey").cast("string")).alias("url"))
    return ring.leader_redirect(asked, known).select("event_id", "status", "url")


# --- metrics --------------------------------------------------------------------------------------------------------


@query("status_counters", f"WITH {LATENCIES} SELECT status, count(*) AS n, sum(us)::BIGINT AS total FROM lat GROUP BY status")
def status_counters(spark, d):
    return metrics.counters(adapt.latencies(spark, d), "status", F.col("us"))


_LE = ", ".join(f"({b!r}::DOUBLE)" for b in metrics.LATENCY_BOUNDS)


@query("latency_histogram_le", f"WITH {LATENCIES}, b(le) AS (VALUES {_LE}, (NULL)) SELECT phase, le, (count(*) FILTER (le IS NULL OR seconds <= le)) AS n FROM lat, b GROUP BY phase, le")
def latency_histogram_le(spark, d):
    return metrics.cumulative(adapt.latencies(spark, d), "phase", F.col("seconds"))


_BUCKET = "CASE WHEN us <= 0 THEN 0 ELSE least(31, length(bin(us))) END"


@query("log2_histogram", f"WITH {LATENCIES} SELECT ({_BUCKET})::INTEGER AS bucket, count(*) AS cnt FROM lat GROUP BY 1")
def log2_histogram(spark, d):
    return metrics.log2_histogram(adapt.latencies(spark, d), "us")


@query("log2_percentiles", f"""WITH {LATENCIES}, h AS (SELECT {_BUCKET} AS bucket, count(*) AS cnt FROM lat GROUP BY 1),
r AS (SELECT bucket, sum(cnt) OVER (ORDER BY bucket) AS cum, sum(cnt) OVER () AS total FROM h), p(pct) AS (VALUES (50.0::DOUBLE), (90.0), (95.0), (99.0))
SELECT pct, CASE WHEN min(bucket) = 0 THEN 1 ELSE pow(2, min(bucket)) END::BIGINT AS us FROM r, p WHERE cum >= greatest(floor(total * pct / 100), 1) GROUP BY pct""")
def log2_percentiles(spark, d):
    return metrics.log2_percentiles(metrics.log2_histogram(adapt.latencies(spark, d), "us"), (50.0, 90.0, 95.0, 99.0))


@query("latency_mean", f"WITH {LATENCIES} SELECT (sum(us) // count(*))::BIGINT AS mean_us, count(*) AS n FROM lat")
def latency_mean(spark, d):
    return metrics.mean_and_count(adapt.latencies(spark, d), "us")


_SUMMARY = """count(*) AS total, count(*) FILTER (status BETWEEN 200 AND 299) AS successes, count(*) FILTER (status NOT BETWEEN 200 AND 299) AS failures,
  count(*) FILTER (status = 503) AS errors_503, count(*) FILTER (status = 429) AS errors_429, count(*) FILTER (status = 0) AS network_errors, 15.0::DOUBLE AS elapsed_s,
  count(*) / 15.0::DOUBLE AS rps, (count(*) FILTER (status NOT BETWEEN 200 AND 299)) / count(*)::DOUBLE AS error_rate"""


@query("load_summary", f"WITH {LATENCIES} SELECT phase, {_SUMMARY} FROM lat GROUP BY phase")
def load_summary(spark, d):
    return metrics.load_summary(adapt.latencies(spark, d), F.lit(15.0), "phase")


_PCT = "CASE WHEN min(bucket) FILTER (cum >= greatest(floor(total * {0} / 100), 1)) = 0 THEN 1 ELSE pow(2, min(bucket) FILTER (cum >= greatest(floor(total * {0} / 100), 1))) END::BIGINT"
_SHOWN = "CASE WHEN {0} >= 1000 THEN printf('%.2fms', {0} / 1000.0) ELSE {0} || 'µs' END"
PHASES = f"""{LATENCIES}, h AS (SELECT phase, {_BUCKET} AS bucket, count(*) AS cnt FROM lat GROUP BY ALL),
r AS (SELECT phase, bucket, sum(cnt) OVER (PARTITION BY phase ORDER BY bucket) AS cum, sum(cnt) OVER (PARTITION BY phase) AS total FROM h),
pc AS (SELECT phase, {_PCT.format(50)} AS p50, {_PCT.format(95)} AS p95, {_PCT.format(99)} AS p99 FROM r GROUP BY phase),
s AS (SELECT phase, {_SUMMARY}, sum(us) // count(*) AS mean_us FROM lat GROUP BY phase),
ph AS (SELECT s.*, pc.p50, pc.p95, pc.p99 FROM s JOIN pc ON pc.phase = s.phase)"""


@query("load_report", f"""WITH {PHASES}, l AS (SELECT phase, [phase, '  requests: ' || total, printf('  rps: %.1f', rps), '  successes: ' || successes, printf('  failures: %d (%.2f%%)', failures, error_rate * 100),
  '  503: ' || errors_503, '  429: ' || errors_429, '  network: ' || network_errors, '  mean: ' || {_SHOWN.format('mean_us')}, '  p50: ' || {_SHOWN.format('p50')}, '  p95: ' || {_SHOWN.format('p95')}, '  p99: ' || {_SHOWN.format('p99')}] AS t FROM ph)
SELECT phase, (generate_subscripts(t, 1) - 1)::INTEGER AS line, unnest(t) AS text FROM l""")
def load_report(spark, d):
    return metrics.phase_report(metrics.phase_summaries(adapt.latencies(spark, d), F.lit(15.0), "phase"), "phase")


@query("load_comparison", f"""WITH {PHASES} SELECT phase, printf('%-28s | %12.1f | %-8s | %-8s | %-8s | %-8s | %.2f%%', phase, rps, {_SHOWN.format('mean_us')}, {_SHOWN.format('p50')}, {_SHOWN.format('p95')}, {_SHOWN.format('p99')}, error_rate * 100) AS text FROM ph""")
def load_comparison(spark, d):
    return metrics.comparison(metrics.phase_summaries(adapt.latencies(spark, d), F.lit(15.0), "phase"), "phase")


@query("percentiles_of_nothing", "SELECT unnest([50.0, 99.0])::DOUBLE AS pct, 0::BIGINT AS us")
def percentiles_of_nothing(spark, d):
    return metrics.log2_percentiles(metrics.log2_histogram(adapt.latencies(spark, d).limit(0), "us"), (50.0, 99.0))


@query("latest_gauge", "SELECT arg_max(value, event_id) AS value FROM events")
def latest_gauge(spark, d):
    return metrics.latest_value(adapt.events(spark, d), "value", "event_id")


@query("engine_stats", """SELECT '{"processed_total":' || count(*) FILTER (event_type <> 'error') || ',"queue_depth":' || count(*) FILTER (event_type = 'error')
  || CASE WHEN max(event_id * 40) > max(event_id * 39 + user_id) THEN ',"replication_lag_bytes":' || (max(event_id * 40) - max(event_id * 39 + user_id)) ELSE '' END || '}' AS stats FROM events""")
def engine_stats(spark, d):
    rows = adapt.events(spark, d)
    progress = rows.select((F.col("event_id") * 40).alias("primary_offset"), (F.col("event_id") * 39 + F.col("user_id")).alias("replica_offset"), F.lit(False).alias("reconnected"))
    return metrics.engine_stats(rows, F.col("event_type") != "error", progress)


@query("exposition", f"WITH {LATENCIES} SELECT 'requests_total{{status=\"' || status || '\"}} ' || count(*) AS line FROM lat GROUP BY status")
def exposition(spark, d):
    return metrics.exposition(metrics.counters(adapt.latencies(spark, d), "status", F.col("us")).withColumn("status", F.col("status").cast("string")), "requests_total", "status", "n")


@query("exposition_histogram", f"""WITH {LATENCIES}, b(le) AS (VALUES {_LE}, (NULL)), c AS (SELECT phase, le, (count(*) FILTER (le IS NULL OR seconds <= le)) AS n FROM lat, b GROUP BY phase, le)
SELECT phase, 'latency_seconds_bucket{{phase="' || phase || '",le="' || coalesce(le::VARCHAR, '+Inf') || '"}} ' || n AS line FROM c
UNION ALL SELECT phase, 'latency_seconds_count{{phase="' || phase || '"}} ' || n FROM c WHERE le IS NULL
UNION ALL SELECT phase, 'latency_seconds_sum{{phase="' || phase || '"}} ' || sum(us)::BIGINT FROM lat GROUP BY phase""")
def exposition_histogram(spark, d):
    rows = adapt.latencies(spark, d)
    sums = rows.groupBy("phase").agg(F.sum("us").alias("sum"))  # whole microseconds: a sum of doubles depends on its order
    return metrics.exposition_histogram(metrics.cumulative(rows, "phase", F.col("seconds")), sums, "latency_seconds", "phase").select("phase", "line")


@query("replication_lag", "SELECT user_id, greatest(max(event_id * 40) - max(event_id * 39 + user_id), 0) AS lag_bytes, count(*) FILTER (event_type = 'error') AS reconnects FROM events GROUP BY user_id")
def replication_lag(spark, d):
    e = F.col("event_id")
    rows = adapt.events(spark, d).select("user_id", (e * 40).alias("primary_offset"), (e * 39 + F.col("user_id")).alias("replica_offset"), (F.col("event_type") == "error").alias("reconnected"))
    return metrics.replication_lag(rows, "user_id")


_SIZES = ", ".join(f"({b!r}::DOUBLE)" for b in metrics.SIZE_BOUNDS)


@query("snapshot_sizes", f"WITH {SNAPSHOTS}, b(le) AS (VALUES {_SIZES}, (NULL)) SELECT status, le, (count(*) FILTER (le IS NULL OR size <= le)) AS n FROM snaps, b GROUP BY status, le")
def snapshot_sizes(spark, d):
    return metrics.cumulative(adapt.snapshots(spark, d), "status", F.col("size"), metrics.SIZE_BOUNDS)


_OK = "status = 'ok'"
_BOUNDED = " UNION ALL ".join(
    [f"SELECT 'size_bytes_bucket', NULL, {b!r}::DOUBLE, count(*) FILTER ({_OK} AND size <= {b!r}) FROM snaps" for b in metrics.SIZE_BOUNDS]
    + [f"SELECT 'duration_seconds_bucket', NULL, {b!r}::DOUBLE, count(*) FILTER ({_OK} AND seconds <= {b!r}) FROM snaps" for b in metrics.LATENCY_BOUNDS]
    + [f"SELECT '{n}_bucket', NULL, 'inf'::DOUBLE, count(*) FILTER ({_OK}) FROM snaps" for n in ("size_bytes", "duration_seconds")]
    + [f"SELECT '{n}_count', NULL, NULL, count(*) FILTER ({_OK}) FROM snaps" for n in ("size_bytes", "duration_seconds")]
    + [f"SELECT 'size_bytes_sum', NULL, NULL, coalesce(sum(size) FILTER ({_OK}), 0) FROM snaps"]
    + [f"SELECT 'created_total', '{x}', NULL, count(*) FILTER (status = '{x}') FROM snaps" for x in ("ok", "error")]
    + ["SELECT 'install_total', NULL, NULL, count(*) FILTER (idx % 300 = 0) FROM snaps", "SELECT 'compacted_entries_total', NULL, NULL, sum(idx % 700) FROM snaps"]
)


@query("snapshot_metrics", f"WITH {SNAPSHOTS}, m(metric, label, le, value) AS ({_BOUNDED}) SELECT metric, label, le, value::DOUBLE AS value FROM m")
def snapshot_metrics(spark, d):
    rows = metrics.snapshot_metrics(adapt.snapshots(spark, d), F.col("index") % 300 == 0, F.col("index") % 700)
    return rows.filter("metric <> 'duration_seconds_sum'")  # a sum of doubles depends on its order


@query("snapshot_gauge", f"WITH {SNAPSHOTS} SELECT coalesce(max(idx), 0) AS snapshot_index FROM snaps")
def snapshot_gauge(spark, d):
    return metrics.snapshot_gauge(adapt.snapshots(spark, d))


@query("node_gauges", f"WITH {SERIES} SELECT node_id, arg_max(term, moment) AS term, arg_max(CASE WHEN role = 'leader' THEN 1 ELSE 0 END, moment) AS is_leader FROM series GROUP BY node_id")
def node_gauges(spark, d):
    return metrics.node_gauges(adapt.series(spark, d), "moment")


# --- the replicated log ---------------------------------------------------------------------------------------------


_SURVIVES = "NOT EXISTS (SELECT 1 FROM records t WHERE t.log = e.log AND t.rec_type = 2 AND t.seq > e.seq AND t.from_index <= e.idx)"


@query("truncate_replay", f"WITH {RECORDS} SELECT log, seq, idx AS log_index, term FROM records e WHERE rec_type = 1 AND {_SURVIVES}")
def truncate_replay(spark, d):
    return _renamed(raftlog.truncated(adapt.records(spark, d), "log").select("log", "seq", "index", "term"), index="log_index")


@query("log_rewrite", f"WITH {RECORDS} SELECT log, seq, idx AS log_index FROM records e WHERE rec_type = 1 AND idx > 100 AND {_SURVIVES}")
def log_rewrite(spark, d):
    return _renamed(raftlog.rewritten(adapt.records(spark, d), 100, "log").select("log", "seq", "index"), index="log_index")


@query("prefix_compact", f"WITH {ENTRIES} SELECT idx AS log_index, term FROM entries WHERE idx > 500")
def prefix_compact(spark, d):
    return _renamed(raftlog.after(adapt.entries(spark, d), 500).select("index", "term"), index="log_index")


@query("log_merge", f"""WITH {FOLLOWER}, {LEADER}, cut AS (SELECT f.node, min(f.idx) AS k FROM follower f JOIN leader l ON l.node = f.node AND l.idx = f.idx WHERE l.term <> f.term GROUP BY f.node)
SELECT f.node, f.idx AS log_index, f.term, f.origin FROM follower f LEFT JOIN cut c ON c.node = f.node WHERE c.k IS NULL OR f.idx < c.k
UNION ALL
SELECT l.node, l.idx, l.term, l.origin FROM leader l LEFT JOIN cut c ON c.node = l.node
WHERE l.idx >= c.k OR NOT EXISTS (SELECT 1 FROM follower f WHERE f.node = l.node AND f.idx = l.idx)""")
def log_merge(spark, d):
    return _renamed(raftlog.merged(adapt.follower(spark, d), adapt.leader(spark, d), "node"), index="log_index")


@query("conflict_run_start", f"WITH {LEADER} SELECT node, idx AS log_index, coalesce((SELECT max(b.idx) + 1 FROM leader b WHERE b.node = a.node AND b.idx < a.idx AND b.term <> a.term), first) AS run_start FROM (SELECT *, min(idx) OVER (PARTITION BY node) AS first FROM leader) a")
def conflict_run_start(spark, d):
    rows = raftlog.run_starts(adapt.leader(spark, d), "node")
    return _renamed(rows.select("node", "index", "run_start"), index="log_index")


@query("term_last_index", f"WITH {ENTRIES} SELECT term, max(idx) + 1 AS next_index FROM entries GROUP BY term")
def term_last_index(spark, d):
    return raftlog.after_terms(adapt.entries(spark, d))


@query("next_index_backoff", f"""WITH {ENTRIES}, t AS (SELECT term, max(idx) + 1 AS n FROM entries GROUP BY term), h AS (SELECT event_id, event_id % 13 AS ct, event_id % 10 AS ci FROM events)
SELECT event_id, CASE WHEN ct = 0 OR ci = 0 THEN greatest(ci, 1) ELSE coalesce(n, ci) END AS next FROM h LEFT JOIN t ON t.term = h.ct""")
def next_index_backoff(spark, d):
    e = F.col("event_id")
    hints = adapt.events(spark, d).select("event_id", (e % 13).alias("conflict_term"), (e % 10).alias("conflict_index"))
    return raftlog.backed_up(hints, adapt.entries(spark, d)).select("event_id", F.col("next").cast("long").alias("next"))


@query("last_entry", f"WITH {ENTRIES} SELECT max(idx) AS last_index, arg_max(term, idx) AS last_term FROM entries")
def last_entry(spark, d):
    return _renamed(raftlog.last_entry(adapt.entries(spark, d), 0, 0), index="last_index", term="last_term")


@query("term_at", f"WITH {ENTRIES} SELECT e.event_id + 300 AS log_index, CASE WHEN e.event_id = 0 THEN 3 ELSE coalesce(n.term, 0) END AS term FROM events e LEFT JOIN (SELECT * FROM entries WHERE idx > 300) n ON n.idx = e.event_id + 300")
def term_at(spark, d):
    asked = adapt.events(spark, d).select((F.col("event_id") + 300).alias("index"))
    return _renamed(raftlog.terms_at(asked, raftlog.after(adapt.entries(spark, d), 300), 300, 3), index="log_index")


_HELD = "list_reverse_sort(list_append({0}, last_index))[(len({0}) + 1) // 2 + 1]"


@query("commit_index", f"""WITH {STATES}, lim AS (SELECT *, CASE WHEN joint THEN least({_HELD.format('matches')}, {_HELD.format('new_matches')}) ELSE {_HELD.format('matches')} END AS most FROM states),
log AS (SELECT id, i AS idx, 1 + i // 4 AS term FROM states, range(1, 13) r(i))
SELECT lim.id, coalesce(max(log.idx), min(lim.commit_index))::BIGINT AS commit_index FROM lim
LEFT JOIN log ON log.id = lim.id AND log.term = lim.current_term AND log.idx > lim.commit_index AND log.idx <= lim.most GROUP BY lim.id""")
def commit_index(spark, d):
    states = adapt.states(spark, d)
    return raftlog.committed(states, adapt.state_entries(states), "id")


_ACKED = "len(list_filter({0}, lambda x: list_contains(acks, x))) + 1 >= (len({0}) + 1) // 2 + 1"


@query("quorum_eval", f"WITH {VOTERS} SELECT event_id, {_ACKED.format('voters')} AND (NOT joint OR {_ACKED.format('new_voters')}) AS quorum FROM v")
def quorum_eval(spark, d):
    return adapt.voters(spark, d).select("event_id", raftlog.quorum(F.col("voters"), F.col("new_voters"), F.col("acks"), F.col("joint")).alias("quorum"))


@query("voters_union", f"WITH {VOTERS} SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(voters, new_voters))), ',') AS peers FROM v")
def voters_union(spark, d):
    return adapt.voters(spark, d).select("event_id", F.array_join(F.array_sort(raftlog.all_peers(F.col("voters"), F.col("new_voters"))), ",").alias("peers"))


@query("voters_add", f"WITH {VOTERS} SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(voters, ['n1', 'n99']))), ',') AS voters FROM v")
def voters_add(spark, d):
    return adapt.voters(spark, d).select("event_id", F.array_join(F.array_sort(raftlog.voters_with(F.col("voters"), F.array(F.lit("n1"), F.lit("n99")))), ",").alias("voters"))


@query("voters_remove", f"WITH {VOTERS} SELECT event_id, array_to_string(list_filter(voters, lambda x: NOT list_contains(new_voters, x)), ',') AS voters FROM v")
def voters_remove(spark, d):
    return adapt.voters(spark, d).select("event_id", F.array_join(raftlog.voters_without(F.col("voters"), F.col("new_voters")), ",").alias("voters"))


@query("snapshot_latest", f"WITH {SNAPSHOTS} SELECT idx AS log_index, term, size FROM snaps ORDER BY idx DESC LIMIT 1")
def snapshot_latest(spark, d):
    return _renamed(raftlog.latest_snapshot(adapt.snapshots(spark, d)).select("index", "term", "size"), index="log_index")


@query("snapshot_prune", f"WITH {SNAPSHOTS} SELECT idx AS log_index, term FROM snaps QUALIFY row_number() OVER (ORDER BY idx DESC) <= 2")
def snapshot_prune(spark, d):
    return _renamed(raftlog.pruned(adapt.snapshots(spark, d), 2).select("index", "term"), index="log_index")


@query("snapshot_boundary", f"""WITH {COMMANDS}, base AS (SELECT key, value FROM commands WHERE idx <= 400 QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC) = 1 AND op = 'set')
SELECT 400::BIGINT AS log_index, 'set' AS op, key, value FROM base UNION ALL SELECT idx, op, key, value FROM commands WHERE idx > 400""")
def snapshot_boundary(spark, d):
    rows = adapt.commands(spark, d)
    return _renamed(raftlog.after_snapshot(rows, kv.fold(rows, 400), 400), index="log_index")


@query("chunk_reassembly", "SELECT event_id // 16 AS transfer, sum(strlen(props))::INTEGER AS size, string_agg(props, '' ORDER BY event_id) AS data FROM events GROUP BY 1")
def chunk_reassembly(spark, d):
    """A first attempt that was given up, and in the second one chunks that are sent wrongly and then again."""
    e = F.col("event_id")
    rows = adapt.events(spark, d).select(F.expr("event_id div 16").alias("transfer"), (e % 16).alias("offset"), F.encode("props", "UTF-8").alias("data"), e)
    junk = F.encode(F.lit("junk"), "UTF-8")
    given_up = rows.filter("offset < 5").select("transfer", "offset", junk.alias("data"), e.alias("received"))
    wrong = rows.filter("offset % 5 = 1").select("transfer", "offset", junk.alias("data"), (2 * e + 1_000_000_000_000 - 1).alias("received"))
    chunks = rows.select("transfer", "offset", "data", (2 * e + 1_000_000_000_000).alias("received")).unionByName(given_up).unionByName(wrong)
    return raftlog.reassembled(chunks, "transfer", "received").select("transfer", "size", F.decode("data", "UTF-8").alias("data"))


# --- changes --------------------------------------------------------------------------------------------------------


@query("role_transitions", f"WITH {SERIES} SELECT node_id, moment, previous, role FROM (SELECT *, lag(role) OVER (PARTITION BY node_id ORDER BY moment) AS previous FROM series) WHERE previous <> role")
def role_transitions(spark, d):
    return changes.transitions(adapt.series(spark, d), "role", "node_id", "moment").select("node_id", "moment", "previous", "role")


@query("health_flips", f"WITH {SERIES} SELECT node_id, moment, healthy FROM (SELECT *, lag(healthy) OVER (PARTITION BY node_id ORDER BY moment) AS previous FROM series) WHERE previous <> healthy")
def health_flips(spark, d):
    return changes.transitions(adapt.series(spark, d), "healthy", "node_id", "moment").select("node_id", "moment", "healthy")


# --- byte formats ---------------------------------------------------------------------------------------------------


def _log_events(spark, d, per: int = 1000) -> DataFrame:
    """(segment, ts_ns, data): the events as payloads of framed logs; an event's id stands for its time."""
    return adapt.log(spark, d).select(F.expr(f"`offset` div {per}").alias("segment"), F.col("offset").alias("ts_ns"), binary.encode_event(F.col("source"), F.col("payload")).alias("data"))


def _in_files(rows: DataFrame, segment_by: str = "segment", order: str = "ts_ns") -> str:
    """rows appended through the log sink to a new folder, a segment for each value of segment_by."""
    path = storage.scratch(rows.sparkSession, "log")
    eventlog.written(rows, path, segment_by, order)
    return path


def _segment(file: str = "file"):
    """The segment that a file's name begins with; folders are cut off first, or the pattern would be tried at each of their characters."""
    return F.regexp_extract(F.substring_index(file, "/", -1), r"^([^/]+)-[0-9a-f]{32}-\d+\.wal$", 1)


_BEFORE = f'coalesce(sum({SIZE}) OVER (PARTITION BY "offset" // 1000 ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT'


@query("wal_roundtrip", f'WITH {LOG} SELECT "offset" AS ts_ns, source, payload, {_BEFORE} AS byte_offset FROM log')
def wal_roundtrip(spark, d):
    return files.read_events(spark, _in_files(_log_events(spark, d))).select("ts_ns", "source", "payload", F.col("offset").alias("byte_offset"))


@query("wal_append_offsets", f'WITH {LOG} SELECT "offset" // 1000 AS segment, "offset" AS ts_ns, {_BEFORE} AS byte_offset, source, payload FROM log')
def wal_append_offsets(spark, d):
    rows = adapt.log(spark, d).select(F.expr("`offset` div 1000").alias("segment"), F.col("offset").alias("ts_ns"), "source", "payload")
    back = eventlog.written(rows, storage.scratch(spark, "log"), "segment")
    return back.select(_segment().cast("long").alias("segment"), "ts_ns", F.col("offset").alias("byte_offset"), "source", "payload")


@query("wal_start_offset", f'WITH {LOG} SELECT "offset" AS ts_ns, source, payload, {_BEFORE} + 29 AS byte_offset FROM log')
def wal_start_offset(spark, d):
    """Each segment begins with a record of 29 bytes, which the reader goes past."""
    rows = _log_events(spark, d)
    heads = rows.select("segment").distinct().select("segment", F.lit(-1).cast("long").alias("ts_ns"), binary.encode_event(F.lit("head"), F.lit("h")).alias("data"))
    path = _in_files(rows.unionByName(heads).withColumn("order", F.col("ts_ns")).withColumn("ts_ns", F.greatest("ts_ns", F.lit(0))), order="order")
    found = spark.read.format("eventlog").option("startOffset", 29).load(path)
    return found.select("ts_ns", "source", "payload", F.col("offset").alias("byte_offset"))


@query("wal_torn_tail", """SELECT CASE WHEN event_id % 100 = 99 THEN 'truncated' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1""")
def wal_torn_tail(spark, d):
    rows = _log_events(spark, d, 100).select("segment", "ts_ns", binary.framed(F.col("ts_ns"), F.col("data")).alias("frame"))
    torn = F.when(F.col("ts_ns") % 100 == 99, F.expr("substring(frame, 1, length(frame) - 10)")).otherwise(F.col("frame"))
    return files.read_frames(spark, _in_files(rows.withColumn("frame", torn))).groupBy("status").agg(F.count("*").alias("n"))


@query("wal_damage", """WITH p AS (SELECT event_id // 100 % 3 AS kind, event_id % 100 AS pos FROM events)
SELECT CASE WHEN kind = 0 AND pos = 99 THEN 'truncated' WHEN kind = 1 AND pos = 60 THEN 'bad_crc' WHEN kind = 2 AND pos = 60 THEN 'bad_magic' ELSE 'ok' END AS status, count(*) AS n
FROM p WHERE kind = 0 OR pos <= 60 GROUP BY 1""")
def wal_damage(spark, d):
    """A third of the segments each with a torn tail, a wrong checksum and a wrong mark, after which a reader stops."""
    kind, pos = F.col("segment") % 3, F.col("ts_ns") % 100
    rows = _log_events(spark, d, 100).select("segment", "ts_ns", binary.framed(F.col("ts_ns"), F.col("data")).alias("frame"))
    torn = F.expr("substring(frame, 1, length(frame) - 3)")
    crc = F.concat(F.expr("substring(frame, 1, length(frame) - 4)"), F.unhex(F.lit("00000000")))
    magic = F.concat(F.unhex(F.lit("00")), F.expr("substring(frame, 2, length(frame) - 1)"))
    made = F.when((kind == 0) & (pos == 99), torn).when((kind == 1) & (pos == 60), crc).when((kind == 2) & (pos == 60), magic).otherwise(F.col("frame"))
    found = spark.read.format("eventlog").option("mode", "PERMISSIVE").load(_in_files(rows.withColumn("frame", made)))
    return found.groupBy("status").agg(F.count("*").alias("n"))


@query("raft_log_scan", f"WITH {RECORDS} SELECT log::VARCHAR AS log, idx AS log_index, term FROM records e WHERE rec_type = 1 AND {_SURVIVES}")
def raft_log_scan(spark, d):
    data = F.repeat(F.lit("x"), (F.col("seq") % 5).cast("int")).cast("binary")
    record = binary.log_record(F.col("rec_type"), F.col("index"), F.col("term"), F.lit(0), data, F.col("from_index"), 1 + F.col("seq") % 3)
    rows = adapt.records(spark, d).select("log", F.col("seq").alias("ts_ns"), record.alias("data"))
    scanned = files.read_log(spark, _in_files(rows, "log"))
    return _renamed(raftlog.truncated(scanned, "file").select(_segment().alias("log"), "index", "term"), index="log_index")


@query("kv_recover", f"WITH {COMMANDS} {_FOLDED}")
def kv_recover(spark, d):
    record = binary.kv_record(F.col("op"), F.col("index"), F.col("key"), F.col("value"))
    rows = adapt.commands(spark, d).select(F.expr("index div 1000").alias("segment"), F.col("index").alias("ts_ns"), record.alias("data"))
    records = files.read_kv(spark, _in_files(rows))
    return _renamed(kv.fold(records.withColumnRenamed("raft_index", "index").select("index", "op", "key", "value")), index="log_index")


@query("snapshot_roundtrip", f"WITH {COMMANDS} SELECT key, value FROM commands QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC) = 1 AND op = 'set'")
def snapshot_roundtrip(spark, d):
    def build(group: pa.Table) -> pa.Table:
        pairs = dict(zip(group["key"].to_pylist(), group["value"].to_pylist(), strict=True))
        content = fr.snapshot(7, 3, pairs, {"Phase": 0, "Voters": ["a"], "NewVoters": None})
        return pa.table({"file": pa.array([str(group["part"][0])]), "content": pa.array([content], pa.binary())})

    state = kv.fold(adapt.commands(spark, d)).select("key", "value", F.pmod(F.xxhash64("key"), F.lit(8)).alias("part"))
    return files.snapshots_in(state.groupBy("part").applyInArrow(build, "file string, content binary")).select("key", "value")


@query("meta_roundtrip", "SELECT event_id AS term, CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS voted_for FROM events")
def meta_roundtrip(spark, d):
    vote = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("user_id").cast("string"))
    made = adapt.events(spark, d).select(F.col("event_id").cast("string").alias("file"), binary.meta_record(F.col("event_id"), vote).alias("content"))
    return files.meta_in(made).select("term", "voted_for")


# --- streams --------------------------------------------------------------------------------------------------------


def _followed(spark, d) -> DataFrame:
    schema = adapt.events(spark, d).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")


def _folders(spark, name: str) -> tuple[str, str]:
    path = storage.scratch(spark, name)
    return f"{path}/table", f"{path}/state"


@query("stream_kv_latest", f'WITH {LOG} SELECT source, max("offset") AS log_offset, arg_max(payload, "offset") AS payload FROM log GROUP BY source')
def stream_kv_latest(spark, d):
    rows = _followed(spark, d).select(F.col("event_id").alias("offset"), F.col("user_id").cast("string").alias("source"), F.col("props").alias("payload"), F.col("ts").alias("received_at"))
    path, state = _folders(spark, "latest")
    streams.upsert(rows, path, state).awaitTermination()
    return streams.view(spark, path).select("source", F.col("offset").alias("log_offset"), "payload")


def _followed_commands(spark, d) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "del").otherwise("set")
    return _followed(spark, d).select((F.col("event_id") + 1).alias("index"), op.alias("op"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"))


@query("stream_apply_state", f"WITH {COMMANDS} {_FOLDED}")
def stream_apply_state(spark, d):
    path, state = _folders(spark, "applied")
    streams.applied_table(_followed_commands(spark, d), path, state).awaitTermination()
    table = streams.view(spark, path, "key", "index", ("value", "live"))
    return table.filter("live").select("key", "value", F.col("index").alias("log_index"))


@query("stream_restore", f"WITH {COMMANDS} SELECT key, value FROM ({_FOLDED})")
def stream_restore(spark, d):
    path, state = _folders(spark, "snapshots")
    streams.snapshots(_followed_commands(spark, d), path, state, threshold=300).awaitTermination()
    return streams.restored(spark, path).select("key", "value")


@query("wal_follow", f'WITH {LOG} SELECT "offset" AS ts_ns, source, payload FROM log')
def wal_follow(spark, d):
    """A stream over segments that the sink wrote, appended to a table."""
    log = _in_files(_log_events(spark, d))
    path, state = _folders(spark, "followed")
    streams.append(spark.readStream.format("eventlog").load(log), path, state).awaitTermination()
    return spark.read.parquet(path).select("ts_ns", "source", "payload")
