"""What a request, a command or a record must hold, and the status it gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.schema import APPLIED_KEY

MAGIC = 0xCAFEBABE


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PAIR = rf"{_STRING}\s*+:\s*+(?:{_STRING}|null)\s*+"
#: A JSON object of strings and nulls, whatever follows it.
_FLAT = rf"(?s)^\s*+\{{\s*+(?:{_PAIR}(?:,\s*+{_PAIR})*+)?+\}}"


def parsed(raw: Column, fields: tuple[str, ...]) -> Column:
    """The string fields of a strict JSON object, or null.

    Names match whatever their case, the last of repeated ones counts, text
    after the object is ignored, a null or absent field is empty, and so are
    all fields of a JSON null. Null: no object, an unknown field, or a value
    that is no string.
    """
    pairs = F.from_json(raw, "map<string,string>")
    entries = F.transform(F.map_entries(pairs), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    known = F.forall(entries, lambda e: e["k"].isin(*fields))

    def last(field: str) -> Column:
        held = F.filter(entries, lambda e: (e["k"] == field) & e["v"].isNotNull())
        return F.coalesce(F.try_element_at(held, F.lit(-1))["v"], F.lit("")).alias(field)

    own = [last(f) for f in fields]
    empty = F.struct(*(F.lit("").alias(f) for f in fields))
    return F.when(raw.rlike(r"^\s*null\b"), empty).when(raw.rlike(_FLAT) & pairs.isNotNull() & known, F.struct(*own))


def command_object(raw: Column) -> Column:
    """struct(op, key, value) of a JSON command, or null where it is malformed."""
    fields = ("op", "key", "value")
    alone = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))  # in brackets, so that text after the object shows
    part = lambda path: F.try_variant_get(alone, path, "variant")
    kind = F.when(part("$[1]").isNull(), F.schema_of_variant(part("$[0]")))
    kind_of = lambda f: F.schema_of_variant(part(f"$[0].{f}"))
    pairs = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))

    def last(field: str) -> Column:
        held = F.filter(pairs, lambda e: (e["k"] == field) & e["v"].isNotNull())
        return F.coalesce(F.try_element_at(held, F.lit(-1))["v"], F.lit("")).alias(field)

    sound = kind.startswith("OBJECT")
    for f in fields:
        sound &= F.coalesce(kind_of(f).isin("STRING", "VOID"), F.lit(True))
    return F.when(kind == "VOID", F.struct(*(F.lit("").alias(f) for f in fields))).when(sound, F.struct(*map(last, fields)))


def outcomes(rows: DataFrame, durable: Column, queued: Column) -> DataFrame:
    """rows with the outcome of each accepted event, its status, and whether reads see it.

    An event is made durable first and queued then; one that finds the queue
    full is refused, but what is durable stays visible.
    """
    outcome = F.when(~durable, "wal_error").when(~queued, "overloaded").otherwise("ok")
    return rows.withColumns({"outcome": outcome, "status": F.when(~durable, 500).when(~queued, 429).otherwise(202), "visible": durable})


def queued(rows: DataFrame, interval: str, order: str, capacity: int) -> DataFrame:
    """rows with whether each found room in a queue that takes `capacity` events an interval, first come first served."""
    place = F.row_number().over(Window.partitionBy(interval).orderBy(order))
    return rows.withColumn("queued", place <= capacity)


def event_status(source: Column, payload: Column, object_ok: Column) -> Column:
    """400 where the object isn't a strict one, 422 where a field is empty, else 202."""
    return F.when(~object_ok, 400).when((source == "") | (payload == ""), 422).otherwise(202)


def requests(raw: DataFrame, column: str = "raw") -> DataFrame:
    """raw with source, payload and status."""
    event = parsed(F.col(column), ("source", "payload"))
    rows = raw.withColumn("__event", event)
    source, payload = F.col("__event.source"), F.col("__event.payload")
    return rows.withColumns({"source": source, "payload": payload, "status": event_status(source, payload, F.col("__event").isNotNull())}).drop("__event")


def commands(rows: DataFrame) -> DataFrame:
    """rows (op, key) with the op that counts and whether the command is accepted: 204, or 400."""
    op = F.coalesce(F.nullif(F.col("op"), F.lit("")), F.lit("set"))
    good = (F.coalesce(F.col("key"), F.lit("")) != "") & op.isin("set", "del")
    return rows.withColumns({"effective_op": op, "status": F.when(good, 204).otherwise(400)})


def config_changes(rows: DataFrame) -> DataFrame:
    """rows (action, nodes) with 200, or 400."""
    good = F.col("action").isin("add", "remove") & (F.size("nodes") > 0)
    return rows.withColumn("status", F.when(F.coalesce(good, F.lit(False)), 200).otherwise(400))


def user_keys(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("key") != APPLIED_KEY)


def magic_ok(magic: Column) -> Column:
    return magic == F.lit(MAGIC)


def log_up_to_date(term: Column, index: Column, own_term: Column, own_index: Column) -> Column:
    """Whether a candidate's last entry is not behind one's own: by term, then by index."""
    return F.struct(term.alias("t"), index.alias("i")) >= F.struct(own_term.alias("t"), own_index.alias("i"))


def lease_holds(now: Column, expiry: Column) -> Column:
    return now < expiry
