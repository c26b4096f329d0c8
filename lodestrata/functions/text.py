"""Column functions over small texts: durations, peer lists, requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(us: Column) -> Column:
    """Microseconds as text: milliseconds with two decimals from 1 ms on."""
    return F.when(us >= 1000, F.format_string("%.2fms", us / 1000.0)).otherwise(F.concat(us.cast("string"), F.lit("µs")))


def peers(text: Column) -> Column:
    """`id:addr,id:addr` as an array of (id, addr); split at the first colon, parts without one or with an empty side are skipped."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    pair = lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("id"), F.trim(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("addr"))
    return F.filter(F.transform(F.filter(parts, lambda p: F.instr(p, ":") > 0), pair), lambda p: (p["id"] != "") & (p["addr"] != ""))


def url_map(text: Column) -> Column:
    """`id=url,id=url` as an array of (id, url); split at the first equals sign, null for an empty text."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    pair = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("id"), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("url"))
    found = F.filter(F.transform(F.filter(parts, lambda p: F.instr(p, "=") > 0), pair), lambda p: (p["id"] != "") & (p["url"] != ""))
    return F.when(F.trim(text) != "", found)


def event_json(source: Column, payload: Column, ts_ns: Column) -> Column:
    return F.to_json(F.struct(source.alias("source"), payload.alias("payload"), ts_ns.alias("received_at_unix_ns")))
