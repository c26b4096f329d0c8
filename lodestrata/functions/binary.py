"""Column functions over bytes: hashes, whole numbers, length-prefixed strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FNV_START, _FNV_PRIME, _LOW32 = 2166136261, 16777619, 0xFFFFFFFF


def fnv1a(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes of a string, as a long from 0 to 2**32 - 1."""
    data = F.encode(text, "UTF-8")
    characters = F.split(F.decode(data, "ISO-8859-1"), "")  # one for each byte
    hashed = F.aggregate(characters, F.lit(_FNV_START).cast("long"), lambda a, c: (a.bitwiseXOR(F.ascii(c).cast("long")) * _FNV_PRIME).bitwiseAND(F.lit(_LOW32)))
    return F.when(F.length(data) == 0, F.lit(_FNV_START).cast("long")).otherwise(hashed)


def unsigned(data: Column) -> Column:
    """Up to 8 bytes, most significant first, as a whole number."""
    return F.conv(F.hex(data), 16, 10).cast("decimal(20,0)").cast("long")


def big_endian(number: Column, size: int) -> Column:
    """The low `size` bytes of a whole number, most significant first."""
    return F.unhex(F.right(F.lpad(F.hex(number), 16, "0"), F.lit(2 * size)))


def little_endian(number: Column, size: int) -> Column:
    """The low `size` bytes of a whole number, least significant first."""
    digits = F.lpad(F.hex(number), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(size))))


def framed(ts_ns: Column, data: Column) -> Column:
    """A frame of a log: mark, time, size, the bytes, and a checksum of all that."""
    head = F.concat(F.unhex(F.lit("CAFEBABE")), big_endian(ts_ns, 8), big_endian(F.length(data), 4), data)
    return F.concat(head, big_endian(F.crc32(head), 4))


def kv_record(op: Column, raft_index: Column, key: Column, value: Column) -> Column:
    """A keyed store's record: 1 sets, 2 deletes, 3 marks how far the store has applied."""
    short = lambda text: F.concat(little_endian(F.octet_length(text), 2), F.encode(text, "UTF-8"))
    kind = F.when(op == "set", F.unhex(F.lit("01"))).when(op == "del", F.unhex(F.lit("02"))).otherwise(F.unhex(F.lit("03")))
    return F.concat(kind, little_endian(raft_index, 8), short(key), F.when(op == "set", short(F.coalesce(value, F.lit("")))).otherwise(F.unhex(F.lit(""))))


def log_record(rec_type: Column, index: Column, term: Column, entry_type: Column, data: Column, from_index: Column, version: Column) -> Column:
    """A replicated log's record: an entry in one of three layouts, or a marker that cuts the log off."""
    kind = F.when(version > 1, F.unhex(F.lpad(F.hex(entry_type), 2, "0"))).otherwise(F.unhex(F.lit("")))
    mark = F.when(version == 3, F.unhex(F.lit("FFC0"))).otherwise(F.unhex(F.lit("")))
    entry = F.concat(F.unhex(F.lit("01")), mark, little_endian(index, 8), little_endian(term, 8), kind, little_endian(F.length(data), 4), data)
    return F.when(rec_type == 2, F.concat(F.unhex(F.lit("02")), little_endian(from_index, 8))).otherwise(entry)


def meta_record(term: Column, voted_for: Column) -> Column:
    """A node's term and vote in a record of one size."""
    vote = F.encode(voted_for, "UTF-8")
    fits = F.when(F.length(vote) > 255, F.raise_error(F.lit("a vote's name is longer than 255 bytes")).cast("binary")).otherwise(vote)
    padded = F.unhex(F.rpad(F.hex(fits), 510, "0"))
    body = F.concat(F.unhex(F.lit("01")), little_endian(term, 8), F.unhex(F.lpad(F.hex(F.length(vote)), 2, "0")), padded)
    return F.concat(body, little_endian(F.crc32(body), 4))


def prefixed(text: Column) -> Column:
    """A two-byte length and the UTF-8 bytes; strings of 65,536 bytes or more are refused, not wrapped."""
    data = F.encode(text, "UTF-8")
    fits = F.when(F.length(data) > 0xFFFF, F.raise_error(F.lit("a string longer than 65,535 bytes can't be encoded")).cast("binary")).otherwise(data)
    return F.concat(big_endian(F.length(data), 2), fits)


def encode_event(source: Column, payload: Column) -> Column:
    return F.concat(prefixed(source), prefixed(payload))


def decode_event(data: Column) -> Column:
    """struct(source, payload), or null where a length points past the end."""
    at = lambda start, size: F.substring(data, start, size)
    source_size = unsigned(at(F.lit(1), F.lit(2))).cast("int")
    second = source_size + 3
    payload_size = unsigned(at(second, F.lit(2))).cast("int")
    whole = (F.length(data) >= 4) & (F.length(data) >= source_size + 4) & (F.length(data) >= source_size + 4 + F.coalesce(payload_size, F.lit(0)))
    text = lambda x: F.decode(x, "UTF-8")
    return F.when(whole, F.struct(text(at(F.lit(3), source_size)).alias("source"), text(at(second + 2, payload_size)).alias("payload")))


def frame_size(source: Column, payload: Column) -> Column:
    """Bytes that an event takes in a framed log: header 16, trailer 4, two lengths of 2."""
    return (F.lit(24) + F.octet_length(source) + F.octet_length(payload)).cast("long")
