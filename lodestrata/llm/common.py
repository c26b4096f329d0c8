"""Shared pieces: reading tables, cutting lineage, and vectorised text scanning."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestrata.storage import scratch, shared_folder

#: The six ASCII white-space bytes: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text scanned at once; temporaries take about 60 times as much.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucket(column: Column, n: int) -> Column:
    """A bucket from 0 to n - 1 that depends on the value alone."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def parts_for(rows: int, per_part: int) -> int:
    return max(1, -(-rows // per_part))


#: Keys of at least LEAST_HOT rows are hot if they are among so few that all others have less than the FEW_HOT-th part.
FEW_HOT, LEAST_HOT = 1000, 1000


def joined_evenly(rows: DataFrame, known: DataFrame, met: str, key: list[str]) -> DataFrame:
    """rows joined to known, which has one row for each key and, in `met`, the number of rows with it.

    Keys with the FEW_HOT-th part of all rows or more are at most FEW_HOT, so
    theirs go to every task, and their rows stay where they are. All others are
    joined by a shuffle, in which no key is large.
    """
    total = known.agg(F.sum(met)).first()[0] or 0
    hot = known.filter(F.col(met) >= max(LEAST_HOT, -(-total // FEW_HOT)))
    if not hot.limit(1).count():
        return rows.join(known.drop(met), key)
    few = F.broadcast(hot.drop(met))
    others = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(few, key).unionByName(others.join(known.drop(met), key))


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """Yield (first row, bytes, offsets) for runs of rows of about `most` bytes.

    offsets has one more entry than the run has rows and starts at 0. A null
    is an empty text. A row longer than `most` makes a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser, on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold_table(letters_only: bool) -> np.ndarray:
    """For each byte, 0 if it parts words, else the byte with A-Z lower-cased."""
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] += 32
    if letters_only:
        for b in range(128):
            if not chr(b).isalnum():
                fold[b] = 0
    else:
        fold[[ord(c) for c in SPACES]] = 0
        fold[0] = 255  # the byte 0 is no white space; no UTF-8 text holds 255
    return fold


WHITE = fold_table(letters_only=False)
ALNUM = fold_table(letters_only=True)
_BASE = 0x9E3779B97F4A7C15 | 1


def released() -> None:
    """Hand memory that a finished group held back to the system, as a worker lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as the largest needs."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed binary; `unpacked` gives them back."""
    codec, parts = pa.Codec("zstd", compression_level=9), []
    for x in arrays:
        raw = np.ascontiguousarray(x).tobytes()
        small = codec.compress(raw, asbytes=True)
        parts += [x.dtype.str.ljust(4).encode(), len(raw).to_bytes(8, "little"), len(small).to_bytes(8, "little"), small]
    return b"".join(parts)


def unpacked(raw: bytes) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd"), [], 0
    while at < len(raw):
        size, small = (int.from_bytes(raw[at + k : at + k + 8], "little") for k in (4, 12))
        out.append(np.frombuffer(codec.decompress(raw[at + 20 : at + 20 + small], size, asbytes=True), raw[at : at + 4].decode().strip()))
        at += 20 + small
    return out


def pack_binary(x: pa.Array) -> bytes:
    """Binaries as their lengths and their bytes."""
    offsets = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    return packed(narrow(np.diff(offsets)), np.frombuffer(x.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]])


def unpack_binary(raw: bytes) -> pa.Array:
    return binaries(*unpacked(raw))


def binaries(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(lengths, dtype=np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def with_fields(schema: StructType, dropped: list[str], *added: tuple) -> StructType:
    """A schema without the dropped names and with (name, type) fields at its end."""
    return StructType([f for f in schema.fields if f.name not in dropped] + [StructField(n, t) for n, t in added])


def long_pieces(data: np.ndarray, most: int = SLICE_BYTES):
    """A text's bytes in pieces of about `most`, each of which ends after white space (or is one long word's end)."""
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        while end < len(data):
            blank = np.flatnonzero(WHITE[data[end : end + most]] == 0)
            if len(blank):
                end += int(blank[0]) + 1
                break
            end = min(len(data), end + most)
        yield data[at:end]
        at = end


def hashed_words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = None):
    """Hash every word of a run of texts without a Python loop over words.

    Returns the words' hashes in order and the number of words in each text. A
    text that is longer than a run should be (it makes a run of its own) is
    scanned in pieces, so temporaries stay bounded by its longest word.
    """
    fold = WHITE if fold is None else fold
    if len(data) > 2 * SLICE_BYTES and len(offsets) == 2:
        found = [_hashed(x, np.array([0, len(x)]), fold)[0] for x in long_pieces(data)]
        return np.concatenate(found), np.array([sum(map(len, found))])
    return _hashed(data, offsets, fold)


def _hashed(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray):
    docs = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(docs, np.int64)
    low = fold[data]
    inside = low != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(docs, np.int64)
    length = last - first
    begin = np.cumsum(length) - length
    step = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(begin, length)
    powers = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
    terms = (low[inside].astype(np.uint64) + np.uint64(1)) * powers[step]
    hashes = mixed(np.add.reduceat(terms, begin) + length.astype(np.uint64))
    counts = np.bincount(np.searchsorted(offsets, first, "right") - 1, minlength=docs)
    return hashes, counts


def arrow_rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
