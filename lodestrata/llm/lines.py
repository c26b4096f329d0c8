"""Line deduplication that can be undone: exact reference counts and sharded cuckoo filters.

The state is a table of references (key, document), a table of counts by key,
and one cuckoo filter for each shard of keys that holds those found in at least
`min_docs` documents. Inserting documents adds references, deleting them takes
references out again. Both change the counts of the keys that they touch and of
no others; a key that crosses the bound enters or leaves its shard's filter, and
shards that no such key belongs to stay as they are. Tables are a base and what
was changed since; every FOLD_AFTER changes they are written anew. When the shards
have grown to twice their size, their number doubles.

To cut lines, the keys of texts meet the filter of their shard, at any size of
the filters (a shard that has many keys is dealt to several tasks), and what the
filter lets pass is joined to the exact table.

A line's key is the line without ASCII white space at its ends and with A-Z
lower-cased, as a 128-bit hash. Keys shorter than `min_chars` code points never
count. A null or empty text is one empty line, and stays what it is. Rows that
share a doc_id are one document to the counts, and each loses its lines; rows
whose doc_id is null are together one document, which keeps a line only where no
other document holds it, and which deleting a null takes out. Very long texts
are split whole, in one task each. An empty table gives an empty one. Columns
named n_lines and n_dropped are replaced, others pass by unused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestrata.llm.common import cut, joined_evenly, parts_for, table, with_fields
from lodestrata.llm.cuckoo import CuckooFilter, Full

MIN_CHARS = 40
MIN_DOCS = 5
#: Frequent keys in a shard, on average, and keys of texts that a task screens at most, on average.
SHARD_KEYS, TASK_KEYS = 1 << 18, 1 << 18
#: Changes after which a table is written anew.
FOLD_AFTER = 8

_SPACE = b" \t\n\x0b\x0c\r"
_KEY = ["hi", "lo"]
_FILTERS = "shard int, buckets long, slots binary"
_KEYS = "hi long, lo long, doc_id long, uid long"


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, or None for a short one."""
    line = line.strip(_SPACE)
    if len(line) < min_chars or len(line.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line.lower())


def keys_in(docs: DataFrame, min_chars: int) -> DataFrame:
    """(hi, lo, doc_id, uid): a row for each distinct key of each row of docs; uid is a hash of doc_id and text."""

    def found(batches):
        for batch in batches:
            ids, uids, keys = [], [], []
            for doc, uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if text.is_valid:
                    own = {k for line in text.as_buffer().to_pybytes().split(b"\n") if (k := key_of(line, min_chars))}
                    keys.extend(own)
                    ids.extend([doc] * len(own))
                    uids.extend([uid] * len(own))
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(ids, pa.int64()), pa.array(uids, pa.int64())], names=["hi", "lo", "doc_id", "uid"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("uid"), "text").mapInArrow(found, _KEYS)


def references(docs: DataFrame, min_chars: int) -> DataFrame:
    """(hi, lo, doc_id): a row for each key of each document."""
    return keys_in(docs, min_chars).select(*_KEY, "doc_id").distinct()


def counted(refs: DataFrame) -> DataFrame:
    """(hi, lo, n_docs, keeper): how many documents hold a key, and the largest of them."""
    return refs.groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def shard_of(shards: int) -> Column:
    return (F.col("lo").bitwiseAND(F.lit(0xFFFFFFFF)) % F.lit(shards)).cast("int")


def _filter_row(shard: int, made: CuckooFilter) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": pa.array([made.buckets], pa.int64()), "slots": pa.array([made.slots.tobytes()], pa.binary())})


def _read_filter(row: pa.Table) -> CuckooFilter:
    buckets = row["buckets"][0].as_py()
    return CuckooFilter(buckets, np.frombuffer(row["slots"][0].as_py(), np.uint16).reshape(buckets, -1).copy())


def filters_of(keys: DataFrame, shards: int) -> DataFrame:
    """A cuckoo filter for each shard of the keys (hi, lo)."""

    def build(group: pa.Table) -> pa.Table:
        return _filter_row(group["shard"][0].as_py(), CuckooFilter.of(group["hi"].to_numpy(), group["lo"].to_numpy()))

    return keys.select(*_KEY, shard_of(shards).alias("shard")).groupBy("shard").applyInArrow(build, _FILTERS)


def filters_changed(filters: DataFrame, crossed: DataFrame, kept: DataFrame, shards: int) -> DataFrame:
    """The filters of the shards in which keys (hi, lo, what) entered (what = 1) or left (-1), after that.

    kept has the frequent keys that did neither, in these shards: a filter that
    gets full is built anew from them.
    """
    marked = crossed.select(*_KEY, "what").unionByName(kept.select(*_KEY, F.lit(0).alias("what"))).withColumn("shard", shard_of(shards))

    def change(old: pa.Table, keys: pa.Table) -> pa.Table:
        what, hi, lo = (keys[c].to_numpy() for c in ("what", "hi", "lo"))
        try:
            if not len(old):
                raise Full
            own = _read_filter(old)
            own.delete(hi[what < 0], lo[what < 0])
            own.insert(hi[what > 0], lo[what > 0])
        except Full:
            own = CuckooFilter.of(hi[what >= 0], lo[what >= 0])
        return _filter_row((old if len(old) else keys)["shard"][0].as_py(), own)

    touched = filters.join(crossed.select(shard_of(shards).alias("shard")).distinct(), "shard", "left_semi")
    return touched.groupBy("shard").cogroup(marked.groupBy("shard")).applyInArrow(change, _FILTERS)


class LineIndex:
    """References, counts and filters of the documents inserted so far."""

    def __init__(self, refs: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_chars: int, min_docs: int, changes: int = 0):
        self.refs, self.counts, self.filters, self.shards = refs, counts, filters, shards
        self.min_chars, self.min_docs, self.changes = min_chars, min_docs, changes

    @property
    def frequent(self) -> DataFrame:
        return self.counts.filter(F.col("n_docs") >= self.min_docs)

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        refs = cut(references(docs, min_chars))
        counts = cut(counted(refs))
        frequent = counts.filter(F.col("n_docs") >= min_docs)
        shards = parts_for(frequent.count(), SHARD_KEYS)
        return cls(refs, counts, cut(filters_of(frequent, shards)), shards, min_chars, min_docs)

    def _moved(self, refs: DataFrame, changed: DataFrame) -> LineIndex:
        """The index after the counts of some keys changed; changed: (hi, lo, n_docs, keeper, before), a row for each."""
        changed = cut(changed)
        was, now = F.col("before") >= self.min_docs, F.col("n_docs") >= self.min_docs
        crossed = cut(changed.filter(was != now).select(*_KEY, F.when(now, 1).otherwise(-1).alias("what")))
        counts = self.counts.join(changed.select(*_KEY), _KEY, "left_anti").unionByName(changed.filter("n_docs > 0").select(*_KEY, "n_docs", "keeper"))
        changes = self.changes + 1
        if changes % FOLD_AFTER == 0:
            refs, counts = cut(refs), cut(counts)
        made = LineIndex(refs, counts, self.filters, self.shards, self.min_chars, self.min_docs, changes)
        keys = made.frequent.count()
        if keys > 2 * self.shards * SHARD_KEYS:
            made.shards = 2 * parts_for(keys, SHARD_KEYS)
            made.filters = cut(filters_of(made.frequent, made.shards))
        elif crossed.limit(1).count():
            touched = crossed.select(shard_of(self.shards).alias("shard")).distinct()
            kept = made.frequent.withColumn("shard", shard_of(self.shards)).join(touched, "shard", "left_semi").join(crossed, _KEY, "left_anti")
            new = filters_changed(self.filters, crossed, kept, self.shards)
            made.filters = cut(self.filters.join(touched, "shard", "left_anti").unionByName(new))
        return made

    def insert(self, docs: DataFrame) -> LineIndex:
        """With more documents; references that are there already change nothing."""
        known = self.refs.withColumnRenamed("doc_id", "of")
        fresh = references(docs, self.min_chars)
        both = (fresh["hi"] == known["hi"]) & (fresh["lo"] == known["lo"]) & fresh["doc_id"].eqNullSafe(known["of"])
        added = cut(fresh.join(known, both, "left_anti"))
        more = counted(added).select(*_KEY, F.col("n_docs").alias("more"), F.col("keeper").alias("largest"))
        before = F.coalesce("n_docs", F.lit(0).cast("long"))
        changed = more.join(self.counts, _KEY, "left").select(*_KEY, (before + F.col("more")).alias("n_docs"), F.greatest("keeper", "largest").alias("keeper"), before.alias("before"))
        return self._moved(self.refs.unionByName(added), changed)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of these ids; a null takes out the rows without one."""
        gone = cut(doc_ids.select(F.col("doc_id").cast("long").alias("of")).distinct())
        same = self.refs["doc_id"].eqNullSafe(gone["of"])
        removed = cut(self.refs.join(gone, same, "left_semi"))
        refs = self.refs.join(gone, same, "left_anti")
        less = counted(removed).select(*_KEY, F.col("n_docs").alias("less"))
        # only the keys of removed references need another keeper
        keepers = refs.join(less.select(*_KEY), _KEY, "left_semi").groupBy(*_KEY).agg(F.max("doc_id").alias("keeper"))
        changed = less.join(self.counts.drop("keeper"), _KEY).join(keepers, _KEY, "left")
        return self._moved(refs, changed.select(*_KEY, (F.col("n_docs") - F.col("less")).alias("n_docs"), "keeper", F.col("n_docs").alias("before")))

    def screened(self, keys: DataFrame) -> DataFrame:
        """Those of the keys (hi, lo, doc_id, uid) that the filter of their shard lets pass."""
        keys = cut(keys.withColumn("shard", shard_of(self.shards)))
        sizes = keys.groupBy("shard").agg(F.ceil(F.count("*") / TASK_KEYS).cast("int").alias("tasks"))
        # a row for each shard, which is one for SHARD_KEYS frequent keys: 16 bytes against their 10 MB of texts at least
        sizes = cut(self.filters.select("shard").join(sizes, "shard"))
        shared = F.broadcast(sizes)
        dealt = keys.join(shared, "shard").withColumn("task", F.pmod(F.xxhash64("uid", "hi"), "tasks").cast("int")).drop("tasks")
        filters = self.filters.join(shared, "shard").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")

        def screen(own: pa.Table, asked: pa.Table) -> pa.Table:
            asked = asked.select(["hi", "lo", "doc_id", "uid"])
            if not len(own) or not len(asked):
                return asked.slice(0, 0)
            return asked.filter(pa.array(_read_filter(own).contains(asked["hi"].to_numpy(), asked["lo"].to_numpy())))

        by = ["shard", "task"]
        return filters.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(screen, _KEYS)

    def dropped(self, docs: DataFrame) -> DataFrame:
        """(uid, lost): for each row that loses lines, their keys; uid is a hash of doc_id and text."""
        frequent = self.frequent.withColumn("met", F.col("n_docs"))
        found = joined_evenly(self.screened(keys_in(docs, self.min_chars).distinct()), frequent, "met", _KEY)
        lost = found.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        return lost.groupBy("uid").agg(F.collect_list(F.struct(*_KEY)).alias("lost"))

    def applied(self, docs: DataFrame) -> DataFrame:
        """docs with their texts cut, and with n_lines and n_dropped."""
        lost = self.dropped(docs).withColumnsRenamed({"uid": "__of", "lost": "__lost"})
        docs = docs.drop("n_lines", "n_dropped")
        names = docs.columns
        joined = docs.join(lost, F.xxhash64("doc_id", "text") == F.col("__of"), "left").select(*names, "__lost")
        min_chars = self.min_chars

        def cut_lines(batches):
            for batch in batches:
                texts, lines_n, dropped_n = [], [], []
                for text, gone in zip(batch.column(names.index("text")).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                    lines = (text or "").encode().split(b"\n")
                    kept = lines
                    if gone:
                        out = {np.array([x["hi"], x["lo"]], "<i8").tobytes() for x in gone}
                        kept = [x for x in lines if key_of(x, min_chars) not in out]
                    texts.append(text if len(kept) == len(lines) else b"\n".join(kept).decode())
                    lines_n.append(len(lines))
                    dropped_n.append(len(lines) - len(kept))
                columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines_n, pa.int64()), pa.array(dropped_n, pa.int64())], names=[*names, "n_lines", "n_dropped"])

        return joined.mapInArrow(cut_lines, with_fields(docs.schema, [], ("n_lines", LongType()), ("n_dropped", LongType())))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return LineIndex.of(docs).applied(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND f.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN frequent f ON f.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
