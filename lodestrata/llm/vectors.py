"""Vectors, and searching a stated set of them against all others in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import bucket, parts_for, released

#: Bytes of vectors in a block; small tables are cut finer, into FEW blocks of at least LEAST_BYTES.
BLOCK_BYTES, FEW, LEAST_BYTES = 32 << 20, 8, 1 << 20
#: Queries answered at once.
GROUP = 1 << 8


def usable(df: DataFrame, zeros: bool) -> DataFrame:
    """(vec_id, embedding as doubles, dim): rows that take part in a search.

    Left out are rows without vec_id, and vectors that are null, empty or hold
    null or non-finite components; with zeros=False also zero vectors. Of rows
    that share a vec_id, the one with the least vector stays.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite
    if not zeros:
        good &= F.exists(x, lambda v: v != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter(good)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def blocks_for(index: DataFrame) -> int:
    size = 8 * (index.agg(F.sum("dim")).first()[0] or 0)
    return max(parts_for(size, BLOCK_BYTES), min(FEW, parts_for(size, LEAST_BYTES)))


def streamed(index: DataFrame, queries: DataFrame, make, score: str, blocks: int) -> DataFrame:
    """(query_id, vec_id, score) of every query in every block of rows.

    make(ids, vectors) builds a block's index, once; its answer(query ids,
    queries) gives arrays (query_id, vec_id, score). Rows fall into blocks by a
    hash of their id, so equal vectors spread over all blocks. A block is a
    partition: its rows come first, and the queries stream past them. Rows move
    once; queries are copied once for each block, which is one vector's bytes
    against the thousands of rows that a query is compared with there. Only
    vectors of the same length meet.
    """
    rows = index.select("dim", bucket(F.col("vec_id"), blocks).alias("block"), F.lit(0).alias("kind"), "vec_id", "embedding")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "embedding")
    met = rows.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("dim", "kind", "vec_id")
    names, kind_of = ["query_id", "vec_id", "score"], pa.int64() if score == "long" else pa.float64()

    def run(batches):
        held, built, length = [], None, None
        for batch in batches:
            dim, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (kind[1:] != kind[:-1])]) if len(dim) else []
            for a, b in zip(edges, [*edges[1:], len(dim)], strict=True):
                if dim[a] != length:
                    held, built, length = [], None, dim[a]
                ids = np.asarray(batch.column(2))[a:b]
                x = np.asarray(batch.column(3).slice(a, b - a).flatten()).reshape(-1, int(length))
                if kind[a] == 0:
                    held.append((ids, x))
                    continue
                if built is None:
                    if not held:
                        continue
                    built, held = make(*(np.concatenate(c) for c in zip(*held, strict=True))), []
                for at in range(0, len(ids), GROUP):
                    found = built.answer(ids[at : at + GROUP], x[at : at + GROUP])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), kind_of), strict=True)], names=names)
        released()

    return met.select("dim", "kind", "vec_id", "embedding").mapInArrow(run, f"query_id long, vec_id long, score {score}")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all blocks, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
