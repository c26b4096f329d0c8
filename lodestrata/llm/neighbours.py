"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Inner products become Euclidean distances: all vectors are scaled by the largest
length, and rows get one more component that makes their length 1. Hash values
are floor((a . v + b) / w) with Gaussian a, VALUES of them to a table's bucket.
A query visits the buckets around its own in the order in which they are likely
to hold near rows: a bucket whose cell lies at an expected squared distance d
from the query's place has a success probability that falls with d, so the least
d come first, over all tables. Only buckets that hold rows are visited. The
candidates that the tables give are merged and ranked by their exact inner
products.

How far to go is fitted: on a sample of at most SAMPLE rows and SAMPLE_BYTES, the
share of distinct rows to visit at which TARGET of the sample's true neighbours
are found. All rows are indexed, in blocks; equal vectors spread over the blocks
by their ids. Each block gives at least k rows, if it has them, so small tables
are ranked whole.

Lengths are taken after division by the largest component, so tiny and huge
vectors neither vanish nor overflow. Scores are sums of doubles as they come: a
sum that overflows is infinite, and one of no value counts as the least. Vectors
that are null, empty, zero or hold null or non-finite components take no part. Of
rows that share a vec_id one takes part. Vectors of another length than the
query's are no candidates. Ties go to the smaller vec_id; an empty table gives
an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import table
from lodestrata.llm.vectors import best, blocks_for, streamed, usable

TABLES, VALUES, WIDTH = 2, 48, 0.5
SAMPLE, SAMPLE_BYTES, SAMPLE_QUERIES, TARGET = 1 << 13, 8 << 20, 128, 0.94


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v**2).sum(1, keepdims=True))


class Tables:
    """All hash tables of a block of rows; scale and longest: of all rows, the largest component and then the largest length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, scale: float, longest: float, share: float, k: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(rows.shape[1] + 1, TABLES * VALUES))
        self.b = rng.uniform(0, 1, TABLES * VALUES)
        self.ids, self.rows, self.k = ids, rows, k
        self.visits = min(len(rows), max(k + 1, int(np.ceil(share * len(rows)))))
        scaled = rows / scale / longest
        values = np.floor(self._places(np.c_[scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))])).astype(np.float32)
        #: for each table, its buckets' centres and the bucket of each row
        self.tables = []
        for t in range(TABLES):
            buckets, of = np.unique(values[:, t * VALUES : (t + 1) * VALUES], axis=0, return_inverse=True)
            self.tables.append((buckets + np.float32(0.5), of.ravel()))

    def _places(self, v: np.ndarray) -> np.ndarray:
        return v @ self.a / WIDTH + self.b

    def costs(self, queries: np.ndarray) -> np.ndarray:
        """For each query and row, the expected squared distance of the row's likeliest bucket."""
        unit = _units(queries)
        place = self._places(np.c_[unit, np.zeros(len(unit))]).astype(np.float32)
        least = np.full((len(queries), len(self.rows)), np.inf, np.float32)
        for t, (centres, of) in enumerate(self.tables):
            own = place[:, t * VALUES : (t + 1) * VALUES]
            cost = (centres**2).sum(1) - 2 * (own @ centres.T) + (own**2).sum(1)[:, None]
            np.minimum(least, cost[:, of], out=least)
        return least

    def answer(self, query_ids: np.ndarray, queries: np.ndarray):
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        at = max(1, (4 << 20) // len(self.rows))  # costs of about 16 MB at once
        for first in range(0, len(queries), at):
            costs = self.costs(queries[first : first + at])
            for own, query, cost in zip(query_ids[first : first + at], queries[first : first + at], costs, strict=True):
                rows = np.argpartition(cost, self.visits - 1)[: self.visits] if self.visits < len(cost) else np.arange(len(cost))
                rows = rows[self.ids[rows] != own]
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = (self.rows[rows] * query).sum(1)
                scores[np.isnan(scores)] = -np.inf
                if len(rows) > self.k:
                    least = np.partition(scores, len(rows) - self.k)[len(rows) - self.k]
                    rows, scores = rows[scores >= least], scores[scores >= least]
                order = np.lexsort((self.ids[rows], -scores))[: self.k]
                out.append((np.full(len(order), own), self.ids[rows][order], scores[order]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]


def fitted_share(sample: np.ndarray, k: int, scale: float, longest: float) -> float:
    """The share of distinct rows to visit at which TARGET of the sample's neighbours are found."""
    if len(sample) <= k + 1:
        return 1.0
    tables = Tables(np.arange(len(sample)), sample, scale, longest, 1.0, k)
    at = np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    needed = []
    for j, cost in zip(at, tables.costs(sample[at]), strict=True):
        scores = (sample / scale) @ (sample[j] / np.abs(sample[j]).max())
        scores[j] = -np.inf
        near = np.argsort(-scores, kind="stable")[:k]
        place = np.empty(len(cost))
        place[np.argsort(cost, kind="stable")] = np.arange(1, len(cost) + 1)
        needed.append(place[near] / len(sample))
    return float(min(1.0, np.quantile(np.concatenate(needed), TARGET, method="higher")))


def search(queries: DataFrame, vectors: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, but for its own row."""
    index, asked = usable(vectors, zeros=False), usable(queries, zeros=False)
    size = index.agg(F.max(F.array_max(F.transform("embedding", F.abs))), F.max("dim")).first()
    scale, longest_dim = size[0] or 1.0, size[1] or 1
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + (v / scale) * (v / scale))
    longest = float(np.sqrt(index.agg(F.max(squares)).first()[0] or 1.0)) * (1 + 1e-9)
    rows = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * longest_dim)))
    sample: dict[int, list] = {}
    for r in index.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(rows).select("dim", "embedding").collect():  # SAMPLE_BYTES at most, or one row
        sample.setdefault(r.dim, []).append(r.embedding)
    shares = {dim: fitted_share(np.array(x), k, scale, longest) for dim, x in sample.items()}

    def make(ids, x):
        return Tables(ids, x, scale, longest, shares.get(x.shape[1], 1.0), k)

    return best(streamed(index, asked, make, "double", blocks or blocks_for(index)), k)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors.filter("vec_id % 20 = 0"), vectors, 20)
