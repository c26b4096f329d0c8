"""Exact top-k search by a bit-sliced index.

A block of vectors is kept as bitmaps: slice b of attribute d has a bit for each
row, set where bit b of the row's quantised attribute is set. A query's scores
are a weighted sum of attributes, so their slices come from the attributes'
slices by bitmap addition (carry-save adders over all rows at once); a weight's
digits are recoded to be few, and a negative digit adds the complement. Each
attribute's lowest slices are left out of that sum, which bounds how far a row's
score can be from it. Going down from the score's most significant slice gives
the k-th highest value; rows that could still reach it, given the bound, are the
boundary and are resolved by their exact integer scores. Ties go to the smaller
vec_id.

An attribute is floor(1024 * x), of any size: rows that lie far outside an
attribute's usual range (they would make its kept slices coarse for all others),
or beyond 31 bits, stand apart from the slices and are always resolved exactly,
with whole numbers of any length where 64 bits could overflow. A score beyond a
long counts as the nearest long.

Vectors that are null, empty or hold null or non-finite components take no part.
Vectors of another length than the query's are no candidates. Of rows that share
a vec_id one takes part. An empty table gives an empty result, and other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import table
from lodestrata.llm.vectors import best, blocks_for, streamed, usable

SCALE = 1024
#: Slices of an attribute that a block's sum takes.
KEPT = 6
#: Attributes from here on never go into slices.
WIDE = float(1 << 31)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _digits(values: np.ndarray) -> np.ndarray:
    """Signed binary digits (-1, 0, 1) of whole numbers, lowest first, no two neighbours both set."""
    out, rest = [], values.copy()
    while rest.any():
        digit = np.where(rest & 1, 2 - (rest & 3), 0)
        out.append(digit)
        rest = (rest - digit) >> 1
    return np.array(out, np.int64).reshape(len(out), *values.shape)


class SlicedBlock:
    """values: whole numbers as doubles, a row for each id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        inside = self._usual(values)
        if inside.sum() <= k:  # nothing to choose by slices
            inside[:] = False
        self.sliced, self.apart = np.flatnonzero(inside), np.flatnonzero(~inside)
        rows, self.dims = int(inside.sum()), values.shape[1]
        if not rows:
            return
        whole = values[inside].astype(np.int64)
        lifted = whole - whole.min(0)
        bits = np.array([int(m).bit_length() for m in lifted.max(0)])
        self.skipped = np.maximum(0, bits - KEPT)
        self.unit = int(self.skipped.min())  # sums are in units of 1 << unit
        self.words = -(-rows // 64)
        padded = np.zeros((self.words * 64, self.dims), np.int64)
        padded[:rows] = lifted >> self.skipped
        slices = np.array([self._bitmap((padded >> b) & 1) for b in range(KEPT)])  # slice, attribute, word
        #: plane [sign, slice, attribute]: the slice, or its complement
        self.planes = np.concatenate([slices, ~slices]).reshape(-1, self.words)
        self.all = self._bitmap((np.arange(self.words * 64) < rows).astype(np.int64)[:, None])[0]

    @staticmethod
    def _usual(values: np.ndarray) -> np.ndarray:
        fits = (np.abs(values) < WIDE).all(1)
        if not fits.any():
            return fits
        low, high = np.quantile(values[fits], [0.01, 0.99], axis=0, method="nearest")
        span = high - low
        flat = span == 0
        low[flat], high[flat] = values[fits].min(0)[flat], values[fits].max(0)[flat]
        return fits & (values >= low - span).all(1) & (values <= high + span).all(1)

    @staticmethod
    def _bitmap(bits: np.ndarray) -> np.ndarray:
        return np.packbits(np.ascontiguousarray(bits.astype(np.uint8).T), axis=1, bitorder="little").view(np.uint64)

    def sums(self, digits: np.ndarray) -> list[np.ndarray]:
        """The slices of a query's partial scores, lowest first; digits: (places, attributes)."""
        place, dim = np.nonzero(digits)
        sign = (digits[place, dim] < 0).astype(np.int64)
        per = np.arange(KEPT)[:, None]
        plane = (((sign * KEPT) + per) * self.dims + dim).ravel()
        weight = (per + place + self.skipped[dim] - self.unit).ravel()
        order = np.argsort(weight, kind="stable")
        plane, counts = plane[order], np.bincount(weight)
        out, carried, at = [], [], 0
        level = 0
        while level < len(counts) or carried:
            own = self.planes[plane[at : at + counts[level]]] if level < len(counts) else np.empty((0, self.words), np.uint64)
            at += len(own)
            now = np.concatenate([own, *carried]) if carried else own
            carried = []
            while len(now) > 2:
                third = len(now) // 3
                a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
                half = a ^ b
                carried.append((a & b) | (half & c))
                now = np.concatenate([half ^ c, now[3 * third :]])
            if len(now) == 2:
                carried.append((now[0] & now[1])[None])
                now = (now[0] ^ now[1])[None]
            out.append(now[0] if len(now) else np.zeros(self.words, np.uint64))
            level += 1
        return out

    def boundary(self, query: np.ndarray, k: int) -> np.ndarray:
        """Numbers of all rows that can be among the k highest."""
        if k >= len(self.sliced) or np.abs(query).max() >= WIDE or not query.any():
            return np.arange(len(self.values))
        whole = query.astype(np.int64)
        slices = self.sums(_digits(whole))
        equal, above, value = self.all, 0, 0
        for level in range(len(slices) - 1, -1, -1):  # the k-th highest partial sum, from the top
            one = equal & slices[level]
            n = int(np.bitwise_count(one).sum())
            if above + n >= k:
                equal, value = one, value | 1 << level
            else:
                above, equal = above + n, equal & ~slices[level]
        # what the slices left out add to a score differs between rows by this much at most
        left_out = sum(abs(q) * ((1 << s) - 1) for q, s in zip(whole.tolist(), self.skipped.tolist(), strict=True))
        least = value - (left_out >> self.unit)
        if least <= 0:
            return np.arange(len(self.values))
        equal, more = self.all, np.zeros(self.words, np.uint64)
        for level in range(max(len(slices), least.bit_length()) - 1, -1, -1):  # sums of `least` and more
            own = slices[level] if level < len(slices) else np.zeros(self.words, np.uint64)
            if least >> level & 1:
                equal = equal & own
            else:
                more, equal = more | (equal & own), equal & ~own
        reached = np.flatnonzero(np.unpackbits((more | equal).view(np.uint8), bitorder="little")[: len(self.sliced)])
        return np.concatenate([self.sliced[reached], self.apart])

    def exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The integer scores of rows."""
        own = self.values[rows]
        if not len(own) or float(np.abs(own).max()) * float(np.abs(query).max()) * self.dims < 2.0**62:
            return own.astype(np.int64) @ query.astype(np.int64)
        whole = list(map(int, query))
        return np.array([min(MOST, max(LEAST, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in own.tolist()], np.int64)

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k highest, ties to the smaller id."""
        rows = self.boundary(query, k)
        scores = self.exact(rows, query)
        order = np.lexsort((self.ids[rows], ~scores))[:k]  # ~x falls as x grows, without overflow
        return rows[order], scores[order]

    def answer(self, query_ids: np.ndarray, queries: np.ndarray):
        out = [(np.empty(0, np.int64),) * 3]
        with np.errstate(over="ignore"):
            quantised = np.floor(SCALE * queries)
        for own, query in zip(query_ids, quantised, strict=True):
            rows, scores = self.top(query, self.k + 1)
            other = self.ids[rows] != own
            rows, scores = rows[other][: self.k], scores[other][: self.k]
            out.append((np.full(len(rows), own), self.ids[rows], scores))
        return [np.concatenate(c) for c in zip(*out, strict=True)]


def search(queries: DataFrame, vectors: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, but for its own row."""
    index, asked = usable(vectors, zeros=True), usable(queries, zeros=True)

    def make(ids, x):
        return SlicedBlock(ids, np.floor(SCALE * x), k)

    return best(streamed(index, asked, make, "long", blocks or blocks_for(index)), k)


def op6_bit_sliced_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors.filter("vec_id % 100 = 0"), vectors, 10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
