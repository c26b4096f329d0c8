"""A cuckoo filter over pairs of 64-bit key halves, in numpy, with insertion and deletion."""

from __future__ import annotations

import numpy as np

from lodestrata.llm.common import mixed

SLOTS = 4
#: Rounds of moving entries before a table counts as full.
ROUNDS = 400
LOAD = 0.8


class Full(Exception):
    pass


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets.

    A key that was inserted is always found. Another is found by chance about
    once in 8,000. Deleting takes out one copy, so only inserted keys may be
    deleted.
    """

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(hi)) / (SLOTS * LOAD)))))
        while True:
            try:
                made = cls(buckets)
                made.insert(hi, lo)
                return made
            except Full:
                buckets *= 2

    def _places(self, hi: np.ndarray, lo: np.ndarray):
        prints = (lo.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (mixed(hi.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(prints.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        prints, first = self._places(hi, lo)
        second = self._other(prints, first)
        return (self.slots[first] == prints[:, None]).any(1) | (self.slots[second] == prints[:, None]).any(1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Insert all keys at once; raises Full, which leaves the table unusable."""
        prints, bucket = self._places(hi, lo)
        rng = np.random.default_rng(len(prints))
        for _ in range(ROUNDS):
            if not len(prints):
                return
            order = np.argsort(bucket, kind="stable")
            prints, bucket = prints[order], bucket[order]
            head = np.r_[True, bucket[1:] != bucket[:-1]]
            rank = np.arange(len(bucket)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            free = self.slots[bucket] == 0
            fits = rank < free.sum(1)
            # the rank-th free slot of the bucket
            slot = (np.cumsum(free, 1) > rank[:, None]).argmax(1)
            self.slots[bucket[fits], slot[fits]] = prints[fits]
            left, at, rank = prints[~fits], bucket[~fits], rank[~fits]
            if not len(left):
                return
            # one entry of each full bucket changes places with a random slot; all that are left move on
            heads = np.r_[True, at[1:] != at[:-1]]
            swap = heads & (rng.random(len(left)) < 0.5)
            victim = rng.integers(0, SLOTS, len(left))
            out = left.copy()
            out[swap] = self.slots[at[swap], victim[swap]]
            self.slots[at[swap], victim[swap]] = left[swap]
            prints, bucket = out, self._other(out, at)
        if len(prints):
            raise Full

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        prints, first = self._places(hi, lo)
        second = self._other(prints, first)
        slots, left = self.slots.reshape(-1), np.arange(len(prints))
        while len(left):
            found = np.concatenate([self.slots[first[left]], self.slots[second[left]]], 1) == prints[left, None]
            if not found.any(1).all():
                raise KeyError("a key that was not inserted can't be deleted")
            at = found.argmax(1)
            place = np.where(at < SLOTS, first[left], second[left]) * SLOTS + at % SLOTS
            _, own = np.unique(place, return_index=True)  # of keys that chose the same entry, one takes it
            slots[place[own]] = 0
            left = np.delete(left, own)
