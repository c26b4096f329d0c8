"""Exact self-join of documents by the Jaccard similarity of their word shingles.

Set-relation skipping. Documents are sets of hashed shingles; rows with equal
sets form a class. An index list holds the sets that have a shingle in their
prefix, rarest shingles first; lists are ordered by size and carry positions.

1. Shingles found in one set only can't be shared. They are counted out by an
   exchange of packed 64-bit hashes; a task sends equal sets once. Sets that lose
   over the permitted part are done: they link with nothing.
2. Blocks of a list are skipped by size, by position (how much can still follow
   the shared shingle) and by a histogram of the sets' shingles, which bounds
   their difference from below. Of the pairs left, each shard of lists names
   those that join sets which no pair named before has joined, so fewer than it
   has sets however many pairs a group of near copies makes.
3. These are verified on the sets. Connected sets share a label, and a set's
   leader is the nearest one that it was verified against.
4. Answers are derived from those of the leader. The lists are gone through
   again, but sets with the same label need no comparison, and two sets whose
   distances from a common leader differ by more than the permitted distance
   can't be linked, by the triangle inequality of the Jaccard distance. Of a pair
   left, where the leader's overlap with the other set is known, the set's own is
   that overlap, less at most what the leader has and the set doesn't, and plus
   at most what the set has and the leader doesn't: mostly that says whether the
   pair is linked. Only what neither settles is verified on the sets, all of it.

A list that is too long for one task is cut into blocks (`_in_blocks`). Tasks
grow in number with the documents: one for each part, home or shard. A component
or a set that very many documents share doesn't meet in one task where its rows
get their ids (`joined_evenly`).

No link is lost: a linked pair shares a shingle of both prefixes, its first one
passes the position bound, and all other bounds hold for every linked pair.
Pairs of one component need not all be listed.

Texts that are null, empty or white space have an empty set and link with
nothing. Texts of fewer words than a shingle have one shingle, all their words.
Very long texts are scanned in pieces, though a set must fit a task. Rows with a
null doc_id take part; a component's id is its least doc_id, null if it has none.
Repeated rows are linked with each other. An empty table gives an empty one, and
columns but doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import WHITE, cut, hashed_words, joined_evenly, mixed, parts_for, released, table, text_slices
from lodestrata.llm.components import components

WORDS, PERCENT = 4, 85
#: Documents whose shingles make one part of the packed exchange, on average; sets whose prefixes make one shard of the index.
DOCS_IN_PART, SETS_IN_SHARD = 8192, 4096
#: Lists up to this length are short.
SHORT = 6
BINS = 128
#: Lists beyond this length are cut into blocks of about so many entries, each for a task of its own.
LONG = 1 << 13
#: Tables of long lists go to every task up to so many of them.
FEW_LISTS = 1 << 16

#: Distinct sets that a task remembers, so as to send copies once.
REMEMBERED = 1 << 19
#: Pairs that a shard hands on at once.
PAIRS = 1 << 16

_DIGESTS = "doc_id long, uid long, n long, d1 long, d2 long"
_PACKED = "part int, frequent boolean, nodes binary, counts binary, tokens binary"
_SHARED = "home int, nodes binary, counts binary, tokens binary, dfs binary"
_SETS = "node long, n long, lone long, prefix binary, tokens binary"
_ENTRY = "shard int, token long, node long, n long, pos long, lone long, label long, lead long, far double, bins binary"
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS):
    """The sorted distinct shingle hashes of each text of a run, one after another, and their numbers."""
    hashes, counts = hashed_words(data, offsets, WHITE)
    ends = np.cumsum(counts)
    value = hashes[: max(0, len(hashes) - words + 1)].copy()
    for k in range(1, words):
        value = value * _MULTIPLIER + hashes[k : len(hashes) - words + 1 + k]
    value = mixed(value)
    number = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    out = np.empty(int(number.sum()), np.uint64)
    at = 0
    for end, c, n in zip(ends.tolist(), counts.tolist(), number.tolist(), strict=True):
        if c >= words:
            out[at : at + n] = value[end - c : end - c + n]
            out[at : at + n].sort()
        elif c:
            one = np.uint64(c)
            for h in hashes[end - c : end]:
                one = mixed(np.array([one], np.uint64) * _MULTIPLIER + h)[0]
            out[at] = one
        at += n
    of = np.repeat(np.arange(len(number)), number)
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    return out[fresh], np.bincount(of[fresh], minlength=len(number))


def _needed(a, b, percent: int):
    """The least overlap of linked sets of sizes a and b."""
    return -(-(percent * (a + b)) // (100 + percent))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)] if len(x) else np.zeros(1, np.int64)


#: Shingles in OFTEN or more of about SAMPLE documents don't go through the counts (see `frequent_shingles`), FREQUENT of them at most.
SAMPLE, OFTEN, FREQUENT = 1 << 13, 8, 1 << 16
#: Turns in which a part is sorted; a power of two.
PASSES = 8
#: The document frequency of frequent shingles; others' are cut off there.
OFTENEST = 255


def frequent_shingles(docs: DataFrame, rows: int, words: int) -> np.ndarray:
    """The sorted hashes of shingles that are frequent in a bounded sample of documents.

    They are taken as shared and as the most frequent, without being counted, so
    that a passage of very many documents doesn't meet in one task. Which ones
    are found changes the work, not the result: a shingle that is held to be
    shared wrongly only lets a document pass to the next step.
    """
    share = min(1.0, SAMPLE / max(1, rows))
    picked = docs.filter(F.rand(1) < share).select("text")

    def hashes(batches):
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(data, offsets, words)[0].view(np.int64))], names=["token"])

    counts = picked.mapInArrow(hashes, "token long").groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    found = counts.orderBy(F.col("n").desc(), "token").limit(FREQUENT).select("token").toArrow()["token"].to_numpy()
    return np.sort(found.view(np.uint64))


def _digests(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each set of a run; 0 for an empty one."""
    first, second = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
    full = counts > 0
    if len(tokens):
        begin = (np.cumsum(counts) - counts)[full]
        first[full] = np.add.reduceat(mixed(tokens), begin)
        second[full] = np.bitwise_xor.reduceat(mixed(tokens * _MULTIPLIER), begin)
    return first, second


def document_digests(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, uid, n, d1, d2): a row for each row of docs, with its set's size and digests; uid is a hash of doc_id and text."""

    def digest(batches):
        for batch in batches:
            out = []
            for _, data, offsets in text_slices(batch.column(2)):
                tokens, counts = shingle_sets(data, offsets, words)
                out.append((counts, *_digests(tokens, counts)))
            n, d1, d2 = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], names=["doc_id", "uid", "n", "d1", "d2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("uid"), "text").mapInArrow(digest, _DIGESTS)


def _small(counts: np.ndarray) -> bytes:
    """Counts in two bytes each, or in four if they need them."""
    return counts.astype(np.uint16 if not len(counts) or counts.max() < 1 << 16 else np.uint32).tobytes()


def _counts(nodes: pa.ChunkedArray, counts: pa.ChunkedArray) -> np.ndarray:
    found = [np.frombuffer(c, np.uint16 if len(c) * 4 == len(n) else np.uint32) for n, c in zip((x.as_py() for x in nodes), (x.as_py() for x in counts), strict=True)]
    return np.concatenate([np.empty(0, np.int64), *found]).astype(np.int64)


def _packed(docs: DataFrame, parts: int, words: int, frequent: np.ndarray, clashes: list[int]) -> DataFrame:
    """Shingle hashes dealt by their high bits; by home, the sizes of sets and their frequent shingles."""
    low = np.uint64(0xFFFF)
    maybe = np.zeros(1 << 16, bool)
    maybe[(frequent & low).astype(np.int64)] = True
    sent = docs.sparkSession.sparkContext.broadcast((frequent, maybe))
    clashing = np.array(clashes, np.int64).view(np.uint64)

    def by_set(own, of, tokens):
        cuts = _runs(of)
        return own[of[cuts[:-1]]].tobytes(), _small(np.diff(cuts)), tokens.tobytes()

    def pack(batches):
        frequent, maybe = sent.value
        known: set = set()
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                tokens, counts = shingle_sets(data, offsets, words)
                d1, d2 = _digests(tokens, counts)
                new = np.zeros(len(counts), bool)
                for k, key in enumerate(zip(d1.tolist(), d2.tolist(), strict=True)):
                    if counts[k] and key not in known:
                        new[k] = True
                        known.add(key)
                if len(known) > REMEMBERED:
                    known.clear()
                tokens, counts = tokens[np.repeat(new, counts)], counts[new]
                own = np.where(np.isin(d1, clashing), d2, d1)[new]
                n = len(counts)
                if not n:
                    continue
                rows = []
                home = (own % np.uint64(parts)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                edges = _runs(home[order])
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    k = order[a:b]
                    rows.append((-1 - int(home[k[0]]), False, own[k].tobytes(), counts[k].astype(np.uint32).tobytes(), None))
                of = np.repeat(np.arange(n), counts)
                part = ((tokens >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
                if len(frequent):
                    often = np.flatnonzero(maybe[(tokens & low).astype(np.int64)])
                    often = often[frequent[np.minimum(np.searchsorted(frequent, tokens[often]), len(frequent) - 1)] == tokens[often]]
                    rest = np.ones(len(tokens), bool)
                    rest[often] = False
                    often = often[np.argsort(home[of[often]], kind="stable")]
                    edges = _runs(home[of[often]])
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        k = often[a:b]
                        rows.append((-1 - int(home[of[k[0]]]), True, *by_set(own, of[k], tokens[k])))
                    part, tokens, of = part[rest], tokens[rest], of[rest]
                order = np.argsort(part.astype(np.uint16) if parts <= 65536 else part, kind="stable")
                part, tokens, of = part[order], tokens[order], of[order]
                edges = _runs(part)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    rows.append((int(part[a]), False, *by_set(own, of[a:b], tokens[a:b])))
                types = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "frequent", "nodes", "counts", "tokens"])
        released()

    return docs.select("text").mapInArrow(pack, _PACKED)


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _table(rows: list[tuple], schema: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_SHARED_FIELDS = [("home", pa.int32()), ("nodes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("dfs", pa.binary())]


def _shared(parts: int):
    """For one part: the entries whose shingle has two entries or more, dealt by the sets' nodes."""

    def share(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        if part < 0:
            often, rows = group["frequent"].to_pylist(), []
            for k, (nodes, counts, tokens) in enumerate(zip(group["nodes"].to_pylist(), group["counts"].to_pylist(), group["tokens"].to_pylist(), strict=True)):
                rows.append((-1 - part, nodes, counts, tokens, bytes([OFTENEST]) * (len(tokens) // 8) if often[k] else None))
            return _table(rows, _SHARED_FIELDS)
        nodes, counts = _joined(group["nodes"], np.uint64), _counts(group["nodes"], group["counts"])
        tokens = _joined(group["tokens"], np.uint64)
        del group
        of = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
        kept = []
        for turn in range(PASSES):  # a share of the hashes at a time, to sort little at once
            own = np.flatnonzero((tokens & np.uint64(PASSES - 1)) == turn).astype(np.int32)
            own = own[np.argsort(tokens[own], kind="stable")]
            edges = _runs(tokens[own])
            df = np.repeat(np.diff(edges), np.diff(edges))
            many = df >= 2
            kept.append((own[many], np.minimum(df[many], OFTENEST).astype(np.uint8)))
        own, df = (np.concatenate(x) for x in zip(*kept, strict=True))
        tokens, of = tokens[own], nodes[of[own]]
        home = (of % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((of, home))
        home, of, tokens, df = home[order], of[order], tokens[order], df[order]
        rows, edges = [], _runs(home)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            cuts = _runs(of[a:b])
            rows.append((int(home[a]), of[a:b][cuts[:-1]].tobytes(), _small(np.diff(cuts)), tokens[a:b].tobytes(), df[a:b].tobytes()))
        del kept, home, of, tokens, df, order, own
        released()
        return _table(rows, _SHARED_FIELDS)

    return share


_SET_FIELDS = [("node", pa.int64()), ("n", pa.int64()), ("lone", pa.int64()), ("prefix", pa.binary()), ("tokens", pa.binary())]


def _gathered(percent: int):
    """For one home: each set that can be linked, with its prefix and its shared shingles."""

    def gather(group: pa.Table) -> pa.Table:
        meta = pa.array([x.as_py() is None for x in group["dfs"]])
        first, rest = group.filter(meta), group.filter(pa.compute.invert(meta))
        nodes, at = np.unique(_joined(first["nodes"], np.uint64), return_index=True)
        sizes = _joined(first["counts"], np.uint32).astype(np.int64)[at]
        tokens, dfs = _joined(rest["tokens"], np.uint64), _joined(rest["dfs"], np.uint8)
        of = np.repeat(_joined(rest["nodes"], np.uint64), _counts(rest["nodes"], rest["counts"]))
        del group, first, rest
        order = np.lexsort((tokens, dfs, of))
        of, tokens = of[order], tokens[order]
        fresh = np.ones(len(of), bool)  # several tasks may have sent a set
        fresh[1:] = (of[1:] != of[:-1]) | (tokens[1:] != tokens[:-1])
        of, tokens = of[fresh], tokens[fresh]
        edges = _runs(of)
        rows = []
        for node, a, b in zip(of[edges[:-1]].tolist() if len(of) else [], edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n = int(sizes[np.searchsorted(nodes, np.uint64(node))])
            own = tokens[a:b]
            if 100 * len(own) >= percent * n:
                lone = n - len(own)
                prefix = n - -(-percent * n // 100) + 1
                rows.append((int(np.uint64(node).astype(np.int64)), n, lone, own[: prefix - lone].tobytes(), np.sort(own).tobytes()))
        del of, tokens, order
        released()
        return _table(rows, _SET_FIELDS)

    return gather


def linkable_sets(docs: DataFrame, rows: int, words: int, percent: int, clashes: list[int]) -> DataFrame:
    """(node, n, lone, prefix, tokens): a row for each distinct set that can be linked with another."""
    parts = parts_for(rows, DOCS_IN_PART)
    sent = _packed(docs, parts, words, frequent_shingles(docs, rows, words), clashes).repartitionById(2 * parts, "part")  # a task for each part, and for each home from its end on
    shared = sent.groupBy("part").applyInArrow(_shared(parts), _SHARED).repartitionById(parts, "home")
    return cut(shared.groupBy("home").applyInArrow(_gathered(percent), _SETS))


def _bins(tokens: np.ndarray) -> bytes:
    return np.minimum(np.bincount((mixed(tokens) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


_ENTRY_FIELDS = [("shard", pa.int32()), ("token", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("lone", pa.int64()), ("label", pa.int64()), ("lead", pa.int64()), ("far", pa.float64()), ("bins", pa.binary())]


def _entries(sets: DataFrame, shards: int) -> DataFrame:
    """The prefixes' index entries of sets (node, n, lone, prefix, tokens, label, lead, far)."""

    def spread(batches):
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            out: list[list] = [[] for _ in range(10)]
            for r in batch.to_pylist():
                prefix = np.frombuffer(r["prefix"], np.uint64)
                k, bins = len(prefix), _bins(np.frombuffer(r["tokens"], np.uint64))
                out[0].append((mixed(prefix) % np.uint64(shards)).astype(np.int32))
                out[1].append(prefix.view(np.int64))
                out[4].append(r["lone"] + np.arange(k))
                for at, x in ((2, r["node"]), (3, r["n"]), (5, r["lone"]), (6, r["label"]), (7, r["lead"]), (8, r["far"]), (9, bins)):
                    out[at].extend([x] * k)
            columns = [pa.array(np.concatenate(c) if c else [], t) if i in (0, 1, 4) else pa.array(c, t) for i, (c, (_, t)) in enumerate(zip(out, _ENTRY_FIELDS, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in _ENTRY_FIELDS])

    return sets.select("node", "n", "lone", "prefix", "tokens", "label", "lead", "far").mapInArrow(spread, _ENTRY)


def _in_blocks(entries: DataFrame, shards: int, settled: bool, long: int = LONG) -> DataFrame:
    """entries with the lists beyond `long` cut into blocks, which count as lists and lie in shards of their own.

    Before anything is known of the sets, an entry goes to one block, by a hash
    of its node: pairs across blocks wait. Once labels are there (`settled`),
    entries of a list's most frequent label go to one block and need no pairs
    among them; all others go to every block, so that each pair of two labels
    meets in one.
    """
    lengths = cut(entries.groupBy("token").agg(F.count("*").alias("entries")).filter(F.col("entries") > long))
    lists = lengths.count()
    if not lists:
        return entries
    send = F.broadcast if lists <= FEW_LISTS else lambda df: df
    blocks = lengths.select(F.col("token").alias("__token"), F.ceil(F.col("entries") / long).alias("__blocks"))
    marked = entries.join(send(blocks), F.col("token") == F.col("__token"), "left")
    own = F.pmod(F.xxhash64("node", "token"), "__blocks")
    place = F.array(own)
    if settled:
        labels = marked.filter(F.col("__blocks").isNotNull()).groupBy("token", "label").agg(F.count("*").alias("n"))
        common = labels.groupBy(F.col("token").alias("__of")).agg(F.max(F.struct("n", "label")).alias("__most")).select("__of", F.col("__most.label").alias("__common"))
        marked = marked.join(send(common), F.col("token") == F.col("__of"), "left")
        place = F.when(F.col("label") == F.col("__common"), place).otherwise(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))
    dealt = marked.withColumn("__block", F.explode(F.when(F.col("__blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(place)))
    inside = F.col("__block") >= 0
    token = F.when(inside, F.xxhash64("token", "__block")).otherwise(F.col("token"))
    shard = F.when(inside, (F.lit(shards) + F.pmod(F.xxhash64("token", "__block", F.lit(1)), F.lit(1 << 30))).cast("int")).otherwise(F.col("shard"))
    return dealt.withColumns({"token": token, "shard": shard}).select(*entries.columns)


class Lists:
    """The index lists of one shard, each ordered by size."""

    def __init__(self, group: pa.Table, percent: int):
        get = lambda c: group[c].to_numpy()
        order = np.lexsort((get("node"), get("n"), get("token")))
        self.token, self.node, self.n, self.pos, self.lone = (get(c)[order] for c in ("token", "node", "n", "pos", "lone"))
        self.label, self.lead = (np.asarray(group[c].fill_null(0))[order] for c in ("label", "lead"))
        self.led = np.asarray(group["lead"].is_valid())[order]
        self.far = np.asarray(group["far"].fill_null(0.0))[order]
        self.bins = np.frombuffer(b"".join(x.as_py() for x in group["bins"]), np.uint8).reshape(-1, BINS)[order]
        self.edges = _runs(self.token)
        self.percent = percent

    def likely(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of entries of a list that no bound rules out."""
        need = _needed(self.n[i], self.n[j], self.percent)
        good = np.minimum(self.n[i] - self.pos[i], self.n[j] - self.pos[j]) >= need
        good &= 100 * np.minimum(self.n[i], self.n[j]) >= self.percent * np.maximum(self.n[i], self.n[j])
        good &= self.node[i] != self.node[j]
        i, j, need = i[good], j[good], need[good]
        kept = np.ones(len(i), bool)
        for a in range(0, len(i), 1 << 15):
            s = slice(a, a + (1 << 15))
            differ = np.abs(self.bins[i[s]].astype(np.int16) - self.bins[j[s]]).sum(1, dtype=np.int64) + self.lone[i[s]] + self.lone[j[s]]
            kept[s] = differ <= self.n[i[s]] + self.n[j[s]] - 2 * need[s]
        return i[kept], j[kept]

    def short_pairs(self):
        """All pairs in short lists, those first that stand next to each other."""
        size = np.repeat(np.diff(self.edges), np.diff(self.edges))
        for step in range(1, SHORT):
            if len(self.token) <= step:
                return
            i = np.flatnonzero((self.token[:-step] == self.token[step:]) & (size[:-step] <= SHORT))
            i = i[self.label[i] != self.label[i + step]]
            yield i, i + step

    def long_lists(self):
        """(begin, end, the end of the sizes that each entry can be linked with) of each long list."""
        for a, b in zip(self.edges[:-1], self.edges[1:], strict=True):
            if b - a > SHORT:
                yield a, b, a + np.searchsorted(self.n[a:b], self.n[a:b] * 100 // self.percent, "right")

    def tree_pairs(self):
        """Likely pairs that join what no earlier likely pair of this shard has joined: fewer than there are sets."""
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        for i, j in self.short_pairs():
            i, j = self.likely(i, j)
            kept = []
            for k, (x, y) in enumerate(zip(self.node[i].tolist(), self.node[j].tolist(), strict=True)):
                if (x := top(x)) != (y := top(y)):
                    above[y] = x
                    kept.append(k)
            yield i[kept], j[kept]
        for a, b, ends in self.long_lists():
            tops = np.array([top(x) for x in self.node[a:b].tolist()])
            for i in range(a, b - 1):
                j = np.arange(i + 1, ends[i - a])
                j = j[tops[j - a] != tops[i - a]]
                if not len(j):
                    continue
                _, j = self.likely(np.full(len(j), i), j)
                if len(j):
                    other, first = np.unique(tops[j - a], return_index=True)
                    for y in other.tolist():
                        above[y] = int(tops[i - a])
                    tops[np.isin(tops, other)] = tops[i - a]
                    yield np.full(len(first), i), j[first]

    def open_pairs(self):
        """All likely pairs that neither a common label nor a common leader settles."""
        limit = 1 - self.percent / 100 + 1e-9

        def unsettled(i, j):
            same = self.led[i] & self.led[j] & (self.lead[i] == self.lead[j])
            return (self.label[i] != self.label[j]) & ~(same & (np.abs(self.far[i] - self.far[j]) > limit))

        for i, j in self.short_pairs():
            kept = unsettled(i, j)
            yield self.likely(i[kept], j[kept])
        for a, b, ends in self.long_lists():
            if (self.label[a:b] == self.label[a]).all():
                continue
            for i in range(a, b - 1):
                j = np.arange(i + 1, ends[i - a])
                j = j[unsettled(np.full(len(j), i), j)]
                if len(j):
                    yield self.likely(np.full(len(j), i), j)

    def found(self, pairs) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b) with a < b, some at a time, so that none but those are held."""
        held, size = [], 0
        for i, j in pairs:
            if len(i):
                held.append((self.node[i], self.node[j]))
                size += len(i)
            if size >= PAIRS:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(held: list) -> pa.RecordBatch:
        both = np.unique(np.sort(np.stack([np.concatenate(x) for x in zip(*held, strict=True)], 1), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, n_a, n_b): pairs with the size of their overlap."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "n_a", "n_b", "t_a", "t_b")

    def overlap(batches):
        for batch in batches:
            both, last, own = [], None, None
            for k in range(len(batch)):
                if (node := batch.column(0)[k].as_py()) != last:
                    last, own = node, np.frombuffer(batch.column(4)[k].as_py(), np.uint64)
                both.append(len(np.intersect1d(own, np.frombuffer(batch.column(5)[k].as_py(), np.uint64), assume_unique=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.int64())], names=["a", "b", "n_a", "n_b", "both"])

    return joined.mapInArrow(overlap, "a long, b long, n_a long, n_b long, both long")


def settled_by_leaders(pairs: DataFrame, seen: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b, linked): pairs (a, b, n_a, n_b) with what the answers of a's or b's leader say; null if they don't.

    seen has verified pairs (a, b, n_a, n_b, both). A set differs from its
    leader by what the leader has more (`less`) and what it has itself (`more`).
    """
    both = seen.select(F.col("a").alias("x"), F.col("b").alias("z"), F.col("n_a").alias("n_x"), F.col("n_b").alias("n_z"), "both")
    both = both.unionByName(both.select(F.col("z").alias("x"), F.col("x").alias("z"), F.col("n_z").alias("n_x"), F.col("n_x").alias("n_z"), "both"))
    far = 1 - F.col("both") / (F.col("n_x") + F.col("n_z") - F.col("both"))
    leads = both.groupBy(F.col("z").alias("of")).agg(F.min(F.struct(far.alias("far"), "x", (F.col("n_x") - F.col("both")).alias("less"), (F.col("n_z") - F.col("both")).alias("more"))).alias("lead")).select("of", F.col("lead.x").alias("lead"), "lead.less", "lead.more")
    known = both.select("x", F.col("z").alias("other"), F.col("both").alias("common"))
    need = F.col("n_a") + F.col("n_b")
    out = pairs.withColumn("linked", F.lit(None).cast("boolean"))
    for own, other in (("a", "b"), ("b", "a")):
        led = out.join(leads, F.col(own) == F.col("of"), "left")
        led = led.join(known, (F.col("lead") == F.col("x")) & (F.col(other) == F.col("other")), "left")
        sure = (F.col("common") - F.col("less")) * (100 + percent) >= need * percent
        never = (F.col("common") + F.col("more")) * (100 + percent) < need * percent
        out = led.select("a", "b", "n_a", "n_b", F.coalesce("linked", F.when(sure, F.lit(True)).when(never, F.lit(False))).alias("linked"))
    return out


def linked_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, long: int = LONG) -> DataFrame:
    """(doc_id, uid, n_shingles, component_id, first): a row for each row of docs; uid is a hash of doc_id and text.

    first is the uid that stands for the component: of the rows with its least doc_id, nulls last, the one of the least
    uid. It is null for rows with an empty set.
    """
    digests = cut(document_digests(docs, words))
    # a set's node is its first digest; of sets that share one by chance it is the second
    same = digests.filter("n > 0").groupBy("d1").agg(F.min(F.struct("d2", "n")).alias("least"), F.max(F.struct("d2", "n")).alias("most"))
    clashes = [r.d1 for r in same.filter("least <> most").select("d1").collect()]  # about rows ** 2 / 2 ** 65 of them
    node = F.when(F.col("d1").isin(clashes), F.col("d2")).otherwise(F.col("d1")) if clashes else F.col("d1")
    rows = digests.select("doc_id", "uid", "n", node.alias("node"))
    sets = linkable_sets(docs, digests.count(), words, percent, clashes)
    shards = parts_for(sets.count(), SETS_IN_SHARD)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(pa.Table.from_batches(list(batches)), percent)
        yield from lists.found(lists.tree_pairs())

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(pa.Table.from_batches(list(batches)), percent)
        yield from lists.found(lists.open_pairs())

    def paired(sets, settled, through):
        entries = _in_blocks(_entries(sets, shards), shards, settled, long).repartitionById(2 * shards, "shard")
        return entries.groupBy("shard").applyInArrow(through, "a long, b long").distinct()

    unled = sets.withColumns({"label": F.col("node"), "lead": F.lit(None).cast("long"), "far": F.lit(None).cast("double")})
    seen = cut(_verified(paired(unled, False, trees), sets))
    is_link = F.col("both") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    labels = components(seen.filter(is_link).select("a", "b"))
    far = 1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    # each set's nearest verified partner is its leader
    leads = seen.withColumn("far", far).groupBy(F.col("b").alias("node")).agg(F.min(F.struct("far", F.col("a").alias("lead"))).alias("near")).select("node", "near.lead", "near.far")
    led = sets.join(labels, "node", "left").join(leads, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = sets.select("node", "n")
    left = paired(led, True, rest).join(seen.select("a", "b"), ["a", "b"], "left_anti")
    left = left.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    settled = cut(settled_by_leaders(left, seen, percent))
    verified = _verified(settled.filter("linked IS NULL").select("a", "b"), sets).filter(is_link).select("a", "b")
    more = cut(settled.filter("linked").select("a", "b").unionByName(verified))
    final = labels
    if more.limit(1).count():
        final = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    # sets, not rows, get their components; then rows theirs by sets
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    own = rows.filter("n > 0").groupBy("node").agg(F.count("*").alias("rows"), F.min(order).alias("least"))
    own = cut(own.join(final, "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = own.groupBy("label").agg(F.count("*").alias("met"), F.min("least").alias("of_all")).select("label", "met", F.col("of_all.doc_id").alias("component_id"), F.col("of_all.uid").alias("first"))
    known = cut(joined_evenly(own.select("node", "rows", "label"), least, "met", ["label"]).select("node", F.col("rows").alias("met"), "component_id", "first"))
    some = joined_evenly(rows.filter("n > 0"), known, "met", ["node"]).select("doc_id", "uid", F.col("n").alias("n_shingles"), "component_id", "first")
    none = rows.filter("n = 0").select("doc_id", "uid", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("first"))
    return some.unionByName(none)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linked_rows(docs).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM words),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * common >= 85 * (len(a.s) + len(b.s) - common)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id, doc_id AS root FROM sets
  UNION SELECT r.doc_id, e.y FROM reached r JOIN edges e ON e.x = r.root)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""
