"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives. The unlabelled texts are a draw from all
rows, whatever their labels, so a share p of them, the class prior, is toxic too.
The prior is the toxic share of the labelled rows. The risk of a classifier is
p * E_pos[l(z)] + max(0, E_unl[l(-z)] - p * E_pos[l(-z)]): what the positives
among the unlabelled add is taken out again, and where the difference turns
negative (overfitting), the step goes the other way. Small numpy classifiers
over the presence of words are trained so, on a bounded sample, and averaged;
every whole text is then scored in vectorised batches.

Near copies are taken out of the draw, out of the positives and out of the labelled
rows that give the prior, all in the same way, or a text copied a thousand times
would make its words look toxic or clean. Of a sampled text at most HELD_WORDS
distinct words are learned from, those of the least hashes; scoring takes all.

Null and empty texts hold no word and get the classifiers' offset. Without one
confirmed toxic text every score is 0. Rows with a null doc_id are scored but
never learned from; of rows that share a doc_id one is. Repeated rows are scored
alike. Very long texts are scanned in pieces. Ties in the sample go to the
smaller doc_id. An empty table gives an empty one; a column named score is
replaced, and others pass by unused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import ALNUM, hashed_words, mixed, released, table, text_slices

#: Bounds of the training sample, in rows.
POSITIVES, UNLABELLED = 3000, 9000
#: Words that a classifier looks at, and how far their shares in both samples differ at least, in standard errors.
WORDS, DISTINCT = 1024, 5.0
#: ... and how likely a text with the word is toxic at least, by the prior: words that only go with a language or a length don't count.
LIKELY = 0.4
#: ... and in what share of the positives it is at least.
SUPPORT = 0.01
MEMBERS, STEPS, RATE, DECAY = 3, 600, 0.1, 1e-4
#: Bound of the labelled rows that the prior is taken from, and of a sampled text's words: to learn from, and to tell near copies among the labelled ones.
LABELLED, HELD_WORDS, TOLD_WORDS = 9000, 2048, 128
#: Near copies in the sample are told by equal groups of minimal hashes: groups, hashes in each.
GROUPS, HASHES = 6, 4
#: Every FOLDS-th hash value is held out.
FOLDS = 5
#: What a sampled row is: bits.
DRAWN, POSITIVE, KNOWN, TOXIC = 1, 2, 4, 8


def fold(doc_id, n: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % n


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray  # (members, words)
    offsets: np.ndarray
    known: np.ndarray  # by the low 16 bits: whether some word has them

    @classmethod
    def of(cls, words, weights, offsets) -> Model:
        known = np.zeros(1 << 16, bool)
        known[(words & np.uint64(0xFFFF)).astype(np.int64)] = True
        return cls(words, weights, offsets, known)

    def scores(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The score of each text, given its words' hashes."""
        if not len(self.offsets):
            return np.zeros(len(counts))
        doc = np.repeat(np.arange(len(counts)), counts)
        mask = self.known[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
        hashes, doc = hashes[mask], doc[mask]
        z = np.repeat(self.offsets[:, None], len(counts), 1)
        if len(hashes) and len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
            pairs = np.unique(doc[hit] * len(self.words) + at[hit])
            doc, at = pairs // len(self.words), pairs % len(self.words)
            for k in range(len(z)):
                z[k] += np.bincount(doc, self.weights[k, at], len(counts))
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean(0)


def _without_copies(rows: list[np.ndarray]) -> list[int]:
    """Numbers of the rows with one of each group of near copies, so that their words don't count as many texts' words."""
    seen, kept = set(), []
    turns = mixed(np.arange(1, GROUPS * HASHES + 1, dtype=np.uint64))[:, None]
    for number, own in enumerate(rows):
        least = mixed(own[None, :] ^ turns).min(1).reshape(GROUPS, HASHES) if len(own) else np.zeros((GROUPS, HASHES), np.uint64)
        groups = {(k, g.tobytes()) for k, g in enumerate(least)}
        if seen.isdisjoint(groups):
            kept.append(number)
        seen |= groups
    return kept


def _presence(rows: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """Which of the words each row has, and a 1 for the offset."""
    x = np.zeros((len(rows), len(words) + 1), np.float32)
    x[:, -1] = 1
    for k, own in enumerate(rows):
        at = np.minimum(np.searchsorted(words, own), len(words) - 1)
        x[k, at[words[at] == own]] = 1
    return x


def _distinct_words(positives: list, unlabelled: list, prior: float) -> np.ndarray:
    """Words whose share among the positives differs most from that among the unlabelled."""
    hashes, counts = np.unique(np.concatenate(positives + unlabelled), return_counts=True)
    own = np.zeros(len(hashes))
    found, n = np.unique(np.concatenate(positives), return_counts=True)
    own[np.searchsorted(hashes, found)] = n
    share, other = own / len(positives), (counts - own) / max(1, len(unlabelled))
    pooled = counts / (len(positives) + len(unlabelled))
    error = np.sqrt(pooled * (1 - pooled) * (1 / len(positives) + 1 / max(1, len(unlabelled)))) + 1e-9
    strength = np.abs(share - other) / error
    strength[prior * share < LIKELY * (other + 0.5 / max(1, len(unlabelled)))] = 0
    strength[own < max(3, SUPPORT * len(positives))] = 0
    order = np.lexsort((hashes, -strength))[:WORDS]
    return np.sort(hashes[order[: max(8, int((strength[order] >= DISTINCT).sum()))]])


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk, given the margins of positives and unlabelled: what positives cost, and what negatives cost, before it is kept from below 0."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def gradient(xp: np.ndarray, xu: np.ndarray, zp: np.ndarray, zu: np.ndarray, prior: float) -> np.ndarray:
    """Of the whole risk; of the negative part alone, the other way round, where that is below 0."""
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
    away = su @ xu / len(xu) - prior * (sp @ xp) / len(xp)
    if risk(zp, zu, prior)[1] < 0:
        return -away
    return prior * ((sp - 1) @ xp) / len(xp) + away


def _train(xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the logistic loss; the last column is the offset's."""
    w = np.zeros(xp.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        grad = gradient(xp, xu, xp @ w.astype(np.float32), xu @ w.astype(np.float32), prior).astype(np.float64)
        grad[:-1] += DECAY * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, what): ids to learn from, of rows that are not held out, by their least hashes; at most POSITIVES + UNLABELLED + LABELLED."""
    learnable = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(learnable).distinct()
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(learnable & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    least = lambda df, n: df.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(n)
    parts = [
        least(ids, UNLABELLED).select("doc_id", F.lit(DRAWN).alias("what")),
        least(known.filter("toxic"), POSITIVES).select("doc_id", F.lit(POSITIVE).alias("what")),
        least(known, LABELLED).select("doc_id", F.when(F.col("toxic"), KNOWN | TOXIC).otherwise(KNOWN).alias("what")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("doc_id").agg(F.bit_or("what").alias("what"))


def sample_rows(docs: DataFrame, chosen: DataFrame) -> list[tuple[np.ndarray, int]]:
    """(hashes of distinct words, what) of each chosen id, in a fixed order: of at most as many ids, and HELD_WORDS or TOLD_WORDS words each."""

    def words(batches):
        for batch in batches:
            own, learnt = [], (np.asarray(batch.column(1)) & (DRAWN | POSITIVE)) > 0
            for first, data, offsets in text_slices(batch.column(2)):
                hashes, counts = hashed_words(data, offsets, ALNUM)
                whats = learnt[first : first + len(counts)]
                own += [np.unique(x)[: HELD_WORDS if full else TOLD_WORDS].tobytes() for x, full in zip(np.split(hashes, np.cumsum(counts)[:-1]), whats, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.binary())], names=["of", "what", "words"])

    chosen = chosen.select(F.col("doc_id").alias("__of"), "what")
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("__of")).select("__of", "what", "text")
    rows = joined.mapInArrow(words, "of long, what int, words binary").groupBy("of").agg(F.min(F.struct("words", "what")).alias("row"))
    found = rows.select("of", "row.*").collect()
    found.sort(key=lambda r: (mixed(np.array([r.of], np.int64).view(np.uint64))[0], r.of))
    return [(np.frombuffer(bytes(r.words), np.uint64), r.what) for r in found]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample of rows that are not held out."""
    none = Model.of(np.empty(0, np.uint64), np.empty((0, 0)), np.empty(0))
    rows = sample_rows(docs, sampled(docs, labels))

    def kept(kind: int) -> list[tuple[np.ndarray, int]]:
        own = [r for r in rows if r[1] & kind]
        return [own[k] for k in _without_copies([w[:TOLD_WORDS] if kind == KNOWN else w for w, _ in own])]

    positives, unlabelled = [w for w, _ in kept(POSITIVE)], [w for w, _ in kept(DRAWN)]
    if not sum(map(len, positives)):
        return none
    unlabelled = unlabelled or positives
    prior = min(max(float(np.mean([bool(what & TOXIC) for _, what in kept(KNOWN)])), 0.01), 0.9)
    words = _distinct_words(positives, unlabelled, prior)
    xp, xu = _presence(positives, words), _presence(unlabelled, words)
    made = []
    for member in range(MEMBERS):
        rng = np.random.default_rng(member)
        pick = lambda x: x[np.sort(rng.permutation(len(x))[: max(1, len(x) * 4 // 5)])]
        made.append(_train(pick(xp), pick(xu), prior))
    del rows, positives, unlabelled, xp, xu
    released()
    return Model.of(words, np.array([w for w, _ in made]), np.array([b for _, b in made]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score`, from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [np.empty(0)]
        for _, data, offsets in text_slices(texts):
            found.append(sent.value.scores(*hashed_words(data, offsets, ALNUM)))
        return pa.array(np.concatenate(found))

    return docs.withColumn("score", score(F.col("text")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
