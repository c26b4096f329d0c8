"""Language identification in two steps: the family, then one-versus-one machines within it.

Texts become byte trigrams of their lower-cased letters, hashed and scaled by
the square root of their share. Linear support vector machines (squared hinge
loss, one against the rest) choose a family; between every two languages of a
family another machine decides, and the language with most votes wins, ties by
the sum of margins. All are trained in numpy on a bounded sample of labelled
rows; every whole text is then predicted in vectorised batches.

A text that is null or has no letter is `und`, with score 0. So is every text
where no row has a language to learn. Rows with a null doc_id are predicted, but
never learned from; of rows that share a doc_id and a language one is. Repeated
rows are predicted alike. Very long texts are scanned in pieces. Ties between
languages go to the first by name, ties in the sample to the smaller doc_id. Of
more than ROWS languages the most frequent are learned. An empty table gives an
empty one; columns named lang_pred and score are replaced, and others pass by
unused.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import SLICE_BYTES, cut, table, text_slices
from lodestrata.llm.toxicity import fold

#: Language codes by family. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "gd", "cy", "br"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "tk"],
    "indic": ["hi", "ur", "bn", "mr", "ne", "pa", "gu"],
    "semitic": ["ar", "he", "mt", "am"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
BITS = 13
FEATURES = 1 << BITS
#: Bounds of the training sample, in rows: for each language, and in all.
PER_LANGUAGE, ROWS = 400, 4000
STEPS, PENALTY = 250, 1e-4
FOLDS, HELD = 4, 2
#: Texts whose features are held at once.
HELD_TEXTS = 128

#: Each byte lower-cased; ASCII that is no letter is a blank.
_FOLD = np.array([b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def _lowered(column) -> pa.Array:
    return pa.array([x.lower() if x else "" for x in column.to_pylist()], pa.large_string())


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each text of a run has trigrams of each slot; a blank stands before and after each text."""
    n = len(offsets) - 1
    wide = np.full(len(data) + 2 * n, 32, np.uint8)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    wide[np.arange(len(data)) + 2 * doc + 1] = _FOLD[data]
    starts = offsets[:-1] + 2 * np.arange(n)
    code = wide[:-2].astype(np.uint32) | wide[1:-1].astype(np.uint32) << np.uint32(8) | wide[2:].astype(np.uint32) << np.uint32(16)
    doc = np.repeat(np.arange(n), np.diff(offsets) + 2)[:-2]
    good = (wide[1:-1] != 32) | ((wide[:-2] != 32) & (wide[2:] != 32))
    inner = np.ones(len(code), bool)
    inner[starts[1:] - 1] = inner[starts[1:] - 2] = False  # would join two texts
    good &= inner
    slot = (code[good] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return np.bincount(doc[good] * FEATURES + slot, minlength=n * FEATURES).reshape(n, FEATURES)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of scaled trigram shares for each text of a run; of length 1, or 0 without trigrams."""
    if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
        # pieces are cut at blanks, which stand on both sides of a cut
        counts = sum(trigram_counts(x, np.array([0, len(x)])) for x in _blank_pieces(data))
    else:
        counts = trigram_counts(data, offsets)
    total = counts.sum(1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def _blank_pieces(data: np.ndarray):
    """A long text in pieces that end before a byte that is no letter, or after SLICE_BYTES where there is none."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        blank = np.flatnonzero(_FOLD[data[at:end]] == 32)
        if end < len(data) and len(blank) and blank[-1] > 0:
            end = at + int(blank[-1])
        yield data[at:end]
        at = end


def machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear support vector machine: squared hinge loss, classes weighed alike, accelerated gradient."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = np.zeros(x.shape[1]), 0.0
    v, c, t = w.copy(), b, 1.0
    rate = 1 / (2 * (2 + PENALTY))  # rows have length 1, and one for the offset
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ v.astype(np.float32) + c))
        pull = -2 * weight * y * slack
        nw, nb = v - rate * (pull.astype(np.float32) @ x + 2 * PENALTY * v), c - rate * pull.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    family_w: np.ndarray
    family_b: np.ndarray
    pairs: dict[str, tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, lang: list[str]) -> Model:
        names = sorted(set(lang))
        family = np.array([FAMILY_OF.get(k, k) for k in lang])
        lang_of = np.array(lang)
        families = sorted(set(family.tolist()))
        languages = {f: [k for k in names if FAMILY_OF.get(k, k) == f] for f in families}
        made = [machine(x, np.where(family == f, 1.0, -1.0)) for f in families] if len(families) > 1 else [(np.zeros(x.shape[1]), 0.0)] * len(families)
        pairs = {}
        for f in families:
            two = list(combinations(range(len(languages[f])), 2))
            own = []
            for i, j in two:
                a, b = languages[f][i], languages[f][j]
                rows = (lang_of == a) | (lang_of == b)
                own.append(machine(x[rows], np.where(lang_of[rows] == a, 1.0, -1.0)))
            pairs[f] = (two, np.array([w for w, _ in own]).reshape(len(two), x.shape[1]), np.array([b for _, b in own]))
        return cls(families, languages, np.array([w for w, _ in made]).astype(np.float32), np.array([b for _, b in made]), {f: (t, w.astype(np.float32), b) for f, (t, w, b) in pairs.items()})

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores, to six places. A score is how sure the family is times how sure the language is."""
        sure = lambda gap: 1 / (1 + np.exp(-np.clip(4 * gap, -30, 30)))
        margins = x @ self.family_w.T + self.family_b
        first = margins.argmax(1)
        rest = np.partition(margins, -2, 1)[:, -2] if len(self.families) > 1 else margins[:, 0] - 10
        score = sure(margins.max(1) - rest)
        out = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(first == k)
            two, w, b = self.pairs[f]
            names = self.languages[f]
            if not len(rows):
                continue
            if not two:
                out[rows] = names[0]
                continue
            m = x[rows] @ w.T + b
            votes, sums = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for p, (i, j) in enumerate(two):
                votes[:, i] += m[:, p] > 0
                votes[:, j] += m[:, p] <= 0
                sums[:, i] += m[:, p]
                sums[:, j] -= m[:, p]
            best = (votes + np.tanh(sums / len(two)) / 4).argmax(1)
            out[rows] = np.array(names, object)[best]
            score[rows] *= sure(sums[np.arange(len(rows)), best] / max(1, len(names) - 1))
        return out, np.round(score, 6)  # sums differ in their last places with the rows beside them


def sampled(docs: DataFrame) -> DataFrame | None:
    """(__of, __lang): ids to learn each language from, those of the least hashes; at most PER_LANGUAGE of one, and ROWS.

    Rows are first thinned to about twice what is needed by a bound on their
    hash, which depends on the language's number of rows, so that no language
    is large where it is ranked.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n"), F.count("*").alias("rows"))
    sizes = cut(sizes.orderBy(F.col("rows").desc(), "lang").limit(ROWS))
    languages = sizes.count()
    if not languages:
        return None
    most = max(1, min(PER_LANGUAGE, ROWS // languages))
    share = F.least(F.lit(1.0), (2.0 * most + 100) / F.col("n"))
    hashed = F.xxhash64("doc_id", F.lit("sample"))
    drawn = F.shiftrightunsigned(hashed, 11) * F.lit(2.0**-53)
    thinned = rows.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").filter(drawn < F.col("share")).select("lang", "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(drawn, "doc_id"))
    return thinned.withColumn("rank", rank).filter(F.col("rank") <= most).select(F.col("doc_id").alias("__of"), F.col("lang").alias("__lang"))


def fit(docs: DataFrame) -> Model | None:
    """Learn from a bounded sample of rows, whose features are 32 KB each."""
    chosen = sampled(docs)
    if chosen is None:
        return None

    def made(batches):
        for batch in batches:
            rows = []
            for x in _feature_rows(batch.column(2)):
                rows += [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.binary())], names=["of", "lang", "x"])

    both = (F.col("doc_id").cast("long") == F.col("__of")) & (F.col("lang") == F.col("__lang"))
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), both).select("__of", "__lang", "text")
    rows = texts.mapInArrow(made, "of long, lang string, x binary").groupBy("of", "lang").agg(F.min("x").alias("x")).collect()  # a row for each chosen id
    rows = sorted((r.lang, bytes(r.x)) for r in rows)
    return Model.fit(np.array([np.frombuffer(x, np.float32) for _, x in rows]), [k for k, _ in rows])


def _feature_rows(column):
    """Features of a batch of texts, HELD_TEXTS rows at a time at most."""
    lowered = _lowered(column)
    for at in range(0, len(lowered), HELD_TEXTS):
        for _, data, offsets in text_slices(lowered.slice(at, HELD_TEXTS), SLICE_BYTES):
            yield features(data, offsets)


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with `lang_pred` and `score`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        lang, score, at = np.full(len(texts), "und", object), np.zeros(len(texts)), 0
        if sent.value is not None:
            for x in _feature_rows(texts):
                lang[at : at + len(x)], score[at : at + len(x)] = sent.value.predict(x)
                at += len(x)
        letters = pa.compute.fill_null(pa.compute.match_substring_regex(texts, r"\p{L}"), False)
        none = ~np.asarray(letters)
        lang[none], score[none] = "und", 0.0
        return pa.StructArray.from_arrays([pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, predict(F.col("text")).alias("__found")).select(*kept, "__found.lang_pred", "__found.score")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")
