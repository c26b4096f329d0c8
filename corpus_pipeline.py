"""A corpus through five of the operators: what each stage decides takes effect on the next.

Every stage takes rows with nulls in any column, empty and very long texts, equal
rows, and tables without rows. Rows without a doc_id are scored, cut, compared,
mixed and encoded like others; they are never learned from, and lose the lines
that any document with an id keeps. A null or empty text is never toxic by its
words, is one empty line, is nobody's near copy, takes no words of a mix (it is
kept or not by its source's rate), and has no tokens. Of a group of near copies
the row of the least doc_id stays, nulls last, of equal ids the row of the least
hash, and of rows equal in doc_id and text the least one, so exactly one. Columns
but those of `documents` are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe, jaccard, lines, mixing, toxicity
from lodestrata.llm.common import cut, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share this percentage of their shingles of so many words; op9's own contract (4, 85) binds that query only.
COPY_WORDS, COPY_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(*COLUMNS), model).filter("score < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others keep."""
    out = lines.LineIndex.of(docs).applied(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: of the least doc_id, nulls last, and of rows repeated with it the least one."""
    linked = jaccard.linked_rows(docs.select("doc_id", "text"), COPY_WORDS, COPY_PERCENT)
    linked = cut(linked.select("uid", "first").filter("first IS NOT NULL").groupBy("uid", "first").count())
    gone = linked.filter("uid <> first").select("uid")
    repeated = linked.filter("uid = first AND count > 1").select("uid")
    rows = docs.select(*COLUMNS).withColumn("uid", F.xxhash64("doc_id", "text"))
    once = rows.join(gone.unionByName(repeated), "uid", "left_anti").select(*COLUMNS)
    if not repeated.limit(1).count():
        return once
    return once.unionByName(rows.join(repeated, "uid").groupBy("uid").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the sources' target weights take it."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and digests of the ids and of the decoded text."""
    return bpe.digests(docs.select("doc_id", "source", "text"), bpe.public_path()).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies), ("mixing sources to target weights", mix), ("BPE encoding and decoding", encode)]

#: SQL can express neither a trained classifier nor draws by hashes in a tree; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
