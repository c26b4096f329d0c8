"""Each stage of the pipeline on what the one before it kept."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as p
import numpy as np
from test_jaccard import plain
from test_text_operators import _kept, _targets

from lodestrata.llm import bpe, toxicity
from lodestrata.llm.common import stored


def test_stages(spark, data):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    stage = dict(p.STAGES)
    names = [n for n, _ in p.STAGES]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    one = stored(stage[names[0]](spark, docs, data))
    assert one.columns == p.COLUMNS
    assert {r.doc_id for r in one.collect()} == {k for k, s in scores.items() if s < 0.5}

    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = stored(stage[names[1]](spark, one, data))
    assert {r.doc_id: r.text for r in two.collect()} == {k: "\n".join(x) for k, x in _kept(rows).items()}
    assert all(r.n_chars == len(r.text) for r in two.collect())

    rows = [(r.doc_id, r.text) for r in two.collect()]
    three = stored(stage[names[2]](spark, two, data))
    assert {r.doc_id for r in three.collect()} == {c for _, _, c in plain(rows)}

    four = stored(stage[names[3]](spark, three, data))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in three.collect():
        n = len(r.text.encode().split())
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    times = Counter()
    for r in four.collect():
        taken[r.source] += len(r.text.encode().split())
        times[r.doc_id] += 1
    assert max(times.values()) <= 2
    want = _targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1 for s in sizes)

    tokenizer = Tokenizer.from_file(bpe.public_path())
    ids = lambda t: np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    five = stage[names[4]](spark, four, data)
    assert Counter((r.doc_id, r.ids_sha256) for r in five.collect()) == Counter((r.doc_id, hashlib.sha256(ids(r.text)).hexdigest()) for r in four.collect())


def test_stages_on_empty_and_odd_tables(spark, data, odd_docs):
    odd = odd_docs
    for name, stage in p.STAGES:
        assert stage(spark, odd_docs.limit(0), data).count() == 0, name
        odd = stored(stage(spark, odd, data))
    assert odd.count() > 0


def test_run(spark, data):
    assert p.run(spark, data).count() > 0


def test_near_copies_at_five_words_and_four_fifths(spark, data):
    word = lambda n, own: [f"{own}{k}" for k in range(n)]
    base = word(204, "a")  # 200 shingles of five words
    texts = [base, base + word(44, "b"), base + word(51, "c"), word(60, "d")]  # 200 / 244 = 0.82 at five words; 201 / 245 at four; 200 / 251 is below 0.8
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    got = {r.doc_id for r in dict(p.STAGES)["n-gram Jaccard join"](spark, docs, data).collect()}
    assert got == {0, 2, 3} == {c for _, _, c in plain(rows, 5, 80)}

    table = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = {r.doc_id for r in dict(p.STAGES)["n-gram Jaccard join"](spark, table, data).collect()}
    assert got == {c for _, _, c in plain(rows, 5, 80)}


def test_one_row_of_each_group_stays(spark, data):
    text = lambda own: " ".join(f"{own}{k}" for k in range(300))
    near = text("c") + " end"
    rows = [(None, text("a")), (None, text("a")), (None, text("a") + " end"), (1, text("b")), (1, text("b")), (None, text("b")), (2, text("c")), (2, near), (3, None), (None, text("d"))]
    docs = spark.createDataFrame([(*r, "en", f"s{k}", 1) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in dict(p.STAGES)["n-gram Jaccard join"](spark, docs, data).collect()]
    assert Counter(d for d, _ in got) == {None: 2, 1: 1, 2: 1, 3: 1}
    assert Counter((t or " ")[0] for _, t in got) == {"a": 1, "b": 1, "c": 1, "d": 1, " ": 1}
