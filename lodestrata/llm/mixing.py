"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, the source's
target over its size. Its whole part is taken as it is; the fractional parts are
rounded in pairs: one document of a pair hands words to the other until one of
the two probabilities is 0 or 1, which way being drawn so that expectations
stay. A pair's expected words never change, so a source's words differ from its
target by less than one document. Within a chunk of documents the pairing is a
fold over an array; what a chunk leaves over is a residual, and residuals are
folded in chunks again, level by level, until a source has one. Within a chunk
large documents come first, so that what is left over tends to be small.

Draws are hashes of the documents, so reruns agree. Everything is DataFrame
expressions. Texts are read once; from there on only sizes travel. A null or
empty text has no words: it takes no part in pairs and is rounded by itself. A
null source is a source, after all others. Rows that are equal in doc_id and text
draw alike but are rounded each for itself; `mixed_rows` gives them together as
many copies as they were rounded to. Units of equal size are paired in the order
of a hash. Very long texts are one number here; an empty table gives an empty
one, and columns but doc_id, text and source are not looked at, whatever their
names. The sources' targets are set in one task, a row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import cut, joined_evenly, parts_for, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Documents, or residuals, that one fold pairs.
CHUNK = 64
#: The table of sources goes to every task up to so many rows, and bytes of names.
SOURCES, SOURCE_BYTES = 1 << 16, 8 << 20
#: Probabilities nearer than this to 0 or 1 are 0 or 1.
NEAR = 1e-9


def words_in(text: Column) -> Column:
    """The number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, n) with the target of each: weighted shares, the excess over a cap dealt again.

    Sources whose cap lies low against their weight reach it first. In that
    order, the first source that the words left over can't fill sets the words
    a unit of weight gets from there on.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    by_cap = everything.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = ranked.withColumn("level", level).withColumn("place", F.row_number().over(by_cap))
    unfilled = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))
    stop = F.min(unfilled).over(everything)
    own = F.when(stop.isNull() | (F.col("place") < stop["place"]), F.col("most")).otherwise(F.least(stop["level"] * F.col("weight"), "most"))
    return filled.withColumn("target", own).select("source", "source_size", "n", "target")


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def drawn(*keys: Column) -> Column:
    """A number from 0 up to 1 that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)


def _state(i, uid, s, p, ones) -> Column:
    return F.struct(i.cast("int").alias("i"), uid.cast("long").alias("uid"), s.cast("double").alias("s"), p.cast("double").alias("p"), ones.alias("ones"))


def _paired(a: Column, b: Column, seed: int) -> Column:
    """The state after the residual a met the unit b; i is -1 where nothing is left over."""
    none = F.lit(-1)

    def held(unit, p, ones):
        over = _state(F.when((p > NEAR) & (p < 1 - NEAR), unit["i"]).otherwise(none), unit["uid"], unit["s"], p, F.when(p >= 1 - NEAR, F.array_append(ones, unit["i"])).otherwise(ones))
        return over

    def moved(x):  # x: words that a can gain or lose, that b can lose or gain
        grows = drawn(F.lit(seed), a["uid"], b["uid"]) * (x["up"] + x["down"]) < x["down"]
        a_full, a_empty = (1 - a["p"]) * a["s"] <= b["p"] * b["s"], a["p"] * a["s"] <= (1 - b["p"]) * b["s"]
        with_a, with_b = F.array_append(a["ones"], a["i"]), F.array_append(a["ones"], b["i"])
        return (
            F.when(grows & a_full, held(b, b["p"] - x["up"] / b["s"], with_a))
            .when(grows, held(a, a["p"] + x["up"] / a["s"], a["ones"]))
            .when(a_empty, held(b, b["p"] + x["down"] / b["s"], a["ones"]))
            .otherwise(held(a, a["p"] - x["down"] / a["s"], with_b))
        )

    up, down = F.least((1 - a["p"]) * a["s"], b["p"] * b["s"]), F.least(a["p"] * a["s"], (1 - b["p"]) * b["s"])
    return _let(F.struct(up.alias("up"), down.alias("down")), moved)


def folded(units: Column, seed: int) -> Column:
    """Pair the units (uid, s, p) of an array in order: (residual's index or -1, its uid, s, p, indices rounded up)."""
    at = F.transform(units, lambda x, k: F.struct(k.alias("i"), x["uid"].alias("uid"), x["s"].alias("s"), x["p"].alias("p")))
    start = _state(F.lit(-1), F.lit(0), F.lit(0.0), F.lit(0.0), F.array().cast("array<int>"))
    return F.aggregate(at, start, lambda a, b: F.when(a["i"] < 0, _state(b["i"], b["uid"], b["s"], b["p"], a["ones"])).otherwise(_paired(a, b, seed)))


def _level(units: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Fold the units of each chunk."""
    grouped = units.groupBy(*keys).agg(F.array_sort(F.collect_list("unit")).alias("units"))
    return grouped.withColumn("fold", folded(F.col("units"), seed))


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 1) -> DataFrame:
    """(doc_id, uid, size, source_size, target, copies): a row for each row of docs.

    uid is a hash of doc_id and text, by which a caller joins the copies back.
    """
    sized = cut(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "source", words_in(F.col("text")).alias("size")))
    sources = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, cap))
    size = sources.agg(F.count("*"), F.sum(F.length("source")), F.max("n")).first()
    few = size[0] <= SOURCES and (size[1] or 0) <= SOURCE_BYTES
    known = sources.select(F.col("source").alias("of"), "source_size", "target", "n")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = (
        sized.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("whole", F.floor(rate + NEAR))
        .withColumn("part", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    )
    own = (F.col("size") == 0) | (F.col("part") <= NEAR)
    chunk = F.pmod(F.xxhash64("uid", F.lit(seed)), F.ceil(F.col("n") / CHUNK)).cast("long")
    unit = F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(seed), "uid").alias("tie"), "uid", F.col("size").cast("double").alias("s"), F.col("part").alias("p"), "doc_id", "size", "whole", "source_size", "target")
    alone = rated.filter(own).select("doc_id", "uid", "size", "source_size", "target", (F.col("whole") + (drawn(F.lit(seed), "uid", F.lit(0)) < F.col("part")).cast("long")).alias("copies"))
    first = _level(rated.filter(~own).select("source", chunk.alias("chunk"), unit.alias("unit")), ["source", "chunk"], seed)
    up = _residuals(first, size[2] or 0, seed)
    joined = first.join(up, first["source"].eqNullSafe(up["of"]) & (first["chunk"] == up["below"]), "left")
    up_one = F.array_contains(F.col("fold.ones"), F.col("at")) | ((F.col("at") == F.col("fold.i")) & F.coalesce("bit", F.lit(False)))
    paired = joined.select("fold", "bit", F.posexplode("units").alias("at", "u")).select("u.doc_id", "u.uid", "u.size", "u.source_size", "u.target", (F.col("u.whole") + up_one.cast("long")).alias("copies"))
    return paired.unionByName(alone)


def _residuals(level: DataFrame, most: int, seed: int) -> DataFrame:
    """(of, below, bit): whether the residual of each chunk is rounded up."""
    chunks = parts_for(most, CHUNK)
    left = level.filter(F.col("fold.i") >= 0).select("source", "chunk", "fold.uid", "fold.s", "fold.p")
    if chunks == 1:
        return left.select(F.col("source").alias("of"), F.col("chunk").alias("below"), (drawn(F.lit(seed), "uid", F.lit(1)) < F.col("p")).alias("bit"))
    unit = F.struct((-F.col("s")).alias("order"), F.xxhash64(F.lit(seed), "uid").alias("tie"), "uid", "s", "p", F.col("chunk").alias("below"))
    above = _level(cut(left.select("source", F.floor(F.col("chunk") / CHUNK).alias("chunk"), unit.alias("unit"))), ["source", "chunk"], seed)
    up = _residuals(above, chunks, seed).withColumnsRenamed({"of": "of_up", "below": "at_up", "bit": "bit_up"})
    joined = above.join(up, above["source"].eqNullSafe(up["of_up"]) & (above["chunk"] == up["at_up"]), "left")
    bit = F.array_contains(F.col("fold.ones"), F.col("at")) | ((F.col("at") == F.col("fold.i")) & F.coalesce("bit_up", F.lit(False)))
    return joined.select(F.col("source").alias("of"), "fold", "bit_up", F.posexplode("units").alias("at", "u")).select("of", F.col("u.below").alias("below"), bit.alias("bit"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it.

    Rows equal in doc_id and text share out the copies that they got together:
    of r such rows with c copies the first k have floor(c * k / r) of them. Rows
    that are equal in all columns are counted first, so no group of them meets.
    """
    taken = copies(docs, **how).groupBy(F.col("uid").alias("__uid")).agg(F.count("*").alias("__met"), F.sum("copies").alias("__copies"))
    taken = cut(taken.filter("__copies > 0").withColumn("__rows", F.col("__met")))
    names = docs.columns
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("__copy")
    keyed = docs.withColumn("__uid", F.xxhash64("doc_id", "text"))
    rows = joined_evenly(keyed, taken, "__met", ["__uid"])
    once = rows.filter("__rows = 1").select(*names, times(F.col("__copies"))).select(*names)
    if not taken.filter("__rows > 1").limit(1).count():
        return once
    several = rows.filter("__rows > 1").groupBy("__uid", "__rows", "__copies", F.to_json(F.struct(*names)).alias("__whole"))
    several = several.agg(F.count("*").alias("__n"), F.first(F.struct(*names)).alias("__row"))
    so_far = F.sum("__n").over(Window.partitionBy("__uid").orderBy("__whole"))
    share = lambda k: F.floor(F.col("__copies") * k / F.col("__rows")).cast("long")
    dealt = several.withColumn("__to", so_far).withColumn("__own", share(F.col("__to")) - share(F.col("__to") - F.col("__n")))
    return once.unionByName(dealt.filter("__own > 0").select("__row.*", times(F.col("__own"))).select(*names))


def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
