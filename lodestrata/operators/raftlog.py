"""A replicated log as tables: truncation, merging, conflicts, quorums, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _logs(by: tuple) -> list[str]:
    if not by:
        raise ValueError("name the columns that tell logs apart: a log goes through one task, and all logs as one would, too")
    return list(by)


def truncated(records: DataFrame, *by: str) -> DataFrame:
    """The entries that no later marker cuts off.

    A marker at sequence s from index f cuts every entry before it with an index
    of f or more. Going down the log from its end, an entry is out where the
    least from_index that was met so far is not above its own index; that is a
    running minimum in each log (`by`), not a join of all pairs.
    """
    later = Window.partitionBy(*_logs(by)).orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    marked = records.withColumn("__cut", F.min(F.when(F.col("rec_type") == 2, F.col("from_index"))).over(later))
    return marked.filter((F.col("rec_type") == 1) & (F.col("__cut").isNull() | (F.col("__cut") > F.col("index")))).drop("__cut")


def after(entries: DataFrame, upto: int) -> DataFrame:
    return entries.filter(F.col("index") > upto)


def rewritten(records: DataFrame, upto: int, *by: str) -> DataFrame:
    """The log as compaction writes it: markers resolved, and only indices above `upto`."""
    return after(truncated(records, *by), upto)


def merged(follower: DataFrame, leader: DataFrame, by: str) -> DataFrame:
    """Each follower's log after the leader's entries came in.

    The matching prefix stays; from the first index at which the terms differ
    the leader's entries replace what follows, and entries that the follower
    lacks are appended.
    """
    a, b = follower.alias("f"), leader.alias("l")
    same = (F.col(f"f.{by}") == F.col(f"l.{by}")) & (F.col("f.index") == F.col("l.index"))
    cut = a.join(b, same).filter("f.term <> l.term").groupBy(F.col(f"f.{by}").alias("__of")).agg(F.min("f.index").alias("__cut"))
    kept = follower.join(cut, F.col(by) == F.col("__of"), "left").filter(F.col("__cut").isNull() | (F.col("index") < F.col("__cut"))).select(follower.columns)
    own = follower.select(F.col(by).alias("__by"), F.col("index").alias("__index"))
    new = leader.join(cut, F.col(by) == F.col("__of"), "left").join(own, (F.col(by) == F.col("__by")) & (F.col("index") == F.col("__index")), "left")
    return kept.unionByName(new.filter(F.col("__index").isNull() | (F.col("index") >= F.col("__cut"))).select(follower.columns))


def run_starts(entries: DataFrame, *by: str) -> DataFrame:
    """Each entry with the first index of its run of one term."""
    order = Window.partitionBy(*_logs(by)).orderBy("index")
    starts = F.when(F.lag("term").over(order).isNull() | (F.lag("term").over(order) != F.col("term")), F.col("index"))
    return entries.withColumn("__start", starts).withColumn("run_start", F.last("__start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__start")


def after_terms(entries: DataFrame) -> DataFrame:
    """The index that follows each term's last entry."""
    return entries.groupBy("term").agg((F.max("index") + 1).alias("next_index"))


def backed_up(hints: DataFrame, entries: DataFrame) -> DataFrame:
    """The next index to send, from a follower's hint (conflict_term, conflict_index).

    Without a term or an index: the index, or 1. With a term that the leader
    has: what follows its last entry; otherwise the index.
    """
    joined = hints.join(after_terms(entries).withColumnRenamed("term", "conflict_term"), "conflict_term", "left")
    plain = (F.col("conflict_term") == 0) | (F.col("conflict_index") == 0)
    return joined.withColumn("next", F.when(plain, F.greatest("conflict_index", F.lit(1))).otherwise(F.coalesce("next_index", "conflict_index"))).drop("next_index")


def last_entry(entries: DataFrame, snapshot_index: int, snapshot_term: int) -> DataFrame:
    """(index, term) of the last entry, or of the snapshot where the log is empty."""
    last = entries.agg(F.max(F.struct("index", "term")).alias("last"))
    return last.select(F.coalesce("last.index", F.lit(snapshot_index)).alias("index"), F.coalesce("last.term", F.lit(snapshot_term)).alias("term"))


def terms_at(indices: DataFrame, entries: DataFrame, snapshot_index: int, snapshot_term: int) -> DataFrame:
    """indices with the term of each: the snapshot's at its index, 0 where there is no entry."""
    joined = indices.join(entries.select("index", "term"), "index", "left")
    return joined.withColumn("term", F.when(F.col("index") == snapshot_index, snapshot_term).otherwise(F.coalesce("term", F.lit(0))))


def acked(voters: Column, acks: Column) -> Column:
    """Whether a majority of the voters and oneself has acknowledged; repeated voters count each time."""
    return F.size(F.filter(voters, lambda v: F.array_contains(acks, v))) + 1 >= F.floor((F.size(voters) + 1) / 2) + 1


def quorum(voters: Column, new_voters: Column, acks: Column, joint: Column) -> Column:
    return acked(voters, acks) & (~joint | acked(new_voters, acks))


def _majority(matches: Column, last: Column) -> Column:
    """The highest index that a majority holds, given the peers' matches; oneself holds `last`."""
    held = F.sort_array(F.concat(matches, F.array(last)), asc=False)
    return F.element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int"))


def commit_limit(matches: Column, new_matches: Column, last: Column, joint: Column) -> Column:
    return F.when(joint, F.least(_majority(matches, last), _majority(new_matches, last))).otherwise(_majority(matches, last))


def committed(states: DataFrame, entries: DataFrame, by: str) -> DataFrame:
    """Each state's commit index: the highest entry of the current term within the majority's limit.

    Entries of earlier terms commit only along with one of the current term. A
    term's entries follow each other without gaps, so its first and last index
    say which of them is the highest within the limit: entries are summed up
    once, and states meet a row for each term.
    """
    limited = states.withColumn("__limit", commit_limit(F.col("matches"), F.col("new_matches"), F.col("last_index"), F.col("joint")))
    terms = entries.groupBy(F.col(by).alias("__by"), F.col("term").alias("__term")).agg(F.min("index").alias("__first"), F.max("index").alias("__last"))
    found = limited.join(terms, (F.col(by) == F.col("__by")) & (F.col("current_term") == F.col("__term")), "left")
    highest = F.when(F.col("__limit") >= F.col("__first"), F.least("__limit", "__last"))
    return found.select(by, F.greatest(F.col("commit_index"), F.coalesce(highest, F.col("commit_index"))).alias("commit_index"))


def all_peers(voters: Column, new_voters: Column) -> Column:
    return F.array_distinct(F.concat(voters, new_voters))


def voters_with(voters: Column, nodes: Column) -> Column:
    return F.array_distinct(F.concat(voters, nodes))


def voters_without(voters: Column, nodes: Column) -> Column:
    """Keeps repeated voters that stay."""
    return F.filter(voters, lambda v: ~F.array_contains(nodes, v))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.col("index").desc(), F.col("term").desc()).limit(1)


def pruned(snapshots: DataFrame, keep: int) -> DataFrame:
    """The newest snapshots; at least one stays whatever is asked."""
    newest = snapshots.orderBy(F.col("index").desc()).limit(max(keep, 1)).select("index")
    return snapshots.join(newest, "index", "left_semi")


def after_snapshot(entries: DataFrame, snapshot: DataFrame, snapshot_index: int) -> DataFrame:
    """(index, op, key, value): the snapshot's rows as sets at its index, and the entries after it."""
    rows = snapshot.select(F.lit(snapshot_index).cast("long").alias("index"), F.lit("set").alias("op"), "key", "value")
    return rows.unionByName(after(entries, snapshot_index).select("index", "op", "key", "value"))


def reassembled(chunks: DataFrame, by: str, received: str | None = None) -> DataFrame:
    """(by, size, data): chunks (offset, data as bytes) of one transfer put together in order of offset.

    With `received`, a column that grows with the time of arrival: a chunk of
    offset 0 starts the transfer anew, so what came before the last such chunk is
    dropped, and of chunks of one offset the last counts. Without it the greatest
    data of an offset counts. A transfer is a snapshot file and becomes one row.
    """
    if received:
        start = chunks.filter("offset = 0").groupBy(F.col(by).alias("__of")).agg(F.max(received).alias("__start"))
        chunks = chunks.join(start, F.col(by) == F.col("__of"), "left").filter(F.col("__start").isNull() | (F.col(received) >= F.col("__start")))
    once = chunks.groupBy(by, "offset").agg((F.max_by("data", received) if received else F.max("data")).alias("data"))
    # bytes as characters of one byte each
    parts = F.array_sort(F.collect_list(F.struct("offset", F.decode("data", "ISO-8859-1").alias("part"))))
    whole = F.encode(F.array_join(F.col("parts.part"), ""), "ISO-8859-1")
    return once.groupBy(by).agg(parts.alias("parts")).select(by, whole.alias("data")).select(by, F.length("data").alias("size"), "data")
