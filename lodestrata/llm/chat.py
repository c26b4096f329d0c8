"""Chat formatting over logged conversations, snapshots collapsed.

A log of cumulative snapshots holds a conversation many times, each time with
some more turns. Every turn gets a rolling hash of all turns up to it. A
conversation whose last hash is found at a turn of another that goes on after it
is a prefix of that one; an anti-join takes it out, and of equal conversations
the one with the least conv_id stays. Only these are rendered, so the rendered
texts are the log's maximal conversations.

The rolling hash is the exclusive or of hashes of each turn with its position,
twice with different seeds (128 bits); it runs in a window over one
conversation. A conversation becomes one row of text, so it must fit a row.

Texts can't forge turns: a mark that stands in a role or a text gets a backslash
more between `<` and `|`, and a role's line breaks and backslashes are written
with one, so that what was logged can be read back from what is rendered.

Turns are ordered by turn (nulls first), role and text, and rows that are equal
in all of these are one turn; other ties can't be. A null role or text is an
empty one. Rows without conv_id belong to no conversation. Very long turns go
whole. An empty table gives an empty one, and columns but conv_id, turn, role and
text are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import cut, table

BEFORE, BETWEEN, AFTER = "<|im_start|>", "\n", "<|im_end|>\n"


def rolled(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turns, role, text, h1, h2): each turn with its position and its rolling hash."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter(F.col("conv_id").isNotNull())
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("conv_id")
    own = F.struct("turn", "role", "text")
    fresh = rows.withColumn("fresh", ~F.coalesce(own.eqNullSafe(F.lag(own).over(order)), F.lit(False))).filter("fresh")
    placed = fresh.withColumn("pos", F.row_number().over(order)).withColumn("turns", F.count("*").over(whole))
    for k, name in enumerate(("h1", "h2")):
        placed = placed.withColumn(name, F.bit_xor(F.xxhash64(F.lit(k), "pos", "role", "text")).over(so_far))
    return placed.select("conv_id", "pos", "turns", "role", "text", "h1", "h2")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, copies): the conversations that are no prefix of others, and how many equal ones there are."""
    ends = turns.filter("pos = turns").groupBy("h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    prefixes = turns.filter("pos < turns").select("h1", "h2").distinct()
    return ends.join(prefixes, ["h1", "h2"], "left_anti").select("conv_id", "copies")


def unforged(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def rendered_turn(role: Column, text: Column) -> Column:
    one_line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(BEFORE), unforged(one_line), F.lit(BETWEEN), unforged(text), F.lit(AFTER))


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered): each maximal conversation as one text."""
    turns = cut(rolled(conversations))  # three readers; the windows run once
    kept = turns.join(maximal(turns).hint("shuffle_merge"), "conv_id")
    lines = F.array_sort(F.collect_list(F.struct("pos", rendered_turn(F.col("role"), F.col("text")).alias("line"))))
    whole = kept.groupBy("conv_id").agg(F.first("turns").alias("n_turns"), F.first("copies").alias("n_copies"), lines.alias("lines"))
    return whole.select("conv_id", "n_turns", "n_copies", F.concat_ws("", F.col("lines.line")).alias("rendered"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = formatted(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", "n_copies", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


_UNFORGED = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
OP2_SQL = rf"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS turns,
         list({{'role': role, 'text': text}}) OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS so_far
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
whole AS (
  SELECT min(conv_id) AS conv_id, max(turns) AS n_turns, count(*) AS n_copies, so_far
  FROM placed WHERE pos = turns GROUP BY so_far),
kept AS (
  SELECT *, array_to_string(list_transform(so_far, lambda t: '<|im_start|>' || {_UNFORGED.format("replace(replace(t.role, '\\', '\\\\'), chr(10), '\\n')")}
      || chr(10) || {_UNFORGED.format('t.text')} || '<|im_end|>' || chr(10)), '') AS rendered
  FROM whole w WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.pos < p.turns AND p.so_far = w.so_far))
SELECT conv_id, n_turns::BIGINT AS n_turns, n_copies::BIGINT AS n_copies, length(rendered)::BIGINT AS n_chars,
       sha256(rendered) AS rendered_sha256
FROM kept
"""
