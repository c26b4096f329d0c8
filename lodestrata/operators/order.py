"""Running sums over a whole table without one task seeing it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of the ordering column that share a chunk.
CHUNK = 1 << 16


def running_before(df: DataFrame, order: str, amount: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with the sum of `amount` over all rows before each one, by a whole-number column without repeats.

    Chunks of the order are summed first; only their sums, one row a chunk, meet
    in one task. Within a chunk a window adds up the rest. The column should be
    dense, or `chunk` larger by as much as it isn't. Rows without an order come
    first, in no order among them.
    """
    cut = df.withColumns({"__amount": amount, "__chunk": F.expr(f"`{order}` div {chunk} - CASE WHEN `{order}` % {chunk} < 0 THEN 1 ELSE 0 END")})
    sums = cut.groupBy("__chunk").agg(F.sum("__amount").alias("__sum"))
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("__chunk").alias("__of"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(bases, F.col("__chunk").eqNullSafe(F.col("__of")))
    return joined.withColumn(name, F.col("__base") + F.coalesce(F.sum("__amount").over(inside), F.lit(0))).drop("__amount", "__chunk", "__of", "__sum", "__base")
