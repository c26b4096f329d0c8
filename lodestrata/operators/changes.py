"""Changes in a node's state over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def transitions(series: DataFrame, state: str, by: str, order: str, first: bool = False) -> DataFrame:
    """The rows at which a node's state differs from the one before; the first row only if asked."""
    before = F.lag(state).over(Window.partitionBy(by).orderBy(order))
    rows = series.withColumn("previous", before)
    changed = F.col("previous") != F.col(state)
    return rows.filter(changed | F.col("previous").isNull() if first else changed)
