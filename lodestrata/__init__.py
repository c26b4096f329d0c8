"""Event-log analytics on Spark: DataFrame operators over append-only logs."""
