"""Requests as they arrive: lines of JSON from files or a stream of files, and made-up load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.validate import requests


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(raw, source, payload, status, ingress) of files that hold one request a line."""
    return requests(spark.read.text(path).withColumnRenamed("value", "raw")).withColumn("ingress", F.lit("http"))


def follow_requests(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "raw")
    return requests(raw).withColumn("ingress", F.lit("http"))


def read_messages(events: DataFrame) -> DataFrame:
    """Messages (source, payload as bytes) of the other ingress, on which nothing need be filled."""
    return events.select("source", F.decode("payload", "UTF-8").alias("payload"), F.lit(202).alias("status"), F.lit("grpc").alias("ingress"))


def generated(spark: SparkSession, rows: int, source: str = "bench", payload: str = "hello-world", partitions: int | None = None) -> DataFrame:
    return spark.range(0, rows, 1, partitions).select("id", F.lit(source).alias("source"), F.lit(payload).alias("payload"))


def generated_stream(spark: SparkSession, rows_per_second: int, source: str = "bench", payload: str = "hello-world") -> DataFrame:
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rows.select("timestamp", F.col("value").alias("id"), F.lit(source).alias("source"), F.lit(payload).alias("payload"))
