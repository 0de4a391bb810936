"""The driver's tables as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def produce_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as produce commands: topic, arrival, producer_id, seq, priority, payload, ts_ms."""
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"),
        F.col("event_id").alias("arrival"),
        F.col("user_id").cast("string").alias("producer_id"),
        F.get_json_object("props", "$.k").cast("long").alias("seq"),
        (F.col("user_id") % 8).cast("int").alias("priority"),
        F.col("props").alias("payload"),
        ts.alias("ts_ms"),
    )


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as produce commands with large payloads."""
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("topic"), F.col("doc_id").alias("arrival"), F.col("text").alias("payload"))
