"""Streams of payloads: a broker topic in production, a folder of files otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderlog.functions.keys import utf8_text


def topic_payloads(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Payloads of a Kafka topic; needs Spark's Kafka package on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return raw.select(
        F.concat_ws("-", "topic", "partition", "offset").alias("batch_id"),
        utf8_text(F.col("value")).alias("payload"),
    )


def folder_payloads(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str = "batch_id bigint, payload string",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Payload rows of files that arrive in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
