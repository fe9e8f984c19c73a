"""Payload readers and bounded gunzip."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderlog.fixed import MAX_PAYLOAD_BYTES, PROBLEM_ENCODING, PROBLEM_JSON, PROBLEM_TOO_LARGE
from cinderlog.functions.keys import utf8_text

_HEADER_BYTES = 10


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """One payload per file, as bytes, with the encoding taken from the file name."""
    files = spark.read.format("binaryFile").load(path)
    gzipped = F.col("path").endswith(".gz")
    return files.select(
        F.col("path").alias("batch_id"),
        F.col("content").alias("body"),
        F.when(gzipped, F.lit("gzip")).otherwise(F.lit("")).alias("encoding"),
    )


def _inflate(raw: bytes, limit: int) -> tuple[bytes | None, str | None]:
    """Inflate up to ``limit`` bytes and stop there; members may follow one another."""
    if len(raw) < _HEADER_BYTES or raw[:3] != b"\x1f\x8b\x08":
        return None, PROBLEM_ENCODING
    out, rest = bytearray(), raw
    try:
        while rest:
            stream = zlib.decompressobj(wbits=31)
            out += stream.decompress(rest, limit + 1 - len(out))
            if len(out) > limit:
                return None, PROBLEM_TOO_LARGE
            if not stream.eof:
                return None, PROBLEM_JSON  # cut off inside the body
            rest = stream.unused_data
    except zlib.error:
        return None, PROBLEM_JSON
    return bytes(out), None


def inflate(payloads: DataFrame, max_bytes: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """Payload text of byte payloads; ``problem`` says why there is none.

    Without a valid gzip header the encoding is at fault; a stream that breaks
    later reads as broken JSON. The limit counts inflated bytes.
    """

    @F.pandas_udf("struct<payload: string, problem: string>")
    def gunzip(bodies: pd.Series) -> pd.DataFrame:
        done = [(None, None) if b is None else _inflate(bytes(b), max_bytes) for b in bodies]
        return pd.DataFrame(
            {
                "payload": [None if b is None else b.decode("utf-8", "replace") for b, _ in done],
                "problem": [p for _, p in done],
            }
        )

    zipped = F.col("encoding") == "gzip"
    read = payloads.withColumn("_z", gunzip(F.when(zipped, F.col("body"))))
    return read.select(
        "batch_id",
        F.when(zipped, F.col("_z.payload")).otherwise(utf8_text(F.col("body"))).alias("payload"),
        F.when(zipped, F.col("_z.problem")).alias("problem"),
    )
