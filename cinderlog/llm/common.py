"""What the operators share: input columns, stable row keys, written stages."""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.session import configure, scratch_path

# Code points of [\x20\x09-\x0D], the white space of every contract here.
BLANK = r"[\x20\x09-\x0D]"

# A finished job's shuffle files are dropped, since its result is a written
# table; Arrow batches are kept small because one text may have megabytes.
STAGE_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in STAGE_CONF.items():
        spark.conf.set(key, value)
    return spark


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: a cut lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Remove settled stages that nothing reads any more: what was made of them is written itself."""
    for df in settled:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Only (doc_id, text); a NULL text is the empty text, other columns are ignored.

    With ``carry`` the row as it came is kept in one column, ``whole``.
    """
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    return docs.select(*own, *[F.struct("*").alias("whole")] * carry)


def with_whole(ddl: str, docs: DataFrame) -> T.StructType:
    """The schema ``ddl``, and the column ``whole`` if ``docs`` carries it."""
    schema = T.StructType.fromDDL(ddl)
    return schema.add(docs.schema["whole"]) if "whole" in docs.columns else schema


def row_key(doc_id: Column, text: Column) -> Column:
    """A shuffle key that is the id where there is one, so that NULL ids spread out."""
    return F.coalesce(doc_id, F.xxhash64(text))


def placed(docs: DataFrame) -> DataFrame:
    """(key, ord, doc_id, text), hash-partitioned by ``key``.

    Rows that share an id are told apart by ``ord``. All users of this frame in
    one query share its exchange, so the texts move once.
    """
    keyed = docs.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    order = Window.partitionBy("key").orderBy(F.xxhash64("doc_id", "text"))
    return keyed.withColumn("ord", F.row_number().over(order)).select("key", "ord", "doc_id", "text")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; executors have the same module."""
    if "/opt/tokenizers" not in sys.path and not _has_public():
        sys.path.append("/opt/tokenizers")
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def _has_public() -> bool:
    import importlib.util

    return importlib.util.find_spec("public_tokenizers") is not None
