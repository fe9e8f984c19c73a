"""Session settings and the shared folder for cut lineages."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that may be changed on a running session. AQE splits skewed join
# partitions and sizes shuffles at run time.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Spark itself copies the archive to every executor; it is only made on the
    driver's disk.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="cinderlog-code-"), "cinderlog")
    sc.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))
    _shipped.add(sc.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to an existing session."""
    ship_package(spark)
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "cinderlog", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Checkpoints go when nothing refers to them any more.
    static = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in {**static, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is made up only for a local master without the
    setting; on a cluster the missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if base is None:
        base = sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="cinderlog-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/cinderlog/{label}-{uuid.uuid4().hex}"


def durable(df):
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
