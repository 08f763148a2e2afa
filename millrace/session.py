"""The settings that the library's results rest on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",  # checked arithmetic
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
}


def session(name: str = "millrace", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only where none is set, on one machine."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one. It goes when the driver's JVM ends: lazy results still read from it before."""
    path = f"{shared_root(spark)}/millrace/{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores if they come in fewer partitions than there are, as a small table's one file does. A large
    table is in more, and stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if not rows.isStreaming and rows.rdd.getNumPartitions() < cores else rows


def require_ansi(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.ansi.enabled").lower() != "true":
        raise RuntimeError("spark.sql.ansi.enabled must be true: products that overflow have to fail")
