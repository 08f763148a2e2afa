"""Shared folders, file access from tasks and other small helpers of the llm operators.

The driver and the executors share no local folder, so whatever one task writes and another reads goes below the
folder named by ``spark.checkpoint.dir``. Files written by tasks carry a name of their own for every attempt; only the
names that a committed Parquet manifest holds are ever read, so retried, speculative or lost attempts leave nothing
but unread files behind.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_root, spread, work_dir

_SHIPPED: set[str] = set()
BATCH_BYTES = 8 << 20
#: A key of more rows than HOT is dealt over several tasks; of a table of more than HOT * HOT_KEYS rows, one of more than its
#: share of HOT_KEYS, so that there are at most HOT_KEYS such keys, however many rows there are.
HOT, HOT_KEYS = 1 << 16, 1 << 16


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that it need not be installed there; and bounds
    the session's Arrow batches by BATCH_BYTES: rows hold whole texts, and each task has a batch on both sides."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if context.applicationId in _SHIPPED:
        return
    package, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    target = context._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark, 'package')}/{package.name}.zip")
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(target.toString())
    _SHIPPED.add(context.applicationId)


def clear(spark: SparkSession) -> None:
    """Removes all work folders below the shared one. Only results that were written elsewhere can be read afterwards."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/millrace")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it again: cuts the lineage with a copy that outlives executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def meet(rows: DataFrame, own: DataFrame, by: list[str], other: str, total: int) -> DataFrame:
    """rows, each with what own has of its key: own has one row for each key (by, never null) of rows, and in n how many rows
    have it; total is the number of all rows. The rows of a frequent key are dealt by their column other to several tasks,
    with a copy of its row of own for each. (As own is an aggregate by the same key, adaptive execution can't split this
    join.) What is broadcast are the frequent keys, HOT_KEYS at most. No key of HOT rows or fewer in all is frequent: then it is
    a plain join, whose plan is a third as large."""
    if total <= HOT:
        return rows.join(own, by)
    most = max(HOT, -(-total // HOT_KEYS))
    chunks = F.ceil(F.col("n") / most).cast("int")
    hot = own.filter(F.col("n") > most).select(*by, chunks.alias("_chunks"))
    chunk = F.pmod(F.xxhash64(other), F.coalesce("_chunks", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(hot), by, "left").withColumn("_chunk", chunk).drop("_chunks")
    copies = own.withColumn("_chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return dealt.join(copies, [*by, "_chunk"]).drop("_chunk")


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path within it."""
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> str:
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batches: Iterator[pa.RecordBatch], at_most: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most at_most, so that what a task builds from one batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_most):
            yield batch.slice(start, at_most)


def utf8(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """A text column as strings; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


__all__ = ["clear", "meet", "new_file", "opened", "rows_of", "ship", "shared_root", "shuffle_partitions", "spread", "stage", "texts", "utf8", "work_dir"]
