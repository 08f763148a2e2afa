"""range: the integers of a half-open interval, dealt in turn to the source's partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import InvalidTopology, LimitExceeded
from millrace.limits import DEFAULT, Limits


def range_settings(start: int, end_exclusive: int, limits: Limits = DEFAULT) -> int:
    """The length of a valid range."""
    if start > end_exclusive:
        raise InvalidTopology("range start exceeds its end")
    if end_exclusive - start > limits.range_length and limits.data_limits:
        raise LimitExceeded(f"a range has at most {limits.range_length} values")
    return end_exclusive - start


def range_rows(spark: SparkSession, start: int, end_exclusive: int, parallelism: int = 1, limits: Limits = DEFAULT) -> DataFrame:
    """value, _src_partition and _src_seq (from 1). The length is what is counted, so no sum overflows."""
    length = range_settings(start, end_exclusive, limits)
    rows = spark.range(length)
    return rows.select(
        (F.lit(start).cast("long") + F.col("id")).alias("value"),
        (F.col("id") % parallelism).cast("int").alias("_src_partition"),
        (F.expr(f"id div {parallelism}") + 1).alias("_src_seq"),
    )
