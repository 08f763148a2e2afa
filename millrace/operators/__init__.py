"""The transforms: functions of (DataFrame, settings). Columns that begin with _ are lineage and pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import words_of


def even(rows: DataFrame) -> DataFrame:
    """Remainders are truncated, so odd negatives are odd."""
    return rows.filter(F.col("value") % 2 == 0)


def less_than(rows: DataFrame, threshold: int) -> DataFrame:
    return rows.filter(F.col("value") < F.lit(threshold).cast("long"))


def multiply(rows: DataFrame, factor: int) -> DataFrame:
    """A product outside int64 fails the job (ANSI arithmetic)."""
    return rows.withColumn("value", F.col("value") * F.lit(factor).cast("long"))


def split_words(rows: DataFrame, most: int = 16) -> DataFrame:
    """word, and _ordinal, its place in the line."""
    kept = [c for c in rows.columns if c not in ("line", "_ordinal")]
    return rows.select(*kept, F.posexplode(words_of(F.col("line"), most)).alias("_ordinal", "word"))


def min_length(rows: DataFrame, length: int) -> DataFrame:
    """In code points."""
    return rows.filter(F.char_length("word") >= F.lit(length))


TRANSFORMS = {
    "even": lambda rows, s: even(rows),
    "less_than": lambda rows, s: less_than(rows, s["threshold"]),
    "multiply": lambda rows, s: multiply(rows, s["factor"]),
    "split_words": lambda rows, s: split_words(rows),
    "min_length": lambda rows, s: min_length(rows, s["length"]),
}
