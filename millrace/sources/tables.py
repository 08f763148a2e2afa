"""Columns of tables as sources. Scans stay narrow: only the column and its key are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import chunks
from millrace.limits import DEFAULT
from millrace.session import spread


def table_values(table: DataFrame, column: str) -> DataFrame:
    """value: an integer column; the data model has no null, so nulls are refused."""
    refused = F.raise_error(F.lit(f"column {column} holds null, which is no value")).cast("long")
    return table.select(F.coalesce(F.col(column).cast("long"), refused).alias("value"))


def table_lines(table: DataFrame, text_col: str, id_col: str, words: int = DEFAULT.words_per_line) -> DataFrame:
    """id_col, ordinal and line: each text is cut by itself, so (id, ordinal) names a line."""
    rows = spread(table.select(id_col, text_col))  # cutting texts is worth a core for each part of them
    return rows.select(F.col(id_col), F.posexplode(chunks(F.col(text_col), words)).alias("ordinal", "line"))
