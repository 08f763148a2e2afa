"""Progress of source partitions: the contiguous prefix of sequence numbers that is complete, and whether it is all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def completed_prefix(done: DataFrame, eofs: DataFrame, block: int = BLOCK) -> DataFrame:
    """part, completed, eof and final for each row (part, eof) of eofs. done: rows (part, seq), seq from 1; repeats count
    once.

    Sequences are counted by blocks, with map-side parts; of each partition only the first block that is not full is
    looked into. So the windows see a row for each block, and then at most one block for each partition.
    """
    seen = done.select("part", "seq").distinct().withColumn("block", F.expr(f"(seq - 1) div {block}L"))
    counts = seen.groupBy("part", "block").agg(F.count("*").alias("n"))
    full = counts.filter(F.col("n") == block)
    at = Window.partitionBy("part").orderBy("block")
    leading = full.withColumn("k", F.row_number().over(at) - 1).filter(F.col("k") == F.col("block")).groupBy("part").agg(F.count("*").alias("blocks"))
    base = eofs.select("part", "eof").join(leading, "part", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0).cast("long")))
    edge = seen.join(base.select("part", F.col("blocks").alias("block")), ["part", "block"])
    place = Window.partitionBy("part").orderBy("seq")
    rest = edge.withColumn("k", F.row_number().over(place)).filter(F.col("seq") == F.col("block") * block + F.col("k")).groupBy("part").agg(F.count("*").alias("more"))
    found = base.join(rest, "part", "left")
    completed = F.col("blocks") * block + F.coalesce("more", F.lit(0).cast("long"))
    return found.select("part", completed.alias("completed"), "eof", (completed == F.col("eof")).alias("final"))
