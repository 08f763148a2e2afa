"""Bounded streaming runs: the same plans over a stream that ends (trigger availableNow).

The source's rows are files; each micro-batch takes some of them. The query's checkpoint holds which files are done and
the Parquet sink's log which output files count, so a run that is stopped goes on where it was, and one that has ended
adds nothing when it is started again. Order is global, so it is made when the output is sealed, and so are records of
one identity: a stream would have to remember all of them.

How many rows each source partition has is written beside the source's files before any is read (EOFS). What is complete
is read from the checkpoint: the rows of the files of committed batches, as contiguous prefixes. A whole job is sealed
only when every partition is complete.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import results
from millrace.errors import CorruptResult
from millrace.functions import identity
from millrace.limits import DEFAULT, Limits
from millrace.plans import planner
from millrace.plans.validate import Validated
from millrace.store import Store
from millrace.streaming.progress import completed_prefix

EOFS = "eofs.json"
#: Seconds between two looks at a running query.
LOOK = 0.2


def source_files(spark: SparkSession, graph: Validated, folder: str, files: int = 8, limits: Limits = DEFAULT) -> str:
    """The source stage's rows as files, for a stream to read."""
    planner.source_rows(spark, graph, limits).repartition(files).write.mode("ignore").parquet(folder)
    return folder


def committed_files(spark: SparkSession, checkpoint: str) -> list[str]:
    """The source files of the batches that a query has committed: its last commit names an offset, which is a place in the
    source's log of files."""
    store = Store(spark, checkpoint)
    commits = [int(x) for x in store.names("commits") if x.isdigit()]
    if not commits:
        return []
    last = json.loads(store.read(f"offsets/{max(commits)}").splitlines()[-1])["logOffset"]
    found = set()
    for name in store.names("sources/0"):
        if name.split(".")[0].isdigit():
            entries = map(json.loads, store.read(f"sources/0/{name}").splitlines()[1:])
            found.update(e["path"] for e in entries if e["batchId"] <= last)
    return sorted(found)


def completed(spark: SparkSession, source: str, checkpoint: str, eofs: tuple[int, ...]) -> DataFrame:
    """part, completed, eof and final of each source partition."""
    ends = spark.createDataFrame(list(enumerate(eofs)), "part int, eof long")
    files = committed_files(spark, checkpoint)
    rows = spark.read.parquet(*files) if files else spark.read.parquet(source).limit(0)
    return completed_prefix(rows.select(F.col("_src_partition").alias("part"), F.col("_src_seq").alias("seq")), ends)


def run_stream(spark: SparkSession, graph: Validated, job: bytes, source: str, out: str, checkpoint: str, *, files_per_batch: int = 4, limits: Limits = DEFAULT, domains: dict = identity.DOMAINS, committed: Callable[[], None] | None = None) -> DataFrame:
    """Runs the graph over the files of source (a field, _src_partition and _src_seq) until all that are there now are
    done; the sink's rows so far. An error of an operator ends the query, and is raised. committed: called after new
    batches."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows = planner.compile_graph(spark, graph, job, limits=limits, domains=domains, source=lambda: stream)
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        seen = None
        while committed is not None and not query.awaitTermination(LOOK):
            batch = (query.lastProgress or {}).get("batchId")
            if batch != seen:
                seen = batch
                committed()
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(rows.schema).parquet(out)


def run_sealed(spark: SparkSession, graph: Validated, job: bytes, folder: str, *, limits: Limits = DEFAULT, told: Callable[[int], None] | None = None, **more) -> results.ResultSet:
    """A whole job as a stream: source files, query, sealed results, all below folder. told: gets the number of complete
    source partitions after new batches."""
    store = Store(spark, folder)
    source, checkpoint = source_files(spark, graph, f"{folder}/source", limits=limits), f"{folder}/checkpoint"
    store.write(EOFS, json.dumps(graph.eofs))
    eofs = tuple(json.loads(store.read(EOFS)))
    done = lambda: completed(spark, source, checkpoint, eofs).filter("final").count()
    rows = run_stream(spark, graph, job, source, f"{folder}/stream", checkpoint, limits=limits, committed=(lambda: told(done())) if told else None, **more)
    if done() != len(eofs):
        raise CorruptResult("a source partition is not complete")
    if told:
        told(len(eofs))
    twice = sum(e.source == graph.source.stage_id for e in graph.incoming[graph.sink.stage_id]) > 1
    return results.seal(rows, f"{folder}/results", graph.sink.parallelism, limits=limits, collapse=twice)
