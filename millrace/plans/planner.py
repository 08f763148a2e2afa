"""Compiles a valid graph to one DataFrame plan of built-in expressions.

Rows carry _src_partition and _src_seq, their path (_path, a digest), and the partition that they are in (_part) as
columns; Spark's own partitions have nothing to do with them, so routing moves no row. A row that an operator can't take
turns into an error that is raised when the row is computed, and only then: behind an empty source nothing fails.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import OperatorFailure
from millrace.functions import identity
from millrace.limits import DEFAULT, Limits
from millrace.operators import TRANSFORMS
from millrace.plans.spec import Edge
from millrace.plans.validate import Validated
from millrace.registry import REGISTRY
from millrace.session import require_ansi
from millrace.sources import line_rows, range_rows

FIELDS = {"value": "bigint", "line": "string", "word": "string"}
LINEAGE = ("_src_stage", "_src_partition", "_src_seq", "_path", "_part")


def source_rows(spark: SparkSession, graph: Validated, limits: Limits = DEFAULT) -> DataFrame:
    own = graph.settings[graph.source.stage_id]
    if graph.source.operator == "range":
        return range_rows(spark, own["start"], own["end_exclusive"], graph.source.parallelism, limits)
    return line_rows(spark, own["corpus"], graph.source.parallelism)


def _failing(kind: str, message: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def _checked(rows: DataFrame, wanted: str, operator: str) -> DataFrame:
    """Rows with the wanted field; other rows raise. Nulls stand for fields that a row has not."""
    message = f"{operator} requires exactly one field {wanted!r}"
    fields = [c for c in rows.columns if c in FIELDS]
    if fields == [wanted]:
        return rows
    kept = [c for c in rows.columns if c not in FIELDS]
    own = F.coalesce(F.col(wanted), _failing(FIELDS[wanted], message)) if wanted in fields else _failing(FIELDS[wanted], message)
    return rows.select(*kept, own.alias(wanted))


def route(rows: DataFrame, edge: Edge, partitions: int, job: bytes, tuple_id: Column, domains: dict = identity.DOMAINS) -> DataFrame:
    """Sets _part. field_hash sends equal values to one partition, shuffle deals by the row's identity, and broadcast
    gives every partition a copy."""
    if edge.routing == "broadcast":
        return rows.withColumn("_part", F.explode(F.array(*(F.lit(p) for p in range(partitions)))))
    if edge.routing == "field_hash":
        missing = _failing("bigint", "routing field is missing")
        value = F.coalesce(F.col("value"), missing) if "value" in rows.columns else missing
        return rows.withColumn("_part", identity.value_route_column(value, partitions))
    part = F.lit(0) if partitions == 1 else identity.shuffle_route_column(job, edge.edge_id, tuple_id, partitions, domains)
    return rows.withColumn("_part", part)


def compile_graph(spark: SparkSession, graph: Validated, job: bytes, *, limits: Limits = DEFAULT, domains: dict = identity.DOMAINS, source: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The sink's rows: their fields and LINEAGE. source: gives other rows than the source stage's, with its columns."""
    require_ansi(spark)
    first = graph.source.stage_id
    rows = source() if source else source_rows(spark, graph, limits)
    path = identity.source_path_column(job, first, F.col("_src_partition"), F.col("_src_seq"), domains)
    made = {first: rows.withColumn("_src_stage", F.lit(first)).withColumn("_part", F.col("_src_partition")).withColumn("_path", path).withColumn("_ordinal", F.lit(0))}
    for k in graph.order[1:]:
        stage, edges = graph.stages[k], graph.incoming[k]
        twice = [s for s, n in Counter(e.source for e in edges).items() if n > 1 and s == first]
        if twice and k != graph.sink.stage_id:
            raise OperatorFailure(f"stage {first} has parallel edges to stage {k}: their rows could not be told apart")
        branches = []
        for edge in edges:
            own = made[edge.source]
            tuple_id = lambda: identity.tuple_column(job, F.col("_src_stage"), F.col("_src_partition"), F.col("_src_seq"), F.col("_path"))
            if edge.source != first:  # a source's rows have the same name on every edge
                producer = identity.task_column(job, edge.source, F.col("_part"))
                own = own.withColumn("_path", identity.child_path_column(tuple_id(), producer, edge.edge_id, F.col("_ordinal"), domains))
            branches.append(route(own, edge, stage.parallelism, job, tuple_id(), domains).drop("_ordinal"))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
        if k == graph.sink.stage_id:
            fields = sorted(c for c in rows.columns if c in FIELDS)
            rows = rows.select(*fields, *LINEAGE)
            # the same row on parallel edges is one record of its partition; a stream's are made one when it is sealed
            return rows.distinct() if twice and not rows.isStreaming else rows
        op = REGISTRY[stage.operator]
        out = TRANSFORMS[stage.operator](_checked(rows, op.reads, stage.operator), graph.settings[k])
        made[k] = out if "_ordinal" in out.columns else out.withColumn("_ordinal", F.lit(0))
    raise AssertionError("the sink comes last")
