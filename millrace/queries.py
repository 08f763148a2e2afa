"""One query for each operator, over the driver's tables: name -> function of (spark, sf_dir), with its SQL."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import operators, results, streaming
from millrace.functions import identity
from millrace.jobs import Catalogue
from millrace.limits import Limits
from millrace.plans import planner, spec
from millrace.plans.spec import Edge, Stage, Topology
from millrace.plans.validate import validate
from millrace.registry import fingerprint
from millrace.session import spread, work_dir
from millrace.sources import range_rows, table_lines, table_values
from millrace.streaming.progress import completed_prefix

JOB = bytes(range(1, 17))
PARTS = 4
OPEN = Limits(data_limits=False)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    return table_values(_table(spark, sf_dir, name), column)


def graph(name: str, *stages: tuple, edges: list[tuple] | None = None):
    """A valid graph of stages (operator, parallelism, settings); by default a chain of shuffles."""
    from millrace.registry import REGISTRY

    own = tuple(Stage(k, f"s{k}", REGISTRY[op].role, p, op, 1, tuple((a, str(b)) for a, b in sorted(s.items()))) for k, (op, p, s) in enumerate(stages, 1))
    edges = edges or [(k, k + 1, "shuffle") for k in range(1, len(stages))]
    return validate(Topology(1, name, own, tuple(Edge(k, a, b, r, "value" if r == "field_hash" else "") for k, (a, b, r) in enumerate(edges, 1)), fingerprint()), OPEN)


def dealt(values: DataFrame, column: str = "value", parts: int = PARTS) -> DataFrame:
    """A key from 0 as a range would deal it: partition and sequence."""
    return values.withColumns({"_src_partition": F.pmod(column, F.lit(parts)).cast("int"), "_src_seq": F.expr(f"{column} div {parts}") + 1})


# ------------------------------------------------------------------------------------------------------------- sources


def src_range(spark, sf_dir):
    return range_rows(spark, -1000, 49_000, PARTS).select("value")


def source_dealing(spark, sf_dir):
    return range_rows(spark, 5, 20_005, 3).select(F.col("_src_partition").alias("part"), F.col("_src_seq").alias("seq"), "value")


def src_lines_documents(spark, sf_dir):
    return table_lines(_table(spark, sf_dir, "documents"), "text", "doc_id")


def src_lines_corpus(spark, sf_dir):
    g = graph("lines", ("lines", 2, {"corpus": "gettysburg"}), ("collect", 1, {}))
    rows = planner.compile_graph(spark, g, JOB)
    return rows.select("line", F.col("_src_partition").alias("part"), F.col("_src_seq").alias("seq"))


# ---------------------------------------------------------------------------------------------------------- transforms


def op_multiply_lineitem(spark, sf_dir):
    return operators.multiply(_values(spark, sf_dir, "lineitem", "l_orderkey"), 3)


def op_even_orders(spark, sf_dir):
    return operators.even(_values(spark, sf_dir, "orders", "o_orderkey"))


def op_less_than_orders(spark, sf_dir):
    return operators.less_than(_values(spark, sf_dir, "orders", "o_custkey"), 700)


def chain_scale_filter(spark, sf_dir):
    rows = operators.multiply(_values(spark, sf_dir, "lineitem", "l_orderkey"), 3)
    return operators.less_than(operators.even(rows), 40_000)


def _words(spark, sf_dir):
    return operators.split_words(src_lines_documents(spark, sf_dir))


def op_split_words_documents(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", "ordinal", F.col("_ordinal").alias("position"), "word")


def op_min_length_documents(spark, sf_dir):
    return operators.min_length(_words(spark, sf_dir), 4).select("doc_id", "ordinal", F.col("_ordinal").alias("position"), "word")


# ---------------------------------------------------------------------------------------------------------- aggregates


def count_by_word_top(spark, sf_dir):
    return results.count_by(operators.min_length(_words(spark, sf_dir), 4), "word", 50)


def count_by_event_type(spark, sf_dir):
    return results.count_by(_table(spark, sf_dir, "events").select("event_type"), "event_type")


def count_by_user_string_order(spark, sf_dir):
    return results.count_by(_table(spark, sf_dir, "events").select("user_id"), "user_id", 100)


def count_by_totals(spark, sf_dir):
    counted = results.count_by(operators.min_length(_words(spark, sf_dir), 4), "word")
    return counted.agg(F.sum("count").alias("records"), F.count("*").alias("distinct_words"))


# ------------------------------------------------------------------------------------------------------- graph and job


def _over(spark, sf_dir, g, table: str, column: str) -> DataFrame:
    """The graph over a table's key instead of its range."""
    rows = lambda: dealt(_values(spark, sf_dir, table, column), parts=g.source.parallelism)
    return planner.compile_graph(spark, g, JOB, limits=OPEN, source=rows)


def _hex(rows: DataFrame) -> DataFrame:
    return rows.select("value", F.col("_src_partition").alias("part"), F.col("_src_seq").alias("seq"), F.lower(F.hex("_path")).alias("path"))


SOURCE = ("range", PARTS, {"start": 0, "end_exclusive": 1})


def job_word_count(spark, sf_dir):
    g = graph("word-count", ("lines", 2, {"corpus": "gettysburg"}), ("split_words", 2, {}), ("min_length", 2, {"length": 4}), ("collect", 1, {}))
    return results.count_by(planner.compile_graph(spark, g, JOB), "word")


def job_numbers(spark, sf_dir):
    g = graph("numbers", SOURCE, ("multiply", 3, {"factor": 3}), ("even", 2, {}), ("less_than", 2, {"threshold": 30_000}), ("collect", 1, {}))
    return _over(spark, sf_dir, g, "orders", "o_orderkey").select("value", F.col("_src_partition").alias("part"), F.col("_src_seq").alias("seq"))


def lineage_source_ids(spark, sf_dir):
    return _hex(_over(spark, sf_dir, graph("ids", SOURCE, ("collect", 1, {})), "orders", "o_orderkey"))


def lineage_child_ids(spark, sf_dir):
    return _hex(_over(spark, sf_dir, graph("ids", SOURCE, ("multiply", 1, {"factor": 3}), ("collect", 1, {})), "orders", "o_orderkey"))


def route_field_hash(spark, sf_dir):
    rows = _values(spark, sf_dir, "lineitem", "l_partkey").withColumn("part", identity.value_route_column(F.col("value"), 7))
    return rows.groupBy("part").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))


def route_shuffle(spark, sf_dir):
    g = graph("shuffle", SOURCE, ("collect", 5, {}))
    return _over(spark, sf_dir, g, "orders", "o_orderkey").groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("rows"), F.sum("value").alias("total"))


def route_broadcast(spark, sf_dir):
    g = graph("copies", SOURCE, ("even", 3, {}), ("collect", 1, {}), edges=[(1, 2, "broadcast"), (2, 3, "shuffle")])
    return _over(spark, sf_dir, g, "orders", "o_orderkey").groupBy("value").agg(F.count("*").alias("copies"), F.countDistinct("_path").alias("identities"))


def fan_out_fan_in(spark, sf_dir):
    g = graph("fan", SOURCE, ("multiply", 2, {"factor": 2}), ("less_than", 2, {"threshold": 5000}), ("collect", 2, {}), edges=[(1, 2, "shuffle"), (1, 3, "field_hash"), (2, 4, "shuffle"), (3, 4, "shuffle"), (1, 4, "shuffle")])
    return _over(spark, sf_dir, g, "orders", "o_orderkey").select("value", F.col("_src_seq").alias("seq"))


def parallel_edges_collapse(spark, sf_dir):
    g = graph("parallel", SOURCE, ("collect", 1, {}), edges=[(1, 2, "shuffle"), (1, 2, "shuffle")])
    return _over(spark, sf_dir, g, "orders", "o_orderkey").select("value")


def result_order_page(spark, sf_dir):
    """The page after a cursor: as many records as the default budget holds."""
    rows = _over(spark, sf_dir, graph("page", SOURCE, ("collect", 1, {})), "orders", "o_orderkey")
    cursor = (1, 1, 500, b"\xff" * 32)
    most = OPEN.default_page_bytes // (OPEN.record_overhead_bytes + 18)
    return results.after(rows, cursor).orderBy(*results.ORDER).limit(most).select("value", F.col("_src_partition").alias("part"), F.col("_src_seq").alias("seq"))


def seal_inventory(spark, sf_dir):
    rows = dealt(spread(_values(spark, sf_dir, "lineitem", "l_orderkey"))).withColumn("_part", F.col("_src_partition"))
    return results.inventory(rows.select("value", "_part")).withColumnRenamed("_part", "part")


def seal_inventory_words(spark, sf_dir):
    rows = _words(spark, sf_dir).select("word", F.pmod("doc_id", F.lit(PARTS)).cast("int").alias("_part"))
    return results.inventory(rows).withColumnRenamed("_part", "part")


def status_aggregates(spark, sf_dir):
    """Rows of each source partition, and how many partitions are complete: those that have as many rows as were dealt."""
    rows = dealt(_values(spark, sf_dir, "orders", "o_orderkey"))
    own = rows.groupBy(F.col("_src_partition").alias("part")).agg(F.count("*").alias("rows"), F.max("_src_seq").alias("last_seq"))
    return own.withColumn("contiguous", F.col("rows") == F.col("last_seq"))


def watermark_prefix(spark, sf_dir):
    """How far each source partition is complete when some of its rows are missing."""
    orders = _table(spark, sf_dir, "orders")
    rows = dealt(orders.filter("o_custkey % 97 <> 5").select(F.col("o_orderkey").alias("value")))
    eofs = dealt(orders.select(F.col("o_orderkey").alias("value"))).groupBy(F.col("_src_partition").alias("part")).agg(F.max("_src_seq").alias("eof"))
    return completed_prefix(rows.select(F.col("_src_partition").alias("part"), F.col("_src_seq").alias("seq")), eofs, block=16)


def _sealed(spark, sf_dir) -> results.ResultSet:
    rows = _over(spark, sf_dir, graph("sealed", SOURCE, ("collect", PARTS, {})), "orders", "o_orderkey")
    return results.seal(rows, work_dir(spark, "sealed"), PARTS, limits=OPEN)


def sealed_manifest(spark, sf_dir):
    """What the manifest of a sealed set says of its sink partitions, once the rows have been held against it."""
    found = results.verify(_sealed(spark, sf_dir), OPEN).manifest["partitions"]
    return spark.createDataFrame([(p["partition"], p["records"], p["bytes"], p["checksum"]) for p in found], "part int, records long, bytes long, checksum string")


def sealed_page(spark, sf_dir):
    """The second page of a sealed set, after the first one's cursor."""
    own = _sealed(spark, sf_dir)
    found = results.page(own, results.page(own, limits=OPEN).cursor, limits=OPEN)
    return spark.createDataFrame([(r.value, r["_src_partition"], r["_src_seq"]) for r in found.records], "value long, part int, seq long")


def sealed_stream(spark, sf_dir):
    """A stream over files of orders, in micro-batches, and its sealed records."""
    g = graph("stream", SOURCE, ("multiply", 3, {"factor": 3}), ("even", 2, {}), ("less_than", 2, {"threshold": 30_000}), ("collect", 2, {}))
    folder = work_dir(spark, "stream")
    dealt(_values(spark, sf_dir, "orders", "o_orderkey")).repartition(6).write.parquet(f"{folder}/source")
    rows = streaming.run_stream(spark, g, JOB, f"{folder}/source", f"{folder}/out", f"{folder}/checkpoint", files_per_batch=3, limits=OPEN)
    found = results.seal(rows, f"{folder}/sealed", 2, limits=OPEN)
    return found.rows.select("value", F.col("_src_partition").alias("part"), F.col("_src_seq").alias("seq"))


def job_status(spark, sf_dir):
    """A job from its document to its status: submitted, run as a stream, sealed; with the count and sum of its records."""
    g = graph("whole", ("range", PARTS, {"start": -1000, "end_exclusive": 4000}), ("multiply", 3, {"factor": 3}), ("even", 2, {}), ("collect", 2, {}))
    catalogue = Catalogue(spark, work_dir(spark, "jobs"))
    job = catalogue.submit(spec.to_json(g.topology), JOB, 1)["job_id"]
    status = catalogue.run(job, stream=True)
    shown = ("state", "source_task_count", "completed_source_tasks", "result_partition_count", "manifest_count", "has_failure")
    rows = catalogue.results(job, status["manifest_set_digest"]).rows
    return rows.agg(*(F.lit(status[k]).alias(k) for k in shown), F.count("*").alias("records"), F.sum("value").alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        src_range, source_dealing, src_lines_documents, src_lines_corpus, op_multiply_lineitem, op_even_orders, op_less_than_orders, chain_scale_filter,
        op_split_words_documents, op_min_length_documents, count_by_word_top, count_by_event_type, count_by_user_string_order, count_by_totals,
        job_word_count, job_numbers, lineage_source_ids, lineage_child_ids, route_field_hash, route_shuffle, route_broadcast, fan_out_fan_in,
        parallel_edges_collapse, result_order_page, seal_inventory, seal_inventory_words, status_aggregates, watermark_prefix,
        sealed_manifest, sealed_page, sealed_stream, job_status,
    )
}

# ----------------------------------------------------------------------------------------------------------------- SQL


def _lines_of(table: str, text: str, key: str) -> str:
    return f"""w AS (SELECT {key}, list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '') AS w FROM {table}),
l AS (SELECT {key}, CAST(i AS INTEGER) AS ordinal, array_to_string(w[i * 16 + 1:i * 16 + 16], ' ') AS line FROM w, unnest(range(0, (len(w) + 15) // 16)) AS t(i)),
s AS (SELECT {key}, ordinal, list_filter(list_transform(regexp_split_to_array(line, '\\s+'), lambda x: lower(regexp_replace(x, '[^\\pL]', '', 'g'))), lambda x: x <> '') AS s FROM l),
words AS (SELECT {key}, ordinal, CAST(p - 1 AS INTEGER) AS position, s[p] AS word FROM s, unnest(range(1, len(s) + 1)) AS t(p))"""


_DOCS = "WITH " + _lines_of("documents", "text", "doc_id")
_CORPUS = "WITH corpus AS (SELECT 1 AS k, '{}' AS text), " + _lines_of("corpus", "text", "k")
_HEX = lambda x, n: f"lpad(lower(to_hex({x})), {n}, '0')"
_U64 = lambda digest: f"CAST('0x' || substr({digest}, 1, 16) AS UBIGINT)"
_DEALT = f"(SELECT o_orderkey AS value, o_orderkey % {PARTS} AS part, o_orderkey // {PARTS} + 1 AS seq FROM orders)"


def _source_path() -> str:
    head = (identity.DOMAINS["source"] + JOB + JOB + struct.pack(">H", 1)).hex()
    return f"sha256(unhex('{head}' || {_HEX('part', 4)} || {_HEX('seq', 16)}))"


def _tuple(path: str) -> str:
    return f"'{(JOB + JOB).hex()}0001' || {_HEX('part', 4)} || {_HEX('seq', 16)} || {path}"


def _oracles() -> dict[str, str]:
    from millrace.sources import corpus_text

    corpus = _CORPUS.format(" ".join(corpus_text("gettysburg").split()).replace("'", "''"))
    child = f"sha256(unhex('{identity.DOMAINS['child'].hex()}' || {_tuple('path')} || '{(JOB + struct.pack('>HH', 2, 0)).hex()}' || '00020000'))"
    shuffle = _U64(f"sha256(unhex('{(identity.DOMAINS['route'] + JOB + struct.pack('>H', 1)).hex()}' || {_tuple('path')}))")
    most = OPEN.default_page_bytes // (OPEN.record_overhead_bytes + 18)
    summed = lambda digest, k: f"CAST(sum(CAST('0x' || substr({digest}, {16 * k + 1}, 16) AS UBIGINT)) AS VARCHAR)"
    of = lambda name, x: f"'{name}:' || strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR)"
    checksum = lambda text: " || '.' || ".join(summed(f"sha256({text})", k) for k in range(4)) + " AS checksum"
    return {
        "src_range": "SELECT range AS value FROM range(-1000, 49000)",
        "source_dealing": "SELECT CAST((value - 5) % 3 AS INTEGER) AS part, (value - 5) // 3 + 1 AS seq, value FROM (SELECT range AS value FROM range(5, 20005))",
        "src_lines_documents": f"{_DOCS} SELECT doc_id, ordinal, line FROM l",
        "src_lines_corpus": f"{corpus} SELECT line, ordinal % 2 AS part, CAST(ordinal // 2 + 1 AS BIGINT) AS seq FROM l",
        "op_multiply_lineitem": "SELECT l_orderkey * 3 AS value FROM lineitem",
        "op_even_orders": "SELECT o_orderkey AS value FROM orders WHERE o_orderkey % 2 = 0",
        "op_less_than_orders": "SELECT o_custkey AS value FROM orders WHERE o_custkey < 700",
        "chain_scale_filter": "SELECT * FROM (SELECT l_orderkey * 3 AS value FROM lineitem) WHERE value % 2 = 0 AND value < 40000",
        "op_split_words_documents": f"{_DOCS} SELECT doc_id, ordinal, position, word FROM words",
        "op_min_length_documents": f"{_DOCS} SELECT doc_id, ordinal, position, word FROM words WHERE length(word) >= 4",
        "count_by_word_top": f"{_DOCS} SELECT word, count(*) AS count FROM words WHERE length(word) >= 4 GROUP BY word ORDER BY 2 DESC, 1 LIMIT 50",
        "count_by_event_type": "SELECT event_type, count(*) AS count FROM events GROUP BY event_type",
        "count_by_user_string_order": "SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
        "count_by_totals": f"{_DOCS} SELECT count(*) AS records, count(DISTINCT word) AS distinct_words FROM words WHERE length(word) >= 4",
        "job_word_count": f"{corpus} SELECT word, count(*) AS count FROM words WHERE length(word) >= 4 GROUP BY word",
        "job_numbers": f"SELECT value * 3 AS value, CAST(part AS INTEGER) AS part, seq FROM {_DEALT} WHERE value * 3 % 2 = 0 AND value * 3 < 30000",
        "lineage_source_ids": f"SELECT value, CAST(part AS INTEGER) AS part, seq, {_source_path()} AS path FROM {_DEALT}",
        "lineage_child_ids": f"SELECT value * 3 AS value, CAST(part AS INTEGER) AS part, seq, {child} AS path FROM (SELECT *, {_source_path()} AS path FROM {_DEALT})",
        "route_field_hash": f"SELECT CAST({_U64(f'sha256(unhex({chr(39)}000576616c756501{chr(39)} || {_HEX("l_partkey", 16)}))')} % 7 AS INTEGER) AS part, count(*) AS rows, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY 1",
        "route_shuffle": f"SELECT CAST({shuffle} % 5 AS INTEGER) AS part, count(*) AS rows, CAST(sum(value) AS BIGINT) AS total FROM (SELECT *, {_source_path()} AS path FROM {_DEALT}) GROUP BY 1",
        "route_broadcast": "SELECT o_orderkey AS value, count(*) AS copies, count(DISTINCT p) AS identities FROM orders, range(3) AS t(p) WHERE o_orderkey % 2 = 0 GROUP BY 1",
        "fan_out_fan_in": f"SELECT value * 2 AS value, seq FROM {_DEALT} UNION ALL SELECT value, seq FROM {_DEALT} WHERE value < 5000 UNION ALL SELECT value, seq FROM {_DEALT}",
        "parallel_edges_collapse": "SELECT o_orderkey AS value FROM orders",
        "result_order_page": f"SELECT value, CAST(part AS INTEGER) AS part, seq FROM {_DEALT} WHERE (part, seq) > (1, 500) ORDER BY part, seq LIMIT {most}",
        "seal_inventory": f"SELECT CAST(l_orderkey % {PARTS} AS INTEGER) AS part, count(*) AS records, count(*) * 186 AS bytes, {checksum(of('value', 'l_orderkey'))} FROM lineitem GROUP BY 1",
        "seal_inventory_words": f"{_DOCS} SELECT CAST(doc_id % {PARTS} AS INTEGER) AS part, count(*) AS records, CAST(sum(168 + 2 + 2 + 4 + 1 + 2 + strlen(word)) AS BIGINT) AS bytes, {checksum(of('word', 'word'))} FROM words GROUP BY 1",
        "sealed_manifest": f"SELECT CAST({shuffle} % {PARTS} AS INTEGER) AS part, count(*) AS records, count(*) * 186 AS bytes, {checksum('upper(path) || ' + of('value', 'value'))} FROM (SELECT *, {_source_path()} AS path FROM {_DEALT}) GROUP BY 1",
        "sealed_page": f"SELECT value, CAST(part AS INTEGER) AS part, seq FROM {_DEALT} ORDER BY part, seq LIMIT {most} OFFSET {most}",
        "sealed_stream": f"SELECT value * 3 AS value, CAST(part AS INTEGER) AS part, seq FROM {_DEALT} WHERE value * 3 % 2 = 0 AND value * 3 < 30000",
        "job_status": f"SELECT 'succeeded' AS state, {PARTS} AS source_task_count, {PARTS} AS completed_source_tasks, 2 AS result_partition_count, 2 AS manifest_count, false AS has_failure, count(*) AS records, CAST(sum(range * 3) AS BIGINT) AS total FROM range(-1000, 4000) WHERE range * 3 % 2 = 0",
        "watermark_prefix": f"SELECT CAST(part AS INTEGER) AS part, coalesce(min(CASE WHEN missing THEN seq END) - 1, max(seq)) AS completed, max(seq) AS eof, NOT bool_or(missing) AS final FROM (SELECT o_orderkey % {PARTS} AS part, o_orderkey // {PARTS} + 1 AS seq, o_custkey % 97 = 5 AS missing FROM orders) GROUP BY 1",
        "status_aggregates": f"SELECT CAST(part AS INTEGER) AS part, count(*) AS rows, max(seq) AS last_seq, count(*) = max(seq) AS contiguous FROM {_DEALT} GROUP BY 1",
    }


ORACLE_SQL = _oracles()
__all__ = ["ORACLE_SQL", "QUERIES", "graph", "spec"]
