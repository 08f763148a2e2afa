"""Sealed results: written whole, then named by a manifest; ordered scans, pages and counts read what is sealed.

A result set is a folder of Parquet files, by sink partition and in result order, and manifest.json, which is written
last. Nothing is visible before, and readers name the set by the manifest's digest. Order: source stage, source
partition, source sequence, path.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.errors import CorruptResult, LimitExceeded, ManifestMismatch, MissingField, PageTooSmall, ResultUnavailable
from millrace.limits import DEFAULT, Limits
from millrace.plans.planner import LINEAGE
from millrace.store import Store

ORDER = ("_src_stage", "_src_partition", "_src_seq", "_path")


def fields_of(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in LINEAGE]


def tuple_bytes(rows: DataFrame) -> Column:
    """Bytes of a row's canonical form: field count, then name, tag and value of each field that it has."""
    size = F.lit(2)
    for name, kind in rows.dtypes:
        if name not in LINEAGE:
            value = F.lit(8) if kind == "bigint" else 2 + F.octet_length(name)
            size = size + F.when(F.col(name).isNull(), 0).otherwise(2 + len(name.encode()) + 1 + value)
    return size.cast("long")


def record_bytes(rows: DataFrame, limits: Limits = DEFAULT) -> Column:
    return tuple_bytes(rows) + limits.record_overhead_bytes


def record_digest(rows: DataFrame) -> Column:
    """SHA-256 (hex) of a row's path, if it has one, and of name, length and value of each field that it has."""
    parts = [F.hex("_path")] if "_path" in rows.columns else []
    for name, kind in rows.dtypes:
        if name not in LINEAGE:
            value = F.hex(name) if kind == "binary" else F.col(name).cast("string")
            parts.append(F.coalesce(F.concat(F.lit(f"{name}:"), F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("")))
    return F.sha2(F.concat(*parts), 256)


def inventory(rows: DataFrame, by: str = "_part", limits: Limits = DEFAULT) -> DataFrame:
    """Of each partition: records, bytes, and a checksum: the records' SHA-256 digests, summed up as four numbers of 64
    bits. Sums do not depend on the order in which rows are met, and a row that is there twice counts twice."""
    own = rows.select(by, record_bytes(rows, limits).alias("bytes"), record_digest(rows).alias("digest"))
    sums = [F.sum(F.conv(F.substring("digest", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return own.groupBy(by).agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.concat_ws(".", *sums).alias("checksum"))


@dataclass(frozen=True)
class ResultSet:
    """A sealed set: its rows, and what its manifest says of each sink partition."""

    rows: DataFrame
    manifest: dict
    digest: str


def seal(rows: DataFrame, folder: str, partitions: int, *, limits: Limits = DEFAULT, collapse: bool = False) -> ResultSet:
    """Computes all rows, which is what decides whether the job succeeds, and makes them visible. collapse: equal records
    of one identity are one. What is left of one identity twice, in other fields or another partition, is an error."""
    spark = rows.sparkSession
    if collapse:
        rows = rows.distinct()
    if limits.data_limits:
        too_long = F.raise_error(F.lit(f"a row has more than {limits.tuple_bytes} bytes"))
        size = tuple_bytes(rows)
        rows = rows.withColumns({f: F.when(size > limits.tuple_bytes, too_long.cast(k)).otherwise(F.col(f)) for f, k in rows.dtypes if f in fields_of(rows)})
    data = f"data-{uuid.uuid4().hex}"
    order = ["_part", *ORDER]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).write.partitionBy("_part").parquet(f"{folder}/{data}")
    written = _read(spark, f"{folder}/{data}", rows)
    if not written.groupBy("_path").count().filter("count > 1").isEmpty():
        raise CorruptResult("one identity is there twice")
    parts = _counted(written, partitions, limits)
    if limits.data_limits and sum(p["bytes"] for p in parts) > limits.result_bytes_per_job:
        raise LimitExceeded(f"a job's results have at most {limits.result_bytes_per_job} bytes")
    manifest = {"data": data, "schema": rows.schema.json(), "partitions": parts}
    Store(spark, folder).write("manifest.json", json.dumps(manifest))
    return open_results(spark, folder)


def _counted(written: DataFrame, partitions: int, limits: Limits) -> list[dict]:
    found = {r["_part"]: r for r in inventory(written, limits=limits).collect()}  # one row for each sink partition
    empty = Row(records=0, bytes=0, checksum="0.0.0.0")
    own = [(p, found.get(p, empty)) for p in sorted({*range(partitions), *found})]
    return [{"partition": p, "records": r["records"], "bytes": r["bytes"], "checksum": r["checksum"]} for p, r in own]


def verify(results: ResultSet, limits: Limits = DEFAULT) -> ResultSet:
    """Counts and digests all rows again; an error unless they are what the manifest says."""
    stated = results.manifest["partitions"]
    if _counted(results.rows, len(stated), limits) != stated:
        raise CorruptResult("the rows are not those of the manifest")
    return results


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def open_results(spark: SparkSession, folder: str, digest: str | None = None) -> ResultSet:
    from pyspark.sql.types import StructType

    store = Store(spark, folder)
    if not store.exists("manifest.json"):
        raise ResultUnavailable("no manifest: the results are not complete")
    text = store.read("manifest.json")
    own = hashlib.sha256(text.encode()).hexdigest()
    if digest is not None and digest != own:
        raise ManifestMismatch("the results are not those of that digest")
    manifest = json.loads(text)
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    rows = spark.read.schema(schema).parquet(f"{folder}/{manifest['data']}").select(*schema.names)
    return ResultSet(rows, manifest, own)


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*ORDER)


@dataclass(frozen=True)
class Page:
    records: list[Row]
    cursor: tuple | None  # of the last record; the next page begins after it
    end: bool


def after(rows: DataFrame, cursor: tuple | None) -> DataFrame:
    """Rows that follow the cursor. The first comparison alone prunes Parquet row groups, which are in this order."""
    if cursor is None:
        return rows
    stage, part, seq, path = cursor
    at = F.struct(F.lit(stage).cast("int"), F.lit(part).cast("int"), F.lit(seq).cast("long"), F.unhex(F.lit(bytes(path).hex())))
    prunes = (F.col("_src_stage") > stage) | ((F.col("_src_stage") == stage) & (F.col("_src_partition") >= part))
    return rows.filter(prunes & (F.struct(*ORDER) > at))


def _budget(budget: int | None, limits: Limits) -> int:
    budget = limits.default_page_bytes if budget is None else budget
    if not 1 <= budget <= limits.page_bytes:
        raise LimitExceeded(f"a page has 1..{limits.page_bytes} bytes")
    return budget


def page(results: ResultSet, cursor: tuple | None = None, budget: int | None = None, limits: Limits = DEFAULT) -> Page:
    """The next records in order, whole, of at most budget bytes. What comes to the driver is bounded by the budget."""
    budget = _budget(budget, limits)
    rows = results.rows.withColumn("_bytes", record_bytes(results.rows, limits))
    least = limits.record_overhead_bytes + 2
    most = min(limits.page_records, budget // least + 1)
    found = after(rows, cursor).orderBy(*ORDER).limit(most + 1).collect()
    kept, used = [], 0
    for row in found[:most]:
        if used + row["_bytes"] > budget:
            break
        used += row["_bytes"]
        kept.append(row)
    if found and not kept:
        raise PageTooSmall(found[0]["_bytes"])
    last = tuple(kept[-1][c] for c in ORDER) if kept else cursor
    return Page(kept, last, len(kept) == len(found))


def pages(results: ResultSet, budget: int | None = None, limits: Limits = DEFAULT) -> Iterator[Row]:
    """What page after page gives, by one sorted pass: the driver holds a partition of it at a time."""
    budget = _budget(budget, limits)
    rows = ordered(results.rows.withColumn("_bytes", record_bytes(results.rows, limits)))
    for row in rows.toLocalIterator():
        if row["_bytes"] > budget:
            raise PageTooSmall(row["_bytes"])
        yield row


def rendered(row: Row, job_id: str, sink_stage: int) -> dict:
    fields = {k: v for k, v in row.asDict().items() if not k.startswith("_") and v is not None}
    fields = {k: base64.b64encode(v).decode() if isinstance(v, (bytes, bytearray)) else v for k, v in fields.items()}
    return {"job_id": job_id, "source_stage_id": row["_src_stage"], "source_partition": row["_src_partition"], "source_sequence": row["_src_seq"], "sink_stage_id": sink_stage, "sink_partition": row["_part"], "fields": fields}


def count_by(rows: DataFrame, field: str, top: int = 0) -> DataFrame:
    """field (as a string) and count, most frequent first, ties by the string. A record without the field is an error.
    Partial counts are summed before the shuffle; with top, only the first rows are kept while sorting."""
    if field not in rows.columns or field.startswith("_"):
        raise MissingField(f"the result records have no field {field!r}")
    kind = dict(rows.dtypes)[field]
    value = F.base64(F.col(field)) if kind == "binary" else F.col(field).cast("string")
    missing = F.raise_error(F.lit(f"a result record has no field {field!r}")).cast("string")
    counted = rows.groupBy(F.coalesce(value, missing).alias(field)).agg(F.count("*").alias("count"))
    counted = counted.orderBy(F.desc("count"), F.asc(field))
    return counted.limit(top) if top else counted


def totals(rows: DataFrame, field: str) -> tuple[int, int]:
    """Records and distinct values of the whole set."""
    row = count_by(rows, field).agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    return row[0], row[1]
