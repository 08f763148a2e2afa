"""Deterministic identities of jobs and rows, and the routes that follow from them.

A row is named by its job, its source task (stage, partition), its sequence there, and a path: the SHA-256 of its source
identity, or of its parent's identity, the task that made it, the edge and its place among its siblings. Each name has a
Python form (for the driver and as a check) and a column form.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the digests begin with; a parameter, so that others' digests can be matched.
DOMAINS = {"job": b"millrace/job/v1\0", "source": b"millrace/source-tuple/v1\0", "child": b"millrace/derived-tuple/v1\0", "route": b"millrace/route/v1\0"}


def job_id(client: bytes, sequence: int, topology_digest: bytes, domains: dict = DOMAINS) -> bytes:
    return hashlib.sha256(domains["job"] + client + struct.pack(">Q", sequence) + topology_digest).digest()[:16]


def task_bytes(job: bytes, stage: int, partition: int) -> bytes:
    return job + struct.pack(">HH", stage, partition)


def source_path(job: bytes, stage: int, partition: int, sequence: int, domains: dict = DOMAINS) -> bytes:
    return hashlib.sha256(domains["source"] + job + task_bytes(job, stage, partition) + struct.pack(">Q", sequence)).digest()


def tuple_bytes(job: bytes, stage: int, partition: int, sequence: int, path: bytes) -> bytes:
    return job + task_bytes(job, stage, partition) + struct.pack(">Q", sequence) + path


def child_path(parent: bytes, producer: bytes, edge: int, ordinal: int, domains: dict = DOMAINS) -> bytes:
    return hashlib.sha256(domains["child"] + parent + producer + struct.pack(">HH", edge, ordinal)).digest()


def shuffle_route(job: bytes, edge: int, tuple_id: bytes, partitions: int, domains: dict = DOMAINS) -> int:
    digest = hashlib.sha256(domains["route"] + job + struct.pack(">H", edge) + tuple_id).digest()
    return struct.unpack(">Q", digest[:8])[0] % partitions


def value_route(value: int, partitions: int) -> int:
    """field_hash on the field value: the hash of the tuple of that field alone."""
    encoded = struct.pack(">H", 5) + b"value" + b"\1" + struct.pack(">Q", value & (1 << 64) - 1)
    return struct.unpack(">Q", hashlib.sha256(encoded).digest()[:8])[0] % partitions


# ------------------------------------------------------------------------------------------------------- column forms


def raw(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def big_endian(number: Column, size: int) -> Column:
    """The last size bytes of a number in two's complement."""
    return F.unhex(F.substring(F.lpad(F.hex(number.cast("long")), 16, "0"), 17 - 2 * size, 2 * size))


def sha256(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def remainder(digest: Column, partitions: int) -> Column:
    """The first 8 bytes, unsigned, by partitions. Both halves stay within a long."""
    high, low = (F.conv(F.substring(F.hex(digest), at, 8), 16, 10).cast("long") for at in (1, 9))
    return ((high % partitions * ((1 << 32) % partitions) + low) % partitions).cast("int")


def task_column(job: bytes, stage: Column | int, partition: Column) -> Column:
    return F.concat(raw(job), big_endian(F.lit(stage) if isinstance(stage, int) else stage, 2), big_endian(partition, 2))


def source_path_column(job: bytes, stage: int, partition: Column, sequence: Column, domains: dict = DOMAINS) -> Column:
    return sha256(raw(domains["source"] + job), task_column(job, stage, partition), big_endian(sequence, 8))


def tuple_column(job: bytes, stage: Column, partition: Column, sequence: Column, path: Column) -> Column:
    return F.concat(raw(job), task_column(job, stage, partition), big_endian(sequence, 8), path)


def child_path_column(parent: Column, producer: Column, edge: int, ordinal: Column, domains: dict = DOMAINS) -> Column:
    return sha256(raw(domains["child"]), parent, producer, big_endian(F.lit(edge), 2), big_endian(ordinal, 2))


def shuffle_route_column(job: bytes, edge: int, tuple_id: Column, partitions: int, domains: dict = DOMAINS) -> Column:
    return remainder(sha256(raw(domains["route"] + job + struct.pack(">H", edge)), tuple_id), partitions)


def value_route_column(value: Column, partitions: int) -> Column:
    return remainder(sha256(raw(struct.pack(">H", 5) + b"value" + b"\1"), big_endian(value, 8)), partitions)
