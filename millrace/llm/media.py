"""Media columns: content-addressed payloads in tar shards, with metadata from header-only range reads.

A payload is stored as a PNG image of 8-bit grey samples, WIDTH to a line, which keeps it without loss. Tasks append
images to tar shards in the shared folder; a member is named by the SHA-256 of its bytes, and a task stores each digest
once. Rows carry digest, shard, offset and length only, and the member of the smallest shard name and offset is the one
of its digest: all rows of equal payloads point to the same bytes, and payloads are never shuffled. A digest that several
tasks met is in several shards; what no row points to is what a rewrite of the shards would leave out.

Metadata columns are filled by reads of the 33 bytes that begin a PNG, payloads by reads of their own range.

Defined cases: null text counts as empty, which is padded to one line; rows are independent (ties, repeated ids and null
ids give rows of their own); an empty table gives no rows; other columns are ignored. Very long texts are one image each,
so a task holds one text and its image at a time.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

WIDTH = 192
SHARD_BYTES = 256 << 20
HEADER = 33  # signature and the IHDR chunk
# The signature of PNG files.
SIGNATURE = b"\x89PNG\r\n\x1a\n"

# --------------------------------------------------------------------------------------------------------------- images


def padded(data: bytes) -> bytes:
    """data, and spaces up to a positive multiple of WIDTH."""
    return data + b" " * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 3) -> bytes:
    lines = len(payload) // WIDTH
    rows = np.zeros((lines, WIDTH + 1), dtype=np.uint8)  # each line begins with its filter: none
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(lines, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, lines, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits of a sample and colour type, of the first HEADER bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR" or len(start) < HEADER:
        raise ValueError("not a PNG image")
    width, height, bits, colour = struct.unpack(">IIBB", start[16:26])
    return width, height, bits, colour


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png() has made."""
    width, height, bits, colour = png_header(data[:HEADER])
    at, packed = HEADER, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if (bits, colour) != (8, 0) or rows[:, 0].any():
        raise ValueError("only unfiltered 8-bit grey images are read")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and entropy of the samples, and a bit for each field of an 8 x 8 grid that is above their mean."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(samples, minlength=256).astype(np.float64)
    p = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    columns = np.add.reduceat(samples.reshape(-1, WIDTH), np.arange(0, WIDTH, WIDTH // 8), axis=1, dtype=np.int64)
    height = len(columns)
    edges = np.arange(9) * height // 8
    sums = np.concatenate([np.zeros((1, 8), dtype=np.int64), np.cumsum(columns, axis=0)])
    sizes = np.maximum(1, edges[1:] - edges[:-1])
    grid = (sums[edges[1:]] - sums[edges[:-1]]) / (sizes[:, None] * (WIDTH // 8))
    bits = int("".join("1" if x else "0" for x in (grid > mean).ravel()), 2)
    return f"mean={mean:.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f};grid={bits:016x}"


# --------------------------------------------------------------------------------------------------------------- shards


class ShardWriter:
    """Appends members to tar files in a folder; a digest once."""

    def __init__(self, folder: str):
        self.folder, self.sink, self.name, self.at = folder, None, "", 0
        self.stored: dict[bytes, tuple[str, int, int, str]] = {}

    def add(self, digest: bytes, data: bytes) -> tuple[str, int, int, str]:
        """shard, offset, length, SHA-256 of data; digest names what data was made of."""
        if self.sink is None or self.at > SHARD_BYTES:
            self.close()
            self.name, self.at = common.new_file(self.folder, ".tar"), 0
            files, path = common.opened(self.name)
            self.sink = files.open_output_stream(path)
        own = hashlib.sha256(data).hexdigest()
        info = tarfile.TarInfo(f"{own}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT if len(data) < 8 << 30 else tarfile.GNU_FORMAT)
        self.sink.write(head)
        self.sink.write(data)
        self.sink.write(b"\0" * (-len(data) % 512))
        self.stored[digest] = place = (self.name, self.at + len(head), len(data), own)
        self.at += len(head) + len(data) + -len(data) % 512
        return place

    def close(self) -> None:
        if self.sink is not None:
            self.sink.write(b"\0" * 1024)
            self.sink.close()
            self.sink = None


def store(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> DataFrame:
    """Stores the texts; a row for each of docs: id_col, n_bytes, digest (of the image, hex), shard, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ShardWriter(folder)
        for batch in common.rows_of(batches, 512):
            data = common.utf8(batch.column(1))
            places = []
            for text in data:
                name = hashlib.sha256(text).digest()
                places.append(out.stored.get(name) or out.add(name, to_png(padded(text), level)))
            shard, offset, length, digest = (list(x) for x in zip(*places, strict=True))
            columns = [batch.column(0), pa.array(map(len, data), pa.int64()), pa.array(digest), pa.array(shard), pa.array(offset, pa.int64()), pa.array(length, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "digest", "shard", "offset", "length"])
        out.close()

    rows = common.spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, digest string, shard string, offset long, length long"
    return common.stage(rows.mapInArrow(run, schema), f"{folder}/rows")


def contents(rows: DataFrame) -> DataFrame:
    """One row for each digest: where its bytes are."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _ranges(batch: pa.RecordBatch, most: int | None = None) -> Iterator[bytes]:
    """The bytes that the rows' shard, offset and length name, or the first most of them."""
    shard, source = None, None
    names = batch.schema.names
    columns = [batch.column(names.index(x)).to_pylist() for x in ("shard", "offset", "length")]
    try:
        for name, offset, length in zip(*columns, strict=True):
            if name != shard:
                if source is not None:
                    source.close()
                files, path = common.opened(name)
                shard, source = name, files.open_input_file(path)
            source.seek(offset)
            yield source.read(length if most is None else min(most, length))
    finally:
        if source is not None:
            source.close()


def with_headers(stored: DataFrame) -> DataFrame:
    """Adds width, height, bits and colour, by reads of HEADER bytes."""
    kinds = {"width": "int", "height": "int", "bits": "int", "colour": "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [png_header(start) for start in _ranges(batch, HEADER)]
            new = [pa.array([x[k] for x in found], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *kinds])

    return stored.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in stored.dtypes), *(f"{n} {t}" for n, t in kinds.items())]))


def with_payloads(stored: DataFrame) -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, by reads of the members."""
    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}

    def values(data: bytes) -> tuple:
        payload = from_png(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "string": pa.string()}
        for batch in batches:
            found = [values(data) for data in _ranges(batch)]
            new = [pa.array([x[k] for x in found], types[t]) for k, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *kinds])

    return stored.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in stored.dtypes), *(f"{n} {t}" for n, t in kinds.items())]))


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = store(docs, common.work_dir(spark, "media"))
    parts = common.shuffle_partitions(spark)
    stored = contents(rows).repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")
    found = with_payloads(with_headers(stored))
    whole = F.concat(F.lit("png:"), F.col("width"), F.lit("x"), F.col("height"), F.lit("x"), F.col("bits"), F.lit(";"), F.col("feature"))
    found = found.withColumn("feature", whole).drop("shard", "offset", "length", "width", "height", "bits", "colour")
    return rows.select("doc_id", "n_bytes", "digest").join(found, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
