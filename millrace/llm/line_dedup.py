"""Removes lines that many documents share, with two Bloom filters before the exact count.

1. Tasks hash the keys of their lines, each once a batch, and deal the hashes by ranges. A range's task puts its hashes
   into a filter of keys seen once, and those that were there already into a filter of keys seen twice; each hash that
   is new to the second filter is a suspect. The number of ranges follows the number of lines, so these filters have a
   bounded size and are never full.
2. The suspects make the twice-seen filter that is broadcast: BITS bits for each, up to MOST_BITS. (A fuller one lets
   more lines through to the exact count, with the same result.) Only (key digest, document) of lines whose key it holds
   are shuffled and counted exactly; keys of enough documents come back with the document that keeps them.
3. Up to TABLE of these keys are broadcast, with their keepers, and each document looks up its own lines: no text is
   shuffled. More keys stay a table; a filter of them is broadcast, documents that have none of them pass by, and only
   the others are joined with the numbers of the lines that they lose.

Key: the line without ASCII white space (tab to carriage return, space) at both ends, A-Z in lower case. Lines are what
stands between line feeds. Defined cases: null text counts as empty, which is one empty line; a key counts once for
each distinct id, all null ids count as one document, which is smaller than any other; rows with the same id keep or
lose a line together; an empty table gives no rows. The other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

#: Bits of a filter for each key; hash functions; lines of a range; most bits of a filter that is broadcast (64 MB), and
#: bits of a slice of it.
BITS, HASHES, RANGE, MOST_BITS, SLICE = 16, 4, 4_000_000, 1 << 29, 1 << 22
#: Shared keys that are broadcast with their keepers, 32 bytes each.
TABLE = 1 << 20
STRIP = b" \t\n\x0b\x0c\r"


def keys(text: bytes, least: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key has at least least code points."""
    out = []
    for k, line in enumerate(text.split(b"\n")):
        key = line.strip(STRIP)
        if len(key) >= least and (key.isascii() or len(key) >= 4 * least or len(key.decode()) >= least):
            out.append((k, key.lower()))
    return out


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(n, HASHES) bit numbers; bits is a power of two."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64)
    mixed = (low[:, None] + steps * high[:, None]) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def holds(bits: np.ndarray, hashes: np.ndarray, n_bits: int) -> np.ndarray:
    at = positions(hashes, n_bits)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)


def put(bits: np.ndarray, hashes: np.ndarray, n_bits: int) -> None:
    at = positions(hashes, n_bits).ravel()
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def power_of_two(n: int) -> int:
    return 1 << max(6, (n - 1).bit_length())


def key_of(line: bytes) -> bytes:
    """What names a key: the 64 bits that the filters hold, and 128 bits of a digest."""
    return xxhash.xxh3_64_digest(line) + hashlib.blake2b(line, digest_size=16).digest()


def _found(texts: list[bytes], least: int) -> tuple[list[int], list[tuple[int, bytes]], np.ndarray]:
    """Of the lines with a key: the texts' numbers, (line number, key), and the keys' hashes."""
    at, lines = [], []
    for k, text in enumerate(texts):
        own = keys(text, least)
        at += [k] * len(own)
        lines += own
    return at, lines, np.array([xxhash.xxh3_64_intdigest(key) for _, key in lines], dtype=np.uint64)


def suspects(texts: DataFrame, least: int) -> DataFrame:
    """hash: of every key that two lines of the column text have, and of few others."""
    spark = texts.sparkSession
    lines = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 1
    ranges = max(common.shuffle_partitions(spark), -(-lines // RANGE))
    n_bits = power_of_two(BITS * 2 * -(-lines // ranges))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches):
            new, counts = np.unique(_found(common.utf8(batch.column(0)), least)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(counts > 1)], names=["hash", "again"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = None, None
        for batch in batches:
            if once is None:
                once, twice = np.zeros(n_bits // 8, dtype=np.uint8), np.zeros(n_bits // 8, dtype=np.uint8)
            given, again = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            new, first, counts = np.unique(given, return_index=True, return_counts=True)
            flagged = np.zeros(len(new), dtype=bool)
            np.logical_or.at(flagged, np.searchsorted(new, given), again)
            again = (counts > 1) | flagged | holds(once, new, n_bits)
            put(once, new, n_bits)
            new = new[again]
            new = new[~holds(twice, new, n_bits)]
            put(twice, new, n_bits)
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64))], names=["hash"])

    return texts.mapInArrow(hashed, "hash long, again boolean").repartition(ranges, "hash").mapInArrow(seen, "hash long")


def filter_of(hashes: DataFrame, n_bits: int) -> bytes:
    """A filter of the column hash, made in slices by tasks."""
    size = min(n_bits, SLICE)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            at = positions(batch.column(0).to_numpy().view(np.uint64), n_bits).ravel()
            for k in np.unique(at // size).tolist():
                inside = at[at // size == k] % size
                np.bitwise_or.at(own.setdefault(k, np.zeros(size // 8, dtype=np.uint8)), inside >> 3, np.left_shift(1, inside & 7).astype(np.uint8))
        for k, bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()])], names=["slice", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own[k] = own[k] | np.frombuffer(bits, dtype=np.uint8) if k in own else np.frombuffer(bits, dtype=np.uint8)
        for k, bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()])], names=["slice", "bits"])

    tasks = min(64, -(-n_bits // size), common.shuffle_partitions(hashes.sparkSession))
    parts = hashes.coalesce(64).mapInArrow(build, "slice int, bits binary").repartition(tasks, "slice")
    bits = bytearray(n_bits // 8)
    for row in parts.mapInArrow(merge, "slice int, bits binary").collect():  # MOST_BITS / 8 bytes at most
        bits[row.slice * size // 8 : (row.slice + 1) * size // 8] = row.bits
    return bytes(bits)


def shared_keys(rows: DataFrame, folder: str, least: int, documents: int) -> DataFrame:
    """(key, keeper) of the keys that at least documents documents of (id, text) hold."""
    spark = rows.sparkSession
    suspected = common.stage(suspects(rows.select("text"), least), f"{folder}/suspects")
    n_bits = min(MOST_BITS, power_of_two(BITS * suspected.count()))
    bits = spark.sparkContext.broadcast(filter_of(suspected, n_bits))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in common.rows_of(batches):
            ids = batch.column(0).to_pylist()
            at, lines, hashes = _found(common.utf8(batch.column(1)), least)
            own = {(ids[at[k]], lines[k][1]) for k in np.flatnonzero(holds(second, hashes, n_bits)).tolist()}
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([key_of(key) for _, key in own], pa.binary())], names=["id", "key"])

    found = rows.mapInArrow(repeated, "id long, key binary")
    # one row for each key and document, then sums with map-side parts: a key in every document is spread by document
    counted = found.distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
    return common.stage(counted.filter(F.col("n") >= documents).select("key", "keeper"), f"{folder}/shared")


class Shared:
    """Shared keys and their keepers, by the order of the keys' hashes."""

    def __init__(self, names: list[bytes], keepers: list[int]):
        order = sorted(range(len(names)), key=names.__getitem__)
        self.names, self.keepers = b"".join([names[k] for k in order]), np.array([keepers[k] for k in order], dtype=np.int64)
        self.hashes = np.array([int.from_bytes(names[k][:8], "big") for k in order], dtype=np.uint64)

    def drops(self, ids: list[int | None], texts: list[bytes], least: int) -> list[list[int] | None]:
        """Of each text, the numbers of the lines that it loses, or None."""
        out: list[list[int] | None] = [None] * len(texts)
        at, lines, hashes = _found(texts, least)
        first = np.searchsorted(self.hashes, hashes)
        hit = np.flatnonzero(self.hashes[np.minimum(first, len(self.hashes) - 1)] == hashes) if len(self.hashes) else []
        for k in map(int, hit):
            name, place = key_of(lines[k][1]), int(first[k])
            while place < len(self.hashes) and self.hashes[place] == hashes[k]:
                if self.names[24 * place : 24 * place + 24] == name:
                    if ids[at[k]] != self.keepers[place]:
                        out[at[k]] = [*(out[at[k]] or ()), lines[k][0]]
                    break
                place += 1
        return out


def _without(text: Column, drop: Column) -> Column:
    """text without the lines of the numbers in drop; the lines are bound once, as the one element of an array."""
    stay = F.array_except(F.sequence(F.lit(0), F.length(text) - F.length(F.replace(text, F.lit("\n")))), drop)
    return F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n"))[0]


def _looked_up(rows: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """rows with drop, by the broadcast keys."""
    found = shared.toArrow()
    table = rows.sparkSession.sparkContext.broadcast(Shared(found.column("key").to_pylist(), found.column("keeper").to_pylist()))

    @F.arrow_udf("array<int>")
    def drops(id_: pa.Array, text: pa.Array) -> pa.Array:
        return pa.array(table.value.drops(id_.to_pylist(), common.utf8(text), least), pa.list_(pa.int32()))

    return rows.withColumn("drop", drops("id", "text"))


def _joined(rows: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """The same by joins: of the keys and lines, then of the lost lines and the documents that may lose some."""
    spark = rows.sparkSession
    n_bits = min(MOST_BITS, power_of_two(BITS * shared.count()))
    hashes = shared.select(F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long").alias("hash"))
    bits = spark.sparkContext.broadcast(filter_of(hashes, n_bits))

    @F.arrow_udf("boolean")
    def may_lose(text: pa.Array) -> pa.Array:
        at, _, found = _found(common.utf8(text), least)
        out = np.zeros(len(text), dtype=bool)
        out[np.array(at, dtype=np.int64)[holds(np.frombuffer(bits.value, dtype=np.uint8), found, n_bits)]] = True
        return pa.array(out)

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches):
            ids, texts = batch.column(0).to_pylist(), common.utf8(batch.column(1))
            at, lines, found = _found(texts, least)
            own = np.flatnonzero(holds(np.frombuffer(bits.value, dtype=np.uint8), found, n_bits)).tolist()
            columns = [[ids[at[k]] for k in own], [hashlib.md5(texts[at[k]]).digest() for k in own], [lines[k][0] for k in own], [key_of(lines[k][1]) for k in own]]
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "digest", "line", "key"])

    lines = rows.select("id", "text").mapInArrow(lines_of, "id long, digest binary, line int, key binary")
    lost = lines.join(shared, "key").filter(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "digest", "line").distinct()
    lost = lost.groupBy("id", "digest").agg(F.collect_list("line").alias("drop")).toDF("_id", "_digest", "drop")  # lines of one text
    flagged = rows.withColumn("may", may_lose("text"))
    of_text = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    some = flagged.filter("may").withColumn("digest", of_text)
    some = some.join(lost, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    rest = flagged.filter("NOT may").withColumn("drop", F.lit(None).cast("array<int>"))
    return some.select(*rows.columns, "drop").unionByName(rest.select(*rows.columns, "drop"))


def drop_shared_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 40, documents: int = 5) -> DataFrame:
    """docs with text_col without the lines that it loses, and n_lines (before) and n_dropped. A key of at least least code
    points in at least documents documents stays in the one with the largest id only. A null text is null still. Columns of
    docs named n_lines or n_dropped are replaced."""
    folder = common.work_dir(docs.sparkSession, "lines")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own, text = F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    shared = shared_keys(common.spread(docs.select(own, text)), folder, least, documents)
    n_shared = shared.count()
    others = [c for c in names if c != text_col]
    rows = common.spread(docs.select(F.struct(*others).alias("row") if others else F.lit(0).alias("row"), own, text, F.col(text_col).alias("given")))
    if not n_shared:
        rows = rows.withColumn("drop", F.lit(None).cast("array<int>"))
    else:
        rows = (_looked_up if n_shared <= TABLE else _joined)(rows, shared, least)
    whole, none = F.coalesce("text", F.lit("")), F.col("drop").isNull()
    kept = F.when(none, F.col("given")).otherwise(_without(whole, F.col("drop")))
    count = (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("long")
    new = [kept.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names]
    return rows.select(*new, count.alias("n_lines"), F.when(none, 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = drop_shared_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, k, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS place
  FROM (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, shared.key IS NOT NULL AND keyed.doc_id <> shared.keeper AS lost
  FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY k, doc_id
"""
