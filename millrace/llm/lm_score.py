"""Scores texts with a word bigram model whose counts are in a log-frequency Bloom filter.

Tokens are the words between ASCII white space, A-Z in lower case, then one end token. Each token's base probability
is (c + 1) / (N + V + 1), from exact counts over the training rows. A pair (history, word) that training rows hold c
times is in the filter once for each level 1..floor(log2 c) + 1: the levels that answer, probed from 1 until one does
not, give c to a power of two from below. Then

    P(word | history) = b * 2^(level - 1) / c(history) + (1 - b) * base(word),   b = c(history) / (c(history) + BACKOFF)

With singles=False, pairs that are held once are left out: the levels are 1..floor(log2 c), for 2^level.

1. Tasks turn texts into chunk files in the shared folder: the hashes of the chunk's words, sorted, and the texts as
   numbers of those words. Chunks are bounded. What is shuffled are packed arrays, one for each chunk and slice of the
   hashes: words and pairs with their training counts. The number of slices follows the bytes of text, so a slice's
   size does not grow with the table. (There are chunks x slices such rows; with more memory for a task, larger chunks
   and slices make them fewer.)
2. A slice's task sums them up, answers every chunk with the total counts of just its words, and makes the slice's
   part of the filter. So exact counts reach the texts without a table of all words in one place.
3. Each chunk is scored from its file, the answers, and the filter. How large the filter can get is known before it is made,
   from the pieces' counts: a filter of at most BROADCAST bytes is broadcast, once for each worker. A larger one stays in
   its slices: the slice's task probes it for the pairs that each chunk has sent, and answers with their levels.

Words and pairs are named by 64-bit hashes (48 bits in the filter's input): two words of a corpus of a billion distinct
ones meet with a probability of about 3 %, of the millions of a large crawl's language under one in a million.

Defined cases: null text counts as empty (just the end token); rows with the same id are rows of their own; a null id is
held out where the caller's expression says so (the query: never); with no training row, N and V are 0 and every base
probability is 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

#: A chunk has about this many tokens, or distinct words, at most (and one text at least).
CHUNK_TOKENS, CHUNK_WORDS = 2_000_000, 250_000
#: Bytes of text for each slice of the hashes; bytes of a filter that is broadcast, at most.
SLICE_TEXT, BROADCAST = 16 << 20, 32 << 20
BITS_PER_ENTRY, HASHES, BACKOFF = 12, 4, 4.0
BEGIN, END = (xxhash.xxh3_64_intdigest(x) for x in (b"\nbegin", b"\nend"))  # no word holds a line feed

# ------------------------------------------------------------------------------------------------------------- packing


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers as byte planes, compressed."""
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(head)) + head + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (size,) = struct.unpack_from("<I", raw)
    at, out = 4 + size, []
    for kind, n in json.loads(raw[4:at]):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def pair_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """48 bits."""
    return mixed(history * np.uint64(0xC2B2AE3D27D4EB4F) + word) >> np.uint64(16)


def slice_of(top32: np.ndarray, slices: int) -> np.ndarray:
    return (top32 * np.uint64(slices)) >> np.uint64(32)


def cuts(values: np.ndarray, shift: int, slices: int) -> np.ndarray:
    """Stops of the slices in sorted values."""
    return np.searchsorted(slice_of(values >> np.uint64(shift), slices), np.arange(slices + 1, dtype=np.uint64))


# ---------------------------------------------------------------------------------------------------------- the filter


def filter_bits(entries: int, bits_per_entry: int) -> int:
    return max(64, (entries * bits_per_entry + 63) // 64 * 64)


def _places(keys: np.ndarray, level: int, k: int, bits: np.ndarray | int) -> np.ndarray:
    return mixed(keys + np.uint64((level * HASHES + k + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)) % np.asarray(bits, dtype=np.uint64)


def build_filter(keys: np.ndarray, counts: np.ndarray, bits_per_entry: int, singles: bool = False) -> np.ndarray:
    """Bytes of the filter of one slice."""
    levels = levels_of(counts, singles)
    n_bits = filter_bits(int(levels.sum()), bits_per_entry)
    bits = np.zeros(n_bits // 8, dtype=np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= level]
        for k in range(HASHES):
            at = _places(own, level, k, n_bits).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return bits


class Filters:
    """Some slices' filters, one after another."""

    def __init__(self, parts: dict[int, bytes], slices: int):
        self.slices = slices
        self.sizes = np.zeros(slices, dtype=np.uint64)
        self.starts = np.zeros(slices, dtype=np.int64)
        at = 0
        for k in sorted(parts):
            self.sizes[k], self.starts[k] = 8 * len(parts[k]), 8 * at
            at += len(parts[k])
        self.bits = np.frombuffer(b"".join(parts[k] for k in sorted(parts)), dtype=np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key; 0 where its slice is not here."""
        out = np.zeros(len(keys), dtype=np.int8)
        own = slice_of(keys >> np.uint64(16), self.slices).astype(np.int64)
        sizes, starts = self.sizes[own], self.starts[own]
        at, level = np.flatnonzero(sizes > 0), 1
        while len(at):
            for k in range(HASHES):
                place = starts[at] + _places(keys[at], level, k, sizes[at]).astype(np.int64)
                at = at[(self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
            out[at] = level
            level += 1
        return out


# --------------------------------------------------------------------------------------------------------------- steps

PARTS = "slice int, pairs boolean, chunk string, data binary, entries long"
SUMS = "kind string, slice int, chunk string, data binary, n long, v long"


def levels_of(counts: np.ndarray, singles: bool) -> np.ndarray:
    """How many levels pairs of these counts have; those of a sum are at most as many as its parts' together."""
    return np.maximum(np.frexp(counts.astype(np.float64))[1] - (0 if singles else 1), 0)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


class _Chunk:
    """Texts as word numbers: begin, words, end of each."""

    def __init__(self) -> None:
        self.numbers = defaultdict(count().__next__)
        self.begin, self.end = self.numbers[b"\nbegin"], self.numbers[b"\nend"]
        self.tokens, self.sizes, self.ids, self.train = [], [], [], []
        self.total = 0

    def add(self, doc_id: int | None, text: bytes, train: bool) -> None:
        own = [self.begin, *map(self.numbers.__getitem__, text.lower().split()), self.end]
        self.tokens.append(np.array(own, dtype=np.uint32))
        self.sizes.append(len(own))
        self.ids.append(doc_id)
        self.train.append(train)
        self.total += len(own)

    def close(self, folder: str, slices: int, singles: bool) -> list[tuple]:
        """Writes the file; the packed counts."""
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), dtype=np.uint64, count=len(self.numbers))
        order = np.argsort(words)
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words, tokens = words[order], rank[np.concatenate(self.tokens)]
        sizes, train = np.array(self.sizes, dtype=np.uint32), np.array(self.train, dtype=np.uint8)
        name = common.new_file(folder, ".chunk")
        ids = np.array([0 if x is None else x for x in self.ids], dtype=np.int64)
        null = np.array([x is None for x in self.ids], dtype=np.uint8)
        files, path = common.opened(name)
        with files.open_output_stream(path) as out:
            out.write(pack([words, tokens, sizes, train, ids, null]))
        learned = np.repeat(train.astype(bool), sizes)
        counts = np.bincount(tokens[learned], minlength=len(words)).astype(np.uint32)
        rows, stops = [], cuts(words, 32, slices)
        for k in range(slices):
            if stops[k] < stops[k + 1]:
                own = slice(stops[k], stops[k + 1])
                rows.append((k, False, name, pack([words[own], counts[own]]), 0))
        second = np.ones(len(tokens), dtype=bool)
        second[np.cumsum(sizes, dtype=np.int64) - sizes] = False  # all but the begin marks
        at, hashed = np.flatnonzero(second), words[tokens]
        keys, pair = np.unique(pair_keys(hashed[at - 1], hashed[at]), return_inverse=True)
        counts = np.bincount(pair[learned[at]], minlength=len(keys)).astype(np.uint32)
        stops = cuts(keys, 16, slices)
        for k in range(slices):
            if stops[k] < stops[k + 1]:
                own, n = keys[stops[k] : stops[k + 1]], counts[stops[k] : stops[k + 1]]
                rows.append((k, True, name, pack([np.diff(own, prepend=np.uint64(0)), n]), int(levels_of(n, singles).sum())))
        return rows


def _tokenize(folder: str, slices: int, singles: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in common.rows_of(batches, 512):
            for doc_id, text, held in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                chunk.add(doc_id, text, not held)
                if chunk.total >= CHUNK_TOKENS or len(chunk.numbers) >= CHUNK_WORDS:
                    yield _batch(PARTS, chunk.close(folder, slices, singles))
                    chunk = _Chunk()
        if chunk.sizes:
            yield _batch(PARTS, chunk.close(folder, slices, singles))

    return run


def _sum_up(bits_per_entry: int, singles: bool, slices: int, reply: bool):
    """Of each slice, sorted by (slice, pairs): replies to the chunks and totals, or its filter or, with reply, the levels that
    it gives the chunks' pairs."""
    begin = np.uint64(BEGIN)

    def words(k: int, rows: list[tuple[str, bytes]]) -> Iterator[tuple]:
        parts = [(chunk, *unpack(data)) for chunk, data in rows]
        keys, at = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        totals = np.zeros(len(keys), dtype=np.uint64)
        np.add.at(totals, at, np.concatenate([p[2] for p in parts]).astype(np.uint64))
        token = totals[keys != begin]  # the begin mark is a history, not a token
        yield ("totals", k, None, None, int(token.sum()), int((token > 0).sum()))
        stop = 0
        for chunk, own, _ in parts:
            yield ("reply", k, chunk, pack([totals[at[stop : stop + len(own)]]]), None, None)
            stop += len(own)

    def pairs(k: int, rows: list[tuple[str, bytes]]) -> Iterator[tuple]:
        parts = [(chunk, *unpack(data)) for chunk, data in rows]
        sent = [np.cumsum(p[1], dtype=np.uint64) for p in parts]
        keys = np.concatenate(sent)
        order = np.argsort(keys)
        keys, counts = keys[order], np.concatenate([p[2] for p in parts])[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts.astype(np.uint64), first)
        bits = build_filter(keys[counts > 0], counts[counts > 0], bits_per_entry, singles)
        if not reply:
            yield ("filter", k, None, bits.tobytes(), len(bits), None)
            return
        levels = Filters({k: bits.tobytes()}, slices).levels(keys)
        for (chunk, *_), own in zip(parts, sent, strict=True):
            yield ("levels", k, chunk, pack([levels[np.searchsorted(keys, own)]]), None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                for row in (pairs if at[1] else words)(at[0], held):
                    yield _batch(SUMS, [row])

        for batch in batches:
            for k, pair, chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, pair) != at:
                    yield from done()
                    at, held = (k, pair), []
                held.append((chunk, data))
        yield from done()

    return run


def _score(n: int, v: int, one, id_col: str, singles: bool):
    def scored(chunk: str, replies: list[tuple[str, bytes]]) -> pa.RecordBatch:
        files, path = common.opened(chunk)
        with files.open_input_stream(path) as source:
            words, tokens, sizes, train, ids, null = unpack(source.read())
        totals = np.concatenate([unpack(x)[0] for kind, x in replies if kind == "reply"]).astype(np.float64)
        stops = np.cumsum(sizes, dtype=np.int64)
        is_token = np.ones(len(tokens), dtype=bool)
        is_token[stops - sizes] = False
        base = (totals + 1) / (n + v + 1)
        c = totals[tokens]
        at = np.flatnonzero(is_token)
        hashed = words[tokens]
        keys = pair_keys(hashed[at - 1], hashed[at])
        if one is not None:
            levels = one.value.levels(keys)
        else:
            levels = np.concatenate([unpack(x)[0] for kind, x in replies if kind == "levels"])[np.unique(keys, return_inverse=True)[1]]
        before, own = c[at - 1], base[tokens[at]]
        weight = before / (before + BACKOFF)
        seen = np.where(levels > 0, np.minimum(np.ldexp(1.0, levels.astype(np.int32) - (1 if singles else 0)), before), 0.0)
        p = (1 - weight) * own + weight * np.divide(seen, before, out=np.zeros(len(at)), where=before > 0)
        starts = stops - sizes - np.arange(len(sizes))  # in the tokens without begin marks
        total = lambda x: np.add.reduceat(x, starts)
        columns = [
            pa.array(ids, mask=null.astype(bool)),
            pa.array(train == 0),
            pa.array(sizes.astype(np.int64) - 1),
            pa.array(total((c[at] > 0).astype(np.int64))),
            pa.array(np.full(len(ids), n, dtype=np.int64)),
            pa.array(total(np.log10(own))),
            pa.array(total(np.log10(p))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for chunk, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != at:
                    if held:
                        yield scored(at, held)
                    at, held = chunk, []
                held.append((kind, data))
        if held:
            yield scored(at, held)

    return run


def score(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", bits_per_entry: int = BITS_PER_ENTRY, singles: bool = False, slice_text: int | None = None) -> DataFrame:
    """Every row's scores by a model of the rows where held_out is not true: id_col, held_out, n_tokens, n_known,
    train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    folder, tasks = common.work_dir(spark, "lm"), common.shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(16, tasks, -(-size // (slice_text or SLICE_TEXT)))
    # written before it is shuffled: a task that is run again makes chunks of other names, which must not mix with these
    parts = common.stage(common.spread(rows).mapInArrow(_tokenize(folder, slices, singles), PARTS), f"{folder}/parts")
    entries, chunks = parts.agg(F.sum("entries"), F.count_distinct("chunk")).first()
    reply = (entries or 0) * bits_per_entry // 8 + 8 * slices > BROADCAST
    parts = parts.select("slice", "pairs", "chunk", "data").repartition(slices, "slice", "pairs").sortWithinPartitions("slice", "pairs")
    sums = common.stage(parts.mapInArrow(_sum_up(bits_per_entry, singles, slices, reply), SUMS), f"{folder}/sums")
    totals, one = sums.filter("kind = 'totals'").agg(F.sum("n"), F.sum("v")).first(), None
    if not reply:  # BROADCAST bytes at most
        found = sums.filter("kind = 'filter'").select("slice", "data").collect()
        one = spark.sparkContext.broadcast(Filters({r.slice: bytes(r.data) for r in found}, slices))
    replies = sums.filter("kind IN ('reply', 'levels')").select("chunk", "kind", "slice", "data")
    replies = replies.repartition(max(tasks, chunks), "chunk").sortWithinPartitions("chunk", "kind", "slice").select("chunk", "kind", "data")
    out = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return replies.mapInArrow(_score(totals[0] or 0, totals[1] or 0, one, id_col, singles), out)


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, singles=True)
