"""Token-id files with shuffled planes, and their reader.

A file holds the ids of many documents, one after another. Blocks of a fixed number of ids are transposed into byte
planes (the first bytes of all ids of the block, then the second ones, ...) or bit planes, and every plane is
compressed with zstandard by itself: the high planes of small ids are runs of zeros, the low ones hold the entropy.

    magic | plane ... plane (block 0) | plane ... (block 1) | ... | footer (JSON, zstandard) | u64 footer length | magic

The footer is the chunk index: plane kind, ids per block and, for every block, its first id, number of ids, offset and
the length of each plane; after it come the documents (id, number of ids). So any range of ids is read with one read
of the footer and one for its blocks.

Defined cases: null text counts as empty (only the end id is written); a null document id sorts first; repeated ids
are all kept, ordered by the hash of their text; an empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

MAGIC = b"MRPLANE1"
ID_BYTES = 4

SHARDS = "shard string, first_id long, has_null boolean, order_key long, row_key long, n_docs long, n_ids long"


# ------------------------------------------------------------------------------------------------------- file format


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, least significant first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, ID_BYTES)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(ID_BYTES)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * ID_BYTES)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    raw = np.empty((n, ID_BYTES), dtype=np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, dtype=np.uint8)
    else:
        bits = np.empty((n, 8 * ID_BYTES), dtype=np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little")
        raw[:] = np.packbits(bits, axis=1, bitorder="little")
    return raw.view("<u4").ravel()


class PlaneWriter:
    """Writes one file; holds one block of ids at most."""

    def __init__(self, sink, kind: str = "byte", block_ids: int = 1 << 16, level: int = 3):
        if kind not in ("byte", "bit"):
            raise ValueError(f"unknown plane kind {kind!r}")
        self.sink, self.kind, self.block_ids = sink, kind, block_ids
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.waiting, self.held, self.n_ids, self.at = [], 0, 0, len(MAGIC)
        self.blocks: list[list] = []
        self.docs: list[tuple[int | None, int]] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self.docs.append((doc_id, len(ids) // ID_BYTES))
        self.waiting.append(ids)
        self.held += len(ids) // ID_BYTES
        if self.held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4")
        stop = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for start in range(0, stop, self.block_ids):
            block = ids[start : min(start + self.block_ids, stop)]
            planes = [self.compress(plane) for plane in to_planes(block, self.kind)]
            self.blocks.append([self.n_ids, len(block), self.at, [len(plane) for plane in planes]])
            self.sink.write(b"".join(planes))
            self.at += sum(map(len, planes))
            self.n_ids += len(block)
        self.waiting, self.held = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        footer = {"kind": self.kind, "block_ids": self.block_ids, "blocks": self.blocks, "docs": self.docs}
        packed = self.compress(json.dumps(footer).encode())
        self.sink.write(packed + struct.pack("<Q", len(packed)) + MAGIC)


class PlaneReader:
    """Reads any range of ids of one file; holds the blocks of that range only."""

    def __init__(self, source, size: int):
        self.source = source
        tail = len(MAGIC) + 8
        source.seek(size - tail)
        end = source.read(tail)
        if end[8:] != MAGIC:
            raise ValueError("not a plane file, or one that was cut short")
        length = struct.unpack("<Q", end[:8])[0]
        source.seek(size - tail - length)
        footer = json.loads(zstandard.ZstdDecompressor().decompress(source.read(length)))
        self.kind, self.block_ids = footer["kind"], footer["block_ids"]
        self.blocks, self.docs = footer["blocks"], footer["docs"]
        self.kept: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def block(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            _, n, at, lengths = self.blocks[k]
            self.source.seek(at)
            raw, planes, stop = self.source.read(sum(lengths)), [], 0
            for length in lengths:
                planes.append(zstandard.ZstdDecompressor().decompress(raw[stop : stop + length]))
                stop += length
            self.kept = (k, from_planes(planes, n, self.kind))
        return self.kept[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, "<u4")
        parts = []
        for k in range(start // self.block_ids, (stop - 1) // self.block_ids + 1):
            first = self.blocks[k][0]
            parts.append(self.block(k)[max(0, start - first) : stop - first])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document id, ids before it in this file, its ids."""
        start = 0
        for doc_id, n in self.docs:
            yield doc_id, start, self.ids(start, start + n)
            start += n


# ---------------------------------------------------------------------------------------------------------- encoding

_ENCODERS: dict[bytes, WordCacheEncoder] = {}
#: Words of up to this many bytes are compared as they are; longer ones by a 128-bit hash.
SHORT = 24
_WHITE = np.zeros(256, dtype=bool)
_WHITE[list(b" \t\n\x0b\x0c\r")] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class _Words:
    """The words of a buffer that ends in white space: places, content keys and hashes of those."""

    def __init__(self, buffer: bytes):
        self.buffer = buffer + b"\n" * (SHORT + 8)
        white = _WHITE[np.frombuffer(self.buffer, dtype=np.uint8)]
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.stops = edges[::2], edges[1::2]
        size = self.stops - self.starts
        at_any = np.ndarray(len(self.buffer) - 7, dtype="<u8", buffer=self.buffer, strides=(1,))  # 8 bytes from any place
        keys = [at_any[self.starts + 8 * k] & _MASKS[np.clip(size - 8 * k, 0, 8)] for k in range(3)]
        for k in np.flatnonzero(size > SHORT).tolist():
            digest = xxhash.xxh3_128_intdigest(self.word(k))
            keys[0][k], keys[1][k], keys[2][k] = digest & (1 << 64) - 1, digest >> 64, (1 << 64) - 1
        self.keys = np.stack([*keys, size.astype(np.uint64)], axis=1)
        x = np.zeros(len(size), dtype=np.uint64)
        for own in self.keys.T:
            x = (x + own) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        self.hashes = x

    def word(self, k: int) -> bytes:
        return self.buffer[self.starts[k] : self.stops[k]]


class _Table:
    """Known words, by hash: their keys, and where their ids are."""

    def __init__(self) -> None:
        self.hashes, self.keys = np.empty(0, dtype=np.uint64), np.empty((0, 4), dtype=np.uint64)
        self.first, self.count = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def find(self, hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is known, and its row. A known hash with another key is an error."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        if (self.keys[at[known]] != keys[known]).any():
            raise _Collision
        return known, at

    def add(self, hashes: np.ndarray, keys: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.keys = np.insert(self.hashes, at, hashes), np.insert(self.keys, at, keys, axis=0)
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, count)


def lowered(text: bytes) -> bytes:
    """A-Z in lower case, but not in words that hold a byte of 0x80 or more."""
    if text.isascii():
        return text.lower()
    raw = np.frombuffer(text, dtype=np.uint8)
    word = np.cumsum((raw == 0x20) | (raw - np.uint8(9) < 5), dtype=np.int32)
    other = np.zeros(int(word[-1]) + 1, dtype=bool)
    other[word[raw >= 0x80]] = True
    upper = (raw - np.uint8(0x41) < 26) & ~other[word]
    return np.where(upper, raw | np.uint8(0x20), raw).tobytes()


class _Collision(Exception):
    """Two words have one hash."""


class WordCacheEncoder:
    """Encodes with a tokenizers file, calling the library once for each word that a worker has not met lately.

    Where the file's normaliser and pre-tokenizer are the known word-BPE pair (NFC, white-space runs to one space, lower
    case, then a split whose matches never hold white space, and BPE within a match), no token reaches over ASCII white
    space, so the ids of a text are those of its pieces between it, in order; A-Z of words that are all ASCII may be lowered
    before (of others not: NFC comes first, and has composed forms that only the small letter has). A run of Latin
    letters is one match, whose last token alone ends in the end-of-word mark, so many of them go to the library at
    once, and a full stop or comma after it is a match of its own. Words are cut, looked up and put together for many
    texts at a time, in arrays. With any other file, and for texts that hold an added token's string, the library gets
    whole texts; so it does if two words ever have one hash.
    """

    CACHED = 1_200_000
    RECENT = 100_000
    AT_ONCE = 3 << 20
    SPACE = re.compile(r"[\x20\x09-\x0D]")
    LETTERS = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,]?)")

    def __init__(self, given: str | bytes):
        """given: a tokenizers file's path, or its bytes."""
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        text = (given if isinstance(given, bytes) else Path(given).read_bytes()).decode()
        self.library, spec = Tokenizer.from_str(text), json.loads(text)
        self.added = [token["content"] for token in spec.get("added_tokens") or []]
        self.added_bytes = [token.lower().encode() for token in self.added]
        self.by_word = self._word_local(spec)
        if self.by_word:
            ends = [i for token, i in spec["model"]["vocab"].items() if token.endswith(spec["model"]["end_of_word_suffix"])]
            self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
            self.ends[ends] = True
        self._forget()

    def _forget(self) -> None:
        self.main, self.recent = _Table(), _Table()
        self.pool, self.used = np.empty(1 << 16, dtype="<u4"), 0

    @staticmethod
    def _word_local(spec: dict) -> bool:
        normalizer, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [x["type"] for x in normalizer.get("normalizers", [])]
        cuts = splitter.get("pretokenizers", [])
        return (
            steps == ["NFC", "Replace", "Lowercase"]
            and normalizer["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and normalizer["normalizers"][1]["content"] == " "
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["behavior"] == "Removed"
            and cuts[0]["invert"]
            and cuts[0]["pattern"]["Regex"].endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and not cuts[1]["add_prefix_space"]
            and spec["model"]["type"] == "BPE"
            and bool(spec["model"].get("end_of_word_suffix"))
            and not spec["model"].get("dropout")
            and not spec.get("post_processor")
        )

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words, one after another, and how many each has."""
        counts, parts, at, rest = np.zeros(len(words), dtype=np.int64), [], [], []
        joined, marks = [], []
        for k, word in enumerate(words):
            found = self.LETTERS.fullmatch(word)
            if found:
                at.append(k)
                joined.append(word if not found[2] else found[1] + b" " + found[2])
                marks.append(2 if found[2] else 1)
            else:
                rest.append(k)
        for k in range(0, len(joined), 512):
            ids = np.array(self.library.encode_batch_fast([b" ".join(joined[k : k + 512]).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids])[np.cumsum(marks[k : k + 512]) - 1] + 1
            counts[at[k : k + 512]] = np.diff(stops, prepend=0)
            parts.append(ids)
        for k, ids in zip(rest, self.whole([words[k].decode() for k in rest]), strict=True):
            counts[k] = len(ids) // ID_BYTES
            parts.append(np.frombuffer(ids, dtype="<u4"))
        order = np.array(at + rest, dtype=np.int64)  # as the parts are
        firsts = np.empty(len(words), dtype=np.int64)
        firsts[order] = np.cumsum(counts[order]) - counts[order]
        flat = np.concatenate(parts) if parts else np.empty(0, dtype="<u4")
        return flat, np.stack([firsts, counts])

    def _learn(self, words: _Words, hashes: np.ndarray, rows: np.ndarray) -> None:
        flat, places = self._ids_of([words.word(k) for k in rows.tolist()])
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + 2 * len(flat), dtype="<u4")])
        self.pool[self.used : self.used + len(flat)] = flat
        self.recent.add(hashes, words.keys[rows], places[0] + self.used, places[1])
        self.used += len(flat)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        """ids of texts after lowered(), which are held together."""
        buffer = b"\n".join([*texts, b""])
        words = _Words(buffer)
        hashes, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        keys = words.keys[first]
        if (keys[inverse] != words.keys).any():
            raise _Collision
        if len(self.main.hashes) + len(self.recent.hashes) > self.CACHED:
            self._forget()
        if len(self.recent.hashes) > self.RECENT:
            self.main.add(self.recent.hashes, self.recent.keys, self.recent.first, self.recent.count)
            self.recent = _Table()
        old, at = self.main.find(hashes, keys)
        new = np.flatnonzero(~old)
        known, _ = self.recent.find(hashes[new], keys[new])
        self._learn(words, hashes[new[~known]], first[new[~known]])
        begin, count = np.empty(len(hashes), dtype=np.int64), np.empty(len(hashes), dtype=np.int64)
        begin[old], count[old] = self.main.first[at[old]], self.main.count[at[old]]
        _, at = self.recent.find(hashes[new], keys[new])
        begin[new], count[new] = self.recent.first[at], self.recent.count[at]
        counts = count[inverse]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(begin[inverse] - total[:-1], counts) + np.arange(total[-1])]
        places = np.cumsum([0, *(len(t) + 1 for t in texts)])
        stops = total[np.searchsorted(words.starts, places)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(stops, stops[1:], strict=False)]

    def _cut(self, text: str) -> list[str]:
        """Pieces of a long text that end before white space; the text itself if an added token may be in it."""
        if any(token in text.encode().lower() for token in self.added_bytes):
            return [text]
        out, at = [], 0
        while at < len(text):
            found = self.SPACE.search(text, at + self.AT_ONCE)
            stop = found.start() if found else len(text)
            out.append(text[at:stop])
            at = stop
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self.whole(texts)
        long = {k: self._cut(text) for k, text in enumerate(texts) if len(text) > 2 * self.AT_ONCE}
        out = self._batch(["" if k in long else text for k, text in enumerate(texts)])
        for k, pieces in long.items():
            out[k] = b"".join(self._batch(pieces))
        return out

    def _batch(self, texts: list[str]) -> list[bytes]:
        raw = [text.encode() for text in texts]
        special = {k for k, text in enumerate(raw) if any(token in text.lower() for token in self.added_bytes)}
        lowered_ = [lowered(text) for text in raw]
        out: list[bytes] = []
        start = size = 0
        for k, text in enumerate(lowered_):
            size += len(text)
            if size >= self.AT_ONCE or k + 1 == len(texts):
                try:
                    out += self._encode([b"" if j in special else lowered_[j] for j in range(start, k + 1)])
                except _Collision:
                    out += self.whole(texts[start : k + 1])
                start, size = k + 1, 0
        for k in special:
            out[k] = self.whole([texts[k]])[0]
        return out


def encoder(file: bytes) -> WordCacheEncoder:
    """One for each file and worker process."""
    name = hashlib.sha256(file).digest()
    if name not in _ENCODERS:
        _ENCODERS[name] = WordCacheEncoder(file)
    return _ENCODERS[name]


# ---------------------------------------------------------------------------------------------------------- operators


def _writer(folder: str, sent, end_id: int, kind: str, block_ids: int, level: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sink, out, first = common.new_file(folder, ".planes"), None, None, None
        encode, end = encoder(sent.value), np.array([end_id], dtype="<u4").tobytes()
        for batch in common.rows_of(batches, 1024):
            if out is None:
                files, path = common.opened(name)
                sink = files.open_output_stream(path)
                out = PlaneWriter(sink, kind, block_ids, level)
                first = [batch.column(c)[0].as_py() for c in (0, 2, 3)]
            ids = encode(common.texts(batch.column(1)))
            for doc_id, found in zip(batch.column(0).to_pylist(), ids, strict=True):
                out.add(doc_id, found + end)
        if out is not None:
            out.close()
            sink.close()
            row = [[name], [first[0]], [first[0] is None], [first[1]], [first[2]], [len(out.docs)], [out.n_ids]]
            types = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
            names = ["shard", "first_id", "has_null", "order_key", "row_key", "n_docs", "n_ids"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=names)

    return write


def write_planes(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, kind: str = "byte", block_ids: int = 1 << 16, level: int = 3) -> DataFrame:
    """Encodes whole texts and writes their ids in ascending order of id_col; returns the shard table, in no order.

    The rows are dealt out by range of (id, hash of the text, hash of the row's place), so no id, however often it or a whole
    row occurs, fills a task. Columns: shard (file), first_id, has_null, order_key, row_key (order the shards by first_id,
    nulls first, then order_key, then row_key), n_docs, n_ids.
    """
    spark = docs.sparkSession
    order = [F.col("id").asc_nulls_first(), F.col("order_key").asc(), F.col("row_key").asc()]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col)).alias("order_key"), F.xxhash64(F.monotonically_increasing_id()).alias("row_key"))
    rows = rows.repartitionByRange(common.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    sent = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())
    shards = rows.mapInArrow(_writer(folder, sent, end_id, kind, block_ids, level), SHARDS)
    return common.stage(shards, f"{folder}/shards")


def read_planes(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document of the shards: id_col, start (ids of all documents before it), n_tokens, ids (little-endian
    unsigned 32-bit integers, binary). The shard table has one row a file, so the driver can number the files."""
    spark = shards.sparkSession
    rows = sorted(shards.collect(), key=lambda r: (not r.has_null, r.first_id or 0, r.order_key, r.row_key))
    starts = np.cumsum([0] + [r.n_ids for r in rows]).tolist()
    plan = spark.createDataFrame([(k, r.shard, starts[k]) for k, r in enumerate(rows)], "k long, shard string, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[id_col, "start", "n_tokens", "ids"])

        for batch in batches:
            for shard, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                files, path = common.opened(shard)
                rows, held = [], 0
                with files.open_input_file(path) as source:
                    for doc_id, start, ids in PlaneReader(source, source.size()):
                        rows.append((doc_id, before + start, len(ids), ids.tobytes()))
                        held += len(ids)
                        if held > 1 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    parts = max(1, min(len(rows), 10 * common.shuffle_partitions(spark)))
    return plan.repartitionByRange(parts, "k").mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids binary")


def op8_token_planes(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_planes(docs, common.work_dir(spark, "planes"), public_tokenizers.path("word_bpe_49k.json"))
    return read_planes(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
