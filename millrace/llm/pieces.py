"""SentencePiece encoding with byte spans of the source, and decoding.

Encoding keeps offsets. A text is normalised by longest-prefix matches in the model's compiled character map (a
double-array trie over UTF-8 bytes with replacement strings); every normalised byte records the source byte at which
its match began, so a piece that covers normalised bytes [a, b) covers source bytes [align[a], align[b]). Spans of
neighbouring pieces therefore meet, and those of a text's pieces cover it.

A model's empty map matches nothing, so each character is its own match; such chunks are aligned many at a time, in arrays.
The ids are the sentencepiece library's. Where no piece of a BPE model joins a space to what stands before it, and none
holds a line feed, merges never reach over those places: the ids of a text are those of its chunks in order, and a
worker normalises, aligns and encodes only chunks that it has not met lately. Other models get whole texts. The model is
read once, by the driver, and broadcast.

Defined cases: null text counts as empty and gives just the end id (or nothing without one), no spans but an empty one
at 0 for the end id, and the empty text when decoded. Rows are independent: ties, repeated rows and other columns have
no influence. Very long texts are encoded
piece by piece where that gives the same ids, and whole otherwise.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

SPACE = "▁"

# ------------------------------------------------------------------------------------------------------ normalisation


class CharacterMap:
    """A compiled character map: u32 size of the trie, the trie's units, then replacement strings that end in a zero."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
            self.strings = blob[4 + size :]

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest key at start, and its replacement."""
        units, found, size = self.units, None, len(self.units)
        if not units:
            return None
        at = self._offset(units[0])
        for k in range(start, len(text)):
            byte = text[k]
            at ^= byte
            if at >= size or (units[at] & 0x800000FF) != byte:
                break
            unit = units[at]
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (k + 1 - start, units[at] & 0x7FFFFFFF)
        if found is None:
            return None
        length, where = found
        return length, self.strings[where : self.strings.index(b"\0", where)]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Normalizer:
    """Source text -> normalised bytes and, for each of them and the end, the place in the source."""

    def __init__(self, spec, as_suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.as_suffix = as_suffix

    def _prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(text, at)
        if found:
            return found
        lead = text[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, text[at : at + n]

    def __call__(self, source: str) -> tuple[bytes, list[int]]:
        text, at = source.encode(), 0
        space = SPACE.encode() if self.escape else b" "
        if self.squeeze:
            while at < len(text):
                n, new = self._prefix(text, at)
                if new != b" ":
                    break
                at += n
        if at >= len(text):
            return b"", [at]
        out, align = bytearray(), []

        def put(data: bytes, place: int) -> None:
            out.extend(data)
            align.extend([place] * len(data))

        if self.prefix and not self.as_suffix:
            put(space, at)
        after_space = self.squeeze
        while at < len(text):
            n, new = self._prefix(text, at)
            if self.squeeze and after_space:
                new = new.lstrip(b" ")
            if new:
                put(new.replace(b" ", space), at)
                after_space = new.endswith(b" ")
            elif n == 0:
                break
            at += n
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = align[len(out)]
                del align[len(out) :]
        if self.prefix and self.as_suffix:
            put(space, at)
        align.append(at)
        return bytes(out), align

    def chunks(self, chunks: list[bytes], head: bool) -> np.ndarray:
        """The alignment of chunks that follow each other, for an empty map without squeezing: of each normalised byte, and of
        the end, the place in all chunks together. head: each chunk begins a text, with a space before it that is not in
        the source."""
        raw = np.frombuffer(b"".join([b" " + c for c in chunks] if head else chunks), dtype=np.uint8)
        real = np.ones(len(raw), dtype=bool)
        if head:
            real[np.cumsum([0, *(len(c) + 1 for c in chunks[:-1])])] = False
        place = np.cumsum(real) - real
        begins = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, np.arange(len(raw)), 0))  # of the characters
        space = len(SPACE.encode()) if self.escape else 1
        return np.append(np.repeat(place[begins], np.where(raw == 0x20, space, 1)), real.sum())


# ----------------------------------------------------------------------------------------------------------- encoding


class PieceEncoder:
    """ids and source lengths of the pieces of texts."""

    CACHED = 150_000
    LONG = 1 << 20
    CUT = re.compile(f"[^ {SPACE}] ")
    CHUNK = re.compile(f"\n|[ {SPACE}]+[^ {SPACE}\n]*|[^ {SPACE}\n]+")

    def __init__(self, given: str | bytes):
        """given: a model file's path, or its bytes."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(given if isinstance(given, bytes) else Path(given).read_bytes())
        self.normalize = Normalizer(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.end_id = self.library.eos_id()
        kinds = model.SentencePiece.Type if hasattr(model, "SentencePiece") else pb.ModelProto.SentencePiece
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        self.normal_length = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], dtype=np.int64)
        spec, plain = model.normalizer_spec, (kinds.NORMAL, kinds.BYTE, kinds.UNKNOWN, kinds.CONTROL)
        self.by_chunk = (
            model.trainer_spec.model_type == pb.TrainerSpec.BPE
            and model.trainer_spec.byte_fallback
            and not model.trainer_spec.treat_whitespace_as_suffix
            and not spec.precompiled_charsmap
            and spec.add_dummy_prefix
            and spec.escape_whitespaces
            and not spec.remove_extra_whitespaces
            and all(p.type in plain for p in model.pieces)
            and not any(re.search(f"[^{SPACE}]{SPACE}|\n", p.piece) for p in model.pieces if p.type == kinds.NORMAL)
        )
        model.normalizer_spec.add_dummy_prefix = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.heads: dict[str, tuple[bytes, bytes]] = {}

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """For any model: ids, source lengths of the pieces, and where the first one begins."""
        normal, align = self.normalize(text)
        pieces = self.library.encode(text, out_type=str)
        ids = np.array([self.library.piece_to_id(p) for p in pieces], dtype=np.int32)
        cuts, at, k = [align[0]], 0, 0
        while k < len(pieces):
            if len(ids) and self.is_byte[ids[k]]:  # the bytes of a character: the last piece has its span
                first = normal[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                cuts += [align[at]] * (n - 1)
                at, k = at + n, k + n
            else:
                at, k = at + len(pieces[k].encode()), k + 1
            cuts.append(align[at])
        return ids, np.diff(np.array(cuts, dtype=np.int64)).astype(np.int32), align[0]

    def _new(self, chunks: list[str], head: bool) -> dict[str, tuple[bytes, bytes]]:
        if not chunks:
            return {}
        found = self.inner.encode([f" {c}" for c in chunks] if head else chunks, num_threads=1)
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32)
        align = self.normalize.chunks([c.encode() for c in chunks], head)
        cuts = np.cumsum(np.concatenate([[0], self.normal_length[ids]]))
        if cuts[-1] != len(align) - 1:
            raise ValueError("the pieces are not those of the normalised chunks")
        lengths = np.diff(align[cuts]).astype(np.int32)
        raw, sizes, stops = ids.tobytes(), lengths.tobytes(), (4 * np.cumsum([0, *map(len, found)])).tolist()
        return {c: (raw[a:b], sizes[a:b]) for c, a, b in zip(chunks, stops, stops[1:], strict=False)}

    def _learn(self, split: list[list[str]], head: bool = True) -> None:
        """Makes the chunks of texts known; the first of each begins a text, with head."""
        if len(self.known) > self.CACHED:
            self.known.clear()
        if len(self.heads) > self.CACHED:
            self.heads.clear()
        if head:
            self.heads.update(self._new(list({x[0] for x in split}.difference(self.heads)), True))
        self.known.update(self._new(list(set().union(*(x[head:] for x in split)).difference(self.known)), False))

    def _look_up(self, chunks: list[str], head: bool = True) -> tuple[bytes, bytes]:
        """ids and source lengths of known chunks."""
        parts = [self.heads[chunks[0]], *map(self.known.__getitem__, chunks[1:])] if head and chunks else list(map(self.known.__getitem__, chunks))
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def _long(self, text: str) -> tuple[bytes, bytes]:
        """The same for a text that is cut into pieces, each where a space follows none."""
        found, at = [], 0
        while at < len(text):
            cut = self.CUT.search(text, at + self.LONG)
            stop = cut.start() + 1 if cut else len(text)
            chunks = self.CHUNK.findall(text[at:stop])
            self._learn([chunks], not at)
            found.append(self._look_up(chunks, not at))
            at = stop
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def __call__(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, begins and ends of the pieces of all texts, and the stops of the texts in them (from 0)."""
        tail = np.array([self.end_id] if end else [], dtype=np.int32).tobytes()
        none = np.zeros(len(tail) // 4, dtype=np.int32).tobytes()
        ids, lengths, firsts, counts = [], [], np.zeros(len(texts), dtype=np.int64), []
        if self.by_chunk:
            long = {k: self._long(text) for k, text in enumerate(texts) if len(text) > self.LONG}
            split = [[] if k in long else self.CHUNK.findall(text) for k, text in enumerate(texts)]
            self._learn([chunks for chunks in split if chunks])
            for k, chunks in enumerate(split):
                own, sizes = long.get(k) or self._look_up(chunks)
                ids += (own, tail)
                lengths += (sizes, none)
                counts.append((len(own) + len(tail)) // 4)
        else:
            for k, text in enumerate(texts):
                own, sizes, firsts[k] = self.whole(text)
                ids += (own.tobytes(), tail)
                lengths += (sizes.tobytes(), none)
                counts.append(len(own) + len(tail) // 4)
        flat, size = np.frombuffer(b"".join(ids), dtype=np.int32), np.frombuffer(b"".join(lengths), dtype=np.int32)
        stops = np.cumsum([0, *counts])
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ends = total[1:] - np.repeat(total[stops[:-1]] - firsts, counts)
        return flat, (ends - size).astype(np.int32), ends.astype(np.int32), stops


_ENCODERS: dict[bytes, PieceEncoder] = {}


def encoder(model: bytes) -> PieceEncoder:
    """One for each model and worker process."""
    name = hashlib.sha256(model).digest()
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceEncoder(model)
    return _ENCODERS[name]


# ---------------------------------------------------------------------------------------------------------- operators


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", end: bool = True, decoded: bool = False, packed: bool = False) -> DataFrame:
    """id_col, ids, begins and ends (byte spans of the pieces in the text's UTF-8; with packed one column spans instead, the
    begin and end of each piece as little-endian 32-bit numbers); with decoded also the text that the library makes of the
    ids. The end id's span is empty. model: a model file's path, for the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(sent.value)
        for batch in common.rows_of(batches, 256):
            ids, begins, ends, stops = own(common.texts(batch.column(1)), end)
            stops32 = pa.array(stops.astype(np.int32))
            columns, names = [batch.column(0), pa.ListArray.from_arrays(stops32, pa.array(ids))], [id_col, "ids"]
            if packed:
                raw, at = np.stack([begins, ends], axis=1).astype("<i4").tobytes(), (8 * stops).tolist()
                columns.append(pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary()))
                names.append("spans")
            else:
                columns += [pa.ListArray.from_arrays(stops32, pa.array(x)) for x in (begins, ends)]
                names += ["begins", "ends"]
            if decoded:
                columns.append(pa.array(own.library.decode([ids[a:b].tolist() for a, b in zip(stops, stops[1:], strict=False)], num_threads=1), pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = common.spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")))
    kind = rows.schema[0].dataType.simpleString()
    spans = "spans binary" if packed else "begins array<int>, ends array<int>"
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, {spans}" + ", decoded string" * decoded)


def decode(rows: DataFrame, model: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of every id list; a null list gives the empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    @F.pandas_udf("string")
    def text_of(lists):
        import pandas as pd

        library = encoder(sent.value).library
        return pd.Series(library.decode([[] if x is None else [int(i) for i in x] for x in lists], num_threads=1), dtype=object)

    return rows.withColumn(out_col, text_of(F.col(ids_col)))


def digests() -> list:
    """Digest columns of encode(..., decoded=True)."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    ]


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoded = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True, packed=True)
    return encoded.select("doc_id", *digests(), F.sha2("spans", 256).alias("spans_sha256"))
