"""Plane files: exact round trips; ids against the library."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import common, token_planes

WORDS = public_tokenizers.path("word_bpe_49k.json")
OTHER = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 100])
def test_planes(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (token_planes.from_planes(token_planes.to_planes(ids, kind), n, kind) == ids).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, (1 << 32) - 1), max_size=60), max_size=12), st.sampled_from(["byte", "bit"]), st.sampled_from([1, 8, 64]))
def test_file(docs, kind, block):
    sink = io.BytesIO()
    out = token_planes.PlaneWriter(sink, kind, block)
    for k, ids in enumerate(docs):
        out.add(k, np.array(ids, dtype="<u4").tobytes())
    out.close()
    read = token_planes.PlaneReader(sink, len(sink.getvalue()))
    assert [ids.tolist() for _, _, ids in read] == docs
    flat = sum(docs, [])
    for a in range(0, len(flat), 7):
        assert read.ids(a, min(a + 9, len(flat))).tolist() == flat[a : a + 9]


def test_cut_file():
    sink = io.BytesIO()
    out = token_planes.PlaneWriter(sink)
    out.add(1, b"\1\0\0\0")
    out.close()
    with pytest.raises(ValueError):
        token_planes.PlaneReader(io.BytesIO(sink.getvalue()[:-3]), len(sink.getvalue()) - 3)


LETTERS = st.one_of(st.sampled_from(list(" \n\t.,'sS<|>aAbé É×÷ÿ0́️ßΣςİ ")), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=400, deadline=None)
@given(st.text(LETTERS, max_size=40))
def test_ids(text):
    own = token_planes.encoder(open(WORDS, "rb").read())
    assert own.by_word
    assert np.frombuffer(own([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


LIBRARY = Tokenizer.from_file(WORDS)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "A <|ENDOFTEXT|> b", "it's it'S. we'll, a.. b,, c., é. Éa,", "x" * 3000, "a b " * 20000, "\x1c\x1d a\x0bb\x85c d"])
def test_odd_ids(text):
    own = token_planes.WordCacheEncoder(WORDS)
    for _ in range(2):
        assert np.frombuffer(own([text, text])[1], "<u4").tolist() == library_ids(WORDS, text)


def test_small_cache(monkeypatch):
    monkeypatch.setattr(token_planes.WordCacheEncoder, "CACHED", 6)
    monkeypatch.setattr(token_planes.WordCacheEncoder, "RECENT", 2)
    own = token_planes.WordCacheEncoder(WORDS)
    for text in ["a b c d e", "d, e. f g", "a b z, zz", "f g a,"] * 3:
        assert np.frombuffer(own([text])[0], "<u4").tolist() == library_ids(WORDS, text)


def test_collisions_and_long_words(monkeypatch):
    texts = ["a bc d", "", "x" * 23 + " " + "x" * 24 + " " + "x" * 25 + " " + "x" * 24 + "y", "\x00 a\x00 a", "é" * 12 + " " + "é" * 13, "last"]
    want = [library_ids(WORDS, t) for t in texts]
    own = token_planes.WordCacheEncoder(WORDS)
    assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == want
    monkeypatch.setattr(own, "AT_ONCE", 4)
    assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == want
    words = token_planes._Words.__init__

    def same_hash(self, buffer):
        words(self, buffer)
        self.hashes[:] = 7

    monkeypatch.setattr(token_planes._Words, "__init__", same_hash)
    assert [np.frombuffer(x, "<u4").tolist() for x in token_planes.WordCacheEncoder(WORDS)(texts)] == want


def test_long_texts_are_cut(monkeypatch):
    own = token_planes.WordCacheEncoder(WORDS)
    monkeypatch.setattr(own, "AT_ONCE", 10)
    texts = ["short", "a bc, def\n" * 9, "x" * 90, "é ü\u2003ö " * 20, "a <|endoftext|> b " * 5, "", " " * 50, "last one"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == [library_ids(WORDS, t) for t in texts]


def test_other_tokenizer_gets_whole_texts():
    own = token_planes.WordCacheEncoder(OTHER)
    assert not own.by_word
    assert np.frombuffer(own(["Hello  world\n x"])[0], "<u4").tolist() == library_ids(OTHER, "Hello  world\n x")


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_operator(spark, docs_of, kind):
    rows = [(7, "seven words, é"), (None, "no id"), (2, None), (3, ""), (3, ""), (3, "other"), (5, "long text. " * 30000), (1, "a")]
    shards = token_planes.write_planes(docs_of(rows), common.work_dir(spark, "test"), WORDS, kind=kind, block_ids=100)
    got = token_planes.read_planes(shards).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [None, 1, 2, 3, 3, 3, 5, 7]
    want = sorted(zlib.crc32(np.array([*library_ids(WORDS, t or ""), 2], "<u4").tobytes()) for _, t in rows)
    assert sorted(zlib.crc32(r.ids) for r in got) == want


def test_empty_table(spark, docs_of):
    shards = token_planes.write_planes(docs_of([]), common.work_dir(spark, "test"), WORDS)
    assert token_planes.read_planes(shards).count() == 0


def test_query(spark, tmp_path):
    rows = [(k % 23, f"text {k % 7}, é " * (k % 5)) for k in range(90)] + [(4, "the same row")] * 60 + [(None, None), (50, "x\ny " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = token_planes.op8_token_planes(spark, str(tmp_path)).orderBy("start").collect()
    at, before = 0, -1
    for r in got:
        assert r.start == at and (-1 if r.doc_id is None else r.doc_id) >= before
        at, before = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    ids = [np.array([*library_ids(WORDS, t or ""), 2], "<u4") for _, t in rows]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids, strict=True)), key=str)
