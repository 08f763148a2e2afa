"""SentencePiece ids, spans and decoding against the library."""

import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from millrace.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = ["", " ", "a", " a", "a ", "a  b", "\n", "a\nb", " \n x", "▁", "a▁b ▁", "héllo wörld", "日本語 テキスト", "🙂 ok\t\tz", "\x00\x01 é́", "<s> </s> <0x0A> <unk>", "x" * 5000 + " y" * 3000, "1234 5,6", "ﬁ ﬀ Å"]


def spans(library, text):
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def ours(own, text):
    ids, begins, ends, _ = own([text], end=False)
    return list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True))


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_spans(text):
    assert ours(pieces.PieceEncoder(MODEL), text) == spans(LIBRARY, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁ab.1é日🙂"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    own = pieces.encoder(open(MODEL, "rb").read())
    assert ours(own, text) == spans(LIBRARY, text)
    ids, begins, ends, _ = own([text], end=False)
    assert (begins <= ends).all() and (begins[1:] == ends[:-1]).all()
    assert not len(ids) or (begins[0], ends[-1]) == (0, len(text.encode()))


def test_long_texts_are_cut(monkeypatch):
    own = pieces.PieceEncoder(MODEL)
    monkeypatch.setattr(own, "LONG", 5)
    monkeypatch.setattr(own, "CACHED", 20)
    texts = [*TEXTS, "ab  cd ▁ ef\n gh\n\nij " * 9, "abc", *TEXTS]
    for text in texts:
        assert ours(own, text) == spans(LIBRARY, text)
    monkeypatch.setattr(own, "LONG", 12)
    ids, _, _, stops = own(texts, end=False)
    assert [ids[a:b].tolist() for a, b in zip(stops, stops[1:])] == LIBRARY.encode(texts)


def test_whole_path_agrees():
    own = pieces.PieceEncoder(MODEL)
    own.by_chunk = False
    for text in TEXTS:
        assert ours(own, text) == spans(LIBRARY, text)


def trie(keys: dict[bytes, bytes]) -> bytes:
    """A compiled character map of a few keys, placed node by node at multiples of 256 + 256."""
    strings, where = b"", {}
    for new in keys.values():
        where[new] = len(strings)
        strings += new + b"\0"
    units = [0] * 256 * (2 + sum(map(len, keys)))
    free = [1]

    def place(at: int, prefix: bytes, label: int) -> None:
        below = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in keys
        base = 256 * free[0]
        free[0] += 1
        offset = at ^ base
        assert offset < 1 << 21
        units[at] = (offset << 10) | (leaf << 8) | label
        if leaf:
            units[base] = 1 << 31 | where[keys[prefix]]
        for byte in below:
            place(base ^ byte, prefix + bytes([byte]), byte)

    place(0, b"", 0)
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + strings


@pytest.mark.parametrize("squeeze", [False, True])
def test_character_map(tmp_path, squeeze):
    keys = {"ﬁ".encode(): b"fi", "Å".encode(): "Å".encode(), b"A": b"a", "㌀".encode(): "アパート".encode(), "　".encode(): b" ", "A̋".encode(): b"X", "​".encode(): b""}
    model = pb.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.normalizer_spec.precompiled_charsmap = trie(keys)
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    path = str(tmp_path / "m.model")
    open(path, "wb").write(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own = pieces.PieceEncoder(path)
    assert not own.by_chunk
    for text in [*TEXTS, "aﬁb  Å ㌀x", "　 　AA̋A​ z 　", "A̋ ​"]:
        assert ours(own, text) == spans(library, text), repr(text)


def test_query(spark, tmp_path):
    rows = [(1, None), (2, ""), (2, ""), (None, "no id"), (4, "hello\nworld " * 2000), *((10 + k, t) for k, t in enumerate(TEXTS) if "\0" not in t)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pieces.op1_sentencepiece(spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        own = spans(LIBRARY, text or "")
        ids, end = [*(x[0] for x in own), 2], len((text or "").encode())
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids)), hashlib.sha256(struct.pack(f"<{2 * len(ids)}i", *(n for _, *span in own for n in span), end, end)).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_packed_spans(docs_of):
    docs = docs_of([(1, "héllo wörld ▁ \n"), (2, None), (3, "a" * 50)])
    packed = {r.doc_id: list(struct.iter_unpack("<2i", r.spans)) for r in pieces.encode(docs, MODEL, packed=True).collect()}
    assert packed == {r.doc_id: list(zip(r.begins, r.ends, strict=True)) for r in pieces.encode(docs, MODEL).collect()}


def test_empty(spark, docs_of):
    assert pieces.encode(docs_of([]), MODEL).count() == 0


def test_decode(spark, docs_of):
    encoded = pieces.encode(docs_of([(1, "a b\nc"), (2, None)]), MODEL)
    assert {r.doc_id: r.decoded for r in pieces.decode(encoded, MODEL).collect()} == {1: "a b\nc", 2: ""}
