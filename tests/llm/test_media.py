"""Media columns: exact round trips through the shards."""

import hashlib
import tarfile
import zlib

import pytest

from millrace.llm import common, media


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000])
def test_png(n):
    payload = media.padded(bytes(k * 7 % 256 for k in range(n)))
    data = media.to_png(payload)
    assert len(payload) % 192 == 0 and len(payload) >= 192
    assert media.from_png(data) == payload
    assert media.png_header(data[: media.HEADER]) == (192, len(payload) // 192, 8, 0)
    assert media.feature(payload) == media.feature(bytes(payload))
    with pytest.raises(ValueError):
        media.from_png(data[:50] + bytes([data[50] ^ 1]) + data[51:])


def test_columns(spark, docs_of, tmp_path, monkeypatch):
    rows = [(1, "one"), (2, None), (2, ""), (None, "no id"), (5, "é" * 96), (6, "one"), (7, "x" * 300000), (8, "one")]
    folder = common.work_dir(spark, "test")
    stored = media.store(docs_of(rows).coalesce(2), folder)
    assert stored.count() == len(rows)
    once = media.contents(stored)
    assert once.count() == 5
    members = {}
    for shard in {r.shard for r in stored.collect()}:
        with tarfile.open(shard.removeprefix("file:")) as tar:
            for m in tar.getmembers():
                members[shard, m.offset_data] = (m.name, tar.extractfile(m).read())
    for r in stored.collect():
        name, data = members[r.shard, r.offset]
        assert (name, len(data)) == (f"{r.digest}.png", r.length) and hashlib.sha256(data).hexdigest() == r.digest
    found = {r.digest: r for r in media.with_payloads(media.with_headers(once)).collect()}
    for r in stored.collect():
        assert found[r.digest].media_sha256 == r.digest
    want = {hashlib.sha256(media.padded((t or "").encode())).hexdigest() for _, t in rows}
    assert {r.payload_sha256 for r in found.values()} == want
    assert all(r.height * 192 == r.payload_bytes for r in found.values())
    assert media.store(docs_of([]), common.work_dir(spark, "test")).count() == 0


def test_query(spark, docs_of, tmp_path):
    from millrace.llm.queries import QUERIES

    rows = [(1, "one"), (2, None), (3, "one"), (4, "a b " * 1000)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op9_media_columns"](spark, str(tmp_path)).collect()}
    for i, t in rows:
        payload = media.padded((t or "").encode())
        own = got[i]
        assert (own.n_bytes, own.payload_bytes, own.payload_sha256) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert own.tail_crc32 == zlib.crc32(payload[-16:])
    assert got[1][1:] == got[3][1:]
