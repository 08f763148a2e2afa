"""Queries without SQL against brute force, and operators over tables whose columns are named like their results."""

import hashlib
import math
import random
import re
import zlib

import xxhash
from pyspark.sql import functions as F

from millrace.llm import ann, lang_id, line_dedup, lm_score, media, mixing, pieces, secret_scan, shingles, simhash, token_planes

LONG = "a long text of many words " * 4000


def texts():
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "The", "a", "of", "é", "x" * 30, f"w{rng.randint(0, 400)}"])
    out = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for _ in range(40):
        own = rng.choice(out).split(" ")
        own[rng.randrange(len(own))] = rng.choice(["the", "changed"])
        out.append(rng.choice(["\n", " "]).join(own))
    return [None, "", " ", *out, out[3], out[3].upper(), LONG, LONG + "end", "x" * 192, "x" * 193]


def table(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")


def test_op10(spark, tmp_path):
    rows = [(k if k % 13 else 500 + k, t) for k, t in enumerate(texts())] + [(7, "a repeated id")]
    table(spark, tmp_path, rows)
    prints = []
    for _, t in rows:
        words = [w for w in re.split("[ \t\n\v\f\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
        own = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    least = {g: min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group)}
    want = sorted((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group, strict=True))
    assert sorted(tuple(r) for r in simhash.op10_simhash(spark, str(tmp_path)).collect()) == want


def test_op9(spark, tmp_path):
    rows = list(enumerate(texts())) + [(3, "a repeated id"), (None, "no id")]
    table(spark, tmp_path, rows)
    got = {}
    for r in media.op9_media_columns(spark, str(tmp_path)).collect():
        got.setdefault(str(r.doc_id), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, t in rows:
        data = (t or "").encode()
        payload = data + b" " * (max(1, math.ceil(len(data) / 192)) * 192 - len(data))
        sha = hashlib.sha256(payload).hexdigest()
        (r,) = [r for r in got[str(doc_id)] if r.payload_sha256 == sha]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-16:]))
        n, mean = len(payload), sum(payload) / len(payload)
        entropy = -sum(payload.count(b) / n * math.log2(payload.count(b) / n) for b in set(payload))
        lines, grid = n // 192, ""
        for y in range(8):
            band = range(y * lines // 8, (y + 1) * lines // 8)
            for x in range(8):
                field = [payload[192 * line + c] for line in band for c in range(24 * x, 24 * x + 24)]
                grid += "1" if sum(field) / max(24, len(field)) > mean else "0"
        assert r.feature == f"png:192x{lines}x8;mean={mean:.4f};entropy={abs(entropy):.4f};grid={int(grid, 2):016x}"
    assert len({r.media_sha256 for x in got.values() for r in x}) == len({(t or " ").ljust(192) for _, t in rows})  # padding alone is like a space


def test_names_of_results(spark):
    """Columns that are named like new ones are replaced, and have no influence."""
    rows = [(k, t, "en" if k % 2 else "fr", "s") for k, t in enumerate(texts()[:40])]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = ("n_lines", "n_dropped", "topic", "n_words", "weight", "probability", "sampled", "lang_pred", "score", "held_out", "component_id", "component", "fp", "digest", "row", "id", "key", "spans", "ids", "begins", "ends", "start", "n_tokens", "drop", "given", "name", "node", "may")
    full = plain.withColumns({c: F.lit("other") for c in taken})
    model = lang_id.fit([("one two three", "en"), ("un deux trois", "fr")])
    held = F.col("doc_id") % 3 == 0
    import public_tokenizers

    from millrace.llm import common

    bpe = public_tokenizers.path("piece_bpe_32k.model")
    planes = lambda d: token_planes.read_planes(token_planes.write_planes(d, common.work_dir(spark, "test"), public_tokenizers.path("word_bpe_49k.json")))
    for run in (
        line_dedup.drop_shared_lines, mixing.mix, lambda d: lang_id.predict(d, model), lambda d: lm_score.score(d, held), secret_scan.scan, simhash.near_duplicates,
        shingles.one_of_each, lambda d: pieces.encode(d, bpe), planes, lambda d: media.store(d, common.work_dir(spark, "test")).drop("shard", "offset"),
    ):
        want, got = run(plain), run(full)
        columns = [c for c in want.columns if c not in ("row", "component")]
        rows_of = lambda d: sorted(str(r) for r in d.select(*columns).collect())  # noqa: E731, B023
        assert rows_of(want) == rows_of(got)


def test_op4_names(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0], "x", 5, 0.5, "p") for k in range(60)], "vec_id long, embedding array<float>, query_id string, rank int, score double, part string")
    assert ann.search(rows, F.col("id") % 50 == 0).columns == ["query_id", "rank", "vec_id", "score"] and ann.search(rows, F.col("id") % 50 == 0).count() == 10
