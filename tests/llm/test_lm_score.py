"""Base scores against brute force; model scores against the same formula with exact counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import lm_score


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def brute(rows, held, singles=False):
    uni, bi, hist = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            own = tokens(t)
            uni.update(own)
            before = ["begin", *own[:-1]]
            bi.update(zip(before, own))
            hist.update(before)
    n, v, out = sum(uni.values()), len(uni), []
    for i, t in rows:
        own, base, score = tokens(t), 0.0, 0.0
        for h, w in zip(["begin", *own[:-1]], own):
            p = (uni[w] + 1) / (n + v + 1)
            b = hist[h] / (hist[h] + lm_score.BACKOFF)
            c = bi[h, w]
            seen = min(2 ** int(math.log2(c)), hist[h]) if c >= (1 if singles else 2) else 0
            base += math.log10(p)
            score += math.log10((1 - b) * p + b * (seen / hist[h] if hist[h] else 0))
        out.append((i, held(i), len(own), sum(uni[w] > 0 for w in own), n, base, score))
    return sorted(out, key=lambda r: (str(r[0]), r[5]))


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("chunk, broadcast", [(4_000_000, 64 << 20), (50, 64 << 20), (50, 100)])
def test_scores(docs_of, chunk, broadcast, monkeypatch):
    monkeypatch.setattr(lm_score, "BROADCAST", broadcast)
    rng = random.Random(chunk)
    words = ["the", "The", "a", "é", "É", "\x1cx", "of,", "x" * 5000] + [f"w{k}" for k in range(30)]
    rows = [(k if k % 11 else None, " ".join(rng.choice(words[: rng.choice([3, 10, 38])]) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    rows += [(200, None), (201, " \n\t"), (202, ""), (202, ""), (203, "the a " * 3000), (204, "never seen")]
    monkeypatch.setattr(lm_score, "CHUNK_TOKENS", chunk)
    got = lm_score.score(docs_of(rows), F.crc32(F.col("doc_id").cast("string")) % 7 == 2, bits_per_entry=64)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: (str(r[0]), r[5]))
    want = brute(rows, is_held)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_empty_and_untrained(docs_of):
    assert lm_score.score(docs_of([]), F.lit(False)).count() == 0
    row = lm_score.score(docs_of([(1, "a b")]), F.lit(True)).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)


def test_pack():
    arrays = [np.arange(5, dtype=np.uint64), np.array([], dtype=np.int32), np.array([7], dtype=np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, lm_score.unpack(lm_score.pack(arrays)), strict=True))


def test_filter_answers():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 4000, dtype=np.uint64))
    counts = rng.integers(1, 3000, len(keys))
    bits = lm_score.build_filter(keys, counts, 12)
    own = lm_score.Filters({0: bits.tobytes()}, 1)
    want = np.where(counts > 1, np.floor(np.log2(counts)), 0)
    assert (own.levels(keys) >= want).all() and (own.levels(keys) == want).mean() > 0.95
    assert (own.levels(rng.integers(0, 1 << 48, 20000, dtype=np.uint64)) > 0).mean() < 0.02


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_query_with_production_parameters(spark, tmp_path, monkeypatch, broadcast):
    """Base columns exactly; scores but for the few pairs that the filter holds by chance."""
    monkeypatch.setattr(lm_score, "BROADCAST", broadcast)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(words[: rng.choice([5, 50, 300])]) for _ in range(rng.randint(0, 40)))) for k in range(300)] + [(None, "w1 w2"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in lm_score.op7_lm_score(spark, str(tmp_path)).collect()), key=lambda r: (str(r[0]), r[5]))
    want = brute(rows, is_held, singles=True)
    assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    off = np.array([a[6] - b[6] for a, b in zip(got, want, strict=True)])
    assert (off > -1e-9).all() and (abs(off) < 1e-9).mean() > 0.6 and off.max() < 3
