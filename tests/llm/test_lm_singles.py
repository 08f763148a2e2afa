"""Pairs that training rows hold once are in the model of the query."""

import math

import numpy as np
import pytest

from millrace.llm import lm_score


def test_filter_holds_pairs_seen_once():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 4000, dtype=np.uint64))
    counts = rng.integers(1, 4, len(keys))
    own = lm_score.Filters({0: lm_score.build_filter(keys, counts, 12, singles=True).tobytes()}, 1)
    want = np.floor(np.log2(counts)) + 1
    assert (own.levels(keys) >= want).all() and (own.levels(keys) == want).mean() > 0.95
    assert (own.levels(rng.integers(0, 1 << 48, 20000, dtype=np.uint64)) > 0).mean() < 0.02


def test_query_scores_a_pair_seen_once(spark, tmp_path):
    rows = [(2, "alpha beta"), (3, "gamma delta gamma")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lm_score.op7_lm_score(spark, str(tmp_path)).collect()}
    assert not got[2].held_out and not got[3].held_out
    n, v, b = 7, 5, lambda c: c / (c + lm_score.BACKOFF)  # tokens: alpha beta end gamma delta gamma end
    p = lambda pair, before, word: b(before) * pair / before + (1 - b(before)) * (word + 1) / (n + v + 1)
    want = math.log10(p(1, 2, 1)) + math.log10(p(1, 1, 1)) + math.log10(p(1, 1, 2))
    assert got[2].score == pytest.approx(want, rel=1e-9)
