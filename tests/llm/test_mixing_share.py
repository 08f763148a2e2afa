"""The kept share of words does not hang on the rarest cell."""

import random

import pytest

from millrace.llm import mixing

rng = random.Random(10)
ROWS = [(k, "word " * rng.randint(20, 60), rng.choice(["en", "en", "en", "de"]), rng.choice(["a", "b", "b"])) for k in range(2000)]
TINY = (9999, "five words are in here", "xx", "tiny")


@pytest.mark.parametrize("cells", [50_000, 0])
def test_a_tiny_cell_takes_nothing_from_the_others(docs_of, cells, monkeypatch):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
    monkeypatch.setattr(mixing, "CAPPED_SWEEPS", 25 if cells else 5)
    rows = mixing.mix(docs_of([*ROWS, TINY]), temper=0.7, sweeps=5).collect()
    words = sum(r.n_words for r in rows)
    assert sum(r.n_words * r.probability for r in rows) / words == pytest.approx(mixing.SHARE, abs=1e-3)
    assert sum(r.n_words * r.sampled for r in rows) / words == pytest.approx(mixing.SHARE, abs=0.04)
    assert [r.probability for r in rows if r.source == "tiny"] == [1.0] and min(r.probability for r in rows) > 0.5


def test_shares_are_the_targets_where_there_are_words_enough():
    cells = {("a", "x"): 900.0, ("a", "y"): 100.0, ("b", "x"): 500.0, ("b", "y"): 500.0}
    goals = [{"a": 0.5, "b": 0.5}, {"x": 0.6, "y": 0.4}]
    p = mixing.capped({c: (x, mixing.rake(dict(cells), goals)[c]) for c, x in cells.items()}, goals, 0.6, 200)
    kept = {c: p[c] * x for c, x in cells.items()}
    assert sum(kept.values()) == pytest.approx(1200, rel=1e-3)
    assert kept["a", "x"] + kept["a", "y"] == pytest.approx(600, rel=1e-2) and kept["a", "x"] + kept["b", "x"] == pytest.approx(720, rel=1e-2)
