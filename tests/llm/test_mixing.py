"""Raking against its definition, sampling against its probabilities."""

import hashlib
import random
import re

import pytest

from millrace.llm import mixing

rng = random.Random(4)
ROWS = [(k, "word " * rng.randint(1, 60) + rng.choice(["", "| a | b", "a@b.c", "license"]), rng.choice(["en", "en", "de", "fr", None]), rng.choice(["a", "b", "b", None])) for k in range(600)]
ODD = [(700, None, "en", "a"), (701, "", None, None), (None, "null id", "en", "b"), (702, "twice", "de", "a"), (702, "twice", "de", "a"), (703, "w " * 60000, "fr", "b")]


def drawn(doc_id, salt="mix"):
    return int(hashlib.md5(f"{'' if doc_id is None else doc_id}:{salt}".encode()).hexdigest()[:13], 16) / 2**52


def words(text):
    return len(re.findall(mixing.WORD, text or ""))


def shares(rows, key):
    total = sum(r.n_words * r.weight for r in rows)
    out = {}
    for r in rows:
        out[key(r)] = out.get(key(r), 0) + r.n_words * r.weight / total
    return out


def test_targets(docs_of):
    targets = {"source": {"a": 5, "b": 3, "unknown": 2}, "lang": {"en": 0.25, "de": 0.25, "fr": 0.25, "unknown": 0.25}}
    docs = docs_of(ROWS + ODD)
    got = mixing.mix(docs, targets=targets)
    assert got.columns == [*docs.columns, *mixing.NEW]
    rows = got.collect()
    assert sorted(str((r.doc_id, r.text, r.lang, r.source)) for r in rows) == sorted(map(str, ROWS + ODD))
    assert all(r.n_words == words(r.text) for r in rows)
    assert shares(rows, lambda r: r.source or "unknown") == pytest.approx({"a": 0.5, "b": 0.3, "unknown": 0.2}, abs=1e-6)
    assert shares(rows, lambda r: r.lang or "unknown") == pytest.approx(targets["lang"], abs=1e-6)
    assert max(r.probability for r in rows) == pytest.approx(1) and min(r.probability for r in rows) >= 0
    assert all(r.sampled == (drawn(r.doc_id) < r.probability) for r in rows)
    kept, expected = (sum(r.n_words * x(r) for r in rows) for x in (lambda r: r.sampled, lambda r: r.probability))
    assert abs(kept - expected) < 4 * sum(r.n_words**2 * r.probability * (1 - r.probability) for r in rows) ** 0.5


def test_default_is_tempered(docs_of):
    rows = mixing.mix(docs_of(ROWS)).collect()
    have = {}
    for r in rows:
        have[r.lang or "unknown"] = have.get(r.lang or "unknown", 0) + r.n_words
    total = sum(x**mixing.TEMPER for x in have.values())
    assert shares(rows, lambda r: r.lang or "unknown") == pytest.approx({k: x**mixing.TEMPER / total for k, x in have.items()}, abs=1e-6)


def test_rare_values_are_other(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "MOST", {"source": 1, "lang": 2, "topic": 16})
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    rows = mixing.mix(docs_of(ROWS), rate=0.5).collect()
    assert len(rows) == len(ROWS) and len({r.weight for r in rows}) <= 2 * 3 * 5
    assert all(r.probability == min(1, 0.5 * r.weight) for r in rows)


def test_empty(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    row = mixing.mix(docs_of([(1, None, None, None)])).first()
    assert (row.n_words, row.weight, row.probability, row.sampled) == (0, 1.0, 1.0, True)


def test_rake_by_hand():
    got = mixing.rake({("a", "x"): 1.0, ("a", "y"): 1.0, ("b", "x"): 2.0}, [{"a": 0.5, "b": 0.5}, {"x": 0.75, "y": 0.25}])
    assert got == pytest.approx({("a", "x"): 1, ("a", "y"): 1, ("b", "x"): 2})


def test_stops_by_error():
    rng_ = random.Random(3)
    cells = {(a, b, c): rng_.random() ** 4 + 1e-6 for a in "abcdef" for b in "xyz" for c in "pqr" if rng_.random() < 0.6}
    goals = [mixing.tempered(cells, k, 0.3) for k in range(3)]
    got = mixing.rake(dict(cells), goals, 2000, 1e-12)
    for k, goal in enumerate(goals):
        have = {}
        for cell, x in got.items():
            have[cell[k]] = have.get(cell[k], 0) + x / sum(cells.values())
        assert have == pytest.approx(goal, abs=1e-11)
    with pytest.warns(UserWarning, match="off by"):
        mixing.rake({("a", "x"): 1.0, ("b", "y"): 1.0}, [{"a": 0.9, "b": 0.1}, {"x": 0.1, "y": 0.9}], 50)


def test_given_topics_and_tokens(docs_of):
    docs = docs_of([(k, "one two", "en", "a") for k in range(30)])
    docs = docs.selectExpr("*", "concat('t', doc_id % 3) AS subject", "doc_id AS tokens")
    rows = mixing.mix(docs, topic_col="subject", tokens_col="tokens", targets={"topic": {"t0": 0.5, "t1": 0.25, "t2": 0.25}}).collect()
    assert {r.topic for r in rows} == {"t0", "t1", "t2"} and all(r.n_words == r.doc_id for r in rows)
    assert shares(rows, lambda r: r.topic) == pytest.approx({"t0": 0.5, "t1": 0.25, "t2": 0.25}, abs=1e-6)
