"""Groups of copies against exact similarities, at the similarity that counts."""

import random

import pytest

from millrace.llm import shingles, simhash


def jaccard(a, b, words=5):
    x, y = (set(zip(*(t.lower().split()[k:] for k in range(words)))) for t in (a, b))
    return len(x & y) / len(x | y)


def edited(rng, text, changes):
    words = text.split()
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


def test_pairs_just_over_and_under(docs_of):
    """Pairs, with no third copy: those from 0.8 on are linked, those below are not. By fingerprints, a third of those
    from 0.8 to 0.82 was lost, and over half of those from 0.75 to 0.8 linked."""
    rng, rows, want = random.Random(5), [], {}
    while len(want) < 400:
        base = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(300))
        other = edited(rng, base, rng.randint(6, 9))
        s = jaccard(base, other)
        if 0.77 < s < 0.84:
            k = 2 * len(want)
            rows += [(k, base), (k + 1, other)]
            want[k] = s >= 0.8
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs_of(rows)).collect()}
    assert sum(want.values()) > 50 and len(want) - sum(want.values()) > 50
    linked = {k: got[k + 1] == k for k in want}
    assert not any(linked[k] and not want[k] for k in want)
    assert sum(linked[k] for k in want) >= sum(want.values()) - 1  # of 10,000 such pairs, 4 are expected to share no key


def test_groups(docs_of):
    rng = random.Random(6)
    base = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(300))
    texts = [None, "", " \n", "one", "ONE", base, base.upper(), *(edited(rng, base, rng.randint(1, 9)) for _ in range(40))]
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs_of(list(enumerate(texts)))).collect()}
    group = list(range(len(texts)))
    for i in range(5, len(texts)):
        for j in range(5, i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert got == {k: 0 if k < 3 else 3 if k < 5 else g for k, g in enumerate(group)}
    assert shingles.near_duplicates(docs_of([])).count() == 0


def closure(texts, least=0.8):
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and jaccard(texts[i], texts[j]) >= least:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


@pytest.mark.parametrize("hubs, block, rows", [(0, 8, 0), (0, 2048, 1 << 20), (1, 8, 1 << 20), (2, 8, 0)])
def test_texts_of_one_template(docs_of, monkeypatch, hubs, block, rows):
    """Many texts that share much, but not enough: their buckets are compared by blocks."""
    monkeypatch.setattr(shingles, "HUBS", hubs)
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "BROADCAST_ROWS", rows)
    rng = random.Random(7)
    base = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(300))
    texts = [edited(rng, base, rng.randint(10, 16)) for _ in range(30)]
    texts += [edited(rng, rng.choice(texts), rng.randint(1, 8)) for _ in range(25)]
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs_of(list(enumerate(texts)))).collect()}
    want = closure(texts)
    assert 20 < len(set(want)) < 40 and got == dict(enumerate(want))


def test_one_of_each(docs_of, monkeypatch):
    rng = random.Random(8)
    base, other = (" ".join(f"w{rng.randint(0, 5000)}" for _ in range(200)) for _ in range(2))
    rows = [(4, base), (3, edited(rng, base, 3)), (None, base), (9, other), (9, other), (9, "another text of id nine"), (None, "only without an id"), (None, "only without an id"), (5, None), (6, ""), (7, " ")]
    for few in (0, 1 << 20):
        monkeypatch.setattr(shingles, "BROADCAST_ROWS", few)
        got = shingles.one_of_each(docs_of(rows))
        assert got.columns == docs_of([]).columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([rows[1], rows[3], rows[5], rows[6], (5, None)], key=str)
    assert shingles.one_of_each(docs_of([])).count() == 0


@pytest.mark.parametrize("n", [12_000, 250_000, 15_000_000, 10**8])
def test_tables_hold_recall_at_the_radius(n):
    found = simhash.tables(n, 4, simhash.RECALL, 42)
    assert 1 - (1 - (1 - 42 / 256) ** found.shape[1]) ** len(found) >= simhash.RECALL
