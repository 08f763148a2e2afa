"""Fingerprints, the trie join and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash


def slow_print(text, words=4):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints, radius=4):
    """The smallest index reachable, of a list of fingerprints."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def cloud(rng, n, centres, spread):
    own = [rng.getrandbits(64) for _ in range(centres)]
    return [rng.choice(own) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, spread))) for _ in range(n)]


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "a b c", "A b C d", "x y z w " * 700, "é ü ñ ö ß", "a b c d e", "a\x0bb\x1cc d e"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()).tolist() == [slow_print(text)]
    for block in (1, 2, 7, 100):
        assert simhash.fingerprint((text or "").encode(), block=block, width=3).tolist()[0] == slow_print(text)
    assert simhash.fingerprint((text or "").encode(), words=1, block=5).tolist() == [slow_print(text, 1)]


@pytest.mark.parametrize("seed", range(8))
def test_trie_links(seed, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 50 if seed % 2 else 1 << 20)
    rng = random.Random(seed)
    rows = sorted({(rng.randint(0, 2), x) for x in cloud(rng, 150, rng.choice([2, 10, 60]), rng.choice([3, 6, 12]))})
    bucket, keys = (np.array([r[k] for r in rows], dtype=np.uint64) for k in (0, 1))
    label = simhash.trie_links(keys[:, None], bucket, 4)
    for b in range(3):
        at = np.flatnonzero(bucket == b)
        assert (label[at] - at[0]).tolist() == slow_components([int(x) for x in keys[at]]) if len(at) else True


@pytest.mark.parametrize("n", [10, 10**7, 10**9, 10**12])
def test_choices_cover(n):
    rng = random.Random(n)
    for _ in range(50):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
        assert any(all((a ^ b) >> s & ((1 << w) - 1) == 0 for s, w in band) for band in simhash.choices(n, 4))


@pytest.mark.parametrize("split", [1 << 16, 5])
def test_links_and_components(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = random.Random(split)
    prints = sorted(set(cloud(rng, 300, 20, 7)))
    signed = [int(np.uint64(x).view(np.int64)) for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in simhash.components(edges, str(tmp_path)).collect()}
    want = slow_components(prints)
    names = [roots.get(x, x) for x in signed]
    assert len(set(zip(names, want))) == len(set(names)) == len(set(want))


def test_chain_of_components(spark, tmp_path):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (900, 901)], "u long, v long")
    roots = {r.node: r.root for r in simhash.components(edges, str(tmp_path)).collect()}
    assert {roots[k] for k in range(201)} == {0} and roots[901] == roots[900] == 900


def test_operator(spark, docs_of):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(120)) for _ in range(6)]
    texts = [None, "", " ", "one", "ONE", *base, *base[:3], *(b.upper() for b in base[:2])]
    for b in base:
        words = b.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    rows = [(k if k != 3 else None, t) for k, t in enumerate(texts, 10)]
    got = {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs_of(rows)).collect()}
    prints = [slow_print(t) for t in texts]
    group = slow_components(prints)
    ids = [r[0] for r in rows]
    least = {g: min((i for i, h in zip(ids, group) if h == g and i is not None), default=None) for g in group}
    assert got == {(i, p, least[g]) for i, p, g in zip(ids, prints, group)}
    assert simhash.near_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_wide_trie_links(seed):
    rng = random.Random(seed)
    wide = sorted({tuple(x) for x in zip(*(cloud(random.Random(seed * 10 + k), 120, 6, 20) for k in range(2)))})
    keys = np.array(wide, dtype=np.uint64)
    whole = [a << 64 | b for a, b in wide]
    radius = rng.choice([20, 30, 40])
    assert simhash.trie_links(keys, np.zeros(len(keys)), radius).tolist() == slow_components(whole, radius)


def test_wide_operator(spark, docs_of):
    """Copies with a few words changed are one group; texts that share no more than words are not."""
    rng = random.Random(8)
    rows, group = [], {}
    for g in range(30):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(400)]
        for c in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(rows), words=5, width=4, radius=42).collect()}
    least = {g: min(k for k in group if group[k] == g) for g in group.values()}
    assert got == {k: least[g] for k, g in group.items()}
