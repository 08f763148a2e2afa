"""Shared lines against brute force, whatever the filters let through."""

import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import line_dedup

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, least=40, documents=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(i)
    shared = {k: max((i for i in own if i is not None), default=None) for k, own in held.items() if len(own) >= documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in shared or shared[key(x)] == i]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def run(docs_of, rows, **more):
    got = line_dedup.drop_shared_lines(docs_of(rows), **more).collect()
    assert got == [] or {"lang", "ids", "key", "line", "count"} <= set(got[0].asDict())
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str)


@pytest.mark.parametrize("bits, table", [(1 << 27, 1 << 20), (64, 1 << 20), (1 << 27, 0), (64, 0)])
def test_random(docs_of, bits, table, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_BITS", bits)
    monkeypatch.setattr(line_dedup, "TABLE", table)
    rng = random.Random(bits)
    lines = ["x" * n + str(k) for k, n in enumerate([10, 38, 39, 40, 60, 300])] + ["é" * 39, "é" * 40, "Ü" * 41, "", " ", "A" * 40 + "\r", "\t" + "a" * 40, "İ" * 40]
    rows = [(k if k % 17 else None, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 5)))) for k in range(40)]
    rows += [(5, "y" * 50), (5, "y" * 50), (6, "y" * 50), (7, "y" * 50), (8, "y" * 50), (9, None), (10, "z" * 45 + "\n" + "z" * 45)]
    assert run(docs_of, rows) == sorted(brute(rows), key=str)


def test_least_documents(docs_of):
    line = "the same line of at least forty code points"
    rows = [(k, f"{k}\n  {line.upper() if k % 2 else line} \n{line}") for k in range(5)]
    assert run(docs_of, rows[:4]) == sorted(brute(rows[:4]), key=str)
    got = run(docs_of, rows)
    assert got == sorted(brute(rows), key=str)
    assert [r[3] for r in got] == [2, 2, 2, 2, 0]


def test_empty_and_long(docs_of):
    assert run(docs_of, []) == []
    rows = [(k, "\n".join(["a" * 50] * 3000 + [str(k)])) for k in range(6)]
    assert run(docs_of, rows) == sorted(brute(rows), key=str)


def test_filters():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    bits = np.zeros((1 << 18) // 8, dtype=np.uint8)
    line_dedup.put(bits, keys, 1 << 18)
    assert line_dedup.holds(bits, keys, 1 << 18).all()
    assert line_dedup.holds(bits, rng.integers(0, 1 << 63, 20000, dtype=np.uint64), 1 << 18).mean() < 0.01


def test_hashes_that_meet():
    """Two keys with one hash are told apart by their digests."""
    a, b = b"a" * 50, b"b" * 50
    names = [line_dedup.key_of(a), line_dedup.key_of(a)[:8] + line_dedup.key_of(b)[8:]]
    assert line_dedup.Shared(names, [7, 9]).drops([1, 7, 2], [a, b"x\n" + a, b], 40) == [[0], None, None]


def test_suspects_are_few(spark):
    rng = random.Random(3)
    texts = ["\n".join(f"{rng.random()} one line of over forty code points" for _ in range(20)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts + texts[:7]], "text string")
    got = [r.hash for r in line_dedup.suspects(rows, 40).collect()]
    assert 140 <= len(got) <= 160 and len(set(got)) == len(got)
