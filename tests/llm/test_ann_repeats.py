"""Equal vectors of other ids are found, however often the query's own id is repeated."""

import numpy as np

from millrace.llm import ann


def test_a_repeated_query_id():
    ids, same = np.array([0] * 10 + [1, 2, 3, 4, 5]), np.ones((15, 4))
    q, found, cos = ann.nearest(np.array([0]), same[:1], ids, same, 5)
    assert found.tolist() == [1, 2, 3, 4, 5] and np.allclose(cos, 1)


def test_against_all_rows():
    rng = np.random.default_rng(4)
    for _ in range(50):
        ids, vectors = rng.integers(0, 6, 40), np.eye(3)[rng.integers(0, 3, 40)]
        q = np.unique(ids)
        own = np.array([vectors[ids == i][0] for i in q])
        a, found, _ = ann.nearest(q, own, ids, vectors, 4)
        for i, v in zip(q, own):
            want = sorted((-float(v @ w), int(j)) for j, w in zip(ids, vectors) if j != i)[:4]
            assert found[a == i].tolist() == [j for _, j in want]
