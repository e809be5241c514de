"""Operator 11: recall against brute force, and exact lists where nothing may be missed."""

import numpy as np
import pytest

from storelens.llm import projected_search as A

SCHEMA = "vec_id long, embedding array<float>"


def lists(spark, rows, schema=SCHEMA, **options):
    out = {}
    for r in A.nearest(spark.createDataFrame(rows, schema), **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def brute(ids, x, k=20):
    out = {}
    for i, q in enumerate(ids):
        if q % 20 == 0:
            s = np.zeros(len(ids))
            for d in range(x.shape[1]):
                s += x[i, d] * x[:, d]
            out[int(q)] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def test_quantile():
    assert A.quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3) and A.quantile(0.5, 2) == pytest.approx(1.3863, abs=1e-4)


@pytest.mark.parametrize("small", [False, True])
def test_recall(spark, monkeypatch, small):
    if small:  # several cells, pieces, leaves and blocks of queries
        for name, value in (("PIECE", 200), ("LEAF", 16), ("QUERIES", 40), ("SAMPLE", 500)):
            monkeypatch.setattr(A, name, value)
    r = np.random.default_rng(3)
    x = np.concatenate((r.standard_normal((1500, 24)), r.standard_normal((10, 24))[r.integers(0, 10, 1500)] * 2 + 0.2 * r.standard_normal((1500, 24)))).astype(np.float32)
    ids = r.permutation(3000)
    want = brute(ids, x.astype(float))
    got = lists(spark, [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)])
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.95 * 20 * len(want)
    exact = {(q, i): s for q, w in brute(ids, x.astype(float), 3000).items() for i, s in w}
    assert all(exact[q, i] == s for q, w in got.items() for i, s in w)  # scores to the last bit


def test_copies_tie_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(A, "PIECE", 64)
    rows = [(i, [1.0, 2.0]) for i in range(1000)] + [(i, [1.0, -float(i)]) for i in range(1000, 1100)]
    got = lists(spark, rows + rows[:50])
    for q in range(0, 1000, 20):
        assert got[q] == [(i, 5.0) for i in range(22) if i != q][:20]


def test_fewer_candidates_and_padding(spark):
    got = lists(spark, [(20, [1.0, 1.0]), (1, [3.0]), (2, [0.0, 2.0, 9.0]), (40, [-1.0, 0.0])])
    assert got == {20: [(1, 3.0), (2, 2.0), (40, -1.0)], 40: [(2, 0.0), (20, -1.0), (1, -3.0)]}


def test_odd_vectors(spark):
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, float("nan")]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, [None, 1.0])]
    assert lists(spark, bad) == {}
    assert lists(spark, []) == {}
    assert lists(spark, [*bad, (0, [1.0, 0.0])]) == {}  # a query without candidates
    assert lists(spark, [(3, [1.0, 0.0]), (5, [1.0, 0.0])]) == {}  # no query
    rows = [(0, [1.0], 7, "a"), (1, [2.0], 7, "b")]
    assert lists(spark, rows, SCHEMA + ", id long, cell string") == {0: [(1, 2.0)]}
