"""Groups of similar vectors against all pairs: nothing unconnected is joined, few links are lost."""

import numpy as np

from storelens.operators import grouping as G


def components(sims, threshold):
    n, label = len(sims), list(range(len(sims)))
    todo = set(range(n))
    while todo:
        start = min(todo)
        stack = [start]
        todo.discard(start)
        while stack:
            u = stack.pop()
            label[u] = start
            for v in [v for v in todo if sims[u, v] >= threshold]:
                todo.discard(v)
                stack.append(v)
    return label


def planted(seed=5, dims=32):
    """Vectors that resemble one of 80 by cosines from 0.85 to 1, and one text's 300 copies."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.normal(size=(80, dims)))
    rows = []
    for c in centre:
        for cos in rng.uniform(0.85, 1, size=6):
            away = rng.normal(size=dims)
            away = unit(away - (away @ c) * c)
            rows.append(3 * (cos * c + np.sqrt(1 - cos * cos) * away))
    x = np.concatenate([centre, np.array(rows), np.repeat(unit(rng.normal(size=(1, dims))), 300, axis=0)])
    return x[rng.permutation(len(x))]


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def test_recall_and_no_false_link(spark):
    x = planted()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sims = u @ u.T
    got = {r["vec_id"]: r for r in G.group_similar(frame(spark, x)).collect()}
    assert len(got) == len(x)
    exact = components(sims, 0.9 - 1e-9)
    label = np.array([got[i]["group_id"] for i in range(len(x))])
    for g in set(label):
        members = np.flatnonzero(label == g)
        assert g == members[0] and len({exact[m] for m in members}) == 1
        assert all(got[m]["group_size"] == len(members) and abs(got[m]["similarity"] - sims[m, g]) < 1e-9 for m in members)
    a, b = np.nonzero(np.triu(sims >= 0.9, 1))
    copies = sims[a, b] > 1 - 1e-9
    assert (label[a] == label[b])[copies].all()
    assert (label[a] == label[b])[~copies].mean() >= 0.9 and (~copies).sum() > 500


def test_vectors_without_a_cosine_stand_alone(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]),
            (8, [float("inf"), 0.0]), (9, [0.0, 1.0])]
    got = G.group_similar(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["group_id"], r["group_size"], r["similarity"]) for r in got) == [
        (1, 1, 2, 1.0), (2, 1, 2, 1.0), (3, 3, 1, None), (4, 4, 1, None), (5, 5, 1, None), (6, 6, 1, None), (7, 7, 1, None),
        (8, 8, 1, None), (9, 9, 1, 1.0)]
    assert G.group_similar(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_tables_grow_with_the_data():
    shapes = [G.table_shape(n, 0.9, 0.02) for n in (10 ** 3, 10 ** 6, 10 ** 9)]
    assert shapes == sorted(shapes) and all(
        (1 - (1 - np.arccos(0.9) / np.pi) ** b) ** t <= 0.02 for b, t in shapes)


def test_few_tables_for_many_vectors():
    # the rows that travel are vectors times tables: 100 tables at this size when a bucket held one vector
    assert G.table_shape(1_500_000, 0.9, 0.02)[1] <= 32


def test_sketches_bound_the_cosine():
    x = planted()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    import pyarrow as pa
    q = G._units(pa.array(G._sketch(x), pa.binary()))
    assert np.abs(q @ q.T - u @ u.T).max() <= G._slack(x.shape[1]) < 0.001


def test_large_buckets_give_the_same_groups(spark, monkeypatch):
    """Buckets above the bound go through leaders and splits, groups above theirs through several parts."""
    x = planted(seed=9)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    exact = components(u @ u.T, 0.9 - 1e-9)
    monkeypatch.setattr(G, "BUCKET", 8)
    monkeypatch.setattr(G, "PART", 16)
    got = {r["vec_id"]: r for r in G.group_similar(frame(spark, x)).collect()}
    label = np.array([got[i]["group_id"] for i in range(len(x))])
    assert len(got) == len(x)
    for g in set(label):
        members = np.flatnonzero(label == g)
        assert g == members[0] and len({exact[m] for m in members}) == 1
        assert all(got[m]["group_size"] == len(members) and abs(got[m]["similarity"] - (u @ u.T)[m, g]) < 1e-9 for m in members)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    assert (label[a] == label[b]).mean() >= 0.9
    copies = (u @ u.T)[a, b] > 1 - 1e-9
    assert (label[a] == label[b])[copies].all() and copies.sum() > 40_000


def test_open_pairs_of_a_bucket_are_told_apart():
    x = np.array([[1, 0], [0.9, np.sqrt(1 - 0.81)], [0, 1]], dtype=np.float32)
    (one, other, sure), = G.bucket_links(np.array([4, 7, 9]), x, 0.9, 1e-3)  # at the threshold: not sure
    assert (one.tolist(), other.tolist(), sure) == ([7], [4], False)
    (one, other, sure), = G.bucket_links(np.array([4, 7, 9]), x, 0.4, 1e-3)  # a chain hangs on its smallest id
    assert (one.tolist(), other.tolist(), sure) == ([7, 9], [4, 4], True)
