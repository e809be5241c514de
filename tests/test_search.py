"""Similarity jobs against a brute-force computation, with many Arrow batches
and exact ties (duplicate vectors)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.operators import search as S


@pytest.fixture()
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, old)


def data(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(120, 8)).astype(np.float32)
    vecs[50] = vecs[10]  # exact tie
    vecs[51] = vecs[10]
    labels = rng.integers(0, 4, size=120)
    rows = [(i, [float(x) for x in v], int(l)) for i, (v, l) in enumerate(zip(vecs, labels))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df, vecs.astype(np.float64), labels


def brute(vecs, labels):
    cents = np.stack([vecs[labels == q].mean(axis=0) for q in range(4)])
    sims = (vecs @ cents.T) / (np.linalg.norm(vecs, axis=1)[:, None] * np.linalg.norm(cents, axis=1)[None, :])
    return sims


def test_nearest_matches_brute_force(spark, small_batches):
    df, vecs, labels = data(spark)
    got = S.nearest(df, S.centroids(df), k=4).collect()
    sims = brute(vecs, labels)
    exp = set()
    for q in range(4):
        order = np.lexsort((np.arange(len(vecs)), -sims[:, q]))[:4]
        exp |= {(q, int(i), r + 1) for r, i in enumerate(order)}
    assert {(r["qid"], r["vec_id"], r["rank"]) for r in got} == exp


def test_group_by_topic_matches_brute_force(spark, small_batches):
    df, vecs, labels = data(spark)
    got = {r["vec_id"]: (r["group_id"], r["similarity"]) for r in S.group_by_topic(df, S.centroids(df)).collect()}
    sims = brute(vecs, labels)
    for i in range(len(vecs)):
        g, s = got[i]
        assert g == int(np.argmax(sims[i])) and abs(s - sims[i].max()) < 1e-9


def test_query_blocks_and_zero_vectors(spark, monkeypatch):
    """Any number of query vectors, in blocks; a zero vector is nobody's neighbour."""
    df, vecs, labels = data(spark)
    df = df.unionByName(spark.createDataFrame([(999, [0.0] * 8, 9), (998, [float("nan")] * 8, 9)], df.schema))
    queries = df.where("vec_id < 998").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    whole = sorted(map(tuple, S.nearest(df, queries, k=3).select("qid", "vec_id", "rank").collect()))
    topics = {r["vec_id"]: r["group_id"] for r in S.group_by_topic(df, queries).collect()}
    monkeypatch.setattr(S, "BLOCK_VECTORS", 17)
    assert sorted(map(tuple, S.nearest(df, queries, k=3).select("qid", "vec_id", "rank").collect())) == whole
    assert {r["vec_id"]: r["group_id"] for r in S.group_by_topic(df, queries).collect()} == topics
    assert len(whole) == 120 * 3 and not {998, 999} & {v for _, v, _ in whole}
    assert topics[50] == 10 and 999 not in topics
