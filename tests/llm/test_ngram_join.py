"""Operator 1 against brute force, with tiles, blocks and salted parts made small."""

import contextlib
import glob
import random
import re

import numpy as np
import pytest

from storelens.llm import ngram_join as J
from storelens.llm.common import shared_dir
from storelens.llm.components import components


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return set()
    return {tuple(ws)} if len(ws) < 5 else {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)}


def brute(rows):
    """{id: (n, component)} by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (len(x), find(i)) for i, x in sets}


def corpus(seed, n=160, vocabulary=400):
    r = random.Random(seed)
    word = [f"w{i}" for i in range(vocabulary)]
    boiler = [r.choice(word) for _ in range(40)]
    out = []
    for k in range(n):
        kind = r.random()
        if out and kind < 0.55:  # a copy with a few changes, some near the limit
            t = (r.choice(out[:12]) or "").split(" ")
            for _ in range(r.randint(0, max(1, len(t) // 25))):
                at = r.randrange(len(t) + 1)
                t[at:at + r.randint(0, 1)] = [r.choice(word)]
            out.append(" ".join(t))
        elif kind < 0.7:
            out.append(" ".join(boiler + [r.choice(word) for _ in range(r.randint(0, 30))]))
        else:
            out.append(" ".join(r.choice(word) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 9, 30, 80, 150]))))
    return out


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True), (3, True)])
def test_same_components_as_all_pairs(spark, monkeypatch, seed, small):
    if small:  # frequent shingles, salted parts and blocks of several records
        for name, value in (("FREQUENT", 0.02), ("FREQUENT_LEAST", 3), ("PART_ROWS", 5), ("BLOCK_ROWS", 4), ("TEXT_BYTES", 4000)):
            monkeypatch.setattr(J, name, value)
    texts = corpus(seed)
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)] + [(5000, None), (5001, ""), (5002, " \n"), (5003, texts[0]), (5004, (texts[0] or "").upper()), (5005, "Ä b"), (5006, "ä b")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, key string, n int").repartition(4)  # extra columns with the operator's names
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(d).collect()}
    assert got == brute(rows)


def test_few_files_between_the_stages(spark, monkeypatch):
    """A file costs the executor several processes (chmod): with many shuffle partitions only the sets and the tiles keep theirs."""
    monkeypatch.setattr(J, "passing", lambda _: contextlib.nullcontext())
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    at = shared_dir(spark).removeprefix("file:") + "/llm-*"
    before = set(glob.glob(at))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = list(enumerate(corpus(6)))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == brute(rows)
    files = sorted(len(glob.glob(d + "/part-*")) for d in set(glob.glob(at)) - before)
    assert len(files) > 10 and files[-3] <= 2 * spark.sparkContext.defaultParallelism < files[-1]


def test_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert J.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = J.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None), (1, None)], schema)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 0, -1), (-1, 2, -1), (1, 0, 1), (3, 2, 3), (3, 2, 3)]


def test_bitmap_bound_is_never_below_the_overlap():
    r = np.random.default_rng(4)
    for _ in range(300):
        pool = r.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = (np.unique(r.choice(pool, int(r.integers(1, 400)))) for _ in range(2))
        assert J.overlap_bound(len(a), J.bitmap(a), len(b), J.bitmap(b)) >= len(np.intersect1d(a, b))


def test_shingle_sets_tell_texts_apart():
    texts = ["a b c d e", "A B C D E", "a b c d", "a b cd e", "ab c d e", "a b c d e f", "", None, "a\tb\x0bc  d\ne", "a b c d e a b c d e a b c d e"]
    sets = [frozenset(s.tolist()) for s in J.shingle_sets(texts)]
    want = [frozenset(shingles(t)) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert (sets[i] == sets[j]) == (want[i] == want[j])
    long = "x y " * 200_000
    assert len(J.shingle_sets([long])[0]) == 2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (60, 59), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{k: 100 for k in range(101, 160)}, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
