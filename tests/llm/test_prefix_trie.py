"""Operator 12 against a plain trie of tuples."""

import hashlib
import math
import random
import zlib

import pytest

from storelens.llm import prefix_trie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members, children, sums, out = {}, {}, {}, set()
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        sums[k] = (sum(sums[x][0] for x in below) or 1, sum(sums[x][1] for x in below) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0))
        ends = ",".join(str(c) for c in sorted(members[k]) if len(built[c]) == len(k))
        out.add((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below), *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, rows):
    got = [tuple(r) for r in P.trie(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed):
    r, rows = random.Random(seed), []
    for c in [*range(0, 40), *range(100, 125), *range(205, 212), -5, -100, -107]:
        for t in range(r.choice([0, 1, 2, 3, 5, 6, 8, 9, 14, 30])):
            rows.append((c, r.choice([t, t, t, None]) if seed else t, r.choice(["u", "a", None]), r.choice(["x", "yé😀", "", None]) if t > 2 else "z"))
    return [*rows, *rows[:7], (None, 1, "u", "q")]


@pytest.mark.parametrize(("seed", "small"), [(0, False), (1, True)])
def test_same_as_plain_trie(spark, monkeypatch, seed, small):
    if small:  # blocks, runs of blocks and chunks of ids of a few each
        for name in ("BLOCK", "RUN", "CHUNK"):
            monkeypatch.setattr(P, name, 2)
    rows = made(seed)
    assert found(spark, rows) == brute(rows)


def test_copies_and_prefixes(spark):
    rows = [(c, t, "u", "x") for c in (3, 203, 404, 505) for t in range(40)] + [(100 * i, 0, "u", "x") for i in range(9)]
    assert found(spark, rows) == brute(rows)


def test_turnless_and_empty(spark):
    none = [(c, 0, "u", "x") for c in range(1, 400) if c % 100 and zlib.crc32(str(c).encode()) % 6]
    want = brute(none)
    assert len(want) == 1 and found(spark, none) == want  # the root alone, a leaf in which all end
    assert found(spark, []) == set()


def test_clashing_columns(spark):
    rows = [(200, 0, "u", "x", 1, 2), (200, 1, "a", "y", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", c long, depth long")
    assert {tuple(r) for r in P.trie(df).select(*COLUMNS).collect()} == brute([r[:4] for r in rows])
