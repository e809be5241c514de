"""Operator 13 against brute force, also with groups halved down to single letters."""

import random
import re
import zlib
from collections import Counter

import pytest

from storelens.llm import spelling as S

COLUMNS = ["word", "n", "form", "root", "n_near", "form_n"]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        out[w] = n, best if best and words[best] >= 2 * n else None, len(others)

    def root(w):
        while out[w][1]:
            w = out[w][1]
        return w

    return {(w, n, f, root(w), k, words[f] if f else None) for w, (n, f, k) in out.items()}


def found(spark, docs):
    rows = [tuple(r) for r in S.variants(spark.createDataFrame(docs, "doc_id long, text string")).select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("seed", "letters", "limit"), [(0, "abàÿ", 10_000), (1, "abcé", 8), (2, "aB", 3)])
def test_same_as_all_pairs(spark, monkeypatch, seed, letters, limit):
    monkeypatch.setattr(S, "LIMIT", limit)
    monkeypatch.setattr(S, "FRONTIER", 50)
    r = random.Random(seed)
    docs = [(i if i % 7 else None, " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(300))) for i in range(24)]
    docs += [(5, docs[5][1]), (90, None), (91, ""), (92, "÷×æðþß " * 5 + "日本語テキスト " * 5)]
    want = brute(docs)
    assert len(want) > 100 and any(w[2] for w in want) and found(spark, docs) == want


def test_chain_of_forms_and_ties(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "caaaa": 6, "zzzzz": 5, "zzzzy": 5}
    # ids at which the word keeps all its letters
    docs = [(i, w) for w, n in counts.items() for i in [j for j in range(1000) if zlib.crc32(f"{j}:{w}".encode()) % 97][:n]]
    got = {w: (f, t) for w, _, f, t, _, _ in found(spark, docs)}
    assert got["aaaaa"] == ("aaaab", "aabbb")  # aaaab and caaaa tie at 6
    assert got["aaabb"] == ("aabbb", "aabbb") and got["zzzzz"] == (None, "zzzzz") and got["zzzzy"] == (None, "zzzzy")


def test_empty_and_clashing_columns(spark):
    assert found(spark, []) == set()
    docs = spark.createDataFrame([(1, "words words words", 1, "x")], "doc_id long, text string, n long, word string")
    assert [tuple(r) for r in S.variants(docs).select(*COLUMNS).collect()] == [("words", 3, None, "words", 0, None)]


def test_very_long_word(spark):
    w = "ab" * 3000
    got = found(spark, [(k, f"{w} {w} {w} {w} {w} {w} {w}c {w}c {w}c") for k in (1, 2)])
    assert {(len(r[0]), r[4]) for r in got} >= {(6000, 1), (6001, 1)}
