"""Operators 7 and 8: exact round trips and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from storelens.llm import fingerprint as P8
from storelens.llm import packing
from storelens.llm.queries import QUERIES, tokenizer_path
from storelens.llm.tokens import Encoder

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_encoder_equals_the_tokenizer(tok):
    r = random.Random(2)
    bits = ["a", "b", "é", "ß", " ", "  ", "\n", "'", "'s", "'re", "'ll", "'ve", "1", "23", ".", "!", "don't", "I'm", " '", "\t", "漢", "ñ", "'d", "'t", "\xa0", "\x0b", "\x1c", "Ⅷ", "½", "…", "’s", "<|endoftext|>", "😀"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    enc = Encoder(tokenizer_path())
    assert enc.merge is not None
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(texts, 500)] == want
    enc.merge = None  # any other tokenizer
    assert [x.tolist() for x in enc.encode(texts[:300])] == want[:300]


def check(rows, texts, tok, window=1024):
    """Every id in exactly one piece, whole sequences, and little padding."""
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    for i, pieces in by_doc.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(want[i])
    assert set(by_doc) == set(want) and sorted(by_seq) == list(range(len(by_seq)))
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padding += window - at
    assert padding < window


def test_pieces_make_up_all_documents(spark, tok):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    check(QUERIES["op7_min_bin_slack"](spark, SF001).collect(), texts, tok)


def test_packing_odd_inputs(spark, tok):
    from pyspark.sql import functions as F
    texts = {0: None, 1: "", 2: "word " * 5000, 3: "x", 4: "same text " * 90, 5: "same text " * 90} | {i: "copy of it " * 60 for i in range(10, 60)}
    d = spark.createDataFrame([(i, t, 1, "y") for i, t in texts.items()], "doc_id bigint, text string, start int, ids string").repartition(3)
    out = packing.pack(d, tokenizer_path())
    check(out.withColumn("ids_crc32", F.crc32("ids")).collect(), texts, tok)
    assert packing.pack(d.where("false"), tokenizer_path()).count() == 0
    twice = spark.createDataFrame([(None, "ab cd"), (None, "ab cd"), (7, "ab cd")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.length) for r in packing.pack(twice, tokenizer_path()).collect())[-1][0] == 7


def test_fill_is_the_best_subset_sum():
    r = random.Random(6)
    for _ in range(300):
        counts = {r.randint(1, 40): r.randint(1, 4) for _ in range(r.randint(0, 8))}
        capacity = r.randint(0, 80)
        sums = {0}
        for s, n in counts.items():
            sums = {a + k * s for a in sums for k in range(n + 1)}
        got = packing.fill(counts, capacity)
        assert all(n <= counts[s] for s, n in got.items())
        assert sum(s * n for s, n in got.items()) == max(x for x in sums if x <= capacity)


def test_plans_place_every_member_once():
    r = random.Random(5)
    for _ in range(60):
        w = r.choice([8, 16, 64, 1024])
        counts = {r.randint(1, w - 1): r.choice([1, 2, 5, 300]) for _ in range(r.randint(0, 30))}
        p, seen = packing.plan_sequences(counts, w), {}
        for size, n in counts.items():
            for k in range(n):
                pieces = p.place(size, k)
                assert sum(x for x, _, _ in pieces) == size
                for length, s, o in pieces:
                    seen.setdefault(s, []).append((o, length))
        assert sorted(seen) == list(range(p.n_sequences))
        assert w * p.n_sequences - sum(s * n for s, n in counts.items()) < w
    assert len(packing.plan_sequences({700: 10**9, 3: 10**8}).key) < 3000  # the work doesn't follow the counts


# ---- operator 8 ----


def brute(text, k, w):
    points = [ord(c) for c in text]
    if not points:
        return []
    k, m, hashes = min(k, len(points)), (1 << 64) - 1, []
    for i in range(len(points) - k + 1):
        x = 0
        for c in points[i:i + k]:
            x = (x * P8._BASE + c + 1) & m
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        hashes.append((x ^ (x >> 31)) >> 20)
    w = min(w, len(hashes))
    picked = set()
    for i in range(len(hashes) - w + 1):
        low = min(hashes[i:i + w])
        picked.add(max(p for p in range(i, i + w) if hashes[p] == low))
    return [(hashes[p], p) for p in sorted(picked)]


@pytest.mark.parametrize("block", [37, 1 << 19])
def test_winnowing_matches_brute_force(monkeypatch, block):
    monkeypatch.setattr(P8, "_BLOCK", block)
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice("abé 😀") for _ in range(r.randint(0, 200)))
        k, w = r.choice([1, 2, 3, 5, 7, 16]), r.choice([1, 2, 3, 5, 8, 64])
        assert list(zip(*(x.tolist() for x in P8.winnow(t, k, w)), strict=True)) == brute(t, k, w)


def test_guarantee_of_common_passages():
    r = random.Random(9)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        shared = say(P8.K + P8.WINDOW - 1)
        a, b = (P8.winnow(say(200) + shared + say(100))[0] for _ in range(2))
        assert np.intersect1d(a, b).size


def op8_rows(rows):
    order = sorted(rows, key=lambda r: r[1] or "")
    order = sorted(order, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        f = lambda s: ",".join(f"{h:011x}:{p}" for h, p in brute(s, P8.K, P8.WINDOW))
        g = lambda s: {h for h, _ in brute(s, P8.K, P8.WINDOW)}
        like = lambda x, y: len(x & y) / len(x | y) if x and y else float(x == y)
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), f(t), f(e), like(g(t), g(e)), like(g(t), g(nxt)))
    return out


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_edits_and_next_documents(spark, parts):
    r = random.Random(parts)
    rows = [(i * i, "".join(r.choice("abc dé") for _ in range(r.choice([0, 1, 5, 16, 80, 300])))) for i in range(60)] + [(3, None), (-5, "x" * 100)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    d = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, n_chars int").repartition(3)
    got = {x[0]: tuple(x)[1:] for x in P8.compare_with_edits(d).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == op8_rows(rows)


def test_fingerprints_of_odd_tables(spark):
    d = spark.createDataFrame([(1, None), (1, ""), (None, "abc"), (2, "same " * 50), (2, "same " * 50)], "doc_id bigint, text string")
    out = P8.compare_with_edits(d).collect()
    assert len(out) == 5 and {x.fingerprint for x in out if x.doc_id == 1} == {""}
    assert len({x.fingerprint for x in out if x.doc_id == 2}) == 1
    assert P8.compare_with_edits(d.where("false")).count() == 0
    one = P8.compare_with_edits(d.where("doc_id is null")).collect()[0]
    assert one.near_next == 1.0 and P8.fingerprints(d).count() == 5
