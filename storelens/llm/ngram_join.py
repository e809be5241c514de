"""N-gram Jaccard join (operator 1): documents whose shingle sets have Jaccard similarity of at least 0.8.

1. ``signatures``: each text's set of hashed five-word shingles, as its size, a
   64-bit key of the set, and a bitmap of hashed shingles (2 to 4 bits a shingle).
   Equal sets share a key: copies are one class from here on.
2. ``tiles``: linked sets share a shingle among the first fifth of their shingles
   in a common order (rare ones first).  Records of the same shingle lie in
   tiles by size band (a factor of 1.25, beyond which no link is possible).  In each
   tile every set is paired with the tile's first and the two sets before it:
   linear in the records, whatever the size of a group.
3. Pairs are checked: the bit counts of both bitmaps bound the overlap from
   above, and what passes is intersected exactly, as sorted arrays.
4. In runs whose sets are not yet one component, the sets outside the largest
   one meet a set of it, another in each run; that settles loose groups.
5. What is still apart is gone through in blocks of one size band (with those of the
   same and the next band), pair by pair of different components, with the bitmap bound first.  After that every pair that shares a
   leading shingle is in one component or has been checked: no link is lost.

Frequent shingles (in more than ``FREQUENT`` of all sets) come last in the order,
and their tiles are dealt over salted parts of bounded size, joined by their first sets.

Defined cases: no words or null text: empty set, linked with nothing; one to four
words: the whole sequence is the one shingle; rows with a null id get no component
and link with nothing; repeated rows are copies; an empty table gives an empty table; extra columns are not carried.
64-bit hashes stand for shingles and sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import by_bytes, file_parts, keep, passing
from storelens.llm.components import components

WORDS = 5
PERCENT = 80  # 100 * intersection >= PERCENT * union
BAND = 100 / PERCENT
FREQUENT = 0.001  # share of all sets from which a shingle counts as frequent
FREQUENT_LEAST = 64  # sets, for small tables
PART_ROWS = 20_000  # records of a frequent shingle in one salted part
LARGE, MATES = 64, 8  # from so many sets of a component in a run on, so many of them are met
FAMILY_PARTS, FAMILY_ROWS = 4, 20_000  # tasks of a family of runs, at least, and records of it that one may get
SEEN_PAIRS = 300_000  # that a task remembers, to give each once
BLOCK_ROWS = 1000  # sets of one side of a block of pairs
BANDED = 1 << 32  # numbers of a size band's blocks
TEXT_BYTES = 2 << 20  # of texts shingled at once

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the hash base and of its inverse, up to the longest buffer met (2^64 wraps)."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = np.full(n, _BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() changes A-Z only
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    ends_of = np.cumsum([len(p) + 1 for p in parts])
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white))))
    begin, end = edge[0::2], edge[1::2]
    up, down = _POWERS.upto(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _U(1)) * up, dtype=np.uint64)))
    word = _mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    first = np.searchsorted(begin, np.concatenate(([0], ends_of[:-1])))
    last = np.append(first[1:], len(begin))
    if len(word) >= words:
        n = len(word) - words + 1
        gram = word[:n].copy()
        for k in range(1, words):
            gram = gram * _U(_BASE) + word[k:k + n]
        gram = _mix(gram)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            g = gram[a:b - words + 1].copy()
            g.sort()
            keep_ = np.empty(len(g), dtype=bool)
            keep_[0] = True
            np.not_equal(g[1:], g[:-1], out=keep_[1:])
            out.append(g[keep_])
        elif b > a:
            x = np.array([b - a], dtype=np.uint64)
            for w in word[a:b]:
                x = x * _U(_BASE) + w
            out.append(_mix(x + _U(1)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set and its size."""
    x = np.array([np.add.reduce(_mix(s + _U(_BASE)), dtype=np.uint64) + _U(len(s))], dtype=np.uint64)
    return int(_mix(x).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """One bit for each shingle hash, in the power of two of at least 64 and two times the set's size."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(s & _U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(b: bytes, size: int) -> np.ndarray:
    """A bitmap as 64-bit words, folded to ``size`` bytes: the bitmap the set has at that width."""
    x = np.frombuffer(b, dtype=np.uint64)
    while x.nbytes > size:
        x = x[:len(x) // 2] | x[len(x) // 2:]
    return x


def overlap_bound(na: int, a: bytes, nb: int, b: bytes) -> int:
    """An upper bound of the intersection: a bit that only one side has is a shingle that only it has."""
    size = min(len(a), len(b))
    x, y = fold(a, size), fold(b, size)
    only_a = int(np.bitwise_count(x & ~y).sum())
    only_b = int(np.bitwise_count(y & ~x).sum())
    return min(na - only_a, nb - only_b)


def enough(overlap, na, nb):
    """100 * overlap >= PERCENT * union."""
    return (100 + PERCENT) * overlap >= PERCENT * (na + nb)


def _front(n: int) -> tuple[int, int]:
    """How many leading shingles must hold a common one: of any set, and of the smaller set of a pair."""
    return n - -(-PERCENT * n // 100) + 1, n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, set size, key and bitmap; and, on one row of each batch of sets, the
    shingles that many sets of the batch share, for the frequency order."""
    schema = "doc_id bigint, n bigint, key bigint, bits binary, common array<bigint>, common_n array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", TEXT_BYTES):
            sets = shingle_sets(b.column(1).to_pylist())
            keys = [set_key(s) if len(s) else None for s in sets]
            distinct = {k: s for k, s in zip(keys, sets, strict=True) if k is not None}
            common, count = [], []
            if distinct:
                x = np.concatenate(list(distinct.values()))
                x.sort()
                at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
                times = np.diff(np.append(at, len(x)))
                often = times >= max(3, len(distinct) * FREQUENT * 2)
                common, count = x[at[often]].view(np.int64), times[often]
            empty = [None] * (len(sets) - 1)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()),
                pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([common, *empty], pa.list_(pa.int64())), pa.array([count, *empty], pa.list_(pa.int64()))],
                names=["doc_id", "n", "key", "bits", "common", "common_n"])

    return _texts(docs, doc_id, text).mapInArrow(run, schema)


def frequent_shingles(sig: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than ``FREQUENT`` of all sets and about how many sets hold them, rarest first.

    At most (mean set size / FREQUENT) of them exist, however many sets there
    are: that is what reaches the driver and travels to the tasks.
    """
    n = sig.where("n > 0").count()
    rows = sig.where("common is not null").select(F.explode(F.arrays_zip("common", "common_n")).alias("c")).groupBy(
        F.col("c.common").alias("t")).agg(F.sum("c.common_n").alias("n")).where(
        F.col("n") >= max(FREQUENT_LEAST, int(n * FREQUENT))).orderBy("n", "t").toPandas()
    return rows["t"].to_numpy(dtype=np.int64).view(np.uint64), rows["n"].to_numpy(dtype=np.int64)


def _records(texts: DataFrame, frequent: np.ndarray, held: np.ndarray) -> DataFrame:
    """(token, salt, n, key, front): the leading shingles of every set, rare ones first."""
    schema = "token bigint, salt int, n int, key bigint, front boolean"
    order = np.argsort(frequent)
    sorted_f, rank_f = frequent[order], order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", TEXT_BYTES):
            seen, cols = set(), ([], [], [], [], [])
            for s in shingle_sets(b.column(0).to_pylist()):
                n = len(s)
                key = set_key(s) if n else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                lead, front = _front(n)
                salt = np.zeros(lead, dtype=np.int32)
                if len(sorted_f):
                    at = np.minimum(np.searchsorted(sorted_f, s), len(sorted_f) - 1)
                    often = sorted_f[at] == s
                    rare, ranks = s[~often], np.sort(rank_f[at[often]])
                    s = np.concatenate((rare, frequent[ranks]))[:lead]
                    if lead > len(rare):
                        parts = -(-held[ranks[:lead - len(rare)]] // PART_ROWS)
                        salt[len(rare):] = np.where(parts > 1, 1 + (key & 0x7FFFFFFF) % parts, 0)  # 0: not dealt
                else:
                    s = s[:lead]
                cols[0].append(s)
                cols[1].append(salt)
                cols[2].append(np.full(lead, n, dtype=np.int32))
                cols[3].append(np.full(lead, key, dtype=np.int64))
                cols[4].append(np.arange(lead) < front)
            if cols[0]:
                a = [np.concatenate(c) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(a[0].view(np.int64)), *[pa.array(c) for c in a[1:]]],
                                                 names=["token", "salt", "n", "key", "front"])

    return texts.where("doc_id is not null").select("text").mapInArrow(run, schema)


_TILE = "token bigint, salt int, n int, key bigint, front boolean, first bigint, back1 bigint, back2 bigint, lead boolean"
_TILE_NAMES = [c.split(" ")[0] for c in _TILE.split(", ")]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Go through records sorted by (token, salt, n, key) and give each up to three mates in its run.

    A tile is a run's records of one size band.  A record's mates are its tile's
    first and the two records before it in the run, where sizes allow a link.
    Repeated sets and lone records are dropped.  In runs of two the mate settles
    everything, so their token is left out.  Parts of a dealt shingle keep all records, with their
    tiles' firsts marked as leads.  Memory: a batch and a few records.
    """
    held: list[np.ndarray] | None = None
    ended = False
    source = iter(batches)
    while not ended:
        b = next(source, None)
        ended = b is None
        cols = [] if ended else [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if not ended:
            cols.append(np.zeros(b.num_rows, dtype=bool))  # done: given out before
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols, strict=True)] if cols else held
        if not cols or not len(cols[0]):
            continue
        token, salt, n, key, front, done = cols
        same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        once = np.concatenate(([True], ~(same & (key[1:] == key[:-1]) & (n[1:] == n[:-1]))))
        token, salt, n, key, front, done = cols = [c[once] for c in cols]
        new_run = np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])))
        band = np.floor(np.log(n) / math.log(BAND) + 1e-9).astype(np.int64)
        new_tile = new_run | np.concatenate(([True], band[1:] != band[:-1]))
        place = np.arange(len(n))
        first = np.maximum.accumulate(np.where(new_tile, place, 0))
        size, held = len(n), None
        if not ended:
            begin = int(np.flatnonzero(new_run)[-1])
            if size - begin < 3:  # its length is not known yet
                held = [c[begin:] for c in cols]
                size = begin
            else:
                pick = sorted({int(first[-1]), size - 3, size - 2, size - 1})
                held = [c[pick] for c in cols]
                held[5] = np.ones(len(pick), dtype=bool)
        if not size:
            continue
        run = np.cumsum(new_run) - 1
        length = np.bincount(run)[run]
        mates = []
        for mate in (first, place - 1, place - 2):
            at = np.maximum(mate, 0)
            none = (mate < 0) | (run[at] != run) | (at == place) | (PERCENT * n > 100 * n[at])
            mates.append((key[at], none))
        dealt = salt > 0
        out = ((length > 1) | dealt) & ~done
        out[size:] = False
        at = np.flatnonzero(out)
        if len(at):
            yield pa.RecordBatch.from_arrays([
                pa.array(token[at], mask=((length == 2) & ~dealt)[at]), pa.array(salt[at]), pa.array(n[at]), pa.array(key[at]),
                pa.array(front[at]), *[pa.array(k[at], mask=none[at]) for k, none in mates], pa.array((dealt & new_tile)[at])], names=_TILE_NAMES)


def tiles(records: DataFrame) -> DataFrame:
    """The records of shingles that at least two sets lead with, with mates (see ``_walk``)."""
    return records.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "key").mapInArrow(_walk, _TILE)


def _mates(tile: DataFrame) -> DataFrame:
    """(a, b): every record with its mate, and the leads of dealt parts with theirs."""
    leads = tile.where("lead").select("token", F.lit(0).alias("salt"), "n", "key", "front")
    cols = ["key", "first", "back1", "back2"]
    each = tile.select(*cols).unionByName(tiles(leads).select(*cols)).distinct()
    return each.select("key", F.explode(F.array("first", "back1", "back2")).alias("mate")).where("mate is not null").select(
        F.least("key", "mate").alias("a"), F.greatest("key", "mate").alias("b")).distinct()


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps leave room for enough overlap."""
    for b in batches:
        a, c, na, nb, xa, xb = (x.to_pylist() for x in b.columns)
        ok = [enough(overlap_bound(*v), v[0], v[2]) for v in zip(na, xa, nb, xb, strict=True)]
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, o in zip(a, ok, strict=True) if o], pa.int64()),
                                          "b": pa.array([x for x, o in zip(c, ok, strict=True) if o], pa.int64())})


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sorted arrays have enough in common."""
    for b in batches:
        a, c, xa, xb = (x.to_pylist() for x in b.columns)
        ok = []
        for x, y in zip(xa, xb, strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = np.concatenate((x, y))
            both.sort()
            ok.append(enough(int((both[1:] == both[:-1]).sum()), len(x), len(y)))
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, o in zip(a, ok, strict=True) if o], pa.int64()),
                                          "b": pa.array([x for x, o in zip(c, ok, strict=True) if o], pa.int64())})


def _sets(docs: DataFrame) -> DataFrame:
    """(key, grams): each text's set as a sorted array of 64-bit hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", TEXT_BYTES):
            sets = [s for s in shingle_sets(b.column(0).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_pydict({"key": pa.array([set_key(s) for s in sets], pa.int64()),
                                              "grams": pa.array([s.tobytes() for s in sets], pa.binary())})

    return docs.select("text").mapInArrow(run, "key bigint, grams binary")


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, parts: int, bounded: bool = False) -> DataFrame:
    """The linked ones of ``pairs`` (a, b): bitmaps first, then the exact intersection."""
    if not bounded:
        x = nodes.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
        y = nodes.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
        pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_bounded, "a bigint, b bigint")
    pairs = keep(pairs, parts=parts)
    of = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    ids = keep(of.join(nodes.select("key", "doc_id"), "key").select("doc_id").distinct(), parts=parts)
    grams = _sets(texts.join(ids, "doc_id", "left_semi"))
    x = grams.select(F.col("key").alias("a"), F.col("grams").alias("xa"))
    y = grams.select(F.col("key").alias("b"), F.col("grams").alias("xb"))
    return keep(pairs.join(x, "a").join(y, "b").select("a", "b", "xa", "xb").mapInArrow(_exact, "a bigint, b bigint").distinct(), parts=parts)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components within a block that the bitmaps leave possible.

    Rows come sorted by (token, i, j, n); one block at a time is held.
    """
    def compare(cols: list[list]) -> pa.RecordBatch | None:
        own, n, key, root, bits = cols
        n, root, own = np.array(n, dtype=np.int64), np.array(root, dtype=np.int64), np.array(own)
        two = len(np.unique(own)) > 1
        folded: dict[int, np.ndarray] = {}
        a, b = [], []
        for i in range(len(n)):
            js = np.arange(i + 1, int(np.searchsorted(n, 100 * n[i] // PERCENT, side="right")))
            js = js[(root[js] != root[i]) & ((own[js] != own[i]) if two else True)]
            if not len(js):
                continue
            size = len(bits[i])
            if size not in folded:
                folded[size] = np.stack([fold(x, size) if len(x) >= size else np.zeros(size // 8, np.uint64) for x in bits])
            x, ys = folded[size][i], folded[size][js]
            only_i = np.bitwise_count(x & ~ys).sum(axis=1, dtype=np.int64)
            only_j = np.bitwise_count(ys & ~x).sum(axis=1, dtype=np.int64)
            js = js[enough(np.minimum(n[i] - only_i, n[js] - only_j), n[i], n[js])]
            for j in js.tolist():
                pair = (key[i], key[j]) if key[i] < key[j] else (key[j], key[i])
                if pair not in seen:
                    if len(seen) >= SEEN_PAIRS:
                        seen.clear()
                    seen.add(pair)
                    a.append(pair[0])
                    b.append(pair[1])
        if a:
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        return None

    seen: set[tuple[int, int]] = set()

    now, rows = None, [[] for _ in range(5)]
    for b in batches:
        for token, i, j, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (token, i, j) != now:
                if now is not None and (out := compare(rows)) is not None:
                    yield out
                now, rows = (token, i, j), [[] for _ in range(5)]
            for c, v in zip(rows, row, strict=True):
                c.append(v)
    if now is not None and (out := compare(rows)) is not None:
        yield out


def _rooted(tile: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    """The tiles' records with the components they are in."""
    return keep(tile.where("token is not null").select("token", "n", "key", "front").join(
        roots, F.col("key") == F.col("node"), "left").select("token", "n", "key", "front", F.coalesce("root", "key").alias("root")), parts=parts)


def _second_mates(rooted: DataFrame) -> DataFrame:
    """(a, b): in each run of several components, the sets outside the largest with one of its sets.

    It is picked by a hash, another in each run, and several where the largest
    component is large, so a set of a loose group meets many of the group's sets.
    """
    picks = [F.min_by(F.struct("key", "n"), F.xxhash64("token", "key", F.lit(k))).alias(f"p{k}") for k in range(MATES)]
    parts = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"), *picks)
    parts = parts.select("token", "root", "c", F.slice(F.array(*[f"p{k}" for k in range(MATES)]), F.lit(1),
                                                       F.when(F.col("c") >= LARGE, MATES).otherwise(1)).alias("ones"))
    major = parts.groupBy("token").agg(F.max_by(F.struct("root", "ones"), F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("parts"))
    major = major.where("parts > 1").select("token", F.col("m.root").alias("large"), F.col("m.ones").alias("ones"))
    pairs = rooted.join(major, "token").where(F.col("root") != F.col("large")).select("key", "n", F.explode("ones").alias("one"))
    fits = F.greatest("n", "one.n") * PERCENT <= F.least("n", "one.n") * 100
    return pairs.where(fits).select(F.least("key", "one.key").alias("a"), F.greatest("key", "one.key").alias("b")).distinct()


def _open_pairs(rooted: DataFrame, nodes: DataFrame, files: int) -> DataFrame:
    """Pairs of different components that share a leading shingle and pass the bitmap bound.

    Runs of the same sets are gone through once.
    """
    h = F.xxhash64("key")
    mixed = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("front").alias("any"),
                                        F.count(F.lit(1)).alias("m"), F.sum(F.shiftright(h, 20)).alias("s"), F.bit_xor(h).alias("x")).where("lo <> hi and any")
    mixed = mixed.groupBy("m", "s", "x").agg(F.min_by(F.struct("token", "lo"), "token").alias("t")).select("t.*", "m")
    # runs of one family go to few tasks (each of its blocks to others), where repeated pairs are dropped early
    parts = mixed.groupBy("lo").agg(F.greatest(F.lit(FAMILY_PARTS), F.ceil(F.sum("m") / FAMILY_ROWS)).alias("parts"))
    mixed = keep(mixed.join(parts, "lo").select("token", F.col("lo").alias("family"), F.pmod(F.xxhash64("token"), F.col("parts")).alias("part"), "m"), parts=files)
    rows = rooted.join(mixed, "token").withColumn("band", F.when(F.col("m") > BLOCK_ROWS, F.floor(F.log("n") / math.log(BAND))).otherwise(0))
    # a large run's blocks are of one size band; only blocks of equal or neighbouring bands can hold links
    each = rows.where(F.col("m") > BLOCK_ROWS).groupBy("token", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    up = each.select("token", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    down = each.select("token", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    each = each.join(up, ["token", "band"], "left").join(down, ["token", "band"], "left")
    rows = rows.join(each, ["token", "band"], "left").join(nodes.select("key", "bits"), "key")
    rows = rows.withColumn("own", F.col("band") * BANDED + F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))))

    def others(count: str, step: int):
        first = (F.col("band") + step) * BANDED
        return F.when(F.col(count) > 0, F.sequence(first, first + F.col(count) - 1)).otherwise(F.array().cast("array<bigint>"))

    meets = F.when(F.col("blocks").isNull(), F.array("own")).otherwise(F.concat(others("blocks", 0), others("above", 1), others("below", -1)))
    rows = rows.withColumn("other", F.explode(meets))
    rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "n", "key", "root", "bits", "family", "part")
    return rows.repartition("family", "part", "i", "j").drop("family", "part").sortWithinPartitions("token", "i", "j", "n", "key").mapInArrow(_block_pairs, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row."""
    with passing(docs.sparkSession):
        return _near_duplicates(_texts(docs, doc_id, text))


def _near_duplicates(texts: DataFrame) -> DataFrame:
    sig = keep(signatures(texts))
    frequent, held = frequent_shingles(sig)
    parts = file_parts(sig.sparkSession, sig.count())  # of every table between the stages
    tile = keep(tiles(_records(texts, frequent, held)))
    # one row per set: that of its smallest id
    least = sig.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    nodes = sig.select("key", "doc_id", "n", "bits").join(least, ["key", "doc_id"])
    links = _links(_mates(tile), nodes, texts, parts)
    roots = components(links, parts)
    rooted = _rooted(tile, roots, parts)
    links = links.unionByName(_links(_second_mates(rooted), nodes, texts, parts))
    roots = components(links, parts)
    more = keep(_open_pairs(_rooted(tile, roots, parts), nodes, parts), parts=parts)
    if more.limit(1).count():
        roots = components(links.unionByName(_links(more, nodes, texts, parts, bounded=True)), parts)
    rows = sig.select("doc_id", "n", "key").join(roots, F.col("key") == F.col("node"), "left").select(
        "doc_id", "n", F.coalesce("root", "key").alias("root"))
    rows = keep(rows, lasting=True, parts=parts)  # all that the result reads
    top = rows.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("component_id"))
    return rows.join(top, F.col("root") == F.col("r"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
