"""Document fingerprints (operator 8) by winnowing.

The hash of every k-gram of code points is rolled over the text; every window
of ``window`` k-grams gives its smallest hash, the rightmost of equal ones; each
selected hash is kept with its position.  So any passage of at least
``k + window - 1`` code points that two texts share gives both a common hash.

Defined cases: a null or empty text has the empty fingerprint; a text shorter
than k is hashed whole, one with fewer k-grams than a window gives its smallest;
two empty fingerprints are alike (1), an empty and another aren't (0); equal
texts have equal fingerprints; long texts are read whole, in blocks of windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K, WINDOW = 16, 64  # guarantee: common passages of 79 code points
_PLACE_BITS = 20
_BLOCK = 1 << (_PLACE_BITS - 1)  # windows handled at once
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 44-bit hash of each k-gram: the polynomial of its code points, rolled by
    doubling (a gram of 2m is two grams of m), then mixed."""
    h, n, power = points.astype(np.uint64) + np.uint64(1), 1, _BASE
    out, taken = None, 0
    while True:
        if k & n:
            if out is None:
                out, taken = h, n
            else:  # out covers `taken` points, h the n that follow
                length = len(points) - taken - n + 1
                out = out[:length] * np.uint64(pow(_BASE, n, 1 << 64)) + h[taken:taken + length]
                taken += n
        n *= 2
        if n > k:
            break
        m = n // 2
        length = len(points) - n + 1
        if length <= 0:
            h = h[:0]
            continue
        h = h[:length] * np.uint64(pow(_BASE, m, 1 << 64)) + h[m:m + length]
    x = out.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x >> np.uint64(_PLACE_BITS)


def _smallest(keys: np.ndarray, window: int) -> np.ndarray:
    """The minimum of each window, by doubling."""
    m, n = keys, 1
    while 2 * n <= window:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    rest = window - n
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions, in the order of the text."""
    points = code_points(text)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = gram_hashes(points, min(k, len(points)))
    window = min(window, len(h))
    low = np.uint64((1 << _PLACE_BITS) - 1)
    found_h, found_p = [], []
    for start in range(0, len(h) - window + 1, _BLOCK):
        part = h[start:start + _BLOCK + window - 1]
        keys = (part << np.uint64(_PLACE_BITS)) | (low - np.arange(len(part), dtype=np.uint64))
        best = _smallest(keys, window)
        best = best[np.concatenate(([True], best[1:] != best[:-1]))]
        found_h.append(best >> np.uint64(_PLACE_BITS))
        found_p.append((low - (best & low)).astype(np.int64) + start)
    hashes, places = np.concatenate(found_h), np.concatenate(found_p)
    new = np.concatenate(([True], places[1:] != places[:-1]))  # a block may begin with the last one's choice
    return hashes[new], places[new]


def as_string(hashes: np.ndarray, places: np.ndarray) -> str:
    """``hash:position`` in hexadecimal and decimal, comma-joined."""
    return ",".join([f"{h:011x}:{p}" for h, p in zip(hashes.tolist(), places.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of selected hashes, given sorted and distinct."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``hashes`` and ``positions`` (arrays) of each text; a map without shuffle."""
    rest = [c for c in docs.columns if c not in ("hashes", "positions")]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add("hashes", T.ArrayType(T.LongType())).add("positions", T.ArrayType(T.LongType()))
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [winnow(t or "", k, window) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())), pa.array([p for _, p in got], pa.list_(pa.int64()))],
                names=[*rest, "hashes", "positions"])

    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


_LAST = -(1 << 63)  # the place of null ids: after all others


def _buckets(docs: DataFrame, key: str, parts: int) -> tuple[np.ndarray, dict[int, int], list[int]]:
    """Lower limits of at most ``parts`` ranges of ids, the largest id of each, and the
    ranges in descending order; only these few numbers reach the driver."""
    ids = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)).alias("id"))
    cut = ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    limits = np.unique(np.array([int(c) for c in cut], dtype=np.int64))

    def tops(batches):
        best: dict[int, int] = {}
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            where = np.searchsorted(limits, x, side="right")
            for w in np.unique(where).tolist():
                best[w] = max(best.get(w, _LAST), int(x[where == w].max()))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(best), pa.int32()), "top": pa.array(list(best.values()), pa.int64())})

    rows = ids.mapInArrow(tops, "bucket int, top bigint").groupBy("bucket").agg(F.max("top").alias("top")).collect()
    top = {r["bucket"]: r["top"] for r in rows}
    return limits, top, sorted(top, reverse=True)


def with_next(docs: DataFrame, fn, schema: str, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Apply ``fn(rows)`` to the texts in descending id, where rows yields (id, text, next text).

    The ids are cut into ranges of about equal counts; each text is shuffled
    once, to its range.  The first document of each range is also sent to the
    range before it, so no task needs more than its own rows.  Equal ids are
    ordered by text.  The last document's next is the first.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    limits, top, order = _buckets(docs, doc_id, parts)
    host = {top[b]: order[i - 1] for i, b in enumerate(order)}  # a range's first id goes to the range before, too

    def deal(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            x = np.array([_LAST if i is None else i for i in ids], dtype=np.int64)
            where = np.searchsorted(limits, x, side="right").astype(np.int32)
            guests = [i for i, v in enumerate(x.tolist()) if v in host]
            out = pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.zeros(len(x), np.int32)), b.column(0), b.column(1)], names=["bucket", "guest", "doc_id", "text"])
            yield out
            if guests:
                g = out.take(pa.array(guests, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([host[int(x[i])] for i in guests], pa.int32()), pa.array([1] * len(guests), pa.int32()), g.column(2), g.column(3)], names=out.schema.names)

    dealt = src.mapInArrow(deal, "bucket int, guest int, doc_id bigint, text string")
    dealt = dealt.repartitionById(max(1, len(limits) + 1), F.col("bucket")).sortWithinPartitions(
        "bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def walk(batches):
        def pairs():
            held = None  # the row whose next is not known yet
            for b in batches:
                for bucket, guest, i, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if held is not None and held[0] == bucket:
                        yield held[2], held[3], t
                    held = (bucket, guest, i, t) if not guest else None

        return fn(pairs())

    return dealt.mapInArrow(walk, schema)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the text replaced by as much of the next text's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness."""
    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def fn(rows):
        out: list[tuple] = []
        size, last = 0, (None, None)  # the fingerprint made for the row before, as its next
        for i, t, nxt in rows:
            own = last[1] if last[0] is not None and last[0] == t else winnow(t, k, window)
            other = winnow(nxt, k, window)
            last = (nxt, other)
            e = edited(t, nxt)
            ed = winnow(e, k, window)
            a, b, c = np.unique(own[0]), np.unique(ed[0]), np.unique(other[0])
            out.append((i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_string(*own), as_string(*ed), likeness(a, b), likeness(a, c)))
            size += len(t)
            if size > 4_000_000 or len(out) >= 2000:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=_arrow(schema))
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=_arrow(schema))

    return with_next(docs, fn, schema, doc_id, text)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in schema.split(", "))])
