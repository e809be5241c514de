"""G1: groups of similar reviews, by random-projection hash tables.

A table's key is the signs of a vector's products with random planes: two vectors of
cosine ``threshold`` agree on a sign with probability p = 1 - acos(threshold) / pi, so
they share a key of b bits in one of ``tables`` tables but for (1 - p^b)^tables.  b leaves
``ROWS`` vectors in a bucket on the mean, the number of tables follows from ``miss``; both
grow with the data (tables by n^0.22 at 0.9), and neither caps a bucket.

What travels to the buckets is a vector's sketch: its unit vector in 16-bit steps, whose products
bound the cosine from both sides (``_slack``).  A bucket of up to ``BUCKET`` vectors compares all
its pairs by sketches: those similar beyond doubt are linked, each with the smallest id that it
is connected with there.  The few pairs that the bounds leave open are compared exactly, by vector.

In a larger bucket a round names one leader (a minimum, combined before the shuffle) and sends its
sketch to the bucket's vectors where they are; those that are similar are linked and leave; the rest
goes on, split by two more bits of the same key, until its buckets are small.  A bucket of
copies so ends after one round, whatever its size, and a round takes at least the leader out
of each bucket.  Groups are what links connect, named by their smallest id; out come members
with their group, never pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.session import cut_lineage

ROWS = 512      # vectors of a bucket on the mean
BUCKET = 2048   # vectors of a bucket whose pairs are compared in one piece
PART = 1024     # members of a group that meet its row in one part
MORE_BITS = 2   # bits that a large bucket's rest is split by in the next round
KEY_BITS = 60
STEPS = 32767   # of a sketch, in a unit
BLOCK = 512     # vectors compared with their bucket's at once


def table_shape(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors: two of cosine ``threshold`` share no key with probability ``miss``."""
    bits = min(max(4, math.ceil(math.log2(max(2, n / ROWS)))), KEY_BITS)
    p = 1 - math.acos(threshold) / math.pi
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-(p ** bits))))


def _slack(dims: int) -> float:
    """How far the product of two sketches can be from the cosine (rounding, then sums of 32-bit floats)."""
    e = 0.5 / STEPS
    return 2 * e * math.sqrt(dims) + dims * e * e + dims * 2.0 ** -22


def _matrix(col, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dims)


def _sketch(x: np.ndarray) -> list[bytes]:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return [r.tobytes() for r in np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) * STEPS).astype("<i2")]


def _units(col) -> np.ndarray:
    """The vectors of a column of sketches, as 32-bit floats."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype="<i2").reshape(len(col), -1).astype(np.float32) / np.float32(STEPS)


def _sketches(vectors: DataFrame, dims: int) -> DataFrame:
    """(id, q): each vector's sketch."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_sketch(_matrix(b.column(1), dims)), pa.binary())], names=["id", "q"])

    return vectors.select("id", "v").mapInArrow(run, "id long, q binary")


def _hashed(vectors: DataFrame, dims: int, tables: int, seed: int, sketched: bool) -> DataFrame:
    """(id, t, key) and, if ``sketched``, q: the ``KEY_BITS`` signs of each vector in each table."""
    def run(batches):
        rng = np.random.default_rng(seed)
        planes = rng.standard_normal((tables, dims, KEY_BITS))
        powers = np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), dims)
            more = {"q": pa.array(_sketch(x), pa.binary())} if sketched else {}
            for t in range(tables):
                keys = ((x @ planes[t]) > 0).astype(np.int64) @ powers
                yield pa.RecordBatch.from_pydict({"id": b.column(0), "t": pa.array(np.full(len(keys), t, dtype=np.int32)), "key": pa.array(keys), **more})

    return vectors.select("id", "v").mapInArrow(run, "id long, t int, key long" + (", q binary" if sketched else ""))


def _with_leader(rows: DataFrame, threshold: float, slack: float) -> DataFrame:
    """(id, t, key, q, leader, near) of rows with their leader's sketch ``lq``: near is 2 if similar, 0 if not, 1 if the sketches can't tell."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                cosine = np.einsum("ij,ij->i", _units(b.column(3)), _units(b.column(5)))
                near = (cosine >= threshold - slack).astype(np.int32) + (cosine >= threshold + slack)
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(near, pa.int32())], names=["id", "t", "key", "q", "leader", "near"])

    return rows.select("id", "t", "key", "q", "leader", "lq").mapInArrow(run, "id long, t int, key long, q binary, leader long, near int")


def bucket_links(ids: np.ndarray, x: np.ndarray, threshold: float, slack: float) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(ids, ids, sure) of one bucket, sorted by id: what is surely connected with its smallest id, and open pairs of what isn't connected."""
    m = len(ids)
    sure, open_ = np.empty((m, m), dtype=bool), np.empty((m, m), dtype=bool)
    for s in range(0, m, BLOCK):
        cosine = x[s:s + BLOCK] @ x.T
        sure[s:s + BLOCK] = cosine >= threshold + slack
        open_[s:s + BLOCK] = (cosine >= threshold - slack) & ~sure[s:s + BLOCK]
    np.fill_diagonal(sure, False)
    top, left = np.arange(m), sure.any(axis=1)
    for i in np.flatnonzero(left).tolist():
        if left[i]:
            left[i], todo = False, [i]
            while todo:
                more = np.flatnonzero(sure[todo.pop()] & left)
                left[more], top[more] = False, i
                todo.extend(more.tolist())
    out, at = [], np.flatnonzero(top != np.arange(m))
    if len(at):
        out.append((ids[at], ids[top[at]], True))
    a, b = np.nonzero(np.triu(open_, 1))
    apart = top[a] != top[b]
    if apart.any():
        out.append((ids[b[apart]], ids[a[apart]], False))
    return out


def _in_buckets(rows: DataFrame, threshold: float, slack: float) -> DataFrame:
    """(id, leader, sure) of the buckets ``place``, ``bucket`` of rows (id, q); one bucket is held at a time."""
    def run(batches):
        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                if not b.num_rows:
                    continue
                held = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            if held is None:
                return
            place, bucket = (held.column(c).to_numpy() for c in ("place", "bucket"))
            edge = np.flatnonzero((place[1:] != place[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            begin = [0, *edge.tolist()]
            end = [*begin[1:], len(place)] if b is None else begin[1:]  # the last one may go on
            for s, e in zip(begin, end, strict=False):
                if e - s > 1:
                    of = held.slice(s, e - s)
                    for one, other, sure in bucket_links(of.column("id").to_numpy(), _units(of.column("q")), threshold, slack):
                        yield pa.RecordBatch.from_pydict({"id": pa.array(one), "leader": pa.array(other), "sure": pa.array(np.full(len(one), sure))})
            held = held.slice(begin[-1]).combine_chunks()

    rows = rows.repartition("place", "bucket").sortWithinPartitions("place", "bucket", "id")
    return rows.select("id", "q", "place", "bucket").mapInArrow(run, "id long, leader long, sure boolean")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _similarity(pairs: DataFrame, vectors: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the exact cosine of the vectors that ``a`` and ``b`` name."""
    va = vectors.select(F.col("id").alias(a), F.col("v").alias("_va"), F.col("norm").alias("_na"))
    vb = vectors.select(F.col("id").alias(b), F.col("v").alias("_vb"), F.col("norm").alias("_nb"))
    return (pairs.join(va, a).join(vb, b)
                 .withColumn("similarity", _dot(F.col("_va"), F.col("_vb")) / (F.col("_na") * F.col("_nb")))
                 .drop("_va", "_vb", "_na", "_nb"))


def links(vectors: DataFrame, dims: int, threshold: float, miss: float, seed: int = 17) -> DataFrame:
    """(id, leader) of vectors that a chain of at least ``threshold`` similar ones connects in some bucket."""
    n = vectors.count()
    bits, tables = table_shape(n, threshold, miss)
    slack = _slack(dims)
    keys, rest = (_hashed(vectors, dims, tables, seed, sketched) for sketched in (False, True))
    found, small, rounds = None, None, 0
    while True:
        bucket = F.shiftright("key", max(0, KEY_BITS - bits - MORE_BITS * rounds))
        large = cut_lineage(keys.groupBy("t", bucket.alias("bucket")).agg(
            F.min_by("id", F.xxhash64("id", "t")).alias("leader"), F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).drop("n"))
        last = large.isEmpty()
        rest = rest.withColumn("bucket", bucket)
        # at most n * tables / BUCKET rows
        done = rest if last else rest.join(F.broadcast(large), ["t", "bucket"], "left_anti")
        done = done.select("id", "q", (F.col("t") * 1000 + rounds).alias("place"), "bucket")
        small = done if small is None else small.unionByName(done)
        if last:
            break
        lead = _sketches(vectors.join(F.broadcast(large.select(F.col("leader").alias("id")).distinct()), "id", "left_semi"), dims)
        lead = large.join(lead.select(F.col("id").alias("leader"), F.col("q").alias("lq")), "leader").dropDuplicates(["t", "bucket"])
        met = cut_lineage(_with_leader(rest.join(F.broadcast(lead), ["t", "bucket"]).where("id <> leader"), threshold, slack))
        near = met.where("near > 0").select("id", "leader", (F.col("near") == 2).alias("sure"))
        found = near if found is None else found.unionByName(near)
        keys = rest = met.where("near < 2").select("id", "t", "key", "q")
        rounds += 1
    near = _in_buckets(small, threshold, slack)
    found = near if found is None else found.unionByName(near)
    found = cut_lineage(found.where("id <> leader").distinct())
    exact = _similarity(found.where("NOT sure").select("id", "leader"), vectors, "id", "leader")
    return found.where("sure").select("id", "leader").unionByName(
        exact.where(F.col("similarity") >= threshold).select("id", "leader")).distinct()


def smallest_connected(edges: DataFrame) -> DataFrame:
    """(id, group_id): the smallest id that ``edges`` (id, leader) connect each end with.

    Each round both ends take the smaller of their labels, then every label its own
    label's; labels only fall, and the rounds end when none does."""
    edges = cut_lineage(edges.select(F.col("id").alias("a"), F.col("leader").alias("b")))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut_lineage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")))
    while True:
        seen = both.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        new = label.join(seen, "a").select("a", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        up = new.select(F.col("a").alias("l"), F.col("l").alias("top"))
        new = cut_lineage(new.join(up, "l").select("a", F.least("l", "top").alias("l"), "was"))
        label = new.select("a", "l")
        if new.where("l <> was").isEmpty():
            return label.select(F.col("a").alias("id"), F.col("l").alias("group_id"))


def group_similar(vectors: DataFrame, threshold: float = 0.9, miss: float = 0.02, id_col: str = "vec_id",
                  vec: str = "embedding") -> DataFrame:
    """One row a vector: ``id_col``, group_id (smallest id of its group), group_size and
    the cosine with that vector (1 for the vector itself).

    Ids are unique.  A vector without a cosine (null, zero, holding null or a non-finite
    number, or of another length than the longest) is its own group without a similarity."""
    if not 0 < threshold < 1:
        raise ValueError("threshold lies between 0 and 1")
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    dims = every.agg(F.max(F.size("v"))).first()[0] or 0
    norm = F.sqrt(_dot(F.col("v"), F.col("v")))
    good = cut_lineage(every.where("id IS NOT NULL").where(F.size("v") == dims).withColumn("norm", norm)
                       .where("norm > 0 AND NOT isnan(norm) AND norm < double('infinity')"))
    linked = smallest_connected(links(good, dims, threshold, miss))
    # one row a group with its first vector, a huge one's in several copies: its members meet it in as many tasks
    sizes = linked.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")).withColumn("_n", F.ceil(F.col("group_size") / PART).cast("int"))
    first = good.select(F.col("id").alias("group_id"), F.col("v").alias("_vg"), F.col("norm").alias("_ng"))
    groups = sizes.join(first, "group_id").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    parts = F.broadcast(sizes.where("_n > 1").select("group_id", "_n"))  # at most members / PART rows
    salted = linked.join(parts, "group_id", "left").withColumn("_s", F.pmod(F.xxhash64("id"), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    cosine = _dot(F.col("v"), F.col("_vg")) / (F.col("norm") * F.col("_ng"))
    member = (salted.join(good, "id").join(groups, ["group_id", "_s"])
                    .select("id", "group_id", "group_size", F.when(F.col("id") == F.col("group_id"), F.lit(1.0)).otherwise(cosine).alias("similarity")))
    has = good.select("id", F.lit(1.0).alias("own"))
    return (every.select("id").join(member, "id", "left").join(has, "id", "left")
                 .select(F.col("id").alias(id_col), F.coalesce("group_id", "id").alias("group_id"),
                         F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         F.coalesce("similarity", "own").alias("similarity")))
