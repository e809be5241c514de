"""Nearest neighbours by inner product (operator 11): stable projections, a kd-tree, a chi-square stop.

1. With a coordinate of sqrt(M^2 - |x|^2) added (M: the largest norm; a query gets 0), the nearest
   vector is that of the largest inner product: |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>.
2. ``DIMS`` Gaussian projections (2-stable, of a fixed seed) take each vector to a point.  For two
   vectors at distance d, the squared distance of their points is d^2 times a chi-square variable.
3. The points are indexed by a kd-tree.  Its upper levels are fitted on at most ``SAMPLE`` rows (those
   of smallest hashed id) and deal every row to a cell; cells are cut into pieces of
   about ``PIECE`` rows, whose lower levels are built from all their rows, down to leaves of ``LEAF`` points.
4. A query visits pieces, then leaves, by the distance of their boxes, nearest first, and verifies the points in
   them by inner products in double precision.  It stops once the chi-square distribution says that a vector nearer
   than the present k-th would have shown up by now with probability ``SURE``: box distance^2 >= quantile * d_k^2.

Queries go in blocks of at most ``QUERIES`` rows in the order of the cells (near ones together); a
block is broadcast, the index is scanned where it lies, and each task hands on its k best a query.
Copies of a vector: a piece keeps the k + 1 smallest ids of each distinct vector for the search, as no
more of them can be among the k nearest; all are indexed.

Defined cases: vectors null, empty, zero, or holding null or non-finite components take no part, nor do rows with
a null id; shorter vectors count as padded with zeros; rows repeated in id and vector count once; a query never finds
its own id, and an id of several vectors asks once for each; ties go to the smaller id; fewer candidates than
k: all; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.llm.common import keep

DIMS, SEED = 8, 20
SURE = 0.95
SAMPLE, CELLS = 16_384, 1_024
PIECE, LEAF, QUERIES = 2_048, 64, 8_192


def quantile(p: float, dims: int = DIMS) -> float:
    """x with P(chi-square of an even number of degrees <= x) = p."""
    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for j in range(1, dims // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def vectors(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v) of the rows that take part, components in double precision."""
    v = F.col(column).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(
        finite & F.exists("v", lambda x: x != 0))


class Space:
    """Projection of augmented vectors, and the cells that the upper kd-tree cuts."""

    def __init__(self, width: int, longest: float):
        import numpy as np

        self.width, self.longest = width, longest
        self.axes = np.random.default_rng(SEED).standard_normal((width + 1, DIMS))
        self.splits: list[tuple[int, float]] = []  # heap order: node i has children 2i + 1, 2i + 2

    def matrix(self, flat, sizes):
        """Rows of ``width`` components from flat ones, padded with zeros."""
        import numpy as np

        if len(sizes) and (sizes == self.width).all():
            return flat.reshape(len(sizes), self.width)
        out = np.zeros((len(sizes), self.width))
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return out

    def points(self, x, query: bool = False):
        import numpy as np

        out = x @ self.axes[:-1]
        if not query:
            out += np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))[:, None] * self.axes[-1]
        return out

    def fit(self, points, cells: int) -> None:
        """Median cuts along the widest side, for ``cells`` (a power of two) cells."""
        import numpy as np

        parts = [points]
        while len(self.splits) + 1 < cells:
            nxt = []
            for p in parts:
                side = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
                at = float(np.median(p[:, side])) if len(p) else 0.0
                self.splits.append((side, at))
                nxt += [p[p[:, side] <= at], p[p[:, side] > at]]
            parts = nxt

    def cell(self, points):
        import numpy as np

        node = np.zeros(len(points), dtype=np.int64)
        if self.splits:
            side, at = (np.array(x) for x in zip(*self.splits, strict=True))
            for _ in range(int(math.log2(len(self.splits) + 1))):
                node = 2 * node + 1 + (points[np.arange(len(points)), side[node]] > at[node])
        return node - len(self.splits)


def _read(space: Space, batch):
    """(ids, vectors) of an Arrow batch with id and v."""
    import numpy as np

    v = batch.column(batch.schema.get_field_index("v"))
    ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
    return ids, space.matrix(v.flatten().to_numpy(), np.diff(v.offsets.to_numpy()))


def _dealt(space: Space):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                _, x = _read(space, batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(space.cell(space.points(x)))], names=["id", "v", "cell"])
    return run


def _leaves(points, rows):
    """Index lists of the leaves of a kd-tree over some points."""
    import numpy as np

    if len(rows) <= LEAF:
        return [rows]
    p = points[rows]
    side = int(np.argmax(np.ptp(p, axis=0)))
    order = np.argsort(p[:, side], kind="stable")
    half = len(rows) // 2
    return _leaves(points, rows[order[:half]]) + _leaves(points, rows[order[half:]])


def _piece(space: Space, k: int):
    """One row a piece: ids, vectors, the points' leaves and boxes, as bytes of arrays."""
    def run(key, table):
        import numpy as np
        import pyarrow as pa

        batch = table.combine_chunks().to_batches()[0]
        ids, x = _read(space, batch)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        _, same = np.unique(x, axis=0, return_inverse=True)
        by = np.argsort(same.ravel(), kind="stable")  # copies together, ids ascending
        s = same.ravel()[by]
        start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        nth = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
        use = np.sort(by[nth <= k])
        ids, x = ids[use], x[use]
        p = space.points(x)
        leaves = _leaves(p, np.arange(len(ids)))
        order = np.concatenate(leaves)
        ends = np.cumsum([len(r) for r in leaves])
        boxes = np.stack([np.concatenate((p[r].min(0), p[r].max(0))) for r in leaves])
        small = x.astype(np.float32)  # stored in single precision where that is exact
        data = small if (small == x).all() else x
        arrays = (ids[order].astype("<i8"), data[order], ends.astype("<i8"), boxes)
        return pa.table({"cell": [key[0].as_py()], "n": [len(ids)], "bytes": [data.dtype.itemsize],
                         **{name: [v.tobytes()] for name, v in zip(("ids", "x", "ends", "boxes"), arrays, strict=True)}})
    return run


PIECES = "cell long, n long, bytes long, ids binary, x binary, ends binary, boxes binary"


class Search:
    """The k best of a block of queries, piece by piece."""

    def __init__(self, space: Space, ids, q, k: int):
        import numpy as np

        self.space, self.ids, self.q, self.k = space, ids, q, k
        self.p, self.bound = space.points(q, query=True), quantile(SURE)
        self.base = (q * q).sum(1) + space.longest
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def open(self, rows, box2):
        """Which of ``rows`` go on, by the chi-square test at the squared box distances."""
        import numpy as np

        kth = self.score[rows, -1]
        d2 = np.maximum(self.base[rows] - 2 * kth, 0)  # infinite as long as fewer than k are found
        return box2 <= self.bound * d2

    def piece(self, ids, x, ends, boxes) -> None:
        import numpy as np

        lo, hi = boxes[:, :DIMS], boxes[:, DIMS:]
        gap = np.maximum(np.maximum(lo.min(0) - self.p, self.p - hi.max(0)), 0)
        rows = np.flatnonzero(self.open(np.arange(len(self.ids)), (gap * gap).sum(1)))
        if not len(rows):
            return
        box2 = np.zeros((len(rows), len(ends)))
        for d in range(DIMS):
            p = self.p[rows, d][:, None]
            gap = np.maximum(np.maximum(lo[:, d] - p, p - hi[:, d]), 0)
            box2 += gap * gap
        order, begins = np.argsort(box2, axis=1, kind="stable"), np.append(0, ends[:-1])
        for step in range(len(ends)):  # the next leaf of each query that still looks
            leaf = order[:, step]
            going = self.open(rows, box2[np.arange(len(rows)), leaf])
            rows, box2, order, leaf = rows[going], box2[going], order[going], leaf[going]
            if not len(rows):
                return
            by = np.argsort(leaf, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(leaf[by]) != 0))
            pairs = [self.verify(rows[part], begins[leaf[part[0]]], ids[begins[leaf[part[0]]]:ends[leaf[part[0]]]], x[begins[leaf[part[0]]]:ends[leaf[part[0]]]])
                     for part in np.split(by, cut[1:])]
            row, at = (np.concatenate(c) for c in zip(*pairs, strict=True))
            if len(row):
                self.merge(row, ids[at], x[at])

    def verify(self, rows, begin, ids, x):
        """Pairs of a leaf that may enter a list; the product of matrices only rules out."""
        import numpy as np

        s = self.q[rows] @ x.T
        slack = 1e-9 * (1 + self.space.longest)
        r, c = np.nonzero((s >= self.score[rows, -1][:, None] - slack) & (ids[None, :] != self.ids[rows][:, None]))
        return rows[r], c + begin

    def merge(self, row, ids, x) -> None:
        """Scores in one fixed order of summing, then the k best of old and new; ties to the smaller id."""
        import numpy as np

        q, s = self.q[row], np.zeros(len(row))
        for d in range(x.shape[1]):
            s += q[:, d] * x[:, d]
        some = np.unique(row)
        row = np.concatenate((row, np.repeat(some, self.k)))
        s, ids = np.concatenate((s, self.score[some].ravel())), np.concatenate((ids, self.found[some].ravel()))
        order = np.lexsort((ids, -s, row))
        row, s, ids = row[order], s[order], ids[order]
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        nth = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        best = nth < self.k
        self.score[row[best], nth[best]], self.found[row[best], nth[best]] = s[best], ids[best]


def _searched(block, k: int):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        space, number, ids, q = block.value
        search = Search(space, ids, q, k)
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                n = col["n"][i].as_py()
                x = np.frombuffer(col["x"][i].as_py(), dtype=f"<f{col['bytes'][i].as_py()}").reshape(n, -1).astype(np.float64)
                ends = np.frombuffer(col["ends"][i].as_py(), dtype="<i8")
                search.piece(np.frombuffer(col["ids"][i].as_py(), dtype="<i8"), x, ends, np.frombuffer(col["boxes"][i].as_py()).reshape(len(ends), -1))
        r, c = np.nonzero(search.score > -np.inf)
        for at in range(0, len(r), 100_000):
            a, b = r[at:at + 100_000], c[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(number[a]), pa.array(search.ids[a]), pa.array(search.found[a, b]), pa.array(search.score[a, b])],
                                             names=["number", "query_id", "vec_id", "score"])
    return run


def index(rows: DataFrame, k: int) -> tuple[Space, DataFrame, DataFrame] | None:
    """The space, the pieces of all ``rows`` (id, v), and the rows with their cells; None for an empty table."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.max(norm2).alias("longest"), F.max(F.size("v")).alias("width")).first()
    if not facts["n"]:
        return None
    space = Space(facts["width"], facts["longest"])
    cells = 1
    while cells < CELLS and cells * PIECE < facts["n"]:
        cells *= 2
    if cells > 1:
        import numpy as np

        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
        x = space.matrix(np.array([c for r in sample for c in r["v"]]), np.array([len(r["v"]) for r in sample]))
        space.fit(space.points(x), cells)
    dealt = rows.mapInArrow(_dealt(space), "id long, v array<double>, cell long")
    count = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}  # at most CELLS rows
    parts = F.create_map(*[F.lit(c) for cell, n in sorted(count.items()) for c in (cell, -(-n // PIECE))])
    part = F.pmod(F.xxhash64("id", "v"), F.coalesce(F.try_element_at(parts, F.col("cell")), F.lit(1)))
    pieces = dealt.withColumn("part", part).groupBy("cell", "part").applyInArrow(_piece(space, k), PIECES)
    return space, keep(pieces), dealt


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id ``every`` divides."""
    import numpy as np

    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = keep(vectors(df, id_column, column).dropDuplicates(["id", "v"]))
    made = index(rows, k)
    if made is None:
        return spark.createDataFrame([], schema)
    space, pieces, dealt = made
    queries = dealt.where(F.col("id") % every == 0)
    # queries by cell, each cell's shuffled; a block takes the next QUERIES of them, more or less
    count = dict(queries.groupBy("cell").count().collect())
    starts, total = [], 0
    for cell, n in sorted(count.items()):
        starts += [F.lit(cell), F.struct(F.lit(total).alias("start"), F.lit(n).alias("n"))]
        total += n
    if not total:
        return spark.createDataFrame([], schema)
    where = F.try_element_at(F.create_map(*starts), F.col("cell"))
    shuffled = F.pmod(F.xxhash64("id", "v"), where["n"]) if total > QUERIES else F.lit(0)
    block = F.floor((where["start"] + shuffled) / QUERIES) if total > QUERIES else F.lit(0)
    queries = queries.select("id", "v", block.cast("long").alias("block"))
    out = None
    for b in range(-(-total // QUERIES)):
        got = queries.where(F.col("block") == b).select("id", "v").toArrow()  # QUERIES rows, and some by chance
        if not got.num_rows:
            continue
        ids, q = _read(space, got.combine_chunks().to_batches()[0])
        order = np.lexsort((*q.T[::-1], ids))
        sent = spark.sparkContext.broadcast((space, np.arange(len(ids)), ids[order], q[order]))
        best = pieces.mapInArrow(_searched(sent, k), "number long, query_id long, vec_id long, score double")
        rank = F.row_number().over(W.partitionBy("number").orderBy(F.col("score").desc(), "vec_id"))
        part = keep(best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        sent.unpersist()
        out = part if out is None else out.unionByName(part)
    return out
