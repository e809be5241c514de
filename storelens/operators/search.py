"""Similarity and search over reviews: topic grouping (G1), nearest reviews
to a query set (G2), keyword search for technical faults (G3).

No operator here pairs reviews with each other.  Vectors are scored against a
stated set of query/centroid vectors in blocks of bounded size (shipped with the
task) by a NumPy matrix product per Arrow batch; no join at all.  A vector without
a cosine (zero or not a number) matches nothing.
Top-k is exact in phases: k per query per batch, then per (query, salt), then
per query, so one popular query never lands in one task with all rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query/centroid vectors of one block; a larger set takes one pass over the vectors a block.
BLOCK_VECTORS = 4096
TOPK_SALTS = 64

# Technical-fault keywords searched in review text (en, fr, de, es).
FAULT_TERMS = [
    "crash", "crashes", "bug", "bugs", "error", "errors", "freeze", "freezes", "slow",
    "login", "battery", "update", "broken", "fail", "failed", "timeout", "token",
    "erreur", "panne", "lent", "fehler", "absturz", "langsam", "fallo", "lento",
]


def centroids(vectors: DataFrame, group: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per group: per-dimension averages (partial aggregation on
    (group, dim)), reassembled in dimension order."""
    dims = vectors.select(group, F.posexplode(vec).alias("i", "x"))
    per_dim = dims.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return (per_dim.groupBy(group)
                   .agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_d"))
                   .select(F.col(group).alias("qid"), F.transform("_d", lambda s: s["m"]).alias("qvec")))


def _query_blocks(queries: DataFrame):
    """(qids sorted, matrix) of each block of about ``BLOCK_VECTORS`` query vectors."""
    import numpy as np
    q = queries.select(F.col("qid").cast("long").alias("qid"), "qvec")
    blocks = max(1, -(-q.count() // BLOCK_VECTORS))
    for k in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k).orderBy("qid").collect()
        if rows:
            mat = np.array([list(r["qvec"]) for r in rows], dtype=np.float64).reshape(len(rows), -1)
            yield np.array([r["qid"] for r in rows], dtype=np.int64), mat


def _all_blocks(queries: DataFrame, one, schema) -> DataFrame:
    """``one(qids, matrix)`` of every block, together."""
    out = None
    for qids, mat in _query_blocks(queries):
        part = one(qids, mat)
        out = part if out is None else out.unionByName(part)
    return queries.sparkSession.createDataFrame([], schema) if out is None else out


def _batch_matrix(batch, vec: str):
    """Arrow list<float> column -> (n, d) float64 matrix (no per-row Python)."""
    import numpy as np
    col = batch.column(vec)
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1)


def _cosines(x, qmat):
    import numpy as np
    xn = np.linalg.norm(x, axis=1)
    qn = np.linalg.norm(qmat, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (x @ qmat.T) / (xn[:, None] * qn[None, :])


def candidates(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id",
               vec: str = "embedding") -> DataFrame:
    """(id, qid, similarity) of each Arrow batch's k best vectors per query.

    Vectors are scored in NumPy (one matrix product per batch); only k rows
    per query and batch leave the task, so the exact global top-k needs to
    shuffle a tiny fraction of the data."""
    import numpy as np
    import pyarrow as pa
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("qid", T.LongType()),
                           T.StructField("similarity", T.DoubleType())])

    def one(qids, qmat):
        def run(batches):
            for b in batches:
                ids = b.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)
                sims = _cosines(_batch_matrix(b, vec), qmat)
                out_id, out_q, out_s = [], [], []
                for j, q in enumerate(qids):
                    some = np.flatnonzero(~np.isnan(sims[:, j]))
                    order = some[np.lexsort((ids[some], -sims[some, j]))[:k]]   # similarity desc, id asc
                    out_id.append(ids[order])
                    out_q.append(np.full(len(order), q, dtype=np.int64))
                    out_s.append(sims[order, j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_q)),
                     pa.array(np.concatenate(out_s))], names=[id_col, "qid", "similarity"])

        return vectors.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), vec).mapInArrow(run, schema)

    return _all_blocks(queries, one, schema)


def top_k_per_query(scored: DataFrame, k: int, id_col: str = "vec_id", salts: int = TOPK_SALTS) -> DataFrame:
    """Exact top-k per qid in two phases: top-k inside (qid, salt) groups, then
    top-k over the <= k*salts survivors.  Ties broken by id."""
    order = [F.col("similarity").desc(), F.col(id_col)]
    s = scored.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)))
    local = s.withColumn("_r", F.row_number().over(Window.partitionBy("qid", "_salt").orderBy(*order))) \
             .where(F.col("_r") <= k)
    return (local.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
                 .where(F.col("rank") <= k).drop("_salt", "_r"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id") -> DataFrame:
    """The k most similar vectors to each query vector (cosine)."""
    return top_k_per_query(candidates(vectors, queries, k, id_col), k, id_col)


def group_by_topic(vectors: DataFrame, topics: DataFrame, id_col: str = "vec_id",
                   vec: str = "embedding") -> DataFrame:
    """G1: each vector joins the group of its most similar topic vector (ties ->
    lowest topic id).  One matrix product and argmax per Arrow batch and block of
    topics; only several blocks need a shuffle, of one row a vector and block."""
    import numpy as np
    import pyarrow as pa
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("group_id", T.LongType()),
                           T.StructField("similarity", T.DoubleType())])
    blocks = []

    def one(qids, qmat):
        blocks.append(len(qids))

        def run(batches):
            for b in batches:
                ids = b.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)
                sims = _cosines(_batch_matrix(b, vec), qmat)
                some = np.flatnonzero(~np.isnan(sims).all(axis=1))
                best = np.argmax(np.where(np.isnan(sims), -np.inf, sims)[some], axis=1)  # first max = lowest qid
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array(qids[best]), pa.array(sims[some, best])],
                    names=[id_col, "group_id", "similarity"])

        return vectors.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), vec).mapInArrow(run, schema)

    out = _all_blocks(topics, one, schema)
    if len(blocks) < 2:
        return out
    best = F.max_by(F.struct("group_id", "similarity"), F.struct("similarity", (-F.col("group_id")).alias("g"))).alias("b")
    return out.groupBy(id_col).agg(best).select(id_col, "b.group_id", "b.similarity")


def keyword_faults(reviews: DataFrame, terms: list[str] | None = None, text: str = "content",
                   id_col: str = "external_review_id") -> DataFrame:
    """Mentions and distinct reviews per fault keyword over whole texts.

    One regex pass per text returns only the tokens that are terms, so only
    hits are exploded; every term is reported (zero when unseen)."""
    terms = terms or FAULT_TERMS
    # a term matches exactly when it is a whole token (maximal letter/digit run)
    alt = "|".join(sorted({re.escape(t) for t in terms}, key=lambda t: (-len(t), t)))
    pattern = rf"(?U)(?<![\p{{L}}\p{{N}}])({alt})(?![\p{{L}}\p{{N}}])"
    hits = reviews.select(
        id_col, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), 1)).alias("term"))
    counts = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_mentions"),
                                      F.countDistinct(id_col).alias("n_reviews"))
    spark = reviews.sparkSession
    all_terms = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    return (all_terms.join(counts, "term", "left")
                     .select("term", F.coalesce("n_mentions", F.lit(0)).cast("long").alias("n_mentions"),
                             F.coalesce("n_reviews", F.lit(0)).cast("long").alias("n_reviews")))
