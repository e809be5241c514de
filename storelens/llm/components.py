"""Connected components of an edge table, by alternating stars.

Every round hangs each node's larger neighbours on its smallest one (large star),
then its smaller neighbours and itself (small star), until only stars are left;
rounds grow with the logarithm of the longest chain.  Minima are combined before
the shuffle and a hub's rows are on one side of a plain join, which Spark can
split; the driver only learns whether a node is left that isn't settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import keep


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none: then each star is a component."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("x"), one.alias("hangs"), none.alias("holds")).unionByName(
        edges.select(F.col("b").alias("x"), none.alias("hangs"), one.alias("holds")))
    odd = ends.groupBy("x").agg(F.sum("hangs").alias("n"), F.max("holds").alias("m")).where("n > 1 or (n = 1 and m = 1)")
    return odd.isEmpty()


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a bigint, b bigint) that isn't the smallest of its component.

    Loops and repeated edges are ignored; an empty table gives an empty table.
    Each round's edges are written in ``parts`` files at most, if given.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = keep(e, parts=parts)
    while not _settled(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a").select(
            F.col("b").alias("a"), F.least("u", "m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.join(low, F.col("a") == F.col("u"))
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        e = keep(small, parts=parts)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
