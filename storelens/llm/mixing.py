"""Mixing sources to target weights (operator 3) by Poisson replication.

Each source has a mean repetition rate: its target share of the corpus over
its present share.  A document's count is the Poisson quantile of a uniform
number hashed from its id and the seed, so it depends on nothing else; the
document is written that many times, and every copy gets a hashed place in the
global order.  Built-in functions only.

Defined cases: a null text has size 0; null sources form one source; a source
without any bytes, or without a target weight, has rate 0 unless no source has
bytes (then rate 1); a row without id is hashed by its text instead; equal rows get equal counts; an empty table gives an empty
table; other columns pass through, but ``ADDED`` names are replaced.  No cap: the quantile table of a source ends
where the remaining probability is below the resolution of the uniform number.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SEED = 20240229
TEMPERATURE = 0.5  # target share of a source ~ its size to this power, when no weights are given
BITS = 52  # of the uniform number, exact in a double
ADDED = ("copy", "copies", "place")
# A table of rates up to this many sources is broadcast (about 100 bytes a row and
# quantile); beyond it the join is shuffled, with the documents salted by id.
BROADCAST_SOURCES, SALTS = 1000, 64
BROADCAST_RATE = 50.0


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) hashed from the parts, with 52 bits."""
    hexed = F.substring(F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])), 1, BITS // 4)
    return F.conv(hexed, 16, 10).cast("long") / F.lit(float(1 << BITS))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE,
          text: str = "text", source: str = "source") -> DataFrame:
    """One row per source: its bytes and its mean repetition rate (target share over present share)."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    per = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("bytes"))
    if weights is None:
        w = F.pow(F.col("bytes").cast("double"), F.lit(float(temperature)))
    else:
        w = F.coalesce(*[F.when(F.col("source") == F.lit(k), F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    per = per.select("source", "bytes", F.when(F.col("bytes") > 0, w).otherwise(0.0).alias("weight"))
    sums = per.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))  # one row
    all_bytes, all_weight = sums.select("all_bytes").scalar(), sums.select("all_weight").scalar()
    rate = F.when(all_weight > 0, F.when(F.col("bytes") > 0, F.col("weight") / all_weight
                  * all_bytes / F.col("bytes")).otherwise(0.0)).otherwise(1.0)
    return per.select("source", "bytes", rate.alias("rate"))


def quantiles(per_source: DataFrame) -> DataFrame:
    """``rates`` with the ascending Poisson distribution function of each rate.

    Terms are taken in logarithms, so large rates don't underflow.  A rate of r
    has about r + 10 sqrt(r) + 40 steps; the rest has probability below 2^-52.
    """
    steps = (F.col("rate") + 10 * F.sqrt("rate") + 40).cast("int")
    k = per_source.select("*", F.explode(F.sequence(F.lit(0), steps)).alias("k"))
    by = W.partitionBy("source").orderBy("k")
    term = F.when(F.col("k") > 0, F.log("rate") - F.log(F.col("k").cast("double"))).otherwise(-F.col("rate"))
    k = k.where((F.col("rate") > 0) | (F.col("k") == 0))
    k = k.select("*", F.exp(F.sum(term).over(by)).alias("p"))
    k = k.select("source", "rate", "k", F.sum("p").over(by).alias("cdf"))
    return k.groupBy("source").agg(F.first("rate").alias("rate"), F.sort_array(F.collect_list("cdf")).alias("cdf"))


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE,
              seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source",
              parts: int | None = None) -> DataFrame:
    """Every copy of every document, dealt over the partitions in the hashed global order.

    Adds ``copy`` (from 0), ``copies`` and ``place`` in [0, 1): ordering by it is
    the shuffled corpus; partitions hold ascending ranges of it.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    per = rates(docs, weights, temperature, text, source)
    table = quantiles(per)
    # the size of the broadcast side is measured, not assumed
    size = per.agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("top")).first()
    small = size["n"] <= BROADCAST_SOURCES and (size["top"] or 0.0) <= BROADCAST_RATE
    table = table.select(F.col("source").alias("__source"), "cdf")
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.concat(F.lit("null"), F.coalesce(F.md5(F.col(f"`{text}`").cast("binary")), F.lit(""))))
    if small:
        joined = docs.join(F.broadcast(table), F.col(f"`{source}`").eqNullSafe(F.col("__source")), "left")
    else:
        salted = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        joined = docs.withColumn("__slot", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(
            salted, F.col(f"`{source}`").eqNullSafe(F.col("__source")) & (F.col("__slot") == F.col("__salt")), "left")
    u = uniform(str(seed), key)
    count = F.coalesce(F.size(F.filter("cdf", lambda c: c <= F.col("__u"))), F.lit(0))
    counted = joined.select(*[F.col(f"`{c}`") for c in kept], u.alias("__u"), "cdf").select(
        *[F.col(f"`{c}`") for c in kept], count.cast("long").alias("copies"))
    copies = counted.where("copies > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    place = uniform(str(seed), "place", key, F.col("copy").cast("string"))
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    # places are uniform, so equal ranges are equal shares: no sampling pass, and no key can be hot
    return copies.withColumn("place", place).repartitionById(
        parts, F.floor(F.col("place") * parts).cast("int")).sortWithinPartitions("place")
