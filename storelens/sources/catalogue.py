"""The app catalogue as bucketed copy-on-write versions.

    data/v=<version>/bucket=<b>/     the rows of a bucket as that version wrote them
    versions/v=<version>/            manifest: for every bucket the version that holds its rows

An update reads and writes the buckets of its own apps only; the manifest of the
new version points to the old files for all others.  The manifest is written
last, so readers see a version whole or not at all, and a version written again
(a batch that runs twice) starts from the same parent and replaces itself.
Versions grow in the order of the batches; one writer commits at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.operators import catalog as C

ROWS_PER_BUCKET = 100_000  # an update rewrites whole buckets, a read opens one file each
BUCKETS = (8, 4096)  # fewest and most buckets of a new catalogue


def bucket_of(app_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(app_id.cast("string")), F.lit(buckets)).cast("int")


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/versions")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def manifest(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int] | None:
    """{bucket: data version} of the newest version (older than ``before``); None if there is none."""
    m = _manifests(spark, root)
    if m is None:
        return None
    m = m if before is None else m.where(F.col("v") < before)
    newest = m.agg(F.max("v")).first()[0]
    if newest is None:
        return None
    return {r["bucket"]: r["data_v"] for r in m.where(F.col("v") == newest).collect()}  # one row a bucket


def write_version(spark: SparkSession, rows: DataFrame, root: str, version: int, buckets: int, held: dict[int, int]) -> None:
    """The rows (key column ``id``) of some buckets, then the manifest of all."""
    (rows.withColumn("bucket", bucket_of(F.col("id"), buckets)).repartition("bucket").sortWithinPartitions("id")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/v={version}"))
    (spark.createDataFrame(sorted(held.items()), "bucket int, data_v long").coalesce(1)
          .write.mode("overwrite").parquet(f"{root}/versions/v={version}"))


def create(apps: DataFrame, root: str, buckets: int | None = None) -> None:
    """Version 0: the whole catalogue (one row an id, at least one row), in buckets by its number of rows if none is given."""
    if buckets is None:
        low, high = BUCKETS
        buckets = min(high, max(low, -(-apps.count() // ROWS_PER_BUCKET)))
    write_version(apps.sparkSession, apps, root, 0, buckets, dict.fromkeys(range(buckets), 0))


def read_buckets(spark: SparkSession, root: str, held: dict[int, int], schema) -> DataFrame:
    """The rows of the buckets that ``held`` names, from the versions that hold them."""
    one_of = F.lit(False)
    for v in sorted(set(held.values())):  # literals: at most one a bucket
        one_of = one_of | ((F.col("v") == v) & F.col("bucket").isin(sorted(b for b, at in held.items() if at == v)))
    full = T.StructType([*schema.fields, T.StructField("v", T.LongType()), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(full).parquet(f"{root}/data").where(one_of).select(*schema.names)


def _read(spark: SparkSession, root: str, held: dict[int, int]) -> DataFrame:
    return read_buckets(spark, root, held, spark.read.parquet(f"{root}/data/v=0").drop("bucket").schema)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The catalogue as of a version, the newest by default."""
    held = manifest(spark, root, None if version is None else version + 1)
    if held is None:
        raise FileNotFoundError(f"no catalogue under {root}")
    return _read(spark, root, held)


def apply_updates(updates: DataFrame, root: str, version: int) -> None:
    """Apply scraped app records (one an app; rules of ``catalog.apps_merge``) as ``version``;
    apps that the catalogue lacks are left out."""
    spark = updates.sparkSession
    held = manifest(spark, root, version)
    if held is None:
        raise FileNotFoundError(f"no catalogue under {root}")
    touched = sorted(r[0] for r in updates.select(bucket_of(F.col("app_id"), len(held))).distinct().collect())  # <= buckets
    current = _read(spark, root, {b: held[b] for b in touched})
    merged = C.apps_merge(current, updates).select(*current.columns)
    write_version(spark, merged, root, version, len(held), held | dict.fromkeys(touched, version))
