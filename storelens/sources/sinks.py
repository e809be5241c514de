"""Sinks: month-partitioned price history (S3), insert-if-absent reviews (S4),
catalogue update log and snapshots (S5), whole-batch commit of scrape results
(S6), CSV/JSON export (S8).

Every writer is idempotent under re-execution of the same input (foreachBatch
is at-least-once): rows carry deterministic ids and are anti-joined against
what the target already holds before appending.  Targets are plain Parquet
directories on the shared file system; nothing is read and overwritten in the
same plan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.operators import prices as P
from storelens.operators import reviews as R
from storelens.session import cut_lineage
from storelens.sources import catalogue as CAT

REVIEW_KEY = ["app_id", "external_review_id"]
REVIEW_BUCKETS = 256            # hash buckets of app_id = directories of the reviews table
ROWS_PER_FILE = 1_000_000       # a directory gets one more writer for each of these in a batch
BROADCAST_MAX_KEYS = 500_000    # batch keys shipped to every task only below this (checked)


def try_read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The table at ``path`` or None when it does not exist yet."""
    try:
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        return r.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def read_partitioned(spark: SparkSession, path: str, part_col: str) -> DataFrame:
    """Read a directory-partitioned table keeping the partition column a string
    (values such as 202601 would otherwise be inferred as integers, and a
    predicate on 'default' would no longer type-check).  Predicates on the
    column still prune directories."""
    return spark.read.parquet(path).withColumn(part_col, F.col(part_col).cast("string"))


def writers(counts: dict, column: str, rows_per_file: int):
    """Writers of each directory, by the batch's rows in it (a literal map: one entry a directory)."""
    pairs = [F.lit(x) for k, n in sorted(counts.items()) for x in (k, -(-n // rows_per_file))]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(1)) if pairs else F.lit(1)


# --- S3 ------------------------------------------------------------------------------------
def write_price_history(prices: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Append price observations into ``price_month=YYYYMM|default`` directories.

    A month gets a writer for every ``rows_per_file`` rows that the batch has in it
    (dealt by row id, so a hot app is not one writer's either), and each file is sorted by
    (app_id, ts) so Parquet min/max statistics skip row groups for app/time
    predicates (the BRIN / (app_id, ts) index of a row store).  Observations
    whose ``id`` is already stored in the same month are skipped.
    """
    spark = prices.sparkSession
    p = P.with_price_month(prices)
    existing = try_read(spark, path)
    counts = {r[0]: r[1] for r in p.groupBy("price_month").count().collect()}  # one row a month of the batch
    if existing is not None:
        months = sorted(counts)
        old = existing.withColumn("price_month", F.col("price_month").cast("string")) \
                      .where(F.col("price_month").isin(months))
        keys = p.select("id", "price_month")
        small = sum(counts.values()) <= BROADCAST_MAX_KEYS
        seen = old.select("id", "price_month").join(F.broadcast(keys) if small else keys,
                                                    ["id", "price_month"], "left_semi")
        p = p.join(seen, ["id", "price_month"], "left_anti")
    (p.withColumn("_w", F.pmod(F.xxhash64("id"), writers(counts, "price_month", rows_per_file)))
      .repartition("price_month", "_w")
      .sortWithinPartitions("app_id", "ts")
      .drop("_w")
      .write.mode("append").partitionBy("price_month").parquet(path))
    return p


def read_price_history(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Read with partition pruning: a ts range becomes a price_month predicate."""
    df = read_partitioned(spark, path, "price_month")
    if start is not None and end is not None:
        df = df.where(P.month_partition_filter(start, end) &
                      (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) &
                      (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    return df


def refresh_price_trends(spark: SparkSession, prices_path: str, trends_path: str, months: list[str]) -> DataFrame:
    """A4 as a materialised table: recompute the monthly trend rows of the given
    ``price_month`` values from the partitioned history (only those directories
    are read) and replace exactly those partitions of the trends table
    (dynamic partition overwrite); other months stay untouched."""
    src = read_partitioned(spark, prices_path, "price_month").where(F.col("price_month").isin(months))
    trends = P.price_trends(src.drop("price_month")).withColumn("trend_month", F.date_format("month", "yyyyMM"))
    (trends.repartition("trend_month")
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("trend_month").parquet(trends_path))
    return trends


# --- S4 ------------------------------------------------------------------------------------
def review_bucket(app_id_col) -> F.Column:
    return F.pmod(F.xxhash64(app_id_col), F.lit(REVIEW_BUCKETS)).cast("int")


def existing_keys(stored: DataFrame, batch_keys: DataFrame, key: list[str]) -> DataFrame:
    """Stored keys that also occur in the batch.

    Only the hash buckets the batch touches are read (partition pruning with
    a bounded literal list), and the batch keys are broadcast to the scan when
    a capped count proves them small; otherwise it is a shuffled semi join.
    The stored table itself is never shuffled whole for a small batch.
    """
    if "app_bucket" in stored.columns:
        buckets = [r[0] for r in batch_keys.select(review_bucket(F.col("app_id"))).distinct().collect()]
        stored = stored.where(F.col("app_bucket").isin(buckets))  # <= REVIEW_BUCKETS values
    small = batch_keys.limit(BROADCAST_MAX_KEYS + 1).count() <= BROADCAST_MAX_KEYS
    probe = F.broadcast(batch_keys) if small else batch_keys
    return stored.select(*key).join(probe, key, "left_semi")


def append_new_reviews(batch: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Insert-if-absent on (app_id, external_review_id), appended into
    ``app_bucket=`` directories.

    A bucket gets a writer for every ``rows_per_file`` rows that the batch has in it
    (dealt by review id, so a hot app is not one writer); files are sorted by (app_id,
    review_date) so row-group statistics serve per-app date-range reads (the
    (app_id, review_date) index of a row store), and carry a Parquet bloom
    filter on the review id for point lookups."""
    spark = batch.sparkSession
    stored = try_read(spark, path)
    new = batch
    if stored is not None:
        keys = batch.select(*REVIEW_KEY)
        new = batch.join(existing_keys(stored, keys, REVIEW_KEY), REVIEW_KEY, "left_anti")
    sort_cols = ["app_id"] + (["review_date"] if "review_date" in new.columns else [])
    new = new.withColumn("app_bucket", review_bucket(F.col("app_id")))
    counts = {r[0]: r[1] for r in batch.groupBy(review_bucket(F.col("app_id"))).count().collect()}  # <= REVIEW_BUCKETS rows
    (new.withColumn("_w", F.pmod(F.xxhash64("external_review_id"), writers(counts, "app_bucket", rows_per_file)))
        .repartition("app_bucket", "_w")
        .sortWithinPartitions(*sort_cols)
        .drop("_w")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#external_review_id", "true")
        .partitionBy("app_bucket").parquet(path))
    return new.drop("app_bucket")


# --- S5 ------------------------------------------------------------------------------------
def append_app_updates(updates: DataFrame, path: str, batch_id: int) -> None:
    """Log the app records of one batch (skipped when that batch is logged)."""
    spark = updates.sparkSession
    u = updates.withColumn("batch_id", F.lit(batch_id).cast("long"))
    old = try_read(spark, path)
    if old is not None:
        u = u.join(old.where(F.col("batch_id") == batch_id).select("app_id", "batch_id"),
                   ["app_id", "batch_id"], "left_anti")
    u.write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, base: str, snapshot_id: str) -> str:
    """Write a full table version into its own directory (never over the input)."""
    out = f"{base.rstrip('/')}/snapshot={snapshot_id}"
    df.write.mode("overwrite").parquet(out)
    return out


# --- S6 ------------------------------------------------------------------------------------
def commit_scrape_batch(results: DataFrame, root: str, batch_id: int, tables=("prices", "reviews", "apps")) -> None:
    """Fan one batch of scrape results out to the tables (``tables``: those wanted).

    ``results`` rows: app_id, captured_at, success, app struct, price struct, reviews
    array (output of ``extract.scrape_results`` plus the app id).  Where pages of one
    app disagree, the capture time decides, then the page id and the place on the page.
    Failed pages write nothing.  Re-running a batch id appends nothing twice.  App
    records go to the log and, if ``root`` has a catalogue, into its version ``batch_id`` + 1.
    """
    root = root.rstrip("/")
    # The writes below read the same extracted pages; a reliable checkpoint
    # in the shared spark.checkpoint.dir survives executor loss without re-running
    # the HTML extraction.
    ok = cut_lineage(results.where("success"))
    try:
        if "prices" in tables:
            write_price_history(ok.where(F.col("price").isNotNull()).select(
                # one row a scrape: page, app, region, currency and instant name it
                F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), F.col("app_id").cast("string"), "price.region",
                                   "price.currency", F.col("price.ts").cast("string")), 256).alias("id"), "app_id",
                F.col("price.price").alias("price"), F.col("price.currency").alias("currency"),
                F.col("price.region").alias("region"), F.col("price.ts").alias("ts")), f"{root}/price_history")
        if "reviews" in tables:
            raw = ok.select("app_id", "captured_at", "page_id", F.posexplode("reviews").alias("at", "r")).select(
                "app_id", F.struct("captured_at", "page_id", "at").alias("pos"), "r.external_review_id", "r.rating", "r.title", "r.content",
                "r.author_name", "r.review_date")
            append_new_reviews(R.merge_batch_reviews(raw), f"{root}/reviews")
        if "apps" in tables:
            last = F.max_by("app", F.struct("captured_at", "page_id"))
            apps = ok.where(F.col("app").isNotNull()).groupBy("app_id").agg(last.alias("app")).select("app_id", "app.*").drop("bundle_id")
            append_app_updates(apps, f"{root}/app_updates", batch_id)
            if CAT.manifest(apps.sparkSession, f"{root}/catalogue") is not None:
                CAT.apply_updates(apps, f"{root}/catalogue", batch_id + 1)
    finally:
        ok.unpersist()  # no-op for checkpointed data; files are cleaned when unreferenced


# --- S7/S8 ----------------------------------------------------------------------------------
def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Struct/array/map columns become JSON text (CSV has no nested types)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt == "csv":
        flatten_for_csv(df).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")
