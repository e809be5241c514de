"""Structured Streaming twins of the batch jobs (ST1-ST5).

* ST1 ``start_ingest``     captured pages -> extract -> validate -> commit
* ST2 ``dedupe_reviews``   review keys not stored before
* ST3 ``price_changes``    every price change of a series (batch twin: W2)
* ST4 / ST5 ``count_windows``  requests per caller and minute, failures per store
                           and hour (batch twins: the rate limit and A6)

Each is a ``foreachBatch`` step over a table below ``root`` with one folder per
micro-batch, written in overwrite mode: a batch that runs again after a failure
replaces its own rows, and nothing else.  Results don't depend on how the input
is cut into files or in which order they come: ST2 compares with the earlier keys of the
batch's apps, ST3 with the last price of the batch's series (late prices are put in
their places on read), ST4 and ST5 keep partial counts that add up on read.  No watermark drops a row, and
the newest window is there.  Checkpoints live under the caller's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.numeric import exact_ratio
from storelens.operators import extract as X
from storelens.plans import ordered as O
from storelens.sources import catalogue as CAT
from storelens.sources import sinks as S

# --- ST1 ----------------------------------------------------------------------------------------
PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("app_id", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("captured_at", T.TimestampNTZType()),
    T.StructField("html", T.StringType()),
])


def _commit(root: str, profile: X.PageProfile):
    def run(batch: DataFrame, batch_id: int) -> None:
        raw = X.extract_raw(batch, profile, keep=("app_id", "captured_at"))
        res = X.scrape_results(raw, F.col("captured_at"), keep=("app_id",))
        S.commit_scrape_batch(res, root, batch_id)
    return run


def start_ingest(spark, pages_dir: str, root: str, checkpoint: str,
                 profile: X.PageProfile = X.APPLE_PROFILE, files_per_trigger: int = 64,
                 available_now: bool = True):
    """ST1: watch ``pages_dir`` (Parquet files of PAGE_SCHEMA) and commit each
    micro-batch to the tables under ``root``."""
    pages = (spark.readStream.schema(PAGE_SCHEMA)
             .option("maxFilesPerTrigger", files_per_trigger).parquet(pages_dir))
    w = pages.writeStream.foreachBatch(_commit(root, profile)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


# --- tables with one folder per micro-batch -------------------------------------------------------
def _write(df: DataFrame, table: str, batch_id: int, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(f"{table}/batch={batch_id}")


# --- ST2 ----------------------------------------------------------------------------------------
REVIEW_KEY = ("app_id", "external_review_id")


def earlier_keys(spark: SparkSession, root: str, batch_id: int, buckets: list[int], key=REVIEW_KEY) -> DataFrame | None:
    """Stored keys of the batches before ``batch_id`` in ``buckets``: other directories are not read, and a
    batch that runs again doesn't see itself."""
    if batch_id == 0 or not buckets:
        return None
    return spark.read.parquet(f"{root}/reviews").where(F.col("app_bucket").isin(buckets) & (F.col("batch") < batch_id)).select(*key)


def dedupe_reviews(root: str, key=REVIEW_KEY):
    """Append each review key that no earlier batch holds, once.

    The key table lies in directories by a hash of the app; a batch reads those of its own apps.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(list(key)).withColumn("app_bucket", S.review_bucket(F.col("app_id")))
        counts = {r[0]: r[1] for r in batch.groupBy(S.review_bucket(F.col("app_id"))).count().collect()}  # <= REVIEW_BUCKETS
        stored = earlier_keys(batch.sparkSession, root, batch_id, sorted(counts), key)
        if stored is not None:
            same = [new[k].eqNullSafe(stored[k]) for k in key]
            new = new.join(stored, same, "left_anti")
        # a directory gets one writer for each ROWS_PER_FILE rows, not one file of each task
        writer = F.pmod(F.xxhash64(*key), S.writers(counts, "app_bucket", S.ROWS_PER_FILE))
        new = new.withColumn("_w", writer).repartition("app_bucket", "_w").drop("_w")
        _write(new, f"{root}/reviews", batch_id, by="app_bucket")
    return run


def stored_reviews(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/reviews").drop("batch", "app_bucket")


# --- ST3 ----------------------------------------------------------------------------------------
SERIES = ["app_id", "region", "currency"]
PRICE_COLUMNS = [*SERIES, "id", "ts", "price"]
LAST_BUCKETS = 64


def _series_key() -> F.Column:
    """The series as one text, nulls included."""
    return F.to_json(F.struct(*SERIES), {"ignoreNullFields": "false"})


def price_changes(root: str, width_us: int = O.DAY_US, buckets: int = LAST_BUCKETS):
    """Compare each price with the one before it; no stored price is read again.

    What a batch needs of the past is the last price of its own series: ``last`` holds one row a
    series, as bucketed copy-on-write versions (one a batch, of the touched buckets).
    Prices that come after their series' last one go to ``compared`` with their previous price;
    those that come too late go to its ``late=1`` folders, and ``price_alerts`` corrects what they change.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, last_root = batch.sparkSession, f"{root}/last"
        new = batch.select(*PRICE_COLUMNS).withColumn("series", _series_key())
        held = CAT.manifest(spark, last_root, batch_id)
        bucket = CAT.bucket_of(F.col("series"), buckets)
        touched = sorted(r[0] for r in new.select(bucket).distinct().collect())  # <= buckets
        here = F.struct("ts", "id", "price")
        newest = new.groupBy(F.col("series").alias("id")).agg(F.max_by(here, F.struct("ts", "id")).alias("last"))
        if held is None:
            held, known, top = dict.fromkeys(range(buckets), batch_id), newest.where(F.lit(False)), newest
        else:
            known = CAT.read_buckets(spark, last_root, {b: held[b] for b in touched}, newest.schema)
            both = known.unionByName(newest)
            top = both.groupBy("id").agg(F.max_by("last", F.struct("last.ts", "last.id")).alias("last"))
        at = F.struct("ts", "id")
        seen = O.with_prev(new, SERIES, "ts", ["ts", "id"], ["ts", "id", "price"], width_us)
        seen = seen.join(known.withColumnRenamed("id", "series"), "series", "left")
        # before the batch's own previous price there may be the series' last one
        past = F.struct("last.ts", "last.id")
        in_batch = F.struct("prev.ts", "prev.id")
        own = F.col("prev").isNotNull() & (F.col("last").isNull() | (in_batch > past))
        is_late = F.coalesce(F.col("last").isNotNull() & (at <= past), F.lit(False))
        seen = seen.withColumn("prev_price", F.when(own, F.col("prev.price")).otherwise(F.col("last.price")))
        seen = seen.select(*PRICE_COLUMNS, "prev_price", is_late.cast("int").alias("late"))
        _write(seen, f"{root}/compared", batch_id, by="late")
        CAT.write_version(spark, top, last_root, batch_id, buckets, held | dict.fromkeys(touched, batch_id))
    return run


def price_alerts(spark: SparkSession, root: str, width_us: int = O.DAY_US) -> DataFrame:
    """The changes as they stand, late prices in their places.

    Series without a late price are read as compared.  Of the others, what lies at or after
    the first late price is compared anew, together with the last price before it."""
    stored = spark.read.parquet(f"{root}/compared")
    compared, late = stored.where("late = 0").drop("batch", "late"), stored.where("late = 1").drop("batch", "late")
    out = [*SERIES, "id", "ts", "prev_price", "price"]
    if late.isEmpty():  # folder names tell
        return compared.where("price <> prev_price").select(*out)
    first = late.groupBy(*SERIES).agg(F.min("ts").alias("first_late"))
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in SERIES]
    c = compared.alias("c").join(first.alias("f"), on, "left").select("c.*", "first_late")
    settled = c.where("first_late IS NULL OR ts < first_late").select(*PRICE_COLUMNS, "prev_price")
    before = c.where("ts < first_late").groupBy(*SERIES).agg(
        F.max_by(F.struct("id", "ts", "price"), F.struct("ts", "id")).alias("last")).select(*SERIES, "last.*", F.lit(False).alias("open"))
    after = c.where("ts >= first_late").select(*PRICE_COLUMNS).unionByName(late.select(*PRICE_COLUMNS)).withColumn("open", F.lit(True))
    anew = O.with_prev(after.unionByName(before.select(*PRICE_COLUMNS, "open")), SERIES, "ts", ["ts", "id"], ["price"], width_us)
    anew = anew.where("open").select(*PRICE_COLUMNS, F.col("prev.price").alias("prev_price"))
    return settled.unionByName(anew).where("price <> prev_price").select(*out)


# --- ST4 / ST5 ------------------------------------------------------------------------------------
def count_windows(root: str, by: str, unit: str, failed: str | None = None):
    """Partial counts of the batch's rows per ``by`` and window (one ``unit`` of ``ts``)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        bad = F.col(failed).cast("long") if failed else F.lit(0).cast("long")
        _write(batch.groupBy(by, F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("start")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(bad).alias("n_failed")), f"{root}/windows", batch_id)
    return run


def windows(spark: SparkSession, root: str, by: str) -> DataFrame:
    """The counts of all batches, whatever their order."""
    return spark.read.parquet(f"{root}/windows").groupBy(by, "start").agg(F.sum("n").alias("n"), F.sum("n_failed").alias("n_failed"))


def over_limit(spark: SparkSession, root: str, limit: int = 100, caller: str = "ip") -> DataFrame:
    """ST4: (caller, minute) with more than ``limit`` requests."""
    return windows(spark, root, caller).where(F.col("n") > limit).select(
        caller, F.col("start").alias("minute"), F.col("n").alias("n_requests"))


def failure_rates(spark: SparkSession, root: str, by: str = "store") -> DataFrame:
    """ST5: failures / attempts per hour and store."""
    return windows(spark, root, by).select(
        F.col("start").alias("hour"), by, F.col("n").alias("n_attempts"), "n_failed",
        exact_ratio(F.col("n_failed"), F.col("n"), "decimal(10,6)").alias("failure_rate"))
