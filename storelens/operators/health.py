"""Ingestion health: sync errors (W6), hourly success/error rates (A6),
per-caller rate limiting (ST4 batch twin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.numeric import exact_ratio
from storelens.plans import ordered as O

RATE_TYPE = "decimal(10,6)"


def sync_errors(attempts: DataFrame, run: int = 3, width_us: int | None = None) -> DataFrame:
    """Attempts that end a run of >= ``run`` consecutive failed fetches of the
    same app (ordered by ts, attempt_id), with the run length so far.

    Islands without a per-app window: position = running count; last success
    position = carried forward; streak = position - last success position.
    Both scans are split by time bucket, so a hot app spreads over many tasks.
    """
    order = ["ts", "attempt_id"]
    a = O.running_totals(attempts, ["app_id"], "ts", {"pos": F.lit(1).cast("long")}, width_us, order=order)
    a = a.withColumn("_ok_pos", F.when(~F.col("failed"), F.col("pos")))
    a = O.last_non_null(a, ["app_id"], "ts", order, "_ok_pos", "last_ok_pos", width_us)
    a = a.withColumn("streak", F.col("pos") - F.coalesce(F.col("last_ok_pos"), F.lit(0)))
    return a.where(F.col("failed") & (F.col("streak") >= run)).select("app_id", "attempt_id", "ts", "streak")


def health_hourly(attempts: DataFrame, by: str = "store") -> DataFrame:
    """Per hour and store: attempts, failures, failure rate."""
    return (attempts.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
                    .groupBy("hour", by)
                    .agg(F.count(F.lit(1)).alias("n_attempts"),
                         F.sum(F.col("failed").cast("long")).alias("n_failed"))
                    .withColumn("failure_rate",
                                exact_ratio(F.col("n_failed"), F.col("n_attempts"), RATE_TYPE)))


def rate_limit(access: DataFrame, limit: int = 100, caller: str = "ip") -> DataFrame:
    """ST4 batch twin: callers with more than ``limit`` requests in a minute."""
    return (access.withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
                  .groupBy(caller, "minute").agg(F.count(F.lit(1)).alias("n_requests"))
                  .where(F.col("n_requests") > limit))
