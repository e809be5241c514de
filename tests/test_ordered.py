"""The bucketed ordered scans must equal plain per-key windows, including a
hot key whose rows span many buckets and buckets with no rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from storelens.plans import ordered as O

HOUR = O.HOUR_US


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(7)
    rows, t0 = [], datetime(2024, 1, 1)
    for i in range(3000):
        key = 0 if i % 3 else rnd.choice([1, 2, 3, 4, None])  # key 0: two thirds of the rows; NULL keys too
        ts = None if i % 97 == 0 else t0 + timedelta(minutes=rnd.randint(0, 60 * 24 * 20))  # ties, NULLs
        val = rnd.choice([None, 1, 2, 3, 5])
        rows.append((i, key, ts, val))
    return spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v int")


def collect(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_with_prev(series):
    got = O.with_prev(series, ["k"], "ts", ["ts", "id"], ["v", "id"], width_us=6 * HOUR)
    got = got.select("id", F.col("prev.id").alias("pid"), F.col("prev.v").alias("pv"))
    w = Window.partitionBy("k").orderBy("ts", "id")
    exp = series.select("id", F.lag("id").over(w).alias("pid"), F.lag("v").over(w).alias("pv"))
    assert collect(got, ["id", "pid", "pv"]) == collect(exp, ["id", "pid", "pv"])


def test_running_totals_range_and_rows(series):
    s = {"s": F.coalesce(F.col("v"), F.lit(0)).cast("long"), "n": F.lit(1).cast("long")}
    got = O.running_totals(series, ["k"], "ts", s, width_us=6 * HOUR)
    w = Window.partitionBy("k").orderBy("ts")
    exp = series.select("id", F.sum(F.coalesce("v", F.lit(0))).over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"))
    assert collect(got, ["id", "s", "n"]) == collect(exp, ["id", "s", "n"])
    got2 = O.running_totals(series, ["k"], "ts", {"n": F.lit(1).cast("long")}, width_us=6 * HOUR, order=["ts", "id"])
    exp2 = series.select("id", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")).alias("n"))
    assert collect(got2, ["id", "n"]) == collect(exp2, ["id", "n"])


def test_last_non_null(series):
    got = O.last_non_null(series, ["k"], "ts", ["ts", "id"], "v", "lv", width_us=6 * HOUR)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = series.select("id", F.last("v", ignorenulls=True).over(w).alias("lv"))
    assert collect(got, ["id", "lv"]) == collect(exp, ["id", "lv"])


def test_auto_width_bounds(spark, series):
    w = O.auto_width(series, ["k"], "ts", target_rows=10)
    assert O.MIN_WIDTH_US <= w <= O.MAX_WIDTH_US and w % O.MINUTE_US == 0
    assert O.auto_width(series, ["k"], "ts", target_rows=10**9) == O.MAX_WIDTH_US


def test_hot_key_is_split(series):
    """The per-row window runs on (key, bucket), never on the key alone."""
    plan = O.with_prev(series, ["k"], "ts", ["ts", "id"], ["v"], width_us=6 * HOUR)._jdf \
        .queryExecution().executedPlan().toString()
    assert "_bucket" in plan


def test_single_hot_series_is_split_and_exact(spark):
    """All observations in one series (the extreme of 'one key holds a third of
    the rows'): buckets sized for ~200 rows each, result equal to a plain window."""
    from conftest import SF01
    from storelens.sources import fixtures as FX
    hot = FX.fx_prices(spark, SF01).withColumn("app_id", F.lit(0).cast("long")).withColumn("region", F.lit("US"))
    width = O.auto_width(hot, ["app_id"], "ts", target_rows=200)
    buckets = hot.select(O.bucket_of("ts", width).alias("b")).distinct().count()
    assert buckets >= hot.count() // 400
    got = O.with_prev(hot, ["app_id"], "ts", ["ts", "id"], ["id"], width_us=width) \
        .select("id", F.col("prev.id").alias("pid"))
    exp = hot.select("id", F.lag("id").over(Window.partitionBy("app_id").orderBy("ts", "id")).alias("pid"))
    assert collect(got, ["id", "pid"]) == collect(exp, ["id", "pid"])


def test_with_prev_on_integral_order(spark):
    rows = [(0 if i % 4 else i % 3, v) for i, v in enumerate(random.Random(5).sample(range(0, 50_000), 3000))]
    df = spark.createDataFrame(rows, "k long, version long")
    got = O.with_prev(df, ["k"], "version", ["version"], ["version"], width_us=64) \
        .select("k", "version", F.col("prev.version").alias("pv"))
    exp = df.select("k", "version", F.lag("version").over(Window.partitionBy("k").orderBy("version")).alias("pv"))
    assert collect(got, ["k", "version", "pv"]) == collect(exp, ["k", "version", "pv"])
