"""Price-history jobs: running average (W1), price changes (W2), offers (W3),
latest price (W4), churn alerts after price rises (W5/J6), price in force
(J7), monthly trends (A4), cross-app comparison (A5), history pages (L1/L2),
top movers (L5), the month-partitioned layout (S3/A3) and retention (R1).

Series key is (app_id, region, currency); every ordered scan goes through
``plans.ordered`` so a hot app is split by time bucket.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.numeric import exact_ratio
from storelens.plans import ordered as O

SERIES = ["app_id", "region", "currency"]
ORDER = ["ts", "id"]
AVG_TYPE = "decimal(18,6)"
PCT_TYPE = "decimal(18,6)"

# Fixed layout of the price table: one partition per month from 2026-01 to
# 2027-12, everything else in 'default'.
FIRST_MONTH = "2026-01-01 00:00:00"
END_MONTH = "2028-01-01 00:00:00"


def _exact_avg(total: Column, n: Column) -> Column:
    return exact_ratio(total, n, AVG_TYPE)


def running_avg(prices: DataFrame, keys=("app_id",), width_us: int | None = None) -> DataFrame:
    """AVG(price) OVER (PARTITION BY keys ORDER BY ts) — default RANGE frame,
    so observations with the same ts share one value."""
    keys = list(keys)
    r = O.running_totals(prices, keys, "ts",
                         {"run_sum": F.col("price"), "run_n": F.lit(1).cast("long")}, width_us)
    return r.withColumn("running_avg", _exact_avg(F.col("run_sum"), F.col("run_n"))).drop("run_sum")


def price_changes(prices: DataFrame, width_us: int | None = None) -> DataFrame:
    """Observations whose price differs from the previous observation of the
    same (app, region, currency); first observations are not changes."""
    p = O.with_prev(prices, SERIES, "ts", ORDER, ["price", "ts", "id"], width_us)
    return (p.where(F.col("prev").isNotNull() & (F.col("price") != F.col("prev.price")))
             .select(*SERIES, "id", "ts", F.col("prev.price").alias("prev_price"), "price",
                     F.col("prev.ts").alias("prev_ts"),
                     (F.col("price") - F.col("prev.price")).alias("delta"),
                     F.when(F.col("prev.price") != 0,
                            exact_ratio(F.col("price") - F.col("prev.price"), F.col("prev.price"), PCT_TYPE))
                      .alias("change_pct")))


def offers(prices: DataFrame, lookback_days: int = 30, drop: str = "0.15",
           width_us: int | None = None) -> DataFrame:
    """Price more than ``drop`` below the average of the same series over the
    previous ``lookback_days`` (RANGE [t - lookback, t), so observations at the
    same instant are excluded; none -> no offer).

    Window sums are differences of running totals: every observation adds a
    probe at t and one at t - lookback to its series' stream (probes sort before
    observations at the same instant), and sum/count over [t - lookback, t) =
    total(< t) - total(< t - lookback).  Linear, exact, and split by time bucket
    like every other series scan, however hot the series.
    """
    lb = lookback_days * O.DAY_US
    obs = prices.select(*SERIES, "id", "ts", "price")
    price_t = prices.schema["price"].dataType
    zero = F.lit(0).cast(price_t)

    def row(ts, k, probe, v, c):
        return F.struct(ts.alias("ts"), F.lit(k).alias("_k"), F.lit(probe).cast("string").alias("_probe"),
                        v.alias("_v"), F.lit(c).cast("long").alias("_c"))

    # one scan: each observation yields itself and its two probes
    u = obs.select(*SERIES, F.col("id").alias("_ord"), F.col("ts").alias("_obs_ts"),
                   F.col("price").alias("_obs_price"),
                   F.explode(F.array(
                       row(F.col("ts"), 1, None, F.col("price"), 1),
                       row(F.col("ts"), 0, "now", zero, 0),
                       row(F.timestamp_add("MICROSECOND", F.lit(-lb), "ts"), 0, "back", zero, 0))).alias("r")) \
           .select(*SERIES, "_ord", "_obs_ts", "_obs_price", "r.*") \
           .withColumn("_ref", F.when(F.col("_probe").isNotNull(), F.col("_ord")))
    r = O.running_totals(u, SERIES, "ts", {"_s": F.col("_v"), "_n": F.col("_c")}, width_us,
                         order=["ts", "_k", "_ord", "_probe"])

    def at(name, c):
        return F.max(F.when(F.col("_probe") == name, F.col(c)))

    w = (r.where(F.col("_probe").isNotNull())
          .groupBy(*SERIES, "_ref")
          .agg(F.first("_obs_ts").alias("ts"), F.first("_obs_price").alias("price"),
               (at("now", "_s") - at("back", "_s")).alias("_sum"), (at("now", "_n") - at("back", "_n")).alias("_cnt")))
    return (w.where(F.col("_cnt") > 0)
             .withColumn("avg_30d", _exact_avg(F.col("_sum"), F.col("_cnt")))
             # price < (1 - drop) * sum / count, on the unrounded average
             .where(F.col("price") * F.col("_cnt").cast("decimal(12,0)") * 100 <
                    F.col("_sum").cast("decimal(28,2)") * F.lit(100 - int(Decimal(drop) * 100)).cast("decimal(3,0)"))
             .select(*SERIES, F.col("_ref").alias("id"), "ts", "price", "avg_30d"))


def latest_price(prices: DataFrame) -> DataFrame:
    """Latest observation per series — an aggregation (map-side partial
    max_by) rather than a row_number window, so hot series are combined before
    the shuffle."""
    return (prices.groupBy(*SERIES)
                  .agg(F.max_by(F.struct("price", "ts", "id"), F.struct("ts", "id")).alias("l"),
                       F.count(F.lit(1)).alias("n_obs"))
                  .select(*SERIES, F.col("l.price").alias("price"), F.col("l.ts").alias("ts"),
                          F.col("l.id").alias("id"), "n_obs"))


def asof_price(events: DataFrame, prices: DataFrame, event_id: str, key: str = "app_id",
               width_us: int | None = None) -> DataFrame:
    """For every event (e.g. a review) the price in force at its time: the
    latest price observation at or before it (same-ts prices count).  Union of
    both streams + segmented carry-forward; no theta join, no pairs."""
    ev = events.select(F.struct(*events.columns).alias("_ev"), F.col(key).alias("_key"),
                       F.col("ts").alias("_ts"), F.col(event_id).cast("long").alias("_ord"))
    price_t = prices.schema["price"].dataType
    p = prices.select(F.col(key).alias("_key"), F.col("ts").alias("_ts"), F.lit(0).alias("_kind"),
                      F.col("id").cast("long").alias("_ord"), F.col("price").alias("_price"),
                      F.lit(None).cast(ev.schema["_ev"].dataType).alias("_ev"))
    e = ev.select("_key", "_ts", F.lit(1).alias("_kind"), "_ord",
                  F.lit(None).cast(price_t).alias("_price"), "_ev")
    c = O.last_non_null(p.unionByName(e), ["_key"], "_ts", ["_ts", "_kind", "_ord"], "_price",
                        "price_in_force", width_us)
    return c.where(F.col("_kind") == 1).select("_ev.*", "price_in_force")


def price_rises(prices: DataFrame, width_us: int | None = None) -> DataFrame:
    return price_changes(prices, width_us).where(F.col("delta") > 0)


def churn_alerts(prices: DataFrame, ratings: DataFrame, span_days: int = 7, negative_max: int = 2,
                 min_after: int = 3, factor: int = 2, width_us: int | None = None) -> DataFrame:
    """After each price rise at t, count negative reviews (rating <=
    ``negative_max``) of the same app in (t, t+span] and in [t-span, t); alert
    when after >= max(min_after, factor * before).

    No pair is materialised: the rise contributes four probe rows to the
    review stream and a running count of negatives (segmented by time bucket)
    is read at each probe, so work is linear even for a hot app.
    """
    span = span_days * O.DAY_US
    rises = price_rises(prices, width_us).select(
        F.col("app_id"), F.col("id").alias("rise_id"), F.col("ts").alias("rise_ts"),
        F.col("prev_price"), F.col("price"))
    # probe kinds: 0 = count of reviews with ts < probe, 2 = count with ts <= probe.
    # Each probe carries its rise's fields, so no join back to the rises is needed.
    probes = rises.select(
        "app_id", "rise_id", "rise_ts", "prev_price", "price",
        F.explode(F.array(
            F.struct(F.lit("before_lo").alias("p"), F.timestamp_add("MICROSECOND", F.lit(-span), "rise_ts").alias("ts"), F.lit(0).alias("k")),
            F.struct(F.lit("before_hi").alias("p"), F.col("rise_ts").alias("ts"), F.lit(0).alias("k")),
            F.struct(F.lit("after_lo").alias("p"), F.col("rise_ts").alias("ts"), F.lit(2).alias("k")),
            F.struct(F.lit("after_hi").alias("p"), F.timestamp_add("MICROSECOND", F.lit(span), "rise_ts").alias("ts"), F.lit(2).alias("k")),
        )).alias("pr")).select("app_id", "rise_id", "rise_ts", "prev_price", "price", F.col("pr.p").alias("probe"),
                               F.col("pr.ts").alias("ts"), F.col("pr.k").alias("_k"))
    price_t = prices.schema["price"].dataType
    revs = ratings.select("app_id", "ts", F.lit(1).alias("_k"), F.lit(None).cast("long").alias("rise_id"),
                          F.lit(None).cast("timestamp_ntz").alias("rise_ts"),
                          F.lit(None).cast(price_t).alias("prev_price"), F.lit(None).cast(price_t).alias("price"),
                          F.lit(None).cast("string").alias("probe"),
                          (F.col("rating") <= negative_max).cast("long").alias("_neg"))
    u = probes.withColumn("_neg", F.lit(0).cast("long")).unionByName(revs)
    u = u.withColumn("_tie", F.coalesce(F.col("rise_id"), F.lit(0)))
    r = O.running_totals(u, ["app_id"], "ts", {"_cum": F.col("_neg")}, width_us,
                         order=["ts", "_k", "_tie", "probe"])

    def at(probe):
        return F.max(F.when(F.col("probe") == probe, F.col("_cum")))

    out = (r.where(F.col("probe").isNotNull())
            .groupBy("app_id", "rise_id")
            .agg(F.first("rise_ts").alias("rise_ts"), F.first("prev_price").alias("prev_price"),
                 F.first("price").alias("price"),
                 (at("before_hi") - at("before_lo")).alias("neg_before"),
                 (at("after_hi") - at("after_lo")).alias("neg_after")))
    return (out.where(F.col("neg_after") >= F.greatest(F.lit(min_after), F.lit(factor) * F.col("neg_before")))
               .select("app_id", "rise_id", "rise_ts", "prev_price", "price", "neg_before", "neg_after"))


def price_trends(prices: DataFrame) -> DataFrame:
    """A4: monthly price trend per (app, month, currency, region)."""
    return (prices.withColumn("month", F.date_trunc("month", "ts").cast("timestamp_ntz"))
                  .groupBy("app_id", "month", "currency", "region")
                  .agg(F.sum("price").alias("_s"), F.count(F.lit(1)).alias("n_obs"),
                       F.min("price").alias("min_price"), F.max("price").alias("max_price"),
                       F.min_by("price", F.struct("ts", "id")).alias("first_price"),
                       F.max_by("price", F.struct("ts", "id")).alias("last_price"))
                  .withColumn("avg_price", _exact_avg(F.col("_s"), F.col("n_obs"))).drop("_s"))


def compare_apps(prices: DataFrame, app_ids: list, period: str = "month") -> DataFrame:
    """A5: average price per period for a handful of apps side by side (pivot on
    a fixed value list -> one pass, no distinct-values job)."""
    p = (prices.where(F.col("app_id").isin(app_ids))
               .withColumn("period", F.date_trunc(period, "ts").cast("timestamp_ntz")))
    wide = p.groupBy("period").pivot("app_id", app_ids).agg(
        exact_ratio(F.sum("price"), F.count(F.lit(1)), AVG_TYPE))
    return wide.select("period", *[F.col(f"`{a}`").alias(f"app_{a}") for a in app_ids])


def with_price_month(prices: DataFrame) -> DataFrame:
    """S3: partition value 'YYYYMM' inside the monthly range, else 'default'."""
    in_range = (F.col("ts") >= F.lit(FIRST_MONTH).cast("timestamp_ntz")) & \
               (F.col("ts") < F.lit(END_MONTH).cast("timestamp_ntz"))
    return prices.withColumn("price_month", F.when(in_range, F.date_format("ts", "yyyyMM"))
                                              .otherwise(F.lit("default")))


def month_partition_filter(start, end) -> Column:
    """Partition predicate matching a ts range, so a read of the partitioned
    table prunes directories (Spark does not derive it from a ts predicate)."""
    months = F.date_format(F.lit(start).cast("timestamp_ntz"), "yyyyMM"), \
        F.date_format(F.lit(end).cast("timestamp_ntz"), "yyyyMM")
    inside = F.col("price_month").between(*months)
    # the default partition holds what lies outside the monthly span: only ranges that leave it need it
    if str(start) >= FIRST_MONTH[:10] and str(end) <= END_MONTH:
        return inside
    return (F.col("price_month") == "default") | inside


def price_history_page(prices: DataFrame, app_id, start, end, limit: int = 100, cursor=None) -> DataFrame:
    """L1/L2: one app's observations in [start, end), newest first, keyset cursor
    (ts, id) exclusive.  ORDER BY + LIMIT plans as TakeOrderedAndProject."""
    p = prices.where((F.col("app_id") == F.lit(app_id)) &
                     (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) &
                     (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    if "price_month" in prices.columns:
        p = p.where(month_partition_filter(start, end))
    if cursor is not None:
        cts, cid = cursor
        cts = F.lit(cts).cast("timestamp_ntz")
        p = p.where((F.col("ts") < cts) | ((F.col("ts") == cts) & (F.col("id") < F.lit(cid))))
    return p.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def top_movers(prices: DataFrame, k: int = 20, width_us: int | None = None) -> DataFrame:
    """The k largest relative price changes (top-k is the feature)."""
    ch = price_changes(prices, width_us).where(F.col("change_pct").isNotNull())
    return (ch.withColumn("abs_pct", F.abs("change_pct"))
              .orderBy(F.col("abs_pct").desc(), F.col("app_id"), F.col("region"), F.col("ts"), F.col("id"))
              .limit(k)
              .select(*SERIES, "id", "ts", "prev_price", "price", "change_pct"))


def retention_split(df: DataFrame, ts: str, as_of, months: int) -> DataFrame:
    """Label rows 'keep' / 'expire' by age relative to ``as_of``."""
    cutoff = F.add_months(F.lit(as_of).cast("timestamp_ntz"), -months).cast("timestamp_ntz")
    return df.withColumn("retention", F.when(F.col(ts) >= cutoff, F.lit("keep")).otherwise(F.lit("expire")))
