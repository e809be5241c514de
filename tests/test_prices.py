"""Hand-computed cases for the price and health rules."""

from datetime import datetime, timedelta
from decimal import Decimal

from storelens.operators import health as H
from storelens.operators import prices as P

T0 = datetime(2026, 1, 1)
PRICES = "id long, app_id long, region string, currency string, price decimal(10,2), ts timestamp_ntz"


def obs(spark, rows):
    return spark.createDataFrame([(i, a, "US", "USD", Decimal(p), T0 + timedelta(days=d)) for i, a, p, d in rows], PRICES)


def test_offers_window_semantics(spark):
    df = obs(spark, [(1, 1, "10", 0), (2, 1, "10", 10), (3, 1, "8", 10),   # 3: same instant as 2 -> excluded
                     (4, 1, "8", 20), (5, 1, "5", 45), (6, 2, "1", 0)])     # 6: no history -> no offer
    got = {r["id"]: r["avg_30d"] for r in P.offers(df).collect()}
    # id 3: window [t-30d, t) holds only id 1 (10) -> 8 < 8.5 -> offer
    # id 4: window holds 10, 10, 8 -> avg 9.333333 -> 8 < 7.93? no
    # id 5: window [day 15, day 45) holds id 4 (8) -> 5 < 6.8 -> offer
    assert got == {3: Decimal("10.000000"), 5: Decimal("8.000000")}


def test_running_avg_ties_share_value(spark):
    df = obs(spark, [(1, 1, "1", 0), (2, 1, "2", 1), (3, 1, "4", 1), (4, 1, "9", 2)])
    got = {r["id"]: (r["run_n"], r["running_avg"]) for r in P.running_avg(df).collect()}
    assert got == {1: (1, Decimal("1.000000")), 2: (3, Decimal("2.333333")), 3: (3, Decimal("2.333333")),
                   4: (4, Decimal("4.000000"))}


def test_latest_and_changes(spark):
    df = obs(spark, [(1, 1, "1", 0), (2, 1, "1", 1), (3, 1, "2", 2), (4, 1, "1.5", 3)])
    latest = P.latest_price(df).first()
    assert (latest["id"], latest["price"], latest["n_obs"]) == (4, Decimal("1.50"), 4)
    ch = {r["id"]: (r["prev_price"], r["change_pct"]) for r in P.price_changes(df).collect()}
    assert ch == {3: (Decimal("1.00"), Decimal("1.000000")), 4: (Decimal("2.00"), Decimal("-0.250000"))}


def test_asof_price_counts_same_instant(spark):
    prices = obs(spark, [(1, 1, "3", 0), (2, 1, "4", 2)])
    ev = spark.createDataFrame([(10, 1, T0 - timedelta(days=1)), (11, 1, T0), (12, 1, T0 + timedelta(days=2)),
                                (13, 1, T0 + timedelta(days=5)), (14, 2, T0)], "review_id long, app_id long, ts timestamp_ntz")
    got = {r["review_id"]: r["price_in_force"] for r in P.asof_price(ev, prices, "review_id").collect()}
    assert got == {10: None, 11: Decimal("3.00"), 12: Decimal("4.00"), 13: Decimal("4.00"), 14: None}


def test_churn_thresholds(spark):
    prices = obs(spark, [(1, 1, "1", 0), (2, 1, "2", 10)])         # rise at day 10
    h = timedelta(hours=1)
    t = T0 + timedelta(days=10)
    ratings = [(100, 1, t - 2 * h, 1)]                             # one negative before
    ratings += [(101 + i, 1, t + (i + 1) * h, 1) for i in range(2)]  # two negatives after: below max(3, 2)
    ratings += [(200, 1, t + timedelta(days=8), 1)]                # outside the 7-day span
    df = spark.createDataFrame(ratings, "review_id long, app_id long, ts timestamp_ntz, rating int")
    assert P.churn_alerts(prices, df).count() == 0
    more = df.unionByName(spark.createDataFrame([(103, 1, t + 5 * h, 2)], df.schema))
    r = P.churn_alerts(prices, more).first()
    assert (r["neg_before"], r["neg_after"]) == (1, 3)


def test_sync_error_runs(spark):
    flags = [True, True, False, True, True, True, True, False, True]
    att = spark.createDataFrame([(i, 7, T0 + timedelta(minutes=i), f) for i, f in enumerate(flags)],
                                "attempt_id long, app_id long, ts timestamp_ntz, failed boolean")
    got = {r["attempt_id"]: r["streak"] for r in H.sync_errors(att).collect()}
    assert got == {5: 3, 6: 4}
