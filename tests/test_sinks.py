"""Month-partitioned price history, pruning, idempotent appends, whole-batch commit."""

import os
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from storelens.operators import extract as X
from storelens.sources import sinks as S


def prices(spark, rows):
    return spark.createDataFrame(rows, "id long, app_id long, region string, currency string, "
                                       "price decimal(10,2), ts timestamp_ntz")


EDGES = [(1, 1, "US", "USD", Decimal("1.00"), datetime(2025, 12, 31, 23, 59, 59)),
         (2, 1, "US", "USD", Decimal("2.00"), datetime(2026, 1, 1)),
         (3, 1, "US", "USD", Decimal("3.00"), datetime(2027, 12, 31, 23, 59, 59)),
         (4, 1, "US", "USD", Decimal("4.00"), datetime(2028, 1, 1))]


def test_partition_layout_and_pruning(spark, scratch):
    path = os.path.join(scratch, "price_history")
    months = [(100 + m, 2, "US", "USD", Decimal(m), datetime(2026 + m // 12, m % 12 + 1, 15)) for m in range(24)]
    S.write_price_history(prices(spark, EDGES + months), path)
    parts = sorted(d for d in os.listdir(path) if d.startswith("price_month="))
    assert len(parts) == 25 and "price_month=default" in parts
    got = {r["id"]: r["price_month"] for r in spark.read.parquet(path).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("default", "202601", "202712", "default")
    df = S.read_price_history(spark, path, "2026-03-01", "2026-05-01")
    assert sorted(r["id"] for r in df.collect()) == [102, 103]
    only_months = os.path.join(scratch, "months_only")  # no 'default' directory: values look numeric
    S.write_price_history(prices(spark, months), only_months)
    assert S.read_price_history(spark, only_months, "2026-03-01", "2026-05-01").count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "price_month" in plan


def test_price_append_is_idempotent(spark, scratch):
    path = os.path.join(scratch, "ph")
    S.write_price_history(prices(spark, EDGES), path)
    S.write_price_history(prices(spark, EDGES), path)
    assert spark.read.parquet(path).count() == 4


def test_reviews_insert_if_absent(spark, scratch):
    path = os.path.join(scratch, "reviews")
    b1 = spark.createDataFrame([("a", "1", 5), ("a", "2", 4)], "app_id string, external_review_id string, rating int")
    b2 = spark.createDataFrame([("a", "2", 1), ("b", "2", 3)], "app_id string, external_review_id string, rating int")
    S.append_new_reviews(b1, path)
    S.append_new_reviews(b2, path)
    S.append_new_reviews(b2, path)
    got = sorted((r["app_id"], r["external_review_id"], r["rating"]) for r in spark.read.parquet(path).collect())
    assert got == [("a", "1", 5), ("a", "2", 4), ("b", "2", 3)]


def _page(name, price, reviews):
    revs = "".join(f'<div class="we-customer-review" data-review-id="{i}"><figure class="we-star-rating" '
                   f'aria-label="{r} of 5"></figure><p class="we-customer-review__body">Body {i} a@b.com</p></div>'
                   for i, r in reviews)
    return (f"<body><h1 class='product-header__title'>{name}</h1>"
            f"<ul><li class='inline-list__item--bulleted'>{price}</li></ul>{revs}</body>")


def test_commit_scrape_batch(spark, scratch):
    pages = [(1, "app1", "u1", datetime(2026, 2, 1), _page("One", "$1.99", [("r1", 4), ("r1", 2), ("r2", 5)])),
             (2, "app2", "u2", datetime(2026, 2, 1), _page("Two", "Free", [("r9", 0)])),   # poisoned
             (3, "app3", "u3", datetime(2026, 2, 2), _page("", "$3.00", []))]               # no app record
    df = spark.createDataFrame(pages, "page_id long, app_id string, url string, captured_at timestamp_ntz, html string")
    raw = X.extract_raw(df, keep=("app_id", "captured_at"))
    res = X.scrape_results(raw, F.col("captured_at"), keep=("app_id",))
    for _ in range(2):  # a re-run of the same batch writes nothing new
        S.commit_scrape_batch(res, scratch, batch_id=7)
    ph = spark.read.parquet(os.path.join(scratch, "price_history"))
    assert sorted((r["app_id"], r["price"]) for r in ph.collect()) == [("app1", Decimal("1.99")), ("app3", Decimal("3.00"))]
    rv = {r["external_review_id"]: r for r in spark.read.parquet(os.path.join(scratch, "reviews")).collect()}
    assert sorted(rv) == ["r1", "r2"]
    assert rv["r1"]["rating"] == 4 and rv["r1"]["content"] == "body r1 [EMAIL]"  # first rating, processed text
    apps = spark.read.parquet(os.path.join(scratch, "app_updates")).collect()
    assert [(a["app_id"], a["name"]) for a in apps] == [("app1", "One")]


def test_export(spark, scratch):
    df = spark.createDataFrame([(1, {"a": 1})], "id int, m struct<a:int>")
    S.export(df, os.path.join(scratch, "csv"), "csv")
    S.export(df, os.path.join(scratch, "json"), "json")
    assert spark.read.option("header", True).csv(os.path.join(scratch, "csv")).first()["m"] == '{"a":1}'
    assert spark.read.json(os.path.join(scratch, "json")).first()["m"]["a"] == 1


def test_refresh_price_trends(spark, scratch):
    path, tpath = os.path.join(scratch, "ph"), os.path.join(scratch, "trends")
    rows = [(i, 1, "US", "USD", Decimal(i), datetime(2026, 1 + i % 3, 1 + i)) for i in range(9)]
    S.write_price_history(prices(spark, rows), path)
    S.refresh_price_trends(spark, path, tpath, ["202601", "202602", "202603"])
    before = {r["trend_month"]: r["n_obs"] for r in S.read_partitioned(spark, tpath, "trend_month").collect()}
    assert before == {"202601": 3, "202602": 3, "202603": 3}
    S.write_price_history(prices(spark, [(99, 1, "US", "USD", Decimal(5), datetime(2026, 2, 20))]), path)
    S.refresh_price_trends(spark, path, tpath, ["202602"])
    after = {r["trend_month"]: r["n_obs"] for r in S.read_partitioned(spark, tpath, "trend_month").collect()}
    assert after == {"202601": 3, "202602": 4, "202603": 3}
