"""Streams give the batch results whatever the cut and order of their files."""

import os
import random
import re
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from storelens.operators import health as H
from storelens.operators import prices as P
from storelens.sources import fixtures as FX
from storelens.streaming import jobs as ST
from storelens.streaming import replay as RP


def shuffled_files(df, out, n, seed):
    """Rows dealt over n files without regard to time, in a shuffled order of arrival."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    dealt = df.withColumn("_f", F.pmod(F.xxhash64(*df.columns), F.lit(n)))
    for at, k in enumerate(order):
        dealt.where(F.col("_f") == k).drop("_f").coalesce(1).write.parquet(os.path.join(out, f"part{at:03d}"))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(os.path.join(out, "part*"))


def rows(df, cols):
    return sorted(tuple(str(r[c]) for c in cols) for r in df.select(*cols).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_price_alerts_equal_batch(spark, scratch, seed):
    prices = FX.fx_prices(spark, SF01).where(F.col("app_id") < 60)
    RP.run_all(shuffled_files(prices, os.path.join(scratch, "in"), 5, seed), ST.price_changes(scratch), scratch)
    cols = ["app_id", "region", "currency", "id", "ts", "prev_price", "price"]
    got = rows(ST.price_alerts(spark, scratch), cols)
    assert got == rows(P.price_changes(prices), cols) and len(got) > 50


def test_windows_equal_batch(spark, scratch):
    att, a = FX.fx_attempts(spark, SF01), os.path.join(scratch, "att")
    RP.run_all(shuffled_files(att, os.path.join(a, "in"), 4, 1), ST.count_windows(a, "store", "hour", "failed"), a)
    cols = ["hour", "store", "n_attempts", "n_failed", "failure_rate"]
    assert rows(ST.failure_rates(spark, a), cols) == rows(H.health_hourly(att), cols)  # the newest window too
    acc, b = FX.fx_access(spark, SF01), os.path.join(scratch, "acc")
    RP.run_all(shuffled_files(acc, os.path.join(b, "in"), 4, 2), ST.count_windows(b, "ip", "minute"), b)
    cols = ["ip", "minute", "n_requests"]
    assert rows(ST.over_limit(spark, b, 1), cols) == rows(H.rate_limit(acc, limit=1), cols)


def test_dedupe_over_batches(spark, scratch):
    feed = FX.fx_review_batch(spark, SF01).select("app_id", "external_review_id")
    feed = feed.unionByName(feed)
    RP.run_all(shuffled_files(feed, os.path.join(scratch, "in"), 4, 3), ST.dedupe_reviews(scratch), scratch)
    assert rows(ST.stored_reviews(spark, scratch), feed.columns) == rows(feed.distinct(), feed.columns)


def test_a_batch_reads_its_own_apps_keys_only(spark, scratch):
    step, schema = ST.dedupe_reviews(scratch), "app_id string, external_review_id string"
    keys = [[(f"app{a}", f"r{k}") for a in range(40) for k in range(3)], [("app1", "r1"), ("app1", "r9"), (None, "r1"), ("app2", None)],
            [(None, "r1"), ("app2", None), ("app1", "r9"), ("app3", "r3")]]
    for k, b in enumerate(keys):
        for _ in range(2):
            step(spark.createDataFrame(b, schema), k)
    got = [tuple(r) for r in ST.stored_reviews(spark, scratch).select("app_id", "external_review_id").collect()]
    assert len(got) == len(set(got)) and set(got) == {k for b in keys for k in b}
    bucket = spark.sql("SELECT 'app1' AS app_id").select(ST.S.review_bucket(F.col("app_id"))).first()[0]
    read = ST.earlier_keys(spark, scratch, 1, [bucket])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*app_bucket", plan)
    files = read.select(F.input_file_name().alias("f")).distinct().count()
    assert files == 1 < len(spark.read.parquet(f"{scratch}/reviews").inputFiles()) and 3 <= read.count() < 120


def test_prices_come_in_any_order_without_reading_the_stored_ones(spark, scratch):
    """A batch reads the last price of its series' buckets; the stored prices' folders may even be away."""
    schema = "app_id long, region string, currency string, id long, ts timestamp_ntz, price decimal(10,2)"
    rng = random.Random(4)
    data = [(a, rng.choice(["US", None]), "USD", i, datetime(2026, 1, 1 + rng.randrange(20), rng.randrange(3)), Decimal(rng.randrange(1, 4)))
            for i, a in enumerate([1] * 60 + [rng.randrange(2, 9) for _ in range(60)])]
    whole = rows(P.price_changes(spark.createDataFrame(data, schema)), ["id", "prev_price", "price"])
    for order in ("sorted", "shuffled"):
        root = os.path.join(scratch, order)
        batch = sorted(data, key=lambda r: (r[4], r[3])) if order == "sorted" else rng.sample(data, len(data))
        step = ST.price_changes(root, buckets=4)
        for k in range(4):
            step(spark.createDataFrame(batch[30 * k:30 * k + 30], schema), k)
        assert rows(ST.price_alerts(spark, root), ["id", "prev_price", "price"]) == whole
        late = spark.read.parquet(f"{root}/compared").where("late = 1").count()
        assert late == 0 if order == "sorted" else late > 20


def test_a_batch_needs_the_last_prices_only(spark, scratch):
    """The second batch finds its past with the stored prices' folders away."""
    schema = "app_id long, region string, currency string, id long, ts timestamp_ntz, price decimal(10,2)"
    row = lambda i, app, day, p: (app, "US", None, i, datetime(2026, 1, day), Decimal(p))
    one, two = os.path.join(scratch, "one"), os.path.join(scratch, "two")
    ST.price_changes(one)(spark.createDataFrame([row(1, 1, 1, "1.00"), row(2, 1, 2, "2.00"), row(3, 2, 1, "5.00")], schema), 0)
    os.makedirs(two)
    os.symlink(os.path.join(one, "last"), os.path.join(two, "last"))
    ST.price_changes(two)(spark.createDataFrame([row(4, 1, 3, "3.00"), row(5, 2, 1, "6.00"), row(6, 3, 1, "7.00")], schema), 1)
    got = {r["id"]: r["prev_price"] for r in spark.read.parquet(f"{two}/compared").collect()}
    assert got == {4: Decimal("2.00"), 5: Decimal("5.00"), 6: None}


def test_a_batch_that_runs_again_replaces_itself(spark, scratch):
    schema = "app_id long, region string, currency string, id long, ts timestamp_ntz, price decimal(10,2)"
    row = lambda i, day, p: (1, "US", "USD", i, datetime(2026, 1, day), Decimal(p))
    batches = [[row(1, 1, "1.00"), row(2, 3, "2.00")], [row(3, 2, "9.00"), row(4, 4, "3.00")], [row(5, 5, "3.00")]]
    step = ST.price_changes(scratch)
    for k, b in enumerate(batches):
        for _ in range(2):
            step(spark.createDataFrame(b, schema), k)
    got = sorted((r["id"], r["prev_price"], r["price"]) for r in ST.price_alerts(spark, scratch).collect())
    # the late row 3 is compared with row 1, and row 2 anew with row 3
    assert got == [(2, Decimal("9.00"), Decimal("2.00")), (3, Decimal("1.00"), Decimal("9.00")), (4, Decimal("2.00"), Decimal("3.00"))]


def test_ingest_stream(spark, scratch):
    html = ("<body><h1 class='product-header__title'>App {i}</h1><ul><li class='inline-list__item--bulleted'>"
            "${i}.99</li></ul><div class='we-customer-review' data-review-id='r{i}'>"
            "<figure class='we-star-rating' aria-label='4'></figure></div></body>")
    data = [(i, f"app{i % 3}", f"u{i}", datetime(2026, 3, 1 + i), html.format(i=i)) for i in range(6)]
    pages = spark.createDataFrame(data, ST.PAGE_SCHEMA)
    src = os.path.join(scratch, "pages")
    for i in range(3):
        pages.where(F.col("page_id") % 3 == i).coalesce(1).write.parquet(os.path.join(src, f"f{i}"))
    q = ST.start_ingest(spark, os.path.join(src, "f*"), os.path.join(scratch, "tables"),
                        os.path.join(scratch, "ckpt"), files_per_trigger=1)
    q.awaitTermination(600)
    # batch twin: the same pages committed as one batch
    from storelens.operators import extract as X
    from storelens.sources import sinks as S
    raw = X.extract_raw(pages, keep=("app_id", "captured_at"))
    S.commit_scrape_batch(X.scrape_results(raw, F.col("captured_at"), keep=("app_id",)),
                          os.path.join(scratch, "batch"), batch_id=0)
    for table, cols in (("price_history", ["id", "app_id", "price", "ts"]),
                        ("reviews", ["app_id", "external_review_id", "rating", "content"])):
        streamed = spark.read.parquet(os.path.join(scratch, "tables", table)).select(*cols).collect()
        batched = spark.read.parquet(os.path.join(scratch, "batch", table)).select(*cols).collect()
        assert len(streamed) == 6 and sorted(map(tuple, streamed)) == sorted(map(tuple, batched))
