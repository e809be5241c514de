"""Versions of the bucketed catalogue, against a plain dictionary."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from storelens.operators import extract as X
from storelens.sources import catalogue as CAT
from storelens.sources import sinks as S

APPS = "id long, name string, bundle_id string, store string, developer_name string, description string, icon_url string, is_active boolean"
UPDATES = "app_id long, name string, developer_name string, description string, icon_url string"


def apps(spark, n):
    return spark.createDataFrame([(i, f"app {i}", f"com.{i}", "APPLE_APP_STORE", "dev", None, None, i % 2 == 0) for i in range(n)], APPS)


def test_versions_against_a_dictionary(spark, scratch):
    rng = random.Random(5)
    CAT.create(apps(spark, 60), scratch, buckets=8)
    want = {r.id: r.asDict() for r in apps(spark, 60).collect()}
    states = [want]
    for version in (1, 2, 3):
        ups = [(i, f"v{version} {i}", rng.choice([None, "", "new dev"]), rng.choice([None, "about"]), rng.choice(["", "icon"]))
               for i in rng.sample(range(70), 9)]  # ids from 60 on are unknown apps
        want = {i: dict(r) for i, r in want.items()}
        for i, name, dev, about, icon in ups:
            if i in want:
                want[i] |= {"name": name} | {k: v for k, v in (("developer_name", dev), ("description", about), ("icon_url", icon)) if v}
        states.append(want)
        CAT.apply_updates(spark.createDataFrame(ups, UPDATES), scratch, version)
        if version == 2:  # the batch runs twice
            CAT.apply_updates(spark.createDataFrame(ups, UPDATES), scratch, version)
    for version, state in enumerate(states):
        assert {r.id: r.asDict() for r in CAT.read(spark, scratch, version).collect()} == state
    assert {r.id: r.asDict() for r in CAT.read(spark, scratch).collect()} == states[-1]


def test_an_update_writes_its_buckets_only(spark, scratch):
    CAT.create(apps(spark, 200), scratch, buckets=16)
    CAT.apply_updates(spark.createDataFrame([(7, "seven", None, None, None)], UPDATES), scratch, 1)
    written = [d for d in os.listdir(os.path.join(scratch, "data", "v=1")) if d.startswith("bucket=")]
    assert len(written) == 1
    held = CAT.manifest(spark, scratch)
    assert sorted(held) == list(range(16)) and sum(v == 1 for v in held.values()) == 1
    plan = CAT.read(spark, scratch)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and CAT.read(spark, scratch).count() == 200
    CAT.apply_updates(spark.createDataFrame([], UPDATES), scratch, 2)  # an empty batch is a version of its own
    assert CAT.read(spark, scratch).where("name = 'seven'").count() == 1 and CAT.read(spark, scratch).count() == 200


def test_no_catalogue(spark, scratch):
    with pytest.raises(FileNotFoundError):
        CAT.read(spark, scratch)
    with pytest.raises(FileNotFoundError):
        CAT.apply_updates(spark.createDataFrame([], UPDATES), scratch, 1)


def results(spark, rows):
    """Scrape results of (page_id, app_id, captured_at, name, price, [(review id, rating label)])."""
    raw = [(p, a, f"u{p}", at, name, None, None, None, price, [(k, rid, lab, None, "t", f"text {p}", None, None) for k, (rid, lab) in enumerate(rv)], None)
           for p, a, at, name, price, rv in rows]
    df = spark.createDataFrame(raw, """page_id long, app_id long, url string, captured_at timestamp_ntz, name string, developer_name string, description string,
        icon_url string, raw_price string, reviews array<struct<pos int, review_id string, rating_label string, rating_text string, title string,
        content string, author_name string, date_text string>>, parse_error string""")
    return X.scrape_results(df, F.col("captured_at"), keep=("app_id", "captured_at"))


def test_capture_time_decides_not_the_page_id(spark, scratch):
    CAT.create(apps(spark, 5), f"{scratch}/catalogue", buckets=4)
    late, early = datetime(2026, 3, 1), datetime(2026, 1, 1)
    batch = results(spark, [(1, 3, late, "late name", "$1.00", [("r", "5 out of 5")]), (9, 3, early, "early name", "$2.00", [("r", "1 out of 5")]),
                            (2, 99, late, "unknown app", "$3.00", [])])
    for _ in range(2):
        S.commit_scrape_batch(batch, scratch, 0)
    assert {r.id: r.name for r in CAT.read(spark, f"{scratch}/catalogue").collect()} == {0: "app 0", 1: "app 1", 2: "app 2", 3: "late name", 4: "app 4"}
    assert [(r.app_id, r.rating, r.content) for r in spark.read.parquet(f"{scratch}/reviews").collect()] == [(3, 1, "text 1")]  # first rating, last text
    assert spark.read.parquet(f"{scratch}/price_history").count() == 3


def test_commit_writes_the_tables_asked_for(spark, scratch):
    S.commit_scrape_batch(results(spark, [(1, 3, datetime(2026, 3, 1), "n", "$1.00", [("r", "5 out of 5")])]), scratch, 0, tables=("prices",))
    assert os.listdir(scratch) == ["price_history"]


def test_writers_by_rows(spark, scratch):
    """A hot month of one app gets more writers than the others."""
    rows = spark.range(1000).selectExpr("cast(id as string) id", "1L app_id", "'US' region", "'USD' currency", "cast(1 as decimal(10,2)) price",
                                        "case when id < 900 then timestamp_ntz'2026-01-05 00:00:00' else timestamp_ntz'2026-02-05 00:00:00' end ts")
    path = os.path.join(scratch, "prices")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows would fit one task
    try:
        S.write_price_history(rows, path, rows_per_file=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = {m: sum(f.endswith(".parquet") for f in os.listdir(os.path.join(path, f"price_month={m}"))) for m in ("202601", "202602")}
    assert n["202602"] == 1 and 2 <= n["202601"] <= 9
