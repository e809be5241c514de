"""Normaliser and firewall cases ported from the reference's validation tests."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storelens.functions import normalize as N
from storelens.operators import firewall as V


def ev(spark, expr, value, t="string"):
    return spark.createDataFrame([(value,)], f"x {t}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,code", [("usd", "USD"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"),
                                      ("  eur  ", "EUR"), ("kr", "SEK"), ("R$", "BRL"), ("Fr", "CHF")])
def test_currency_ok(spark, raw, code):
    assert ev(spark, N.normalize_currency, raw) == code
    assert ev(spark, N.currency_rule, raw) is None


@pytest.mark.parametrize("raw,msg", [("XYZ", "Unknown currency: 'XYZ'"), ("KR", "Unknown currency: 'KR'"),
                                     ("   ", "Currency cannot be empty"), ("", "Currency cannot be empty")])
def test_currency_errors(spark, raw, msg):
    assert ev(spark, N.normalize_currency, raw) is None
    assert ev(spark, N.currency_rule, raw) == msg


@pytest.mark.parametrize("raw,val", [
    ("$4.99", Decimal("4.99")), ("Free", Decimal(0)), ("FREE", Decimal(0)), ("4,99 €", Decimal("4.99")),
    ("$1,234.56", None), ("1,234", Decimal("1.234")), ("-4.99", Decimal("4.99")), ("4.", Decimal(4)),
    (".99", Decimal("0.99")), ("", None), (".", None), ("N/A", None), (None, None),
])
def test_parse_price(spark, raw, val):
    got = ev(spark, N.parse_price, raw)
    assert (got is None and val is None) or got == val


@pytest.mark.parametrize("aria,text,val", [("4 out of 5", None, 4), ("", "3 stars", 3), (None, "0 stars", 0),
                                           ("4.5 out of 5", None, 4), (None, "none", None)])
def test_parse_rating(spark, aria, text, val):
    df = spark.createDataFrame([(aria, text)], "a string, t string")
    assert df.select(N.parse_rating("a", "t").alias("r")).first()["r"] == val


@pytest.mark.parametrize("raw,val", [
    ("Jan 15, 2025", "2025-01-15"), ("JAN 5, 2025", "2025-01-05"), ("January 05, 2025", "2025-01-05"),
    ("2025-1-5", "2025-01-05"), ("2025-01-15", "2025-01-15"), ("15/01/2025", None), ("Feb 30, 2025", None),
    ("Sept 1, 2025", None), ("Jan 5, 25", None), (None, None),
])
def test_parse_date(spark, raw, val):
    got = ev(spark, N.parse_date, raw)
    assert (got is None and val is None) or got.strftime("%Y-%m-%d") == val


def test_region(spark):
    assert ev(spark, N.normalize_region, " us ") == "US"
    assert ev(spark, N.region_rule, "toolong") == "region exceeds max length of 5"
    assert ev(spark, N.region_rule, "") is None


def test_validate_prices(spark):
    rows = [(1, "$9.99", "USD", "US"), (2, "-1", "USD", "US"), (3, "100000000", "USD", "US"),
            (4, "99999999.99", "usd", "us"), (5, "0", "INVALID", "US"), (6, "1", "eur", "TOOLONG"),
            (7, "N/A", "USD", "US")]
    df = spark.createDataFrame(rows, "scrape_id int, raw_price string, raw_currency string, raw_region string") \
        .withColumn("ts", F.lit("2025-06-01 12:00:00").cast("timestamp_ntz"))
    out = {r["scrape_id"]: r for r in V.validate_prices(df, keep=("scrape_id",)).collect()}
    assert out[1]["outcome"] == "accepted" and out[1]["price"] == Decimal("9.99")
    assert out[2]["outcome"] == "accepted" and out[2]["price"] == Decimal("1.00")  # sign dropped by the parser
    assert out[3]["violations"] == ["Price exceeds maximum of 99999999.99"]
    assert out[4]["outcome"] == "accepted" and (out[4]["currency"], out[4]["region"]) == ("USD", "US")
    assert out[5]["violations"] == ["Unknown currency: 'INVALID'"]
    assert out[6]["violations"] == ["region exceeds max length of 5"]
    assert out[7]["outcome"] == "no_price" and out[7]["violations"] == []
    counts = {(r["outcome"], r["rule"]): r["n"] for r in V.violation_counts(
        V.validate_prices(df, keep=("scrape_id",)), "outcome").collect()}
    assert counts[("accepted", None)] == 3 and counts[("no_price", None)] == 1


def test_validate_apps(spark):
    rows = [("  My App ", " com.example.app ", "   ", None, None), ("", "b", None, None, None),
            ("x" * 256, "b", None, None, None), ("a", "b", None, None, "h" * 513)]
    df = spark.createDataFrame(rows, "name string, bundle_id string, developer_name string, "
                                     "description string, icon_url string")
    out = V.validate_apps(df).collect()
    assert (out[0]["name"], out[0]["bundle_id"], out[0]["developer_name"], out[0]["violations"]) == \
        ("My App", "com.example.app", None, [])
    assert out[1]["violations"] == ["name cannot be empty"]
    assert out[2]["violations"] == ["name exceeds max length of 255"]
    assert out[3]["violations"] == ["icon_url exceeds max length of 512"]


def test_validate_reviews(spark):
    rows = [("  rev-001  ", 4, "  Great  ", None), ("r", 0, None, None), ("r", 6, None, None),
            ("   ", 1, None, None), ("r", 5, "t" * 501, None), ("r", 1, None, "a" * 256)]
    df = spark.createDataFrame(rows, "external_review_id string, rating int, title string, author_name string") \
        .withColumn("content", F.lit(" raw ")).withColumn("review_date", F.lit(None).cast("timestamp_ntz"))
    out = V.validate_reviews(df).collect()
    assert (out[0]["external_review_id"], out[0]["title"], out[0]["content"], out[0]["violations"]) == \
        ("rev-001", "Great", " raw ", [])
    assert out[1]["violations"] == out[2]["violations"] == ["Rating must be between 1 and 5"]
    assert out[3]["violations"] == ["external_review_id cannot be empty"]
    assert out[4]["violations"] == ["title exceeds max length of 500"]
    assert out[5]["violations"] == ["author_name exceeds max length of 255"]


def test_audits(spark):
    df = spark.createDataFrame([(1, "a", "APPLE_APP_STORE"), (2, "a", "APPLE_APP_STORE"), (3, None, "OTHER")],
                               "id int, bundle_id string, store string")
    dup = V.unique_audit(df, ["bundle_id", "store"], "apps").collect()
    assert [(r["key"], r["n_rows"]) for r in dup] == [("a|APPLE_APP_STORE", 2)]
    aud = {(r["column_name"], r["rule"]): r["n_violations"] for r in
           V.null_enum_audit(df, "apps", ["bundle_id"], {"store": list(N.STORES)}).collect()}
    assert aud == {("bundle_id", "null"): 1, ("store", "enum"): 1}
    parents = spark.createDataFrame([(1,)], "id int")
    child = spark.createDataFrame([(1, "x"), (9, "y"), (None, "z")], "app_id int, r string")
    assert sorted(r["r"] for r in V.fk_audit(child, parents, "app_id", "id").collect()) == ["y", "z"]


@pytest.mark.parametrize("raw,val", [("2025-06-01 12:00:00", "2025-06-01 12:00:00"),
                                     ("2025-06-01T12:00:00Z", "2025-06-01 12:00:00"),
                                     ("2025-06-01T12:00:00-05:00", "2025-06-01 17:00:00")])
def test_to_utc(spark, raw, val):
    assert ev(spark, N.to_utc, raw).strftime("%Y-%m-%d %H:%M:%S") == val


def test_split_accepted_and_results(spark):
    df = spark.createDataFrame([("  https://x/y  ",), ("   ",), (None,)], "url string")
    v = V.validate_results(df)
    ok, bad = V.split_accepted(v)
    assert [r["url"] for r in ok.collect()] == ["https://x/y"]
    assert sorted(r["violations"][0] for r in bad.collect()) == ["url cannot be empty"] * 2


def test_digits_of_other_scripts_and_limits(spark):
    rows = ["٣", "１２.５０", "9" * 30, "99999999.99", "99999999.99000000001", "99999999.98999999999", "1.00000000001"]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    p = [r[0] for r in df.select(N.parse_price("x")).collect()]
    ok = [r[0] is None for r in df.select(N.price_rule(N.parse_price("x"))).collect()]
    assert [int(v) for v in p[:2]] == [3, 12] and ok == [True, True, False, True, False, True, True]
    r = spark.createDataFrame([("٤ من ٥",), ("x",)], "x string").select(N.parse_rating("x", F.lit(None).cast("string"))).collect()
    assert [v[0] for v in r] == [4, None]


def test_unreadable_timestamps_and_quotes(spark):
    df = spark.createDataFrame([("no time",), ("2025-01-02 03:04:05",)], "x string")
    assert [r[0] is None for r in df.select(N.to_utc("x")).collect()] == [True, False]
    texts = ["a", "it's", 'say "x"', "it's \"x\"", "a\\b", "line\nbreak"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [r[0] for r in df.select(N.quoted(F.col("x"))).collect()] == [repr(t) for t in texts]
