"""Randomised agreement of the price and date parsers with a direct Python
model of the record-level rules (Decimal parsing, strptime with three formats)."""

import re
from datetime import datetime
from decimal import Decimal, InvalidOperation

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storelens.functions import normalize as N


def model_price(raw):
    if not raw:
        return None
    if raw.lower() == "free":
        return Decimal("0")
    cleaned = re.sub(r"[^0-9.,]", "", raw).replace(",", ".")
    try:
        return Decimal(cleaned)
    except InvalidOperation:
        return None


def model_date(text):
    if not text:
        return None
    for fmt in ("%b %d, %Y", "%B %d, %Y", "%Y-%m-%d"):
        try:
            return datetime.strptime(text, fmt)
        except ValueError:
            continue
    return None


price_parts = st.sampled_from(["$", "€", "USD", " ", "1", "23", "4", ".", ",", "99", "0", "Free", "free",
                               "FREE", "-", "N/A", "kr", "9999"])
prices = st.lists(st.lists(price_parts, max_size=6).map("".join), min_size=150, max_size=150)

months = ["Jan", "jan", "JAN", "January", "FEBRUARY", "feb", "Sept", "Sep", "May", "Dec", "december", "Foo"]
days = ["1", "01", "5", "09", "10", "29", "30", "31", "32", "0", "00", " 5"]
years = ["2025", "2024", "1999", "25", "20250"]
named = st.builds(lambda m, sep, d, comma, y: f"{m}{sep}{d}{comma}{y}", st.sampled_from(months),
                  st.sampled_from([" ", "  ", "\t"]), st.sampled_from(days), st.sampled_from([", ", ",", ",  ", " "]),
                  st.sampled_from(years))
iso = st.builds(lambda y, m, d: f"{y}-{m}-{d}", st.sampled_from(years),
                st.sampled_from(["1", "01", "2", "02", "12", "13", "0"]), st.sampled_from(days))
dates = st.lists(st.one_of(named, iso, st.just(""), st.just("15/01/2025")), min_size=150, max_size=150)


@settings(max_examples=3, deadline=None)
@given(prices)
def test_parse_price_matches_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    for r in df.select("x", N.parse_price("x").alias("p")).collect():
        exp = model_price(r["x"])
        assert (r["p"] is None and exp is None) or (r["p"] is not None and exp is not None and r["p"] == exp), r


@settings(max_examples=3, deadline=None)
@given(dates)
def test_parse_date_matches_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    for r in df.select("x", N.parse_date(F.col("x")).alias("d")).collect():
        exp = model_date(r["x"])
        assert (r["d"] is None and exp is None) or (r["d"] == exp), r
