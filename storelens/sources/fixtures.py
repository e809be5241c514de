"""Stand-in domain tables derived from the driver's generic tables.

The jobs speak app-store vocabulary (apps, price observations, reviews, fetch
attempts); the test data is TPC-H-ish.  Each builder here is a narrow
projection over one driver table (column pruning reaches the Parquet scan) and
is deterministic, so the DuckDB oracle can rebuild the same rows with SQL.
All of them grow linearly with the input table — no sampling, no caps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.plans.parallel import spread
from storelens.sources.tables import read_table

EPOCH_2024 = "2024-01-01 00:00:00"


# Fixed endings of review texts, by length (copies stay copies), so that every cleaning and masking rule meets its case.
REVIEW_ENDINGS = ["", " <b>bold</b><br/> <a href='/x'>link</a>", " see https://shop.example/a?b=1 or www.x.example/y now",
                  " \U0001F600\U0001F44D ok \u2764", " ssn 123-45-6789.", " write to jo.doe@mail.example", " HTTPS://A.EXAMPLE x <i>", "\t call +1 (555) 123-4567", " card 4111 1111 1111 1111"]


def fx_reviews(spark: SparkSession, sf_dir: str, read=read_table) -> DataFrame:
    """documents -> reviews: one review per document, whole text and a stated ending as content."""
    d = spread(read(spark, sf_dir, "documents", ["doc_id", "text", "source"]), key="doc_id")
    ending = F.element_at(F.array(*[F.lit(e) for e in REVIEW_ENDINGS]), (F.char_length("text") % len(REVIEW_ENDINGS) + 1).cast("int"))
    d = d.select("doc_id", "source", F.concat("text", ending).alias("text"))
    return d.select(
        F.col("doc_id").cast("string").alias("external_review_id"),
        F.col("source").alias("app_id"),
        (F.col("doc_id") % 7).cast("int").alias("rating"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),  # first line; stops at the first newline
        F.col("text").alias("content"),
        F.nullif(F.regexp_extract("text", r"^\s*(\S+(?:\s+\S+)?)", 1), F.lit("")).alias("author_name"),
        F.timestamp_add("HOUR", F.col("doc_id") % 720,
                       F.lit(EPOCH_2024).cast("timestamp_ntz")).alias("review_date"),
        F.col("doc_id").alias("pos"),
    )


def fx_prices(spark: SparkSession, sf_dir: str, read=read_table) -> DataFrame:
    """events -> price observations per (app, region, currency)."""
    e = read(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("app_id"),
        F.col("event_type").alias("region"),
        F.lit("USD").alias("currency"),
        F.col("value").cast("decimal(10,2)").alias("price"),
        F.col("ts"),
    )


# Fixed shapes of the raw (pre-firewall) price feed; chosen so every branch of
# the price/currency/region rules is exercised.
RAW_PRICE_SHAPES = 6      # '$'||dec, dec with ',', 'Free', 'N/A', '1,234.56', dec||' USD'
RAW_CURRENCIES = ["$", "eur", "  usd ", "R$", "XYZ", "kr", "", "Fr"]
RAW_REGIONS = ["us", " mx ", "BR", "toolong", "de"]


def fx_raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> raw scraped price rows (text price, free-form currency/region)."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    dec = F.col("value").cast("decimal(10,2)").cast("string")
    k = F.col("event_id") % 6
    raw_price = (F.when(k == 0, F.concat(F.lit("$"), dec))
                 .when(k == 1, F.regexp_replace(dec, r"\.", ","))
                 .when(k == 2, F.lit("Free"))
                 .when(k == 3, F.lit("N/A"))
                 .when(k == 4, F.lit("1,234.56"))
                 .otherwise(F.concat(dec, F.lit(" USD"))))
    cur = F.element_at(F.array(*[F.lit(c) for c in RAW_CURRENCIES]), (F.col("event_id") % 8 + 1).cast("int"))
    reg = F.element_at(F.array(*[F.lit(r) for r in RAW_REGIONS]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("scrape_id"),
        F.col("user_id").alias("app_id"),
        F.col("ts"),
        raw_price.alias("raw_price"),
        cur.alias("raw_currency"),
        reg.alias("raw_region"),
    )


def fx_prices_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> a multi-year price series (50 apps, 1995-2001) for monthly layout/trends."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 50).alias("app_id"),
        F.lit("US").alias("region"),
        F.lit("USD").alias("currency"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("price"),
        F.col("o_orderdate").alias("ts"),
    )


def fx_attempts(spark: SparkSession, sf_dir: str, read=read_table) -> DataFrame:
    """events -> fetch attempts; an 'error' event is a failed fetch."""
    e = read(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    return e.select(
        F.col("event_id").alias("attempt_id"),
        F.col("user_id").alias("app_id"),
        F.col("ts"),
        (F.col("event_type") == "error").alias("failed"),
        F.when(F.col("user_id") % 2 == 0, F.lit("APPLE_APP_STORE"))
         .otherwise(F.lit("GOOGLE_PLAY_STORE")).alias("store"),
    )


# Fixed mapping of event types to star ratings for the churn stand-in.
RATING_OF_EVENT = {"error": 1, "signup": 2, "click": 3, "view": 4}


def fx_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> reviews with a rating (non-purchase events)."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    m = F.create_map(*[x for k, v in RATING_OF_EVENT.items() for x in (F.lit(k), F.lit(v))])
    return (e.where(F.col("event_type") != "purchase")
             .select(F.col("event_id").alias("review_id"), F.col("user_id").alias("app_id"),
                     F.col("ts"), F.try_element_at(m, F.col("event_type")).cast("int").alias("rating")))


def fx_purchase_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> the purchase events as one price series per app (churn stand-in)."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return (e.where(F.col("event_type") == "purchase")
             .select(F.col("event_id").alias("id"), F.col("user_id").alias("app_id"),
                     F.lit("US").alias("region"), F.lit("USD").alias("currency"),
                     F.col("value").cast("decimal(10,2)").alias("price"), F.col("ts")))


def fx_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> app catalogue."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("com."), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", ""), F.lit("."),
                 F.col("p_partkey").cast("string")).alias("bundle_id"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("APPLE_APP_STORE"))
         .otherwise(F.lit("GOOGLE_PLAY_STORE")).alias("store"),
        F.col("p_type").alias("developer_name"),
        (F.col("p_size") % 10 != 0).alias("is_active"),
    )


def fx_access(spark: SparkSession, sf_dir: str, read=read_table) -> DataFrame:
    """events -> API access log (caller ip = user)."""
    e = read(spark, sf_dir, "events", ["event_id", "ts", "user_id"])
    return e.select(F.col("event_id").alias("request_id"),
                    F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."),
                             (F.col("user_id") / 256).cast("bigint").cast("string")).alias("ip"),
                    F.col("ts"))


def fx_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> release notes: app = conversation, version = turn."""
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    return c.select(F.col("conv_id").alias("app_id"), F.col("turn").alias("version"),
                    F.col("text").alias("notes"))


def fx_review_batch(spark: SparkSession, sf_dir: str, read=read_table) -> DataFrame:
    """documents -> one capture batch where copies of a review share an id: the
    id is the md5 of the whole text, so equal texts of a source are one review."""
    r = fx_reviews(spark, sf_dir, read)
    return r.withColumn("external_review_id", F.md5("content"))


def fx_stored_review_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels -> keys of reviews already stored (the labelled documents)."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id"])
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source"])
    return (d.join(lab, "doc_id", "left_semi")
             .select(F.col("source").alias("app_id"), F.col("doc_id").cast("string").alias("external_review_id")))


def fx_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> scrape requests: request = order, requested app = customer + 1000
    (ids past the catalogue are unknown apps)."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return o.select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") + 1000).alias("app_id"))


def fx_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_apps with the optional text columns a catalogue row carries."""
    return (fx_apps(spark, sf_dir)
            .withColumn("description", F.lit(None).cast("string"))
            .withColumn("icon_url", F.lit(None).cast("string")))


def fx_scraped_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> app records parsed from this round's pages, one per catalogued app:
    renamed apps, blank developer for even sizes, description = type."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_size"])
    return (p
             .select(F.col("p_partkey").alias("app_id"), F.upper("p_name").alias("name"),
                     F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.concat("p_type", F.lit(" Inc")))
                      .alias("developer_name"),
                     F.col("p_type").alias("description"), F.lit(None).cast("string").alias("icon_url")))


def fx_raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> raw page fields as extraction gives them, with every kind of
    trouble: nameless and over-long apps, free, missing and excessive prices, blank
    urls, and reviews with missing, empty or blank ids and ratings from none to 9."""
    d = read_table(spark, sf_dir, "documents", ["doc_id"])
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")

    def review(k):
        at = F.col("doc_id") + k
        rid = (F.when(at % 11 == 0, F.lit("")).when(at % 11 == 1, F.lit(None).cast("string")).when(at % 29 == 2, F.lit("   "))
               .otherwise(F.concat(F.lit("r"), (at % 40).cast("string"))))
        label = (F.when(at % 13 == 0, F.lit("no rating")).when(at % 31 == 3, F.lit("9 stars"))
                 .when(at % 37 == 4, F.lit("")).otherwise(F.concat((1 + at % 5).cast("string"), F.lit(" out of 5"))))
        return F.struct(
            k.cast("int").alias("pos"), rid.alias("review_id"), label.alias("rating_label"), F.lit("4").alias("rating_text"),
            F.concat(F.lit(" title "), n).alias("title"), F.lit("content").alias("content"),
            F.when(at % 7 == 0, F.lit(" ")).otherwise(F.lit(" Ann ")).alias("author_name"),
            F.when(at % 5 == 0, F.lit("soon")).otherwise(F.lit("Jan 5, 2025")).alias("date_text"))

    shapes = ["Free", "$4.99", "N/A", None, "123456789.99", "1,50", ""]
    return d.select(
        i.alias("page_id"),
        F.when(i % 17 == 0, F.lit("  ")).otherwise(F.concat(F.lit("https://s/app/"), (i % 50).cast("string"), F.lit("?page="), n)).alias("url"),
        F.when(i % 9 == 0, F.lit(None).cast("string")).when(i % 19 == 1, F.repeat(F.lit("n"), 256))
         .otherwise(F.concat(F.lit("  App "), n, F.lit(" "))).alias("name"),
        F.when(i % 3 == 0, F.lit(" ")).otherwise(F.lit(" Dev ")).alias("developer_name"),
        F.lit("about").alias("description"), F.concat(F.lit("https://i/"), n).alias("icon_url"),
        F.element_at(F.array(*[F.lit(x).cast("string") for x in shapes]), (i % 7 + 1).cast("int")).alias("raw_price"),
        F.when(i % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), i % 4 - 1), review)).otherwise(
            F.transform(F.slice(F.sequence(F.lit(0).cast("long"), F.lit(0).cast("long")), 1, 0), review)).alias("reviews"),
        F.lit(None).cast("string").alias("parse_error"))


def fx_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_raw_pages as captures of apps: four pages an app, taken in an order of
    their own between December 2025 and late 2027 (one month before the monthly layout begins)."""
    i = F.col("page_id")
    hours = (i * 37) % 16000
    return fx_raw_pages(spark, sf_dir).withColumns({
        "app_id": F.floor(i / 4).cast("long"),
        "captured_at": F.timestamp_add("HOUR", hours.cast("int"), F.lit("2025-12-01 00:00:00").cast("timestamp_ntz"))})


def fx_review_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> review vectors with 0 to 3 rewritten versions each (components scaled by up to 15 %, their cosine above 0.97)."""
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    e = e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"),
                 F.explode(F.sequence(F.lit(0), (F.col("vec_id") % 4).cast("int"))).alias("c"))
    scale = lambda i: 1 + F.col("c") * (((i + 1) * 7 + F.col("c") * 3) % 5 - 2) / F.lit(40.0)
    return e.select((F.col("vec_id") * 4 + F.col("c")).alias("vec_id"), F.transform("v", lambda x, i: x * scale(i)).alias("embedding"))
