"""Named queries: (spark, sf_dir) -> DataFrame over the whole input tables.

Each entry composes stand-in views (``sources.fixtures``) with an operator
(``operators.*``) and flattens nested output so it can be compared with the
DuckDB twin in ``plans.oracle``.  Parameters (app ids, dates, limits) are the
query's own arguments, not sampling: every entry scans its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions import normalize as N
from storelens.functions import text as T
from storelens.operators import catalog as C
from storelens.operators import extract as X
from storelens.operators import firewall as V
from storelens.operators import health as H
from storelens.operators import prices as P
from storelens.operators import reviews as R
from storelens.plans.parallel import spread
from storelens.session import use_utc
from storelens.sources import catalogue as CAT
from storelens.sources import fixtures as FX
from storelens.sources import sinks as S
from storelens.streaming import jobs as ST
from storelens.streaming import replay as RP

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return deco


def _joined(col: str = "violations"):
    return F.array_join(F.col(col), "; ").alias(col)


# --- reviews / text -----------------------------------------------------------
@query("process_reviews")
def q_process_reviews(spark, sf_dir):
    """B1 over every document (whole texts)."""
    return R.flatten_metadata(R.process_reviews(FX.fx_reviews(spark, sf_dir)))


@query("clean_text")
def q_clean_text(spark, sf_dir):
    """T5 scalar clean (emoji step, case-insensitive URLs) over whole contents."""
    r = FX.fx_reviews(spark, sf_dir)
    return r.select("external_review_id", T.clean_text("content").alias("clean"))


@query("anonymize_pii")
def q_anonymize_pii(spark, sf_dir):
    """T11 email -> card -> SSN -> phone over whole contents."""
    r = FX.fx_reviews(spark, sf_dir)
    return r.select("external_review_id", T.anonymize_pii("content").alias("masked"))


@query("author_initials")
def q_author_initials(spark, sf_dir):
    """T10 author -> initials."""
    r = FX.fx_reviews(spark, sf_dir)
    return r.select("external_review_id", "author_name", T.author_initials("author_name").alias("initials"))


@query("pii_flags")
def q_pii_flags(spark, sf_dir):
    """T14 flags on raw content."""
    r = FX.fx_reviews(spark, sf_dir)
    f = T.pii_flags("content")
    return r.select("external_review_id", *[c.alias(n) for n, c in f.items()])


@query("pii_rates")
def q_pii_rates(spark, sf_dir):
    """A7 PII prevalence per app from the processing metadata."""
    return R.pii_rates(R.process_reviews(FX.fx_reviews(spark, sf_dir), keep=("app_id",)))


@query("metadata_query")
def q_metadata_query(spark, sf_dir):
    """P7 reviews selected by a metadata flag."""
    p = R.process_reviews(FX.fx_reviews(spark, sf_dir), keep=("app_id",))
    return R.metadata_query(p, "had_credit_card").select(
        "app_id", "external_review_id", F.col("processing_metadata.original_length").alias("original_length"))


@query("rating_summary")
def q_rating_summary(spark, sf_dir):
    """A8 per app and month."""
    return R.rating_summary(FX.fx_reviews(spark, sf_dir)).withColumn("month", F.col("month").cast("timestamp_ntz"))


@query("weekly_report")
def q_weekly_report(spark, sf_dir):
    """A9 ROLLUP(app, week)."""
    w = R.weekly_report(FX.fx_reviews(spark, sf_dir))
    return w.withColumn("week", F.col("week").cast("timestamp_ntz")).withColumn("level", F.col("level").cast("int"))


@query("reviews_page")
def q_reviews_page(spark, sf_dir):
    """L3 newest reviews of one app."""
    r = FX.fx_reviews(spark, sf_dir).select("app_id", "external_review_id", "review_date", "rating")
    return R.reviews_page(r, "src3", limit=20)


@query("new_reviews")
def q_new_reviews(spark, sf_dir):
    """J2/U2 batch minus already stored (anti join)."""
    b = FX.fx_reviews(spark, sf_dir).select("app_id", "external_review_id", "rating")
    return R.new_reviews(b, FX.fx_stored_review_keys(spark, sf_dir))


@query("review_merge")
def q_review_merge(spark, sf_dir):
    """J3/W7 duplicates in one batch: first rating/date, last processed text."""
    m = R.merge_batch_reviews(FX.fx_review_batch(spark, sf_dir))
    return m.select("app_id", "external_review_id", "rating", "review_date", "title", "content", "author_name",
                    F.col("metadata.original_length").alias("original_length"),
                    F.col("metadata.processed_length").alias("processed_length"))


# --- normalisers / firewall -------------------------------------------------------
@query("normalize_currency")
def q_normalize_currency(spark, sf_dir):
    """N1 symbol/code -> ISO, with the failure message."""
    r = FX.fx_raw_prices(spark, sf_dir)
    return r.select("scrape_id", "raw_currency", N.normalize_currency("raw_currency").alias("currency"),
                    N.currency_rule("raw_currency").alias("error"))


@query("parse_price")
def q_parse_price(spark, sf_dir):
    """N6 price text -> exact decimal."""
    r = FX.fx_raw_prices(spark, sf_dir)
    return r.select("scrape_id", "raw_price", N.parse_price("raw_price").alias("price"))


@query("validate_prices")
def q_validate_prices(spark, sf_dir):
    """V2 over the raw price feed."""
    v = V.validate_prices(FX.fx_raw_prices(spark, sf_dir), keep=("scrape_id", "app_id"))
    return v.select("scrape_id", "app_id", "price", "currency", "region", "ts", _joined(), "outcome")


@query("quarantine_counts")
def q_quarantine_counts(spark, sf_dir):
    """V8 accepted / rejected / no-price counts and per-rule counts."""
    v = V.validate_prices(FX.fx_raw_prices(spark, sf_dir), keep=("scrape_id",))
    return V.violation_counts(v, "outcome")


@query("validate_reviews")
def q_validate_reviews(spark, sf_dir):
    """V3 over every review."""
    v = V.validate_reviews(FX.fx_reviews(spark, sf_dir), keep=("app_id",))
    return v.select("app_id", "external_review_id", "rating", "title", "author_name", "review_date", _joined())


@query("validate_apps")
def q_validate_apps(spark, sf_dir):
    """V1 over the catalogue."""
    v = V.validate_apps(FX.fx_catalog(spark, sf_dir), keep=("id",))
    return v.select("id", "name", "bundle_id", "developer_name", "icon_url", _joined())


@query("unique_audit")
def q_unique_audit(spark, sf_dir):
    """V5 duplicate keys on the three tables (plus the capture batch's review ids)."""
    return V.union_all([
        V.unique_audit(FX.fx_apps(spark, sf_dir), ["bundle_id", "store"], "apps"),
        V.unique_audit(FX.fx_reviews(spark, sf_dir), ["app_id", "external_review_id"], "reviews"),
        V.unique_audit(FX.fx_review_batch(spark, sf_dir), ["app_id", "external_review_id"], "review_batch"),
        V.unique_audit(FX.fx_prices(spark, sf_dir), ["id", "ts"], "price_history"),
    ])


@query("fk_audit")
def q_fk_audit(spark, sf_dir):
    """V6 reviews whose app is not in the catalogue, counted per app."""
    orphans = V.fk_audit(FX.fx_ratings(spark, sf_dir), FX.fx_apps(spark, sf_dir), "app_id", "id")
    return orphans.groupBy("app_id").agg(F.count(F.lit(1)).alias("n_orphans"))


@query("null_enum_audit")
def q_null_enum_audit(spark, sf_dir):
    """V7 not-null and enum checks."""
    return V.union_all([
        V.null_enum_audit(FX.fx_apps(spark, sf_dir), "apps", ["name", "bundle_id", "store", "is_active"],
                          {"store": list(N.STORES)}),
        V.null_enum_audit(FX.fx_prices(spark, sf_dir), "price_history", ["price", "currency", "region", "ts"]),
        V.null_enum_audit(FX.fx_reviews(spark, sf_dir), "reviews", ["app_id", "external_review_id", "rating"]),
    ])


# --- catalogue -------------------------------------------------------------------
@query("store_urls")
def q_store_urls(spark, sf_dir):
    """P1/P2/P3 URLs per app and region."""
    return C.store_urls(FX.fx_apps(spark, sf_dir))


@query("request_lookup")
def q_request_lookup(spark, sf_dir):
    """S2/J1/P4 requests looked up in the catalogue by app id."""
    return C.request_lookup(FX.fx_requests(spark, sf_dir), FX.fx_apps(spark, sf_dir))


@query("batch_enqueued")
def q_batch_enqueued(spark, sf_dir):
    """A2 enqueued count."""
    return C.enqueued_count(FX.fx_requests(spark, sf_dir))


@query("apps_merge")
def q_apps_merge(spark, sf_dir):
    """S5 catalogue updated from scraped records."""
    return C.apps_merge(FX.fx_catalog(spark, sf_dir), FX.fx_scraped_apps(spark, sf_dir))


@query("worklist")
def q_worklist(spark, sf_dir):
    """P6/P8 monitored apps with scrape mode."""
    return C.worklist(FX.fx_apps(spark, sf_dir), FX.fx_attempts(spark, sf_dir), "2024-01-30 12:00:00")


@query("apps_page")
def q_apps_page(spark, sf_dir):
    """L4 listing, second page after a cursor."""
    return C.apps_page(FX.fx_apps(spark, sf_dir).select("id", "name", "bundle_id", "store"),
                       limit=50, after=("b", 0))


@query("store_union")
def q_store_union(spark, sf_dir):
    """X10/U1 per-store feeds unified."""
    a = FX.fx_apps(spark, sf_dir)
    apple = a.where(F.col("store") == C.APPLE).select("id", "name", "bundle_id", "developer_name")
    google = a.where(F.col("store") == C.GOOGLE).select("id", "name", F.col("bundle_id").alias("bundle_id"))
    return C.store_union(apple, google)


# --- prices -------------------------------------------------------------------------
@query("price_partitions")
def q_price_partitions(spark, sf_dir):
    """S3/A3 rows per monthly partition (series shifted into the partitioned years)."""
    p = FX.fx_prices_long(spark, sf_dir).withColumn(
        "ts", F.add_months("ts", 372).cast("timestamp_ntz"))
    return P.with_price_month(p).groupBy("price_month").agg(F.count(F.lit(1)).alias("n_rows"))


@query("running_avg")
def q_running_avg(spark, sf_dir):
    """W1 running average per app (RANGE frame, ties share)."""
    r = P.running_avg(FX.fx_prices_long(spark, sf_dir))
    return r.select("app_id", "id", "ts", "price", "run_n", "running_avg")


@query("price_changes")
def q_price_changes(spark, sf_dir):
    """W2 changes per (app, region, currency)."""
    return P.price_changes(FX.fx_prices(spark, sf_dir))


@query("offers")
def q_offers(spark, sf_dir):
    """W3 >15 % under the trailing 30-day average."""
    return P.offers(FX.fx_prices(spark, sf_dir))


@query("latest_price")
def q_latest_price(spark, sf_dir):
    """W4 latest observation per series."""
    return P.latest_price(FX.fx_prices(spark, sf_dir))


@query("churn")
def q_churn(spark, sf_dir):
    """W5/J6 negative-review spikes after price rises."""
    return P.churn_alerts(FX.fx_purchase_prices(spark, sf_dir), FX.fx_ratings(spark, sf_dir))


@query("asof_price")
def q_asof_price(spark, sf_dir):
    """J7 price in force at each review."""
    return P.asof_price(FX.fx_ratings(spark, sf_dir), FX.fx_purchase_prices(spark, sf_dir), "review_id")


@query("price_trends")
def q_price_trends(spark, sf_dir):
    """A4 monthly trend table."""
    return P.price_trends(FX.fx_prices_long(spark, sf_dir))


@query("compare_apps")
def q_compare_apps(spark, sf_dir):
    """A5 three apps side by side per month."""
    return P.compare_apps(FX.fx_prices_long(spark, sf_dir), [1, 2, 3])


@query("price_history_page")
def q_price_history_page(spark, sf_dir):
    """L1/L2 one app's history in a range, second page via keyset cursor."""
    return P.price_history_page(FX.fx_prices_long(spark, sf_dir), 7, "1996-01-01", "1998-01-01",
                                limit=100, cursor=("1997-06-01 00:00:00", 10**12))


@query("top_movers")
def q_top_movers(spark, sf_dir):
    """L5 top 20 relative changes."""
    return P.top_movers(FX.fx_prices(spark, sf_dir), k=20)


@query("retention_split")
def q_retention_split(spark, sf_dir):
    """R1 prices kept 24 months, reviews 6 months."""
    p = P.retention_split(FX.fx_prices_long(spark, sf_dir), "ts", "2001-08-01", 24) \
        .select(F.lit("price_history").alias("table_name"), "retention")
    r = P.retention_split(FX.fx_reviews(spark, sf_dir), "review_date", "2024-07-15", 6) \
        .select(F.lit("reviews").alias("table_name"), "retention")
    return p.unionByName(r).groupBy("table_name", "retention").agg(F.count(F.lit(1)).alias("n_rows"))


# --- ingestion health ----------------------------------------------------------------
@query("sync_errors")
def q_sync_errors(spark, sf_dir):
    """W6 three or more failed fetches in a row."""
    return H.sync_errors(FX.fx_attempts(spark, sf_dir))


@query("health_hourly")
def q_health_hourly(spark, sf_dir):
    """A6 failure rate per hour and store."""
    return H.health_hourly(FX.fx_attempts(spark, sf_dir))


@query("rate_limit")
def q_rate_limit(spark, sf_dir):
    """ST4 batch twin: callers over the per-minute limit (limit 1 on this data)."""
    return H.rate_limit(FX.fx_access(spark, sf_dir), limit=1)


# --- extraction ---------------------------------------------------------------------------------
PAGES_CAPTURED_AT = "2024-01-31 00:00:00"


@query("extract_pages")
def q_extract_pages(spark, sf_dir):
    """X1-X8/A1/V4 every captured page -> one result row (rows-only check)."""

    pages = spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url", "html"), key="page_id")
    res = X.scrape_results(X.extract_raw(pages, X.PAGES_PROFILE), PAGES_CAPTURED_AT)
    return res.select("page_id", "url", "success", "error",
                      F.col("app.name").alias("name"), F.col("app.developer_name").alias("developer_name"),
                      F.col("app.description").alias("description"), F.col("app.icon_url").alias("icon_url"),
                      F.col("price.price").alias("price"), "has_app", "has_price", "review_count")


# --- similarity / search / changelog ------------------------------------------------------------
def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding", "label")


@query("similar_reviews")
def q_similar_reviews(spark, sf_dir):
    """G1 every review vector grouped under its most similar topic centroid."""
    from storelens.operators import search as S
    v = _vectors(spark, sf_dir)
    g = S.group_by_topic(v, S.centroids(v, "label"))
    return g.withColumn("similarity", F.round("similarity", 6))


@query("review_groups")
def q_review_groups(spark, sf_dir):
    """G1 review vectors and their rewritten versions, grouped at cosine 0.9."""
    from storelens.operators import grouping as G
    g = G.group_similar(FX.fx_review_versions(spark, sf_dir), threshold=0.9)
    return g.withColumn("similarity", F.round("similarity", 6))


@query("nearest_reviews")
def q_nearest_reviews(spark, sf_dir):
    """G2 five nearest review vectors to each topic centroid."""
    from storelens.operators import search as S
    v = _vectors(spark, sf_dir)
    n = S.nearest(v, S.centroids(v, "label"), k=5)
    return n.select("qid", "vec_id", F.col("rank").cast("long").alias("rank"),
                    F.round("similarity", 6).alias("similarity"))


@query("keyword_faults")
def q_keyword_faults(spark, sf_dir):
    """G3 fault keywords over every review text."""
    from storelens.operators import search as S
    return S.keyword_faults(FX.fx_reviews(spark, sf_dir))


@query("changelog_new_items")
def q_changelog_new_items(spark, sf_dir):
    """X11 new release-note items per version."""
    from storelens.operators import changelog as CL
    return CL.new_items(FX.fx_changelog(spark, sf_dir))


# --- remaining scalar and join rows ------------------------------------------------------------
@query("parse_ratings")
def q_parse_ratings(spark, sf_dir):
    """N7 rating from an aria-label ('<n> out of 5') or element text, over every review."""
    r = FX.fx_reviews(spark, sf_dir)
    label = F.when(F.col("pos") % 2 == 0, F.concat(F.col("rating").cast("string"), F.lit(" out of 5")))
    text = F.concat(F.col("rating").cast("string"), F.lit(" stars"))
    return r.select("external_review_id", N.parse_rating(label, text).alias("rating"),
                    N.rating_rule(N.parse_rating(label, text)).alias("error"))


@query("parse_dates")
def q_parse_dates(spark, sf_dir):
    """N8 review dates written in the three accepted formats (and one rejected)."""
    r = FX.fx_reviews(spark, sf_dir)
    k = F.col("pos") % 4
    txt = (F.when(k == 0, F.date_format("review_date", "MMM d, yyyy"))
            .when(k == 1, F.date_format("review_date", "MMMM dd, yyyy"))
            .when(k == 2, F.date_format("review_date", "yyyy-MM-dd"))
            .otherwise(F.date_format("review_date", "dd/MM/yyyy")))
    return r.select("external_review_id", txt.alias("date_text"), N.parse_date(txt).alias("review_date"))


@query("app_review_counts")
def q_app_review_counts(spark, sf_dir):
    """J4 apps with their reviews: count and mean rating per catalogued app."""
    rv = FX.fx_ratings(spark, sf_dir).groupBy("app_id").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.sum("rating").cast("long").alias("rating_sum"))
    apps = FX.fx_apps(spark, sf_dir).select(F.col("id").alias("app_id"), "name", "store")
    return apps.join(rv, "app_id", "inner").withColumn(
        "avg_rating", (F.col("rating_sum").cast("decimal(38,18)") / F.col("n_reviews")).cast("decimal(12,6)"))


@query("cascade_reviews")
def q_cascade_reviews(spark, sf_dir):
    """J5 reviews kept after removing inactive apps (left semi join on survivors)."""
    keep = C.monitored(FX.fx_apps(spark, sf_dir)).select(F.col("id").alias("app_id"))
    return FX.fx_ratings(spark, sf_dir).join(keep, "app_id", "left_semi")


@query("metadata_json_query")
def q_metadata_json_query(spark, sf_dir):
    """P7 on a JSON document column: events whose metadata key k is at least 95."""
    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id", "user_id", "props")
    return R.metadata_key_query(e, "props", "$.k", "int", lambda v: v >= 95) \
        .select("event_id", F.col("user_id").alias("app_id"), F.col("_v").alias("k"))


@query("page_fields")
def q_page_fields(spark, sf_dir):
    """X1-X5 raw fields the Arrow tokeniser picks from every captured page."""

    pages = spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url", "html"), key="page_id")
    raw = X.extract_raw(pages, X.PAGES_PROFILE)
    return raw.select("page_id", "name", "icon_url", "raw_price",
                      F.size("reviews").alias("review_containers"))


# --- streaming jobs replayed over the stand-in feeds -----------------------------------------------
PAGES_AT = "2025-06-01 12:00:00"


@query("page_results")
def q_page_results(spark, sf_dir):
    """Validated page results; any invalid record fails its page."""
    res = X.scrape_results(FX.fx_raw_pages(spark, sf_dir), PAGES_AT)
    return res.select(
        "page_id", "url", "success", "error", F.col("app.name").alias("name"), F.col("app.developer_name").alias("developer_name"),
        F.col("price.price").alias("price"), "has_app", "has_price", F.col("review_count").cast("int").alias("review_count"),
        F.array_join(F.transform("reviews", lambda r: F.concat_ws(":", r["external_review_id"], r["rating"].cast("string"), r["author_name"],
                                                                  F.date_format(r["review_date"], "yyyy-MM-dd"))), ",").alias("reviews"))


@query("paginated_reviews")
def q_paginated_reviews(spark, sf_dir):
    """Each review of an app's successful pages once, from the first page that shows it."""
    m = X.merge_paginated(X.scrape_results(FX.fx_raw_pages(spark, sf_dir), PAGES_AT))
    return m.select("app_url", "external_review_id", "page_id", "pos", "rating", "title", "author_name")


def _committed(spark, sf_dir, table):
    """``table`` after the captures are committed in two batches (even and odd pages, which share their apps); the folder."""
    raw = FX.fx_captures(spark, sf_dir)
    res = X.scrape_results(raw, F.col("captured_at"), keep=("app_id",))
    root = RP.new_root(spark, "commit")
    if table == "apps":
        CAT.create(FX.fx_catalog(spark, sf_dir), f"{root}/catalogue")
    for k in (0, 1):
        S.commit_scrape_batch(res.where(F.col("page_id") % 2 == k), root, k, tables=(table,))
    return root


@query("commit_prices")
def q_commit_prices(spark, sf_dir):
    """Every scraped price as stored by month, one row a page."""
    got = S.read_price_history(spark, f"{_committed(spark, sf_dir, 'prices')}/price_history")
    return got.select("app_id", "price", "currency", "region", "ts", "price_month")


@query("commit_reviews")
def q_commit_reviews(spark, sf_dir):
    """Each review of an app once, as the first batch that has it merged it by capture time."""
    got = spark.read.parquet(f"{_committed(spark, sf_dir, 'reviews')}/reviews")
    return got.select("app_id", "external_review_id", "rating", "review_date")


@query("commit_apps")
def q_commit_apps(spark, sf_dir):
    """One record an app and batch, that of its last capture."""
    got = spark.read.parquet(f"{_committed(spark, sf_dir, 'apps')}/app_updates")
    return got.select("app_id", "batch_id", "name", "developer_name", "icon_url")


@query("commit_catalogue")
def q_commit_catalogue(spark, sf_dir):
    """The whole catalogue as the two batches leave it."""
    got = CAT.read(spark, f"{_committed(spark, sf_dir, 'apps')}/catalogue")
    return got.select("id", "name", "bundle_id", "store", "developer_name", "description", "icon_url", "is_active")


def _stream(spark, sf_dir, name, shape, step):
    """Run a streaming step over a stand-in feed; the folder with its tables."""
    root = RP.new_root(spark, name)
    RP.run_all(shape(spark, sf_dir, read=RP.streamed), step(root), root)
    return root


@query("price_alerts_stream")
def q_price_alerts_stream(spark, sf_dir):
    """ST3 price changes from the price feed."""
    return ST.price_alerts(spark, _stream(spark, sf_dir, "price_alerts", FX.fx_prices, ST.price_changes))


@query("failure_monitor_stream")
def q_failure_monitor_stream(spark, sf_dir):
    """ST5 hourly failure rates from the fetch attempts."""
    root = _stream(spark, sf_dir, "failure_monitor", FX.fx_attempts, lambda r: ST.count_windows(r, "store", "hour", "failed"))
    return ST.failure_rates(spark, root)


@query("rate_limit_stream")
def q_rate_limit_stream(spark, sf_dir):
    """ST4 callers over the per-minute limit from the access log."""
    root = _stream(spark, sf_dir, "rate_limit", FX.fx_access, lambda r: ST.count_windows(r, "ip", "minute"))
    return ST.over_limit(spark, root, limit=1)


@query("dedupe_reviews_stream")
def q_dedupe_reviews_stream(spark, sf_dir):
    """ST2 review keys of the capture feed, each once."""
    def feed(spark, sf_dir, read):
        return FX.fx_review_batch(spark, sf_dir, read=read).select("app_id", "external_review_id")
    root = _stream(spark, sf_dir, "dedupe_reviews", feed, ST.dedupe_reviews)
    return ST.stored_reviews(spark, root).select("app_id", "external_review_id")
