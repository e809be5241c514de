"""Catalogue jobs: store URLs (P1/P2), dispatch (P3), request lookup (J1/P4),
monitored apps (P6), incremental work list (P8), catalogue update from scrapes
(S5), app listing (L4), store union (X10/U1), batch counts (A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# ---------------------------------------------------------------------------
# Store URL shapes, the unsupported-store error, region list.
# ---------------------------------------------------------------------------
APPLE = "APPLE_APP_STORE"
GOOGLE = "GOOGLE_PLAY_STORE"
APPLE_BASE = "https://apps.apple.com"          # {base}/{region}/app/id{bundle_id}
GOOGLE_BASE = "https://play.google.com/store/apps/details"  # ?id={bundle_id}&hl=en&gl={REGION}
GOOGLE_NOT_IMPLEMENTED = "Google Play scraper not yet implemented"
APP_NOT_FOUND = "App not found"
DEFAULT_REGIONS = ["us", "mx", "br", "de", "jp"]
# ---------------------------------------------------------------------------


def store_url(store, bundle_id, region=None):
    """Store page URL (Apple by region path, anything else -> Google)."""
    region = F.lit("us") if region is None else region
    apple = F.concat(F.lit(APPLE_BASE + "/"), F.lower(region), F.lit("/app/id"), bundle_id)
    google = F.concat(F.lit(GOOGLE_BASE + "?id="), bundle_id, F.lit("&hl=en&gl="), F.upper(region))
    return F.when(store == F.lit(APPLE), apple).otherwise(google)


def store_urls(apps: DataFrame, regions: list[str] | None = None) -> DataFrame:
    """One row per (app, region) with its URL and whether a scraper
    exists for the store.  The region list is a literal of a few entries, so it
    is an ``explode`` (no join, no shuffle)."""
    regions = regions or DEFAULT_REGIONS
    a = apps.select("id", "bundle_id", "store", F.explode(F.array(*[F.lit(r) for r in regions])).alias("region"))
    return a.select(
        F.col("id").alias("app_id"), "region", "store",
        store_url(F.col("store"), F.col("bundle_id"), F.col("region")).alias("url"),
        (F.col("store") == APPLE).alias("supported"),
        F.when(F.col("store") != APPLE, F.lit(GOOGLE_NOT_IMPLEMENTED)).alias("error"),
    )


def request_lookup(requests: DataFrame, apps: DataFrame) -> DataFrame:
    """Every request row kept (left join); unknown ids -> 'App not
    found'; non-Apple stores -> failed row with the not-implemented error."""
    cat = apps.select(F.col("id").alias("app_id"), "bundle_id", "store", F.lit(True).alias("_found"))
    j = requests.join(cat, "app_id", "left")
    found = F.col("_found").isNotNull()
    return j.select(
        "request_id", "app_id", found.alias("found"), "store",
        F.when(found, store_url(F.col("store"), F.col("bundle_id"))).alias("url"),
        (found & (F.col("store") == APPLE)).alias("dispatched"),
        F.when(~found, F.lit(APP_NOT_FOUND))
         .when(F.col("store") != APPLE, F.lit(GOOGLE_NOT_IMPLEMENTED)).alias("error"),
    )


def enqueued_count(requests: DataFrame) -> DataFrame:
    """A2: the batch task counts every id it enqueues, duplicates and unknown ids included."""
    return requests.agg(F.count(F.lit(1)).alias("enqueued"))


def monitored(apps: DataFrame) -> DataFrame:
    """Apps flagged for monitoring."""
    return apps.where(F.col("is_active"))


def worklist(apps: DataFrame, attempts: DataFrame, as_of, full_after_hours: int = 1) -> DataFrame:
    """Per monitored app, 'full' scrape when never scraped or last scrape is
    at least ``full_after_hours`` old, else 'price_only'.  max(ts) is a partial
    aggregation; the catalogue side is joined on app id."""
    last = attempts.groupBy("app_id").agg(F.max("ts").alias("last_scraped_at"))
    a = monitored(apps).select(F.col("id").alias("app_id"))
    j = a.join(last, "app_id", "left")
    cutoff = F.timestamp_add("HOUR", F.lit(-full_after_hours), F.lit(as_of).cast("timestamp_ntz"))
    return j.withColumn("mode", F.when(F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") <= cutoff),
                                       F.lit("full")).otherwise(F.lit("price_only")))


def apps_merge(catalog: DataFrame, scraped: DataFrame) -> DataFrame:
    """Apply successful scrapes to the catalogue: name always replaced;
    developer/description/icon only when the scrape has a non-empty value;
    bundle_id never changes; ``changed`` marks rows whose values moved.
    Returns a full new snapshot (write it to a new path, never the one read)."""
    # one record an app: the latest capture of several pages, by whatever of these the feed carries
    fields = ["name", "developer_name", "description", "icon_url"]
    order = F.struct(*[c for c in ("captured_at", "page_id") if c in scraped.columns], *fields)
    scraped = scraped.groupBy("app_id").agg(F.max_by(F.struct(*fields), order).alias("r")).select("app_id", "r.*")
    s = scraped.select(F.col("app_id").alias("id"), F.col("name").alias("s_name"),
                       F.col("developer_name").alias("s_dev"), F.col("description").alias("s_desc"),
                       F.col("icon_url").alias("s_icon"))
    j = catalog.join(s, "id", "left")

    def keep_or_new(new, old):
        return F.when(F.coalesce(new, F.lit("")) != "", new).otherwise(F.col(old))

    out = j.select(
        "id", F.coalesce(F.col("s_name"), F.col("name")).alias("name"), "bundle_id", "store",
        keep_or_new(F.col("s_dev"), "developer_name").alias("developer_name"),
        keep_or_new(F.col("s_desc"), "description").alias("description"),
        keep_or_new(F.col("s_icon"), "icon_url").alias("icon_url"),
        "is_active",
        F.col("name").alias("_old_name"), F.col("developer_name").alias("_old_dev"),
        F.col("description").alias("_old_desc"), F.col("icon_url").alias("_old_icon"),
    )
    changed = ~(F.col("name").eqNullSafe(F.col("_old_name")) & F.col("developer_name").eqNullSafe(F.col("_old_dev")) &
                F.col("description").eqNullSafe(F.col("_old_desc")) & F.col("icon_url").eqNullSafe(F.col("_old_icon")))
    return out.withColumn("changed", changed).drop("_old_name", "_old_dev", "_old_desc", "_old_icon")


def apps_page(apps: DataFrame, limit: int = 50, after=None) -> DataFrame:
    """L4: catalogue listing by (name, id) with a keyset cursor."""
    a = apps
    if after is not None:
        n, i = after
        a = a.where((F.col("name") > F.lit(n)) | ((F.col("name") == F.lit(n)) & (F.col("id") > F.lit(i))))
    return a.orderBy("name", "id").limit(limit)


def store_union(apple: DataFrame, google: DataFrame) -> DataFrame:
    """One app model from per-store feeds; columns missing in a feed
    become NULL; the store column says where a row came from."""
    return (apple.withColumn("store", F.lit(APPLE))
                 .unionByName(google.withColumn("store", F.lit(GOOGLE)), allowMissingColumns=True))
