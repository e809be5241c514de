"""Review jobs: text processing (B1), batch merge (J3/W7), insert-if-absent (J2),
and the review-side rollups (A7, A8, A9, L3, P7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions import text as T
from storelens.functions.numeric import exact_ratio

METADATA_FIELDS = ("original_length", "processed_length", "had_email", "had_credit_card", "had_ssn")


def process_reviews(reviews: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """B1: reviews(external_review_id, title, content, author_name) ->
    (external_review_id, title_processed, content_processed, author_name_processed,
    processing_metadata struct).  T15: the metadata struct holds raw and processed
    code-point lengths and the T14 flags.

    A single narrow projection: no shuffle, no Python.  ``content_processed`` is
    materialised in its own projection because both the output column and
    ``processed_length`` read it; Catalyst would otherwise evaluate the regex
    chain twice.  ``keep`` passes extra input columns through (e.g. app_id).
    """
    flags = T.pii_flags("content")
    staged = reviews.select(
        *keep,
        "external_review_id",
        T.batch_mask(T.batch_clean("title")).alias("title_processed"),
        T.batch_mask(T.batch_clean("content")).alias("content_processed"),
        T.author_initials("author_name").alias("author_name_processed"),
        T.code_points("content").alias("original_length"),
        *[c.alias(n) for n, c in flags.items()],
    )
    return staged.select(
        *keep,
        "external_review_id", "title_processed", "content_processed", "author_name_processed",
        F.struct(
            F.col("original_length"),
            T.code_points("content_processed").alias("processed_length"),
            "had_email", "had_credit_card", "had_ssn",
        ).alias("processing_metadata"),
    )


def flatten_metadata(df: DataFrame, col: str = "processing_metadata") -> DataFrame:
    others = [c for c in df.columns if c != col]
    return df.select(*others, *[F.col(f"{col}.{f}").alias(f) for f in METADATA_FIELDS])


def merge_batch_reviews(raw: DataFrame, key=("app_id", "external_review_id"), pos: str = "pos") -> DataFrame:
    """Collapse duplicate review ids inside one batch.

    First occurrence (by ``pos``) keeps its rating/review_date; the *last*
    occurrence's title/content/author (processed) and metadata win.  The raw
    rows are merged first — one hash aggregation with min_by/max_by, combined
    map-side before the shuffle, so a huge group of copies shrinks to one row
    per task — and only the surviving rows go through the text job (processing
    is per row, so the last processed text is the processed last text).
    """
    key = list(key)
    agg = raw.groupBy(*key).agg(
        F.min_by(F.struct("rating", "review_date"), F.col(pos)).alias("first"),
        F.max_by(F.struct("title", "content", "author_name"), F.col(pos)).alias("last"),
    )
    merged = agg.select(*key, "first.rating", "first.review_date", "last.title", "last.content", "last.author_name")
    keep = tuple(k for k in key if k != "external_review_id") + ("rating", "review_date")
    processed = process_reviews(merged, keep=keep)
    return processed.select(
        *key, "rating", "review_date",
        F.col("title_processed").alias("title"),
        F.col("content_processed").alias("content"),
        F.col("author_name_processed").alias("author_name"),
        F.col("processing_metadata").alias("metadata"),
    )


def new_reviews(batch: DataFrame, stored: DataFrame, key=("app_id", "external_review_id")) -> DataFrame:
    """Reviews of a batch not yet stored (insert-if-absent).  One anti join;
    AQE turns it into a broadcast when the stored side is small at runtime."""
    return batch.join(stored.select(*key), list(key), "left_anti")


def pii_rates(processed: DataFrame, group: str = "app_id") -> DataFrame:
    """Share of reviews whose raw content had each PII kind, per app."""
    m = "processing_metadata"
    return processed.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.sum(F.col(f"{m}.had_email").cast("long")).alias("n_email"),
        F.sum(F.col(f"{m}.had_credit_card").cast("long")).alias("n_credit_card"),
        F.sum(F.col(f"{m}.had_ssn").cast("long")).alias("n_ssn"),
        F.sum(F.col(f"{m}.original_length").cast("long")).alias("chars_in"),
        F.sum(F.col(f"{m}.processed_length").cast("long")).alias("chars_out"),
    ).withColumn("email_rate", exact_ratio(F.col("n_email"), F.col("n_reviews"), "decimal(10,6)"))


def rating_summary(reviews: DataFrame, valid_only: bool = True) -> DataFrame:
    """Per app and month: count, mean rating, distribution 1..5, negative share."""
    r = reviews.where(F.col("rating").between(1, 5)) if valid_only else reviews
    r = r.withColumn("month", F.date_trunc("month", "review_date"))
    dist = [F.sum((F.col("rating") == k).cast("long")).alias(f"n_{k}") for k in range(1, 6)]
    return r.groupBy("app_id", "month").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        exact_ratio(F.sum("rating"), F.count(F.lit(1)), "decimal(12,6)").alias("avg_rating"),
        *dist,
        F.sum((F.col("rating") <= 2).cast("long")).alias("n_negative"),
    )


def weekly_report(reviews: DataFrame) -> DataFrame:
    """Per app and ISO week (Monday start) with per-app and grand totals (ROLLUP)."""
    r = reviews.where(F.col("rating").between(1, 5)).withColumn("week", F.date_trunc("week", "review_date"))
    return (r.rollup("app_id", "week")
             .agg(F.count(F.lit(1)).alias("n_reviews"),
                  F.sum("rating").cast("long").alias("rating_sum"),
                  F.sum((F.col("rating") <= 2).cast("long")).alias("n_negative"),
                  F.grouping_id().alias("level")))


def reviews_page(reviews: DataFrame, app_id, limit: int = 50, before=None) -> DataFrame:
    """L3: one app's reviews, newest first; ``before`` = (review_date, id) cursor."""
    r = reviews.where(F.col("app_id") == F.lit(app_id))
    if before is not None:
        ts, rid = before
        r = r.where((F.col("review_date") < F.lit(ts)) |
                    ((F.col("review_date") == F.lit(ts)) & (F.col("external_review_id") < F.lit(rid))))
    return r.orderBy(F.col("review_date").desc(), F.col("external_review_id").desc()).limit(limit)


def metadata_query(processed: DataFrame, flag: str = "had_email") -> DataFrame:
    """Reviews selected by a metadata key (the JSONB/GIN lookup).  On a typed
    struct this is nested-column pruning + a pushed predicate."""
    return processed.where(F.col(f"processing_metadata.{flag}"))


def metadata_key_query(df: DataFrame, json_col: str, path: str, value_type: str, predicate) -> DataFrame:
    """P7 for open (schemaless) metadata keys: the JSON text is parsed once into a
    VARIANT and the key is read with ``variant_get`` (typed, NULL when absent or
    not convertible); ``predicate`` filters on the extracted value ``_v``."""
    v = F.variant_get(F.parse_json(F.col(json_col)), path, value_type)
    return df.withColumn("_v", v).where(predicate(F.col("_v")))
