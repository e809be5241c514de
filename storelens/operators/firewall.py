"""Data-quality firewall (V1-V8): normalise records, attach every violated rule,
split accepted from quarantined, and audit keys/references/enums.

Each validator is one projection (no shuffle).  Instead of raising on the first
bad record, every row carries ``violations: array<string>``; a row is accepted
when the array is empty.  Audits are aggregations with map-side combine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions import normalize as N


def validate_apps(apps: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """V1: name/bundle_id stripped and required (<=255); developer/icon stripped,
    blank -> NULL, <=255 / <=512; description untouched."""
    name, bundle = N.py_strip("name"), N.py_strip("bundle_id")
    dev, icon = N.strip_or_null("developer_name"), N.strip_or_null("icon_url")
    staged = apps.select(
        *keep,
        name.alias("name"), bundle.alias("bundle_id"), dev.alias("developer_name"),
        F.col("description"), icon.alias("icon_url"),
    )
    return staged.withColumn("violations", N.violations(
        F.coalesce(N.required_rule(F.col("name"), "name"), N.max_length_rule(F.col("name"), N.MAX_NAME, "name")),
        F.coalesce(N.required_rule(F.col("bundle_id"), "bundle_id"),
                   N.max_length_rule(F.col("bundle_id"), N.MAX_BUNDLE_ID, "bundle_id")),
        N.max_length_rule(F.col("developer_name"), N.MAX_DEVELOPER, "developer_name"),
        N.max_length_rule(F.col("icon_url"), N.MAX_ICON_URL, "icon_url"),
    ))


def validate_prices(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """V2 over raw scraped prices (raw_price text, raw_currency, raw_region, ts).

    Unparsable price text is not a violation: the page simply has no price
    (``outcome='no_price'``).  Parsed prices are range-checked unrounded and
    stored rounded to decimal(10,2).  Normalised values are computed once in
    their own projection and the rules read them (small generated code).
    """
    norm = raw.select(
        *keep, "ts", "raw_currency",
        N.parse_price("raw_price").alias("price_exact"),
        N.normalize_currency("raw_currency").alias("currency"),
        N.py_strip("raw_currency").alias("_cur_stripped"),
        N.normalize_region("raw_region").alias("region"),
    )
    checked = norm.select(
        *keep, "ts", "price_exact", "currency", "region",
        N.price_rule(F.col("price_exact")).alias("_price_rule"),
        N.violations(
            N.price_rule(F.col("price_exact")),
            (F.when(F.col("raw_currency").isNull(), F.lit("currency is required"))
              .when(F.col("_cur_stripped") == "", F.lit("Currency cannot be empty"))
              .when(F.col("currency").isNull(),
                    F.concat(F.lit("Unknown currency: '"), F.col("raw_currency"), F.lit("'")))),
            F.when(F.col("region").isNull(), F.lit("region is required"))
             .otherwise(N.max_length_rule(F.col("region"), N.MAX_REGION, "region")),
            F.when(F.col("ts").isNull(), F.lit("timestamp is required")),
        ).alias("_rules"),
    )
    no_price = F.col("price_exact").isNull()
    return checked.select(
        *keep,
        F.when(F.col("_price_rule").isNull(), F.col("price_exact").cast("decimal(10,2)")).alias("price"),
        "currency", "region", F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(no_price, F.array().cast("array<string>")).otherwise(F.col("_rules")).alias("violations"),
        F.when(no_price, F.lit("no_price"))
         .when(F.size("_rules") == 0, F.lit("accepted")).otherwise(F.lit("rejected")).alias("outcome"),
    )


def validate_reviews(reviews: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """V3: id stripped/required/<=255, rating 1..5, title/author stripped (blank ->
    NULL) with 500/255 limits, content untouched, review_date as UTC."""
    rid = N.py_strip("external_review_id")
    staged = reviews.select(
        *keep,
        rid.alias("external_review_id"), F.col("rating").cast("int").alias("rating"),
        N.strip_or_null("title").alias("title"), F.col("content"),
        N.strip_or_null("author_name").alias("author_name"),
        F.col("review_date").cast("timestamp_ntz").alias("review_date"),
    )
    return staged.withColumn("violations", N.violations(
        F.coalesce(N.required_rule(F.col("external_review_id"), "external_review_id"),
                   N.max_length_rule(F.col("external_review_id"), N.MAX_REVIEW_ID, "external_review_id")),
        N.rating_rule(F.col("rating")),
        N.max_length_rule(F.col("title"), N.MAX_TITLE, "title"),
        N.max_length_rule(F.col("author_name"), N.MAX_AUTHOR, "author_name"),
    ))


def validate_results(results: DataFrame) -> DataFrame:
    """V4: result url stripped and required."""
    url = N.py_strip("url")
    return results.withColumn("url", url).withColumn(
        "violations", N.violations(N.required_rule(F.col("url"), "url")))


def split_accepted(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V8: (accepted, quarantined) — two filters over the same projection."""
    ok = F.size("violations") == 0
    return validated.where(ok), validated.where(~ok)


def violation_counts(validated: DataFrame, outcome_col: str | None = None) -> DataFrame:
    """V8: count per violated rule plus per outcome, one aggregation.

    ``explode_outer`` keeps clean rows (rule NULL) so totals come from the same
    scan; partial aggregation combines map-side before the shuffle.
    """
    outcome = (F.col(outcome_col) if outcome_col else
               F.when(F.size("violations") == 0, F.lit("accepted")).otherwise(F.lit("rejected")))
    rows = validated.select(outcome.alias("outcome"), F.explode_outer("violations").alias("rule"))
    return rows.groupBy("outcome", "rule").agg(F.count(F.lit(1)).alias("n"))


def unique_audit(df: DataFrame, key: list[str], table: str) -> DataFrame:
    """V5: keys held by more than one row."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
              .where(F.col("n_rows") > 1)
              .select(F.lit(table).alias("table_name"),
                      F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"),
                      "n_rows"))


def fk_audit(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """V6: child rows whose key has no parent (anti join; AQE broadcasts a small parent)."""
    p = parent.select(F.col(parent_key).alias(child_key))
    return child.join(p, child_key, "left_anti")


def null_enum_audit(df: DataFrame, table: str, not_null: list[str], enums: dict | None = None) -> DataFrame:
    """V7: one row per (column, rule) with the number of offending rows, from a
    single aggregation over the table."""
    enums = enums or {}
    aggs = [F.sum(F.col(c).isNull().cast("long")).alias(f"null::{c}") for c in not_null]
    aggs += [F.sum((F.col(c).isNotNull() & ~F.col(c).isin(*vals)).cast("long")).alias(f"enum::{c}")
             for c, vals in enums.items()]
    wide = df.agg(*aggs)
    names = [f"null::{c}" for c in not_null] + [f"enum::{c}" for c in enums]
    stacked = wide.select(F.explode(F.array(*[
        F.struct(F.lit(n.split("::")[1]).alias("column_name"), F.lit(n.split("::")[0]).alias("rule"),
                 F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("long").alias("n_violations"))
        for n in names])).alias("r"))
    return stacked.select(F.lit(table).alias("table_name"), "r.*")


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
