"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each stand-in view from ``storelens.sources.fixtures`` has a CTE here with the
same definition; each query's SQL inlines the CTEs it needs.  Column names and
types are aligned with the Spark side (exact decimals, bigint counts, NTZ
timestamps) so an order-insensitive value hash can compare them.
"""

from __future__ import annotations

from storelens.operators.prices import END_MONTH, FIRST_MONTH

FX = {
    "fx_reviews": r"""fx_reviews AS (
  SELECT CAST(doc_id AS VARCHAR) AS external_review_id, source AS app_id,
         CAST(doc_id % 7 AS INTEGER) AS rating,
         split_part(text, chr(10), 1) AS title, text AS content,
         NULLIF(regexp_extract(text, '^\s*(\S+(?:\s+\S+)?)', 1), '') AS author_name,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS BIGINT)) AS review_date,
         doc_id AS pos
  FROM (SELECT doc_id, source, text || CASE length(text) % 9 WHEN 0 THEN '' WHEN 1 THEN ' <b>bold</b><br/> <a href=''/x''>link</a>'
          WHEN 2 THEN ' see https://shop.example/a?b=1 or www.x.example/y now' WHEN 3 THEN ' 😀👍 ok ❤'
          WHEN 4 THEN ' ssn 123-45-6789.' WHEN 5 THEN ' write to jo.doe@mail.example' WHEN 6 THEN ' HTTPS://A.EXAMPLE x <i>'
          WHEN 7 THEN chr(9) || ' call +1 (555) 123-4567' ELSE ' card 4111 1111 1111 1111' END AS text FROM documents))""",
    "fx_prices": """fx_prices AS (
  SELECT event_id AS id, user_id AS app_id, event_type AS region, 'USD' AS currency,
         CAST(value AS DECIMAL(10,2)) AS price, ts
  FROM events)""",
    "fx_raw_prices": """fx_raw_prices AS (
  SELECT event_id AS scrape_id, user_id AS app_id, ts,
         CASE event_id % 6
           WHEN 0 THEN '$' || CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR)
           WHEN 1 THEN replace(CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR), '.', ',')
           WHEN 2 THEN 'Free'
           WHEN 3 THEN 'N/A'
           WHEN 4 THEN '1,234.56'
           ELSE CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) || ' USD' END AS raw_price,
         ['$', 'eur', '  usd ', 'R$', 'XYZ', 'kr', '', 'Fr'][CAST(event_id % 8 + 1 AS INTEGER)] AS raw_currency,
         ['us', ' mx ', 'BR', 'toolong', 'de'][CAST(event_id % 5 + 1 AS INTEGER)] AS raw_region
  FROM events)""",
    "fx_prices_long": """fx_prices_long AS (
  SELECT o_orderkey AS id, o_custkey % 50 AS app_id, 'US' AS region, 'USD' AS currency,
         CAST(o_totalprice AS DECIMAL(10,2)) AS price, o_orderdate AS ts
  FROM orders)""",
    "fx_attempts": """fx_attempts AS (
  SELECT event_id AS attempt_id, user_id AS app_id, ts, event_type = 'error' AS failed,
         CASE WHEN user_id % 2 = 0 THEN 'APPLE_APP_STORE' ELSE 'GOOGLE_PLAY_STORE' END AS store
  FROM events)""",
    "fx_ratings": """fx_ratings AS (
  SELECT event_id AS review_id, user_id AS app_id, ts,
         CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3
                              WHEN 'view' THEN 4 END AS INTEGER) AS rating
  FROM events WHERE event_type <> 'purchase')""",
    "fx_purchase_prices": """fx_purchase_prices AS (
  SELECT event_id AS id, user_id AS app_id, 'US' AS region, 'USD' AS currency,
         CAST(value AS DECIMAL(10,2)) AS price, ts
  FROM events WHERE event_type = 'purchase')""",
    "fx_apps": """fx_apps AS (
  SELECT p_partkey AS id, p_name AS name,
         'com.' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '.' || CAST(p_partkey AS VARCHAR) AS bundle_id,
         CASE WHEN p_partkey % 2 = 0 THEN 'APPLE_APP_STORE' ELSE 'GOOGLE_PLAY_STORE' END AS store,
         p_type AS developer_name, p_size % 10 <> 0 AS is_active
  FROM part)""",
    "fx_access": """fx_access AS (
  SELECT event_id AS request_id,
         '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(CAST(trunc(user_id / 256) AS BIGINT) AS VARCHAR) AS ip,
         ts
  FROM events)""",
    "fx_changelog": """fx_changelog AS (
  SELECT conv_id AS app_id, turn AS version, text AS notes FROM conversations)""",
}

# Patterns (fixed values; the same strings as storelens.functions.text, RE2 dialect).
HTML_TAG = r"<[^>]+>"
URL = r"""https?://[^\s<>"']+|www\.[^\s<>"']+"""
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
CARD = r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)(?:\d{3,4}[-.\s]?)\d{3,4}"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def batch_clean(x: str) -> str:
    s = f"regexp_replace({x}, {q(HTML_TAG)}, '', 'g')"
    s = f"regexp_replace({s}, {q(URL)}, '', 'g')"
    s = f"lower({s})"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    return f"trim({s})"


def batch_mask(x: str) -> str:
    s = f"regexp_replace({x}, {q(EMAIL)}, '[EMAIL]', 'g')"
    s = f"regexp_replace({s}, {q(CARD)}, '[CREDIT_CARD]', 'g')"
    return f"regexp_replace({s}, {q(SSN)}, '[SSN]', 'g')"


def anonymize_pii(x: str) -> str:
    return f"regexp_replace({batch_mask(x)}, {q(PHONE)}, '[PHONE]', 'g')"


def initials(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string(list_transform("
            f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> ''), "
            f"lambda w: upper(substr(w, 1, 1)) || '.'), ' ') END")


def dec_ratio(num: str, den: str, scale: int = 6, width: int = 18) -> str:
    """num/den for integers, rounded HALF_UP (away from zero) to ``scale`` digits, as
    an exact DECIMAL (DuckDB's decimal division returns DOUBLE); NULL when den = 0."""
    f = 10 ** scale
    n, d = f"CAST({num} AS HUGEINT)", f"CAST(NULLIF({den}, 0) AS HUGEINT)"
    qq = f"(sign({n}) * sign({d}) * ((2 * abs({n}) * {f} + abs({d})) // (2 * abs({d}))))"
    return f"CAST(CAST({qq} AS DECIMAL(38,0)) * CAST({1 / f:.{scale}f} AS DECIMAL({scale + 1},{scale})) AS DECIMAL({width},{scale}))"


def cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS HUGEINT)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def with_fx(names, body: str) -> str:
    return "WITH " + ",\n".join(FX[n] for n in names) + "\n" + body


SQL: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    SQL[name] = sql


register("process_reviews", with_fx(["fx_reviews"], f"""
SELECT external_review_id,
       {batch_mask(batch_clean('title'))} AS title_processed,
       {batch_mask(batch_clean('content'))} AS content_processed,
       {initials('author_name')} AS author_name_processed,
       CAST(length(coalesce(content, '')) AS INTEGER) AS original_length,
       CAST(length(coalesce({batch_mask(batch_clean('content'))}, '')) AS INTEGER) AS processed_length,
       regexp_matches(coalesce(content, ''), {q(EMAIL)}) AS had_email,
       regexp_matches(coalesce(content, ''), {q(CARD)}) AS had_credit_card,
       regexp_matches(coalesce(content, ''), {q(SSN)}) AS had_ssn
FROM fx_reviews"""))


# --- shared pieces -------------------------------------------------------------------
from storelens.functions.normalize import CURRENCY_CODES, CURRENCY_SYMBOLS  # noqa: E402
from storelens.functions.text import EMOJI_RANGES  # noqa: E402

EMOJI = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI_RANGES) + "]+"


def clean_text(x: str) -> str:
    s = f"regexp_replace({x}, {q(HTML_TAG)}, '', 'g')"
    s = f"regexp_replace({s}, {q('(?i)' + URL)}, '', 'g')"
    s = f"regexp_replace({s}, {q(EMOJI)}, '', 'g')"
    s = f"regexp_replace(lower({s}), '\\s+', ' ', 'g')"
    return strip(s)


def currency(x: str) -> str:
    sym = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in CURRENCY_SYMBOLS.items())
    codes = ", ".join(q(c) for c in CURRENCY_CODES)
    st = strip(x)
    return (f"coalesce(CASE {st} {sym} END, CASE WHEN upper({st}) IN ({codes}) THEN upper({st}) END)")


def currency_error(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'currency is required' WHEN {strip(x)} = '' THEN 'Currency cannot be empty' "
            f"WHEN {currency(x)} IS NULL THEN 'Unknown currency: ''' || {x} || '''' END")


def parse_price(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN lower({x}) = 'free' THEN CAST(0 AS DECIMAL(38,10)) "
            f"ELSE TRY_CAST(replace(regexp_replace({x}, '[^0-9.,]', '', 'g'), ',', '.') AS DECIMAL(38,10)) END")


def price_rule(p: str) -> str:
    return (f"CASE WHEN {p} IS NULL THEN 'price is required' WHEN {p} < 0 THEN 'Price cannot be negative' "
            f"WHEN {p} > 99999999.99 THEN 'Price exceeds maximum of 99999999.99' END")


def region_rule(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'region is required' "
            f"WHEN length(upper({strip(x)})) > 5 THEN 'region exceeds max length of 5' END")


def joined(*rules: str) -> str:
    return f"array_to_string(list_filter([{', '.join(rules)}], lambda r: r IS NOT NULL), '; ')"


def nullif_blank(x: str) -> str:
    return f"NULLIF({strip(x)}, '')"


def maxlen(x: str, n: int, field: str) -> str:
    return f"CASE WHEN length({x}) > {n} THEN '{field} exceeds max length of {n}' END"


def required(x: str, field: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '{field} cannot be empty' END"


PROCESSED = f"""processed AS (
  SELECT app_id, external_review_id, pos, rating, review_date,
         {batch_mask(batch_clean('title'))} AS title_processed,
         {batch_mask(batch_clean('content'))} AS content_processed,
         {initials('author_name')} AS author_name_processed,
         CAST(length(coalesce(content, '')) AS INTEGER) AS original_length,
         regexp_matches(coalesce(content, ''), {q(EMAIL)}) AS had_email,
         regexp_matches(coalesce(content, ''), {q(CARD)}) AS had_credit_card,
         regexp_matches(coalesce(content, ''), {q(SSN)}) AS had_ssn
  FROM src),
processed2 AS (
  SELECT *, CAST(length(coalesce(content_processed, '')) AS INTEGER) AS processed_length FROM processed)"""

# --- reviews / text ---------------------------------------------------------------------------
register("clean_text", with_fx(["fx_reviews"], f"""
SELECT external_review_id, {clean_text('content')} AS clean FROM fx_reviews"""))

register("anonymize_pii", with_fx(["fx_reviews"], f"""
SELECT external_review_id, {anonymize_pii('content')} AS masked FROM fx_reviews"""))

register("author_initials", with_fx(["fx_reviews"], f"""
SELECT external_review_id, author_name, {initials('author_name')} AS initials FROM fx_reviews"""))

register("pii_flags", with_fx(["fx_reviews"], f"""
SELECT external_review_id,
       regexp_matches(coalesce(content, ''), {q(EMAIL)}) AS had_email,
       regexp_matches(coalesce(content, ''), {q(CARD)}) AS had_credit_card,
       regexp_matches(coalesce(content, ''), {q(SSN)}) AS had_ssn
FROM fx_reviews"""))

register("pii_rates", with_fx(["fx_reviews"], f""", src AS (SELECT * FROM fx_reviews),
{PROCESSED}
SELECT app_id, count(*) AS n_reviews,
       CAST(sum(CAST(had_email AS BIGINT)) AS BIGINT) AS n_email,
       CAST(sum(CAST(had_credit_card AS BIGINT)) AS BIGINT) AS n_credit_card,
       CAST(sum(CAST(had_ssn AS BIGINT)) AS BIGINT) AS n_ssn,
       CAST(sum(original_length) AS BIGINT) AS chars_in,
       CAST(sum(processed_length) AS BIGINT) AS chars_out,
       {dec_ratio('sum(CAST(had_email AS BIGINT))', 'count(*)', 6, 10)} AS email_rate
FROM processed2 GROUP BY app_id""".lstrip()))

register("metadata_query", with_fx(["fx_reviews"], f""", src AS (SELECT * FROM fx_reviews),
{PROCESSED}
SELECT app_id, external_review_id, original_length FROM processed2 WHERE had_credit_card""".lstrip()))

register("rating_summary", with_fx(["fx_reviews"], f"""
SELECT app_id, CAST(date_trunc('month', review_date) AS TIMESTAMP) AS month, count(*) AS n_reviews,
       {dec_ratio('sum(rating)', 'count(*)', 6, 12)} AS avg_rating,
       {", ".join(f"CAST(count(*) FILTER (WHERE rating = {k}) AS BIGINT) AS n_{k}" for k in range(1, 6))},
       CAST(count(*) FILTER (WHERE rating <= 2) AS BIGINT) AS n_negative
FROM fx_reviews WHERE rating BETWEEN 1 AND 5 GROUP BY ALL"""))

register("weekly_report", with_fx(["fx_reviews"], """
SELECT app_id, week, count(*) AS n_reviews, CAST(sum(rating) AS BIGINT) AS rating_sum,
       CAST(count(*) FILTER (WHERE rating <= 2) AS BIGINT) AS n_negative,
       CAST(GROUPING(app_id, week) AS INTEGER) AS level
FROM (SELECT app_id, CAST(date_trunc('week', review_date) AS TIMESTAMP) AS week, rating
      FROM fx_reviews WHERE rating BETWEEN 1 AND 5)
GROUP BY ROLLUP (app_id, week)"""))

register("reviews_page", with_fx(["fx_reviews"], """
SELECT app_id, external_review_id, review_date, rating FROM fx_reviews WHERE app_id = 'src3'
ORDER BY review_date DESC, external_review_id DESC LIMIT 20"""))

register("new_reviews", with_fx(["fx_reviews"], """,
stored AS (SELECT d.source AS app_id, CAST(d.doc_id AS VARCHAR) AS external_review_id
           FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))
SELECT app_id, external_review_id, rating FROM fx_reviews b
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.app_id = b.app_id AND s.external_review_id = b.external_review_id)
""".lstrip()))

register("review_merge", with_fx(["fx_reviews"], f""",
src AS (SELECT * REPLACE (md5(content) AS external_review_id) FROM fx_reviews),
{PROCESSED}
SELECT app_id, external_review_id,
       first(rating ORDER BY pos) AS rating, first(review_date ORDER BY pos) AS review_date,
       first(title_processed ORDER BY pos DESC) AS title, first(content_processed ORDER BY pos DESC) AS content,
       first(author_name_processed ORDER BY pos DESC) AS author_name,
       first(original_length ORDER BY pos DESC) AS original_length,
       first(processed_length ORDER BY pos DESC) AS processed_length
FROM processed2 GROUP BY app_id, external_review_id""".lstrip()))

# --- normalisers / firewall ---------------------------------------------------------------------
register("normalize_currency", with_fx(["fx_raw_prices"], f"""
SELECT scrape_id, raw_currency, {currency('raw_currency')} AS currency, {currency_error('raw_currency')} AS error
FROM fx_raw_prices"""))

register("parse_price", with_fx(["fx_raw_prices"], f"""
SELECT scrape_id, raw_price, {parse_price('raw_price')} AS price FROM fx_raw_prices"""))

VALIDATED_PRICES = f"""validated AS (
  SELECT *, {joined(price_rule('price_exact'), currency_error('raw_currency'), region_rule('raw_region'),
                    "CASE WHEN ts IS NULL THEN 'timestamp is required' END")} AS v
  FROM (SELECT *, {parse_price('raw_price')} AS price_exact FROM fx_raw_prices)),
labelled AS (
  SELECT scrape_id, app_id,
         CASE WHEN ({price_rule('price_exact')}) IS NULL THEN CAST(price_exact AS DECIMAL(10,2)) END AS price,
         {currency('raw_currency')} AS currency, upper({strip('raw_region')}) AS region, ts,
         CASE WHEN price_exact IS NULL THEN '' ELSE v END AS violations,
         CASE WHEN price_exact IS NULL THEN 'no_price' WHEN v = '' THEN 'accepted' ELSE 'rejected' END AS outcome
  FROM validated)"""

register("validate_prices", with_fx(["fx_raw_prices"], f""",
{VALIDATED_PRICES}
SELECT * FROM labelled""".lstrip()))

register("quarantine_counts", with_fx(["fx_raw_prices"], f""",
{VALIDATED_PRICES}
SELECT outcome, rule, count(*) AS n FROM (
  SELECT outcome, unnest(CASE WHEN violations = '' THEN [NULL::VARCHAR] ELSE string_split(violations, '; ') END) AS rule
  FROM labelled)
GROUP BY outcome, rule""".lstrip()))

register("validate_reviews", with_fx(["fx_reviews"], f"""
SELECT app_id, external_review_id, rating, title, author_name, review_date,
       {joined(f"coalesce({required('external_review_id', 'external_review_id')}, {maxlen('external_review_id', 255, 'external_review_id')})",
               "CASE WHEN rating IS NULL THEN 'rating is required' WHEN rating < 1 OR rating > 5 THEN 'Rating must be between 1 and 5' END",
               maxlen('title', 500, 'title'), maxlen('author_name', 255, 'author_name'))} AS violations
FROM (SELECT app_id, {strip('external_review_id')} AS external_review_id, rating,
             {nullif_blank('title')} AS title, {nullif_blank('author_name')} AS author_name, review_date
      FROM fx_reviews)"""))

register("validate_apps", with_fx(["fx_apps"], f"""
SELECT id, name, bundle_id, developer_name, icon_url,
       {joined(f"coalesce({required('name', 'name')}, {maxlen('name', 255, 'name')})",
               f"coalesce({required('bundle_id', 'bundle_id')}, {maxlen('bundle_id', 255, 'bundle_id')})",
               maxlen('developer_name', 255, 'developer_name'), maxlen('icon_url', 512, 'icon_url'))} AS violations
FROM (SELECT id, {strip('name')} AS name, {strip('bundle_id')} AS bundle_id,
             {nullif_blank('developer_name')} AS developer_name, CAST(NULL AS VARCHAR) AS icon_url
      FROM fx_apps)"""))

register("unique_audit", with_fx(["fx_apps", "fx_reviews", "fx_prices"], """
SELECT 'apps' AS table_name, concat_ws('|', bundle_id, store) AS key, count(*) AS n_rows
FROM fx_apps GROUP BY bundle_id, store HAVING count(*) > 1
UNION ALL
SELECT 'reviews', concat_ws('|', app_id, external_review_id), count(*)
FROM fx_reviews GROUP BY app_id, external_review_id HAVING count(*) > 1
UNION ALL
SELECT 'review_batch', concat_ws('|', app_id, md5(content)), count(*)
FROM fx_reviews GROUP BY app_id, md5(content) HAVING count(*) > 1
UNION ALL
SELECT 'price_history', concat_ws('|', CAST(id AS VARCHAR), CAST(ts AS VARCHAR)), count(*)
FROM fx_prices GROUP BY id, ts HAVING count(*) > 1"""))

register("fk_audit", with_fx(["fx_ratings", "fx_apps"], """
SELECT app_id, count(*) AS n_orphans FROM fx_ratings r
WHERE NOT EXISTS (SELECT 1 FROM fx_apps a WHERE a.id = r.app_id) GROUP BY app_id"""))


def _nulls(table: str, fx: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, 'null' AS rule, "
        f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_violations FROM {fx}" for c in cols)


register("null_enum_audit", with_fx(["fx_apps", "fx_prices", "fx_reviews"], f"""
{_nulls('apps', 'fx_apps', ['name', 'bundle_id', 'store', 'is_active'])}
UNION ALL
SELECT 'apps', 'store', 'enum', CAST(count(*) FILTER (WHERE store IS NOT NULL AND store NOT IN ('APPLE_APP_STORE', 'GOOGLE_PLAY_STORE')) AS BIGINT) FROM fx_apps
UNION ALL
{_nulls('price_history', 'fx_prices', ['price', 'currency', 'region', 'ts'])}
UNION ALL
{_nulls('reviews', 'fx_reviews', ['app_id', 'external_review_id', 'rating'])}"""))

# --- catalogue -----------------------------------------------------------------------------------
APPLE_URL = "'https://apps.apple.com/' || lower({r}) || '/app/id' || bundle_id"
GOOGLE_URL = "'https://play.google.com/store/apps/details?id=' || bundle_id || '&hl=en&gl=' || upper({r})"


def url(r: str) -> str:
    return (f"CASE WHEN store = 'APPLE_APP_STORE' THEN {APPLE_URL.format(r=r)} "
            f"ELSE {GOOGLE_URL.format(r=r)} END")


register("store_urls", with_fx(["fx_apps"], f"""
SELECT id AS app_id, region, store, {url('region')} AS url, store = 'APPLE_APP_STORE' AS supported,
       CASE WHEN store <> 'APPLE_APP_STORE' THEN 'Google Play scraper not yet implemented' END AS error
FROM fx_apps CROSS JOIN (VALUES ('us'), ('mx'), ('br'), ('de'), ('jp')) AS t(region)"""))

register("request_lookup", with_fx(["fx_apps"], f""",
req AS (SELECT o_orderkey AS request_id, o_custkey + 1000 AS app_id FROM orders)
SELECT r.request_id, r.app_id, a.id IS NOT NULL AS found, a.store,
       CASE WHEN a.id IS NOT NULL THEN {url("'us'")} END AS url,
       a.id IS NOT NULL AND a.store = 'APPLE_APP_STORE' AS dispatched,
       CASE WHEN a.id IS NULL THEN 'App not found'
            WHEN a.store <> 'APPLE_APP_STORE' THEN 'Google Play scraper not yet implemented' END AS error
FROM req r LEFT JOIN fx_apps a ON a.id = r.app_id""".lstrip()))

register("batch_enqueued", "SELECT count(*) AS enqueued FROM orders")

register("apps_merge", with_fx(["fx_apps"], """,
cat AS (SELECT *, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS icon_url FROM fx_apps),
scr AS (SELECT p_partkey AS id, upper(p_name) AS s_name0, p_size,
               CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type || ' Inc' END AS s_dev,
               p_type AS s_desc, CAST(NULL AS VARCHAR) AS s_icon
        FROM part),
j AS (SELECT c.*, s.s_name0, s.s_dev, s.s_desc, s.s_icon FROM cat c LEFT JOIN scr s ON s.id = c.id),
o AS (SELECT id, coalesce(s_name0, name) AS new_name, bundle_id, store,
             CASE WHEN coalesce(s_dev, '') <> '' THEN s_dev ELSE developer_name END AS new_dev,
             CASE WHEN coalesce(s_desc, '') <> '' THEN s_desc ELSE description END AS new_desc,
             CASE WHEN coalesce(s_icon, '') <> '' THEN s_icon ELSE icon_url END AS new_icon,
             is_active, name, developer_name, description, icon_url
      FROM j)
SELECT id, new_name AS name, bundle_id, store, new_dev AS developer_name, new_desc AS description,
       new_icon AS icon_url, is_active,
       NOT (new_name IS NOT DISTINCT FROM name AND new_dev IS NOT DISTINCT FROM developer_name
            AND new_desc IS NOT DISTINCT FROM description AND new_icon IS NOT DISTINCT FROM icon_url) AS changed
FROM o""".lstrip()))

register("worklist", with_fx(["fx_apps", "fx_attempts"], """,
last AS (SELECT app_id, max(ts) AS last_scraped_at FROM fx_attempts GROUP BY app_id)
SELECT a.id AS app_id, l.last_scraped_at,
       CASE WHEN l.last_scraped_at IS NULL OR l.last_scraped_at <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR
            THEN 'full' ELSE 'price_only' END AS mode
FROM fx_apps a LEFT JOIN last l ON l.app_id = a.id WHERE a.is_active""".lstrip()))

register("apps_page", with_fx(["fx_apps"], """
SELECT id, name, bundle_id, store FROM fx_apps WHERE name > 'b' OR (name = 'b' AND id > 0)
ORDER BY name, id LIMIT 50"""))

register("store_union", with_fx(["fx_apps"], """
SELECT id, name, bundle_id, developer_name, 'APPLE_APP_STORE' AS store FROM fx_apps WHERE store = 'APPLE_APP_STORE'
UNION ALL
SELECT id, name, bundle_id, CAST(NULL AS VARCHAR), 'GOOGLE_PLAY_STORE' FROM fx_apps WHERE store = 'GOOGLE_PLAY_STORE'"""))

# --- prices ------------------------------------------------------------------------------------------
register("price_partitions", with_fx(["fx_prices_long"], """
SELECT CASE WHEN ts2 >= TIMESTAMP '2026-01-01' AND ts2 < TIMESTAMP '2028-01-01' THEN strftime(ts2, '%Y%m')
            ELSE 'default' END AS price_month, count(*) AS n_rows
FROM (SELECT CAST(CAST(ts AS DATE) + INTERVAL 372 MONTH AS TIMESTAMP) AS ts2 FROM fx_prices_long)
GROUP BY 1"""))

register("running_avg", with_fx(["fx_prices_long"], f"""
SELECT app_id, id, ts, price, count(*) OVER w AS run_n,
       {dec_ratio(cents('sum(price) OVER w'), '100 * count(*) OVER w')} AS running_avg
FROM fx_prices_long WINDOW w AS (PARTITION BY app_id ORDER BY ts)"""))

CHANGES = f"""changes AS (
  SELECT app_id, region, currency, id, ts, prev_price, price, prev_ts, price - prev_price AS delta,
         CASE WHEN prev_price <> 0 THEN {dec_ratio(cents('price - prev_price'), cents('prev_price'))} END AS change_pct
  FROM (SELECT *, lag(price) OVER w AS prev_price, lag(ts) OVER w AS prev_ts
        FROM SERIES WINDOW w AS (PARTITION BY app_id, region, currency ORDER BY ts, id))
  WHERE prev_price IS NOT NULL AND price <> prev_price)"""

register("price_changes", with_fx(["fx_prices"], f""",
{CHANGES.replace('SERIES', 'fx_prices')}
SELECT * FROM changes""".lstrip()))

register("offers", with_fx(["fx_prices"], f"""
SELECT app_id, region, currency, id, ts, price, avg_30d FROM (
  SELECT *, {dec_ratio(cents('s'), '100 * n')} AS avg_30d FROM (
    SELECT app_id, region, currency, id, ts, price, sum(price) OVER w AS s, count(price) OVER w AS n
    FROM fx_prices
    WINDOW w AS (PARTITION BY app_id, region, currency ORDER BY epoch_us(ts)
                 RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING)))
WHERE n > 0 AND CAST(price * 100 AS HUGEINT) * n * 100 < CAST(s * 100 AS HUGEINT) * 85"""))

register("latest_price", with_fx(["fx_prices"], """
SELECT app_id, region, currency, price, ts, id, n_obs FROM (
  SELECT *, row_number() OVER (PARTITION BY app_id, region, currency ORDER BY ts DESC, id DESC) AS rn,
         count(*) OVER (PARTITION BY app_id, region, currency) AS n_obs
  FROM fx_prices) WHERE rn = 1"""))

register("churn", with_fx(["fx_purchase_prices", "fx_ratings"], f""",
{CHANGES.replace('SERIES', 'fx_purchase_prices')},
rises AS (SELECT app_id, id AS rise_id, ts AS rise_ts, prev_price, price FROM changes WHERE delta > 0),
counted AS (
  SELECT r.app_id, r.rise_id, r.rise_ts, r.prev_price, r.price,
         count(v.ts) FILTER (WHERE v.ts >= r.rise_ts - INTERVAL 7 DAY AND v.ts < r.rise_ts AND v.rating <= 2) AS neg_before,
         count(v.ts) FILTER (WHERE v.ts > r.rise_ts AND v.ts <= r.rise_ts + INTERVAL 7 DAY AND v.rating <= 2) AS neg_after
  FROM rises r LEFT JOIN fx_ratings v
    ON v.app_id = r.app_id AND v.ts >= r.rise_ts - INTERVAL 7 DAY AND v.ts <= r.rise_ts + INTERVAL 7 DAY
  GROUP BY r.app_id, r.rise_id, r.rise_ts, r.prev_price, r.price)
SELECT * FROM counted WHERE neg_after >= greatest(3, 2 * neg_before)""".lstrip()))

register("asof_price", with_fx(["fx_ratings", "fx_purchase_prices"], """
SELECT r.review_id, r.app_id, r.ts, r.rating,
       (SELECT p.price FROM fx_purchase_prices p WHERE p.app_id = r.app_id AND p.ts <= r.ts
        ORDER BY p.ts DESC, p.id DESC LIMIT 1) AS price_in_force
FROM fx_ratings r"""))

register("price_trends", with_fx(["fx_prices_long"], f"""
SELECT app_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, currency, region,
       count(*) AS n_obs, min(price) AS min_price, max(price) AS max_price,
       first(price ORDER BY ts, id) AS first_price, first(price ORDER BY ts DESC, id DESC) AS last_price,
       {dec_ratio(cents('sum(price)'), '100 * count(*)')} AS avg_price
FROM fx_prices_long GROUP BY ALL"""))

register("compare_apps", with_fx(["fx_prices_long"], f"""
SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS period,
       {", ".join(f"{dec_ratio(cents(f'sum(price) FILTER (WHERE app_id = {a})'), f'100 * count(*) FILTER (WHERE app_id = {a})')} AS app_{a}" for a in (1, 2, 3))}
FROM fx_prices_long WHERE app_id IN (1, 2, 3) GROUP BY 1"""))

register("price_history_page", with_fx(["fx_prices_long"], """
SELECT * FROM fx_prices_long
WHERE app_id = 7 AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1998-01-01'
  AND (ts < TIMESTAMP '1997-06-01' OR (ts = TIMESTAMP '1997-06-01' AND id < 1000000000000))
ORDER BY ts DESC, id DESC LIMIT 100"""))

register("top_movers", with_fx(["fx_prices"], f""",
{CHANGES.replace('SERIES', 'fx_prices')}
SELECT app_id, region, currency, id, ts, prev_price, price, change_pct FROM changes
WHERE change_pct IS NOT NULL ORDER BY abs(change_pct) DESC, app_id, region, ts, id LIMIT 20""".lstrip()))

register("retention_split", with_fx(["fx_prices_long", "fx_reviews"], """
SELECT table_name, retention, count(*) AS n_rows FROM (
  SELECT 'price_history' AS table_name,
         CASE WHEN ts >= TIMESTAMP '2001-08-01' - INTERVAL 24 MONTH THEN 'keep' ELSE 'expire' END AS retention
  FROM fx_prices_long
  UNION ALL
  SELECT 'reviews', CASE WHEN review_date >= TIMESTAMP '2024-07-15' - INTERVAL 6 MONTH THEN 'keep' ELSE 'expire' END
  FROM fx_reviews)
GROUP BY ALL"""))

# --- ingestion health ------------------------------------------------------------------------------
register("sync_errors", with_fx(["fx_attempts"], """
SELECT app_id, attempt_id, ts, streak FROM (
  SELECT *, pos - coalesce(max(CASE WHEN NOT failed THEN pos END) OVER (
                PARTITION BY app_id ORDER BY ts, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS streak
  FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY ts, attempt_id) AS pos FROM fx_attempts))
WHERE failed AND streak >= 3"""))

register("health_hourly", with_fx(["fx_attempts"], f"""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, store, count(*) AS n_attempts,
       CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS n_failed,
       {dec_ratio('count(*) FILTER (WHERE failed)', 'count(*)', 6, 10)} AS failure_rate
FROM fx_attempts GROUP BY ALL"""))

register("rate_limit", with_fx(["fx_access"], """
SELECT ip, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, count(*) AS n_requests
FROM fx_access GROUP BY ALL HAVING count(*) > 1"""))

# --- similarity / search / changelog ---------------------------------------------------------------
from storelens.operators.search import FAULT_TERMS  # noqa: E402

VEC = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dims AS (SELECT label, i, avg(v[i]) AS m FROM e CROSS JOIN unnest(range(1, len(v) + 1)) AS t(i) GROUP BY label, i),
cent AS (SELECT label AS qid, list(m ORDER BY i) AS c FROM dims GROUP BY label),
sc AS (SELECT e.vec_id, cent.qid,
              list_dot_product(e.v, cent.c) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(cent.c, cent.c))) AS sim
       FROM e CROSS JOIN cent)"""

register("similar_reviews", f"""WITH {VEC}
SELECT vec_id, CAST(qid AS BIGINT) AS group_id, round(sim, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, qid) AS r FROM sc) WHERE r = 1""")

# All pairs; a group's vectors are all similar to each other in the test tables, so the smallest similar id names it.
register("review_groups", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, unnest(range(vec_id % 4 + 1)) AS c FROM embeddings),
r AS (SELECT vec_id * 4 + c AS id, [x * (1 + c * ((i * 7 + c * 3) % 5 - 2) / 40.0::DOUBLE) FOR x, i IN v] AS v FROM e),
s AS (SELECT a.id, min(b.id) AS group_id, count(*) AS group_size,
             arg_min(list_cosine_similarity(a.v, b.v), b.id) AS sim
      FROM r a JOIN r b ON list_cosine_similarity(a.v, b.v) >= 0.9 GROUP BY a.id)
SELECT id AS vec_id, group_id, group_size, CASE WHEN id = group_id THEN 1.0::DOUBLE ELSE round(sim, 6) END AS similarity FROM s""")

register("nearest_reviews", f"""WITH {VEC}
SELECT CAST(qid AS BIGINT) AS qid, vec_id, rank, round(sim, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM sc) WHERE rank <= 5""")

_TERMS = ", ".join(q(t) for t in dict.fromkeys(FAULT_TERMS))
register("keyword_faults", with_fx(["fx_reviews"], f""",
toks AS (SELECT external_review_id, unnest(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM fx_reviews),
c AS (SELECT term, count(*) AS n_mentions, count(DISTINCT external_review_id) AS n_reviews
      FROM toks WHERE term IN ({_TERMS}) GROUP BY term)
SELECT t.term, CAST(coalesce(c.n_mentions, 0) AS BIGINT) AS n_mentions, CAST(coalesce(c.n_reviews, 0) AS BIGINT) AS n_reviews
FROM (SELECT unnest([{_TERMS}]) AS term) t LEFT JOIN c USING (term)""".lstrip()))

register("changelog_new_items", with_fx(["fx_changelog"], """,
lines AS (SELECT app_id, version, CAST(generate_subscripts(string_split(notes, chr(10)), 1) - 1 AS INTEGER) AS pos,
                 unnest(string_split(notes, chr(10))) AS line FROM fx_changelog),
items AS (SELECT app_id, version, pos, item, lower(item) AS item_key FROM (
            SELECT app_id, version, pos,
                   regexp_replace(regexp_replace(line, '^\\s*[-*•]\\s*', ''), '^\\s+|\\s+$', '', 'g') AS item FROM lines)
          WHERE item <> ''),
vers AS (SELECT app_id, version, lag(version) OVER (PARTITION BY app_id ORDER BY version) AS prev_version
         FROM (SELECT DISTINCT app_id, version FROM fx_changelog))
SELECT i.app_id, i.version, i.pos, i.item FROM items i JOIN vers v USING (app_id, version)
WHERE NOT EXISTS (SELECT 1 FROM items o WHERE o.app_id = i.app_id AND o.version = v.prev_version AND o.item_key = i.item_key)
""".lstrip()))

# --- remaining scalar and join rows ----------------------------------------------------------------
register("parse_ratings", with_fx(["fx_reviews"], """,
src AS (SELECT external_review_id,
               coalesce(NULLIF(CASE WHEN pos % 2 = 0 THEN CAST(rating AS VARCHAR) || ' out of 5' END, ''),
                        CAST(rating AS VARCHAR) || ' stars') AS t FROM fx_reviews),
p AS (SELECT external_review_id, CAST(NULLIF(regexp_extract(t, '([0-9])', 1), '') AS INTEGER) AS rating FROM src)
SELECT external_review_id, rating,
       CASE WHEN rating IS NULL THEN 'rating is required'
            WHEN rating < 1 OR rating > 5 THEN 'Rating must be between 1 and 5' END AS error
FROM p""".lstrip()))

register("parse_dates", with_fx(["fx_reviews"], """,
src AS (SELECT external_review_id, pos % 4 AS k, review_date,
               CASE pos % 4 WHEN 0 THEN strftime(review_date, '%b ') || CAST(day(review_date) AS VARCHAR) || strftime(review_date, ', %Y')
                            WHEN 1 THEN strftime(review_date, '%B %d, %Y')
                            WHEN 2 THEN strftime(review_date, '%Y-%m-%d')
                            ELSE strftime(review_date, '%d/%m/%Y') END AS date_text FROM fx_reviews)
SELECT external_review_id, date_text,
       CASE WHEN k < 3 THEN CAST(date_trunc('day', review_date) AS TIMESTAMP) END AS review_date
FROM src""".lstrip()))

register("app_review_counts", with_fx(["fx_ratings", "fx_apps"], f"""
SELECT a.id AS app_id, a.name, a.store, count(*) AS n_reviews, CAST(sum(r.rating) AS BIGINT) AS rating_sum,
       {dec_ratio('sum(r.rating)', 'count(*)', 6, 12)} AS avg_rating
FROM fx_apps a JOIN fx_ratings r ON r.app_id = a.id GROUP BY a.id, a.name, a.store"""))

register("cascade_reviews", with_fx(["fx_ratings", "fx_apps"], """
SELECT * FROM fx_ratings r WHERE EXISTS (SELECT 1 FROM fx_apps a WHERE a.id = r.app_id AND a.is_active)"""))

register("metadata_json_query", """
SELECT event_id, user_id AS app_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k
FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 95""")

# Twin of the selector profile for the captured pages of the test tables: one
# <article><h1> per page, links in <nav><ul><li>.  Character references are
# decoded like HTML does for the forms these elements hold: the legacy names
# quot/lt/gt/amp with or without ';', '&amp' last so a decoded '&' is never
# read again as the start of a reference; anything else stays literal.
def html_text(x: str) -> str:
    for ent, ch in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{ent};?', {q(ch)}, 'g')"
    return f"NULLIF(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"


register("page_fields", f"""
SELECT page_id,
       {html_text("regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)")} AS name,
       NULLIF(regexp_extract(html, '(?s)<nav>.*?<a href="([^"]*)"', 1), '') AS icon_url,
       {html_text("regexp_replace(regexp_extract(html, '(?s)<nav><ul><li>(.*?)</li>', 1), '<[^>]+>', '', 'g')")} AS raw_price,
       CAST(len(regexp_extract_all(html, 'data-review-id')) AS INTEGER) AS review_containers
FROM pages""")

# Streaming twins: the streams' tables hold what the batch jobs compute.
register("price_alerts_stream", with_fx(["fx_prices"], """
SELECT app_id, region, currency, id, ts, prev_price, price FROM (
  SELECT *, lag(price) OVER w AS prev_price
  FROM fx_prices WINDOW w AS (PARTITION BY app_id, region, currency ORDER BY ts, id))
WHERE prev_price IS NOT NULL AND price <> prev_price"""))

register("failure_monitor_stream", with_fx(["fx_attempts"], f"""
SELECT * FROM (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, store, count(*) AS n_attempts,
         CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS n_failed,
         {dec_ratio('count(*) FILTER (WHERE failed)', 'count(*)', 6, 10)} AS failure_rate
  FROM fx_attempts GROUP BY ALL)"""))

register("rate_limit_stream", with_fx(["fx_access"], """
SELECT ip, minute, n_requests FROM (
  SELECT ip, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, count(*) AS n_requests
  FROM fx_access GROUP BY ALL HAVING count(*) > 1)"""))

register("dedupe_reviews_stream", with_fx(["fx_reviews"], """
SELECT DISTINCT app_id, md5(content) AS external_review_id FROM fx_reviews"""))


# --- validated pages (stand-in raw fields) ----------------------------------------------------------
RAW_PAGES = """WITH p AS (SELECT doc_id AS page_id, doc_id AS i,
    CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'https://s/app/' || (doc_id % 50) || '?page=' || doc_id END AS url,
    CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 19 = 1 THEN repeat('n', 256) ELSE 'App ' || doc_id END AS name,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Dev' END AS developer_name,
    CASE doc_id % 7 WHEN 0 THEN 0.00 WHEN 1 THEN 4.99 WHEN 4 THEN 123456789.99 WHEN 5 THEN 1.50 END AS price
  FROM documents),
seen AS (SELECT page_id, k::INTEGER AS pos, i + k AS z FROM (SELECT page_id, i, unnest(range(i % 4)) AS k FROM p)),
r0 AS (SELECT *, CASE WHEN z % 11 IN (0, 1) THEN NULL WHEN z % 29 = 2 THEN '' ELSE 'r' || (z % 40) END AS rid,
    CASE WHEN z % 13 = 0 THEN NULL WHEN z % 31 = 3 THEN 9 WHEN z % 37 = 4 THEN 4 ELSE 1 + z % 5 END::INTEGER AS rating,
    CASE WHEN z % 7 = 0 THEN NULL ELSE 'Ann' END AS author_name, CASE WHEN z % 5 = 0 THEN NULL ELSE '2025-01-05' END AS day FROM seen),
r AS (SELECT *, concat_ws('; ', CASE WHEN rid = '' THEN 'external_review_id cannot be empty' END,
    CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'Rating must be between 1 and 5' END) AS v FROM r0 WHERE rid IS NOT NULL AND rating IS NOT NULL),
rv AS (SELECT page_id, count(*)::INTEGER AS n, string_agg(nullif(v, ''), '; ' ORDER BY pos) AS v,
    string_agg(concat_ws(':', rid, rating, author_name, day), ',' ORDER BY pos) AS listed FROM r GROUP BY page_id),
res AS (SELECT p.*, rv.n, rv.listed, nullif(concat_ws('; ', CASE WHEN url = '' THEN 'url cannot be empty' END,
    CASE WHEN length(name) > 255 THEN 'name exceeds max length of 255' END,
    CASE WHEN price > 99999999.99 THEN 'Price exceeds maximum of 99999999.99' END, rv.v), '') AS error FROM p LEFT JOIN rv USING (page_id))
"""

register("page_results", RAW_PAGES + """
SELECT page_id, url, error IS NULL AS success, error, CASE WHEN error IS NULL THEN name END AS name,
       CASE WHEN error IS NULL AND name IS NOT NULL THEN developer_name END AS developer_name,
       CASE WHEN error IS NULL THEN price END::DECIMAL(10,2) AS price, error IS NULL AND name IS NOT NULL AS has_app,
       error IS NULL AND price IS NOT NULL AS has_price, CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END::INTEGER AS review_count,
       CASE WHEN error IS NULL THEN coalesce(listed, '') ELSE '' END AS reviews FROM res""")

register("paginated_reviews", RAW_PAGES + """
SELECT app_url, external_review_id, page_id, pos, rating, title, author_name FROM (
  SELECT regexp_replace(res.url, '[?#].*$', '') AS app_url, r.rid AS external_review_id, r.page_id, r.pos, r.rating,
         'title ' || r.page_id AS title, r.author_name,
         row_number() OVER (PARTITION BY regexp_replace(res.url, '[?#].*$', ''), r.rid ORDER BY r.page_id, r.pos) AS rn
  FROM r JOIN res USING (page_id) WHERE res.error IS NULL) WHERE rn = 1""")

# The captures: four pages an app, taken in an order of their own; even pages are batch 0, odd ones batch 1.
CAPTURES = RAW_PAGES + """, cap AS (SELECT *, page_id // 4 AS app_id, page_id % 2 AS batch_id, TIMESTAMP '2025-12-01' + to_hours((page_id * 37) % 16000) AS taken
  FROM res WHERE error IS NULL)
"""
UPDATES = CAPTURES + """, u AS (SELECT app_id, batch_id, name, developer_name, 'https://i/' || page_id AS icon_url FROM cap WHERE name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY app_id, batch_id ORDER BY taken DESC, page_id DESC) = 1)
"""

register("commit_prices", CAPTURES + f"""
SELECT app_id, price::DECIMAL(10,2) AS price, 'USD' AS currency, 'US' AS region, taken AS ts,
       CASE WHEN taken >= TIMESTAMP '{FIRST_MONTH}' AND taken < TIMESTAMP '{END_MONTH}' THEN strftime(taken, '%Y%m') ELSE 'default' END AS price_month
FROM cap WHERE price IS NOT NULL""")

register("commit_reviews", CAPTURES + """
SELECT app_id, external_review_id, rating, review_date FROM (
  SELECT app_id, r.rid AS external_review_id, r.rating, r.day::TIMESTAMP AS review_date,
         row_number() OVER (PARTITION BY app_id, r.rid ORDER BY batch_id, taken, r.page_id, r.pos) AS rn
  FROM r JOIN cap USING (page_id)) WHERE rn = 1""")

register("commit_apps", UPDATES + "SELECT app_id, batch_id, name, developer_name, icon_url FROM u")

register("commit_catalogue", UPDATES.replace("WITH p AS", f"WITH {FX['fx_apps']}, p AS", 1) + """
SELECT c.id, coalesce(b.name, a.name, c.name) AS name, c.bundle_id, c.store, coalesce(b.developer_name, a.developer_name, c.developer_name) AS developer_name,
       CASE WHEN coalesce(b.name, a.name) IS NOT NULL THEN 'about' END AS description, coalesce(b.icon_url, a.icon_url) AS icon_url, c.is_active
FROM fx_apps c LEFT JOIN (FROM u WHERE batch_id = 0) a ON a.app_id = c.id LEFT JOIN (FROM u WHERE batch_id = 1) b ON b.app_id = c.id""")
