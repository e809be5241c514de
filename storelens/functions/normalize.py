"""Normalisers for scraped fields (Column -> Column), all native expressions.

Each builder returns the normalised value; rule builders return a message
Column that is NULL when the rule holds, so a job can collect violations with
``array_compact(array(rule1, rule2, ...))`` in one projection.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from storelens.functions.text import py_strip

# ---------------------------------------------------------------------------
# Currency symbols and ISO codes the results must agree with.
# ---------------------------------------------------------------------------
CURRENCY_SYMBOLS = {
    "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₩": "KRW", "₹": "INR",
    "₽": "RUB", "R$": "BRL", "₺": "TRY", "₫": "VND", "₱": "PHP", "฿": "THB",
    "zł": "PLN", "kr": "SEK", "Fr": "CHF",
}
CURRENCY_CODES = [
    "AED", "ARS", "AUD", "BGN", "BRL", "CAD", "CHF", "CLP", "CNY", "COP", "CZK",
    "DKK", "EGP", "EUR", "GBP", "HKD", "HRK", "HUF", "IDR", "ILS", "INR", "JPY",
    "KRW", "MXN", "MYR", "NGN", "NOK", "NZD", "PEN", "PHP", "PKR", "PLN", "QAR",
    "RON", "RUB", "SAR", "SEK", "SGD", "THB", "TRY", "TWD", "UAH", "USD", "VND",
    "ZAR",
]
# Column limits (code points) and the price ceiling.
MAX_NAME = 255
MAX_BUNDLE_ID = 255
MAX_DEVELOPER = 255
MAX_ICON_URL = 512
MAX_TITLE = 500
MAX_AUTHOR = 255
MAX_REVIEW_ID = 255
MAX_REGION = 5
MAX_PRICE = "99999999.99"
# English month names accepted by the review-date formats.
MONTHS = ["january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december"]
# ---------------------------------------------------------------------------

STORES = ("APPLE_APP_STORE", "GOOGLE_PLAY_STORE")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


# --- N3 / N4 / N5 -------------------------------------------------------------
def strip_or_null(col) -> Column:
    """Python-style strip; blank -> NULL."""
    return F.nullif(py_strip(col), F.lit(""))


def required_rule(stripped: Column, field: str) -> Column:
    """Message when the stripped value is NULL/blank."""
    return F.when(stripped.isNull() | (stripped == ""), F.lit(f"{field} cannot be empty"))


def max_length_rule(value: Column, n: int, field: str) -> Column:
    """Message when longer than ``n`` code points (NULL passes)."""
    return F.when(F.char_length(value) > n, F.lit(f"{field} exceeds max length of {n}"))


def quoted(c: Column) -> Column:
    """The text in quotes as messages show it: single ones unless it holds only
    those, with backslashes, the quote itself and line controls escaped."""
    x = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for ch, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(ch), F.lit(name))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))


# --- N1 -----------------------------------------------------------------------
def normalize_currency(col) -> Column:
    """Symbol (case-sensitive, checked first) or ISO code (any case) -> ISO code; else NULL."""
    s = py_strip(col)
    up = F.upper(s)
    return F.coalesce(F.try_element_at(_lit_map(CURRENCY_SYMBOLS), s),
                      F.when(up.isin(CURRENCY_CODES), up))


def currency_rule(col) -> Column:
    s = py_strip(col)
    return (F.when(_c(col).isNull(), F.lit("currency is required"))
             .when(s == "", F.lit("Currency cannot be empty"))
             .when(normalize_currency(col).isNull(),
                   F.concat(F.lit("Unknown currency: "), quoted(_c(col)))))


# --- N2 -----------------------------------------------------------------------
def to_utc(col) -> Column:
    """Naive -> read as UTC; offset-bearing strings keep their instant; unreadable
    text gives NULL.  Result is
    a TIMESTAMP_NTZ holding UTC wall time (session zone is pinned to UTC)."""
    c = _c(col)
    return F.try_to_timestamp(c).cast("timestamp_ntz")


# Decimal digits of other scripts, and the ASCII digit each stands for.
_DIGITS = [(chr(c), unicodedata.decimal(chr(c))) for c in range(0x80, 0x110000) if unicodedata.decimal(chr(c), None) is not None]
OVER_LIMIT = "9999999999"


def ascii_digits(c: Column) -> Column:
    """The text with decimal digits of every script as 0 to 9."""
    return F.when(F.regexp_like(c, F.lit(r"(?U)(?![0-9])\d")), F.translate(
        c, "".join(d for d, _ in _DIGITS), "".join(str(v) for _, v in _DIGITS))).otherwise(c)


# --- N6 -----------------------------------------------------------------------
def parse_price(col) -> Column:
    """'free' (any case) -> 0; else keep digits (of any script) . , ; ',' -> '.'; unparsable -> NULL.

    decimal(38,10) keeps the value for the range rule; storage rounds to (10,2)
    after validation.  A value beyond the limit, by size or by digits that the
    type doesn't hold, is given as ``OVER_LIMIT``, so that the rule rejects it.
    """
    c = ascii_digits(_c(col))
    cleaned = F.replace(F.regexp_replace(c, r"[^0-9.,]", ""), F.lit(","), F.lit("."))
    # Only digits and dots remain; cast only well-formed numbers, so malformed
    # text never reaches the cast (a failing cast costs an exception per row).
    well_formed = cleaned.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")
    over = F.lit(OVER_LIMIT).cast("decimal(38,10)")
    kept = F.regexp_extract(cleaned, r"^([0-9]*\.?[0-9]{0,10})", 1)  # ten decimals, the rest cut off
    more = F.regexp_like(cleaned, F.lit(r"\.[0-9]{10}[0-9]*[1-9]"))
    beyond = more & (F.coalesce(kept.try_cast("decimal(38,10)"), over) >= F.lit(str(MAX_PRICE)).cast("decimal(38,10)"))
    return (F.when(c.isNull() | (c == ""), F.lit(None).cast("decimal(38,10)"))
             .when(F.lower(c) == "free", F.lit(0).cast("decimal(38,10)"))
             .when(well_formed, F.when(beyond, over).otherwise(F.coalesce(cleaned.try_cast("decimal(38,10)"), over))))


def price_rule(price: Column) -> Column:
    return (F.when(price.isNull(), F.lit("price is required"))
             .when(price < 0, F.lit("Price cannot be negative"))
             .when(price > F.lit(MAX_PRICE).cast("decimal(10,2)"),
                   F.lit(f"Price exceeds maximum of {MAX_PRICE}")))


# --- N7 -----------------------------------------------------------------------
def parse_rating(aria_label, text) -> Column:
    """First digit of the aria-label (when non-empty), else of the element text."""
    src = ascii_digits(F.coalesce(F.nullif(_c(aria_label), F.lit("")), _c(text)))
    return F.nullif(F.regexp_extract(src, r"([0-9])", 1), F.lit("")).cast("int")


def rating_rule(rating: Column) -> Column:
    return (F.when(rating.isNull(), F.lit("rating is required"))
             .when((rating < 1) | (rating > 5), F.lit("Rating must be between 1 and 5")))


# --- N8 -----------------------------------------------------------------------
_DAY = r"(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])"
_NAMED = r"(?iU)^([a-z]+)\s+" + _DAY + r",\s+([0-9]{4})$"
_ISO = r"^([0-9]{4})-(1[0-2]|0[1-9]|[1-9])-" + _DAY + "$"


def parse_date(col) -> Column:
    """'Jan 5, 2025' | 'January 05, 2025' | '2025-01-05' -> UTC midnight; else NULL.

    Month names are matched case-insensitively (abbreviated or full), days take
    one or two digits, years exactly four; impossible dates give NULL.
    """
    c = _c(col)
    month_no = {m[:3]: i + 1 for i, m in enumerate(MONTHS)}
    month_no.update({m: i + 1 for i, m in enumerate(MONTHS)})
    mname = F.lower(F.regexp_extract(c, _NAMED, 1))
    named = F.try_make_timestamp_ntz(
        F.regexp_extract(c, _NAMED, 3).cast("int"),
        F.try_element_at(_lit_map(month_no), mname),
        F.trim(F.regexp_extract(c, _NAMED, 2)).cast("int"),
        F.lit(0), F.lit(0), F.lit(0))
    iso = F.try_make_timestamp_ntz(
        F.regexp_extract(c, _ISO, 1).cast("int"),
        F.regexp_extract(c, _ISO, 2).cast("int"),
        F.trim(F.regexp_extract(c, _ISO, 3)).cast("int"),
        F.lit(0), F.lit(0), F.lit(0))
    return (F.when(c.rlike(_NAMED), named)
             .when(c.rlike(_ISO), iso))


# --- N9 -----------------------------------------------------------------------
def normalize_region(col) -> Column:
    return F.upper(py_strip(col))


def region_rule(col) -> Column:
    return F.when(_c(col).isNull(), F.lit("region is required")).otherwise(
        max_length_rule(normalize_region(col), MAX_REGION, "region"))


def store_rule(col) -> Column:
    return F.when(_c(col).isNull() | ~_c(col).isin(*STORES), F.lit("store is not a known store"))


def violations(*rules: Column) -> Column:
    """array<string> of the messages of the rules that fail (empty when clean).

    Built with ``concat`` of one-element arrays rather than ``array_compact``
    (a lambda-based function that would drop the projection out of
    whole-stage codegen)."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.when(r.isNotNull(), F.array(r)).otherwise(empty) for r in rules])

