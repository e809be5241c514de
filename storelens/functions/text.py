"""Text cleaning and PII masking as native Catalyst expressions (Column -> Column).

Everything here compiles to ``regexp_replace`` / ``rlike`` / string functions,
so a ``select`` of these builders stays inside one whole-stage-codegen span:
no Python worker, no serialisation.  Java regexes get ``(?U)`` so ``\\s``,
``\\d`` and ``\\b`` are Unicode-aware, as they are in the record-level rules
these builders reproduce.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Patterns and masks the results must agree with (do not edit).
# ---------------------------------------------------------------------------
HTML_TAG_PATTERN = r"<[^>]+>"
URL_PATTERN = r"https?://[^\s<>\"']+|www\.[^\s<>\"']+"
WHITESPACE_PATTERN = r"\s+"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = (
    r"(?:\+?\d{1,3}[-.\s]?)?"
    r"(?:\(?\d{2,4}\)?[-.\s]?)"
    r"(?:\d{3,4}[-.\s]?)"
    r"\d{3,4}"
)
CREDIT_CARD_PATTERN = r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
# Emoji code-point ranges (inclusive), in the order they are listed upstream.
EMOJI_RANGES = [
    (0x1F600, 0x1F64F),  # emoticons
    (0x1F300, 0x1F5FF),  # symbols & pictographs
    (0x1F680, 0x1F6FF),  # transport & map
    (0x1F1E0, 0x1F1FF),  # flags
    (0x2702, 0x27B0),    # dingbats
    (0xFE00, 0xFE0F),    # variation selectors
    (0x1F900, 0x1F9FF),  # supplemental symbols
    (0x1FA00, 0x1FA6F),  # chess symbols
    (0x1FA70, 0x1FAFF),  # symbols extended-A
    (0x2600, 0x26FF),    # misc symbols
    (0x2B50, 0x2B55),    # stars and circles
]
EMAIL_MASK = "[EMAIL]"
PHONE_MASK = "[PHONE]"
CREDIT_CARD_MASK = "[CREDIT_CARD]"
SSN_MASK = "[SSN]"
# ---------------------------------------------------------------------------

_U = "(?U)"  # Unicode character classes for \s \d \b \w
EMOJI_PATTERN = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI_RANGES) + "]+"
# Python's str.strip()/split() also treat U+001C..U+001F as whitespace.
PY_SPACE = r"[\s\x{1C}-\x{1F}]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _only_if(needle: Column, col: Column, expr: Column) -> Column:
    """Run an expensive regex only on rows containing a literal every match
    must contain; other rows pass through unchanged (same result, less work)."""
    return F.when(needle, expr).otherwise(col)


# --- T1-T4: single cleaning steps ------------------------------------------
def remove_html_tags(col) -> Column:
    return F.regexp_replace(_c(col), HTML_TAG_PATTERN, "")


def remove_urls(col, case_insensitive: bool = True) -> Column:
    """http(s)/www URLs; any case in the scalar form, case-sensitive in the batch job."""
    flags = "(?iU)" if case_insensitive else _U
    return F.regexp_replace(_c(col), flags + URL_PATTERN, "")


def normalize_whitespace(col) -> Column:
    """Collapse whitespace runs to one space, then strip (T3).  After the collapse
    every whitespace character is a plain space, so ``trim`` is the full strip."""
    return F.trim(F.regexp_replace(_c(col), f"(?U){PY_SPACE}+", " "))


def remove_emojis(col) -> Column:
    return F.regexp_replace(_c(col), EMOJI_PATTERN, "")


# --- T5: scalar full clean ---------------------------------------------------
def clean_text(col) -> Column:
    """tags -> URLs (any case) -> emoji -> lower -> whitespace."""
    s = remove_html_tags(col)
    s = remove_urls(s, case_insensitive=True)
    s = remove_emojis(s)
    s = F.lower(s)
    return normalize_whitespace(s)


# --- T6-T9, T11: masks -------------------------------------------------------
def mask_emails(col) -> Column:
    """E-mail addresses -> [EMAIL]."""
    c = _c(col)
    return _only_if(c.contains("@"), c, F.regexp_replace(c, _U + EMAIL_PATTERN, EMAIL_MASK))


def mask_phones(col) -> Column:
    """Phone numbers -> [PHONE] (scalar form only; the batch job has no phone step)."""
    return F.regexp_replace(_c(col), _U + PHONE_PATTERN, PHONE_MASK)


def mask_credit_cards(col) -> Column:
    """16-digit card numbers -> [CREDIT_CARD]."""
    return F.regexp_replace(_c(col), _U + CREDIT_CARD_PATTERN, CREDIT_CARD_MASK)


def mask_ssn(col) -> Column:
    """SSNs -> [SSN]."""
    c = _c(col)
    return _only_if(c.contains("-"), c, F.regexp_replace(c, _U + SSN_PATTERN, SSN_MASK))


def anonymize_pii(col) -> Column:
    """email -> card -> SSN -> phone (cards/SSNs first: the phone rule eats digits)."""
    return mask_phones(mask_ssn(mask_credit_cards(mask_emails(col))))


# --- T10: author initials ----------------------------------------------------
def py_strip(col) -> Column:
    """Strip leading/trailing whitespace the way Python's str.strip() does."""
    return F.regexp_replace(_c(col), f"(?U)^{PY_SPACE}+|{PY_SPACE}+$", "")


def author_initials(col) -> Column:
    """T10 / F1: 'John Doe' -> 'J. D.'; blank -> ''; NULL stays NULL (native, no Python UDF).

    Each word (a run of non-whitespace, Python's ``split()`` sense) becomes its
    first code point plus '.', separators collapse to one space, and the
    result is upper-cased — the same as upper-casing each initial, since only
    initials, dots and spaces remain.  No lambda functions, so the projection
    stays in whole-stage codegen.
    """
    word = f"(?U)([^\\s\\x{{1C}}-\\x{{1F}}])[^\\s\\x{{1C}}-\\x{{1F}}]*"
    marked = F.regexp_replace(py_strip(col), word, "$1.")
    return F.upper(F.regexp_replace(marked, f"(?U){PY_SPACE}+", " "))


# --- T12-T14: the batch review job's column recipes ---------------------------
def batch_clean(col) -> Column:
    """tags -> URLs (case-sensitive, before lowering) -> lower -> whitespace -> strip.

    NULL in, NULL out; markup-only text gives '' (not NULL).
    """
    s = F.regexp_replace(_c(col), HTML_TAG_PATTERN, "")
    s = _only_if(s.contains("://") | s.contains("www."), s, F.regexp_replace(s, _U + URL_PATTERN, ""))
    s = F.lower(s)
    s = F.regexp_replace(s, _U + r"\s+", " ")
    return F.trim(s)  # only single U+0020 runs can remain at the ends


def batch_mask(col) -> Column:
    """Email -> card -> SSN (no phone step in the batch job)."""
    return mask_ssn(mask_credit_cards(mask_emails(col)))


def pii_flags(col) -> dict[str, Column]:
    """Flags computed on the raw text (NULL treated as '')."""
    raw = F.coalesce(_c(col), F.lit(""))
    return {
        "had_email": raw.contains("@") & raw.rlike(_U + EMAIL_PATTERN),
        "had_credit_card": raw.rlike(_U + CREDIT_CARD_PATTERN),
        "had_ssn": raw.contains("-") & raw.rlike(_U + SSN_PATTERN),
    }


def code_points(col) -> Column:
    """Length in code points, NULL counted as 0 (int)."""
    return F.char_length(F.coalesce(_c(col), F.lit(""))).cast("int")
