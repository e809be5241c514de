"""Randomised agreement between the Catalyst text expressions and a direct
Python ``re`` model of the same fixed patterns (record-level semantics)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from storelens.functions import text as T

EMOJI = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in T.EMOJI_RANGES) + "]+"
ALPHABET = list("abcXYZ019 .-@:/<>()+_\t\n") + ["http://", "https://", "www.", "@x.co", "<b>", "</b>",
                                                 "4111 1111 1111 1111", "123-45-6789", "555.123.4567",
                                                 " ", "é", "😀", "✅", "Ü", "ß"]
texts = st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), min_size=200, max_size=200)


def model_clean(t):
    t = re.sub(T.HTML_TAG_PATTERN, "", t)
    t = re.sub(T.URL_PATTERN, "", t, flags=re.I)
    t = re.sub(EMOJI, "", t)
    return re.sub(r"\s+", " ", t.lower()).strip()


def model_pii(t):
    for p, m in ((T.EMAIL_PATTERN, T.EMAIL_MASK), (T.CREDIT_CARD_PATTERN, T.CREDIT_CARD_MASK),
                 (T.SSN_PATTERN, T.SSN_MASK), (T.PHONE_PATTERN, T.PHONE_MASK)):
        t = re.sub(p, m, t)
    return t


def model_batch(t):
    t = re.sub(T.URL_PATTERN, "", re.sub(T.HTML_TAG_PATTERN, "", t))
    t = re.sub(r"\s+", " ", t.lower()).strip()
    for p, m in ((T.EMAIL_PATTERN, T.EMAIL_MASK), (T.CREDIT_CARD_PATTERN, T.CREDIT_CARD_MASK),
                 (T.SSN_PATTERN, T.SSN_MASK)):
        t = re.sub(p, m, t)
    return t


def model_initials(n):
    s = n.strip()
    return "" if not s else " ".join(f"{p[0].upper()}." for p in s.split())


@settings(max_examples=4, deadline=None)
@given(texts)
def test_text_expressions_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    out = df.select("i", "x", T.clean_text("x").alias("c"), T.anonymize_pii("x").alias("p"),
                    T.batch_mask(T.batch_clean("x")).alias("b"), T.author_initials("x").alias("a"),
                    *[c.alias(n) for n, c in T.pii_flags("x").items()]).collect()
    for r in out:
        x = r["x"]
        assert r["c"] == model_clean(x), x
        assert r["p"] == model_pii(x), x
        assert r["b"] == model_batch(x), x
        assert r["a"] == model_initials(x), x
        assert r["had_email"] == bool(re.search(T.EMAIL_PATTERN, x))
        assert r["had_credit_card"] == bool(re.search(T.CREDIT_CARD_PATTERN, x))
        assert r["had_ssn"] == bool(re.search(T.SSN_PATTERN, x))
