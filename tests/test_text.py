"""Example values of the reference's cleaner / anonymiser / batch tests, as
Column expressions evaluated by Spark."""

import pytest
from pyspark.sql import functions as F

from storelens.functions import text as T
from storelens.operators import reviews as R


def ev(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("inp,out", [
    ("<b>hello</b>", "hello"), ("before<br/>after", "beforeafter"), ("<b>unclosed", "unclosed"),
])
def test_remove_html_tags(spark, inp, out):
    assert ev(spark, T.remove_html_tags, inp) == out


@pytest.mark.parametrize("inp,out", [
    ("visit http://example.com today", "visit  today"), ("go to www.example.com", "go to "),
    ("http://a.com and https://b.com", " and "), ("HTTP://X.CO x", " x"),
])
def test_remove_urls(spark, inp, out):
    assert ev(spark, T.remove_urls, inp) == out


@pytest.mark.parametrize("inp,out", [("hello\t\nworld", "hello world"), ("   ", ""),
                                     ("a  b", "a b"), ("\x1ca\x1f", "a")])
def test_normalize_whitespace(spark, inp, out):
    assert ev(spark, T.normalize_whitespace, inp) == out


@pytest.mark.parametrize("inp,out", [
    ("hello 😀 world", "hello  world"), ("🎉🎊 party", " party"),
    ("a✅b⭐c\U0001FA70d\U0001F1E6e", "abcde"),
])
def test_remove_emojis(spark, inp, out):
    assert ev(spark, T.remove_emojis, inp) == out


def test_clean_text(spark):
    assert ev(spark, T.clean_text, "<b>Hello</b>  WORLD  http://x.com 😀") == "hello world"


@pytest.mark.parametrize("inp,out", [
    ("Send to user.name+tag@domain.co.uk please", "Send to [EMAIL] please"),
    ("a@b.com and c@d.org", "[EMAIL] and [EMAIL]"),
])
def test_mask_emails(spark, inp, out):
    assert ev(spark, T.mask_emails, inp) == out


@pytest.mark.parametrize("inp", ["+1-123-456-7890", "(123) 456-7890", "123.456.7890"])
def test_mask_phones(spark, inp):
    assert ev(spark, T.mask_phones, inp) == "[PHONE]"


@pytest.mark.parametrize("inp", ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"])
def test_mask_cards(spark, inp):
    assert ev(spark, T.mask_credit_cards, inp) == "[CREDIT_CARD]"


def test_mask_ssn(spark):
    assert ev(spark, T.mask_ssn, "123-45-6789") == "[SSN]"
    assert ev(spark, T.mask_ssn, "é123-45-6789") == "é123-45-6789"  # Unicode \b: é is a word char


def test_anonymize_pii_order(spark):
    s = "mail a@b.com card 4111 1111 1111 1111 ssn 123-45-6789 tel 555-123-4567 date 20250115"
    assert ev(spark, T.anonymize_pii, s) == \
        "mail [EMAIL] card [CREDIT_CARD] ssn [SSN] tel [PHONE] date [PHONE]"


@pytest.mark.parametrize("inp,out", [("John Doe", "J. D."), ("John", "J."), ("jane doe", "J. D."),
                                     ("   ", ""), ("  ana  maría\tlópez ", "A. M. L."), ("ßen", "SS.")])
def test_author_initials(spark, inp, out):
    assert ev(spark, T.author_initials, inp) == out


def test_author_initials_null(spark):
    assert ev(spark, T.author_initials, None) is None


def _batch(spark, rows):
    return spark.createDataFrame(rows, "external_review_id string, title string, content string, author_name string")


def test_process_reviews_basic(spark):
    df = _batch(spark, [("rev-001", "Great App", "This app is wonderful.", "John Doe")])
    r = R.process_reviews(df).first()
    assert r["title_processed"] == "great app"
    assert r["content_processed"] == "this app is wonderful."
    assert r["author_name_processed"] == "J. D."
    m = r["processing_metadata"]
    assert (m["original_length"], m["processed_length"]) == (22, 22)
    assert not (m["had_email"] or m["had_credit_card"] or m["had_ssn"])


def test_process_reviews_semantics(spark):
    df = _batch(spark, [
        ("a", None, None, None),
        ("b", "<b></b>", "email: test@mail.com", "  "),
        ("c", "T", "<a@b.co> HTTP://X.CO Visit http://x.co  card 4111111111111111 ssn 123-45-6789", "x"),
    ])
    rows = {r["external_review_id"]: r for r in R.process_reviews(df).collect()}
    a = rows["a"]
    assert a["title_processed"] is None and a["content_processed"] is None and a["author_name_processed"] is None
    assert a["processing_metadata"]["original_length"] == 0
    b = rows["b"]
    assert b["title_processed"] == ""  # markup only -> empty, not NULL
    assert b["content_processed"] == "email: [EMAIL]"
    assert b["processing_metadata"]["had_email"] and b["author_name_processed"] == ""
    c = rows["c"]
    # flags come from raw text; the tag holding the address is removed before masking;
    # the batch URL rule is case-sensitive and runs before lowering; masks stay upper-case
    assert c["processing_metadata"]["had_email"] and c["processing_metadata"]["had_ssn"]
    assert c["content_processed"] == "http://x.co visit card [CREDIT_CARD] ssn [SSN]"


def test_process_reviews_empty(spark):
    assert R.process_reviews(_batch(spark, [])).count() == 0


def test_process_reviews_plan_is_native(spark):
    df = _batch(spark, [("a", "t", "c", "n")])
    plan = R.process_reviews(df)._jdf.queryExecution().executedPlan().toString()
    # no Python evaluation and no key shuffle (only the core-spreading round robin)
    assert "EvalPython" not in plan and "hashpartitioning" not in plan
