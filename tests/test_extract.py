"""Page extraction on a made-up store page, plus the poisoning / skipping rules."""

import dataclasses
import random
from decimal import Decimal
from html.parser import HTMLParser

import pytest

from storelens.operators import extract as X

# A page of our own around the layout's class names: entities, an ad and an unclosed paragraph between the parts.
PAGE = """<!doctype html><html lang=en><head><title>x</title><script>var h = "<h1 class='product-header__title'>no</h1>";</script></head>
<body><nav><a href="/">Store</a></nav>
<h2 class="large product-header__identity"><a href="/dev/77">Blue <b>Kettle</b> &amp; Sons</a></h2>
<h1 class='wide product-header__title'> Tea Timer <span>&#8211;</span> Pro </h1>
<picture class="product-hero__media small"><source src="/img/tea.webp?a=1&amp;b=2" media="x"></picture>
<p>Unclosed <section class="section--description"><div class="we-truncate wide"><p>Steeps in &lt;3 minutes.</p></div></section>
<em>Price</em><li class="inline-list__item--bulleted">$12.50</li>
<div class="ad">five stars</div>
<article class="we-customer-review lockup" data-review-id="k-9">
 <figure class="we-star-rating" aria-label="5 out of 5"></figure><h3 class="we-customer-review__title">Calm &#x26; quick</h3>
 <time class="we-customer-review__date">Mar 3, 2025</time><span class="we-customer-review__user">Ola B.</span>
 <p class="we-customer-review__body">Never a bitter cup<br>again.</p></article>
<article class="we-customer-review" data-review-id='k-4'>
 <figure class="we-star-rating" aria-label="1 out of 5"></figure><h3 class="we-customer-review__title">Too loud</h3>
 <span class="we-customer-review__user">Ines</span><time class="we-customer-review__date">Dec 24, 2024</time>
 <p class="we-customer-review__body">It woke the cat.</p></article></body></html>"""
NO_FIRST_CHILD = dataclasses.replace(X.APPLE_PROFILE, price=X.Pick("li", "inline-list__item--bulleted"))


def review(rid, rating_label, extra=""):
    return (f'<div class="we-customer-review" data-review-id="{rid}">'
            f'<figure class="we-star-rating" aria-label="{rating_label}"></figure>{extra}</div>')


def run(spark, pages, profile=NO_FIRST_CHILD):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    res = X.scrape_results(X.extract_raw(df, profile), "2025-06-01 12:00:00")
    return {r["page_id"]: r for r in res.collect()}


def test_fixture_page(spark):
    r = run(spark, [(1, "https://apps.apple.com/us/app/id1", PAGE)])[1]
    assert r["success"] and r["error"] is None
    a = r["app"]
    assert (a["name"], a["developer_name"], a["description"], a["icon_url"]) == \
        ("Tea Timer–Pro", "BlueKettle& Sons", "Steeps in <3 minutes.", "/img/tea.webp?a=1&b=2")
    p = r["price"]
    assert (p["price"], p["currency"], p["region"]) == (Decimal("12.50"), "USD", "US")
    assert [(v["external_review_id"], v["rating"], v["title"], v["content"], v["author_name"]) for v in r["reviews"]] == [
        ("k-9", 5, "Calm & quick", "Never a bitter cupagain.", "Ola B."), ("k-4", 1, "Too loud", "It woke the cat.", "Ines")]
    assert [str(v["review_date"])[:10] for v in r["reviews"]] == ["2025-03-03", "2024-12-24"]
    assert (r["has_app"], r["has_price"], r["review_count"]) == (True, True, 2)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string")
    plan = X.scrape_results(X.extract_raw(df), "2025-06-01 12:00:00")._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Python", "MapInArrow", "ArrowEval", "InPandas"))


@pytest.mark.parametrize("profile", [X.APPLE_PROFILE, X.PAGES_PROFILE])
def test_plan_holds_one_decoder(spark, profile):
    df = spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string")
    plan = X.scrape_results(X.extract_raw(df, profile), "2025-06-01 12:00:00")._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    assert len(text) < 80_000 and text.count("CounterClockwiseContourIntegral") <= 1


class Tree(HTMLParser):
    """A plain tree, as a soup of html.parser builds it: a closing tag ends the nearest open element of its name."""

    def __init__(self, html):
        super().__init__()
        self.root = ("", {}, [])
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        e = (tag, dict(attrs), [])
        self.open[-1][2].append(e)
        if tag not in ("br", "img", "source", "input", "meta"):
            self.open.append(e)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)

    def find(self, pick, e=None):
        """The text of the first element that fits, in page order; None without one."""
        def walk(e):
            for c in e[2]:
                if isinstance(c, tuple):
                    yield c
                    yield from walk(c)

        def text(e):
            return "".join(c.strip() if isinstance(c, str) else text(c) for c in e[2])

        roots = [self.root] if pick.within is None else [e for e in walk(self.root) if self.fits(e, pick.within)][:1]
        found = next((e for r in roots for e in walk(r) if self.fits(e, pick)), None)
        return found and (text(found) or None)

    @staticmethod
    def fits(e, pick):
        return pick.tag in (None, e[0]) and (pick.cls is None or pick.cls in (e[1].get("class") or "").split())


PICKS = [X.Pick("div", "a"), X.Pick(cls="b"), X.Pick("p"), X.Pick("p", within=X.Pick("div", "a")), X.Pick("section", within=X.Pick(cls="b")), X.Pick("span", "b")]


def test_nested_elements_as_a_plain_tree_reads_them(spark):
    from pyspark.sql import functions as F
    r = random.Random(5)

    def made(depth, in_p=False):
        out = []
        for _ in range(r.randint(0, 4)):
            kind = r.random()
            if kind < 0.35 or depth > 5:
                out.append(r.choice(["x", " y ", "w<br>z", "é"]))
            else:
                tag = r.choice(["div", "div", "p", "section", "span", "ul"])
                inner = made(depth + 1, in_p or tag == "p")
                open_end = tag == "p" and not in_p and "<p" not in inner and r.random() < 0.3  # some paragraphs are never closed
                out.append(f"<{tag} class='{r.choice(['a', 'b', 'a b', 'c'])}'>{inner}{'' if open_end else f'</{tag}>'}")
        return "".join(out)

    pages = ["<div class='we-truncate'><div>a</div><p>deep text</p></div>", "<div class=a><div>1</div><div class=a>2<div>3</div></div>4</div>5",
             "<div class=a><p>one</div><p>two</p>"] + ["<body>" + made(0) + "</body>" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").repartition(4)

    outer = [p.within for p in PICKS if p.within]
    scopes = X.cut_elements(df, F.array(*[X._rest(F.col("html"), p) for p in outer]), F.array(*[X._name(F.col("html"), p) for p in outer]))
    scopes = scopes.withColumnRenamed("__held", "scopes")
    within = [F.get("scopes", F.lit(outer.index(p.within))) if p.within else F.col("html") for p in PICKS]
    held = X.cut_elements(scopes, F.array(*[X._rest(s, p) for s, p in zip(within, PICKS, strict=True)]), F.array(*[X._name(s, p) for s, p in zip(within, PICKS, strict=True)]))
    texts = F.transform("__held", lambda t: F.nullif(X.N.py_strip(X.stripped(t)), F.lit("")))
    got = {x["i"]: x["t"] for x in held.select("i", texts.alias("t")).collect()}
    for i, page in enumerate(pages):
        tree = Tree(page)
        for k, pick in enumerate(PICKS):
            assert got[i][k] == tree.find(pick), (page, pick)


def test_nested_description(spark):
    html = "<section class='section--description'><div class=\"we-truncate\"><div>a</div><p>deep text</p></div></section><h1 class=product-header__title>N</h1>"
    assert run(spark, [(1, "u", html)])[1]["app"]["description"] == "deep text"


def test_long_pages_and_references(spark):
    filler = "<div class='x'>" + "word &#233; &eacute; " * 60_000 + "</div>"
    html = filler + "<h1 class='product-header__title'>A&nbsp;&quot;B&quot; &#x1F600; &#0; &amp;lt;</h1>" + filler
    df = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    r = {x["page_id"]: x for x in X.extract_raw(df).collect()}
    assert r[1]["name"] == 'A\xa0"B" \U0001F600 \ufffd &lt;' and r[1]["reviews"] == []
    assert r[2]["name"] is None and r[3]["reviews"] == []


def test_every_named_reference_is_decoded(spark):
    from html import unescape
    from html.entities import html5

    from pyspark.sql import functions as F
    texts = ["Caf&eacute; M&uuml;ller &ntilde;", "&notit; &copy2 &amp;lt; &ampx &bogus; & &; &#233;&#xe9; &CounterClockwiseContourIntegral;", "a&eacute b&AMPc", "&fjlig;&NotEqualTilde;"]
    texts += [f"x&{n}y" for n in html5] + ["word &eacute; &zwj; " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4)
    got = {r["id"]: r["d"] for r in df.select("id", X.decode_refs(F.col("t")).alias("d")).collect()}
    assert got == {i: unescape(t) for i, t in enumerate(texts)}
    page = PAGE.replace("Pro </h1>", "Pro &eacute;&uuml;&ntilde;</h1>")
    assert run(spark, [(1, "u", page)])[1]["app"]["name"].endswith(" éüñ")


def test_first_child_selector(spark):
    """With the production selector the price li is not the first child of body."""
    r = run(spark, [(1, "u", PAGE)], X.APPLE_PROFILE)[1]
    assert r["success"] and r["price"] is None


def test_free_and_nameless(spark):
    html = '<body><li class="inline-list__item--bulleted">Free</li>' + review("r1", "5 stars") + "</body>"
    r = run(spark, [(1, "u", html)])[1]
    assert r["success"] and r["app"] is None and r["price"]["price"] == Decimal("0.00") and r["review_count"] == 1


@pytest.mark.parametrize("body,ok,count", [
    (review("r1", "0 stars"), False, 0),          # rating 0 poisons the page
    (review("r1", "9"), False, 0),                # so does 6-9
    (review("   ", "4"), False, 0),               # whitespace id passes the skip, fails validation
    (review("", "4"), True, 0),                   # empty id: skipped
    (review("r1", "no rating"), True, 0),         # no digit: skipped
    (review("r1", "4.5 out of 5"), True, 1),      # first digit
    (review("r1", "4") + review("r1", "3"), True, 2),  # duplicates kept in the page, merged at commit
])
def test_review_rules(spark, body, ok, count):
    r = run(spark, [(1, "u", "<body><h1 class='product-header__title'>A</h1>" + body + "</body>")])[1]
    assert r["success"] == ok and r["review_count"] == count
    if not ok:
        assert r["app"] is None and r["price"] is None and r["error"]


def test_overlong_name_poisons(spark):
    r = run(spark, [(1, "u", f"<h1 class='product-header__title'>{'n' * 256}</h1>")])[1]
    assert not r["success"] and "name exceeds max length of 255" in r["error"]


def test_batch_isolation(spark):
    pages = [(i, f"u{i}", PAGE if i % 2 else "<div><<<>>>&&&") for i in range(20)]
    out = run(spark, pages)
    assert sorted(out) == list(range(20))
    assert all(out[i]["success"] for i in range(1, 20, 2))


def test_script_and_entities(spark):
    html = ("<head><script>var t='</p>';</script></head><body><article><h1>A &amp; B</h1>"
            "<p>one<br>two<p>three</article><footer> dev </footer><nav><a href='/x'>x</a></nav></body>")
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    r = X.extract_raw(df, X.PAGES_PROFILE).first()
    assert (r["name"], r["developer_name"], r["icon_url"]) == ("A & B", "dev", "/x")
    assert r["description"] == "onetwothree"


def test_merge_paginated(spark):
    p1 = "<body>" + review("r1", "4") + review("r2", "3") + "</body>"
    p2 = "<body>" + review("r2", "1") + review("r3", "5") + "</body>"
    df = spark.createDataFrame([(1, "https://s/app/id1?page=1", p1), (2, "https://s/app/id1?page=2", p2)],
                               "page_id long, url string, html string")
    res = X.scrape_results(X.extract_raw(df, NO_FIRST_CHILD), "2025-06-01 12:00:00")
    m = {r["external_review_id"]: r for r in X.merge_paginated(res).collect()}
    assert sorted(m) == ["r1", "r2", "r3"] and m["r2"]["rating"] == 3 and m["r2"]["page_id"] == 1
    assert {r["app_url"] for r in m.values()} == {"https://s/app/id1"}
