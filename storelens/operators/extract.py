"""Store pages -> app / price / review records (X1-X9, A1, V4), in Catalyst only.

A store layout is a profile of picks: tag, class, attribute and the element it
lies in.  A pick compiles to a pattern for its opening tag; review containers
cut the page into one segment each.  Price text, rating digit, dates, field
rules and page poisoning (any invalid record fails the whole page) follow in
further projections, so the job has no shuffle and no Python.

Balanced elements: what follows an opening tag is split at the tags of the same
name and of containers, and a running depth over the parts finds where the
element ends: at its own closing tag, nested elements of the same name read
whole, or, if it is never closed, with the container around it or the page.  (An
unclosed element inside one of its own name counts as open up to there.)
``within`` looks into the first matching outer element; a review's fields are
looked for up to its end or the next container.

Each piece of text is cut out once as it stands; all those of a page are then
decoded together, so the plan holds one decoder, whatever the number of fields.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions import normalize as N


@dataclass(frozen=True)
class Pick:
    """An element: by tag (None: any), a class it carries, an attribute it has, and where it lies."""
    tag: str | None = None
    cls: str | None = None
    attr: str | None = None
    within: Pick | None = None
    first_child: bool = False

    def opening(self) -> str:
        """Pattern of its opening tag; group 1 is the tag's name."""
        out = rf"<({self.tag or '[a-z][a-z0-9]*'})(?=[\s>/])"
        if self.cls:
            c = re.escape(self.cls)
            out += rf"(?=[^>]*\sclass\s*=\s*(?:\"(?:[^\"]*\s)?{c}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{c}(?:\s[^']*)?'|{c}[\s>]))"
        if self.attr:
            out += rf"(?=[^>]*\s{re.escape(self.attr)}(?=[\s=>/]))"
        # a first child follows its parent's opening tag, with nothing but text between
        before = r"<(?!(?:img|br|input|meta|link|hr|source)\b)[a-z][^>]*>[^<]*" if self.first_child else ""
        return before + out + r"[^>]*>"


@dataclass(frozen=True)
class PageProfile:
    """Picks for one store layout."""
    name: Pick
    developer: Pick
    description: Pick
    icon: Pick
    icon_attr: str
    price: Pick
    review: Pick
    review_id_attr: str
    rating: Pick
    title: Pick
    content: Pick
    author: Pick
    date: Pick


# The App Store page layout.
APPLE_PROFILE = PageProfile(
    name=Pick("h1", "product-header__title"),
    developer=Pick("a", within=Pick("h2", "product-header__identity")),
    description=Pick("p", within=Pick(cls="we-truncate", within=Pick("section", "section--description"))),
    icon=Pick("source", within=Pick("picture", "product-hero__media")),
    icon_attr="src",
    price=Pick("li", "inline-list__item--bulleted", first_child=True),
    review=Pick(cls="we-customer-review"),
    review_id_attr="data-review-id",
    rating=Pick("figure", "we-star-rating"),
    title=Pick("h3", "we-customer-review__title"),
    content=Pick("p", "we-customer-review__body"),
    author=Pick("span", "we-customer-review__user"),
    date=Pick("time", "we-customer-review__date"),
)

# Layout of the captured generic pages in the test tables (ours).
PAGES_PROFILE = PageProfile(
    name=Pick("h1", within=Pick("article")), developer=Pick("footer"), description=Pick("p", within=Pick("article")),
    icon=Pick("a", within=Pick("nav")), icon_attr="href",
    price=Pick("li", within=Pick("nav"), first_child=True), review=Pick(attr="data-review-id"), review_id_attr="data-review-id",
    rating=Pick(attr="aria-label"), title=Pick("h3"), content=Pick("p"), author=Pick("span"), date=Pick("time"),
)

# --- reading elements ---------------------------------------------------------------------

# All named character references, with their ';' and, where HTML allows it, without.
_CONTAINERS = "a|article|aside|blockquote|body|button|div|figure|footer|form|header|html|label|main|nav|ol|section|span|table|ul"
_COMMON = ("amp;", "nbsp;", "quot;", "lt;", "gt;", "apos;", "copy;", "middot;", "eacute;", "rsquo;")  # looked up first
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _refs(names) -> Column:
    """A literal map of references to their characters."""
    return F.str_to_map(F.lit("\x01".join(f"{n}\x02{html5[n]}" for n in names)), F.lit("\x01"), F.lit("\x02"))


def decode_refs(x: Column) -> Column:
    """Character references of text: named ones and numbers, each read once, so that a decoded '&' starts none."""
    common, every, short = _refs(_COMMON), _refs(n for n in html5 if n not in _COMMON), _refs(_BARE)

    def part(p, i):
        number = F.regexp_extract(p, r"^#(x[0-9A-Fa-f]{1,6}|X[0-9A-Fa-f]{1,6}|[0-9]{1,7});?", 1)
        code = F.when(F.lower(number).startswith("x"), F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(number).cast("int")
        good = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        sign = F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        name = F.regexp_extract(p, r"^[A-Za-z][A-Za-z0-9]*;?", 0)
        bare = F.regexp_extract(p, f"^(?:{'|'.join(_BARE)})", 0)  # the longest that needs no ';'
        named = F.coalesce(F.try_element_at(common, name), F.try_element_at(every, name))
        return (F.when(i == 0, p)
                .when(number != "", F.concat(sign, F.regexp_replace(p, r"^#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});?", "")))
                .otherwise(F.coalesce(F.concat(named, F.substr(p, F.length(name) + 1)),
                                      F.concat(F.try_element_at(short, bare), F.substr(p, F.length(bare) + 1)),
                                      F.concat(F.lit("&"), p))))

    whole = F.array_join(F.transform(F.split(x, "&"), part), "")
    return F.when(F.contains(x, F.lit("&")), whole).otherwise(x)


def settled(value: Column) -> Column:
    """``value``, as a column that stays in its own projection.

    Catalyst folds projections into each other and pushes filters through them by putting
    expressions into expressions; lambdas nested that way double their canonical forms
    with each level.  A row number, though it is never negative, stops both.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _rest(scope: Column, pick: Pick) -> Column:
    """What follows the element's opening tag ('' if it isn't there)."""
    return F.regexp_extract(scope, rf"(?is){pick.opening()}(.*)", 2)


def _name(scope: Column, pick: Pick) -> Column:
    return F.lit(pick.tag) if pick.tag else F.regexp_extract(scope, f"(?is){pick.opening()}", 1)


# One SQL text each: as calls on columns they would cost some thousand round trips to the JVM.
_PARTS = rf"zip_with(__rests, __names, (rest, name) -> split(concat('\n', rest), concat(r'(?i)(?=</?(?:', name, r'|{_CONTAINERS})[\s>/])')))"
# A part begins with a tag, but for the first one.  Depth: of the element's own name; outer: of other containers.
_CHANGE = "if(at.i = 0, 0, if(startswith(part, '</'), -1, 1))"
_MINE = r"lower(regexp_extract(part, r'^</?([A-Za-z][A-Za-z0-9]*)', 1)) = lower(name)"
_ENDED = "(at.depth <= 0 or at.outer < 0)"
_ENDS = f"""zip_with(__parts, __names, (parts, name) -> aggregate(parts, named_struct('depth', 1, 'outer', 0, 'i', 0, 'ends', -1),
    (at, part) -> named_struct('depth', at.depth + if({_MINE}, {_CHANGE}, 0), 'outer', at.outer + if({_MINE}, 0, {_CHANGE}),
                               'i', at.i + 1, 'ends', if(at.ends < 0 and {_ENDED}, at.i - 1, at.ends)),
    at -> if(at.ends >= 0, at.ends, if({_ENDED}, at.i - 1, at.i))))"""
_HELD = "zip_with(__parts, __ends, (parts, n) -> array_join(slice(parts, 1, n), ''))"


def cut_elements(at: DataFrame, rests: Column, names: Column) -> DataFrame:
    """``__held``: what elements of these names hold, of what follows their opening tags (both arrays)."""
    at = at.withColumns({"__rests": settled(rests), "__names": settled(names)})
    for name, sql in (("__parts", _PARTS), ("__ends", _ENDS), ("__held", _HELD)):
        at = at.withColumn(name, settled(F.expr(sql)))
    return at.drop("__rests", "__names", "__parts", "__ends")


def stripped(x: Column) -> Column:
    """X1, before references are decoded: an element's strings, stripped and joined."""
    return F.regexp_replace(x, r"(?U)\s*<[^>]*>\s*", "")


def tag_of(scope: Column, pick: Pick) -> Column:
    """The element's opening tag ('' if it isn't there)."""
    opening = F.regexp_extract(scope, rf"(?is){pick.opening()}", 0)
    return F.regexp_extract(opening, r"(?s)<[^<]*\z", 0) if pick.first_child else opening


def attr_of(tag: Column, name: str) -> Column:
    """X2, before references are decoded: an attribute of an opening tag ('' if it isn't there)."""
    pattern = rf"(?is)\s{re.escape(name)}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
    return F.regexp_replace(F.regexp_extract(tag, pattern, 1), "^[\"']|[\"']$", "")


def _depth(pick: Pick) -> int:
    return 0 if pick.within is None else 1 + _depth(pick.within)


def _columns(profile: PageProfile) -> tuple[list[Pick], list[Pick]]:
    return ([profile.name, profile.developer, profile.description, profile.price],
            [profile.rating, profile.title, profile.content, profile.author, profile.date])


def extract_raw(pages: DataFrame, profile: PageProfile = APPLE_PROFILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """pages(page_id, url, html, *keep) -> raw fields and reviews, one row per
    page (X1 text, X2 attributes, X3 app fields, X4 price text, X5 review containers
    in document order).  ``keep`` columns pass through."""
    unseen = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template)\b.*?(?:</\1\s*>|\z)"
    base = ["page_id", "url", *keep]
    at = pages.select(*base, F.regexp_replace(F.coalesce("html", F.lit("")), unseen, "").alias("__html"))
    texts, parts = _columns(profile)

    # fields of the page, and what they lie in, the outermost first
    column: dict[Pick | None, str] = {None: "__html"}
    wanted = {p: None for p in texts}
    for p in [*texts, profile.icon]:
        while p.within is not None:
            wanted[p := p.within] = None
    for depth in range(max(map(_depth, wanted)) + 1):
        level = [p for p in wanted if _depth(p) == depth]
        at = cut_elements(at, F.array(*[_rest(F.col(column[p.within]), p) for p in level]), F.array(*[_name(F.col(column[p.within]), p) for p in level]))
        column |= {p: f"__e{depth}_{i}" for i, p in enumerate(level)}
        at = at.withColumns({column[p]: F.get("__held", F.lit(i)) for i, p in enumerate(level)})
    app = [F.col(column[p]) for p in texts]
    icon = attr_of(tag_of(F.col(column[profile.icon.within]), profile.icon), profile.icon_attr)

    # every container begins a segment; the line before makes sure that the first segment is none
    segments = F.split(F.concat(F.lit("\n"), F.col("__html")), rf"(?is)(?={profile.review.opening()})")
    at = at.select(*base, F.transform(F.array(*app), stripped).alias("__app"), F.array(icon).alias("__icon"), settled(segments).alias("__all"))
    at = at.withColumn("__segments", settled(F.slice("__all", F.lit(2), F.greatest(F.size("__all") - 1, F.lit(0))))).drop("__all")
    ids = F.transform("__segments", lambda s: attr_of(F.regexp_extract(s, r"(?s)\A<[^>]*>", 0), profile.review_id_attr))
    at = cut_elements(at.withColumn("__ids", ids), F.transform("__segments", lambda s: _rest(s, profile.review)),
                      F.transform("__segments", lambda s: _name(s, profile.review))).withColumnRenamed("__held", "__reviews")
    labels = F.transform("__reviews", lambda h: attr_of(tag_of(h, profile.rating), "aria-label"))
    at = cut_elements(at.withColumn("__labels", labels), F.flatten(F.transform("__reviews", lambda h: F.array(*[_rest(h, p) for p in parts]))),
                      F.flatten(F.transform("__reviews", lambda h: F.array(*[_name(h, p) for p in parts]))))

    # all strings of a page, decoded together
    strings = F.concat("__app", "__icon", "__ids", "__labels", F.transform("__held", stripped))
    at = at.select(*base, settled(strings).alias("__strings"), F.size("__ids").alias("__n"))
    at = at.select(*base, "__n", settled(F.transform("__strings", decode_refs)).alias("__strings"))

    def string(i) -> Column:
        return F.get("__strings", F.lit(i) if isinstance(i, int) else i)

    def text(i) -> Column:
        return F.nullif(N.py_strip(string(i)), F.lit(""))

    def record(k):
        first = len(texts) + 1
        named = zip(("rating_text", "title", "content", "author_name", "date_text"), range(len(parts)), strict=True)
        fields = [text(first + 2 * F.col("__n") + len(parts) * k + i).alias(c) for c, i in named]
        return F.struct(k.cast("int").alias("pos"), F.nullif(string(first + k), F.lit("")).alias("review_id"),
                        F.nullif(string(first + F.col("__n") + k), F.lit("")).alias("rating_label"), *fields)

    numbers = F.when(F.col("__n") > 0, F.sequence(F.lit(0), F.col("__n") - 1)).otherwise(F.array().cast("array<int>"))
    return at.select(
        F.col("page_id").cast("long").alias("page_id"), "url", text(0).alias("name"), text(1).alias("developer_name"), text(2).alias("description"),
        F.nullif(string(4), F.lit("")).alias("icon_url"), text(3).alias("raw_price"), F.transform(numbers, record).alias("reviews"),
        F.lit(None).cast("string").alias("parse_error"), *keep)


# --- records ---------------------------------------------------------------------------------------
def scrape_results(raw: DataFrame, captured_at, currency: str = "USD", region: str = "US",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """X3-X8 + V1-V4 + A1 on raw extraction output, all in one projection.

    * P5: reviews without id, or without a parsable rating, are skipped;
    * X4: price text -> decimal (N6), USD/US, capture time as ts;
    * X7: every other invalid record (app, price, review, url) poisons the page:
      success = false, error = the violations, no app/price/reviews;
    * a page without a name is successful with app = NULL;
    * ``captured_at`` is the capture time as a timestamp, also of pages without a price.
    """
    keep = tuple(k for k in keep if k != "captured_at")
    ts = F.lit(captured_at).cast("timestamp_ntz")

    def typed(r):
        return F.struct(r["pos"].alias("pos"), N.py_strip(r["review_id"]).alias("external_review_id"),
                        N.parse_rating(r["rating_label"], r["rating_text"]).alias("rating"), N.strip_or_null(r["title"]).alias("title"), r["content"].alias("content"),
                        N.strip_or_null(r["author_name"]).alias("author_name"), N.parse_date(r["date_text"]).alias("review_date"))

    def broken(r):
        rid = r["external_review_id"]
        return N.violations(
            F.coalesce(N.required_rule(rid, "external_review_id"), N.max_length_rule(rid, N.MAX_REVIEW_ID, "external_review_id")),
            N.rating_rule(r["rating"]), N.max_length_rule(r["title"], N.MAX_TITLE, "title"),
            N.max_length_rule(r["author_name"], N.MAX_AUTHOR, "author_name"))

    with_id = F.filter("reviews", lambda r: r["review_id"].isNotNull() & (r["review_id"] != ""))
    name, dev, icon = N.py_strip("name"), N.strip_or_null("developer_name"), N.strip_or_null("icon_url")
    bundle = F.col("bundle_id") if "bundle_id" in raw.columns else F.lit(None).cast("string")
    staged = raw.select(
        *keep, "page_id", N.py_strip("url").alias("url"), "parse_error", N.parse_price("raw_price").alias("exact"),
        F.when(F.col("name").isNotNull(), F.struct(name.alias("name"), bundle.alias("bundle_id"), dev.alias("developer_name"), F.col("description"),
                                                   icon.alias("icon_url"))).alias("app"),
        F.transform(with_id, typed).alias("reviews"), ts.alias("ts"))
    staged = staged.withColumn("reviews", settled(F.filter("reviews", lambda r: r["rating"].isNotNull())))
    none = F.array().cast("array<string>")
    app_v = F.when(F.col("app").isNotNull(), N.violations(
        N.max_length_rule(F.col("app.name"), N.MAX_NAME, "name"),
        N.max_length_rule(F.col("app.developer_name"), N.MAX_DEVELOPER, "developer_name"),
        N.max_length_rule(F.col("app.icon_url"), N.MAX_ICON_URL, "icon_url"))).otherwise(none)
    price_v = F.when(F.col("exact").isNotNull(), N.violations(N.price_rule(F.col("exact")))).otherwise(none)
    url_v = N.violations(N.required_rule(F.col("url"), "url"))
    staged = staged.withColumn("violations", settled(F.concat(url_v, app_v, price_v, F.flatten(F.transform("reviews", broken)))))
    staged = staged.withColumn("success", F.col("parse_error").isNull() & (F.size("violations") == 0))
    ok = F.col("success")
    price = F.col("exact").cast("decimal(10,2)")
    out = staged.select(
        *keep, "page_id", "url", F.col("ts").alias("captured_at"), "success",
        F.when(F.col("parse_error").isNotNull(), F.col("parse_error")).when(~ok, F.array_join("violations", "; ")).alias("error"),
        F.when(ok, F.col("app")).alias("app"), F.when(ok, F.col("reviews")).otherwise(F.slice("reviews", F.lit(1), F.lit(0))).alias("reviews"),
        F.when(ok & F.col("exact").isNotNull(), F.struct(price.alias("price"), F.lit(currency).alias("currency"), F.lit(region).alias("region"), "ts")).alias("price"))
    return out.withColumns({"has_app": F.col("app").isNotNull(), "has_price": F.col("price").isNotNull(), "review_count": F.size("reviews")})


def page_reviews(results: DataFrame) -> DataFrame:
    """One row per review of a successful page, in document order."""
    return (results.where("success")
                   .select("page_id", "url", F.explode("reviews").alias("r"))
                   .select("page_id", "url", "r.*"))


def app_key(url_col) -> F.Column:
    """Paginated captures of one app share the URL without query / fragment."""
    return F.regexp_replace(url_col, r"[?#].*$", "")


def merge_paginated(results: DataFrame) -> DataFrame:
    """Reviews of all captured pages of an app, each review id once (the
    first page that shows it wins).  One aggregation on (app, review id)."""
    r = page_reviews(results).withColumn("app_url", app_key(F.col("url")))
    return (r.groupBy("app_url", "external_review_id")
             .agg(F.min_by(F.struct("page_id", "pos", "rating", "title", "content", "author_name",
                                    "review_date"), F.struct("page_id", "pos")).alias("r"))
             .select("app_url", "external_review_id", "r.*"))
