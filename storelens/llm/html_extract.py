"""HTML extraction (operator 5): a linear-chain conditional random field over the leaf blocks of a page.

A block is the text between two boundaries of block elements, with its open
ancestors.  Each block is content or not; features are its ancestors' tags and
class or id words, what its text looks like, and its neighbours' look.  The
weights maximise the likelihood of labelled pages, which are generated here in
many layouts (sound and broken); Viterbi decoding keeps the likeliest labelling.

Character references are decoded, white space inside a block (``<br>`` too)
becomes one space, blocks are trimmed and joined in page order by a newline.

Defined cases: null and empty pages, and pages without any content block, give
an empty text; broken markup is read as it comes, unclosed and deeply nested elements in time and
memory in proportion to the page; an unclosed comment or tag hides the rest; repeated rows give equal
results; pages are read whole; an empty table gives an empty table; extra columns are not carried.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import by_bytes

PAGES, EPOCHS, SEED = 500, 8, 5  # of training

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section "
    "select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style template title svg math object".split())
# An opening tag ends these open elements, up to a container.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
           "option": {"option"}, "body": {"head"}}
for _t in BLOCK_TAGS - set(_CLOSES) - {"button", "option", "head", "html", "body"}:
    _CLOSES[_t] = {"p"}
_STOPS = frozenset("ul ol dl table div section article aside body td th form main header footer nav blockquote figure".split())

# Words of class, id and role attributes, by what they usually mark.
_GROUPS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs topbar links",
    "head": "header masthead brand logo head",
    "foot": "footer foot bottom copyright legal colophon contentinfo",
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular more complementary",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense outbrain taboola",
    "notice": "notice notification cookie cookies consent gdpr alert popup modal overlay toast newsletter subscribe signup paywall message",
    "form": "form search login signin register input",
    "comment": "comment comments reply replies disqus discussion respond thread reviews feedback",
    "share": "share sharing social follow tweet",
    "content": "content article post entry main story body text article-body prose",
}
_GROUP_OF = {w: g for g, ws in _GROUPS.items() for w in ws.split()}
_ATTR_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CUES = {
    "copyright": re.compile(r"©|\(c\)|copyright|all rights reserved", re.I), "consent": re.compile(r"cookie|consent|privacy|gdpr|accept all", re.I),
    "advert": re.compile(r"advertis|sponsored|promoted|buy now|special offer", re.I), "subscribe": re.compile(r"subscribe|newsletter|sign up|sign in|log in|register", re.I),
    "reply": re.compile(r"\breply\b|comments?\b|posted by|\bsays:|\bago\b|permalink", re.I), "more": re.compile(r"read more|related|share|follow us|skip to|menu|search", re.I),
}


_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math object q s samp small span strike strong sub sup svg template time tt u var".split())
_KNOWN = (BLOCK_TAGS | HIDDEN_TAGS | _INLINE | {"script", "style"}) - {"html", "body"}  # tags that make a feature
_TAG_GROUP = {"aside": "side", "footer": "foot", "header": "head", "article": "content", "main": "content", "nav": "nav", "form": "form"}


class Element:
    """An open element, with what its ancestors and it add to the features of a block inside.

    Folded once, when it opens, from its parent: a page's depth doesn't count again for each block.
    """
    __slots__ = ("tag", "parent", "leaf", "inside", "marks", "nearest", "bad", "content", "heading")

    def __init__(self, tag: str, words: list[str], parent: Element | None):
        self.tag, self.parent = tag, parent
        inside, marks = (parent.inside, parent.marks) if parent else ((), ())
        self.leaf = tag if tag in BLOCK_TAGS and tag in _KNOWN else parent.leaf if parent else "none"
        self.nearest, self.bad, self.content = (parent.nearest, parent.bad, parent.content) if parent else ("none", False, False)
        self.heading = tag == "h1" or (parent is not None and parent.heading)
        self.inside = tuple(sorted({*inside, "in=" + tag})) if tag in _KNOWN and "in=" + tag not in inside else inside
        groups = [_GROUP_OF[w] for w in words if w in _GROUP_OF]
        if tag in _TAG_GROUP:
            groups.append(_TAG_GROUP[tag])
        for g in groups:
            if "mark=" + g not in marks:
                marks = tuple(sorted({*marks, "mark=" + g}))
            self.nearest, self.bad, self.content = g, self.bad or g != "content", self.content or g == "content"
        self.marks = marks

    def path(self) -> list[str]:
        """Tags from the outermost one to this one."""
        out, e = [], self
        while e is not None:
            out.append(e.tag)
            e = e.parent
        return out[::-1]


@dataclass(slots=True)
class Block:
    text: str
    within: Element | None  # the innermost open element
    linked: int = 0  # characters inside links


class _Leaves(HTMLParser):
    """Leaf blocks of a page, in page order.

    ``at`` holds the places of each open tag in the stack, so that neither an opening nor a
    closing tag walks the open elements: the work is linear in the page, however deep.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.hidden = self.links = 0
        self.within: Element | None = None
        self.no_sections = False  # no marked section is closed from here on

    # What never ends hides the rest of the page, as the HTML standard has it, and is so looked for once.

    def parse_comment(self, i, report=1):
        k = super().parse_comment(i, report)
        return k if k >= 0 else len(self.rawdata)

    def parse_starttag(self, i):
        k = super().parse_starttag(i)
        return k if k >= 0 else len(self.rawdata)

    def parse_endtag(self, i):
        k = super().parse_endtag(i)
        return k if k >= 0 else len(self.rawdata)

    def parse_pi(self, i):
        k = super().parse_pi(i)
        return k if k >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i):
        section = self.rawdata.startswith("<![", i)
        k = -1
        if not (section and self.no_sections):
            try:
                k = super().parse_html_declaration(i)
            except AssertionError:  # a section of no known kind
                pass
            self.no_sections |= section and k < 0
        if k < 0:  # up to the next ">", as a comment
            k = self.rawdata.find(">", i + 2) + 1
        return k or len(self.rawdata)

    def cut(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.within, self.linked))
            self.parts, self.linked = [], 0

    def _pop(self, n: int) -> None:
        for e in reversed(self.stack[n:]):
            self.at[e.tag].pop()
            self.hidden -= e.tag in HIDDEN_TAGS
            self.links -= e.tag == "a"
        del self.stack[n:]

    def _last(self, tags) -> int:
        """The highest place of any of ``tags``; -1 without one."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def handle_starttag(self, tag, attrs) -> None:
        if tag in BLOCK_TAGS:
            self.cut()
            closes = _CLOSES.get(tag, ())
            if closes:  # all of these above the innermost container end, with what is in them
                stop = self._last(_STOPS.difference(closes))
                first = min((v[k] for t in closes if (v := self.at.get(t)) and (k := bisect.bisect_right(v, stop)) < len(v)), default=-1)
                if first >= 0:
                    self._pop(first)
        elif tag == "br" and self.parts:
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        words = [w.lower() for a, v in attrs if a in ("class", "id", "role") and v for w in _ATTR_WORD.findall(v)]
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Element(tag, words, self.stack[-1] if self.stack else None))
        self.hidden += tag in HIDDEN_TAGS
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and tag not in BLOCK_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        if tag in BLOCK_TAGS:
            self.cut()
        if not self.at.get(tag):
            return
        k = self.at[tag][-1]
        if tag in _STOPS or tag in BLOCK_TAGS or self._last(_STOPS) < k:  # an inline end tag doesn't close a container
            self._pop(k)

    def handle_data(self, data) -> None:
        if self.hidden > 0 or not data:
            return
        if not self.parts:
            if not data.strip():
                return
            self.within = self.stack[-1] if self.stack else None
        self.parts.append(data)
        if self.links > 0:
            self.linked += len(data.strip())


def leaves(html: str) -> list[Block]:
    p = _Leaves()
    p.feed(html)
    p.close()
    p.cut()
    return p.blocks


def _bucket(n: int) -> int:
    return 0 if n <= 1 else 1 if n <= 3 else 2 if n <= 6 else 3 if n <= 12 else 4 if n <= 25 else 5 if n <= 60 else 6


def features(blocks: list[Block]) -> Iterator[list[str]]:
    """Features of each block, one block at a time; all of them are about the page, none about its address."""
    look = []
    for b in blocks:
        n = b.text.count(" ") + 1
        share = b.linked / max(1, len(b.text))
        look.append((_bucket(n), "all" if share > 0.8 else "some" if share > 0.2 else "no", "end" if b.text[-1] in ".!?…\"'”»:" else "open"))
    total, seen_h1, outside = len(blocks), False, Element("", [], None)
    for i, b in enumerate(blocks):
        e = b.within or outside
        words, link, end = look[i]
        marked = "bad" if e.bad else "content" if e.content else "plain"
        f = ["bias", "leaf=" + e.leaf, *e.inside, *e.marks, "nearest=" + e.nearest, "marked=" + marked,
             f"words={words}", "link=" + link, "end=" + end, f"words+link={words}{link}", f"marked+words={marked}{words}"]
        if words < 6:
            f += ["cue=" + k for k, r in _CUES.items() if r.search(b.text)]
        for name, j in (("before", i - 1), ("after", i + 1)):
            f.append(f"{name}={look[j][0]}{look[j][1]}" if 0 <= j < total else f"{name}=none")
        seen_h1 |= e.heading
        f.append("h1seen" if seen_h1 else "noh1")
        f.append("place=" + str(min(4, 5 * i // total)))
        yield f


# ---- the field: labels 0 (not content) and 1, one weight a feature for label 1, and transitions ------------

_TURN = tuple(f"turn{a}{b}" for a in (0, 1) for b in (0, 1))


def _scores(feats: Iterable[list[str]], w: dict[str, float]) -> list[float]:
    return [sum(w.get(x, 0.0) for x in f) for f in feats]


def viterbi(feats: Iterable[list[str]], w: dict[str, float]) -> list[int]:
    s, t = _scores(feats, w), [w.get(x, 0.0) for x in _TURN]
    if not s:
        return []
    a, b, back = 0.0, s[0], []
    for x in s[1:]:
        from0, from1 = (0 if a + t[0] >= b + t[2] else 1), (0 if a + t[1] >= b + t[3] else 1)
        a, b = max(a + t[0], b + t[2]), max(a + t[1], b + t[3]) + x
        back.append((from0, from1))
    y = [int(b > a)]
    for k in reversed(back):
        y.append(k[y[-1]])
    return y[::-1]


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _marginals(s: list[float], t: list[float]) -> tuple[list[float], list[float]]:
    """Probability of label 1 at each block, and expected counts of the four turns."""
    n = len(s)
    f = [(0.0, s[0])]
    for x in s[1:]:
        a, b = f[-1]
        f.append((_add(a + t[0], b + t[2]), _add(a + t[1], b + t[3]) + x))
    g = [(0.0, 0.0)]
    for x in reversed(s[1:]):
        a, b = g[-1]
        g.append((_add(t[0] + a, t[1] + x + b), _add(t[2] + a, t[3] + x + b)))
    g.reverse()
    z = _add(*f[-1])
    p = [math.exp(min(0.0, f[i][1] + g[i][1] - z)) for i in range(n)]
    turns = [0.0] * 4
    for i in range(n - 1):
        for k in range(4):
            u, v = k >> 1, k & 1
            turns[k] += math.exp(min(0.0, f[i][u] + t[k] + (s[i + 1] if v else 0.0) + g[i + 1][v] - z))
    return p, turns


def generate(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """Labelled pages: HTML with the marks ``\\x01`` around content texts, taken out again, and the label of each block."""
    r = np.random.default_rng(seed)

    def pick(xs):
        return xs[int(r.integers(len(xs)))]

    def chance(p: float) -> bool:
        return bool(r.random() < p)

    syllables = "the an er on in re at is ou ti ed st ch ie la de qu os un ü é ci ing tion of to and was for".split()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(pick(syllables) for _ in range(int(r.integers(1, 4)))) for _ in range(int(r.integers(lo, hi))))

    def sentence(lo: int = 4, hi: int = 16) -> str:
        s = words(lo, hi)
        return s[0].upper() + s[1:] + pick([".", ".", ".", "!", "?"])

    def prose(lo: int = 1, hi: int = 6) -> str:
        out = " ".join(sentence() for _ in range(int(r.integers(lo, hi))))
        for tag in ("b", "em", "a href=/x", "span", "code"):
            if chance(0.12):
                parts = out.split(" ")
                k = int(r.integers(len(parts)))
                parts[k] = f"<{tag}>{parts[k]}</{tag.split()[0]}>"
                out = " ".join(parts)
        return out.replace(" & ", " &amp; ") + ("&nbsp;&mdash; " + words(1, 3) if chance(0.1) else "")

    def good(s: str) -> str:
        return "\x01" + s  # the text node that begins so is content

    def wrap(tag: str, mark: str, inner: str) -> str:
        style = r.random()
        attr = "" if not mark else f' class="{mark}"' if style < 0.5 else f" id={mark}" if style < 0.7 else f" class='{pick(['x', 'col', 'box', 'l-wrap'])} {mark}-{pick(['box', 'wrap', 'inner', '1'])}'"
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(k: int) -> str:
        items = [f'<a href="/{words(1, 2)}">{words(1, 4)}</a>' for _ in range(k)]
        kind = r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}" + ("</li>" if chance(0.8) else "") for x in items) + "</ul>"
        return pick([" | ", " &middot; ", " "]).join(items) if kind < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def boilerplate(kind: str) -> str:
        semantic = chance(0.5)
        if kind == "nav":
            return wrap("nav" if semantic else "div", "" if semantic and chance(0.5) else pick(["nav", "menu", "navbar", "breadcrumbs"]), links(int(r.integers(2, 9))))
        if kind == "head":
            inner = pick([f"<h1>{words(1, 4)}</h1>", f"<div>{words(1, 4)}</div>", f"<p>{sentence(2, 8)}</p>", words(1, 5)]) + (links(3) if chance(0.4) else "")
            return wrap("header" if semantic else "div", "" if semantic else pick(["header", "masthead", "site-header"]), inner)
        if kind == "foot":
            inner = pick([f"&copy; {words(1, 3)} &middot; {sentence()}", f"<p>&copy; 20{r.integers(10, 30)} {words(1, 4)}. All rights reserved.</p>", links(3), f"<p>{sentence()}</p><p>{words(2, 6)}</p>"])
            return wrap("footer" if semantic else "div", "" if semantic and chance(0.6) else pick(["footer", "bottom", "copyright"]), inner)
        if kind == "side":
            inner = "".join(pick([f"<h3>{words(1, 4)}</h3>{links(4)}", f"<p>{prose(1, 3)}</p>", f"<div>{sentence()}</div>"]) for _ in range(int(r.integers(1, 4))))
            return wrap("aside" if semantic else "div", "" if semantic and chance(0.6) else pick(["sidebar", "related", "widget", "aside"]), inner)
        if kind == "ad":
            return wrap(pick(["div", "div", "section", "p"]), pick(["ad", "ads", "advert", "sponsored", "promo", "ad-slot"]), pick([sentence(), prose(1, 3), f"Advertisement {words(1, 5)}"]))
        if kind == "notice":
            inner = pick([f"<p>{pick(['This site uses cookies. ', 'We value your privacy. ', ''])}{sentence()}</p>", f"{sentence()} <button>{pick(['Accept all', 'OK', words(1, 3)])}</button>", f"<p>{prose(1, 3)}</p>"])
            return wrap(pick(["div", "section", "aside"]), pick(["cookie", "notice", "consent", "alert", "newsletter", "popup", "cookie-notice"]), inner)
        if kind == "form":
            return f"<form{pick(['', ' class=search', ' id=login'])}><label>{words(1, 3)}</label><input name=q><select><option>{words(1, 2)}<option>{words(1, 2)}</select>{pick(['', f'<p>{sentence()}</p>'])}<textarea>{words(1, 5)}</textarea><button>{words(1, 2)}</button></form>"
        if kind == "comment":
            one = lambda: pick([f"<p>{prose(1, 3)}</p>", f"<b>{words(1, 2)} says:</b><p>{prose(1, 4)}</p><a href=#>Reply</a>", f"<div>{words(1, 2)} {r.integers(2, 20)} hours ago</div><div>{prose(1, 4)}</div>"])
            tag, item = pick([("div", "div"), ("section", "article"), ("ol", "li"), ("ul", "li")])
            return wrap(tag, pick(["comments", "comment-list", "replies", "disqus", "discussion"]), pick(["", f"<h2>{r.integers(2, 30)} Comments</h2>", f"<h3>{words(1, 3)}</h3>"]) + "".join(
                wrap(item, pick(["comment", "reply", ""]), one()) for _ in range(int(r.integers(1, 5)))))
        return wrap("div", pick(["share", "social"]), links(3))

    def article() -> str:
        out = [f"<h1>{good(words(2, 12))}</h1>"] if chance(0.85) else []
        if out and chance(0.15):
            out = [f"<header>{out[0]}</header>"]
        if chance(0.25):
            out.append(f"<p><b>{good(prose(1, 3))}<br>")
        for _ in range(int(r.integers(1, 14))):
            x = r.random()
            if x < 0.68:
                s = good(prose(1, 5) if chance(0.9) else words(1, 4) + ".")
                out.append(f"<p>{s}" + ("</p>" if chance(0.85) else "") if chance(0.9) else f"<div>{s}</div>")
            elif x < 0.75:
                out.append(f"<h{pick('23')}>{good(words(1, 7))}</h{pick('23')}>")
            elif x < 0.80:
                out.append("<ul>" + "".join(f"<li>{good(pick([words(1, 8), sentence()]))}</li>" for _ in range(int(r.integers(1, 5)))) + "</ul>")
            elif x < 0.84:
                out.append(f"<blockquote>{good(prose(1, 3))}</blockquote>" if chance(0.5) else f"<blockquote><p>{good(prose(1, 3))}</p></blockquote>")
            elif x < 0.86:
                out.append(f"<pre>{good(words(2, 9))}</pre>")
            elif x < 0.88:
                out.append(f"<figure><img src=x><figcaption>{good(sentence())}</figcaption></figure>")
            elif x < 0.90:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{good(words(1, 4))}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            else:
                out.append(boilerplate(pick(["ad", "ad", "notice", "side", "share", "form"])))
        if chance(0.15):
            out.append(boilerplate("comment"))
        return "".join(out)

    out = []
    for _ in range(n):
        body = article()
        kind = r.random()
        body = f"<article>{body}</article>" if kind < 0.55 else wrap("div", pick(["content", "article", "post", "entry", "main"]), body) if kind < 0.85 else f"<div>{body}</div>"
        if chance(0.3):
            body = f"<main>{body}</main>"
        top = [boilerplate(k) for k in ("notice", "head", "nav", "form", "ad", "nav") if chance(0.35)]
        end = [boilerplate(k) for k in ("share", "ad", "comment", "side", "form", "foot", "notice") if chance(0.35)]
        if chance(0.15):
            top, end = [*end[-1:], *top], end[:-1]
        page = "".join([*top, body, *end])
        if chance(0.2):
            page = page.replace("<div", "<!-- x --><div", 2)
        page = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>var t='</p>';</script><style>p{{}}</style></head><body>{page}" + ("</body></html>" if chance(0.85) else "")
        if chance(0.1):
            page = re.sub(r"<(/?)(\w+)", lambda m: "<" + m[1] + m[2].upper(), page)
        labels = ["\x01" in b.text for b in leaves(page)]
        out.append((page.replace("\x01", ""), [int(x) for x in labels]))
    return out


@functools.lru_cache(maxsize=4)
def train(n: int = PAGES, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.2, ridge: float = 1e-3) -> dict[str, float]:
    """Weights of the field, by stochastic gradient ascent of the log likelihood (AdaGrad)."""
    data = [(list(features(leaves(page))), y) for page, y in generate(n, seed)]
    data = [(f, y) for f, y in data if f and len(f) == len(y)]
    w: dict[str, float] = {}
    square: dict[str, float] = {}
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in r.permutation(len(data)).tolist():
            feats, y = data[at]
            p, turns = _marginals(_scores(feats, w), [w.get(x, 0.0) for x in _TURN])
            grad = {x: -turns[k] for k, x in enumerate(_TURN)}
            for a, b in zip(y, y[1:], strict=False):
                grad[_TURN[2 * a + b]] += 1.0
            for f, want, have in zip(feats, y, p, strict=True):
                d = want - have
                if abs(d) > 1e-4:
                    for x in f:
                        grad[x] = grad.get(x, 0.0) + d
            for x, g in grad.items():
                g -= ridge * w.get(x, 0.0)
                square[x] = square.get(x, 0.0) + g * g
                if square[x]:
                    w[x] = w.get(x, 0.0) + rate * g / math.sqrt(square[x])
    return w


def main_text(html: str | None, w: dict[str, float]) -> str:
    blocks = leaves(html or "")
    return "\n".join(b.text for b, y in zip(blocks, viterbi(features(blocks), w), strict=True) if y)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and text of every page; a map without shuffle."""
    w = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "html", 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h, w) for h in b.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html")).mapInArrow(
        run, "page_id bigint, url string, text string")
