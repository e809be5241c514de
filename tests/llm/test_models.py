"""Operators 2, 5 and 9: brute force of what is exact, held-out accuracy of what is learnt."""

import hashlib
import html as entities
import random
import re
import zlib

import numpy as np
import pytest

from storelens.llm import html_extract as H
from storelens.llm import pii as P
from storelens.llm import toxicity as T
from storelens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"

SF01 = "/root/testdata/sf0.01"

# ---- operator 2 ----


def made(seed, n, insults=("loser", "idiot", "worthless", "blerghan", "stupid")):
    r = random.Random(seed)
    syllables = "the an er on in re at is ou ti ed nd ha es or ea".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    out = []
    for k in range(n):
        ws = [word() for _ in range(r.randint(20, 120))]
        if k % 4 == 0:
            for _ in range(r.randint(2, 5)):
                ws[r.randrange(len(ws))] = r.choice(insults)
        out.append((" ".join(ws) + ".", k % 4 == 0))
    return out


@pytest.fixture(scope="module")
def model():
    rows = made(1, 900)
    return T.train([t for t, y in rows if y], [t for t, y in rows if not y])


def test_held_out_accuracy(model):
    rows = made(2, 400)
    s = model.score([t for t, _ in rows])
    y = np.array([y for _, y in rows])
    assert ((s >= 0) & (s <= 1)).all()
    assert ((s >= 0.5) == y).mean() >= 0.98


def test_gaps_and_inserted_characters_are_found(model):
    clean = [t for t, y in made(3, 200) if not y]
    for insult in ("s-t-u-p-i-d i d i o t", "wor*thless stu.pid", "id-iot lo0ser stupid!"):
        s = model.score([t[:60].rsplit(" ", 1)[0] + " " + insult + " " + t[60:].split(" ", 1)[-1] for t in clean])
        assert (s >= 0.5).mean() > 0.9, insult


@pytest.mark.parametrize("insults", [("go drop dead now", "you are a rat", "eat my hat", "no one is fond of you", "the end is on you"), ("sod", "git", "rat", "ass", "cow")])
def test_phrases_and_short_words_are_learnt(insults):
    rows, held = made(1, 900, insults), made(2, 400, insults)
    m = T.train([t for t, y in rows if y], [t for t, y in rows if not y])
    assert ((m.score([t for t, _ in held]) >= 0.5) == np.array([y for _, y in held])).mean() >= 0.98


def test_runs_of_inserted_characters_are_found(model):
    clean = [t for t, y in made(3, 200) if not y]
    for insult in ("i--d--i--o--t", "s . t . u . p . i . d", "i***d***i***o***t", "s  t  u  p  i  d", "i -- d -- i -- o -- t"):
        s = model.score([t[:60].rsplit(" ", 1)[0] + " " + insult + " " + t[60:].split(" ", 1)[-1] for t in clean])
        assert (s >= 0.5).mean() > 0.9, insult
    assert (model.score(clean) >= 0.5).mean() < 0.05


def test_windows_equal_the_kernel_machine():
    """The folded table gives the sum over landmarks of normalised kernel values, computed here pair by pair."""
    r = random.Random(4)
    marks = ["idiotic", "loserly", "thebest"]
    alpha = np.array([0.7, -1.1, 0.4])

    def subsequences(s):
        x, out = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in s], {}
        for i in range(min(T.WINDOW, len(x))):
            for p in T._PATTERNS:
                if i + p[-1] < len(x) and all(x[i + k] for k in p):
                    w = 1.0
                    for k in range(1, p[-1]):
                        if k not in p:
                            w *= T.PASS_LETTER if x[i + k] else T.PASS_OTHER
                    key = tuple(x[i + k] for k in p)
                    out.setdefault(key, []).append(w)
        return out

    def norm(f):
        return np.sqrt(T.FLOOR + sum(w * w for ws in f.values() for w in ws))

    place, weights = T._weights(T._rows(marks))
    table = np.zeros(T._SIZE, dtype=np.float32)
    used = np.flatnonzero(place >= 0)
    table[used] = weights[place[used]] @ alpha
    for _ in range(40):
        s = "".join(r.choice("idotlserhb-.") for _ in range(r.randint(5, 30)))
        got = T.windows(*T.letters(s), table)
        for i in range(len(s)):
            f = subsequences(s[i:i + T._WIDTH])
            want = 0.0
            for a, m in zip(alpha, marks, strict=True):
                g = subsequences(m)
                want += a * sum(sum(ws) * sum(g.get(u, ())) for u, ws in f.items()) / norm(f) / norm(g)
            assert got[i] == pytest.approx(want, abs=1e-4)


def test_a_text_scores_the_same_in_any_company(model):
    texts = [t for t, _ in made(5, 40)] + ["", "a", " \n", "idiot"]
    assert np.allclose(model.score(texts), np.concatenate([model.score([t]) for t in texts]), atol=1e-6)


def test_toxicity_odd_inputs(spark, model):
    d = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "idiot", "y"), (2, "word " * 100_000, "z")], "doc_id bigint, text string, score string")
    rows = T.score(d, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert T.score(d.where("false"), model).count() == 0
    nothing = T.train([], ["a", "b"])
    assert nothing.score(["x"])[0] < 0.01


def test_toxicity_query_learns_from_its_fold_only(spark):
    rows = QUERIES["op2_string_kernel"](spark, SF001).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(rows) == spark.read.parquet(f"{SF001}/documents.parquet").count()


# ---- operator 9 ----

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def fixed(t):
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(t) if 12 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 9 <= len(only(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], P.KINDS.index(s[2])))


def test_fixed_patterns_match_the_plain_expressions():
    r = random.Random(3)
    for alphabet in ("0123456789 .-+()@ab_%1234 .@+", "0123456789", "1.25 ", "+0 1-()"):
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 45)))
            assert P.base_spans(t) == fixed(t), t


def test_field_finds_held_out_spellings():
    w, right, wrong, missed = P.train(), 0, 0, 0
    for text, spans in P.generate(300, 77):
        bounds, cands = P.segments(text, 0, len(text))
        got = {(bounds[cands[k][0]], bounds[cands[k][1]], cands[k][2]) for k in P.viterbi(len(bounds) - 1, cands, w)}
        right, wrong, missed = right + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_zones_lose_no_held_out_spelling():
    w, right, missed, zoned = P.train(), 0, 0, 0
    for text, spans in P.generate(300, 77):
        base, added = P.all_spans(text, w)
        bounds, cands = P.segments(text, 0, len(text))
        whole = {(bounds[cands[k][0]], bounds[cands[k][1]], cands[k][2]) for k in P.viterbi(len(bounds) - 1, cands, w)}
        got = {*base, *added}
        right, missed = right + len(got & set(spans)), missed + len(set(spans) - got)
        zoned += len((whole & set(spans)) - got)  # found by the field on the whole sentence, lost by the zones
    assert zoned == 0 and right / (right + missed) > 0.97
    long = "x the 12 some words anna at sub-domain-of-the-place dot longer-example-host-name dot com and"
    for text, span in ((long, (20, 88, "email")), ("write to anna42 at mail3 dot example dot com today", (9, 44, "email")), ("ping 8 . 8 . 8 . 8 now", (5, 18, "ip"))):
        assert P.all_spans(text, w)[1] == [span]
        assert P.masked(text, [span]) == text[:span[0]] + f"<{span[2].upper()}>" + text[span[1]:]


def test_viterbi_is_the_best_segmentation():
    r = random.Random(8)
    for _ in range(150):
        n = r.randint(0, 8)
        cands = [(i, r.randint(i + 1, n), "card", [f"f{k}"]) for k, i in enumerate(r.randint(0, n - 1) for _ in range(r.randint(0, 7)))] if n else []
        w = {f"f{k}": r.uniform(-1, 1) for k in range(7)} | {P._NEXT: r.uniform(-1, 1)}

        def best(j):
            """(score, chosen) of the best segmentation from atom j on; adjacency is charged when met."""
            if j >= n:
                return [(0.0, [])]
            out = [(s, c) for s, c in best(j + 1)]
            for k, (i, e, _, f) in enumerate(cands):
                if i == j:
                    out += [(s + w[f[0]] + (w[P._NEXT] if c and cands[c[0]][0] == e else 0.0), [k, *c]) for s, c in best(e)]
            return out

        def value(c):
            return sum(w[cands[k][3][0]] for k in c) + sum(w[P._NEXT] for a, b in zip(c, c[1:], strict=False) if cands[a][1] == cands[b][0])

        assert value(P.viterbi(n, cands, w)) == pytest.approx(max(s for s, _ in best(0)))


def test_pii_rows_and_masking(spark):
    texts = [None, "", "a@b.co and +1 (269) 555-3296 4524132264652876 end", "call (415) 555-0199 now", "Version 2.0.", "7" * 20_000, "é 1.2.3.4, é", "password=c1f6c02f845bf3028d", "a@b.co" * 2]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1), (1, "", 1)], "doc_id bigint, text string, base int")
    rows = P.find(d).collect()
    assert len(rows) == len(texts) + 2 and P.find(d.where("false")).count() == 0
    for r in rows:
        t = texts[r.doc_id] if r.doc_id is not None else "x"
        assert [tuple(s) for s in r.base] == fixed(t or "")
        assert all(not (s["start"] < b["end"] and b["start"] < s["end"]) for s in r.added for b in r.base)
    found = {r.doc_id: [(s["kind"], texts[r.doc_id][s["start"]:s["end"]]) for s in r.added] for r in rows if r.doc_id is not None}
    assert found[2] == [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]  # the fixed phone pattern swallows both and fails
    assert found[3] == [("phone", "(415) 555-0199")] and not found[4] and not found[5] and not found[7]
    out = {r.doc_id: r.text for r in P.mask(d).collect()}
    assert out[0] is None and out[2] == "<EMAIL> and <PHONE> <CARD> end" and out[6] == "é <IP>, é"
    assert P.mask(d).columns == d.columns


def test_pii_query_digests(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    w = P.train()
    for r in QUERIES["op9_semi_markov"](spark, SF01).collect():
        t = docs[r.doc_id]
        base = fixed(t)
        line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], P.KINDS.index(s[2]))))
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, k in base) for x in P.KINDS]
        assert r.spans == line(base + P.all_spans(t, w)[1])


# ---- operator 5 ----


def plain(page):
    """Article text of the driver's pages, by their known layout."""
    page = re.sub(r"<script>.*?</script>|<style>.*?</style>|<!--.*?-->", "", page, flags=re.S)
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1])
    parts = [" ".join(entities.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(x for x in parts if x)


def test_pages_of_the_driver(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    rows = QUERIES["op5_block_crf"](spark, SF01).collect()
    assert len(rows) == len(pages)
    assert sum(r.text == plain(pages[r.page_id]) for r in rows) >= 0.99 * len(rows)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_held_out_layouts():
    w, right, total = H.train(), 0, 0
    for page, labels in H.generate(150, 99):
        got = H.viterbi(list(H.features(H.leaves(page))), w)
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.98


def test_leaf_blocks_of_broken_markup():
    text = lambda s: [b.text for b in H.leaves(s)]
    assert text("<p>a<b>b<br>c<p>d &amp; e&nbsp;f<div>g</b>h") == ["ab c", "d & e f", "gh"]
    assert text("<script>var t='</p>';</script><style>p{}</style>x<!-- y -->z<td>1<td>2") == ["xz", "1", "2"]
    assert text("") == [] and text("<<>>&#x41;") and text("<p></p> \n") == [] and text("plain") == ["plain"]
    path = H.leaves("<ul><li>a<li><a href=x>b</a></ul>")[1].within.path()
    assert path == ["ul", "li", "a"]


def test_html_viterbi_and_marginals_by_enumeration():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 6)
        w = {f"f{i}": r.uniform(-2, 2) for i in range(n)} | {x: r.uniform(-2, 2) for x in H._TURN}
        feats = [[f"f{i}"] for i in range(n)]

        def score(y):
            return sum(w[f"f{i}"] for i in range(n) if y[i]) + sum(w[H._TURN[2 * a + b]] for a, b in zip(y, y[1:], strict=False))

        ys = [[(k >> i) & 1 for i in range(n)] for k in range(1 << n)]
        assert score(H.viterbi(feats, w)) == pytest.approx(max(map(score, ys)))
        z = sum(np.exp(score(y)) for y in ys)
        p, _ = H._marginals([w[f"f{i}"] for i in range(n)], [w[x] for x in H._TURN])
        for i in range(n):
            assert p[i] == pytest.approx(sum(np.exp(score(y)) for y in ys if y[i]) / z)


def test_extract_odd_inputs(spark):
    pages = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", "<nav>" + "<a href=x>y</a>" * 20_000 + "</nav><article><p>" + "Some long words of text here. " * 20_000 + "</p></article>")]
    d = spark.createDataFrame([(*p, "t") for p in pages], "page_id bigint, url string, html string, text string")
    rows = H.extract(d).collect()
    assert len(rows) == 4 and sorted(len(r.text) for r in rows) == [0, 0, 0, 30 * 20_000 - 1]
    assert H.extract(d.where("false")).count() == 0


@pytest.mark.parametrize("page", ["<div>x" * 200_000, "<b>" * 100_000 + "<h1>x" * 100_000, "<b>" * 100_000 + "x</q>" * 100_000,
                                  "".join(f"<t{i}>y" for i in range(120_000)), "<!--" * 200_000, "<a " * 200_000, "<![CDATA[x>" * 80_000, "<table><td>x" * 60_000])
def test_broken_pages_cost_in_proportion(page):
    """Some 1 MB each of what never ends: seconds and little memory, with a defined result."""
    import time
    import tracemalloc

    w = H.train()
    began = time.time()
    text = H.main_text(page, w)
    assert time.time() - began < 60
    assert set(text) <= {"x", "y", "\n"} or page.startswith("<![")
    tracemalloc.start()
    H.main_text(page[:len(page) // 8], w)
    assert tracemalloc.get_traced_memory()[1] < 500 << 17  # an eighth of 500 MB
    tracemalloc.stop()


def test_unclosed_comment_and_odd_sections():
    text = lambda s: [b.text for b in H.leaves(s)]
    assert text("<p>a<!-- b<p>c") == ["a"] and text("<p>a<![foo[b]]><p>c") == ["a", "c"] and text("<p>a<br><p>b</p") == ["a", "b"]
