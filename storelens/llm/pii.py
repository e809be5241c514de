"""PII (operator 9): fixed patterns, and a semi-Markov conditional random field for what they miss.

The fixed patterns (e-mail, IP address, card, phone) are matched leftmost and
without overlap per kind; their spans always stay.  Around characters that
personal data needs (digits, @, written-out "at" and "dot") the text is cut into
atoms, and every run of at most ``MAX_ATOMS`` atoms whose characters suit a kind is
a candidate segment.  Features of the whole span (digit groups, separators,
check digit, cue words before it, what touches it) score each candidate; single atoms
are the alternative.  Weights maximise the likelihood of labelled sentences,
which are generated here; the best segmentation, found by dynamic programming
over boundaries and types, adds its spans where no fixed one lies.

Defined cases: null and empty texts have no span; repeated rows give equal
results; long texts are read whole, a zone at a time; an empty table gives an
empty table; extra columns are not carried by ``find`` and pass through ``mask``.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import by_bytes

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 40
CONTEXT = 40  # characters around a zone's anchors
SENTENCES, EPOCHS, SEED = 900, 12, 9  # of training

# Fixed patterns; the look-behind and the possessive groups only save vain starts.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    out, done = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, m.end(), "email"))
                done = m.end()
    if _DIGITS.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


# ---- candidate segments ----------------------------------------------------------------------------------

_AT, _DOT = r"[\[({<]\s?(?:at|AT|@)\s?[\])}>]", r"[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]"
_ANCHOR = re.compile(rf"[0-9]|@|{_AT}|{_DOT}|(?<= )(?:at|AT) (?=[A-Za-z0-9-]+ (?:dot|DOT) )")
_ATOM = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
_SPOKEN = rf"(?:{_AT}|@|(?:at|AT))"
_EMAIL_LIKE = re.compile(rf"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]++(?:(?:\.|\s?{_DOT}\s?)[A-Za-z0-9_%+-]++)*+\s?{_SPOKEN}\s?[A-Za-z0-9-]+(?:(?:\.|\s?{_DOT}\s?|\s(?:dot|DOT)\s)[A-Za-z0-9-]+)*")
_IP_LIKE = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:\.|\s?{_DOT}\s?|\s\.\s?)[0-9]{{1,3}}){{3}}|(?:[0-9A-Fa-f]{{1,4}}:){{3,7}}:?[0-9A-Fa-f]{{1,4}}|[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{0,4}}){{2,7}}")
_NUMBER_LIKE = re.compile(r"\(?\+?[0-9][0-9 ().,/_·–-]*[0-9]")
_GROUPS = re.compile(r"[0-9]+")
_CUES = {  # words before a span
    "email": "email mail e-mail contact write courriel correo mailto address",
    "phone": "phone tel telephone call fax mobile cell whatsapp sms telefon téléphone teléfono number appelez anruf",
    "ip": "ip host server address addr ping from client login ipv4 ipv6 adresse",
    "card": "card visa mastercard amex credit debit payment carte karte tarjeta cc pay",
}
_CUE_OF = {}
for _k, _w in _CUES.items():
    for _x in _w.split():
        _CUE_OF.setdefault(_x, []).append(_k)


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around anchors, the only places that could hold a segment."""
    start = end = None
    for m in _ANCHOR.finditer(text):
        if end is not None and m.start() - end <= 8:
            end = m.end()
            continue
        if end is not None:
            yield start, end
        start, end = m.start(), m.end()
    if end is not None:
        yield start, end


def _worth(text: str, lo: int, hi: int) -> bool:
    """Whether ``segments`` could have a candidate in a zone with its context: one of its patterns fits."""
    return (any(sum("0" <= c <= "9" for c in m[0]) >= 7 for m in _NUMBER_LIKE.finditer(text, lo, hi))
            or _IP_LIKE.search(text, lo, hi) is not None or _EMAIL_LIKE.search(text, lo, hi) is not None)


def _around(text: str, a: int, b: int) -> tuple[int, int]:
    """A zone with its context, widened to white space where that is near, and to the end of what begins in it."""
    lo, hi = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
    for x in range(lo, max(-1, lo - 24), -1):
        if x == 0 or text[x - 1].isspace():
            lo = x
            break
    for x in range(hi, min(len(text), hi + 24) + 1):
        if x == len(text) or text[x].isspace():
            hi = x
            break
    cut = True
    while cut and hi < len(text):
        cut = False
        for like in (_EMAIL_LIKE, _IP_LIKE, _NUMBER_LIKE):
            last = None
            for last in like.finditer(text, lo, hi):
                pass
            if last is not None and last.end() > hi - 12 and (end := like.match(text, last.start()).end()) > hi:
                hi, cut = end, True
    return lo, hi


def _features(text: str, a: int, b: int, kind: str) -> list[str]:
    """What the whole span and its surroundings say, for one kind."""
    s = text[a:b]
    before, after = text[a - 1:a], text[b:b + 1]
    f = ["bias", "touch<" + ("w" if before.isalnum() else before if before in "@._-+/=#$:\"'&" and before else "o"),
         "touch>" + ("w" if after.isalnum() else "." + ("w" if text[b + 1:b + 2].isalnum() else "o") if after == "." else after if after and after in "@_-+/=%:\"'&" else "o")]
    cue = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, a - 30):a].lower())[-3:]
    hit = {k for w in cue for k in _CUE_OF.get(w, ())}
    f.append("cue" if kind in hit else "othercue" if hit else "nocue")
    if kind in ("card", "phone"):
        groups = [len(g) for g in _GROUPS.findall(s)]
        n, seps = sum(groups), "".join(sorted(set(re.sub("[0-9]", "", s))))
        f += [f"n{min(n, 20)}", f"groups{min(len(groups), 7)}", f"sep{seps[:6]}", f"max{min(max(groups), 12)}", f"last{min(groups[-1], 6)}", f"first{s[0] if not s[0].isdigit() else 'd'}"]
        f.append("shape" + "-".join(map(str, groups[:6])))
        if kind == "card":
            f += ["luhn" if 12 <= n <= 19 and luhn("".join(_GROUPS.findall(s))) else "noluhn", "even" if len(set(groups)) == 1 else "uneven"]
        f.append("cue+" + f[-1] if f[3] == "cue" else "nocue+n" + str(min(n, 20)))
    elif kind == "email":
        f += ["at" + ("@" if "@" in s else "b" if re.search(_AT, s) else "w"), "dot" + ("b" if re.search(_DOT, s) else "w" if re.search(r"\s(?:dot|DOT)\s", s) else "." if "." in re.split(_SPOKEN, s)[-1] else "n"),
              "tld" + str(min(5, len(re.split(r"[^A-Za-z0-9]+", s)[-1]))), "space" if " " in s else "tight"]
    else:
        f += ["six" if ":" in s else "four", "parts" + str(min(9, len(re.findall(r"[0-9A-Fa-f]+", s)))), "defanged" if re.search(_DOT, s) else "plain"]
        if ":" not in s:
            f.append("inrange" if all(int(p) <= 255 for p in re.findall("[0-9]+", s)) else "outofrange")
        else:
            f += ["clock" if re.fullmatch(r"[0-9]{1,2}(:[0-9]{2}){2}", s) else "noclock", "hexletters" if re.search("[A-Fa-f]", s) else "digits", "double" if "::" in s else "single"]
    return [kind + "|" + x for x in f]


def segments(text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int, str, list[str]]]]:
    """Atom boundaries of a zone, and its candidates (first atom, end atom, kind, features)."""
    bounds = [lo]
    for m in _ATOM.finditer(text, lo, hi):
        bounds.append(m.end())
    at = {b: i for i, b in enumerate(bounds)}
    out = []
    for kind, like in (("email", _EMAIL_LIKE), ("ip", _IP_LIKE), ("phone", _NUMBER_LIKE)):
        for m in like.finditer(text, lo, hi):
            a, b = m.span()
            if kind == "phone":  # every run of whole digit groups within a number-like stretch
                starts = [a + g.start() for g in _GROUPS.finditer(m[0])]
                ends = [a + g.end() for g in _GROUPS.finditer(m[0])]
                for i, x in enumerate(starts):
                    digits = 0
                    for j in range(i, min(len(ends), i + MAX_ATOMS)):
                        digits += ends[j] - starts[j]
                        if digits > 19:
                            break
                        opens = [x] + [x - k for k in (1, 2) if x - k >= lo and set(text[x - k:x]) <= set("+(")]
                        for o in opens:
                            if o in at and ends[j] in at and at[ends[j]] - at[o] <= MAX_ATOMS:
                                if digits >= 7 and digits <= 15:
                                    out.append((at[o], at[ends[j]], "phone", _features(text, o, ends[j], "phone")))
                                if 12 <= digits and o == x:
                                    out.append((at[o], at[ends[j]], "card", _features(text, o, ends[j], "card")))
            elif a in at and b in at and at[b] - at[a] <= MAX_ATOMS:
                out.append((at[a], at[b], kind, _features(text, a, b, kind)))
    return bounds, out


# ---- the field -------------------------------------------------------------------------------------------


def _index(cands, weights) -> dict[int, list[tuple[int, str, float]]]:
    """By end atom: first atom, kind and score of each candidate."""
    by_end: dict[int, list[tuple[int, str, float]]] = {}
    for k, (i, j, kind, f) in enumerate(cands):
        by_end.setdefault(j, []).append((i, k, sum(weights.get(x, 0.0) for x in f)))
    return by_end


_NEXT = "adjacent"  # transition weight between two entity segments without an atom between


def viterbi(n: int, cands, weights) -> list[int]:
    """The candidates of the best segmentation of n atoms; a single atom outside scores 0."""
    by_end, link = _index(cands, weights), weights.get(_NEXT, 0.0)
    best = [(0.0, -math.inf)] + [(-math.inf, -math.inf)] * n  # ending outside, ending with an entity
    back: list[tuple] = [(None, None)] * (n + 1)
    for j in range(1, n + 1):
        out = max(best[j - 1])
        ent, pick = -math.inf, None
        for i, k, s in by_end.get(j, ()):
            v = max(best[i][0], best[i][1] + link) + s
            if v > ent:
                ent, pick = v, (i, k)
        best[j], back[j] = (out, ent), (j - 1, pick)
    out, j, force = [], n, None
    while j > 0:
        if force is None:
            force = best[j][1] > best[j][0]
        if not force:
            j, force = j - 1, None
        else:
            i, k = back[j][1]
            out.append(k)
            force = best[i][1] + link > best[i][0]
            j = i
    return out[::-1]


def _logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _expected(n: int, cands, weights) -> tuple[dict[int, float], float]:
    """Probability of each candidate, and the expected number of adjacent pairs (forward-backward)."""
    by_end, link = _index(cands, weights), weights.get(_NEXT, 0.0)
    f = [(0.0, -math.inf)]
    for j in range(1, n + 1):
        out, ent = _logadd(*f[j - 1]), -math.inf
        for i, _, s in by_end.get(j, ()):
            ent = _logadd(ent, _logadd(f[i][0], f[i][1] + link) + s)
        f.append((out, ent))
    total = _logadd(*f[n])
    by_start: dict[int, list] = {}
    for j, xs in by_end.items():
        for i, k, s in xs:
            by_start.setdefault(i, []).append((j, k, s))
    after = [(-math.inf, -math.inf)] * n + [(0.0, 0.0)]  # what may follow an outside atom, an entity
    for i in range(n - 1, -1, -1):
        skip, ent = after[i + 1][0], -math.inf
        for j, _, s in by_start.get(i, ()):
            ent = _logadd(ent, after[j][1] + s)
        after[i] = (_logadd(skip, ent), _logadd(skip, ent + link))
    prob, pairs = {}, 0.0
    for j, xs in by_end.items():
        for i, k, s in xs:
            tail = s + after[j][1] - total
            a, b = f[i][0] + tail, f[i][1] + link + tail
            prob[k] = math.exp(_logadd(a, b)) if max(a, b) > -700 else 0.0
            pairs += math.exp(b) if b > -700 else 0.0
    return prob, pairs


def generate(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled sentences: made-up words, personal data in many spellings, and numbers that are none."""
    r = np.random.default_rng(seed)

    def pick(xs):
        return xs[int(r.integers(len(xs)))]

    def word() -> str:
        w = "".join(pick("the an er on in re at is ou ti ed st ch ie la de qu os un ü é ci".split()) for _ in range(int(r.integers(1, 4))))
        return w.capitalize() if r.random() < 0.15 else w

    def num(k: int) -> str:
        return "".join(str(d) for d in r.integers(0, 10, k))

    def card() -> str:
        d = pick(["4", "5", "37", "6011"])
        d += num((15 if d == "37" else 16) - 1 - len(d))
        return next(d + c for c in "0123456789" if luhn(d + c))

    def cut(s: str, sizes: list[int], sep: str) -> str:
        out, at = [], 0
        for k in sizes:
            out.append(s[at:at + k])
            at += k
        return sep.join(x for x in (*out, s[at:]) if x)

    def email(at: str, dot: str) -> str:
        local = word().lower().encode("ascii", "ignore").decode() or "info"
        return local + pick(["", ".", "_"]) + num(2) + at + "mail" + num(1) + dot + pick(["example", "host", "site"]) + dot + pick(["com", "org", "net", "de"])

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{num(2)} {num(2)} {num(7)}", f"00{num(2)} {num(3)} {num(6)}",
                     f"0{num(2)} {num(4)} {num(4)}", f"1-800-{b}-{c}", f"({a}) {b} {c}", f"+1{a}{b}{c}", f"0{num(3)}/{num(6)}"])

    def ip() -> str:
        return pick(["{}.{}.{}.{}", "{}.{}.{}.{}", "{}[.]{}[.]{}[.]{}", "{}(.){}(.){}(.){}"]).format(*r.integers(1, 256, 4))

    def six() -> str:
        return ":".join(f"{int(x):x}" for x in r.integers(256, 65536, 8))

    makers = {
        "email": lambda: pick([email("@", "."), email("@", "."), email(" (at) ", " (dot) "), email("[at]", "[dot]"), email(" [at] ", "."), email(" at ", " dot "), email("(at)", ".")]),
        "ip": lambda: ip() if r.random() < 0.8 else six(),
        "card": lambda: (lambda c: pick([c, cut(c, [4, 4, 4], " "), cut(c, [4, 4, 4], "-"), cut(c, [4, 4, 4], "."), cut(c, [4, 4, 4], "/")]))(card()),
        "phone": phone,
    }
    noise = [lambda: f"Version {num(1)}.{num(1)}.{num(2)}", lambda: f"{pick(['19', '20'])}{num(2)}-0{pick('123456789')}-1{num(1)}", lambda: f"1{num(1)}:{pick('012345')}{num(1)}:{pick('012345')}{num(1)}",
             lambda: "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: 'token = "' + "".join(pick("0123456789abcdef") for _ in range(40)) + '"',
             lambda: "password=" + "".join(pick("0123456789abcdef") for _ in range(18)), lambda: f"{num(2)},{num(3)},{num(3)}.{num(2)}", lambda: f"${num(3)},{num(3)},{num(3)}", lambda: num(int(r.integers(7, 12))),
             lambda: num(16), lambda: f"order {num(9)}", lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(4)}-{num(4)}", lambda: f"@{word().lower()}", lambda: f"see {word()} at {word()} {word()}",
             lambda: " ".join(num(int(r.integers(1, 5))) for _ in range(int(r.integers(3, 9)))), lambda: f"{num(1)}.{num(1)}.{num(2)}.{num(4)}", lambda: f"{num(3)}/{num(3)}", lambda: f"https://a.example.com/{num(8)}?id={num(10)}",
             lambda: f"{num(2)}.{num(2)}.{pick(['19', '20'])}{num(2)} {num(2)}:{num(2)}", lambda: f"[{num(2)}] ({num(4)}) {num(2)}({num(1)}):{num(3)}-{num(3)}", lambda: f"3.{num(15)}", lambda: "sha " + "".join(pick("0123456789abcdef") for _ in range(12))]
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(int(r.integers(1, 6)))), []
        for _ in range(int(r.integers(1, 3))):
            if r.random() < 0.5:
                kind = pick(KINDS)
                if r.random() < 0.35:
                    text += " " + pick(_CUES[kind].split()) + pick(["", ":"])
                text += pick([" ", " ", " ", ": ", ", "]) if r.random() < 0.9 else " \""
                s = makers[kind]()
                spans.append((len(text), len(text) + len(s), kind))
                text += s + pick(["", "", ".", ",", ";"])
            else:
                text += " " + pick(noise)() + pick(["", "", ".", ","])
            text += " " + " ".join(word() for _ in range(int(r.integers(1, 5))))
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=4)
def train(n: int = SENTENCES, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.3, ridge: float = 1e-3) -> dict[str, float]:
    """Weights of the field, by stochastic gradient ascent of the log likelihood (AdaGrad)."""
    data = []
    for text, spans in generate(n, seed):
        bounds, cands = segments(text, 0, len(text))
        gold = {k for k, (i, j, kind, _) in enumerate(cands) if (bounds[i], bounds[j], kind) in set(spans)}
        if cands:
            data.append((len(bounds) - 1, cands, gold))
    weights: dict[str, float] = {}
    square: dict[str, float] = {}
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in r.permutation(len(data)).tolist():
            n_atoms, cands, gold = data[at]
            prob, pairs = _expected(n_atoms, cands, weights)
            ends = {cands[k][1] for k in gold}
            grad = {_NEXT: sum(cands[k][0] in ends for k in gold) - pairs}
            for k, (_, _, _, f) in enumerate(cands):
                d = (k in gold) - prob.get(k, 0.0)
                if abs(d) > 1e-6:
                    for x in f:
                        grad[x] = grad.get(x, 0.0) + d
            for x, g in grad.items():
                g -= ridge * weights.get(x, 0.0)
                square[x] = square.get(x, 0.0) + g * g
                if square[x]:
                    weights[x] = weights.get(x, 0.0) + rate * g / math.sqrt(square[x])
    return weights


def all_spans(text: str, weights: dict[str, float]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The fixed spans, and those that the field adds."""
    base, added, seen = base_spans(text), [], 0
    taken = sorted((a, b) for a, b, _ in base)
    for a, b in zones(text):
        lo, hi = _around(text, a, b)
        lo = max(lo, seen)
        if lo >= hi or not _worth(text, lo, hi):
            continue
        bounds, cands = segments(text, lo, hi)
        for k in viterbi(len(bounds) - 1, cands, weights):
            i, j, kind, _ = cands[k]
            x, y = bounds[i], bounds[j]
            if not any(p < y and x < q for p, q in taken[max(0, _left(taken, x) - 1):_left(taken, y) + 1]):
                added.append((x, y, kind))
                seen = y
    return base, added


def _left(taken: list[tuple[int, int]], x: int) -> int:
    import bisect

    return bisect.bisect_left(taken, (x, 0))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and added: the spans as arrays of (start, end, kind)."""
    weights = train()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    names = ("start", "end", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", 4 << 20):
            got = [all_spans(t or "", weights) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[
                pa.array([[dict(zip(names, s, strict=True)) for s in g[k]] for g in got], span) for k in (0, 1)]], names=["doc_id", "base", "added"])

    kind = "array<struct<start: bigint, end: bigint, kind: string>>"
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, f"doc_id bigint, base {kind}, added {kind}")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch of spans replaced by the first one's kind, like ``<EMAIL>``."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all spans masked in ``text``; null stays null, other columns as they are."""
    weights = train()
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text, 4 << 20):
            new = []
            for t in b.column(at).to_pylist():
                new.append(t and masked(t, [s for x in all_spans(t, weights) for s in x]))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(new, b.schema.field(at).type), *b.columns[at + 1:]], names=names)

    return docs.mapInArrow(run, docs.schema)
