"""Toxicity (operator 2): a subsequence string kernel SVM with Nyström landmarks.

The kernel of two strings counts their common subsequences of four letters over
at most ``SPAN`` characters.  An occurrence weighs less for each character it
passes over: little for inserted signs ("i d i o t", "stu-pid", "lo0ser"), of which
a run counts as one ("s--t--u", "s . t . u"), more for letters.  Case is folded, other letters than a to z fall into a few classes, the beginning of a word counts as a letter,
other characters match nothing.

A document is as toxic as its worst passage.  Labels are of documents, so the
training passages get theirs by multiple instances: all sentences of clean
documents are clean, and of a toxic document the sentence whose worst window the
present model finds worst is toxic; its window's own text is a positive, across words.
The first model learns from words and pairs of neighbouring words that stand out in
toxic documents, and they stay positives.  Landmarks are passages of toxic and words of hard clean
sentences; the SVM is linear in the Nyström map of the windows' kernel values.

The kernel is an inner product over subsequences, so the trained machine, a sum
over landmarks, is folded into one table of 33^4 weights: scoring looks up
each subsequence of a text once and gives exactly the machine's value.  The
table (5 MB whatever the data) travels to the tasks; scoring is a map without shuffle.

Defined cases: null and empty texts are scored like a text without any
subsequence; without labelled rows of both kinds every score is the share of
toxic ones (0 without rows); repeated rows score alike; long texts are read whole;
an empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import by_bytes

LETTERS = 4  # of a subsequence
SPAN = 7  # characters a subsequence may spread over
PASS_LETTER, PASS_OTHER = 0.3, 0.9  # weight of passing over a letter, or another character
WINDOW = 5  # starts of subsequences that one window adds up
LANDMARKS = 240
ROUNDS = 3
# Bounds of the training sample: documents of each label, and their length.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 3000, 20_000
SEED = 17
CLEAN_BELOW = 0.97  # share of clean documents that a sentence must exceed to be taken for toxic
FLOOR = 0.5  # added to the squared norm of a window, so that a few stray letters don't look like a word
FILLERS = " .-*_0"  # characters inserted into training words
CHUNK = 400_000  # code points scored at once

_MARKED = 5  # classes of letters beyond a to z, by code point
_LETTERS = 28 + _MARKED  # none, a to z, these, and the beginning of a word
_SIZE = _LETTERS ** LETTERS
_PATTERNS = [(0, *p) for p in combinations(range(1, SPAN), LETTERS - 1)]
_WIDTH = WINDOW + SPAN - 1  # characters that a window sees


def _weight(last: int, inside: np.ndarray) -> np.ndarray:
    """Weight of subsequences that end ``last`` characters after their start, with so many letters between (two are theirs)."""
    k = np.arange(last)
    table = PASS_LETTER ** np.maximum(k - (LETTERS - 2), 0) * PASS_OTHER ** (last - 1 - k)
    return table.astype(np.float32).take(inside)


def _norms() -> np.ndarray:
    """The norm of a window by the mask of its letters: every occurrence counts as a subsequence of its own."""
    mask = np.arange(1 << _WIDTH)
    total = np.full(len(mask), FLOOR)
    for i in range(WINDOW):
        for p in _PATTERNS:
            bits = sum(1 << (i + k) for k in p)
            inside = np.bitwise_count((mask >> (i + 1)) & ((1 << (p[-1] - 1)) - 1))
            total += np.where((mask & bits) == bits, _weight(p[-1], inside).astype(np.float64) ** 2, 0.0)
    return np.sqrt(total).astype(np.float32)


_NORM = _norms()


def _letters() -> np.ndarray:
    """1 to 26 for a to z of either case, 27 on for other letters, 0 for the rest."""
    out = np.zeros(0x110000, dtype=np.int32)
    for c in range(0x3000):
        ch = chr(c).lower()[0]
        if ch.isalpha():
            out[c] = ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) % _MARKED
    wide = np.arange(0x3000, 0xD800)
    out[wide] = 27 + wide % _MARKED
    return out


_LETTER_OF: np.ndarray | None = None


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the text, and the number of line breaks up to each character.

    White space begins a word, unless all between its neighbours' other white space is at
    most one letter with signs ("i d i o t", "i - d - i").
    """
    global _LETTER_OF
    if _LETTER_OF is None:
        _LETTER_OF = _letters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    white = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    x = _LETTER_OF[points]
    part = np.cumsum(~white & np.concatenate(([True], white))[:len(white)])  # of each sign, or the part before it
    held = np.bincount(part, weights=x > 0, minlength=int(part[-1]) + 2 if len(part) else 2)
    single = held <= 1
    single[0] = single[-1] = False  # nothing lies before the first and after the last
    broken = white & ~(single[part] & single[part + 1] & (points != 0x0A))
    x[broken] = _LETTERS - 1
    return x, np.cumsum(points == 0x0A, dtype=np.int32)


def squeezed(x: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and breaks with each run of inserted signs as one sign, and the old place of each."""
    kept = np.flatnonzero((x > 0) | (np.concatenate(([1], x))[:len(x)] > 0))
    return x[kept], breaks[kept], kept


def windows(x: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The normalised machine value of each window, by the place of its first character.

    A window ends at a line break, and no subsequence crosses one; words it may cross.
    """
    n = len(x)
    total = np.zeros(n, dtype=np.float32)
    pair = {d: x[:max(0, n - d)] * _LETTERS + x[d:] for d in range(1, SPAN)}
    upto = np.cumsum(x > 0, dtype=np.int32)
    for d in range(LETTERS - 1, min(SPAN, n)):
        m = n - d
        part = np.zeros(m, dtype=np.float32)
        for _, a, b, last in _PATTERNS:
            if last == d:
                code = pair[a][:m] * _LETTERS ** 2
                code += pair[d - b][b:b + m]
                part += table.take(code)
        part *= _weight(d, upto[d - 1:n - 1] - upto[:m])
        part *= breaks[d:] == breaks[:m]
        total[:m] += part
    c = np.concatenate(([0.0], np.cumsum(total, dtype=np.float64)))
    place = np.arange(n)
    ends = np.append(np.flatnonzero(np.diff(breaks, prepend=0)), n)
    end = np.minimum(ends[np.minimum(breaks, len(ends) - 1)], place + WINDOW)  # a break's own character begins the next part
    value = (c[np.maximum(end, place)] - c[:-1]).astype(np.float32)
    mask = (x > 0).astype(np.int32)
    full = mask.copy()
    for k in range(1, _WIDTH):
        if k < n:
            full[:n - k] |= (mask[k:] & (breaks[k:] == breaks[:n - k])) << k
    return value / _NORM.take(full)


def _joined(texts: list[str]) -> tuple[str, np.ndarray]:
    """All texts, each after a break that belongs to it, and where each begins."""
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return "\n".join(["", *texts]), begin


def worst(texts: list[str], table: np.ndarray, bar: float) -> np.ndarray:
    """Per text: its highest window (none is below 0), and the logarithm of how many pass ``bar``."""
    out, group, size = [], [], 0

    def flush() -> None:
        text, begin = _joined(group)
        x, breaks, kept = squeezed(*letters(text))
        begin = np.searchsorted(kept, begin)  # a text begins with a break, which is kept
        w = windows(x, breaks, table)
        out.append(np.column_stack([np.maximum(np.maximum.reduceat(w, begin), 0), np.log1p(np.add.reduceat((w > bar).astype(np.int64), begin))]))

    for t in texts:
        if group and size + len(t) > CHUNK:
            flush()
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        flush()
    return np.concatenate(out).astype(np.float64) if out else np.empty((0, 2))


@dataclass(frozen=True)
class Model:
    """Folded weights of the machine, and its calibration over the worst window and how many windows pass ``bar``."""

    table: np.ndarray
    bar: float
    scale: tuple[float, float]
    offset: float

    def score(self, texts: list[str]) -> np.ndarray:
        f = worst(texts, self.table, self.bar) @ np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(f + self.offset, -30, 30)))


def _rows(strings: list[str]) -> np.ndarray:
    """The first ``_WIDTH`` characters of each string as letters, blank beyond its first break."""
    out = np.zeros((len(strings), _WIDTH), dtype=np.int32)
    for i, s in enumerate(strings):
        if s:
            x, breaks, _ = squeezed(*letters(s))
            x = x[breaks == breaks[0]][:_WIDTH]
            out[i, :len(x)] = x
    return out


def _subsequences(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes of each row's subsequences, one place and pattern at a time, and their weights; -1: none."""
    upto = np.cumsum(rows > 0, axis=1)
    for i in range(WINDOW):
        for p in _PATTERNS:
            cols = [rows[:, i + k] for k in p]
            code = ((cols[0] * _LETTERS + cols[1]) * _LETTERS + cols[2]) * _LETTERS + cols[3]
            whole = (cols[0] > 0) & (cols[1] > 0) & (cols[2] > 0) & (cols[3] > 0)
            yield np.where(whole, code, -1), _weight(p[-1], upto[:, i + p[-1] - 1] - upto[:, i])


def _norm(rows: np.ndarray) -> np.ndarray:
    return _NORM[((rows > 0) << np.arange(_WIDTH)).sum(axis=1)].astype(np.float64)


def _weights(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised subsequence weights of each landmark: place of a code (-1: in none), and a row a code."""
    all_codes = [(c, w) for c, w in _subsequences(marks)]
    used = np.unique(np.concatenate([c for c, _ in all_codes]))
    used = used[used >= 0]
    place = np.full(_SIZE, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    out = np.zeros((len(used) + 1, len(marks)), dtype=np.float32)  # the last row is for codes of none
    for c, w in all_codes:
        j = np.flatnonzero(c >= 0)
        np.add.at(out, (place[c[j]], j), w[j])
    return place, out / _norm(marks)


def _kernel(rows: np.ndarray, place: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Normalised kernel of each row with each landmark."""
    out = np.zeros((len(rows), weights.shape[1]), dtype=np.float32)
    for code, w in _subsequences(rows):
        at = np.where(code >= 0, place[np.maximum(code, 0)], -1)
        hit = np.flatnonzero(at >= 0)
        if len(hit):
            out[hit] += w[hit, None] * weights[at[hit]]
    return out / _norm(rows)[:, None]


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton's method on the support vectors."""
    z1 = np.hstack([z, np.ones((len(z), 1))]).astype(np.float32)
    w, reg = np.zeros(z1.shape[1]), np.full(z1.shape[1], ridge)
    reg[-1] = 1e-6
    support = np.ones(len(z), dtype=bool)
    for _ in range(steps):
        square, target = np.diag(reg), np.zeros(len(reg))
        for k in range(0, len(z1), 4096):  # in blocks, for memory
            a = z1[k:k + 4096][support[k:k + 4096]].astype(np.float64)
            b = a * weight[k:k + 4096][support[k:k + 4096], None]
            square, target = square + b.T @ a, target + b.T @ y[k:k + 4096][support[k:k + 4096]]
        new = np.linalg.solve(square, target)
        now = y * (z1 @ new) < 1
        w, same = new, (now == support).all()
        support = now
        if same or not support.any():
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag([1e-3] * x1.shape[1])
        step = np.linalg.solve(h, x1.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _telling(toxic: list[str], clean: list[str]) -> dict[str, float]:
    """Words, and pairs of neighbouring words, that stand out in toxic documents, with their log odds."""
    often = np.zeros(1 << 22, dtype=np.int32)  # of toxic documents, by hash: pairs of few are never counted by name
    for t in toxic:
        often[np.unique([zlib.crc32(g.encode("utf-8", "surrogatepass")) % len(often) for g in _grams(t)]).astype(np.int64)] += 1
    a: Counter = Counter()
    for t in toxic:
        a.update({g for g in _grams(t) if often[zlib.crc32(g.encode("utf-8", "surrogatepass")) % len(often)] > 2})
    b: Counter = Counter()
    for t in clean:
        b.update({g for g in _grams(t) if g in a})
    out = {}
    for w, n in a.items():
        x, y = n + 0.5, b[w] + 0.5
        odds = np.log(x / (len(toxic) - x + 1.5)) - np.log(y / (len(clean) - y + 1.5))
        if len(w) >= LETTERS - 1 and odds > 2 and odds / np.sqrt(1 / x + 1 / y) > 2.9:
            out[w] = float(odds)
    return out


def _grams(text: str) -> list[str]:
    ws = text.lower().split()
    return ws + [f"{v} {w}" for v, w in zip(ws, ws[1:], strict=False)]


def _first(passage: str) -> str:
    """The first word of a passage, whole or as far as it goes."""
    return (passage.split() or [""])[0]


def _gapped(word: str, rng: np.random.Generator) -> str:
    """The word with one filler between all letters, or with one at one place."""
    f = FILLERS[int(rng.integers(len(FILLERS)))]
    if rng.random() < 0.5:
        return f.join(word)
    k = int(rng.integers(1, max(2, len(word))))
    return word[:k] + f + word[k:]


def train(toxic: list[str], clean: list[str], seed: int = SEED) -> Model:
    """Fit the machine on two thirds of the sample and calibrate it on the rest."""
    nothing = np.zeros(_SIZE, dtype=np.float32)
    if len(toxic) < 3 or len(clean) < 3:
        share = len(toxic) / max(1, len(toxic) + len(clean))
        return Model(nothing, 0.0, (0.0, 0.0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    fit_t, cal_t = [t for i, t in enumerate(toxic) if i % 3], toxic[::3]
    fit_c, cal_c = [t for i, t in enumerate(clean) if i % 3], clean[::3]
    rng = np.random.default_rng(seed)
    split = [[s for s in _SENTENCE.split(t) if s] for t in (*fit_t, *fit_c)]
    text, begin = _joined([s for ss in split for s in ss])
    x, breaks, kept = squeezed(*letters(text))
    edges = np.searchsorted(kept, begin)
    telling = _telling(fit_t, fit_c)
    table, bar = nothing, 0.0
    neg: list[tuple[float, str]] = []

    def passage(i: int) -> str:
        """The worst window of a sentence."""
        end = edges[i + 1] if i + 1 < len(edges) else len(x)
        w = int(edges[i] + value[edges[i]:end].argmax())
        return text[int(kept[w]):int(kept[min(w + _WIDTH, len(x)) - 1]) + 1]

    for step in range(ROUNDS):
        at, pos, own, hard = 0, [], [], []  # (value, passage)
        if step:
            value = np.concatenate([windows(x[i:i + CHUNK], breaks[i:i + CHUNK] - breaks[i], table) for i in range(0, len(x), CHUNK)])
            high = np.maximum.reduceat(value, edges)
            ends = np.cumsum([len(ss) for ss in split])
            tops = [high[e - len(ss):e].max(initial=0) for ss, e in zip(split, ends.tolist(), strict=True)]
            bar = float(np.quantile(tops[len(fit_t):], CLEAN_BELOW))  # toxic sentences exceed nearly all clean documents
        for k, ss in enumerate(split):
            bad, mine = k < len(fit_t), range(at, at + len(ss))
            at += len(ss)
            if not ss:
                continue
            if bad:  # what tells most in each sentence, and the worst window of the sentence that the present machine finds worst
                found = [max(_grams(t), key=lambda w: telling.get(w, 0.0), default="") for t in ss]
                found = sorted((w for w in found if w in telling), key=lambda w: -telling[w])[:4]
                pos += [(telling[w], " " + w[:_WIDTH - 1]) for w in found]
                if step:
                    i = max(mine, key=lambda i: high[i])
                    own.append((float(high[i]), passage(i)))
                continue
            if step:  # clean sentences that the present machine finds worst
                for i in sorted(mine, key=lambda i: -high[i])[:4]:
                    hard.append((float(high[i]), passage(i)))
            else:
                for _ in range(4):
                    w = text.find(" ", int(begin[mine[0]]) + int(rng.integers(sum(map(len, ss)) + 1)))
                    neg.append((0.0, text[max(w, 0):max(w, 0) + _WIDTH]))
        hard.sort(reverse=True)
        neg += hard[:len(split)]
        if not (pos or own) or not neg:
            break
        # landmarks: peaks of toxic documents (most frequent first, then highest), and of hard clean ones
        count: dict[str, list[float]] = {}
        for v, w in pos:
            count.setdefault(w.strip().lower(), []).append(v)
        words = [w for w in sorted(count, key=lambda w: (-len(count[w]), -max(count[w]), w)) if len(w) >= LETTERS - 1][:LANDMARKS // 2]
        words += [w for w in dict.fromkeys(w.strip().lower() for _, w in sorted(own, key=lambda r: (-r[0], r[1]))) if len(w) >= LETTERS and w not in words][:max(0, LANDMARKS // 2 - len(words))]
        worse = [_first(w).lower() for _, w in sorted(neg, key=lambda r: -r[0])]
        words += [w for w in dict.fromkeys(worse) if len(w) >= LETTERS and w not in words][:LANDMARKS - len(words)]
        if not words:
            break
        marks = _rows([" " + w for w in words])
        place, weights = _weights(marks)
        value, vector = np.linalg.eigh(_kernel(marks, place, weights).astype(np.float64))
        root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
        inserted = [" " + _gapped(w.strip(), rng) for _, w in pos if len(w.strip()) >= LETTERS]
        spaced = [" " + _gapped(_first(w), rng) for _, w in neg[::2] if len(_first(w)) >= LETTERS]
        z = _kernel(_rows([w for _, w in pos + own] + inserted + [w for _, w in neg] + spaced), place, weights) @ root
        n_pos, n_neg = len(pos) + len(own) + len(inserted), len(neg) + len(spaced)
        y = np.array([1.0] * n_pos + [-1.0] * n_neg)
        v, bias = _svm(z, y, np.where(y > 0, len(y) / (2 * n_pos), len(y) / (2 * n_neg)))
        table = np.zeros(_SIZE, dtype=np.float32)
        used = np.flatnonzero(place >= 0)
        table[used] = weights[place[used]] @ (root @ v)
    cal = worst([*cal_t, *cal_c], table, bar)
    w = _logistic(cal, np.array([1.0] * len(cal_t) + [0.0] * len(cal_c)))
    return Model(table, bar, (float(w[0]), float(w[1])), float(w[2]))


def sample(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> tuple[list[str], list[str]]:
    """At most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled texts of at most ``MAX_CHARS``, by hashed id.

    ``labels`` has doc_id and toxic (0/1), only rows to learn from.
    """
    out = []
    short = docs.where(F.char_length("text") <= MAX_CHARS)
    for kind, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        ids = labels.where(F.col("toxic") == kind).select("doc_id").distinct().orderBy(
            F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)  # a bounded number of ids
        rows = short.join(F.broadcast(ids), "doc_id").select("doc_id", "text").toPandas()
        out.append(rows.sort_values(["doc_id", "text"])["text"].tolist())
    return out[0], out[1]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", 2 << 20):
            s = model.score([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, "doc_id bigint, score double, predicted int")
