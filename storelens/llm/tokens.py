"""Byte-level BPE ids of whole texts, fast.

Texts are cut into pre-tokens with array operations (letters, digits, other
signs, white space; one space joins what follows it; English contractions), the
distinct pre-tokens of a batch are found by Arrow's dictionary encoding, and
only those not met before go through the tokenizer.  Byte-level BPE never
merges across pre-tokens, so the ids are the tokenizer's own.  A text with a
character outside the ranges below, or with an added token's string, and any
tokenizer of another kind, goes through the tokenizer whole.
"""

from __future__ import annotations

import array
import json
import os

import numpy as np
import pyarrow as pa

_LETTER, _DIGIT, _SPACE, _OTHER, _UNSURE = range(5)
CACHE_BYTES = 32 << 20  # of pre-tokens and their ids that a Python worker remembers, twice over
ENTRY_BYTES = 180  # that an entry takes besides its own bytes


def _classes() -> np.ndarray:
    """Class of each code point below U+3000 and of the common Asian blocks, from Unicode's categories."""
    import unicodedata

    out = np.full(0x110000, _UNSURE, dtype=np.uint8)
    for lo, hi in ((0x21, 0x7F), (0xA1, 0x180), (0x391, 0x3CE), (0x410, 0x450), (0x2010, 0x2028), (0x2030, 0x205F),
                   (0x20A0, 0x20AD), (0x3041, 0x3095), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)):
        for c in range(lo, hi):
            kind = unicodedata.category(chr(c))
            if kind[0] in "LN":
                out[c] = _LETTER if kind[0] == "L" else _DIGIT
            elif kind[0] in "PS":
                out[c] = _OTHER
    for c in (0x20, 0x09, 0x0A, 0x0D):
        out[c] = _SPACE
    return out


def cuts(points: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; ``first`` marks the first code point of each text."""
    n = len(points)
    begins = first.copy()
    begins[1:] |= classes[1:] != classes[:-1]
    space = classes == _SPACE
    # the last of some white space before something else stands alone, or joins it if it is a plain space
    before = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
    begins[before] = True
    begins[before[points[before] == 0x20] + 1] = False
    # 's 't 'm 'd and 're 've 'll, where the apostrophe begins a pre-token
    quote = np.flatnonzero((points[:-1] == 0x27) & begins[:-1] & (classes[1:] == _LETTER) & ~first[1:])
    for q in quote.tolist():
        if not begins[q]:
            continue
        a = chr(points[q + 1])
        two = a + chr(points[q + 2]) if q + 2 < n and not first[q + 2] else ""
        size = 2 if a in "stmd" else 3 if two in ("re", "ve", "ll") else 0
        if size:
            begins[q + 1:q + size] = False
            if q + size < n:
                begins[q + size] = True
    return np.flatnonzero(begins)


class Encoder:
    """Ids (uint32 arrays) for lists of texts, as ``tokenizers`` gives them without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.merge = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") \
                and not spec.get("normalizer") and spec["model"]["type"] == "BPE":
            self.merge = _merger(spec["model"])
        self.classes = _classes() if self.merge else None
        self.seen: dict[bytes, bytes] = {}  # of late, and of the time before
        self.before: dict[bytes, bytes] = {}
        self.held = 0

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], piece: int = 1_000_000) -> list[np.ndarray]:
        """``piece``: code points handled at once (a longer text is taken alone)."""
        out: list[np.ndarray] = []
        group, size = [], 0
        for t in texts:
            if group and size + len(t) > piece:
                out += self._group(group)
                group, size = [], 0
            group.append(t)
            size += len(t)
        return out + self._group(group) if group else out

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        if self.merge is None:
            return self._plain(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        kinds = self.classes[points]
        unsure = np.flatnonzero(kinds == _UNSURE)
        slow = {int(i) for i in np.unique(np.searchsorted(ends, unsure, side="right"))}
        slow |= {i for i, t in enumerate(texts) if not t or any(a in t for a in self.added)}
        if not slow:
            return self._by_words(texts, points, kinds, ends)
        out: list[np.ndarray] = [None] * len(texts)
        for i, ids in zip(sorted(slow), self._plain([texts[i] for i in sorted(slow)]), strict=True):
            out[i] = ids
        good = [i for i in range(len(texts)) if i not in slow]
        if good:
            parts = [slice(int(ends[i] - sizes[i]), int(ends[i])) for i in good]
            got = self._by_words([texts[i] for i in good], np.concatenate([points[p] for p in parts]),
                                 np.concatenate([kinds[p] for p in parts]), np.cumsum(sizes[good]))
            for i, ids in zip(good, got, strict=True):
                out[i] = ids
        return out

    def _by_words(self, texts: list[str], points: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        first = np.zeros(len(points), dtype=bool)
        first[np.concatenate(([0], ends[:-1]))] = True
        begin = cuts(points, kinds, first)
        width = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)  # UTF-8 bytes up to here
        offsets = np.append(np.concatenate(([0], width[begin[1:] - 1])), width[-1]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [
            None, pa.py_buffer(offsets), pa.py_buffer("".join(texts).encode())])
        coded = words.dictionary_encode()
        ids = self._pieces(coded.dictionary.to_pylist())
        lens = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), dtype=np.uint32)
        starts = np.cumsum(lens, dtype=np.int64) - lens
        index = coded.indices.to_numpy(zero_copy_only=False)
        n = lens[index]  # ids of each pre-token of the texts
        upto = np.cumsum(n, dtype=np.int64)
        where = np.repeat(starts[index] - (upto - n), n)
        where += np.arange(len(where))
        last = upto[np.searchsorted(begin, ends, side="left") - 1]  # ids up to each text's end
        return np.split(flat[where], last[:-1])

    def _pieces(self, words: list[bytes]) -> list[bytes]:
        got = list(map(self.seen.get, words))
        for i, ids in enumerate(got):
            if ids is None:
                w = words[i]
                ids = self.before.get(w)
                if ids is None:
                    ids = array.array("I", self.merge(w.decode())).tobytes()
                if self.held > CACHE_BYTES:
                    self.before, self.seen, self.held = self.seen, {}, 0
                got[i] = self.seen[w] = ids
                self.held += len(w) + len(ids) + ENTRY_BYTES
        return got


def worker_encoder(path: str) -> Encoder:
    """One encoder a Python worker: a task function travels by value, so its module's own globals are new in every task."""
    import sys
    import types

    store = sys.modules.setdefault("storelens_worker_encoders", types.ModuleType("storelens_worker_encoders"))
    if path not in store.__dict__:
        store.__dict__[path] = Encoder(path)
    return store.__dict__[path]


def _merger(model: dict):
    """The ids of one pre-token, by the merges of a byte-level BPE model whose ids follow
    the order of the merges (else None: the tokenizer itself is used)."""
    import tiktoken

    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback"):
        return None
    order = [vocab.get(a + b) for a, b in merges]
    if None in order or any(x >= y for x, y in zip(order, order[1:], strict=False)):
        return None
    # the printable stand-ins of bytes in byte-level vocabularies
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    made = {a + b for a, b in merges}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if (len(t) == 1 or t in made) and all(c in byte_of for c in t)}
    if sum(len(k) == 1 for k in ranks) != 256:
        return None
    return tiktoken.Encoding("pre-tokens", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
