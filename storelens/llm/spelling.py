"""Spelling variant grouping (operator 13): words of a corpus one edit apart, and the form each belongs to.

1. ``vocabulary``: the counted words of all texts, in one native pass.
2. One edit lies either behind or before the middle of the shorter word, so two near
   words share the first half of it or the rest.  ``groups`` deals each word by both
   (class of the shorter word's length, fixed beginning, fixed end, free middle).  A group
   of more than ``LIMIT`` words is halved again in the same way, up to a middle of one
   letter, where the alphabet bounds it: no group grows with the data, no pair is lost,
   and each pair has one group that owns it.
3. ``near_pairs`` scans each group's sorted list of middles.  Adjacent LCPs cut the list
   into ranges that share a prefix; a range's banded row of the edit matrix (three cells,
   coded as one number) is reckoned once from that of the range around it and reused by
   all its words, and a range whose row exceeds one edit is skipped as a whole.  The scan
   goes column by column for many query words at once.
4. Counts and best near words are added up over a word's groups; the last form is
   reached by pointer jumping (counts at least double, so six rounds suffice).

Defined cases: null or empty texts have no words; a null doc_id counts as an empty string
before the colon; repeated rows count again; an empty table gives an empty table; other
columns are not read, whatever their names.  Equal words are one word: ties of count go to
the form first in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import ascii_lower, keep

MIN_LENGTH, MIN_COUNT, NOISE = 5, 3, 97
LIMIT = 10_000  # words of a group; above what a middle of one letter can hold (90 + 90 * 90)
FRONTIER = 3_000_000  # bound on list entries that the queries of one block can meet
KEY = ["l", "a", "b", "pre", "suf"]
NEAR = "word string, n_near long, form string, form_n long"


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters, lower-cased, some with a letter lost, of 5 letters and 3 occurrences or more."""
    run = F.col("run")
    # a run that is too short before the loss of a letter is so after it
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(ascii_lower(F.col("text")), F.lit("[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length(run)).cast("int")
    lost = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    words = hashed.select(F.when(F.col("h") % NOISE == 0, lost).otherwise(run).alias("word"))
    return words.where(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row of a group twice: with the first half of its middle fixed, and with the rest fixed."""
    m = F.col("l") - F.col("a") - F.col("b")
    first = F.floor(m / 2).cast("int")
    rest, free = m - first, F.char_length("mid")
    begin = F.struct((F.col("a") + first).alias("a"), F.col("b"), F.concat("pre", F.substring("mid", F.lit(1), first)).alias("pre"),
                     F.col("suf"), F.substring(F.col("mid"), first + 1, free).alias("mid"))
    end = F.struct(F.col("a"), (F.col("b") + rest).alias("b"), F.col("pre"),
                   F.concat(F.substring(F.col("mid"), free - rest + 1, rest), F.col("suf")).alias("suf"), F.substring(F.col("mid"), F.lit(1), free - rest).alias("mid"))
    return rows.select("l", "n", F.explode(F.array(begin, end)).alias("h")).select("l", "h.a", "h.b", "h.pre", "h.suf", "h.mid", "n")


def groups(words: DataFrame) -> DataFrame:
    """(l, a, b, pre, suf, mid, n): every word in all groups where its near words can be."""
    size = F.char_length("word")
    classes = F.explode(F.when(size > MIN_LENGTH, F.array(size - 1, size)).otherwise(F.array(size)))
    whole = words.select(classes.alias("l"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("").alias("pre"), F.lit("").alias("suf"), F.col("word").alias("mid"), "n")
    open_, done = _halves(whole), []
    while True:
        large = keep(open_.where(F.col("l") - F.col("a") - F.col("b") > 1).groupBy(*KEY).count().where(F.col("count") > LIMIT).drop("count"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, open_])
        done.append(open_.join(large, KEY, "left_anti"))
        open_ = keep(_halves(open_.join(large, KEY, "left_semi").select(*KEY, "mid", "n")))


def _tables():
    """The next row of the band for (row, matches), and whether a row still has a cell of at most one edit.

    A row holds the distances of the list's prefix of j letters to the query's first j - 1, j and j + 1
    letters, each 0, 1 or 2 (more), as one number to base 3.  Matches: does the next letter of the list equal
    the query's letters j - 1, j, j + 1 (bits 0, 1, 2).  ``alive[row, k]``: k letters of the query (0: one
    too few, 1: none, 2: some) lie behind the middle cell.
    """
    import numpy as np

    step, alive = np.zeros(27 * 8, dtype=np.uint8), np.zeros((27, 3), dtype=bool)
    for row in range(27):
        a, b, c = row // 9, row // 3 % 3, row % 3
        alive[row] = [a <= 1, min(a, b) <= 1, min(a, b, c) <= 1]
        for bits in range(8):
            x = min(a + 1 - (bits & 1), b + 1, 2)
            y = min(b + 1 - (bits >> 1 & 1), c + 1, x + 1, 2)
            z = min(c + 1 - (bits >> 2 & 1), y + 1, 2)
            step[row * 8 + bits] = x * 9 + y * 3 + z
    return step, alive


_START = 2 * 9 + 0 * 3 + 1  # before any letter: none, 0, 1


def near_pairs(mids: list[str], group, middle, ends):
    """(query, other) indexes of words one edit apart that their group owns.

    ``group``: its number for each word, ascending, the words of one sorted; ``middle``: letters
    free in its class; ``ends``: its end is fixed.  A word of ``middle`` letters is a query, one
    with a letter more is only found.
    """
    import numpy as np

    step, alive = _tables()
    n = len(mids)
    size = np.fromiter(map(len, mids), dtype=np.int64, count=n)
    codes = np.frombuffer(("\0" + "\0\0".join(mids) + "\0\0\0\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    off = np.cumsum(size + 2) - size - 1
    lcp = np.zeros(n, dtype=np.int64)
    fresh = np.append(True, group[1:] != group[:-1])
    same, j = np.flatnonzero(~fresh), 0
    while len(same):
        c = codes[off[same] + j]
        same = same[(c == codes[off[same - 1] + j]) & (c != 0)]
        lcp[same] += 1
        j += 1
    lcp[fresh] = -1
    starts0 = np.flatnonzero(fresh)
    at0 = np.cumsum(fresh) - 1
    queries = np.flatnonzero(size == middle)
    load = np.cumsum(np.diff(np.append(starts0, n))[at0[queries]])
    found = []
    for block in np.split(queries, np.searchsorted(load, np.arange(FRONTIER, load[-1] if len(load) else 0, FRONTIER))):
        fq, fn, fs = block, at0[block], np.full(len(block), _START, dtype=np.int64)
        starts, within, j = starts0, np.flatnonzero(size > 0), 0
        while len(fq):
            deeper = within[lcp[within] < j + 1]  # where ranges that share j + 1 letters begin
            lo = np.searchsorted(deeper, starts)
            hi = np.append(lo[1:], len(deeper))
            k = (hi - lo)[fn]
            rep = np.repeat(np.arange(len(fq)), k)
            child = lo[fn][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(k) - k, k)
            w, q, row = deeper[child], fq[rep], fs[rep]
            c, here = codes[off[w] + j], off[q] + j
            bits = (c == codes[here - 1]) | (c == codes[here]) << 1 | (c == codes[here + 1]) << 2
            new = step[row * 8 + bits].astype(np.int64)
            left = middle[q] - (j + 1)
            ok = (left >= -1) & alive[new, np.clip(left, -1, 1) + 1]
            w, q, row, new, left, child = w[ok], q[ok], row[ok], new[ok], left[ok], child[ok]
            # a list word that ends here: one edit, and not one that another group owns
            hit = (size[w] == j + 1) & (((left == 0) & (new // 3 % 3 == 1)) | ((left == -1) & (new // 9 == 1) & ~(ends[q] & (row // 3 % 3 == 0))))
            found.append((q[hit], w[hit]))
            fq, fn, fs, starts = q, child, new, deeper
            within = within[size[within] > j + 1]
            j += 1
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (list(zip(*found, strict=True)) or [(), ()]))


def _scan(batches) -> Iterator:
    """Groups as they come, sorted, to the near words of each word in its group."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def changes(t: pa.Table) -> np.ndarray:
        """Where another group begins than that of the row before."""
        out = np.zeros(t.num_rows, dtype=bool)
        out[:1] = True
        for name in KEY:
            c = t.column(name).combine_chunks()
            out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        return out

    def found(t: pa.Table, begins: np.ndarray) -> pa.RecordBatch | None:
        number = np.cumsum(begins) - 1
        some = np.flatnonzero(np.bincount(number)[number] > 1)  # a word alone in its group has no near one there
        if not len(some):
            return None
        t, number = t.take(pa.array(some)), number[some]
        l, a, b, n = (t.column(c).to_numpy() for c in ("l", "a", "b", "n"))
        pre, mid, suf = (t.column(c).to_pylist() for c in ("pre", "mid", "suf"))
        q, w = near_pairs(mid, number, l - a - b, b > 0)
        if not len(q):
            return None
        longer = (l - a - b)[w] < np.fromiter((len(mid[i]) for i in w), dtype=np.int64, count=len(w))
        target, other = np.concatenate((q, w[longer])), np.concatenate((w, q[longer]))
        used = np.unique(target)  # being near is mutual: these are the others too
        word = {int(i): pre[i] + mid[i] + suf[i] for i in used}
        rank = np.zeros(len(mid), dtype=np.int64)
        ordered = sorted(word, key=word.get)
        rank[ordered] = np.arange(len(ordered))
        order = np.lexsort((rank[other], -n[other], target))
        target, other = target[order], other[order]
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        counts = np.diff(np.append(first, len(target)))
        return pa.RecordBatch.from_arrays([
            pa.array([word[int(i)] for i in target[first]], pa.string()), pa.array(counts, pa.int64()),
            pa.array([word[int(i)] for i in other[first]], pa.string()), pa.array(n[other[first]], pa.int64())], names=["word", "n_near", "form", "form_n"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        begins = changes(t)
        cut = int(np.flatnonzero(begins)[-1])  # the last group may go on
        rest = t.slice(cut)
        if cut and (out := found(t.slice(0, cut), begins[:cut])) is not None:
            yield out
    if rest is not None and (out := found(rest, changes(rest))) is not None:
        yield out


def roots(linked: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows: the last of the forms from each word."""
    out = linked.select("word", F.col("form").alias("root"))
    while True:
        out = keep(out)
        up = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if out.join(up, "root", "left_semi").isEmpty():
            return out
        out = out.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every word of the texts' vocabulary."""
    words = keep(vocabulary(docs.select("doc_id", "text")))
    dealt = groups(words).repartition(*KEY).sortWithinPartitions(*KEY, "mid")
    near = dealt.mapInArrow(_scan, NEAR).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form"))).alias("best"))
    chosen = -F.col("best.m") >= 2 * F.col("n")
    out = keep(words.join(near, "word", "left").select("word", "n", F.when(chosen, F.col("best.form")).alias("form"),
                                                       F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, -F.col("best.m")).alias("form_n")))
    last = roots(out.where("form is not null").select("word", "form"))
    return out.join(last, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
