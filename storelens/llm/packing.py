"""Packing (operator 7) by minimum bin slack.

Documents become token ids (one closing id each).  Whole windows are cut off
first; what remains of each document has a length below the window.  Only the
counts of those lengths (at most ``window - 1`` numbers) go to the driver, which
plans sequences: the longest remaining length opens one, a bitset dynamic
program over the counted lengths finds the fill closest to the window, and
backtracking gives how many of each length it takes.  The same fill is repeated
as often as the counts allow.  Where a fill leaves slack, one more length is cut
to close it and its tail goes back to the counts, so only the last sequence is padded.

The plan numbers the members of each length; a remainder finds its place by its
number, in its own task.  Numbers are a task's own count plus a running sum
over tasks, so equal lengths (many copies) meet in no single task.

Defined cases: a null or empty text is its closing id alone; equal rows are
packed apiece; null ids pass; an empty table gives no piece; other columns are
not carried (join on the id).  Texts are encoded whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storelens.llm.common import by_bytes, keep
from storelens.llm.tokens import worker_encoder

WINDOW = 1024
CLOSING_ID = 0
TEXT_BYTES = 1 << 20  # of texts encoded at once
TASKS = 1000  # whose running numbers are reckoned together
SENT_TASKS = 500_000  # rows of the tasks' numbers that are broadcast (8 MB); more are joined by a shuffle


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length come closest to ``capacity`` without exceeding it.

    Bit t of ``reach`` says that the lengths so far can add up to t; the state
    before each chunk of equal lengths is kept for the way back.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for size in sorted((s for s, n in counts.items() if n and s <= capacity), reverse=True):
        left, chunk = min(counts[size], capacity // size), 1
        while left and not reach >> capacity & 1:
            take = min(chunk, left)
            steps.append((size, take, reach))
            reach |= reach << (take * size) & mask
            left -= take
            chunk *= 2
        if reach >> capacity & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            total -= size * take
            out[size] = out.get(size, 0) + take
    return out


@dataclass(frozen=True)
class Plan:
    """Where the members of each length go.

    Row i covers the members ``key[i] = length << 40 | first number`` up to the next
    row of that length; each ``sequence[i]``-based sequence takes ``per[i]`` of them
    from ``offset[i]`` on.  ``head[i]`` > 0: the member is cut after so many ids
    and its tail is member ``tail[i] + j`` of the shorter length.
    """

    key: np.ndarray
    sequence: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    n_sequences: int

    def place(self, length: int, number: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of each piece of a remainder, in its order."""
        out = []
        while True:
            i = int(np.searchsorted(self.key, (length << 40) | number, side="right")) - 1
            j = number - (int(self.key[i]) & ((1 << 40) - 1))
            per, head = int(self.per[i]), int(self.head[i])
            if not head:
                out.append((length, int(self.sequence[i]) + j // per, int(self.offset[i]) + j % per * length))
                return out
            out.append((head, int(self.sequence[i]) + j, int(self.offset[i])))
            length, number = length - head, int(self.tail[i]) + j


def plan_sequences(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """Minimum bin slack over the counted lengths; the work depends on the window, not on the counts' size."""
    left = {s: n for s, n in counts.items() if n}
    used = dict.fromkeys(left, 0)  # members given a place so far
    rows, sequence = [], 0
    sizes = [-s for s in left]
    heapq.heapify(sizes)
    while sizes:
        top = -sizes[0]
        if not left.get(top):
            heapq.heappop(sizes)
            continue
        left[top] -= 1
        rest = fill(left, window - top)
        left[top] += 1
        take = {top: 1}
        for s, n in rest.items():
            take[s] = take.get(s, 0) + n
        slack = window - sum(s * n for s, n in take.items())
        cut = max((s for s, n in left.items() if s > slack and n > take.get(s, 0)), default=0) if slack else 0
        need = take | {cut: take.get(cut, 0) + 1} if cut else take
        times = min(left[s] // n for s, n in need.items())
        offset = 0
        for s in sorted(take, reverse=True):
            rows.append((s << 40 | used[s], sequence, take[s], offset, 0, 0))
            offset += s * take[s]
            used[s] += take[s] * times
            left[s] -= take[s] * times
        if cut:
            tail = cut - slack
            if tail not in used:
                used[tail], left[tail] = 0, 0
            if not left[tail]:
                heapq.heappush(sizes, -tail)
            rows.append((cut << 40 | used[cut], sequence, 1, offset, slack, used[tail] + left[tail]))
            used[cut] += times
            left[cut] -= times
            left[tail] += times
        sequence += times
    rows.sort()
    cols = [np.array([r[k] for r in rows], dtype=np.int64) for k in range(6)]
    return Plan(*cols, sequence)


def encode(docs: DataFrame, tokenizer: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its whole windows and its remainder (ids as little-endian unsigned
    bytes), its count, and its numbers within the task: remainders of that length
    and whole windows before it."""
    schema = "doc_id bigint, doc_tokens bigint, whole binary, rest binary, rest_length int, part int, rest_number bigint, whole_before bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = worker_encoder(tokenizer), TaskContext.get().partitionId()
        seen, whole_seen = np.zeros(window, dtype=np.int64), 0
        for b in by_bytes(batches, "text", TEXT_BYTES):
            rows = []
            for i, ids in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(CLOSING_ID)).astype("<u4")
                cut = len(ids) // window * window
                r = len(ids) - cut
                rows.append((i, len(ids), ids[:cut].tobytes(), ids[cut:].tobytes(), r, part, int(seen[r]), whole_seen))
                seen[r] += 1
                whole_seen += cut // window
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                names=[c.split(" ")[0] for c in schema.split(", ")])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    Sequences have at most ``window`` ids; sequence ids and offsets are gapless from 0.
    """
    kept = keep(encode(docs, tokenizer, window, doc_id, text))  # encoding is the costly step: it runs once
    # numbers of remainders over all tasks: a running sum of the tasks' counts, for each length
    per = kept.where("rest_length > 0").groupBy("rest_length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("rest_length").orderBy("part")
    per = per.select("rest_length", "part", "n", (F.sum("n").over(before) - F.col("n")).alias("base"))
    counts = {r["rest_length"]: r["n"] for r in per.groupBy("rest_length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_sequences(counts, window)

    piece = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    names = [c.split(" ")[0] for c in piece.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, total, ids, number in zip(*[c.to_pylist() for c in b.columns], strict=True):
                at, first = 0, total - len(ids) // 4
                for length, sequence, offset in plan.place(len(ids) // 4, number):
                    rows.append((i, first + at, length, ids[4 * at:4 * (at + length)], total, sequence, offset))
                    at += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    short = kept.where("rest_length > 0").select("doc_id", "doc_tokens", "rest", "rest_length", "part", "rest_number")
    short = short.join(per.select("rest_length", "part", "base"), ["rest_length", "part"]).select(
        "doc_id", "doc_tokens", "rest", (F.col("base") + F.col("rest_number")).alias("number")).mapInArrow(rests, piece)

    # whole windows: one sequence each, numbered after the planned ones by a running sum over tasks; one number a TASKS tasks reaches the driver
    tasks = kept.groupBy("part").agg(F.sum(F.octet_length("whole") / (4 * window)).cast("long").alias("n")).withColumn("run", F.floor(F.col("part") / TASKS))
    starts, at = [F.lit(-1), F.lit(0)], plan.n_sequences
    for r in tasks.groupBy("run").agg(F.sum("n").alias("n")).orderBy("run").collect():
        starts += [F.lit(r["run"]), F.lit(at)]
        at += r["n"]
    within = F.sum("n").over(W.partitionBy("run").orderBy("part")) - F.col("n")
    tasks = keep(tasks.select("part", (F.try_element_at(F.create_map(*starts), F.col("run")) + within).alias("begin")))
    tasks = F.broadcast(tasks) if tasks.count() <= SENT_TASKS else tasks

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "whole", TEXT_BYTES):
            rows = []
            for i, total, ids, number in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for k in range(len(ids) // (4 * window)):
                    rows.append((i, k * window, window, ids[4 * k * window:4 * (k + 1) * window], total, number + k, 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    long = kept.where("doc_tokens >= " + str(window)).join(tasks, "part").select(
        "doc_id", "doc_tokens", "whole", (F.col("begin") + F.col("whole_before")).alias("number")).mapInArrow(wholes, piece)
    return short.unionByName(long)
