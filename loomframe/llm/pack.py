"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

Only the histogram of piece lengths (at most `size` numbers) reaches the driver, so the packing plan is made for whole
multiplicities: a plan entry says "`times` sequences, each holding pieces of these lengths". First the reduction
fixes sets of one to three pieces that dominate every alternative for their longest piece:

* nothing else fits beside the longest piece: it stays alone;
* one other piece fills the sequence exactly: that pair;
* no two others fit beside it: the pair with the largest piece that fits;
* the largest piece that fits is at least as long as the best two that fit, and no three others fit: that pair;
* no three others fit, and of the pieces longer than the one that completes the largest piece that fits, no two fit:
  the three, as any other two that fit have a longer and a shorter piece at most as long as these.

Each rule replaces any other filling of the sequence by one at least as good: the pieces that the alternative would
have used can take the place of the fixed partner.

What no rule decides is packed by best-fit decreasing, simulated on multiplicities. Pieces then take the places of
the plan by their rank among the pieces of their length: ranks come from counts per task and length, so no length,
however common, meets in one task.

Defined results: a null text is empty and is one piece holding just the end id; repeated rows are packed each; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import lean, stash, tune
from ._tokens import MEMORY, Encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def pieces(docs: DataFrame, tokenizer: str, *, end_id: int = 2, size: int = 1024, keep_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """Pieces of at most `size` ids with their place in the document; only the first piece of a longer document is shorter. rank: number among the task's pieces of the same length."""
    tune(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = Encoder.of(tokenizer, end_id, memory), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for doc, b in zip(batch.column("doc_id").to_pylist(), enc.ids(texts), strict=True):
                n = len(b) // 4
                at, k, to = 0, 0, (n - 1) % size + 1
                while at < n:
                    ids = b[4 * at : 4 * to]
                    rows.append((doc, k, at, to - at, zlib.crc32(ids), task, int(seen[to - at]), ids)[: 8 if keep_ids else 7])
                    seen[to - at] += 1
                    at, to, k = to, to + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][: 8 if keep_ids else 7]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"][: len(kinds)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(cut, encodes=True), PIECES + (", ids binary" if keep_ids else ""))


class Plan:
    """Patterns with multiplicities: parts [(lengths, times)], in the order of their sequence ids."""

    def __init__(self) -> None:
        self.parts: list[tuple[tuple[int, ...], int]] = []

    def add(self, lengths: tuple[int, ...], times: int) -> None:
        if times > 0:
            self.parts.append((lengths, times))

    @property
    def sequences(self) -> int:
        return sum(t for _, t in self.parts)


def _largest(have: list[int], count: dict[int, int], room: int, but: tuple[int, ...] = ()) -> int:
    """The largest length up to `room` that is still there once `but` is taken; 0 if none. have: ascending lengths."""
    k = bisect.bisect_right(have, room) - 1
    while k >= 0:
        if count[have[k]] > but.count(have[k]):
            return have[k]
        k -= 1
    return 0


def _best_fill(have: list[int], count: dict[int, int], room: int, j: int) -> int:
    """The most that two or more pieces can fill of `room` beside one of length j: exact for pairs, `room` where three could fit."""
    left = lambda x: count[x] - (x == j)
    usable = [x for x in have[: bisect.bisect_right(have, room)] if left(x) > 0]
    least = [x for x in usable[:3] for _ in range(min(3, left(x)))][:3]
    if len(least) == 3 and sum(least) <= room:
        return room
    best, lo, hi = 0, 0, len(usable) - 1
    while lo <= hi:
        a, b = usable[lo], usable[hi]
        if a + b > room or (lo == hi and left(a) < 2):
            hi -= 1
            continue
        best = max(best, a + b)
        lo += 1
    return best


def _third(have: list[int], count: dict[int, int], room: int, j: int, k: int) -> int:
    """With k the largest piece beside j: the piece b that makes (j, k, b) dominate every other set with j; 0 if none."""
    least = [x for x in have[:4] for _ in range(min(4, count[x] - (x == j)))][:3]
    if len(least) == 3 and sum(least) <= room:
        return 0
    b = _largest(have, count, room - k, (j, k))
    if not b:
        return 0
    at = bisect.bisect_right(have, b)
    longer = [x for x in have[at : at + 3] for _ in range(min(2, count[x] - (x == j)))][:2]
    return 0 if len(longer) == 2 and sum(longer) <= room else b


def reduce(hist: dict[int, int], size: int, plan: Plan) -> dict[int, int]:
    """Fix dominating sets, longest pieces first, as long as a rule holds; returns the lengths that no rule decided."""
    count = {k: v for k, v in hist.items() if v > 0}
    have = sorted(count)

    def take(j: int, others: tuple[int, ...], times: int) -> None:
        plan.add((j, *others), times)
        for x in (j, *others):
            count[x] -= times
        for x in {j, *others}:
            if not count[x]:
                have.remove(x)  # ascending, at most `size` lengths

    for j in sorted(count, reverse=True):
        room = size - j
        while count[j]:
            k = _largest(have, count, room, (j,))
            if not k:
                take(j, (), count[j] if j > room else 1)
                continue
            # What a rule looks at still holds while copies are taken: counts only fall.
            if k == room or k >= _best_fill(have, count, room, j):
                take(j, (k,), count[j] // 2 if k == j else min(count[j], count[k]))
                continue
            if b := _third(have, count, room, j, k):
                take(j, (k, b), min(count[x] // n for x, n in Counter((j, k, b)).items()))
                continue
            break
    return {k: v for k, v in count.items() if v}


def best_fit(hist: dict[int, int], size: int, plan: Plan) -> None:
    """Best-fit decreasing over multiplicities: each piece goes to the fullest sequence that has room."""
    rooms: dict[int, list[list]] = {}  # room left: [pattern, times]
    order: list[int] = []  # ascending rooms in use

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if not times:
            return
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append([pattern, times])

    for s in sorted(hist, reverse=True):
        left = hist[s]
        while left:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                each = size // s
                put(size - each * s, (s,) * each, left // each)
                put(size - left % each * s, (s,) * (left % each), 1 if left % each else 0)
                break
            room = order[at]
            pattern, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            each = min(room // s, left)
            full = min(times, left // each)
            put(room, pattern, times - full)
            put(room - each * s, pattern + (s,) * each, full)
            left -= full * each
    for groups in rooms.values():
        merged = Counter()
        for pattern, times in groups:
            merged[pattern] += times
        for pattern, times in merged.items():
            plan.add(pattern, times)


def plan(hist: dict[int, int], size: int) -> Plan:
    out = Plan()
    best_fit(reduce(hist, size, out), size, out)
    return out


def _places(made: Plan, size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, offset of each run of places (a run: one place in each of `times` sequences)."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    first = 0
    for lengths, times in made.parts:
        at = 0
        for s in lengths:
            runs.setdefault(s, []).append((taken[s], first, at))
            taken[s] += times
            at += s
        first += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 2, size: int = 1024, keep_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept)."""
    spark = docs.sparkSession
    cut = stash(pieces(docs, tokenizer, end_id=end_id, size=size, keep_ids=keep_ids, memory=memory), "pieces")
    counts = stash(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    hist = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_places(plan(hist, size), size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = [*cut.columns[:5], *cut.columns[7:], "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length).tolist():
                me = np.flatnonzero(length == s)
                starts, first, at = runs[s]
                k = np.searchsorted(starts, rank[me], "right") - 1
                seq[me], off[me] = first[k] + rank[me] - starts[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), pa.array(seq), pa.array(off)], names)

    ranked = cut.join(base, ["task", "length"]).select(*cut.columns[:5], (F.col("rank") + F.col("base")).alias("rank"), *cut.columns[7:])
    return ranked.mapInArrow(lean(place), PIECES.split(", task")[0] + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long")
