"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of `window` words (a shorter item is one window). A window's set is its
word shingles, ordered by rarity in the corpus. Containment of the whole window needs all of its shingles, so its
necessary prefix is the one rarest shingle: documents are joined with the windows on that shingle only. The length
bound (the document has as many words as the window) and the positional bound (the shingle's place in the window
must leave room for the window in the document) cut candidates, and what is left is verified word by word.

The benchmark side is broadcast in blocks of at most `block_chars` characters of items; all documents meet each
block, so any benchmark fits and no document row is shuffled.

Defined results: null texts and texts without words have n_words 0 and no hit; items without words take no part; a
null item_id counts as the empty string; repeated items count once, repeated document rows each get a row; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import lean, stash, tune
from ._text import ALNUM, Words, buffer, inside, shingles, slices

SHINGLE = 5
_TABLE = 20  # log2 of the size of the prefilter over shingle hashes


def _arrays(items: list[tuple[str, str]], window: int):
    """Distinct windows of a block: {words: item ids}."""
    out: dict[bytes, set[str]] = defaultdict(set)
    for item_id, text in items:
        w = Words(*buffer(pa.array([text], pa.large_string())), ALNUM)
        n = len(w.start)
        words = [w.text(i) for i in range(n)]
        for i in range(max(n - window, 0) + 1 if n else 0):
            out[b" ".join(words[i : i + window])].add(item_id)
    return out


class _Block:
    """Windows with the hashes of their shingles; `prefix` maps a rarest shingle to its windows."""

    def __init__(self, windows: dict[bytes, set[str]]):
        self.words = list(windows)
        self.items = [sorted(windows[w]) for w in self.words]
        self.length = [w.count(b" ") + 1 for w in self.words]
        self.grams = []
        for w, n in zip(self.words, self.length, strict=True):
            h = Words(*buffer(pa.array([w.decode()], pa.large_string())), ALNUM).hashes()
            self.grams.append((min(n, SHINGLE), shingles(h, min(n, SHINGLE)).tolist()))
        self.sizes = sorted({k for k, _ in self.grams})
        self.prefix: dict[int, list[tuple[int, int]]] = {}

    def table(self, hashes) -> tuple[np.ndarray, np.ndarray]:
        known = np.unique(np.fromiter(hashes, np.uint64))
        bits = np.zeros(1 << _TABLE, bool)
        bits[known >> np.uint64(64 - _TABLE)] = True
        return known, bits

    def order(self, counts: dict[int, int]) -> None:
        for i, (_, grams) in enumerate(self.grams):
            _, g, at = min((counts.get(g, 0), g, at) for at, g in enumerate(grams))
            self.prefix.setdefault(g, []).append((i, at))


def _find(w: Words, h: np.ndarray, size: int, known: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of known shingles and their hashes."""
    g = shingles(h, size)
    at = np.flatnonzero(bits[g >> np.uint64(64 - _TABLE)] & inside(w.first, size)) if len(g) else np.zeros(0, np.int64)
    at = at[np.isin(g[at], known)] if len(at) else at
    return at, g[at]


def _rarity(docs: DataFrame, block: _Block) -> dict[int, int]:
    """How often each shingle of the block occurs in all documents."""
    known, bits = block.table(g for _, gs in block.grams for g in gs)
    shared = docs.sparkSession.sparkContext.broadcast((known, bits, block.sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits, sizes = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in slices(batch):
                w = Words(*buffer(part.column("text")), ALNUM)
                h = w.hashes()
                for size in sizes:
                    _, g = _find(w, h, size, known, bits)
                    total += np.bincount(np.searchsorted(known, g), minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["k", "n"])

    rows = docs.select("text").mapInArrow(lean(count), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {int(known[r.k]): r.n for r in rows}


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted, joined spans, flat."""
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _join(docs: DataFrame, block: _Block | None) -> DataFrame:
    """Add the block's hits to each document; all columns are kept."""
    block = block or _Block({})
    table = block.table(block.prefix)
    shared = docs.sparkSession.sparkContext.broadcast((block.words, block.items, block.length, block.prefix, sorted({block.grams[i][0] for v in block.prefix.values() for i, _ in v}), *table))
    schema = docs.schema
    names = schema.names

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, items, length, prefix, sizes, known, bits = shared.value
        for batch in batches:
            for part in slices(batch):
                w = Words(*buffer(part.column("text")), ALNUM)
                first = w.first
                spans = [list(zip(s[::2], s[1::2], strict=True)) if s else [] for s in part.column("_spans").to_pylist()]
                found = [set(x or ()) for x in part.column("_items").to_pylist()]
                h = w.hashes() if sizes else None
                for size in sizes:
                    at, g = _find(w, h, size, known, bits)
                    doc = np.searchsorted(first, at, "right") - 1
                    for p, gram, d in zip(at.tolist(), g.tolist(), doc.tolist(), strict=True):
                        for i, o in prefix[gram]:
                            s, n = p - o, length[i]
                            if min(n, SHINGLE) == size and s >= first[d] and s + n <= first[d + 1] and w.join(s, n) == words[i]:
                                spans[d].append((s - int(first[d]), s - int(first[d]) + n))
                                found[d].update(items[i])
                new = {"_words": pa.array(np.diff(first), pa.int64()), "_spans": pa.array([_merge(s) for s in spans], pa.list_(pa.int64())), "_items": pa.array([sorted(x) for x in found], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(n) if n not in new else None) for n in names], names)

    return docs.mapInArrow(lean(probe), schema)


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, block_chars: int = 8_000_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the columns `keep`, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (word spans, flat), hit_items."""
    tune(docs.sparkSession)
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).distinct()
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first().n
    n_blocks = max(1, -(-total // block_chars))
    cols = list(dict.fromkeys([*keep, "text"]))
    state = docs.select(*cols, F.lit(0).cast("long").alias("_words"), F.array().cast("array<long>").alias("_spans"), F.array().cast("array<string>").alias("_items"))
    for b in range(n_blocks):
        rows = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b)
        block = _Block(_arrays([tuple(r) for r in rows.collect()], window))
        if block.words:
            block.order(_rarity(state, block))
        state = _join(state, block)
        if b < n_blocks - 1:
            state = stash(state, "decontaminate")
    n_hit = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s")), lambda a, x: F.when(a.s < 0, F.struct(a.n.alias("n"), x.alias("s"))).otherwise(F.struct((a.n + x - a.s).alias("n"), F.lit(-1).cast("long").alias("s"))), lambda a: a.n)
    return state.select(
        *keep,
        F.col("_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
        F.col("_spans").alias("hit_spans"),
        F.col("_items").alias("hit_items"),
    )
