"""Line deduplication with a log-template tree of fixed depth.

A line is parsed as its words between blanks, lower-cased; a word with a digit is a variable field. The tree's first
level is the number of words, the next DEPTH levels are the leading words; in a leaf, a line belongs to the template
of all its words and to four templates in which one quarter of the words after the leading ones is variable too, and
above the leaf to the one in which the leading words are (lines of GENERAL words or more). So lines that differ in
numbers, names or a phrase share a template. Merging a leaf's lines by similarity, as they arrive, would make the
templates depend on the order of rows and a leaf the work of one task; a fixed family of templates does neither.

A template found in `min_docs` documents or more is recurring, and so is that of all words of a line of `long_words`
words or more (if given) from two documents on; its lines are dropped from all documents but the one with the smallest
doc_id. Lines of fewer than `min_words` words are left alone: short lines (a heading, a date, a one-line document)
recur without being boilerplate; the README has figures.

All templates of a batch come from prefix sums over word hashes. Templates are counted over all documents (combined
before the shuffle). Recurring ones are broadcast, 16 bytes each, while they are at most `broadcast_rows`; beyond that,
lines join them by shuffle, to the same result.

Defined results: a null text stays null with no lines; an empty text has one empty line; a text whose lines all go
becomes empty; a null doc_id counts as larger than all others; repeated rows are documents of their own, and those
with the smallest doc_id all keep the lines; other columns are left as they are (`keep`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import lean, stash, tune
from ._text import SOLID, Words, _power, buffer, mix, slices

U64 = np.uint64
DEPTH = 3
GENERAL = 8
#: The queries' `long_words`.
LONG = 50
NO_ID = 2**63 - 1
_VARIABLE = U64(0x6A09E667F3BCC909)
_MARKS = [U64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(1, 7)]


def _templates(part: pa.RecordBatch, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template, line) pairs; text of each line; byte span of each line; words of each pair's line, 0 in general templates."""
    data, offs = buffer(part.column("text"))
    w = Words(data, offs, SOLID)
    h = w.hashes()
    digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    h = np.where(digits[w.end] > digits[w.start], _VARIABLE, h) if len(h) else h
    cut = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate((offs[:-1], cut + 1)))  # an empty text has one line
    text = np.repeat(np.arange(len(offs) - 1), 1 + np.diff(np.searchsorted(cut, offs)))
    stop = np.empty_like(begin)
    last = np.concatenate((text[1:] != text[:-1], [True])) if len(text) else np.zeros(0, bool)
    stop[last] = offs[1:]
    stop[~last] = begin[1:][~last[:-1]] - 1
    a, b = np.searchsorted(w.start, begin), np.searchsorted(w.start, stop)
    n = b - a
    r, inv = _power(len(h) + 1)
    c = np.zeros(len(h) + 1, U64)
    np.cumsum(h * r[: len(h)], out=c[1:])
    line = np.flatnonzero(n >= min_words)
    keys, lines = [], []
    seal = lambda total, at, k: mix(total * inv[a[at]] + n[at].astype(U64) * _MARKS[5] + (_MARKS[k - 1] if k else U64(0)))
    keys.append(seal(c[b[line]] - c[a[line]], line, 0))
    lines.append(line)
    words = n[line]
    line = np.flatnonzero(n >= max(min_words, GENERAL))
    for k in range(5):
        rest = n[line] - DEPTH
        lo, hi = (a[line] + DEPTH + rest * k // 4, a[line] + DEPTH + rest * (k + 1) // 4) if k < 4 else (a[line], a[line] + DEPTH)
        keys.append(seal(c[b[line]] - c[a[line]] - (c[hi] - c[lo]), line, k + 1))
        lines.append(line)
    return np.concatenate(keys), np.concatenate(lines), text, begin, stop, np.concatenate((words, np.zeros(5 * len(line), words.dtype)))


def recurring(docs: DataFrame, *, min_docs: int = 3, min_words: int = 5, long_words: int | None = None) -> DataFrame:
    """(template, n, first): recurring templates, their number of documents and smallest doc_id."""
    tune(docs.sparkSession)
    least = long_words or NO_ID

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                key, line, text, _, _, words = _templates(part, min_words)
                if not len(key):
                    continue
                doc = text[line]
                o = np.lexsort((doc, key))
                key, doc, words = key[o], doc[o], words[o]
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
                key, ids, words = key[new], part.column("d").to_numpy()[doc[new]], words[new]
                at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                n = np.diff(np.concatenate((at, [len(key)])))
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(n), pa.array(np.minimum.reduceat(ids, at)), pa.array(words[at] >= least)], ["template", "n", "d", "long"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), "text").mapInArrow(lean(count), "template long, n long, d long, long boolean")
    found = rows.groupBy("template").agg(F.sum("n").alias("n"), F.min("d").alias("first"), F.max("long").alias("long"))
    return found.where((F.col("n") >= min_docs) | (F.col("long") & (F.col("n") >= 2))).drop("long")


def drop_lines(docs: DataFrame, *, min_docs: int = 3, min_words: int = 5, long_words: int | None = None, keep: tuple[str, ...] = ("doc_id",), broadcast_rows: int = 2_000_000) -> DataFrame:
    """Per document: the columns `keep`, text with the recurring lines dropped, n_lines, n_dropped."""
    spark = docs.sparkSession
    found = stash(recurring(docs, min_docs=min_docs, min_words=min_words, long_words=long_words).select("template", "first"), "templates")
    names = [c for c in keep if c != "text"]
    rows = docs.select(*names, "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"))
    out = [*(rows.schema[c] for c in names), rows.schema["text"]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", n_lines long, n_dropped long"
    columns = [f.name for f in out] + ["n_lines", "n_dropped"]

    def rebuilt(part: pa.RecordBatch, gone: np.ndarray, text: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
        data, _ = buffer(part.column("text"))
        null = part.column("text").is_null().to_numpy(zero_copy_only=False)
        first = np.searchsorted(text, np.arange(part.num_rows + 1))
        lost = np.bincount(text[gone], minlength=part.num_rows)
        texts = part.column("text").to_pylist()
        for i in np.flatnonzero(lost).tolist():
            kept = [k for k in range(first[i], first[i + 1]) if not gone[k]]
            texts[i] = b"\n".join(data[begin[k] : stop[k]].tobytes() for k in kept).decode()
        new = [pa.array(texts, part.schema.field("text").type), pa.array(np.where(null, 0, np.diff(first))), pa.array(lost)]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *new], columns)

    if found.count() <= broadcast_rows:
        table = found.toArrow()
        key, first = (table.column(c).to_numpy() for c in ("template", "first"))
        o = np.argsort(key.view(U64)) if len(key) else np.zeros(0, np.int64)
        bits = np.zeros(1 << 22, bool)
        bits[key.view(U64) >> U64(42)] = True
        shared = spark.sparkContext.broadcast((key.view(U64)[o] if len(key) else np.zeros(1, U64), first[o] if len(key) else np.full(1, NO_ID), bits))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, keeper, bits = shared.value
            for batch in batches:
                for part in slices(batch):
                    key, line, text, begin, stop, _ = _templates(part, min_words)
                    may = bits[key >> U64(42)]
                    key, line = key[may], line[may]
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    hit = (known[at] == key) & (keeper[at] != part.column("_d").to_numpy()[text[line]])
                    gone = np.zeros(len(text), bool)
                    gone[line[hit]] = True
                    yield rebuilt(part, gone, text, begin, stop)

        return rows.mapInArrow(lean(apply), schema)

    rows = stash(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                key, line, text, *_ = _templates(part, min_words)
                first = np.searchsorted(text, np.arange(part.num_rows))
                row, d = (part.column(c).to_numpy()[text[line]] for c in ("_row", "_d"))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(row), pa.array(d), pa.array(line - first[text[line]])], ["template", "_row", "d", "line"])

    hits = rows.select("_row", "_d", "text").mapInArrow(lean(lines_of), "template long, _row long, d long, line long").join(found, "template").where("first <> d")
    hits = hits.groupBy("_row").agg(F.collect_set("line").alias("_gone"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, _, text, begin, stop, _ = _templates(part, min_words)
                first, gone = np.searchsorted(text, np.arange(part.num_rows)), np.zeros(len(text), bool)
                for i, x in enumerate(part.column("_gone").to_pylist()):
                    gone[[int(first[i]) + k for k in x or ()]] = True
                yield rebuilt(part, gone, text, begin, stop)

    return rows.join(hits, "_row", "left").mapInArrow(lean(remove), schema)
