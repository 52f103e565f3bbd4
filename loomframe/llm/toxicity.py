"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes (`2**bits` buckets) of its words, pairs of neighbours and pairs with one
word between, each with the value scale / sqrt(1 + 3 * words); those of fewer than `min_docs` sampled texts are left
out. Training reads a bounded sample: `per_class` labelled documents of each label, by a hash, one row of each (that
whose text has the smallest hash), and of a text with more features the `row_features` with the smallest hashes. It
makes one pass after another of FTRL-proximal: per-coordinate rates, and an L1 term that leaves few weights, which are
broadcast (at most 2**bits numbers). Scoring is one map over all texts, with all their features.

Defined results: a null text is empty; a text without words gets the bias alone; without labelled rows of both
classes every score is 0; a null doc_id counts as held out; a null label is ignored, and of several labels of a
document the largest holds; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import lean, tune
from ._text import ALNUM, Words, buffer, inside, shingles, slices

GRAMS = ((0,), (0, 1), (0, 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) == 0


SCALE = 16.0


def _features(part: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, row) of a batch's texts, with repeats, and the value that each row's features have."""
    w = Words(*buffer(part.column("text")), ALNUM)
    h = w.hashes()
    idx, at = [], []
    for skips in GRAMS:
        g = shingles(h, len(skips), skips)
        ok = np.flatnonzero(inside(w.first, skips[-1] + 1))
        idx.append((g[ok] >> np.uint64(64 - bits)).astype(np.int64))
        at.append(np.searchsorted(w.first, ok, "right") - 1)
    return np.concatenate(idx), np.concatenate(at), SCALE / np.sqrt(1 + 3 * np.diff(w.first))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", bits: int = 20, per_class: int = 5000, row_features: int = 10_000, passes: int = 8, min_docs: int = 3, alpha: float = 3.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.0) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, features, weights). Labels of held-out documents are not read."""
    spark = docs.sparkSession
    tune(spark)
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max(label) >= 1).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                idx, at, x = _features(part, bits)
                pair = np.unique(at << bits | idx)
                cut = np.searchsorted(pair >> bits, np.arange(part.num_rows + 1))
                if np.diff(cut).max(initial=0) > row_features:
                    pair = np.concatenate([pair[a : min(b, a + row_features)] for a, b in zip(cut, cut[1:], strict=False)])
                    x = np.where(np.diff(cut) > row_features, SCALE / np.sqrt(1 + row_features), x)
                    cut = np.searchsorted(pair >> bits, np.arange(part.num_rows + 1))
                rows = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((pair & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("y"), rows, pa.array(x)], ["h", "y", "f", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            f, cut = b.column("f").values.to_numpy(), b.column("f").offsets.to_numpy()
            rows += [(y, x, f[cut[k] : cut[k + 1]]) for k, (y, x) in enumerate(zip(b.column("y").to_pylist(), b.column("x").to_pylist(), strict=True))]
        if len({y for y, *_ in rows}) == 2:
            often = np.bincount(np.concatenate([f for *_, f in rows]), minlength=(1 << bits) + 1) >= min_docs
            rows = [(y, x, np.append(f[often[f]], 1 << bits)) for y, x, f in rows]  # the last feature is the bias
            z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
            for _ in range(passes):
                for y, x, f in rows:
                    zf, root = z[f], np.sqrt(n[f])
                    shrink = np.full(len(f), l1)
                    shrink[-1] = 0
                    w = np.where(np.abs(zf) <= shrink, 0, (np.sign(zf) * shrink - zf) / ((beta + root) / alpha + l2))
                    g = (1 / (1 + np.exp(-np.clip(w.sum() * x, -35, 35))) - y) * x
                    z[f] = zf + g - (np.sqrt(n[f] + g * g) - root) / alpha * w
                    n[f] += g * g
            shrink = np.full(len(z), l1)
            shrink[-1] = 0
            w = np.where(np.abs(z) <= shrink, 0, (np.sign(z) * shrink - z) / ((beta + np.sqrt(n)) / alpha + l2))
            at = np.union1d(np.flatnonzero(w), [1 << bits])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["f", "w"])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * per_class keys at most
    sample = sample.groupBy("doc_id", "h", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # and so many rows
    features = sample.mapInArrow(lean(extract), "h long, y int, f array<int>, x double").repartition(1).sortWithinPartitions("h", "y", "f")
    rows = features.mapInArrow(lean(learn), "f long, w double").collect()
    if not rows:
        return -np.inf, np.zeros(0, np.int64), np.zeros(0)
    f, w = np.array([r.f for r in rows]), np.array([r.w for r in rows])
    order = np.argsort(f)
    f, w = f[order], w[order]
    return float(w[-1]), f[:-1], w[:-1]


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], *, bits: int = 20) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, f, w = shared.value
        weight = np.zeros(1 << bits)
        weight[f] = w
        for batch in batches:
            for part in slices(batch):
                idx, at, x = _features(part, bits)
                ok = np.flatnonzero(weight[idx])
                pair = np.unique(at[ok] << bits | idx[ok])
                total = (bias + np.bincount(pair >> bits, weight[pair & ((1 << bits) - 1)], part.num_rows)) * x if np.isfinite(bias) else np.full(part.num_rows, -np.inf)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.where(np.isfinite(total), 1 / (1 + np.exp(-np.clip(total, -700, 700))), 0.0))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(apply), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options), bits=options.get("bits", 20))
