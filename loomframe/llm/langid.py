"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: each of its slots holds a bit per language (bit-sliced), and the AND of an
n-gram's slots gives at once every language that contains the n-gram. Per language the hits over a text's n-grams are
counted (popcounts) and corrected for the false positives that the filter's filling makes likely:
(hits - n * p) / (1 - p) with p = fill ** hashes. The largest corrected count decides.

n-grams are `n` bytes of the lower-cased UTF-8 text, every ASCII byte that is no letter being a blank. A language's
set holds all n-grams found in at least `min_share` of its sampled texts; the filter has as many slots as the largest
set needs (SLOTS for each of its n-grams, `bits` at least). Training reads a bounded sample: about `per_language`
distinct texts of each language, chosen by a hash of the text. Prediction is one map over all texts.

A model's size is its languages times its slots, so a table with more than `max_languages` values of lang is refused.

Defined results: `und` with score 0 for a null text or one without a letter; a text with letters but without a known
n-gram has score 0, too; ties go to the language with more training texts, then the smaller name; without training
rows every text is `und`; a null doc_id counts as held out; repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import lean, tune
from ._text import LOWER, buffer, mix, slices

U64 = np.uint64
_ODD = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5)]
#: Slots of the filter for an n-gram of the largest set: 16 make 1.4 % false positives with two hashes.
SLOTS = 16
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_CLEAN = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)[LOWER]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) == 0


def _grams(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash per n-gram, first n-gram of each text and the total); n - 1 blanks before each text and after the last, so
    that no n-gram has characters of two texts."""
    rows = len(offs) - 1
    padded = np.full(len(data) + rows * (n - 1) + n, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(rows) + 1, np.diff(offs)) * (n - 1)
    padded[at] = _CLEAN[data]
    total = len(data) + rows * (n - 1)
    code = np.zeros(total, U64)
    for k in range(n):
        code |= padded[k : k + total].astype(U64) << U64(8 * k)
    return mix(code * _ODD[0]), offs + np.arange(rows + 1) * (n - 1)


def _has_letter(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    low = LOWER[data]
    sums = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
    out = sums[offs[1:]] > sums[offs[:-1]]
    for i in np.flatnonzero(~out & (offs[1:] > offs[:-1])).tolist():
        out[i] = any(c.isalpha() for c in bytes(data[offs[i] : offs[i + 1]]).decode("utf-8", "replace"))
    return out


class Filter:
    """The slots' language masks (a column of 64 bits per 64 languages) and the chance of a false positive per language."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], bits: int, hashes: int):
        self.languages, self.bits, self.hashes = languages, bits, hashes
        self.slots = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), U64)
        self.false = np.zeros(len(languages))
        for k, g in enumerate(grams):
            for at in self.places(g):
                self.slots[k // 64, at] |= U64(1 << (k % 64))
            self.false[k] = ((self.slots[k // 64] >> U64(k % 64) & U64(1)).mean()) ** hashes

    def places(self, g: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(self.hashes):
            yield (g * _ODD[k + 1] >> U64(64 - self.bits)).astype(np.int64)

    def hits(self, g: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per language and text: n-grams that the filter holds for the language."""
        out = np.zeros((len(self.languages), len(first) - 1), np.int64)
        places = list(self.places(g))
        for word, slots in enumerate(self.slots):
            mask = slots[places[0]]
            for at in places[1:]:
                mask &= slots[at]
            if len(self.languages) <= 8:
                mask = mask.astype(np.uint8)
            for k in range(64 * word, min(64 * word + 64, len(self.languages))):
                one = (mask >> mask.dtype.type(k % 64)) & mask.dtype.type(1)
                out[k] = np.add.reduceat(one, np.minimum(first[:-1], len(one) - 1), dtype=np.int64) if len(one) else 0
        return out


def train(docs: DataFrame, *, n: int = 5, per_language: int = 3000, min_share: float = 0.01, bits: int = 20, hashes: int = 2, max_languages: int = 4096) -> Filter:
    """Learn from text and lang of the documents that aren't held out."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang", F.xxhash64("text").alias("h"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count_distinct("h").alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages: is lang a language?")
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return Filter([], [], bits, hashes)
    share = {x: min(1.0, per_language / sizes[x]) for x in languages}
    limits = [(k, x, int(share[x] * (1 << 40)), float(max(2, min_share * share[x] * sizes[x]))) for k, x in enumerate(languages)]
    limits = F.broadcast(spark.createDataFrame(limits, "k int, lang string, below long, enough double"))  # max_languages rows at most
    sample = rows.join(limits, "lang").where(F.pmod(F.col("h"), F.lit(1 << 40)) < F.col("below")).select("text", "h", "k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in slices(batch):
                keep = []
                for i, key in enumerate(zip(part.column("h").to_pylist(), part.column("k").to_pylist(), strict=True)):
                    if key not in seen:
                        seen.add(key)
                        keep.append(i)
                if not keep:
                    continue
                part = part.take(pa.array(keep))
                g, first = _grams(*buffer(part.column("text")), n)
                lang = part.column("k").to_numpy()
                each = [np.unique(g[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                for k in np.unique(lang):
                    grams, times = np.unique(np.concatenate([e for e, x in zip(each, lang, strict=True) if x == k]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), k, np.int32)), pa.array(grams.view(np.int64)), pa.array(times)], ["k", "g", "n"])

    found = sample.mapInArrow(lean(count), "k int, g long, n long").groupBy("k", "g").agg(F.sum("n").alias("n"))
    # Bounded by the sample: an n-gram that is kept is in 1 of 1 / min_share of a language's sampled texts.
    kept = found.join(limits.select("k", "enough"), "k").where(F.col("n") >= F.col("enough")).select("k", "g").toArrow()
    k, g = (kept.column(c).to_numpy() for c in ("k", "g"))
    o = np.argsort(k, kind="stable")
    cuts = np.searchsorted(k[o], np.arange(len(languages) + 1))
    grams = [g[o[a:b]].view(U64) for a, b in zip(cuts, cuts[1:], strict=False)]
    return Filter(languages, grams, max(bits, int(SLOTS * max(map(len, grams)) - 1).bit_length()), hashes)


def predict(docs: DataFrame, model: Filter, *, n: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the columns `keep`, lang_pred, score (the winner's part of all corrected counts)."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        names = np.array([*f.languages, "und"], object)
        for batch in batches:
            for part in slices(batch):
                data, offs = buffer(part.column("text"))
                best, score = np.full(part.num_rows, len(f.languages)), np.zeros(part.num_rows)
                if f.languages:
                    g, first = _grams(data, offs, n)
                    hits = f.hits(g, first)
                    fixed = np.maximum((hits - np.diff(first) * f.false[:, None]) / np.maximum(1 - f.false[:, None], 1e-9), 0)
                    some = _has_letter(part, data, offs)
                    best[some] = fixed.argmax(0)[some]
                    total = fixed.sum(0)
                    score[some] = (fixed.max(0) / np.maximum(total, 1e-9))[some]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(lean(apply), schema + ", lang_pred string, score double")


def identify(docs: DataFrame, *, n: int = 5, **options) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    out = predict(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train(docs, n=n, **options), n=n)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
