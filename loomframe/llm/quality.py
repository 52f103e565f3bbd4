"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects documents whose feature is above a cutoff. All rules tighten together in LEVELS steps from the mildest to
the strictest cutoffs (`GRIDS`, fixed before seeing data), so a document has one number: the first step at which some
rule rejects it (`level`; LEVELS if none does). The step to use comes from labelled documents that pass the base
rules. Per stratum (the document's lang), steps are tried in order; a step is accepted while an exact binomial test
shows, at level delta / strata, that at most alpha of the stratum's good documents would be rejected at it, and the
first that isn't accepted ends the sequence. So, with probability 1 - delta, no stratum loses more than alpha of its
good documents: testing in a fixed order needs no correction within a sequence, and Bonferroni corrects over strata.
A stratum without enough labels (86 good documents for the defaults and four strata) rejects nothing.

Only counts per stratum and step reach the driver: (`max_strata` + 1) * LEVELS at most; all strata but the
`max_strata` with most labels share one, with a step of its own.

Defined results: a null text has no words and so fails the base rules; a null lang is a stratum of its own (that of the
empty string); null labels and labels of unknown documents are ignored, of several labels of a document the smallest
holds; a null doc_id has no label; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import stash

#: The characters of [\x20\x09-\x0D].
BLANKS = "\x20\t\n\x0b\x0c\r"
_BLANK_RE = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"

#: Cutoffs of each rule at every step, mildest first.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "upper_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25),
    "repeat_share": (0.95, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2),
    "dup_line_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35),
    "chars_per_word": (50.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 14.0, 13.0, 12.0),
}
LEVELS = 10


def _count(text: Column, chars: str) -> Column:
    """Characters of a text that are among `chars`."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def features(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and a column per rule."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(*keep, text.alias("_t"), F.array_remove(F.split(text, _BLANK_RE), "").alias("_w"))
    df = df.withColumn("_n", F.size("_w").cast("long"))
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    at = F.when(F.col("_n") >= 3, F.sequence(F.lit(0), F.col("_n").cast("int") - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_s", F.sort_array(F.transform(at, lambda i: F.struct(window(i).alias("h"), i.alias("i")))))
    # Neighbours in the order of the windows' hashes are the same window: both are marked.
    same = lambda x, k: (F.get("_s", k + 1)["h"] == x["h"]) | F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False))
    starts = F.filter("_s", lambda x, k: F.coalesce(same(x, k), F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False))))
    # A window covers three words, less those that the next repeated window, in the order of places, covers too.
    df = df.withColumn("_p", F.sort_array(F.transform(starts, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda i, k: F.least(F.coalesce(F.get("_p", k + 1) - i, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    blank = F.length("_t") - F.length(F.translate("_t", BLANKS, ""))
    df = df.withColumn("_l", F.when(F.contains("_t", F.lit("\n")), lines).otherwise(F.array().cast("array<string>")))
    df = df.select(
        *keep,
        F.col("_n").alias("n_words"),
        (F.length("_t") - blank).cast("long").alias("word_chars"),
        _count(F.col("_t"), _SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_l").alias("_lines"),
        _count(F.col("_t"), _UPPER).alias("_upper"),
    )
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return df.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        per_word("n_symbols").alias("symbols_per_word"),
        (F.col("_upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper_share"),
        per_word("n_repeat_words").alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1))).alias("dup_line_share"),
        per_word("word_chars").alias("chars_per_word"),
    )


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly from the logarithms of its terms."""
    if k >= n:
        return 1.0
    lp, lq = math.log(p), math.log1p(-p)
    term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq
    return min(1.0, math.fsum(math.exp(term(i)) for i in range(k + 1)))


def level() -> Column:
    """The first step at which a rule rejects the document; LEVELS if none does."""
    return F.least(*[sum(((F.col(rule) <= c).cast("int") for c in grid), F.lit(0)) for rule, grid in GRIDS.items()])


def accepted(n: int, rejected: list[int], alpha: float, delta: float) -> int:
    """How many steps a stratum accepts: n good documents, of which `rejected[i]` are rejected at the i-th step."""
    return next((i for i, k in enumerate(rejected) if binomial_tail(n, k, alpha) > delta), len(rejected))


def thresholds(feats: DataFrame, labels: DataFrame, *, label: str = "quality", stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, max_strata: int = 64) -> dict[str | None, int]:
    """Accepted steps per stratum. The key None stands for all strata beyond the `max_strata` with most labels."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y")).where("y > 0")
    good = feats.where(~F.col("base_failed")).select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("s"), level().alias("v")).join(known, "doc_id", "left_semi")
    counts = [F.count(F.lit(1)).alias("n"), *[F.sum((F.col("v") <= i).cast("long")).alias(f"k{i}") for i in range(LEVELS)]]
    rows = [r.asDict() for r in good.groupBy("s").agg(*counts).orderBy(F.desc("n"), "s").limit(max_strata).collect()]
    if len(rows) == max_strata:
        rest = good.where(~F.col("s").isin([r["s"] for r in rows])).agg(*counts).first().asDict()
        rows += [rest | {"s": None}] if rest["n"] else []
    return {None: 0} | {r["s"]: accepted(r["n"], [r[f"k{i}"] for i in range(LEVELS)], alpha, delta / len(rows)) for r in rows}


def verdict(steps: dict[str | None, int], stratum: Column) -> Column:
    """True where no accepted step rejects the document."""
    own = {s: n for s, n in steps.items() if s is not None}
    mine = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[F.coalesce(stratum, F.lit(""))] if own else F.lit(None)
    return level() >= F.coalesce(mine, F.lit(steps.get(None, 0)))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: the features, kept."""
    feats = stash(features(docs, keep=("doc_id", "lang")), "quality")
    return feats.withColumn("kept", ~F.col("base_failed") & verdict(thresholds(feats, labels, **options), F.col("lang")))
