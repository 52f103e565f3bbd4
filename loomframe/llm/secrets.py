"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Each version of a document is a blob named by the SHA-256 of its text. The ledger (a Parquet table) has one row per
blob and version of the rules that was scanned, with the spans found. A scan takes the blobs that have no row for the
present rules, once each, whatever the number of paths that hold them; it appends them to the ledger; then every path
gets the findings of its blob by a join. Changing a pattern changes the rules' version, so all blobs are scanned anew.

Spans: Spark's regular expression functions give no positions. `split` gives the text between matches and
`regexp_extract_all` the matches; a running sum of their lengths over a blob's matches, which are rows of one task
then, gives the places in code points.

Defined results: a null text is the empty blob; a null or repeated path gets its row each; an empty table gives an
empty result; rows that a ledger holds twice count once; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import new_path, stash


class Rule(NamedTuple):
    kind: str
    pattern: str  # leftmost matches that don't overlap
    group: int  # the group whose length counts
    least: int  # matches with a shorter group are dropped
    hint: str  # a cheaper pattern that every text with a kept match has


RULES = (
    Rule("assign", """((?i:password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, """(?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]"""),
    # A run of the class is one match, so the least length can stand in the pattern.
    Rule("access", "(AKIA[A-Z0-9]{14,})", 1, 18, "AKIA[A-Z0-9]{14}"),
    Rule("hex", "([0-9a-f]{16,})", 1, 16, "[0-9a-f]{16}"),
)
SPAN = "array<struct<start:int,k:int,stop:int>>"
MATCH = "array<struct<k:int,i:int,b:int,m:int,g:int>>"


def version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]


def matches(text: Column, rule: Rule, k: int) -> Column:
    """Array of (k, number of the match, characters between it and the one before, its own, its group's)."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("b"), whole.alias("m"), group.alias("g"))
    lengths = F.transform(parts, lambda p, i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.length(p["b"]).alias("b"), F.length(p["m"]).alias("m"), F.length(p["g"]).alias("g")))
    return F.when(text.rlike(rule.hint), lengths).otherwise(F.array().cast(MATCH)).cast(MATCH)


def _blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> str:
    """Scan the blobs of `versions` (column text) that the ledger hasn't yet for these rules; returns the ledger's path."""
    spark = versions.sparkSession
    fresh = ledger is None
    ledger = ledger or new_path(spark, "blob-ledger")
    mark = version(rules)
    text = F.coalesce("text", F.lit(""))
    # Only texts with a hint of a secret go through the shuffle by blob: the others' rows hold no finding and need no text.
    blobs = versions.select(_blob(F.col("text")).alias("blob"), text.alias("t"))
    if not fresh:
        seen = spark.read.parquet(ledger).where(F.col("rules") == mark).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    hinted = F.lit(False)
    for r in rules:
        hinted = hinted | F.col("t").rlike(r.hint)
    once = blobs.withColumn("t", F.when(hinted, F.col("t"))).groupBy("blob").agg(F.max("t").alias("t"))
    # A blob's matches become rows beside each other: running sums over them take no time beyond sorting. The outer
    # explode keeps the blobs without a match.
    found = once.select("blob", F.explode_outer(F.concat(*[matches(F.col("t"), r, k) for k, r in enumerate(rules)])).alias("x")).select("blob", "x.*")
    least = F.array(*[F.lit(r.least) for r in rules])
    found = found.withColumn("stop", F.sum(F.col("b") + F.col("m")).over(Window.partitionBy("blob", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    kept = F.when(F.col("g") >= F.get(least, F.col("k")), F.struct((F.col("stop") - F.col("m")).alias("start"), "k", "stop"))
    once = found.groupBy("blob").agg(F.sort_array(F.collect_list(kept)).cast(SPAN).alias("found")).select("blob", F.lit(mark).alias("rules"), "found")
    once.write.mode("append").parquet(ledger)
    return ledger


def findings(paths: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, *, key: str = "doc_id") -> DataFrame:
    """Per path: key, blob and the spans of its blob."""
    spark = paths.sparkSession
    known = spark.read.parquet(ledger).where((F.col("rules") == version(rules)) & (F.size("found") > 0)).select("blob", "found")
    known = stash(known.dropDuplicates(["blob"]), "found")  # scans that ran at once, or twice, left a blob's row twice
    mine = paths.select(key, _blob(F.col("text")).alias("blob"))
    return mine.join(known, "blob", "left").select(key, "blob", F.coalesce("found", F.array().cast(SPAN)).alias("found"))


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES, *, key: str = "doc_id") -> DataFrame:
    names = F.array(*[F.lit(r.kind) for r in rules])
    text = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"], x["stop"])), ",")

    def number(k: int) -> Column:
        return F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")

    counts = [number(k).alias(f"n_{r.kind}") for k, r in enumerate(rules)]
    return found.select(key, *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"), "blob")
