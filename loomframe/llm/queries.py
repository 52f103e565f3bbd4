"""Queries of the operators, over whole tables and whole texts with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, langid, lines, oracles, pack, quality, secrets, surrogates, token_index, toxicity
from ._spark import table


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("hit_spans", "hit_items")


def op4_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = token_index.write(docs, public_tokenizers.path("word_bpe_49k.json"), memory=REMEMBERED)
    found = token_index.lookup(spark, path, docs.select("doc_id").distinct())
    return token_index.read(spark, path, token_index.expand(found, path, nulls=True))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_lines(table(spark, sf_dir, "documents"), long_words=lines.LONG)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), memory=REMEMBERED)


#: Pieces of text that a worker of the tokenizing queries remembers; nothing else runs in it, so there is room.
REMEMBERED = 600_000
#: The queries' key; a corpus that is given away needs a secret one.
SURROGATE_KEY = b"loomframe public demonstration key"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.report(secrets.findings(docs, secrets.scan(docs)))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.drop("lang", *quality.GRIDS)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py at the repository's top."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_secrets, op2_langid, op3_decontaminate, op4_token_index, op5_jaccard, op6_lines, op7_surrogates, op8_pack, op9_quality, op10_toxicity, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
