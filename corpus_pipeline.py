"""A corpus pipeline over `documents`: five stages, each one operator of `loomframe.llm`.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. The filtering stages return
the columns of `documents`; the last returns the packed pieces. No stage can be written in SQL (models, hashes and
packing plans), so ORACLE_SQL is None and the tests hold the stages against brute force.

Language identification drops null texts, texts without a letter and those without a single known n-gram; where no
language could be learned, all texts with a letter stay. The near-duplicate stage decides by rows, so repeated rows and
copies without a doc_id go, too. The others keep what isn't rejected.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import decontaminate, jaccard, langid, lines, pack
from loomframe.llm._spark import stash, table

#: Pieces of text that a packing worker remembers: it lives on beside the other stages' workers.
REMEMBERED = 100_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language; a null lang becomes the prediction."""
    model = langid.train(docs)
    if not model.languages:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    out = langid.predict(docs, model, keep=COLUMNS).where((F.col("lang_pred") != "und") & (F.col("score") > 0))
    return out.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of recurring templates; documents of which no word is left go. n_chars follows the text."""
    out = lines.drop_lines(docs, long_words=lines.LONG, keep=COLUMNS)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that with the smallest doc_id, null last."""
    rows = docs.select(*COLUMNS).withColumn("_key", F.xxhash64(*COLUMNS))
    found = stash(jaccard.similar(rows, key="_key").where("group is not null").select("group", "doc_id", "_key"), "near-copies")
    first = found.groupBy("group").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(jaccard.NO_ID)).alias("d"), "_key")).alias("f")).select("f._key")
    kept = rows.join(found.select("_key").distinct().join(first, "_key", "left_anti"), "_key", "left_anti")
    repeated = stash(found.groupBy("_key").count().where("count > 1").select("_key").join(first, "_key", "left_semi"), "repeated")
    if not repeated.isEmpty():  # rows that are the same in all columns: one stays
        kept = kept.join(repeated, "_key", "left_anti").unionByName(rows.join(repeated, "_key", "left_semi").dropDuplicates(["_key"]))
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return out.where(~F.col("contaminated")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    return pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), memory=REMEMBERED)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage{k}")
    return docs
