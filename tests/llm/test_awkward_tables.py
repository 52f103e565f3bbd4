"""Every query of the subpackage over tables with nulls, repeated rows, ties, long texts, no rows, and columns named like the operators' own."""

import pytest
from helpers import DOCS, awkward, frame
from pyspark.sql import functions as F

from loomframe.llm import queries

#: Names that operators use inside.
OWN = ("blob", "found", "rules", "h", "k", "g", "x", "y", "n", "row", "_row", "_d", "_t", "_w", "node", "token", "to", "hub", "chunk", "group", "shard", "offset", "ids", "task", "rank", "length", "level", "kept", "s", "score", "template", "first", "_words", "_spans", "_items", "lang_pred", "held_out", "component_id")
PER_DOCUMENT = [k for k in queries.queries() if k not in ("op8_pack", "pipeline")]


def tables(spark, folder, rows):
    docs = frame(spark, rows, DOCS).withColumns({c: F.lit(c) for c in OWN})
    docs.write.parquet(f"{folder}/documents.parquet")
    items = [("1", "one two three four five six seven eight nine ten eleven"), (None, None), ("2", ""), ("1", "one two three four five six seven eight nine ten eleven")]
    spark.createDataFrame(items, "item_id string, text string").withColumns({c: F.lit(c) for c in OWN}).write.parquet(f"{folder}/benchmark.parquet")
    labels = [(0, 1, 0), (0, 0, 1), (1, None, None), (None, 1, 1), (99, 1, 1), (3, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit(c) for c in OWN}).write.parquet(f"{folder}/labels.parquet")
    return docs.count()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    long = "a long text of many words, 4111 1111 1111 1111 and John Smith. " * 20_000
    more = [(None, "one two three four five six seven eight nine ten eleven", None, None, 1), (None, None, None, None, None), (None, "", "en", "s", 0)]
    rows = [*awkward(["one two three four five six seven eight nine ten eleven", long]), *awkward()[-3:], *more, *more]
    some, none = (str(tmp_path_factory.mktemp(x)) for x in ("some", "none"))
    return {some: tables(spark, some, rows), none: tables(spark, none, [])}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, folders, name):
    for folder, n in folders.items():
        got = queries.queries()[name](spark, folder)
        rows = got.collect()
        assert len(set(got.columns)) == len(got.columns)
        if name in PER_DOCUMENT:
            assert len(rows) == n and sum(r.doc_id is None for r in rows) == (6 if n else 0)
        elif name == "op8_pack":
            assert sum(r.piece == 0 for r in rows) == n
        else:
            assert len(rows) == 0 or {r.doc_id for r in rows} <= {None, *range(20)}
