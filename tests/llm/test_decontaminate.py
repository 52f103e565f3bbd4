import hashlib
import re

from helpers import DOCS, awkward, frame, real
from pyspark.sql import functions as F

from loomframe.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i or "")
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out)


def run(spark, docs, items, **k):
    got = op.contamination(docs, items, **k).drop("hit_spans", "hit_items")
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(tuple(r) for r in got.collect())


def test_real_rows(spark):
    docs, items = real(spark), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(str(r.item_id), r.text) for r in items.collect()])
    assert any(x[2] for x in want)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, block_chars=2000) == want


def test_awkward(spark):
    items = [("1", "Line ONE here, now"), ("2", None), ("3", ""), (None, "word " * 12), ("5", "la plage"), ("5", "la plage"), ("6", "ça va bien"), ("7", "x" * 5000)]
    extra = ["so line one\there now! word word", "Line one here now word", None]
    docs = [*awkward(extra), awkward(extra)[11]]
    want = brute([r[:2] for r in docs], items)
    schema = "item_id string, text string, doc_id long, lang string"
    it = spark.createDataFrame([(*x, 5, "q") for x in items], schema)
    assert run(spark, frame(spark, docs), it) == want
    assert run(spark, frame(spark, docs), it, block_chars=2000) == want
    assert run(spark, frame(spark, docs), it.limit(0)) == brute([r[:2] for r in docs], [])
    assert run(spark, frame(spark, [], DOCS), it) == []


def test_many_repeated_items_and_a_long_text(spark):
    items = spark.createDataFrame([("7", "one two three four five six seven eight nine ten eleven")] * 10_000 + [("8", "alpha beta gamma")], "item_id string, text string")
    long = "filler text here " * 1_000_000
    docs = [(None, "zero one two three four five six seven eight nine ten", None, None, 1), (2, long + "alpha, beta; gamma", None, None, 1), (None, None, None, None, 0)]
    d = frame(spark, docs).withColumns({c: F.lit(c) for c in ("_words", "_spans", "_items", "n_words")})
    got = {r.n_words: (r.doc_id, r.n_hit, r.n_items) for r in op.contamination(d, items, block_chars=100).collect()}
    assert got == {11: (None, 10, 1), 3_000_003: (2, 3, 1), 0: (None, 0, 0)}
