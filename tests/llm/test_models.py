"""Language identification and toxicity: held-out accuracy, folds, awkward rows; components; the pipeline's stages."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, awkward, frame, real

import corpus_pipeline
from loomframe.llm import jaccard, langid, lines, toxicity
from loomframe.llm.components import components

SF = "/root/testdata/sf0.1"


def fold(d):
    return d is None or zlib.crc32(str(d).encode()) % 5 == 0


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth) and all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.99


def test_filter_agrees_with_exact_sets(spark):
    """Brute force: exact n-gram sets in place of the filter, counted and compared in plain Python."""
    docs, n = real(spark, "sf0.01"), 5
    model = langid.train(docs, n=n)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]

    def grams(t):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        raw = b" " * (n - 1) + bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in raw) + b" " * (n - 1)
        return [raw[i : i + n] for i in range(len(raw) - n + 1)]

    seen, sets = {}, {}
    for d, t, x in rows:
        if not fold(d) and x is not None and t is not None:
            seen.setdefault(x, set()).add(t)
    for x, texts in seen.items():
        c = Counter(g for t in texts for g in set(grams(t)))
        sets[x] = {g for g, k in c.items() if k >= max(2, 0.01 * len(texts))}
    order = sorted(seen, key=lambda x: (-len(seen[x]), x))
    assert model.languages == order
    got = {r.doc_id: r for r in langid.predict(docs, model, n=n).collect()}
    same = 0
    for d, t, _ in rows:
        hits = [sum(g in sets[x] for g in grams(t)) for x in order]
        best = order[int(np.argmax(hits))] if any(c.isalpha() for c in t or "") else "und"
        same += best == got[d].lang_pred
        if sum(hits) > 100:
            assert best == got[d].lang_pred and abs(max(hits) / sum(hits) - got[d].score) < 0.05
    assert same >= 0.998 * len(rows)


def test_many_languages(spark):
    docs = frame(spark, [(i, f"text number {i} is here", f"l{i % 300}", None, 1) for i in range(3000)])
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, max_languages=299)
    assert len(langid.train(docs).languages) == 300


def test_language_of_awkward_texts(spark):
    rows = [*awkward(), (None, "the word", "en", None, 1), (30, "12 !? 34", "fr", None, 1), (30, "12 !? 34", "fr", None, 1)]
    model = langid.train(real(spark))
    got = {r.doc_id: r for r in langid.predict(frame(spark, rows), model).collect()}
    for d, t, *_ in rows:
        letters = any(c.isalpha() for c in t or "")
        assert (got[d].lang_pred == "und") == (not letters), t
    assert {r.lang_pred for r in langid.identify(frame(spark, rows).where("1 = 0").union(frame(spark, [(1, "a b", None, None, 1)]))).collect()} == {"und"}
    assert langid.identify(frame(spark, [], DOCS)).count() == 0


def test_filter_holds_what_was_put_in(spark):
    rng = np.random.default_rng(3)
    grams = [rng.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(70)]  # more than one word of masks
    f = langid.Filter([f"l{k:02}" for k in range(70)], grams, 18, 2)
    hits = f.hits(np.concatenate(grams), np.arange(0, 70 * 3000 + 1, 3000))
    assert all(hits[k, k] == 3000 for k in range(70))
    wrong = hits.sum() - 70 * 3000
    assert abs(wrong / (70 * 69 * 3000) - f.false.mean()) < 0.2 * f.false.mean()


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    n = Counter((truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth)
    assert n[1, 1] >= 0.7 * (n[1, 1] + n[1, 0]) and n[0, 1] <= 0.01 * (n[0, 0] + n[0, 1])


def test_same_weights_as_plain_python(spark):
    """FTRL-proximal written out in plain Python, over the features of a small table."""
    bits, alpha, beta, l1, l2, passes = 12, 3.0, 1.0, 3.0, 0.5, 3
    words = [f"w{i}" for i in range(30)]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[: 20 if i % 3 else 30], 12)), None, None, 1) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    bias, at, w = toxicity.train(docs, labels, bits=bits, passes=passes, min_docs=3, alpha=alpha, beta=beta, l1=l1, l2=l2)
    known = [(r.h, i, words) for i, words, r in ((r.doc_id, r.text, r) for r in docs.selectExpr("doc_id", "text", "xxhash64(doc_id) h").collect()) if not fold(i)]
    samples = []
    for h, i, text in known:
        idx, _, x = toxicity._features(pa.RecordBatch.from_pydict({"text": [text]}), bits)
        samples.append((h, int(i % 3 == 0), sorted(set(idx.tolist())), float(x[0])))
    often = Counter(f for *_, fs, _ in samples for f in fs)
    z, n = Counter(), Counter()

    def weight(f):
        shrink = 0 if f == "bias" else l1
        return 0.0 if abs(z[f]) <= shrink else -(z[f] - np.sign(z[f]) * shrink) / ((beta + n[f] ** 0.5) / alpha + l2)

    for _ in range(passes):
        for _, y, fs, x in sorted(samples, key=lambda s: s[:2]):
            used = [f for f in fs if often[f] >= 3] + ["bias"]
            ws = {f: weight(f) for f in used}
            g = (1 / (1 + np.exp(-sum(ws.values()) * x)) - y) * x
            for f in used:
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha * ws[f]
                n[f] += g * g
    want = {f: weight(f) for f in z if f != "bias" and weight(f)}
    assert abs(bias - weight("bias")) < 1e-9 and dict(zip(at.tolist(), w.tolist(), strict=True)).keys() == want.keys()
    assert all(abs(want[f] - x) < 1e-9 for f, x in zip(at.tolist(), w.tolist(), strict=True))


def test_training_is_bounded_for_repeated_ids_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, "bad words here", None, None, 1)] * 10_000 + [(2, long, None, None, 1), (3, "good words there", None, None, 1), (1, "zzz", None, None, 1)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    once = frame(spark, rows[-4:])
    args = {"min_docs": 1, "l1": 0.0, "row_features": 50}
    a, b = toxicity.train(frame(spark, rows), labels, **args), toxicity.train(once, labels, **args)
    assert a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all() and len(a[1]) < 150
    assert toxicity.toxicity(frame(spark, rows), labels, **args).count() == len(rows)


def test_toxicity_of_awkward_texts(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    docs = frame(spark, [*awkward(), (None, "x", None, None, 1), (2, None, None, None, 1)])
    for lab in (labels, labels.limit(0)):
        got = toxicity.toxicity(docs, lab).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(frame(spark, [], DOCS), labels).count() == 0


def test_labels_of_held_out_documents_change_nothing(spark):
    docs = real(spark, "sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all()


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rng = np.random.default_rng(5)
    links = {"chain": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(60)], "random": [tuple(map(int, rng.integers(0, 80, 2))) for _ in range(60)]}[kind]
    up = {n: n for e in links for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        lo, hi = sorted((root(a), root(b)))
        up[hi] = lo
    want = {n: root(n) for e in links if e[0] != e[1] for n in e}
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert docs.join(before, "doc_id", "left_anti").isEmpty()
    # One document of each component of the second stage's rows stays: the smallest.
    want = {r.doc_id for r in jaccard.similar(kept[1]).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in kept[2].collect()} == want
    assert lines.recurring(kept[1]).join(lines.recurring(kept[0]), "template", "left_anti").isEmpty()
    by = {}
    for r in kept[4].collect():
        by.setdefault(r.sequence_id, []).append(r.length)
    assert {r.doc_id for r in kept[4].collect()} == {r.doc_id for r in kept[3].collect()} and max(map(sum, by.values())) <= 1024
    assert corpus_pipeline.run(spark, sf).count() == kept[4].count()
    empty = frame(spark, [], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_stages_on_awkward_rows(spark):
    """Null ids, nulls in other columns, repeated rows and copies: one row of each group stays, texts without a language go."""
    text = "the quick brown fox jumps over the lazy dog and runs away from here"
    rows = [(None, text, None, None, None), (None, text, None, None, None), (None, text + " now", None, "s", 1), (7, "only one of it is in this table today", "en", None, 2), (7, "only one of it is in this table today", "en", None, 2), (8, "Only one of it is in this table today", None, None, 2), (9, "", None, None, 0), (10, None, None, None, None)]
    docs = frame(spark, rows).withColumns({c: toxicity.F.lit(c) for c in ("group", "_d", "component_id", "node")})
    got = sorted(map(str, (tuple(r) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect())))
    assert len(got) == 4 and sum("fox" in x for x in got) == 1 and sum("(7, 'only" in x for x in got) == 1
    kept = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == {7, 8} and len(kept) == 3  # the others share no n-gram with the two labelled texts
    model_docs = real(spark).select(*corpus_pipeline.COLUMNS)
    more = frame(spark, [(10**6, "日本語 テスト", None, None, 5), (10**6 + 1, "the cat and the dog", None, None, 5), (10**6 + 1, "the cat and the dog", None, None, 5)])
    kept = {r.doc_id: r for r in corpus_pipeline.identify_language(spark, model_docs.unionByName(more), "").where("doc_id >= 1000000").collect()}
    assert set(kept) == {10**6 + 1} and kept[10**6 + 1].lang == "en"
    sf = "/root/testdata/sf0.001"
    for d in (docs, docs.where("1 = 0")):
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, sf)
        assert d.count() <= 8
