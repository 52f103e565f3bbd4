"""Small inputs that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(extra=()):
    texts = [None, "", "   ", "a", "One two three.", "été à la plage, ça va", "x" * 5000, "word " * 4000, "日本語 テスト", "12 34 56", "the the the the the", "line one here now\nline one here now\n\nother line", *extra]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def real(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
