import random
import re

import pyarrow as pa
import pytest
from helpers import DOCS, awkward, frame, real
from pyspark.sql import functions as F

from loomframe.llm import jaccard as op

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs):
    """Exact components by an inverted index over all shingles."""
    sets, index = [], {}
    for k, (_, t) in enumerate(docs):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        sets.append(s)
        for x in s:
            index.setdefault(x, []).append(k)
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        both = {}
        for x in s:
            for j in index[x]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        for j, c in both.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    low = {}
    for i, (d, _) in enumerate(docs):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(docs))


def check(spark, docs, **k):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted(tuple(r) for r in op.similar(docs, **k).collect())
    assert got == want
    return want


def near(rng, words, share):
    w = list(words)
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_real(spark):
    want = check(spark, real(spark, "sf0.01"))
    assert sum(d != c for d, _, c in want) > 20


def test_made(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(rng.choice([8, 30, 120, 200]))]
        for share in (0, 0.01, 0.02, 0.03, 0.04):
            texts += [near(rng, base, share) for _ in range(6)]
    chain = [rng.choice(vocab) for _ in range(150)]
    for i in range(12):  # neighbours link, the ends don't
        texts.append(" ".join(chain[i * 8 : i * 8 + 100]))
    texts += [" ".join([rng.choice(vocab) for _ in range(25)] + passage) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    check(spark, frame(spark, rows), heavy_min=4)
    check(spark, frame(spark, rows), broadcast_rows=0, heavy=0)
    check(spark, frame(spark, rows), heavy_min=2, hot=3)


def test_last_shared_shingle_of_a_third_document(spark):
    # One-word shingles, in the order of their hashes.
    words = [f"w{i}" for i in range(400)]
    words = [w for _, w in sorted((int(op.sets(pa.RecordBatch.from_pydict({"text": [w]}), 1)[0][0]), w) for w in words)]
    own, t, a_own, c_own = words[:22], words[22:120], words[120:122], words[200:299]
    texts = [[*t, *a_own], [*own, *t], [t[22], *c_own]]
    got = {r.doc_id: r.component_id for r in op.similar(frame(spark, [(i, " ".join(x), None, None, 0) for i, x in enumerate(texts)]), size=1).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    # Samples of pools, near the limit: groups of several sets that share late shingles of their prefixes.
    rng, rows = random.Random(3), []
    for k in range(40):
        pool = [f"v{k}x{i}" for i in range(130)]
        for _ in range(6):
            rows.append((len(rows), " ".join(rng.sample(pool, rng.randrange(108, 128))), None, None, 0))
    sets = [set(r[1].split()) for r in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if up[i] != up[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                lo, hi = sorted((up[i], up[j]))
                up = [lo if x == hi else x for x in up]
    for k in (4, 8):
        assert {r.doc_id: r.component_id for r in op.similar(frame(spark, rows), size=1, heavy_min=k).collect()} == dict(enumerate(up))


@pytest.mark.parametrize("seed", range(2))
def test_links_at_the_threshold(spark, seed):
    """n in m1 at exactly 0.8, m2 a near copy of m1 that doesn't link with n; sets of 5 to 200 that share just enough."""
    rng, rows = random.Random(seed), []
    for k in range(40):
        w = [f"t{k}x{i}" for i in range(140)]
        rng.shuffle(w)
        rows += [" ".join(x) for x in (w[12:112], w[:125], w[:119] + w[130:136])]
    for k in range(60):
        n = rng.randrange(5, 200)
        both = min(n, -(-80 * 2 * n // 180) + rng.randrange(-1, 2))
        w = [f"u{k}x{i}" for i in range(2 * n)]
        rng.shuffle(w)
        rows += [" ".join(w[:n]), " ".join(w[n - both : 2 * n - both]), " ".join(rng.sample(w[: n + 2], min(n, len(w[: n + 2]))))]
    docs = [(i, t, None, None, 0) for i, t in enumerate(rows)]
    sets = [set(t.split()) for t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if up[i] != up[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                lo, hi = sorted((up[i], up[j]))
                up = [lo if x == hi else x for x in up]
    for options in ({}, {"heavy_min": 2, "hot": 2}):
        assert {r.doc_id: r.component_id for r in op.similar(frame(spark, docs), size=1, **options).collect()} == dict(enumerate(up))


def test_many_rows_without_an_id(spark):
    """Rows with a null doc_id and repeated rows: no row meets all others."""
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, f"{base} {i} {i} {i} tail", None, None, 0) for i in range(300)] + [(5, base, None, None, 0)] * 300
    got = op.similar(frame(spark, rows).withColumns({c: F.lit(c) for c in ("row", "_row", "node", "token", "n")})).collect()
    assert len(got) == 600 and all(r.component_id in (None, 5) for r in got) and sum(r.component_id == 5 and r.doc_id == 5 for r in got) == 300


def test_awkward(spark):
    more = ["one two three.", "a", "A", "b c d e f g", "B c d e f g", "b c d e f g h", "  a "]
    check(spark, frame(spark, [*awkward(more), awkward()[11]]))
    check(spark, frame(spark, [], DOCS))
    null = frame(spark, [(None, "p q r s t u", None, None, 1), (4, "p q r s t u", None, None, 1), (None, "only here", None, None, 1)])
    assert sorted((tuple(r) for r in op.similar(null).collect()), key=str) == sorted([(None, 2, 4), (4, 2, 4), (None, 1, None)], key=str)
