import json
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, awkward, frame, real
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomframe.llm import _spark, langid, pack, token_index
from loomframe.llm._tokens import Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(text=st.lists(st.sampled_from([*" \n\t.,'!_aAéß½²1٣日́\u0085 \x1c\x00<|>", "<|endoftext|>", "'s", " the", "İ", " ǅa", "한", "क़", ".", ","]), max_size=40).map("".join))
def test_same_ids_as_whole_texts(name, text):
    e = Encoder.of(public_tokenizers.path(name), 2)
    assert np.frombuffer(e.ids([text])[0], "<u4").tolist() == plain(name)(text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which", ["real", "awkward"])
def test_index_round_trip(spark, which):
    docs = real(spark) if which == "real" else frame(spark, [*awkward(), (5, "again", None, None, 0), (5, "again", None, None, 0), (None, "no key", None, None, 0), (None, None, None, None, 0), (None, "no key", None, None, 0)])
    docs = docs.withColumns({c: F.lit(c) for c in ("k", "x", "row", "shard", "offset", "ids")})
    enc, at, want = plain(FILES[1]), 0, []
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    path = token_index.write(docs, public_tokenizers.path(FILES[1]))
    found = token_index.lookup(spark, path, docs.select("doc_id").distinct())
    got = [tuple(r) for r in token_index.read(spark, path, token_index.expand(found, path, nulls=True), keep_ids=True).collect()]
    if which == "real":
        for r in rows:
            ids = enc(r.text)
            want.append((r.doc_id, at, len(ids), crc(ids), np.array(ids, "<u4").tobytes()))
            at += len(ids)
        assert sorted(got) == want
    else:
        assert Counter((d, b) for d, *_, b in got) == Counter((r.doc_id, np.array(enc(r.text), "<u4").tobytes()) for r in rows)
        starts = sorted((s, n) for _, s, n, *_ in got)
        assert [s for s, _ in starts] == np.cumsum([0, *(n for _, n in starts)])[:-1].tolist()
    missing = spark.range(10**6, 10**6 + 500).withColumnRenamed("id", "doc_id")
    assert token_index.lookup(spark, path, missing).count() == 0


def test_long_text_and_many_repeated_rows(spark):
    """A text of 20 MB, and a key with 10,000 equal rows over several shards."""
    long = "some words, then others. " * 800_000
    docs = frame(spark, [(7, "same text here", None, None, 0)] * 10_000 + [(3, long, None, None, 0), (9, "last", None, None, 0)])
    path = token_index.write(docs, public_tokenizers.path(FILES[1]), shard_bytes=4_000_000)
    assert len(json.loads(token_index._read(f"{path}/manifest.json"))["shards"]) > 4
    got = token_index.read(spark, path, token_index.expand(token_index.lookup(spark, path, docs.select("doc_id").distinct()), path)).collect()
    enc = plain(FILES[1])
    n, same, end = len(enc(long[: 25 * 1000])) - 1, enc("same text here"), enc("last")
    starts = sorted((r.start, r.doc_id, r.n_tokens) for r in got)
    first = 800 * n + 1
    assert starts == [(0, 3, first), *((first + k * len(same), 7, len(same)) for k in range(10_000)), (first + 10_000 * len(same), 9, len(end))]
    assert {r.ids_crc32 for r in got if r.doc_id == 7} == {crc(same)}
    packed = pack.pack(docs, public_tokenizers.path(FILES[0])).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in packed) <= 1024


def test_index_of_nothing(spark):
    path = token_index.write(frame(spark, [], DOCS), public_tokenizers.path(FILES[1]))
    assert token_index.lookup(spark, path, spark.range(5).withColumnRenamed("id", "doc_id")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 20000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(10**12, n, replace=False) - 10**11
    h = token_index.PerfectHash.build(keys)
    assert sorted(h.position(keys).tolist()) == list(range(n))
    assert [int(h.position(keys[i : i + 1])[0]) for i in range(min(n, 50))] == h.position(keys)[:50].tolist()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
def test_plan_holds_every_piece_once(hist):
    made, seen = pack.plan(hist, 64), Counter()
    for lengths, times in made.parts:
        assert sum(lengths) <= 64 and times > 0
        for x in lengths:
            seen[x] += times
    assert seen == Counter(hist)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=7))
def test_reduction_keeps_an_optimum(sizes):
    def best(items, bins=()):
        if not items:
            return len(bins)
        x, rest = items[0], items[1:]
        options = {b: i for i, b in enumerate(bins) if b + x <= 20}
        return min([best(rest, tuple(sorted(bins[:i] + (bins[i] + x,) + bins[i + 1 :]))) for i in options.values()] + [best(rest, tuple(sorted((*bins, x))))])

    made = pack.Plan()
    left = pack.reduce(Counter(sizes), 20, made)
    rest = [k for k, v in left.items() for _ in range(v)]
    assert made.sequences + best(sorted(rest, reverse=True)) == best(sorted(sizes, reverse=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200))
def test_plan_is_at_most_one_sequence_above_plain_best_fit(sizes):
    """Plain best-fit decreasing, piece by piece."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 100) - s)
    made = pack.plan(Counter(sizes), 100)
    assert -(-sum(sizes) // 100) <= made.sequences <= len(rooms) + 1


def test_three_pieces_are_fixed():
    made = pack.Plan()  # no three others fit, nor do two of those longer than 21
    assert not pack.reduce({50: 1, 28: 1, 21: 1, 27: 1}, 100, made).keys() & {50, 28, 21} and ((50, 28, 21), 1) in made.parts


@pytest.mark.parametrize("which", ["real", "awkward", "empty"])
def test_pack(spark, which):
    docs = real(spark) if which == "real" else frame(spark, [] if which == "empty" else [*awkward(), (3, "a", None, None, 1), (3, "a", None, None, 1)])
    enc = plain(FILES[0])
    got = pack.pack(docs, public_tokenizers.path(FILES[0])).collect()
    want = Counter()
    for r in docs.collect():
        ids = enc(r.text)
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, k, s, e - s, crc(ids[s:e])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    if which == "real":
        assert len(by) <= 1.05 * -(-sum(r.length for r in got) // 1024)


def test_a_stage_leaves_its_worker_small(spark, monkeypatch):
    """The worker's function of another stage forgets remembered pieces and gives freed memory back, also if it fails."""
    made, freed, kind = [], [], type(spark.range(1))
    plain_map = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: made.append(f) or plain_map(self, f, *a, **k))
    monkeypatch.setattr(_spark, "give_back", lambda: freed.append(1), raising=False)
    docs = frame(spark, awkward()).select("doc_id", "text")
    e = Encoder.of(public_tokenizers.path(FILES[0]), 2)
    batches = docs.toArrow().to_batches()
    langid.predict(docs, langid.Filter(["a"], [np.arange(9, dtype=np.uint64)], 10, 2))
    for given_, fails in ((batches, False), ([*batches, None], True)):
        want = e.ids(["a few words"])
        assert len(e.known) > 1
        freed.clear()
        if fails:
            with pytest.raises(AttributeError):
                list(made[-1](iter(given_)))
        else:
            assert sum(b.num_rows for b in made[-1](iter(given_))) == docs.count()
        assert freed == [1] and len(e.known) == 1 and not e.older
        assert e.ids(["a few words"]) == want
    pack.pieces(docs, public_tokenizers.path(FILES[0]))  # encodes: it frees, but remembers
    monkeypatch.setattr(pack.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    e.ids(["a few words"])
    freed.clear()
    list(made[-1](iter(batches)))
    assert freed == [1] and len(e.known) > 1
