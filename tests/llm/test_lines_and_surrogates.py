import itertools
import re
from collections import defaultdict

import corpus_pipeline
from helpers import DOCS, awkward, frame, real
from pyspark.sql import functions as F

from loomframe.llm import lines, queries, surrogates

KEY = b"test key"
WORD = re.compile(b"[^\x20\x09-\x0d]+")


def brute_lines(docs, min_docs=3, min_words=5):
    lower = lambda w: re.sub(b"[A-Z]", lambda m: m[0].lower(), w)

    def keys(line):
        w = [None if re.search(b"[0-9]", x) else lower(x) for x in WORD.findall(line.encode())]
        if len(w) < min_words:
            return
        yield (0, *w)
        if len(w) >= lines.GENERAL:
            n = len(w) - lines.DEPTH
            for k in range(4):
                lo, hi = lines.DEPTH + n * k // 4, lines.DEPTH + n * (k + 1) // 4
                yield (k + 1, len(w), *w[:lo], "*", *w[hi:])
            yield (5, len(w), "*", *w[lines.DEPTH :])

    seen = defaultdict(lambda: [0, lines.NO_ID])
    big = lambda d: lines.NO_ID if d is None else d
    for d, t in docs:
        for k in {k for x in (t or "").split("\n") for k in keys(x)}:
            seen[k][0] += 1
            seen[k][1] = min(seen[k][1], big(d))
    out = []
    for d, t in docs:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        ls = t.split("\n")
        kept = [x for x in ls if not any(seen[k][0] >= min_docs and seen[k][1] != big(d) for k in keys(x))]
        out.append((d, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out, key=str)


LOGS = ["Ann Lee Smith signed in from the office\nsomething else here entirely now", "Bob said Jones signed in from the office", "a third person signed in from the office", "start\nuser 17 logged in from host alpha beta gamma delta today\nend of it all now", "user 18 logged in from host alpha other words delta today\n", "A\nuser 99 logged in from host alpha beta gamma delta today\nuser 1 logged in from host", "unrelated line of words here", "End of it all now\n\nunrelated line of words here\nunrelated line of words here"]


def test_lines(spark):
    for docs in (real(spark), frame(spark, [*awkward(LOGS), *awkward(LOGS)[-4:], (None, LOGS[0], None, None, 1)]), frame(spark, [], DOCS)):
        want = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
        for rows in (10**6, 0):
            assert sorted((tuple(r) for r in lines.drop_lines(docs, broadcast_rows=rows).collect()), key=str) == want


def test_long_lines_recur_from_two_documents_on(spark, tmp_path):
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    long, short, other, like = (" ".join(x) for x in (words[:50], words[1:50], words[5:60], [*words[5:30], "else", *words[31:60]]))
    docs = frame(spark, [(i, t, None, None, 1) for i, t in enumerate(["a\n" + long, "b\n" + long.upper(), other, "c\n" + short, "d\n" + short, like])])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [(0, "a\n" + long), (1, "b"), (2, other), (3, "c\n" + short), (4, "d\n" + short), (5, like)]
    made = [lines.drop_lines(docs, long_words=lines.LONG, broadcast_rows=rows) for rows in (10**6, 0)]
    for out in (*made, queries.op6_lines(spark, str(tmp_path)), corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path))):
        assert sorted(tuple(r) for r in out.select("doc_id", "text").collect()) == want


PII = [
    "Mr. John Smith wrote to ann.lee@mail.example.org, Smith said.",
    "call +1 (705) 555-5569 or 555-123-4567; ip 10.0.0.255, card 4111 1111 1111 1111 and 5500000000000004.",
    "ssn 123-45-6789 x.und.34@mail7.example.com Анна Иванова и Иванова @ a@b 1.2.3.4.5",
    "again ann.lee@mail.example.org and 10.0.0.255 from John Smith",
    "Mary Jones and Mary",
]


def test_surrogates(spark):
    rows = {r.doc_id: r for r in surrogates.replace(frame(spark, awkward(PII)), KEY).collect()}
    assert len(rows) == len(awkward(PII))
    n = len(awkward())
    assert [rows[n + k].n_entities for k in range(5)] == [4, 5, 5, 4, 3]
    for i, r in rows.items():
        if i < n:
            assert r.n_entities == 0 and r.text == awkward()[i][1]
    out, back = defaultdict(set), defaultdict(set)
    for k, t in enumerate(PII):
        for s, e, kind, new in surrogates.entities(t, KEY):
            old = t[s:e]
            out[old].add(new)
            back[kind, new].add(old)
            assert old != new and len(old.split()) == len(new.split()) and old not in rows[n + k].text
            if kind in ("card", "ssn", "phone"):
                assert re.sub(r"\d", "9", old) == re.sub(r"\d", "9", new)
            if kind == "card":
                d, f = (re.sub(r"\D", "", x) for x in (old, new))
                assert (surrogates._luhn(d[:-1]) == int(d[-1])) == (surrogates._luhn(f[:-1]) == int(f[-1]))
            if kind == "person" and old in surrogates._GENDER:
                assert surrogates._GENDER[old] == surrogates._GENDER[new]
    assert all(len(v) == 1 for v in [*out.values(), *back.values()])


def test_names_of_more_than_two_parts():
    texts = {"John Fitzgerald Kennedy spoke, Kennedy said.": "John Fitzgerald Kennedy Kennedy", "then Anna Maria Lopez met Maria": "Anna Maria Lopez Maria", "Prof. Dr. Hans Peter Vogel Mr Brown came": "Hans Peter Vogel Brown", "see Mary K. Ostrom today": "Mary K Ostrom", "Mrs. Stone and Peter Paul Grey met John": "Stone Peter Paul Grey"}
    for t, want in texts.items():
        found = surrogates.entities(t, KEY)
        assert [t[s:e] for s, e, *_ in found] == want.split()
        assert all(t[s:e] != new and (t[s:e] in surrogates._GENDER) == (new in surrogates._GENDER) for s, e, _, new in found)


FOUND = {
    "用户@example.com wrote": ["用户@example.com"],
    "Dr Łęg and JOHN SMITH met John von Neumann; Smith left.": ["Łęg", "JOHN", "SMITH", "John", "Neumann", "Smith"],
    "IBAN DE89 3704 0044 0532 0130 00 AND 2001:db8::ff00:42:8329 at 12:30:45": ["DE89 3704 0044 0532 0130 00", "2001:db8::ff00:42:8329"],
    "a@b.com " * 9 + "555-123-4567@example.com +1 705 555 5569": ["a@b.com"] * 9 + ["555-123-4567@example.com", "+1 705 555 5569"],
    "Mary O'Brien, John@x.com": ["Mary", "O'Brien", "John@x.com"],
    "محمد العلي قال": ["محمد", "العلي"],
    "田中さんと王小明先生 김민수 씨. 田中": ["田中", "王小明", "김민수", "田中"],
    "κύριος Γιώργος Παπαδόπουλος": ["Γιώργος", "Παπαδόπουλος"],
    "std::vector a::b 10:20, THE END, Frank words here and Mark": [],
}


def test_kinds_of_entities():
    import ipaddress

    for t, want in FOUND.items():
        found = surrogates.entities(t, KEY)
        assert [t[s:e] for s, e, *_ in found] == want
        for s, e, kind, new in found:
            old = t[s:e]
            assert new != old and ((len(new) == len(old) and not set(old) & set(new) & set("用户")) or kind == "person") and old.isupper() == new.isupper()
            if kind == "ipv6":
                ipaddress.IPv6Address(new)
            if kind == "iban":
                assert surrogates._mod97(new.replace(" ", "")) == 1 and new[:2] == old[:2]


def test_no_two_short_names_have_one_surrogate(spark):
    """All names of three letters and the listed ones, in one corpus: nothing collides, nothing stays itself."""
    v, c = "aeiou", "bcdfghjklmnpqrstvwxyz"
    names = {"".join(x).capitalize() for p in ((v, c, v), (c, v, c), (v, v, c), (c, v, v)) for x in itertools.product(*p)} | {*surrogates._GENDER}
    new = {n: surrogates.person(KEY, n) for n in names}
    assert len(set(new.values())) == len(names) and all(a != b and (a in surrogates._GENDER) == (b in surrogates._GENDER) for a, b in new.items())
    assert sum(map(len, surrogates.GIVEN.values())) == len(surrogates._GENDER)
    docs = frame(spark, [(i, f"Mr {n} wrote.", None, None, 1) for i, n in enumerate(sorted(names)) if n.isascii() and n not in surrogates._FORMS] + [(None, "Jane Miller wrote.", None, None, 1)])
    assert surrogates.replace(docs.withColumns({x: F.lit(x) for x in ("kind", "entity", "surrogate", "entities")}), KEY).where("n_entities > 0").count() == docs.count()


def test_permutations_have_no_fixed_points():
    for n in (2, 3, 10, 97, 1000):
        p = surrogates.Permutation(KEY, "t", n)
        v = [p(i) for i in range(n)]
        assert sorted(v) == list(range(n)) and all(a != b for a, b in enumerate(v))


def test_real_corpus(spark):
    docs = real(spark, "sf0.01")
    assert surrogates.collisions(docs, KEY).isEmpty()
    got = surrogates.replace(docs, KEY, check=False)
    old = {r.doc_id: r.text for r in docs.collect()}
    seen = 0
    for r in got.collect():
        for m in re.findall(r"[\w.]+@[\w.]+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)", old[r.doc_id]):
            assert m not in r.text
            seen += 1
    assert seen > 20
    assert surrogates.replace(frame(spark, [], DOCS), KEY).count() == 0
