"""Personal data replaced by keyed surrogates of the same type and format.

Detected: e-mail addresses, IPv4 and IPv6 addresses, IBANs (with a right check), telephone, card and social-security-
like numbers, and persons: a form of address or a listed given name before capitalised names (or upper-case ones, also
behind particles such as "von"); a listed Arabic given name or form of address and the word behind it; a common
Chinese, Japanese or Korean surname with up to two further characters before a form of address. Every replacement is a
keyed permutation without fixed point of all values of the entity's format: x -> P^-1(P(x) + 1), P a Feistel network
over the format's mixed radices. So the same entity has the same surrogate everywhere (coreference), different
entities have different ones (distinctness), none stays itself, and no table of entities is needed. Formats keep what
makes a value of its type: digits stay digits, separators, a telephone's country code and an IBAN's country stay,
octets stay below 256, a card number keeps its Luhn check (or its failure) and an IBAN its check, vowels and
consonants of the Latin, Greek and Cyrillic alphabets stay such, other letters stay in their block of Unicode, and so
do lengths and cases. Given names are permuted within their gender and script; other names within the names of their
format that aren't listed given names, so that the two kinds never meet. A person's names are replaced in the text
where they stand alone, too. Names and IPv6 addresses in another case are the same entity.

`collisions` checks over the whole corpus that no two entities have one surrogate, which the permutations rule out;
`replace` refuses to go on else.

Defined results: a null text stays null; empty texts and texts without entities stay as they are; a value of a format
without another value stays; repeated rows are treated alike; other columns are ignored unless in `keep`.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import lean, tune
from ._text import slices

KINDS = ("email", "ip", "ipv6", "iban", "phone", "card", "ssn", "person")

# Given names by (gender, script), forms of address by gender, particles, East Asian surnames and forms.
GIVEN = {
    ("f", "latin"): "Alice Amelia Anna Barbara Carmen Charlotte Claire Clara Elena Elizabeth Emily Emma Eva Hannah Helen Ines Isabel Jane Julia Karin Katherine Laura Linda Lucia Margaret Maria Marie Martha Mary Monika Nancy Olivia Patricia Petra Rachel Rosa Sarah Sofia Sophie Susan Teresa Ursula".split(),
    ("m", "latin"): "Adam Albert Alexander Andrew Antonio Arthur Carlos Charles Daniel David Diego Edward Fernando Francisco Frank George Hans Henry Jacques James Javier Jean John Jorge Joseph Juan Klaus Louis Luis Manuel Mark Michael Miguel Oliver Pablo Paul Pedro Peter Philippe Pierre Richard Robert Stefan Thomas William Wolfgang".split(),
    ("f", "cyrillic"): "Анна Вера Галина Екатерина Елена Ирина Людмила Мария Надежда Наталья Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Константин Михаил Николай Павел Сергей Юрий".split(),
    ("f", "greek"): "Άννα Γεωργία Δήμητρα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Γιάννης Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Σπύρος Χρήστος".split(),
    ("f", "arabic"): "خديجة زينب عائشة فاطمة مريم".split(),
    ("m", "arabic"): "أحمد حسن حسين خالد محمد يوسف".split(),
}
ADDRESS = {"f": "Mrs Ms Miss Madame Mme Mlle Frau Señora Sra Κυρία السيدة".split(), "m": "Mr Sir Monsieur Herr Señor Sr Κύριος Κύριε السيد".split(), "": "Dr Prof الدكتور".split()}
PARTICLES = "von van der den de la le du di da del della dos das bin ibn al el ter ten zu zur".split()
SURNAMES = "王 李 张 刘 陈 杨 黄 赵 吴 周 田中 佐藤 鈴木 高橋 伊藤 渡辺 山本 中村 小林 加藤 김 이 박 최 정".split()
HONORIFICS = "さん さま 様 先生 女士 小姐 씨 님".split()
_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäåæèéêëìíîïòóôöøùúûü", "çñýÿ", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
_CLASS = {c: k for k, s in enumerate(_CLASSES) for c in s}
_GENDER = {n: key for key, names in GIVEN.items() for n in names}

_DOMAIN = re.compile(r"((?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+)([A-Za-z]{2,24})(?![A-Za-z0-9])")
_LOCAL = re.compile(r"[\w.+%-]{1,64}\Z")
_REGION = re.compile(r"[+(]?\d[\d .()\-]{5,}\d")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NUMBERS = (
    ("ip", re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)")),
    ("card", re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?!\d)")),
    ("phone", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?!\d)")),
    ("ssn", re.compile(r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)")),
)
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = r"[^\W\d_]+(?:-[^\W\d_]+|['’][A-ZÀ-Þ][^\W\d_]+)*"
_FORMS = {a for v in ADDRESS.values() for a in v}
_FORMS |= {a.upper() for a in _FORMS}
_CALLED = {*_GENDER, *(n.upper() for n in _GENDER)}
_longest = lambda words: "|".join(sorted(words, key=len, reverse=True))
_PERSON = re.compile(rf"\b((?:(?:{_longest(_FORMS)})\.?[ ]+)+)?(?:({_longest(_CALLED)})\b|(?<=[ ])({_NAME}))")
#: A further name, behind particles if any; an initial may have a dot.
_FURTHER = re.compile(rf"[ ]+(?:(?:{_longest(PARTICLES)})[ ]+)*({_NAME})(?:(?<=[ ][^\W\d_])\.(?=[ ]))?")
_EAST = re.compile(rf"((?:{_longest(SURNAMES)})[\u4e00-\u9fff\uac00-\ud7a3]{{0,2}}?)[ ]?(?:{_longest(HONORIFICS)})")

#: Words that a person can begin with, and a cheap pattern that finds their like: most texts have none.
_STARTS = {*_CALLED, *_FORMS}
_START = re.compile(rf"[{''.join(sorted({w[0] for w in _STARTS}))}]\w+")


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode(), "sha256")[:16], "big")


class Permutation:
    """A keyed permutation of 0..n-1 without fixed points (n >= 2)."""

    def __init__(self, key: bytes, name: str, n: int):
        self.key, self.name, self.n = key, name, n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1

    def _round(self, k: int, x: int) -> int:
        out = 0
        for block in range(-(-self.half // 128)):
            out = out << 128 | _prf(self.key, self.name, self.n, k, x, block)
        return out & self.mask

    def _forth(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for k in range(6):
                a, b = b, a ^ self._round(k, b)
            x = a << self.half | b
            if x < self.n:
                return x

    def _back(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for k in reversed(range(6)):
                a, b = b ^ self._round(k, a), a
            x = a << self.half | b
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        return self._back((self._forth(x) + 1) % self.n) if self.n > 1 else x


def _simple(c: str) -> bool:
    """Is it a lower-case letter with one upper-case letter of its own?"""
    u = c.upper()
    return len(u) == 1 and u != c and u.lower() == c


@functools.lru_cache(1 << 16)
def _alphabet(c: str) -> tuple[str, str, int, bool]:
    """(name, letters, place, upper case?) of the alphabet in which a character is permuted; no letters: it stays."""
    low = c.lower()
    upper = len(low) == 1 and low != c and _simple(low) and low.upper() == c
    low = low if upper else c
    if low in _CLASS:
        name, letters = str(_CLASS[low]), _CLASSES[_CLASS[low]]
    elif low.isalpha():
        like = lambda d: (unicodedata.category(d), _simple(d), unicodedata.normalize("NFKC", d) == d)
        block, what = ord(low) >> 7, like(low)
        letters = "".join(d for d in map(chr, range(block << 7, block + 1 << 7)) if d not in _CLASS and like(d) == what) if what[2] else low
        name = f"{block}{what}"
    else:
        return "", "", 0, False
    return name, letters, letters.index(low), upper


def _index(text: str) -> tuple[str, int, int]:
    """(format, number of its values, this text's place among them)."""
    n, x, shape = 1, 0, []
    for c in text:
        name, letters, at, _ = _alphabet(c)
        shape.append(f"\x00{name}\x01" if letters else c)
        if letters:
            x, n = x * len(letters) + at, n * len(letters)
    return "".join(shape), n, x


def _value(text: str, x: int) -> str:
    """The x-th value of a text's format, in the text's cases."""
    out = []
    for c in reversed(text):
        _, letters, _, upper = _alphabet(c)
        if letters:
            x, at = divmod(x, len(letters))
            c = letters[at].upper() if upper else letters[at]
        out.append(c)
    return "".join(reversed(out))


def _shaped(key: bytes, name: str, text: str, taken: tuple[int, ...] = ()) -> str:
    """Permute a text among those of its format, but for the values `taken` (ascending), of which it is none."""
    shape, n, x = _index(text)
    x = Permutation(key, f"{name}|{shape}", n - len(taken))(x - bisect.bisect_left(taken, x))
    for t in taken:
        x += x >= t
    return _value(text, x)


@functools.cache
def _listed() -> dict[str, tuple[int, ...]]:
    """By format: the places of the listed given names."""
    out: dict[str, list[int]] = {}
    for name in _GENDER:
        shape, _, x = _index(name)
        out.setdefault(shape, []).append(x)
    return {k: tuple(sorted(v)) for k, v in out.items()}


def _luhn(digits: str) -> int:
    """The check digit of a number without its last digit."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def surrogate(key: bytes, kind: str, text: str) -> str:
    """The replacement of an entity other than a person."""
    if kind == "email":
        local, _, domain = text.partition("@")
        name, dot, top = domain.rpartition(".")
        return f"{_shaped(key, 'local|' + domain.lower(), local)}@{_shaped(key, 'domain', name)}{dot}{top}"
    if kind == "ip":
        a, b, c, d = map(int, text.split("."))
        x = Permutation(key, "ip", 1 << 32)(a << 24 | b << 16 | c << 8 | d)
        return f"{x >> 24}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"
    if kind == "ipv6":
        digits = re.sub("[^0-9a-f]", "", text.lower())
        x = Permutation(key, "ipv6|" + re.sub("[0-9A-Fa-f]", "h", text), 16 ** len(digits))(int(digits, 16))
        new = iter(f"{x:0{len(digits)}{'x' if text == text.lower() else 'X'}}")
        return re.sub("[0-9A-Fa-f]", lambda _: next(new), text)
    if kind == "iban":
        plain = text.replace(" ", "")
        new = plain[:2] + "00" + _shaped(key, "iban" + plain[:2], plain[4:])
        new = iter(f"{new[:2]}{98 - _mod97(new):02d}{new[4:]}")
        return re.sub("[^ ]", lambda _: next(new), text)
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        off = (int(digits[-1]) - _luhn(digits[:-1])) % 10
        new = _shaped(key, f"card{off}", digits[:-1])
        new = iter(new + str((_luhn(new) + off) % 10))
        return re.sub(r"\d", lambda _: next(new), text)
    if kind == "phone" and text[0] == "+":
        code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", text)[0]
        return code + _shaped(key, "phone" + code, text[len(code) :])
    return _shaped(key, kind, text)


def person(key: bytes, name: str) -> str:
    """A name's surrogate: a listed given name's is one of its gender and script, another's is not listed."""
    plain = name if name in _GENDER else name.capitalize()
    if plain not in _GENDER:
        shape, *_ = _index(name)
        return _shaped(key, "last", name, _listed().get(shape, ()))
    pool = GIVEN[_GENDER[plain]]
    new = pool[Permutation(key, "given|" + "|".join(_GENDER[plain]), len(pool))(pool.index(plain))]
    return new if name == plain else new.upper()


class _Spans:
    """Spans found, none over another; the first to come stays."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, str, str]] = []

    def free(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.rows, (end,))  # the first that begins at `end` or later
        return k == 0 or self.rows[k - 1][1] <= start

    def add(self, start: int, end: int, kind: str, new: str) -> None:
        if self.free(start, end):
            bisect.insort(self.rows, (start, end, kind, new))


def _persons(text: str) -> set[str]:
    """Names of persons in a text."""
    names: set[str] = set()
    m = None if _STARTS.isdisjoint(_START.findall(text)) else _PERSON.search(text)
    while m:
        run, end = [m[2] or m[3]], m.end()
        cased = run[0][0] != run[0][0].lower()
        if m[2] or (m[1] and (cased or run[0][0].isalpha() and run[0][0] == run[0][0].upper())):
            shout = cased and len(run[0]) > 1 and run[0].isupper()
            while (k := _FURTHER.match(text, end)) and k[1] not in _FORMS and (cased or len(run) == 1):
                first = k[1][0]
                # Capitalised words all the way; without cases, one word; after an upper-case name, upper-case words.
                if not (first.isupper() if cased else first == first.upper() and not first.isascii()) or (shout and not k[1].isupper()):
                    break
                run.append(k[1])
                end = k.end()
            if m[1] or len(run) > 1:
                names.update(run)
        m = _PERSON.search(text, end)
    return names | {y for x in names if len(x) > 1 for y in ((x.title(),) if x.isupper() else (x.upper(),) if x.istitle() else ())}


def entities(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, surrogate), by start, without overlaps."""
    found = _Spans()
    at = text.find("@")
    while at >= 0:
        left, right = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if left and right:
            start = left.start() + len(left[0]) - len(left[0].lstrip(".-%+"))
            if start < at:
                found.add(start, right.end(), "email", surrogate(key, "email", text[start : right.end()]))
        at = text.find("@", at + 1)
    if text.count(":") > 1:
        for m in _IPV6.finditer(text):
            if len(m[0]) > 5 and re.search(r"\d", m[0]) and len(m[0].strip(":").split(":")) > 1:
                try:
                    ipaddress.IPv6Address(m[0])
                except ValueError:
                    continue
                found.add(*m.span(), "ipv6", surrogate(key, "ipv6", m[0]))
    for m in _IBAN.finditer(text):
        one = m[0]
        while one and not (15 <= len(one.replace(" ", "")) <= 34 and _mod97(one.replace(" ", "")) == 1):
            one = one.rpartition(" ")[0]  # a word behind it, perhaps
        if one:
            found.add(m.start(), m.start() + len(one), "iban", surrogate(key, "iban", one))
    for r in _REGION.finditer(text):
        for kind, pattern in _NUMBERS:
            for m in pattern.finditer(text, r.start(), r.end()):
                if found.free(*m.span()):
                    found.add(*m.span(), kind, surrogate(key, kind, m[0]))
    if names := _persons(text):  # where they stand alone, too
        new = {x: person(key, x) for x in names}
        for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})\b", text):
            found.add(*m.span(), "person", new[m[0]])
    if not text.isascii():
        for name in {m[1] for m in _EAST.finditer(text)}:
            where = re.finditer(re.escape(name), text) if len(name) > 1 else (m for m in _EAST.finditer(text) if m[1] == name)
            for m in where:
                found.add(m.start(), m.start() + len(name), "person", person(key, name))
    return found.rows


def _entity(kind: str, text: str) -> str:
    """A hash of what an entity is: names and IPv6 addresses are the same in any case."""
    return hashlib.sha256((text.lower() if kind in ("person", "ipv6") else text).encode()).hexdigest()[:32]


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, surrogate) that more than one entity of the corpus has: no row, if all is well. Entities are compared by hashes."""
    tune(docs.sparkSession)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = {(k, _entity(k, t[s:e]), new) for t in part.column("text").to_pylist() if t for s, e, k, new in entities(t, key)}
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["kind", "entity", "surrogate"])

    rows = docs.select("text").mapInArrow(lean(detect), "kind string, entity string, surrogate string")
    return rows.groupBy("kind", "surrogate").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).where("a <> b").select("kind", "surrogate")


def replace(docs: DataFrame, key: bytes, *, keep: tuple[str, ...] = ("doc_id",), check: bool = True) -> DataFrame:
    """Per document: `keep`, text with surrogates, n_entities, entities (kind:start:end in the original text, comma-joined)."""
    tune(docs.sparkSession)
    if check and not (bad := collisions(docs, key)).isEmpty():
        raise ValueError(f"surrogates collide: {bad.take(3)}")
    names = [c for c in keep if c != "text"]
    rows = docs.select(*names, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", n_entities long, entities string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, n, spans = [], [], []
                for t in part.column("text").to_pylist():
                    found = entities(t, key) if t else []
                    for s, e, _, new in reversed(found):
                        t = t[:s] + new + t[e:]
                    texts.append(t)
                    n.append(len(found))
                    spans.append(",".join(f"{k}:{s}:{e}" for s, e, k, _ in found))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(spans, pa.string())], [*names, "text", "n_entities", "entities"])

    return rows.mapInArrow(lean(apply), schema)
