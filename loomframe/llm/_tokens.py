"""Token ids with the tokenizers library, memoised by stretches of text that the pre-tokenizer never joins.

A byte-pair encoder works on each pre-token alone, so a text may be cut wherever its pre-tokenizer always cuts; the
pieces' ids in a row are the text's ids. Most pieces recur, and only new ones are encoded. `tests/llm` holds the
result against plain encoding of whole texts.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np

#: Pieces that one worker remembers (about 400 bytes each, twice as many at most) and the longest of them in characters.
MEMORY, LONGEST = 300_000, 48
_CUT = "\x00"
#: A text with one of these isn't cut: runs of blanks, and blanks other than a single space or line break.
_RUNS = ("  ", " \n", "\n ", "\n\n")
_ODD = "\x00\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_ASCII = _ODD[:9]


def _pieces_bytes(text: str) -> list[str]:
    """Pieces for a byte-level encoder whose pattern is ` ?letters| ?digits| ?marks|blanks`."""
    for x in _RUNS:
        if x in text:
            return [text]
    for x in _ODD_ASCII if text.isascii() else _ODD:
        if x in text:
            return [text]
    return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split(_CUT)


def _pieces_words(text: str) -> list[str]:
    """Pieces for an encoder that drops white space."""
    return text.replace("\n", " ").split(" ")


def _ends_alnum(c: str) -> bool:
    """Is a character a letter or a number, and is it one still, normalised and in lower case?"""
    return c.isalnum() and (c.isascii() or unicodedata.normalize("NFC", c).lower()[-1].isalnum())


class Encoder:
    """ids(texts): each text's ids as little-endian unsigned 32-bit bytes, the end id appended."""

    _made: dict[tuple, Encoder] = {}

    def __init__(self, path: str, end_id: int, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memory = memory
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        self.encode.encode_special_tokens = True  # their strings in a text are ordinary text
        spec = self.encode.pre_tokenizer.__getstate__().decode()
        # Where the pre-tokenizer isn't one of the two known kinds, whole texts are encoded.
        self.pieces = _pieces_words if '"Removed"' in spec and r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in spec else _pieces_bytes if spec.startswith('{"type":"ByteLevel","add_prefix_space":false') and '"use_regex":true' in spec else None
        self.end = np.array([end_id], "<u4").tobytes()
        vocabulary = self.encode.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("Ġ") if self.pieces is _pieces_bytes else token.endswith("</w>")
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, end_id: int, memory: int = MEMORY) -> Encoder:
        """One encoder for each worker process."""
        key = (path, end_id, memory)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    @classmethod
    def forget(cls) -> None:
        """Drop the remembered pieces of this worker process; the encoders stay."""
        for e in cls._made.values():
            e.known, e.older = {"": b""}, {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.encode.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, units: list[str]) -> list[bytes]:
        """Ids of pieces of letters only, many in one call. Each is one pre-token, which the vocabulary marks: the
        first token of ` word` has its blank, the last token of `word` has the word's end."""
        out: list[bytes] = []
        spaced = self.pieces is _pieces_bytes
        groups = [units[k : k + 400] for k in range(0, len(units), 400)]
        for group, e in zip(groups, self.encode.encode_batch_fast([("" if spaced else " ").join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.edge[ids])
            cut = (4 * (np.append(at, len(ids)) if spaced else np.append(0, at + 1))).tolist()
            if len(cut) != len(group) + 1:  # a letter whose lower case is no letter, say
                out += self._plain(group)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return out

    def _new(self, pieces: list[str]) -> list[tuple[str, bytes]]:
        spaced = self.pieces is _pieces_bytes
        words = [p for p in pieces if (p[1:].isalpha() and p[0] == " " if spaced else p.isalpha())]
        others = list(set(pieces).difference(words))
        return [*zip(words, self._letters(words), strict=True), *zip(others, self._plain(others), strict=True)]

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.pieces is None:
            return [x + self.end for x in self._plain(texts)]
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > self.memory:  # pieces that recur come back from the older half
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        new = set().union(*cut).difference(known)
        if older:
            known.update({k: older[k] for k in new if k in older})
            new.difference_update(known)
        # A word with a mark behind it: the mark is a pre-token of its own.
        marked = [k for k in new if len(k) > 1 and k[-1] in ",." and _ends_alnum(k[-2])]
        new.difference_update(marked)
        new.update(k for m in marked for k in (m[:-1], m[-1]) if k not in known)
        made = list(new)
        known.update(self._new(made))
        known.update([(m, known[m[:-1]] + known[m[-1]]) for m in marked])
        out = [b"".join(map(known.__getitem__, x)) + self.end for x in cut]
        for k in made + marked:
            if len(k) > LONGEST:
                known.pop(k, None)
        return out
