"""Vectorised text primitives over Arrow string buffers (UTF-8 bytes, no Python string per row)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes that one step works on; bounds the memory of a Python worker (a longer single text is a step of its own).
STEP_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LANES = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_R = U64(0x9E3779B97F4A7C15)
_R_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, U64), np.ones(1, U64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of [^\x20\x09-\x0D].
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: Powers that a worker keeps; those for a longer text are made for it alone.
_KEPT = STEP_BYTES + (1 << 16)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    def made(r: np.uint64, n: int) -> np.ndarray:
        p = np.full(n, r, U64)
        p[0] = 1
        return np.cumprod(p)

    if n > _KEPT:
        return made(_R, n), made(_R_INV, n)
    if len(_powers[0]) < n:
        _powers[:] = made(_R, _KEPT), made(_R_INV, _KEPT)
    return _powers[0][:n], _powers[1][:n]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most `limit` bytes of text (at least one row each)."""
    _, offs = buffer(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = to


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null texts are empty."""
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n, wide = len(col), pa.types.is_large_string(col.type)
    _, ob, db = col.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(ob, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(db, np.uint8)[offs[0] : offs[-1]] if db is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


class Words:
    """Words of a batch of texts: byte spans, first word of each text, 64-bit hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray):
        self.data, self.offs = LOWER[data], offs
        m = kind[self.data]
        n = len(m)
        full = offs[:-1] < offs[1:]
        prev, nxt = np.zeros(n, bool), np.zeros(n, bool)
        prev[1:], nxt[:-1] = m[:-1], m[1:]
        prev[offs[:-1][full]] = False
        nxt[offs[1:][full] - 1] = False
        self.start = np.flatnonzero(m & ~prev)
        self.end = np.flatnonzero(m & ~nxt) + 1
        self.first = np.searchsorted(self.start, offs)  # word index at which each text begins, and the total

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, U64)
        r, inv = _power(n)
        c = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[self.data] * r, out=c[1:])
        h = (c[self.end] - c[self.start]) * inv[self.start]
        h += (self.end - self.start).astype(U64) * _LANES[63]
        return mix(h)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def join(self, i: int, n: int) -> bytes:
        return b" ".join(self.text(k) for k in range(i, i + n))


def shingles(h: np.ndarray, size: int, skips: tuple[int, ...] | None = None) -> np.ndarray:
    """Hash of each `size` words in a row (len(h) - size + 1 values), texts not yet told apart. skips: offsets instead of 0..size-1."""
    at = skips or tuple(range(size))
    n = len(h) - at[-1]
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64((0x51ED270B * (at[-1] + 1) + len(at)) % 2**64), U64)
    for k, o in enumerate(at):
        out += h[o : o + n] * _LANES[k % 60] if k < 60 else h[o : o + n] * _LANES[k % 60] * _R
    return mix(out)


def inside(first: np.ndarray, reach: int) -> np.ndarray:
    """Mask over word positions (len = words - reach + 1): does a window of `reach` words from here stay in its text?"""
    n = int(first[-1]) - reach + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n + reach, np.int8)
    for k in range(1, reach):  # the last reach-1 words of each text start no window
        at = first[1:] - k
        ok[at[(at >= first[:-1]) & (at >= 0)]] = 0
    return ok[:n].astype(bool)
