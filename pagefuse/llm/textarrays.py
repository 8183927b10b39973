"""numpy kernels over many texts at once, laid end to end as UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U = np.uint64
#: An odd base: its powers have inverses modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Odd factors for combining neighbours.
FACTORS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165]
#: Bytes of text that one chunk holds, save for a longer single text.
CHUNK = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def give_back() -> None:
    """Hand memory that is free back to the system: workers live on and would keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(f: Callable) -> Callable:
    """``f``, after which free memory goes back to the system; of a generator, after its last item."""

    @wraps(f)
    def run(*args: object) -> object:
        out = f(*args)
        if not isinstance(out, Iterator):
            give_back()
            return out
        return drained(out)

    return run


def drained(items: Iterator) -> Iterator:
    """The items; then free memory goes back."""
    yield from items
    give_back()


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, dtype=U)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if len(have) <= 4 * CHUNK:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def string_parts(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying the bytes; a null has no bytes."""
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, dtype=kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    values = values[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1, i + 1)
        yield i, min(j, n)
        i = min(j, n)


def words(values: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, text number) of every word: the runs of bytes that are no white space, within a text.

    The hash is a polynomial in all bytes of the word, mixed with its length.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(values):
        return none, none, none.astype(U), none
    solid = ~_SPACE[values]
    edge = np.zeros(len(values) + 1, dtype=bool)
    edge[offsets[:-1]] = True
    first = solid & edge[:-1]
    first[1:] |= solid[1:] & ~solid[:-1]
    first[0] = solid[0]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    c = (_LOWER[values] if lower else values).astype(U)
    c += U(1)
    c *= powers(BASE, len(c))
    s = np.empty(len(c) + 1, dtype=U)
    s[0] = 0
    np.cumsum(c, out=s[1:])
    h = (s[end] - s[start]) * powers(BASE_INV, len(c))[start]
    h ^= (end - start).astype(U) * U(FACTORS[0])
    text = np.searchsorted(offsets, start, side="right") - 1
    return start, end, mix(h), text


def grams(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``n`` words within a text, in order."""
    m = len(h) - n + 1
    if m < 1:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = h[:m].copy()
    for j in range(1, n):
        g = mix(g * U(FACTORS[1])) + h[j : j + m]
    ok = text[:m] == text[n - 1 :]
    return mix(g[ok]), text[:m][ok]


def shingles(h: np.ndarray, text: np.ndarray, texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``n`` words; a text of 1 to n - 1 words has its whole sequence as its only one."""
    g, t = grams(h, text, n)
    per = np.bincount(text, minlength=texts)
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    extra_h, extra_t = [g], [t]
    for k in range(1, n):
        own = np.flatnonzero(per == k)
        if len(own):
            x = np.full(len(own), FACTORS[2 + k % 5], dtype=U) * U(k)
            for j in range(k):
                x = mix(x * U(FACTORS[1])) + h[first[own] + j]
            extra_h.append(mix(x))
            extra_t.append(own)
    g, t = np.concatenate(extra_h), np.concatenate(extra_t)
    if len(extra_h) > 1:
        o = np.argsort(t, kind="stable")
        g, t = g[o], t[o]
    return g, t


def sets(g: np.ndarray, t: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, laid end to end, and their offsets."""
    at = np.searchsorted(t, np.arange(texts + 1))
    parts = [np.unique(g[at[i] : at[i + 1]]) for i in range(texts)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else g[:0]), np.concatenate([[0], np.cumsum(sizes)])


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of ``data`` (by item offsets) as an Arrow binary array."""
    size = data.dtype.itemsize
    off = (offsets * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
