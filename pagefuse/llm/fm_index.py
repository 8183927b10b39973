"""Substring dedup over words with a compressed FM-index for each shard.

``repeats`` brings the segments that may repeat into shards.  A shard numbers
its words and builds the index of its different segments: the Burrows-Wheeler
transform as a wavelet matrix of packed bits with rank counts, and one bit for
each suffix that says where its first ``length`` words differ from the suffix
before.  The suffix array is needed only to build them and is not kept.

The segments are then streamed through backward search, many in step: each step
prepends a word; where the match is longer than a window, the interval is
widened by the bits to that of its first ``length`` words.  What stays are the
matching statistics capped at the window.  Positions whose match reaches the
threshold report their interval; positions with one interval hold the same
words, and the first place among them is where those words start first.

Edge cases: a null text has no words; texts of fewer words than a window lose
nothing; rows with a null id lose nothing and take nothing from others; rows
that share an id count as one document whose texts start at the same place; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import repeats
from . import textarrays as ta

U = np.uint64


class WaveletMatrix:
    """Symbols as bit planes, high bit first, each stably sorted by the planes above; 1.5 bits or so a symbol and plane."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.planes, self.counts, self.zeros = levels, [], [], []
        x, n = symbols.astype(np.int64), len(symbols)
        for level in range(levels - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(U)
            self.planes.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])[:-1].astype(np.uint32))
            self.zeros.append(n - int(bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Position in the last plane of the symbols equal to ``symbol`` before ``place``."""
        p = place
        for k in range(self.levels):
            w = p >> 6
            ones = self.counts[k][w] + np.bitwise_count(self.planes[k][w] & ((U(1) << (p & 63).astype(U)) - U(1)))
            ones = ones.astype(np.int64)
            p = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, p - ones)
        return p


class Marks:
    """Packed bits, the first one set, with the nearest set bit to the left and to the right of any place."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(U)
        some, at = self.words != 0, np.arange(len(self.words))
        self.left = np.maximum.accumulate(np.where(some, at, 0)).astype(np.uint32)
        self.right = np.minimum.accumulate(np.where(some, at, len(at))[::-1])[::-1].astype(np.uint32)

    def at_or_before(self, place: np.ndarray) -> np.ndarray:
        """The last set bit up to each place."""
        w = place >> 6
        x = self.words[w] & (~U(0) >> (63 - (place & 63)).astype(U))
        back = self.left[np.maximum(w - 1, 0)].astype(np.int64)
        w = np.where(x != 0, w, back)
        x = np.where(x != 0, x, self.words[back])
        for k in (1, 2, 4, 8, 16, 32):
            x = x | x >> U(k)
        return (w << 6) + np.bitwise_count(x).astype(np.int64) - 1

    def after(self, place: np.ndarray) -> np.ndarray:
        """The first set bit after each place; the number of bits where there is none."""
        w = place >> 6
        x = self.words[w] & ((~U(0) << (place & 63).astype(U)) << U(1))
        on = np.append(self.right, len(self.words))[w + 1].astype(np.int64)
        w = np.where(x != 0, w, on)
        x = np.where(x != 0, x, np.append(self.words, U(0))[on])
        low = np.bitwise_count((x & (~x + U(1))) - U(1)).astype(np.int64)
        return np.minimum((w << 6) + low, self.n)


class FMIndex:
    """FM-index of sequences of word numbers from 1; each ends with 0."""

    def __init__(self, text: np.ndarray, length: int) -> None:
        n = len(text)
        self.n, self.length = n, length
        sa, equal = suffixes(text, length)
        bwt = text[sa - 1]
        size = int(text.max()) + 1
        self.wavelet = WaveletMatrix(bwt, max(1, int(size - 1).bit_length()))
        # start of each symbol's zone among the suffixes, and where the last plane puts its first
        self.zone = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.base = self.wavelet.rank(np.arange(size), np.zeros(size, dtype=np.int64))
        self.marks = Marks(np.concatenate([[True], ~equal]))

    def prepend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more word in front; empty for a word that the index does not know."""
        known = symbol < len(self.base)
        symbol = np.where(known, symbol, 0)
        shift = self.zone[symbol] - self.base[symbol]
        lo, hi = self.wavelet.rank(symbol, lo) + shift, self.wavelet.rank(symbol, hi) + shift
        return lo, np.where(known, hi, lo)

    def matching(self, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of sequences ``text[first:last]``: for each position the match length, capped at
        the window, and its interval.  Sequences are streamed from the back, all in step.  Where a word makes the
        interval empty, its match is shortened from the right until it occurs.
        """
        length = np.zeros(len(text), dtype=np.int64)
        low, high = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
        order = np.argsort(first - last, kind="stable")  # longest first
        at, stop = last[order] - 1, first[order]
        lo, hi, m = np.zeros(len(at), np.int64), np.full(len(at), self.n), np.zeros(len(at), np.int64)
        while len(at):
            c = text[at]
            a, b = self.prepend(c, lo, hi)
            m = m + 1
            lost = np.flatnonzero(a >= b)
            if len(lost):
                m[lost], a[lost], b[lost] = self.longest(text, at[lost], np.minimum(m[lost] - 1, self.length))
            over = np.flatnonzero(m > self.length)
            if len(over):
                a[over], b[over] = self.marks.at_or_before(a[over]), self.marks.after(a[over])
            m = np.minimum(m, self.length)
            length[at], low[at], high[at] = m, a, b
            more = at > stop
            at, stop, lo, hi, m = at[more] - 1, stop[more], a[more], b[more], m[more]
        return length, low, high


    def search(self, text: np.ndarray, at: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the ``m`` words from each place; of all suffixes for none."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n)
        for k in range(int(m.max(initial=0)) - 1, -1, -1):
            own = np.flatnonzero((m > k) & (lo < hi))
            lo[own], hi[own] = self.prepend(text[at[own] + k], lo[own], hi[own])
        return lo, hi

    def longest(self, text: np.ndarray, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest match from each place of at most ``most`` words, by bisection, and its interval."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            a, b = self.search(text, at, mid)
            low, high = np.where(a < b, mid, low), np.where(a < b, high, mid - 1)
        return low, *self.search(text, at, low)


def suffixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by doubling, and whether neighbours agree in their first ``length`` symbols.

    The text is read as a ring; sequences end with 0, so order beyond an end
    only breaks ties.
    """
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, k, p = rank.astype(np.int64), 1, 1
    at_p = rank
    while True:
        second = np.roll(rank, -k)
        key = rank * (int(rank.max()) + 1) + second
        sa = np.argsort(key, kind="stable")
        s = key[sa]
        new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[sa] = new
        k *= 2
        if k <= length:
            at_p, p = rank, k
        if new[-1] == n - 1 or k >= n:
            break
    tail = np.roll(at_p, -(length - p))
    equal = (at_p[sa[1:]] == at_p[sa[:-1]]) & (tail[sa[1:]] == tail[sa[:-1]])
    return sa, equal


def window_firsts(data: np.ndarray, off: np.ndarray, wins: np.ndarray, doc: np.ndarray, pos: np.ndarray, plan: repeats.Plan) -> tuple[np.ndarray, np.ndarray]:
    """First place (document, position) of each window's words."""
    _, _, codes, seg = ta.words(data, off)
    _, number = np.unique(codes, return_inverse=True)
    size = np.bincount(seg, minlength=len(wins))
    first = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(len(codes) + len(wins), dtype=np.int64)
    text[np.arange(len(codes)) + seg] = number + 1
    index = FMIndex(text, plan.length)
    length, low, _ = index.matching(text, first, first + size)
    inside = np.arange(wins.sum()) - np.repeat(np.cumsum(wins) - wins, wins)
    start = np.repeat(first, wins) + inside
    if (length[start] < plan.length).any():
        raise RuntimeError("a window was not found in its own index")
    # positions above the threshold are grouped by the interval that the search reported for them
    group = low[start]
    d, p = np.repeat(doc, wins), np.repeat(pos, wins) + inside
    order = np.lexsort((p, d, group))
    lead = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    best = np.empty(index.n, dtype=np.int64)
    best[group[order][lead]] = order[lead]
    return d[best[group]], p[best[group]]


def digests(df: DataFrame, length: int = 20, anchor: int = 6, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """One row for each document: words, removed words, removed runs, SHA-256 of the rest.

    ``bucket_bytes`` is the text that one task holds.
    """
    plan = repeats.plan_for(df, "word", length, min(anchor, length), True, text_col, bucket_bytes)
    schema = f"`{id_col}` long, n_words long, n_removed long, n_spans long, kept_sha256 string"
    return repeats.find(df, plan, window_firsts, repeats.digest(plan, id_col, ["n_words", "n_removed", "n_spans"]), schema, id_col, text_col)
