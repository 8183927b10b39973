"""Runs: stretches of words that repeat with a period, found by way of tandem repeats in linear time.

The method is Gusfield and Stoye's, on the words of many texts laid end to end,
a separator of its own after each:

1. A suffix array by doubling; its block names answer how far two places agree,
   forwards and backwards.  The Lempel-Ziv blocks of the string follow from it.
2. The first occurrence of a tandem repeat (a word sequence twice in a row)
   can't lie inside one block.  For each block and each half-length, the agreement
   around its border and its start gives the leftmost repeat of that length
   there: the covering set.
3. In the suffix tree each of them is a place on an edge.  Following suffix
   links from there, and one word further, gives the rotations that are
   repeats as well, until there is none or it is known: the complete vocabulary.
4. Repeats whose half is no repetition itself are located: the leaves below
   their places are their starts.  Starts that follow each other with one
   half-length are one run, and that is maximal.

A run has the smallest period ``q``, at least ``min_length`` words and at
least ``min_periods`` periods.  Before the string is built, words that no such
run can hold are left out: each three words in a row within a run occur
``min_periods - 1`` times in it, so a text falls into the stretches whose word
triples do, again and again.  That loses no run and splits none.

Words are compared by 64-bit hashes.  Each text is worked on in one task.

Edge cases: a null or empty text has no runs and an empty collapsed text;
repeated rows and null ids are rows of their own; an empty table gives no rows;
columns that are not asked for are not read.  A very long text takes about a
kilobyte of memory for each word in a repetitive stretch, and none for others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .repeats import left

U = np.uint64
#: Agreements that are worked out at once.
SLICE = 1 << 19


class Agreement:
    """How far the string agrees with itself from two places on; ``order`` is its suffix array."""

    def __init__(self, codes: np.ndarray, longest: int) -> None:
        n, step = len(codes), 1
        self.n, names = n, np.unique(codes, return_inverse=True)[1].astype(np.int32)
        self.names = [np.append(names, np.int32(-1))]
        while step <= longest and names.max(initial=0) < n - 1:
            second = np.full(n, -1, dtype=np.int64)
            second[: n - step] = names[step:]
            key = names.astype(np.int64) * (n + 1) + second + 1
            o = np.argsort(key)
            ranked = np.cumsum(np.concatenate([[0], key[o][1:] != key[o][:-1]]))
            names = np.empty(n, dtype=np.int32)
            names[o] = ranked
            self.names.append(np.append(names, np.int32(-1)))
            step *= 2
        self.rank = names
        self.order = np.empty(n, dtype=np.int64)
        self.order[names] = np.arange(n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and j (different places) on."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            out += (self.names[k][i + out] == self.names[k][j + out]).astype(np.int64) << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words that end with i and j (different places, -1: none)."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            ok = (a >= 0) & (b >= 0)
            out += (ok & (self.names[k][np.where(ok, a, 0)] == self.names[k][np.where(ok, b, 0)])).astype(np.int64) << k
        return out


def blocks(agree: Agreement) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end: each is the longest that also starts earlier, or one word."""
    order = agree.order.tolist()
    n = len(order)
    before, after, stack = [-1] * n, [-1] * n, []
    for p in order:  # nearest neighbours in the suffix array that start earlier in the string
        while stack and stack[-1] > p:
            after[stack.pop()] = p
        before[p] = stack[-1] if stack else -1
        stack.append(p)
    here = np.arange(n)
    size = np.ones(n, dtype=np.int64)
    for near in (np.array(before), np.array(after)):
        own = np.flatnonzero(near >= 0)
        size[own] = np.maximum(size[own], agree.forward(here[own], near[own]))
    starts, at, size = [], 0, size.tolist()
    while at < n:
        starts.append(at)
        at += size[at]
    return np.array([*starts, n])


def covering(agree: Agreement, cuts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, half-length) of tandem repeats from which rotations reach the first occurrence of every one."""
    size = np.diff(cuts)
    starts, halves = [], []

    def each(most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(block, half-length) pairs, from 1 to the most of each block, slice by slice."""
        end = np.cumsum(most)
        for a in range(0, int(end[-1]) if len(end) else 0, SLICE):
            x = np.arange(a, min(a + SLICE, int(end[-1])))
            b = np.searchsorted(end, x, side="right")
            yield b, x - (end[b] - most[b]) + 1

    # repeats that start in the block, have their middle in it and reach over its end
    for b, k in each(np.minimum(size[:-1], longest // 2)):
        h = cuts[b + 1]
        q = h - k
        ahead, back = agree.forward(h, q), agree.backward(h - 1, q - 1)
        ok = (ahead > 0) & (ahead + back >= k)
        starts.append(np.maximum(q - back, q - k + 1)[ok])
        halves.append(k[ok])
    # repeats that start before the block and have their middle in it
    most = np.minimum(size + np.append(size[1:], 0), np.minimum(longest // 2, agree.n - 1 - cuts[:-1]))
    for b, k in each(np.maximum(most, 0)):
        h = cuts[b]
        q = h + k
        ahead, back = agree.forward(h, q), agree.backward(h - 1, q - 1)
        s = np.maximum(h - back, h - k + 1)
        ok = (ahead > 0) & (back > 0) & (ahead + back >= k) & (s < h) & (s + k <= cuts[b + 1])
        starts.append(s[ok])
        halves.append(k[ok])
    return np.concatenate(starts), np.concatenate(halves)


class SuffixTree:
    """Nodes 0 to n - 1 are the leaves in suffix order, node n is the root; a node has the leaves ``left`` to ``right`` below it."""

    def __init__(self, agree: Agreement) -> None:
        n, order = agree.n, agree.order
        common = agree.forward(order[:-1], order[1:]).tolist()
        depth, lo, hi, parent = (n - order).tolist(), list(range(n)), list(range(n)), [n] * n
        depth.append(0)
        lo.append(0)
        hi.append(n - 1)
        parent.append(n)
        stack = [n]
        for r, d in enumerate([*common, 0]):
            last = r
            while depth[stack[-1]] > d:
                top = stack.pop()
                parent[last] = top
                hi[top] = r
                last = top
            if depth[stack[-1]] < d:
                stack.append(len(depth))
                depth.append(d)
                lo.append(lo[last])
                hi.append(r)
                parent.append(n)
            parent[last] = stack[-1]
        self.depth, self.left, self.right, self.parent = (np.array(x, dtype=np.int64) for x in (depth, lo, hi, parent))
        self.agree, self.root = agree, n
        self.up = [self.parent]
        while (self.up[-1] != n).any():
            self.up.append(self.up[-1][self.up[-1]])
        # children in order of their first word
        nodes = np.flatnonzero(np.arange(len(depth)) != n)
        nodes = nodes[np.lexsort((self.left[nodes], self.parent[nodes]))]
        self.kids, above = nodes, self.parent[nodes]
        self.words = agree.names[0][order[self.left[nodes]] + self.depth[above]]
        self.begin = np.searchsorted(above, np.arange(len(depth) + 1))
        inner = np.arange(n + 1, len(depth))
        self.link = np.full(len(depth), n, dtype=np.int64)
        self.link[inner] = self.place(order[self.left[inner]] + 1, self.depth[inner] - 1)

    def place(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The highest nodes at or below the ends of words ``start`` to ``start + length``."""
        v = self.agree.rank[start].astype(np.int64)
        for up in reversed(self.up):
            above = up[v]
            v = np.where(self.depth[above] >= length, above, v)
        return v


def vocabulary(tree: SuffixTree, starts: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, half-length) of every different tandem repeat, from those of the covering set by suffix links."""
    n = tree.agree.n
    place = tree.place(starts, 2 * halves)
    first = np.unique(place * n + halves).tolist()
    known = set(first)
    text, order = tree.agree.names[0].tolist(), tree.agree.order.tolist()
    depth, low, parent, link = tree.depth.tolist(), tree.left.tolist(), tree.parent.tolist(), tree.link.tolist()
    kids, words, begin = tree.kids.tolist(), tree.words.tolist(), tree.begin.tolist()

    def child(v: int, word: int) -> int:
        k = bisect_left(words, word, begin[v], begin[v + 1])
        return kids[k] if k < begin[v + 1] and words[k] == word else -1

    for mark in first:
        v, half = divmod(mark, n)
        while True:
            at = order[low[v]]
            node = link[parent[v]]
            length = 2 * half - 1
            while depth[node] < length:  # without its first word the repeat is in the tree for certain
                node = child(node, text[at + 1 + depth[node]])
            if depth[node] == length:
                node = child(node, text[at])
            elif text[order[low[node]] + length] != text[at]:
                node = -1
            if node < 0 or node * n + half in known:
                break
            known.add(node * n + half)
            v = node
    marks = np.fromiter(known, np.int64, len(known))
    return marks // n, marks % n


def primitive(agree: Agreement, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether words ``start`` to ``start + half`` are no repetition themselves."""
    top = int(half.max(initial=1))
    least = np.arange(top + 1)  # smallest prime factor
    for p in range(2, int(top**0.5) + 1):
        if least[p] == p:
            own = least[p * p :: p]
            own[own == np.arange(p * p, top + 1, p)] = p
    out, rest = np.ones(len(half), dtype=bool), half.copy()
    while (todo := np.flatnonzero(rest > 1)).size:
        p = least[rest[todo]]
        period = half[todo] // p
        out[todo] &= agree.forward(start[todo], start[todo] + period) < half[todo] - period
        rest[todo] //= p
        while (again := todo[(rest[todo] > 1) & (rest[todo] % p == 0)]).size:
            q = p[np.searchsorted(todo, again)]
            rest[again] //= q
    return out


def all_runs(codes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of two periods or more in a string whose stretches each end with a word of its own."""
    none = np.zeros(0, dtype=np.int64)
    if len(codes) < 3:
        return none, none, none
    agree = Agreement(codes, longest)
    starts, halves = covering(agree, blocks(agree), longest)
    if not len(starts):
        return none, none, none
    tree = SuffixTree(agree)
    node, half = vocabulary(tree, starts, halves)
    ok = primitive(agree, agree.order[tree.left[node]], half)
    node, half = node[ok], half[ok]
    count = tree.right[node] - tree.left[node] + 1
    leaf = np.repeat(tree.left[node] - np.cumsum(count) + count, count) + np.arange(count.sum())
    key = np.sort(np.repeat(half, count) * agree.n + agree.order[leaf])
    first = np.flatnonzero(np.concatenate([[True], np.diff(key) != 1]))
    size = np.diff(np.append(first, len(key)))
    period, start = key[first] // agree.n, key[first] % agree.n
    return start, size - 1 + 2 * period, period


def stretches(h: np.ndarray, text: np.ndarray, least: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, stretch) of the stretches that may hold a run; some words are in two."""
    at, own = np.arange(len(h)), text
    for _ in range(12):  # fewer words each time; where it ends does not matter
        m = len(at) - 2
        if m < 1:
            return at[:0], own[:0]
        w = h[at]
        g = ta.mix(ta.mix(ta.mix(w[:m]) * U(ta.FACTORS[1]) + w[1 : m + 1]) * U(ta.FACTORS[2]) + w[2:] + ta.mix(own[:m].astype(U)))
        o = np.argsort(g)
        new = np.concatenate([[True], g[o][1:] != g[o][:-1]])
        first = np.flatnonzero(new)
        ok = np.empty(m, dtype=bool)
        ok[o] = np.repeat(np.diff(np.append(first, m)) >= count, np.diff(np.append(first, m)))
        ok &= own[:m] == own[2:]
        edge = np.diff(np.concatenate([[0], ok.view(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = b - a + 2 >= least
        a, n = a[long], (b - a + 2)[long]
        pick = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        if len(pick) == len(at):
            break
        at, own = at[pick], np.repeat(np.arange(len(n)), n)
    return at, own


def runs_of_words(h: np.ndarray, text: np.ndarray, min_length: int = 6, min_periods: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of the runs of texts whose words have hashes ``h`` and lie in text number ``text``; by start, then period."""
    if min_length < 3 or min_periods < 2:
        raise ValueError("a run has two periods and three words at least")
    at, own = stretches(h, text, min_length, min(min_periods - 1, max(min_length, min_periods) - 2))
    if not len(at):
        return at, at, at
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    size = np.diff(np.append(first, len(at)))
    # each stretch is followed by a separator of its own
    words = np.unique(h[at], return_inverse=True)[1]
    to = np.arange(len(at)) + np.repeat(np.arange(len(first)), size)
    codes = np.empty(len(at) + len(first), dtype=np.int64)
    codes[to] = words
    back = np.full(len(codes), -1, dtype=np.int64)
    back[to] = at
    codes[back < 0] = np.arange(len(first)) + len(at)
    start, length, period = all_runs(codes, int(size.max()))
    ok = (length >= min_length) & (length >= min_periods * period)
    start, length, period = back[start[ok]], length[ok], period[ok]
    o = np.lexsort((period, start))
    return start[o], length[o], period[o]


def periodic_runs(df: DataFrame, min_length: int = 6, min_periods: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the id, ``n_words``, its ``runs`` by start, then period (start and length in words, period), and ``collapsed``: the text without the words that repeat the run's first period, by single spaces.

    One Arrow pass; nothing is shuffled.
    """
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = ta.string_parts(b.column("__text"))
            for i, j in ta.chunks(offsets):
                own, off = values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                begin, end, h, text = ta.words(own, off)
                start, length, period = runs_of_words(h, text, min_length, min_periods)
                word = np.searchsorted(text, np.arange(j - i + 1))
                gone = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, start + length, -1)
                rest = left(SimpleNamespace(values=own, off=word, start=begin, end=end), np.cumsum(gone[:-1]) > 0)
                per = np.searchsorted(start, word)
                structs = pa.StructArray.from_arrays([pa.array(start - word[text[start]]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                cols = [b.column("__id").slice(i, j - i), pa.array(np.diff(word)), pa.ListArray.from_arrays(pa.array(per, pa.int32()), structs), pa.array(rest, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "runs", "collapsed"])

    d = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return d.mapInArrow(ta.tidy(run), schema)
