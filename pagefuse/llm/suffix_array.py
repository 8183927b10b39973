"""Suffix-array dedup of byte strings, sorted deep and shallow.

``repeats`` brings the segments that may repeat into shards.  A shard sorts the
starts of all windows of its different segments by the window's bytes, which
makes the suffix array of the shard as deep as a window:

* shallow: buckets of the first two bytes, then multikey quicksort.  A group of
  starts that agree so far is parted in three by its pivot's next eight bytes,
  taken as one character; the middle part goes on with the eight bytes after,
  down to ``SHALLOW`` bytes or a few more;
* deep: each group that is still tied grows a blind trie.  A node holds only the
  first bit in which its strings differ, found over the group at once; the bits
  it skips are never compared again, and the leaves from left to right are the
  order.

All groups of a shard take each step together, so a step is a handful of array
operations whatever the number of groups.  Starts whose windows agree in full
are neighbours then, and the smallest document among them is where the string
starts first.

Edge cases: a null text counts as empty; texts shorter than the string length
have no string; rows with a null id lose nothing and take nothing from others;
rows that share an id take nothing from each other; an empty table gives no
rows; extra columns are kept by ``removed`` and not read by the digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from . import repeats

#: Depth in bytes at which tied groups go to blind tries.
SHALLOW = 16


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number in their order."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(n + 1, dtype=np.uint64)
    for k in range(8):
        out[:n] = (out[:n] << np.uint64(8)) | padded[k : k + n]
    return out


def spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of the ranges, range by range, and where each range starts among them."""
    at = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(begin - at, size), at


class Sorter:
    """Windows of ``length`` bytes at ``starts``: their order, and which places of it begin a group of equal windows."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int) -> None:
        self.words, self.starts, self.length = eight_bytes(data), starts, length
        self.order, self.new = np.arange(len(starts), dtype=np.int32), np.zeros(len(starts), dtype=bool)
        if len(starts):
            self.blind_tries(*self.multikey_quicksort(*self.buckets(), min(SHALLOW, length)))

    def key(self, item: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """The next eight bytes of windows at their depth; bytes past the window do not count."""
        at = np.minimum(self.starts[item] + depth, len(self.words) - 1)
        past = np.clip(depth + 8 - np.int64(self.length), 0, 7).astype(np.uint64)
        return self.words[at] >> (past * np.uint64(8))

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Deals all starts to buckets of their first two bytes: (begin, size) of those with several."""
        two = np.minimum(self.length, 2)
        key = (self.words[self.starts] >> np.uint64(8 * (8 - two))).astype(np.uint16)
        self.order = np.argsort(key, kind="stable").astype(np.int32)  # a counting sort for numbers of 16 bits
        begin = np.flatnonzero(np.diff(key[self.order].astype(np.int32), prepend=-1))
        self.new[begin] = True
        size = np.diff(np.append(begin, len(key)))
        return begin[size > 1], size[size > 1]

    def multikey_quicksort(self, begin: np.ndarray, size: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorts to a depth of ``limit`` bytes or more; (begin, size, depth) of the groups that are tied then."""
        depth = np.full(len(begin), min(2, limit))
        if limit <= 2:
            return begin, size, depth
        place, _ = spread(begin, size)
        place = place.astype(np.int32)
        item = self.order[place]
        key, tied = self.key(item, 2), []
        begin, size = begin.astype(np.int32), size.astype(np.int32)
        while len(begin):
            at = np.cumsum(size, dtype=np.int32) - size
            p = np.repeat(self.median(key, at, size), size)
            less, more = key < p, key > p
            # three-way partition: an entry's turn among the less, the equal and the more of its group
            nth_less, nth_more = np.cumsum(less, dtype=np.int32), np.cumsum(more, dtype=np.int32)
            before_less, before_more = nth_less[at] - less[at], nth_more[at] - more[at]
            last = at + size - 1
            below, above = nth_less[last] - before_less, nth_more[last] - before_more
            nth_less -= np.repeat(before_less, size)
            nth_more -= np.repeat(before_more, size)
            to = np.arange(len(key), dtype=np.int32)
            base = np.repeat(at, size)
            to += np.repeat(below, size)
            to -= nth_less
            to -= nth_more
            np.copyto(to, base + nth_less - 1, where=less)
            np.copyto(to, base + np.repeat(size - above, size) + nth_more - 1, where=more)
            moved, moved_key = np.empty_like(item), np.empty_like(key)
            moved[to], moved_key[to] = item, key
            parts = np.stack([below, size - below - above, above], axis=1)
            starts = begin[:, None] + np.stack([np.zeros_like(below), below, size - above], axis=1)
            self.new[starts[parts > 0]] = True
            middle = np.zeros(parts.shape, dtype=bool)
            middle[:, 1] = True
            depths = depth[:, None] + 8 * middle
            on = (parts > 1) & (depths < limit)
            done = (parts > 1) & ~on
            tied.append((starts[done], parts[done], depths[done]))
            stay = np.repeat(on.ravel(), parts.ravel())
            self.order[place[~stay]] = moved[~stay]
            item, key, place = moved[stay], moved_key[stay], place[stay]
            begin, size, depth, fresh = starts[on], parts[on], depths[on], middle[on]
            if fresh.any():
                own = np.flatnonzero(np.repeat(fresh, size))
                key[own] = self.key(item[own], np.repeat(depth[fresh], size[fresh]))
        if not tied:
            return begin, size, depth
        return tuple(np.concatenate([t[k] for t in tied]).astype(np.int64) for k in range(3))

    @staticmethod
    def median(key: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The middle one of three keys of each group."""
        a, b, c = key[at], key[at + size // 2], key[at + size - 1]
        return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))

    def blind_tries(self, begin: np.ndarray, size: np.ndarray, depth: np.ndarray) -> None:
        """Orders each group by the leaves of its blind trie; only groups of equal windows stay tied."""
        open_ = depth < self.length
        begin, size, depth = begin[open_], size[open_], depth[open_]
        while len(begin):
            place, at = spread(begin, size)
            item = self.order[place]
            key = self.key(item, np.repeat(depth, size))
            differ = np.bitwise_or.reduceat(key ^ np.repeat(key[at], size), at)
            same = differ == 0
            # a node: its bit is the highest one in which a string of the group differs from the first
            bit = differ.copy()
            for k in (1, 2, 4, 8, 16, 32):
                bit |= bit >> np.uint64(k)
            bit ^= bit >> np.uint64(1)
            right = (key & np.repeat(bit, size)) != 0
            turn = np.cumsum(right) - right
            inside = turn - np.repeat(turn[at], size)  # ones before, within the group
            ones = np.add.reduceat(right.astype(np.int64), at)
            zeros = size - ones
            base = np.repeat(begin, size)
            to = np.where(right, base + np.repeat(zeros, size) + inside, place - inside)
            self.order[to] = item
            branch = ~same
            self.new[(begin + zeros)[branch]] = True
            # leaves and ended groups are done; equal ones read on, both children of a node go on
            b = np.concatenate([begin[branch], (begin + zeros)[branch], begin[same]])
            n = np.concatenate([zeros[branch], ones[branch], size[same]])
            d = np.concatenate([depth[branch], depth[branch], depth[same] + 8])
            more = (n > 1) & (d < self.length)
            o = np.argsort(b[more], kind="stable")
            begin, size, depth = b[more][o], n[more][o], d[more][o]


def sort_windows(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows at ``starts`` and, for each place in it, the number of its group of equal windows."""
    s = Sorter(data, starts, length)
    return s.order, np.cumsum(s.new) - 1


def window_firsts(data: np.ndarray, off: np.ndarray, wins: np.ndarray, doc: np.ndarray, pos: np.ndarray, plan: repeats.Plan) -> tuple[np.ndarray, np.ndarray]:
    """Smallest document that holds each window's string; positions do not count."""
    inside = np.arange(wins.sum()) - np.repeat(np.cumsum(wins) - wins, wins)
    starts, owner = np.repeat(off[:-1], wins) + inside, np.repeat(doc, wins)
    order, group = sort_windows(data, starts, plan.length)
    low = np.minimum.reduceat(owner[order], np.flatnonzero(np.diff(group, prepend=-1)))
    out = np.empty(len(starts), dtype=np.int64)
    out[order] = low[group]
    return out, np.zeros(len(starts), dtype=np.int64)


def anchor_bytes(length: int) -> int:
    """Bytes of an anchor: long enough to recur rarely by chance, however large the corpus, and short enough for few anchors."""
    return min(length, max(20, length // 6))


def digests(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """One row for each document: bytes, removed bytes, removed runs, SHA-256 of the rest.

    ``bucket_bytes`` is the text that one task holds.
    """
    plan = repeats.plan_for(df, "byte", length, anchor_bytes(length), False, text_col, bucket_bytes)
    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeats.find(df, plan, window_firsts, repeats.digest(plan, id_col, ["n_bytes", "n_removed", "n_spans"]), schema, id_col, text_col)


def removed(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", bucket_bytes: int = 8 << 20) -> DataFrame:
    """``df`` with repeated strings of ``length`` bytes or more cut from the text, but where they start first.

    A cut is drawn in to whole characters.  ``chars_col``, if there, is counted anew.
    """
    plan = repeats.plan_for(df, "byte", length, anchor_bytes(length), False, text_col, bucket_bytes)
    names = df.columns

    def finish(docs: pa.Table, marked: object) -> pa.Table:
        texts = []
        for _, u, gone in marked:
            if gone.any():
                # a character stays unless all its bytes go: the first byte of a character decides for it
                lead = (u.values & 0xC0) != 0x80
                char = np.cumsum(lead) - 1
                char = np.maximum(char, 0)
                whole = np.ones(int(char[-1]) + 1, dtype=bool)
                np.logical_and.at(whole, char, gone)
                gone = whole[char]
            texts += [x.decode("utf-8", "replace") for x in repeats.left(u, gone)]
        out = {}
        for k, name in enumerate(names):
            if name == text_col:
                out[name] = pa.array(texts, pa.string())
            elif name == chars_col:
                out[name] = pa.array([len(t) for t in texts], pa.int64())
            else:
                out[name] = docs.column(f"__keep_{k}")
        return pa.table(out)

    kept = [c if c not in (text_col, chars_col) else id_col for c in names]
    schema = StructType([f for f in df.schema.fields])
    return repeats.find(df, plan, window_firsts, finish, schema, id_col, text_col, kept)
