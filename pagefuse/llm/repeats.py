"""Finding repeated windows over a whole corpus: the frame that the substring operators share.

A window is ``length`` consecutive units (bytes or words) of one text.  Which
windows are equal is decided by an index over a shard of the corpus, which the
operators supply (a suffix array, an FM-index).  This frame brings equal windows
into the same shard and carries the answers back:

1. Each window names an anchor, its smallest run of ``anchor`` units by a hash
   (leftmost of equals).  Equal windows name equal anchors at the same place in
   them.  Consecutive windows with one anchor are a segment.  Map tasks send
   the anchors' keys to key buckets; keys that a batch holds twice go there once.
2. Key buckets tell the documents which of their anchors occur again anywhere.
   No window of another anchor can be repeated, so the rest is done with.
3. The documents, dealt to buckets of bounded size, send the segments of
   those anchors to the shard of the key: each different segment once from
   each bucket, with its first place there.
4. Shards index the different segments and find, for every window, the first
   place of its content in the corpus.
5. The answers go back to the buckets that asked, which mark the units.

A key that occurs 4,096 times or more, and once or more in 512 KiB of the whole
corpus, is hot: that bounds their number, and their table is a few MB at most.
The windows of hot anchors are segments of their own
and go to the shard of their own content, so a passage in a third of all
documents, whatever stands around it, spreads over all shards, and copies
meet as one entry for each bucket.  Nothing is dropped, capped or sampled.

Documents are identified by their 64-bit id; segments by a 64-bit hash of
their content within their shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import written

U = np.uint64
POS = U((1 << 31) - 1)
#: Bytes of text that are worked on at once, save for a longer single text; each takes about a hundred of memory.
CHUNK = 1 << 20
#: Anchors that a task gathers before it sends them.
GATHERED = 4 << 20


@dataclass(frozen=True)
class Plan:
    """Sizes of the parts; all grow with the corpus but ``length`` and ``anchor``."""

    unit: str
    length: int
    anchor: int
    key_buckets: int
    doc_buckets: int
    shards: int
    within: bool  # an earlier start in the same document counts as well
    least_hot: int = 4096


def plan_for(df: DataFrame, unit: str, length: int, anchor: int, within: bool, text_col: str, bucket_bytes: int = 8 << 20) -> Plan:
    """A plan with buckets of about ``bucket_bytes`` of text, from one sum over the table."""
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(8, -(-int(total) // bucket_bytes))
    return Plan(unit, length, anchor, parts, parts | 1, 4 * parts, within, max(4096, int(total) >> 19))


#: Two primes and two factors below 2 ** 31, so that products stay within 63 bits.
PRIMES, FACTORS = (2147483647, 2147483629), (1103515245, 1664525)


def bucket_column(key: Column, parts: int) -> Column:
    """The document bucket of an id, for ids of any stride; ``bucket_of`` is the same in numpy."""
    x = F.pmod(key.cast("long"), F.lit(PRIMES[0]))
    x = F.pmod(x * F.lit(FACTORS[0]).cast("long"), F.lit(PRIMES[1]))
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 13)) * F.lit(FACTORS[1]).cast("long"), F.lit(PRIMES[1]))
    return F.pmod(x, F.lit(parts)).cast("int")


def bucket_of(key: np.ndarray, parts: int) -> np.ndarray:
    """See ``bucket_column``."""
    x = key.astype(np.int64) % PRIMES[0] * FACTORS[0] % PRIMES[1]
    return (x ^ (x >> 13)) * FACTORS[1] % PRIMES[1] % parts


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value: numbers as differences, byte by byte of their width, compressed where it pays."""
    head, body = [bytes([len(arrays)])], []
    for a in arrays:
        head.append(a.dtype.char.encode() + len(a).to_bytes(4, "little"))
        if a.dtype.itemsize == 1:
            body.append(np.ascontiguousarray(a).tobytes())
        elif len(a):
            d = np.concatenate([a[:1], a[1:] - a[:-1]])
            body.append(d.view(np.uint8).reshape(len(d), -1).T.tobytes())
    raw = b"".join(head + body)
    return b"z" + zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) > 256 else b"r" + raw


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    raw = zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[:1] == b"z" else blob[1:]
    n, out = raw[0], []
    at = 1 + 5 * n
    for k in range(n):
        kind, size = np.dtype(chr(raw[1 + 5 * k])), int.from_bytes(raw[2 + 5 * k : 6 + 5 * k], "little")
        x = np.frombuffer(raw, np.uint8, size * kind.itemsize, at)
        at += len(x)
        if kind.itemsize > 1:
            x = np.cumsum(np.ascontiguousarray(x.reshape(kind.itemsize, size).T).view(kind).ravel(), dtype=kind)
        out.append(x)
    return out


class Units:
    """The units of several texts laid end to end."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, unit: str) -> None:
        self.values, self.offsets = values, offsets
        if unit == "byte":
            self.codes = values.astype(U) + U(1)
            self.off, self.start, self.end = offsets, None, None
        else:
            self.start, self.end, self.codes, text = ta.words(values, offsets)
            self.off = np.searchsorted(text, np.arange(len(offsets)))
        c = self.codes * ta.powers(ta.BASE, len(self.codes))
        self.sums = np.empty(len(c) + 1, dtype=U)
        self.sums[0] = 0
        np.cumsum(c, out=self.sums[1:])

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of units a to b, for many ranges."""
        h = (self.sums[b] - self.sums[a]) * ta.powers(ta.BASE_INV, len(self.codes) + 1)[a]
        return ta.mix(h ^ ((b - a).astype(U) * U(ta.FACTORS[0])))

    def rolling(self, k: int) -> np.ndarray:
        """Hash of every run of k units, wherever texts end."""
        return ta.mix((self.sums[k:] - self.sums[:-k]) * ta.powers(ta.BASE_INV, len(self.codes) + 1)[: len(self.sums) - k])

    def raw(self, a: int, b: int) -> bytes:
        """The bytes of units a to b."""
        if self.start is None:
            return self.values[a:b].tobytes()
        return self.values[self.start[a] : self.end[b - 1]].tobytes()


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


@dataclass
class Segments:
    """Runs of windows that name one anchor: first and last window start, key, text, number within the text."""

    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    text: np.ndarray
    ordinal: np.ndarray


def segments(u: Units, plan: Plan) -> Segments:
    """All segments of the texts, in order."""
    n, m = len(u.codes), len(u.codes) - plan.length + 1
    none = np.zeros(0, dtype=np.int64)
    if m < 1:
        return Segments(none, none, none.astype(U), none, none)
    g = u.rolling(plan.anchor)
    rank = (g & ~POS) | np.arange(len(g), dtype=U)
    p = (sliding_min(rank, plan.length - plan.anchor + 1) & POS).astype(np.int64)
    text = np.repeat(np.arange(len(u.off) - 1), np.diff(u.off))
    ok = text[:m] == text[n - m :]
    new = np.ones(m + 1, dtype=bool)
    new[1:m] = (p[1:] != p[:-1]) | (ok[1:] != ok[:-1])
    first, last = np.flatnonzero(new[:m] & ok), np.flatnonzero(new[1:] & ok)
    key = ta.mix(g[p[first]] ^ U(ta.FACTORS[6]))
    own = text[first]
    begin = np.searchsorted(own, np.arange(len(u.off) - 1))
    return Segments(first, last, key, own, np.arange(len(own)) - begin[own] if len(own) else none)


def by_part(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of each part that a sorted array holds."""
    k, n = run_lengths(part)
    to = np.cumsum(n)
    return list(zip(k.tolist(), (to - n).tolist(), to.tolist(), strict=True))


def ordinals_rows(docs: np.ndarray, ordinals: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """(1, document bucket, blob) rows that carry anchors of documents."""
    own = bucket_of(docs, parts)
    o = np.argsort(own, kind="stable")
    docs, ordinals, own = docs[o], ordinals[o], own[o]
    return [(1, k, pack(docs[a:b], ordinals[a:b].astype(np.uint32))) for k, a, b in by_part(own)]


def rows_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Rows of (kind, part, blob)."""
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "part", "blob"])


ROWS = "kind int, part int, blob binary"


def anchor_rows(plan: Plan, batches: object) -> object:
    """Step 1, for batches of (id, text); anchors are sent when many have gathered, so blobs have many each."""
    cols: list[list[np.ndarray]] = [[], [], []]
    for b in batches:
        ids = b.column("id")
        known = np.asarray(ids.is_valid())
        ids = ids.fill_null(0).to_numpy()
        values, offsets = ta.string_parts(b.column("text"))
        for i, j in ta.chunks(offsets, CHUNK):
            s = segments(Units(values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], plan.unit), plan)
            ok = known[s.text + i]
            for col, x in zip(cols, (s.key[ok], ids[s.text[ok] + i], s.ordinal[ok].astype(np.uint32)), strict=True):
                col.append(x)
            if sum(map(len, cols[0])) >= GATHERED:
                yield from key_blobs(plan, *(np.concatenate(c) for c in cols))
                cols = [[], [], []]
    if sum(map(len, cols[0])):
        yield from key_blobs(plan, *(np.concatenate(c) for c in cols))


def key_blobs(plan: Plan, key: np.ndarray, doc: np.ndarray, ordinal: np.ndarray) -> object:
    """Rows of anchors: to the bucket of their key, and those whose key is here twice to their documents at once."""
    o = np.argsort(key, kind="stable")
    ks = key[o]
    new = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))
    size = np.diff(np.append(new, len(ks)))
    single = o[new[size == 1]]
    many = o[np.repeat(size > 1, size)]
    rows = ordinals_rows(doc[many], ordinal[many], plan.doc_buckets) if len(many) else []
    own = (key[single] % U(plan.key_buckets)).astype(np.int64)
    q = np.lexsort((single, own))
    single, own = single[q], own[q]
    mk, mn = ks[new[size > 1]], size[size > 1]
    mown = (mk % U(plan.key_buckets)).astype(np.int64)
    q = np.argsort(mown, kind="stable")
    mk, mn, mown = mk[q], mn[q], mown[q]
    both = np.union1d(own, mown)
    for k, a, z, c, e in zip(both.tolist(), *(np.searchsorted(x, both, side=side).tolist() for x in (own, mown) for side in ("left", "right")), strict=True):
        one = single[a:z]
        d, n = run_lengths(doc[one])
        rows.append((0, k, pack((key[one] >> U(32)).astype(np.uint32), d, n.astype(np.uint32), ordinal[one], (mk[c:e] >> U(32)).astype(np.uint32), mn[c:e].astype(np.uint32))))
    yield rows_batch(rows)


def run_lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the runs of an array."""
    new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[new], np.diff(np.append(new, len(x)))


def repeated_anchors(plan: Plan, key: tuple, group: pa.Table) -> pa.Table:
    """Step 2, for the blobs of a key bucket; those of a document bucket pass."""
    kind, part = (int(k.as_py()) for k in key)
    if kind == 1:
        return pa.Table.from_batches([rows_batch([(1, part, b.as_py()) for b in group.column("blob")])])
    cols: list[list[np.ndarray]] = [[] for _ in range(5)]
    for b in group.column("blob"):
        k, d, n, o, mk, mn = unpack(b.as_py())
        for c, x in zip(cols, (k, np.repeat(d, n), o, mk, mn), strict=True):
            c.append(x)
    k, d, o, mk, mn = (np.concatenate(c) for c in cols)
    every = np.concatenate([k, mk])
    weight = np.concatenate([np.ones(len(k), np.int64), mn.astype(np.int64)])
    names, back = np.unique(every, return_inverse=True)
    total = np.bincount(back, weights=weight, minlength=len(names)).astype(np.int64)
    again = total[back[: len(k)]] > 1
    rows = ordinals_rows(d[again], o[again], plan.doc_buckets) if again.any() else []
    hot = names[total >= plan.least_hot]
    if len(hot):
        rows.append((2, part, pack(hot)))
    return pa.Table.from_batches([rows_batch(rows)]) if rows else pa.table({"kind": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})


def is_hot(key: np.ndarray, plan: Plan, hot: np.ndarray) -> np.ndarray:
    """Whether keys are in the sorted table of hot ones, named by bucket and 32 bits."""
    if not len(hot):
        return np.zeros(len(key), dtype=bool)
    name = ((key % U(plan.key_buckets)) << U(32)) | (key >> U(32))
    at = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
    return hot[at] == name


def expand(s: Segments, rows: np.ndarray, plan: Plan, hot: np.ndarray, u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, text, content hash, shard) of segments; those of hot anchors window by window."""
    h = is_hot(s.key[rows], plan, hot)
    cold, warm = rows[~h], rows[h]
    first, n, text = s.first[cold], s.last[cold] - s.first[cold] + 1, s.text[cold]
    shard = (ta.mix(s.key[cold]) % U(plan.shards)).astype(np.int64)
    content = u.hashes(first, first + n + plan.length - 1)
    if len(warm):
        k = s.last[warm] - s.first[warm] + 1
        start = np.repeat(s.first[warm], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        own = u.hashes(start, start + plan.length)
        first, n, text = np.concatenate([first, start]), np.concatenate([n, np.ones(len(start), np.int64)]), np.concatenate([text, np.repeat(s.text[warm], k)])
        content, shard = np.concatenate([content, own]), np.concatenate([shard, (ta.mix(own) % U(plan.shards)).astype(np.int64)])
    return first, n, text, content, shard


def doc_chunks(docs: pa.Table) -> object:
    """(first row, past the last, bytes, offsets, ids, id is known) of a bucket's documents, chunk by chunk."""
    docs = docs.combine_chunks()
    if not docs.num_rows:
        return
    ids = docs.column("id").chunk(0)
    known = np.asarray(ids.is_valid())
    ids = ids.fill_null(0).to_numpy()
    values, offsets = ta.string_parts(docs.column("text").chunk(0))
    for i, j in ta.chunks(offsets, CHUNK):
        yield i, j, values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids[i:j], known[i:j]


def request_rows(plan: Plan, hot: np.ndarray, part: int, docs: pa.Table, blobs: pa.Table) -> list[tuple[int, int, bytes]]:
    """Step 3, for the documents of a bucket and the anchors that are repeated."""
    got = [unpack(b.as_py()) for b in blobs.column("blob")]
    if not got or not docs.num_rows:
        return []
    wd, wo = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64)
    o = np.lexsort((wo, wd))
    wd, wo = wd[o], wo[o]
    new = np.concatenate([[True], (wd[1:] != wd[:-1]) | (wo[1:] != wo[:-1])])
    wd, wo = wd[new], wo[new]
    cols: list[list[np.ndarray]] = [[] for _ in range(7)]
    bodies: list[bytes] = []
    seen: dict[int, int] = {}
    for _, _, values, offsets, ids, known in doc_chunks(docs):
        own = np.isin(ids, wd) & known
        if not own.any():
            continue
        u = Units(values, offsets, plan.unit)
        s = segments(u, plan)
        a, b = np.searchsorted(wd, ids, side="left"), np.searchsorted(wd, ids, side="right")
        pick = [np.zeros(0, np.int64)]
        begin = np.searchsorted(s.text, np.arange(len(ids) + 1))
        for t in np.flatnonzero(own):
            o = wo[a[t] : b[t]]
            pick.append(begin[t] + o[o < begin[t + 1] - begin[t]])
        first, n, text, content, shard = expand(s, np.concatenate(pick), plan, hot, u)
        doc, pos = ids[text], first - u.off[text]
        # one entry for each content: its first and its last place here
        order = np.lexsort((pos, doc, content))
        c = content[order]
        new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        lo, hi = order[new], order[np.append(new[1:], len(c)) - 1] if len(c) else order
        for e, x in zip(lo, c[new].tolist(), strict=True):
            if x not in seen:
                seen[x] = len(seen)
                bodies.append(u.raw(first[e], first[e] + n[e] + plan.length - 1))
        for col, x in zip(cols, (c[new], n[lo], shard[lo], doc[lo], pos[lo], doc[hi], pos[hi]), strict=True):
            col.append(x)
    if not cols[0]:
        return []
    c, n, shard, d0, p0, d1, p1 = (np.concatenate(x) for x in cols)
    body = np.array([seen[x] for x in c.tolist()], dtype=np.int64)
    # merge the chunks' entries of one content
    order = np.lexsort((p0, d0, body))
    _, size = run_lengths(body[order])
    at = np.cumsum(size) - size
    top = np.lexsort((p1, d1, body))[at + size - 1] if len(at) else order
    lo = order[at]
    c, n, shard, d0, p0, d1, p1 = c[lo], n[lo], shard[lo], d0[lo], p0[lo], d1[top], p1[top]
    texts = [bodies[k] for k in body[lo]]
    if not plan.within:  # then places within a document do not count
        p0 = p1 = np.zeros(len(c), np.int64)
    o = np.lexsort((p0, d0, shard))
    out = []
    for k, a, z in by_part(shard[o]):
        r = o[a:z]
        own = [texts[x] for x in r]
        out.append((part, k, pack(c[r], n[r].astype(np.uint32), d0[r], p0[r], d1[r] - d0[r], p1[r], np.array([len(x) for x in own], dtype=np.uint32), np.frombuffer(b"".join(own), dtype=np.uint8))))
    return out


#: Units of segments, laid end to end, and their windows: (data, offsets, windows, document, position) -> (document, position) for each window.
Index = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Plan], tuple[np.ndarray, np.ndarray]]


def answer_rows(plan: Plan, index: Index, group: pa.Table) -> list[tuple[int, int, bytes]]:
    """Step 4, for the requests of a shard: answers to the document buckets."""
    asked, data = [], []
    for part, blob in zip(group.column("kind").to_pylist(), group.column("blob"), strict=True):
        c, n, d0, p0, more, p1, size, body = unpack(blob.as_py())
        asked.append((part, c, n, d0, p0, d0 + more, p1, size))
        data.append(body)
    part = np.repeat([a[0] for a in asked], [len(a[1]) for a in asked])
    c, n, d0, p0, d1, p1, size = (np.concatenate([a[k] for a in asked]) for k in range(1, 8))
    n, size = n.astype(np.int64), size.astype(np.int64)
    whole = np.concatenate(data)
    begin = np.cumsum(size) - size
    # different contents, each with its first place
    order = np.lexsort((p0, d0, c))
    _, copies = run_lengths(c[order])
    at = np.cumsum(copies) - copies
    lead = order[at]
    which = np.empty(len(c), dtype=np.int64)
    which[order] = np.repeat(np.arange(len(lead)), copies)
    sizes = size[lead]
    off = np.concatenate([[0], np.cumsum(sizes)])
    take = np.repeat(begin[lead] - off[:-1], sizes) + np.arange(off[-1])
    doc, pos = index(whole[take], off, n[lead], d0[lead], p0[lead], plan)
    # runs of windows whose first places follow on each other
    wins = n[lead]
    wbeg = np.cumsum(wins) - wins
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1 if plan.within else np.zeros(len(doc) - 1, bool))
    new[wbeg] = True
    start = np.flatnonzero(new)
    run = np.diff(np.append(start, len(doc)))
    rbeg = np.searchsorted(start, wbeg)
    rcount = np.diff(np.append(rbeg, len(start)))
    # a bucket gets an answer only where its last place comes after a first place
    low = np.minimum.reduceat(doc[start], rbeg)[which]
    useful = low < d1
    if plan.within:
        useful |= (low == d1) & (pos[start][np.minimum(rbeg[which], len(start) - 1)] < p1 + n)
    rows = np.flatnonzero(useful)
    rows = rows[np.argsort(part[rows], kind="stable")]
    out = []
    for k, a, z in by_part(part[rows]):
        w = which[rows[a:z]]
        m = rcount[w]
        r = np.repeat(rbeg[w], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        q = pos[start[r]] if plan.within else np.zeros(0, np.int64)
        out.append((0, k, pack(c[rows[a:z]], m.astype(np.uint32), run[r].astype(np.uint32), doc[start[r]], q)))
    return out


def covered(plan: Plan, hot: np.ndarray, docs: pa.Table, blobs: pa.Table) -> object:
    """Step 5, for the documents of a bucket: (first row, units, mask of removed units) chunk by chunk."""
    got = [unpack(b.as_py()) for b in blobs.column("blob")]
    if got:
        c, m, run, doc, pos = (np.concatenate([g[k] for g in got]) for k in range(5))
        m, run = m.astype(np.int64), run.astype(np.int64)
        o = np.argsort(c, kind="stable")
        first_run = np.cumsum(m) - m
    for i, j, values, offsets, ids, known in doc_chunks(docs):
        u = Units(values, offsets, plan.unit)
        gone = np.zeros(len(u.codes) + 1, dtype=np.int32)
        if got:
            s = segments(u, plan)
            first, n, text, content, _ = expand(s, np.flatnonzero(known[s.text]), plan, hot, u)
            at = np.minimum(np.searchsorted(c[o], content), len(c) - 1)
            hit = np.flatnonzero(c[o][at] == content)
            reply = o[at[hit]]
            k = m[reply]
            r = np.repeat(first_run[reply], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            seg = np.repeat(hit, k)
            ahead = np.cumsum(run[r]) - run[r]  # windows before each run within its segment
            ahead -= np.repeat(ahead[np.cumsum(k) - k], k) if len(k) else 0
            me = ids[text[seg]]
            earlier = doc[r] < me
            if plan.within:
                here = first[seg] - u.off[text[seg]] + ahead
                earlier |= (doc[r] == me) & (pos[r] < here)
            a = (first[seg] + ahead)[earlier]
            np.add.at(gone, a, 1)
            np.add.at(gone, a + run[r][earlier] + plan.length - 1, -1)
        yield i, u, np.cumsum(gone[:-1]) > 0


def find(df: DataFrame, plan: Plan, index: Index, finish: Callable, schema: object, id_col: str, text_col: str, keep: list[str] = ()) -> DataFrame:
    """Rows of ``finish(docs, marked chunks)`` for every document; lazy from step 3 on."""
    d = df.select(*[F.col(x).alias(f"__keep_{k}") for k, x in enumerate(keep)], F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # rows without an id neither ask nor answer, so they may go anywhere: to the bucket of their text
    d = d.withColumn("part", bucket_column(F.coalesce("id", F.xxhash64("text")), plan.doc_buckets))
    none = pa.table({"kind": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})

    def tidied(f: Callable, *args: object) -> object:
        return ta.tidy(f)(*args)

    def table_of(rows: list) -> pa.Table:
        return pa.Table.from_batches([rows_batch(rows)]) if rows else none

    sent = d.select("id", "text").mapInArrow(ta.tidy(lambda batches: anchor_rows(plan, batches)), ROWS)
    told = written(sent.groupBy("kind", "part").applyInArrow(lambda key, g: tidied(repeated_anchors, plan, key, g), ROWS))
    hot = hot_keys(told)
    blobs = told.where("kind = 1").select("part", "blob")
    asked = d.groupBy("part").cogroup(blobs.groupBy("part")).applyInArrow(lambda key, a, b: table_of(tidied(request_rows, plan, hot, int(key[0].as_py()), a, b)), ROWS)
    answers = asked.groupBy("part").applyInArrow(lambda key, g: table_of(tidied(answer_rows, plan, index, g)), ROWS).select("part", "blob")
    return d.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda key, a, b: tidied(lambda: finish(a, covered(plan, hot, a, b))), schema)


def hot_keys(told: DataFrame) -> np.ndarray:
    """Names of the hot keys, sorted; ``least_hot`` grows with the corpus and so bounds their number."""
    names = [(np.int64(r[0]).astype(U) << U(32)) | unpack(r[1])[0].astype(U) for r in told.where("kind = 2").select("part", "blob").collect()]
    return np.sort(np.concatenate(names)) if names else np.zeros(0, U)


def digest(plan: Plan, id_name: str, counts: list[str]) -> Callable:
    """A ``finish`` that returns id, units, removed units, removed runs and the SHA-256 of what is left."""

    def finish(docs: pa.Table, marked: object) -> pa.Table:
        n_all, n_gone, n_spans, sha = [], [], [], []
        for _, u, gone in marked:
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            for t, rest in enumerate(left(u, gone)):
                a, b = u.off[t], u.off[t + 1]
                mask = gone[a:b]
                n_all.append(b - a)
                n_gone.append(int(mask.sum()))
                n_spans.append(int(edge[a:b].sum()) + int(a < b and mask[0] and not edge[a]))
                sha.append(hashlib.sha256(rest).hexdigest())
        cols = [docs.column("id"), pa.array(n_all, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
        return pa.table(dict(zip([id_name, *counts, "kept_sha256"], cols, strict=True)))

    return finish


def left(u: Units, gone: np.ndarray) -> list[bytes]:
    """What is left of each text: bytes as they are, words joined by one space."""
    keep = np.flatnonzero(~gone)
    ends = np.searchsorted(keep, u.off)
    if u.start is None:
        out = u.values[keep].tobytes() if gone.any() else u.values.tobytes()
        return [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    size = u.end[keep] - u.start[keep] + 1  # a word and a space
    stop = np.concatenate([[0], np.cumsum(size)])
    padded = np.append(u.values, np.uint8(32))
    data = padded[np.repeat(u.start[keep] - stop[:-1], size) + np.arange(stop[-1])]
    data[stop[1:] - 1] = 32
    out = data.tobytes()
    return [out[a : max(a, b - 1)] for a, b in zip(stop[ends[:-1]].tolist(), stop[ends[1:]].tolist(), strict=True)]
