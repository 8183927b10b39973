"""Runs against a plain search, kernels one by one and the whole query."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from pagefuse.llm import runs
from pagefuse.llm import textarrays as ta
from pagefuse.llm.queries import op12_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(w, least, periods):
    """All runs, period by period."""
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, periods * q) and not any(w[i : i + size - p] == w[i + p : i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def strings(rng, most):
    """Texts of small alphabets, many with a periodic tail."""
    out = []
    for _ in range(rng.integers(1, 5)):
        n = int(rng.integers(0, most))
        w = rng.integers(0, rng.integers(1, 5), n)
        if n > 6 and rng.random() < 0.6:
            a = int(rng.integers(0, n))
            w[a:] = w[a + np.arange(n - a) % int(rng.integers(1, max(2, n - a)))]
        out.append(w.tolist())
    return out


@pytest.mark.parametrize(("least", "periods"), [(6, 4), (3, 2), (4, 3), (9, 2)])
def test_runs_against_plain_search(least, periods):
    rng = np.random.default_rng(least)
    for k in range(400):
        texts = strings(rng, 150 if k % 20 == 0 else 40)
        h = ta.mix(np.array([x + 1 for t in texts for x in t], dtype=np.uint64))
        off = np.cumsum([0, *map(len, texts)])
        got = runs.runs_of_words(h, np.repeat(np.arange(len(texts)), [len(t) for t in texts]), least, periods)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == [(s + o, n, q) for t, o in zip(texts, off, strict=False) for s, n, q in plain(t, least, periods)]


def test_vocabulary_is_complete():
    """Every different tandem repeat of a string has its place in the tree, and no place is anything else."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        w = rng.integers(0, rng.integers(1, 4), int(rng.integers(3, 60))).tolist()
        codes = np.array([*w, 99])
        agree = runs.Agreement(codes, len(w))
        assert [codes[i:].tolist() for i in agree.order] == sorted(codes[i:].tolist() for i in range(len(codes)))
        starts, halves = runs.covering(agree, runs.blocks(agree), len(w))
        want = {tuple(w[i : i + 2 * k]) for k in range(1, len(w) // 2 + 1) for i in range(len(w) - 2 * k + 1) if w[i : i + k] == w[i + k : i + 2 * k]}
        assert {tuple(w[s : s + 2 * k]) for s, k in zip(starts, halves, strict=True)} <= want
        if want:
            tree = runs.SuffixTree(agree)
            node, half = runs.vocabulary(tree, starts, halves)
            at = agree.order[tree.left[node]]
            got = [tuple(codes[a : a + 2 * k].tolist()) for a, k in zip(at, half, strict=True)]
            assert len(got) == len(set(got)) and set(got) == want
            assert ((tree.depth[tree.parent[node]] < 2 * half) & (tree.depth[node] >= 2 * half)).all()


def test_blocks():
    w = [0, 1, 0, 1, 0, 1, 2, 0, 1, 2, 3]
    assert runs.blocks(runs.Agreement(np.array(w), len(w))).tolist() == [0, 1, 2, 6, 7, 10, 11]


def test_a_long_text_of_one_word_and_of_one_period():
    for w in ([7] * 30_000, [*range(5_000)] * 7, [*range(3_000), *([1, 2, 3, 1, 2] * 4_000)]):
        h = ta.mix(np.array(w, dtype=np.uint64) + np.uint64(1))
        got = [x.tolist() for x in runs.runs_of_words(h, np.zeros(len(w), dtype=np.int64))]
        q = {30_000: 1, 35_000: 5_000, 23_000: 5}[len(w)]
        start = 3_000 if q == 5 else 0
        assert got == [[start], [len(w) - start], [q]]


def expected(doc_id, text, changed=False):
    """The query's row, plainly."""
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if changed and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain(w, 6, 4)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{size},{q}\n" for s, size, q in found), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(found), *top, top[1] and 1000 * top[1] // top[2], *sha)


def test_small_tables(spark):
    texts = [None, "", " \n\t", "a", "a a a a a a", "a a a a a", "x y x y x y x y", "x y\nx y  x y\tx", "é ß é ß é ß é ß é", "a b c " * 4 + "z " + "b c a " * 5, "no run here at all", "w " * 4000, "a b a b " * 5]
    d = spark.createDataFrame([*enumerate(texts), (None, "r r r r r r r"), (3, "a"), (3, "a")], "doc_id long, text string").selectExpr("*", "'x' AS runs", "0 AS n_words", "1 AS collapsed")
    got = runs.periodic_runs(d).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        if r.doc_id is not None:
            w = WORD.findall(texts[r.doc_id] or "")
            own = plain(w, 6, 4)
            assert r.n_words == len(w) and [tuple(x) for x in r.runs] == own
            gone = {i for s, size, q in own for i in range(s + q, s + size)}
            assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert [tuple(x) for r in got if r.doc_id is None for x in r.runs] == [(0, 7, 1)]
    assert runs.periodic_runs(d.limit(0)).count() == 0


def test_the_whole_query(spark, sf):
    got = sorted(tuple(r) for r in op12_periodic_runs(spark, sf).collect())
    want = sorted(expected(r.doc_id, r.text, True) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert got == want and sum(r[1] for r in got) > 3
