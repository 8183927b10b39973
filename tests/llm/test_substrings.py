"""Repeated windows: both operators against brute force, their indexes on their own."""

import hashlib
import random
import re
from dataclasses import replace

import numpy as np
import pytest

from pagefuse.llm import fm_index, repeats, suffix_array
from pagefuse.llm import textarrays as ta


def brute(docs, units, length, within, join):
    """Plainly: the first place of every window, then what is covered."""
    first = {}
    for d, t in docs:
        u = units(t or "")
        for i in range(len(u) - length + 1):
            k = u[i : i + length] if isinstance(u, bytes) else tuple(u[i : i + length])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = {}
    for d, t in docs:
        u = units(t or "")
        gone = np.zeros(len(u) + 1, int)
        for i in range(len(u) - length + 1):
            f = first[u[i : i + length] if isinstance(u, bytes) else tuple(u[i : i + length])]
            if (f < (d, i)) if within else (f[0] < d):
                gone[i] += 1
                gone[i + length] -= 1
        m = np.cumsum(gone[:-1]) > 0
        spans = int((m & ~np.concatenate([[False], m[:-1]])).sum()) if len(u) else 0
        out[d] = (len(u), int(m.sum()), spans, hashlib.sha256(join(u, m)).hexdigest())
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def left_words(u, m):
    return " ".join(x for x, g in zip(u, m, strict=True) if not g).encode()


def left_bytes(u, m):
    return np.frombuffer(u, np.uint8)[~m].tobytes()


def corpus():
    """Copies, shared passages, periodic texts, a common line in many contexts, edge texts."""
    rng = random.Random(8)
    w = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    passage, line = w(60), "this very line stands in many documents of all kinds today"
    docs = [w(80), passage + " " + w(40), w(30) + "\n" + passage, w(50) + " " + passage + " " + passage]
    docs += [docs[0], docs[0] + " tail", docs[1].replace(" ", "  ", 1)]
    docs += [w(15) + "\n" + line + "\n" + w(15) for _ in range(40)]
    docs += ["ab " * 60, "x" * 300, "x" * 120, "", " ", "é" * 90, None, "short", w(400)]
    rng.shuffle(docs)
    return list(enumerate(docs))


CASES = [("byte", 50, False, suffix_array, str.encode, left_bytes), ("word", 20, True, fm_index, words, left_words), ("byte", 17, False, suffix_array, str.encode, left_bytes), ("word", 7, True, fm_index, words, left_words)]


@pytest.mark.parametrize("unit, length, within, op, units, join", CASES)
@pytest.mark.parametrize("hot", [4096, 3])
def test_against_brute_force(spark, monkeypatch, unit, length, within, op, units, join, hot):
    docs = corpus()
    plan = repeats.plan_for
    monkeypatch.setattr(repeats, "plan_for", lambda *a, **k: replace(plan(*a, **k), least_hot=hot))
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, part int, kind string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in op.digests(d, length=length).collect()}
    assert got == brute(docs, units, length, within, join)


@pytest.mark.parametrize("op", [suffix_array, fm_index])
def test_edges(spark, op):
    d = spark.createDataFrame([(None, "word " * 60), (1, "word " * 60 + "a"), (1, "word " * 60 + "a"), (2, "word " * 60 + "a"), (None, None)], "doc_id long, text string")
    got = op.digests(d).collect()
    assert len(got) == 5
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert len({tuple(r) for r in got if r.doc_id == 1}) == 1
    assert next(r for r in got if r.doc_id == 2).n_removed > 50
    assert op.digests(d.limit(0)).count() == 0


@pytest.mark.parametrize("unit, length, within, op, units, join", CASES[:2])
def test_texts_longer_than_a_chunk(spark, unit, length, within, op, units, join):
    """Texts of several chunks, one without any space, and what they share."""
    rng = random.Random(2)
    part = " ".join(str(rng.randint(0, 10**9)) for _ in range(60_000))
    block = "".join(rng.choice("abcdefgh") for _ in range(1_200_000))
    docs = [(1, part + " " + part[:50_000]), (2, "start " + part[100:400_000]), (3, block), (4, block[5000:905_000] + "end")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, blob string, part int")
    got = {r[0]: tuple(r)[1:] for r in op.digests(d, length=length).collect()}
    assert got == brute(docs, units, length, within, join)


def test_removed_keeps_characters_and_columns(spark):
    t = "naïve café " * 40
    d = spark.createDataFrame([(1, t + "one", "en", "s", 9), (2, "zwei " + t, "de", "s", 9), (3, None, None, None, None), (4, "other", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in suffix_array.removed(d, length=100).collect()}
    assert got[1].text == t + "one" and got[4].text == "other" and got[3].text == ""
    assert got[2].text.startswith("zwei") and len(got[2].text) < 20 and "�" not in got[2].text and got[2].n_chars == len(got[2].text) and got[2].lang == "de"


def test_sorting_by_shallow_and_deep():
    rng = np.random.default_rng(4)
    for length in (5, 16, 20, 50):
        data = rng.integers(97, 99, 400).astype(np.uint8)
        data[100:200] = data[:100]
        starts = np.arange(len(data) - length + 1)
        order, group = suffix_array.sort_windows(data, starts, length)
        keys = [data[s : s + length].tobytes() for s in starts[order]]
        assert keys == sorted(keys)
        assert all((a == b) == (p == q) for a, b, p, q in zip(keys, keys[1:], group, group[1:], strict=False))


def test_sorting_long_common_prefixes():
    """Groups that stay tied far below the shallow depth, windows in any order, and none at all."""
    rng = np.random.default_rng(1)
    for length in (1, 9, 17, 33, 90, 200):
        part = rng.integers(97, 100, 150).astype(np.uint8)
        other = part.copy()
        other[[60, 140]] ^= 1
        data = np.concatenate([part, part, other, np.full(260, 97, np.uint8)])
        starts = rng.permutation(len(data) - length + 1)
        order, group = suffix_array.sort_windows(data, starts, length)
        keys = [data[starts[i] : starts[i] + length].tobytes() for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(starts)))
        assert all((a == b) == (p == q) for a, b, p, q in zip(keys, keys[1:], group, group[1:], strict=False))
    order, group = suffix_array.sort_windows(data, np.zeros(0, np.int64), 50)
    assert not len(order) and not len(group)


def test_wavelet_rank():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 13, 500)
    w = fm_index.WaveletMatrix(x, 4)
    base = w.rank(np.arange(13), np.zeros(13, dtype=np.int64))
    for c in range(13):
        got = w.rank(np.full(501, c), np.arange(501)) - base[c]
        assert (got == np.concatenate([[0], np.cumsum(x == c)])).all()


def test_backward_search_counts_matches():
    rng = np.random.default_rng(6)
    seqs = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(40)]
    text = np.concatenate([np.append(s, 0) for s in seqs])
    first = np.cumsum([0] + [len(s) + 1 for s in seqs[:-1]])
    index = fm_index.FMIndex(text, 4)
    length, low, high = index.matching(text, first, first + [len(s) for s in seqs])
    for f, s in zip(first, seqs, strict=True):
        for i in range(len(s)):
            k = min(4, len(s) - i)
            assert length[f + i] == k
            want = sum(t[j : j + k].tolist() == s[i : i + k].tolist() for t in seqs for j in range(len(t) - k + 1))
            assert high[f + i] - low[f + i] == want


def test_matching_statistics_of_foreign_texts():
    """Texts that the index does not hold, with words it does not know: lengths, counts and one interval for equal words."""
    rng = np.random.default_rng(2)
    for length, v in ((1, 2), (3, 2), (5, 4)):
        seqs = [rng.integers(1, v + 1, rng.integers(1, 50)) for _ in range(6)]
        index = fm_index.FMIndex(np.concatenate([np.append(s, 0) for s in seqs]), length)
        docs = [rng.integers(1, v + 2, rng.integers(1, 40)) for _ in range(5)] + seqs[:1]
        off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        n, low, high = index.matching(np.concatenate(docs), off[:-1], off[1:])
        count, names = {}, {}
        for s in seqs:
            for m in range(1, length + 1):
                for i in range(len(s) - m + 1):
                    count[tuple(s[i : i + m])] = count.get(tuple(s[i : i + m]), 0) + 1
        for d, o in zip(docs, off, strict=False):
            for i in range(len(d)):
                m = max((k for k in range(min(length, len(d) - i) + 1) if not k or tuple(d[i : i + k]) in count))
                assert n[o + i] == m
                if m:
                    assert high[o + i] - low[o + i] == count[tuple(d[i : i + m])]
                    assert names.setdefault(tuple(d[i : i + m]), low[o + i]) == low[o + i]


def test_firsts_come_from_the_search(monkeypatch):
    """The index keeps no suffix array: what the search reports decides, and a search that reports nothing is an error."""
    data = np.frombuffer(b"a b c d e a b c d", np.uint8)
    plan = repeats.Plan("word", 3, 2, 2, 3, 4, True)
    args = (data, np.array([0, len(data)]), np.array([7]), np.array([5]), np.array([0]), plan)
    doc, pos = fm_index.window_firsts(*args)
    assert doc.tolist() == [5] * 7 and pos.tolist() == [0, 1, 2, 3, 4, 0, 1]
    monkeypatch.setattr(fm_index.WaveletMatrix, "rank", lambda self, symbol, place: place * 0)
    with pytest.raises(RuntimeError):
        fm_index.window_firsts(*args)


def test_buckets_agree():
    ids = np.array([0, 1, 7, -3, 2**62, -(2**62), 4096, 8192, 12288])
    strided = repeats.bucket_of(np.arange(0, 65 * 5000, 65), 65)
    assert np.bincount(strided, minlength=65).max() < 200
    assert repeats.bucket_of(ids, 9).tolist() == [python_bucket(int(x), 9) for x in ids]


def python_bucket(x, parts):
    x = x % repeats.PRIMES[0] * repeats.FACTORS[0] % repeats.PRIMES[1]
    return (x ^ (x >> 13)) * repeats.FACTORS[1] % repeats.PRIMES[1] % parts


def test_pack_round_trip():
    a = [np.arange(5), np.zeros(0, np.uint32), np.arange(2000)[::-1] ** 3, np.array([2**63, 1], dtype=np.uint64), np.arange(9, dtype=np.uint8)]
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(a, repeats.unpack(repeats.pack(*a)), strict=True))


def test_segments_cover_every_window():
    values = np.frombuffer(b"the cat sat on the mat and the cat sat again", np.uint8)
    u = repeats.Units(values, np.array([0, 20, len(values)]), "byte")
    s = repeats.segments(u, repeats.Plan("byte", 8, 3, 2, 3, 4, False))
    got = sorted(x for a, b in zip(s.first, s.last, strict=True) for x in range(a, b + 1))
    assert got == [*range(13), *range(20, len(values) - 7)]


def test_words_match_the_rule():
    texts = ["a  bb\tccc\n\x0bé", "", " x", "y "]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    start, end, _, text = ta.words(np.frombuffer(b"".join(raw), np.uint8), off)
    whole = b"".join(raw)
    assert [(int(t), whole[a:b].decode()) for a, b, t in zip(start, end, text, strict=True)] == [(i, w) for i, t in enumerate(texts) for w in words(t)]
