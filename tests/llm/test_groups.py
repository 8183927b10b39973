"""Near-duplicate operators against brute force."""

import random
import re

import numpy as np
import pytest

from pagefuse.llm import embeddings, minhash
from pagefuse.llm.common import min_label_components


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    return {n: find(n) for n in nodes}


def shingle_set(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def corpus():
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 120))] for _ in range(25)]
    texts = [None, "", "  ", "one", "One", "two words", "TWO words", "É x", "é x"]
    for b in base:
        texts.append(" ".join(b))
        for edits in (0, 1, 2, 4, 7):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = f"e{rng.randint(0, 9999)}"
            texts.append(" ".join(c))
    chain = [f"c{i}" for i in range(60)]  # each is near the next, the ends are not near each other
    for k in range(8):
        texts.append(" ".join(chain[k * 2 : 45 + k * 2]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("shingle, percent, block", [(3, 85, 256), (5, 80, 4)])
def test_minhash(spark, shingle, percent, block):
    texts = corpus()
    ids = [7 * i + 3 for i in range(len(texts))]
    sets = dict(zip(ids, (shingle_set(t, shingle) for t in texts), strict=True))
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = closure(ids, links)
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, band int, comp string")
    got = {r.doc_id: r for r in minhash.near_duplicates(d, shingle, percent, bands=24, rows=4, block=block).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


@pytest.mark.parametrize("blocks", [1, 7])
def test_one_large_open_bucket(spark, blocks, monkeypatch):
    """A bucket of many components, compared in blocks over cells: the links join what brute force joins."""
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 2**40, 30).astype(np.uint64) for _ in range(300)]
    sets = [np.unique(np.concatenate([base[i % 300][: int(rng.integers(26, 31))], rng.integers(0, 2**40, int(rng.integers(0, 4))).astype(np.uint64)])) for i in range(1500)]
    ids = (rng.permutation(1500) + 5).tolist()
    bands = [[7, int(rng.integers(0, 50))] for _ in ids]
    rows = spark.createDataFrame([(b, k, 5, blocks, i, i * 3, i) for i, keys in zip(ids, bands, strict=True) for b, k in enumerate(keys)], "band int, key long, hub long, blocks int, id long, f1 long, comp long")
    items = spark.createDataFrame([(i, i * 3, k, bytearray(s.tobytes())) for i, k, s in zip(ids, bands, sets, strict=True)], "id long, f1 long, bands array<long>, items binary")
    pairs = minhash.block_pairs(rows.select("band", "key", "blocks").distinct())
    assert pairs == 51 * blocks * (blocks + 1) // 2
    monkeypatch.setattr(minhash, "CELL_PAIRS", 2)
    links = minhash.residual_links(rows, items, 80, pairs)
    cells = max(16 * int(spark.conf.get("spark.sql.shuffle.partitions")), pairs // 2)
    assert f", {cells})" in links._jdf.queryExecution().optimizedPlan().toString()  # cells follow the pairs
    got = [(r.a, r.b) for r in links.collect()]
    want = []
    for i in range(1500):
        for j in range(i % 300, i, 300):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want.append((ids[i], ids[j]))
    assert closure(ids, got) == closure(ids, want) and len(got) <= len(want)


def test_minhash_edges(spark):
    t = "a b c d e f g h i j k l m n o p"
    d = spark.createDataFrame([(None, t), (5, t), (5, t), (4, t + " q"), (9, None), (None, None)], "doc_id long, text string")
    got = minhash.near_duplicates(d, 3, 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(4, 4, True), (5, 4, False), (5, 4, False), (9, 9, True)]
    assert all(r.kept for r in got if r.doc_id is None)
    assert minhash.near_duplicates(d.limit(0)).count() == 0
    left = minhash.one_of_each(d, shingle=3, percent=85)
    assert left.columns == ["doc_id", "text"] and sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [4, 9]


def test_one_of_each_keeps_other_texts_of_an_id(spark):
    """Only the row whose text is a copy goes, and copies of the other text are judged on their own."""
    rng = random.Random(4)
    a, b, c = (" ".join(f"{x}{rng.randint(0, 999)}" for _ in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (2, b), (2, b), (3, b + " end"), (4, c), (None, c), (None, a)]
    left = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85)
    assert left.columns == ["doc_id", "text"]
    assert sorted(((r.doc_id or 0), r.text) for r in left.collect()) == sorted([(1, a), (2, b), (4, c), (0, c), (0, a)])


def test_band_keys_are_circulant():
    """Coordinate k is the smallest of one permutation, shifted by k."""
    from pagefuse.llm import textarrays as ta

    x = np.arange(50, dtype=np.uint64) * np.uint64(7919)
    one = minhash.band_keys(x, np.array([0]), 1, 1)
    placed = ta.mix(x ^ minhash.SIGMA)
    key = ta.mix(np.array([0x9E3779B97F4A7C15], np.uint64) * np.uint64(ta.FACTORS[3]) + ta.mix(placed ^ minhash.PI).min())
    assert one[0, 0] == key[0]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(300)] + [(1000 + rng.randint(0, 99), 1000 + rng.randint(0, 99)) for _ in range(60)]
    nodes = {x for e in links if e[0] != e[1] for x in e}
    d = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in min_label_components(d).collect()}
    assert got == closure(nodes, [e for e in links if e[0] != e[1]])
    assert min_label_components(d.limit(0)).count() == 0


def vectors():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 16))
    rows = list(x)
    for i in range(60):
        z = rng.normal(size=16)
        z -= (z @ x[i]) / (x[i] @ x[i]) * x[i]
        z *= np.linalg.norm(x[i]) / np.linalg.norm(z)
        c = rng.choice([0.93, 0.96, 0.99])
        rows.append(3 * (c * x[i] + np.sqrt(1 - c * c) * z))
    rows += [x[0], x[0], x[1] * 2.0]
    return [r.tolist() for r in rows] + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [1.0, 2.0], [1e308] * 16, [float("inf")] + [1.0] * 15]


@pytest.mark.parametrize("block", [2048, 8])
def test_embeddings(spark, block):
    rows = vectors()
    ok = [i for i, v in enumerate(rows) if v and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    m = embeddings.unit(np.array([rows[i] for i in ok]))
    g = m @ m.T >= 0.95
    links = [(ok[a], ok[b]) for a in range(len(ok)) for b in range(a + 1, len(ok)) if g[a, b]]
    want = closure(range(len(rows)), links)
    n = {i: sum(i in e for e in links) for i in range(len(rows))}
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, pivot int, label string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(d, block=block).collect()}
    assert {i: r.n_links for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("pivots, least_recall", [(128, 0.997), (500, 0.99), (2000, 0.985)])
def test_recall_at_the_threshold(pivots, least_recall):
    """Pairs with a cosine of exactly 0.95 in open space, by the query's own rule, as many pivots as up to 16 million vectors have."""
    rng = np.random.default_rng(2)
    n = 1500
    a = embeddings.unit(rng.normal(size=(n, 64)))
    z = rng.normal(size=a.shape)
    z = embeddings.unit(z - (z * a).sum(1, keepdims=True) * a)
    p = embeddings.unit(rng.normal(size=(pivots, 64)))
    perm = embeddings.permutations(np.concatenate([a, 0.95 * a + np.sqrt(1 - 0.95**2) * z]), p, 8)
    found = [embeddings.scores(perm, np.arange(k, k + 100), np.arange(n + k, n + k + 100), 0, 8)[0].diagonal() >= 12 for k in range(0, n, 100)]
    assert np.mean(found) >= least_recall


def test_scores_of_shared_pivots():
    perm = np.array([[3, 1, 7, 9], [1, 3, 7, 2], [9, 8, 6, 5], [3, 1, 7, 9]], dtype=np.int32)
    score, early = embeddings.scores(perm, np.arange(4), np.arange(4), 3, 4)
    assert score[0].tolist() == [3 * 4, 3 + 4, 1, 3 * 4] and early[0].tolist() == [True, True, False, True]
    full, none = embeddings.scores(perm, np.arange(4), np.arange(4), 0, 4)
    assert full[0].tolist() == [16, 3 + 3 + 4, 1, 16] and not none.any()


def cluster(rng, n, size=64, spread=0.0275):
    """Distinct vectors around one centre, with cosines on both sides of 0.95 among them."""
    centre = embeddings.unit(rng.normal(size=(1, size)))
    return centre + spread * rng.normal(size=(n, size))


def brute(x):
    """Links of each vector and its smallest neighbour's component."""
    u = embeddings.unit(x)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    return np.bincount(np.concatenate([i, j]), minlength=len(x)).tolist(), closure(range(len(x)), zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("block", [2048, 100])
def test_embeddings_in_a_dense_cluster(spark, block):
    """A third of the rows is one noisy cluster of distinct vectors: no link is missed."""
    rng = np.random.default_rng(11)
    x = np.concatenate([cluster(rng, 700), rng.normal(size=(1400, 64))])
    n, comp = brute(x)
    assert 0.2 < np.mean(n[:700]) / 699 < 0.95
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(d, pivots=600, block=block).collect()}  # as many pivots in the cluster as a large table has
    assert [got[i].n_links for i in range(len(x))] == n
    assert {i: r.component_id for i, r in got.items()} == comp


@pytest.mark.parametrize("strays", [1, 150])
def test_embeddings_of_mixed_lengths(spark, strays):
    """Vectors of each length link among themselves, with one longer stray and with many."""
    rng = np.random.default_rng(12)
    short = np.concatenate([cluster(rng, 40, 16, 0.06), rng.normal(size=(20, 16))])
    long_ = cluster(rng, strays, 24, 0.05)
    n, comp = brute(short)
    rows = [v.tolist() for v in short] + [v.tolist() for v in long_]
    d = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(d, block=50).collect()}
    assert sum(n) and [got[i].n_links for i in range(60)] == n and {i: got[i].component_id for i in range(60)} == comp
    if strays > 1:
        n, comp = brute(long_)
        assert [got[60 + i].n_links for i in range(strays)] == n and [got[60 + i].component_id - 60 for i in range(strays)] == [comp[i] for i in range(strays)]


def test_scratch_is_cleared(spark):
    from pagefuse.llm import common

    d = common.written(spark.range(3))
    assert d.count() == 3
    common.clear_scratch(spark)
    with pytest.raises(Exception, match="(?i)file"):
        spark.read.parquet(d.inputFiles()[0]).count()


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(12)]
    got = minhash.intersections(sets[:5], sets[5:], width=7)
    assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[5:]] for x in sets[:5]]
    assert minhash.intersections([], sets).shape == (0, 12)
