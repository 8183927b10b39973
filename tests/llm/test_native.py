"""Quality rules, sharding, mixing and packing against models in Python."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagefuse.llm import mixing, packing, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot string, bucket string, __sub string, n_words string"


def docs(spark, texts, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], 0, "x", "y", "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGE = [None, "", " \n\t", "one", "a b c a b c", "a b c d " * 30, "x\ny\nx\n\n \nx", "#tag $1 * & | < >", "é à ñ " * 25, "w " * 5000, "THE END!! " * 60, "a\x0bb\x0cc\rd"]


def measure(t):
    """The contract's counts, plainly."""
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + o for i, g in enumerate(tri) if tri.count(g) > 1 for o in range(3)} if len(w) < 1000 else set(range(len(w)))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_ledger(spark):
    rng = random.Random(3)
    texts = EDGE + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    got = {r.doc_id: r for r in quality.ledger(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measure(t), t
        assert bool(r.fail_bits & quality.BASE.mask) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_policies_and_ablation(spark):
    led = quality.ledger(docs(spark, EDGE)).cache()
    bits = [r.fail_bits for r in led.collect()]
    for r in quality.ablation(led).collect():
        p, b = quality.POLICIES[r.policy], next(1 << x.bit for x in quality.RULES if x.name == r.rule)
        assert r.n_failed == sum(bool(x & b) for x in bits)
        assert r.n_only_this == sum((x & p.mask) == b for x in bits)
        assert r.n_kept == sum(not x & p.mask for x in bits)
        assert r.n_kept_without == sum(not x & p.mask & ~b for x in bits)
    kept = quality.kept_documents(docs(spark, EDGE), quality.BASE)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert quality.ledger(docs(spark, EDGE).limit(0)).count() == 0


@pytest.mark.parametrize("weights", [[1.0] * 5, [1.0, 2.0, 3.0]])
def test_sharding(spark, weights):
    d = docs(spark, [None, "", "é"] + ["t"] * 2000)
    d = d.union(d.where("doc_id < 3")).union(d.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    out = sharding.assign_shards(d, weights, [*weights, 1.0], sub_digits=1).collect()
    assert len(out) == 2007 and {r.law for r in out} == {"key"}
    for s in range(len(weights)):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
        assert abs(len(slots) / 2007 - weights[s] / sum(weights)) < 0.06
    assert all(r.grown_shard in (r.shard, len(weights)) for r in out)
    by = {r.doc_id: r for r in out}
    assert (by[0].size, by[1].size, by[2].size) == (8, 8, 10) and by[0].text_crc32 == 0
    assert len({(r.doc_id, r.shard) for r in out}) == len({r.doc_id for r in out})
    assert sharding.assign_shards(d.limit(0), weights).count() == 0


def test_write_and_move(spark, tmp_path):
    d = docs(spark, ["t"] * 300)
    sharding.write_shards(d, str(tmp_path / "s"), [1.0] * 3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 300
    moved = sharding.moved(d, [1.0] * 3, [1.0] * 4).collect()
    assert all(r.from_shard == r.to_shard or r.to_shard == 3 for r in moved) and sum(r.n for r in moved) == 300


def fair(sizes, weights, alpha, block):
    """(source, block, rows before it, in target) by slot: earliest deadline first in exact fractions, round by round."""
    units = lambda w: [max(1, math.floor(x / sum(w) * mixing.UNIT + 0.5)) if x > 0 else 0 for x in w]
    p, q = units(weights), units([n**alpha for n in sizes])
    blocks, done, out, first, ok = [-(-n // block) for n in sizes], [0] * len(sizes), [], 0, True
    while any(d < b for d, b in zip(done, blocks, strict=True)):
        live = [i for i in range(len(sizes)) if done[i] < blocks[i]]
        goal = p if any(p[i] for i in live) else q
        total, turn, t = sum(goal[i] for i in live), [0] * len(sizes), 0
        while True:
            i = min((-(-(turn[i] + 1) * total // goal[i]), i) for i in live if goal[i] and turn[i] * total // goal[i] <= t)[1]
            out.append((i, done[i], first, ok))
            first += min(block, sizes[i] - done[i] * block)
            done[i], turn[i], t = done[i] + 1, turn[i] + 1, t + 1
            if done[i] == blocks[i]:
                ok = False
                break
    return out


def spark_schedule(spark, sizes, weights, block):
    d = spark.createDataFrame([(f"s{i:05d}", n) for i, n in enumerate(sizes)], "__src string, n long")
    named = {f"s{i:05d}": w for i, w in enumerate(weights)} if weights else None
    rows = sorted(mixing.schedule(d, named, 0.7, block).collect(), key=lambda r: r.mix_slot)
    assert [r.mix_slot for r in rows] == list(range(len(rows)))
    return [(int(r[0][1:]), r[1], r[3], r.in_target) for r in rows], [r.target_weight for r in rows]


@pytest.mark.parametrize("sizes, weights", [([5], None), ([900, 400, 33, 16, 1], None), ([64] * 7, None), ([100, 200, 50, 80], [5.0, 1.0, 0.0, 0.0]), ([100, 40], [0.0, 0.0])])
def test_schedule(spark, sizes, weights):
    got, _ = spark_schedule(spark, sizes, weights, 4)
    assert got == fair(sizes, weights if weights and any(weights) else [n**0.7 for n in sizes], 0.7, 4)


@pytest.mark.parametrize("sizes, block", [([round(500_000 / (i + 1) ** 1.3) for i in range(10)], 128), ([round(4000 / (i + 1)) + 16 for i in range(5000)], 64)])
def test_less_than_one_block_off(spark, sizes, block):
    """Against the unrounded target, on a long run and with thousands of sources."""
    got, _ = spark_schedule(spark, sizes, None, block)
    assert len(got) == len({x[:2] for x in got}) == sum(-(-n // block) for n in sizes)
    share = [n**0.7 / sum(m**0.7 for m in sizes) for n in sizes]
    target = [x for x in got if x[3]]
    for t, (i, j, _, _) in enumerate(target):
        assert share[i] * t - j < 1 + 1e-6 and j + 1 - share[i] * (t + 1) < 1 + 1e-6


def test_mixed(spark):
    sources = [None] * 3 + ["a"] * 400 + ["b"] * 150 + ["c"] * 7
    d = docs(spark, ["t"] * len(sources), sources)
    out = sorted(mixing.mixed(d, block_rows=4, sub_digits=1).collect(), key=lambda r: r.position)
    assert [r.position for r in out] == list(range(len(sources)))
    assert sorted(r.doc_id for r in out) == list(range(len(sources)))
    assert out == sorted(out, key=lambda r: (r.mix_slot, r.position))
    sizes = [3, 400, 150, 7]
    assert [(r.source, r.block) for r in out] == [([None, "a", "b", "c"][i], j) for i, j, _, _ in fair(sizes, [n**0.7 for n in sizes], 0.7, 4) for _ in range(min(4, sizes[i] - 4 * j))]
    weight = {r.source: r.target_weight for r in out}
    assert all(abs(weight[s] - n**0.7 / sum(m**0.7 for m in sizes)) < 1e-9 for s, n in zip([None, "a", "b", "c"], sizes, strict=True))
    named = sorted(mixing.mixed(d, {"a": 1000.0, "b": 1.0, "c": 1e-4}, block_rows=4).collect(), key=lambda r: r.position)
    assert [r.source for r in named][-3:] == [None] * 3 and named[-1].target_weight == 0.0 and not named[-1].in_target
    assert len({r.mix_slot for r in mixing.mixed(d, slots=10).collect()}) <= 14
    assert mixing.mixed(d.limit(0)).count() == 0
    ordered = mixing.in_mix_order(d, block_rows=4, sub_digits=1)
    assert ordered.columns == [*d.columns, "mix_position"] and [(r.doc_id, r.mix_position) for r in ordered.collect()] == [(r.doc_id, r.position) for r in out]


def test_mixed_twice_and_by_shuffle(spark, monkeypatch):
    """Repeated rows, null ids, a frame that was mixed before, and a schedule too long to broadcast."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    d = docs(spark, ["t"] * 30, ["a"] * 20 + ["b"] * 10)
    d = d.union(d.where("doc_id < 9")).union(d.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    twice = mixing.in_mix_order(mixing.in_mix_order(d, block_rows=2), block_rows=2)
    assert twice.columns == [*d.columns, "mix_position"] and [r.mix_position for r in twice.collect()] == list(range(40))


def padding(edges, lengths, counts):
    return sum(c * (min(e for e in edges if e >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_edges_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        m = int(rng.integers(1, 9))
        x, c = np.sort(rng.choice(np.arange(1, 40), m, replace=False)), rng.integers(1, 50, m)
        k = int(rng.integers(1, 5))
        best = min(padding([*e, x[-1]], x, c) for n in range(min(k, m)) for e in itertools.combinations(x[:-1].tolist(), n))
        edges = packing.optimal_edges(x, c, k)
        assert len(edges) <= k and edges[-1] == x[-1] and padding(edges, x, c) == best
    assert packing.optimal_edges(np.zeros(0), np.zeros(0), 3) == []


def test_packed(spark):
    rng = random.Random(4)
    texts = [None, "", "a"] + ["w " * rng.randint(1, 90) for _ in range(300)] + ["w " * 1000]
    d = docs(spark, texts).union(docs(spark, texts).where("doc_id = 5"))
    out = packing.packed(d, max_tokens=64, budget=256, n_buckets=4).collect()
    tokens = {}
    for r in out:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
        assert 0 < r.n_tokens <= r.bucket_len and r.padding == r.bucket_len - r.n_tokens and r.start_token == 64 * r.piece
    want = {i: len((t or "").split()) + 1 for i, t in enumerate(texts)}
    want[5] *= 2
    assert tokens == want
    batches = {}
    for r in out:
        batches.setdefault((r.bucket_len, r.batch), []).append(r.slot)
    for (size, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * size <= 256
        assert (size, batch + 1) not in batches or len(slots) == 256 // size
    assert packing.packed(d.limit(0)).count() == 0


def test_packed_padding_is_least(spark):
    """The padding of packed() itself, against every choice of edges."""
    rng = random.Random(8)
    words = [rng.choice([1, 2, 4, 4, 5, 9, 10, 13, 21, 22, 30]) for _ in range(120)]
    out = packing.packed(docs(spark, ["w " * n for n in words]), max_tokens=64, budget=256, n_buckets=3).collect()
    x, c = np.unique(np.array(words) + 1, return_counts=True)
    best = min(padding([*e, x[-1]], x, c) for e in itertools.combinations(x[:-1].tolist(), 2))
    assert sum(r.padding for r in out) == best
    assert all(r.padding == 0 for r in packing.packed(docs(spark, ["w w w w"] * 5)).collect())


def test_long_unbroken_texts_are_cut(spark, tmp_path):
    """A run of letters and a text without spaces count by the tokenizer, in the query as registered."""
    from pagefuse.llm.queries import op3_packing
    from pagefuse.llm.token_counts import load

    rng = random.Random(6)
    texts = [None, "", "w w", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(5_000))]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    out = op3_packing(spark, str(tmp_path)).collect()
    tokens = {}
    for r in out:
        assert r.n_tokens <= 4096
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens == {i: len(load()[0].encode_ordinary(t or "")) + 1 for i, t in enumerate(texts)}
    assert tokens[3] > 4096 and tokens[4] > 4096
