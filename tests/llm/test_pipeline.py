"""The pipeline's stages on the smallest tables and on planted cases, and the registered queries."""

import random

import pytest
from compare import oracle, rows

import corpus_pipeline
from pagefuse.llm.common import written
from pagefuse.llm.oracles import ORACLES
from pagefuse.llm.queries import QUERIES

SLOW_ORACLES = {"op8_sharding"}  # its checksum is slow in SQL; the driver runs it at sf0.01


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES or name in SLOW_ORACLES:
        assert len(got)
        return
    want = oracle(sf, ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_stages_on_planted_cases(spark, sf):
    rng = random.Random(5)
    clean = [prose(rng, 200) for _ in range(30)]
    passage = prose(rng, 80)
    texts = dict(enumerate(clean))
    texts[100] = clean[0]  # an exact copy
    texts[101] = clean[1].replace(clean[1].split()[50], "changed", 1)  # a near copy
    texts[102], texts[103] = prose(rng, 100) + " " + passage, passage + " " + prose(rng, 100)
    texts[104] = "spam " * 300
    texts[105] = "too short"
    texts[106] = None
    d = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf)
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS + ([corpus_pipeline.POSITION] if name.startswith("mixing") else [])
            d = written(out)
            ids[name] = {r.doc_id: r.text for r in d.collect()}
        else:
            last = out.collect()
    assert set(ids["quality rules"]) == set(texts) - {104, 105, 106}
    assert set(ids["MinHash near-dedup"]) == set(range(30)) | {102, 103}
    cut = ids["suffix-array dedup"]
    assert set(cut) == set(ids["MinHash near-dedup"]) and passage in cut[102] and passage not in cut[103] and all(cut[i] == clean[i] for i in range(30))
    assert ids["mixing sources to target weights"] == cut
    assert {r.doc_id for r in last} == set(cut)


CLASHING = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"{c} string" for c in ("n", "f1", "bands", "part", "id", "slot", "position", "block", "fail_bits", "n_tokens", "batch", "component_id", "kept")]])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, sf, name, stage):
    """Empty tables, nulls in any column, repeated rows, ties, a very long text, clashing columns: each stage on its own."""
    rng = random.Random(7)
    long_ = prose(rng, 1000) + " " + " ".join(prose(rng, 100) for _ in range(40)) * 110  # over 2 MiB
    a, b = prose(rng, 150), prose(rng, 150)
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, None, None, None), (None, a, None, "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0), (3, " \n", "en", "t", 2), (4, long_, "en", "t", 3), (5, "x" * 3_000_000, "en", "t", 3)]
    d = spark.createDataFrame([(*r, *["z"] * 13) for r in rows], CLASHING)
    out = stage(spark, d, sf)
    got = out.collect()
    empty = stage(spark, d.limit(0), sf)
    assert empty.count() == 0 and empty.columns == out.columns
    if name == "packing":
        assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, None} and all(r.n_tokens <= r.bucket_len for r in got)
        return
    assert out.columns[:5] == corpus_pipeline.COLUMNS
    ids = sorted((r.doc_id or 0 for r in got))
    if name.startswith("quality"):
        assert set(ids) <= {0, 1, 4} and ids.count(1) == 3
    elif name.startswith("MinHash"):
        assert ids == [0, 0, 1, 1, 2, 3, 4, 5] and sorted(r.text for r in got if r.doc_id == 1) == sorted([a, b])
    elif name.startswith("suffix"):
        assert ids == [0, 0, 1, 1, 1, 2, 3, 4, 5] and [r.text for r in got if r.doc_id == 5] == ["x" * 3_000_000]
    else:
        assert ids == [0, 0, 1, 1, 1, 2, 3, 4, 5] and sorted(r.mix_position for r in got) == list(range(9))


def test_packing_follows_the_mix(spark, sf):
    """From a frame in memory: within a bucket, pieces come in order of the mix, whatever the order of the rows."""
    rng = random.Random(3)
    d = spark.createDataFrame([(i, "w " * rng.randint(1, 40), "en", f"s{rng.randint(0, 3)}", 0) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, d, sf)
    place = {r.doc_id: r.mix_position for r in mixed.collect()}
    for frame in (mixed, mixed.orderBy("doc_id"), written(mixed.orderBy("n_chars", "text"))):
        buckets = {}
        for r in corpus_pipeline.pack(spark, frame, sf).collect():
            buckets.setdefault(r.bucket_len, []).append((r.batch, r.slot, place[r.doc_id]))
        for own in buckets.values():
            own.sort()
            assert [x[2] for x in own] == sorted(x[2] for x in own)


def test_pipeline_against_brute_force(spark, sf):
    """Rules, near copies, repeated strings, mix and batches of a small corpus, each worked out plainly."""
    from pagefuse.llm import packing
    from pagefuse.llm.token_counts import load

    rng = random.Random(11)
    base = [prose(rng, 120) for _ in range(24)]
    shared = prose(rng, 60)
    texts = {10 * i: t for i, t in enumerate(base)}
    for i in range(6):
        w = base[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts[10 * i + 1] = " ".join(w)
        texts[10 * i + 5] = prose(rng, 70) + " " + shared + " " + prose(rng, 30)
    texts[9000], texts[9001], texts[9002] = base[3], "few words", None
    d = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = written(stage(spark, d, sf))
    got = {(r.doc_id, r.piece): (r.n_tokens, r.bucket_len, r.batch, r.slot) for r in corpus_pipeline.pack(spark, d, sf).collect()}

    kept = {i: t for i, t in texts.items() if t and len(t.split()) >= 50}  # the other rules of the policy reject none of these
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in kept.items()}
    root = {i: i for i in kept}
    for i in sorted(kept):
        for j in sorted(kept):
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    kept = {i: t for i, t in kept.items() if root[i] == i}
    first = {}
    for i in sorted(kept):
        for k in range(len(kept[i]) - 199):
            first.setdefault(kept[i][k : k + 200], i)
    cut = {}
    for i, t in kept.items():
        gone = set()
        for k in range(len(t) - 199):
            if first[t[k : k + 200]] < i:
                gone |= set(range(k, k + 200))
        cut[i] = "".join(c for k, c in enumerate(t) if k not in gone)
    from test_native import fair

    sources = sorted({f"s{i % 3}" for i in cut})
    import hashlib

    lists = [sorted((i for i in cut if f"s{i % 3}" == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for s in sources]
    order = [lists[s][k] for s, j, _, _ in fair([len(x) for x in lists], [len(x) ** 0.7 for x in lists], 0.7, 16) for k in range(16 * j, min(16 * j + 16, len(lists[s])))]
    n = {i: len(load()[0].encode_ordinary(t)) + 1 for i, t in cut.items()}
    values = sorted(set(n.values()))
    edges = packing.optimal_edges([*values], [sum(x == v for x in n.values()) for v in values], 16)
    want, count = {}, dict.fromkeys(edges, 0)
    for i in order:
        e = min(x for x in edges if x >= n[i])
        want[(i, 0)] = (n[i], e, count[e] // (65536 // e), count[e] % (65536 // e))
        count[e] += 1
    assert len(cut[15]) < len(texts[15]) and got == want


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and len({r.doc_id for r in got}) > 100


def test_entry_registers_all():
    import __spark_entry__

    q = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(q) and set(__spark_entry__.oracle_sql()) <= set(q)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
