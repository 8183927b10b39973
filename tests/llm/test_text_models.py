"""Token attribution against decoding, and the classifier's held-out accuracy."""

import zlib

import duckdb
import numpy as np
import pytest

from pagefuse.llm import token_counts, toxicity

TEXTS = [None, "", "\n", "one line", "first\nsecond line\n\n", "naïve café\n日本語 text\n", "a" * 3000, "word " * 500 + "\nend", "\r\nx\ty"]


def test_spans_round_trip():
    enc, lengths = token_counts.load()
    for t in TEXTS:
        raw = (t or "").encode()
        ids = enc.encode_ordinary(t or "")
        ends = [0, *np.cumsum(lengths[ids]).tolist()] if ids else [0]
        pieces = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        assert pieces == [enc.decode_single_token_bytes(i) for i in ids]
        spans = token_counts.line_spans(raw)
        assert b"".join(raw[a:b] for a, b in spans) == raw


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution(spark, rule):
    d = spark.createDataFrame([*enumerate(TEXTS), (None, "null id")], "doc_id long, text string").selectExpr("*", "1 AS section", "'x' AS n_tokens")
    got = token_counts.token_counts(d, rule).collect()
    enc, _ = token_counts.load()
    for i, t in enumerate(TEXTS):
        own = [r for r in got if r.doc_id == i]
        n = len(enc.encode_ordinary(t or ""))
        assert abs(sum(r.n_tokens for r in own) - n) < 1e-9 and {r.doc_tokens for r in own} == {n}
        assert [r.section for r in own] == list(range(len(own)))
    assert sum(r.n_tokens for r in got if r.doc_id is None) > 0
    assert token_counts.token_counts(d.limit(0), rule).count() == 0


def brute(ends, spans, rule):
    counts = [0.0] * (len(spans) + 1)
    for a, b in zip([0, *ends[:-1]][: len(ends)], ends, strict=True):
        share = [max(0, min(b, e) - max(a, s)) for s, e in spans]
        if rule == "first":
            own = [k for k, (s, e) in enumerate(spans) if s <= a < e]
            counts[own[0] if own else -1] += 1
        elif rule == "largest":
            best = max(range(len(spans)), key=lambda k: (share[k], -k)) if spans else -1
            counts[best if spans and share[best] and share[best] >= b - a - sum(share) else -1] += 1
        else:
            for k, w in enumerate(share):
                counts[k] += w / (b - a)
            counts[-1] += (b - a - sum(share)) / (b - a)
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_rules_against_brute_force(rule):
    rng = np.random.default_rng(2)
    for _ in range(200):
        ends = np.cumsum(rng.integers(1, 6, rng.integers(1, 12)))
        cuts = np.unique(rng.integers(0, ends[-1] + 1, 6))
        spans = np.array([(a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if k % 2 == 0 or rng.random() < 0.6]).reshape(-1, 2)
        if not len(spans):
            continue
        got, _ = token_counts.attribute(ends, spans, rule)
        assert np.allclose(got, brute(ends.tolist(), [tuple(s) for s in spans.tolist()], rule))


def test_given_spans(spark):
    d = spark.createDataFrame([(1, "héllo world again", [(0, 5), (6, 11)]), (2, "none", None)], "doc_id long, text string, spans array<struct<start:int,end:int>>")
    got = token_counts.token_counts(d, "largest", spans_col="spans").collect()
    assert [(r.section, r.start_byte, r.end_byte) for r in got if r.doc_id == 1][:2] == [(0, 0, 6), (1, 7, 12)]
    assert [(r.start_char, r.end_char) for r in got if r.doc_id == 1][:2] == [(0, 5), (6, 11)]
    assert any(r.section == -1 for r in got if r.doc_id == 1)


def test_the_whole_query_against_brute_force(spark, tmp_path):
    """Every line's span and tokens, the lines found and the tokens dealt plainly."""
    from pagefuse.llm.queries import op1_token_counts

    texts = [*TEXTS, "É" * 50 + "\nb c\n" * 30]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, section string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(op1_token_counts(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.section))
    enc, lengths = token_counts.load()
    want = []
    for i, t in enumerate(texts):
        t = t or ""
        lines = [x for x in t.split("\n")]
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        chars, spans = 0, []
        for x in lines:
            spans.append((chars, chars + len(x), len(t[:chars].encode()), len(t[: chars + len(x)].encode())))
            chars += len(x)
        ends = np.cumsum(lengths[enc.encode_ordinary(t)]).tolist() if t else []
        n = brute(ends, [x[2:] for x in spans], "largest")
        want += [(i, k, *x, n[k]) for k, x in enumerate(spans)]
    assert [(r.doc_id, r.section, r.start_char, r.end_char, r.start_byte, r.end_byte, r.n_tokens) for r in got] == want
    for r in got:
        assert (texts[r.doc_id] or "")[r.start_char : r.end_char].encode() == (texts[r.doc_id] or "").encode()[r.start_byte : r.end_byte]


@pytest.fixture(scope="module")
def labelled():
    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{d}/documents.parquet' JOIN '{d}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    held = np.array([zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows])
    return rows, held


def test_held_out(labelled):
    rows, held = labelled
    y = np.array([r[2] for r in rows])
    model = toxicity.TextCNN(toxicity.Settings()).fit([r[1] for r, h in zip(rows, held, strict=True) if not h], y[~held])
    s = model.scores([r[1] for r, h in zip(rows, held, strict=True) if h])
    found, truth = s >= 0.3, y[held] == 1
    assert (found & truth).sum() / truth.sum() >= 0.85
    assert (found & truth).sum() / found.sum() >= 0.85
    odd = model.scores([None, "", "a", "x " * 200_000])
    assert ((odd > 0) & (odd < 1)).all()


def naive(m, text):
    """The score of a text by plain loops over words, filters and widths."""
    ids = m.ids(text)
    words = [[sum(float(m.emb[p][d]) for p in parts) for d in range(m.s.dim)] for parts in ids.tolist()]
    z, at = float(m.out0), 0
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(m.s.filters):
            best = max(sum(words[i + j][d] * float(m.conv[k][j, d, f]) for j in range(w) for d in range(m.s.dim)) for i in range(len(words) - w + 1)) + float(m.bias[k][f])
            z += max(best, 0.0) * float(m.out[at])
            at += 1
    return 1 / (1 + np.exp(-(z * m.scale + m.shift)))


def test_scores_against_naive_forward():
    m = toxicity.TextCNN(toxicity.Settings(buckets=200, dim=3, filters=2, stretch=16))
    m.scale, m.shift = 1.3, -0.2
    m.bias = [np.array([0.1, -0.3], np.float32) for _ in toxicity.WIDTHS]
    texts = [None, "", "one", "two words here", "Stems stemming stemmed again and again", " ".join(f"w{i % 13}" for i in range(60)), "two words here"]
    assert np.allclose(m.scores(texts), [naive(m, t) for t in texts], atol=1e-5)


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    m = toxicity.TextCNN(toxicity.Settings(buckets=50, dim=3, filters=2))
    m.emb, m.conv = m.emb.astype(np.float64), [c.astype(np.float64) for c in m.conv]
    m.out, m.bias = rng.normal(0, 1, len(m.out)), [rng.normal(0, 0.5, 2) for _ in m.bias]
    ids, y, h = m.ids("some words of one text that is short"), 1.0, 1e-3

    def loss():
        p = 1 / (1 + np.exp(-(m.out @ np.maximum(m.pooled(ids)[0].astype(np.float64), 0) + m.out0)))
        return -np.log(p) if y else -np.log(1 - p)

    d_out, d_out0, d_conv, d_bias, rows, grads = m.gradient(ids, y)
    d_emb = np.zeros_like(m.emb)
    for r, g in zip(rows, grads, strict=True):
        for part in r.T:
            np.add.at(d_emb, part, g)
    used = np.unique(ids)[1:] if (ids == 0).any() else np.unique(ids)
    for array, want, places in [(m.out, d_out, range(len(m.out))), *[(c, d, range(0, c.size, 2)) for c, d in zip(m.conv, d_conv, strict=True)], *[(b, d, range(2)) for b, d in zip(m.bias, d_bias, strict=True)], (m.emb, d_emb, used * 3)]:
        for k in places:
            at = np.unravel_index(k, array.shape)
            was = array[at]
            array[at] = was + h
            up = loss()
            array[at] = was - h
            down = loss()
            array[at] = was
            assert abs((up - down) / (2 * h) - np.asarray(want)[at]) < 2e-3
    assert abs(d_out0) > 0


def test_thresholds_come_from_rows_kept_aside():
    s = np.array([0.1, 0.2, 0.9, 0.8, 0.7, 0.6, 0.95, 0.05])
    y = np.array([0, 0, 1, 1, 1, 1, 1, 0], dtype=np.float32)
    t = toxicity.language_thresholds(s, y, [None] * 8)
    assert set(t) == {""} and 0.2 < t[""] < 0.6
    assert toxicity.language_thresholds(s, y, ["a", "b"] * 4) == {}
    assert toxicity.kept_aside(10).sum() == 2


def test_edges_of_the_query(spark, tmp_path):
    """Repeated rows, null languages, clashing columns, a text of several megabytes."""
    from pagefuse.llm.queries import op2_toxicity

    rows = [(i, f"text number {i} " + ("vile " * (i % 2)), [None, "en"][i % 3 == 0], 1.0, "x") for i in range(60)]
    rows += [rows[3], (None, "vile vile", None, 1.0, "x"), (61, "word " * 700_000, "en", 1.0, "x"), (62, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, held_out string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, "x") for i in range(60)], "doc_id long, toxic int, text string").select("doc_id", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    got = op2_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.ptp([r.score for r in got if r.doc_id == 3]) < 1e-5


def test_long_text_keeps_its_windows():
    s = toxicity.Settings(stretch=50, epochs=1, max_rows=10)
    m = toxicity.TextCNN(s)
    text = " ".join(f"w{i % 97}" for i in range(500))
    best, _ = m.pooled(m.ids(text))
    whole = toxicity.TextCNN(toxicity.Settings(stretch=10_000))
    assert np.allclose(best, whole.pooled(whole.ids(text))[0], atol=1e-5)
    assert np.allclose(m.logits([text, "a"]), whole.logits([text, "a"]), atol=1e-5)


def test_one_class_and_nulls(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(20)] + [(99, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0) for i in range(20)] + [(99, None)], "doc_id long, toxic int")
    model, thresholds = toxicity.fit(toxicity.sample(docs, labels))
    got = toxicity.scored(docs, model, ["doc_id"]).collect()
    assert len(got) == 21 and all(0 < r.score < 0.3 for r in got) and thresholds == {}
    none, t = toxicity.fit(toxicity.sample(docs, labels.limit(0)))
    assert t == {} and toxicity.scored(docs.limit(0), none, ["doc_id"]).count() == 0


def test_all_labels_are_learnt_from(spark):
    d = spark.createDataFrame([(k, ("bad thing " if k % 2 else "fine day ") + f"word{k % 17} other{k % 5}", "abcd"[k // 2 % 4]) for k in range(600)], "doc_id long, text string, lang string")
    labels = d.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic")
    s = toxicity.Settings(buckets=500, dim=4, filters=4, max_rows=60)
    model, thresholds = toxicity.fit(toxicity.labelled(d, labels), s)
    assert set(thresholds) == set("abcd")  # sixty rows would hold too few toxic ones aside
    score = toxicity.scored(d, model, ["doc_id"]).toPandas()
    assert ((score["score"] >= 0.5) == (score["doc_id"] % 2 == 1)).mean() > 0.99
    again, same = toxicity.fit(toxicity.labelled(d.repartition(7), labels.repartition(3)), s)
    assert np.array_equal(again.table(), model.table()) and same == thresholds
