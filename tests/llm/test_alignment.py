"""Token groups and links of two tokenizers against a plain alignment, token by token."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from pagefuse.llm import alignment, parts
from pagefuse.llm.queries import op13_tokenizer_alignment

ODD = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "hi <|endoftext|> you", "<s> x </s> <unk>", "▁ marked ▁", "x▁y", "日本 語　テ  キ", "𝔘nicode 🎉🎉 Ａ ﬁ",
    "don't 's", "a" * 2000, "word.\nNext", "\n\nx.\n\n y", "été, ÇA!? 12ab", "a\x00b \x00", "é ​ ﻿", "same text", "same text",
]


def tokens(text, tok, sp):
    """[(id, bytes)] of A and B, or none for both."""
    if not text:
        return [], []
    raw = (" " + text).encode()
    of, special = parts.byte_values(), tok.get_added_tokens_decoder()
    a = [(k, special[k].content.encode() if k in special else bytes(of[c] for c in tok.id_to_token(k))) for k in tok.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for k in sp.encode(text):
        piece = sp.id_to_piece(k)
        b.append((k, bytes([int(piece[3:5], 16)]) if sp.is_byte(k) else piece.replace("▁", " ").encode()))
    if b"".join(x[1] for x in a) != raw or b"".join(x[1] for x in b) != raw:
        return [], []
    return a, b


def spans(own):
    at, out = 0, []
    for k, raw in own:
        out.append((k, at, at + len(raw)))
        at += len(raw)
    return out


def expected(rows):
    """The query's rows: every A token against every B token that overlaps it."""
    tok, sp = parts.load(None, True)[0], alignment.pieces()[0]
    docs, count = [], Counter()
    for i, text in rows:
        a, b = (spans(x) for x in tokens(text, tok, sp))
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        links, j = [], 0
        for k, s, e in a:
            while j and b[j][1] > s:
                j -= 1
            while j < len(b) and b[j][2] <= s:
                j += 1
            m = j
            while m < len(b) and b[m][1] < e:
                links.append((k, b[m][0]))
                m += 1
        begin, groups, pa, pb = 0, [], 0, 0
        for end in ends:
            qa, qb = pa, pb
            while qa < len(a) and a[qa][2] <= end:
                qa += 1
            while qb < len(b) and b[qb][2] <= end:
                qb += 1
            groups.append(",".join(str(x[0]) for x in a[pa:qa]) + "|" + ",".join(str(x[0]) for x in b[pb:qb]))
            pa, pb, begin = qa, qb, end
        count.update(set(links))
        docs.append((i, len(a), len(b), groups, links))
    top = {}
    for (k, _), n in count.items():
        top[k] = max(top.get(k, 0), n)
    return [(i, n_a, n_b, len(g), len(x), sum(count[p] == top[p[0]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", ";".join(g)) for i, n_a, n_b, g, x in docs]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_labels_and_groups():
    labels = alignment.labelled(np.array([1, 3, 4, 6]), np.array([2, 4, 5, 6]), 6)
    assert labels.tolist() == [1, 2, 1, 3, 2, 3]
    assert alignment.group_ends(labels).tolist() == [4, 6]
    a, b = alignment.linked(labels)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 2), (3, 3)]


@pytest.mark.parametrize("cuttable", [True, False])
def test_aligner_against_plain(cuttable):
    rng = np.random.default_rng(4)
    letters = [*"abe .,\n\t 's é9日  !-▁<", "<|endoftext|>", "the", " and"]
    rows = [*enumerate(ODD), *((k, "".join(rng.choice(letters, rng.integers(0, 25)))) for k in range(100, 500))]
    align = alignment.Aligner()
    align.cuttable = cuttable
    align.parts.kept = 60  # forgets again and again
    want = expected(rows)
    for i in range(0, len(rows), 50):
        own = align([t or "" for _, t in rows[i : i + 50]])
        assert [g.decode() for g in align.groups(*own)] == [w[8] for w in want[i : i + 50]]
        assert align.sums(*own).tolist() == [list(w[1:5]) for w in want[i : i + 50]]


def test_small_tables(spark, monkeypatch):
    rows = [*enumerate(ODD), (None, "no id"), (3, "same id"), (3, "same id")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS pair", "1 AS chunk", "2 AS total")
    got = alignment.alignments(d.repartition(5)).select(COLUMNS).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r)
    assert sorted((tuple(r) for r in got), key=key) == sorted((w[:8] for w in expected(rows)), key=key)
    assert sorted(r.groups for r in alignment.groups(d).collect()) == sorted(w[8] for w in expected(rows))
    assert alignment.alignments(d.limit(0)).count() == 0


def test_the_whole_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op13_tokenizer_alignment(spark, sf).select(COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == sorted(w[:8] for w in expected(rows))
