"""Files of token ids against the tokenizer itself and exact round trips."""

import io
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pagefuse.llm import parts, token_files
from pagefuse.llm.common import new_path
from pagefuse.llm.queries import op11_token_output

ODD = [
    "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "x  y", "hi <|endoftext|> you<|endoftext|>", "<|endoftext|>", " <|endoftext|> ", "日本 語　テ  キ",
    "a\x1c b \x1cc", "don't 's 's'", "a" * 3000, " \t\t x", "word.\nNext", "end.\n", "\n\nx.\n\n y", "été, ÇA!? 12ab", "×÷ ª_º", "a\x00b \x00",
]


@pytest.mark.parametrize("plain", [False, True])
def test_parts_equal_whole_texts(plain):
    rng = np.random.default_rng(3)
    letters = [*"ab .,\n\t 's é9日  !-×_ª", "<|endoftext|>"]
    texts = [*ODD, *("".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(1500))]
    encode = parts.PartEncoder(None, plain)
    encode.parts.kept = encode.encode.words.kept = 150  # forgets again and again
    tok = parts.load(None, plain)[0]
    for i in range(0, len(texts), 50):
        own = texts[i : i + 50]
        ids, n = encode(own)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(x, add_special_tokens=False).ids for x in own]


def test_parts_beside_all_white_space():
    """Cuts and runs are found in bytes; characters of several bytes and slices of arrays must not mislead them."""
    rng = np.random.default_rng(4)
    white = [c for c in map(chr, range(0x10000)) if c.isspace()]
    letters = [*white, *"     aZ09.,'|\n\n", "\u0080", "\u0084", "×", "÷", "ÀÖØö", "øÿ", "\u0100", "\u1681", "\u2010", "\u2027", "\u3001", "\u200b", "日", "😀", "ꀀ"]
    texts = [*ODD, *(a + " " + b for a in letters for b in letters), *("".join(rng.choice(letters, rng.integers(0, 20))) for _ in range(1000))]
    tok = parts.load()[0]
    want = [tok.encode(x, add_special_tokens=False).ids for x in texts]
    for kind in (pa.string(), pa.large_string()):
        ids, n = parts.PartEncoder()(pa.array(["before", *texts, "after"], kind).slice(1, len(texts)))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_no_python_call_for_each_part():
    """op11_token_output: parts and words are found, told apart and counted in arrays, the merges run once for each word."""
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)},{k}" for k in range(i, i + 2000)) for i in range(0, 20_000, 1000)]
    encode, calls = parts.PartEncoder(), []
    sys.setprofile(lambda _, event, __: calls.append(event))
    try:
        ids, n = encode(texts)
    finally:
        sys.setprofile(None)
    assert len(calls) < 2000
    tok = parts.load()[0]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("top", [1, 200, 1 << 16, 1 << 24, 1 << 32])
def test_codes_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 3, 4, 5, 1000):
        x = rng.integers(0, top, n).astype(np.uint32)
        control, data = token_files.coded(x)
        assert len(control) == -(-n // 4)
        assert len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in x)
        assert (token_files.decoded(control + data, n) == x).all()


def test_file_round_trip(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 300, 40)
    ids = (rng.zipf(1.3, sizes.sum()) % 50257).astype(np.uint32)
    docs, known = rng.integers(-5, 1 << 60, 40), rng.random(40) < 0.9
    data = token_files.encode_file(ids, sizes, docs, known)
    f = token_files.TokenFile(pa.PythonFile(io.BytesIO(data), mode="r"))
    assert (f.ids(0, len(ids)) == ids).all() and (f.docs == docs).all() and (f.known == known).all()
    for a, b in ((0, 0), (5, 6), (63, 65), (64, 128), (100, 1000)):
        assert (f.ids(a, b) == ids[a:b]).all()
    count = np.bincount(ids)
    assert (np.diff(count[f.table]) <= 0).all() and len(f.table) == np.count_nonzero(count)
    hurt = bytearray(data)
    hurt[-60] ^= 1
    with pytest.raises(ValueError):
        token_files.TokenFile(pa.PythonFile(io.BytesIO(bytes(hurt)), mode="r"))


def expected(rows):
    """(id, start, tokens, crc) of rows in the order of the files, by the plain tokenizer."""
    tok, out, start = parts.load()[0], [], 0
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_small_tables(spark, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 500)
    rows = [(7 * k % 23, t) for k, t in enumerate([*ODD, None])] + [(None, "no id"), (None, None), (3, "same id"), (3, "same id")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n_tokens", "1 AS start", "2 AS path")
    path = new_path(spark)
    files = token_files.write_ids(d.repartition(3), path)
    assert files.count() > 1
    got = [tuple(r) for r in token_files.read_documents(spark, path, with_ids=True).orderBy("place").collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode())))
    assert [r[0] for r in got] == [r[0] for r in ordered] and [r[1] for r in got] == list(range(len(rows)))
    # rows of one id come by length; texts of one length and id by hash, so compare those as sets of one run
    assert sorted(r[3:5] for r in got) == sorted(e[2:] for e in expected(ordered))
    assert [r[2] for r in got] == np.cumsum([0, *[r[3] for r in got]])[:-1].tolist()
    assert all(zlib.crc32(np.array(r[5], dtype="<u4").tobytes()) == r[4] for r in got)
    path = new_path(spark)
    assert token_files.write_ids(d.limit(0), path).count() == 0 and token_files.read_documents(spark, path).count() == 0


def test_full_files_and_one_hot_id(spark, monkeypatch):
    """A third of the rows share an id and a text: they spread over ranges; every file of a range is read."""
    monkeypatch.setattr(token_files, "RANGE_BYTES", 4000)
    d = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one hot text' ELSE concat('text ', id) END AS text")
    path = new_path(spark)
    files = token_files.write_ids(d.repartition(4), path).collect()
    assert max(f.n_docs for f in files) < 250
    got = token_files.read_documents(spark, path).orderBy("place").collect()
    want = expected(sorted((r.doc_id, r.text) for r in d.collect()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((w[0], *w[2:]) for w in want)
    assert [r.doc_id for r in got] == [w[0] for w in want]


def test_the_whole_query(spark, sf):
    got = sorted(tuple(r) for r in op11_token_output(spark, sf).collect())
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert got == expected(rows)
