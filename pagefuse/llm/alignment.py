"""Groups of tokens of two tokenizers that cover the same bytes, and how often their ids meet.

Both tokenizers encode a space and the text.  A string with a label for each
byte says which of them end a token there (none, A, B or both); a regular
expression scans it for the spans up to each label "both", and the labels in a
span count the tokens of its group.  Within a group no border is shared, so
each label but "none" also ends one overlap of an A token with a B token: a
link.

A is a tokenizers file, B a sentencepiece model that adds the space itself.
Both end a token before a space between two characters that are no white space
(``parts``; no piece of B has a space after another character), so the label
string of a part is worked out once.

The links of all documents are counted by id pair.  A task sums the documents
that hold a pair over a chunk of them; the sums meet by pair, once for each
chunk, however often a pair occurs; the totals go back to the chunks that
have the pair.  Only the greatest count of each A id goes through the driver:
one number for each id of the vocabulary.

Edge cases: a null or empty text, and one whose token bytes of A or B are not
the space and the text, has no tokens and links nothing; repeated rows and rows
without an id are documents of their own; an empty table gives no rows; columns
besides id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textarrays as ta
from .common import written
from .parts import Encoder, Parts, Ragged, cut, load
from .repeats import pack, unpack

#: Labels of a byte that ends a token.
A, B = 1, 2
_SPAN = re.compile(b"[^\x03]*\x03")
#: Bytes of text of a chunk whose pairs are summed before they are sent.
CHUNK = 8 << 20
STORED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def pieces(path: str | None = None) -> tuple:
    """(sentencepiece model, bytes of each id, whether texts may be cut)."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    raw = []
    for k in range(sp.get_piece_size()):
        piece = sp.id_to_piece(k)
        raw.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(k) else b"" if sp.is_control(k) or sp.is_unknown(k) else piece.replace("▁", " ").encode())
    as_is = sp.normalize("a  Ａ\tﬁ ") == "▁a▁▁Ａ\tﬁ▁"
    return sp, raw, as_is and not any(re.search("[^▁]▁", sp.id_to_piece(k)) for k in range(sp.get_piece_size()))


def vocabulary_bytes(raw: list[bytes]) -> Ragged:
    """The bytes of each id."""
    out = Ragged(np.uint8)
    out.extend(np.frombuffer(b"".join(raw), np.uint8), np.array([len(b) for b in raw], dtype=np.int64))
    return out


def labelled(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> np.ndarray:
    """The labels of ``size`` bytes, from where the tokens of A and of B end."""
    out = np.zeros(size, dtype=np.uint8)
    out[a_ends - 1] |= A
    out[b_ends - 1] |= B
    return out


def group_ends(labels: np.ndarray) -> np.ndarray:
    """Where the groups end: the spans up to each label "both"."""
    return np.fromiter((m.end() for m in _SPAN.finditer(labels.tobytes())), np.int64)


def linked(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token), by number, of every overlap."""
    x = labels[labels > 0]
    a, b = (x & A).astype(np.int64), (x & B).astype(np.int64) // B
    return np.cumsum(a) - a, np.cumsum(b) - b


class Aligner:
    """Alignments of whole texts; what the tokenizers do to a part is worked out once."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None) -> None:
        self.a_encode, (_, a_raw, a_cuts) = Encoder(a_path, True), load(a_path, True)
        self.sp, b_raw, b_cuts = pieces(b_path)
        self.a_bytes, self.b_bytes, self.cuttable = vocabulary_bytes(a_raw), vocabulary_bytes(b_raw), a_cuts and b_cuts
        self.n_b = len(b_raw)
        self.counts, self.pairs, self.text = np.zeros((0, 5), dtype=np.int64), Ragged(np.int64), Ragged(np.uint8)
        self.parts = Parts(self._add, self._keep)
        # decimal digits of numbers, with room for a mark after them
        width = len(str(max(len(a_raw), self.n_b)))
        self.digits = np.array([str(k).ljust(width + 1, "\0").encode() for k in range(max(len(a_raw), self.n_b))], dtype=f"S{width + 1}").view(np.uint8).reshape(-1, width + 1)
        self.n_digits = np.array([len(str(k)) for k in range(len(self.digits))], dtype=np.int64)

    def _keep(self, stay: np.ndarray) -> None:
        self.counts = self.counts[stay]
        self.pairs.keep(stay)
        self.text.keep(stay)

    def _add(self, fresh: list[str]) -> None:
        """Tokens, groups and links of new parts: counts are (fault, A tokens, B tokens, groups, links)."""
        raw = [b" " + p.encode() for p in fresh]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        whole = np.frombuffer(b"".join(raw), np.uint8)
        a, b = Ragged(np.int64), Ragged(np.int64)
        a.extend(*self.a_encode([" " + p for p in fresh]))
        own = self.sp.encode(fresh, num_threads=1)
        b.extend(np.fromiter(chain.from_iterable(own), np.int64), np.array([len(x) for x in own], dtype=np.int64))
        good = np.ones(len(fresh), dtype=bool)
        texts = Ragged(np.uint8)
        texts.extend(whole, size)
        for ids, of in ((a, self.a_bytes), (b, self.b_bytes)):
            total = np.concatenate([[0], np.cumsum(of.size[ids.flat])])
            end = np.cumsum(ids.size)
            good &= total[end] - total[end - ids.size] == size
        for ids, of in ((a, self.a_bytes), (b, self.b_bytes)):
            k = np.flatnonzero(good)
            wrong = np.flatnonzero(of.take(ids.take(k)) != texts.take(k))
            good[k[np.searchsorted(np.cumsum(size[k]), wrong, side="right")]] = False
        k = np.flatnonzero(good)
        a_ids, b_ids = a.take(k), b.take(k)
        labels = labelled(np.cumsum(self.a_bytes.size[a_ids]), np.cumsum(self.b_bytes.size[b_ids]), int(size[k].sum()))
        ends = group_ends(labels)
        x, y = linked(labels)
        # per part: groups by their ends, links by labels
        stop = np.cumsum(size[k])
        groups = np.diff(np.searchsorted(ends, stop, side="right"), prepend=0)
        links = np.diff(np.concatenate([[0], np.cumsum(labels > 0)])[stop], prepend=0)
        counts = np.zeros((len(fresh), 5), dtype=np.int64)
        counts[:, 0] = ~good
        counts[k, 1:] = np.stack([a.size[k], b.size[k], groups, links], axis=1)
        self.counts = np.concatenate([self.counts, counts])
        self.pairs.extend(a_ids[x] * self.n_b + b_ids[y], counts[:, 4])
        # the groups as text: A ids, then B ids of each
        in_a, in_b = (np.diff(np.concatenate([[0], np.cumsum(labels & m > 0)])[ends], prepend=0) for m in (A, B))
        ga, gb = np.cumsum(in_a), np.cumsum(in_b)
        at_a = np.arange(len(a_ids)) + np.repeat(gb - in_b, in_a)
        at_b = np.arange(len(b_ids)) + np.repeat(ga, in_b)
        n = len(a_ids) + len(b_ids)
        ids, mark = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
        ids[at_a], ids[at_b] = a_ids, b_ids
        mark[ga + gb - in_b - 1], mark[ga + gb - 1] = ord("|"), ord(";")
        rows, length = self.digits[ids], self.n_digits[ids]
        rows[np.arange(n), length] = mark
        data = rows[np.arange(rows.shape[1]) <= length[:, None]]
        tokens = np.concatenate([[0], np.cumsum(length + 1)])
        own = np.zeros(len(fresh), dtype=np.int64)
        own[k] = np.diff(tokens[np.cumsum(a.size[k] + b.size[k])], prepend=0)
        self.text.extend(data, own)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the parts of texts that have tokens, number of parts of each text)."""
        numbers, size = self.parts.numbers([(cut(t) if self.cuttable else [t]) if t else [] for t in texts])
        fault = np.concatenate([[0], np.cumsum(self.counts[numbers, 0])])
        end = np.cumsum(size)
        bad = fault[end] > fault[end - size]
        return numbers[np.repeat(~bad, size)], np.where(bad, 0, size)

    def sums(self, numbers: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(A tokens, B tokens, groups, links) of each text."""
        total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[numbers, 1:], axis=0)])
        end = np.cumsum(size)
        return total[end] - total[end - size]

    def groups(self, numbers: np.ndarray, size: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text; empty without tokens."""
        data = self.text.take(numbers).tobytes()
        stop = np.concatenate([[0], np.cumsum(self.text.size[numbers])])
        end = np.cumsum(size)
        return [data[a : max(a, b - 1)] for a, b in zip(stop[end - size].tolist(), stop[end].tolist(), strict=True)]

    def links(self, numbers: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id pairs of each text end to end, each once and in order; how often; number of pairs of each text)."""
        text = np.repeat(np.arange(len(size)), size)
        key, often = np.unique(text * len(self.counts) + numbers, return_counts=True)
        text, part = np.divmod(key, max(1, len(self.counts)))
        n = self.pairs.size[part]
        pair, text, often = self.pairs.take(part), np.repeat(text, n), np.repeat(often, n)
        o = np.lexsort((pair, text))
        pair, text, often = pair[o], text[o], often[o]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])])) if len(pair) else np.zeros(0, np.int64)
        return pair[first], np.add.reduceat(often, first) if len(first) else often, np.bincount(text[first], minlength=len(size))


def source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text by fixed names."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def groups(df: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups of each document, ``a1,a2|b1;a3|b2,b3`` by their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(a_path, b_path)
        for b in batches:
            for i, j in ta.chunks(ta.string_parts(b.column("text"))[1]):
                own = align.groups(*align(b.column("text").slice(i, j - i).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array([g.decode() for g in own], pa.string())], names=[id_col, "groups"])

    return source(df, id_col, text_col).mapInArrow(ta.tidy(run), f"`{id_col}` long, groups string")


def stored(df: DataFrame, a_path: str | None, b_path: str | None, id_col: str, text_col: str) -> DataFrame:
    """A written row for each document: its counts, the digest of its groups and its links, packed; by chunks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align, chunk, held = Aligner(a_path, b_path), TaskContext.get().partitionId() << 32, 0
        for b in batches:
            offsets = ta.string_parts(b.column("text"))[1]
            for i, j in ta.chunks(offsets):
                own = align(b.column("text").slice(i, j - i).to_pylist())
                sums = align.sums(*own)
                sha = [hashlib.sha256(g).hexdigest() if g else "" for g in align.groups(*own)]
                pair, often, n = align.links(*own)
                end = np.cumsum(n)
                blobs = [pack(pair[p:q], often[p:q].astype(np.uint32)) for p, q in zip((end - n).tolist(), end.tolist(), strict=True)]
                cols = [pa.array(np.full(j - i, chunk)), b.column("id").slice(i, j - i), *[pa.array(sums[:, k]) for k in range(4)], pa.array(sha, pa.string()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
                held += int(offsets[j] - offsets[i])
                if held >= CHUNK:
                    chunk, held = chunk + 1, 0

    return written(source(df, id_col, text_col).mapInArrow(ta.tidy(run), STORED))


def chunk_pairs(rows: DataFrame) -> DataFrame:
    """(chunk, pair, documents of the chunk that hold it); a chunk may have a pair in more than one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), now)), pa.array(pair), pa.array(n)], names=["chunk", "pair", "n"])

        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("links"), strict=True):
                if held and chunk != now:
                    yield out()
                now = chunk
                held.append(unpack(blob.as_py())[0])
        if held:
            yield out()

    return rows.select("chunk", "links").mapInArrow(ta.tidy(run), "chunk long, pair long, n long")


def alignments(df: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: tokens of A and B, groups, links, those that are the most frequent of their A id, the sum of their counts, and the digest of the groups."""
    rows = stored(df, a_path, b_path, id_col, text_col)
    n_b = len(pieces(b_path)[1])
    own = chunk_pairs(rows).withColumn("total", F.sum("n").over(Window.partitionBy("pair"))).select("chunk", "pair", "total")
    counted = written(own)
    top = np.zeros(len(load(a_path, True)[1]), dtype=np.int64)
    for a, n in counted.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("total")).collect():  # one row for each id of A at most
        top[a] = n

    def finish(docs: pa.Table, totals: pa.Table) -> pa.Table:
        pair, at = np.unique(totals.column("pair").to_numpy(), return_index=True)
        total = totals.column("total").to_numpy()[at]
        best, sums = [], []
        for blob in docs.column("links"):
            p, often = unpack(blob.as_py())
            count = total[np.searchsorted(pair, p)] if len(p) else p
            best.append(int(often[count == top[p // n_b]].sum()))
            sums.append(int((often.astype(np.int64) * count).sum()))
        docs = docs.drop_columns(["chunk", "links"])
        return docs.append_column("n_best", pa.array(best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = rows.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(lambda a, b: ta.tidy(finish)(a, b), schema)
    return out.withColumnRenamed("doc_id", id_col)
