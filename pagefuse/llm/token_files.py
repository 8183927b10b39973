"""Token ids as files of frequency-ranked, byte-aligned variable-length codes.

A file has the ids of documents that follow each other in the order of the
corpus.  Its ids are ranked by how often they occur in it (ties: smaller id
first), so a file can be read, added or lost without the others.  A rank takes
one to four bytes; the control bytes, four two-bit lengths each, are apart
from them, and reading is a numpy look-up: a control byte gives the lengths of
four codes and where they begin, a mask cuts each from an unaligned word.

Layout, all numbers little-endian::

    blocks    of BLOCK ranks each but the last: control bytes, then data bytes
    footer    uint32 ids by rank | uint64 end of each block | uint64 ids of
              each document | int64 document ids | uint8 whether an id is known
    trailer   the four counts (uint64), crc32 of footer and counts (uint32), magic

Documents are sorted by id: null first, rows that share an id by length and
text.  A task sorts and encodes one range of ids and starts another file when
one is full, so it holds ``FILE_IDS`` ids and one text at most.  A file counts
once its row is in the manifest, which Spark commits as one table; a task that
is lost leaves a file that nothing names.

Edge cases: a null or empty text is its end id alone; repeated rows are
documents of their own; an empty table gives a manifest without files; columns
besides id and text are not read; a very long text may fill a file of its own.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textarrays as ta
from .parts import PartEncoder

MAGIC = b"ranksids"
#: Ids of a block, and about as many of a file.
BLOCK, FILE_IDS = 1 << 16, 1 << 24
#: Bytes of text of one range of document ids.
RANGE_BYTES = 32 << 20
#: Bytes of text that are encoded at once: a larger chunk has fewer different parts for its size.
TEXT_BYTES = 8 << 20

#: Lengths of the four codes of a control byte, their places, and their bytes together.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
PLACES = np.cumsum(LENGTHS, axis=1) - LENGTHS
TOTAL = LENGTHS.sum(axis=1)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)
MANIFEST = "part int, number int, path string, n_docs long, n_ids long, n_bytes long"


def coded(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks."""
    x = np.ascontiguousarray(ranks, dtype="<u4")
    more = (x > 0xFF).view(np.uint8) + (x > 0xFFFF).view(np.uint8) + (x > 0xFFFFFF).view(np.uint8)
    data = x.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    four = np.zeros(-(-len(x) // 4) * 4, dtype=np.uint8)
    four[: len(x)] = more
    four = four.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)
    return np.bitwise_or.reduce(four, axis=1).astype(np.uint8).tobytes(), data.tobytes()


def decoded(block: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block."""
    k = -(-n // 4)
    control = np.frombuffer(block, np.uint8, k)
    total = TOTAL[control]
    at = ((np.cumsum(total) - total)[:, None] + PLACES[control]).ravel()[:n]
    data = block[k:] + bytes(3)
    word = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    return word[at] & MASKS[LENGTHS[control].ravel()[:n]]


def encode_file(ids: np.ndarray, sizes: np.ndarray, docs: np.ndarray, known: np.ndarray) -> bytes:
    """A file of documents: all their ids end to end, the ids of each, document ids and whether these are known."""
    count = np.bincount(ids)
    table = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    rank = np.zeros(len(count), dtype=np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    body, ends = [], []
    for a in range(0, len(ids), BLOCK):
        body += coded(rank[ids[a : a + BLOCK]])
        ends.append(len(body[-2]) + len(body[-1]))
    parts = [table.astype("<u4"), np.cumsum(ends).astype("<u8"), sizes.astype("<u8"), docs.astype("<i8"), known.astype(np.uint8)]
    footer = b"".join(p.tobytes() for p in parts) + np.array([len(table), len(ends), len(sizes), len(ids)], dtype="<u8").tobytes()
    return b"".join(body) + footer + zlib.crc32(footer).to_bytes(4, "little") + MAGIC


class TokenFile:
    """One file, read block by block; ``ids(a, b)`` are any ids of it."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, size = source, source.size()
        tail = self._read(size - 44, 44)
        if tail[36:] != MAGIC:
            raise ValueError("not a file of token ids")
        ranks, blocks, docs, self.n_ids = np.frombuffer(tail, "<u8", 4).tolist()
        length = 4 * ranks + 8 * blocks + 17 * docs
        footer = self._read(size - 44 - length, length)
        if zlib.crc32(tail[:32], zlib.crc32(footer)) != int.from_bytes(tail[32:36], "little"):
            raise ValueError("the footer is damaged")
        at = 0
        for name, kind, n in (("table", "<u4", ranks), ("ends", "<u8", blocks), ("sizes", "<u8", docs), ("docs", "<i8", docs), ("known", "u1", docs)):
            setattr(self, name, np.frombuffer(footer, kind, n, at))
            at += n * np.dtype(kind).itemsize

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        """The ids of block ``k``."""
        at = int(self.ends[k - 1]) if k else 0
        return self.table[decoded(self._read(at, int(self.ends[k]) - at), min(BLOCK, self.n_ids - k * BLOCK))]

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the file."""
        own = [self.block(k) for k in range(a // BLOCK, -(-b // BLOCK))] if b > a else [np.zeros(0, np.uint32)]
        return np.concatenate(own)[a - a // BLOCK * BLOCK :][: b - a]


def opened(path: str, write: bool = False) -> pa.NativeFile:
    """A file of any file system that Arrow knows by its URI."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))
    if write:
        store.create_dir(inner.rsplit("/", 1)[0])
        return store.open_output_stream(inner)
    return store.open_input_file(inner)


def write_ids(df: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Write the ids of all texts, each followed by ``end_id``, below the folder ``path``; the manifest, in the order of the corpus."""
    d = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    # the length and hash split the rows of one id; a salt, rows that are equal
    d = d.select("id", "text", F.octet_length("text").alias("__n"), F.xxhash64("text").alias("__h"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).alias("__salt"))
    order = ["id", "__n", "__h", "__salt"]
    ranged = d.repartitionByRange(max(1, -(-int(total) // RANGE_BYTES)), *order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encode = PartEncoder(tokenizer_path)
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        known: list[np.ndarray] = []

        def full() -> pa.RecordBatch:
            nonlocal number
            name = f"{path}/ids-{part:06d}-{number:04d}-{uuid.uuid4().hex}.bin"
            n_docs, n_ids = sum(map(len, sizes)), sum(map(len, ids))
            data = encode_file(np.concatenate(ids), np.concatenate(sizes), np.concatenate(docs), np.concatenate(known))
            with opened(name, write=True) as f:
                f.write(data)
            row = [part, number, name, n_docs, n_ids, len(data)]
            number += 1
            for x in (ids, sizes, docs, known):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([row[2]]), *[pa.array([v], pa.int64()) for v in row[3:]]], names=["part", "number", "path", "n_docs", "n_ids", "n_bytes"])

        for b in batches:
            offsets = ta.string_parts(b.column("text"))[1]
            for i, j in ta.chunks(offsets, TEXT_BYTES):
                own, n = encode(b.column("text").slice(i, j - i))
                # the end id after each text
                own = np.insert(own, np.cumsum(n), end_id).astype(np.uint32)
                key = b.column("id").slice(i, j - i)
                ids.append(own)
                sizes.append(n + 1)
                docs.append(key.fill_null(0).to_numpy(zero_copy_only=False))
                known.append(np.asarray(key.is_valid()))
                if sum(map(len, ids)) >= FILE_IDS:
                    yield full()
        if ids:
            yield full()

    ranged.mapInArrow(ta.tidy(run), MANIFEST).write.parquet(f"{path}/manifest")
    return manifest(df.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder, one row each, with the ids and documents before each; a few hundred bytes for 32 MB of text."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return rows.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(out) for c, out in (("n_ids", "first_id"), ("n_docs", "first_doc"))])


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of a folder: ``doc_id``, ``place``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``.

    A task reads one file, block by block; a document that spans blocks is put together from them.
    """
    schema = "doc_id long, place long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                with opened(row["path"]) as f:
                    yield from documents(TokenFile(f), row["first_doc"], row["first_id"], with_ids)

    files = manifest(spark, path).select("path", "first_doc", "first_id")
    n = max(1, files.count())
    return files.repartition(n, "first_doc").mapInArrow(ta.tidy(run), schema)


def documents(file: TokenFile, first_doc: int, first_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The documents of a file, in batches of about sixteen blocks of ids."""
    ends = np.cumsum(file.sizes.astype(np.int64))
    a = 0
    while a < len(ends):
        begin = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, begin + 16 * BLOCK, side="right")))
        own = np.ascontiguousarray(file.ids(begin, int(ends[b - 1])), dtype="<u4")
        cuts = np.concatenate([[0], ends[a:b] - begin])
        raw = memoryview(own).cast("B")
        crc = [zlib.crc32(raw[4 * p : 4 * q]) for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        cols = [pa.array(file.docs[a:b], mask=file.known[a:b] == 0), pa.array(np.arange(a, b) + first_doc), pa.array(first_id + begin + cuts[:-1]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())]
        if with_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(own.view("<i4"))))
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "place", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
        a = b
