"""Token counts by offset-mapped attribution.

Each document is encoded once, as a whole.  A byte-level tokenizer loses no
byte, so the running sum of its tokens' byte lengths gives the span of every
token.  An interval join (two binary searches) lays the spans over the
sections of the document, and a rule allocates tokens that cross a boundary:

* ``first``: to the section with the token's first byte,
* ``largest``: to the section with most of its bytes, the earlier one on ties,
* ``split``: to all of them, by their part of its bytes.

Sections are the lines of the text, line end included, so they tile the text
and their counts add up to the document's; or spans in a column, in characters.
Tokens in no span are counted in a row of section -1.

Edge cases: a null or empty text has no tokens and one empty section 0;
repeated rows and null ids are counted row by row; an empty table gives no
rows; a null span list means one span over the whole text; extra columns are
not read.  A very long text is encoded whole, in one call.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "largest", "split")
#: Loaded encodings of this process, by path of their vocabulary.
_LOADED: dict[str, tuple] = {}


def load(path: str | None = None) -> tuple:
    """(encoding, byte length of each token); ``path`` is a file of base64 tokens and ranks."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for t, r in ranks.items():
            lengths[r] = len(t)
        _LOADED[path] = (enc, lengths)
    return _LOADED[path]


def line_spans(raw: bytes) -> np.ndarray:
    """Byte spans (start, end) of the lines of a text, line ends included."""
    ends = np.array([m.end() for m in re.finditer(b"\n", raw)], dtype=np.int64)
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    return np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1)


def char_spans(text: str, spans: list) -> np.ndarray:
    """Spans in characters as spans in bytes."""
    at = np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "replace")) for c in text])])
    n = len(text)
    return np.array([[at[min(max(a, 0), n)], at[min(max(b, 0), n)]] for a, b in spans], dtype=np.int64).reshape(-1, 2)


def chars_before(raw: bytes) -> np.ndarray:
    """Characters before each byte of a text, and in all of it."""
    return np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])


def attribute(ends: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each span, and how many that touch it cross a boundary; the last entry is for no span.

    ``ends`` has the end of each token, ``spans`` sorted spans that do not overlap.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    k = len(spans)
    counts, crossing = np.zeros(k + 1), np.zeros(k + 1, dtype=np.int64)
    if not len(ends):
        return counts, crossing
    # the spans that a token touches: from the first that ends after its start to the last that starts before its end
    lo = np.searchsorted(spans[:, 1], starts, side="right")
    hi = np.searchsorted(spans[:, 0], ends, side="left") - 1
    inside = (lo == hi) & (starts >= spans[np.minimum(lo, k - 1), 0]) & (ends <= spans[np.minimum(lo, k - 1), 1])
    counts += np.bincount(lo[inside], minlength=k + 1)
    for t in np.flatnonzero(~inside):  # few: those at a boundary or in no span
        a, b, touched = starts[t], ends[t], range(int(lo[t]), int(hi[t]) + 1)
        share = [min(b, spans[s, 1]) - max(a, spans[s, 0]) for s in touched]
        own = [s for s, w in zip(touched, share, strict=True) if w > 0]
        share = [w for w in share if w > 0]
        for s in own:
            crossing[s] += 1
        if not own:
            counts[k] += 1
        elif rule == "first":
            counts[own[0] if spans[own[0], 0] <= a else k] += 1
        elif rule == "largest":
            rest = (b - a) - sum(share)
            best = int(np.argmax(share))
            counts[own[best] if share[best] >= rest else k] += 1
        else:
            for s, w in zip(own, share, strict=True):
                counts[s] += w / (b - a)
            counts[k] += ((b - a) - sum(share)) / (b - a)
    return counts, crossing


def token_counts(df: DataFrame, rule: str = "largest", id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """One row for each section: its span in characters and in bytes, ``n_tokens`` by the rule, ``n_crossing`` tokens, and the document's ``doc_tokens``.

    One Arrow pass; nothing is shuffled and a document never leaves its task.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, section int, start_char long, end_char long, start_byte long, end_byte long, n_tokens double, n_crossing long, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = load(tokenizer_path)
        for b in batches:
            keys, at, parts, n = b.column("__id"), [], [], 0
            texts = b.column("__text")
            for i in range(b.num_rows):
                text = texts[i].as_py() or ""
                raw = text.encode("utf-8", "replace")
                ends = np.cumsum(lengths[np.array(enc.encode_ordinary(text), dtype=np.int64)]) if raw else np.zeros(0, np.int64)
                own = b.column("__spans")[i].as_py() if spans_col else None
                spans = char_spans(text, sorted((s["start"], s["end"]) for s in own)) if own else np.array([[0, len(raw)]], dtype=np.int64) if spans_col else line_spans(raw)
                counts, crossing = attribute(ends, spans, rule)
                k = len(spans) + int(counts[-1] > 0)
                rows = np.zeros((k, 8))
                rows[:, 0] = [*range(len(spans)), -1][:k]
                rows[: len(spans), 1:3] = spans if len(raw) == len(text) else chars_before(raw)[spans]
                rows[: len(spans), 3:5] = spans
                rows[:, 5], rows[:, 6], rows[:, 7] = counts[:k], crossing[:k], len(ends)
                at += [i] * k
                parts.append(rows)
                n += k
                if n > 50_000:
                    yield frame(keys, at, parts)
                    at, parts, n = [], [], 0
            if n:
                yield frame(keys, at, parts)

    def frame(keys: pa.Array, at: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        whole = x[:, [0, 1, 2, 3, 4, 6, 7]].astype(np.int64).T
        out = [keys.take(pa.array(at)), pa.array(whole[0].astype(np.int32)), *[pa.array(whole[k]) for k in (1, 2, 3, 4)], pa.array(x[:, 5]), pa.array(whole[5]), pa.array(whole[6])]
        return pa.RecordBatch.from_arrays(out, names=[id_col, "section", "start_char", "end_char", "start_byte", "end_byte", "n_tokens", "n_crossing", "doc_tokens"])

    d = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *([F.col(spans_col).alias("__spans")] if spans_col else []))
    return d.mapInArrow(run, schema)
