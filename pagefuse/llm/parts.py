"""Encoding texts by their parts, each different part once.

A byte-level tokenizer with the usual word pattern always ends a token before a
space that stands between two characters that are no white space: nothing in
the pattern spans such a place, and nothing in it looks across.  So a text is
the parts between these spaces, and a part has the same tokens wherever it
stands.  ``Parts`` keeps the tokens of the parts it has met; it forgets rare
ones when there are too many.  ``Strings`` does so for Arrow arrays, whose
texts are cut as bytes: no Python string is made for a part that recurs.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textarrays as ta

#: A space that is no cut, and a cut.
_ODD = re.compile(r" (?:(?=\s)|(?<=\s ))")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Parts that are kept from one batch to the next.
KEPT = 400_000
#: Bytes of them.
KEPT_BYTES = 32 << 20
#: Parts that are encoded as one text.
JOINED = 20_000
#: White space as the last bytes of three: up to the first ASCII character, then two and three bytes long.
_WHITE = [[int.from_bytes(b, "big") for b in (c.encode() for c in map(chr, range(0x10000)) if c.isspace()) if len(b) == n] for n in (1, 2, 3)]
_BLANK = np.isin(np.arange(256), _WHITE[0])
#: Kinds of bytes: letters, digits and marks whose class no version of Unicode disputes, line ends and spaces; 0 for others.
LETTER, DIGIT, MARK, LINE, SPACE = range(1, 6)
_LOADED: dict[tuple, tuple] = {}


def cut(text: str) -> list[str]:
    """The parts of a text; joined by one space they are the text.  Only the first may begin, only the last end with white space."""
    if text[:1].isspace() or text[-1:].isspace() or _ODD.search(text):
        return _CUT.split(text)
    return text.split(" ")


def cut_places(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the spaces of ``cut`` lie in texts laid end to end."""
    at = np.flatnonzero(values == 0x20)
    edge = np.zeros(len(values) + 1, dtype=bool)
    edge[offsets] = True
    at = at[~(edge[at] | edge[at + 1])]
    at = at[~(_BLANK[values[at - 1]] | _BLANK[values[at + 1]])]
    for beside in (-1, 1):
        odd = np.flatnonzero(values[at + beside] > 0x7F)
        # a character of several bytes lies in the text whole, and its neighbours are inside or not asked for
        a, b, c = (values[np.clip(at[odd] + k, 0, len(values) - 1)].astype(np.int32) for k in ((-3, -2, -1) if beside < 0 else (1, 2, 3)))
        two = b << 8 | c if beside < 0 else a << 8 | b
        at = np.delete(at, odd[np.isin(two, _WHITE[1]) | np.isin(a << 16 | b << 8 | c, _WHITE[2])])
    return at


def strings(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The strings between bounds, of the same bytes."""
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64)), pa.py_buffer(values)])


def laid(offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The bounds of texts and of the pieces that begin inside them, in order."""
    return np.append(np.sort(np.concatenate([offsets[:-1], inside]), kind="stable"), offsets[-1])


def summed(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum of each group of values, of so many each."""
    total, end = np.concatenate([[0], np.cumsum(values)]), np.cumsum(size)
    return total[end] - total[end - size]


def as_strings(texts: list[str] | pa.Array) -> pa.Array:
    """Texts as an array with long offsets."""
    return pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 for itself, the rest from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(path: str | None = None, plain_specials: bool = False) -> tuple:
    """(tokenizer, bytes of each id, whether texts may be cut) of a tokenizers file.

    With ``plain_specials`` the strings of special tokens are ordinary text.
    """
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if (path, plain_specials) not in _LOADED:
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = plain_specials
        state, of = json.loads(tok.to_str()), byte_values()
        special = tok.get_added_tokens_decoder()
        raw = [b""] * tok.get_vocab_size()
        for piece, k in tok.get_vocab().items():
            raw[k] = special[k].content.encode() if k in special else bytes(of[c] for c in piece)
        pre = state["pre_tokenizer"] or {}
        cuttable = state["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        cuttable = cuttable and not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in special.values())
        _LOADED[path, plain_specials] = tok, raw, cuttable
    return _LOADED[path, plain_specials]


class Encoder:
    """A function from texts to (ids laid end to end, number of ids of each).

    Most texts that it gets are new words with a space before and a mark or a
    line end after.  The words in them recur, so these texts are taken apart
    and the vocabulary's merges run once for each different word.  All other
    texts go through the tokenizer as they are.
    """

    def __init__(self, path: str | None = None, plain_specials: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tok, raw, self.cuttable = load(path, plain_specials)
        self.size = np.array([len(b) for b in raw], dtype=np.int64)
        self.bare = Tokenizer(self.tok.model)  # merges only
        special = "" if plain_specials else "".join(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.kind = np.zeros(256, dtype=np.uint8)
        for c in map(chr, range(0x21, 0x7F)):
            self.kind[ord(c)] = LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK if c != "'" and c not in special else 0
        self.kind[[ord("\n"), ord(" ")]] = LINE, SPACE
        self.table = "".join(sorted(byte_values(), key=byte_values().get))
        self.ids = Ragged(np.uint32)
        self.words = Strings(self._add, self.ids.keep)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], dtype=np.int64)

    def _add(self, words: pa.Array) -> None:
        values, offsets = ta.string_parts(words)
        text, stops = codecs.charmap_decode(values.tobytes(), "strict", self.table)[0], offsets.tolist()
        for at in range(0, len(words), JOINED):
            cuts = stops[at : at + JOINED + 1]
            own = [text[a:b] for a, b in pairwise(cuts)]
            ids = np.array(self.bare.encode_batch_fast([own], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=np.uint32)
            stop = np.searchsorted(np.cumsum(self.size[ids]), np.array(cuts[1:]) - cuts[0]) + 1
            self.ids.extend(ids, np.diff(stop, prepend=0))

    def runs(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where words begin inside texts, whether a text is simple) of texts laid end to end; any other text is one word.

        A simple text may begin with a space and is runs of letters, digits or
        marks and single line ends inside; its words are the line ends and the
        runs, the first with the space.
        """
        first = np.zeros(len(values) + 1, dtype=bool)
        first[offsets] = True
        kind = np.append(self.kind[values], np.uint8(0))
        # letters of two bytes: C3 and all but the signs of times and division
        lead = np.flatnonzero(values[:-1] == 0xC3)
        after = values[lead + 1]
        lead = lead[(after & 0xC0 == 0x80) & (after != 0x97) & (after != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        bad = kind[:-1] == 0
        spaces, lines = np.flatnonzero(kind == SPACE), np.flatnonzero(kind == LINE)
        bad[spaces] = ~first[spaces] | first[spaces + 1]
        bad[lines] = first[lines] | first[lines + 1] | (kind[lines + 1] == LINE) | (kind[lines - 1] == SPACE)
        simple = offsets[1:] > offsets[:-1]
        simple[np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1] = False
        start = np.diff(kind[:-1], prepend=np.uint8(0)) != 0
        start[lines] = True
        start[spaces[spaces + 1 < len(start)] + 1] = False
        inside = np.flatnonzero(start & ~first[:-1])
        if not simple.all():
            inside = inside[simple[np.searchsorted(offsets, inside, side="right") - 1]]
        return inside, simple

    def __call__(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids laid end to end, number of ids of each text)."""
        texts = as_strings(texts)
        if not self.cuttable:
            return self._whole(texts.to_pylist())
        values, offsets = ta.string_parts(texts)
        inside, simple = self.runs(values, offsets)
        size = 1 + np.diff(np.searchsorted(inside, offsets))
        words = strings(values, laid(offsets, inside))
        numbers = self.words.numbers(words if simple.all() else words.filter(pa.array(np.repeat(simple, size))))
        out, rest = Ragged(np.uint32), Ragged(np.uint32)
        out.extend(self.ids.take(numbers), summed(self.ids.size[numbers], size[simple]))
        if simple.all():
            return out.flat, out.size
        rest.extend(*self._whole(texts.filter(pa.array(~simple)).to_pylist()))
        order = np.empty(len(texts), np.int64)
        order[simple], order[~simple] = np.arange(simple.sum()), np.arange((~simple).sum()) + len(out.size)
        out.extend(rest.flat, rest.size)
        return out.take(order), out.size[order]


class Numbers(dict):
    """A number for each key, in order of their first look-up."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Parts:
    """Numbers of parts; ``add`` is told of the parts that are new, in order of their numbers, and ``keep`` which numbers stay."""

    def __init__(self, add: Callable[[list[str]], None], keep: Callable[[np.ndarray], None], kept: int = KEPT) -> None:
        self.add, self.keep, self.kept = add, keep, kept
        self.number = Numbers()
        self.seen = np.zeros(0, dtype=np.int64)

    def numbers(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all parts in order, number of parts of each text)."""
        if len(self.number) > self.kept:
            self.forget()
        old = len(self.number)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, int(size.sum()))
        if len(self.number) > old:
            self.add(list(islice(self.number, old, None)))
        seen = np.bincount(out, minlength=len(self.number))
        seen[: len(self.seen)] += self.seen
        self.seen = seen
        return out, size

    def forget(self) -> None:
        """Keep the parts that were met more than once, or none where these are too many as well."""
        stay = np.flatnonzero(self.seen > 1)
        if 2 * len(stay) > self.kept:
            stay = stay[:0]
        names = list(self.number)
        self.number = Numbers((names[k], j) for j, k in enumerate(stay.tolist()))
        self.seen = np.ones(len(stay), dtype=np.int64)
        self.keep(stay)


class Strings:
    """``Parts`` for the strings of an Arrow array; they stay in Arrow."""

    def __init__(self, add: Callable[[pa.Array], None], keep: Callable[[np.ndarray], None], kept: int = KEPT) -> None:
        self.add, self.keep, self.kept = add, keep, kept
        self.known = pa.array([], pa.large_string())
        self.seen = np.zeros(0, dtype=np.int64)

    def numbers(self, texts: pa.Array) -> np.ndarray:
        """The numbers of all strings, in order."""
        if len(self.known) > self.kept or self.known.nbytes > KEPT_BYTES:
            self.forget()
        different = texts.dictionary_encode()
        number = pc.index_in(different.dictionary, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            number[fresh] = np.arange(len(fresh)) + len(self.known)
            new = different.dictionary.take(pa.array(fresh))
            self.add(new)
            self.known = pa.concat_arrays([self.known, new])
        index = different.indices.to_numpy()
        self.seen = np.concatenate([self.seen, np.zeros(len(fresh), np.int64)])
        self.seen[number] += np.bincount(index, minlength=len(number))
        return number[index]

    def forget(self) -> None:
        """Keep the strings that were met more than once, or none where these are too many as well."""
        stay = np.flatnonzero(self.seen > 1)
        known = self.known.take(pa.array(stay))
        if 2 * len(stay) > self.kept or 2 * known.nbytes > KEPT_BYTES:
            stay, known = stay[:0], known[:0]
        self.known, self.seen = known, np.ones(len(stay), dtype=np.int64)
        self.keep(stay)


class Ragged:
    """Arrays of different lengths, laid end to end, that grow at the end."""

    def __init__(self, dtype: type) -> None:
        self.flat, self.size = np.zeros(0, dtype), np.zeros(0, np.int64)
        self._off: np.ndarray | None = None

    def extend(self, flat: np.ndarray, size: np.ndarray) -> None:
        """More arrays."""
        self.flat, self.size, self._off = np.concatenate([self.flat, flat.astype(self.flat.dtype)]), np.concatenate([self.size, size]), None

    @property
    def off(self) -> np.ndarray:
        """Where each begins."""
        if self._off is None:
            self._off = np.cumsum(self.size) - self.size
        return self._off

    def take(self, k: np.ndarray) -> np.ndarray:
        """Arrays ``k``, laid end to end."""
        n = self.size[k]
        end = np.cumsum(n)
        return self.flat[np.repeat(self.off[k] - end + n, n) + np.arange(end[-1] if len(end) else 0)]

    def keep(self, k: np.ndarray) -> None:
        """Only arrays ``k`` stay."""
        self.flat, self.size, self._off = self.take(k), self.size[k], None


class PartEncoder:
    """Ids of whole texts by their parts; a tokenizer whose texts can't be cut encodes them whole."""

    def __init__(self, path: str | None = None, plain_specials: bool = False) -> None:
        self.encode = Encoder(path, plain_specials)
        self.ids = Ragged(np.uint32)
        self.parts = Strings(self._add, self.ids.keep)

    def _add(self, fresh: pa.Array) -> None:
        self.ids.extend(*self.encode(fresh))

    def __call__(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids laid end to end, number of ids of each text)."""
        texts = as_strings(texts)
        if not self.encode.cuttable:
            return self.encode(texts)
        values, offsets = ta.string_parts(texts)
        inside = cut_places(values, offsets)
        # a part that is not its text's first has its space
        numbers = self.parts.numbers(strings(values, laid(offsets, inside)))
        size = 1 + np.diff(np.searchsorted(inside, offsets))
        return self.ids.take(numbers), summed(self.ids.size[numbers], size)
