"""Text expressions: token estimates, budgets, entities, white space, Markdown escapes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entities that are decoded besides numeric ones.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "mdash": "—", "ndash": "–", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”"}

SPACE = r"(?U)\s+"
#: The characters of that class.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_ENTITY = re.compile(r"&(?:#(?P<dec>\d{1,7})|#[xX](?P<hex>[0-9a-fA-F]{1,6})|(?P<name>[A-Za-z]+));")


def normalize_ws(x: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def word_count(x: Column) -> Column:
    """Words between Unicode white space."""
    return F.regexp_count(x, F.lit(r"(?U)\S+"))


def estimate_tokens(x: Column) -> Column:
    """A blend of code points and words: trunc(cp / 4 * 0.6 + words * 1.33 * 0.4)."""
    chars, words = F.char_length(x).cast("double"), word_count(x).cast("double")
    return F.when(x == "", F.lit(0)).otherwise(chars / 4.0 * 0.6 + words * 1.33 * 0.4).cast("long")


def trim_end(x: Column) -> Column:
    """Without white space at the end; one look from the end, however long inner white space is."""
    return F.rtrim(x, F.lit(WHITE))


def with_commas(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def cut_to_tokens(x: Column, most: int) -> Column:
    """Text over a token budget is cut at four characters a token, with a note of what is missing."""
    room = 4 * most
    missing = F.greatest(F.char_length(x) - room, F.lit(0))
    note = F.concat(F.lit("\n\n[... Remaining "), missing.cast("string"), F.lit(" characters truncated by token budget ...]"))
    return F.when(estimate_tokens(x) <= most, x).otherwise(F.concat(trim_end(F.substring(x, 1, room)), note))


def escape_md(x: Column) -> Column:
    """Square brackets escaped for Markdown."""
    return F.regexp_replace(x, r"([\[\]])", r"\\$1")


def snippet(x: Column, most: int = 300) -> Column:
    """One line of at most ``most`` code points, with an ellipsis where it was longer."""
    one = normalize_ws(x)
    return F.when(F.char_length(one) > most, F.concat(F.substring(one, 1, most), F.lit("…"))).otherwise(one)


@F.pandas_udf(StringType())
def decode_entities(x: pd.Series) -> pd.Series:
    """Known and numeric entities decoded in one pass, so a decoded ``&`` starts no other; unknown ones stay."""

    def one(m: re.Match) -> str:
        if m["name"]:
            return ENTITIES.get(m["name"], m[0])
        code = int(m["dec"]) if m["dec"] else int(m["hex"], 16)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return x.map(lambda s: _ENTITY.sub(one, s) if isinstance(s, str) else None)


def strip_tags(x: Column) -> Column:
    """Text of a well-formed snippet: tags out, white space collapsed (entities stay)."""
    return normalize_ws(F.regexp_replace(x, r"<[^>]*>", " "))


def first_heading(markdown: Column, fallback: Column) -> Column:
    """Text of the first ``# `` line, else the fallback."""
    h = F.regexp_extract(markdown, r"(?m)^[ \t]*# +(\S[^\n]*)$", 1)
    return F.when(h == "", fallback).otherwise(F.trim(h))


def visible_chars(x: Column) -> Column:
    """Code points that aren't white space."""
    return F.char_length(F.regexp_replace(x, SPACE, ""))


def unix_to_date(seconds: Column) -> Column:
    """Civil date of an epoch second, in UTC."""
    return F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(seconds / 86400).cast("int")).cast("string")


def parse_currency(query: Column) -> Column:
    """(amount, from, to) of a query like ``100 usd to eur``; null where two codes are missing.

    The last number is the amount, 1 without one; the first two words of three
    letters are the codes.
    """
    tokens = F.filter(F.transform(F.split(query, SPACE), lambda t: F.upper(F.regexp_replace(t, r"^[^A-Za-z0-9.]+|[^A-Za-z0-9]+$", ""))), lambda t: ~t.isin("", "TO", "IN"))
    numbers = F.filter(F.transform(tokens, lambda t: t.try_cast("double")), lambda n: n.isNotNull())
    codes = F.filter(tokens, lambda t: t.rlike("^[A-Z]{3}$"))
    made = F.struct(F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit(1.0)).alias("amount"), F.get(codes, F.lit(0)).alias("from"), F.get(codes, F.lit(1)).alias("to"))
    return F.when(F.size(codes) >= 2, made)


def parse_translation(query: Column) -> Column:
    """(text, from, to) of a query with two leading or two trailing language codes; null without."""
    t = F.split(normalize_ws(query), " ")
    n = F.size(t)
    code = lambda x: F.lower(x).rlike("^[a-z]{2}$")
    at = lambda k: F.get(t, k)
    lead = code(at(F.lit(0))) & code(at(F.lit(1)))
    tail = code(at(n - 2)) & code(at(n - 1))
    first = F.struct(F.array_join(F.slice(t, F.lit(3), F.greatest(n - 2, F.lit(0))), " ").alias("text"), F.lower(at(F.lit(0))).alias("from"), F.lower(at(F.lit(1))).alias("to"))
    last = F.struct(F.array_join(F.slice(t, F.lit(1), F.greatest(n - 2, F.lit(0))), " ").alias("text"), F.lower(at(n - 2)).alias("from"), F.lower(at(n - 1)).alias("to"))
    return F.when((n >= 4) & lead, first).when((n >= 4) & tail, last)
