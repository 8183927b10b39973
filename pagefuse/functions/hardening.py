"""Hardening of untrusted Markdown, as expressions in a fixed order."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import trim_end, with_commas
from .urls import once

BEGIN, END = "<!-- BEGIN_UNTRUSTED_CONTENT -->", "<!-- END_UNTRUSTED_CONTENT -->"
#: Zero-width and direction characters, the soft hyphen, and controls but for line feed and tab.
INVISIBLE = r"[​-‍⁠-⁤﻿‪-‮⁦-⁩­\u0000-\u0008\u000B-\u001F\u007F-\u009F]"


@dataclass(frozen=True)
class Hardening:
    """What to do beyond the fixed steps."""

    escape_fences: bool = True
    delimit: bool = True
    budget: int | None = 50_000


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no expression for it."""
    return x.map(lambda s: unicodedata.normalize("NFC", s) if isinstance(s, str) else None)


#: Characters that form C may change, move or join to the one before: marks, parts of Hangul syllables, characters that stand for others, and those Java does not know.
UNSTABLE = r"[\u0300-\x{10FFFF}&&[\p{M}\p{Cn}\u0374\u037E\u0387\u0958-\u095F\u09DC-\u09DF\u0A33-\u0A5E\u0B5C\u0B5D\u0F43-\u0F69\u1161-\u1175\u11A8-\u11C2\u1F71-\u1FFD\u2000\u2001\u2126-\u212B\u2329\u232A\u2ADC\uF900-\uFAFF\uFB1D-\uFB4E\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]]"
#: A run of these with the character before it. All others begin anew, so form C of a text is that of these runs.
CLUSTER = f"(?s)[^{UNSTABLE}]?+{UNSTABLE}++"


@F.pandas_udf(ArrayType(StringType()))
def nfc_each(x: pd.Series) -> pd.Series:
    """Unicode normal form C of each of some texts."""
    return x.map(lambda a: [unicodedata.normalize("NFC", s) for s in a] if a is not None else None)


def normal_form(x: Column) -> Column:
    """Unicode normal form C; Python sees only the runs that it may change."""
    runs = nfc_each(F.when(x.rlike(UNSTABLE), F.regexp_extract_all(x, F.lit(CLUSTER), F.lit(0))))
    rest = F.split(x, CLUSTER, -1)
    return F.coalesce(F.array_join(F.zip_with(rest, runs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""), x)


def collapse_blank_lines(x: Column) -> Column:
    """At most two lines in a row that hold white space only.

    Possessive groups loop without recursion, so any number of lines is fine.
    """
    return F.regexp_replace(x, r"(?dm)^((?:[\p{Z}\t]*+\n){2})(?:[\p{Z}\t]*+\n)++", "$1")


def neutralize_fences(x: Column) -> Column:
    """A backslash before every backtick of a run of three or more."""
    return F.regexp_replace(x, "`(?=``)|(?<=`)`(?=`)|(?<=``)`", r"\\`")


def cut_to_chars(x: Column, most: int) -> Column:
    """Text over ``most`` code points is cut there, with a note of how many are missing."""
    cut = trim_end(F.substring(x, 1, most))
    note = F.concat(F.lit("[... Remaining "), with_commas(F.char_length(x) - most), F.lit(" characters truncated by token budget ...]"))
    return F.when(F.char_length(x) <= most, x).otherwise(F.concat(cut, F.when(cut == "", F.lit("")).otherwise(F.lit("\n\n")), note))


def delimited(x: Column) -> Column:
    """Wrapped between the two boundary comments, unless blank or exactly so wrapped already; inner ones are broken up."""
    own = x.startswith(BEGIN + "\n") & x.endswith("\n" + END) & (F.size(F.split(x, "UNTRUSTED_CONTENT", -1)) == 3)
    inner = F.regexp_replace(x, r"(BEGIN|END)_UNTRUSTED_CONTENT", "$1-UNTRUSTED-CONTENT")
    return F.when(x.rlike(r"(?U)^\s*$") | own, x).otherwise(F.concat(F.lit(BEGIN + "\n"), inner, F.lit("\n" + END)))


def harden(x: Column, options: Hardening = Hardening(), normal: bool = True) -> Column:
    """NFC, invisible characters out, blank lines, end, fences, budget, boundary comments.

    Text that this has wrapped and cut before is unwrapped first and its note
    kept, so hardening twice changes nothing.
    """
    y = normal_form(x) if normal else x
    # each step is bound once; no step's lambda holds another, which Spark can't take apart around a Python function
    y = trim_end(collapse_blank_lines(once(F.regexp_replace(y, INVISIBLE, ""), unwrapped)))
    if options.escape_fences:
        y = neutralize_fences(y)
    if options.budget is not None:
        y = once(y, lambda y: within_budget(y, options.budget))
    return once(y, delimited) if options.delimit else y


def unwrapped(y: Column) -> Column:
    """Without the boundary comments that ``delimited`` puts around a text."""
    own = y.startswith(BEGIN + "\n") & y.endswith("\n" + END) & (F.size(F.split(y, "UNTRUSTED_CONTENT", -1)) == 3)
    return F.when(own, F.substr(y, F.lit(len(BEGIN) + 2), F.char_length(y) - len(BEGIN) - len(END) - 2)).otherwise(y)


def within_budget(y: Column, budget: int) -> Column:
    """Cut to the budget, unless it is what an earlier cut left."""
    note = r"\n\n\[\.\.\. Remaining [\d,]+ characters truncated by token budget \.\.\.\]\z"
    cut_before = y.rlike(note) & (F.char_length(F.regexp_replace(y, note, "")) <= budget)
    return F.when(cut_before, y).otherwise(cut_to_chars(y, budget))
