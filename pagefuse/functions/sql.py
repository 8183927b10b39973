"""Registers the engine's functions for SQL."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import htmlclean, spa, text, urls
from .hardening import BEGIN, END, INVISIBLE, Hardening, nfc


_INVISIBLE = re.compile(INVISIBLE)
_NOTE = re.compile(r"\n\n\[\.\.\. Remaining [\d,]+ characters truncated by token budget \.\.\.\]\Z")
_WORD = "UNTRUSTED_CONTENT"


def hardened(x: str | None, options: Hardening = Hardening()) -> str | None:
    """What ``hardening.harden`` makes of one text."""
    if not isinstance(x, str):
        return None

    def wrapped(y: str) -> bool:
        return y.startswith(BEGIN + "\n") and y.endswith("\n" + END) and y.count(_WORD) == 2

    y = _INVISIBLE.sub("", unicodedata.normalize("NFC", x))
    if wrapped(y):
        y = y[len(BEGIN) + 1 : -len(END) - 1]
    lines, run, kept = y.split("\n"), 0, []
    for line in lines[:-1]:
        run = run + 1 if not line.strip(text.WHITE) else 0
        if run <= 2:
            kept.append(line)
    y = "\n".join([*kept, lines[-1]]).rstrip(text.WHITE)
    if options.escape_fences:
        y = re.sub("`{3,}", lambda m: "\\`" * len(m[0]), y)
    if options.budget is not None and len(y) > options.budget and not (_NOTE.search(y) and len(_NOTE.sub("", y)) <= options.budget):
        cut = y[: options.budget].rstrip(text.WHITE)
        y = cut + ("\n\n" if cut else "") + f"[... Remaining {len(y) - options.budget:,} characters truncated by token budget ...]"
    if options.delimit and y.strip(text.WHITE) and not wrapped(y):
        y = f"{BEGIN}\n{re.sub(f'(BEGIN|END)_{_WORD}', r'\1-UNTRUSTED-CONTENT', y)}\n{END}"
    return y


@F.pandas_udf(StringType())
def harden(x: pd.Series) -> pd.Series:
    """``hardening.harden`` with its defaults, as a function that SQL can name."""
    return x.map(hardened)


@F.pandas_udf(StringType())
def clean_html(html: pd.Series, url: pd.Series) -> pd.Series:
    """Markdown of pages; null where a page can't be cleaned."""
    return pd.Series([htmlclean.clean_page(h, u or "", htmlclean.CleanOptions())[4] for h, u in zip(html, url, strict=True)])


def newer(version: Column, than: str) -> Column:
    """Whether a version of the form ``v1.2.3`` comes after another."""
    parts = lambda v: F.transform(F.split(F.regexp_replace(v, "^v", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^\d+", 0).try_cast("int"), F.lit(0)))
    return parts(version) > parts(F.lit(than))


def intact(content: Column, sha256: Column) -> Column:
    """Whether content has the SHA-256 sum, in hexadecimal of either case, that goes with it."""
    return F.sha2(content, 256) == F.lower(F.trim(sha256))


def register(spark: SparkSession) -> list[str]:
    """Temporary functions of a session; returns their names.

    ``estimate_tokens``, ``collapse_ws``, ``media_type``, ``parse_bangs`` and ``detect_spa`` are
    SQL functions, so Catalyst inlines them; the others are Arrow functions.
    """
    bang, words = "'^!+[A-Za-z0-9_]+$'", "split(x, '(?U)\\\\s+')"
    made = {
        "estimate_tokens": "(x STRING) RETURNS BIGINT RETURN CAST(CASE WHEN x = '' THEN 0 ELSE CAST(char_length(x) AS DOUBLE) / 4.0D * 0.6D + CAST(regexp_count(x, '(?U)\\\\S+') AS DOUBLE) * 1.33D * 0.4D END AS BIGINT)",
        "collapse_ws": "(x STRING) RETURNS STRING RETURN trim(regexp_replace(x, '(?U)\\\\s+', ' '))",
        "media_type": "(x STRING) RETURNS STRING RETURN lower(trim(split_part(x, ';', 1)))",
        "parse_bangs": f"(x STRING) RETURNS STRUCT<clean_query: STRING, bangs: ARRAY<STRING>> RETURN named_struct('clean_query', array_join(filter({words}, t -> t <> '' AND NOT t RLIKE {bang}), ' '), 'bangs', transform(filter({words}, t -> t RLIKE {bang}), t -> lower(regexp_replace(t, '^!+', ''))))",
    }
    made["detect_spa"] = f"(html STRING, visible INT) RETURNS ARRAY<STRING> RETURN {spa.sql_body('html', 'visible')}"
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    python = {"canonical_url": urls.parsed_canonical, "ip_blocked": urls.ip_blocked_arrow, "percent_decode": urls.percent_decode, "decode_entities": text.decode_entities, "nfc": nfc, "harden": harden, "clean_html": clean_html}
    for name, f in python.items():
        spark.udf.register(name, f)
    return [*made, *python]


def selfcheck(spark: SparkSession) -> DataFrame:
    """(check, ok) for a few known answers on the session's workers."""
    from ..operators.ladder import WARNING

    cases = [
        ("address guard", "ip_blocked('169.254.169.254') AND NOT ip_blocked('8.8.8.8')"),
        ("canonical form", "canonical_url('http://www.e.test/a/?utm_id=1') = 'https://e.test/a'"),
        ("entities", "decode_entities('&lt;&#33;') = '<!'"),
        ("tokens", "estimate_tokens('') = 0"),
        ("hardening", "harden('a```') LIKE '%a_`_`_`%'"),
        ("shortcuts", "parse_bangs('!Gh x').bangs[0] = 'gh'"),
    ]
    register(spark)
    rows = spark.sql(" UNION ALL ".join(f"SELECT '{name}' AS check, {test} AS ok" for name, test in cases))
    page = htmlclean.clean_page("<h1>x</h1>", "https://e.test", htmlclean.CleanOptions())
    return rows.union(spark.createDataFrame([("page cleaning", page[4] == "# x"), ("ladder", bool(WARNING))], "check string, ok boolean"))
