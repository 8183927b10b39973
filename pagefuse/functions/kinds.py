"""What a response is: content types, sniffing, fences, and the light passes for structured text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hardening import BEGIN, END, Hardening, delimited, harden
from .text import decode_entities, normalize_ws, trim_end
from .urls import once

#: Media types of source code that are read as text.
CODE_TYPES = ["text/javascript", "application/javascript", "application/x-javascript", "application/ecmascript", "application/typescript", "text/typescript", "text/css", "application/x-sh", "application/x-shellscript", "text/x-shellscript", "text/x-python", "application/x-python", "text/x-diff", "text/x-patch"]


def media_type(header: Column) -> Column:
    """A content type in lower case, without parameters."""
    return F.lower(F.trim(F.split_part(header, F.lit(";"), F.lit(1))))


def kind_of_type(ct: Column) -> Column:
    """Html, Json, Xml or Text; null where the type isn't supported."""
    return (
        F.when(ct.isin("text/html", "application/xhtml+xml"), F.lit("Html"))
        .when(ct.isin("application/json", "text/json", "application/ndjson", "application/x-ndjson") | ct.endswith("+json"), F.lit("Json"))
        .when(ct.isin("application/xml", "text/xml") | ct.endswith("+xml"), F.lit("Xml"))
        .when(ct.isin("text/plain", "text/csv", "application/csv", "text/tab-separated-values", *CODE_TYPES) | ct.rlike("(markdown|yaml|yml)$"), F.lit("Text"))
    )


def sniff(body: Column) -> Column:
    """The kind of a body whose type isn't given, by its first characters after any white space."""
    x = F.regexp_extract(body, r"(?s)^[ \t\n\f\r]*+(.{0,16})", 1)
    return F.when(x.rlike(r"^[{\[]"), F.lit("Json")).when(x.rlike(r"^(?i)(<!doctype html|<html)"), F.lit("Html")).when(x.startswith("<"), F.lit("Xml")).otherwise(F.lit("Text"))


def fence_language(kind: Column, ct: Column) -> Column:
    """Language of the code fence around a payload; null for prose."""
    t = F.coalesce(ct, F.lit("text/plain"))
    text = (
        F.when(t.contains("csv"), F.lit("csv"))
        .when(t.rlike("yaml|yml"), F.lit("yaml"))
        .when(t.contains("tab-separated"), F.lit("tsv"))
        .when(t.rlike("javascript|ecmascript"), F.lit("javascript"))
        .when(t.contains("typescript"), F.lit("typescript"))
        .when(t == "text/css", F.lit("css"))
        .when(t.contains("shell") | (t == "application/x-sh"), F.lit("bash"))
        .when(t.contains("python"), F.lit("python"))
        .when(t.rlike("diff|patch"), F.lit("diff"))
    )
    return F.when(kind == "Json", F.lit("json")).when(kind == "Xml", F.lit("xml")).when(kind == "Text", text)


def payload(content: Column, language: Column, options: Hardening = Hardening(), normal: bool = True) -> Column:
    """A hardened payload: in a fence with its language, or as prose where that is null; blank stays empty."""
    bare = harden(content, Hardening(options.escape_fences, False, options.budget), normal)

    def wrapped(b: Column) -> Column:
        fenced = F.concat(F.lit("```"), language, F.lit("\n"), trim_end(b), F.lit("\n```"))
        if options.delimit:
            fenced = F.concat(F.lit(BEGIN + "\n"), F.regexp_replace(fenced, r"(BEGIN|END)_UNTRUSTED_CONTENT", "$1-UNTRUSTED-CONTENT"), F.lit("\n" + END))
        return F.when(language.isNull(), delimited(b) if options.delimit else b).when(b.rlike(r"(?U)^\s*$"), F.lit("")).otherwise(fenced)

    return once(bare, wrapped)


def xml_title(text: Column) -> Column:
    """Text of the first title element, one line of 200 code points at most; null without."""
    raw = F.regexp_extract(text, r"(?s)<title[^>]*>(.*?)</title", 1)
    raw = F.coalesce(decode_entities(F.when(raw.contains("&"), raw)), raw)
    t = F.substring(normalize_ws(raw), 1, 200)
    return F.when(t != "", t)


def payload_title(kind: Column, text: Column) -> Column:
    """Title of a structured document."""
    return F.when(kind == "Json", F.lit("JSON response")).when(kind == "Xml", F.coalesce(xml_title(F.when(kind == "Xml", text)), F.lit("XML document"))).otherwise(F.lit(""))
