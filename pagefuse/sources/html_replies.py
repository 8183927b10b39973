"""Rows from HTML replies by CSS specs, in one Arrow pass over the replies."""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.htmltree import Node, growing, parse, select, selected


@dataclass(frozen=True)
class CssSpec:
    """Selectors of an item and, within it, of each field; ``sel@attr`` reads an attribute, ``@attr`` the item's own."""

    item: str
    title: str
    url: str
    snippet: str | None = None
    date: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    base: str = ""
    cap: int | None = None
    http_only: bool = False
    skip: str | None = None  # items with this in a class are advertisements


#: Public result pages, by engine name.
SPECS = {
    "pypi": CssSpec("a.package-snippet", "span.package-snippet__name", "@href", "p.package-snippet__description", metadata={"version": "span.package-snippet__version"}, base="https://pypi.org"),
    "pub.dev": CssSpec(".packages-item", ".packages-title", "a@href", ".packages-description", base="https://pub.dev"),
    "rubygems": CssSpec("a.gems__gem", "h2", "@href", "p.gems__gem__desc__t", base="https://rubygems.org"),
    "lobste.rs": CssSpec("li.story", "span.link a", "span.link a@href", metadata={"comments": "span.comments_label"}, base="https://lobste.rs"),
    "searchmysite": CssSpec("div.search-result", "h3 a", "h3 a@href", ".result-summary"),
    "duckduckgo": CssSpec(".result__body, .web-result, .result", "a.result__a", "a.result__a@href", "a.result__snippet", ".result__date", base="https://duckduckgo.com", cap=20, skip="result--ad"),
    "brave": CssSpec('.snippet[data-type="web"], .result, #results .snippet', ".title, .snippet-title, a .url, h2", "a@href", ".desc, .snippet-description, .snippet-content", cap=15, http_only=True),
    "startpage": CssSpec(".w-gl__result, .result", "h2, .w-gl__result-title", "a.w-gl__result-url, a.result-link, a@href", ".w-gl__description, .description, p", cap=15, http_only=True),
    "mojeek": CssSpec("ul.results-standard > li, li.result", "a.title, h2 a", "a.title, h2 a@href", "p.s, p", cap=15, http_only=True),
}


def field_text(item: Node, selector: str | None) -> str | None:
    """Text of the first match, white space collapsed, or one of its attributes; null if missing or blank."""
    if not selector:
        return None
    sel, _, attr = selector.rpartition("@") if "@" in selector else (selector, "", "")
    node = item if "@" in selector and not sel else next(selected(item, sel), None)
    if node is None:
        return None
    x = node.attrs.get(attr, "") if attr else node.text()
    return " ".join(x.split()) or None


def unwrapped(href: str) -> str:
    """The target of a redirect link that carries it in ``uddg``."""
    q = urllib.parse.parse_qs(urllib.parse.urlsplit(href).query)
    target = q.get("uddg", [""])[0]
    return target if target.startswith("http") else href


def rows_of(html: str | None, spec: CssSpec) -> list[tuple]:
    """(rank, title, url, snippet, published_date, metadata) of each item with a URL.

    Under a cap a page is parsed until that many items are closed, which later text can't change.
    """
    drop, done = {"script", "style"}, 0
    out: list[tuple] = []
    trees = [(parse(html or "", drop), set())] if spec.cap is None else growing(html or "", drop)
    for root, opened in trees:
        for item in select(root, spec.item)[done:]:
            if id(item) in opened:
                break
            done += 1
            row = _row(item, spec)
            if row is not None:
                out.append((len(out) + 1, *row))
            if spec.cap and len(out) >= spec.cap:
                return out
    return out


def _row(item: Node, spec: CssSpec) -> tuple | None:
    if spec.skip and spec.skip in item.classes():
        return None
    href = field_text(item, spec.url)
    if not href:
        return None
    url = unwrapped(urllib.parse.urljoin(spec.base, href) if spec.base else href)
    if spec.http_only and not url.startswith("http"):
        return None
    meta = {k: v for k, s in spec.metadata.items() if (v := field_text(item, s))}
    return field_text(item, spec.title) or "", url, field_text(item, spec.snippet) or "", field_text(item, spec.date), meta


def extract(replies: DataFrame, spec: CssSpec) -> DataFrame:
    """Hits of replies (query_id, engine, payload)."""
    d = replies.select("query_id", "engine", "payload")
    id_type = d.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, e, *r) for q, e, p in zip(b["query_id"], b["engine"], b["payload"], strict=True) for r in rows_of(p, spec)]
            yield pd.DataFrame(rows, columns=["query_id", "engine", "rank", "title", "url", "snippet", "published_date", "metadata"])

    return d.mapInPandas(run, f"query_id {id_type}, engine string, rank int, title string, url string, snippet string, published_date string, metadata map<string,string>")
