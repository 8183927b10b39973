"""Web pages to Markdown: decode, strip, harvest metadata, allow-list, main content, Markdown, links.

One Arrow function does all layers for a page and returns a struct, so a page
is parsed twice at most and no tree leaves the call.
"""

from __future__ import annotations

import codecs
import re
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .htmltree import BLOCK, Node, parse

#: Elements that go with all they hold, before anything else.
STRIPPED = {"script", "style", "noscript", "iframe", "svg", "canvas", "template", "math", "object", "embed", "noembed", "xmp"}
#: Containers of boilerplate that go with all they hold.
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "datalist", "fieldset", "dialog", "figure"}
#: Elements that stay; others are unwrapped.
KEPT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "blockquote", "pre", "code", "ul", "ol", "li", "table", "thead", "tbody", "tr", "th", "td", "a", "em", "strong", "del", "hr", "dl", "dt", "dd", "br"}
#: Schemes of links that stay.
SCHEMES = {"http", "https", "mailto"}
#: Metadata names, the first that is there counts.
BYLINE, PUBLISHED, SITE = ("author", "article:author", "twitter:creator"), ("article:published_time", "date", "dcterms.date"), ("og:site_name",)


@dataclass(frozen=True)
class CleanOptions:
    """Limits and choices of the cleaning."""

    max_bytes: int = 5 * 1024 * 1024
    max_nodes: int = 10_000
    images: bool = False
    links: str = "inline"


def decode(body: bytes | str, charset: str | None = None) -> str:
    """Text of a body by its byte order mark, the given label, a label in it, UTF-8, else the likeliest encoding; a label under which bytes are invalid is passed over."""
    if isinstance(body, str):
        return body
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    head = body[:2048].decode("latin-1")
    found = re.search(r"""<meta[^>]+charset\s*=\s*["']?([\w-]+)""", head, re.I) or re.search(r"""<\?xml[^>]+encoding\s*=\s*["']([\w-]+)""", head, re.I)
    for label in (charset, found and found[1], "utf-8"):
        try:
            if label:
                return body.decode(label)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode(likely_encoding(body), "replace")


#: Encodings that are tried where nothing names one, with the characters that speak for each.
LIKELY = {
    "shift_jis": "ぁ-ヿ", "euc_jp": "ぁ-ヿ", "euc_kr": "가-힣", "gb18030": "一-龥", "big5": "一-龥", "windows-1251": "а-яА-Я", "koi8_r": "а-яА-Я", "windows-1253": "ά-ώΑ-Ω", "windows-1255": "א-ת", "windows-1256": "ا-ي", "windows-1250": "áčďéěíňóřšťúůýžąćęłńśźżőű",
}
#: Frequent Chinese characters, which tell the two encodings of Chinese apart.
FREQUENT = set("的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后這個們來說時會對於後國為過發裡經麼現當動還進樣開")


def likely_encoding(body: bytes) -> str:
    """The encoding under which a body's characters beyond ASCII look most like a script; Windows-1252 where none does. The whole body counts."""
    best, found = 0.0, "windows-1252"
    if body.isascii():
        return found
    for name, letters in LIKELY.items():
        try:
            text = body.decode(name)
        except UnicodeDecodeError:
            continue
        odd = [c for c in text if ord(c) > 127]
        if not odd:
            continue
        own = re.findall(f"[{letters}]", "".join(odd))
        share = len(own) / len(odd)
        if letters.startswith("一"):
            share *= min(1.0, 4 * sum(c in FREQUENT for c in own) / len(odd))
        elif letters.startswith("ぁ"):
            share = min(1.0, 2 * share) * sum("ぁ" <= c <= "ヿ" or "一" <= c <= "龥" or c in "、。「」ー" for c in odd) / len(odd)
        elif name in ("windows-1251", "koi8_r", "windows-1253"):  # lower case prevails in prose
            share *= 0.5 + 0.5 * sum(c.islower() for c in own) / max(len(own), 1)
            share *= len(odd) / (len(odd) + len(re.findall("[a-zA-Z]", text)) / 4)  # whole words, not letters among Latin ones
        elif name == "windows-1250":
            share *= 0.9
        if share > best + 1e-9 and share > 0.5:
            best, found = share, name
    latin = body.decode("windows-1252", "replace")
    odd = [c for c in latin if ord(c) > 127]
    western = sum(c in "àâäáãåæçéèêëíìîïñóòôöõøœúùûüÿßÀÂÄÁÃÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØŒÚÙÛÜ’‘“”«»–—…€°§" for c in odd) / len(odd)
    return "windows-1252" if western >= best else found


def metadata(root: Node) -> dict[str, str | None]:
    """Title, byline, date and site from the head; social titles win over the title element."""
    title, metas = None, {}
    for n in root.walk():
        if n.tag == "title" and title is None:
            title = " ".join(n.text().split()) or None
        elif n.tag == "meta" and n.attrs.get("content", "").strip():
            metas.setdefault((n.attrs.get("property") or n.attrs.get("name") or "").lower(), n.attrs["content"].strip())
    first = lambda names: next((metas[k] for k in names if k in metas), None)
    return {"title": first(("twitter:title", "og:title")) or title, "byline": first(BYLINE), "published_time": first(PUBLISHED), "site_name": first(SITE)}


def allowed(root: Node, base: str, options: CleanOptions) -> Node:
    """A copy of the tree with kept elements only, links absolute and of allowed schemes."""
    keep = KEPT | {"img"} if options.images else KEPT
    out = Node("#root")
    stack: list[tuple[Node, Node]] = [(root, out)]
    while stack:
        src, dst = stack.pop()
        for c in src.children:
            if isinstance(c, str):
                dst.children.append(c)
            elif c.tag in BOILERPLATE or c.tag in ("head", "title"):
                continue
            elif c.tag in keep:
                attrs = {}
                for k in {"a": ("href", "title"), "img": ("src", "alt", "title")}.get(c.tag, ()):
                    v = c.attrs.get(k)
                    if v is not None and k in ("href", "src"):
                        v = absolute(v, base)
                    if v is not None:
                        attrs[k] = v
                n = Node(c.tag, attrs, parent=dst)
                dst.children.append(n)
                stack.append((c, n))
            else:
                n = Node("#unwrapped" if c.tag not in BLOCK else "#block", parent=dst)
                dst.children.append(n)
                stack.append((c, n))
    return out


def absolute(link: str, base: str) -> str | None:
    """A link joined to the page's address; null if its scheme isn't allowed."""
    try:
        full = urllib.parse.urljoin(base, re.sub(r"[\x00-\x20]+", "", link) if ":" in link.split("/")[0] else link.strip())
        return full if urllib.parse.urlsplit(full).scheme in SCHEMES else None
    except ValueError:
        return None


def main_content(root: Node) -> Node:
    """The element with the densest prose, after the published readability heuristics; all of it where none stands out.

    A paragraph scores by its commas and length for its parent, half for the
    grandparent; a candidate's score falls with the part of its text in links.
    """
    score: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for n in root.walk():
        if n.tag not in ("p", "pre", "td", "blockquote"):
            continue
        t = n.text().strip()
        if len(t) < 25:
            continue
        points = 1 + t.count(",") + min(len(t) // 100, 3)
        for up, part in ((n.parent, 1.0), (n.parent.parent if n.parent else None, 0.5)):
            if up is not None:
                score[id(up)] = score.get(id(up), 0) + points * part
                nodes[id(up)] = up
    best, top = root, 0.0
    for k, s in score.items():
        n = nodes[k]
        size = len(n.text()) or 1
        linked = sum(len(a.text()) for a in n.walk() if a.tag == "a")
        s *= 1 - min(linked / size, 1)
        if s > top:
            best, top = n, s
    whole = len(root.text().strip())
    return best if top >= 3 and len(best.text().strip()) >= 0.5 * whole else root


def to_markdown(root: Node) -> str:
    """Markdown of a cleaned tree: headings, lists, links, code, quotes, tables."""
    text = re.sub(r"[ \t]+\n", "\n", "".join(_block(root, 0)))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _inline(x: Node | str, depth: int = 0) -> str:
    if isinstance(x, str):
        return re.sub(r"[ \t\n\r\f]+", " ", x)
    if depth > 200:
        return " ".join(x.text().split())
    inner = "".join(_inline(c, depth + 1) for c in x.children)
    bare = inner.strip()
    if x.tag == "br":
        return "  \n"
    if x.tag == "img":
        return f"![{x.attrs.get('alt', '')}]({x.attrs['src']})" if "src" in x.attrs else ""
    if not bare:
        return " " if inner else ""
    lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    if x.tag in ("em", "strong", "del"):
        mark = {"em": "*", "strong": "**", "del": "~~"}[x.tag]
        return f"{lead}{mark}{bare}{mark}{tail}"
    if x.tag == "code":
        return f"{lead}`{bare}`{tail}"
    if x.tag == "a" and "href" in x.attrs:
        return f"{lead}[{bare}]({x.attrs['href']}){tail}"
    return inner


def _is_block(x: Node | str) -> bool:
    return isinstance(x, Node) and (x.tag in BLOCK or x.tag in ("#block", "li", "tr", "thead", "tbody", "td", "th", "dt", "dd") or (x.tag == "#unwrapped" and any(_is_block(c) for c in x.children)))


def _block(x: Node, depth: int) -> list[str]:
    if depth > 100:
        return [" ".join(x.text().split())]
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        t = re.sub(r" +", " ", "".join(line)).strip()
        if t:
            out.append(f"\n\n{t}\n\n")
        line.clear()

    for c in x.children:
        if not _is_block(c):
            line.append(_inline(c))
            continue
        flush()
        if c.tag[0] == "h" and c.tag[1:].isdigit():
            t = " ".join(_inline(c).split())
            out.append(f"\n\n{'#' * int(c.tag[1])} {t}\n\n" if t else "")
        elif c.tag == "hr":
            out.append("\n\n---\n\n")
        elif c.tag == "pre":
            out.append(f"\n\n```\n{c.text().strip(chr(10))}\n```\n\n")
        elif c.tag in ("ul", "ol"):
            items = [i for i in c.children if isinstance(i, Node)]
            rows = []
            for k, i in enumerate(items):
                mark = f"{k + 1}. " if c.tag == "ol" else "- "
                body = re.sub(r"\n{2,}", "\n", "".join(_block(i, depth + 1))).strip()
                rows.append(mark + body.replace("\n", "\n" + " " * len(mark)))
            out.append("\n\n" + "\n".join(rows) + "\n\n")
        elif c.tag == "blockquote":
            body = re.sub(r"\n{3,}", "\n\n", "".join(_block(c, depth + 1))).strip()
            out.append("\n\n" + "\n".join(f"> {v}".rstrip() for v in body.split("\n")) + "\n\n")
        elif c.tag == "table":
            rows = [[" ".join(_inline(d).split()).replace("|", "\\|") for d in r.children if isinstance(d, Node) and d.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                width = max(map(len, rows))
                rows = [r + [""] * (width - len(r)) for r in rows]
                rows.insert(1, ["---"] * width)
                out.append("\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n\n")
        else:
            out += _block(c, depth + 1)
    flush()
    return out


def rewrite_links(md: str, mode: str) -> str:
    """Links as they are, stripped to their text, or as numbered footnotes in order of first use; brackets may nest."""
    if mode == "inline":
        return md
    out, urls, i = [], [], 0
    while i < len(md):
        if md[i] == "\\" and i + 1 < len(md):
            out.append(md[i : i + 2])
            i += 2
            continue
        if md[i] == "[" and (found := _link_at(md, i)):
            text, url, i = found
            text = rewrite_links(text, "strip")
            if mode == "footnotes":
                if url not in urls:
                    urls.append(url)
                text += f"[{urls.index(url) + 1}]"
            out.append(text)
            continue
        out.append(md[i])
        i += 1
    notes = "".join(f"\n[{k}]: {u}" for k, u in enumerate(urls, 1))
    return "".join(out) + (f"\n{notes}" if notes else "")


def _link_at(md: str, i: int) -> tuple[str, str, int] | None:
    """Text, target and end of a link that starts at ``i``; null if there is none."""
    depth, j = 0, i
    while j < len(md):
        if md[j] == "\\":
            j += 1
        elif md[j] == "[":
            depth += 1
        elif md[j] == "]":
            depth -= 1
            if not depth:
                break
        j += 1
    if j + 1 >= len(md) or md[j + 1] != "(":
        return None
    depth, k = 0, j + 1
    while k < len(md):
        if md[k] == "\\":
            k += 1
        elif md[k] == "(":
            depth += 1
        elif md[k] == ")":
            depth -= 1
            if not depth:
                return md[i + 1 : j], md[j + 2 : k], k + 1
        elif md[k] == "\n":
            return None
        k += 1
    return None


SCHEMA = "title string, byline string, published_time string, site_name string, markdown string, n_nodes long, error_kind string"


def clean_page(body: bytes | str | None, url: str | None, options: CleanOptions, charset: str | None = None) -> tuple:
    """The fields of ``SCHEMA`` for one page; errors are a value, never an exception."""
    none = (None,) * 5
    if body is None:
        return (*none, 0, "empty")
    if len(body.encode() if isinstance(body, str) else body) > options.max_bytes:
        return (*none, 0, "too_large")
    html = decode(body, charset)
    try:
        tree = parse(html, STRIPPED, options.max_nodes)
    except OverflowError:
        return (*none, options.max_nodes + 1, "too_many_nodes")
    meta = metadata(tree)
    md = to_markdown(main_content(allowed(tree, url or "", options)))
    return (meta["title"], meta["byline"], meta["published_time"], meta["site_name"], rewrite_links(md, options.links), len(tree.walk()), None)


def cleaned(pages: DataFrame, keep: list[str], url_col: str = "url", body_col: str = "html", options: CleanOptions = CleanOptions(), parts: int | None = None) -> DataFrame:
    """``keep`` columns and the fields of ``SCHEMA`` for each page, in one Arrow pass.

    Few large files would leave most cores idle, so pages are dealt out first
    where ``parts`` is given.
    """
    src = pages.select(*keep, F.col(url_col).alias("__url"), F.col(body_col).alias("__body"))
    if parts:
        src = src.repartition(parts)
    schema = src.select(*keep).schema
    for f in SCHEMA.split(", "):
        schema = schema.add(*f.split())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for b in batches:
            rows = [clean_page(x, u, options) for x, u in zip(b["__body"], b["__url"], strict=True)]
            yield pd.concat([b[keep].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return src.mapInPandas(run, schema)


def strip_active(html: Column) -> Column:
    """Active elements and comments out of well-formed HTML, as an expression; the tree does it for any HTML."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(out, r"(?is)<(script|style|noscript|iframe|svg|canvas|template|math|object|embed|noembed|xmp)\b[^>]*>.*?</\1\s*>", "")


def title_of(html: Column) -> Column:
    """Text of the title element, white space collapsed; null without."""
    t = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1), r"(?U)\s+", " "))
    return F.when(t != "", t)
