"""Detection of pages that a browser must render."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of the element that an application mounts on, in the order in which they are looked for.
ROOTS = ['id="root"', 'id="app"', 'id="__next"', 'id="app-root"', "<app-root"]
#: Phrases for browsers without scripts.
NOSCRIPT = ["you need to enable javascript to run this app", "javascript is disabled in your browser", "please turn on javascript and refresh the page", "enable javascript and refresh the page to view", "this application requires javascript"]
#: Names of the reasons; that of other roots is under None.
BARE, PHRASE, DENSE = "large-html-with-almost-no-visible-text", "noscript-fallback-warning", "high-script-density-no-content-tags"
NAMES = {'id="__next"': "empty-next-root", 'id="app-root"': "empty-angular-root", "<app-root": "empty-angular-root", None: "empty-framework-root"}
LARGE_BYTES, LITTLE_TEXT, MANY_SCRIPTS = 20 * 1024, 250, 5


def _empty(lower: Column, root: str) -> Column:
    """Whether nothing but the end of the element, or a comment, follows the first occurrence of a root."""
    tail = F.when(F.instr(lower, root) > 0, F.substr(lower, F.instr(lower, root)))
    return F.coalesce(tail.rlike(r"(?U)^[^>]*>\s*(</div|</app-root|</main|<!--)"), F.lit(False))


def reasons(html: Column, visible: Column) -> Column:
    """Why a page looks client-rendered: an array of reasons, empty for none.  ``visible`` counts its text."""
    low = F.lower(html)
    root = F.lit(None).cast("string")
    for r in reversed(ROOTS):
        found = F.lit(NAMES.get(r, NAMES[None]))
        if r == 'id="__next"':  # with page data in it the server has rendered; the scan ends all the same
            found = F.when(~low.contains("__next_data__"), found)
        root = F.when(_empty(low, r), found).otherwise(root)
    any_phrase = F.lit(False)
    for p in NOSCRIPT:
        any_phrase = any_phrase | low.contains(p)
    dense = (F.regexp_count(low, F.lit("<script")) > MANY_SCRIPTS) & (F.regexp_count(low, F.lit("<p|<article|<h1|<h2|<h3")) == 0)
    return F.array_compact(
        F.array(
            F.when((F.octet_length(html) > LARGE_BYTES) & (visible < LITTLE_TEXT), F.lit(BARE)),
            root,
            F.when(any_phrase, F.lit(PHRASE)),
            F.when(dense, F.lit(DENSE)),
        )
    )


def sql_body(html: str, visible: str) -> str:
    """``reasons`` as SQL over two names, so that Catalyst can inline it as a function."""
    low = f"lower({html})"
    ends = "(</div|</app-root|</main|<!--)"
    empty = lambda r: rf"instr({low}, '{r}') > 0 AND substr({low}, instr({low}, '{r}')) RLIKE r'(?U)^[^>]*>\s*{ends}'"
    named = {r: f"'{NAMES.get(r, NAMES[None])}'" for r in ROOTS}
    named['id="__next"'] = f"CASE WHEN NOT contains({low}, '__next_data__') THEN {named['id=\"__next\"']} END"
    root = "CASE " + " ".join(f"WHEN {empty(r)} THEN {named[r]}" for r in ROOTS) + " END"
    phrase = " OR ".join(f"contains({low}, '{p}')" for p in NOSCRIPT)
    dense = f"regexp_count({low}, '<script') > {MANY_SCRIPTS} AND regexp_count({low}, '<p|<article|<h1|<h2|<h3') = 0"
    return f"CASE WHEN {html} IS NOT NULL THEN array_compact(array(CASE WHEN octet_length({html}) > {LARGE_BYTES} AND {visible} < {LITTLE_TEXT} THEN '{BARE}' END, {root}, CASE WHEN {phrase} THEN '{PHRASE}' END, CASE WHEN {dense} THEN '{DENSE}' END)) END"
