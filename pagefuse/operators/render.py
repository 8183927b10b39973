"""Renderers: search responses and pages as Markdown and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bangs import parse_bangs
from ..functions.text import escape_md, snippet


def search_markdown(query: Column, results: Column, engines: Column, failed: Column, elapsed_ms: Column) -> Column:
    """A response as Markdown; ``results``: structs of title, url, snippet, score, sources, published_date."""
    clean = parse_bangs(query)["clean_query"]
    shown = F.when(clean == "", query).otherwise(clean)
    head = F.concat(F.lit('# Search Results: "'), shown, F.lit('"\n*Queried '), F.size(engines).cast("string"), F.lit(" engines ("), F.array_join(engines, ", "), F.lit(") in "), elapsed_ms.cast("string"), F.lit("ms*\n"))

    def row(r: Column, i: Column) -> Column:
        date = F.when(F.coalesce(r["published_date"], F.lit("")) != "", F.concat(F.lit("   - **Published:** "), r["published_date"], F.lit("\n"))).otherwise(F.lit(""))
        text = F.when(F.coalesce(r["snippet"], F.lit("")) != "", F.concat(F.lit("   - "), snippet(r["snippet"]), F.lit("\n"))).otherwise(F.lit(""))
        score = F.format_string("%.2f", r["score"])
        return F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". ["), escape_md(r["title"]), F.lit("]("), r["url"], F.lit(")\n   - **Engine:** `"), F.get(r["sources"], F.lit(0)), F.lit("` | **Score:** "), score, F.lit("\n"), date, text)

    body = F.when(F.size(results) == 0, F.lit("\n_No results found._\n")).otherwise(F.array_join(F.transform(results, row), ""))
    lost = F.transform(failed, lambda f: F.concat(F.lit("- `"), f["engine"], F.lit("`: "), f["error"], F.when(f["is_rate_limited"], F.lit(" (rate limited)")).otherwise(F.lit("")), F.lit("\n")))
    foot = F.when(F.size(failed) > 0, F.concat(F.lit("\n---\n*Engine failures:*\n"), F.array_join(lost, ""))).otherwise(F.lit(""))
    return F.concat(head, body, foot)


def search_json(query: Column, category: Column, bang: Column, results: Column, engines: Column, failed: Column, elapsed_ms: Column) -> Column:
    """A response as a JSON object with every key, null or not."""
    env = F.struct(
        F.lit("search.v1").alias("schema"), query.alias("query"), category.alias("category"), bang.alias("bang"), F.size(results).alias("total_results"),
        elapsed_ms.alias("elapsed_ms"), engines.alias("engines_queried"), failed.alias("engines_failed"), results.alias("results"),
    )
    return F.to_json(env, {"ignoreNullFields": "false"})


def page_markdown(title: Column, url: Column, byline: Column, published: Column, site: Column, method: Column, tokens: Column, warning: Column, markdown: Column) -> Column:
    """A page as Markdown; lines of missing fields are left out."""
    line = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(f"- **{name}:** "), x))
    facts = F.concat(F.lit("- **Method:** `"), method, F.lit("` | **Tokens:** ~"), tokens.cast("string"))
    block = F.when(warning.isNotNull(), F.concat(F.lit("\n> [!WARNING]\n> **Dynamic Render Unavailable**\n> "), warning))
    return F.concat(F.concat_ws("\n", F.concat(F.lit("# "), escape_md(title)), line("URL", url), line("By", byline), line("Published", published), line("Site", site), facts, block), F.lit("\n\n"), markdown, F.lit("\n"))


def page_json(page: Column) -> Column:
    """A page struct as JSON with its schema tag."""
    return F.to_json(F.struct(F.lit("page.v1").alias("schema"), page.alias("page")), {"ignoreNullFields": "false"})


def exit_code(results: Column, failed: Column) -> Column:
    """1 where nothing was found and something failed, else 0."""
    return F.when((F.size(results) == 0) & (F.size(failed) > 0), F.lit(1)).otherwise(F.lit(0))
