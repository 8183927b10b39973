"""Engines whose JSON replies need more than a path for each field.

Each function takes replies (query_id, engine, payload) and returns hits
(query_id, engine, rank, title, url, snippet, published_date, thumbnail_url,
metadata), all in native expressions but for entity decoding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import decode_entities, strip_tags, unix_to_date
from .json_replies import items_of, ranked


def _get(path: str, of: str = "item") -> Column:
    return F.get_json_object(F.col(of), path)


def _meta(**fields: Column) -> Column:
    """A map of the fields that are there."""
    return F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def _none() -> Column:
    return F.lit(None).cast("string")


def _items(replies: DataFrame, results: str | None) -> DataFrame:
    return replies.select("query_id", "engine", F.posexplode(items_of(F.col("payload"), results)).alias("pos", "item"))


def _hits(df: DataFrame, title: Column, url: Column, snippet: Column | None = None, date: Column | None = None, thumbnail: Column | None = None, metadata: Column | None = None, cap: int | None = None) -> DataFrame:
    """Hits with a title and a URL, ranked in order."""
    h = df.select(
        "query_id", "engine", "pos", title.alias("title"), url.alias("url"), F.coalesce(snippet if snippet is not None else _none(), F.lit("")).alias("snippet"),
        (date if date is not None else _none()).alias("published_date"), (thumbnail if thumbnail is not None else _none()).alias("thumbnail_url"),
        (metadata if metadata is not None else F.create_map()).cast("map<string,string>").alias("metadata"),
    )
    return ranked(h.where("title IS NOT NULL AND url IS NOT NULL AND url <> ''"), cap)


def plain(x: Column) -> Column:
    """Snippet HTML as text: tags out, entities decoded."""
    return decode_entities(strip_tags(F.coalesce(x, F.lit(""))))


def mediawiki(replies: DataFrame, domain: str) -> DataFrame:
    """Search lists of a wiki; article addresses are made from titles."""
    d = _items(replies, "query.search")
    title = F.nullif(_get("$.title"), F.lit(""))
    return _hits(d, title, F.concat(F.lit(f"https://{domain}/wiki/"), F.replace(title, F.lit(" "), F.lit("_"))), plain(_get("$.snippet")), _get("$.timestamp"))


def stackexchange(replies: DataFrame) -> DataFrame:
    """Questions with score, answers and whether one is accepted."""
    d = _items(replies, "items")
    m = _meta(score=F.coalesce(_get("$.score"), F.lit("0")), answers=F.coalesce(_get("$.answer_count"), F.lit("0")), answered=F.when(_get("$.is_answered") == "true", F.lit("true")))
    return _hits(d, decode_entities(_get("$.title")), _get("$.link"), date=unix_to_date(_get("$.creation_date").try_cast("long")), metadata=m)


def forum(posts: DataFrame, topics: DataFrame, base: str, cap: int = 15) -> DataFrame:
    """First post of each topic, joined with it; posts (query_id, engine, pos, topic_id, blurb), topics (query_id, topic_id, title, slug).

    A topic's id counts as seen with its first post, whether the topic is known or not.
    """
    first = posts.groupBy("query_id", "engine", "topic_id").agg(F.min_by("blurb", "pos").alias("blurb"), F.min("pos").alias("pos"))
    d = first.join(topics, ["query_id", "topic_id"])
    return _hits(d, F.col("title"), F.concat(F.lit(f"{base}/t/"), F.coalesce("slug", F.lit("topic")), F.lit("/"), F.col("topic_id").cast("string")), F.col("blurb"), cap=cap)


def discourse(replies: DataFrame, base: str) -> DataFrame:
    """Forum replies: posts and topics in one payload."""
    p = _items(replies, "posts").select("query_id", "engine", "pos", F.coalesce(_get("$.topic_id").try_cast("long"), F.lit(0)).alias("topic_id"), plain(_get("$.blurb")).alias("blurb"))
    t = _items(replies, "topics").select("query_id", F.coalesce(_get("$.id").try_cast("long"), F.lit(0)).alias("topic_id"), decode_entities(F.coalesce(_get("$.title"), F.lit(""))).alias("title"), _get("$.slug").alias("slug"))
    return forum(p, t.dropDuplicates(["query_id", "topic_id"]), base)


def lemmy(replies: DataFrame, kind: str, base: str) -> DataFrame:
    """Posts, comments, communities or users of a federated link board."""
    text = lambda p: strip_tags(F.coalesce(_get(p), F.lit("")))
    at = lambda path, p: F.concat(F.lit(f"{base}/{path}/"), F.coalesce(_get(p), F.lit("0")))
    if kind == "posts":
        d = _items(replies, "posts").where(_get("$.community.name").isNotNull())
        return _hits(d, _get("$.post.name"), F.coalesce(_get("$.post.url"), at("post", "$.post.id")), text("$.post.body"), metadata=_meta(community=_get("$.community.name")))
    if kind == "comments":
        d = _items(replies, "comments").where(_get("$.comment.content").isNotNull())
        return _hits(d, F.concat(F.lit("Comment #"), F.coalesce(_get("$.comment.id"), F.lit("0"))), at("comment", "$.comment.id"), text("$.comment.content"))
    one, path, shown, mark = ("community", "c", "$.community.title", "") if kind == "communities" else ("person", "u", "$.person.display_name", "@")
    name = _get(f"$.{one}.name")
    about = "$.community.description" if kind == "communities" else "$.person.bio"
    return _hits(_items(replies, kind), F.concat(F.coalesce(_get(shown), name), F.lit(f" ({mark}"), name, F.lit(")")), F.concat(F.lit(f"{base}/{path}/"), name), text(about))


def mastodon(replies: DataFrame, hashtags: bool, base: str) -> DataFrame:
    """Hashtags with their recent uses, or accounts."""
    if hashtags:
        name = _get("$.name")
        return _hits(_items(replies, "hashtags"), F.concat(F.lit("#"), name), F.coalesce(_get("$.url"), F.concat(F.lit(f"{base}/tags/"), name)), metadata=_meta(recent_uses=_get("$.history[0].uses")))
    user = _get("$.username")
    return _hits(_items(replies, "accounts"), F.concat(F.coalesce(_get("$.display_name"), user), F.lit(" (@"), user, F.lit(")")), _get("$.url"), strip_tags(F.coalesce(_get("$.note"), F.lit(""))))


def model_hub(replies: DataFrame) -> DataFrame:
    """Models, data sets or spaces, with likes and downloads."""
    m = _meta(likes=F.coalesce(_get("$.likes"), F.lit("0")), downloads=_get("$.downloads"), pipeline_tag=_get("$.pipeline_tag"))
    return _hits(_items(replies, None), _get("$.id"), F.concat(F.lit("https://huggingface.co/"), _get("$.id")), metadata=m)


def commons(replies: DataFrame) -> DataFrame:
    """Media files from an object of pages, in order of the page key so that ranks are the same in every run."""
    pages = F.from_json(F.get_json_object("payload", "$.query.pages"), "map<string,string>")
    d = replies.select("query_id", "engine", F.posexplode(F.transform(F.array_sort(F.map_entries(pages)), lambda e: e["value"])).alias("pos", "item"))
    return _hits(d, F.regexp_replace(_get("$.title"), "^(File:)+", ""), _get("$.imageinfo[0].descriptionurl"), thumbnail=_get("$.imageinfo[0].thumburl"))


def instant_answers(replies: DataFrame, cap: int = 12, nested: int = 5) -> DataFrame:
    """The abstract, then related topics; a group of topics gives ``nested`` of them.

    The cap is checked after each topic, so the last group may go beyond it.
    """
    source = F.coalesce(_get("$.AbstractSource", "payload"), F.lit(""))
    text = _get("$.AbstractText", "payload")
    top = F.struct(_get("$.Heading", "payload").alias("title"), F.nullif(_get("$.AbstractURL", "payload"), F.lit("")).alias("url"), F.concat(text, F.lit(" (via "), source, F.lit(")")).alias("snippet"), F.lit(None).cast("string").alias("kind"))
    has_top = top["title"].isNotNull() & top["url"].isNotNull() & top["snippet"].isNotNull()

    def hit(t: Column) -> Column:
        url, words = F.get_json_object(t, "$.FirstURL"), F.get_json_object(t, "$.Text")
        return F.when(url.isNotNull() & words.isNotNull(), F.struct(F.split_part(words, F.lit(" - "), F.lit(1)).alias("title"), url.alias("url"), words.alias("snippet"), F.lit("related_topic").alias("kind")))

    def hits(t: Column) -> Column:
        group = F.coalesce(F.from_json(F.get_json_object(t, "$.Topics"), "array<string>"), F.array().cast("array<string>"))
        return F.when(hit(t).isNotNull(), F.array(hit(t))).otherwise(F.array_compact(F.transform(F.slice(group, 1, nested), hit)))

    topics = F.coalesce(F.from_json(F.get_json_object("payload", "$.RelatedTopics"), "array<string>"), F.array().cast("array<string>"))
    d = replies.select("query_id", "engine", F.when(has_top, F.array(top)).otherwise(F.array().cast("array<struct<title:string,url:string,snippet:string,kind:string>>")).alias("start"), F.transform(topics, hits).alias("groups"))
    grown = F.aggregate("groups", F.col("start"), lambda acc, g: F.when((F.size(acc) >= cap) & (F.size(acc) > F.size("start")), acc).otherwise(F.concat(acc, g)))
    each = d.select("query_id", "engine", F.posexplode(grown).alias("pos", "h"))
    return _hits(each, F.col("h.title"), F.col("h.url"), F.col("h.snippet"), metadata=_meta(kind=F.col("h.kind")))


def search_token(pages: DataFrame) -> DataFrame:
    """(query_id, token, error): the token of a result page, which the requests for images, videos and news must carry.

    ``pages`` has the first step's replies (query_id, payload).
    """
    token = F.regexp_extract("payload", r"""vqd=["']?([0-9A-Za-z_-]+)""", 1)
    return pages.select("query_id", F.nullif(token, F.lit("")).alias("token"), F.when(F.coalesce(token, F.lit("")) == "", F.lit("no token in page")).alias("error"))


def token_requests(queries: DataFrame, tokens: DataFrame, template: str) -> DataFrame:
    """Second-step requests (query_id, url) of queries (query_id, query) that got a token."""
    from ..functions.urls import encode_component

    j = queries.join(tokens.where("token IS NOT NULL"), "query_id")
    url = F.replace(F.replace(F.lit(template), F.lit("{query}"), encode_component(F.col("query"))), F.lit("{token}"), F.col("token"))
    return j.select("query_id", url.alias("url"))


def news(replies: DataFrame, cap: int = 20) -> DataFrame:
    """News items; the date is a civil date or what the reply says in words."""
    date = F.coalesce(unix_to_date(_get("$.date").try_cast("long")), _get("$.relative_time"))
    return _hits(_items(replies, None), _get("$.title"), _get("$.url"), _get("$.excerpt"), date, _get("$.image"), _meta(source=_get("$.source")), cap)


def qwant(replies: DataFrame, kind: str, cap: int = 15) -> DataFrame:
    """Groups of the main line of one kind; reaching the cap ends a group only, so each later group adds one."""
    groups = F.from_json(F.get_json_object("payload", "$.data.result.items.mainline"), "array<string>")
    g = replies.where(_get("$.status", "payload") == "success").select("query_id", "engine", F.posexplode(groups).alias("g", "group"))
    of_kind = F.coalesce(_get("$.type", "group"), F.lit("")).isin("", kind)
    each = g.where(of_kind).select("query_id", "engine", "g", F.posexplode(F.from_json(_get("$.items", "group"), "array<string>")).alias("i", "item"))
    each = each.where(_get("$.title").isNotNull() & _get("$.url").isNotNull())
    w = Window.partitionBy("query_id", "engine").orderBy("g", "i")
    n = each.withColumn("seen", F.row_number().over(w)).withColumn("in_group", F.row_number().over(Window.partitionBy("query_id", "engine", "g").orderBy("i")))
    # rows that a group may add: up to the cap, and always its first
    kept = n.where((F.col("seen") <= cap) | (F.col("in_group") == 1)).withColumn("pos", F.struct("g", "i"))
    return _hits(kept, _get("$.title"), _get("$.url"), F.coalesce(_get("$.desc"), _get("$.description")), thumbnail=F.coalesce(_get("$.media"), _get("$.thumbnail")), metadata=_meta(source=_get("$.source.name")))


def pubmed(ids: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries in the order of the id list; ``ids`` and ``summaries`` are replies of the two steps."""
    listed = ids.select("query_id", "engine", F.posexplode(F.from_json(F.get_json_object("payload", "$.esearchresult.idlist"), "array<string>")).alias("pos", "id"))
    docs = summaries.select("query_id", F.explode(F.from_json(F.get_json_object("payload", "$.result"), "map<string,string>")).alias("id", "item"))
    d = listed.join(docs, ["query_id", "id"])
    names = F.transform(F.filter(F.coalesce(F.from_json(_get("$.authors"), "array<string>"), F.array().cast("array<string>")), lambda a: F.get_json_object(a, "$.name").isNotNull()), lambda a: F.get_json_object(a, "$.name"))
    who = F.when(F.size(names) == 0, F.lit("…")).otherwise(F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.lit(", et al.")))
    date = F.coalesce(_get("$.pubdate"), F.lit(""))
    line = F.concat(F.coalesce(_get("$.source"), F.lit("")), F.lit(" · "), who, F.lit(" · "), date)
    return _hits(d, F.nullif(_get("$.title"), F.lit("")), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("id"), F.lit("/")), line, date, metadata=_meta(pmid=F.col("id")))


def _osm(d: DataFrame, kind: Column, number: Column, title: Column, snippet: Column, metadata: Column) -> DataFrame:
    url = F.concat(F.lit("https://www.openstreetmap.org/"), kind, F.lit("/"), number)
    return _hits(d.where(F.coalesce(number.try_cast("long"), F.lit(0)) != 0), title, url, snippet, metadata=metadata)


def nominatim(replies: DataFrame) -> DataFrame:
    """Places with coordinates; rows without an id are dropped."""
    kind = F.coalesce(_get("$.osm_type"), F.lit("node"))
    where = F.concat(F.lit("("), F.coalesce(_get("$.lat"), F.lit("0")), F.lit(", "), F.coalesce(_get("$.lon"), F.lit("0")), F.lit(")"))
    return _osm(_items(replies, None), kind, _get("$.osm_id"), _get("$.display_name"), where, _meta(osm_type=kind, type=F.nullif(_get("$.type"), F.lit(""))))


def photon(replies: DataFrame) -> DataFrame:
    """Places with their address; W and R are ways and relations, all else nodes."""
    p = "$.properties."
    kind = F.when(_get(p + "osm_type") == "W", F.lit("way")).when(_get(p + "osm_type") == "R", F.lit("relation")).otherwise(F.lit("node"))
    parts = F.concat_ws(", ", *[_get(p + k) for k in ("street", "city", "county", "state", "country")])
    key = F.nullif(_get(p + "osm_key"), F.lit(""))
    return _osm(_items(replies, "features"), kind, _get(p + "osm_id"), _get(p + "name"), parts, _meta(kind=F.concat(key, F.lit("/"), F.coalesce(_get(p + "osm_value"), F.lit("")))))


def currency(queries: DataFrame, rates: DataFrame) -> DataFrame:
    """One answer for each query (query_id, query) like ``100 usd in eur``; rates: code, per_unit of a common base.

    Codes must be in the table, so ordinary words are no currencies.
    """
    from ..functions.text import parse_currency

    q = queries.select("query_id", parse_currency(F.col("query")).alias("p")).where("p IS NOT NULL").select("query_id", "p.*")
    a, b = (rates.select(F.col("code").alias(c), F.col("per_unit").alias(r)) for c, r in (("from", "ra"), ("to", "rb")))
    j = q.join(a, "from").join(b, "to").withColumn("rate", F.col("rb") / F.col("ra"))
    value = F.format_string("%.4f", F.col("amount") * F.col("rate"))
    return j.select("query_id", F.concat(F.format_string("%.4f", "amount"), F.lit(" "), F.col("from"), F.lit(" = "), value, F.lit(" "), F.col("to")).alias("title"), F.format_string("1 %s = %.6f %s", "from", "rate", "to").alias("snippet"))


def translations(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Answers for queries with two language codes, looked up in (text, from, to, translation)."""
    from ..functions.text import parse_translation

    q = queries.select("query_id", parse_translation(F.col("query")).alias("p")).where("p IS NOT NULL").select("query_id", "p.*")
    return q.join(dictionary, ["text", "from", "to"]).select("query_id", "text", "from", "to", F.col("translation").alias("title"))
