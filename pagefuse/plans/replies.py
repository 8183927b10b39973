"""Registered queries of the engine families, each next to the DuckDB SQL for the same hits.

Replies are made from the tables: a group of rows becomes the list of one
reply, in the shape that the family's service has.  The SQL states the hits
from the rows themselves, so it shares nothing with the readers.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, kinds, sql, urls
from ..operators import route
from ..sources import factory, families, html_replies, json_replies, reader, spec_rows
from .queries import query, table


def text_of(*parts: str | Column) -> Column:
    """Columns and fixed texts in one."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def c(name: str) -> Column:
    """A column."""
    return F.col(name)


def listed(df: DataFrame, group: str | Column, order: str, item: Column, engine: str = "e") -> DataFrame:
    """(query_id, engine, items): the items of each group, in order; a reply's list is bounded, so groups of growing tables go by a key that bounds them."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), item.alias("v"))))
    group = F.col(group) if isinstance(group, str) else group
    return df.groupBy(group.cast("long").alias("query_id")).agg(F.transform(pairs, lambda p: p["v"]).alias("items")).withColumn("engine", F.lit(engine))


def twenty(key: str) -> Column:
    """Twenty keys a group."""
    return F.floor(F.col(key) / 20)


def reply(df: DataFrame, body: Column) -> DataFrame:
    """(query_id, engine, payload)."""
    return df.select("query_id", "engine", F.to_json(body).alias("payload"))


def at(name: str) -> Column:
    """A metadata field."""
    return F.col("metadata")[name].alias(name)


@query("""
SELECT (p_partkey // 20)::BIGINT AS query_id, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey)::INT AS rank, p_name AS title, 'https://wiki.test/wiki/' || replace(p_name, ' ', '_') AS url,
 p_type || ' & ' || p_brand AS snippet, '2020-01-0' || (1 + p_partkey % 9) AS published_date FROM part""")
def wiki_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search lists of a wiki: addresses from titles, snippets without tags and entities."""
    item = F.struct(c("p_name").alias("title"), text_of("<b>", c("p_type"), "</b> &amp; ", c("p_brand")).alias("snippet"), text_of("2020-01-0", 1 + c("p_partkey") % 9).alias("timestamp"))
    d = listed(table(spark, sf_dir, "part"), twenty("p_partkey"), "p_partkey", item)
    h = families.mediawiki(reply(d, F.struct(F.struct(c("items").alias("search")).alias("query"))), "wiki.test")
    return h.select("query_id", "rank", "title", "url", "snippet", "published_date")


@query("""
SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS rank, 'Is "' || o_orderpriority || '" <it>?' AS title, 'https://q.test/' || o_orderkey AS url,
 strftime(o_orderdate, '%Y-%m-%d') AS published_date, (o_orderkey % 7)::VARCHAR AS score, CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE (o_orderkey % 5)::VARCHAR END AS answers, CASE WHEN o_orderkey % 2 = 0 THEN 'true' END AS answered FROM orders""")
def question_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with score, answers (0 where the reply has none) and whether one is accepted."""
    k = c("o_orderkey")
    item = F.struct(
        text_of("Is &quot;", c("o_orderpriority"), "&quot; &lt;it&gt;?").alias("title"), text_of("https://q.test/", k).alias("link"), (k % 7).alias("score"), F.when(k % 3 != 0, k % 5).alias("answer_count"),
        (k % 2 == 0).alias("is_answered"), F.unix_timestamp("o_orderdate").alias("creation_date"),
    )
    h = families.stackexchange(reply(listed(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", item), F.struct("items")))
    return h.select("query_id", "rank", "title", "url", "published_date", at("score"), at("answers"), at("answered"))


@query("""
WITH t AS (SELECT conv_id, turn, text, role FROM conversations), f AS (SELECT conv_id, min(turn) AS turn FROM t WHERE conv_id % 5 <> 4 GROUP BY conv_id)
SELECT t.conv_id AS query_id, 1 AS rank, 'Topic & ' || t.conv_id AS title, 'https://forum.test/t/' || CASE WHEN t.conv_id % 2 = 0 THEN 'slug-' || t.conv_id ELSE 'topic' END || '/' || t.conv_id AS url, t.role AS snippet
FROM f JOIN t ON t.conv_id = f.conv_id AND t.turn = f.turn""")
def forum_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and topics in one payload: the first post of each topic, topics unknown to the reply left out."""
    k = c("conv_id")
    posts = listed(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.struct(k.alias("topic_id"), text_of("<i>", c("role"), "</i>").alias("blurb")))
    topic = F.array(F.struct(c("query_id").alias("id"), text_of("Topic &amp; ", c("query_id")).alias("title"), F.when(c("query_id") % 2 == 0, text_of("slug-", c("query_id"))).alias("slug")))
    topics = F.when(c("query_id") % 5 != 4, topic).otherwise(F.slice(topic, 1, 0))
    h = families.discourse(reply(posts, F.struct(c("items").alias("posts"), topics.alias("topics"))), "https://forum.test")
    return h.select("query_id", "rank", "title", "url", "snippet")


@query("""
WITH n AS (SELECT n_regionkey::BIGINT AS q, n_nationkey AS k, n_name AS name FROM nation),
p AS (SELECT q, 'posts' AS kind, k, name AS title, CASE WHEN k % 2 = 0 THEN 'https://n.test/' || k ELSE 'https://l.test/post/' || k END AS url, 'about ' || name AS snippet FROM n WHERE k % 7 <> 0
 UNION ALL SELECT q, 'comments', k, 'Comment #' || k, 'https://l.test/comment/' || k, 'on ' || name FROM n WHERE k % 3 <> 0
 UNION ALL SELECT q, 'communities', k, CASE WHEN k % 2 = 0 THEN 'Land ' || name ELSE name END || ' (' || name || ')', 'https://l.test/c/' || name, 'of ' || name FROM n
 UNION ALL SELECT q, 'users', k, name || ' (@' || name || ')', 'https://l.test/u/' || name, '' FROM n)
SELECT q AS query_id, kind AS engine, row_number() OVER (PARTITION BY q, kind ORDER BY k)::INT AS rank, title, url, snippet FROM p""")
def board_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts, comments, communities and users of a link board."""
    k, name = c("n_nationkey"), c("n_name")
    items = {
        "posts": F.struct(F.struct(k.alias("id"), name.alias("name"), F.when(k % 2 == 0, text_of("https://n.test/", k)).alias("url"), text_of("<p>about</p> ", name).alias("body")).alias("post"), F.when(k % 7 != 0, F.struct(name.alias("name"))).alias("community")),
        "comments": F.struct(F.struct(k.alias("id"), F.when(k % 3 != 0, text_of("on <b>", name, "</b>")).alias("content")).alias("comment")),
        "communities": F.struct(F.struct(name.alias("name"), F.when(k % 2 == 0, text_of("Land ", name)).alias("title"), text_of("of ", name).alias("description")).alias("community")),
        "users": F.struct(F.struct(name.alias("name")).alias("person")),
    }
    out = None
    for kind, item in items.items():
        h = families.lemmy(reply(listed(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", item, kind), F.struct(c("items").alias(kind))), kind, "https://l.test").select("query_id", "engine", "rank", "title", "url", "snippet")
        out = h if out is None else out.unionByName(h)
    return out


@query("""
WITH n AS (SELECT n_regionkey::BIGINT AS q, n_nationkey AS k, n_name AS name FROM nation),
p AS (SELECT q, 'tags' AS e, k, '#' || name AS title, CASE WHEN k % 2 = 0 THEN 'https://u.test/' || k ELSE 'https://m.test/tags/' || name END AS url, '' AS snippet, (k * 3)::VARCHAR AS recent_uses FROM n
 UNION ALL SELECT q, 'accounts', k, CASE WHEN k % 2 = 0 THEN 'The ' || name ELSE name END || ' (@' || name || ')', 'https://a.test/' || k, 'note ' || k, NULL FROM n)
SELECT q AS query_id, e AS engine, row_number() OVER (PARTITION BY q, e ORDER BY k)::INT AS rank, title, url, snippet, recent_uses FROM p""")
def social_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashtags with their recent uses, and accounts."""
    k, name, n = c("n_nationkey"), c("n_name"), table(spark, sf_dir, "nation")
    tag = F.struct(name.alias("name"), F.when(k % 2 == 0, text_of("https://u.test/", k)).alias("url"), F.array(F.struct((k * 3).cast("string").alias("uses"))).alias("history"))
    user = F.struct(name.alias("username"), F.when(k % 2 == 0, text_of("The ", name)).alias("display_name"), text_of("https://a.test/", k).alias("url"), text_of("<p>note ", k, "</p>").alias("note"))
    tags = families.mastodon(reply(listed(n, "n_regionkey", "n_nationkey", tag, "tags"), F.struct(c("items").alias("hashtags"))), True, "https://m.test")
    users = families.mastodon(reply(listed(n, "n_regionkey", "n_nationkey", user, "accounts"), F.struct(c("items").alias("accounts"))), False, "https://m.test")
    return tags.unionByName(users).select("query_id", "engine", "rank", "title", "url", "snippet", at("recent_uses"))


@query("""
SELECT (s_suppkey // 20)::BIGINT AS query_id, row_number() OVER (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey)::INT AS rank, 'org/' || s_name AS title, 'https://huggingface.co/org/' || s_name AS url,
 CASE WHEN s_suppkey % 4 = 0 THEN '0' ELSE s_suppkey::VARCHAR END AS likes, (s_suppkey * 10)::VARCHAR AS downloads, CASE WHEN s_suppkey % 2 = 0 THEN 'text' END AS pipeline_tag FROM supplier""")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of a hub, a list without a frame."""
    k = c("s_suppkey")
    item = F.struct(text_of("org/", c("s_name")).alias("id"), F.when(k % 4 != 0, k).alias("likes"), (k * 10).alias("downloads"), F.when(k % 2 == 0, F.lit("text")).alias("pipeline_tag"))
    h = families.model_hub(reply(listed(table(spark, sf_dir, "supplier"), twenty("s_suppkey"), "s_suppkey", item), c("items")))
    return h.select("query_id", "rank", "title", "url", at("likes"), at("downloads"), at("pipeline_tag"))


@query("""
SELECT (s_suppkey // 20)::BIGINT AS query_id, row_number() OVER (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey::VARCHAR)::INT AS rank, s_name || '.png' AS title, 'https://c.test/f/' || s_suppkey AS url, 'https://c.test/t/' || s_suppkey AS thumbnail_url FROM supplier""")
def media_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media files from an object of pages, by page key."""
    k = c("s_suppkey")
    item = F.struct(text_of("File:", c("s_name"), ".png").alias("title"), F.array(F.struct(text_of("https://c.test/f/", k).alias("descriptionurl"), text_of("https://c.test/t/", k).alias("thumburl"))).alias("imageinfo"))
    d = listed(table(spark, sf_dir, "supplier"), twenty("s_suppkey"), "s_suppkey", F.struct(k.cast("string").alias("key"), item.alias("value")))
    h = families.commons(reply(d, F.struct(F.struct(F.map_from_entries("items").alias("pages")).alias("query"))))
    return h.select("query_id", "rank", "title", "url", "thumbnail_url")


@query("""
WITH n AS (SELECT n_regionkey::BIGINT AS q, n_nationkey AS k, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
a AS (SELECT r_regionkey::BIGINT AS q, 0 AS o, r_name AS title, 'https://d.test/' || r_name AS url, 'About ' || r_name || ' (via Src)' AS snippet, NULL AS kind FROM region WHERE r_regionkey % 2 = 0
 UNION ALL SELECT q, i * 10, name, 'https://d.test/' || k, name || ' - a land', 'related_topic' FROM n WHERE i <= 2
 UNION ALL SELECT q, 30 + i, name, 'https://d.test/' || k, name, 'related_topic' FROM n WHERE i BETWEEN 3 AND 5)
SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY o)::INT AS rank, title, url, snippet, kind FROM a""")
def instant_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An abstract where there is one, then related topics and those of a group."""
    k, name = c("n_nationkey"), c("n_name")
    d = listed(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", F.struct(k.alias("k"), name.alias("name")))
    d = d.join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "query_id"), "query_id")
    link = lambda t, words: F.struct(text_of("https://d.test/", t["k"]).alias("FirstURL"), words.alias("Text"))
    nothing = F.lit(None).cast("array<struct<FirstURL:string,Text:string>>")
    own = F.transform(F.slice("items", 1, 2), lambda t: F.struct(text_of("https://d.test/", t["k"]).alias("FirstURL"), text_of(t["name"], " - a land").alias("Text"), nothing.alias("Topics")))
    group = F.struct(F.lit(None).cast("string").alias("FirstURL"), F.lit(None).cast("string").alias("Text"), F.transform(F.slice("items", 3, 9), lambda t: link(t, t["name"])).alias("Topics"))
    has = c("query_id") % 2 == 0
    body = F.struct(
        c("r_name").alias("Heading"), F.when(has, text_of("About ", c("r_name"))).alias("AbstractText"), F.when(has, text_of("https://d.test/", c("r_name"))).otherwise("").alias("AbstractURL"), F.lit("Src").alias("AbstractSource"),
        F.concat(own, F.array(group)).alias("RelatedTopics"),
    )
    return families.instant_answers(reply(d, body)).select("query_id", "rank", "title", "url", "snippet", at("kind"))


@query("""
SELECT user_id AS query_id, rank::INT AS rank, event_type || ' ' || event_id AS title, 'https://n.test/' || event_id AS url, 'ex' AS snippet, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE '2 hours ago' END AS published_date, 'S' AS source
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events) WHERE rank <= 20""")
def news_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items, twenty at most, dated by a number or in words."""
    k = c("event_id")
    item = F.struct(text_of(c("event_type"), " ", k).alias("title"), text_of("https://n.test/", k).alias("url"), F.lit("ex").alias("excerpt"), F.when(k % 2 == 0, F.unix_timestamp("ts")).alias("date"), F.lit("2 hours ago").alias("relative_time"), F.lit("S").alias("source"))
    h = families.news(reply(listed(table(spark, sf_dir, "events"), "user_id", "event_id", item), c("items")))
    return h.select("query_id", "rank", "title", "url", "snippet", "published_date", at("source"))


@query("""
WITH e AS (SELECT user_id AS q, event_id AS k, CASE WHEN event_id % 3 = 0 THEN 'web' WHEN event_id % 3 = 1 THEN '' ELSE 'ads' END AS t, event_id % 3 AS g FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY g, k) AS seen, row_number() OVER (PARTITION BY q, g ORDER BY k) AS i FROM e WHERE t <> 'ads'),
p AS (SELECT * FROM r WHERE seen <= 15 OR i = 1)
SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY g, k)::INT AS rank, 'T' || k AS title, 'https://w.test/' || k AS url, CASE WHEN k % 2 = 0 THEN 'd' ELSE 'e' END AS snippet FROM p""")
def mainline_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a main line: those of one kind or of none, with a cap that ends a group only."""
    k = c("event_id")
    item = F.struct(text_of("T", k).alias("title"), text_of("https://w.test/", k).alias("url"), F.when(k % 2 == 0, F.lit("d")).alias("desc"), F.lit("e").alias("description"))
    e = table(spark, sf_dir, "events").withColumn("g", k % 3)
    one = e.groupBy("user_id", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("v")))), lambda p: p["v"]).alias("items"))
    group = F.struct(F.when(c("g") == 0, F.lit("web")).when(c("g") == 2, F.lit("ads")).alias("type"), c("items").alias("items"))
    d = one.groupBy(c("user_id").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("g", group.alias("v")))), lambda p: p["v"]).alias("mainline")).withColumn("engine", F.lit("e"))
    body = F.struct(F.lit("success").alias("status"), F.struct(F.struct(F.struct("mainline").alias("items")).alias("result")).alias("data"))
    return families.qwant(reply(d, body), "web").select("query_id", "rank", "title", "url", "snippet")


@query("""
SELECT (s_suppkey // 20)::BIGINT AS query_id, row_number() OVER (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey DESC)::INT AS rank, s_name AS title, 'https://pubmed.ncbi.nlm.nih.gov/' || s_suppkey || '/' AS url,
 'J' || s_suppkey % 3 || ' · ' || CASE WHEN s_suppkey % 2 = 0 THEN 'A, B, C, et al.' ELSE '…' END || ' · 2020' AS snippet, s_suppkey::VARCHAR AS pmid FROM supplier WHERE s_suppkey % 5 <> 4""")
def id_list_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps: an id list and an object of summaries, which lacks some; hits in the order of the list."""
    k, s = c("s_suppkey"), table(spark, sf_dir, "supplier")
    ids = listed(s.withColumn("o", -k), twenty("s_suppkey"), "o", k.cast("string"))
    authors = F.when(k % 2 == 0, F.array(*[F.struct(F.lit(x).alias("name")) for x in "ABCD"])).otherwise(F.array().cast("array<struct<name:string>>"))
    item = F.struct(c("s_name").alias("title"), text_of("J", k % 3).alias("source"), authors.alias("authors"), F.lit("2020").alias("pubdate"))
    docs = listed(s.where("s_suppkey % 5 <> 4"), twenty("s_suppkey"), "s_suppkey", F.struct(k.cast("string").alias("key"), item.alias("value")))
    h = families.pubmed(reply(ids, F.struct(F.struct(c("items").alias("idlist")).alias("esearchresult"))), reply(docs, F.struct(F.map_from_entries("items").alias("result"))))
    return h.select("query_id", "rank", "title", "url", "snippet", at("pmid"))


@query("""
WITH n AS (SELECT n_regionkey::BIGINT AS q, n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey <> 0),
p AS (SELECT q, 'a' AS e, k, CASE WHEN k % 2 = 0 THEN 'way' ELSE 'node' END AS kind, name AS title, '(' || k || '.5, -1)' AS snippet FROM n
 UNION ALL SELECT q, 'b', k, CASE k % 3 WHEN 0 THEN 'way' WHEN 1 THEN 'relation' ELSE 'node' END, name, 'City ' || k || ', ' || name FROM n)
SELECT q AS query_id, e AS engine, row_number() OVER (PARTITION BY q, e ORDER BY k)::INT AS rank, title, 'https://www.openstreetmap.org/' || kind || '/' || k AS url, snippet FROM p""")
def place_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of two map services; those without an id are left out."""
    k, name, n = c("n_nationkey"), c("n_name"), table(spark, sf_dir, "nation")
    a = F.struct(k.alias("osm_id"), F.when(k % 2 == 0, F.lit("way")).alias("osm_type"), text_of(k, ".5").alias("lat"), F.lit("-1").alias("lon"), name.alias("display_name"))
    b = F.struct(F.struct(k.alias("osm_id"), F.when(k % 3 == 0, F.lit("W")).when(k % 3 == 1, F.lit("R")).otherwise("N").alias("osm_type"), name.alias("name"), text_of("City ", k).alias("city"), name.alias("country"), F.lit("place").alias("osm_key")).alias("properties"))
    first = families.nominatim(reply(listed(n, "n_regionkey", "n_nationkey", a, "a"), c("items")))
    second = families.photon(reply(listed(n, "n_regionkey", "n_nationkey", b, "b"), F.struct(c("items").alias("features"))))
    return first.unionByName(second).select("query_id", "engine", "rank", "title", "url", "snippet")


@query("""
SELECT conv_id AS query_id, 'https://i.test/i.js?q=' || replace(replace(url_encode(role || ' é'), '*', '%2A'), '+', '%20') || '&vqd=4-' || conv_id || '_x' AS url FROM conversations WHERE turn = 0 AND conv_id % 3 <> 0""")
def token_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps: the token of each result page, then the requests of the queries that got one."""
    first = table(spark, sf_dir, "conversations").where("turn = 0")
    pages = first.select(c("conv_id").alias("query_id"), F.when(c("conv_id") % 3 != 0, text_of('<script>x({vqd="4-', c("conv_id"), '_x", q})</script>')).otherwise("<p>none</p>").alias("payload"))
    asked = first.select(c("conv_id").alias("query_id"), text_of(c("role"), " é").alias("query"))
    return families.token_requests(asked, families.search_token(pages), "https://i.test/i.js?q={query}&vqd={token}")


RATES = {"USD": 1.0, "EUR": 0.8, "GBP": 0.5, "JPY": 150.0, "CHF": 0.9}
_CODES = "(VALUES (0, 'usd', 1.0::DOUBLE), (1, 'eur', 0.8), (2, 'gbp', 0.5), (3, 'jpy', 150.0), (4, 'chf', 0.9), (5, 'xyz', NULL)) AS"


@query(f"""
SELECT event_id AS query_id, printf('%.4f', (event_id % 90 + 1)::DOUBLE) || ' ' || upper(a.code) || ' = ' || printf('%.4f', (event_id % 90 + 1)::DOUBLE * (b.rate / a.rate)) || ' ' || upper(b.code) AS title,
 '1 ' || upper(a.code) || ' = ' || printf('%.6f', b.rate / a.rate) || ' ' || upper(b.code) AS snippet
FROM events JOIN {_CODES} a(i, code, rate) ON a.i = event_id % 6 JOIN {_CODES} b(i, code, rate) ON b.i = event_id // 6 % 6 WHERE a.rate IS NOT NULL AND b.rate IS NOT NULL""")
def currency_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in one currency of each query, in another; unknown codes give no answer."""
    codes = F.array(*[F.lit(x) for x in ("usd", "eur", "gbp", "jpy", "chf", "xyz")])
    k = c("event_id")
    pick = lambda i: F.get(codes, (i % 6).cast("int"))
    q = table(spark, sf_dir, "events").select(k.alias("query_id"), text_of(k % 90 + 1, " ", pick(k), " in ", pick(F.floor(k / 6)), "?").alias("query"))
    return families.currency(q, spark.createDataFrame(list(RATES.items()), "code string, per_unit double"))


@query("""
SELECT n_nationkey::BIGINT AS query_id, lower(n_name) AS text, CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'de' END AS "from", CASE WHEN n_nationkey % 2 = 0 THEN 'de' ELSE 'en' END AS "to", 'T ' || n_name AS title
FROM nation WHERE n_nationkey % 3 <> 0""")
def translation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with language codes before or after a phrase, looked up in a dictionary that lacks every third."""
    k, name = c("n_nationkey"), F.lower("n_name")
    n = table(spark, sf_dir, "nation")
    q = n.select(k.cast("long").alias("query_id"), F.when(k % 2 == 0, text_of("en de ", name, " and more")).otherwise(text_of(name, " and more de en")).alias("query"))
    a, b = F.when(k % 2 == 0, F.lit("en")).otherwise("de"), F.when(k % 2 == 0, F.lit("de")).otherwise("en")
    d = n.where("n_nationkey % 3 <> 0").select(text_of(name, " and more").alias("text"), a.alias("from"), b.alias("to"), text_of("T ", c("n_name")).alias("translation"))
    return families.translations(q, d).select("query_id", F.regexp_replace("text", " and more$", "").alias("text"), "from", "to", "title")


@query("""
WITH s AS (SELECT (s_suppkey // 20)::BIGINT AS q, s_suppkey AS k, s_name AS name FROM supplier)
SELECT q AS query_id, 'gitea' AS engine, row_number() OVER (PARTITION BY q ORDER BY k)::INT AS rank, 'o/' || name AS title, 'https://g.test/' || k AS url, CASE WHEN k % 2 = 0 THEN 'about ' || name ELSE '' END AS snippet, k::VARCHAR AS extra FROM s
UNION ALL SELECT q, 'wikidata', row_number() OVER (PARTITION BY q ORDER BY k)::INT, name, 'https://d.test/' || k, 'd', 'Q' || k FROM s
UNION ALL SELECT q, 'crates.io', row_number() OVER (PARTITION BY q ORDER BY k)::INT, name, 'https://crates.io/crates/' || name, 'x y', NULL FROM s
UNION ALL SELECT q, 'ddg_images', row_number() OVER (PARTITION BY q ORDER BY k)::INT, name, CASE WHEN k % 2 = 0 THEN 'https://p.test/' ELSE 'https://i.test/' END || k, '', 'https://i.test/' || k FROM s
UNION ALL SELECT q, 'ddg_videos', row_number() OVER (PARTITION BY q ORDER BY k)::INT, name, 'https://v.test/' || k, 'v', '1:0' || k % 10 FROM s""")
def spec_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines that a spec describes: repositories, entities, packages, images, videos."""
    k, name, s = c("s_suppkey"), c("s_name"), table(spark, sf_dir, "supplier")
    made = {
        "gitea": (F.struct(text_of("o/", name).alias("full_name"), text_of("https://g.test/", k).alias("html_url"), F.when(k % 2 == 0, text_of("about ", name)).alias("description"), k.alias("stars_count")), lambda i: F.struct(i.alias("data")), "stars"),
        "wikidata": (F.struct(name.alias("label"), text_of("https://d.test/", k).alias("concepturi"), F.lit("d").alias("description"), text_of("Q", k).alias("id")), lambda i: F.struct(i.alias("search")), "entity_id"),
        "crates.io": (F.struct(name.alias("name"), F.lit("x y").alias("description")), lambda i: F.struct(i.alias("crates")), "downloads"),
        "ddg_images": (F.struct(name.alias("title"), F.when(k % 2 == 0, text_of("https://p.test/", k)).alias("url"), text_of("https://i.test/", k).alias("image")), lambda i: i, "image"),
        "ddg_videos": (F.struct(name.alias("title"), text_of("https://v.test/", k).alias("url"), F.lit("v").alias("description"), text_of("1:0", k % 10).alias("duration")), lambda i: i, "duration"),
    }
    out = None
    for engine, (item, frame, extra) in made.items():
        h = factory.interpret(reply(listed(s, twenty("s_suppkey"), "s_suppkey", item, engine), frame(c("items"))), engine)
        h = h.select("query_id", "engine", "rank", "title", "url", "snippet", c("metadata")[extra].alias("extra"))
        out = h if out is None else out.unionByName(h)
    return out


_RESULT = {
    "duckduckgo": ('<div class="result{ad}"><a class="result__a" href="//duckduckgo.com/l/?uddg={u}">{t}</a><a class="result__snippet">{s}</a></div>', 20),
    "brave": ('<div class="snippet" data-type="web"><a href="{u}"><span class="title">{t}</span></a><p class="snippet-description">{s}</p></div>', 15),
    "startpage": ('<div class="w-gl__result"><a class="w-gl__result-url" href="{u}">x</a><h2>{t}</h2><p class="w-gl__description">{s}</p></div>', 15),
    "mojeek": ('<ul class="results-standard"><li><a class="title" href="{u}">{t}</a><p class="s">{s}</p></li></ul>', 15),
}


@query("""
WITH e AS (SELECT user_id, event_id AS k, event_type FROM events), n AS (SELECT unnest(['duckduckgo', 'brave', 'startpage', 'mojeek']) AS engine, unnest([20, 15, 15, 15]) AS cap),
r AS (SELECT user_id AS query_id, engine, cap, row_number() OVER (PARTITION BY user_id, engine ORDER BY k)::INT AS rank, event_type || ' & ' || k AS title, 'https://h.test/' || k AS url, 'about ' || event_type AS snippet FROM e, n WHERE engine <> 'duckduckgo' OR k % 4 <> 0)
SELECT query_id, engine, rank, title, url, snippet FROM r WHERE rank <= cap""")
def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages of four engines: wrapped links, advertisements left out, caps."""
    k = c("event_id")
    out = None
    for engine, (row, _) in _RESULT.items():
        text = F.lit(row.replace("{ad}", "{a}"))
        for mark, value in (("{a}", F.when(k % 4 == 0, F.lit(" result--ad")).otherwise("")), ("{u}", F.url_encode(text_of("https://h.test/", k)) if engine == "duckduckgo" else text_of("https://h.test/", k)), ("{t}", text_of("<b>", c("event_type"), "</b> &amp; ", k)), ("{s}", text_of("about\n ", c("event_type")))):
            text = F.replace(text, F.lit(mark), value)
        d = listed(table(spark, sf_dir, "events"), "user_id", "event_id", text, engine)
        pages = d.select("query_id", "engine", text_of("<html><body>", F.array_join("items", "\n"), "</body></html>").alias("payload"))
        h = html_replies.extract(pages, html_replies.SPECS[engine]).select("query_id", "engine", "rank", "title", "url", "snippet")
        out = h if out is None else out.unionByName(h)
    return out


# --- kinds, readers, tags ------------------------------------------------------------------------


@query("""
SELECT 'e' || event_id AS id, 'Json' AS kind, 'JSON response' AS title, '<!-- BEGIN_UNTRUSTED_CONTENT -->' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || '<!-- END_UNTRUSTED_CONTENT -->' AS markdown FROM events
UNION ALL SELECT 'n' || n_nationkey, 'Xml', 'Land ' || n_name || ' & "more"', '<!-- BEGIN_UNTRUSTED_CONTENT -->' || chr(10) || '```xml' || chr(10) || '<n><title>Land  ' || n_name || ' &amp; &#34;more&quot;</title></n>' || chr(10) || '```' || chr(10) || '<!-- END_UNTRUSTED_CONTENT -->' FROM nation
UNION ALL SELECT 'r' || r_regionkey, 'Text', 'r' || r_regionkey || '.csv', '<!-- BEGIN_UNTRUSTED_CONTENT -->' || chr(10) || '```csv' || chr(10) || 'a,' || r_name || chr(10) || '```' || chr(10) || '<!-- END_UNTRUSTED_CONTENT -->' FROM region
UNION ALL SELECT 's' || s_suppkey, 'Text', 's' || s_suppkey, '<!-- BEGIN_UNTRUSTED_CONTENT -->' || chr(10) || 'plain <b> ' || s_name || chr(10) || '<!-- END_UNTRUSTED_CONTENT -->' FROM supplier
UNION ALL SELECT 'h' || c_custkey, 'Html', c_name, '<!-- BEGIN_UNTRUSTED_CONTENT -->' || chr(10) || '# ' || c_name || chr(10) || chr(10) || 'In **' || c_mktsegment || '**' || chr(10) || '<!-- END_UNTRUSTED_CONTENT -->' FROM customer""")
def kind_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of every kind, each through its own pass: pages cleaned, JSON and XML fenced, tables fenced, prose as it is."""
    t = lambda name: table(spark, sf_dir, name)
    one = lambda d, id_, url, ct, body: d.select(id_.alias("id"), url.alias("url"), F.lit(ct).alias("content_type"), body.alias("html"))
    made = [
        one(t("events"), text_of("e", c("event_id")), F.lit("https://k.test/e"), "application/json", c("props")),
        one(t("nation"), text_of("n", c("n_nationkey")), F.lit("https://k.test/n"), "text/xml", text_of("<n><title>Land  ", c("n_name"), " &amp; &#34;more&quot;</title></n>")),
        one(t("region"), text_of("r", c("r_regionkey")), text_of("https://k.test/d/r", c("r_regionkey"), ".csv"), "text/csv; charset=utf-8", text_of("a,", c("r_name"))),
        one(t("supplier"), text_of("s", c("s_suppkey")), text_of("https://k.test/s", c("s_suppkey"), "/"), "text/plain", text_of("plain <b> ", c("s_name"))),
        one(t("customer"), text_of("h", c("c_custkey")), F.lit("https://k.test/h"), "text/html", text_of("<html><body><main><h1>", c("c_name"), "</h1><p>In <strong>", c("c_mktsegment"), "</strong></p><script>x()</script></main></body></html>")),
    ]
    every = made[0]
    for d in made[1:]:
        every = every.unionByName(d)
    every = every.withColumn("kind", kinds.kind_of_type(kinds.media_type(c("content_type"))))
    return route.sanitized(every, ["id", "kind"]).select("id", "kind", "title", "markdown")


@query("""
WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 204 END AS status, CASE WHEN event_id % 10 = 0 THEN '7' WHEN event_id % 10 = 5 THEN 'soon' END AS retry_after, event_type AS body FROM events)
SELECT event_id, CASE WHEN status BETWEEN 200 AND 299 THEN body END AS markdown, CASE WHEN status IS NULL THEN 'network' WHEN status = 429 THEN 'rate_limited' WHEN status BETWEEN 200 AND 299 THEN NULL ELSE 'reader_failed' END AS error_kind,
 CASE WHEN status = 429 THEN try_cast(retry_after AS BIGINT)::VARCHAR END AS retry_after_s FROM r""")
def reader_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a reader service: Markdown, rate limits with their wait, failures."""
    k = c("event_id")
    status = F.when(k % 5 == 0, 429).when(k % 5 == 1, 200).when(k % 5 == 2, 404).when(k % 5 == 3, 204)
    d = table(spark, sf_dir, "events").select("event_id", status.alias("status"), F.when(k % 10 == 0, F.lit("7")).when(k % 10 == 5, F.lit("soon")).alias("retry_after"), c("event_type").alias("body"))
    return reader.interpreted(d).select("event_id", "markdown", "error_kind", c("retry_after_s").cast("string").alias("retry_after_s"))


@query("""SELECT event_type, median(value) AS middle, min(value) AS least, count(*) AS n FROM events GROUP BY 1""")
def sample_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and least of samples, as a benchmark reports them."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.median("value").alias("middle"), F.min("value").alias("least"), F.count(F.lit(1)).alias("n"))


@query("""
WITH h AS (SELECT user_id AS query_id, event_id, 'https://d.test/' || event_id % 7 AS url FROM events WHERE event_id % 11 <> 0),
f AS (SELECT query_id, url, min(event_id) AS first FROM h GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS k FROM f), n AS (SELECT user_id AS query_id, count(*) AS total FROM events GROUP BY 1)
SELECT r.query_id, k::INT AS place, url, total > (SELECT count(*) FROM r x WHERE x.query_id = r.query_id AND x.k <= 5) AS truncated FROM r JOIN n ON n.query_id = r.query_id WHERE k <= 5""")
def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tool hands on: one row for each URL, rows without one left out, five at most, and whether some are missing."""
    k = c("event_id")
    d = table(spark, sf_dir, "events").select(c("user_id").alias("query_id"), k.alias("rn"), F.when(k % 11 != 0, text_of("https://d.test/", k % 7)).alias("url"))
    return route.tool_rows(d, 5).select("query_id", "place", "url", "truncated")


@query("""
SELECT n_nationkey AS id, n_nationkey // 10 > 1 OR n_nationkey // 10 = 1 AND n_nationkey % 10 > 2 AS newer, sha256(n_name) = sha256(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'x' END) AS intact FROM nation""")
def release_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a release is newer than 1.2.0, and whether its bytes have the sum that goes with it."""
    k, name = c("n_nationkey"), c("n_name")
    version = text_of("v", F.floor(k / 10), ".", k % 10, ".0")
    return table(spark, sf_dir, "nation").select(k.alias("id"), sql.newer(version, "1.2.0").alias("newer"), sql.intact(name, F.upper(F.sha2(F.when(k % 2 == 0, name).otherwise("x"), 256))).alias("intact"))


@query("""
WITH u AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'http://10.0.0.' || event_id % 200 || '/' WHEN 1 THEN 'https://e.test:6667/' WHEN 2 THEN 'ftp://e.test/' WHEN 3 THEN 'nothing' WHEN 4 THEN 'http://localhost/' WHEN 5 THEN 'http://[::1]/' ELSE 'https://e.test/' || event_id END AS url FROM events)
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'ssrf_blocked' WHEN 1 THEN 'bad_port' WHEN 2 THEN 'bad_scheme' WHEN 3 THEN 'invalid_url' WHEN 4 THEN 'ssrf_blocked' WHEN 5 THEN 'ssrf_blocked' END AS tag FROM u""")
def error_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of what keeps addresses from being read."""
    k = c("event_id")
    url = F.when(k % 7 == 0, text_of("http://10.0.0.", k % 200, "/"))
    for i, x in enumerate(("https://e.test:6667/", "ftp://e.test/", "nothing", "http://localhost/", "http://[::1]/"), 1):
        url = url.when(k % 7 == i, F.lit(x))
    return table(spark, sf_dir, "events").select("event_id", errors.tag(urls.guard_error(url.otherwise(text_of("https://e.test/", k)))).alias("tag"))


def spec_template(spec: json_replies.Spec) -> str:
    """A reply in which each field of a spec has a mark of its own, and a second item without anything."""

    def put(tree: object, path: str, value: str) -> object:
        head, _, rest = path.partition(".")
        if head.isdigit():
            return [put(None, rest, value) if rest else value]
        own = dict(tree or {})
        own[head] = put(own.get(head), rest, value) if rest else value
        return own

    item: object = None
    for mark, f in (("@T", spec.title), ("@U", spec.url), ("@S", spec.snippet), ("@P", spec.thumbnail), ("@D", spec.date), *((f"@M{k}", f) for k, f in spec.metadata.items())):
        if f and (f.path != spec.url.path or mark == "@U"):  # one path may fill two fields
            item = put(item, f.path, mark)
    return json.dumps([item, {}, item] if spec.results is None else put(None, spec.results, [item, {}, item]))


#: Engine names in order, and the marks that each fills.
_ENGINES = sorted(json_replies.SPECS)
_SHAPES = [(k, n, s.url.prefix, *(bool(f and f.path != s.url.path) for f in (s.title, s.snippet, s.thumbnail, s.date)), s.title.path == s.url.path) for k, n in enumerate(_ENGINES) for s in (json_replies.SPECS[n],)]


@query(f"""
WITH s(k, engine, prefix, title, snippet, thumb, dated, same) AS (VALUES {", ".join(repr(x).replace("True", "true").replace("False", "false") for x in _SHAPES)}),
e AS (SELECT event_id, event_type, s.* FROM events JOIN s ON event_id % {len(_ENGINES)} = s.k)
SELECT event_id AS query_id, engine, r AS rank, CASE WHEN same THEN 'u' || event_id WHEN title THEN 'about ' || event_type ELSE '' END AS title, prefix || 'u' || event_id AS url, CASE WHEN snippet THEN 'of ' || event_type ELSE '' END AS snippet,
 CASE WHEN dated THEN event_id::VARCHAR END AS published_date, CASE WHEN thumb THEN 'https://i.test/' || event_type END AS thumbnail_url FROM e, (VALUES (1::INT), (2)) AS t(r)""")
def registry_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of all engines that specs describe, an event each, by the specs as rows of one table."""
    shapes = spark.createDataFrame([(k, n, spec_template(json_replies.SPECS[n])) for k, n in enumerate(_ENGINES)], "k long, engine string, template string")
    d = table(spark, sf_dir, "events").join(F.broadcast(shapes), c("event_id") % len(_ENGINES) == c("k"))
    payload = c("template")
    for mark, value in (("@T", text_of(" about ", c("event_type"))), ("@U", text_of("u", c("event_id"))), ("@S", text_of("of ", c("event_type"))), ("@P", text_of("https://i.test/", c("event_type"))), ('"@D"', c("event_id").cast("string"))):
        payload = F.replace(payload, F.lit(mark), value)
    hits = spec_rows.extract(d.select(c("event_id").alias("query_id"), "engine", payload.alias("payload")), spec_rows.known(spark))
    return hits.select("query_id", "engine", "rank", "title", "url", "snippet", "published_date", "thumbnail_url")
