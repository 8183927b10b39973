"""The registered queries of the engine, each next to the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bangs, hardening, htmlclean, kinds, spa, text, urls
from ..operators import cache, fuse, ladder, quota, registry, render, route
from ..sources import families, feeds, html_replies, json_replies, pages as page_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table."""
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple], names: str) -> str:
    """The same table for the oracle."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, (int, float)):
            return str(x)
        if isinstance(x, list):
            return "[" + ", ".join(map(one, x)) + "]" if x else "[]::VARCHAR[]"
        return "'" + str(x).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


# --- URLs ---------------------------------------------------------------------------------------

_URL = r"'^(?i)(https?)://([^/?#\s]+)([^?#]*)(\?[^#]*)?'"


def canon_sql(u: str) -> str:
    """SQL for the canonical form of a URL."""
    p = lambda k: f"regexp_extract(trim({u}), {_URL}, {k})"
    drop = "[" + ", ".join(f"'{t}'" for t in urls.TRACKING) + "]"
    host = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({p(2)}), '^[^@]*@', ''), CASE WHEN lower({p(1)}) = 'http' THEN ':80$' ELSE ':443$' END, ''), ':$', ''), '^www\\.', '')"
    path = f"CASE WHEN {p(3)} = '' THEN '/' ELSE {p(3)} END"
    coded = lambda v: f"replace(replace(replace(url_encode(url_decode(replace({v}, '+', ' '))), '%20', '+'), '~', '%7E'), '%2A', '*')"
    q = f"array_to_string(list_transform(list_filter(string_split(substr({p(4)}, 2), '&'), lambda x: x <> '' AND NOT list_contains({drop}, lower(split_part(x, '=', 1)))), lambda x: {coded("split_part(x, '=', 1)")} || '=' || {coded("regexp_extract(x, '=(.*)$', 1)")}), '&')"
    return f"CASE WHEN {p(1)} <> '' THEN 'https://' || {host} || CASE WHEN {q} = '' THEN regexp_replace({path}, '/$', '') ELSE {path} || '?' || {q} END END"


@query(f"SELECT page_id, {canon_sql('url')} AS canonical FROM pages")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form of every page's address."""
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT canonical, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, {canon_sql('url')} AS canonical FROM pages) GROUP BY 1")
def url_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each canonical address."""
    d = canonical_urls(spark, sf_dir)
    return d.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query(f"""
WITH p AS (SELECT page_id, regexp_extract(trim(url), {_URL}, 3) AS path, regexp_replace(lower(regexp_extract(trim(url), {_URL}, 2)), ':\\d*$', '') AS host FROM pages)
SELECT page_id, host, coalesce(list_filter(string_split(path, '/'), lambda s: s <> '')[-1], host) AS title FROM p""")
def url_parts_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and fallback title of every page."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host_of(u).alias("host"), urls.fallback_title(u).alias("title"))


GUARDED = [
    (1, "http://169.254.169.254/latest/meta-data"), (2, "http://127.0.0.1:8080/x"), (3, "http://localhost/admin"), (4, "file:///etc/passwd"), (5, "http://example.org:22/"), (6, "https://example.org/page"),
    (7, "http://[::1]/"), (8, "http://api.localhost/"), (9, "http://10.1.2.3/"), (10, "http://172.32.0.1/"), (11, "http://172.31.255.255/"), (12, "https://user@192.168.0.9/"), (13, "http://8.8.8.8/"), (14, "http://example.org:6667/"), (15, "ftp://example.org/"), (16, "https://100.64.0.1/"),
    (17, "http://[2606:4700::1111]/"), (18, "https://[::ffff:8.8.8.8]/x"), (19, "http://[fe80::1]:8080/"), (20, "http://[64:ff9b::808:808]/"), (21, "http://[1::2::3]/"), (22, "http://[fd00:1:2:3:4:5:6:7]/"), (23, "https:///x"), (24, "no url at all"), (25, "JavaScript:void(0)"),
    (26, "http://2130706433/"), (27, "http://0x7f.1/"), (28, "http://127.1:81/x"), (29, "http://0177.0.0.1/"), (30, "http://127.0.0.1./"), (31, "http://localhost./"), (32, "http://134744072/"), (33, "http://0x8080808/"), (34, "http://1.2.3.4.5/"), (35, "http://256.1.1.1/"), (36, "http://name.08/"), (37, "http://0x/"),
    (38, "http://u:p@0300.0250.1/"), (39, "http://[64:ff9b::7f00:1]/"), (40, "http://[2002:a00:1::]/"), (41, "http://[2002:808:808::]/"), (42, "http://4294967296/"), (43, "http://x.1e5/"),
]
_V4 = r"'^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$'"


def blocked_sql(ip: str) -> str:
    """SQL for whether an IPv4 text is not public; null where it is no address."""
    import ipaddress

    o = [f"TRY_CAST(regexp_extract({ip}, {_V4}, {k}) AS BIGINT)" for k in range(1, 5)]
    n = f"({o[0]} * 16777216 + {o[1]} * 65536 + {o[2]} * 256 + {o[3]})"
    nets = [ipaddress.ip_network(x) for x in urls.BLOCKED_V4]
    tests = " OR ".join(f"{n} BETWEEN {int(x.network_address)} AND {int(x.broadcast_address)}" for x in nets)
    return f"CASE WHEN {' AND '.join(f'{x} <= 255' for x in o)} THEN {tests} END"


def blocked_v6_sql(ip: str) -> str:
    """SQL for whether an IPv6 text is not public; null where it is no address."""
    import ipaddress

    x = f"regexp_replace(regexp_replace(lower({ip}), '^\\\\[(.*)\\\\]$', '\\\\1'), '%.*$', '')".replace("\\\\", "\\")
    octet = lambda k: f"try_cast(string_split(regexp_extract({x}, ':([0-9.]+)$', 1), '.')[{k}] AS BIGINT)"
    tail = f"regexp_extract({x}, ':([0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}})$', 1)"
    fine = " AND ".join(f"{octet(k)} <= 255" for k in range(1, 5))
    whole = f"CASE WHEN {tail} = '' THEN {x} WHEN {fine} THEN left({x}, (length({x}) - length({tail}))::INT) || printf('%x:%x', ({octet(1)} * 256 + {octet(2)})::INT, ({octet(3)} * 256 + {octet(4)})::INT) END"
    half = lambda k: f"(CASE WHEN coalesce(string_split(w, '::')[{k}], '') = '' THEN []::VARCHAR[] ELSE string_split(string_split(w, '::')[{k}], ':') END)"
    every = f"(CASE WHEN len(string_split(w, '::')) = 1 THEN string_split(w, ':') WHEN len(string_split(w, '::')) = 2 AND len({half(1)}) + len({half(2)}) <= 7 THEN {half(1)} || list_transform(range(8 - len({half(1)}) - len({half(2)})), lambda z: '0') || {half(2)} END)"
    bits = f"list_reduce(list_transform({every}, lambda g: lpad(to_binary(('0x' || g)::BIGINT), 16, '0')), lambda a, b: a || b)"
    nets = [ipaddress.ip_network(n) for n in (*urls.BLOCKED_V6, *urls.CARRIED_V6)]
    tests = " OR ".join(f"starts_with(b, '{int(n.network_address):0128b}'[1:{n.prefixlen}])" for n in nets)
    return f"(SELECT {tests} FROM (SELECT {bits} AS b FROM (SELECT {whole} AS w) WHERE len({every}) = 8 AND len(list_filter({every}, lambda g: NOT regexp_full_match(g, '[0-9a-f]{{1,4}}'))) = 0))"


_GUARD = f"""
WITH all_urls AS (SELECT id, url FROM {values_sql(GUARDED, 'id, url')} UNION ALL SELECT 1000 + page_id, url FROM pages),
p AS (SELECT id, url, regexp_extract(trim(url), {_URL}, 1) AS scheme, regexp_extract(trim(url), {_URL}, 2) AS auth FROM all_urls),
g AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(auth), '^[^@]*@', ''), ':\\d*$', ''), '^\\[(.*)\\]$', '\\1') AS raw, TRY_CAST(regexp_extract(auth, ':(\\d+)$', 1) AS INT) AS port FROM p),
n AS (SELECT *, rtrim(raw, '.') AS bare, NOT contains(auth, '[') AND regexp_matches(raw, '(^|\\.)(0x[0-9a-f]*|[0-9]+)\\.?$') AS numbered FROM g),
v AS (SELECT *, CASE WHEN numbered AND regexp_full_match(bare, '((0x[0-9a-f]*|0[0-7]*|[1-9][0-9]*)\\.){{0,3}}(0x[0-9a-f]*|0[0-7]*|[1-9][0-9]*)') THEN
  list_transform(string_split(bare, '.'), lambda x: CASE WHEN x = '0x' THEN 0 WHEN starts_with(x, '0x') THEN x::BIGINT WHEN starts_with(x, '0') THEN list_reduce(list_transform(string_split(x, ''), lambda d: d::BIGINT), lambda a, d: a * 8 + d) ELSE x::BIGINT END) END AS vs FROM n),
t AS (SELECT *, CASE WHEN len(list_filter(vs[:-2], lambda x: x > 255)) = 0 AND vs[-1] < power(256, 5 - len(vs)) THEN vs[-1] + coalesce(list_sum(list_transform(vs[:-2], lambda x, i: x * power(256, 4 - i)::BIGINT)), 0)::BIGINT END AS num FROM v),
h AS (SELECT *, CASE WHEN NOT numbered THEN bare WHEN num IS NOT NULL THEN concat_ws('.', num // 16777216, num // 65536 % 256, num // 256 % 256, num % 256) END AS host FROM t)
SELECT id::BIGINT AS id, CASE WHEN scheme = '' AND regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(lower(trim(url)), '^https?:') THEN 'bad_scheme' WHEN scheme = '' THEN 'invalid_url' WHEN port IN ({', '.join(map(str, urls.BAD_PORTS))}) THEN 'blocked_port' WHEN host IS NULL THEN 'invalid_url' WHEN host = 'localhost' OR host LIKE '%.localhost' THEN 'blocked_host'
 WHEN coalesce({blocked_sql('host')}, CASE WHEN contains(auth, '[') THEN coalesce({blocked_v6_sql('host')}, true) ELSE false END) THEN 'blocked_address' END AS error FROM h"""


@query(_GUARD)
def ssrf_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why addresses must not be fetched: fixed hostile ones and all pages."""
    d = literals(spark, GUARDED, "id long, url string").union(table(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("id"), "url"))
    return d.select("id", urls.guard_error(F.col("url")).alias("error"))


IPS = [(f"{a}.{b}.{c}.{d}",) for a in (0, 8, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 255, 256) for b, c, d in ((0, 0, 0), (16, 0, 1), (18, 0, 1), (31, 255, 255), (32, 0, 1), (51, 100, 7), (64, 0, 1), (168, 1, 1), (254, 1, 1), (0, 2, 9), (0, 113, 3))]


@query(f"""SELECT ip, {blocked_sql('ip')} AS blocked FROM (SELECT ip FROM {values_sql(IPS, 'ip')}
 UNION ALL SELECT concat_ws('.', event_id * 7919 % 257, event_id * 104729 % 256, user_id % 256, event_id % 256) FROM events)""")
def ip_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which IPv4 addresses of a grid, and of an address for each event, are not public."""
    k = F.col("event_id")
    own = table(spark, sf_dir, "events").select(F.concat_ws(".", *[x.cast("string") for x in (k * 7919 % 257, k * 104729 % 256, F.col("user_id") % 256, k % 256)]).alias("ip"))
    return literals(spark, IPS, "ip string").union(own).select("ip", urls.ipv4_blocked(F.col("ip")).alias("blocked"))


IPS6 = [(x,) for x in ("::", "::1", "::2:3", "::ffff:1.2.3.4", "::8.8.8.8", "[fe80::1]", "febf::", "fec0::1", "fe80::1%eth0", "fc00::", "fdff:1:2:3:4:5:6:7", "fe00::1", "ff02::1", "100::1", "100:0:0:1::", "2001:db8::5", "2001:DB8:ffff::", "2001:db9::", "2606:4700::1111", "64:ff9b::1.2.3.4", "64:ff9b:1::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "12345::", "::1.2.3.256", ":::", "x", "8.8.8.8")]


HEADS6 = ["fe80", "fc12", "2001:db8", "2606:4700", "64:ff9b:0:0:0:0", "2002:a00", "2002:808", "::ffff", "ff02", "1:2:3:4:5:6"]


@query(f"""SELECT ip, {blocked_v6_sql('ip')} AS blocked FROM (SELECT ip FROM {values_sql(IPS6, 'ip')}
 UNION ALL SELECT h || CASE WHEN len(string_split(h, ':')) = 6 OR h = '::ffff' THEN ':' ELSE '::' END || printf('%x', event_id * 7919 % 65536) || ':' || printf('%x', user_id) FROM events JOIN (SELECT unnest({HEADS6}) AS h, unnest(range(0, {len(HEADS6)})) AS i) ON i = event_id % {len(HEADS6)})""")
def ip_blocklist_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which IPv6 addresses are not public, fixed ones and one for each event; null for what is no such address."""
    k = F.col("event_id")
    heads = F.array(*[F.lit(h + (":" if h.count(":") == 5 or h == "::ffff" else "::")) for h in HEADS6])
    own = table(spark, sf_dir, "events").select(F.concat(F.get(heads, (k % len(HEADS6)).cast("int")), F.lower(F.hex(k * 7919 % 65536)), F.lit(":"), F.lower(F.hex("user_id"))).alias("ip"))
    return literals(spark, IPS6, "ip string").union(own).select("ip", urls.ipv6_blocked(F.col("ip")).alias("blocked"))


HREFS = [(1, "/l/?uddg=https%3A%2F%2Fexample.org%2Fa&rut=1"), (2, "//example.org/x"), (3, "/about"), (4, "https://example.org/direct"), (5, "/l/?kh=1&uddg=http%3A%2F%2Fb.test%2F%3Fq%3D1")]


@query(f"""SELECT id::BIGINT AS id, CASE WHEN regexp_extract(href, '[?&]uddg=([^&]*)', 1) LIKE 'http%' THEN url_decode(regexp_extract(href, '[?&]uddg=([^&]*)', 1))
 WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN 'https://duckduckgo.com' || href ELSE href END AS target FROM {values_sql(HREFS, 'id, href')}
 UNION ALL SELECT 1000 + page_id, CASE page_id % 4 WHEN 3 THEN regexp_replace(url, '^http:', 'https:') ELSE url END FROM pages""")
def redirect_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of wrapped, relative and direct links: fixed ones and those of all pages, wrapped, direct or without a scheme."""
    k, url = F.col("page_id"), F.col("url")
    href = F.when(k % 4 == 0, F.concat(F.lit("/l/?uddg="), F.url_encode(url), F.lit("&rut="), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("//l.test/l/?kh=1&uddg="), F.url_encode(url))).when(k % 4 == 2, url).otherwise(F.regexp_replace(url, "^https?:", ""))
    d = literals(spark, HREFS, "id long, href string").union(table(spark, sf_dir, "pages").select((k + 1000).alias("id"), href))
    return d.select("id", urls.unwrap_redirect(F.col("href")).alias("target"))


@query("""
SELECT item_id, replace(replace(replace(replace(replace('https://s.test/?q={query}&raw={query_raw}&p={page}&n={page1}&l={locale}', '{query_raw}', text), '{query}', url_encode(text)), '{page}', '1'), '{page1}', '2'), '{locale}', 'en-US') AS request FROM benchmark""")
def request_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests rendered from a template for every benchmark text."""
    q = F.col("text")
    t = F.lit("https://s.test/?q={query}&raw={query_raw}&p={page}&n={page1}&l={locale}")
    return table(spark, sf_dir, "benchmark").select("item_id", urls.render_template(t, q, F.lit(2), F.lit("en-US"), F.lit(1), F.lit(None).cast("string")).alias("request"))


# --- queries and engines ------------------------------------------------------------------------

#: A small registry: ties in weight, disabled, unimplemented and instant engines, two categories.
ENGINES = [
    ("alpha", "al", "json_engine", ["general"], True, 2.0, True), ("beta", "be", "css_engine", ["general", "news"], True, 1.0, True), ("gamma", "ga", "json_engine", ["general"], True, 1.0, True),
    ("delta", "de", "xpath", ["general"], False, 5.0, True), ("eps", "ep", "json_engine", ["science", "it"], True, 1.0, False), ("zeta", "ze", "currency_convert", ["general"], True, 100.0, True),
    ("eta", "et", "json_engine", ["it"], True, 0.5, True), ("theta", "th", "json_engine", ["it", "science"], True, 1.5, True), ("iota", "io", "translated", ["general"], True, 100.0, True),
    ("kappa", "ka", "json_engine", ["images"], True, 1.0, True), ("lambda", "la", "css_engine", ["videos"], False, 1.0, False), ("mu", "mu", "json_engine", ["news"], True, 3.0, True),
]
_ENGINES_SQL = f"""(SELECT * FROM {values_sql(ENGINES, "name, bang, family, categories, enabled, weight, implemented")} UNION ALL
 SELECT lower(n_name), 'n' || n_nationkey, ['json_engine', 'css_engine', 'xpath', 'tineye'][1 + n_nationkey % 4], CASE WHEN n_nationkey % 5 = 0 THEN ['it', 'news'] ELSE [['general', 'science', 'files'][1 + n_nationkey % 3]] END, n_nationkey % 7 <> 0, (n_nationkey % 6) / 2.0::DOUBLE, n_nationkey % 8 <> 3 FROM nation) AS t"""


def engine_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry: the small one, and an engine for each nation."""
    fixed = literals(spark, ENGINES, "name string, bang string, family string, categories array<string>, enabled boolean, weight double, implemented boolean")
    k = F.col("n_nationkey")
    pick = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    cats = F.when(k % 5 == 0, F.array(F.lit("it"), F.lit("news"))).otherwise(F.array(pick(("general", "science", "files"), k % 3)))
    own = table(spark, sf_dir, "nation").select(F.lower("n_name"), F.concat(F.lit("n"), k.cast("string")), pick(("json_engine", "css_engine", "xpath", "tineye"), k % 4), cats, k % 7 != 0, k % 6 / 2, k % 8 != 3)
    return fixed.union(own)


_ASKED = "CASE conv_id % 4 WHEN 0 THEN '!al ' || text WHEN 1 THEN text || ' !IT !th' WHEN 2 THEN '!zz !! ' || text || ' !be !ga !al' ELSE '!news ' || text END"
_TOKENS = f"SELECT conv_id AS query_id, list_filter(regexp_split_to_array({_ASKED}, '\\s+'), lambda t: t <> '') AS ts FROM conversations WHERE turn = 0"
_PARSED = f"SELECT query_id, array_to_string(list_filter(ts, lambda t: NOT regexp_full_match(t, '!+[A-Za-z0-9_]+')), ' ') AS clean_query, list_transform(list_filter(ts, lambda t: regexp_full_match(t, '!+[A-Za-z0-9_]+')), lambda t: lower(regexp_replace(t, '^!+', ''))) AS bangs FROM ({_TOKENS})"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns of conversations with shortcuts put in."""
    short = F.col("text")
    q = (
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("!al "), short))
        .when(F.col("conv_id") % 4 == 1, F.concat(short, F.lit(" !IT !th")))
        .when(F.col("conv_id") % 4 == 2, F.concat(F.lit("!zz !! "), short, F.lit(" !be !ga !al")))
        .otherwise(F.concat(F.lit("!news "), short))
    )
    return table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), bangs.parse_bangs(q).alias("p")).select("query_id", "p.*")


@query(f"SELECT query_id, clean_query, array_to_string(bangs, ',') AS bangs FROM ({_PARSED})")
def bang_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortcuts and clean query of every first turn."""
    return asked(spark, sf_dir).withColumn("bangs", F.array_join("bangs", ","))


_CATS = ", ".join(f"'{c}'" for c in bangs.CATEGORIES)


@query(f"""
WITH b AS (SELECT query_id, unnest(bangs) AS bang, generate_subscripts(bangs, 1) AS pos FROM ({_PARSED})),
j AS (SELECT b.query_id, pos, CASE WHEN b.bang IN ({_CATS}) THEN b.bang END AS cat, CASE WHEN b.bang NOT IN ({_CATS}) THEN e.name END AS engine, e.categories[1] AS ecat FROM b LEFT JOIN {_ENGINES_SQL.replace(') AS t', ') AS e')} ON b.bang = e.bang),
f AS (SELECT query_id, coalesce(string_agg(engine, ',' ORDER BY pos), '') AS engines, arg_max(cat, pos) FILTER (cat IS NOT NULL) AS last_cat, arg_min(ecat, pos) FILTER (engine IS NOT NULL) AS first_ecat FROM j GROUP BY query_id)
SELECT p.query_id, coalesce(engines, '') AS engines, coalesce(last_cat, first_ecat) AS category FROM ({_PARSED}) p LEFT JOIN f ON f.query_id = p.query_id""")
def bang_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines and category that the shortcuts of each query choose."""
    out = bangs.resolve_bangs(asked(spark, sf_dir), engine_table(spark, sf_dir))
    return out.withColumn("engines", F.array_join("engines", ","))


SEARCHES = [(1, "general", [], None), (2, "it", ["theta", "nope", "eps"], None), (3, "news", ["nope"], None), (4, "general", ["mu", "alpha", "mu"], 1), (5, "general", [], 2), (6, "science", ["zeta"], None)]
_SEARCHED = f"""SELECT * FROM {values_sql(SEARCHES, 'query_id, category, engines, max_engines')} UNION ALL
 SELECT 1000 + conv_id, ['general', 'it', 'news', 'science', 'files'][1 + conv_id % 5], CASE conv_id % 3 WHEN 0 THEN ['nation_' || conv_id % 30, 'mu'] ELSE []::VARCHAR[] END, CASE WHEN conv_id % 2 = 0 THEN 3 END FROM conversations WHERE turn = 0"""


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed searches and one for each conversation."""
    k = F.col("conv_id")
    cat = F.get(F.array(*[F.lit(x) for x in ("general", "it", "news", "science", "files")]), (k % 5).cast("int"))
    named = F.when(k % 3 == 0, F.array(F.concat(F.lit("nation_"), (k % 30).cast("string")), F.lit("mu"))).otherwise(F.array().cast("array<string>"))
    own = table(spark, sf_dir, "conversations").where("turn = 0").select(k + 1000, cat, named, F.when(k % 2 == 0, 3))
    return literals(spark, SEARCHES, "query_id long, category string, engines array<string>, max_engines int").union(own)


@query(f"""
WITH q AS ({_SEARCHED}), e AS (SELECT * FROM {_ENGINES_SQL}),
n AS (SELECT query_id, engine, min(pos) AS pos FROM (SELECT query_id, unnest(engines) AS engine, generate_subscripts(engines, 1) AS pos FROM q) GROUP BY ALL),
u AS (SELECT n.query_id, n.engine, 0.0 AS w, pos, '' AS nm, false AS by_category FROM n JOIN e ON e.name = n.engine AND e.implemented),
c AS (SELECT q.query_id, e.name, -e.weight, 0, e.name, true FROM q JOIN e ON list_contains(e.categories, q.category) AND e.implemented AND e.enabled AND e.family NOT IN ('currency_convert', 'translated', 'lingva', 'dictzone', 'tineye', 'mozhi') WHERE q.query_id NOT IN (SELECT query_id FROM u)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w, pos, nm) - 1 AS engine_ord FROM (SELECT * FROM u UNION ALL SELECT * FROM c))
SELECT r.query_id::BIGINT AS query_id, engine, engine_ord::INT AS engine_ord, by_category FROM r JOIN q ON q.query_id = r.query_id WHERE engine_ord < coalesce(max_engines, 12)""")
def engine_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines that each search uses, in order."""
    q = searches(spark, sf_dir)
    return registry.select_engines(q, engine_table(spark, sf_dir))[0]


@query(f"""
WITH q AS ({_SEARCHED}), e AS (SELECT * FROM {_ENGINES_SQL}),
n AS (SELECT DISTINCT query_id, unnest(engines) AS engine FROM q)
SELECT query_id::BIGINT AS query_id, engine, CASE WHEN e.name IS NULL THEN 'unknown engine' ELSE 'engine not implemented' END AS error FROM n LEFT JOIN e ON e.name = n.engine WHERE e.name IS NULL OR NOT implemented""")
def engine_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named engines that can't be used."""
    q = searches(spark, sf_dir)
    return registry.select_engines(q, engine_table(spark, sf_dir))[1].drop("is_rate_limited")


@query(f"SELECT category, count(*) AS n, count_if(enabled)::BIGINT AS n_enabled, count_if(implemented)::BIGINT AS n_implemented FROM (SELECT unnest(categories) AS category, enabled, implemented FROM {_ENGINES_SQL}) GROUP BY 1")
def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines of each category."""
    return registry.category_counts(engine_table(spark, sf_dir))


def _engine_tables() -> str:
    """The small registry as Markdown tables, one for each category."""
    out = ["# Engines", "| not | a | table |"]
    for cat in dict.fromkeys(c for e in ENGINES for c in e[3]):
        out += [f"### Tab `!{cat}`", "| Engine | !bang | Module family | Default | Timeout | Weight | Paging | Locale | Safe | Range | Wave |", "|---|---|---|---|---|---|---|---|---|---|---|"]
        out += [f"| {name.upper()} (DE) | `!{bang}` | `{family}` | {'on' if on else 'off'} | 2.5 | {weight} | {'✓' if weight > 1 else '—'} | n/a | — | ✓ | 2 |" for name, bang, family, cats, on, weight, _ in ENGINES if cat in cats]
    return "\n".join(out)


@query(f"SELECT name, upper(name) || ' (DE)' AS display, bang, family, enabled, 2500::BIGINT AS timeout_ms, weight, weight > 1 AS paging, false AS locale, true AS time_range, 2 AS wave, array_to_string(list_sort(categories), ',') AS categories FROM {_ENGINES_SQL}")
def registry_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows read back from Markdown tables, engines of several tables merged."""
    head = "| Engine | !bang | Module family | Default | Timeout | Weight | Paging | Locale | Safe | Range | Wave |\n|---|---|---|---|---|---|---|---|---|---|---|"
    e = engine_table(spark, sf_dir).where("bang RLIKE '^n[0-9]+$'")
    row = F.concat(F.lit("| "), F.upper("name"), F.lit(" (DE) | `!"), "bang", F.lit("` | `"), "family", F.lit("` | "), F.when(F.col("enabled"), F.lit("on")).otherwise("off"), F.lit(" | 2.5 | "), F.col("weight").cast("string"), F.lit(" | "), F.when(F.col("weight") > 1, F.lit("✓")).otherwise("—"), F.lit(" | n/a | — | ✓ | 2 |"))
    tabs = F.array_join(F.transform("categories", lambda c: F.concat(F.lit("### Tab `!"), c, F.lit(f"`\n{head}\n"), row)), "\n")
    own = e.select((F.substr("bang", F.lit(2)).cast("long") + 2).alias("doc"), tabs.alias("text"))
    d = registry.from_tables(literals(spark, [(1, _engine_tables())], "doc long, text string").union(own))
    return d.select("name", "display", "bang", "family", "enabled", "timeout_ms", "weight", "paging", "locale", "time_range", "wave", F.array_join(F.array_sort("categories"), ",").alias("categories"))


@query(f"""SELECT * FROM (SELECT (i - 1)::INT AS ord, cats[i] AS bang, cats[i] AS target, 'category' AS kind FROM (SELECT [{_CATS}] AS cats), range(1, {len(bangs.CATEGORIES) + 1}) AS r(i)
 UNION ALL SELECT {len(bangs.CATEGORIES)}, bang, name, 'engine' FROM {_ENGINES_SQL}) WHERE contains(bang, 'e') OR contains(lower(target), 'e')""")
def bang_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortcuts with an e in them or in their target."""
    return registry.bang_listing(engine_table(spark, sf_dir), "E")


@query(f"SELECT name, CASE name WHEN 'delta' THEN true WHEN 'mu' THEN false ELSE enabled END AS enabled FROM {_ENGINES_SQL}")
def engine_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with two engines switched."""
    return registry.switched(engine_table(spark, sf_dir), {"delta": True, "mu": False}).select("name", "enabled")


# --- fusion -------------------------------------------------------------------------------------

TOKENS = [(1, "the"), (2, "ing"), (3, "que"), (4, "sch"), (5, "zz")]
TOP = 50


def page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of three rankers over the pages: occurrences of the query's token, length, newest id; 50 each.

    Counting is one pass over the pages.  Ranks keep 50 rows of a query before
    the shuffle; titles are made for the hits only, which are bounded.
    """
    p = table(spark, sf_dir, "pages")
    counts = F.array(*[F.struct(F.lit(q).alias("query_id"), F.regexp_count("html", F.lit(t)).alias("score")) for q, t in TOKENS])
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id"))
    kw = p.select("page_id", F.explode(counts).alias("c")).select("c.query_id", "page_id", "c.score").withColumn("rank", top).where(F.col("rank") <= TOP)
    kw = kw.select("query_id", F.lit("kw").alias("engine"), F.lit(0).alias("engine_ord"), "rank", "page_id")
    ids = F.explode(F.array(*[F.lit(q) for q, _ in TOKENS])).alias("query_id")
    place = F.row_number().over(Window.orderBy(F.desc("s"), "page_id"))
    every = [kw]
    for k, (name, s) in enumerate((("len", F.char_length("html")), ("fresh", F.col("page_id"))), 1):
        best = p.select("page_id", s.alias("s")).orderBy(F.desc("s"), "page_id").limit(TOP).withColumn("rank", place)
        every.append(best.select(ids, F.lit(name).alias("engine"), F.lit(k).alias("engine_ord"), "rank", "page_id"))
    hits = every[0].union(every[1]).union(every[2])
    title = F.coalesce(htmlclean.title_of(F.col("html")), F.lit(""))
    return p.join(F.broadcast(hits), "page_id").select("query_id", "engine", "engine_ord", "rank", title.alias("title"), "url", F.substring(title, 1, 200).alias("snippet"))


_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g'))"
_HITS = f"""
t AS (SELECT * FROM {values_sql(TOKENS, 'query_id, token')}),
kw AS (SELECT query_id, 'kw' AS engine, 0 AS eo, page_id, row_number() OVER (PARTITION BY query_id ORDER BY len(regexp_extract_all(html, token)) DESC, page_id) AS rank FROM pages, t),
ln AS (SELECT query_id, 'len' AS engine, 1 AS eo, page_id, row_number() OVER (PARTITION BY query_id ORDER BY length(html) DESC, page_id) AS rank FROM pages, t),
fr AS (SELECT query_id, 'fresh' AS engine, 2 AS eo, page_id, row_number() OVER (PARTITION BY query_id ORDER BY page_id DESC) AS rank FROM pages, t),
hits AS (SELECT x.*, url, {_TITLE} AS title, left({_TITLE}, 200) AS snippet FROM (SELECT * FROM kw UNION ALL SELECT * FROM ln UNION ALL SELECT * FROM fr) x JOIN pages p ON p.page_id = x.page_id WHERE rank <= 50)"""


def fuse_sql(hits: str, weight: str = "1.0", limit: int = 10) -> str:
    """SQL for a fusion of ``hits`` (a list of CTEs that ends with one of that name)."""
    return f"""
WITH {hits},
h AS (SELECT *, coalesce({canon_sql('url')}, 'nourl:' || title) AS k, {weight} / (60 + rank) AS w FROM hits),
g AS (SELECT query_id, k, list_reduce(list_prepend(0.0::DOUBLE, list(w::DOUBLE ORDER BY eo, rank)), lambda a, x: a + x) AS total, list(engine ORDER BY eo, rank) AS es, arg_max(title, {{'l': strlen(title), 'e': -eo, 'r': -rank}}) AS title,
 arg_max(snippet, {{'l': strlen(snippet), 'e': -eo, 'r': -rank}}) AS snippet, arg_min(url, {{'e': eo, 'r': rank}}) AS url, min({{'e': eo, 'r': rank}}) AS seen FROM h GROUP BY query_id, k),
s AS (SELECT *, floor(total * 100 + 0.5) / 100 AS score FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rn FROM s)
SELECT query_id::INT AS query_id, rn::INT AS rn, url, title, snippet, score, array_to_string(list_filter(es, lambda x, i: list_position(es, x) = i), ',') AS sources FROM r WHERE rn <= {limit}"""


def _shown(fused: DataFrame) -> DataFrame:
    return fused.select("query_id", "rn", "url", "title", "snippet", "score", F.array_join("sources", ",").alias("sources"))


@query(fuse_sql(_HITS))
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten of each query, fused from three rankers."""
    return _shown(fuse.fuse(page_hits(spark, sf_dir)))


@query(fuse_sql(_HITS, "CASE engine WHEN 'kw' THEN 5.0 WHEN 'fresh' THEN 0.5 ELSE 1.0 END", 25))
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top twenty-five with weights for two rankers."""
    return _shown(fuse.fuse(page_hits(spark, sf_dir), {"kw": 5.0, "fresh": 0.5}, 25))


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
a AS (SELECT vec_id, row_number() OVER (ORDER BY list_sum(list_transform(list_zip(v.embedding::DOUBLE[], q.e), lambda z: z[1] * z[2])) DESC, vec_id) AS rank FROM embeddings v, q),
b AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) AS rank FROM embeddings),
u AS (SELECT vec_id, rank, 0 AS eo FROM a WHERE rank <= 50 UNION ALL SELECT vec_id, rank, 1 FROM b WHERE rank <= 50),
g AS (SELECT vec_id, list_reduce(list_prepend(0.0::DOUBLE, list(1.0::DOUBLE / (60 + rank) ORDER BY eo, rank)), lambda x, y: x + y) AS total, min({'e': eo, 'r': rank}) AS seen FROM u GROUP BY vec_id)
SELECT vec_id::VARCHAR AS title, floor(total * 100 + 0.5) / 100 AS score, row_number() OVER (ORDER BY floor(total * 100 + 0.5) / 100 DESC, seen)::INT AS rn FROM g QUALIFY rn <= 20""")
def rrf_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness to one vector fused with the order of labels."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").agg(F.max("embedding")).first()[0] or []  # the query vector, one row by definition
    q = F.array(*map(F.lit, q)).cast("array<float>")
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    near = v.select("vec_id", (-dot).alias("s"))
    every = []
    for k, d in enumerate((near, v.select("vec_id", F.col("label").cast("double").alias("s")))):
        best = d.orderBy("s", "vec_id").limit(TOP).withColumn("rank", F.row_number().over(Window.orderBy("s", "vec_id")))
        every.append(best.select(F.lit(1).alias("query_id"), F.lit(f"e{k}").alias("engine"), F.lit(k).alias("engine_ord"), "rank", F.col("vec_id").cast("string").alias("title"), F.lit(None).cast("string").alias("url"), F.lit("").alias("snippet")))
    return fuse.fuse(every[0].union(every[1]), limit=20).select("title", "score", "rn")


def _collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fuse.fuse(page_hits(spark, sf_dir)).withColumn("published_date", F.lit(None).cast("string"))
    return f.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", "title", "url", "snippet", "score", "sources", "published_date"))).alias("results"))


_SNIP = r"trim(regexp_replace(snippet, '\s+', ' ', 'g'))"
_ROW_MD = f"""chr(10) || rn || '. [' || regexp_replace(title, '([\\[\\]])', '\\\\\\1', 'g') || '](' || url || ')' || chr(10) || '   - **Engine:** `' || split_part(sources, ',', 1) || '` | **Score:** ' || printf('%.2f', score) || chr(10)
 || CASE WHEN snippet <> '' THEN '   - ' || CASE WHEN length({_SNIP}) > 300 THEN left({_SNIP}, 300) || '…' ELSE {_SNIP} END || chr(10) ELSE '' END"""


@query(f"""
SELECT query_id, '# Search Results: "' || token || '"' || chr(10) || '*Queried 3 engines (fresh, kw, len) in 7ms*' || chr(10) || string_agg({_ROW_MD}, '' ORDER BY rn) || chr(10) || '---' || chr(10) || '*Engine failures:*' || chr(10) || '- `slow`: engine timed out' || chr(10) || '- `busy`: quota (rate limited)' || chr(10) AS md
FROM ({fuse_sql(_HITS)}) JOIN {values_sql(TOKENS, 'tid, token')} ON tid = query_id GROUP BY query_id, token""")
def search_render_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as Markdown."""
    lost = F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(m).alias("error"), F.lit(r).alias("is_rate_limited")) for e, m, r in (("slow", "engine timed out", False), ("busy", "quota", True))])
    names = F.create_map(*[F.lit(x) for q, t in TOKENS for x in (q, f"!al {t}")])
    d = _collected(spark, sf_dir)
    return d.select("query_id", render.search_markdown(names[F.col("query_id")], F.col("results"), F.array(*map(F.lit, ("fresh", "kw", "len"))), lost, F.lit(7)).alias("md"))


@query(f"SELECT query_id, count(*)::INT AS total, true AS has_bang_key, max(score) AS best FROM ({fuse_sql(_HITS)}) GROUP BY 1")
def search_render_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON form of each response says."""
    none = F.array().cast("array<struct<engine:string,error:string,is_rate_limited:boolean>>")
    j = render.search_json(F.lit("q"), F.lit("general"), F.lit(None).cast("string"), F.col("results"), F.array(F.lit("kw")), none, F.lit(7))
    d = _collected(spark, sf_dir).select("query_id", j.alias("j"))
    return d.select("query_id", F.get_json_object("j", "$.total_results").cast("int").alias("total"), F.col("j").contains('"bang":null').alias("has_bang_key"), F.get_json_object("j", "$.results[0].score").cast("double").alias("best"))


# --- text ---------------------------------------------------------------------------------------

_EST = r"CASE WHEN {x} = '' THEN 0 ELSE trunc(length({x})::DOUBLE / 4.0::DOUBLE * 0.6::DOUBLE + len(regexp_extract_all({x}, '\S+'))::DOUBLE * 1.33::DOUBLE * 0.4::DOUBLE) END::BIGINT"


@query(f"SELECT doc_id, {_EST.format(x='text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


_CUT = r"regexp_replace(left(text, {n}), '\s+$', '')"


@query(f"SELECT doc_id, CASE WHEN {_EST.format(x='text')} <= 100 THEN text ELSE {_CUT.format(n=400)} || chr(10) || chr(10) || '[... Remaining ' || greatest(length(text) - 400, 0) || ' characters truncated by token budget ...]' END AS cut FROM documents")
def token_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to a hundred tokens."""
    return table(spark, sf_dir, "documents").select("doc_id", text.cut_to_tokens(F.col("text"), 100).alias("cut"))


@query(f"SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE {_CUT.format(n=1000)} || chr(10) || chr(10) || '[... Remaining ' || format('{{:,}}', length(text) - 1000) || ' characters truncated by token budget ...]' END AS cut FROM documents")
def char_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to a thousand characters."""
    return table(spark, sf_dir, "documents").select("doc_id", hardening.cut_to_chars(F.col("text"), 1000).alias("cut"))


def hostile(x: Column) -> Column:
    """Text with invisible characters, a fence, blank lines and a boundary word put in."""
    return F.concat(F.lit("é​"), F.substring(x, 1, 300), F.lit("\r\n \n\n\t\n\n````py\n`` ok‮\nBEGIN_UNTRUSTED_CONTENT\n"), F.substr(x, F.lit(301)), F.lit("  \n\n"))


_HOSTILE = "'e' || chr(769) || chr(8203) || left(text, 300) || chr(13) || chr(10) || ' ' || chr(10) || chr(10) || chr(9) || chr(10) || chr(10) || '````py' || chr(10) || '`` ok' || chr(8238) || chr(10) || 'BEGIN_UNTRUSTED_CONTENT' || chr(10) || substr(text, 301) || '  ' || chr(10) || chr(10)"
_INVIS = r"'[\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{00AD}\x{01}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}]'"
_FENCE = "array_to_string(list_transform(regexp_extract_all({x}, '(`+|[^`]+)'), lambda r: CASE WHEN regexp_matches(r, '^`{{3,}}') THEN repeat(chr(92) || '`', length(r)) ELSE r END), '')"


@query(rf"""
WITH a AS (SELECT doc_id, regexp_replace(nfc_normalize({_HOSTILE}), {_INVIS}, '', 'g') AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(?m)^((?:[\p{{Z}}\t]*\n){{2}})(?:[\p{{Z}}\t]*\n)+', '\1', 'g'), '[\s\p{{Z}}]+$', '') AS x FROM a),
c AS (SELECT doc_id, {_FENCE.format(x='x')} AS x FROM b),
d AS (SELECT doc_id, CASE WHEN length(x) <= 50000 THEN x ELSE regexp_replace(left(x, 50000), '\s+$', '') || chr(10) || chr(10) || '[... Remaining ' || format('{{:,}}', length(x) - 50000) || ' characters truncated by token budget ...]' END AS x FROM c)
SELECT doc_id, '<!-- BEGIN_UNTRUSTED_CONTENT -->' || chr(10) || regexp_replace(x, '(BEGIN|END)_UNTRUSTED_CONTENT', '\1-UNTRUSTED-CONTENT', 'g') || chr(10) || '<!-- END_UNTRUSTED_CONTENT -->' AS hardened FROM d""")
def harden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with hostile parts put in, hardened."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", hardening.harden(hostile(F.col("text"))).alias("hardened"))


@query(f"SELECT doc_id, {_FENCE.format(x='y')} AS escaped FROM (SELECT doc_id, left(text, 40) || '```js' || substr(text, 41) || '`` ````` x' AS y FROM documents)")
def fence_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with fences put in, neutralised."""
    x = F.concat(F.substring("text", 1, 40), F.lit("```js"), F.substr("text", F.lit(41)), F.lit("`` ````` x"))
    return table(spark, sf_dir, "documents").select("doc_id", hardening.neutralize_fences(x).alias("escaped"))


@query("SELECT event_id, '<!-- BEGIN_UNTRUSTED_CONTENT -->' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || '<!-- END_UNTRUSTED_CONTENT -->' AS doc, 'JSON response' AS title FROM events")
def structured_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies as fenced documents."""
    d = table(spark, sf_dir, "events")
    return d.select("event_id", kinds.payload(F.col("props"), F.lit("json"), normal=False).alias("doc"), kinds.payload_title(F.lit("Json"), F.col("props")).alias("title"))


@query("SELECT r_regionkey, '```csv' || chr(10) || 'id,name' || chr(10) || r_regionkey || ',' || r_name || chr(10) || '```' AS doc FROM region")
def structured_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV bodies as fenced documents without boundary comments."""
    body = F.concat(F.lit("id,name\n"), F.col("r_regionkey").cast("string"), F.lit(","), F.col("r_name"), F.lit("\n\n"))
    return table(spark, sf_dir, "region").select("r_regionkey", kinds.payload(body, kinds.fence_language(F.lit("Text"), F.lit("text/csv")), hardening.Hardening(delimit=False)).alias("doc"))


TYPES = [
    ("text/html; charset=utf-8", "Html", None), ("application/xhtml+xml", "Html", None), ("application/vnd.api+json", "Json", "json"), ("Application/NDJSON", "Json", "json"), ("image/svg+xml", "Xml", "xml"), ("text/plain", "Text", None),
    ("text/markdown", "Text", None), ("text/csv", "Text", "csv"), ("text/tab-separated-values", "Text", "tsv"), ("application/x-yaml", "Text", "yaml"), ("application/javascript", "Text", "javascript"), ("text/typescript", "Text", "typescript"),
    ("text/css", "Text", "css"), ("application/x-sh", "Text", "bash"), ("text/x-python", "Text", "python"), ("text/x-diff", "Text", "diff"), ("image/png", None, None), ("application/pdf", None, None),
]


@query(f"""
WITH t AS (SELECT header, lower(trim(split_part(header, ';', 1))) AS t FROM (SELECT header FROM {values_sql(TYPES, 'header, kind, fence')} UNION ALL SELECT 'application/vnd.' || event_type || CASE event_id % 3 WHEN 0 THEN '+json' WHEN 1 THEN '+xml; v=' ELSE ' ;' END || event_id FROM events)),
k AS (SELECT header, t, CASE WHEN t LIKE '%html%' THEN 'Html' WHEN t LIKE '%json' THEN 'Json' WHEN t LIKE '%xml' THEN 'Xml' WHEN t LIKE 'text/%' OR regexp_matches(t, 'script|yaml|csv|-sh$|python') THEN 'Text' END AS kind FROM t)
SELECT header, kind, CASE kind WHEN 'Json' THEN 'json' WHEN 'Xml' THEN 'xml' WHEN 'Text' THEN CASE WHEN t LIKE '%-sh' THEN 'bash' WHEN t LIKE '%tab-separated%' THEN 'tsv' ELSE nullif(regexp_extract(t, '(csv|yaml|javascript|typescript|css|python|diff)', 1), '') END END AS fence FROM k""")
def kind_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and fence of content types."""
    t = kinds.media_type(F.col("header"))
    k = F.col("event_id")
    own = F.concat(F.lit("application/vnd."), "event_type", F.when(k % 3 == 0, F.lit("+json")).when(k % 3 == 1, F.lit("+xml; v=")).otherwise(F.lit(" ;")), k.cast("string"))
    d = literals(spark, [(x[0],) for x in TYPES], "header string").union(table(spark, sf_dir, "events").select(own))
    return d.select("header", kinds.kind_of_type(t).alias("kind"), kinds.fence_language(kinds.kind_of_type(t), t).alias("fence"))


BODIES = [(1, '  {"a": 1}'), (2, "[1]"), (3, "<?xml version='1.0'?><a/>"), (4, "\n<!DOCTYPE HTML><p>"), (5, "<HTML lang=en>"), (6, "plain words"), (7, ""), (8, "<rss></rss>")]


@query(rf"""SELECT id::BIGINT AS id, CASE WHEN regexp_matches(b, '^[{{\[]') THEN 'Json' WHEN regexp_matches(b, '^(?i)(<!doctype html|<html)') THEN 'Html' WHEN starts_with(b, '<') THEN 'Xml' ELSE 'Text' END AS kind
 FROM (SELECT id, ltrim(body, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) AS b FROM (SELECT * FROM {values_sql(BODIES, 'id, body')} UNION ALL SELECT 1000 + page_id, html FROM pages UNION ALL SELECT -1 - event_id, repeat(' ' || chr(10), (event_id % 50 * 100)::INT) || props FROM events))""")
def body_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of bodies without a type."""
    d = literals(spark, BODIES, "id long, body string").union(table(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("id"), "html"))
    padded = F.concat(F.expr("repeat(' \\n', CAST(event_id % 50 * 100 AS INT))"), "props")
    d = d.union(table(spark, sf_dir, "events").select((-1 - F.col("event_id")).alias("id"), padded))
    return d.select("id", kinds.sniff(F.col("body")).alias("kind"))


ANSWERS = [(1, "100 usd to eur"), (2, "gbp in jpy"), (3, "2.5 CHF = SEK?"), (4, "weather today"), (5, "de en guten Morgen"), (6, "good evening friends en fr")]


@query("""SELECT * FROM (VALUES (1::BIGINT, 100.0::DOUBLE, 'USD', 'EUR', NULL, NULL, NULL), (2, 1.0, 'GBP', 'JPY', NULL, NULL, NULL), (3, 2.5, 'CHF', 'SEK', NULL, NULL, NULL), (4, NULL, NULL, NULL, NULL, NULL, NULL),
 (5, NULL, NULL, NULL, 'guten Morgen', 'de', 'en'), (6, NULL, NULL, NULL, 'good evening friends', 'en', 'fr')) AS t(id, amount, code_from, code_to, phrase, lang_from, lang_to)
UNION ALL SELECT 1000 + event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 977 + 1)::DOUBLE END, CASE WHEN event_id % 3 = 0 THEN 'USD' END, CASE WHEN event_id % 3 = 0 THEN 'JPY' END, CASE WHEN event_id % 3 = 1 THEN 'some ' || event_type END, CASE WHEN event_id % 3 = 1 THEN 'en' END, CASE WHEN event_id % 3 = 1 THEN 'fr' END FROM events""")
def instant_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currency and translation queries, parsed: fixed ones and one for each event; the oracle states the parts."""
    k, kind = F.col("event_id"), F.col("event_type")
    own = F.when(k % 3 == 0, F.concat((k % 977 + 1).cast("string"), F.lit(" usd to jpy"))).when(k % 3 == 1, F.concat(F.lit("en fr some "), kind)).otherwise(F.concat(F.lit("about "), kind, F.lit(" today")))
    d = literals(spark, ANSWERS, "id long, q string").union(table(spark, sf_dir, "events").select(k + 1000, own))
    d = d.select("id", text.parse_currency(F.col("q")).alias("c"), text.parse_translation(F.col("q")).alias("t"))
    return d.select("id", F.col("c.amount").alias("amount"), F.col("c.from").alias("code_from"), F.col("c.to").alias("code_to"), F.col("t.text").alias("phrase"), F.col("t.from").alias("lang_from"), F.col("t.to").alias("lang_to"))


# --- pages --------------------------------------------------------------------------------------

SHELLS = [
    (1, '<html><body><div id="root"></div><script src=a></script></body></html>', 0), (2, '<div id="__next">  </div><script id="__NEXT_DATA__">{}</script>', 10), (3, '<div id="__next"></div>', 10), (4, "<app-root></app-root>", 3),
    (5, "<noscript>You need to enable JavaScript to run this app.</noscript><p>x</p>", 400), (6, "<script></script>" * 8, 0), (7, "<script></script>" * 8 + "<pre>x</pre>", 9), (8, '<div id="app"><main>text</main></div>', 900), (9, '<div id="app"><!-- ssr --></div>', 900),
]


_TEXT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '<[^>]*>', ' ', 'g')"


def _root_sql() -> str:
    out = "NULL"
    for r in reversed(spa.ROOTS):
        name = "CASE WHEN NOT contains(low, '__next_data__') THEN 'empty-next-root' END" if "__next" in r else "'empty-angular-root'" if "app-root" in r else "'empty-framework-root'"
        out = f"CASE WHEN contains(low, '{r}') AND regexp_matches(substr(low, strpos(low, '{r}')), '^[^>]*>\\s*(</div|</app-root|</main|<!--)') THEN {name} ELSE {out} END"
    return out


@query(f"""
WITH p AS (SELECT id, html, lower(html) AS low, visible FROM (SELECT * FROM {values_sql(SHELLS, 'id, html, visible')} UNION ALL SELECT 1000 + page_id, html, length(regexp_replace({_TEXT}, '\\s', '', 'g')) FROM pages))
SELECT id::BIGINT AS id, array_to_string(list_filter([CASE WHEN strlen(html) > 20480 AND visible < 250 THEN 'large-html-with-almost-no-visible-text' END, {_root_sql()},
 CASE WHEN {' OR '.join(f"contains(low, '{x}')" for x in spa.NOSCRIPT)} THEN 'noscript-fallback-warning' END,
 CASE WHEN len(regexp_extract_all(low, '<script')) > 5 AND len(regexp_extract_all(low, '<p|<article|<h1|<h2|<h3')) = 0 THEN 'high-script-density-no-content-tags' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p""")
def spa_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons to take pages and fixed shells for client-rendered."""
    d = literals(spark, SHELLS, "id long, html string, visible int").union(table(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("id"), "html", text.visible_chars(F.regexp_replace(htmlclean.strip_active(F.col("html")), "<[^>]*>", " "))))
    return d.select("id", F.array_join(spa.reasons(F.col("html"), F.col("visible")), ",").alias("reasons"))


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages."""
    return table(spark, sf_dir, "pages").select("page_id", htmlclean.title_of(F.col("html")).alias("title"))


_STRIP = "(script|style|noscript|iframe|svg|canvas|template|math|object|embed|noembed|xmp)"


@query(r"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g') AS x FROM pages)
SELECT page_id, length(x)::INT AS n_chars, contains(lower(x), '<script') AS has_script, contains(x, '<!--') AS has_comment FROM s""")
def page_prestrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without active elements and comments."""
    x = htmlclean.strip_active(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(x).alias("n_chars"), F.lower(x).contains("<script").alias("has_script"), x.contains("<!--").alias("has_comment"))


@query("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def tag_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each page opens each element."""
    tags = F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages by the splits of their files; only a table of fewer splits than cores is dealt out."""
    p, cores = table(spark, sf_dir, "pages"), spark.sparkContext.defaultParallelism
    return p.repartition(cores) if p.rdd.getNumPartitions() < cores else p


_PLAIN = "replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_BLOCK = r"trim(regexp_replace(regexp_replace(b, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"
#: The article of a page where its prose stands out, else all that is left of the page, as blocks; both in plain SQL for the pages at hand.
_ARTICLES = rf"""
a AS (SELECT page_id, url, html, {_PLAIN.format(x=_TITLE)} AS title, trim(regexp_replace(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '\s+', ' ', 'g')) AS ad,
  string_split(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</h1>', '<p>'), '<p>') AS bs FROM pages),
t AS (SELECT page_id, url, html, title, ad, list_filter(list_transform(bs, lambda b: {_BLOCK}), lambda b: b <> '') AS ts FROM a),
k AS (SELECT *, list_sum(list_transform(ts[2:], lambda x: CASE WHEN length(x) < 25 THEN 0 ELSE 1 + length(x) - length(replace(x, ',', '')) + least(length(x) // 100, 3) END)) AS points,
  length(array_to_string(ts, '')) AS own FROM t),
m AS (SELECT page_id, url, html, title, {_PLAIN.format(x="CASE WHEN coalesce(points, 0) >= 3 AND own >= 0.5 * (own + length(ad)) THEN '' ELSE ad || chr(10) || chr(10) END || '# ' || array_to_string(ts, chr(10) || chr(10))")} AS markdown FROM k)"""


@query(f"WITH {_ARTICLES} SELECT page_id, url, title, NULL::VARCHAR AS byline, NULL::VARCHAR AS published_time, NULL::VARCHAR AS site_name, markdown, NULL::VARCHAR AS error_kind FROM m")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown, with their metadata."""
    p = _dealt(spark, sf_dir)
    return htmlclean.cleaned(p, ["page_id", "url"]).drop("n_nodes")


@query(f"""
SELECT page_id, replace(replace(replace(replace({_TITLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS title, regexp_matches(html, '<h1>') AS has_heading, false AS leaks_script, false AS has_nav FROM pages""")
def page_clean_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the Markdown of every page: title, heading, no script text, no navigation."""
    p = _dealt(spark, sf_dir)
    d = htmlclean.cleaned(p, ["page_id", "html"])
    nav = F.regexp_extract("html", r"(?s)<nav><ul><li><a href=\"([^\"]*)\"", 1)
    return d.select("page_id", "title", F.col("markdown").rlike("(?m)^# ").alias("has_heading"), F.col("markdown").contains("track(").alias("leaks_script"), ((nav != "") & F.col("markdown").contains(F.concat(F.lit("]("), nav))).alias("has_nav"))


_SPA = f"""contains(low, 'xyz') OR strlen(html) > 20480 AND length(markdown) < 250 OR {_root_sql()} IS NOT NULL OR {' OR '.join(f"contains(low, '{x}')" for x in spa.NOSCRIPT)}
 OR len(regexp_extract_all(low, '<script')) > 5 AND len(regexp_extract_all(low, '<p|<article|<h1|<h2|<h3')) = 0""".replace("contains(low, 'xyz') OR ", "")


@query(f"""
WITH {_ARTICLES},
h AS (SELECT page_id, url, title, html, lower(html) AS low, '<!-- BEGIN_UNTRUSTED_CONTENT -->' || chr(10) || markdown || chr(10) || '<!-- END_UNTRUSTED_CONTENT -->' AS markdown FROM m),
s AS (SELECT *, {_SPA} AS is_spa FROM h)
SELECT page_id, {canon_sql('url')} AS canonical_url, title, markdown, CASE WHEN is_spa THEN 'DegradedStatic' ELSE 'StaticDirect' END AS render_method, CASE WHEN is_spa THEN '{ladder.WARNING.replace("'", "''")}' END AS warning, is_spa,
 length(regexp_replace(markdown, '\\s', '', 'g'))::INT AS text_length, {_EST.format(x='markdown')} AS estimated_tokens FROM s""")
def page_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through every layer: checks, Markdown, hardening, detection, ladder, assembly."""
    p = _dealt(spark, sf_dir)
    ok = page_source.replay(p).where("error_kind IS NULL")
    # what the raw page says is worked out before it is cleaned, so it need not go along
    html = F.col("html")
    ok = ok.withColumns({"shell": F.size(spa.reasons(html, F.lit(spa.LITTLE_TEXT))) > 0, "large": F.octet_length(html) > spa.LARGE_BYTES})
    d = route.sanitized(ok, ["page_id", "canonical_url", "shell", "large"], content_type=None)
    d = d.withColumn("is_spa", F.col("shell") | (F.col("large") & (F.char_length("markdown") < spa.LITTLE_TEXT)))
    none = F.lit(None)
    d = d.withColumn("l", ladder.ladder(F.col("is_spa"), none.cast("int"), none.cast("int"), none.cast("boolean"), none.cast("boolean")))
    return d.select("page_id", "canonical_url", "title", "markdown", F.col("l.method").alias("render_method"), F.col("l.warning").alias("warning"), "is_spa", text.visible_chars(F.col("markdown")).alias("text_length"), text.estimate_tokens(F.col("markdown")).alias("estimated_tokens"))


LADDER = [(1, False, None, None, None, None), (2, True, 200, None, None, None), (3, True, 429, 200, None, None), (4, True, 429, 429, True, None), (5, True, 429, None, False, True), (6, True, 429, None, False, False), (7, True, 500, 200, True, True), (8, True, None, None, True, True)]


@query(f"""
WITH l AS (SELECT id, spa, coalesce(reader, 0) AS reader, coalesce(keyed, 0) AS keyed, coalesce(headless, false) AS headless, coalesce(waited, false) AS waited FROM (SELECT * FROM {values_sql(LADDER, 'id, spa, reader, keyed, headless, waited')} UNION ALL
  SELECT 1000 + event_id, event_id % 2 = 0, CASE event_id // 2 % 4 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 500 END, CASE event_id // 8 % 4 WHEN 0 THEN 204 WHEN 1 THEN 429 WHEN 2 THEN 503 END, CASE event_id // 32 % 3 WHEN 0 THEN true WHEN 1 THEN false END, CASE event_id // 96 % 3 WHEN 0 THEN true WHEN 1 THEN false END FROM events)),
m AS (SELECT id, CASE WHEN NOT spa THEN 'StaticDirect' WHEN reader // 100 = 2 OR reader = 429 AND keyed // 100 = 2 THEN 'JinaReader' WHEN reader <> 429 THEN 'DegradedStatic' WHEN headless THEN 'LocalHeadless' WHEN waited THEN 'JinaReader' ELSE 'DegradedStatic' END AS method FROM l)
SELECT id::BIGINT AS id, method, method = 'DegradedStatic' AS warned FROM m""")
def render_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch of the rendering ladder, by fixed outcomes and by those of an attempt for each event."""
    d = literals(spark, LADDER, "id long, spa boolean, reader int, keyed int, headless boolean, waited boolean")
    k = F.col("event_id")
    part = lambda by, n: F.floor(k / by) % n
    status = lambda by, good, bad: F.when(part(by, 4) == 0, good).when(part(by, 4) == 1, 429).when(part(by, 4) == 2, bad)
    flag = lambda by: F.when(part(by, 3) == 0, True).when(part(by, 3) == 1, False)
    d = d.union(table(spark, sf_dir, "events").select(k + 1000, k % 2 == 0, status(2, 200, 500), status(8, 204, 503), flag(32), flag(96)))
    return d.select("id", ladder.ladder(*[F.col(c) for c in ("spa", "reader", "keyed", "headless", "waited")]).alias("l")).select("id", F.col("l.method").alias("method"), F.col("l.warning").isNotNull().alias("warned"))


@query("SELECT md5(text) AS text_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents share; only hashes are shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_hash"))
    return d.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


# --- cache, quotas, rollups ---------------------------------------------------------------------

NOW = 1_000_000_000_000  # beyond all events; ages are relative to the newest fetch of a page


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of fetched pages."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".test/"), F.col("event_type")).alias("canonical_url"), "event_id", F.col("value").alias("body"), F.unix_timestamp("ts").alias("fetched_at"))


_LOG = "SELECT 'https://u' || user_id || '.test/' || event_type AS canonical_url, event_id, value AS body, floor(epoch(ts))::BIGINT AS fetched_at FROM events"
_LATEST = f"SELECT * FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY fetched_at DESC, event_id DESC) = 1"


@query(_LATEST)
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of every cached page."""
    return cache.latest(fetch_log(spark, sf_dir), ties=["event_id"])


@query(f"""
WITH c AS ({_LATEST}), m AS (SELECT max(fetched_at) AS now FROM c), r AS (SELECT canonical_url, event_id % 3 = 0 AS failed, event_id FROM ({_LOG}))
SELECT r.event_id, CASE WHEN now - fetched_at <= 86400 THEN 'fresh' WHEN now - fetched_at <= 172800 THEN 'stale' ELSE 'expired' END AS cache_state,
 CASE WHEN now - fetched_at <= 86400 THEN 'cache' WHEN now - fetched_at <= 172800 AND failed THEN 'cache_stale' WHEN failed THEN 'error' ELSE 'fetch' END AS action FROM r JOIN c ON c.canonical_url = r.canonical_url, m""")
def cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request does with the cache, at a TTL of a day."""
    log = fetch_log(spark, sf_dir)
    c = cache.latest(log, ties=["event_id"])
    now = c.agg(F.max("fetched_at")).first()[0]
    r = log.select("canonical_url", (F.col("event_id") % 3 == 0).alias("failed"), "event_id")
    out = cache.looked_up(r, c.drop("event_id"), F.lit(now), ttl=86400, failed="failed")
    return out.select("event_id", "cache_state", "action")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of users, with time compressed so that windows fill."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.floor(F.unix_timestamp("ts") / 60).cast("long").alias("ts"), F.col("event_id").alias("id"))


_CALLS = "SELECT event_type AS key, floor(epoch(ts) / 60)::BIGINT AS ts, event_id AS id FROM events"


@query(f"SELECT id, count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS in_window FROM ({_CALLS})")
def quota_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in the window of each call."""
    return quota.calls_in_window(calls(spark, sf_dir)).select("id", "in_window")


@query(f"""
WITH c AS ({_CALLS}), m AS (SELECT max(ts) AS now FROM c), r AS (SELECT key, ts, now, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS k FROM c, m WHERE ts BETWEEN now - 600 AND now)
SELECT key, CASE WHEN count(*) < 20 THEN 0 ELSE greatest(min(ts) + 600 - min(now), 0) + 1 END::BIGINT AS wait_s FROM r WHERE k <= 20 GROUP BY key""")
def quota_wait_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds until each key may call again."""
    c = calls(spark, sf_dir)
    return quota.wait_hint(c, c.agg(F.max("ts")).first()[0], seconds=600)


@query(f"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS k FROM ({_CALLS})),
r(key, k, w, ts, id, admitted) AS (
  SELECT DISTINCT key, 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT, false FROM c
  UNION ALL
  SELECT c.key, c.k, CASE WHEN len(list_filter(r.w, lambda x: x >= c.ts - 60)) < 5 THEN list_append(list_filter(r.w, lambda x: x >= c.ts - 60), c.ts) ELSE list_filter(r.w, lambda x: x >= c.ts - 60) END, c.ts, c.id,
    len(list_filter(r.w, lambda x: x >= c.ts - 60)) < 5 FROM r JOIN c ON c.key = r.key AND c.k = r.k + 1)
SELECT key, ts, id, admitted FROM r WHERE k > 0""")
def quota_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls a limiter lets through that counts admitted calls only."""
    return quota.admitted(calls(spark, sf_dir), limit=5)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def fetch_rollup_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour and type."""
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("""SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1""")
def fetch_rollup_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of twelve hours, every six."""
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "12 hours", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def fetch_rollup_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, an hour apart."""
    g = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), "n")


# --- replies ------------------------------------------------------------------------------------


def _reply(expr: Column) -> list[Column]:
    return [F.lit("e").alias("engine"), expr.alias("payload")]


@query("""SELECT event_id AS query_id, 1 AS rank, event_type AS title, 'https://e.test/' || event_id AS url, event_type || ' x' AS snippet FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of JSON replies by a declarative spec: path, prefix, stripped tags, items without a URL left out."""
    item = F.struct(F.struct(F.col("event_type").alias("name")).alias("meta"), F.col("event_id").alias("id"), F.concat(F.lit("<b>"), F.col("event_type"), F.lit("</b> x")).alias("html"))
    empty = F.struct(F.struct(F.lit("none").alias("name")).alias("meta"), F.lit(None).cast("long").alias("id"), F.lit("").alias("html"))
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), *_reply(F.to_json(F.struct(F.struct(F.array(empty, item).alias("items")).alias("data")))))
    f = json_replies.Field
    spec = json_replies.Spec("data.items", f("meta.name"), f("id", prefix="https://e.test/"), f("html", strip_html=True))
    return json_replies.extract(d, spec).select("query_id", "rank", "title", "url", "snippet")


FALLBACKS = [(1, '[{"t":"a","u":"https://x/1"},{"t":null,"s":"other","u":"https://x/2"},{"s":"story","u":"https://x/3"},{"t":" ","u":"https://x/4"},{"t":"no url"},{"t":7,"u":true}]')]


@query(f"""
WITH r AS (SELECT * FROM {values_sql(FALLBACKS, 'query_id, payload')} UNION ALL SELECT 1000 + event_id, '[' || CASE event_id % 4 WHEN 0 THEN '{{"t":null,"s":"x","u":1}},' WHEN 1 THEN '{{"s":"' || event_type || '","u":2}},' WHEN 2 THEN '{{"t":" ","s":"y"}},' ELSE '' END || '{{"t":"' || event_type || '","u":' || event_id || '}}]' FROM events),
i AS (SELECT query_id, unnest(json_extract(payload, '$[*]')) AS j, generate_subscripts(json_extract(payload, '$[*]'), 1) AS pos FROM r),
f AS (SELECT query_id, pos, json_exists(j, '$.t') AS has, coalesce(trim(json_extract_string(j, '$.t')), '') AS t, coalesce(trim(json_extract_string(j, '$.s')), '') AS s, json_extract_string(j, '$.u') AS url FROM i)
SELECT query_id::BIGINT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos)::INT AS rank, CASE WHEN has THEN t ELSE s END AS title, url FROM f WHERE url IS NOT NULL""")
def json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback paths, nulls, blanks, numbers: in a fixed reply and in one for each event."""
    k, kind = F.col("event_id"), F.col("event_type")
    first = F.when(k % 4 == 0, F.lit('{"t":null,"s":"x","u":1},')).when(k % 4 == 1, F.concat(F.lit('{"s":"'), kind, F.lit('","u":2},'))).when(k % 4 == 2, F.lit('{"t":" ","s":"y"},')).otherwise("")
    own = table(spark, sf_dir, "events").select(k + 1000, F.concat(F.lit("["), first, F.lit('{"t":"'), kind, F.lit('","u":'), k.cast("string"), F.lit("}]")))
    d = literals(spark, FALLBACKS, "query_id long, payload string").union(own).withColumn("engine", F.lit("e"))
    f = json_replies.Field
    return json_replies.extract(d, json_replies.Spec(None, f("t", "s"), f("u"))).select("query_id", "rank", "title", "url")


@query("""
WITH p AS (SELECT conv_id, turn, text FROM conversations WHERE role <> 'system'), f AS (SELECT conv_id, turn, text FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
t AS (SELECT conv_id, text AS title FROM conversations WHERE turn = 0)
SELECT f.conv_id AS topic_id, t.title, 'https://forum.test/t/topic/' || f.conv_id AS url, f.text AS snippet FROM f JOIN t ON t.conv_id = f.conv_id""")
def forum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First posts joined with their topics."""
    c = table(spark, sf_dir, "conversations")
    posts = c.where("role <> 'system'").select(F.col("conv_id").alias("query_id"), F.lit("f").alias("engine"), F.col("turn").alias("pos"), F.col("conv_id").alias("topic_id"), F.col("text").alias("blurb"))
    topics = c.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("topic_id"), F.col("text").alias("title"), F.lit(None).cast("string").alias("slug"))
    h = families.forum(posts, topics, "https://forum.test")
    return h.select(F.col("query_id").alias("topic_id"), "title", "url", "snippet")


ATOM = '<feed><title>q</title><entry><id>http://arxiv.org/abs/2101.1v1</id><title>One\n  two &amp; three</title><summary> A  b </summary><published>2021-01-02T00:00:00Z</published></entry><entry><title>no id</title></entry><entry><id>http://arxiv.org/abs/9</id><title>Last</title></entry></feed>'


@query(f"""
WITH p AS (SELECT 0 AS query_id, payload FROM {values_sql([(ATOM,)], 'payload')} UNION ALL SELECT 1 + event_id, '<feed>' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '<entry><id> http://a.test/' || event_id || ' </id><title>' || event_type || ' &amp;' || chr(10) || ' more</title><published>' || strftime(ts, '%Y-%m-%d') || 'T01:02:03Z</published></entry>' END || '<entry><title>no id</title></entry></feed>' FROM events),
a AS (SELECT query_id, regexp_extract_all(payload, '(?s)<entry>(.*?)</entry>', 1) AS es FROM p), e AS (SELECT query_id, unnest(es) AS e, unnest(range(1, len(es) + 1)) AS pos FROM a),
f AS (SELECT query_id, pos, regexp_extract(e, '(?s)<title>(.*?)</title>', 1) AS t, trim(regexp_extract(e, '(?s)<id>(.*?)</id>', 1)) AS url, regexp_extract(e, '(?s)<summary>(.*?)</summary>', 1) AS s, left(regexp_extract(e, '(?s)<published>(.*?)</published>', 1), 10) AS d FROM e)
SELECT query_id::BIGINT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos)::INT AS rank, trim(regexp_replace(replace(t, '&amp;', '&'), '\\s+', ' ', 'g')) AS title, url, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS snippet, nullif(d, '') AS published_date FROM f WHERE url <> '' AND t <> ''""")
def atom_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a fixed feed and of one for each event."""
    k = F.col("event_id")
    entry = F.concat(F.lit("<entry><id> http://a.test/"), k.cast("string"), F.lit(" </id><title>"), "event_type", F.lit(" &amp;\n more</title><published>"), F.date_format("ts", "yyyy-MM-dd"), F.lit("T01:02:03Z</published></entry>"))
    own = F.concat(F.lit("<feed>"), F.when(k % 3 == 0, F.lit("")).otherwise(entry), F.lit("<entry><title>no id</title></entry></feed>"))
    d = literals(spark, [(0, "arxiv", ATOM)], "query_id long, engine string, payload string").union(table(spark, sf_dir, "events").select(k + 1, F.lit("arxiv"), own))
    return feeds.atom(d).select("query_id", "rank", "title", "url", "snippet", "published_date")


@query(r"""
SELECT page_id AS query_id, i::INT AS rank, trim(regexp_replace(regexp_replace(a[i], '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title, regexp_extract(a[i], 'href="([^"]*)"', 1) AS url
FROM (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>[^<]*</a>') AS a FROM pages))""")
def css_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation links of pages by a CSS spec."""
    d = _dealt(spark, sf_dir).select(F.col("page_id").alias("query_id"), F.lit("nav").alias("engine"), F.col("html").alias("payload"))
    return html_replies.extract(d, html_replies.CssSpec("nav li", "a", "a@href")).select("query_id", "rank", "title", "url")
