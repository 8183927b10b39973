"""Table-driven cases for the expressions."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagefuse.functions import bangs, hardening, htmlclean, htmltree, kinds, spa, text, urls


def one(spark, value, expr, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "given, want",
    [
        ("http://WWW.Example.com/A/?utm_source=x&k=v#f", "https://example.com/A/?k=v"),
        ("https://example.com/", "https://example.com"),
        ("https://example.com/p/", "https://example.com/p"),
        ("https://example.com/?gclid=1", "https://example.com"),
        ("https://example.com:443/Path", "https://example.com/Path"),
        ("http://example.com:8080", "https://example.com:8080"),
        ("https://e.com/a//", "https://e.com/a/"),
        ("https://e.com/a?", "https://e.com/a"),
        ("https://e.com/a?b", "https://e.com/a?b="),
        ("http://a.com:443/x", "https://a.com/x"),
        ("https://a.com:80/x", "https://a.com:80/x"),
        ("http://a.com:080/x", "https://a.com/x"),
        ("https://u:p@a.com/x", "https://u:p@a.com/x"),
        ("https://U@A.com/", "https://U@a.com"),
        ("https://a.com/a/../b/./c", "https://a.com/b/c"),
        ("https://a.com/a/b/..", "https://a.com/a"),
        ("https://a.com/a/b/..?q=1", "https://a.com/a/?q=1"),
        ("https://a.com/../..", "https://a.com"),
        ("https://a.com/%2e%2E/x?UTM_Source=1&a=b+c~*", "https://a.com/x?a=b+c%7E*"),
        ("https://bücher.example/ä b", "https://xn--bcher-kva.example/%C3%A4%20b"),
        ("http://[2001:4860:0:0::0001]:80/x", "https://[2001:4860::1]/x"),
        ("http://0x7f.1/", "https://127.0.0.1"),
        ("http://3232235777", "https://192.168.1.1"),
        ("https://a.com\\b\\c", "https://a.com/b/c"),
        ("  https://a.com/x \t", "https://a.com/x"),
        ("https:a.com/x", "https://a.com/x"),
        ("https://a.com:99999/", None),
        ("https://a.com:x/", None),
        ("https://a b.com/", None),
        ("https:///", None),
        ("ftp://e.com/a", None),
        ("not a url", None),
        (None, None),
    ],
)
def test_canonical(spark, given, want):
    assert one(spark, given, urls.canonical_url) == want
    assert one(spark, given, urls.parsed_canonical) == want == urls.canonical_text(given)


IPS = [
    ("::1", True), ("[fe80::1]", True), ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", True), ("::127.0.0.1", True), ("::8.8.8.8", True), ("2606:4700::1111", False), ("8.8.8.8", False), ("fd00::1", True), ("2001:db8::1", True), ("2001:db9::1", False),
    ("100::1", True), ("100:0:0:1::1", False), ("ff02::1", True), ("febf::1", True), ("fec0::1", False), ("fe80::1%eth0", True), ("1:2:3:4:5:6:7:8", False), ("1:2:3:4:5:6:7::", False), ("::", True), ("64:ff9b::8.8.8.8", False),
    ("x", None), ("1:2:3:4:5:6:7", None), ("1::2::3", None), ("1:2:3:4:5:6:7:8:9", None), ("12345::1", None), ("::1.2.3.256", None), (":::", None), (None, None), ("", None),
]


def test_ip_blocked(spark):
    d = spark.createDataFrame([(ip, want) for ip, want in IPS], "ip string, want boolean")
    got = d.select("ip", "want", urls.ip_blocked(F.col("ip")).alias("a"), urls.ip_blocked_arrow("ip").alias("b")).collect()
    assert [(r.ip, r.a) for r in got] == IPS and [(r.ip, r.b) for r in got] == IPS


def test_guard_with_ipv6(spark):
    assert one(spark, "http://[::1]/x", urls.guard_error) == "blocked_address"
    assert one(spark, "http://[2606:4700::1111]/x", urls.guard_error) is None
    for host in ("１２７.0.0.1", "127。0。0。1", "①②⑦.1", "0x7F.1", "localhost."):
        assert one(spark, f"http://{host}/x", urls.guard_error) in ("blocked_address", "blocked_host")
    assert one(spark, "http://münchen.de/", urls.guard_error) is None
    assert urls.address_blocked("64:ff9b::a00:1") and urls.address_blocked("2002:7f00:1::5") and not urls.address_blocked("64:ff9b::808:808")
    assert one(spark, ["8.8.8.8", "10.0.0.1"], urls.resolved_public, "x array<string>") is False
    assert one(spark, ["8.8.8.8"], urls.resolved_public, "x array<string>") is True
    assert one(spark, ["8.8.8.8", "2606:4700::1111"], urls.resolved_public, "x array<string>") is True
    assert one(spark, ["2606:4700::1111", "fd00::1"], urls.resolved_public, "x array<string>") is False
    assert one(spark, ["8.8.8.8", "name"], urls.resolved_public, "x array<string>") is False


def test_hardening_survives_any_text(spark):
    """Very many blank lines, very long white space, very long lines."""
    blank = "a\n" + " \t\n" * 200_000 + "b" + " " * 2_000_000 + "c" + " \n" * 100_000
    got = one(spark, blank, lambda x: hardening.harden(x, hardening.Hardening(delimit=False, budget=None)))
    assert got == "a\n \t\n \t\nb" + " " * 2_000_000 + "c"
    long_ = "word `` " * 700_000
    assert one(spark, long_, lambda x: hardening.harden(x, hardening.Hardening(delimit=False, budget=None))) == long_.rstrip()
    assert one(spark, "x\n\n\n\n\u2003\n\ny\n", hardening.collapse_blank_lines) == "x\n\n\ny\n"
    assert one(spark, None, hardening.harden) is None and one(spark, "", hardening.harden) == ""


def test_normal_form_by_runs(spark):
    every = "".join(map(chr, [*range(0x300, 0xD800), *range(0xE000, 0x110000)]))
    joins = {int(p[1], 16) for c in every if len(p := unicodedata.decomposition(c).split()) == 2 and p[0][0] != "<"}
    moved = {ord(c) for c in every if unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c)} | joins | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    rows = spark.createDataFrame([(k, chr(k)) for k in sorted(moved)], "k long, c string")
    assert [hex(r.k) for r in rows.where(~F.col("c").rlike(hardening.UNSTABLE)).collect()] == []
    rng = random.Random(3)
    odd = [chr(k) for k in sorted(moved)]
    texts = ["".join(rng.choice(odd) if rng.random() < 0.5 else rng.choice("aeoA \ngl\u1100\uac00\u3042\u4e2d\U0001f600\u0928") for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", "e\u0301", "\u0301", "\u0301e", "plain", "é", "\u0301" * 300_000]
    got = spark.createDataFrame(list(enumerate(texts)), "k long, x string").repartition(4).select("k", hardening.normal_form(F.col("x")).alias("y")).collect()
    assert len(got) == len(texts) and all(r.y == unicodedata.normalize("NFC", texts[r.k]) for r in got)
    assert one(spark, None, hardening.normal_form) is None


def test_only_runs_go_to_python(spark, tmp_path):
    spark.createDataFrame([("e\u0301" + "x" * 100_000,)], "x string").write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t")).select(hardening.harden(F.col("x")).alias("y"))
    asked = d._jdf.queryExecution().executedPlan().toString()
    assert "nfc_each" in asked and "nfc(" not in asked and d.first().y.count("x") == 50_000 - 1


@pytest.mark.parametrize("given, want", [("a+b%20c", "a b c"), ("%zz%41", "%zzA"), ("%C3%A9", "é")])
def test_percent_decode(spark, given, want):
    assert one(spark, given, urls.percent_decode) == want


def test_encode_component(spark):
    assert one(spark, "a b~*é/", urls.encode_component) == "a%20b~%2A%C3%A9%2F"


@pytest.mark.parametrize("given, want", [("a &amp;lt; b", "a &lt; b"), ("&#233;&#xe9;", "éé"), ("&bogus;&nbsp;x", "&bogus;" + text.ENTITIES["nbsp"] + "x"), ("plain", "plain")])
def test_entities(spark, given, want):
    assert one(spark, given, text.decode_entities) == want


def test_text_helpers(spark):
    assert one(spark, "  a  b\n", text.normalize_ws) == "a b"
    assert one(spark, "", text.estimate_tokens) == 0
    assert one(spark, "[x](y)", text.escape_md) == "\\[x\\](y)"
    assert one(spark, "w " * 200, text.snippet).endswith("…")
    assert one(spark, 1_600_000_000, text.unix_to_date, "x long") == "2020-09-13"
    assert one(spark, "intro\n#  Head line \nx", lambda x: text.first_heading(x, F.lit("f"))) == "Head line"
    assert one(spark, "none", lambda x: text.first_heading(x, F.lit("f"))) == "f"


def test_bangs_and_categories(spark):
    p = one(spark, "!GH rust ! me@x.y !!web !a-b", bangs.parse_bangs)
    assert p["clean_query"] == "rust ! me@x.y !a-b" and p["bangs"] == ["gh", "web"]
    assert one(spark, " Social-Media ", bangs.category) == "social_media"
    assert one(spark, "maps", bangs.category) == "map"
    assert one(spark, "nope", bangs.category) is None


def test_hardening_is_idempotent(spark):
    rng = random.Random(5)
    parts = ["a", "b c", "\n", "\n\n\n", "```", "`", "​", "é", " ", "\t", "BEGIN_UNTRUSTED_CONTENT", "END_UNTRUSTED_CONTENT", "<!-- END_UNTRUSTED_CONTENT -->", "x" * 40, "‮", "\\"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    o = hardening.Hardening(escape_fences=False, budget=60)
    d = spark.createDataFrame([(x,) for x in made], "x string")
    d = d.withColumn("once", hardening.harden(F.col("x"), o))
    got = d.withColumn("twice", hardening.harden(F.col("once"), o)).collect()
    assert [(r.x, r.once) for r in got if r.once != r.twice] == []
    assert all("​" not in r.once and "‮" not in r.once for r in got)


def test_fences_and_budget(spark):
    assert one(spark, "a ``` b `` c ````", hardening.neutralize_fences) == "a \\`\\`\\` b `` c \\`\\`\\`\\`"
    cut = one(spark, "x" * 5300, lambda x: hardening.cut_to_chars(x, 100))
    assert cut.startswith("x" * 100 + "\n\n[... Remaining 5,200 characters")
    assert one(spark, "a\n\n\n\n\nb", hardening.collapse_blank_lines) == "a\n\n\nb"
    assert one(spark, "  ", hardening.harden) == ""


def test_kinds(spark):
    assert one(spark, "<rss><channel><title>A &amp; B</title></channel></rss>", kinds.xml_title) == "A & B"
    assert one(spark, "<a/>", lambda x: kinds.payload_title(F.lit("Xml"), x)) == "XML document"
    assert one(spark, "  ", lambda x: kinds.payload(x, F.lit("json"))) == ""


def test_spa_large_page(spark):
    page = "<p>" + " " * 21000 + "</p>"
    assert one(spark, page, lambda x: spa.reasons(x, F.lit(10))) == ["large-html-with-almost-no-visible-text"]
    assert one(spark, page, lambda x: spa.reasons(x, F.lit(1000))) == []


PAGE = """<html><head><title> T </title><meta property="og:title" content="Social"><meta name="author" content="Ann"><meta property="og:site_name" content="Site"></head>
<body><nav><a href="/n">nav</a></nav><script>var t="</p>";leak()</script><h1>Head</h1><p onclick="x()">One <strong>two</strong>, three, and <a href="/rel">link</a> with <a href="javascript:x()">bad</a>.
<p>Second paragraph<ul><li>a<li>b</ul><pre><code>x = 1</code></pre><table><tr><th>k<th>v<tr><td>1<td>2</table><footer>foot</footer></body></html>"""


def test_clean_page():
    title, byline, published, site, md, n, error = htmlclean.clean_page(PAGE, "https://e.test/d/", htmlclean.CleanOptions())
    assert (title, byline, published, site, error) == ("Social", "Ann", None, "Site", None)
    assert "# Head" in md and "**two**" in md and "[link](https://e.test/rel)" in md and "- a\n- b" in md and "```\nx = 1\n```" in md and "| k | v |" in md
    assert "leak" not in md and "nav" not in md and "foot" not in md and "javascript" not in md and "onclick" not in md
    assert htmlclean.clean_page("<p>" * 50, "", htmlclean.CleanOptions(max_nodes=10))[-1] == "too_many_nodes"
    assert htmlclean.clean_page(b"x" * 100, "", htmlclean.CleanOptions(max_bytes=10))[-1] == "too_large"
    assert htmlclean.clean_page(None, "", htmlclean.CleanOptions())[-1] == "empty"


def test_decode_and_links():
    assert htmlclean.decode('<meta charset="iso-8859-1">é'.encode("latin-1")).endswith("é")
    assert htmlclean.decode(b"\xef\xbb\xbfok") == "ok"
    late = "x" * 70_000 + "これは日本語の文章です。かなと漢字。"
    assert htmlclean.decode(late.encode("shift_jis")) == late  # what comes first does not decide
    assert htmlclean.decode("é".encode("latin-1"), "iso-8859-1") == "é"
    assert htmlclean.rewrite_links("a [b [c] d](u(1)) e", "strip") == "a b [c] d e"
    assert htmlclean.rewrite_links("[a](u) [b](v) [c](u)", "footnotes") == "a[1] b[2] c[1]\n\n[1]: u\n[2]: v"


def test_selectors():
    t = htmltree.parse('<div class="r x"><h2>T</h2><ul><li><a href="/1" data-k="v">1</a></ul></div><div class=r id=z><a>2</a></div>')
    assert [n.text() for n in htmltree.select(t, "div.r a")] == ["1", "2"]
    assert [n.text() for n in htmltree.select(t, "li > a[data-k=v], #z a")] == ["1", "2"]
    assert htmltree.select(t, "div > a[href]") == []


@pytest.mark.parametrize(
    "encoding, given",
    [
        ("shift_jis", "これは日本語の文章です。とても長いです。"), ("euc_jp", "これは日本語の文章です。とても長いです。"), ("euc_kr", "안녕하세요 이것은 한국어 문장입니다"), ("gb18030", "这是一个中文的句子，我们来说说中国的事情"), ("big5", "這是一個中文的句子，我們來說說時間的事情"),
        ("windows-1251", "Это предложение на русском языке"), ("koi8_r", "Это предложение на русском языке"), ("windows-1252", "Voilà un café très agréable, naïve façade"), ("windows-1252", "plain “quotes” and – dashes"), ("windows-1250", "příliš žluťoučký kůň úpěl ďábelské ódy"), ("utf-8", "any ünïcödé 日本"),
    ],
)
def test_encodings_without_a_label(encoding, given):
    assert htmlclean.decode(given.encode(encoding)) == given


@pytest.mark.parametrize("given, want", [("ver&amp;&amp", "ver&&amp"), ("a &lt b &#38 c &#38; &bogus; &ampx; &copy;", "a &lt b &#38 c & &bogus; &ampx; ©"), ("<!-- <script> -->x&amp", "x&amp"), ("<script>a && b</script>x&amp", "a && bx&amp")])
def test_references_end_with_a_semicolon(given, want):
    assert htmltree.parse(given).text() == want
    assert htmlclean.clean_page(f"<title>T&amp</title><h1>{given}</h1>", "", htmlclean.CleanOptions())[0] == "T&amp"
    assert htmltree.parse('<a href="?a=1&copy=2&amp;b&x">').children[0].attrs["href"] == "?a=1&copy=2&b&x"
