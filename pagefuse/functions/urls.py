"""URL expressions: canonical form, guards against private addresses, encodings, templates."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
import urllib.parse
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Query parameters that only track, compared in lower case.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "mc_eid", "mc_cid", "msclkid", "dclid", "twclid", "igshid", "yclid", "ved", "ei", "gs_l", "s_kwcid"]

#: Ports that a browser refuses to fetch from.
BAD_PORTS = [
    1, 7, 9, 11, 13, 15, 17, 19, 20, 21, 22, 23, 25, 37, 42, 43, 53, 69, 77, 79, 87, 95, 101, 102, 103, 104, 109, 110, 111, 113,
    115, 117, 119, 123, 135, 137, 139, 143, 161, 179, 389, 427, 465, 512, 513, 514, 515, 526, 530, 531, 532, 540, 548, 554, 556,
    563, 587, 601, 636, 989, 990, 993, 995, 1719, 1720, 1723, 2049, 3659, 4045, 5060, 5061, 6000, 6566, 6665, 6666, 6667, 6668,
    6669, 6697, 10080,
]

#: IPv4 networks that are not public.
BLOCKED_V4 = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
#: IPv6 networks that are not public; the first two are all compatible and mapped IPv4 addresses.
BLOCKED_V6 = ["::/96", "::ffff:0:0/96", "100::/64", "2001:db8::/32", "fc00::/7", "fe80::/10", "ff00::/8"]
#: Addresses that carry an IPv4 address which is not public, translated (64:ff9b::/96) or tunnelled (2002::/16).
CARRIED_V6 = [
    f"{ipaddress.IPv6Address((prefix << shift) + (int(n.network_address) << low))}/{96 - low + n.prefixlen}"
    for n in map(ipaddress.ip_network, BLOCKED_V4)
    for prefix, shift, low in ((0x64FF9B, 96, 0), (0x2002, 112, 80))
]

_PARTS = r"^(?i)(https?)://([^/?#\s]+)([^?#]*)(\?[^#]*)?"
_V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def part(url: Column, k: int) -> Column:
    """Group ``k`` of an http or https URL: 1 scheme, 2 authority, 3 path, 4 query with its mark."""
    return F.regexp_extract(F.trim(url), _PARTS, k)


#: URLs that the expressions leave to the parser: odd characters, bracketed or numeric hosts, escapes in the host.
_ODD = r"[^\x21-\x7E]|[\"<>`{}\\^|]|^(?i)https?:(?!//[^/])|^(?i)https?://[^/?#]*[\[%]|^(?i)https?://([^/?#]*@)?([^/?#]*\.)?(0x[0-9a-f]*|\d+)\.?(:\d*)?([/?#]|$)|^(?i)https?://[^/?#]*:[^/?#@]*[^\d/?#@][^/?#@]*([/?#]|$)|^(?i)https?://[^/?#]*:\d{5,}"


def canonical_url(url: Column) -> Column:
    """The https form without ``www.``, fragment, tracking parameters and trailing slash; null for other schemes.

    The port goes where it is the scheme's or 443; user names stay; dot segments
    are resolved.  Pairs of the query stay in order, form-encoded; the slash
    stays where a query remains.  Odd URLs, and only those, go to a full parser.
    """
    u = F.trim(url)
    odd = u.rlike(_ODD)
    return F.when(odd, parsed_canonical(F.when(odd, u))).otherwise(plain_canonical(u))


def plain_canonical(url: Column) -> Column:
    """See ``canonical_url``, for URLs of visible ASCII characters with a host name."""
    scheme, authority = F.lower(part(url, 1)), part(url, 2)
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    user = F.when(user.isin("@", ":@"), F.lit("")).otherwise(F.regexp_replace(user, ":@$", "@"))
    host = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    host = F.regexp_replace(host, r":0*(?=\d)", ":")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    host = F.regexp_replace(F.regexp_replace(host, ":(443)?$", ""), r"^www\.(?=.)", "")
    path = F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3))
    dots = r"(?i)/(\.|%2e){1,2}(/|$)"
    path = F.when(path.rlike(dots), without_dots(path)).otherwise(path)
    coded = lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x))
    pairs = F.filter(F.split(F.substr(part(url, 4), F.lit(2)), "&"), lambda p: (p != "") & ~F.lower(F.coalesce(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))), p)).isin(TRACKING))
    value = lambda p: F.regexp_extract(p, "=(.*)$", 1)
    query = F.array_join(F.transform(pairs, lambda p: F.concat(coded(F.split_part(p, F.lit("="), F.lit(1))), F.lit("="), coded(value(p)))), "&")
    kept = F.when(query == "", F.regexp_replace(path, "/$", "")).otherwise(F.concat(path, F.lit("?"), query))
    return F.when((scheme != "") & (host != "") & ~host.startswith(":"), F.concat(F.lit("https://"), user, host, kept))


def without_dots(path: Column) -> Column:
    """A path after its ``.`` and ``..`` segments have taken effect."""
    one, two = (lambda s: F.lower(s).isin(".", "%2e")), (lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e"))
    segments = F.split(F.substr(path, F.lit(2)), "/", -1)
    last = F.element_at(segments, -1)
    start = F.array().cast("array<string>")
    kept = F.aggregate(segments, start, lambda a, s: F.when(two(s), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(one(s), a).otherwise(F.concat(a, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when((one(last) | two(last)) & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


_HOST_BAD = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
_PATH_SAFE, _USER_SAFE = "/%:@!$&'()*+,;=-._~|[]", "%!$&'()*+,-._~"


def numbered_host(host: str) -> str | None:
    """A host whose last part is a number, as an IPv4 address; a ValueError where it is none."""
    parts = host.removesuffix(".").split(".")
    if not re.fullmatch(r"\d+|0[xX][0-9a-fA-F]*", parts[-1]):
        return None
    base = lambda p: 16 if p[:2].lower() == "0x" else 8 if len(p) > 1 and p[0] == "0" else 10
    n = [int(p[2:] or "0", 16) if base(p) == 16 else int(p, base(p)) for p in parts]
    if len(n) > 4 or any(x > 255 for x in n[:-1]) or n[-1] >= 256 ** (5 - len(n)):
        raise ValueError(host)
    return str(ipaddress.IPv4Address(sum(x << 8 * (3 - i) for i, x in enumerate(n[:-1])) + n[-1]))


def host_text(raw: str) -> str:
    """A host as a browser writes it: names in ASCII and lower case, addresses in their shortest form."""
    if raw.startswith("["):
        if not raw.endswith("]"):
            raise ValueError(raw)
        ip = ipaddress.IPv6Address(raw[1:-1])
        return f"[{ip.compressed}]" if ip.ipv4_mapped is None else f"[::ffff:{int(ip) >> 16 & 0xFFFF:x}:{int(ip) & 0xFFFF:x}]"
    host = urllib.parse.unquote(raw, errors="strict")
    host = host.lower() if host.isascii() else host.encode("idna").decode().lower()
    if not host or _HOST_BAD.search(host):
        raise ValueError(raw)
    return numbered_host(host) or host


def canonical_text(u: str | None) -> str | None:
    """``canonical_url`` of one URL, by a full parser."""
    if not isinstance(u, str):
        return None
    u = re.sub(r"[\t\n\r]", "", u.strip("".join(map(chr, range(33)))))
    m = re.match(r"(?i)(https?):[/\\]*([^/\\?#]*)([^?#]*)(?:\?([^#]*))?", u)
    if not m:
        return None
    user, at, rest = m[2].rpartition("@")
    try:
        cut = re.fullmatch(r"(\[.*\]|[^:]*)(?::(\d*))?", rest)
        if not cut:
            return None
        host, port = host_text(cut[1]), int(cut[2]) if cut[2] else None
    except (ValueError, UnicodeError):
        return None
    if port is not None and port > 65535:
        return None
    host = host.removeprefix("www.") or host
    if port is not None and port != 443 and not (port == 80 and m[1].lower() == "http"):
        host += f":{port}"
    name, colon, secret = user.partition(":")
    who = urllib.parse.quote(name, safe=_USER_SAFE) + (f":{urllib.parse.quote(secret, safe=_USER_SAFE)}" if secret else "")
    segments, path = [], m[3].replace("\\", "/").split("/")[1:] or [""]
    for s in path:
        dots = s.lower().replace("%2e", ".")
        if dots == "..":
            segments = segments[:-1]
        elif dots != ".":
            segments.append(s)
    if path[-1].lower().replace("%2e", ".") in (".", "..") and segments:
        segments.append("")
    out = "/" + urllib.parse.quote("/".join(segments), safe=_PATH_SAFE)
    pairs = [(k, v) for k, v in urllib.parse.parse_qsl((m[4] or ""), keep_blank_values=True, errors="replace", max_num_fields=None) if k.lower() not in TRACKING]
    form = "&".join("=".join(urllib.parse.quote_plus(x, safe="*").replace("~", "%7E") for x in kv) for kv in pairs)
    return f"https://{who + '@' if who else ''}{host}" + (f"{out}?{form}" if form else out.removesuffix("/"))


@F.pandas_udf(StringType())
def parsed_canonical(urls: pd.Series) -> pd.Series:
    """``canonical_url`` by a full parser, for any URL."""
    return urls.map(canonical_text)


def host_of(url: Column) -> Column:
    """Host name in lower case, without user, port and brackets."""
    h = F.regexp_replace(F.lower(part(url, 2)), r"^[^@]*@", "")
    return F.regexp_replace(F.regexp_replace(h, r":\d*$", ""), r"^\[(.*)\]$", "$1")


def port_of(url: Column) -> Column:
    """Port number that the URL names, else null."""
    return F.regexp_extract(part(url, 2), r":(\d+)$", 1).try_cast("int")


def v4_number(ip: Column) -> Column:
    """An IPv4 address as a number, null where it is none."""
    octets = F.when(ip.rlike(_V4), F.transform(F.split(ip, r"\."), lambda o: o.cast("long")))
    return F.when(F.forall(octets, lambda o: o <= 255), F.aggregate(octets, F.lit(0).cast("long"), lambda n, o: n * 256 + o))


_RANGES_V4 = ", ".join(f"struct({int(n.network_address)}L AS lo, {int(n.broadcast_address)}L AS hi)" for n in map(ipaddress.ip_network, BLOCKED_V4))


def number_blocked(n: Column) -> Column:
    """Whether an IPv4 address, as a number, is not public; null for null."""
    return F.exists(F.expr(f"array({_RANGES_V4})"), lambda r: n.between(r["lo"], r["hi"]))


def ipv4_blocked(ip: Column) -> Column:
    """Whether an IPv4 address is not public; null where it is no address."""
    return once(v4_number(ip), number_blocked)


def v6_groups(ip: Column) -> Column:
    """The eight numbers of an IPv6 address, null where it is none; brackets and a zone are taken off."""
    plain = F.regexp_replace(F.lower(ip), r"^\[|%.*$|\]$", "")

    def spelled(x: Column) -> Column:
        """An address whose IPv4 end is written as two groups."""
        tail = F.regexp_extract(x, r":(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
        groups = lambda n: F.concat(F.regexp_replace(x, r"[\d.]+$", ""), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))
        return F.when(tail == "", x).otherwise(once(v4_number(tail), groups))

    def filled(halves: Column) -> Column:
        """The groups, zeros in the place of the double colon."""
        groups = lambda k: F.filter(F.split(F.coalesce(F.get(halves, F.lit(k)), F.lit("")), ":", -1), lambda g: (g != "") | (F.get(halves, F.lit(k)) != ""))
        left, right = groups(0), groups(1)
        missing = 8 - F.size(left) - F.size(right)
        return F.when(F.size(halves) == 1, left).when((F.size(halves) == 2) & (missing >= 1), F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right))

    def numbers(every: Column) -> Column:
        good = (F.size(every) == 8) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.transform(every, lambda g: F.conv(g, 16, 10).cast("int")))

    return once(once(F.split(once(plain, spelled), "::", -1), filled), numbers)


def ipv6_blocked(ip: Column) -> Column:
    """Whether an IPv6 address is not public; null where it is no address."""

    def inside(g: Column) -> Column:
        out = F.lit(False)
        for net in map(ipaddress.ip_network, BLOCKED_V6):
            words = [int(net.network_address) >> 16 * (7 - k) & 0xFFFF for k in range(8)]
            whole, bits = divmod(net.prefixlen, 16)
            test = F.lit(True)
            for k in range(whole):
                test = test & (F.get(g, F.lit(k)) == words[k])
            if bits:
                test = test & (F.get(g, F.lit(whole)).bitwiseAND(0xFFFF << (16 - bits) & 0xFFFF) == words[whole])
            out = out | test
        at = lambda k: F.get(g, F.lit(k)).cast("long")
        translated = (at(0) == 0x64) & (at(1) == 0xFF9B) & ((at(2) + at(3) + at(4) + at(5)) == 0)
        carried = F.when(translated, at(6) * 65536 + at(7)).when(at(0) == 0x2002, at(1) * 65536 + at(2))
        return F.when(g.isNotNull(), out | F.coalesce(once(carried, number_blocked), F.lit(False)))

    return once(v6_groups(ip), inside)


def ip_blocked(ip: Column) -> Column:
    """Whether an IPv4 or IPv6 address is not public; null where it is no address."""
    return F.coalesce(F.when(ip.rlike(_V4), ipv4_blocked(ip)), F.when(ip.contains(":"), ipv6_blocked(ip)))


_NETS = [ipaddress.ip_network(n) for n in (*BLOCKED_V4, *BLOCKED_V6, *CARRIED_V6)]


def address_blocked(address: str) -> bool:
    """``ip_blocked`` of one address outside of Spark; a ValueError where it is none."""
    ip = ipaddress.ip_address(address.strip("[]").split("%")[0])
    return any(ip in n for n in _NETS if n.version == ip.version)


@F.pandas_udf(BooleanType())
def ip_blocked_arrow(ips: pd.Series) -> pd.Series:
    """``ip_blocked`` as a function that SQL can name."""

    def one(x: str | None) -> bool | None:
        try:
            return address_blocked(x)
        except (ValueError, AttributeError):
            return None

    return ips.map(one).astype("object")


@cache
def _as_ascii() -> tuple[str, str]:
    """Characters that a host name shows as one ASCII letter, digit or dot, and these, for ``translate``."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c)).lower()) for c in range(0x80, 0x20000)]
    pairs = [(c, x) for c, x in pairs if re.fullmatch("[0-9a-z.]", x)] + [("\u3002", "."), ("\uff61", ".")]
    return "".join(c for c, _ in pairs), "".join(x for _, x in pairs)


def number_host(host: Column) -> Column:
    """A host whose last part is a number, as a dotted IPv4 address; null where it is none."""
    one = lambda p: F.when(p.rlike("^0x[0-9a-f]{0,14}$"), F.conv(F.concat(F.lit("0"), F.substr(p, F.lit(3))), 16, 10)).when(p.rlike("^0[0-7]{0,18}$"), F.conv(p, 8, 10)).when(p.rlike("^[1-9][0-9]{0,17}$"), p).cast("long")

    def address(n: Column) -> Column:
        count, last = F.size(n), F.element_at(n, -1)
        fine = (count <= 4) & F.forall(n, lambda x: x.isNotNull()) & F.forall(F.slice(n, F.lit(1), count - 1), lambda x: x <= 255) & (last < F.pow(F.lit(256), 5 - count))
        low = F.aggregate(F.transform(F.slice(n, F.lit(1), count - 1), lambda x, i: x * F.pow(F.lit(256), 3 - i).cast("long")), last, lambda s, x: s + x)
        return F.when(fine, once(low, lambda v: F.concat_ws(".", *[F.shiftright(v, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)])))

    return once(F.transform(F.split(host, r"\."), one), address)


def guarded_host(url: Column) -> Column:
    """The host as a browser asks for it: numbers as addresses, other forms of letters, digits and dots as ASCII, no dot at the end; null where a number is no address."""
    odd = r"[\t\n\r\\\\]|^(?i)https?:(?!//[^/])"
    u = once(F.trim(url), lambda x: F.when(x.rlike(odd), F.regexp_replace(F.regexp_replace(x, r"[\t\n\r]", ""), r"^(?i)(https?):[/\\\\]*", "$1://")).otherwise(x))
    h = once(F.regexp_extract(host_of(u), r"^[^\\\\]*", 0), lambda x: F.when(x.contains("%"), F.lower(F.coalesce(F.try_url_decode(x), x))).otherwise(x))
    h = once(h, lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), F.translate(x, *_as_ascii())).otherwise(x))
    return once(F.regexp_replace(h, r"\.$", ""), lambda x: F.when(x.rlike(r"(^|\.)(0x[0-9a-f]*|[0-9]+)$") & ~x.contains(":"), number_host(x)).otherwise(x))


def guard_error(url: Column) -> Column:
    """Why a URL must not be fetched (scheme, port, host, address), or null."""
    literal = part(url, 2).rlike(r"\[")
    bad_host = once(
        guarded_host(url),
        lambda h: F.when(h.isNull(), F.when(literal, F.lit("blocked_address")).otherwise(F.lit("invalid_url"))).when((h == "localhost") | h.endswith(".localhost"), F.lit("blocked_host")).when(F.coalesce(ip_blocked(h), literal), F.lit("blocked_address")),
    )
    return (
        F.when((part(url, 1) == "") & url.rlike(r"^\s*(?i)(?!https?:)[a-z][a-z0-9+.-]*:"), F.lit("bad_scheme"))
        .when(F.coalesce(part(url, 1), F.lit("")) == "", F.lit("invalid_url"))
        .when(F.coalesce(port_of(url).isin(BAD_PORTS), F.lit(False)), F.lit("blocked_port"))
        .otherwise(bad_host)
    )


def resolved_public(addresses: Column) -> Column:
    """Whether every address that a name resolves to (an array) is public; false for none."""
    return (F.size(addresses) > 0) & F.forall(addresses, lambda a: ~F.coalesce(ip_blocked(a), F.lit(True)))


def fallback_title(url: Column) -> Column:
    """Last segment of the path that isn't empty, else the host."""
    segments = F.filter(F.split(part(url, 3), "/"), lambda s: s != "")
    return F.coalesce(F.try_element_at(segments, F.lit(-1)), host_of(url))


def encode_component(x: Column) -> Column:
    """Percent-encoding that keeps unreserved characters only."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


@F.pandas_udf(StringType())
def percent_decode(x: pd.Series) -> pd.Series:
    """Plus to space, valid escapes to bytes, bad ones kept, invalid UTF-8 replaced."""
    return x.map(lambda s: urllib.parse.unquote_plus(s, errors="replace") if isinstance(s, str) else None)


def unwrap_redirect(href: Column, base: str = "https://duckduckgo.com") -> Column:
    """The target of a wrapped result link; relative links become absolute."""
    target = F.try_url_decode(F.regexp_extract(href, r"[?&]uddg=([^&]*)", 1))
    return F.when(F.coalesce(target.startswith("http"), F.lit(False)), target).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href)


def render_template(template: Column, query: Column, page: Column, locale: Column, safe: Column, time_range: Column) -> Column:
    """Fill a request template, one placeholder after the other; pages count from 1."""
    out = template
    for name, value in (("{query_raw}", query), ("{query}", encode_component(query)), ("{page}", (page - 1).cast("string")), ("{page1}", page.cast("string")), ("{locale}", locale), ("{safe}", safe.cast("string")), ("{time_range}", F.coalesce(time_range, F.lit("")))):
        out = F.replace(out, F.lit(name), value)
    return out
