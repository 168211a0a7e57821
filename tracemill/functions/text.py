"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(text: Column, size: int, overlap: int) -> Column:
    """Overlapping parts of a text; a tail that the part before holds already makes no part of its own."""
    last = F.greatest(F.char_length(text) - overlap - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last, F.lit(size - overlap)), lambda i: F.substr(text, i + 1, F.lit(size)))


def normal_key(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " ")))


def source_id(url: Column) -> Column:
    return F.concat(F.lit("web_"), F.substring(F.sha2(url, 256), 1, 12))


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/:?#]+)", 1)


def host_class(name: Column) -> Column:
    return F.when(name.startswith("m."), "mobile").when(name.startswith("blog."), "blog").when(name.endswith(".org"), "reference").otherwise("other")


def last_error(log: Column) -> Column:
    """Last line of a log that names an error."""
    return F.element_at(F.filter(F.split(log, "\n"), lambda x: x.rlike("(Error|Exception)")), -1)


def folded(text: Column) -> Column:
    """Lower case; typographic quotes, dashes and diameter signs as plain characters; white space collapsed."""
    plain = F.translate(F.lower(text), "\u2019\u2018\u201c\u201d\u2013\u2014\u00f8\u2300", "''\"\"--oo")
    return F.trim(F.regexp_replace(plain, "(?U)[\\s\\x1c-\\x1f]+", " "))


def bare(text: Column) -> Column:
    """Folded text without white space."""
    return F.replace(folded(text), F.lit(" "), F.lit(""))


def quoted(needle: Column, page: Column) -> Column:
    """Whether a page holds a quote of six characters or more, whatever the case, the white space and the typography."""
    return (F.char_length(folded(needle)) >= 6) & F.contains(bare(page), bare(needle))


def masked(secret: Column, shown: int = 4) -> Column:
    return F.concat(F.left(secret, F.lit(shown)), F.repeat(F.lit("*"), F.greatest(F.char_length(secret) - shown, F.lit(0))))


#: Words of a query that say nothing about its subject.
GENERIC = (
    "the and for with what are how does official site specifications specs dimensions size standard mechanical model mm pcb mounting hole holes spacing diameter positions "
    "position port ports connector connectors locations layout board case usb hdmi micro gpio exact drawing technical"
).split()


def anchors(text: Column) -> Column:
    """Distinct words of a query without numbers, single characters and generic words; those too where nothing else is left."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    words = F.filter(found, lambda w: (F.char_length(w) > 1) & ~w.rlike("^[0-9]+$"))
    telling = F.array_except(words, F.array(*(F.lit(w) for w in GENERIC)))
    return F.when(F.size(telling) > 0, telling).otherwise(words)


#: Hosts whose links are redirects, the parameter with the target, and what stands before a coded one.
REDIRECTS = ("duckduckgo.com", "html.duckduckgo.com")
CODED_HOST, CODED_PATH, CODED_MARK = "www.bing.com", "/ck/a", "a1"


def unwrapped(url: Column) -> Column:
    """Target of a search engine's redirect, else the address itself; null for a target that can't be decoded."""
    part = lambda what, *key: F.try_parse_url(url, F.lit(what), *map(F.lit, key))
    plain = F.coalesce(F.try_url_decode(part("QUERY", "uddg")), url)
    code = F.substr(part("QUERY", "u"), F.lit(len(CODED_MARK) + 1))
    padded = F.concat(F.translate(code, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.char_length(code), F.lit(4))))
    target = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    coded = (part("HOST") == CODED_HOST) & (part("PATH") == CODED_PATH) & part("QUERY", "u").startswith(CODED_MARK)
    return F.when(part("HOST").isin(*REDIRECTS), plain).when(coded, target).otherwise(url)


#: IPv4 addresses and names that aren't public, and the IPv6 ones that are.
PRIVATE_IPV4 = (
    r"^(?:0|10|127|22[4-9]|2[345][0-9])\.|^100\.(?:6[4-9]|[789][0-9]|1[01][0-9]|12[0-7])\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.0\.[02]\.|^192\.168\."
    r"|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
)
PRIVATE_NAME = r"\.(?:localhost|local|internal|home|lan)$"
PUBLIC_IPV6 = r"^\[(?:2(?!002:|001:0{0,3}:|001:0?db8:)[0-9a-f]{3}|3[0-9a-f]{3}):[0-9a-f:]*\]$"


def public_address(url: Column) -> Column:
    """Normal form of a public web address (lower-case host, no standard port, no fragment, a path); null for any other.

    Not public: other schemes, user names, other ports than the scheme's, names without a dot, local and private hosts,
    white space, control characters and back slashes, more than 8192 characters. Host names are ASCII here (no IDNA).
    """
    at = lambda k: F.regexp_extract(url, r"^(?i:(https?))://(\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9._-]+)(?::([0-9]+))?(/[^?#]*)?(\?[^#]*)?(?:#.*)?$", k)
    scheme, host, port = F.lower(at(1)), F.regexp_replace(F.lower(at(2)), "\\.$", ""), at(3)
    usual = (port == "") | (port == F.when(scheme == "http", "80").otherwise("443"))
    ipv4, ipv6 = host.rlike(r"^[0-9.]+$"), host.startswith("[")
    whole_ipv4 = host.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}$")
    public = F.when(ipv6, host.rlike(PUBLIC_IPV6)).when(ipv4, whole_ipv4 & ~host.rlike(PRIVATE_IPV4)).otherwise(F.contains(host, F.lit(".")) & ~host.rlike(PRIVATE_NAME))
    clean = ~url.rlike(r"[\x00-\x20\x7f\\]") & (F.char_length(url) <= 8192)
    path = F.when(at(4) == "", "/").otherwise(at(4))
    return F.when(clean & (host != "") & usual & public, F.concat(scheme, F.lit("://"), host, path, at(5)))
