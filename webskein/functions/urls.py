"""URL functions as column expressions. Parts are taken by the generic URI pattern, so
international hosts and blanks are no errors."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"

# Path words of system pages, of repository views, and suffixes that are no pages.
NOISE = r"(?i)/(?:cdn-cgi|login|signup|register|logout|rss|feed|search|history|membership|support|email-protection|track|stats)\b|[-/](?:blob|commits|branches|tags|merge_requests|pipelines|jobs)\b"
DETAIL_HINT = r"(?i)/(?:archives|v|p|post|item|product|video|article|detail)/\d+|/\d+\.html$|/v/|/p/"
SKIPPED = (
    "jpg jpeg png gif svg webp ico css js woff woff2 ttf eot pdf zip tar gz rar 7z mp4 mp3 m4a wav mkv avi wmv exe dmg iso xml rss json atom"
).split()
PRIVATE_NAMES = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback")
REFUSED_SCHEMES = ("javascript", "mailto", "tel", "data", "ftp", "file", "ssh")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URI, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no blanks of a lone question mark, and no slashes at the end of a path but the root's."""
    p = path(url)
    p = F.when(p.isin("", "/"), "/").otherwise(F.regexp_replace(p, "/+$", ""))
    head = F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise("")
    host = F.when(netloc(url) != "", F.concat(F.lit("//"), netloc(url))).otherwise("")
    q = F.when(query(url) == "?", "").otherwise(query(url))
    return F.concat(head, host, p, q)


def site(url: Column) -> Column:
    """The host in lower case without any "www."."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def is_noise(url: Column) -> Column:
    return F.lower(path(url)).rlike(NOISE)


def has_skipped_suffix(url: Column) -> Column:
    return F.lower(path(url)).rlike(r"\.(" + "|".join(SKIPPED) + ")$")


def allowed(url: Column, seed: Column) -> Column:
    """Whether a crawl from seed may follow the URL."""
    return (site(url) == site(seed)) & ~is_noise(url) & ~has_skipped_suffix(url)


def priority(url: Column, depth: Column) -> Column:
    """50, 30 more for a detail page's path, 5 for each level above the third, 10 for .html or .htm."""
    p = F.lower(path(url))
    return F.lit(50) + F.when(p.rlike(DETAIL_HINT), 30).otherwise(0) + F.greatest(F.lit(0), (3 - depth) * 5) + F.when(p.rlike(r"\.html?$"), 10).otherwise(0)


def fingerprint(url: Column) -> Column:
    return F.md5(url)


def pattern(url: Column) -> Column:
    """The path with runs of digits that begin a segment made general."""
    return F.regexp_replace(path(url), r"/\d+", "/*")


def entry_url(raw: Column) -> Column:
    """What a user typed as a URL to start from; null if it can't be one."""
    text = F.trim(raw)
    low = F.lower(text)
    pseudo = F.regexp_extract(low, r"^([^:]*):", 1).isin("javascript", "mailto", "tel", "data")
    named = F.regexp_extract(low, "^(.*?)://", 1)
    with_scheme = F.concat(named, F.substring(text, F.length(named) + 1, F.length(text)))
    host_of = lambda u: F.regexp_replace(F.regexp_replace(netloc(u), "^.*@", ""), r"(?<=[^:\]]|\]):\d*$", "")
    return (
        F.when(text.isNull() | (text == "") | text.contains(" "), None)
        .when(low.startswith("//"), F.concat(F.lit("https:"), text))
        .when(pseudo | named.isin(*REFUSED_SCHEMES), None)
        .when(text.contains("://"), F.when(~is_private_name(host_of(text)), with_scheme))
        .otherwise(F.when((host_of(F.concat(F.lit("https://"), text)) != "") & ~is_private_name(host_of(F.concat(F.lit("https://"), text))), F.concat(F.lit("https://"), text)))
    )


def is_private_name(host: Column) -> Column:
    """Reserved names, and IPv4 literals of private, loopback, link-local, reserved, multicast or unspecified ranges."""
    octet = lambda i: F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int")
    a, b, c = octet(1), octet(2), octet(3)
    ranges = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.lower(host).isin(*PRIVATE_NAMES) | F.coalesce(ranges, F.lit(False)) | F.lower(F.regexp_replace(host, r"^\[|\]$", "")).rlike("^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*)$")


@F.pandas_udf(BooleanType())
def is_private_host(host: pd.Series) -> pd.Series:
    """Like is_private_name, for every form of IPv4 and IPv6 literal. Names are not resolved."""

    def one(h: str | None) -> bool:
        h = (h or "").lower().strip("[]")
        if h in PRIVATE_NAMES:
            return True
        try:
            ip = ipaddress.ip_address(h)
        except ValueError:
            return False
        return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified

    return host.map(one)
