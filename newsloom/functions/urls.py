"""URL algebra as column expressions: validation, canonical form, keys."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.common import strip

# Fixed values.
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "msclkid", "yclid", "ref", "source", "_ga", "mc_cid", "mc_eid", "si"]
NON_ARTICLE_EXTENSIONS = [".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".mp4", ".mp3", ".avi", ".zip", ".tar", ".gz", ".exe", ".css", ".js", ".xml", ".json", ".rss"]
#: Public suffixes of two labels that occur most; those of one label are any name without a dot.
PUBLIC_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.mx", "com.ar", "com.cn", "com.tr", "co.in", "co.za", "co.kr", "com.sg", "com.hk"]

#: scheme, authority, path, query, fragment; accepts what strict URI parsers refuse.
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def part(url: Column, i: int) -> Column:
    """Component `i` of a stripped URL: 1 scheme, 2 authority, 3 path, 4 query, 5 fragment; '' where absent."""
    return F.regexp_extract(strip(url), PARTS, i)


def is_valid_url(url: Column) -> Column:
    """URL-01: an http or https scheme and an authority; null and blank are not valid."""
    return F.coalesce(F.lower(part(url, 1)).isin("http", "https") & (part(url, 2) != ""), F.lit(False))


def netloc(url: Column) -> Column:
    """URL-06: the authority as written; '' if there is none, null for null."""
    return part(url, 2)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), r":\d*$", ""))


def validate_url(url: Column) -> Column:
    """URL-02: struct(valid, reason); the first failing rule names the reason, null counts as empty."""
    path = F.lower(part(url, 3))
    kind = F.regexp_extract(path, r"(\.(?:" + "|".join(e[1:] for e in NON_ARTICLE_EXTENSIONS) + r"))\z", 1)
    host = _host(url)
    bare = host.isin(PUBLIC_SUFFIXES) | (host == "") | host.rlike(r"^\.*\z")
    reason = (
        F.when(F.coalesce(strip(url), F.lit("")) == "", F.lit("Empty URL"))
        .when(~is_valid_url(url), F.lit("Invalid scheme or missing netloc"))
        .when(kind != "", F.concat(F.lit("Non-article file type ("), kind, F.lit(")")))
        .when(bare, F.lit("Could not extract domain"))
    )
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column) -> Column:
    """URL-03: canonical form; null stays null.

    Scheme and authority in lower case, no path parameters, fragment, trailing
    slashes or tracking keys, no blank values; the other pairs sorted by key, the
    values of a repeated key in their order, encoded anew.
    """
    path = F.regexp_replace(F.regexp_replace(part(url, 3), r";[^/]*\z", ""), r"/+\z", "")
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    pairs = F.transform(F.split(part(url, 4), "&"), lambda p, i: F.struct(decode(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), i.alias("i"), decode(F.regexp_extract(p, "^[^=]*=(.*)", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & ~p["k"].isin(TRACKING_KEYS)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    scheme, place = F.lower(part(url, 1)), F.lower(part(url, 2))
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(place != "", F.concat(F.lit("//"), place)).otherwise(""), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def url_hash(url: Column) -> Column:
    """URL-04: SHA-256 of the canonical form, in hex."""
    return F.sha2(normalize_url(url), 256)


def clean_url(url: Column) -> Column:
    """URL-05: stripped, without trailing slashes."""
    return F.regexp_replace(strip(url), r"/+\z", "")


@F.pandas_udf(StringType())
def _join(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b: str | None, x: str | None) -> str | None:
        try:
            return urljoin(b or "", (x or "").strip())
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def resolve_relative_url(base: Column, link: Column) -> Column:
    """URL-07: the link resolved against its page; null if the outcome is not crawlable."""
    joined = _join(base, link)
    return F.when(validate_url(joined)["valid"], joined)


def resolve_image_url(base: Column, src: Column) -> Column:
    """URL-08: `//` gets https, what does not start with http is resolved against the page."""
    return F.when(src.startswith("//"), F.concat(F.lit("https:"), src)).when(src.startswith("http"), src).otherwise(_join(base, src))


def domain_key(url: Column) -> Column:
    """URL-09: lower-case authority without any leading `w` or `.` (a set of characters, so wired.com becomes ired.com)."""
    return F.regexp_replace(F.lower(part(url, 2)), r"^[w.]+", "")
