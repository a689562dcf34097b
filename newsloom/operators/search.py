"""Search queries and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.common import keep_first, strip
from newsloom.functions.urls import domain_key, is_valid_url

# Fixed values.
BLOCKED_DOMAINS = ["google.com", "google.co.uk", "bing.com", "yahoo.com", "duckduckgo.com", "reddit.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "youtube.com", "t.co", "bit.ly"]


def sanitize_keyword(c: Column) -> Column:
    """QRY-01: letters, digits, `_`, `-` and `'` of any script; tokens without outer hyphens, one space between."""
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}\p{Mn}_\s\p{Z}\-']", "")
    tokens = F.transform(F.split(kept, r"[\s\p{Z}]+"), lambda t: F.btrim(t, F.lit("-")))
    return F.array_join(F.filter(tokens, lambda t: t != ""), " ")


def build_query(keyword: Column, site: Column | None = None, exclude: Column | None = None, exact: bool = False) -> Column:
    """QRY-02: the query text: term, quoted if exact and of several words, `site:` and `-term` parts."""
    term = strip(keyword)
    if exact:
        term = F.when(term.contains(" "), F.concat(F.lit('"'), term, F.lit('"'))).otherwise(term)
    parts = [term]
    if site is not None:
        parts.append(F.when(F.coalesce(site, F.lit("")) != "", F.concat(F.lit("site:"), strip(site))))
    if exclude is not None:
        clean = F.filter(F.transform(exclude, lambda x: F.regexp_replace(strip(x), "^-+", "")), lambda x: x != "")
        parts.append(F.nullif(F.array_join(F.transform(clean, lambda x: F.concat(F.lit("-"), x)), " "), F.lit("")))
    return F.concat_ws(" ", *parts)


def dedup_results(df: DataFrame, key: str = "query", url: str = "url", rank: str = "rank") -> DataFrame:
    """QRY-04: the first result of each URL within a query; rows without a URL are dropped, ties resolve by all columns."""
    return keep_first(df.where(F.coalesce(F.col(url), F.lit("")) != ""), [key, url], [rank])


def top_results(df: DataFrame, most: int, key: str = "query", rank: str = "rank") -> DataFrame:
    """QRY-05: at most `most` results of each query by rank; the group limit is pushed below the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(rank).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in df.columns if c not in (key, rank)])
    return df.withColumn("__nl_n", F.row_number().over(w)).where(F.col("__nl_n") <= most).drop("__nl_n")


def filter_results(df: DataFrame, least_snippet: int = 20, allowed: list[str] | None = None, blocked: list[str] | None = None, url: str = "url", snippet: str = "snippet", order: list[str] | None = None) -> DataFrame:
    """QRY-03: valid URLs of domains not blocked (and allowed, if any are named), with a snippet long enough, the first of each URL.

    `order` are the columns that say which row is first.
    """
    domain = domain_key(F.col(url))
    x = df.where(is_valid_url(F.col(url)) & ~domain.isin([*BLOCKED_DOMAINS, *(blocked or [])]))
    if allowed:
        x = x.where(domain.isin([a.lower() for a in allowed]))
    x = x.where(F.length(strip(F.coalesce(F.col(snippet), F.lit("")))) >= least_snippet)
    return keep_first(x, [url], order or [])


def known_sources(requested: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """QRY-06: the requested ids that the catalogue has, repeats kept."""
    return requested.join(catalogue.select(key).distinct(), key, "left_semi")


def unknown_sources(requested: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """QRY-06: the distinct requested ids that the catalogue lacks."""
    return requested.join(catalogue.select(key).distinct(), key, "left_anti").select(key).distinct()
