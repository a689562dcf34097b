"""Search results and news-API articles as Spark data sources.

`register(spark)` makes the formats `newsloom_search` and `newsloom_api`
known. Each keyword is one input partition. The transport is a factory,
`package.module:function`, so that tests and offline runs need no network.
"""

from __future__ import annotations

import datetime as dt
import importlib
import inspect
import json
import logging
import time
import unicodedata
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from newsloom.functions.values import parse_date
from newsloom.retry import retry
from newsloom.schemas import API_RAW

API_URL = "https://newsapi.org/v2/"
MAX_PAGE_SIZE = 100
SEARCH_URL = "https://html.duckduckgo.com/html/"
log = logging.getLogger("newsloom")


class ApiError(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(f"[{code}] {message}")
        self.code, self.message = code, message


class RateLimitError(ApiError):
    pass


def top_headline_params(query=None, sources=None, category=None, country=None, language="en", page_size=20, page=1) -> dict:
    """SRC-06: sources exclude category and country."""
    out = {"language": language, "pageSize": min(page_size, MAX_PAGE_SIZE), "page": page}
    if query:
        out["q"] = query
    if sources:
        out["sources"] = ",".join(sources)
    else:
        out |= {k: v for k, v in (("category", category), ("country", country)) if v}
    return out


def search_params(query, sources=None, language="en", from_date=None, to_date=None, sort_by="publishedAt", page_size=20, page=1) -> dict:
    """SRC-07: a blank query is an error; dates are given on in ISO form, unreadable ones left out."""
    if not (query or "").strip():
        raise ValueError("Query cannot be empty.")
    out = {"q": query.strip(), "language": language, "sortBy": sort_by, "pageSize": min(page_size, MAX_PAGE_SIZE), "page": page}
    if sources:
        out["sources"] = ",".join(sources)
    return out | {k: iso for k, v in (("from", from_date), ("to", to_date)) if (iso := iso_instant(v))}


def iso_instant(text: str | None) -> str | None:
    """A date in text as ISO 8601 with offset, naive ones as UTC; None if it is none. The fuzzy parser is used where it is installed."""
    if not (text or "").strip():
        return None
    try:
        d = dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        try:
            from dateutil import parser

            d = parser.parse(text, fuzzy=True)
        except (ImportError, ValueError, OverflowError):
            log.warning("no date in %r; left out", text)
            return None
    return (d if d.tzinfo else d.replace(tzinfo=dt.UTC)).isoformat()


def source_params(category=None, language=None, country=None) -> dict:
    """SRC-09: the filters of the catalogue of sources."""
    return {k: v for k, v in (("category", category), ("language", language), ("country", country)) if v}


def http_get(key: str, timeout: int = 30) -> Callable[[str, dict], tuple[int, str]]:
    """(status, text) of an endpoint with parameters, with the key as bearer."""

    def get(endpoint: str, params: dict) -> tuple[int, str]:
        req = urllib.request.Request(f"{API_URL}{endpoint}?{urllib.parse.urlencode(params)}", headers={"Authorization": f"Bearer {key}", "Accept": "application/json"})
        try:
            with urllib.request.urlopen(req, timeout=timeout) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode(errors="replace")

    return get


def api_call(get: Callable[[str, dict], tuple[int, str]], endpoint: str, params: dict) -> dict:
    """SRC-04: the payload, or the error its status or state stands for; transport errors have code 0."""
    try:
        status, text = get(endpoint, params)
    except TimeoutError as e:
        raise ApiError(0, f"Request timed out: {e}") from e
    except OSError as e:
        raise ApiError(0, f"Connection error: {e}") from e
    if status == 429:
        raise RateLimitError(429, "Rate limit exceeded.")
    if status == 401:
        raise ApiError(401, "Invalid API key.")
    try:
        data = json.loads(text)
    except ValueError:
        data = None
    if not 200 <= status < 400:
        raise ApiError(status, data.get("message", text) if isinstance(data, dict) else text)
    if not isinstance(data, dict) or data.get("status") != "ok":
        raise ApiError(status, data.get("message", "Unknown error") if isinstance(data, dict) else "Unknown error")
    return data


def api_get(get, endpoint: str, params: dict, attempts: int = 3, backoff: float = 2.0, retry_unauthorized: bool = False, sleep=time.sleep) -> dict:
    """SRC-05: with retries; a refused key is not tried again unless asked for."""
    again = retry(attempts, backoff, (ApiError,), lambda e: e.code == 401 and not retry_unauthorized, sleep)
    return again(api_call)(get, endpoint, params)


def api_articles(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """SRC-08: rows of articles from JSON payloads; missing titles and URLs are '', malformed payloads give none."""
    x = payloads.select(*[c for c in payloads.columns if c != column], F.explode(F.from_json(column, API_RAW)["articles"]).alias("a")).where("a is not null")
    a = F.col("a")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return x.select(*[c for c in payloads.columns if c != column], empty(a["title"]).alias("title"), empty(a["url"]).alias("url"), a["description"].alias("description"), a["author"].alias("author"), parse_date(a["publishedAt"]).alias("published_at"), a["source"]["name"].alias("source_name"), a["urlToImage"].alias("url_to_image"), a["content"].alias("content"))


def catalogue(payloads: DataFrame, category=None, language=None, country=None, column: str = "payload") -> DataFrame:
    """SRC-09, SRC-10: the sources of catalogue payloads, filtered; rows without id are dropped."""
    kind = "sources array<struct<id: string, name: string, description: string, url: string, category: string, language: string, country: string>>"
    x = payloads.select(F.explode(F.from_json(column, kind)["sources"]).alias("s")).select("s.*").where("id is not null")
    for name, value in (("category", category), ("language", language), ("country", country)):
        if value:
            x = x.where(F.col(name) == value)
    return x


def _load(path: str, options: dict):
    """What the factory `module:function` makes, from the options of the reader if it takes any."""
    module, _, name = path.partition(":")
    factory = getattr(importlib.import_module(module), name)
    return factory(options) if inspect.signature(factory).parameters else factory()


def web_search(options: dict):
    """A transport over HTTP: the result pages of a search engine's plain HTML interface, until enough hits are read."""
    from newsloom.sources.fetch import HEADERS

    def hits(query: str, most: int, region: str, safesearch: str) -> Iterator[dict]:
        found = 0
        while found < most:
            form = {"q": query, "kl": region, "kp": {"strict": "1", "off": "-2"}.get(safesearch, "-1"), "s": found}
            req = urllib.request.Request(SEARCH_URL, urllib.parse.urlencode(form).encode(), HEADERS)
            with urllib.request.urlopen(req, timeout=int(options.get("timeout") or 30)) as r:
                page = result_page(r.read().decode(errors="replace"))
            if not page:
                return
            yield from page
            found += len(page)

    return hits


def result_page(html: str) -> list[dict]:
    """The hits (href, title, body) of one result page; links through a redirect are taken apart."""
    from newsloom.operators import dom

    out: list[dict] = []
    for n in dom.parse(html).walk():
        kinds = n.get("class").split()
        if n.tag == "a" and "result__a" in kinds:
            target = urllib.parse.parse_qs(urllib.parse.urlsplit(n.get("href")).query).get("uddg")
            out.append({"href": target[0] if target else n.get("href"), "title": " ".join(t.strip() for _, t in n.strings()).strip(), "body": ""})
        elif "result__snippet" in kinds and out and not out[-1]["body"]:
            out[-1]["body"] = " ".join("".join(t for _, t in n.strings()).split())
    return out


def replay(options: dict):
    """A transport without network: hits from a Parquet table (query, url, title, snippet, rank) at the option `path`, by rank."""
    import pyarrow.dataset as ds

    def hits(query: str, most: int, region: str, safesearch: str) -> Iterator[dict]:
        rows = ds.dataset(options["path"].removeprefix("file://")).to_table(columns=["url", "title", "snippet", "rank"], filter=ds.field("query") == query).to_pylist()
        rows.sort(key=lambda r: (r["rank"] is None, r["rank"] or 0, r["url"] or "", r["title"] or "", r["snippet"] or ""))
        return ({"href": r["url"], "title": r["title"], "body": r["snippet"]} for r in rows)

    return hits


class _Keyword(InputPartition):
    def __init__(self, keyword: str) -> None:
        self.keyword = keyword


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.keywords = [k.strip() for k in options.get("keywords", "").split("\n") if k.strip()]

    def partitions(self) -> list[InputPartition]:
        return [_Keyword(k) for k in self.keywords] or [_Keyword("")]


class SearchSource(DataSource):
    """SRC-02, SRC-03: options `keywords` (one a line), `transport`, `max_results`, `page_size`, `pages`, `region`, `safesearch`, `delay`, `site`, `exclude` (terms parted by blanks).

    Each keyword is sanitised and becomes a query with the site and the excluded
    terms. The transport (`web_search` by default) makes a function of (query,
    most, region, safesearch) to an iterable of hits with href, title and body. 0
    means the default.
    """

    @classmethod
    def name(cls) -> str:
        return "newsloom_search"

    def schema(self) -> str:
        return "query string, title string, url string, snippet string, source string, rank int, error string"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


class SearchReader(_Reader):
    def read(self, partition) -> Iterator[tuple]:
        o = self.options
        number = lambda k, default: type(default)(o.get(k) or 0) or default
        size, pages = number("page_size", 10), number("pages", 5)
        most = min(number("max_results", 50), size * pages)
        if not partition.keyword:
            return
        hits = _load(o.get("transport") or "newsloom.sources.search:web_search", o)
        seen: set[str] = set()
        taken = 0
        try:
            for rank, hit in enumerate(hits(query_text(partition.keyword, o.get("site"), (o.get("exclude") or "").split()), most, o.get("region", "wt-wt"), o.get("safesearch", "moderate")), 1):
                url = (hit.get("href") or "").strip()
                if not url or url in seen:
                    continue
                seen.add(url)
                taken += 1
                yield partition.keyword, hit.get("title") or "", url, hit.get("body") or "", "duckduckgo", rank, None
                if taken >= most:
                    return
                if taken % size == 0:
                    time.sleep(number("delay", 1.0))
        except Exception as e:  # noqa: BLE001  a failed keyword is a row, not a failed job
            yield partition.keyword, None, None, None, "duckduckgo", None, str(e)


def query_text(keyword: str, site: str | None = None, exclude: list[str] | None = None) -> str:
    """QRY-01 and QRY-02 for the readers, which have no columns: as `operators.search` has them."""
    kept = "".join(c for c in keyword if c.isalnum() or unicodedata.category(c) == "Mn" or c in "_-'" or c.isspace())
    term = " ".join(t for x in kept.split() if (t := x.strip("-")))
    return " ".join([term, *([f"site:{site.strip()}"] if site else []), *(f"-{t}" for x in exclude or [] if (t := x.strip().lstrip("-")))])


class ApiSource(DataSource):
    """SRC-04 to SRC-07, SRC-09: options `endpoint` (`everything`, `top-headlines` or `sources`), `keywords` (one a line, optional but for `everything`), `transport` for (endpoint, params) -> (status, text), and the parameters of the endpoint."""

    @classmethod
    def name(cls) -> str:
        return "newsloom_api"

    def schema(self) -> str:
        return "query string, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return ApiReader(self.options)


class ApiReader(_Reader):
    def read(self, partition) -> Iterator[tuple]:
        o = self.options
        get = _load(o["transport"], o) if o.get("transport") else http_get(o.get("key", ""))
        endpoint = o.get("endpoint") or "everything"
        sources = [s for s in o.get("sources", "").split(",") if s]
        pages = {"page_size": int(o.get("page_size", 20)), "page": int(o.get("page", 1))}
        try:
            if endpoint == "sources":
                params = source_params(o.get("category"), o.get("language"), o.get("country"))
            elif endpoint == "top-headlines":
                params = top_headline_params(partition.keyword, sources, o.get("category"), o.get("country"), o.get("language", "en"), **pages)
            else:
                params = search_params(partition.keyword, sources, o.get("language", "en"), o.get("from"), o.get("to"), o.get("sort_by", "publishedAt"), **pages)
            data = api_get(get, endpoint, params, int(o.get("attempts", 3)), float(o.get("backoff", 2.0)))
            yield partition.keyword, json.dumps(data), None
        except (ApiError, ValueError) as e:
            yield partition.keyword, None, str(e)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchSource)
    spark.dataSource.register(ApiSource)


def direct(spark: SparkSession, urls: list[str]) -> DataFrame:
    """SRC-01: (url, seq) of URLs given by hand."""
    return spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, seq long")
