"""Pages for a frontier: from a table of pages, or over HTTP with one session for each partition."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Headers as browsers send them, and the answers after which no second try is made.
HEADERS = {
    "User-Agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
    "Accept-Language": "en-US,en;q=0.9",
}
TERMINAL = (403, 404, 410, 451)

SCHEMA = "url string, html string, final_url string, error string"


class Fetcher(Protocol):
    def fetch(self, frontier: DataFrame) -> DataFrame:
        """(url, html, final_url, error) of every URL of the frontier."""


class TableFetcher:
    """Pages that were fetched before; a URL without page has none."""

    def __init__(self, pages: DataFrame) -> None:
        self.pages = pages

    def fetch(self, frontier: DataFrame) -> DataFrame:
        p = self.pages.select(F.col("url").alias("__nl_u"), "html")
        return frontier.select("url").join(p, F.col("url") == F.col("__nl_u"), "left").select("url", "html", F.col("url").alias("final_url"), F.lit(None).cast("string").alias("error"))


#: (status, body, declared charset or None, final URL) of a URL; raises OSError on transport errors.
Transport = Callable[[str], tuple[int, bytes, str | None, str]]


def urllib_transport(timeout: int = 30) -> Transport:
    """SRC-12: one opener, with browser headers."""
    opener = urllib.request.build_opener()
    opener.addheaders = list(HEADERS.items())

    def get(url: str) -> tuple[int, bytes, str | None, str]:
        try:
            with opener.open(url, timeout=timeout) as r:
                return r.status, r.read(), r.headers.get_content_charset(), r.geturl()
        except urllib.error.HTTPError as e:
            return e.code, b"", None, url

    return get


def download(url: str, get: Transport, attempts: int = 3) -> tuple[str | None, str | None, str | None]:
    """SRC-11: (html, final URL, error); tries follow at once, some answers end them."""
    for _ in range(attempts):
        try:
            status, data, charset, final = get(url)
        except RecursionError:
            return None, None, "Too many redirects"
        except (OSError, ValueError):
            continue
        if status in TERMINAL:
            return None, None, f"HTTP {status}"
        if status < 400:
            try:
                return data.decode(charset or "utf-8", errors="replace"), final, None
            except LookupError:
                return data.decode("utf-8", errors="replace"), final, None
    return None, None, "Max retries exceeded"


class HttpFetcher:
    """Downloads in Arrow batches; `make` builds one transport for each partition."""

    def __init__(self, make: Callable[[], Transport] = urllib_transport, attempts: int = 3, partitions: int | None = None) -> None:
        self.make, self.attempts, self.partitions = make, attempts, partitions

    def fetch(self, frontier: DataFrame) -> DataFrame:
        make, attempts = self.make, self.attempts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = make()
            for batch in batches:
                urls = batch.column(0).to_pylist()
                rows = [download(u, get, attempts) if u else (None, None, "Empty URL") for u in urls]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (urls, *map(list, zip(*rows, strict=True)))] if rows else [pa.array([], pa.string())] * 4, names=["url", "html", "final_url", "error"])

        x = frontier.select("url")
        return (x.repartition(self.partitions) if self.partitions else x).mapInArrow(run, SCHEMA)
