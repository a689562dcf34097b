"""PIP-06, PIP-08 to PIP-10, PIP-12: from sources to a frontier to outputs, composed on the driver."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from newsloom.config import Settings
from newsloom.operators import frontier as D
from newsloom.operators import search as S
from newsloom.plans import pipeline
from newsloom.retry import Timer
from newsloom.sources import fetch, sinks
from newsloom.sources import search as R

log = logging.getLogger("newsloom")


def answered(rows: DataFrame, what: str) -> DataFrame:
    """PIP-09: the rows of a source without error; the keywords that failed are logged."""
    rows = rows.persist()
    for r in rows.where("error is not null").select("query", "error").toLocalIterator():
        log.warning("%s failed for %r: %s", what, r["query"], r["error"])
    return rows.where("error is null")


def collect(spark: SparkSession, args, settings: Settings, seen: DataFrame | None = None) -> DataFrame:
    """The accepted frontier of the direct URLs, the search results and the API articles, in this priority, without those in `seen`."""
    R.register(spark)
    parts: list[tuple[str, DataFrame]] = []
    if args.urls:
        parts.append(("direct", R.direct(spark, args.urls)))
    words = "\n".join(args.keywords or [])
    if args.ddg and words:
        r = spark.read.format("newsloom_search").option("keywords", words).option("max_results", args.max_results or settings.search_max_results)
        for name, value in (("transport", getattr(args, "search_transport", None)), ("path", getattr(args, "search_table", None)), ("region", settings.search_region), ("safesearch", settings.search_safesearch)):
            r = r.option(name, value) if value else r
        kept = S.filter_results(answered(r.load(), "search").select("query", "url", "rank", "snippet"), order=["query", "rank"])
        parts.append(("search", kept.select("url", F.col("rank").cast("bigint").alias("seq"))))
    key = args.newsapi_key or settings.newsapi_key
    if args.newsapi and words and not key:
        log.warning("no key for the news API; source left out")
    elif args.newsapi and words:
        r = spark.read.format("newsloom_api").option("keywords", words).option("key", key).option("language", args.lang)
        for name, value in (("sources", ",".join(args.sources or [])), ("from", args.from_date), ("to", args.to_date), ("transport", getattr(args, "api_transport", None))):
            r = r.option(name, value) if value else r
        rows = R.api_articles(answered(r.load(), "the news API").select("query", "payload"))
        parts.append(("newsapi", rows.select("url", F.xxhash64("query", "url").alias("seq"))))
    if not parts:
        return spark.createDataFrame([], "url string, seq long, priority int, discovered_via string, article_id string")
    return D.accepted(D.union_sources(*parts), seen)


def call_each(cleaned: DataFrame, on_article: Callable[[Row], object]) -> None:
    """PIP-06: `on_article` on the driver for each row, a partition at a time; its errors are logged and end nothing."""
    for row in cleaned.toLocalIterator():
        try:
            on_article(row)
        except Exception:
            log.exception("on_article failed for %s", row["url"])


def run(spark: SparkSession, args, settings: Settings, on_article: Callable[[Row], object] | None = None) -> dict:
    """Counts of one run, after its outputs (raw, cleaned, failed, exports, seen) are written below `args.out`; `on_article` gets each cleaned row.

    The raw copy is written before validation, the cleaned articles are upserted
    in full, and with `args.seen` URLs of earlier runs are not fetched again.
    """
    out = args.out
    with Timer() as t:
        seen = D.load_seen(spark, f"{out}/seen") if getattr(args, "seen", False) else None
        found = collect(spark, args, settings, seen).persist()
        fetcher = fetch.TableFetcher(spark.read.parquet(args.pages)) if args.pages else fetch.HttpFetcher(partitions=args.workers, attempts=settings.max_retries)
        label = ", ".join((args.keywords or [])[:3]) or None
        raw = pipeline.extracted(found, fetcher.fetch(found), "duckduckgo" if args.ddg else "direct", label)
        raw = raw.withColumns({"scraped_at": F.current_timestamp(), "processing_time_ms": F.lit(None).cast("double")}).persist()
        tagged = pipeline.tag(raw, args.min_body, args.lang).persist()
        stats = pipeline.stats(tagged).first().asDict()
        stats["errors"] = [r[0] for r in tagged.where("outcome = 'extract_failed'").select("reason").orderBy("url").limit(5).collect()]
        name = sinks.run_name()
        if stats["total"]:
            sinks.write_raw(raw.where("_ok").drop("_ok", "_error"), f"{out}/raw")
            cleaned = tagged.where("outcome = 'cleaned'").withColumns({"status": F.lit("cleaned"), "error_message": F.lit(None).cast("string")}).drop("outcome", "reason", "lang", "_ok", "_error")
            if on_article:
                call_each(cleaned, on_article)
            if stats["successful"]:
                stats |= {k: v for k, v in sinks.write_keyed(cleaned, f"{out}/cleaned", "article_id", ["scraped_at", "url"]).first().asDict().items() if k != "n"}
                sinks.write_csv(cleaned, f"{out}/exports/{name}.csv")
                sinks.write_jsonl(cleaned, f"{out}/exports/{name}.jsonl")
            sinks.failed(tagged).write.mode("append").json(f"{out}/failed")
            if seen is not None:
                D.mark_seen(found, f"{out}/seen")
        for x in (tagged, raw, found):
            x.unpersist()
    return stats | {"elapsed_seconds": round(t.elapsed_ms / 1000, 1)}


def summary(stats: dict) -> str:
    """PIP-12: the counts, and the first five errors."""
    lines = [f"{k}: {stats[k]}" for k in ("total", "successful", "failed", "saved", "elapsed_seconds")]
    return "\n".join([*lines, *(f"  - {e}" for e in stats["errors"][:5])])
