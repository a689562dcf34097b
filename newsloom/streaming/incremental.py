"""The pipeline over a stream of URLs or articles: dedup with state, then outputs batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.urls import url_hash, validate_url
from newsloom.plans import pipeline


def fresh_urls(stream: DataFrame, time_column: str | None = None, within: str = "7 days") -> DataFrame:
    """Valid URLs with `article_id`, each once.

    With an event-time column the state is bounded: a URL counts as seen `within`
    that time only. Without, the state grows with the distinct URLs.
    """
    x = stream.where(validate_url(F.col("url"))["valid"]).withColumn("article_id", url_hash(F.col("url")))
    if time_column:
        return x.withWatermark(time_column, within).dropDuplicatesWithinWatermark(["article_id"])
    return x.dropDuplicates(["article_id"])


def run(stream: DataFrame, fetch: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, least: int = 200, lang: str | None = None, once: bool = True):
    """Start the query: each batch is fetched, extracted, tagged and given to `sink` (tagged rows, batch id).

    `sink` must be idempotent by the batch id, as a batch is repeated after a failure.
    """

    def batch(df: DataFrame, n: int) -> None:
        tagged = pipeline.run(df.select("url"), fetch(df.select("url")), least, lang).persist()
        try:
            sink(tagged, n)
        finally:
            tagged.unpersist()

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (w.trigger(availableNow=True) if once else w).start()
