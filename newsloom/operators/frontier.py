"""The URL frontier: union of sources, validation, keep-first and the seen set."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.common import strip
from newsloom.functions.urls import url_hash, validate_url

log = logging.getLogger("newsloom")


def union_sources(*sources: tuple[str, DataFrame]) -> DataFrame:
    """DED-08: (url, seq, priority, discovered_via) of several sources (url, seq) in the order given."""
    parts = [df.select("url", "seq").withColumns({"priority": F.lit(i), "discovered_via": F.lit(name)}) for i, (name, df) in enumerate(sources)]
    return reduce(DataFrame.unionByName, parts)


def judge(frontier: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """DED-05: every candidate with `article_id`, `accepted` and `reject_reason`.

    A candidate is rejected by validation, because `seen` (article_id) has it, or
    as a later repeat by (priority, seq), found by a partial minimum.
    """
    # equal rows are one row with a count until the end, so copies of a URL are never gathered
    x = frontier.withColumn("url", strip(F.col("url"))).groupBy(*frontier.columns).agg(F.count(F.lit(1)).alias("__nl_n"))
    x = x.withColumns({"__nl_v": validate_url(F.col("url")), "article_id": url_hash(F.col("url"))})
    x = x.withColumn("__nl_at", F.struct("priority", "seq", *[c for c in frontier.columns if c not in ("priority", "seq")]))
    first = x.where("__nl_v.valid").groupBy(F.col("article_id").alias("__nl_id")).agg(F.min("__nl_at").alias("__nl_first"))
    x = x.join(first, F.col("article_id") == F.col("__nl_id"), "left")
    if seen is not None:
        x = x.join(seen.select(F.col("article_id").alias("__nl_seen")).distinct(), F.col("article_id") == F.col("__nl_seen"), "left")
    else:
        x = x.withColumn("__nl_seen", F.lit(None).cast("string"))
    x = x.withColumn("__nl_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__nl_n"))))
    again = (F.col("__nl_at") != F.col("__nl_first")) | (F.col("__nl_k") > 1)
    reason = F.when(~F.col("__nl_v.valid"), F.col("__nl_v.reason")).when(F.col("__nl_seen").isNotNull(), "seen").when(again, "duplicate")
    return x.withColumns({"reject_reason": reason, "accepted": reason.isNull()}).select(*frontier.columns, "article_id", "accepted", "reject_reason")


def accepted(frontier: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """DED-03, DED-07: the URLs to fetch."""
    return judge(frontier, seen).where("accepted").drop("accepted", "reject_reason")


def unseen(df: DataFrame, seen: DataFrame, key: str = "article_id") -> DataFrame:
    """DED-01: rows whose key is not in the seen set."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def mark_seen(df: DataFrame, path: str, key: str = "article_id") -> None:
    """DED-02, SNK-12: append the keys to the seen table."""
    df.select(key).distinct().write.mode("append").parquet(path)


def load_seen(spark, path: str, key: str = "article_id") -> DataFrame:
    """SRC-13: the seen table; one that is missing is empty, one without the column too, with a warning; other errors end the run."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).select(key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            log.warning("the seen set at %s cannot be read and counts as empty: %s", path, e.getCondition())
        return spark.createDataFrame([], f"{key} string")


def count_seen(df: DataFrame, key: str = "article_id", approximate: bool = False) -> DataFrame:
    """DED-04: how many distinct keys there are."""
    return df.agg((F.approx_count_distinct(key) if approximate else F.count_distinct(key)).alias("n"))
