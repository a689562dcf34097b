"""The document pipeline as one tagged plan: extract, validate, clean, filter by language, count."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.common import table
from newsloom.functions import text as T
from newsloom.operators import html as H

OUTCOMES = ["cleaned", "extract_failed", "insufficient", "lang_dropped"]


def is_valid(body: str = "body", snippet: str = "snippet", title: str = "title", least: int = 200) -> Column:
    """PIP-02: a title, and a body of `least` characters or a snippet."""
    some = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    return some(title) & ((F.length(F.coalesce(F.col(body), F.lit(""))) >= least) | some(snippet))


def is_complete() -> Column:
    """A title, a body or snippet, and a URL."""
    some = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    return some("title") & (some("body") | some("snippet")) & some("url")


def clean(df: DataFrame) -> DataFrame:
    """PIP-03: cleaned title, body and snippet; empty ones stay as they are."""
    kept = lambda c, f: F.when(F.length(c) > 0, f(F.col(c))).otherwise(F.col(c))
    x = T.composed(df, "title", "body", "snippet")
    return x.withColumns({"title": kept("title", T.clean_title), "body": kept("body", T.clean_text), "snippet": kept("snippet", T.clean_snippet)})


def tag(df: DataFrame, least: int = 200, lang: str | None = None, detect: Callable[[Column], Column] = T.detect_language) -> DataFrame:
    """PIP-01, PIP-04: `df` (url, title, body, snippet, and `_ok`, `_error` of the extraction) cleaned, with `outcome` and `reason`.

    A row whose language is not known passes the language filter.
    """
    x = df.withColumn("__nl_ok", F.coalesce(F.col("_ok"), F.lit(False))).withColumn("__nl_valid", is_valid(least=least))
    x = clean(x)
    if lang:
        text = F.concat(F.col("title"), F.lit(" "), F.coalesce(F.nullif("body", F.lit("")), "snippet", F.lit("")))
        x = x.withColumn("lang", detect(text))
        other = F.coalesce(F.col("lang") != lang, F.lit(False))
    else:
        x, other = x.withColumn("lang", F.lit(None).cast("string")), F.lit(False)
    outcome = F.when(~F.col("__nl_ok"), "extract_failed").when(~F.col("__nl_valid"), "insufficient").when(other, "lang_dropped").otherwise("cleaned")
    reason = F.when(~F.col("__nl_ok"), F.coalesce("_error", F.lit("Unknown error"))).when(~F.col("__nl_valid"), "Insufficient content")
    return x.withColumns({"outcome": outcome, "reason": reason}).drop("__nl_ok", "__nl_valid")


def stats(tagged: DataFrame) -> DataFrame:
    """PIP-07: one row of counts; `failed` includes rows dropped for their language, `errors` are those with a reason."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return tagged.agg(F.count(F.lit(1)).alias("total"), n("cleaned").alias("successful"), n(*OUTCOMES[1:]).alias("failed"), n("cleaned").alias("saved"), F.lit(0).cast("bigint").alias("skipped_duplicates"), F.count("reason").alias("errors"))


def run(frontier: DataFrame, pages: DataFrame, least: int = 200, lang: str | None = None, source: str = "direct", query: str | None = None) -> DataFrame:
    """PIP-05: the tagged articles of the frontier's URLs, whose pages (url, html, final_url, error) come from a fetcher.

    One plan: the join prunes the pages, one Arrow kernel reads them, the rest is
    built-in expressions. Persist it before writing several outputs of it.
    """
    return tag(extracted(frontier, pages, source, query), least, lang)


def extracted(frontier: DataFrame, pages: DataFrame, source: str = "direct", query: str | None = None) -> DataFrame:
    """The articles of the frontier's URLs as read from their pages, before validation."""
    p = pages.select(F.col("url").alias("__nl_url"), "html", *[F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in ("final_url", "error")])
    x = frontier.select("url").join(p, F.col("url") == F.col("__nl_url"), "left").drop("__nl_url")
    return H.extract(x, source, query)


def _scraped(spark, d) -> DataFrame:
    """Scraped rows as extraction results: those with an error message, or too short a title, failed."""
    a = table(spark, d, "articles")
    failed = (F.col("status") == "failed") | (F.length(F.coalesce("title", F.lit(""))) < 3)
    return a.select("row_id", "url", "title", "body", "snippet", (~failed).alias("_ok"), F.col("error_message").alias("_error"))


def validity_filter(spark, d) -> DataFrame:
    return table(spark, d, "articles").where(is_valid() & is_complete()).select("row_id")


def language_filter(spark, d) -> DataFrame:
    x = table(spark, d, "documents").withColumn("guess", T.detect_language(F.col("text")))
    return x.where("guess is null or guess = 'en'").select("doc_id")


def pipeline_outcomes(spark, d) -> DataFrame:
    return tag(_scraped(spark, d)).select("row_id", "outcome", "reason")


def pipeline_stats(spark, d) -> DataFrame:
    return stats(tag(_scraped(spark, d)))


def flagship(spark, d) -> DataFrame:
    """The cleaned articles."""
    return tag(_scraped(spark, d)).where("outcome = 'cleaned'").select("row_id", "url", "title", F.md5("body").alias("body_md5"), "snippet")


def html_articles(spark, d) -> DataFrame:
    """Pages built around the articles' texts, read back by the HTML kernel."""
    a = table(spark, d, "articles").where("body is not null and url is not null")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    paras = F.array_join(F.transform(F.split("body", "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "")
    head = F.concat(F.lit("<title>"), esc(F.col("title")), F.lit("</title><meta property='og:title' content=\""), esc(F.col("title")), F.lit("\"></head><body><nav><ul><li>Home</li></ul></nav><article>"))
    date = F.when(F.col("published_at").isNotNull(), F.concat(F.lit("<meta property='article:published_time' content=\""), esc(F.col("published_at")), F.lit("\">"))).otherwise("")
    page = a.select("row_id", "url", F.concat(F.lit("<html><head>"), date, head, paras, F.lit("</article><footer>end</footer></body></html>")).alias("html"))
    x = H.extract(page.withColumns({"final_url": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}), "direct", None, dt.datetime(2024, 1, 1))
    return x.select("row_id", "article_id", "title", "published_at", F.length("body").alias("body_chars"), "metadata.word_count", "_ok", "_error")


def oracles(normal: Callable[[str], str], strip: Callable[[str], str], title: str) -> dict[str, str]:
    """SQL of this module's queries, from the SQL of the text functions."""
    some = "length(coalesce({0}, '')) > 0".format
    valid = f"{some('title')} and (length(coalesce(body, '')) >= 200 or {some('snippet')})"
    outcome = f"case when status = 'failed' or length(coalesce(title, '')) < 3 then 'extract_failed' when not ({valid}) then 'insufficient' else 'cleaned' end"
    return {
        "validity_filter": f"select row_id from articles where {valid} and ({some('body')} or {some('snippet')}) and {some('url')}",
        "pipeline_outcomes": f"select row_id, {outcome} as outcome, case {outcome} when 'extract_failed' then coalesce(error_message, 'Unknown error') when 'insufficient' then 'Insufficient content' end as reason from articles",
        "pipeline_stats": f"select count(*) as total, count(*) filter ({outcome} = 'cleaned') as successful, count(*) filter ({outcome} <> 'cleaned') as failed, count(*) filter ({outcome} = 'cleaned') as saved, 0 as skipped_duplicates, count(*) filter ({outcome} <> 'cleaned') as errors from articles",
    }


