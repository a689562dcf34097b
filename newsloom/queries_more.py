"""Queries of the sources, sinks, page extraction and value functions, with their SQL.

What SQL expects is written out there, not taken from the engine's constants.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.common import _temporary_tables, shared_dir, table
from newsloom.functions import text as T
from newsloom.functions import urls as U
from newsloom.functions import values as V
from newsloom.operators import frontier as D
from newsloom.operators import html as H
from newsloom.operators.timestamps import to_utc
from newsloom.plans import pipeline as P
from newsloom.sources import search as R
from newsloom.sources import sinks as K


def _folder(spark) -> str:
    """A new folder among the temporary tables."""
    path = os.path.join(shared_dir(spark), f"newsloom-{uuid.uuid4().hex}")
    _temporary_tables.append((spark, path))
    return path


# ---- values ------------------------------------------------------------------------------------
def date_formats(spark, d) -> DataFrame:
    """DAT-01: dates in five notations, one of them beyond the known formats."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.pmod("o_orderkey", F.lit(5)).alias("k"))
    text = F.date_format("o_orderdate", "yyyy/MM/dd")
    for k, f in enumerate(["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "d MMMM yyyy", "MMM d, yyyy"]):
        text = F.when(F.col("k") == k, F.date_format("o_orderdate", f)).otherwise(text)
    return o.select("o_orderkey", F.unix_seconds(V.parse_date(text, dt.datetime(2024, 1, 1))).alias("seconds"))


def zone_times(spark, d) -> DataFrame:
    """DAT-02: local times in four zones."""
    zone = F.element_at(F.array(*map(F.lit, ["Asia/Tokyo", "Asia/Kolkata", "America/Bogota", "Africa/Johannesburg"])), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.unix_micros(V.ensure_utc(F.col("ts"), zone).cast("timestamp")).alias("us"))


def iso_times(spark, d) -> DataFrame:
    """DAT-03, DAT-04."""
    now = V.utcnow(dt.datetime(2024, 3, 1, 12, 30, tzinfo=dt.UTC))
    return table(spark, d, "events").select("event_id", V.format_iso(F.col("ts").cast("timestamp")).alias("iso"), F.unix_seconds(now.cast("timestamp")).alias("now"))


def capped(spark, d) -> DataFrame:
    """MTH-01, MTH-02."""
    x = table(spark, d, "lineitem").select(V.cap(F.col("l_quantity"), 25).cast("double").alias("capped"), V.round_half_even(F.col("l_quantity").cast("double") / 8, 2).alias("eighth"))
    return x.groupBy("capped", "eighth").agg(F.count(F.lit(1)).alias("n"))


def map_merge(spark, d) -> DataFrame:
    """MAP-01, MAP-02."""
    a = F.create_map(F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"))
    b = F.create_map(F.lit("type"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    shown = lambda m: F.array_join(F.transform(m, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    merged = V.merge_maps(a, b)
    return table(spark, d, "part").select("p_partkey", shown(F.array_sort(F.map_entries(merged))).alias("merged"), shown(V.keep_keys(merged, ["type", "size", "none"])).alias("kept"))


LINKS = ["../x/y.html", "/rooted/z", "//cdn.example/z", "https://abs.example/a", "file.pdf", "mailto:a@b.example"]


def url_resolve(spark, d) -> DataFrame:
    """URL-07, URL-08."""
    a = table(spark, d, "articles").where("url is not null").select("row_id", U.clean_url(F.col("url")).alias("url"))
    x = a.select("row_id", "url", F.posexplode(F.array(*map(F.lit, LINKS))).alias("i", "link"))
    return x.select("row_id", F.col("i").cast("bigint").alias("i"), U.resolve_relative_url(F.col("url"), F.col("link")).alias("link"), U.resolve_image_url(F.col("url"), F.col("link")).alias("image"))


def local_times(spark, d) -> DataFrame:
    """Problem 6 at night: local times between one and four o'clock in zones with and without changes, with the kind of each."""
    zones = F.array(*map(F.lit, ["Europe/Berlin", "America/New_York", "Asia/Tokyo", "Australia/Sydney", "Europe/London"]))
    o = table(spark, d, "orders").select("o_orderkey", F.element_at(zones, (F.pmod("o_custkey", F.lit(5)) + 1).cast("int")).alias("tz"), F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 60 * (60 + F.pmod("o_orderkey", F.lit(180)))).alias("t"))
    x = to_utc(o.select("o_orderkey", "tz", F.date_format("t", "yyyy-MM-dd HH:mm").alias("v"), F.lit("dmy").alias("o")), "v", "tz", "o", kind="kind")
    return x.select("o_orderkey", "epoch_us", "kind")


def decoded_text(spark, d) -> DataFrame:
    """TXT-11, TXT-12."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.decode_bytes(F.encode("text", "UTF-8"))).alias("text_md5"), T.is_english(F.col("lang")).alias("english"))


# ---- sources -----------------------------------------------------------------------------------
def source_direct(spark, d) -> DataFrame:
    """SRC-01."""
    return R.direct(spark, ["https://a.example/1", "https://b.example/2", "https://a.example/1"])


def search_source(spark, d) -> DataFrame:
    """SRC-02, SRC-03, PIP-09: every query of the results asked anew through the reader, which replays the table."""
    R.register(spark)
    words = "\n".join(sorted(r[0] for r in table(spark, d, "search_results").where("query is not null").select("query").distinct().toLocalIterator()))
    x = spark.read.format("newsloom_search").options(keywords=words, transport="newsloom.sources.search:replay", path=f"{d}/search_results.parquet", max_results=20, delay=0.0001).load()
    return x.where("error is null").select("query", "url", F.col("rank").cast("bigint").alias("rank"))


def api_rows(spark, d) -> DataFrame:
    """SRC-08."""
    n = table(spark, d, "newsapi_articles")
    one = F.struct("title", "url", "description", "author", F.struct(F.lit(None).cast("string").alias("id"), F.col("source_name").alias("name")).alias("source"), F.col("url_to_image").alias("urlToImage"), "content")
    payloads = n.select("api_row_id", F.to_json(F.struct(F.lit("ok").alias("status"), F.array(one).alias("articles"))).alias("payload"))
    return R.api_articles(payloads).drop("published_at")


# ---- sinks -------------------------------------------------------------------------------------
def upsert_rows(spark, d) -> DataFrame:
    """SNK-08."""
    old, new = K._halves(spark, d)
    return K.upsert(old, new, "article_id", [])


def keyed_store(spark, d) -> DataFrame:
    """SNK-01, SNK-02: the keyed table after two runs."""
    old, new = K._halves(spark, d)
    path = _folder(spark)
    for x in (old, new):
        K.write_keyed(x, path)
    return spark.read.parquet(path).select("article_id", "title")


def store_lookup(spark, d) -> DataFrame:
    """SNK-10: a row by its key, and how many rows there are."""
    old, _ = K._halves(spark, d)
    path = _folder(spark)
    K.write_keyed(old, path)
    key = old.agg(F.min("article_id")).first()[0]
    return K.find_by_id(spark, path, "article_id", key).select("article_id", "title", F.lit(K.count_rows(spark, path)).cast("bigint").alias("n"))


def csv_rows(spark, d) -> DataFrame:
    """SNK-05, SNK-06: the CSV export of two runs read back."""
    a, path = table(spark, d, "articles"), _folder(spark)
    K.write_csv(a, path, bom=True)
    K.write_csv(a.limit(0), path, append=True, bom=True)
    return K.read_csv(spark, path).select("article_id", "url", "title", "author", "word_count", "status", "error_message")


def jsonl_files(spark, d) -> DataFrame:
    """SNK-03: the JSON Lines export read back."""
    s, path = table(spark, d, "search_results").select("query", "url", "title", "rank"), _folder(spark)
    K.write_jsonl(s, path)
    return spark.read.schema(s.schema).json(path)


def json_array(spark, d) -> DataFrame:
    """SNK-04: a small table as one JSON array, taken apart again."""
    s = table(spark, d, "sites").select("site_id", "domain")
    return K.json_array(s).select(F.explode(F.from_json("json", "array<struct<site_id: int, domain: string>>")).alias("s")).select("s.*")


def seen_set(spark, d) -> DataFrame:
    """SRC-13, SNK-12, DED-02: the seen set after two runs."""
    e, path = table(spark, d, "extraction_results").where("article_id is not null"), _folder(spark)
    D.mark_seen(e.where("success"), path)
    D.mark_seen(e, path)
    return D.load_seen(spark, path).distinct()


def frontier_seen(spark, d) -> DataFrame:
    """DED-03 with a seen set."""
    from newsloom.queries import _frontier

    seen = table(spark, d, "extraction_results").where("success").select("article_id")
    return D.accepted(_frontier(spark, d), seen).select("article_id", "priority", "seq", "url")


# ---- pages -------------------------------------------------------------------------------------
def _esc(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _some(c: str | Column, *parts: str | Column) -> Column:
    """The parts one after the other if `c` holds a text, else ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > 0, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")


def built_pages(a: DataFrame) -> DataFrame:
    """`a` (row_id, url, title, author, body, snippet, thumbnail_url, metadata, scraped_at) with `html`: pages of several shapes with noise of all kinds."""
    even, third = F.pmod("row_id", F.lit(2)) == 0, F.pmod("row_id", F.lit(3)) == 0
    when = F.date_format(F.col("scraped_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    paras = F.array_join(F.transform(F.filter(F.split("body", "\n"), lambda x: T.strip(x) != ""), lambda x: F.concat(F.lit("<p>"), _esc(x), F.lit("</p>"))), "\n")
    parts = [
        "<html><head><title>", _esc(F.coalesce("title", F.lit(""))), " - Site</title>",
        F.when(third, "").otherwise(_some("title", '<meta property="og:title" content="', _esc(F.col("title")), '">')),
        _some("snippet", '<meta property="og:description" content="', _esc(F.col("snippet")), '">'), '<meta name="description" content="A plain description">',
        _some("thumbnail_url", '<meta property="og:image" content="', _esc(F.col("thumbnail_url")), '">'),
        F.when(even, _some("author", '<meta name="author" content="', _esc(F.col("author")), '">')).otherwise(""),
        F.when(even, F.concat(F.lit('<meta property="article:published_time" content="'), when, F.lit('">'))).otherwise(""),
        '<meta name="keywords" content="', F.coalesce(_esc(F.array_join("metadata.keywords", "; ")), F.lit("")), '"><link rel="canonical" href="', _esc(F.col("url")), '"></head><body>',
        '<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-bar"><p>We use cookies</p></div><script>var x = "<p>no</p>";</script><!-- <p>a comment</p> --><aside>Most read</aside>',
        F.when(~even, _some("author", '<div class="credits"><span itemprop="author"><span itemprop="name">', _esc(F.col("author")), "</span></span></div>")).otherwise(""),
        F.when(~even, F.concat(F.lit('<time datetime="'), when, F.lit('"></time>'))).otherwise(""),
        "<article>", F.coalesce(paras, F.lit("")), '<img src="/img/a.jpg" width="640px" height="auto" alt=" Photo "><img src="/img/a.jpg"><img src="https://cdn.example/site-logo.png"><img src="data:image/png;base64,xx"><img data-src="//cdn.example/b.jpg">',
        "<form><p>Your mail</p></form></article><footer><p>All rights reserved</p></footer></body></html>",
    ]
    none = F.lit(None).cast("string")
    return a.withColumns({"html": F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), "final_url": none, "error": none})


def _pages(spark, d) -> DataFrame:
    a = table(spark, d, "articles").where("url is not null").select("row_id", "url", "title", "author", "body", "snippet", "thumbnail_url", "metadata", "scraped_at")
    return built_pages(a).select("row_id", "url", "html", "final_url", "error")


def page_fields(spark, d) -> DataFrame:
    """DOM-01 to 05, EXT-01 to 03, 05 to 16, PIP-15: what the kernel reads from the pages."""
    x = H.extract(_pages(spark, d), "direct", None, dt.datetime(2024, 1, 1))
    m = F.col("metadata")
    return x.select(
        "row_id", "title", "author", F.unix_seconds("published_at").alias("published"), F.md5("body").alias("body_md5"), "snippet", F.size("images").alias("n_images"), F.col("images")[0]["url"].alias("first_image"), F.col("images")[1]["url"].alias("last_image"),
        F.col("images")[0]["alt"].alias("alt"), F.col("images")[0]["width"].alias("width"), F.col("images")[0]["height"].alias("height"), "thumbnail_url", m["canonical_url"].alias("canonical"), F.array_join(m["keywords"], "|").alias("keywords"), m["word_count"].alias("words"), "_ok", "_error",
    )


def page_jsonld(spark, d) -> DataFrame:
    """EXT-04: pages whose fields stand in JSON-LD blocks, one of them malformed, read from the tree that is not cleaned."""
    a = table(spark, d, "articles").where("url is not null and length(title) >= 3")
    block = F.to_json(F.struct(F.col("title").alias("headline"), F.array(F.struct(F.col("author").alias("name"))).alias("author"), F.date_format(F.col("scraped_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datePublished"), F.lit("A description").alias("description")))
    script = lambda c: F.concat(F.lit('<script type="application/ld+json">'), F.replace(c, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    html = F.concat(F.lit("<html><head><title>Other</title>"), script(F.lit("{broken")), script(block), F.lit("</head><body>x</body></html>"))
    none = F.lit(None).cast("string")
    x = H.extract(a.select("row_id", "url", html.alias("html"), none.alias("final_url"), none.alias("error")), "direct", None, dt.datetime(2024, 1, 1), cleaned=False)
    return x.select("row_id", "title", "author", "snippet", F.unix_seconds("published_at").alias("published"))


def pipeline_run(spark, d) -> DataFrame:
    """PIP-01, PIP-05, SRC-11: the whole frontier against the pages there are, by outcome."""
    from newsloom.queries import _frontier

    a = table(spark, d, "articles").where("url is not null")
    first = a.withColumn("url", T.strip(F.col("url"))).groupBy("url").agg(F.min_by(F.struct("row_id", "title", "author", "body", "snippet", "thumbnail_url", "metadata", "scraped_at"), "row_id").alias("a"))
    pages = built_pages(first.select("url", "a.*"))
    tagged = P.run(D.accepted(_frontier(spark, d)), pages.select("url", "html", "final_url", "error"))
    return tagged.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


def language_outcomes(spark, d) -> DataFrame:
    """PIP-04: the language filter of the plan, with a detector that goes by the first letter."""
    guess = lambda c: F.when(F.substring(c, 1, 1).rlike("[A-M]"), "en").when(F.substring(c, 1, 1).rlike("[N-Z]"), "xx")
    return P.tag(P._scraped(spark, d), lang="en", detect=guess).select("row_id", "outcome")


QUERIES = {
    f.__name__: f
    for f in (
        date_formats, zone_times, iso_times, capped, map_merge, url_resolve, local_times, decoded_text, source_direct, search_source, api_rows, upsert_rows, keyed_store, store_lookup, csv_rows, jsonl_files, json_array, seen_set, frontier_seen,
        page_fields, page_jsonld, pipeline_run, language_outcomes,
    )
}


def oracles(frontier: str, strip: Callable[[str], str], part: Callable[[str, int], str], title: str) -> dict[str, str]:
    """SQL of the queries above, from that of the frontier, of stripping, of URL components and of cleaned titles."""
    halves = "w as (select article_id, coalesce(title, '') as title, row_id, min(row_id) over (partition by article_id) as lo, max(row_id) over (partition by article_id) as hi from articles where article_id is not null)"
    base = f"(lower({part('url', 1)}) || '://' || {part('url', 2)})"
    folder = f"regexp_replace(regexp_replace({part('url', 3)}, '/+$', ''), '/[^/]*$', '')"
    bare = lambda x: rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
    lines = f"list_filter(list_transform(string_split(body, chr(10)), lambda x: {bare('x')}), lambda x: x <> '')"
    said = "case when length(thumbnail_url) > 0 then thumbnail_url else img end"
    failed = "case when length(coalesce(title, '')) = 0 or row_id % 3 = 0 then length(trim(coalesce(title, '') || ' - Site')) < 3 else length(title) < 3 end"
    words = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
    return {
        "date_formats": "select o_orderkey, cast(epoch(o_orderdate) as bigint) as seconds from orders",
        "zone_times": "select event_id, epoch_us(timezone((['Asia/Tokyo', 'Asia/Kolkata', 'America/Bogota', 'Africa/Johannesburg'])[event_id % 4 + 1], ts)) as us from events",
        "iso_times": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 <> 0 then '.' || lpad(cast(epoch_us(ts) % 1000000 as varchar), 6, '0') else '' end || '+00:00' as iso, 1709296200 as now from events",
        "capped": "select least(cast(l_quantity as double), 25) as capped, round_even(cast(l_quantity as double) / 8, 2) as eighth, count(*) as n from lineitem group by all",
        "map_merge": "select p_partkey, 'name=' || p_name || '|size=' || p_size || '|type=' || p_brand as merged, 'size=' || p_size || '|type=' || p_brand as kept from part",
        "url_resolve": f"""with a as (select row_id, {base} as base, {folder} as folder from articles where url is not null)
          select row_id, i, case i when 0 then base || regexp_replace(folder, '/[^/]*$', '') || '/x/y.html' when 1 then base || '/rooted/z' when 2 then regexp_extract(base, '^([a-z]+:)', 1) || '//cdn.example/z' when 3 then 'https://abs.example/a' end as link,
          case i when 0 then base || regexp_replace(folder, '/[^/]*$', '') || '/x/y.html' when 1 then base || '/rooted/z' when 2 then 'https://cdn.example/z' when 3 then 'https://abs.example/a' when 4 then base || folder || '/file.pdf' else 'mailto:a@b.example' end as image
          from a, unnest([0, 1, 2, 3, 4, 5]) as t(i)""",
        "local_times": """with t as (select o_orderkey, (['Europe/Berlin', 'America/New_York', 'Asia/Tokyo', 'Australia/Sydney', 'Europe/London'])[o_custkey % 5 + 1] as tz, o_orderdate + to_minutes(60 + o_orderkey % 180) as l from orders),
          u as (select *, timezone(tz, l) as one from t),
          c as (select *, list_filter([one - interval 1 hour, one, one + interval 1 hour], lambda x: timezone(tz, x) = l) as hits from u)
          select o_orderkey, epoch_us(case when len(hits) = 0 then one else list_min(hits) end) as epoch_us, case len(hits) when 0 then 'skipped' when 1 then 'unique' else 'ambiguous' end as kind from c""",
        "decoded_text": "select doc_id, md5(text) as text_md5, coalesce(lang = 'en', false) as english from documents",
        "source_direct": "select * from (values ('https://a.example/1', 0), ('https://b.example/2', 1), ('https://a.example/1', 2)) as t(url, seq)",
        "search_source": r"""with q as (select distinct query, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(query, '[^\p{L}\p{N}\p{Mn}_\s\p{Z}\-'']', '', 'g'), '[\s\p{Z}]+'), lambda t: trim(t, '-')), lambda t: t <> ''), ' ') as asked from search_results where query is not null),
          h as (select q.query, s.url, row_number() over (partition by q.query order by s.rank nulls last, coalesce(s.url, ''), coalesce(s.title, ''), coalesce(s.snippet, '')) as rank from q join search_results s on s.query = q.asked),
          f as (select query, trim(url) as url, min(rank) as rank from h where trim(coalesce(url, '')) <> '' group by all)
          select query, url, rank from (select *, row_number() over (partition by query order by rank) as n from f) where n <= 20""",
        "api_rows": "select api_row_id, coalesce(title, '') as title, coalesce(url, '') as url, description, author, source_name, url_to_image, content from newsapi_articles",
        "upsert_rows": f"with {halves} select article_id, title from w where row_id = hi",
        "keyed_store": f"with {halves} select article_id, title from w where row_id = hi",
        "store_lookup": f"with {halves} select article_id, title, (select count(*) from w where row_id = lo) as n from w where row_id = lo and article_id = (select min(article_id) from w)",
        "csv_rows": "select article_id, coalesce(url, '') as url, coalesce(title, '') as title, coalesce(author, '') as author, case when coalesce(metadata.word_count, 0) = 0 then '' else cast(metadata.word_count as varchar) end as word_count, coalesce(status, '') as status, coalesce(error_message, '') as error_message from articles",
        "jsonl_files": "select query, url, title, rank from search_results",
        "json_array": "select site_id, domain from sites",
        "seen_set": "select distinct article_id from extraction_results where article_id is not null",
        "frontier_seen": frontier + "select article_id, priority, seq, url from r where reason is null and n = 1 and article_id not in (select article_id from extraction_results where success and article_id is not null)",
        "page_fields": f"""with t as (select *, array_to_string({lines}, ' ') as own, coalesce(len({lines}), 0) as n, {base} || '/img/a.jpg' as img, {failed} as bad from articles where url is not null),
          p as (select *, list_sum(list_transform({lines}, lambda x: length(x))) as chars, case when row_id % 2 = 1 and length(author) > 0 then {bare('author')} || ' ' else '' end as credit from t),
          b as (select *, case when n > 0 and 10 * n + chars / 5.0 > 50 and length(own) > 200 then own when length({bare("credit || coalesce(own, '')")}) > 100 then {bare("credit || coalesce(own, '')")} end as text from p)
          select row_id, case when bad then null when length(coalesce(title, '')) = 0 or row_id % 3 = 0 then {bare("coalesce(title, '') || ' - Site'")} else title end as title, case when not bad and length(author) > 0 then {bare('author')} end as author, case when not bad then cast(floor(epoch(scraped_at)) as bigint) end as published,
          case when not bad then md5(text) end as body_md5, case when not bad then coalesce(nullif(snippet, ''), 'A plain description') end as snippet, case when not bad then 2 end as n_images, case when not bad then img end as first_image, case when not bad then 'https://cdn.example/b.jpg' end as last_image,
          case when not bad then 'Photo' end as alt, case when not bad then 640 end as width, null as height, case when not bad then {said} end as thumbnail_url, case when not bad then url end as canonical,
          case when not bad then array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(array_to_string(metadata.keywords, '; '), ''), '[,;]'), lambda x: {bare('x')}), lambda x: x <> ''), '|') end as keywords, case when not bad then coalesce(len({words}), 0) end as words, not bad as _ok,
          case when bad then 'Parse error: title must have at least 3 characters' end as _error from b""",
        "page_jsonld": f"select row_id, title, case when {bare('author')} <> '' then {bare('author')} end as author, 'A description' as snippet, cast(floor(epoch(scraped_at)) as bigint) as published from articles where url is not null and length(title) >= 3",
        "pipeline_run": frontier.replace("with f as", "with f as", 1) + f""", a as (select *, row_number() over (partition by {strip('url')} order by row_id) as k from articles where url is not null),
          o as (select case when a.row_id is null then 'No HTML received' when {failed.replace('title', 'a.title').replace('row_id', 'a.row_id')} then 'Parse error: title must have at least 3 characters' end as reason from r left join a on {strip('a.url')} = r.url and a.k = 1 where r.reason is null and r.n = 1)
          select case when reason is null then 'cleaned' else 'extract_failed' end as outcome, reason, count(*) as n from o group by all""",
        "language_outcomes": f"""select row_id, case when status = 'failed' or length(coalesce(title, '')) < 3 then 'extract_failed' when not (length(coalesce(title, '')) > 0 and (length(coalesce(body, '')) >= 200 or length(coalesce(snippet, '')) > 0)) then 'insufficient'
          when regexp_matches(substring({title}, 1, 1), '[N-Z]') then 'lang_dropped' else 'cleaned' end as outcome from articles""",
    }
