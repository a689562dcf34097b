"""Queries of the core by name, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import queries_more as more
from newsloom.common import table
from newsloom.functions import text as T
from newsloom.functions import urls as U
from newsloom.functions import values as V
from newsloom.operators import frontier as D
from newsloom.operators import search as S
from newsloom.operators.timestamps import p6_found, p6_kinds
from newsloom.plans import pipeline as P
from newsloom.sources import search as R
from newsloom.sources import sinks as K

AS_OF = "2024-06-01 00:00:00"


def url_validate(spark, d) -> DataFrame:
    v = U.validate_url(F.col("url"))
    return table(spark, d, "articles").select("row_id", v["valid"].alias("valid"), v["reason"].alias("reason"))


def url_normalize(spark, d) -> DataFrame:
    return table(spark, d, "articles").select("row_id", U.normalize_url(F.col("url")).alias("canonical"), U.clean_url(F.col("url")).alias("cleaned"))


def url_hash(spark, d) -> DataFrame:
    return table(spark, d, "articles").select("row_id", U.url_hash(F.col("url")).alias("url_hash"))


def url_domain_key(spark, d) -> DataFrame:
    return table(spark, d, "search_results").select(U.netloc(F.col("url")).alias("netloc"), U.domain_key(F.col("url")).alias("domain_key")).groupBy("netloc", "domain_key").agg(F.count(F.lit(1)).alias("n"))


def _frontier(spark, d) -> DataFrame:
    s, n, a = (table(spark, d, t) for t in ("search_results", "newsapi_articles", "articles"))
    direct = a.where("source = 'direct'").select("url", F.col("row_id").alias("seq"))
    found = s.select("url", F.coalesce(F.col("rank"), F.lit(1000000)).cast("bigint").alias("seq"))
    api = n.select("url", F.col("api_row_id").alias("seq"))
    return D.union_sources(("direct", direct), ("search", found), ("newsapi", api))


def frontier_dedup(spark, d) -> DataFrame:
    return D.accepted(_frontier(spark, d)).select("article_id", "priority", "seq", "url")


def frontier_outcomes(spark, d) -> DataFrame:
    x = D.judge(_frontier(spark, d))
    return x.groupBy("discovered_via", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def seen_antijoin(spark, d) -> DataFrame:
    a = table(spark, d, "articles").select("article_id", "row_id")
    seen = table(spark, d, "extraction_results").where("success").select("article_id").where("article_id is not null")
    return D.unseen(a, seen).select("article_id", "row_id")


def seen_count(spark, d) -> DataFrame:
    return D.count_seen(table(spark, d, "articles"))


def search_dedup(spark, d) -> DataFrame:
    return S.dedup_results(table(spark, d, "search_results").select("query", "url", "rank", "title", "snippet")).select("query", "url", "rank")


def search_filter(spark, d) -> DataFrame:
    s = table(spark, d, "search_results").select("query", "url", "rank", "snippet")
    return S.filter_results(s, blocked=["osprey24.example"], order=["rank", "query"]).select("url", "rank", "query")


def search_topk(spark, d) -> DataFrame:
    s = S.dedup_results(table(spark, d, "search_results").where("query is not null").select("query", "url", "rank", "title", "snippet"))
    return S.top_results(s.select("query", "rank", "url"), 10)


def keyword_sanitize(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.sanitize_keyword(F.concat("p_name", F.lit("; -"), "p_type", F.lit("- (new) 'x'"))).alias("keyword"))


def build_query(spark, d) -> DataFrame:
    q = S.build_query(F.col("p_name"), F.lit("news.example"), F.array(F.lit("-"), F.col("p_type"), F.lit("--ads")), exact=True)
    return table(spark, d, "part").select("p_partkey", q.alias("q"))


def source_semi(spark, d) -> DataFrame:
    n = table(spark, d, "newsapi_articles").select("api_row_id", "source_name")
    return S.known_sources(n, table(spark, d, "sites").select("source_name"), "source_name").select("api_row_id", "source_name")


def source_unknown(spark, d) -> DataFrame:
    n = table(spark, d, "newsapi_articles").select("source_name")
    return S.unknown_sources(n, table(spark, d, "sites").select("source_name"), "source_name")


def source_catalogue(spark, d) -> DataFrame:
    s = table(spark, d, "sites").select(F.col("domain").alias("id"), F.col("source_name").alias("name"), F.col("site_lang").alias("language"), "country")
    payload = s.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("sources"))).alias("payload"))  # one payload, as the API answers: sites is a fixed table
    return R.catalogue(payload, language="en", country="GB").select("id", "name")


def content_hash_dups(spark, d) -> DataFrame:
    x = table(spark, d, "documents").select(T.content_hash(F.col("text")).alias("h")).where("h is not null")
    return x.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def text_replace(spark, d) -> DataFrame:
    return table(spark, d, "articles").select("row_id", T.strip_controls(T.replace_chars(F.col("body"))).alias("body"))


def text_nfc(spark, d) -> DataFrame:
    return table(spark, d, "articles").select("row_id", T.nfc(F.col("title")).alias("title"))


def boilerplate_lines(spark, d) -> DataFrame:
    x = table(spark, d, "articles").select("row_id", F.posexplode(F.transform(F.split("body", "\n"), T.strip)).alias("line_no", "line"))
    return x.where(T.is_boilerplate(F.col("line"))).select("row_id", F.col("line_no").cast("bigint").alias("line_no"))


def dedup_lines(spark, d) -> DataFrame:
    return table(spark, d, "articles").select("row_id", F.array_join(T.dedup_lines(F.split("body", "\n")), "\n").alias("body"))


def clean_text(spark, d) -> DataFrame:
    return T.composed(table(spark, d, "articles").select("row_id", "body"), "body").select("row_id", F.md5(T.clean_text(F.col("body"))).alias("body_md5"))


def clean_title(spark, d) -> DataFrame:
    return T.composed(table(spark, d, "articles").select("row_id", "title"), "title").select("row_id", T.clean_title(F.col("title")).alias("title"))


def clean_snippet(spark, d) -> DataFrame:
    return T.composed(table(spark, d, "documents").select("doc_id", "title", "text"), "text").select("doc_id", T.clean_snippet(F.col("text")).alias("snippet"), T.truncate(F.col("title"), 40).alias("short_title"))


def word_count(spark, d) -> DataFrame:
    n = T.count_words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.cast("bigint").alias("words"), T.reading_time(n).alias("minutes"))


def language_guess(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.detect_language(F.col("text")).alias("lang"))


def is_recent(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.is_recent(F.col("ts"), F.lit(AS_OF).cast("timestamp_ntz"), 200).alias("recent"))


def date_range(spark, d) -> DataFrame:
    bound = lambda x: F.lit(x).cast("timestamp_ntz")
    return table(spark, d, "orders").where(V.in_range(F.col("o_orderdate"), bound("1995-01-01"), bound("1996-12-31"))).select("o_orderkey", "o_orderdate")


def json_props(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.json_field(F.col("props"), "k", "bigint").alias("k"))


def keyword_arrays(spark, d) -> DataFrame:
    """Keywords of an article joined, of which the first three, and those beside its tags."""
    k = F.col("metadata.keywords")
    return table(spark, d, "articles").select("row_id", F.array_join(F.array_sort(V.difference_of(k, F.col("tags"))), ", ").alias("others"), V.join_first(k, 3).alias("first_three"), F.size(V.union_of(k, F.col("tags"))).alias("n_all"))


def keyword_split(spark, d) -> DataFrame:
    x = F.translate(F.coalesce("title", F.lit("")), " ", ";")
    return table(spark, d, "articles").select("row_id", F.array_join(V.split_keywords(x), "|").alias("words"))


def content_digests(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", V.sha256(F.col("text")).alias("sha256"), V.md5(F.col("text")).alias("md5"))


QUERIES = {
    **more.QUERIES,
    **{f.__name__: f
    for f in (
        p6_found, p6_kinds, url_validate, url_normalize, url_hash, url_domain_key, frontier_dedup, frontier_outcomes, seen_antijoin, seen_count, search_dedup, search_filter, search_topk, keyword_sanitize, build_query,
        source_semi, source_unknown, source_catalogue, content_hash_dups, text_replace, text_nfc, boilerplate_lines, dedup_lines, clean_text, clean_title, clean_snippet, word_count, language_guess, is_recent,
        date_range, json_props, keyword_arrays, keyword_split, content_digests,
        P.validity_filter, P.language_filter, P.pipeline_outcomes, P.pipeline_stats, P.html_articles, P.flagship, K.csv_flatten, K.upsert_latest, K.upsert_counts, K.failed_records, K.jsonl_rows,
    )},
}
flagship = P.flagship

# ---- the same in SQL -------------------------------------------------------------------------
# Fixed values as SQL expects them, written out so that a wrong one in the engine shows.
_SQL_TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "msclkid", "yclid", "ref", "source", "_ga", "mc_cid", "mc_eid", "si"]
_SQL_EXTENSIONS = ["pdf", "jpg", "jpeg", "png", "gif", "svg", "webp", "mp4", "mp3", "avi", "zip", "tar", "gz", "exe", "css", "js", "xml", "json", "rss"]
_SQL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.mx", "com.ar", "com.cn", "com.tr", "co.in", "co.za", "co.kr", "com.sg", "com.hk"]
_SQL_BLOCKED = ["google.com", "google.co.uk", "bing.com", "yahoo.com", "duckduckgo.com", "reddit.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "youtube.com", "t.co", "bit.ly"]
_SQL_BOILERPLATE = [r"^(share|tweet|email|print|save|copy link|bookmark)(\s+this)?(\s+article)?$", "^advertisement$", "^continue reading (below|this article)", "^sponsored content$", "^follow us on", "^click here to", "^read more[:.]?$", "sign up for (our|the) newsletter", "^subscribe (to|for)", "^you might also like", "^also read[:.]?$"]
_SQL_STOPWORDS = {"en": "the and of in to for with on at was by said", "fr": "le la les des du et une dans pour sur est avec", "de": "der die das und den von im nach ein eine mit aus", "es": "el los las y con una por del para su tras en", "it": "il gli della di che un una per dopo nel con ha", "pt": "o os da do uma em disse com não para após as"}
_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g')"
_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _part(x: str, i: int) -> str:
    return f"regexp_extract({_strip(x)}, '{_PARTS}', {i})"


def _quoted(items: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


_EXT = "|".join(_SQL_EXTENSIONS)
_HOST = f"lower(regexp_replace(regexp_replace({_part('url', 2)}, '^.*@', ''), ':[0-9]*$', ''))"
_KIND = rf"regexp_extract(lower({_part('url', 3)}), '(\.(?:{_EXT}))$', 1)"
_VALID = f"coalesce(lower({_part('url', 1)}) in ('http', 'https') and {_part('url', 2)} <> '', false)"
_REASON = f"""case when coalesce({_strip('url')}, '') = '' then 'Empty URL' when not {_VALID} then 'Invalid scheme or missing netloc'
  when {_KIND} <> '' then 'Non-article file type (' || {_KIND} || ')' when {_HOST} in ({_quoted(_SQL_SUFFIXES)}, '') or regexp_matches({_HOST}, '^\\.*$') then 'Could not extract domain' end"""
_QUERY_PAIRS = f"list_transform(string_split({_part('url', 4)}, '&'), lambda p, i: {{'k': url_decode(replace(regexp_extract(p, '^([^=]*)=', 1), '+', ' ')), 'i': i, 'v': url_decode(replace(regexp_extract(p, '^[^=]*=(.*)', 1), '+', ' '))}})"
_ENC = "replace(url_encode({0}), '%20', '+')"
_QUERY = f"list_transform(list_sort(list_filter({_QUERY_PAIRS}, lambda p: p.v <> '' and p.k not in ({_quoted(_SQL_TRACKING)}))), lambda p: {_ENC.format('p.k')} || '=' || {_ENC.format('p.v')})"
_PATH = f"regexp_replace(regexp_replace({_part('url', 3)}, ';[^/]*$', ''), '/+$', '')"
_CANON = f"""(case when {_part('url', 1)} <> '' then lower({_part('url', 1)}) || ':' else '' end || case when {_part('url', 2)} <> '' then '//' || lower({_part('url', 2)}) else '' end
  || case when {_PATH} = '' then '/' else {_PATH} end || case when len({_QUERY}) > 0 then '?' || array_to_string({_QUERY}, '&') else '' end)"""
_DOMAIN = f"regexp_replace(lower({_part('url', 2)}), '^[w.]+', '')"
_FRONTIER = f"""with f as (
  select url, row_id as seq, 0 as priority, 'direct' as via from articles where source = 'direct'
  union all select url, coalesce(rank, 1000000), 1, 'search' from search_results
  union all select url, api_row_id, 2, 'newsapi' from newsapi_articles
), v as (select {_strip('url')} as url, seq, priority, via, {_REASON} as reason, sha256({_CANON}) as article_id from f),
r as (select *, row_number() over (partition by article_id, reason is null order by priority, seq, url, via) as n from v)
"""
_REPL = "replace(replace(translate({0}, '‘’“”– ', '''''\"\"- '), '—', '--'), '…', '...')"
_REPLACED = "regexp_replace(" + _REPL + r", '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g')"
_CONTROLS = r"regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g')"


def _normal(x: str) -> str:
    return _CONTROLS.format(_REPLACED.format(f"nfc_normalize({x})"))


def _boiler(x: str) -> str:
    known = "|".join(f"(?:{p})" for p in _SQL_BOILERPLATE)
    return rf"({x} <> '' and ((regexp_matches({x}, '^(?:[^\s\p{{Z}}]+[\s\p{{Z}}]?){{1,3}}$') and length({x}) < 30 and not regexp_matches({x}, '[.!?]$')) or regexp_matches({x}, '(?i){known}')))"


def _key(x: str) -> str:
    return rf"regexp_replace({_strip(f'lower({x})')}, '[\s\p{{Z}}]+', ' ', 'g')"


def _first_lines(rows: str) -> str:
    return f"""with l as (select row_id, unnest(string_split(body, chr(10))) as t, unnest(range(len(string_split(body, chr(10))))) as i from ({rows})),
k as (select *, {_key('t')} as k from l), n as (select *, row_number() over (partition by row_id, k order by i) as n from k)
select row_id, string_agg(t, chr(10) order by i) as body from n where k = '' or n = 1 group by row_id"""


_WORDS = r"regexp_split_to_array(lower(text), '[^\p{L}]+')"
_VOTES = "list_value(" + ", ".join(f"{{'n': len(list_intersect({_WORDS}, [{_quoted(ws.split())}])), 'k': '{k}'}}" for k, ws in sorted(_SQL_STOPWORDS.items())) + ")"
_TITLE = rf"regexp_replace({_strip(_normal('title'))}, '[\s\p{{Z}}]*[|\-–—][\s\p{{Z}}]*[^|\-–—]{{3,50}}$', '')"
_SNIP = _strip(_normal("text"))

ORACLES: dict[str, str] = {
    "url_validate": f"select row_id, ({_REASON}) is null as valid, {_REASON} as reason from articles",
    "url_normalize": f"select row_id, {_CANON} as canonical, regexp_replace({_strip('url')}, '/+$', '') as cleaned from articles",
    "url_hash": f"select row_id, sha256({_CANON}) as url_hash from articles",
    "url_domain_key": f"select {_part('url', 2)} as netloc, {_DOMAIN} as domain_key, count(*) as n from search_results group by all",
    "frontier_dedup": _FRONTIER + "select article_id, priority, seq, url from r where reason is null and n = 1",
    "frontier_outcomes": _FRONTIER + "select via as discovered_via, case when reason is not null then reason when n > 1 then 'duplicate' else 'accepted' end as outcome, count(*) as n from r group by all",
    "seen_antijoin": "select article_id, row_id from articles a where not exists (select 1 from extraction_results e where e.success and e.article_id = a.article_id)",
    "seen_count": "select count(distinct article_id) as n from articles",
    "search_dedup": "select query, url, rank from (select *, row_number() over (partition by query, url order by rank nulls last, title nulls last, snippet nulls last) as n from search_results where coalesce(url, '') <> '') where n = 1",
    "search_filter": f"""select url, rank, query from (select *, row_number() over (partition by url order by rank nulls last, query nulls last, snippet nulls last) as n from search_results
      where {_VALID} and {_DOMAIN} not in ({_quoted([*_SQL_BLOCKED, 'osprey24.example'])}) and length({_strip("coalesce(snippet, '')")}) >= 20) where n = 1""",
    "search_topk": """select query, rank, url from (select *, row_number() over (partition by query order by rank nulls last, url nulls last) as k from
      (select *, row_number() over (partition by query, url order by rank nulls last, title nulls last, snippet nulls last) as n from search_results where coalesce(url, '') <> '' and query is not null) where n = 1) where k <= 10""",
    "keyword_sanitize": r"""select p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(p_name || '; -' || p_type || '- (new) ''x''', '[^\p{L}\p{N}\p{Mn}_\s\p{Z}\-'']', '', 'g'), '[\s\p{Z}]+'), lambda t: trim(t, '-')), lambda t: t <> ''), ' ') as keyword from part""",
    "build_query": f"""select p_partkey, case when contains({_strip('p_name')}, ' ') then '"' || {_strip('p_name')} || '"' else {_strip('p_name')} end || ' site:news.example -' || regexp_replace({_strip('p_type')}, '^-+', '') || ' -ads' as q from part""",
    "source_semi": "select api_row_id, source_name from newsapi_articles where source_name in (select source_name from sites)",
    "source_unknown": "select distinct source_name from newsapi_articles where source_name is null or source_name not in (select source_name from sites)",
    "source_catalogue": "select domain as id, source_name as name from sites where site_lang = 'en' and country = 'GB'",
    "content_hash_dups": f"select md5({_key('text')}) as h, count(*) as n from documents where text is not null group by 1 having count(*) > 1",
    "text_replace": f"select row_id, {_CONTROLS.format(_REPLACED.format('body'))} as body from articles",
    "text_nfc": "select row_id, nfc_normalize(title) as title from articles",
    "boilerplate_lines": f"with l as (select row_id, {_strip('unnest(string_split(body, chr(10)))')} as line, unnest(range(len(string_split(body, chr(10))))) as line_no from articles) select row_id, line_no from l where {_boiler('line')}",
    "dedup_lines": f"select a.row_id, f.body from articles a left join ({_first_lines('select row_id, body from articles where body is not null')}) f using (row_id)",
    "clean_text": f"""select a.row_id, md5(coalesce({_strip("regexp_replace(f.body, '\\n{3,}', chr(10) || chr(10), 'g')")}, '')) as body_md5 from articles a left join ({_first_lines(f"select row_id, string_agg(t, chr(10) order by i) as body from (select row_id, {_strip('t')} as t, i from (select row_id, unnest(string_split(b, chr(10))) as t, unnest(range(len(string_split(b, chr(10))))) as i from (select row_id, regexp_replace({_normal('body')}, '[ \\t]+', ' ', 'g') as b from articles where body is not null))) where not {_boiler('t')} group by row_id")}) f using (row_id)""",
    "clean_title": f"select row_id, {_TITLE} as title from articles",
    "clean_snippet": rf"""select doc_id, case when length({_SNIP}) > 1000 then regexp_replace(substring({_SNIP}, 1, 1000), ' [^ ]*$', '') || '…' else {_SNIP} end as snippet, case when length(title) > 40 then regexp_replace(substring(title, 1, 40), ' [^ ]*$', '') || '…' else title end as short_title from documents""",
    "word_count": r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) as words, case when len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) > 0 then floor((len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) + 10) / 20.0) / 10 end as minutes from documents",
    "language_guess": rf"select doc_id, case when length({_strip('text')}) < 50 then null when regexp_matches(text, '\p{{Cyrillic}}(?:.*\p{{Cyrillic}}){{9}}') then 'ru' when list_max({_VOTES}).n >= 2 then list_max({_VOTES}).k end as lang from documents",
    "is_recent": f"select event_id, coalesce(ts > timestamp '{AS_OF}' - interval 201 day, false) as recent from events",
    "date_range": "select o_orderkey, o_orderdate from orders where o_orderdate between timestamp '1995-01-01' and timestamp '1996-12-31'",
    "json_props": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
    "keyword_arrays": """select row_id, array_to_string(list_sort(list_distinct(list_filter(coalesce(metadata.keywords, []), lambda x: not list_contains(coalesce(tags, []), x)))), ', ') as others, array_to_string(metadata.keywords[1:3], ', ') as first_three,
      len(list_distinct(list_concat(coalesce(metadata.keywords, []), coalesce(tags, [])))) as n_all from articles""",
    "keyword_split": f"select row_id, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(coalesce(title, ''), ' ', ';'), '[,;]'), lambda x: {_strip('x')}), lambda x: x <> ''), '|') as words from articles",
    "content_digests": "select doc_id, sha256(text) as sha256, md5(text) as md5 from documents",
    "language_filter": "",
    "jsonl_rows": "select to_json({'query': query, 'url': url, 'rank': rank}) as line from search_results",
    **P.oracles(_normal, _strip, _TITLE),
    **K.ORACLES,
}
ORACLES |= more.oracles(_FRONTIER, _strip, _part, _TITLE)
ORACLES["language_filter"] = f"select doc_id from ({ORACLES['language_guess']}) where lang is null or lang = 'en'"
ORACLES["flagship"] = f"""select a.row_id, a.url, {_TITLE} as title, case when length(a.body) > 0 then c.body_md5 else md5(a.body) end as body_md5,
  case when length({_strip(_normal('a.snippet'))}) > 1000 then regexp_replace(substring({_strip(_normal('a.snippet'))}, 1, 1000), ' [^ ]*$', '') || '…' else {_strip(_normal('a.snippet'))} end as snippet
  from articles a join ({ORACLES['clean_text']}) c using (row_id) join ({ORACLES['pipeline_outcomes']}) o using (row_id) where o.outcome = 'cleaned'"""
