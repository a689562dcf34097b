"""Built-in functions against their stated cases, and every query against its SQL."""

import datetime as dt
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsloom import queries as Q
from newsloom.functions import text as T
from newsloom.functions import urls as U
from newsloom.functions import values as V
from newsloom.operators import html as H
from newsloom.operators import search as S
from newsloom.sources import search as R

DATA = "/root/testdata/sf0.001"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def cleaned(spark, value, f):
    return T.composed(spark.createDataFrame([(value,)], "v string"), "v").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Example.COM/path/?utm_source=x&b=2&a=1&a=0#top", "https://example.com/path?a=1&a=0&b=2"),
        ("https://example.com", "https://example.com/"),
        (" http://e.example/a;v=1?UTM_SOURCE=k&x=&y ", "http://e.example/a?UTM_SOURCE=k"),
        ("https://e.example/a?q=a b*~&c=%C3%A9", "https://e.example/a?c=%C3%A9&q=a+b%2A~"),
        ("https://e.example//", "https://e.example/"),
        (None, None),
    ],
)
def test_url_normalize(spark, url, want):
    assert one(spark, url, U.normalize_url) == want
    assert one(spark, want, U.normalize_url) == want


@pytest.mark.parametrize(("url", "reason"), [("https://example.com/article", None), ("", "Empty URL"), (None, "Empty URL"), ("ftp://x.example/a", "Invalid scheme or missing netloc"), ("https://x.example/a.PDF", "Non-article file type (.pdf)"), ("https://x.example/a.jpg", "Non-article file type (.jpg)"), ("https://co.uk/a", "Could not extract domain"), ("https://x.example/a b?q=1 2", None)])
def test_url_validate(spark, url, reason):
    got = one(spark, url, U.validate_url)
    assert (got["valid"], got["reason"]) == (reason is None, reason)


def test_url_keys(spark):
    assert one(spark, "https://www.wired.com:80/x", U.domain_key) == "ired.com:80"
    assert one(spark, "https://user@Host.example:1/x", U.netloc) == "user@Host.example:1"
    assert one(spark, "/b/c", lambda c: U.resolve_relative_url(F.lit("https://a.example/x/"), c)) == "https://a.example/b/c"
    assert one(spark, "//cdn.example/i.png", lambda c: U.resolve_image_url(F.lit("https://a.example/x/"), c)) == "https://cdn.example/i.png"


def test_clean_text(spark):
    assert cleaned(spark, "First paragraph.\nFirst paragraph.\nSecond paragraph.", T.clean_text) == "First paragraph.\nSecond paragraph."
    assert "  " not in cleaned(spark, "Hello    world  \t  test and more of it here", T.clean_text)
    assert cleaned(spark, "Real content.\nShare this article\nMore content.", T.clean_text) == "Real content.\nMore content."
    assert cleaned(spark, None, T.clean_text) == "" and cleaned(spark, "", T.clean_text) == ""
    once = cleaned(spark, "A é​“x” — y…\n\n\n\nHome\nA whole sentence that stays here.", T.clean_text)
    assert once == cleaned(spark, once, T.clean_text) and "--" in once and "é" in once
    long = "\n".join(f"Line number {i} of the text ends here." for i in range(3000)) * 2
    assert len(cleaned(spark, long, T.clean_text).split("\n")) in (3000, 3001)


@pytest.mark.parametrize(("title", "want"), [("Breaking News Story | BBC News", "Breaking News Story"), ("State-of-the-art", "State-of-the"), ("Story — Reuters", "Story -"), ("A | B | C News", "A | B"), (None, None), ("ab", "ab")])
def test_clean_title(spark, title, want):
    assert cleaned(spark, title, T.clean_title) == want


def test_snippet_words_times(spark):
    assert len(cleaned(spark, "word " * 300, T.clean_snippet)) <= 1001
    assert one(spark, "Élan vital x_1", T.count_words) == 3
    assert [one(spark, n, T.reading_time, "int") for n in (0, 30, 200)] == [None, 0.2, 1.0]
    assert one(spark, "Hello   World", T.content_hash) == one(spark, "hello world ", T.content_hash)
    assert one(spark, "short", T.detect_language) is None
    assert one(spark, "The council of the town said that the bridge was closed for the winter.", T.detect_language) == "en"
    assert one(spark, b"ab\xff", T.decode_bytes, "binary") == "ab�"


def test_keywords_and_queries(spark):
    assert one(spark, "hello; DROP TABLE--", S.sanitize_keyword) == "hello DROP TABLE"
    assert one(spark, " AI   news ", S.sanitize_keyword) == "AI news"
    assert one(spark, "climate change", lambda c: S.build_query(c, F.lit("bbc.com"), F.array(F.lit("sports"), F.lit("-ads"), F.lit(" ")), exact=True)) == '"climate change" site:bbc.com -sports -ads'


def test_dates(spark):
    parse = lambda v: one(spark, v, V.parse_date)
    assert parse("2024-03-15T10:00:00Z") == dt.datetime(2024, 3, 15, 10)
    assert parse("Fri, 15 Mar 2024 10:00:00 +0100") == dt.datetime(2024, 3, 15, 9)
    assert parse("March 15, 2024") == dt.datetime(2024, 3, 15)
    assert parse("garbage") is None and parse(" ") is None and parse(None) is None
    ts = F.lit("2024-03-15 10:00:00.5").cast("timestamp")
    assert spark.range(1).select(V.format_iso(ts)).first()[0] == "2024-03-15T10:00:00.500000+00:00"
    as_of = F.lit("2024-03-15").cast("timestamp")
    assert spark.range(1).select(V.is_recent(F.lit("2025-01-01").cast("timestamp"), as_of), V.is_recent(F.lit(None).cast("timestamp"), as_of)).first()[:] == (True, False)


def test_dates_beyond_the_formats(spark):
    parse = lambda v: one(spark, v, V.parse_date)
    assert parse("2024/03/14") == dt.datetime(2024, 3, 14) and parse("03/14/2024 5:30 PM") == dt.datetime(2024, 3, 14, 17, 30)
    assert parse("March 14, 2024 10:00 AM") == dt.datetime(2024, 3, 14, 10) and parse("Published 3 Mar 2024") == dt.datetime(2024, 3, 3)
    assert one(spark, "3 Mar", lambda c: V.parse_date(c, dt.datetime(2020, 1, 1))) == dt.datetime(2020, 3, 3)
    many = one(spark, ["garbage", None, "2024/03/14 09:00 +0100", "2024-03-15"], V.parse_dates, "array<string>")
    assert many == [None, None, dt.datetime(2024, 3, 14, 8), dt.datetime(2024, 3, 15)]
    pages = spark.createDataFrame([("https://a.example/1", f"<title>A title</title><meta name='date' content='Published 3 Mar 2024'><article><p>{'A sentence of the body. ' * 20}</p></article>", None, None)], "url string, html string, final_url string, error string")
    assert H.extract(pages, "direct", None).first()["published_at"] == dt.datetime(2024, 3, 3)
    assert H.extract(pages.withColumn("html", F.replace("html", F.lit("<meta name='date' content='Published 3 Mar 2024'>"), F.lit(""))), "direct", None).first()["published_at"] is None
    payloads = spark.createDataFrame([('{"articles": [{"url": "u", "publishedAt": "2024/03/14"}]}',)], "payload string")
    assert R.api_articles(payloads).first()["published_at"] == dt.datetime(2024, 3, 14)


def test_maps_and_json(spark):
    m = spark.sql("select map('a', '1', 'b', '2') as a, map('b', '3') as b")
    assert m.select(V.merge_maps(F.col("a"), F.col("b"))).first()[0] == {"a": "1", "b": "3"}
    assert m.select(V.keep_keys(F.col("a"), ["b"])).first()[0][0]["key"] == "b"
    assert one(spark, '[{"k": "x"}]', lambda c: V.json_field(c, "k")) == "x" and one(spark, "{bad", lambda c: V.json_field(c, "k")) is None


def test_same_as_sql(spark):
    con = duckdb.connect()
    for t in ("articles", "newsapi_articles", "search_results", "extraction_results", "sites", "documents", "events", "orders", "part", "lineitem"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")

    def rows(df, cols):
        return sorted(tuple(re.sub(r"\.0$", "", str(v)) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())

    for name, sql in Q.ORACLES.items():
        got, want = Q.QUERIES[name](spark, DATA).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns)), name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
