"""HTML kernel, frontier, outcomes, sinks, sources, streaming and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from newsloom import cli, config, retry
from newsloom.operators import dom
from newsloom.operators import frontier as D
from newsloom.operators import search as S
from newsloom.plans import orchestrate
from newsloom.plans import pipeline as P
from newsloom.sources import fetch, sinks
from newsloom.sources import search as R
from newsloom.streaming import incremental

PAGE = """<html><head><title>Test Article | Example News</title><meta property="og:title" content="Test Article"><meta property="og:description" content="A great test article about AI.">
<meta property="og:image" content="https://x.example/hero.jpg"><meta name="author" content="Jane Smith"><meta property="article:published_time" content="2024-03-15T10:00:00Z"><meta name="keywords" content="a; b,, c">
<link rel="canonical" href="https://x.example/articles/test"><script type="application/ld+json">{"headline": "LD", "author": {"name": "LD Author"}, "datePublished": "2020-01-01"}</script></head>
<body><nav id="main-nav"><ul><li>Home</li></ul></nav><div class="sidebar widget"><ul><li>noise one</li></ul></div><article><h1>Test Article</h1>
<p>%s<p>%s</p><img src="hero.jpg" width="800px" alt=" big "><img src="hero.jpg"><img data-src="//cdn.example/b.png" width="auto"><img src="data:x"><img src="/wp-content/uploads/c.png"></article><footer>foot</footer></body></html>""" % ("First paragraph of the text. " * 12, "Second paragraph. " * 10)


def test_extract_page():
    a = dom.article(PAGE, "https://x.example/articles/test")
    assert a["error"] is None and a["title"] == "Test Article" and a["author"] == "Jane Smith" and a["dates"] == ["2024-03-15T10:00:00Z"]
    assert "First paragraph" in a["body"] and "noise" not in a["body"] and "foot" not in a["body"]
    assert a["metadata"]["keywords"] == ["a", "b", "c"] and a["metadata"]["canonical_url"] == "https://x.example/articles/test"
    assert [i["url"] for i in a["images"]] == ["https://x.example/articles/hero.jpg", "https://cdn.example/b.png"]  # uploads/ counts as noise
    assert a["images"][0] == {"url": "https://x.example/articles/hero.jpg", "alt": "big", "width": 800, "height": None} and a["thumbnail_url"] == "https://x.example/hero.jpg"


def test_uncleaned_tree_reads_jsonld():
    root = dom.parse(PAGE)
    assert dom.author(root) == "LD Author" and dom.published(root) == ["2020-01-01"] and dom.jsonld(root)["headline"] == "LD"
    root = dom.parse('<script type="application/ld+json">[{"author": ["Ann"]}]</script><script type="application/ld+json">{bad</script>')
    assert dom.author(root) == "Ann"


def test_scores_and_bodies():
    assert dom.density(4, 264, 0) == pytest.approx(92.8)
    assert dom.score(dom.parse("<div></div>")) == 0
    text = "A sentence of the body that is long enough to count. " * 6
    linked = f"<body><div><p><a href='#'>{text}</a></p></div><section><p>{text}</p><p>{text}</p></section></body>"
    assert dom.body(dom.parse(linked)) == " ".join([text.strip()] * 2)
    assert dom.body(dom.parse(f"<body><b>{text[:150]}</b></body>")).startswith("A sentence") and dom.body(dom.parse("<body>short</body>")) is None
    assert dom.body(dom.parse("<div>" * 3000)) is None


def test_run_outcomes(spark):
    pages = spark.createDataFrame([("https://a.example/1", PAGE, None), ("https://a.example/2", None, "HTTP 404"), ("https://a.example/3", "<title>x</title>", None), ("https://a.example/4", "<title>Only a title</title><body>tiny</body>", None)], "url string, html string, error string")
    frontier = D.accepted(D.union_sources(("direct", spark.createDataFrame([(f"https://a.example/{i}", i) for i in (1, 2, 3, 4, 5)] + [("https://a.example/1?utm_source=z", 9), (None, 10)], "url string, seq long"))))
    tagged = P.run(frontier, pages, lang="en").cache()
    got = {r["url"][-1]: (r["outcome"], r["reason"]) for r in tagged.collect()}
    assert got["1"] == ("cleaned", None) and got["2"] == ("extract_failed", "HTTP 404") and got["5"] == ("extract_failed", "No HTML received")
    assert got["3"][1].startswith("Parse error") and got["4"][1].startswith("Parse error") and len(got) == 5
    s = P.stats(tagged).first()
    assert (s["total"], s["successful"], s["failed"]) == (5, 1, 4)
    assert sinks.failed(tagged).count() == 4
    assert tagged.where("url = 'https://a.example/1'").first()["published_at"].year == 2024


def test_callback_for_each_row(spark, caplog):
    got = []

    def on_article(row):
        got.append(row["url"])
        if row["url"] == "u1":
            raise ValueError("no")

    orchestrate.call_each(spark.createDataFrame([("u1",), ("u2",)], "url string"), on_article)
    assert sorted(got) == ["u1", "u2"] and "on_article failed for u1" in caplog.text


def test_validity(spark):
    df = spark.createDataFrame([("T", "X" * 300, None), ("T", "Too short", None), ("T", None, "s"), (None, "X" * 300, None)], "title string, body string, snippet string")
    assert [r[0] for r in df.select(P.is_valid()).collect()] == [True, False, True, False]


def test_frontier(spark):
    df = spark.createDataFrame([("https://a.example/1", 1), ("https://a.example/2", 2), ("invalid", 3), ("https://a.example/1", 4), ("https://a.example/1", 4), (None, 5)], "url string, seq long")
    j = D.judge(D.union_sources(("direct", df)), D.accepted(D.union_sources(("x", df.where("seq = 2")))).select("article_id"))
    assert sorted(str(r["reject_reason"])[:9] for r in j.collect()) == ["Empty URL", "Invalid s", "None", "duplicate", "duplicate", "seen"]


def test_result_filter(spark):
    s = "A snippet that is long enough."
    df = spark.createDataFrame([("q", "https://a.example/1", 1, s), ("q", "https://a.example/1", 2, s), ("q", "https://www.google.com/x", 3, s), ("q", "https://b.example/", 4, "short"), ("q", None, 5, s), ("q", "https://c.example/", 6, None)], "query string, url string, rank int, snippet string")
    assert [r["rank"] for r in S.filter_results(df, order=["rank"]).collect()] == [1]
    assert S.filter_results(df, allowed=["b.example"]).count() == 0
    assert S.top_results(df, 2).count() == 2 and S.dedup_results(df).count() == 4


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("k1", 1, "x"), ("k1", 2, "y"), ("k2", 1, None), (None, 1, "z")], "article_id string, v int, title string")
    last = sinks.latest(a, "article_id", ["v"])
    assert {r["article_id"]: r["title"] for r in last.collect()} == {"k1": "y", "k2": None}
    assert sinks.write_keyed(last, str(tmp_path / "t"), buckets=4).first()[:] == (2, 0, 0, 2)
    assert sinks.find_by_id(spark, str(tmp_path / "t"), "article_id", "k1", 4).first()["title"] == "y"
    more = spark.createDataFrame([("k2", 7, "changed"), ("k9", 1, "c"), ("k1", 2, "y")], a.schema)
    assert sinks.write_keyed(more, str(tmp_path / "t"), buckets=4).first()[:] == (1, 1, 1, 2)
    assert {r["article_id"]: r["title"] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"k1": "y", "k2": "changed", "k9": "c"}
    assert sinks.find_by(spark, str(tmp_path / "t"), "title", "c").first()["article_id"] == "k9" and sinks.count_rows(spark, str(tmp_path / "t")) == 3
    up = sinks.upsert(last, spark.createDataFrame([("k2", 5, "new"), ("k3", 1, "c")], a.schema), "article_id", ["v"])
    assert up.count() == 3 and up.where("article_id = 'k2'").first()["title"] == "new"
    assert sinks.upsert_count(last, up, "article_id", ["v", "title"]).first()[:] == (1, 1, 1, 2)
    arts = spark.read.parquet("/root/testdata/sf0.001/articles.parquet")
    sinks.write_csv(arts, str(tmp_path / "c"), bom=True)
    head = next((tmp_path / "c").glob("*.csv")).read_text(encoding="utf-8").split("\n")[0]
    assert head.startswith("﻿article_id,") and head.count(",") == len(sinks.CSV_COLUMNS) - 1
    sinks.write_jsonl(a, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert json.loads(sinks.json_array(a).first()[0])
    D.mark_seen(last, str(tmp_path / "s"))
    assert D.load_seen(spark, str(tmp_path / "s")).count() == 2 and D.load_seen(spark, str(tmp_path / "none")).count() == 0


def fake_hits():
    def hits(query, most, region, safesearch):
        if query == "bad":
            raise OSError("down")
        return [{"href": f"https://s.example/{query}/{i // 2}", "title": "t", "body": "A snippet that is long enough."} for i in range(30)]

    return hits


def fake_api():
    def get(endpoint, params):
        if params["q"] == "denied":
            return 401, "{}"
        return 200, json.dumps({"status": "ok", "totalResults": 2, "articles": [{"title": None, "url": "https://n.example/1", "publishedAt": "2024-01-01T00:00:00Z", "source": {"id": None, "name": "N"}}, {"url": None}]})

    return get


def test_sources(spark):
    R.register(spark)
    r = spark.read.format("newsloom_search").option("keywords", "one\nbad").option("max_results", 5).option("delay", 0.01).option("transport", "tests.test_pipeline:fake_hits").load().orderBy("query", "rank").collect()
    assert [x["rank"] for x in r if x["query"] == "one"] == [1, 3, 5, 7, 9] and [x["error"] for x in r if x["query"] == "bad"] == ["down"]
    p = spark.read.format("newsloom_api").option("keywords", "k\ndenied").option("transport", "tests.test_pipeline:fake_api").load().cache()
    assert p.where("query = 'denied'").first()["error"] == "[401] Invalid API key."
    rows = R.api_articles(p.where("error is null").select("payload")).collect()
    assert [(x["title"], x["url"]) for x in rows] == [("", "https://n.example/1"), ("", "")] and rows[0]["source_name"] == "N"
    c = spark.createDataFrame([('{"sources": [{"id": "a", "category": "tech"}, {"id": null}]}',)], "payload string")
    assert R.catalogue(c, category="tech").count() == 1


def test_api_client():
    waits = []
    with pytest.raises(R.ApiError) as e:
        R.api_get(lambda *_: (500, '{"message": "m"}'), "everything", {}, 3, 2.0, sleep=waits.append)
    assert e.value.code == 500 and waits == [1.0, 2.0]
    with pytest.raises(R.RateLimitError):
        R.api_get(lambda *_: (429, ""), "x", {}, 1)
    with pytest.raises(ValueError, match="empty"):
        R.search_params(" ")
    assert R.top_headline_params(sources=["a", "b"], category="c", page_size=500) == {"language": "en", "pageSize": 100, "page": 1, "sources": "a,b"}


def test_download():
    calls = []

    def get(url):
        calls.append(url)
        if "404" in url:
            return 404, b"", None, url
        if "boom" in url:
            raise OSError
        return 200, "é".encode("latin-1"), "latin-1", url + "/final"

    assert fetch.download("u", get) == ("é", "u/final", None)
    assert fetch.download("404", get) == (None, None, "HTTP 404") and fetch.download("boom", get) == (None, None, "Max retries exceeded") and calls.count("boom") == 3


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("https://a.example/1",), ("https://a.example/1?utm_id=2",), ("bad",)], "url string").coalesce(1).write.json(str(src))
    pages = spark.createDataFrame([("https://a.example/1", PAGE), ("https://a.example/1?utm_id=2", PAGE)], "url string, html string")
    seen = []
    for _ in range(2):  # the second run finds nothing new
        stream = incremental.fresh_urls(spark.readStream.schema("url string").json(str(src)))
        q = incremental.run(stream, fetch.TableFetcher(pages).fetch, lambda df, n: seen.extend(r["outcome"] for r in df.collect()), str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert seen == ["cleaned"]


def test_cli(spark, tmp_path, capsys):
    spark.createDataFrame([("https://a.example/1", PAGE)], "url string, html string").write.parquet(str(tmp_path / "pages"))
    args = ["--urls", "https://a.example/1", "https://a.example/x.pdf", "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "out")]
    assert cli.main(args, spark) == 0 and "successful: 1" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "out/cleaned")).count() == 1
    with pytest.raises(SystemExit):
        cli.main([], spark)


def test_two_runs_keep_both(spark, tmp_path, caplog):
    """Later runs keep earlier articles in full and do not fetch what was seen; searches that fail are logged."""
    second = PAGE.replace("Test Article", "Second Article")
    spark.createDataFrame([("https://a.example/1", PAGE), ("https://a.example/2", second), ("https://s.example/deep/story", second)], "url string, html string").write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([("solar power", "https://s.example/deep/story", "T", "A snippet that is long enough.", 1), ("solar power", "", "T", "", 2), ("other", "https://s.example/x", "T", "A snippet that is long enough.", 1)], "query string, url string, title string, snippet string, rank int").write.parquet(str(tmp_path / "hits"))
    args = ["--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "out"), "--seen", "--urls"]
    assert cli.main([*args, "https://a.example/1"], spark) == 0
    assert cli.main([*args, "https://a.example/1", "https://a.example/2", "--ddg", "--search-transport", "newsloom.sources.search:replay", "--search-table", str(tmp_path / "hits"), "--keywords", "solar power"], spark) == 0
    rows = {r["url"]: r for r in spark.read.parquet(str(tmp_path / "out/cleaned")).collect()}
    assert set(rows) == {"https://a.example/1", "https://a.example/2", "https://s.example/deep/story"}
    assert all(len(r["images"]) == 2 and r["metadata"]["keywords"] == ["a", "b", "c"] and r["tags"] == [] for r in rows.values())
    assert spark.read.parquet(str(tmp_path / "out/raw")).count() == 3 and D.load_seen(spark, str(tmp_path / "out/seen")).count() == 3
    assert cli.main(["--out", str(tmp_path / "none"), "--ddg", "--search-transport", "tests.test_pipeline:fake_hits", "--keywords", "bad"], spark) == 0
    assert "search failed for 'bad': down" in caplog.text


def test_search_requests():
    page = '<div class="result"><a class="result__a" href="//d.example/l/?uddg=https%3A%2F%2Fn.example%2F1&rut=x">The <b>title</b></a><a class="result__snippet" href="#">A  snippet <b>here</b>.</a></div><a class="result__a" href="https://n.example/2">Two</a>'
    assert R.result_page(page) == [{"href": "https://n.example/1", "title": "The title", "body": "A snippet here."}, {"href": "https://n.example/2", "title": "Two", "body": ""}]
    assert R.query_text(" -solar; power- (new)", "n.example", ["-ads", "--"]) == "solar power new site:n.example -ads"
    assert R.search_params("q", from_date="2024-03-01", to_date="no date")["from"] == "2024-03-01T00:00:00+00:00" and "to" not in R.search_params("q", to_date="???")
    assert R.source_params(category="tech", country="gb") == {"category": "tech", "country": "gb"}


def seen_api():
    def get(endpoint, params):
        body = {"sources": [{"id": "a", "category": params.get("category")}]} if endpoint == "sources" else {"articles": [{"url": f"{endpoint}/{params.get('q')}/{params.get('country')}"}]}
        return 200, json.dumps({"status": "ok", **body})

    return get


def test_api_endpoints(spark):
    R.register(spark)
    read = lambda **o: spark.read.format("newsloom_api").options(transport="tests.test_pipeline:seen_api", **o).load().select("payload")
    assert R.api_articles(read(endpoint="top-headlines", country="gb")).first()["url"] == "top-headlines/None/gb"
    assert R.catalogue(read(endpoint="sources", category="tech"), category="tech").first()["id"] == "a"


def test_broadcast_bound(spark):
    from newsloom.common import small

    rows = spark.createDataFrame([(i, "x" * 1000, ["y" * 100]) for i in range(100)], "id long, t string, a array<string>")
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().logical().toString().lower()
    assert hinted(small(rows)) and not hinted(small(rows, most=50)) and not hinted(small(rows, most_bytes=50_000))


def test_config_and_retry(tmp_path):
    (tmp_path / "env").write_text("MAX_RETRIES=7\n# x\nLOG_DIR='l'\n")
    s = config.load(str(tmp_path / "env"), tmp_path, {"REQUEST_TIMEOUT": "5"})
    assert (s.max_retries, s.request_timeout, s.log_dir) == (7, 5, tmp_path / "l")
    n = []
    assert retry.retry(3, sleep=lambda _: None)(lambda: n.append(1) or (1 / 0 if len(n) < 3 else "ok"))() == "ok"
    with retry.Timer() as t:
        pass
    assert t.elapsed_ms >= 0
    retry.configure_logging(tmp_path / "log").info("x")
    assert F is not None
