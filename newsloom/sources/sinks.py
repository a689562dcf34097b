"""Outputs: JSON Lines, CSV, keyed upserts, failed records, the seen set."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.common import stored, table
from newsloom.functions.urls import url_hash

# Fixed value: the columns of the CSV export, in order.
CSV_COLUMNS = ["article_id", "url", "title", "author", "published_at", "source", "source_url", "search_query", "snippet", "body_preview", "word_count", "reading_time_minutes", "language", "thumbnail_url", "tags", "status", "scraped_at", "processing_time_ms", "error_message"]


def run_name(now: dt.datetime | None = None) -> str:
    """SNK-13: the name of one run's exports."""
    return f"articles_{(now or dt.datetime.now(dt.UTC)):%Y%m%d_%H%M%S}"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def flatten(df: DataFrame) -> DataFrame:
    """SNK-07: articles as rows of text for CSV; null becomes '', 0 too where it means unknown, body and snippet are previews."""
    number = lambda c: F.when(c.isNull() | (c == 0), "").otherwise(c.cast("string"))
    m = F.col("metadata")
    values = {
        "snippet": F.substring(_text(F.col("snippet")), 1, 500),
        "body_preview": F.translate(F.substring(_text(F.col("body")), 1, 300), "\n", " "),
        "word_count": number(m["word_count"]),
        "reading_time_minutes": number(m["reading_time_minutes"]),
        "language": _text(m["language"]),
        "tags": F.coalesce(F.array_join("tags", ", "), F.lit("")),
        "scraped_at": F.coalesce(F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")),
        "processing_time_ms": F.bround(F.coalesce("processing_time_ms", F.lit(0.0)), 2),
    }
    return df.select(*[values.get(c, _text(F.col(c)) if c in df.columns else F.lit("")).alias(c) for c in CSV_COLUMNS])


def write_csv(df: DataFrame, path: str, append: bool = False, bom: bool = False) -> None:
    """SNK-05, SNK-06: CSV with a header in each part, so that each can be read by itself; `bom` starts each with a byte order mark.

    Spark writes no mark, so the first header name carries it; `read_csv` takes it off.
    """
    out = flatten(df)
    if bom:
        out = out.withColumnRenamed(CSV_COLUMNS[0], "\ufeff" + CSV_COLUMNS[0])
    out.write.mode("append" if append else "overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_csv(spark, path: str) -> DataFrame:
    """The rows that `write_csv` wrote, as text; empty texts come back empty."""
    x = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\0").csv(path)
    return x.toDF(*[c.removeprefix("\ufeff") for c in x.columns])


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """SNK-03: one JSON object a line, nulls kept."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def json_array(df: DataFrame) -> DataFrame:
    """SNK-04: one row with all rows as a JSON array; for results that fit one value only."""
    return df.agg(F.to_json(F.array_sort(F.collect_list(F.struct("*")))).alias("json"))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """SNK-01, SNK-08: the last row of each key by `order`; rows without a key are dropped.

    A partial maximum finds the last row, so a hot key is not gathered.
    """
    rest = [c for c in df.columns if c != key]
    at = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    x = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(at).alias("__nl_last"))
    return x.select(*[F.col(c) if c == key else F.col("__nl_last")[c].alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """SNK-08: the table after the upsert of `new` into `old`."""
    x = old.withColumn("__nl_new", F.lit(0)).unionByName(new.withColumn("__nl_new", F.lit(1)))
    return latest(x, key, ["__nl_new", *order]).drop("__nl_new")


def upsert_count(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """SNK-09: (inserted, modified, unchanged, n): `n` counts inserted and modified rows only."""
    o = old.select(F.col(key).alias("__nl_k"), F.hash(*values).alias("__nl_o"), F.xxhash64(*values).alias("__nl_o2"))
    x = new.where(F.col(key).isNotNull()).select(key, F.hash(*values).alias("__nl_n"), F.xxhash64(*values).alias("__nl_n2")).join(o, F.col(key) == F.col("__nl_k"), "left")
    same = (F.col("__nl_n") == F.col("__nl_o")) & (F.col("__nl_n2") == F.col("__nl_o2"))
    out = x.agg(F.count_if(F.col("__nl_k").isNull()).alias("inserted"), F.count_if(F.col("__nl_k").isNotNull() & ~same).alias("modified"), F.count_if(F.coalesce(same, F.lit(False))).alias("unchanged"))
    return out.withColumn("n", F.col("inserted") + F.col("modified"))


def write_keyed(df: DataFrame, path: str, key: str = "article_id", order: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """SNK-01, SNK-02, SNK-08: upsert into a keyed table, in partitions by the key's hash for point lookups; the counts of `upsert_count`.

    Only the buckets that `df` touches are read and written anew, into a folder
    of their own before they take the place of the old ones, so keys of earlier
    runs stay. Of several rows of a key the last by `order` counts.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c != key]
    order = order or []
    bucket = lambda x: x.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    new = bucket(stored(latest(df, key, order)))
    known = stored_table(spark, path)
    old = (known if known is not None else spark.createDataFrame([], new.schema)).join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi")  # at most `buckets` rows
    old = stored(old.select(*[F.col(c) if c in old.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns]))
    counts = stored(upsert_count(old, new, key, rest))
    both = stored(upsert(old, new, key, []))  # read before its place is written
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return counts


def stored_table(spark, path: str) -> DataFrame | None:
    """The table at `path`, None if there is none yet; other errors end the run."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def find_by_id(spark, path: str, key: str, value: str, buckets: int = 64) -> DataFrame:
    """SNK-10: the row of a key; only its partition is read."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(buckets))).first()[0]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col(key) == value)).drop("bucket")


def find_by(spark, path: str, column: str, value) -> DataFrame:
    """SNK-10: the rows of a keyed table with a value in another column; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col(column) == value).drop("bucket")


def count_rows(spark, path: str, status: str | None = None) -> int:
    """SNK-10: how many rows a keyed table has, with a status if one is named."""
    x = spark.read.parquet(path)
    return (x.where(F.col("status") == status) if status else x).count()


def write_raw(df: DataFrame, path: str) -> None:
    """PIP-01: the extracted rows before they are validated, appended in full."""
    df.write.mode("append").parquet(path)


def failed(tagged: DataFrame) -> DataFrame:
    """SNK-11: the records of failed URLs; rows dropped for their language have none."""
    x = tagged.where(F.col("outcome").isin("extract_failed", "insufficient"))
    return x.select(url_hash(F.col("url")).alias("article_id"), "url", F.lit("[FAILED]").alias("title"), F.col("reason").alias("snippet"), F.col("reason").alias("error_message"), F.lit("failed").alias("status"))


def csv_flatten(spark, d) -> DataFrame:
    return flatten(table(spark, d, "articles"))


def jsonl_rows(spark, d) -> DataFrame:
    """Rows as JSON, of columns that both engines write alike."""
    return table(spark, d, "search_results").select(F.to_json(F.struct("query", "url", "rank"), {"ignoreNullFields": "false"}).alias("line"))


def upsert_latest(spark, d) -> DataFrame:
    a = table(spark, d, "articles").select("article_id", "scraped_at", "row_id", "status")
    return latest(a, "article_id", ["scraped_at", "row_id"])


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    """The state after the first scrapes of all articles, and the last scrapes."""
    a = table(spark, d, "articles").select("article_id", "row_id", F.coalesce("title", F.lit("")).alias("title"))
    w = Window.partitionBy("article_id")
    x = a.withColumns({"lo": F.min("row_id").over(w), "hi": F.max("row_id").over(w)})
    return x.where("row_id = lo").select("article_id", "title"), x.where("row_id = hi").select("article_id", "title")


def upsert_counts(spark, d) -> DataFrame:
    old, new = _halves(spark, d)
    return upsert_count(old, new, "article_id", ["title"])


def failed_records(spark, d) -> DataFrame:
    from newsloom.plans.pipeline import _scraped, tag

    return failed(tag(_scraped(spark, d))).select("url", "title", "snippet", "status")


_T = "coalesce(cast({0} as varchar), '')".format
_N = "case when {0} is null or {0} = 0 then '' else cast({0} as varchar) end".format
_BAD = "case when status = 'failed' or length(coalesce(title, '')) < 3 then coalesce(error_message, 'Unknown error') when not (length(coalesce(title, '')) > 0 and (length(coalesce(body, '')) >= 200 or length(coalesce(snippet, '')) > 0)) then 'Insufficient content' end"
ORACLES = {
    "csv_flatten": f"""select article_id, {_T('url')} as url, {_T('title')} as title, {_T('author')} as author, {_T('published_at')} as published_at, {_T('source')} as source, {_T('source_url')} as source_url, {_T('search_query')} as search_query,
      substring({_T('snippet')}, 1, 500) as snippet, replace(substring({_T('body')}, 1, 300), chr(10), ' ') as body_preview, {_N('metadata.word_count')} as word_count, {_N('metadata.reading_time_minutes')} as reading_time_minutes, {_T('metadata.language')} as language, {_T('thumbnail_url')} as thumbnail_url,
      coalesce(array_to_string(tags, ', '), '') as tags, {_T('status')} as status, coalesce(strftime(scraped_at, '%Y-%m-%dT%H:%M:%S'), '') as scraped_at, round_even(coalesce(processing_time_ms, 0), 2) as processing_time_ms, {_T('error_message')} as error_message from articles""",
    "upsert_latest": "select article_id, scraped_at, row_id, status from (select *, row_number() over (partition by article_id order by scraped_at desc nulls last, row_id desc) as n from articles where article_id is not null) where n = 1",
    "upsert_counts": """with w as (select article_id, coalesce(title, '') as title, row_id, min(row_id) over (partition by article_id) as lo, max(row_id) over (partition by article_id) as hi from articles), o as (select * from w where row_id = lo), n as (select * from w where row_id = hi)
      select 0 as inserted, count(*) filter (n.title <> o.title) as modified, count(*) filter (n.title = o.title) as unchanged, count(*) filter (n.title <> o.title) as n from n join o using (article_id)""",
    "failed_records": f"select url, '[FAILED]' as title, {_BAD} as snippet, 'failed' as status from articles where {_BAD} is not null",
}
