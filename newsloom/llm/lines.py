"""Problem 4: lines repeated across the documents of one site.

Normalised lines are hashed; each document counts once for each of its distinct
lines (map-side combined), and lines above a document share of their site are
removed from every document. The frequent lines of a site number at most
(mean lines per document) / share, whatever its size, which keeps the joined
back side small; it is broadcast only after its size is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.common import small, table
from newsloom.functions.sites import with_site

#: Blanks stripped from the ends of a line.
BLANKS = " \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85                 　"


def line_keys(body: Column) -> Column:
    """Normalised lines of a body in order: trimmed, lower case, runs of blanks one space, runs of 0-9 one sign."""
    text = F.regexp_replace(F.regexp_replace(F.lower(body), "[ \t]+", " "), "[0-9]+", "0")
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def frequent_lines(df: DataFrame, group: str, body: str, least_rows: int = 5, least_share: float = 0.08) -> DataFrame:
    """(group, a, b, n_rows): hashes of the lines in at least `least_rows` rows and `least_share` of all rows of the group.

    Rows count also when repeated, null or empty; a line counts once per row.
    Rows without a group form none. Blank lines are never frequent.
    """
    x = df.where(F.col(group).isNotNull()).select(F.col(group).alias("__nl_g"), F.col(body).alias("__nl_b"))
    totals = x.groupBy("__nl_g").agg(F.count(F.lit(1)).alias("__nl_all"))
    each = x.select("__nl_g", F.explode(F.array_distinct(line_keys(F.col("__nl_b")))).alias("__nl_l")).where("__nl_l <> ''")
    counts = each.select("__nl_g", F.inline(F.array(_hash(F.col("__nl_l"))))).groupBy("__nl_g", "a", "b").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least_rows)
    return counts.join(totals, "__nl_g").where(F.col("n_rows") >= F.col("__nl_all") * F.lit(least_share)).select(F.col("__nl_g").alias("__nl_fg"), "a", "b", "n_rows")


def with_frequent(df: DataFrame, group: str, frequent: DataFrame) -> DataFrame:
    """Add `__nl_set`, the frequent line hashes of the row's group (null if none)."""
    side = small(frequent.groupBy("__nl_fg").agg(F.collect_list(F.struct("a", "b")).alias("__nl_set")), 20_000)  # rows of some hundred hashes each
    return df.join(side, F.col(group) == F.col("__nl_fg"), "left").drop("__nl_fg")


def mark_repeated_lines(df: DataFrame, group: str, body: str, least_rows: int = 5, least_share: float = 0.08) -> DataFrame:
    """One row per repeated line of each row: the columns of `df` without `body`, and `line_no` from 0.

    Null bodies give nothing, copies of a row each give theirs.
    """
    marked = with_frequent(df, group, frequent_lines(df, group, body, least_rows, least_share)).where("__nl_set is not null")
    keep = [c for c in df.columns if c not in (body, "line_no")]
    lines = marked.select(*keep, "__nl_set", F.posexplode(line_keys(F.col(body))).alias("line_no", "__nl_l")).where("__nl_l <> ''")
    return lines.where(F.array_contains("__nl_set", _hash(F.col("__nl_l")))).select(*keep, F.col("line_no").cast("bigint").alias("line_no"))


def remove_repeated_lines(df: DataFrame, group: str, body: str, least_rows: int = 5, least_share: float = 0.08) -> DataFrame:
    """`df` with `body` rebuilt without the repeated lines of its group; null stays null, other lines stay as they are."""
    marked = with_frequent(df, group, frequent_lines(df, group, body, least_rows, least_share))
    pairs = F.arrays_zip(F.split(F.col(body), "\n").alias("t"), line_keys(F.col(body)).alias("k"))
    kept = F.filter(pairs, lambda p: (p["k"] == "") | ~F.array_contains("__nl_set", _hash(p["k"])))
    rebuilt = F.when(F.col("__nl_set").isNull(), F.col(body)).otherwise(F.array_join(F.transform(kept, lambda p: p["t"]), "\n"))
    return marked.withColumn(body, rebuilt).select(*df.columns)


def _articles(spark, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles").select("row_id", "url", "body")
    return with_site(a, table(spark, sf_dir, "sites"), "url", ["domain"]).drop("url")


def p4_found(spark, sf_dir: str) -> DataFrame:
    """(row_id, line_no) of every line repeated across its site."""
    return mark_repeated_lines(_articles(spark, sf_dir), "domain", "body").select("row_id", "line_no")


def p4_clean(spark, sf_dir: str) -> DataFrame:
    """(row_id, body): every body without the lines repeated across its site."""
    return remove_repeated_lines(_articles(spark, sf_dir), "domain", "body").select("row_id", "body")


P4_FOUND_SQL = r"""
with a as (
  select row_id, body, (select max(s.domain) from sites s where h = s.domain or ends_with(h, '.' || s.domain)) as site
  from (select row_id, body, regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) as h from articles)
), l as (
  select row_id, site, unnest(string_split(body, chr(10))) as t, unnest(range(len(string_split(body, chr(10))))) as line_no from a where site is not null
), k as (
  select row_id, site, line_no, trim(regexp_replace(regexp_replace(lower(t), '[ \t]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ' || chr(9) || chr(13) || chr(160)) as key from l
), c as (
  select site, key, count(distinct row_id) as n from k where key <> '' group by all
), f as (
  select c.site, c.key from c join (select site, count(*) as total from a group by site) t on c.site = t.site where n >= 5 and n >= 0.08 * total
)
select k.row_id, k.line_no from k join f on k.site = f.site and k.key = f.key
"""
