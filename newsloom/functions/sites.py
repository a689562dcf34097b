"""Hosts of URLs and the site that a row belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.common import BROADCAST_ROWS, strip

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and outer spaces; '' if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(strip(url), F.lit("")), _HOST, 1)), F.lit("."))


def name_key(name: Column) -> Column:
    """Spelling-tolerant key of a site's name: its letters and digits in lower case."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def with_site(df: DataFrame, sites: DataFrame, url: str, keep: list[str], name: str | None = None) -> DataFrame:
    """Add the columns `keep` of the row's site; null where the row belongs to none.

    A host belongs to the site whose `domain` it is or ends in (after a dot);
    of several the longest. Hosts are cut to as many labels as the domains have
    and joined on equality, so the test on the ending costs no nested loop. With
    `name`, rows whose URL is blank take the site of that spelled name. `sites`
    is broadcast only if a count shows it small. Columns of `df` with the names in
    `keep` are replaced.
    """
    base = sites.where(F.col("domain").isNotNull()).select(F.lower("domain").alias("__nl_domain"), *[F.col(k).alias(f"__nl_s_{k}") for k in keep], F.col("source_name").alias("__nl_name"))
    base = base.dropDuplicates(["__nl_domain"])
    hint = F.broadcast if base.count() <= BROADCAST_ROWS else (lambda x: x)
    labels = [r[0] for r in base.select(F.size(F.split("__nl_domain", r"\."))).distinct().collect()]
    out = df.withColumn("__nl_host", host(F.col(url)))
    found: list[Column] = []
    for n in sorted(labels, reverse=True):
        part = base.select(F.col("__nl_domain").alias("__nl_key"), F.struct(*[F.col(f"__nl_s_{k}").alias(k) for k in keep]).alias(f"__nl_site_{n}"))
        out = out.join(hint(part), F.substring_index("__nl_host", ".", -n) == F.col("__nl_key"), "left").drop("__nl_key")
        found.append(F.col(f"__nl_site_{n}"))
    if name:
        spelled = base.select(F.explode(F.array_distinct(F.array(name_key(F.col("__nl_name")), name_key(F.col("__nl_domain")), name_key(F.substring_index("__nl_domain", ".", 1))))).alias("__nl_key"), F.struct(*[F.col(f"__nl_s_{k}").alias(k) for k in keep]).alias("__nl_site_0"))
        spelled = spelled.where("__nl_key <> ''").dropDuplicates(["__nl_key"])
        own = F.when(F.coalesce(strip(F.col(url)), F.lit("")) == "", name_key(F.col(name)))
        out = out.join(hint(spelled), own == F.col("__nl_key"), "left").drop("__nl_key")
        found.append(F.col("__nl_site_0"))
    site = F.coalesce(*found) if found else F.struct(*[F.lit(None).cast("string").alias(k) for k in keep])
    return out.withColumn("__nl_site", site).select(*[F.col(f"`{c}`") for c in df.columns if c not in keep], *[F.col("__nl_site")[k].alias(k) for k in keep])
