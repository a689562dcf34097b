"""Small helpers shared by every operator: tables, lineage cuts, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Above this many rows or bytes a side is never broadcast by hand; Catalyst chooses the join instead.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20

#: Unicode-aware strip: Java's \s and SQL's trim() know ASCII blanks only.
EDGE_BLANKS = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+\z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`.

    Only where the session names none and runs in one process (tests, local
    mode) is a temporary folder of this machine set instead.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = getattr(sc, "_newsloom_dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="newsloom-")
        sc._newsloom_dir = named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise `df` with a reliable checkpoint, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame) -> DataFrame:
    """Like `cut`, but as a columnar Parquet table: later reads can prune its columns. It is deleted when the driver ends."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"newsloom-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _temporary_tables.append((spark, path))
    return spark.read.parquet(path)


_temporary_tables: list[tuple[SparkSession, str]] = []


@atexit.register
def drop_temporary_tables() -> None:
    """Delete the tables of `stored`; a long-lived driver can call this when no result of theirs is needed any more."""
    while _temporary_tables:
        spark, path = _temporary_tables.pop()
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            conf = spark._jsc.hadoopConfiguration() if spark.sparkContext._jsc else spark._jvm.org.apache.hadoop.conf.Configuration()
            place.getFileSystem(conf).delete(place, True)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder is then its owner's to clear
            return


def _bytes(c: Column, kind: S.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, S.StringType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, S.ArrayType):
        each = F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, kind.elementType)) if isinstance(kind.elementType, S.StringType) else F.size(c) * (8 * max(1, len(getattr(kind.elementType, "fields", [0]))))
        return F.coalesce(each, F.lit(0)) + 8
    if isinstance(kind, S.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` materialised, with a broadcast hint only if it is seen to have at most `most` rows and `most_bytes` bytes."""
    kept = cut(df)
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    n, held = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(kept) if n <= most and held <= most_bytes else kept


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(c, EDGE_BLANKS, "")


def temporary(*names: str) -> list[str]:
    """Column names that clash with nothing a caller may have."""
    return [f"__nl_{n}" for n in names]


def staged(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """`df` with `cols` added, each evaluated once.

    A one-row generator is a border that neither projections nor filters are
    merged across, so expressions used several times above are not copied.
    """
    kept = [c for c in df.columns if c not in cols]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each combination of `keys`: the first by `order` (nulls last), ties by the other columns.

    A partial minimum finds it, so a hot key is never gathered in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    by = [*[c for c in order if c in rest], *[c for c in rest if c not in order]]
    at = F.struct(*[x for c in by for x in (F.col(f"`{c}`").isNull().alias(f"n_{c}"), F.col(f"`{c}`").alias(f"v_{c}"))])
    least = df.groupBy(*keys).agg(F.min(at).alias("__nl_first"))
    return least.select(*[F.col(f"`{c}`") if c in keys else F.col("__nl_first")[f"v_{c}"].alias(c) for c in df.columns])
