"""The HTML kernel: pages to articles in one Arrow pass; bad pages become rows with an error."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from newsloom.functions.urls import url_hash
from newsloom.functions.values import parse_dates
from newsloom.operators.dom import article
from newsloom.schemas import IMAGES, METADATA

_FIELDS = [("title", S.StringType()), ("author", S.StringType()), ("dates", S.ArrayType(S.StringType())), ("body", S.StringType()), ("snippet", S.StringType()), ("images", IMAGES), ("thumbnail_url", S.StringType()), ("metadata", METADATA)]


def _kernel(kept: list[str], arrow: pa.Schema, cleaned: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()  # noqa: B023, E731
            rows = []
            for url, html, final, error in zip(col("url"), col("html"), col("final_url"), col("error"), strict=True):
                try:
                    got = {"error": error} if error else article(html, final or url or "", cleaned) if html else {"error": "No HTML received"}
                except Exception as e:  # noqa: BLE001  no page may end the job
                    got = {"error": f"Parse error: {e}"}
                rows.append(got)
            arrays = [batch.column(batch.schema.get_field_index(n)).cast(arrow.field(n).type) for n in kept]
            for name in arrow.names[len(kept) :]:
                values = [r.get("error") is None for r in rows] if name == "_ok" else [r.get("error") for r in rows] if name == "_error" else [r.get(name) if r.get("error") is None else None for r in rows]
                arrays.append(pa.array(values, arrow.field(name).type))
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return run


def extract(df: DataFrame, source: str, query: str | None, as_of: dt.datetime | None = None, cleaned: bool = True) -> DataFrame:
    """Articles of the pages in `df` (url, html, final_url, error, and columns to keep), with `_ok` and `_error`.

    The article's id and URL are those of the final URL; an error of the fetch, a
    missing page and a page without title or content are told apart in `_error`.
    Dates take missing parts from `as_of`, by default the start of today.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in df.columns if c != "html"]
    schema = S.StructType([df.schema[c] for c in kept] + [S.StructField(n, t, True) for n, t in _FIELDS] + [S.StructField("_ok", S.BooleanType()), S.StructField("_error", S.StringType())])
    x = df.mapInArrow(_kernel(kept, to_arrow_schema(schema), cleaned), schema)
    final = F.coalesce("final_url", "url")
    x = x.withColumn("__nl_dates", parse_dates(F.col("dates"), as_of))  # a stage of its own, as functions of arrays cannot hold Python's result
    x = x.withColumns({"source_url": F.when(F.col("url") != final, F.col("url")), "published_at": F.get(F.filter("__nl_dates", lambda t: t.isNotNull()), F.lit(0))}).drop("__nl_dates")
    x = x.withColumns({"article_id": url_hash(final), "url": final, "source": F.lit(source), "search_query": F.lit(query).cast("string"), "tags": F.array().cast("array<string>"), "status": F.lit("raw")})
    return x.drop("dates", "final_url", "error")
