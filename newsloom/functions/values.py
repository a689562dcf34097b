"""Dates, numbers, arrays, maps, JSON and hashes."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from newsloom.common import strip

# Formats tried in this order; weekday names are taken off before.
FORMATS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX][XX][X]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX][XX][X]", "yyyy-MM-dd'T'HH:mm[XXX]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss zzz", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy"]


def _fuzzy(default: dt.datetime):
    @F.pandas_udf(ArrayType(LongType()))
    def parse(s: pd.Series) -> pd.Series:
        """Microseconds since 1970 of each text."""
        from dateutil import parser

        def one(v: str | None) -> int | None:
            try:
                d = parser.parse(v, fuzzy=True, default=default) if v and v.strip() else None
                return None if d is None else ((d if d.tzinfo else d.replace(tzinfo=dt.UTC)) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
            except (ValueError, OverflowError, TypeError, ArithmeticError):
                return None

        return pd.Series([None if x is None else [one(v) for v in x] for x in s], dtype=object)

    return parse


def _known(c: Column) -> Column:
    x = F.regexp_replace(strip(c), r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in FORMATS])


def parse_dates(texts: Column, as_of: dt.datetime | None = None) -> Column:
    """DAT-01 over an array: the instant of each date in text, naive ones as UTC; null for null, blank or unreadable.

    Known formats are tried first; only what they cannot read goes to the fuzzy
    parser, which takes missing parts from `as_of`, by default the start of today.
    """
    default = as_of or dt.datetime.now(dt.UTC).replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
    rest = F.transform(texts, lambda s: F.when(_known(s).isNull() & (strip(s) != ""), s))
    some = F.exists(rest, lambda s: s.isNotNull())
    read = F.when(some, _fuzzy(default)(F.when(some, rest)))
    known = F.transform(texts, _known)
    return F.coalesce(F.zip_with(known, read, lambda k, r: F.coalesce(k, F.timestamp_micros(r))), known)


def parse_date(c: Column, as_of: dt.datetime | None = None) -> Column:
    """DAT-01 for one text; see `parse_dates`."""
    return parse_dates(F.array(c), as_of)[0]


def ensure_utc(local: Column, zone: Column | str = "UTC") -> Column:
    """DAT-02: a timestamp without zone as an instant."""
    return F.to_utc_timestamp(local, zone)


def utcnow(as_of: dt.datetime | None = None) -> Column:
    """DAT-03: now, or the given instant."""
    return F.current_timestamp() if as_of is None else F.lit(as_of)


def format_iso(ts: Column) -> Column:
    """DAT-04: ISO 8601 with offset, microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.date_format(ts, "xxx"))


def is_recent(ts: Column, as_of: Column, days: int = 30) -> Column:
    """DAT-05: younger than `days` + 1 days, the future included; null is not."""
    return F.coalesce(ts > as_of - F.make_dt_interval(F.lit(days + 1)), F.lit(False))


def in_range(ts: Column, first: Column | None, last: Column | None) -> Column:
    """DAT-06: within inclusive bounds, of which either may be missing."""
    ok = F.lit(True)
    if first is not None:
        ok = ok & (ts >= first)
    if last is not None:
        ok = ok & (ts <= last)
    return F.coalesce(ok, F.lit(False))


def cap(c: Column, most: int) -> Column:
    """MTH-01."""
    return F.least(c, F.lit(most))


def round_half_even(c: Column, places: int) -> Column:
    """MTH-02."""
    return F.bround(c, places)


def split_keywords(c: Column) -> Column:
    """ARR-01: keywords between commas or semicolons, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, "[,;]"), strip), lambda x: x != "")


def join_first(items: Column, n: int, by: str = ", ") -> Column:
    """ARR-02: the first `n` items as one text."""
    return F.array_join(F.slice(items, 1, n), by)


def union_of(a: Column, b: Column) -> Column:
    """ARR-03, union; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, none), F.coalesce(b, none))


def difference_of(a: Column, b: Column) -> Column:
    """ARR-03, difference; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_except(F.coalesce(a, none), F.coalesce(b, none))


def keep_keys(m: Column, keys: list[str]) -> Column:
    """MAP-01: entries of the given keys, sorted by key, as an array."""
    return F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: k.isin(keys))))


def merge_maps(a: Column, b: Column) -> Column:
    """MAP-02: both maps, the second's values winning."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.coalesce(F.map_contains_key(b, k), F.lit(False))), b)


def json_field(c: Column, path: str, kind: str = "string") -> Column:
    """JSN-01: a field of a JSON object, or of the first of an array; null if malformed."""
    v = F.try_parse_json(c)
    return F.coalesce(F.try_variant_get(v, f"$.{path}", kind), F.try_variant_get(v, f"$[0].{path}", kind))


def to_json_row(*cols: str) -> Column:
    """JSN-02: a row as JSON with its nulls."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def sha256(c: Column) -> Column:
    """HSH-01."""
    return F.sha2(c, 256)


def md5(c: Column) -> Column:
    """HSH-01."""
    return F.md5(c)
