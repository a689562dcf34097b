"""Problem 6: time stamps in many notations, precisions and zones become UTC instants.

Every value is parsed by built-in expressions into calendar fields and a zone
text. Values without an offset are local times; they meet the UTC-offset
intervals of their zone in an as-of join: the intervals are exploded to the
years they touch, so the join is an equality on (zone, year) with the interval
test inside the few candidates of that year. Two matching intervals mean an
ambiguous local time, none a skipped one, one gives the offset directly.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.common import staged, strip, table
from newsloom.functions.sites import with_site

# Month names and their usual short forms, January first.
MONTHS = {
    "en": ["january jan", "february feb", "march mar", "april apr", "may", "june jun", "july jul", "august aug", "september sep sept", "october oct", "november nov", "december dec"],
    "de": ["januar jan jänner", "februar feb feber", "märz mär mrz", "april apr", "mai", "juni jun", "juli jul", "august aug", "september sep sept", "oktober okt", "november nov", "dezember dez"],
    "fr": ["janvier janv", "février févr fév", "mars", "avril avr", "mai", "juin", "juillet juil", "août", "septembre sept", "octobre oct", "novembre nov", "décembre déc"],
    "es": ["enero ene", "febrero feb", "marzo mar", "abril abr", "mayo may", "junio jun", "julio jul", "agosto ago", "septiembre setiembre sep sept", "octubre oct", "noviembre nov", "diciembre dic"],
    "it": ["gennaio gen", "febbraio feb", "marzo mar", "aprile apr", "maggio mag", "giugno giu", "luglio lug", "agosto ago", "settembre set", "ottobre ott", "novembre nov", "dicembre dic"],
    "pt": ["janeiro jan", "fevereiro fev", "março mar", "abril abr", "maio mai", "junho jun", "julho jul", "agosto ago", "setembro set", "outubro out", "novembro nov", "dezembro dez"],
    "ru": ["января январь янв", "февраля февраль фев", "марта март мар", "апреля апрель апр", "мая май", "июня июнь июн", "июля июль июл", "августа август авг", "сентября сентябрь сен сент", "октября октябрь окт", "ноября ноябрь ноя", "декабря декабрь дек"],
}

_TIME = r"(\d{1,2})[:hH](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\b\.?|\s+Uhr|\s+[Чч]\.?)?"
_ZONE = r"(?:\s*\[?(Z|z|[+\-−]\d{2}:?\d{2}|[+\-−]\d{2}|[A-Za-z]{2,5}|(?:UTC|GMT)[+\-]\d{1,2}(?::?\d{2})?|[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+)\]?)?"
_OPT = rf"(?:(?:,?\s+(?:à|um|at|alle|às|a\s+las|в)\s+|,\s*|\s+|[Tt]){_TIME}{_ZONE})?"
_DAY = r"(?:[\p{L}.]+,\s*|[\p{L}]+day\s+)?"
# Each notation rewrites to year|month|day|hour|minute|second|fraction|half|zone.
_NOTATIONS = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_OPT}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^{_DAY}(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_OPT}$", "$3|?$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^{_DAY}(\d{{1,2}})(?:er|st|nd|rd|th|º|\.)?[\s-]+(?:de\s+)?([\p{{L}}]{{3,10}})\.?,?[\s-]+(?:de\s+)?(\d{{4}})(?:\s+г\.?)?{_OPT}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^{_DAY}([\p{{L}}]{{3,10}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_OPT}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]


def zone_intervals(names: list[str], first: int = 1900, last: int = 2100) -> list[tuple]:
    """(zone, start, end, offset, abbreviation) in UTC seconds; the outer intervals stay open.

    Changes are found by weekly steps and bisection to the second.
    """
    out, week, lo, hi = [], 7 * 86400, int(dt.datetime(first, 1, 1, tzinfo=dt.UTC).timestamp()), int(dt.datetime(last, 1, 1, tzinfo=dt.UTC).timestamp())
    zero = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    for name in names:
        zone = zoneinfo.ZoneInfo(name)

        def at(t: int, zone=zone) -> tuple:
            d = (zero + dt.timedelta(seconds=t)).astimezone(zone)
            return int(d.utcoffset().total_seconds()), d.tzname()

        start, now, t = -(1 << 52), at(lo), lo
        while t < hi:
            step = min(t + week, hi)
            if at(step) != now:
                a, b = t, step
                while b - a > 1:
                    m = (a + b) // 2
                    a, b = (m, b) if at(m) == now else (a, m)
                out.append((name, start, b, *now))
                start, now, step = b, at(b), b
            t = step
        out.append((name, start, 1 << 52, *now))
    return out


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date, by arithmetic that cannot fail."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("bigint")


def parse_fields(df: DataFrame, value: str, order: str) -> DataFrame:
    """Add `__nl_epoch` (instants in microseconds, of numeric epochs), `__nl_local` (local microseconds) and `__nl_zone`.

    All are null where the value states no existing calendar date. `order` is
    the column with `dmy` or `mdy`; anything else counts as `dmy`.
    """
    month = {w: i + 1 for names in MONTHS.values() for i, ws in enumerate(names) for w in ws.split()}
    lookup = F.create_map(*[F.lit(x) for kv in month.items() for x in kv])
    v = F.regexp_replace(strip(F.col(value)), r"[\s\p{Z}]+", " ")
    out = staged(df, {"__nl_v": v})
    v = F.col("__nl_v")
    parts = F.lit(None).cast("string")
    for pattern, to in reversed(_NOTATIONS):
        parts = F.when(v.rlike(pattern), F.regexp_replace(v, pattern, to)).otherwise(parts)
    number = v.rlike(r"^(\d{9,10}|\d{12,13}|\d{15,16}|\d{9,10}\.\d{1,6})$")
    epoch = (F.when(v.rlike(r"^\d{9,10}$"), v.try_cast("bigint") * 1000000).when(v.rlike(r"^\d{12,13}$"), v.try_cast("bigint") * 1000).when(v.rlike(r"^\d{15,16}$"), v.try_cast("bigint")).when(v.rlike(r"^\d{9,10}\.\d{1,6}$"), (v.try_cast("decimal(20,6)") * 1000000).try_cast("bigint")))
    out = staged(out, {"__nl_epoch": epoch, "__nl_p": F.split(F.when(~number, parts), r"\|")})
    p = lambda i: F.col("__nl_p")[i]
    num = lambda i: p(i).try_cast("int")
    swap = p(1).startswith("?") & F.coalesce(F.col(order) == "mdy", F.lit(False))
    second = F.regexp_replace(p(1), r"^\?", "")
    out = staged(out, {"__nl_y": num(0), "__nl_m": F.when(swap, num(2)).when(second.rlike(r"^\d+$"), second.try_cast("int")).otherwise(F.try_element_at(lookup, F.lower(second))), "__nl_d": F.when(swap, second.try_cast("int")).otherwise(num(2)), "__nl_half": F.lower(p(7)), "__nl_h": F.coalesce(num(3), F.lit(0))})
    y, m, d, h, half = (F.col(f"__nl_{x}") for x in ("y", "m", "d", "h", "half"))
    last = F.when(m == 2, F.when(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    hour = F.when(half == "", h).when((h < 1) | (h > 12), 99).when(half == "p", h % 12 + 12).otherwise(h % 12)
    minute, sec = F.coalesce(num(4), F.lit(0)), F.coalesce(num(5), F.lit(0))
    micros = F.rpad(p(6), 6, "0").try_cast("int")
    good = (y >= 1) & m.between(1, 12) & d.between(1, last) & hour.between(0, 23) & minute.between(0, 59) & sec.between(0, 59)
    local = (_days(y.cast("bigint"), m.cast("bigint"), d.cast("bigint")) * 86400 + hour * 3600 + minute * 60 + sec) * 1000000 + F.coalesce(micros, F.lit(0))
    out = staged(out, {"__nl_local": F.when(good, local), "__nl_zone": F.when(good, p(8)), "__nl_year": F.when(good, y)})
    return out.select(*df.columns, "__nl_epoch", "__nl_local", "__nl_zone", "__nl_year")


def to_utc(df: DataFrame, value: str, zone: str, order: str, out: str = "epoch_us", kind: str | None = None) -> DataFrame:
    """Add column `out`: microseconds since 1970 of the UTC instant that `value` states, else null.

    With `kind`, a column of that name says how it was found: `offset` (stated by
    the value), or by the number of intervals that match the local time, `unique`,
    `ambiguous` (two, the earlier instant is taken) or `skipped` (none).

    Null, blank, relative and impossible values give null. `zone` holds the row's
    IANA zone (null or unknown: UTC), `order` its `dmy` or `mdy`. An ambiguous
    local time is the earlier instant, a skipped one is read with the offset
    before the change. A zone abbreviation is one of the row's zone and fixes the
    offset where that zone has it. Rows are kept one to one, repeats included.
    The zones needed are those that occur; there are at most as many as the time
    zone database has, which bounds the broadcast interval table.
    """
    spark = df.sparkSession
    df = df.drop(out, *([kind] if kind else []))
    x = parse_fields(df, value, order)
    z = F.col("__nl_zone")
    sign = F.when(F.regexp_extract(z, r"([+\-−])", 1) == "+", 1).otherwise(-1)
    digits = F.regexp_replace(F.regexp_extract(z, r"[+\-−]([\d:]+)$", 1), ":", "")
    full = F.when(F.length(digits) <= 2, F.rpad(F.lpad(digits, 2, "0"), 4, "0")).otherwise(F.lpad(digits, 4, "0"))
    offset = F.when(z.rlike(r"^(?i)(Z|UTC|GMT)$"), 0).when(~z.contains("/") & z.rlike(r"[+\-−]\d"), sign * (F.substring(full, 1, 2).try_cast("int") * 3600 + F.substring(full, 3, 2).try_cast("int") * 60))
    known = sorted(zoneinfo.available_timezones())
    named = F.when(z.contains("/"), z)
    x = staged(x, {"__nl_off": offset, "__nl_tz": F.coalesce(named, F.col(zone), F.lit("UTC")), "__nl_abbr": F.when(~z.contains("/") & offset.isNull(), F.upper(F.nullif(z, F.lit(""))))})
    # one narrow pass over the values finds the zones that occur, at most len(known)
    used = [r[0] for r in x.where("__nl_local is not null and __nl_off is null").select("__nl_tz").where(F.col("__nl_tz").isin(known)).distinct().collect()]
    rows = zone_intervals(used)
    intervals = spark.createDataFrame(rows or [("UTC", -(1 << 52), 1 << 52, 0, "UTC")], "tz string, start long, end long, off int, abbr string")
    day = 86400
    local_year = lambda c: F.floor((c / day + 719468) / 365.2425).cast("int")
    years = F.sequence(F.greatest(local_year(F.col("start") + F.col("off") - 20 * day), F.lit(1899)), F.least(local_year(F.col("end") + F.col("off") + 20 * day), F.lit(2101)))
    exploded = intervals.withColumn("year", F.explode(years)).groupBy("tz", "year").agg(F.collect_list(F.struct("start", "end", "off", "abbr")).alias("__nl_iv"))
    names = intervals.groupBy("tz", "abbr").agg(F.max("off").alias("off")).groupBy("tz").agg(F.map_from_entries(F.collect_list(F.struct("abbr", "off"))).alias("__nl_abbrs"))
    side = exploded.join(names, "tz").withColumnsRenamed({"tz": "__nl_jz", "year": "__nl_jy"})
    bucket = F.least(F.greatest(F.col("__nl_year"), F.lit(1899)), F.lit(2101))
    x = x.join(F.broadcast(side), (F.when(F.col("__nl_off").isNull(), F.col("__nl_tz")) == F.col("__nl_jz")) & (bucket == F.col("__nl_jy")), "left")
    secs = F.floor(F.col("__nl_local") / 1000000)
    hit = F.filter("__nl_iv", lambda i: (secs >= i["start"] + i["off"]) & (secs < i["end"] + i["off"]))
    x = staged(x, {"__nl_hit": hit})
    before = F.filter("__nl_iv", lambda i: secs >= i["end"] + i["off"])
    # ambiguous: the earlier instant has the larger offset; skipped: the latest interval that ended before
    chosen = F.when(F.size("__nl_hit") >= 1, F.array_max(F.transform("__nl_hit", lambda i: i["off"]))).otherwise(F.array_max(F.transform(before, lambda i: F.struct(i["end"], i["off"])))["off"])
    off = F.coalesce("__nl_off", F.try_element_at("__nl_abbrs", "__nl_abbr"), chosen)
    # a zone that no database knows: an own one makes the value no date, the row's counts as UTC
    strange = F.coalesce(F.col("__nl_zone").contains("/"), F.lit(False)) & F.col("__nl_jz").isNull()
    off = F.when(~strange, F.coalesce(off, F.lit(0)))
    cols = {out: F.coalesce(F.col("__nl_epoch"), F.col("__nl_local") - off.cast("bigint") * 1000000)}
    if kind:
        stated = F.coalesce("__nl_off", F.try_element_at("__nl_abbrs", "__nl_abbr")).isNotNull() | F.col("__nl_epoch").isNotNull()
        n = F.coalesce(F.size("__nl_hit"), F.lit(1))
        cols[kind] = F.when(cols[out].isNull(), None).when(stated, "offset").when(F.col("__nl_jz").isNull() | (n == 1), "unique").when(n == 0, "skipped").otherwise("ambiguous")
    return staged(x, cols).select(*df.columns, *cols)


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Every `published_at` of both tables that states a date, as UTC microseconds."""
    return p6_kinds(spark, sf_dir).select("table_name", "row_id", "epoch_us")


def p6_kinds(spark, sf_dir: str) -> DataFrame:
    """The same with `kind`: whether the offset was stated, or the local time unique, ambiguous or skipped."""
    sites = table(spark, sf_dir, "sites")
    a = with_site(table(spark, sf_dir, "articles").select(F.lit("articles").alias("table_name"), "row_id", "url", "published_at"), sites, "url", ["tz_name", "date_order"])
    b = with_site(table(spark, sf_dir, "newsapi_articles").select(F.lit("newsapi_articles").alias("table_name"), F.col("api_row_id").alias("row_id"), "url", "source_name", "published_at"), sites, "url", ["tz_name", "date_order"], name="source_name").drop("source_name")
    return to_utc(a.unionByName(b), "published_at", "tz_name", "date_order", kind="kind").where("epoch_us is not null").select("table_name", "row_id", "epoch_us", "kind")
