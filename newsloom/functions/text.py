"""Text functions as column expressions; Unicode composition alone needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.common import staged, strip

# Characters replaced, and those removed.
REPLACED = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", " ": " "}
REMOVED = "​‌‍﻿"
# Lines that are boilerplate, without regard to case.
BOILERPLATE_LINES = [
    r"^(share|tweet|email|print|save|copy link|bookmark)(\s+this)?(\s+article)?$",
    r"^advertisement$",
    r"^continue reading (below|this article)",
    r"^sponsored content$",
    r"^follow us on",
    r"^click here to",
    r"^read more[:.]?$",
    r"sign up for (our|the) newsletter",
    r"^subscribe (to|for)",
    r"^you might also like",
    r"^also read[:.]?$",
]
BLANK = r"[\s\p{Z}]"


def replace_chars(c: Column) -> Column:
    """The replacements of TXT-01."""
    one = {k: v for k, v in REPLACED.items() if len(v) == 1}
    x = F.translate(c, "".join(one) + REMOVED, "".join(one.values()))
    for k, v in REPLACED.items():
        if len(v) > 1:
            x = F.replace(x, F.lit(k), F.lit(v))
    return x


def strip_controls(c: Column) -> Column:
    """Without C0 and C1 controls, but for tab, line feed and carriage return."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(c: Column) -> Column:
    """Composed form; plain text never leaves the JVM."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def composed(df: DataFrame, *cols: str) -> DataFrame:
    """`df` with the text of `cols` in composed form, as the cleaning functions below expect it.

    Functions of arrays cannot hold Python's result, so it gets a stage of its own.
    """
    x = df.withColumns({f"__nl_{c}": nfc(F.col(c)) for c in cols})
    x = x.select(*[F.col(f"__nl_{c}").alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])
    return staged(x, {c: F.col(c) for c in cols}).select(*[F.col(f"`{c}`") for c in df.columns])


def normalize(c: Column) -> Column:
    """TXT-01 for composed text: plain punctuation, no controls; null and empty stay."""
    return strip_controls(replace_chars(c))


def is_boilerplate(line: Column) -> Column:
    """TXT-05 for one stripped line: a short label or a known phrase; blank lines are none."""
    short = line.rlike(rf"^(?:[^\s\p{{Z}}]+{BLANK}?){{1,3}}\z") & (F.length(line) < 30) & ~line.rlike(r"[.!?]\z")
    known = line.rlike("(?i)" + "|".join(f"(?:{p})" for p in BOILERPLATE_LINES))
    return (line != "") & (short | known)


def drop_boilerplate(lines: Column) -> Column:
    """TXT-05 over an array of stripped lines."""
    return F.filter(lines, lambda x: ~is_boilerplate(x))


def line_key(line: Column) -> Column:
    return F.regexp_replace(strip(F.lower(line)), rf"{BLANK}+", " ")


def dedup_lines(lines: Column) -> Column:
    """TXT-06: the first of equal lines (without regard to case and blanks); blank lines all stay.

    The first places of the keys come from a map, so long texts take linear time.
    """
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  binds an array once, as lambdas evaluate outer expressions for each element

    def kept(own: Column) -> Column:
        places = F.array_sort(F.transform(own, lambda x, i: F.struct(line_key(x).alias("k"), i.alias("i"))))
        first = bound(places, lambda o: F.filter(o, lambda p, j: (p["k"] == "") | (j == 0) | (F.try_element_at(o, j)["k"] != p["k"])))
        return F.transform(F.array_sort(F.transform(first, lambda p: p["i"])), lambda i: own[i])

    return bound(lines, kept)


def clean_text(c: Column) -> Column:
    """TXT-02: the cleaned body; null and empty become ''."""
    text = F.regexp_replace(normalize(c), r"[ \t]+", " ")
    lines = dedup_lines(drop_boilerplate(F.transform(F.split(text, "\n"), strip)))
    return F.coalesce(strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")), F.lit(""))


def strip_title_suffix(c: Column) -> Column:
    """One site suffix of 3 to 50 characters after a bar or dash less."""
    return F.regexp_replace(c, r"[\s\p{Z}]*[|\-–—][\s\p{Z}]*[^|\-–—]{3,50}\z", "")


def clean_title(c: Column) -> Column:
    """TXT-03: normalised and stripped, without its site suffix."""
    return strip_title_suffix(strip(normalize(c)))


def clean_snippet(c: Column, most: int = 1000) -> Column:
    """TXT-04: normalised and stripped; beyond `most` characters cut at the last space, with an ellipsis."""
    x = strip(normalize(c))
    return F.when(F.length(x) > most, F.concat(F.regexp_replace(F.substring(x, 1, most), r" [^ ]*\z", ""), F.lit("…"))).otherwise(x)


def truncate(c: Column, most: int, suffix: str = "…") -> Column:
    """TXT-07: at most `most` characters up to a word's end, with `suffix` where something is lost."""
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most), r" [^ ]*\z", ""), F.lit(suffix))).otherwise(c)


def count_words(c: Column) -> Column:
    """TXT-08: runs of letters, digits and underscores of any script."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))


def reading_time(words: Column) -> Column:
    """TXT-09: minutes at 200 words each to one place (ties up); null for no words."""
    return F.when(words > 0, F.floor((words + 10) / 20) / 10)


def is_english(lang: Column) -> Column:
    """TXT-11."""
    return F.coalesce(lang == "en", F.lit(False))


def decode_bytes(c: Column, charset: str = "UTF-8") -> Column:
    """TXT-12: bytes as text, with replacement characters for what the charset has not."""
    return F.make_valid_utf8(F.decode(c, F.lit(charset))) if charset != "UTF-8" else F.make_valid_utf8(c.cast("string"))


def content_hash(c: Column) -> Column:
    """DED-09: MD5 of the text without regard to case and blanks; null for null."""
    return F.md5(F.regexp_replace(strip(F.lower(c)), rf"{BLANK}+", " "))


# Frequent words of the languages, for the detector without a model.
STOPWORDS = {
    "en": "the and of in to for with on at was by said",
    "fr": "le la les des du et une dans pour sur est avec",
    "de": "der die das und den von im nach ein eine mit aus",
    "es": "el los las y con una por del para su tras en",
    "it": "il gli della di che un una per dopo nel con ha",
    "pt": "o os da do uma em disse com não para após as",
}


def detect_language(c: Column, least: int = 50) -> Column:
    """TXT-10: the language by script and frequent words; null below `least` characters or without evidence."""
    words = F.array_distinct(F.split(F.lower(c), r"[^\p{L}]+"))
    votes = F.array(*[F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, ws.split())))).alias("n"), F.lit(k).alias("k")) for k, ws in sorted(STOPWORDS.items())])
    best = F.array_max(votes)
    return F.when(F.length(strip(c)) < least, None).when(c.rlike(r"\p{IsCyrillic}(?:.*\p{IsCyrillic}){9}"), "ru").when(best["n"] >= 2, best["k"])
