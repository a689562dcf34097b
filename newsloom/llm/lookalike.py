"""Problem 3: text that looks the same written with different characters.

Values are mapped to a look-alike form (widths, ligatures, invisible
characters, blanks, hyphens, letters of other scripts), the forms are grouped
under an accent-sensitive Unicode collation, under which composed and
decomposed accents are equal, and each class gets one of its members as its
canonical value, which is joined back.
"""

from __future__ import annotations

import functools
import string
import unicodedata
from collections import Counter

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from newsloom.common import small, staged, stored, table

# Letters of other scripts above the Latin letters that they look like.
_CYRILLIC = "АВЕЅІЈКМНОРСТХаесіјорѕухүһԁԛԝЁЇёїУЗԌ"
_CYRILLIC_AS = "ABESIJKMHOPCTXaecijopsyxyhdqwËÏëïY3G"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορτυχγϲϳόίάύϊ"
_GREEK_AS = "ABEZHIKMNOPTYXaivoptuxycjóíáúï"
_ARMENIAN = "օսոհ"
_ARMENIAN_AS = "ounh"
#: Hyphens that look like the ASCII one.
_HYPHENS = "‐‑﹣－"


def confusables() -> dict[str, str]:
    """Letters outside ASCII with the letter that Unicode's table of confusables gives for them, of the same case where ASCII has one.

    The table is that of the ICU library, which Spark brings along. Digits,
    punctuation and letters that look like several characters are left alone.
    """
    checker = SparkContext._active_spark_context._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    ascii_ = string.ascii_letters
    letters = [c for c in map(chr, [*range(0xAA, 0xAC00), *range(0xF900, 0xFB00), *range(0x10280, 0x11A00), *range(0x16F00, 0x16FA0)]) if (c.isalpha() or unicodedata.category(c) == "Nl") and unicodedata.decomposition(c)[:1] in ("", "<")]
    # one call for all: a line feed is its own skeleton and parts them
    skeletons = checker.getSkeleton("\n".join([*ascii_, *letters])).split("\n")
    plain: dict[tuple[str, str], str] = {}
    for c, skeleton in zip(ascii_, skeletons, strict=False):
        plain[skeleton, unicodedata.category(c)] = c
        plain.setdefault((skeleton, ""), c)
    out = {}
    for c, skeleton in zip(letters, skeletons[len(ascii_) :], strict=True):
        case = unicodedata.category(c)
        to = plain.get((skeleton, case)) or (plain.get((skeleton, "")) if case not in ("Lu", "Ll") else None) or skeleton
        if len(to) == 1 and to != c and to.isalpha():
            out[c] = to
    # composed letters go with their base; a base some of whose composed letters have no counterpart stays as it is
    composed = [(c, d[0], d[1:]) for c in map(chr, range(0xC0, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0] in out]
    for c, base, marks in composed:
        to = unicodedata.normalize("NFC", out.get(base, base) + marks)
        if len(to) == 1:
            out[c] = to
        else:
            out.pop(base, None)
    for c, base, _ in composed:
        if base not in out:
            out.pop(c, None)
    return out


@functools.cache
def mapping() -> tuple[str, str, dict[str, str]]:
    """Characters to translate, their targets (those beyond are dropped), and ligatures with their letters.

    Built by rule from the Unicode database: wide, narrow, font and no-break
    variants, space separators, and format characters with the other default
    ignorable ones; letters by Unicode's table of confusables, see `confusables`.
    To be called where the session is, not inside a kernel.
    """
    one: dict[str, str] = confusables()
    gone: list[str] = ["͏", "ᅟ", "ᅠ", "ㅤ", "ﾠ", *map(chr, range(0xFE00, 0xFE10))]
    many: dict[str, str] = {}
    for code in [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Zs":
            one[c] = " "
        elif kind == "Cf":
            gone.append(c)
        elif c not in gone and (d := unicodedata.decomposition(c)).startswith("<"):
            plain = unicodedata.normalize("NFKC", c)
            if d.startswith(("<wide>", "<narrow>", "<font>", "<noBreak>")) and len(plain) == 1:
                one[c] = plain
            elif d.startswith("<compat>") and len(plain) > 1 and plain.isascii() and plain.isalpha():
                many[c] = plain
    for a, b in ((_CYRILLIC, _CYRILLIC_AS), (_GREEK, _GREEK_AS), (_ARMENIAN, _ARMENIAN_AS), (_HYPHENS, "-" * len(_HYPHENS))):
        one |= dict(zip(a, b, strict=True))
    one["\t"] = " "
    return "".join([*one, *gone]), "".join(one.values()), many


def look(value: Column) -> Column:
    """The look-alike form: one spelling of everything but accents, for comparison under a collation."""
    src, dst, many = mapping()
    x = F.translate(value, src, dst)
    for c, letters in many.items():
        if c in "ﬀﬁﬂﬃﬄﬅﬆĲĳ":
            x = F.replace(x, F.lit(c), F.lit(letters))
    x = F.when(value.rlike(r"[^\x20-\x7E\n]"), x).otherwise(value)
    return F.regexp_replace(F.regexp_replace(x, " {2,}", " "), "^ +| +(?=\n)|(?<=\n) +| +$", "")


def classes(df: DataFrame, scope: list[str], value: str) -> DataFrame:
    """Distinct values of `df` in their scopes with their class: (*scope, __nl_h, __nl_class, canonical).

    `__nl_h` is the SHA-256 of a value, `__nl_class` that of the class's canonical
    member: the least member that is its own look-alike form, else the least.
    Null values belong to no class; the empty text is a value.
    """
    x = df.where(F.col(value).isNotNull()).select(*scope, F.col(value).alias("__nl_v")).withColumn("__nl_h", F.sha2("__nl_v", 256))
    distinct = x.groupBy(*scope, "__nl_h").agg(F.min("__nl_v").alias("__nl_v"))
    formed = distinct.withColumn("__nl_k", look(F.col("__nl_v")))
    key = F.collate("__nl_k", "UNICODE")
    best = formed.groupBy(*scope, key.alias("__nl_c")).agg(F.min(F.struct((F.col("__nl_v") != F.col("__nl_k")).alias("odd"), F.col("__nl_v").alias("v"))).alias("__nl_m"), F.count(F.lit(1)).alias("n_values"))
    names = [f"__nl_scope_{s}" for s in scope]
    best = best.select(*[F.col(s).alias(n) for s, n in zip(scope, names, strict=True)], "__nl_c", F.col("__nl_m.v").alias("canonical"), "n_values")
    on = functools.reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(n)) for s, n in zip(scope, names, strict=True)], key == F.col("__nl_c"))
    return formed.join(best, on).select(*scope, "__nl_h", F.sha2("canonical", 256).alias("__nl_class"), "canonical", "n_values")


def several(df: DataFrame, scope: list[str], value: str) -> DataFrame:
    """The rows of `df` whose scope holds more than one distinct value; other rows need no comparison."""
    sign = F.xxhash64(value)
    x = df.where(F.col(value).isNotNull())
    spread = x.groupBy(F.xxhash64(*scope).alias("__nl_s")).agg(F.min(sign).alias("a"), F.max(sign).alias("b")).where("a <> b").select("__nl_s")
    return x.withColumn("__nl_s", F.xxhash64(*scope)).join(small(spread), "__nl_s", "left_semi").drop("__nl_s")


class _Kinds(dict):
    """Of a character: its script if it is a letter, `odd` if it is another form of a plain character, else ''."""

    def __init__(self, odd: frozenset[str]) -> None:
        super().__init__(dict.fromkeys(odd, "odd"))

    def __missing__(self, c: str) -> str:
        self[c] = out = unicodedata.name(c, "").partition(" ")[0] if c.isalpha() else ""
        return out


def _forms():
    """Composed and decomposed form, and the number of odd characters and of letters outside the main script."""
    src, _, many = mapping()
    odd = frozenset(c for c in {*src, *many} if c != "\t" and (not c.isalpha() or unicodedata.decomposition(c)))

    @F.pandas_udf(StructType([StructField("nfc", StringType()), StructField("nfd", StringType()), StructField("odd", IntegerType())]))
    def forms(s: pd.Series) -> pd.DataFrame:
        kinds = _Kinds(odd)

        def one(v: str | None):
            if v is None:
                return None, None, None
            c = unicodedata.normalize("NFC", v)
            n: Counter = Counter()
            for x, k in Counter(c).items():
                n[kinds[x]] += k
            scripts = [k for script, k in n.items() if script not in ("", "odd")]
            return c, unicodedata.normalize("NFD", v), n["odd"] + sum(scripts) - max(scripts, default=0)

        return pd.DataFrame([one(v) for v in s], columns=["nfc", "nfd", "odd"])

    return forms


def _collation_key(c: Column) -> Column:
    """The sort key of a text under the collation as bytes, so that classes can be hashed instead of shuffled as texts."""
    jvm = SparkContext._active_spark_context._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    return Column(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.CollationKey(utils.expression(F.collate(c, "UNICODE")._jc))))


def canonicalise(df: DataFrame, value: str, scope: list[str]) -> DataFrame:
    """`df` with `value` replaced by its class's canonical member within the scope, composed; rows and nulls stay.

    The canonical member is one of the class's own texts: the one with the fewest
    odd characters and letters outside its main script. A value without
    look-alikes is its own class. Classes are counted by hashes; only texts of
    classes with several members are joined.
    """
    other = F.col(value).rlike(r"[^\x00-\x7F]")
    rest = [c for c in df.columns if c != value]
    x = df.withColumn("__nl_f", F.when(other, _forms()(F.when(other, F.col(value)))))
    x = staged(x, {"__nl_v": F.coalesce("__nl_f.nfc", value), "__nl_d": F.coalesce("__nl_f.nfd", value), "__nl_odd": F.coalesce("__nl_f.odd", F.lit(0))})
    x = staged(x.select(*[F.col(f"`{c}`") for c in rest], "__nl_v", "__nl_d", "__nl_odd"), {"__nl_k": look(F.col("__nl_d"))})
    x = stored(x.select(*[F.col(f"`{c}`") for c in rest], F.col("__nl_v"), F.sha2("__nl_v", 256).alias("__nl_h"), F.sha2(_collation_key(F.col("__nl_k")), 256).alias("__nl_c"), F.struct("__nl_odd", F.col("__nl_d") != F.col("__nl_k")).alias("__nl_rank")))
    names = [f"__nl_scope_{s}" for s in scope]
    keys = [*[F.col(s).alias(n) for s, n in zip(scope, names, strict=True)], F.col("__nl_c").alias("__nl_c2")]
    on = functools.reduce(lambda a, b: a & b, [*[F.col(s).eqNullSafe(F.col(n)) for s, n in zip(scope, names, strict=True)], F.col("__nl_c") == F.col("__nl_c2")])
    best = x.where("__nl_h is not null").groupBy(*keys).agg(F.min(F.struct("__nl_rank", "__nl_h"))["__nl_h"].alias("__nl_m"), F.min("__nl_h").alias("a"), F.max("__nl_h").alias("b"))
    best = small(best.where("a <> b").select(*names, "__nl_c2", "__nl_m"))
    texts = x.join(best, on).where("__nl_h = __nl_m").groupBy(*names, "__nl_c2").agg(F.any_value("__nl_v").alias("__nl_canonical"))
    y = x.join(best, on, "left")
    own = y.where("__nl_m is null or __nl_h = __nl_m").withColumn(value, F.col("__nl_v"))
    changed = y.where("__nl_h <> __nl_m").drop(*names, "__nl_c2", "__nl_m").join(texts, on).withColumn(value, F.col("__nl_canonical"))
    return own.select(*df.columns).union(changed.select(*df.columns))


def lookalike_pairs(df: DataFrame, scope: list[str], row: str, value: str) -> DataFrame:
    """(`row`_a, `row`_b, *scope): rows of one scope whose values look the same but are not equal, a below b.

    Pairs are formed between distinct values first, so that copies of one value
    meet only rows of its look-alikes and never each other.
    """
    x = stored(several(df.select(*scope, row, value), scope, value).withColumn("__nl_h", F.sha2(value, 256)))
    c = stored(classes(x, scope, value).where("n_values > 1").select(*scope, "__nl_h", "__nl_class"))
    left = c.select(*scope, "__nl_class", F.col("__nl_h").alias("__nl_h1"))
    right = c.select(*scope, "__nl_class", F.col("__nl_h").alias("__nl_h2"))
    pairs = left.join(right, [*scope, "__nl_class"]).where("__nl_h1 <> __nl_h2").drop("__nl_class")
    a = x.select(*scope, F.col(row).alias(f"{row}_a"), F.col("__nl_h").alias("__nl_h1"))
    b = x.select(*scope, F.col(row).alias(f"{row}_b"), F.col("__nl_h").alias("__nl_h2"))
    return a.join(pairs, [*scope, "__nl_h1"]).join(b, [*scope, "__nl_h2"]).where(F.col(f"{row}_a") < F.col(f"{row}_b")).select(f"{row}_a", f"{row}_b", *scope)


def _values(spark, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    return a.select("article_id", "row_id", F.inline(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("value")), F.struct(F.lit("body").alias("field"), F.col("body").alias("value")))))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Rows of one article whose titles or bodies look the same but differ in their characters."""
    return lookalike_pairs(_values(spark, sf_dir), ["article_id", "field"], "row_id", "value").select("row_id_a", "row_id_b", "field")


def p3_canonical(spark, sf_dir: str) -> DataFrame:
    """(row_id, field, value): every title and body in the canonical form of its look-alike class, over all articles."""
    return canonicalise(_values(spark, sf_dir), "value", ["field"]).select("row_id", "field", "value")
