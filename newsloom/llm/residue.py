"""Problem 2: template residue, filler, error pages and script notices instead of content.

Three kinds of evidence. Placeholder detectors find template syntax and stock
lines anywhere in a value. A filler vocabulary is learned from the sentences that
hold a seed word of dummy text; a run of its words marks a value. Notices are
known by no wording: the terms of the title and of the address slug are looked
up in the value, and only values that hold hardly any of them (mismatched) go
on. A sentence that mismatched values of several unrelated articles repeat, and
that makes up such values together with others of its kind (they carry little
information), is a notice; a value is a case if notices make up most of it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.common import cut, small, stored, table
from newsloom.functions.sites import host

# Template syntax and left-over variables.
PLACEHOLDERS = [
    r"\{\{[^{}\n]{1,60}\}\}",
    r"\{%[^%\n]{1,60}%\}",
    r"<%[^%\n]{0,60}%>",
    r"[$#]\{[^{}\n]{1,60}\}",
    r"\{[A-Za-z_]+(?:\.[A-Za-z_]+)*\}",
    r"\[\[[\w. ]{1,40}\]\]",
    r"%[A-Za-z]+(?:_[A-Za-z]+)*%",
    r"(?<![\w%])%[sd](?!\w)",
    r"__[A-Za-z]+(?:[_.][A-Za-z]+)*__",
    r"@@[\w.]+@@",
    r"\*\|[\w.:]+\|\*",
    r"<!--[^\n]{0,60}-->",
    r"&lt;[\w.]+&gt;",
    r"<[a-z]+[._][a-z_.]+>",
    r"\[object Object\]",
    r"\[(?i:insert|enter|add|your|placeholder)\b[^\]\n]{0,60}\]",
]
# Stock lines that stand in for text.
DUMMIES = [
    r"\bundefined,? undefined\b",
    r"\bnull,? null\b",
    r"\bNaN,? NaN\b",
    r"\bTK TK\b",
    r"(?i)\bcopy to come\b",
    r"(?i)\bplaceholder (?:headline|text|copy|image|title|paragraph)\b",
    r"(?i)\bdummy (?:paragraph|text|copy|headline)\b",
    r"(?i)\btext goes here\b",
    r"(?i)\byour (?:summary|text|headline|title|content) here\b",
    r"(?i)\breplace before going live\b",
    r"(?i)\blorem ipsum\b",
    r"(?:\b[xX]{3,}\b[ .,]*){2,}",
    r"(?i)(?:\b(?:asdf|qwer|qwerty|asdfasdf|jkl)\b[ .,]*){2,}",
]
# The classical dummy text, and the seeds that occur in no language's prose.
CLASSIC = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat".split()
SEEDS = ["lorem", "ipsum", "amet", "consectetur", "adipiscing"]

#: A value is mismatched if it holds at most this share of the terms of its title and slug.
FOREIGN = 0.2
#: Notices make up at least this share of a value that is one.
LOW_INFORMATION = 0.6
#: A repeated sentence stands in at least this share of all values, and in LEAST_ARTICLES articles.
REPEATED, LEAST_ARTICLES, LEAST_HOSTS = 3e-5, 5, 2
#: A filler word stands in at least this share of the dummy sentences, which bounds their number.
FILLER_SHARE = 1e-3

# Where a placeholder can start, and what every stock line holds; plain searches are much cheaper than the patterns.
_START = re.compile(r"[{$#@*_\[<%&]")
_WORDS = ("undefined undefined", "undefined, undefined", "null null", "null, null", "nan nan", "nan, nan", "tk tk", "xxx", "asdf", "qwer", "jkl", "placeholder", "dummy ", "goes here", "summary here", "text here", "headline here", "title here", "content here", "lorem ipsum", "copy to come", "going live")
_SYNTAX = re.compile("|".join(PLACEHOLDERS))
_STOCK = re.compile("|".join(f"(?i:{p.removeprefix('(?i)')})" if p.startswith("(?i)") else f"(?:{p})" for p in DUMMIES))
_TERM = re.compile(r"[^\W\d_]{5,}")
_BREAK = re.compile(r"[.!?…]+(?:\s+|$)|\s*[()]\s*")
_STOP = re.compile(r"[.!?…]+(?:\s+|$)")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"\b[^\W\d]*\d\w*")
#: A number, or a word and a number, set off before a sentence.
_PREFIX = re.compile(r"\W*(?:\w+\s+)?0\s*[:–—-]\s+")
_SEED = re.compile(r"\b(?:" + "|".join(SEEDS) + r")\b")
_EDGE = " \t.!?,;'\"»«"


def sentences(low: str) -> list[str]:
    """Sentences of a text in lower case, every word or number with a digit as one sign, without numbers set off before them."""
    out = []
    for line in low.split("\n"):
        for x in (_BREAK if "(" in line or ")" in line else _STOP).split(line):
            if _DIGIT.search(x):
                x = _NUMBER.sub("0", x)
                if m := _PREFIX.match(x):
                    x = x[m.end() :]
            x = x.strip(_EDGE)
            if len(x) >= 8:
                out.append(x)
    return out


def mismatched(low: str, terms: set[str]) -> bool:
    """Whether a text in lower case holds hardly any of the terms; without terms nothing speaks against it."""
    return sum(map(low.__contains__, terms)) <= FOREIGN * len(terms)


def has_placeholder(value: str, low: str) -> bool:
    """Whether a value, given also in lower case, holds template syntax or a stock line."""
    return any(_SYNTAX.match(value, m.start()) for m in _START.finditer(value)) or (any(map(low.__contains__, _WORDS)) and bool(_STOCK.search(value)))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each value that shows anything: whether it holds a placeholder, its sentences if it is mismatched, and those beside a seed of dummy text."""
    for batch in batches:
        at, marks, parts, dummies = [], [], [], []
        before, terms = None, set()
        for k, (t, value) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            low = value.lower()
            if not low.strip():
                continue
            if t != before:
                before, terms = t, set(_TERM.findall(t.lower()))
            mark = has_placeholder(value, low)
            own = sentences(low) if mismatched(low, terms) else None
            dummy = re.split(r"[.!?\n]+", low) if any(map(low.__contains__, SEEDS)) and _SEED.search(low) else None
            if mark or own or dummy:
                at.append(k)
                marks.append(mark)
                parts.append(own)
                dummies.append(dummy)
        kept = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), batch.column(4).take(kept), batch.column(5).take(kept), pa.array(marks, pa.bool_()), pa.array(parts, pa.list_(pa.string())), pa.array(dummies, pa.list_(pa.string()))], names=["row", "field", "a", "g", "mark", "parts", "dummy"])


def filler_words(sentences_: DataFrame) -> list[str]:
    """Words of dummy text, learned from the column `s`: at least 60 % of their sentences there hold a seed word.

    By `FILLER_SHARE` their number is bounded by the words of a sentence over it.
    """
    hit = F.col("s").rlike(r"\b(?:" + "|".join(SEEDS) + r")\b")
    x = sentences_.select(hit.alias("hit"), F.array_distinct(F.split("s", r"[^\p{L}]+")).alias("ws"))
    total = x.count()
    w = x.select("hit", F.explode("ws").alias("w")).where("length(w) >= 3")
    n = w.groupBy("w").agg(F.count_if("hit").alias("n"), F.count(F.lit(1)).alias("m")).where((F.col("n") >= max(5, FILLER_SHARE * total)) & (F.col("n") >= 0.6 * F.col("m")))
    return sorted({*CLASSIC, *(r["w"] for r in n.select("w").collect())})


def _filler(words: list[str]):
    """Keeps the values that hold a run of four filler words, one of them of five letters or more."""
    signs = [w for w in words if len(w) >= 5]
    signs = [w for w in signs if not any(v in w and v != w for v in signs)]
    known = frozenset(words)
    split = re.compile(r"[ ,.;\n]+")

    def runs(low: str) -> bool:
        n = 0
        for w in split.split(low):
            n = n + 1 if w in known else 0
            if n == 4:
                return True
        return False

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        search = ahocorasick.Automaton()
        for w in signs:
            search.add_word(w, w)
        search.make_automaton()
        for batch in batches:
            at = []
            for k, value in enumerate(batch.column(2).to_pylist()):
                low = value.lower()
                if next(search.iter(low), None) and runs(low):
                    at.append(k)
            kept = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["row", "field"])

    return find


def notice_sentences(scanned: DataFrame, n_values: int) -> list[str]:
    """Sentences that mismatched values of unrelated articles repeat and mostly consist of, from (row, field, a, g, parts).

    At least `LEAST_ARTICLES` articles, and `REPEATED` of all values, have the
    sentence, on `LEAST_HOSTS` hosts or five times on one. Of the values that hold
    it, `LOW_INFORMATION` consist of such sentences by `LOW_INFORMATION` of their
    length. Articles are counted by host first, so no sentence is gathered; the
    result is bounded by the sentences of a notice over `REPEATED`.
    """
    least = max(LEAST_ARTICLES, math.ceil(REPEATED * n_values))
    s = scanned.where("parts is not null").select("row", "field", "a", "g", F.explode("parts").alias("s"))
    s = s.select("*", F.xxhash64("s").alias("h"), F.length("s").alias("n"))
    hosts = s.select("h", "g", "a").distinct().groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"))
    known = hosts.groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), F.max("n").alias("top"))
    known = small(known.where((F.col("n") >= least) & ((F.col("hosts") >= LEAST_HOSTS) | (F.col("top") >= max(5, least)))).select("h"))
    each = s.join(known.select("h", F.lit(True).alias("known")), "h", "left")
    poor = each.groupBy("row", "field").agg((F.sum(F.when(F.col("known"), F.col("n"))) >= LOW_INFORMATION * F.sum("n")).alias("poor"), F.collect_set(F.when(F.col("known"), F.col("h"))).alias("hs"))
    share = poor.select("poor", F.explode("hs").alias("h")).groupBy("h").agg(F.avg(F.coalesce("poor", F.lit(False)).cast("int")).alias("share"))
    chosen = small(share.where(F.col("share") >= LOW_INFORMATION).select("h"))
    return [r["s"] for r in s.join(chosen, "h").groupBy("h").agg(F.min("s").alias("s")).select("s").collect()]


def _covered(notices: list[str]):
    """Keeps the values that notices cover by most of their length."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        search = ahocorasick.Automaton()
        for x in notices:
            search.add_word(f" {x}", len(x) + 1)
        search.make_automaton()
        for batch in batches:
            at = []
            for k, parts in enumerate(batch.column(2).to_pylist()):
                text = " " + " ".join(parts) + " "
                if notices and sum(n for end, n in search.iter_long(text) if not text[end + 1].isalpha()) >= LOW_INFORMATION * (len(text) - 1):
                    at.append(k)
            kept = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["row", "field"])

    return find


def find_residue(df: DataFrame, row: str, article: str, url: str, title: str, fields: list[str]) -> DataFrame:
    """(`row`, field): the values of `fields` that are, or hold, template residue.

    Null and blank values are none; a value of any length can be one; repeated
    rows give one. The fewer values, the fewer notices repeat and are found.
    """
    slug = F.regexp_replace(F.regexp_extract(F.col(url), r"/([^/?#]*)/?(?:[?#].*)?\s*$", 1), "[-_]+", " ")
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    terms = F.concat_ws(" ", F.col(title), slug).alias("t")
    values = df.select(F.col(row).cast("bigint").alias("row"), terms, F.xxhash64(article).alias("a"), F.xxhash64(host(F.col(url))).alias("g"), each).where("value is not null")
    scanned = stored(values.select("row", "field", "t", "value", "a", "g").mapInArrow(_scan, "row long, field string, a long, g long, mark boolean, parts array<string>, dummy array<string>"))
    filler = filler_words(scanned.where("dummy is not null").select(F.explode("dummy").alias("s")))
    notices = notice_sentences(scanned, df.count() * len(fields))
    out = scanned.where("mark").select("row", "field")
    out = out.union(values.select("row", "field", "value").mapInArrow(_filler(filler), "row long, field string"))
    out = out.union(scanned.where("parts is not null").select("row", "field", "parts").mapInArrow(_covered(notices), "row long, field string"))
    return out.distinct().withColumnRenamed("row", row)


def p2_found(spark, sf_dir: str) -> DataFrame:
    """(row_id, field) of bodies and snippets with residue instead of, or in, their content."""
    a = table(spark, sf_dir, "articles").select("row_id", "article_id", "url", "title", "body", "snippet")
    return find_residue(a, "row_id", "article_id", "url", "title", ["body", "snippet"])


def residue_bodies(spark, sf_dir: str) -> DataFrame:
    """(row_id): rows whose body is a case of `p2_found`, materialised."""
    a = table(spark, sf_dir, "articles").select("row_id", "article_id", "url", "title", "body")
    return cut(find_residue(a, "row_id", "article_id", "url", "title", ["body"]).select("row_id"))
