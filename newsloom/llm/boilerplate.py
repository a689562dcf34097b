"""Problem 5: page elements mixed with an article's own text.

Template deduction by equivalence classes, per host. The constant words of a line
in their role (the line they stand in; digits and capitalised words are slots)
occur together on every page, so a line stands for all of them. Lines, items of
separated lists and sentences are grouped by their occurrence vectors across the
pages (articles) of one host, kept as a number of pages and an order-free
signature of pages and counts. A class is large and frequent by its lines and its
share of pages, and valid if its lines keep one order on all pages and if it
nests outside the text, that is, hardly ever stands between two paragraphs. Valid
classes are the template; list blocks below a template heading are slots that
nest in it. The same deduction over all hosts finds elements that are rare on
each. The lines that remain in the outer slot are the article's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.common import cut, small, stored, table
from newsloom.functions.sites import with_site
from newsloom.llm.lookalike import mapping
from newsloom.llm.residue import residue_bodies

_DIGITS = re.compile(r"[0-9]+")
_ZEROS = bytes(0x30 if 0x30 <= i < 0x3A else i for i in range(256))
_MARKER = re.compile(r"([0-9]+[.)]|[›•*\-–·»>])\s+")
_MARKS = frozenset("0123456789›•*-–·»>")
_ITEMS = re.compile(r"\s+[|/›>·•]\s+|\s{2,}")
_SEPARATORS = "|/›>·•\t"
_SENTENCES = re.compile(r"(?<=[.!?])\s+")
_SOME_WORDS = re.compile(r"(?:[a-zß-ÿа-яё][^a-zß-ÿа-яё]*){4}")
#: Anything but the characters of Latin text as usually written.
_ODD = re.compile("[^\\x09-\\x7e\\xa1-\\xac\\xae-\\u017f\\u2013-\\u201e\\u2022\\u2026\\u203a]")
_ENDS = tuple('.!?"”»…')
_STOPS = tuple('.!?"”»')


def _table() -> dict[int, str | None]:
    src, dst, many = mapping()
    return {ord(c): (dst[i] if i < len(dst) else None) for i, c in enumerate(src)} | {ord(k): v for k, v in many.items()}


class Plain:
    """`text.translate(table_)` by one look-up in an array; only texts with a letter that becomes several go the slow way."""

    _GONE, _MANY = 0x110000, 0x110001

    def __init__(self, table_: dict[int, str | None]) -> None:
        self.table = table_
        self.codes = np.arange(0x110000, dtype="<u4")
        for k, v in table_.items():
            self.codes[k] = self._GONE if not v else ord(v) if len(v) == 1 else self._MANY

    def __call__(self, text: str) -> str:
        codes = self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        top = codes.max(initial=0)
        if top == self._MANY:
            return text.translate(self.table)
        if top == self._GONE:
            codes = codes[codes != self._GONE]
        return codes.tobytes().decode("utf-32-le", "surrogatepass")


def _capitals() -> str:
    """The upper-case letters as ranges of a character class."""
    out, start = [], None
    for c in range(0x41, 0x590):
        if chr(c).isupper():
            start = c if start is None else start
        elif start is not None:
            out.append(f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(out)


_TAIL = ",.;:!?)\"'»”"
_NAME = rf"[\"'(«“„\[]*[{_capitals()}](?:[^ ]*[^ {_TAIL}])?"
#: A run of capitalised words, up to the punctuation after the last one.
_NAMES = re.compile(rf"(?<![^ ]){_NAME}(?: {_NAME})*(?=[{_TAIL}]*(?: |$))")


def _masked(text: str) -> str:
    """A text with runs of capitalised words as slots, its first word kept."""
    first, _, rest = text.partition(" ")
    return f"{first} {_NAMES.sub('\1', rest)}".lower()


def _bare(text: str) -> str:
    """A text with runs of capitalised words as slots, '' if its first word is none."""
    return _NAMES.sub("\1", text).lower() if _NAMES.match(text) else ""


def _hash(kind: str, text: str) -> int:
    return xxhash.xxh64_intdigest(kind + text) - (1 << 63)


def separated(line: str) -> bool:
    return "  " in line or any(map(line.__contains__, _SEPARATORS))


def _plain(line: str) -> int:
    return _hash("c", _DIGITS.sub("0", line.lower()))


def _caseless(body: str) -> list[bytes]:
    """The lines of a body in lower case, every run of digits as one zero, in the bytes that `_hash` sees."""
    low = body.lower().encode().translate(_ZEROS)
    while b"00" in low:
        low = low.replace(b"00", b"0")
    return low.split(b"\n")


def tokens(line: str) -> tuple[int, int, list[int], list[int], int]:
    """Of one line: its masked token (0 if nothing is masked), its fully masked token (0 if too bare), those of its items and of its sentences, and its caseless token.

    A paragraph has the caseless token and those of its items only.
    """
    s = " ".join(line.split())
    if is_paragraph(s):
        items = [x for x in _ITEMS.split(line) if x.strip()] if separated(line) else []
        return 0, 0, [_hash("i", _DIGITS.sub("0", " ".join(x.split()).lower())) for x in items] if len(items) > 2 else [], [], _plain(s)
    raw = line
    if raw.isupper() and len(raw) > 3:
        raw, s = raw.lower(), s.lower()
    s = _DIGITS.sub("0", s)  # no pattern below tells digits from others of their kind
    low = s.lower()
    whole = _masked(s)
    # a stop is never part of a name, so a masked line that ends with one still does
    bare = "" if s.endswith(_STOPS) else _bare(s)
    items = [x for x in _ITEMS.split(raw) if x.strip()] if separated(raw) else []
    parts = _SENTENCES.split(s)
    return (
        _hash("l", whole) if whole != low else 0,
        _hash("m", bare) if bare and _SOME_WORDS.search(bare) and not bare.endswith(_ENDS) else 0,
        [_hash("i", _DIGITS.sub("0", " ".join(x.split()).lower())) for x in items] if len(items) > 1 else [],
        [_hash("s", _masked(x)) for x in parts] if len(parts) > 1 else [],
        _hash("c", low),
    )


def is_paragraph(line: str) -> bool:
    return len(line) >= 110 and line.endswith(_ENDS)


def title_like(line: str) -> bool:
    """A line that could be the heading of another article: no full stop, no mark of a list."""
    return len(line) >= 25 and not line.endswith(_ENDS)


class Tokens(dict):
    """Tokens of the lines met so far; the elements of pages recur all the time."""

    def __missing__(self, line: str) -> tuple:
        if len(self) > 100_000:
            self.clear()
        out = tokens(line)
        if len(line) < 110:
            self[line] = out
        return out


class Page:
    """The non-blank lines of a body with their numbers, and what the deduction needs of each."""

    def __init__(self, body: str, plain: Plain, known: Tokens) -> None:
        if _ODD.search(body):
            body = plain(body)
        self.at, self.lines, self.raw, self.marks, self.paragraph, self.tokens = [], [], [], [], [], []
        low = _caseless(body)
        for n, line in enumerate(body.split("\n")):
            s = line.strip()
            if not s:
                continue
            x = " ".join(s.split()) if "  " in s or "\t" in s else s
            mark = ""
            if s[0] in _MARKS and (m := _MARKER.match(x)):
                mark = m.group(1)
                mark = "0" + mark[-1] if mark[0].isdigit() else mark
            paragraph = is_paragraph(x)
            self.at.append(n)
            self.raw.append(s)
            self.lines.append(x)
            self.marks.append(mark)
            self.paragraph.append(paragraph)
            if mark:
                self.tokens.append(None)
            elif not paragraph or separated(s):
                self.tokens.append(known[s])
            elif len(x) == len(line):  # neither blanks at the edges nor joined ones
                self.tokens.append((0, 0, (), (), xxhash.xxh64_intdigest(b"c" + low[n]) - (1 << 63)))
            else:
                self.tokens.append((0, 0, (), (), _plain(x)))


def _scanner(t: dict):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(g, a, key, kind, occ, inner, heads, form, at): once for each token of a page, `at` is its first line."""
        lines, plain = Tokens(), Plain(t)
        for batch in batches:
            groups, articles, sizes, keys, stats = [], [], [], [], []
            for g, a, body in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                p = Page(body, plain, lines)
                n = len(p.lines)
                seen: dict[int, list] = {}

                def count(key, kind, form, seen=seen) -> None:
                    e = seen.get(key)
                    if e is None:
                        seen[key] = [kind, 1, inner, heads, form, i]
                    else:
                        e[1] += 1
                        e[2] += inner
                        e[3] += heads

                for i, tok in enumerate(p.tokens):
                    if tok is None:
                        continue
                    whole, bare, items, parts, key = tok
                    inner = 0 < i < n - 1 and p.paragraph[i - 1] and p.paragraph[i + 1]
                    stop = p.lines[i].endswith(_ENDS)
                    heads = not stop and i < n - 1 and (p.marks[i + 1] in ("›", "0.", "»", ">") or (not p.marks[i + 1] and title_like(p.lines[i + 1])))
                    count(key, int(stop), 0)
                    if whole:
                        count(whole, int(stop), 1)
                    if bare:
                        count(bare, int(stop), 2)
                    for k in items:
                        count(k, 2, 3)
                    for k in parts:
                        count(k, 3, 4)
                groups.append(g)
                articles.append(a)
                sizes.append(len(seen))
                keys.extend(seen)
                stats.extend(seen.values())
            each = np.array(stats, np.int32).reshape(-1, 6)
            repeat = lambda x: pa.array(np.repeat(np.array(x, np.int64), sizes))
            yield pa.RecordBatch.from_arrays([repeat(groups), repeat(articles), pa.array(keys, pa.int64()), *[pa.array(each[:, i]) for i in range(6)]], names=["g", "a", "key", "kind", "occ", "inner", "heads", "form", "at"])

    return scan


def template(df: DataFrame, group: str, page: str, body: str, least_pages: int = 5, share: float = 0.02, low: float = 0.0005) -> tuple[DataFrame, list[int]]:
    """The template tokens of each group as (hash g, key, heading), and those that hold for all groups.

    `least_pages` and `share` say on how many pages of a group a class stands to
    be frequent; one of several lines in a fixed order may be rarer. Over all
    groups a class of open-ended lines on at least `low` of all pages is
    frequent; by that share their number is bounded by the lines of a page over
    `low`.
    """
    x = df.where(F.col(body).isNotNull() & F.col(group).isNotNull()).select(F.xxhash64(group).alias("g"), F.xxhash64(page).alias("a"), F.col(body).alias("b"))
    seen = x.mapInArrow(_scanner(_table()), "g long, a long, key long, kind int, occ int, inner int, heads int, form int, at int")
    one = stored(seen.groupBy("g", "key", "a").agg(F.min("kind").alias("kind"), *[F.sum(c).alias(c) for c in ("occ", "inner", "heads")], F.min("form").alias("form"), F.min("at").alias("at")))
    per = cut(one.groupBy("g", "key").agg(F.min("kind").alias("kind"), F.min("form").alias("form"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "occ")).alias("vector"), *[F.sum(c).alias(c) for c in ("occ", "inner", "heads")]).where("n >= 2"))
    pages = cut(x.groupBy("g").agg(F.count_distinct("a").alias("pages")))
    total = pages.agg(F.sum("pages")).first()[0] or 0
    often = per.where(F.col("n") >= least_pages)
    classes = equivalence_classes(often, one)
    part, inner = F.col("n") / F.col("pages"), F.col("inner") / F.col("occ")
    # a line that ends like a sentence may be a remark of the text, so its class must be far more frequent
    open_end = (F.col("kind") == 0) & (((part >= share) & (inner < 0.45)) | ((part >= share / 2) & (inner < 0.2) & (F.col("n") >= 2 * least_pages)) | ((F.col("lines") > 1) & (part >= share / 4) & (inner < 0.25)))
    line = open_end | (F.col("kind").isin(0, 1) & (((part >= 3 * share) & (inner < 0.5)) | (part >= 0.12)))
    segment = F.col("kind").isin(2, 3) & (part >= share / 2)
    valid = classes.join(small(pages), "g").where(line | segment).select("g", "n", "vector", "kind")
    chosen = often.join(valid, ["g", "n", "vector", "kind"]).select("g", "key", (F.col("kind").isin(0, 1) & (F.col("heads") >= 0.6 * F.col("occ"))).alias("heading"))
    # the hosts' pages are disjoint, so sums and combined signatures give the classes over all of them
    whole = per.groupBy("key").agg(F.lit(0).cast("long").alias("g"), F.min("kind").alias("kind"), F.min("form").alias("form"), F.bit_xor("vector").alias("vector"), *[F.sum(c).alias(c) for c in ("n", "occ", "inner")]).where((F.col("n") >= max(8.0, low * total)) & (F.col("kind") == 0))
    nested = whole.groupBy("n", "vector").agg(F.sum("inner").alias("inner"), F.sum("occ").alias("occ")).where("inner < 0.2 * occ").select("n", "vector")
    return cut(chosen), [r[0] for r in whole.join(nested, ["n", "vector"]).select("key").collect()]


def equivalence_classes(tokens_: DataFrame, one: DataFrame) -> DataFrame:
    """(g, n, vector, kind, lines, occ, inner) of the classes of tokens with one occurrence vector.

    `lines` is the number of lines of a class that keep their order on each of
    its pages, 1 if they do not: such lines share their pages by chance and form
    no class together. The other tokens of a line (its masked forms) are no
    further lines.
    """
    n = lambda f: F.count_if(F.col("form") == f)
    c = cut(tokens_.groupBy("g", "n", "vector", "kind").agg(F.greatest(n(0), n(1), n(2), n(3), n(4)).alias("lines"), F.sum("occ").alias("occ"), F.sum("inner").alias("inner")))
    many = small(tokens_.join(c.where("lines > 1").select("g", "n", "vector", "kind"), ["g", "n", "vector", "kind"]).select("g", "key", "n", "vector", "kind"))
    # the order of the lines of a class on each page, as a hash
    order = one.select("g", "key", "a", "at").join(many, ["g", "key"]).groupBy("g", "n", "vector", "kind", "a").agg(F.hash(F.array_sort(F.collect_list(F.struct("at", "key")))["key"]).alias("o"))
    kept = order.groupBy("g", "n", "vector", "kind").agg((F.min("o") == F.max("o")).alias("ordered"))
    return c.join(kept, ["g", "n", "vector", "kind"], "left").withColumn("lines", F.when(F.col("ordered"), F.col("lines")).otherwise(F.lit(1))).drop("ordered")


def _marker(everywhere: list[int], t: dict):
    rare = frozenset(everywhere)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, tuple[frozenset, frozenset]] = {}
        lines, plain = Tokens(), Plain(t)
        for batch in batches:
            rows, numbers = [], []
            keys, heads = batch.column(3), batch.column(4)
            for k, (row, g, body) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                if g not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[g] = (frozenset(keys[k].as_py() or ()), frozenset(heads[k].as_py() or ()))
                for n in page_elements(Page(body, plain, lines), *known[g], rare):
                    rows.append(row)
                    numbers.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(numbers, pa.int64())], names=["row", "line_no"])

    return mark


def page_elements(p: Page, keys: frozenset, headings: frozenset, rare: frozenset) -> list[int]:
    """Numbers of the lines of a page that belong to the template of its host."""
    n = len(p.lines)
    hit = [False] * n
    head = [False] * n
    for i, tok in enumerate(p.tokens):
        if tok is None:
            continue
        whole, bare, items, parts, plain = tok
        hit[i] = whole in keys or bare in keys or plain in keys or whole in rare or bare in rare or plain in rare
        if not hit[i] and items:
            hit[i] = sum(x in keys for x in items) >= max(2, 0.6 * len(items)) if len(items) > 2 else all(x in keys for x in items)
        if not hit[i] and parts:
            known = sum(x in keys for x in parts)
            hit[i] = known == len(parts) or (known >= 1 and not p.lines[i].endswith(_ENDS))
        head[i] = whole in headings or bare in headings or plain in headings
    for i in range(n):
        if head[i] and hit[i]:
            j = i + 1
            if j < n and p.marks[j] in ("›", "0.", "»", ">"):
                while j < n and p.marks[j] == p.marks[i + 1]:
                    hit[j] = True
                    j += 1
            else:
                while j < n and not p.marks[j] and not hit[j] and title_like(p.lines[j]):
                    hit[j] = True
                    j += 1
    # list blocks of the marks that only template uses, also where another element parts them from their heading
    for i in range(n):
        if p.marks[i] in ("›", "»", "0.") and not hit[i]:
            j = i - 1
            while j >= 0 and (p.marks[j] == p.marks[i] or hit[j]) and not head[j]:
                j -= 1
            hit[i] = j >= 0 and head[j]
    return [p.at[i] for i in range(n) if hit[i]]


def element_lines(df: DataFrame, row: str, group: str, page: str, body: str, learn: DataFrame | None = None) -> DataFrame:
    """(`row`, line_no): the lines of each body that are page elements.

    `learn` holds the pages to deduce the templates from (default: `df`). Null
    and blank bodies give nothing; rows without a group meet only the tokens that
    are template everywhere; repeated rows each give theirs.
    """
    x, everywhere = with_templates(df, row, group, page, body, learn)
    return x.mapInArrow(_marker(everywhere, _table()), "row long, line_no long").withColumnRenamed("row", row)


def with_templates(df: DataFrame, row: str, group: str, page: str, body: str, learn: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
    """(row, g, b, keys, headings) of the non-null bodies, with the template tokens of their group; and those of all groups."""
    chosen, everywhere = template(learn if learn is not None else df, group, page, body)
    sets = small(chosen.groupBy(F.col("g").alias("__nl_g")).agg(F.collect_list("key").alias("__nl_keys"), F.collect_list(F.when(F.col("heading"), F.col("key"))).alias("__nl_heads")), 20_000)  # rows of some hundred keys each
    x = df.where(F.col(body).isNotNull()).select(F.col(row).cast("bigint").alias("row"), F.col(group).alias("g"), F.col(body).alias("b"))
    return x.join(sets, F.xxhash64("g") == F.col("__nl_g"), "left").select("row", "g", "b", "__nl_keys", "__nl_heads"), everywhere


def pages(spark, sf_dir: str, *more) -> DataFrame:
    """(row_id, article_id, body, more columns, domain) of the articles with a body."""
    a = table(spark, sf_dir, "articles").select("row_id", "article_id", "url", "body", *more).where("body is not null")
    return with_site(a, table(spark, sf_dir, "sites"), "url", ["domain"]).drop("url")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """(row_id, line_no) of every line that is a page element, not the article's own text, in bodies that are no residue."""
    found = element_lines(pages(spark, sf_dir), "row_id", "domain", "article_id", "body")
    return found.join(small(residue_bodies(spark, sf_dir)), "row_id", "left_anti")
