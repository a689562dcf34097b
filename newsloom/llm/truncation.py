"""Problem 1: values cut off at a field length or in transfer.

A backward character n-gram model says how likely a text ends after its final
characters, against going on: for the final contexts of 1 to 10 characters, from
the end backwards, the ends and the continuations over all values are counted
and the orders are interpolated. Signs of a cut (an ellipsis, a count of missing
characters) are taken off before, so the context is what stood in front of them.
That a value carries such a sign, or equals a title, is evidence whose log-odds
are learned from what the model says of all values with it, and added. Values
below the threshold of their language and column, the valley between the two
groups, are cut. Values of several sentences and single ones (headlines among
them) have ends of their own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.common import cut, small, stored, table

ORDERS = (1, 2, 3, 4, 5, 6, 8, 10)
#: Contexts longer than this are kept only if several texts end with them.
LONG_ORDER = 4
#: Final contexts of one pass over the texts; each has 16 bits of the filter.
KEYS_PER_PASS = 1 << 23
#: Up to this many contexts the model is broadcast, beyond it is joined.
MODEL_KEYS = 2_000_000
#: How many observations the estimate of the shorter context is worth, and values that of all groups.
LEAN, LEAN_GROUP = 60.0, 200.0
#: Odds, before any value is seen, that one with the text of a title is whole: titles are whole texts.
KNOWN_TITLES = 200.0
#: Probability of an end after any character.
BASE = 0.002
_BIN = 4
#: Log-odds beyond these are clear, how far beyond says nothing more: an end more likely than not, and one a thousandth or less likely.
CLEAR = (-8.0, 0.0)

# Signs of a cut at the end of a value, each a piece of evidence of its own.
_ELLIPSIS = r"(?:…|\.{3,}|&hellip;|&#8230;|&#x2026;)"
_MORE = "(?:read )?more|continue reading|weiter(?:lesen)?|(?:lire la )?suite|plus|(?:leer )?más|(?:ler )?mais|(?:leggi )?altro|continua|далее"
SIGNS = [
    rf"(?:{_ELLIPSIS}|[\[(]\s*{_ELLIPSIS}\s*[\])])\W*$",
    r"\[\+?\d+ ?(?:chars?|characters|more)\]\W*$",
    rf"(?:(?<=[….\]])\s*(?i:{_MORE})|[\[(](?i:{_MORE})[\])])\W*$",
    r"&#?[A-Za-z0-9]{0,8}$",
    r"</?[A-Za-z]*[^<>]{0,40}$",
    r"�+$",
]
_SIGNS = [re.compile(x) for x in SIGNS]
#: A value that equals a title.
HEADLINE = 1 << len(SIGNS)
_LONGEST_SIGN = 80
_SEVERAL = re.compile(r"[.!?][\"”»)]*\s+\S")
_DIGITS = re.compile("[0-9]+")
_CYRILLIC = re.compile("[Ѐ-ӿ].*[Ѐ-ӿ]", re.DOTALL)
# Frequent words that tell the languages of short texts apart.
_WORDS = {
    "en": "the and of in to for with on said at was by",
    "fr": "le la les des du et une dans pour sur est à",
    "de": "der die das und den von im nach ein eine mit aus",
    "es": "el los las y con una por del para declaró su tras",
    "it": "il gli della di che ha detto con un una per dopo",
    "pt": "o os da do uma em disse com a não para após",
}


#: A byte of votes for each language of a word.
_VOTES = {w: sum(1 << 8 * i for i, ws in enumerate(_WORDS.values()) if w in ws.split()) for w in " ".join(_WORDS.values()).split()}
_NAMES = list(_WORDS)


def language(text: str) -> str:
    """A cheap guess of the language by frequent words; `ru` for Cyrillic text, `en` where nothing tells."""
    if not text.isascii() and _CYRILLIC.search(text):
        return "ru"
    n = sum(_VOTES[w] for w in set(text.lower().replace("'", " ").split()) & _VOTES.keys())
    votes = [n >> 8 * i & 255 for i in range(len(_NAMES))]
    return _NAMES[votes.index(max(votes))]


def strip_signs(value: str) -> tuple[str, int]:
    """A value without the signs of a cut at its end, and which they were, one bit each."""
    found, value = 0, value.rstrip()
    again = True
    while again and value:
        again = False
        end = value[-_LONGEST_SIGN:]
        for i, p in enumerate(_SIGNS):
            if m := p.search(end):
                value = value[: len(value) - len(end) + m.start()].rstrip()
                found |= 1 << i
                again = True
                break
    return value, found


def _prepared(fields: list[str]):
    """(row, source, field, lang, many, signs, h, empty, text) of each non-null value; titles have no field."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, sources = batch.column(0), batch.column(1)
            at, cols = [], [[] for _ in range(7)]
            for k, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)):
                for field, value in zip([None, *fields], values, strict=True):
                    if value is None or (field is None and not value.strip()):
                        continue
                    text, signs = strip_signs(value) if field else (value.strip(), 0)
                    h = xxhash.xxh64_intdigest(text) - (1 << 63)
                    at.append(k)
                    for c, v in zip(cols, (field, language(text), bool(_SEVERAL.search(text)), signs, h, not value.strip(), _DIGITS.sub("0", text)), strict=True):
                        c.append(v)
            kept = pa.array(at, pa.int64())
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([ids.take(kept), sources.take(kept), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["row", "source", "field", "lang", "many", "signs", "h", "empty", "text"])

    return prepare


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _seed(lang: str) -> int:
    return int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little") | 1


def contexts(texts: list[str], langs: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order k the hash of the k characters that end at each place of the texts laid end to end, the latest first; whether these lie in one text; and the places of the texts' ends."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(sizes)
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    h = np.repeat(np.array([_seed(x) for x in langs], np.uint64), sizes)
    for k in range(1, max(ORDERS) + 1):
        prev = np.zeros(len(codes), np.uint64)
        prev[k - 1 :] = codes[: max(0, len(codes) - k + 1)]
        h = _mix(h * np.uint64(1099511628211) + prev + np.uint64(k))
        if k in ORDERS:
            yield k, h, place >= k - 1, ends[sizes > 0] - 1


def _pieces(texts: list[str], most: int = 400_000) -> Iterator[slice]:
    """Slices of about `most` characters, so that the arrays of a slice stay small; a longer text is one of its own."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield slice(start, i + 1)
            start, n = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, many, k, n): final contexts of the texts and how often texts end with them."""
    for batch in batches:
        langs, manies, texts = (c.to_pylist() for c in batch.columns)
        keys, many, order, count = [], [], [], []
        tails = [t[-max(ORDERS) :] for t in texts]
        flags = np.array([m for m, t in zip(manies, tails, strict=True) if t], bool)
        for k, h, inside, at in contexts(tails, langs):
            good = inside[at]
            for flag in (False, True):
                found, n = np.unique(h[at[good & (flags == flag)]], return_counts=True)
                keys.append(found)
                count.append(n)
                many.append(np.full(len(found), flag))
                order.append(np.full(len(found), k, np.int32))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(many)), pa.array(np.concatenate(order)), pa.array(np.concatenate(count).astype(np.int64))], names=["key", "many", "k", "n"])


def _inside(bits: bytes):
    """Counts of continuations after the contexts that the filter lets pass."""
    shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(bits, np.uint8)
        for batch in batches:
            langs, texts = (c.to_pylist() for c in batch.columns)
            keys = []
            for part in _pieces(texts):
                for _, h, inside, at in contexts(texts[part], langs[part]):
                    inside = inside.copy()
                    inside[at] = False
                    place = (h >> shift).astype(np.int64)
                    keys.append(h[inside & ((seen[place >> 3] >> (place & 7)) & 1 == 1)])
            found, n = np.unique(np.concatenate(keys) if keys else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "m"])

    return count


def _filter(keys: DataFrame, n: int) -> bytes:
    """A bit for the leading bits of each key, 16 to 32 bits for a key."""
    size = 1 << max(17, (16 * max(n, 1)).bit_length())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size >> 3, np.uint8)
        for batch in batches:
            at = (batch.column(0).to_numpy().astype(np.uint64) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(size >> 3, np.uint8)
    for r in keys.coalesce(max(1, min(64, n // 500_000))).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(bytes(r[0]), np.uint8)
    return out.tobytes()


def train(base: DataFrame) -> DataFrame:
    """(key, many, n, m): ends and continuations of the final contexts of the distinct texts of `base` (lang, many, text).

    The texts are read once for each `KEYS_PER_PASS` contexts.
    """
    ends = cut(base.select("lang", "many", "text").mapInArrow(_ends, "key long, many boolean, k int, n long").groupBy("key", "many").agg(F.min("k").alias("k"), F.sum("n").alias("n")).where((F.col("k") <= LONG_ORDER) | (F.col("n") > 1)))
    total = ends.count()
    passes = -(-total // KEYS_PER_PASS) or 1
    inside = None
    for p in range(passes):
        keys = ends.where(F.pmod("key", F.lit(passes)) == p).select("key")
        found = base.select("lang", "text").mapInArrow(_inside(_filter(keys, -(-total // passes))), "key long, m long").where(F.pmod("key", F.lit(passes)) == p)
        inside = found if inside is None else inside.union(found)
    inside = inside.groupBy("key").agg(F.sum("m").alias("m"))
    return cut(ends.join(inside, "key", "left").select("key", "many", "n", F.coalesce("m", F.lit(0)).alias("m")))


def _step(p, n, m):
    """The estimate of a context from that of the shorter one; the value's own end does not count."""
    return (n - 1 + LEAN * p) / (n - 1 + m + LEAN)


def _scorer(model):
    """Scores by a broadcast model: (keys, n, m) of single and of several sentences."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, manies, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "many", "text"))
            tails = [t[-max(ORDERS) :] for t in texts]
            some = np.array([bool(t) for t in tails], bool)
            flags = np.array(manies, bool)[some]
            p = np.full(len(flags), BASE)
            for _, h, inside, at in contexts(tails, langs):
                for flag in (False, True):
                    keys, n, m = model.value[flag]
                    if not len(keys):
                        continue
                    own = h[at].astype(np.int64)
                    i = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    hit = (keys[i] == own) & inside[at] & (flags == flag)
                    p[hit] = _step(p[hit], n[i[hit]], m[i[hit]])
            out = np.full(len(tails), math.log(BASE / (1 - BASE)))
            out[some] = np.log(p / (1 - p))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*batch.schema.names[:-1], "score"])

    return score


def _finals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k, many, key): the final contexts of each value, for a model that is joined."""
    for batch in batches:
        ids, langs, manies, texts = (c.to_pylist() for c in batch.columns)
        tails = [t[-max(ORDERS) :] for t in texts]
        some = np.array([bool(t) for t in tails], bool)
        for k, h, inside, at in contexts(tails, langs):
            good = inside[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[some][good]), pa.array(np.full(good.sum(), k, np.int32)), pa.array(np.array(manies, bool)[some][good]), pa.array(h[at][good].astype(np.int64))], names=["id", "k", "many", "key"])


def log_odds(values: DataFrame, model: DataFrame, most: int = MODEL_KEYS) -> DataFrame:
    """`values` (row, source, field, lang, many, signs, empty and text) with `score`, the log-odds of an end, in place of `text`.

    A model of at most `most` contexts is broadcast, a larger one is joined; the scores are the same.
    """
    names = ["row", "source", "field", "lang", "many", "signs", "empty"]
    if model.count() <= most:
        rows = model.toPandas().sort_values("key")
        sides = [[x.to_numpy() for x in (r["key"], r["n"], r["m"])] for flag in (False, True) for r in [rows[rows["many"] == flag]]]
        kinds = {f.name: f.dataType.simpleString() for f in values.schema}
        schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", score double"
        return values.select(*names, "text").mapInArrow(_scorer(values.sparkSession.sparkContext.broadcast(sides)), schema)
    keyed = stored(values.withColumn("__nl_id", F.monotonically_increasing_id()))
    looked = keyed.select("__nl_id", "lang", "many", "text").mapInArrow(_finals, "id long, k int, many boolean, key long").join(model, ["key", "many"])
    per = looked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "n", "m"))).alias("o"))  # at most one row for each order
    p = F.aggregate("o", F.lit(BASE), lambda acc, o: _step(acc, o["n"], o["m"]))
    out = keyed.join(per.select(F.col("id").alias("__nl_id"), F.log(p / (1 - p)).alias("score")), "__nl_id", "left")
    return out.select(*names, F.coalesce("score", F.lit(math.log(BASE / (1 - BASE)))).alias("score"))


def valley(points: list[tuple[int, int]]) -> float:
    """The cut of a histogram (bin, count) with the least variance within its two sides, in log-odds."""
    points = sorted(points)
    total, mean = sum(n for _, n in points), sum(b * n for b, n in points)
    best, at, n0, s0 = -1.0, points[0][0] - 0.5 if points else 0.0, 0, 0
    for (b, n), (after, _) in zip(points, points[1:], strict=False):
        n0, s0 = n0 + n, s0 + b * n
        between = n0 * (total - n0) * (s0 / n0 - (mean - s0) / (total - n0)) ** 2
        if between > best:
            best, at = between, (b + after) / 2
    return (at + 0.5) / _BIN


def calibrate(hist: list[tuple[str, str, int, int, int]], rounds: int = 12) -> tuple[dict[tuple[str, str], float], list[float]]:
    """Thresholds of (language, field) and the log-odds of each piece of evidence, from (lang, field, signs, bin, count).

    The threshold of a group leans on that of all groups. The evidence of a sign
    is the log of how much more frequent it is among cut values than among whole
    ones, found by turns with which values are cut.
    """
    groups: dict[tuple[str, str], dict[int, int]] = {}
    everything: dict[int, int] = {}
    for lang, field, _, b, n in hist:
        own = groups.setdefault((lang, field), {})
        own[b] = own.get(b, 0) + n
        everything[b] = everything.get(b, 0) + n
    common = valley(list(everything.items()))
    limits = {}
    for g, bins in groups.items():
        size = sum(bins.values())
        limits[g] = (size * valley(list(bins.items())) + LEAN_GROUP * common) / (size + LEAN_GROUP)
    kinds = len(SIGNS) + 1
    prior = [0.0] * len(SIGNS) + [-math.log(KNOWN_TITLES)]
    weights = list(prior)
    for _ in range(rounds):
        with_, total = [[0.0] * kinds, [0.0] * kinds], [0.0, 0.0]
        for lang, field, signs, b, n in hist:
            whole = (b + 0.5) / _BIN - sum(w for i, w in enumerate(weights) if signs >> i & 1) >= limits[lang, field]
            total[whole] += n
            for i in range(kinds):
                with_[whole][i] += n * (signs >> i & 1)
        learned = [math.log((c + 0.5) / (total[0] + 1) * (total[1] + 1) / (w + 0.5)) if c + w else 0.0 for c, w in zip(*with_, strict=True)]
        weights = [a + b for a, b in zip(prior, learned, strict=True)]
    return limits, weights


def find_cut(df: DataFrame, row: str, source: str, fields: list[str], title: str | None = None) -> DataFrame:
    """(`row`, field, source, lang, score, cut): every non-null value of `fields` with its log-odds of an end and the verdict.

    A blank value is not cut. `title` names the column of titles, which are whole
    texts. Rows are kept one to one, repeats included; copies of a text are one
    piece of evidence. The histogram that reaches the driver has a row for each
    language, field, combination of signs and quarter of log-odds.
    """
    head = F.col(title) if title else F.lit(None).cast("string")
    kind = df.schema[row].dataType.simpleString()
    x = df.select(F.col(row).alias("row"), F.col(source).alias("source"), head.alias("head"), *[F.col(f).alias(f"v{i}") for i, f in enumerate(fields)])
    x = stored(x.mapInArrow(_prepared(fields), f"row {kind}, source string, field string, lang string, many boolean, signs int, h long, empty boolean, text string"))
    base = cut(x.where("text <> ''").groupBy("h", "lang", "many").agg(F.any_value("text").alias("text")))
    model = train(base)
    titles = small(x.where("field is null").select("h").distinct().withColumn("head", F.lit(HEADLINE)))
    values = x.where("field is not null").join(titles, "h", "left").withColumn("signs", F.col("signs").bitwiseOR(F.coalesce("head", F.lit(0))))
    scored = stored(log_odds(values, model))
    bins = F.floor(F.least(F.greatest("score", F.lit(CLEAR[0])), F.lit(CLEAR[1])) * _BIN).cast("int")
    hist = scored.where("not empty").groupBy("lang", "field", "signs", bins.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    limits, weights = calibrate([tuple(r) for r in hist])
    score = F.col("score") - sum((F.when(F.col("signs").bitwiseAND(1 << i) != 0, F.lit(w)).otherwise(0.0) for i, w in enumerate(weights)), F.lit(0.0))
    limit = F.lit(0.0)
    for (lang, field), t in limits.items():
        limit = F.when((F.col("lang") == lang) & (F.col("field") == field), F.lit(t)).otherwise(limit)
    return scored.select(F.col("row").alias(row), "field", "source", "lang", score.alias("score"), (~F.col("empty") & (score < limit)).alias("cut"))


def _api(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "newsapi_articles").select("api_row_id", "source_name", "title", "description", "content")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """(api_row_id, field) of the contents and descriptions that lack their end."""
    return find_cut(_api(spark, sf_dir), "api_row_id", "source_name", ["content", "description"], "title").where("cut").select("api_row_id", "field")


def p1_sources(spark, sf_dir: str) -> DataFrame:
    """(source_name, field, n_values, n_cut, share): how often each source's values are cut."""
    x = find_cut(_api(spark, sf_dir), "api_row_id", "source_name", ["content", "description"], "title")
    return x.groupBy(F.col("source").alias("source_name"), "field").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("cut").alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_values"))
