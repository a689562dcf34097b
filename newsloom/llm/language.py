"""Problem 7: languages of documents and of the paragraphs of mixed ones.

Error-correcting output codes: each language has a codeword of 15 bits (rows of
a Hadamard matrix, any two differ in 8 bits), a binary classifier over hashed
character n-grams predicts each bit, and loss-weighted decoding takes the
language whose codeword fits the margins best. More wrong bits than the code can
correct, or a low confidence, make the outcome ambiguous; both together leave the
language undetermined. Page elements are left out by the templates of the page's
host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.common import small, strip
from newsloom.llm.boilerplate import _ENDS, _ODD, Page, Plain, Tokens, _table, page_elements, pages, with_templates
from newsloom.llm.residue import residue_bodies
from newsloom.llm.wordmodel import Adam, Corpus, TokenTable, averages, normal, sigmoid

LANGS = ["en", "fr", "de", "es", "it", "pt", "ru"]
#: The code of texts in none of the languages.
OTHER = "und"
# Three-letter codes and English names of the languages.
NAMES = {"en": "eng english", "fr": "fra fre french", "de": "deu ger german", "es": "spa spanish", "it": "ita italian", "pt": "por portuguese", "ru": "rus russian"}
#: The classifier is fitted on at most this many labelled documents of each language.
SAMPLE_PER_LANGUAGE = 200
BUCKETS, LO, HI = 1 << 15, 1, 4
#: A whole paragraph has at least this many words.
LEAST_WORDS = 7
#: Below this confidence a paragraph is ambiguous and proves no second language.
SURE = 0.9
#: Codewords differ in 8 of 15 bits, so 3 wrong ones can be put right.
CORRECTABLE = 3


def label(c: Column) -> Column:
    """The two-letter code that a label names, null if it names none."""
    key = F.regexp_extract(F.lower(strip(c)), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    names = {n: k for k, ns in NAMES.items() for n in [k, *ns.split()]}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: rows of the Hadamard matrix of 16 (or more) without its constant column."""
    h = np.ones((1, 1))
    while len(h) < max(16, n + 1):
        h = np.block([[h, h], [h, -h]])
    return h[1 : n + 1, 1:].astype(np.float32)


def fit(rows: list[tuple[str, str]], rounds: int = 60) -> np.ndarray:
    """Weights (bucket x bit) of the binary classifiers from (language, text) rows, some of them mislabelled."""
    code = codewords(len(LANGS))
    segments, y, doc = [], [], []
    odd = _table()
    for k, (lang, text) in enumerate(rows):
        text = text.translate(odd) if _ODD.search(text) else text  # as pages are read when judged
        for line in re.split(r"\n|(?<=[.!?])\s+", text):
            words = [w for t in line.split() if (w := normal(t))]
            if len(words) >= 6:
                segments.append(words)
                y.append(LANGS.index(lang))
                doc.append(k)
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    if not segments:
        return weights
    corpus, y, doc = Corpus(segments, LO, HI, BUCKETS, False), np.array(y), np.array(doc)
    weight = 1 / np.sqrt(np.bincount(y, minlength=len(LANGS))[y]).astype(np.float32)
    # a short first fit, before wrong labels are learned by heart, then the rest without them
    for phase, steps in enumerate((rounds // 4, rounds - rounds // 4)):
        adam, params = Adam(0.5), {"w": np.zeros_like(weights)}
        for _ in range(steps):
            margins = corpus.forward(params["w"])
            t = code[y]
            grad = -t * sigmoid(-t * margins) * (weight / weight.sum())[:, None]
            adam.step(params, {"w": corpus.backward(grad.astype(np.float32), weights.shape)})
        weights = params["w"]
        if not phase:  # a document whose sentences contradict its label has a wrong one
            sums = np.zeros((len(rows), code.shape[1]))
            np.add.at(sums, doc, corpus.forward(weights))
            found = decode(sums / np.maximum(np.bincount(doc, minlength=len(rows)), 1)[:, None] * 4, code)[0]
            weight = np.where(found[doc] == y, weight, 0).astype(np.float32)
    return weights


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword by weighted loss of each row of margins, and the confidence in it."""
    # log(1 + exp(-m)) and log(1 + exp(m)) differ by m, so losses differ by half of what the products do
    loss = np.einsum("ij,kj->ik", margins, code) / -2
    loss -= loss.min(1, keepdims=True)
    p = np.exp(-loss)
    return loss.argmin(1), 1 / p.sum(1)


def wrong_bits(margins: np.ndarray, code: np.ndarray, best: np.ndarray) -> np.ndarray:
    """In how many bits each row of margins differs from the codeword decoded for it."""
    return ((margins > 0) != (code[best] > 0)).sum(1)


def _sample(df: DataFrame, group: str, page: str) -> list[tuple[str, str]]:
    x = df.where("__nl_label is not null and body is not null").select("__nl_label", "body", F.xxhash64(page).alias("h"))
    w = Window.partitionBy("__nl_label").orderBy("h", "body")
    x = x.withColumn("n", F.row_number().over(w)).where(F.col("n") <= SAMPLE_PER_LANGUAGE)
    return [(r[0], r[1]) for r in x.select("__nl_label", "body").collect()]


def _judge(weights: np.ndarray, everywhere: list[int], t: dict):
    rare = frozenset(everywhere)
    code = codewords(len(LANGS))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, plain = TokenTable(weights, LO, HI, False), Tokens(), Plain(t)
        look_up = table.__getitem__
        known: dict[str | None, tuple[frozenset, frozenset]] = {}
        for batch in batches:
            if len(table) > 1_000_000:
                table.clear_all()
            ids, ends, owner, number, stops = [], [], [], [], []
            keys, heads = batch.column(3), batch.column(4)
            rows = batch.column(0).to_pylist()
            for k, (g, body) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if g not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[g] = (frozenset(keys[k].as_py() or ()), frozenset(heads[k].as_py() or ()))
                p = Page(body, plain, seen)
                out = set(page_elements(p, *known[g], rare))
                for n, line in zip(p.at, p.raw, strict=True):
                    if n not in out:
                        ids.extend(map(look_up, line.split()))
                        ends.append(len(ids))
                        owner.append(k)
                        number.append(n)
                        stops.append(line.endswith(_ENDS))
            ids_, ends_, owner_ = np.array(ids, np.int64), np.array(ends, np.int64), np.array(owner, np.int64)
            margins, n = averages(table.rows, ids_, ends_)
            best, sure = decode(margins, code)
            whole = np.zeros((len(rows), margins.shape[1]))
            words = np.zeros(len(rows))
            np.add.at(whole, owner_, margins * n[:, None])
            np.add.at(words, owner_, n)
            mean = whole / np.maximum(words, 1)[:, None]
            all_best, all_sure = decode(mean, code)
            all_wrong, wrong = wrong_bits(mean, code, all_best), wrong_bits(margins, code, best)
            firm = (n >= LEAST_WORDS) & (sure >= SURE) & np.array(stops, bool)
            top = np.zeros((len(rows), len(LANGS)))  # the highest confidence of a firm paragraph
            np.maximum.at(top, (owner_[firm], best[firm]), sure[firm])
            has = top > 0
            mixed = has.sum(1) > 1
            one = has.sum(1) == 1
            all_best = np.where(one, has.argmax(1), all_best)
            out = [[], [], [], [], [], []]

            def add(*v, out=out) -> None:
                for c, x in zip(out, v, strict=True):
                    c.append(x)

            for k, row in enumerate(rows):
                if words[k]:
                    unclear = all_wrong[k] > CORRECTABLE and not one[k]
                    add(row, "body", None, OTHER if unclear and all_sure[k] < 0.5 else LANGS[all_best[k]], float(all_sure[k]), bool(unclear or all_sure[k] < SURE))
                    if mixed[k]:
                        for j in np.flatnonzero(has[k]):
                            add(row, "part", None, LANGS[j], float(top[k, j]), False)
            for j in np.flatnonzero(mixed[owner_]) if len(owner_) else ():
                if n[j]:
                    unclear = wrong[j] > CORRECTABLE
                    add(rows[owner_[j]], "paragraph", int(number[j]), OTHER if unclear and sure[j] < 0.5 else LANGS[best[j]], float(sure[j]), bool(unclear or sure[j] < SURE))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.bool_()), strict=True)], names=["row", "kind", "line_no", "lang", "confidence", "ambiguous"])

    return judge


def detect(df: DataFrame, row: str, group: str, page: str, labels: str) -> DataFrame:
    """(row, kind, line_no, lang, confidence, ambiguous) of the own text of each `body` of `df`.

    `kind` is `body` (one row for each body with words), `part` (one row for each
    language of a mixed body) or `paragraph` (each paragraph of a mixed body). The
    labels train the classifier only. Null and wordless bodies give nothing.
    """
    x = df.withColumn("__nl_label", label(F.col(labels)))
    weights = fit(_sample(x, group, page))
    paged, everywhere = with_templates(df, row, group, page, "body")
    return paged.mapInArrow(_judge(weights, everywhere, _table()), "row long, kind string, line_no long, lang string, confidence double, ambiguous boolean")


def _pages(spark, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir, F.col("metadata.language").alias("label"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    """(row_id, lang): languages of mixed bodies, and of the others where the label is missing or wrong."""
    a = _pages(spark, sf_dir)
    a = a.join(small(residue_bodies(spark, sf_dir)), "row_id", "left_anti")
    found = detect(a, "row_id", "domain", "article_id", "label").where(f"kind <> 'paragraph' and lang <> '{OTHER}'")
    labels = a.select("row_id", label(F.col("label")).alias("given"))
    # per row: its languages if mixed, else the one of the body
    per = found.groupBy("row").agg(F.collect_list(F.when(F.col("kind") == "part", F.col("lang"))).alias("parts"), F.max(F.when(F.col("kind") == "body", F.col("lang"))).alias("one"))
    j = per.join(labels, F.col("row") == F.col("row_id"))
    langs = F.when(F.size("parts") > 0, F.col("parts")).when(F.col("given").eqNullSafe(F.col("one")), F.array().cast("array<string>")).otherwise(F.array("one"))
    return j.select("row_id", F.explode(langs).alias("lang"))


def p7_languages(spark, sf_dir: str) -> DataFrame:
    """(row_id, kind, line_no, lang, confidence, ambiguous) of every body with words, residue included, and of each paragraph of the mixed ones."""
    return detect(_pages(spark, sf_dir), "row_id", "domain", "article_id", "label").withColumnRenamed("row", "row_id")
