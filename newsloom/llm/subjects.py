"""Problem 10: subject areas of documents.

Words are averages of a word and its subword embeddings, a sentence is the
average of its words, and each subject has a logistic output of its own. The
labels of a document are weak labels of its sentences. Partitions of the
labelled sample compute gradients side by side; they are summed after each step
and the same parameters go back to all. Every document is scored, and its
subjects are those that at least a quarter of its subject-bearing sentences
bear on.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.common import small, stored, table
from newsloom.llm.wordmodel import Adam, Corpus, TokenTable, averages, normal, sigmoid

#: The classifier is fitted on at most this many labelled documents, chosen by hash.
MAX_LABELLED = 4000
#: Labelled documents of one block, the unit of gradient computation.
BLOCK = 500
#: Gradients are computed in so many tasks, each of which answers a step with one row; MAX_LABELLED bounds the work of each.
TASKS = 4
BUCKETS, LO, HI, DIM = 1 << 15, 3, 5, 16
STEPS, RATE, DECAY = 40, 0.2, 2e-5
SHARE = 0.25
#: Log-odds down to which the clearest sentence of an otherwise unclear text decides.
FAINT = -1.5


def sentences(text: str) -> list[str]:
    """Sentences of a text: pieces of its lines up to a full stop, exclamation or question mark."""
    return text.replace('." ', '."\n').replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")


def _blocks(subjects: list[str]):
    """Sentences of labelled documents, taken apart once, with their weak labels: one packed row for each block of documents."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), BLOCK):
                lines, y = [], []
                for text, named in zip(texts[at : at + BLOCK], labels[at : at + BLOCK], strict=True):
                    row = [float(s in named) for s in subjects]
                    for sentence in sentences(text):
                        if words := [w for t in sentence.split() if (w := normal(t))]:
                            lines.append(words)
                            y.append(row)
                if lines:
                    out = io.BytesIO()
                    np.savez(out, y=np.array(y, np.float32), **Corpus(lines, LO, HI, BUCKETS, True).arrays())
                    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["block"])

    return pack


def _gradients(shared):
    """Sums of the gradients over the blocks of a partition, and the loss."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = shared.value
        sums = {k: np.zeros_like(v) for k, v in params.items()}
        loss, n = 0.0, 0
        for batch in batches:
            for block in batch.column(0).to_pylist():
                z = np.load(io.BytesIO(block))
                corpus, y = Corpus.of(z), z["y"]
                h = corpus.forward(params["e"])
                p = sigmoid(h @ params["v"] + params["b"])
                g = (p - y).astype(np.float32)
                sums["v"] += h.T @ g
                sums["b"] += g.sum(0)
                sums["e"] += corpus.backward(g @ params["v"].T, params["e"].shape)
                loss += float(-(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)).sum())
                n += len(y)
        packed = b"".join(sums[k].astype(np.float32).tobytes() for k in ("e", "v", "b"))
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([loss]), pa.array([n], pa.int64())], names=["g", "loss", "n"])

    return work


def train(labelled: DataFrame, subjects: list[str]) -> dict[str, np.ndarray]:
    """Parameters fitted on `labelled` (text, named), with gradients synchronised after each step."""
    rng = np.random.default_rng(7)
    params = {"e": rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), "v": rng.normal(0, 0.3, (DIM, len(subjects))).astype(np.float32), "b": np.full(len(subjects), -2, np.float32)}
    blocks = stored(labelled.repartition(TASKS).mapInArrow(_blocks(subjects), "block binary"))
    adam = Adam(RATE)
    for _ in range(STEPS):
        # each partition answers with one row of fixed size
        shared = blocks.sparkSession.sparkContext.broadcast(params)
        rows = blocks.mapInArrow(_gradients(shared), "g binary, loss double, n long").collect()
        shared.destroy()  # its files would add up over the steps
        n = sum(r["n"] for r in rows)
        if not n:
            break
        flat = sum(np.frombuffer(bytes(r["g"]), np.float32) for r in rows) / n
        grads, at = {}, 0
        for k in ("e", "v", "b"):
            grads[k] = flat[at : at + params[k].size].reshape(params[k].shape) + (DECAY * params[k] if k != "b" else 0)
            at += params[k].size
        adam.step(params, grads)
    return params


def _score(params: dict[str, np.ndarray], subjects: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = TokenTable((params["e"] @ params["v"]).astype(np.float32), LO, HI, True)
        stop: dict[str, bool] = {}
        bias, least = params["b"], params["t"]
        for batch in batches:
            if len(words) > 2_000_000:
                words.clear_all()
                stop.clear()
            ids, ends, owner = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                at = len(ids)
                for sentence in sentences(text):
                    ids += [words[t] for t in sentence.split()]
                    if len(ids) > at:
                        ends.append(len(ids))
                        owner.append(k)
                        at = len(ids)
            mean, n = averages(words.rows, np.array(ids, np.int64), np.array(ends, np.int64))
            bears = (mean + bias > least) & (n > 0)[:, None]
            owner_ = np.array(owner, np.int64)
            # a text none of whose sentences bears clearly on a subject is judged by its clearest sentence
            best = np.full((batch.num_rows, len(subjects)), -np.inf)
            np.maximum.at(best, owner_, mean + bias)
            clear = np.zeros(batch.num_rows, bool)
            clear[owner_[bears.any(1)]] = True
            bears |= (~clear[owner_])[:, None] & (mean + bias >= best.max(1)[owner_][:, None]) & (mean + bias > FAINT) & (n > 0)[:, None]
            per = np.zeros((batch.num_rows, len(subjects)))
            some = np.zeros(batch.num_rows)
            np.add.at(per, owner_, bears)
            np.add.at(some, owner_, bears.any(1))
            share = per / np.maximum(some, 1)[:, None]
            d, j = np.nonzero((per > 0) & (share >= SHARE))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array([subjects[x] for x in j], pa.string()), pa.array(share[d, j]), pa.array(some[d].astype(np.int32))], names=["doc_id", "subject", "share", "sentences"])

    return score


def classify(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, subject, share, sentences) of the documents (doc_id, text) that bear on any subject.

    `labels` (doc_id, subject) may hold repeated, contradictory or foreign rows.
    Null and blank texts give nothing; repeated documents each give theirs.
    """
    named = labels.where(F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.collect_set("subject").alias("named"))
    named = small(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))
    x = docs.where(F.col("text").rlike(r"\S")).select("doc_id", "text")
    params = train(x.join(named, "doc_id").select("text", "named"), subjects)
    # sentences that bear on nothing get the share of their subject's documents, the others nearly 1: the middle parts them
    n = max(1, named.count())
    found = {r["s"]: r["n"] / n for r in named.select(F.explode("named").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = np.array([min(0.98, found.get(s, 0.0)) for s in subjects], np.float32)
    params["t"] = np.log((1 + base) / (1 - base))
    return x.mapInArrow(_score(params, subjects), "doc_id long, subject string, share double, sentences int")


def _classified(spark, sf_dir: str) -> DataFrame:
    subjects = [r[0] for r in table(spark, sf_dir, "subject_areas").select("subject").orderBy("subject").collect()]  # fixed, 8 rows
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), subjects)


def p10_found(spark, sf_dir: str) -> DataFrame:
    """(doc_id, subject) of every document's subject areas."""
    return _classified(spark, sf_dir).select("doc_id", "subject")


def p10_composition(spark, sf_dir: str) -> DataFrame:
    """(subject, n_docs, weight): how many documents bear on each subject, whole and in equal parts."""
    x = _classified(spark, sf_dir)
    per = x.groupBy("doc_id").agg(F.collect_list("subject").alias("s"))
    return per.select(F.explode("s").alias("subject"), (1 / F.size("s")).alias("w")).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("w").alias("weight"))
