"""Problem 8: texts packed into containers of fixed capacity with little space left.

Only the counts of lengths matter for the packing, and there are at most as many
lengths as the capacity has tokens. Minimum bin slack: the longest remaining
length opens a bin, a subset-sum over bitsets picks the multiset of a window of
the remaining lengths that fills the rest closest to the capacity, and the
pattern is repeated for as many bins as its counts allow, so each pattern uses
up a length. Documents then take their places by their rank among those of
their length, counted by partitions.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.common import cut, small, stored, table

#: The folder of the public tokenizers' vocabularies; a parameter of `pack`.
TOKENIZERS = os.environ.get("NEWSLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct lengths that one subset-sum looks at.
WINDOW = 64

# Fixed value: the splitting pattern that belongs to the vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer(folder: str, name: str = VOCABULARY):
    """The tokenizer of a vocabulary file."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _count(folder: str, name: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(folder, name)
        known: dict[str, int] = {}
        for batch in batches:
            sizes = []
            for text in batch.column(1).to_pylist():
                # a space starts a new piece in front of a letter, so words can be counted one by one
                n = 0
                if "\n" in text or "  " in text or "\t" in text:
                    n = len(enc.encode_ordinary(text))
                else:
                    words = text.split(" ")
                    for i, w in enumerate(words):
                        key = " " + w if i else w
                        m = known.get(key)
                        if m is None:
                            if len(known) > 500_000:
                                known.clear()
                            m = known[key] = len(enc.encode_ordinary(key))
                        n += m
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "size"])

    return count


def token_counts(docs: DataFrame, doc_id: str, text: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(id, size): tokens of every non-empty text."""
    x = docs.where(F.length(text) > 0).select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("t"))
    return x.mapInArrow(_count(folder, name), "id long, size long")


def best_fill(room: int, counts: list[tuple[int, int]]) -> dict[int, int]:
    """The multiset of (length, available) whose sum is closest to `room` from below, as length -> number.

    Bit s of a stage's bitset says that the sum s can be reached; counts are
    taken apart into powers of two, and the choice is traced back.
    """
    mask = (1 << (room + 1)) - 1
    stages, reach = [], 1
    for length, have in counts:
        left = min(have, room // length)
        step = 1
        while left > 0 and not reach >> room & 1:
            k = min(step, left)
            stages.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, k, before in reversed(stages):
        if not before >> total & 1:
            total -= length * k
            out[length] = out.get(length, 0) + k
    return out


def patterns(sizes: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(bins, length -> number per bin) that place every item; each pattern uses up at least one length."""
    left = {k: n for k, n in sizes.items() if n > 0}
    out = []
    lengths = sorted(left, reverse=True)
    while lengths:
        top = lengths[0]
        room = capacity - top
        fits = [x for x in lengths if x <= room and (x != top or left[x] > 1)]
        if len(fits) > WINDOW:  # the window spans the remaining lengths, the shortest always among them
            step = (len(fits) - 1) / (WINDOW - 1)
            fits = [fits[round(i * step)] for i in range(WINDOW)]
        fill = best_fill(room, [(x, left[x] - (x == top)) for x in fits]) if fits and room > 0 else {}
        fill[top] = fill.get(top, 0) + 1
        bins = min(left[x] // n for x, n in fill.items())
        out.append((bins, fill))
        for x, n in fill.items():
            left[x] -= n * bins
        lengths = [x for x in lengths if left[x] > 0]
    return out


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole kinds of containers with their histogram of lengths: the runs of ranks (lo to hi) of a length that the bins from `first` on hold, `per` each."""
    cols: list[list] = [[] for _ in range(6)]
    for batch in batches:
        for container, cap, hist in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            used: dict[int, int] = {}
            first = 0
            for bins, fill in patterns({x["len"]: x["n"] for x in hist}, cap):
                for length, n in fill.items():
                    at = used.get(length, 0)
                    used[length] = at + n * bins
                    for c, v in zip(cols, (container, length, at, at + n * bins, n, first), strict=True):
                        c.append(v)
                first += bins
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 5), strict=True)], names=["container", "len", "lo", "hi", "per", "first"])


def pack(docs: DataFrame, doc_id: str, text: str, limits: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, container, part, bin, tokens): the container of every non-empty text, for each kind of container.

    A text that exceeds the capacity alone is cut into full parts, which fill bins
    of their own, and a rest that is packed like a text. Null and empty texts
    have no place; repeated documents have one each. The patterns of each kind
    are found in a task of its own, from one number for each length, bounded by
    the capacity; texts meet the run of their rank by blocks of ranks as wide as
    a run is on average.
    """
    kinds = [(r[0], int(r[1])) for r in limits.where("capacity_tokens > 0").select("container", "capacity_tokens").distinct().orderBy("container").collect()]
    sized = stored(token_counts(docs, doc_id, text, folder, name))
    kind_rows = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(cap).cast("long").alias("cap")) for c, cap in kinds])
    items = sized.select("id", "size", F.inline(kind_rows))
    rest = items.withColumn("len", F.when(F.col("size") % F.col("cap") == 0, F.when(F.col("size") > 0, F.col("cap")).otherwise(F.lit(0))).otherwise(F.col("size") % F.col("cap"))).where("len > 0")
    rest = rest.withColumn("full", ((F.col("size") - F.col("len")) / F.col("cap")).cast("long"))
    # ranks within a length: partitions are counted first, so that no length is gathered in one place
    blocks = max(64, sized.count() // 2_000_000)
    rest = rest.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    counts = cut(rest.groupBy("container", "cap", "len", "block").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("container", "len").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("container", "len", "block", "before")
    ranked = rest.withColumn("r", F.row_number().over(Window.partitionBy("container", "len", "block").orderBy("id", "size")) - 1).join(offsets, ["container", "len", "block"]).withColumn("r", F.col("r") + F.col("before"))
    # at most one row for each token of capacity in a kind's histogram
    hist = counts.groupBy("container", "cap", "len").agg(F.sum("n").alias("n")).groupBy("container", "cap").agg(F.collect_list(F.struct("len", "n")).alias("hist"))
    runs = cut(hist.repartition(max(1, len(kinds)), "container").mapInArrow(places, "container string, len long, lo long, hi long, per long, first long"))
    widths = small(runs.groupBy("container", "len").agg(F.ceil(F.max("hi") / F.count(F.lit(1))).alias("width")))
    span = F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width")))
    lookup = small(runs.join(widths, ["container", "len"]).select("*", F.explode(span).alias("at")).groupBy("container", "len", "at").agg(F.collect_list(F.struct("lo", "hi", "per", "first")).alias("runs")))
    run = F.filter("runs", lambda x: (F.col("r") >= x["lo"]) & (F.col("r") < x["hi"]))[0]
    placed = ranked.join(widths, ["container", "len"]).withColumn("at", F.floor(F.col("r") / F.col("width"))).join(lookup, ["container", "len", "at"]).withColumn("run", run)
    one = placed.select("id", "container", F.col("full").alias("part"), (F.col("run.first") + F.floor((F.col("r") - F.col("run.lo")) / F.col("run.per"))).cast("string").alias("bin"), F.col("len").alias("tokens"))
    # full parts fill their bins alone and need no number shared with others
    cut_ = ranked.where("full > 0").select("id", "container", "cap", "len", "r", F.posexplode(F.sequence(F.lit(1), F.col("full").cast("int"))).alias("part", "__nl_k"))
    full = cut_.select("id", "container", F.col("part").cast("long").alias("part"), F.concat_ws("-", F.lit("full"), "len", "r", "part").alias("bin"), F.col("cap").alias("tokens"))
    return one.unionByName(full).withColumnRenamed("id", doc_id)


def p8_pack(spark, sf_dir: str) -> DataFrame:
    """The container of every text of `documents`, for each kind of container in `pack_limits`."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "pack_limits"))


def p8_usage(spark, sf_dir: str) -> DataFrame:
    """(container, bins, tokens, fill): how full the containers are."""
    caps = table(spark, sf_dir, "pack_limits")
    x = p8_pack(spark, sf_dir).groupBy("container", "bin").agg(F.sum("tokens").alias("t")).groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("t").alias("tokens"))
    return x.join(F.broadcast(caps.dropDuplicates(["container"])), "container").select("container", "bins", "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("fill"))


def p8_checks(spark, sf_dir: str) -> DataFrame:
    """(container, n_over, n_tokens, n_texts): per kind the bins beyond their capacity (none), and all tokens and texts that have a place."""
    caps = table(spark, sf_dir, "pack_limits").dropDuplicates(["container"])
    x = p8_pack(spark, sf_dir)
    bins = x.groupBy("container", "bin").agg(F.sum("tokens").alias("t")).join(F.broadcast(caps), "container").groupBy("container").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_over"), F.sum("t").alias("n_tokens"))
    return bins.join(x.groupBy("container").agg(F.count_distinct("doc_id").alias("n_texts")), "container")


def p8_texts(spark, sf_dir: str) -> DataFrame:
    """(container, doc_id, n_rest): every text that has a place, with the number of parts of it that share a bin with others: one, its rest or itself."""
    x = p8_pack(spark, sf_dir)
    return x.groupBy("container", "doc_id").agg(F.count_if(~F.col("bin").startswith("full")).alias("n_rest"))


P8_TEXTS_SQL = "select container, doc_id, 1 as n_rest from documents, (select distinct container from pack_limits where capacity_tokens > 0) where length(text) > 0"
