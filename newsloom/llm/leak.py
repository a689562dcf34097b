"""Problem 9: passages of held-out test items inside the corpus.

Texts become lower-case words with one space between; each letter of a script
that writes without blanks is a word. By the q-gram lemma two strings of length m
share at least m - q + 1 q-grams less those that edits destroy, and all of them
lie on diagonals no farther apart than the edits can shift. Each document's
q-grams are looked up in those of the items; hits are counted per item in
overlapping bands of diagonals, with the bound of that item, and the regions kept
are verified by an alignment of their words in the band, which accepts up to
`edits` inserted, missing or changed words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.common import table

#: Characters of the items whose index one pass holds in memory (at 30 bytes each); larger sets take several passes.
CHARS_PER_PASS = 4_000_000
#: Most hits that are held at once.
HITS = 2_000_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Blocks of the scripts that write without blanks between words: Thai, Lao, Myanmar, Khmer, kana and Han.
_UNPARTED = r"[\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case, each after one space."""
    parted = F.when(text.rlike(_UNPARTED), F.regexp_replace(text, f"({_UNPARTED})", " $1 ")).otherwise(text)
    return F.concat(F.lit(" "), F.trim(F.lower(F.regexp_replace(parted, r"[^\p{L}\p{N}]+", " "))), F.lit(" "))


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of q bytes (9 to 16), from two overlapping 8-byte words."""
    if len(data) < q:
        return np.empty(0, np.uint64)
    data = np.ascontiguousarray(data)
    n = len(data) - q + 1
    a = np.ndarray((n,), "<u8", data, 0, (1,))
    b = np.ndarray((n,), "<u8", data, q - 8, (1,))
    h = a * _MIX[0]
    h ^= b * _MIX[1]
    return h


class Index:
    """The q-grams of the items and where they stand, with the bound and the shift of each item."""

    def __init__(self, ids: list[int], texts: list[str], run: int, q: int, edits: int) -> None:
        self.ids, self.run, self.q, self.edits = ids, run, q, edits
        self.texts = [t.encode() for t in texts]
        self.where: dict[int, dict[bytes, list[int]]] = {}
        self.least = np.ones(len(ids), np.int64)
        self.shift = np.zeros(len(ids), np.int64)
        for i, t in enumerate(texts):
            sizes = np.array([len(w.encode()) + 1 for w in t.split()], np.int64)
            if len(sizes) >= run:
                total = np.concatenate(([0], np.cumsum(sizes)))
                shortest = int((total[run:] - total[:-run]).min()) - 1
                longest = int(sizes.max())
                # an edit destroys the q-grams that touch its word and moves what follows by it
                self.least[i] = max(1, shortest - q + 1 - edits * (longest + q - 1))
                self.shift[i] = edits * longest
        grams = [_grams(np.frombuffer(r, np.uint8), q) for r in self.texts]
        self.gram = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        self.item = np.concatenate([np.full(len(g), i, np.int32) for i, g in enumerate(grams)]) if grams else np.empty(0, np.int32)
        self.at = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.empty(0, np.int32)
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.at = self.gram[order], self.item[order], self.at[order]
        self.top = np.uint64(64 - max(22, (16 * len(self.gram)).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.top)), bool)
        self.seen[(self.gram >> self.top).astype(np.int64)] = True

    def regions(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(document, item, first and last place, least and greatest diagonal) whose shared q-grams meet the item's bound in one band."""
        g = _grams(data, self.q)
        pos = np.flatnonzero(self.seen[(g >> self.top).astype(np.int64)])
        lo = np.searchsorted(self.gram, g[pos], "left")
        n = np.searchsorted(self.gram, g[pos], "right") - lo
        doc = np.searchsorted(offsets, pos, "right") - 1
        good = (n > 0) & (pos + self.q <= offsets[doc + 1])  # no q-gram across two documents
        pos, lo, n, doc = pos[good], lo[good], n[good], doc[good]
        found = [np.empty((0, 6), np.int64)]
        # documents in turns of about HITS hits, as a q-gram may stand in many items
        total = np.cumsum(n)
        start = 0
        while start < len(pos):
            end = int(np.searchsorted(total, (total[start - 1] if start else 0) + HITS, "right"))
            end = len(pos) if end >= len(pos) else max(int(np.searchsorted(doc, doc[end], "left")), start)
            end = int(np.searchsorted(doc, doc[start], "right")) if end == start else end
            found.append(self._bands(pos[start:end], lo[start:end], n[start:end], doc[start:end], offsets))
            start = end
        return np.concatenate(found)

    def _bands(self, pos: np.ndarray, lo: np.ndarray, n: np.ndarray, doc: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        take = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        pos, doc = np.repeat(pos, n), np.repeat(doc, n)
        item = self.item[take].astype(np.int64)
        pos = pos - offsets[doc]
        diagonal = pos - self.at[take]
        width = 2 * (self.shift[item] + 1)
        found = []
        for half in (0, 1):
            band = (diagonal + half * (width // 2)) // width
            order = np.lexsort((band, item, doc))
            d, i, b = doc[order], item[order], band[order]
            start = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1]))))
            count = np.diff(np.concatenate((start, [len(d)])))
            p, g = pos[order], diagonal[order]
            rows = np.stack((d[start], i[start], np.minimum.reduceat(p, start), np.maximum.reduceat(p, start), np.minimum.reduceat(g, start), np.maximum.reduceat(g, start)), 1)
            found.append(rows[count >= self.least[i[start]]])
        return np.concatenate(found)

    def places(self, i: int) -> dict[bytes, list[int]]:
        """Where each word of item `i` stands."""
        if i not in self.where:
            self.where[i] = out = {}
            for j, w in enumerate(self.texts[i].split()):
                out.setdefault(w, []).append(j)
        return self.where[i]

    def verify(self, text: bytes, rows: np.ndarray) -> tuple[int, int, int, int, int] | None:
        """The longest alignment within the regions `rows` of one document and item: words of the item, edits, the longest run without edits, first word in the document and in the item."""
        i = int(rows[0, 1])
        body, best, exact = self.texts[i], None, 0
        starts = np.flatnonzero(np.frombuffer(body, np.uint8)[:-1] == 32)
        merged: list[list[int]] = []  # bands overlap
        for first, last, low, high in sorted(rows[:, 2:].tolist(), key=lambda r: r[2]):
            if merged and low <= merged[-1][3]:
                m = merged[-1]
                merged[-1] = [min(m[0], first), max(m[1], last), m[2], max(m[3], high)]
            else:
                merged.append([first, last, low, high])
        for first, last, low, high in merged:
            slack = self.q + int(self.shift[i]) + 1
            a = text.rfind(b" ", 0, max(first - slack, 0) + 1)
            b = text.find(b" ", min(last + self.q + slack, len(text) - 1))
            doc = text[a:b].split()
            before = text.count(b" ", 0, a)
            # the band in words: which word of the item stands at the places of the document's words
            own = np.flatnonzero(np.frombuffer(text[a:b], np.uint8) == 32)[: len(doc)] + a
            from_ = np.searchsorted(starts, own - high - self.shift[i], "right") - 1 - self.edits
            to = np.searchsorted(starts, own - low + self.shift[i], "right") + self.edits
            got = align(doc, len(starts), self.places(i), self.edits, from_.tolist(), to.tolist())
            exact = max(exact, got[2])
            if got[0] >= self.run and (best is None or (got[0], -got[1]) > (best[0], -best[1])):
                best = (*got[:2], got[3] + before, got[4])
        return (*best[:2], exact, *best[2:]) if best else None


def align(doc: list[bytes], n: int, places: dict[bytes, list[int]], edits: int, from_: list[int], to: list[int]) -> tuple[int, int, int, int, int]:
    """Banded alignment of words with those of an item, of which there are `n`, by their `places`: (words of the item, edits, longest run without edits, first word in `doc`, in `item`) of the longest one.

    Word k of `doc` meets the words from_[k] to to[k] of the item. An alignment
    starts and ends with equal words and has at most `edits` changed, inserted or
    missing words in between.
    """
    best, exact = (0, 0, -1, -1), 0
    # per number of edits: the alignments that end at a word of the item, by length and first word; most words have none
    before: list[dict[int, tuple[int, int]]] = [{} for _ in range(edits + 1)]
    for k, w in enumerate(doc):
        hits = [j for j in places.get(w, ()) if from_[k] <= j <= to[k]]
        now: list[dict[int, tuple[int, int]]] = []
        for e in range(edits + 1):
            own: dict[int, tuple[int, int]] = {}
            for j in hits:
                if at := before[e].get(j - 1):
                    own[j] = (at[0] + 1, at[1])
                elif not e:
                    own[j] = (1, k)
                else:
                    continue
                if own[j][0] > best[0]:
                    best = (own[j][0], e, own[j][1], j - own[j][0] + 1)
                if not e and own[j][0] > exact:
                    exact = own[j][0]
            if e:
                for j, (size, at) in before[e - 1].items():
                    for to_, v in ((j, (size, at)), (j + 1, (size + 1, at))):  # an inserted or a changed word
                        if to_ < n and v > own.get(to_, (0, 0)):
                            own[to_] = v
                for j, (size, at) in now[e - 1].items():  # a missing word
                    if j + 1 < n and (size + 1, at) > own.get(j + 1, (0, 0)):
                        own[j + 1] = (size + 1, at)
            now.append(own)
        before = now
    return best[0], best[1], exact, best[2], best[3]


def _searcher(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            text = batch.column(1)
            if isinstance(text, pa.ChunkedArray):
                text = text.combine_chunks()
            kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
            _, offs, buf = text.buffers()
            offsets = np.frombuffer(offs, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            if not len(text) or buf is None:
                continue
            data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            kept = index.regions(data, offsets)
            kept = kept[np.lexsort((kept[:, 1], kept[:, 0]))]
            cuts = np.flatnonzero(np.concatenate(([True], (kept[1:, :2] != kept[:-1, :2]).any(1)))) if len(kept) else []
            out = []
            for rows in np.split(kept, cuts[1:]) if len(kept) else []:
                d, i = int(rows[0, 0]), int(rows[0, 1])
                if got := index.verify(data[offsets[d] : offsets[d + 1]].tobytes(), rows):
                    out.append((batch.column(0)[d].as_py(), index.ids[i], *got))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.int32()] * 5), strict=True)], names=["doc", "item", "n_words", "edits", "exact", "doc_word", "item_word"])

    return search


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 13, q: int = 12, edits: int = 1) -> DataFrame:
    """(doc, item, n_words, edits, exact, doc_word, item_word): documents with at least `run` consecutive words of an item, up to `edits` edited words.

    `n_words` is the length of the longest alignment in words of the item,
    `edits` how many of them are edited, `exact` the longest run without edits;
    the last two say at which word it starts. Null and empty texts and items
    shorter than `run` words match nothing; repeated rows of either side each
    give theirs. The items are test sets, far fewer than the documents: they are
    read in passes of `CHARS_PER_PASS` characters, every document meets all.
    """
    rows = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), words(F.col(item_text)).alias("t")).where(F.size(F.split("t", " ")) >= run + 2).orderBy("i", "t")
    x = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc"), words(F.col(text)).alias("t"))
    out, ids, texts, held = None, [], [], 0

    def search(found: DataFrame | None) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(Index(ids, texts, run, q, edits))
        one = x.mapInArrow(_searcher(shared), "doc bigint, item bigint, n_words int, edits int, exact int, doc_word int, item_word int")
        return one if found is None else found.union(one)

    for r in rows.toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        held += len(r["t"])
        if held >= CHARS_PER_PASS:
            out = search(out)
            ids, texts, held = [], [], 0
    return search(out) if ids or out is None else out


def p9_found(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of documents with 13 consecutive words of a test item, none of them edited."""
    return p9_edited(spark, sf_dir).where("exact >= 13").select("doc_id", "item_id").distinct()


def p9_edited(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_words, edits, exact): also passages with one word changed, inserted or missing."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return find_leaks(d, "doc_id", "text", e, "item_id", "text").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_words", "edits", "exact")


P9_FOUND_SQL = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
e as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items where text is not null),
dr as (select doc_id, array_to_string(w[i:i + 12], ' ') as run from d, unnest(range(1, len(w) - 11)) as t(i) where len(w) >= 13),
er as (select item_id, array_to_string(w[i:i + 12], ' ') as run from e, unnest(range(1, len(w) - 11)) as t(i) where len(w) >= 13)
select distinct doc_id, item_id from dr join er using (run)
"""
