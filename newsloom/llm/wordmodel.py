"""Shared by the text classifiers: words as averages of hashed n-gram weights.

Scores are linear in the words of a segment, so each distinct token is scored
once per worker and segments are sums of table rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def normal(token: str) -> str:
    """The letters of a token in lower case; '' if it has none."""
    m = _LETTERS.search(token)
    return m.group(0).lower() if m else ""


def ngrams(word: str, lo: int, hi: int, buckets: int, whole: bool) -> list[int]:
    """Buckets of the n-grams of <word>, and of the word itself first if `whole`."""
    w = f"<{word}>"
    out = [zlib.crc32(b"=" + w.encode()) % buckets] if whole else []
    for n in range(lo, min(hi, len(w)) + 1):
        out += [zlib.crc32(w[i : i + n].encode()) % buckets for i in range(len(w) - n + 1)]
    return out or [zlib.crc32(w.encode()) % buckets]


class TokenTable(dict):
    """Ids of raw tokens, with the score row of each; made as tokens appear.

    Id 0 is for tokens without letters: a zero row that does not count.
    """

    def __init__(self, weights: np.ndarray, lo: int, hi: int, whole: bool, share: float = 0.0) -> None:
        super().__init__()
        self.weights, self.lo, self.hi, self.whole, self.share = weights, lo, hi, whole, share
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.rows = np.zeros((1 << 12, self.weights.shape[1]), np.float32)
        self.words: dict[str, int] = {"": 0}
        self.n = 1

    def __missing__(self, token: str) -> int:
        word = normal(token)
        at = self.words.get(word)
        if at is None:
            if self.n == len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            at = self.words[word] = self.n
            self.rows[at] = self.vector(word)
            self.n += 1
        self[token] = at
        return at

    def vector(self, word: str) -> np.ndarray:
        f = ngrams(word, self.lo, self.hi, len(self.weights), self.whole)
        if not self.whole:
            return self.weights[f].mean(0)
        return (self.weights[f[0]] + self.weights[f[1:]].mean(0)) / 2 if len(f) > 1 else self.weights[f[0]]


def averages(rows: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean row and number of counted words of each segment; `ends` are the segments' ends in `ids`."""
    starts = np.concatenate(([0], ends[:-1]))
    if not len(ends):
        return np.zeros((0, rows.shape[1]), np.float32), np.zeros(0, np.int64)
    counted = np.concatenate(([0], np.cumsum(ids > 0)))
    n = counted[ends] - counted[starts]
    sums = np.zeros((len(ends), rows.shape[1]), np.float32)
    full = np.flatnonzero(ends > starts)
    first = 0
    while first < len(full):  # in blocks, so that the words' rows stay in the cache
        last = max(first + 1, int(np.searchsorted(ends[full], ends[full[first]] + 20_000)))
        part, at = full[first:last], starts[full[first]]
        sums[part] = np.add.reduceat(rows[ids[at : ends[part[-1]]]], starts[part] - at, axis=0)
        first = last
    return sums / np.maximum(n, 1)[:, None], n


class Corpus:
    """Segments of a training sample: words by their n-gram buckets, segments by their words."""

    def __init__(self, segments: list[list[str]], lo: int, hi: int, buckets: int, whole: bool) -> None:
        vocab: dict[str, int] = {}
        ids, ends = [], []
        for seg in segments:
            ids += [vocab.setdefault(w, len(vocab)) for w in seg]
            ends.append(len(ids))
        self.ids = np.array(ids, np.int64)
        self.starts = np.concatenate(([0], np.array(ends, np.int64)[:-1])) if ends else np.zeros(0, np.int64)
        self.n = np.diff(np.concatenate((self.starts, [len(ids)]))).astype(np.float32)
        flat, part, at = [], [], [0]
        for w in vocab:
            f = ngrams(w, lo, hi, buckets, whole)
            flat += f
            m = len(f) - 1
            part += [0.5, *[0.5 / m] * m] if whole and m else [1 / len(f)] * len(f)
            at.append(len(flat))
        self.flat, self.part, self.at = np.array(flat, np.int64), np.array(part, np.float32), np.array(at[:-1], np.int64)
        self.word = np.repeat(np.arange(len(vocab)), np.diff(at))
        self.word_order = np.argsort(self.ids, kind="stable")
        self.seg = np.repeat(np.arange(len(segments)), self.n.astype(np.int64))

    _ARRAYS = ("ids", "starts", "n", "flat", "part", "at", "word", "word_order", "seg")

    def arrays(self) -> dict[str, np.ndarray]:
        """What a copy is made of, in narrow types."""
        return {k: v.astype(np.int32) if v.dtype == np.int64 else v for k in self._ARRAYS for v in [getattr(self, k)]}

    @classmethod
    def of(cls, arrays) -> Corpus:
        """The corpus that `arrays` were taken of."""
        out = cls.__new__(cls)
        for k in cls._ARRAYS:
            setattr(out, k, arrays[k].astype(np.int64) if arrays[k].dtype == np.int32 else arrays[k])
        return out

    def forward(self, weights: np.ndarray) -> np.ndarray:
        words = np.add.reduceat(weights[self.flat] * self.part[:, None], self.at, axis=0)
        return np.add.reduceat(words[self.ids], self.starts, axis=0) / self.n[:, None]

    def backward(self, grad: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        per = (grad / self.n[:, None])[self.seg[self.word_order]]
        ids = self.ids[self.word_order]
        cuts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        words = np.zeros((len(self.at), grad.shape[1]), np.float32)
        words[ids[cuts]] = np.add.reduceat(per, cuts, axis=0)
        out = np.zeros(shape, np.float32)
        contribution = words[self.word] * self.part[:, None]
        order = np.argsort(self.flat, kind="stable")
        f = self.flat[order]
        cuts = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
        out[f[cuts]] = np.add.reduceat(contribution[order], cuts, axis=0)
        return out


class Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m, v = self.state.get(k, (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.state[k] = (m, v)
            params[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
