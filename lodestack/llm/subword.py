"""Supervised subword embeddings: a text classifier of hashed word and character n-gram vectors.

A document is the mean of the vectors of its features: for every word, the word itself and its character n-grams,
and for a word that repeats the one before, the bigram of a word with itself; all hashed into a fixed number of rows. A
softmax layer reads that mean. Both are learned by stochastic gradient descent in numpy on a bounded sample of
labelled documents. Since mean and softmax input are linear, each feature comes down to one number at the end,
and scoring a text is a sum over its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of words whose n-grams are made at once; longer words are cut in pieces that overlap, so that no n-gram is lost.
PIECE = 500_000
AGAIN = b"a word with itself"


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word at each place, and where each text ends. White space parts words (null: no words)."""
    pieces = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = pieces.flatten().dictionary_encode()
    place, ends = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), pieces.offsets.to_numpy(zero_copy_only=False)[1:] - pieces.offsets[0].as_py()
    real = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)
    if not real.all():  # white space at the ends leaves empty words
        keep = real[place]
        ends = np.r_[0, np.cumsum(keep)][ends]
        place = (np.cumsum(real) - 1)[place[keep]]
        return words.dictionary.filter(pa.array(real)), place, ends
    return words.dictionary, place, ends


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about most bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def features(words: list[str], buckets: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, owners) in turns: the rows of the features of all words, the word itself and all its n-grams, and which word each is of."""
    if words:
        yield np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % buckets, np.arange(len(words))
    held: list[tuple[int, str]] = []
    size = 0
    for i, w in enumerate(words):
        marked = f"<{w}>"
        # Pieces of a long word overlap by high - 1 characters; each makes the n-grams that start in it and not in the next.
        for at in range(0, len(marked), PIECE):
            held.append((i, marked[at : at + PIECE + high - 1]))
            size += len(held[-1][1])
            if size >= PIECE:
                yield _ngrams(held, buckets, low, high)
                held, size = [], 0
    if held:
        yield _ngrams(held, buckets, low, high)


def _ngrams(held: list[tuple[int, str]], buckets: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the n-grams of some pieces of words, and the words that they are of. The last high - 1 characters of a piece that
    goes on start none."""
    letters = np.frombuffer("".join(t for _, t in held).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(t) for _, t in held], np.int64)
    owner = np.repeat(np.array([i for i, _ in held], np.int64), length)
    inside = np.arange(len(letters)) - np.repeat(np.cumsum(length) - length, length)
    left = np.repeat(length, length) - inside
    rows, owners = [], []
    h = np.zeros(len(letters), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, high + 1):
            h = h[: max(0, len(letters) - n + 1)] * np.uint64(0x100000001B3) + letters[n - 1 :] + np.uint64(1)
            if n >= low:
                at = np.flatnonzero((left[: len(h)] >= n) & (inside[: len(h)] < PIECE))
                mixed = (h[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                rows.append(((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
                owners.append(owner[at])
    return np.concatenate(rows), np.concatenate(owners)


def n_features(words: list[str], low: int, high: int) -> np.ndarray:
    """How many features each word has."""
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return 1 + sum(np.maximum(0, length - n + 1) for n in range(low, high + 1))


def repeats(place: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word is the one before it in its text."""
    same = np.r_[False, place[1:] == place[:-1]][: len(place)]
    same[ends[:-1][ends[:-1] < len(place)]] = False
    return same


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of values up to each end, from the end before."""
    return np.diff(np.r_[0, np.r_[0, np.cumsum(values)][ends]])


@dataclass
class SubwordClassifier:
    """Two classes, 0 and 1. Training goes over its rows until it has seen `examples`; reruns with a seed agree."""

    buckets: int = 1 << 16
    dim: int = 10
    low: int = 2
    high: int = 4
    examples: int = 24_000
    rate: float = 2.0
    batch: int = 32
    seed: int = 11
    weights: np.ndarray = field(default=None, repr=False)
    bias: float = 0.0
    empty: float = 0.5

    def document(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a whole text's features and their shares of them; at most `buckets` of either, however long the text."""
        words, place, ends = split(pa.array([text], pa.string()))
        times = np.bincount(place, minlength=len(words)).astype(float)
        count = np.zeros(self.buckets)
        for rows, owners in features(words.to_pylist(), self.buckets, self.low, self.high):
            count += np.bincount(rows, times[owners], minlength=self.buckets)
        count[zlib.crc32(AGAIN) % self.buckets] += repeats(place, ends).sum()
        found = np.flatnonzero(count)
        return found.astype(np.int32), (count[found] / max(1.0, count.sum())).astype(np.float32)

    def fit(self, texts: pa.Array, labels: np.ndarray) -> SubwordClassifier:
        """Learn from texts and their labels."""
        return self.learn([self.document(t.as_py()) for t in texts], labels)

    def learn(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> SubwordClassifier:
        """Learn from documents (see document()) and their labels. Texts without words teach only the score of such texts."""
        labels = np.asarray(labels, np.int64)
        rng = np.random.default_rng(self.seed)
        vectors = ((rng.random((self.buckets, self.dim)) - 0.5) / self.dim).astype(np.float32)
        out, offset = np.zeros((self.dim, 2), np.float32), np.zeros(2, np.float32)
        blank = np.array([len(rows) == 0 for rows, _ in docs], bool)
        usable = np.flatnonzero(~blank)
        epochs = -(-self.examples // max(1, len(usable))) if len(usable) else 0
        done, total = 0, max(1, epochs * len(usable))
        for _ in range(epochs):
            order = rng.permutation(usable)
            for begin in range(0, len(order), self.batch):
                chosen = order[begin : begin + self.batch]
                f = np.concatenate([docs[i][0] for i in chosen]).astype(np.int64)
                w = np.concatenate([docs[i][1] for i in chosen])[:, None]
                o = np.repeat(np.arange(len(chosen)), [len(docs[i][0]) for i in chosen])
                mean = np.add.reduceat(vectors[f] * w, np.searchsorted(o, np.arange(len(chosen))), axis=0)
                logit = mean @ out + offset
                p = np.exp(logit - logit.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(chosen)), labels[chosen]] -= 1
                step = np.float32(self.rate * (1 - done / total))
                back = p @ out.T
                out -= step * (mean.T @ p) / len(chosen)
                offset -= step * p.mean(axis=0) / 4
                # A feature of several documents of the batch takes the sum of their steps.
                by_row = np.argsort(f, kind="stable")
                rows = f[by_row]
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                vectors[rows[first]] -= step * np.add.reduceat(back[o[by_row]] * w[by_row], first, axis=0)
                done += len(chosen)
        self.weights = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)
        self.bias = float(offset[1] - offset[0])
        self.empty = (float(labels[blank].sum()) + 1) / (int(blank.sum()) + 2)
        return self

    def scores(self, texts: pa.Array) -> np.ndarray:
        """How likely class 1 is, from 0 to 1. Texts without words have the share of class 1 among such (smoothed)."""
        words, place, ends = split(texts)
        words = words.to_pylist()
        lean, size = np.zeros(len(words)), n_features(words, self.low, self.high)
        for rows, owners in features(words, self.buckets, self.low, self.high):
            lean += np.bincount(owners, self.weights[rows].astype(float), minlength=len(words))
        again = repeats(place, ends)
        total = sums(lean[place] + again * float(self.weights[zlib.crc32(AGAIN) % self.buckets]), ends)
        n = sums(size[place] + again, ends)
        found = 1 / (1 + np.exp(-np.clip(total / np.maximum(1, n) + self.bias, -500, 500)))
        return np.where(n > 0, found, self.empty)
