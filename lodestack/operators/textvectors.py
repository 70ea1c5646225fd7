"""Vectors of texts learnt from the texts themselves: the leading singular vectors of their TF-IDF matrix.

Every word falls into one of a fixed number of columns by the CRC-32 of its bytes, so the vocabulary needs no cap. A row is a text's
(1 + ln tf) * idf by column, brought to length 1; texts are counted by column once, and all passes read the counts.
The right singular vectors are found by subspace iteration from a random start of fixed seed: each round is one pass in which tasks, two for each core, sum a (a' Q) over their rows a, and hand on their sums in blocks of columns; the
blocks are added up by block. So what a round shuffles is of one size, too. What the driver gets of a round is of one size whatever the input, columns * (dims + EXTRA) numbers. A text's vector is its row times those vectors.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.retrieval import SCORES, WORDS, by_words
from lodestack.shared import written

COLUMNS, DIMS, EXTRA, ROUNDS, SEED = 16_384, 256, 16, 3, 7
#: Columns of a block of sums.
BLOCK = 1024
#: Columns that at least one of so many texts has are a dense matrix in products, of so many rows at once.
COMMON, DENSE_ROWS = 32, 500


@dataclass(frozen=True)
class Basis:
    idf: np.ndarray  # by column
    vectors: np.ndarray  # column x dimension
    values: np.ndarray  # singular values, descending


def _counted(lists: pa.Array, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, tf) of lists of words, sorted."""
    lists = lists.cast(pa.list_(pa.string()))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    found = lists.flatten().dictionary_encode()
    column = np.array([zlib.crc32(w.encode()) % columns for w in found.dictionary.to_pylist()], np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes) * columns + (column[found.indices.to_numpy(zero_copy_only=False)] if len(column) else 0)
    pairs, tf = np.unique(own, return_counts=True)
    return pairs // columns, pairs % columns, tf


def counts(docs: DataFrame, key: str, words: str, columns: int = COLUMNS) -> DataFrame:
    """(key, at, tf): each text as its columns and how often they stand there, both packed as 32-bit integers. Null lists of words are empty."""

    def run(batches):
        for batch in by_words(batches, WORDS):
            row, column, tf = _counted(batch.column(1), columns)
            ends = pa.py_buffer((4 * np.searchsorted(row, np.arange(batch.num_rows + 1))).astype(np.int32).tobytes())
            packed = (pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, pa.py_buffer(x.astype(np.int32).tobytes())]) for x in (column, tf))
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed], names=["key", "at", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, words).mapInArrow(run, f"key {kind}, at binary, tf binary").withColumnRenamed("key", key)


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row begins (and the last one ends), and the numbers of all rows."""
    packed = packed.cast(pa.binary())
    sizes = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, 4 * packed.offset) if len(packed) else np.zeros(1, np.int32)
    ends = (sizes - sizes[0]) // 4
    return ends, np.frombuffer(packed.buffers()[2], np.int32, int(ends[-1]), int(sizes[0])) if ends[-1] else np.zeros(0, np.int32)


def _runs(batches, most: int):
    """(rows, row, column, tf) of runs of rows with at most so many entries; a longer row is a run of its own. The last two columns of batches are packed."""
    for batch in batches:
        (ends, at), (_, tf) = (_unpacked(batch.column(i)) for i in (-2, -1))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
            own = slice(ends[first], ends[last])
            yield batch.slice(first, last - first), np.repeat(np.arange(last - first), np.diff(ends[first : last + 1])), at[own], tf[own]
            first = last


class _Products:
    """Products of rows with a matrix q of a row a column. Common columns are a dense part of it, the rows' other columns are taken one by one."""

    def __init__(self, idf: np.ndarray, q: np.ndarray):
        self.idf, self.q = idf, q
        self.common = np.flatnonzero(idf <= 1 + np.log(COMMON))
        self.place = np.full(len(idf), -1)
        self.place[self.common] = np.arange(len(self.common))
        self.dense = q[self.common]

    def of(self, n: int, row: np.ndarray, column: np.ndarray, tf: np.ndarray):
        """(first, rows a, the other columns' (row, column, weight), a q) of n rows, some at a time; each row is brought to length 1."""
        weight = (1 + np.log(tf)) * self.idf[column]
        length = np.sqrt(np.bincount(row, weight * weight, minlength=n))
        weight = weight / np.where(length > 0, length, 1)[row]
        step = max(1, min(DENSE_ROWS, SCORES // max(1, len(self.common))))
        for first in range(0, n, step):
            own = slice(*np.searchsorted(row, [first, first + step]))
            r, c, w = row[own] - first, column[own], weight[own]
            at = self.place[c]
            on = at >= 0
            a = np.zeros((min(step, n - first), len(self.common)))
            a[r[on], at[on]] = w[on]
            out = a @ self.dense
            r, c, w = r[~on], c[~on], w[~on]
            ends = np.searchsorted(r, np.arange(len(out) + 1))
            for i in np.flatnonzero(np.diff(ends)):
                some = slice(ends[i], ends[i + 1])
                out[i] += w[some] @ self.q[c[some]]
            yield first, a, (r, c, w), out

    def add(self, total: np.ndarray, dense: np.ndarray, a: np.ndarray, others, out: np.ndarray) -> None:
        """Add a' (a q): common columns to dense, the others to total."""
        dense += a.T @ out
        r, c, w = others
        order = np.argsort(c, kind="stable")
        r, c, w = r[order], c[order], w[order]
        at, begins = np.unique(c, return_index=True)
        for column, i, j in zip(at, begins, np.append(begins[1:], len(c))):
            total[column] += w[i:j] @ out[r[i:j]]


def _idf(held: DataFrame, columns: int) -> np.ndarray:
    """idf by column."""

    def run(batches):
        df, n = np.zeros(columns, np.int64), 0
        for rows, _, column, _ in _runs(batches, WORDS):
            df += np.bincount(column, minlength=columns)
            n += rows.num_rows
        at = np.append(np.flatnonzero(df), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.append(df[at[:-1]], n), pa.int64())], names=["at", "n"])

    found = dict(held.select("at", "tf").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect())  # a row a column
    n, df = found.pop(-1, 0), np.zeros(columns)
    df[list(found)] = list(found.values())
    return np.log((1 + n) / (1 + df)) + (1.0 if n else 0.0)


def _pass(held: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sum of a (a' q) over all rows a."""
    context = held.sparkSession.sparkContext
    sent = context.broadcast((idf, q))

    def run(batches):
        products = _Products(*sent.value)
        total, dense = np.zeros_like(products.q), np.zeros_like(products.dense)
        for rows, row, column, tf in _runs(batches, WORDS):
            for _, a, others, out in products.of(rows.num_rows, row, column, tf):
                products.add(total, dense, a, others, out)
        total[products.common] += dense
        blocks = [total[i : i + BLOCK] for i in range(0, len(total), BLOCK)]
        some = [i for i, b in enumerate(blocks) if b.any()]
        for i in some:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blocks[i].tobytes()], pa.binary())], names=["block", "sums"])

    def add(table):
        total = 0
        for x in table["sums"]:
            total = total + np.frombuffer(x.as_buffer())
        return pa.table({"block": table["block"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros_like(q)
    for r in held.select("at", "tf").coalesce(2 * context.defaultParallelism).mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").collect():  # columns / BLOCK rows
        own = out[r.block * BLOCK : (r.block + 1) * BLOCK]
        own += np.frombuffer(r.sums).reshape(own.shape)
    return out


def fit(docs: DataFrame, key: str, words: str, dims: int = DIMS, columns: int = COLUMNS, rounds: int = ROUNDS, seed: int = SEED) -> Basis:
    """The basis of a table of texts (key, words: an array). Texts without words, and null ones, count for idf only. More dims than there are texts or
    columns are filled with zero vectors."""
    if not 0 < dims <= columns:
        raise ValueError("dims must be from 1 to the number of columns")
    return fit_counts(written(counts(docs, key, words, columns), "vectors-counts"), dims, columns, rounds, seed)


def fit_counts(held: DataFrame, dims: int = DIMS, columns: int = COLUMNS, rounds: int = ROUNDS, seed: int = SEED) -> Basis:
    """fit() for a table of counts(), which is read whole for each round."""
    idf = _idf(held, columns)
    width = min(columns, dims + EXTRA)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((columns, width)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(_pass(held, idf, q))[0]
    values, turn = np.linalg.eigh(q.T @ _pass(held, idf, q))
    order = np.argsort(-values)[:dims]
    values = np.sqrt(np.maximum(values[order], 0))
    vectors = q @ turn[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)] < 0, -1, 1) * (values > 1e-9)  # one of two signs; nothing beyond the rank
    return Basis(idf, vectors, values)


def text_vectors(docs: DataFrame, key: str, words: str, basis: Basis) -> DataFrame:
    """(key, vector): each text by a basis. Texts without known words have zero vectors."""
    return vectors_of_counts(counts(docs, key, words, len(basis.idf)), key, basis)


def vectors_of_counts(held: DataFrame, key: str, basis: Basis) -> DataFrame:
    """text_vectors() for a table of counts()."""
    sent = held.sparkSession.sparkContext.broadcast((basis.idf, basis.vectors))

    def run(batches):
        products = _Products(*sent.value)
        for rows, row, column, tf in _runs(batches, WORDS):
            for first, _, _, out in products.of(rows.num_rows, row, column, tf):
                ends = pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(first, len(out)), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["key", "vector"])

    kind = held.schema[key].dataType.simpleString()
    return held.select(key, "at", "tf").mapInArrow(run, f"key {kind}, vector array<double>").withColumnRenamed("key", key)
