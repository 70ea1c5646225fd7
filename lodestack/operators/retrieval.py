"""Batch retrieval: a keyword index, hashed vectors, exact cosine, rank fusion and evaluation of ranked lists."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.shared import new_path, sign_of_files, small, written

#: Queries scored together, and bytes of packed queries that are sent to all tasks; more are joined.
QUERY_BLOCK, BROADCAST_BYTES = 4096, 64_000_000
#: Scores of a matrix of queries and documents, and words that are counted at once, so that a task's memory is the same however many rows there are.
SCORES, WORDS = 1_000_000, 500_000
#: Words of queries that meet all texts in one pass, and cells of a matrix of words and queries.
OVERLAP_ROWS, OVERLAP_CELLS = 200_000, 4_000_000
#: Tables of at most so many rows are broadcast; the count is checked.
BROADCAST_ROWS = 300_000
#: Components of hashed vectors: the first byte of a word's MD5.
HASHED = 256
POSTING = "doc {}, dl int, term string, tf long"


def by_words(batches: Iterator[pa.RecordBatch], most: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches, of which a column is lists, in slices of at most so many items; a longer list is a slice of its own."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def postings(docs: DataFrame, key: str, words: str) -> DataFrame:
    """(doc, dl, term, tf) of every word of every document, and a row with the empty term for each document itself. Words are counted
    where the document lies, in Arrow batches, so nothing is shuffled. A null list of words has the length 0."""

    def run(batches):
        for batch in by_words(batches, WORDS):
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = lists.flatten().dictionary_encode()
            own = np.repeat(np.arange(batch.num_rows), sizes) * (len(found.dictionary) + 1) + found.indices.to_numpy(zero_copy_only=False)
            pairs, n = np.unique(own, return_counts=True)
            row, term = pairs // (len(found.dictionary) + 1), pairs % (len(found.dictionary) + 1)
            rows = np.concatenate([row, np.arange(batch.num_rows)])
            terms = pa.concat_arrays([found.dictionary.cast(pa.string()).take(pa.array(term)), pa.array([""] * batch.num_rows, pa.string())])
            tf = np.concatenate([n, np.ones(batch.num_rows, np.int64)])
            for k in range(0, len(rows), 100_000):
                at = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[at])), pa.array(sizes[rows[at]], pa.int32()), terms.slice(k, 100_000), pa.array(tf[at])], names=["doc", "dl", "term", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, words).mapInArrow(run, POSTING.format(kind))


def ordered_by_term(index: DataFrame) -> DataFrame:
    """Postings in the order of terms, so that a reader skips what it does not ask for; a common term is spread over partitions."""
    return index.repartitionByRange("term", "doc").sortWithinPartitions("term")


#: Keyword indexes of this session, by session, name and the sign of their files.
_INDEXES: dict[tuple, str] = {}


def keyword_index(source: DataFrame, docs: DataFrame, key: str, words: str, name: str) -> DataFrame:
    """The postings of docs as a table, which is written once as long as the files of source, from which docs is made, are the same."""
    spark, sign = source.sparkSession, sign_of_files(source)
    at = (spark.sparkContext.applicationId, name, sign)
    if sign is None or at not in _INDEXES:
        path = new_path(spark, f"index-{name}")
        postings(docs, key, words).write.parquet(path)
        _INDEXES[at] = path
    return spark.read.schema(POSTING.format(docs.schema[key].dataType.simpleString())).parquet(_INDEXES[at])


class IndexStore:
    """A keyword index on storage that documents are added to and removed from.

    Each change is a segment: a folder of postings, or of removed documents, which counts for all segments before it. Spark's committer
    makes a segment whole or absent. Adding a document that is there replaces it.
    """

    rows, columns = "postings", POSTING

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint"):
        self.spark, self.path, self.key_type = spark, path, key_type
        self.segment = 0

    def add(self, docs: DataFrame, key: str, words: str) -> IndexStore:
        own = written(postings(docs, key, words), "index-segment")
        self.remove(own.select("doc").distinct())
        ordered_by_term(own).write.parquet(f"{self.path}/postings/segment={self.segment}")
        return self

    def remove(self, docs: DataFrame) -> IndexStore:
        """Remove the documents of a table with a column doc."""
        self.segment += 1
        docs.select("doc").distinct().write.parquet(f"{self.path}/gone/segment={self.segment}")
        return self

    def read(self) -> DataFrame:
        """What belongs to the documents that are in the store now."""
        columns = self.columns.format(self.key_type)
        if not self.segment:
            return self.spark.createDataFrame([], columns)
        own = self.spark.read.option("basePath", f"{self.path}/{self.rows}").schema(columns + ", segment int").parquet(f"{self.path}/{self.rows}")
        gone = self.spark.read.option("basePath", f"{self.path}/gone").schema(f"doc {self.key_type}, segment int").parquet(f"{self.path}/gone")
        gone = written(gone.groupBy("doc").agg(F.max("segment").alias("upto")), "index-gone")
        kept = own.join(small(gone, BROADCAST_ROWS), "doc", "left").where("upto IS NULL OR segment >= upto")
        return kept.drop("upto", "segment")


class VectorStore(IndexStore):
    """Vectors on storage, in segments as the keyword index; a removed document is a mark that is heeded on reading. A document without a usable vector may be added; no search finds it."""

    rows, columns = "vectors", "doc {}, vector array<double>"

    def add(self, docs: DataFrame, key: str, vector: str) -> VectorStore:
        own = written(docs.select(F.col(key).alias("doc"), F.col(vector).cast("array<double>").alias("vector")), "vector-segment")
        self.remove(own.select("doc").distinct())
        own.write.parquet(f"{self.path}/{self.rows}/segment={self.segment}")
        return self

    def search(self, queries: DataFrame, query_key: str, vector: str, k: int) -> DataFrame:
        """(query, doc, score, rank): the k nearest documents that are in the store now, by exact cosine."""
        return cosine_top_k(self.read(), queries.withColumnRenamed(vector, "vector"), "doc", query_key, "vector", k)


def corpus_size(index: DataFrame) -> tuple[int, float]:
    """Number of documents and their mean length."""
    n, mean = index.where("term = ''").agg(F.count("*"), F.avg("dl")).first()
    return n, mean or 0.0


def ranked(scores: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1; tasks hand on no more than k rows of a group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return scores.withColumn(name, rank).where(F.col(name) <= k)


@lru_cache(maxsize=200_000)
def _component(word: str) -> int:
    return hashlib.md5(word.encode()).digest()[0]


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, words) as batches (key, vector)."""
    for batch in batches:
        out, first = np.zeros((batch.num_rows, HASHED)), 0
        for some in by_words([batch], WORDS):
            lists = some.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = lists.flatten().dictionary_encode()
            component = np.array([_component(w) for w in found.dictionary.to_pylist()], np.int64)
            own = np.repeat(np.arange(some.num_rows), sizes) * HASHED
            if len(own):
                own += component[found.indices.to_numpy(zero_copy_only=False)]
            out[first : first + some.num_rows] = np.bincount(own, minlength=some.num_rows * HASHED).reshape(-1, HASHED)
            first += some.num_rows
        ends = pa.array(np.arange(batch.num_rows + 1) * HASHED, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))], names=["key", "vector"])


def hashed_vectors(docs: DataFrame, key: str, words: str) -> DataFrame:
    """(key, vector): how many words of a document fall on each of 256 components, which is the vector of texts where no model is at hand."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, words).mapInArrow(hashed, f"key {kind}, vector array<double>").withColumnRenamed("key", key)


def _packed(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Usable vectors of rows (id, v) by dimension: (dim, ids, vectors)."""
    lists = rows.column(1).cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ids = lists.flatten(), rows.column(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = sizes > 0
    if flat.null_count:
        good[row[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    values, starts = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    some = np.zeros(len(sizes), bool)
    some[row[values != 0]] = True
    good &= some
    for dim in np.unique(sizes[good]):
        own = np.flatnonzero(good & (sizes == dim))
        yield int(dim), ids[own].astype(np.int64), values[starts[own][:, None] + np.arange(dim)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) as rows (dim, ids, vectors)."""
    for batch in batches:
        for dim, ids, vectors in _packed(batch):
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])], names=["dim", "ids", "vectors"])


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.vectors, float).reshape(-1, row.dim)


def _best(queries, docs, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of some documents for some queries of the same dimension, by matrices of SCORES scores."""
    (ids, q), (names, d) = queries, docs
    if not len(names):
        return
    qq, dd = (q * q).sum(axis=1), (d * d).sum(axis=1)
    step = max(1, SCORES // len(names))
    for at in range(0, len(ids), step):
        part = slice(at, at + step)
        scores = np.round((q[part] @ d.T) / np.sqrt(np.outer(qq[part], dd)), 6)
        if len(names) > k:
            least = np.partition(np.where(np.isnan(scores), -np.inf, scores), -k, axis=1)[:, -k]
            row, doc = np.nonzero(~(scores < least[:, None]))
        else:
            row, doc = (x.reshape(-1) for x in np.indices(scores.shape))
        order = np.lexsort((names[doc], -scores[row, doc], row))
        row, doc = row[order], doc[order]
        first = np.searchsorted(row, np.arange(len(scores)))
        kept = np.arange(len(row)) - first[row] < k
        row, doc = row[kept], doc[kept]
        yield pa.RecordBatch.from_arrays([pa.array(ids[part][row]), pa.array(names[doc]), pa.array(scores[row, doc])], names=["query", "doc", "score"])


def cosine_top_k(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, vector: str, k: int, source: str = "", made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """(query, doc, score, rank): exact cosine, rounded to 6 places, of a stated set of queries with all vectors.

    Queries are packed in blocks. If all of them are small they are sent to every task; else each pack of vectors meets each block by a join on the block's
    number. A task scores by matrix products and hands on its own k best per query. Vectors of another length than the query,
    nulls and zero vectors are left out. With made, batches (key, source) of vectors are made into batches (key, vector) by the worker that scores them,
    so that a task has one Python worker, not two.
    """
    spark = vectors.sparkSession
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = written(asked, "cosine-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")

    def blocked(key, rows):
        found = list(_packed(rows.select(["id", "v"]).combine_chunks().to_batches()[0]))
        return pa.table({"dim": pa.array([dim for dim, _, _ in found], pa.int32()), "ids": pa.array([ids.tobytes() for _, ids, _ in found], pa.binary()), "vectors": pa.array([v.tobytes() for _, _, v in found], pa.binary()), "block": pa.array([key[0].as_py()] * len(found), pa.int32())})

    packs = asked.withColumn("block", block).groupBy("block").applyInArrow(blocked, "dim int, ids binary, vectors binary, block int")
    packs = written(packs, "cosine-blocks")
    own = source if made else vector
    held = vectors.where(F.col(own).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(own).alias("v"))
    made = made or iter
    size = packs.agg(F.sum(F.octet_length("vectors"))).first()[0] or 0
    out = "query long, doc long, score double"
    if size <= BROADCAST_BYTES:
        by_dim: dict[int, list] = {}
        for row in packs.collect():
            by_dim.setdefault(row.dim, []).append(_unpacked(row))
        sent = spark.sparkContext.broadcast(by_dim)

        def run(batches):
            for rows in made(batches):
                for dim, ids, vectors in _packed(rows):
                    for own in sent.value.get(dim, ()):
                        yield from _best(own, (ids, vectors), k)

        found = held.mapInArrow(run, out)
    else:

        def score(batches):
            for rows in batches:
                for i in range(rows.num_rows):
                    r = {name: rows.column(name)[i] for name in ("dim", "ids", "vectors", "q_ids", "q_vectors")}
                    pair = lambda ids, v, r=r: (np.frombuffer(r[ids].as_buffer(), np.int64), np.frombuffer(r[v].as_buffer(), float).reshape(-1, r["dim"].as_py()))
                    yield from _best(pair("q_ids", "q_vectors"), pair("ids", "vectors"), k)

        docs = held.mapInArrow(lambda batches: _pack(made(batches)), "dim int, ids binary, vectors binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = docs.join(packs.select("dim", "block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), ["dim", "block"])
        found = pairs.mapInArrow(score, out)
    return ranked(found, ["query"], [F.desc("score"), F.col("doc")], k)


def overlap_top_k(docs: DataFrame, queries: DataFrame, key: str, query_key: str, words: str, k: int) -> DataFrame:
    """(query, doc, score, rank): Jaccard similarity of the sets of words, rounded half up to 6 places, of all queries with all texts; only pairs that share a word
    are scored. Ties go to the smaller doc. Keys are whole numbers; rows without a key are left out, equal keys of queries are one query.

    Queries are sent to all tasks, OVERLAP_ROWS words at a time, as matrices of words and queries. A task counts common words by matrix products and
    hands on its own k best of each query, so pairs are never rows.
    """
    asked = queries.where(F.col(query_key).isNotNull()).select(F.col(query_key).cast("long").alias("query"), F.explode(words).alias("term")).distinct()
    asked = written(asked, "overlap-asked")
    held = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), words)
    passes = max(1, -(-asked.count() // OVERLAP_ROWS))
    every = None
    for i in range(passes):
        found = _overlaps(held, asked.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == i), k)
        every = found if every is None else every.unionByName(found)
    return ranked(every, ["query"], [F.desc("score"), F.col("doc")], k)


def _overlaps(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    by_query: dict[int, list[str]] = {}
    for query, term in asked.collect():  # about OVERLAP_ROWS
        by_query.setdefault(query, []).append(term)
    parts, ids, known = [], [], set()
    for query in sorted(by_query):
        if ids and (len(ids) + 1) * len(known.union(by_query[query])) > OVERLAP_CELLS:
            parts, ids, known = [*parts, ids], [], set()
        ids.append(query)
        known.update(by_query[query])
    parts.append(ids)
    sent = held.sparkSession.sparkContext.broadcast([[(query, by_query[query]) for query in ids] for ids in parts if ids])

    def run(batches):
        asked, best = [_asked_matrix(part) for part in sent.value], _Best(k)
        for batch in by_words(batches, WORDS):
            lists, names = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = lists.flatten().dictionary_encode()
            several = max(1, len(found.dictionary))
            pairs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * several + found.indices.to_numpy(zero_copy_only=False))
            row, term = pairs // several, pairs % several
            n_words = np.bincount(row, minlength=len(sizes))
            for ids, terms, at, of in asked:
                place = pc.fill_null(pc.index_in(found.dictionary.cast(pa.string()), value_set=terms), -1).to_numpy(zero_copy_only=False)[term]
                r, c = row[place >= 0], place[place >= 0]
                matrix = np.zeros((len(terms), len(ids)), np.float32)
                matrix[at, of] = 1
                n_asked = np.bincount(of, minlength=len(ids))
                step = max(1, SCORES // max(len(terms), len(ids)))
                for first in range(0, len(sizes), step):
                    own, n = slice(*np.searchsorted(r, [first, first + step])), min(step, len(sizes) - first)
                    has = np.zeros((n, len(terms)), np.float32)
                    has[r[own] - first, c[own]] = 1
                    common = (has @ matrix).astype(np.int64)
                    union = n_words[first : first + n, None] + n_asked - common
                    best.add(ids, names[first : first + n], np.where(common > 0, (2_000_000 * common + union) // np.maximum(1, 2 * union), -1).T)
        yield best.rows()

    return held.mapInArrow(run, "query long, doc long, score double")


def _asked_matrix(part: list[tuple[int, list[str]]]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Queries, their words, and which words (at) are in which query (of)."""
    place = {t: i for i, t in enumerate(sorted({t for _, terms in part for t in terms}))}
    at = np.array([place[t] for _, terms in part for t in terms], np.int64)
    return np.array([query for query, _ in part], np.int64), pa.array(list(place), pa.string()), at, np.repeat(np.arange(len(part)), [len(terms) for _, terms in part])


class _Best:
    """The k best documents of each query of what was added; scores are whole millionths, those below 0 do not count."""

    def __init__(self, k: int):
        self.k, self.parts, self.held = k, [], 0

    def add(self, ids: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= 0
        if scores.shape[1] > self.k:
            keep &= scores >= np.partition(scores, -self.k, axis=1)[:, -self.k, None]
        query, doc = np.nonzero(keep)
        self.parts.append((ids[query], names[doc], scores[query, doc]))
        self.held += len(query)
        if self.held > SCORES:
            self.parts = [self._first()]
            self.held = len(self.parts[0][0])

    def _first(self) -> tuple[np.ndarray, ...]:
        query, doc, score = (np.concatenate([p[i] for p in self.parts] or [np.zeros(0, np.int64)]) for i in range(3))
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        return query[kept], doc[kept], score[kept]

    def rows(self) -> pa.RecordBatch:
        query, doc, score = self._first()
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(doc, pa.int64()), pa.array(score / 1e6, pa.float64())], names=["query", "doc", "score"])


def sharing_windows(docs: DataFrame, items: DataFrame, key: str, item_key: str, words: str, width: int = 10) -> DataFrame:
    """(query, doc): documents in which any run of width words of an item stands. Items with fewer words have none.

    Where the items' runs are few, a task hashes a text's runs by the numbers of their words and hands on only runs whose hash an item has; then the words themselves are compared.
    """
    last = F.size(words) - width
    runs = lambda: F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, width), " "))).otherwise(F.array().cast("array<string>"))
    asked = written(items.select(F.col(item_key).alias("query"), F.explode(F.array_distinct(runs())).alias("run")), "windows-asked")
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        held = _runs_with_hash(docs.select(F.col(key).alias("doc"), words), [r[0] for r in items.where(last >= 0).select(words).collect()], width)
    else:
        held = docs.select(F.col(key).alias("doc"), F.explode(F.array_distinct(runs())).alias("run"))
    return held.join(small(asked, BROADCAST_ROWS), "run").select("query", "doc").distinct()


def _run_hashes(numbers: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width numbers."""
    n = max(0, len(numbers) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + numbers[i : i + n]
    return out


def _runs_with_hash(held: DataFrame, lists: list[list[str]], width: int) -> DataFrame:
    """(doc, run): runs of the texts of held (doc, words) whose hash a run of lists has; words that stand in no list have the number 0."""
    place = {w: i for i, w in enumerate(sorted({w for ws in lists for w in ws if w is not None}), 1)}
    own = [_run_hashes(np.array([place.get(w, 0) for w in ws], np.uint64), width) for ws in lists]
    sent = held.sparkSession.sparkContext.broadcast((list(place), np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]))))

    def run(batches):
        known, hashes = pa.array(sent.value[0], pa.string()), sent.value[1]
        for batch in by_words(batches, WORDS):
            lists = batch.column(1).cast(pa.list_(pa.string()))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            numbers = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            found = _run_hashes(numbers.astype(np.uint64), width)
            ends, row = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(np.isin(found, hashes) & (np.arange(len(found)) + width <= ends[row[: len(found)]]))
            texts = [" ".join(w for w in flat.slice(i, width).to_pylist() if w is not None) for i in at]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at], pa.int64())), pa.array(texts, pa.string())], names=["doc", "run"])

    return held.mapInArrow(run, f"doc {held.schema['doc'].dataType.simpleString()}, run string")


def fuse(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = 0.5, sparse_weight: float = 0.5, damp: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists (query, doc, rank): score, both ranks, and rank.

    Scores are rounded to 6 places before sorting, so ties are real; they go to the better dense, then sparse rank, then id.
    """
    d = dense.select("query", "doc", F.col("rank").alias("dense_rank"))
    s = sparse.select("query", "doc", F.col("rank").alias("sparse_rank"))
    both = d.join(s, ["query", "doc"], "full_outer")
    share = lambda w, r: F.coalesce(F.lit(w / (dense_weight + sparse_weight)) / (damp + F.col(r)), F.lit(0.0))
    both = both.withColumn("score", F.round(share(dense_weight, "dense_rank") + share(sparse_weight, "sparse_rank"), 6))
    far = lambda r: F.coalesce(r, F.lit(9999))
    return ranked(both, ["query"], [F.desc("score"), far(F.col("dense_rank")), far(F.col("sparse_rank")), F.col("doc")], k)


def judged(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per query: recall at each k, reciprocal rank and precision at the last k. results: query, doc, rank; relevant: query, doc.

    Queries without relevant documents are left out.
    """
    gold = relevant.select("query", "doc").distinct()
    hits = gold.join(results.select("query", "doc", "rank"), ["query", "doc"], "left")
    at = lambda k: F.count_if(F.col("rank") <= k)
    recalls = [F.round(at(k) / F.count("*"), 6).alias(f"recall_{k}") for k in ks]
    return hits.groupBy("query").agg(*recalls, F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(at(ks[-1]) / F.lit(ks[-1]), 6).alias(f"precision_{ks[-1]}"))
