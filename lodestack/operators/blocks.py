"""A keyword index in shards with blocks of documents, and BM25 over it that skips the blocks which can't hold one of the best.

A shard is a stretch of documents, put in the order of their most frequent word and length, so that neighbours are alike. A row of the index is
a word of a shard: the places of its documents, ascending, and how often it stands there; rows are in the order of words, and the row of
the empty word has the documents' keys and lengths. Where a shard is searched, the largest part that a word can have in a score is taken
for each block of places. These, summed over a query's words, bound every score of the block. The blocks with the largest
bounds are scored first; then those whose bound reaches the k-th score so far; the others are skipped. Nothing is left out of the result by that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.retrieval import BROADCAST_ROWS, by_words, ranked
from lodestack.shared import new_path, sign_of_files, small, written

#: Documents of a shard and places of a block, at most; and words from which a shard gets no more documents.
SHARD, BLOCK = 8192, 16
SHARD_WORDS = 1_500_000
#: Blocks of a query that are scored before any is skipped.
FIRST_BLOCKS = 4
#: Words of queries (a row for each query and word) that are scored in one pass over the index.
ASKED_ROWS = 200_000
SCHEMA = "shard long, term string, n int, docs array<int>, tf array<int>, keys array<long>, dl array<int>"
_OUT = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("docs", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())), ("dl", pa.list_(pa.int32()))])


def _shard(number: int, keys: pa.Array, lists: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of a shard. A null list of words is empty."""
    lists = lists.cast(pa.list_(pa.string()))
    dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = lists.flatten().dictionary_encode()
    words = found.dictionary
    pairs, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * max(1, len(words)) + found.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, term = pairs // max(1, len(words)), pairs % max(1, len(words))
    by_name = pc.sort_indices(words).to_numpy()
    place_of_term = np.empty(len(words), np.int64)
    place_of_term[by_name] = np.arange(len(words))
    term = place_of_term[term]
    top = np.full(len(dl), -1)
    order = np.lexsort((-term, tf))  # the last one of a row is its most frequent word, ties to the first by name
    top[row[order]] = term[order]
    place = np.empty(len(dl), np.int64)
    in_order = np.lexsort((dl, top))
    place[in_order] = np.arange(len(dl))
    at = np.lexsort((place[row], term))
    ends = np.concatenate([[0], np.flatnonzero(np.diff(term[at])) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
    n = len(ends) - 1
    docs, counts = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[at], pa.int32())) for x in (place[row], tf))
    yield pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([""]), pa.array([len(dl)], pa.int32()), pa.nulls(1, _OUT.field("docs").type), pa.nulls(1, _OUT.field("tf").type), pa.array([keys.to_numpy(zero_copy_only=False)[in_order]], _OUT.field("keys").type), pa.array([dl[in_order]], _OUT.field("dl").type)],
        schema=_OUT,
    )
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), words.take(pa.array(by_name)), pa.array(np.diff(ends), pa.int32()), docs, counts, pa.nulls(n, _OUT.field("keys").type), pa.nulls(n, _OUT.field("dl").type)], schema=_OUT)


def block_index(docs: DataFrame, key: str, words: str) -> DataFrame:
    """docs (key, a whole number; words, an array) as shards, in a table of the shared folder. Made where the documents lie, so nothing is shuffled. Keys must not be null."""
    return written(_sharded(docs, key, words), "blocks")


def _sharded(docs: DataFrame, key: str, words: str) -> DataFrame:

    def run(batches):
        number, keys, lists, n, held = TaskContext.get().partitionId() << 32, [], [], 0, 0
        for batch in by_words(batches, -(-SHARD_WORDS // 8)):
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, SHARD - n)
                keys.append(some.column(0))
                lists.append(some.column(1))
                n, at = n + some.num_rows, at + some.num_rows
                held += pc.sum(pc.list_value_length(some.column(1))).as_py() or 0
                if n == SHARD or held >= SHARD_WORDS:
                    yield from _shard(number, pa.concat_arrays(keys), pa.concat_arrays(lists))
                    number, keys, lists, n, held = number + 1, [], [], 0, 0
        if n:
            yield from _shard(number, pa.concat_arrays(keys), pa.concat_arrays(lists))

    return docs.select(F.col(key).cast("long"), words).mapInArrow(run, SCHEMA)


#: Indexes of this session, by session, name and the sign of their files.
_INDEXES: dict[tuple, str] = {}


def stored_index(source: DataFrame, docs: DataFrame, key: str, words: str, name: str) -> DataFrame:
    """The block index of docs as a table, which is written once as long as the files of source, from which docs is made, are the same."""
    spark, sign = source.sparkSession, sign_of_files(source)
    at = (spark.sparkContext.applicationId, name, sign)
    if sign is None or at not in _INDEXES:
        path = new_path(spark, f"blocks-{name}")
        _sharded(docs, key, words).write.parquet(path)
        _INDEXES[at] = path
    return spark.read.schema(SCHEMA).parquet(_INDEXES[at])


class _Shard:
    """A shard's wanted words, ready to be searched."""

    def __init__(self, table: pa.Table, mean: float, k1: float, b: float):
        names = table["term"].to_pylist()
        docs, tf = table["docs"].combine_chunks(), table["tf"].combine_chunks()
        at = names.index("")
        self.keys = table["keys"][at].values.to_numpy()
        norm = k1 * (1 - b + b * table["dl"][at].values.to_numpy() / mean)
        self.blocks = -(-len(self.keys) // BLOCK)
        self.rows, self.postings = {}, []
        self.most = np.zeros((len(names) - 1, self.blocks), np.float32)
        for i, name in enumerate(names):
            if i == at:
                continue
            d, n = docs[i].values.to_numpy(), tf[i].values.to_numpy()
            part, block = n / (n + norm[d]), d // BLOCK
            self.rows[name] = len(self.postings)
            self.postings.append((d, block, part))
            begins = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
            # Half as long, and rounded up, so that it stays a bound.
            self.most[len(self.postings) - 1, block[begins]] = np.nextafter(np.maximum.reduceat(part, begins).astype(np.float32), np.float32(np.inf))

    def _scores(self, known: list[tuple[int, float]], active: np.ndarray) -> np.ndarray:
        scores = np.zeros(len(self.keys))
        for i, weight in known:
            d, block, part = self.postings[i]
            on = active[block]
            scores[d[on]] += weight * part[on]
        return scores

    def best(self, weights: dict[str, float], k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Keys and scores of the k best for a query; blocks with any of its words, and how many of them were scored."""
        known = [(self.rows[t], w) for t, w in weights.items() if t in self.rows]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0), 0, 0
        bounds = np.array([w for _, w in known]) @ self.most[[i for i, _ in known]].astype(float)
        active = np.zeros(self.blocks, bool)
        active[np.argsort(-bounds, kind="stable")[: max(FIRST_BLOCKS, -(-k // BLOCK))]] = True
        active &= bounds > 0
        scores = self._scores(known, active)
        found = scores[scores > 0]
        least = np.partition(found, -k)[-k] - 1e-6 if len(found) >= k else 0.0
        later = (bounds >= least) & (bounds > 0) & ~active
        if later.any():
            scores += self._scores(known, later)
        at = np.flatnonzero(scores > 0)
        rounded = np.round(scores[at], 6)
        top = np.lexsort((self.keys[at], -rounded))[:k]
        return self.keys[at[top]], rounded[top], int((bounds > 0).sum()), int((active | later).sum())


def _weights(index: DataFrame, asked: DataFrame, k1: float) -> tuple[DataFrame, float]:
    """(query, term, weight) with weight = qtf * idf * (k1 + 1), and the mean length of documents."""
    held = index.where("term = ''").select("n", F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"))
    n, total = held.agg(F.sum("n"), F.sum("words")).first()
    wanted = asked.select("term").distinct()
    df = index.select("term", "n").join(small(wanted, BROADCAST_ROWS), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return asked.join(df, "term").select("query", "term", (F.col("qtf") * idf * (k1 + 1)).alias("weight")), (total or 0) / max(1, n or 0) or 1.0


def bm25_search(index: DataFrame, queries: DataFrame, query_key: str, words: str, k: int, k1: float = 1.5, b: float = 0.75, counted: bool = False) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query by BM25; ties go to the smaller doc. With counted: (shard, query, blocks, scored) instead.

    idf is ln((N - df + 0.5) / (df + 0.5) + 1); repeated query words count as often. Queries and documents are whole numbers. Queries without a known word have
    no rows. Of the index only rows of words that are asked for are shuffled, to their shard's task. Queries are sent to all tasks, ASKED_ROWS words at a time.
    """
    asked = queries.select(F.col(query_key).cast("long").alias("query"), F.explode(words).alias("term")).where("term <> ''").groupBy("query", "term").agg(F.count("*").alias("qtf"))
    asked = written(asked, "blocks-asked")
    weights, mean = _weights(index, asked, k1)
    weights = written(weights, "blocks-weights")
    passes = max(1, -(-weights.count() // ASKED_ROWS))
    found = [_pass(index, weights.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == i), k, mean, k1, b, counted) for i in range(passes)]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every if counted else ranked(every, ["query"], [F.desc("score"), F.col("doc")], k)


def _pass(index: DataFrame, weights: DataFrame, k: int, mean: float, k1: float, b: float, counted: bool) -> DataFrame:
    by_query: dict[int, dict[str, float]] = {}
    for query, term, weight in weights.orderBy("query", "term").collect():  # about ASKED_ROWS
        by_query.setdefault(query, {})[term] = weight
    sent = index.sparkSession.sparkContext.broadcast(by_query)
    wanted = small(written(weights.select("term").distinct(), "blocks-terms"), BROADCAST_ROWS)
    own = index.where("term <> ''").join(wanted, "term", "left_semi").unionByName(index.where("term = ''")).select("shard", "term", "docs", "tf", "keys", "dl")

    def search(key, table):
        shard, out = _Shard(table, mean, k1, b), [[], [], []]
        counts = []
        for query, terms in sent.value.items():
            keys, scores, blocks, scored = shard.best(terms, k)
            out[0].append(np.full(len(keys), query))
            out[1].append(keys)
            out[2].append(scores)
            counts.append((table["shard"][0].as_py(), query, blocks, scored))
        if counted:
            return pa.table({name: pa.array([c[i] for c in counts], pa.int64()) for i, name in enumerate(("shard", "query", "blocks", "scored"))})
        joined = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query": pa.array(joined[0], pa.int64()), "doc": pa.array(joined[1], pa.int64()), "score": pa.array(joined[2], pa.float64())})

    return own.groupBy("shard").applyInArrow(search, "shard long, query long, blocks long, scored long" if counted else "query long, doc long, score double")


#: Bytes of bits of queries' documents that are worked on at once.
HOLD_BYTES = 4_000_000


def holders(index: DataFrame, queries: DataFrame, query_key: str, words: str) -> DataFrame:
    """(query, found, n): how many documents have all words of each query, and whether the one with the query's own key does. Keys of queries are unique whole numbers.

    Documents that have a word are bits in their shard, a query's are those of all its words; what is handed on are a shard's numbers, so that pairs of query and
    document are never rows. Queries are sent to all tasks, ASKED_ROWS words at a time.
    """
    asked = queries.select(F.col(query_key).cast("long").alias("query"), F.array_sort(F.array_distinct(words)).alias("terms")).where(F.size("terms") > 0)
    asked = written(asked, "holders-asked")
    passes = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // ASKED_ROWS))
    parts = [_held(index, asked.where(F.pmod(F.xxhash64("terms"), F.lit(passes)) == i)) for i in range(passes)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    found = every.groupBy("query").agg(F.max("found").alias("found"), F.sum("n").alias("n"))
    return asked.select("query").join(found, "query", "left").select("query", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _held(index: DataFrame, asked: DataFrame) -> DataFrame:
    by_terms: dict[tuple[str, ...], list[int]] = {}
    for query, terms in asked.collect():  # about ASKED_ROWS words
        by_terms.setdefault(tuple(terms), []).append(query)
    sets = sorted(by_terms, key=len)  # those of as many words are worked on together
    names = sorted({t for terms in sets for t in terms})
    place = {t: i for i, t in enumerate(names)}
    numbers = [np.array([place[t] for t in terms], np.int32) for terms in sets]
    ids = np.array([q for terms in sets for q in by_terms[terms]], np.int64)
    of = np.repeat(np.arange(len(sets)), [len(by_terms[terms]) for terms in sets])
    sent = index.sparkSession.sparkContext.broadcast((pa.array(names, pa.string()), numbers, ids, of))
    wanted = small(written(asked.select(F.explode("terms").alias("term")).distinct(), "holders-terms"), BROADCAST_ROWS)
    own = index.where("term <> ''").join(wanted, "term", "left_semi").unionByName(index.where("term = ''")).select("shard", "term", "docs", "keys")

    def search(table):
        names, numbers, ids, of = sent.value
        head = table.filter(pc.equal(table["term"], ""))
        body = table.filter(pc.not_equal(table["term"], ""))
        keys = np.concatenate([k.values.to_numpy() for k in head["keys"]])
        lists = body["docs"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        doc = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        width = -(-len(keys) // 8)
        bits = np.zeros((len(lists) + 1, width), np.uint8)  # the last row is for words that no document has
        np.bitwise_or.at(bits, (row, doc >> 3), (1 << (doc & 7)).astype(np.uint8))
        at = pc.fill_null(pc.index_in(names, value_set=body["term"].combine_chunks()), len(lists)).to_numpy(zero_copy_only=False)
        order = np.argsort(keys, kind="stable")
        near = np.minimum(np.searchsorted(keys[order], ids), len(keys) - 1)
        here = keys[order][near] == ids
        n, found = np.zeros(len(numbers), np.int64), np.zeros(len(ids), bool)
        step, first = max(1, HOLD_BYTES // width), 0
        while first < len(numbers):
            several = len(numbers[first])
            last = first
            while last < min(len(numbers), first + step) and len(numbers[last]) == several:
                last += 1
            which = at[np.stack(numbers[first:last])]
            both = bits[which[:, 0]]
            for k in range(1, several):
                both &= bits[which[:, k]]
            n[first:last] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
            mine = np.flatnonzero((of >= first) & (of < last) & here)
            spot = order[near[mine]]
            found[mine] = (both[of[mine] - first, spot >> 3] >> (spot & 7)) & 1 > 0
            first = last
        some = np.flatnonzero(n[of] > 0)
        return pa.table([pa.array(ids[some], pa.int64()), pa.array(found[some]), pa.array(n[of][some], pa.int64())], names=["query", "found", "n"])

    return own.groupBy("shard").applyInArrow(search, "query long, found boolean, n long")


def overfetched(search: Callable[[DataFrame, int], DataFrame], queries: DataFrame, query_key: str, allowed: DataFrame, k: int, more: int = 4) -> DataFrame:
    """(query, doc, score, rank, place): the k best of the documents in allowed (doc), with their rank among all. search(queries, k) gives (query, doc, score, rank).

    Over-fetches: more * k first, and for queries that have fewer than k allowed among them, though more were to be had, more times as many again, until none is left.
    """
    keep = allowed.select("doc").distinct()
    left, fetch, done = queries, k * more, []
    while True:
        found = written(search(left, fetch), "overfetch")
        fit = written(ranked(found.join(keep, "doc", "left_semi"), ["query"], [F.col("rank")], k, "place"), "overfetch-allowed")
        full = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") == fetch)
        short = full.join(fit.groupBy("query").agg(F.count("*").alias("fit")), "query", "left").where(F.coalesce("fit", F.lit(0)) < k).select("query")
        short = written(short, "overfetch-short")
        done.append(fit.join(short, "query", "left_anti"))
        if short.isEmpty():
            break
        left, fetch = left.join(short, F.col(query_key).cast("long") == short["query"], "left_semi"), fetch * more
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select("query", "doc", "score", "rank", "place")


def bm25_search_allowed(index: DataFrame, queries: DataFrame, query_key: str, words: str, allowed: DataFrame, k: int, more: int = 4) -> DataFrame:
    """overfetched() by BM25."""
    return overfetched(lambda asked, n: bm25_search(index, asked, query_key, words, n), queries, query_key, allowed, k, more)
