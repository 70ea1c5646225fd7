"""Sets of words that share at least a given part of their words, counted exactly, with each word shuffled once as a string.

Sets lie in shards of at most SHARD. A word goes once for each shard with the places of its sets, all shards' words are numbered in parts by the hash of the word, the commonest
of a part first, and the numbers go back to the shards; words of one set only are left out but count as different. Of two sets that are alike, those words of each with the
largest numbers, as many as could be missing and one more, have one in common: sets meet on these, with a sketch in which a bit is the parity of the
words that fall on it. What meets and is not parted by sizes, places or sketches is compared word by word. For this, a set goes once to each
bucket where it is wanted; buckets go by MinHash, so that sets that are alike are mostly in the same one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.retrieval import by_words
from lodestack.shared import written

#: Sets and words of a shard, at most; places are 16-bit integers.
SHARD, SHARD_WORDS = 8192, 1_500_000
#: Words of a part of all words, of a part of those that sets meet on (about a quarter of the words do), and of a bucket before sets of others join it.
PART_WORDS, MEET_WORDS, BUCKET_WORDS = 2_000_000, 4_000_000, 1_000_000
#: Whole numbers of 64 bits of a sketch, a power of 2; pairs that are looked at together, and sets that are unpacked together.
SKETCH, PAIRS, ROWS = 8, 400_000, 4096

_SHARDED = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("terms", pa.list_(pa.string())), ("n", pa.binary()), ("places", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary())])
_LEADS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("facts", pa.binary()), ("sketches", pa.binary()), ("number", pa.binary()), ("at", pa.binary()), ("rest", pa.binary())])
_MET = pa.schema([("bucket", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("guests", pa.list_(pa.int64()))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of packed ones, and how many each row has."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate([*parts, np.zeros(0, kind)]), np.array([len(p) for p in parts], np.int64)


def _upto(n: np.ndarray) -> np.ndarray:
    """Where groups of so many begin, and the last one ends."""
    return np.append(0, np.cumsum(n)).astype(np.int64)


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of groups of so many."""
    return np.arange(n.sum()) - np.repeat(_upto(n)[:-1], n)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of whole numbers."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(numbers: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Ascending whole numbers of groups of n as their differences, in bytes of seven bits, the last one of each without the eighth."""
    x = np.diff(numbers, prepend=0)
    first = _upto(n)[:-1][n > 0]
    x[first] = numbers[first]
    size = 1 + sum((x >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[(ends - size)[some] + k] = (x[some] >> 7 * k) & 127 | np.where(size[some] > k + 1, 128, 0)
    cuts = np.append(0, ends)[_upto(n)]
    return [out[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]


def unpacked(rows: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, n) of packed groups."""
    data, sizes = _joined(rows, np.uint8)
    last = np.flatnonzero(data < 128)
    start = np.append(0, last[:-1] + 1)[: len(last)]
    x = np.zeros(len(last), np.int64)
    for k in range(int((last - start).max(initial=-1)) + 1):
        some = last - start >= k
        x[some] |= (data[start[some] + k] & 127).astype(np.int64) << 7 * k
    n = np.diff(np.searchsorted(last, _upto(sizes)))
    total = np.append(0, np.cumsum(x))
    return total[1:] - np.repeat(total[_upto(n)[:-1]], n), n


def _shard(number: int, keys: np.ndarray, lists: pa.Array, parts: int) -> pa.Table:
    lists = lists.cast(pa.list_(pa.string()))
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = lists.flatten().dictionary_encode()
    pairs = np.unique(found.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n))
    term, place = pairs // len(n), (pairs % len(n)).astype(np.uint16)
    part = np.array([zlib.crc32(w.encode()) % parts for w in found.dictionary.to_pylist()], np.int64)[term]
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [_table([(number % parts, number, None, None, None, keys.tobytes(), np.bincount(place, minlength=len(n)).astype(np.int32).tobytes())], _SHARDED)]
    for p in np.flatnonzero(np.diff(ends)):
        own = order[ends[p] : ends[p + 1]]
        some, count = np.unique(term[own], return_counts=True)
        fields = [[int(p)], [number], pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), found.dictionary.take(pa.array(some))), [count.astype(np.int32).tobytes()], [place[own].tobytes()], [None], [None]]
        rows.append(pa.table([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(fields, _SHARDED)], schema=_SHARDED))
    return pa.concat_tables(rows)


def _sharded(sets: DataFrame, parts: int) -> DataFrame:
    """A row for each shard and part: words, how many sets have each, and their places; and a row for each shard with its keys and sizes."""

    def run(batches):
        number, keys, lists, n, held = TaskContext.get().partitionId() << 32, [], [], 0, 0
        for batch in by_words(batches, SHARD_WORDS // 8):
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, SHARD - n)
                keys.append(some.column(0).to_numpy(zero_copy_only=False))
                lists.append(some.column(1))
                n, at, held = n + some.num_rows, at + some.num_rows, held + (pc.sum(pc.list_value_length(some.column(1))).as_py() or 0)
                if n == SHARD or held >= SHARD_WORDS:
                    yield from _shard(number, np.concatenate(keys), pa.concat_arrays(lists), parts).to_batches()
                    number, keys, lists, n, held = number + 1, [], [], 0, 0
        if n:
            yield from _shard(number, np.concatenate(keys), pa.concat_arrays(lists), parts).to_batches()

    return sets.mapInArrow(run, "part int, shard long, terms array<string>, n binary, places binary, keys binary, sizes binary")


def _numbered(sharded: DataFrame) -> DataFrame:
    """Words of more than one set as their numbers in the part, the commonest first."""

    def run(key, table):
        heads = table.filter(pc.is_valid(table["keys"]))
        body = table.filter(pc.is_null(table["keys"]))
        words = body["terms"].combine_chunks() if body.num_rows else pa.array([], pa.list_(pa.string()))
        words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
        found = words.flatten().dictionary_encode()
        code = found.indices.to_numpy(zero_copy_only=False)
        n, terms = _joined(body["n"], np.int32)
        df = np.bincount(code, n, minlength=len(found.dictionary)).astype(np.int64)
        number = np.empty(len(df), np.int32)
        number[np.argsort(-df, kind="stable")] = np.arange(len(df))
        upto, out = _upto(terms), []
        for i, (shard, places) in enumerate(zip(body["shard"].to_pylist(), body["places"])):
            own = slice(upto[i], upto[i + 1])
            keep = df[code[own]] > 1
            place = np.frombuffer(places.as_buffer(), np.uint16)[np.repeat(keep, n[own])]
            out.append((shard, key[0].as_py(), number[code[own]][keep].tobytes(), n[own][keep].tobytes(), place.tobytes(), None, None))
        out += [(r["shard"], None, None, None, None, r["keys"], r["sizes"]) for r in heads.select(["shard", "keys", "sizes"]).to_pylist()]
        return _table(out, pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("numbers", pa.binary()), ("n", pa.binary()), ("places", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary())]))

    return sharded.groupBy("part").applyInArrow(run, "shard long, part int, numbers binary, n binary, places binary, keys binary, sizes binary")


def _numbers(numbered: DataFrame, parts: int, buckets: int) -> DataFrame:
    """(id, n, bucket, words): sets with their size, bucket and the numbers of words of more than one set, packed; those without any such word are left out."""

    def run(table):
        head = table.filter(pc.is_valid(table["keys"]))
        body = table.filter(pc.is_null(table["keys"]))
        keys, sizes = _joined(head["keys"], np.int64)[0], _joined(head["sizes"], np.int32)[0]
        number, terms = _joined(body["numbers"], np.int32)
        number = number.astype(np.int64) * parts + np.repeat(body["part"].to_numpy().astype(np.int64), terms)
        place = _joined(body["places"], np.uint16)[0]
        number = np.repeat(number, _joined(body["n"], np.int32)[0])
        order = np.lexsort((number, place))
        number, n = number[order], np.bincount(place, minlength=len(keys))
        some = np.flatnonzero(n)
        home = np.minimum.reduceat(_mixed(number), _upto(n)[some]) if len(some) else np.zeros(0, np.uint64)
        words = packed(number, n)
        arrays = [pa.array(keys[some]), pa.array(sizes[some]), pa.array((_mixed(home) % np.uint64(buckets)).astype(np.int32)), pa.array([words[i] for i in some], pa.binary())]
        return pa.table(arrays, names=["id", "n", "bucket", "words"])

    return numbered.groupBy("shard").applyInArrow(run, "id long, n int, bucket int, words binary")


def _leads(sets: DataFrame, parts: int, percent: int) -> DataFrame:
    """The words that sets meet on, by part; with each part the sets that have one there, and their sketches."""

    def run(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            words, n = unpacked(batch.column(3))
            size = batch.column(1).to_numpy().astype(np.int64)
            alone = size - n
            of = np.repeat(np.arange(len(n)), n)
            bit = _mixed(words) % np.uint64(64 * SKETCH)
            sketch = np.zeros(len(n) * SKETCH, np.uint64)
            np.bitwise_xor.at(sketch, of * SKETCH + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            sketch = sketch.reshape(-1, SKETCH)
            facts = np.column_stack([size, alone, batch.column(2).to_numpy()]).astype(np.int32)
            rest = _within(n) + 1  # words from this one on to the commonest
            lead = rest > (-(-percent * size // 100) - 1)[of]
            words, of, rest = words[lead], of[lead], rest[lead]
            order = np.argsort(words % parts, kind="stable")
            words, of, rest = words[order], of[order], rest[order]
            ends, keys = np.searchsorted(words % parts, np.arange(parts + 1)), batch.column(0).to_numpy()
            rows = []
            for p in np.flatnonzero(np.diff(ends)):
                own = slice(ends[p], ends[p + 1])
                some, at = np.unique(of[own], return_inverse=True)
                rows.append((int(p), keys[some].tobytes(), facts[some].tobytes(), sketch[some].tobytes(), (words[own] // parts).astype(np.int32).tobytes(), at.astype(np.int32).tobytes(), rest[own].astype(np.int32).tobytes()))
            yield from _table(rows, _LEADS).to_batches()

    return sets.select("id", "n", "bucket", "words").mapInArrow(run, "part int, keys binary, facts binary, sketches binary, number binary, at binary, rest binary")


def _met(leads: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be alike, by the bucket of their second set; and the first sets that are of another bucket."""

    def run(table):
        keys, several = _joined(table["keys"], np.int64)
        size, alone, bucket = _joined(table["facts"], np.int32)[0].reshape(-1, 3).astype(np.int64).T
        sketch = np.ascontiguousarray(_joined(table["sketches"], np.uint64)[0].reshape(-1, SKETCH).T)
        number, n = _joined(table["number"], np.int32)
        of = _joined(table["at"], np.int32)[0] + np.repeat(_upto(several)[:-1], n)
        rest = _joined(table["rest"], np.int32)[0].astype(np.int64)
        order = np.lexsort((size[of], number))
        number, of, rest = number[order].astype(np.int64), of[order], rest[order]
        own = size[of]
        most = int(size.max(initial=0)) * 100 // percent + 1
        upto = np.searchsorted(number * (most + 1) + own, number * (most + 1) + 100 * own // percent, side="right")  # sets of like size of the same word are neighbours
        partners = upto - np.arange(len(of)) - 1
        ends, found, held, first = np.cumsum(partners), [], 0, 0
        while first < len(of):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
            for begin in range(0, max(1, int(partners[first:last].max())), PAIRS):  # a set may have more partners than are looked at together
                some = np.clip(partners[first:last] - begin, 0, PAIRS)
                i = np.repeat(np.arange(first, last), some)
                j = i + 1 + begin + _within(some)
                both = own[i] + own[j]
                keep = (100 + percent) * np.minimum(rest[i], rest[j]) >= percent * both
                a, b, both = of[i[keep]], of[j[keep]], both[keep]
                apart = alone[a] + alone[b]
                for w in range(SKETCH):
                    apart += np.bitwise_count(sketch[w][a] ^ sketch[w][b])
                keep = (100 + percent) * apart <= (100 - percent) * both
                a, b = a[keep], b[keep]
                swap = keys[a] > keys[b]
                found.append(np.unique(np.where(swap, b, a) * len(keys) + np.where(swap, a, b)))
                held += len(found[-1])
                if held > 4 * PAIRS and len(found) > 1:
                    found = [np.unique(np.concatenate(found))]
                    held = 0
            first = last
        pairs = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
        x, y = pairs // max(1, len(keys)), pairs % max(1, len(keys))
        order = np.argsort(bucket[y], kind="stable")
        x, y = x[order], y[order]
        rows = []
        for k in np.unique(bucket[y]):
            some = slice(*np.searchsorted(bucket[y], [k, k + 1]))
            guests = np.unique(x[some][bucket[x[some]] != k])
            rows.append((int(k), keys[x[some]].tobytes(), keys[y[some]].tobytes(), keys[guests]))
        return _table(rows, _MET)

    return leads.groupBy("part").applyInArrow(run, "bucket int, x binary, y binary, guests array<long>")


def _compared(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, others): how many rows the sets stand for that are like each."""

    def run(pairs, own):
        names = own["id"].to_numpy()
        order = np.argsort(names, kind="stable")
        names, copies, size = names[order], own["copies"].to_numpy()[order], own["n"].to_numpy().astype(np.int64)[order]
        some = [unpacked(own["words"].slice(i, ROWS)) for i in range(0, own.num_rows, ROWS)] or [unpacked(own["words"])]
        most = max(w.max(initial=-1) for w, _ in some)
        words, n = np.concatenate([w.astype(np.int32 if most < 1 << 31 else np.int64) for w, _ in some]), np.concatenate([n for _, n in some])
        begin, n = _upto(n)[:-1][order], n[order]
        x, y = (np.searchsorted(names, _joined(pairs[c], np.int64)[0]) for c in "xy")
        both = np.unique(x * len(names) + y)
        x, y = both // max(1, len(names)), both % max(1, len(names))
        marked, others = np.zeros(int(most) + 1, bool), np.zeros(len(names), np.int64)  # numbers are little more than there are words
        cuts = np.append(np.flatnonzero(np.diff(x, prepend=-1)), len(x))
        for first, last in zip(cuts[:-1], cuts[1:]):
            a = x[first]
            mine = words[begin[a] : begin[a] + n[a]]
            marked[mine] = True
            step = max(1, int(4 * PAIRS // max(1, n[y[first:last]].max())))
            for i in range(first, last, step):
                b = y[i : min(last, i + step)]
                common = np.add.reduceat(marked[words[np.repeat(begin[b], n[b]) + _within(n[b])]].astype(np.int64), _upto(n[b])[:-1])
                alike = b[100 * common >= percent * (size[a] + size[b] - common)]
                others[a] += copies[alike].sum()
                others[alike] += copies[a]
            marked[mine] = False
        some = np.flatnonzero(others)
        return pa.table([pa.array(names[some], pa.int64()), pa.array(others[some], pa.int64())], names=["id", "others"])

    guests = met.select("bucket", F.explode("guests").alias("id")).distinct()
    there = sets.select("bucket", "id", "n", "copies", "words")
    there = there.unionByName(guests.join(there.drop("bucket"), "id").select(there.columns))
    found = met.select("bucket", "x", "y").groupBy("bucket").cogroup(there.groupBy("bucket")).applyInArrow(run, "id long, others long")
    return found.groupBy("id").agg(F.sum("others").alias("others"))


def peers(sets: DataFrame, copies: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, others): for sets (id, terms; ids unique whole numbers, words distinct, so many in all) how many rows, by copies (id, copies), are of other sets that share
    at least percent of all words with each. Sets without any are left out."""
    cores = sets.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, words // PART_WORDS)
    own = _numbers(_numbered(_sharded(sets.select(F.col("id").cast("long"), "terms"), parts)), parts, max(cores, words // BUCKET_WORDS))
    own = written(own, "set-numbers")
    met = written(_met(_leads(own, max(cores, words // MEET_WORDS), percent), percent), "sets-met")
    return _compared(met, own.join(copies, "id"), percent)
