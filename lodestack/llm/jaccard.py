"""Documents whose sets of word shingles are similar, and the components that such links form.

1. Every document's shingles become a set with an id; documents with equal sets are one from there on. Tasks pack the
   PartEnum signatures of their sets by bucket, and a sketch of each set.
2. Sets with a signature in common meet in the signature's bucket; the smallest is the leader of the others.
3. The sets of a leader, which hold every pair that shares a signature led by it, are dealt to units of bounded size. In a unit, sketches
   part the sets that cannot be similar; no similar pair is lost by that. What is left together is compared exactly, all pairs. The
   links of the units, a spanning forest each, give components.
4. A leader with more sets than fit has several units, each with the leader in it. Its sets that are in another
   component than the leader are then compared with those of all its other units, and the components joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from lodestack.llm import memory
from lodestack.llm.components import components
from lodestack.llm.partenum import may_be_similar, pair_may_be_similar, set_id, shingle_sets, signatures, similar, sketch, sketch_bits
from lodestack.llm.quality import slices
from lodestack.llm.store import require, shuffle_partitions, written

#: Most sets in a unit besides its leader, about the most shingles in it, and outsiders of other units compared with a unit at once.
UNIT, UNIT_SHINGLES, OUTSIDERS = 2048, 1_500_000, 512
#: Shingles that a task gathers before it hands on its signatures, and text that it takes at once.
FLUSH, CHUNK_BYTES = 600_000, 1_000_000
#: Needed documents up to this many (16 bytes each) are broadcast; the count is checked.
BROADCAST_ROWS = 1_000_000
#: Shingles of so many sets in a unit are counted by matrix products of about so many cells.
DENSE, CELLS = 64, 4_000_000

#: Bytes of text whose signatures make a bucket.
BUCKET_BYTES = 16_000_000
#: Sets whose signatures a task remembers to have handed on.
SIGNED = 200_000

DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("hash", "<i8"), ("n", "<i4"), ("set", "<i8"), ("check", "<i8")])
#: A set's id (by whose first part sets meet) and size.
MADE = np.dtype([("set", "<i8"), ("check", "<i8"), ("n", "<i4")])
PACKED = ("docs", "sets", "sigs", "at", "made", "sketches")
NO_ID = -(2**63)


def _signing(buckets: int, percent: int, width: int):
    """(bucket, docs, sets, sigs, at, made, sketches): packed document rows; ids of sets, signatures, and each signature's set; sets and their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        docs: list[tuple] = []
        sets: dict[tuple[int, int], np.ndarray] = {}
        signed: set[tuple[int, int]] = set()
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs, sets, signed, held, turn
            turn += 1
            made = np.array([(*s, len(f)) for s, f in sets.items()], MADE).tobytes()
            rows = [(turn % buckets, np.array(docs, DOC).tobytes(), b"", b"", b"", made, b"".join(map(sketch, sets.values())))] if docs else []
            ids = np.fromiter((s for s, _ in sets), np.int64, len(sets))
            sig, owner = signatures(list(sets.values()), percent)
            order = np.argsort(sig % np.uint64(buckets), kind="stable")
            sig, owner = sig[order], owner[order]
            edges = np.searchsorted(sig % np.uint64(buckets), np.arange(buckets + 1, dtype=np.uint64))
            for b, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if y > x:
                    used, at = np.unique(owner[x:y], return_inverse=True)
                    rows.append((b, b"", ids[used].tobytes(), sig[x:y].tobytes(), at.astype("<u2" if len(used) <= 65536 else "<u4").tobytes(), b"", b""))
            signed = (set() if len(signed) + len(sets) > SIGNED else signed) | sets.keys()
            docs, sets, held = [], {}, 0
            for k in range(0, len(rows), 64):
                part = rows[k : k + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32())] + [pa.array([r[i + 1] for r in part], pa.binary()) for i in range(len(PACKED))], names=["bucket", *PACKED])

        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(batch.column(2), CHUNK_BYTES):
                for i, features in enumerate(shingle_sets(batch.column(2).slice(a, b - a), width), a):
                    s = set_id(features)
                    docs.append((ids[i] or 0, ids[i] is None, hashes[i], len(features), *s))
                    if len(features) and s not in sets and s not in signed:
                        sets[s] = features
                        held += len(features)
                if held >= FLUSH or len(docs) >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _rows(kind: int, how_many: int, /, **columns) -> pd.DataFrame:
    """Rows of one kind (0 documents, 1 sets and leaders, 2 sketches) of the table that _meeting makes."""
    zeros = {c: np.zeros(how_many, t) for c, t in (("id", np.int64), ("null", bool), ("hash", np.int64), ("n", np.int32), ("set", np.int64), ("check", np.int64), ("leader", np.int64))}
    return pd.DataFrame({"kind": np.full(how_many, kind, np.int32), **zeros, "sketch": [None] * how_many, **columns})


def _meeting(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Documents and sketches unpacked, and (set, leader) of the sets that share a signature of this bucket."""
    docs = np.concatenate([np.frombuffer(x, DOC) for x in rows["docs"]])
    out = [_rows(0, len(docs), id=docs["id"], null=docs["null"] > 0, hash=docs["hash"], n=docs["n"], set=docs["set"], check=docs["check"])]
    for made, sketches in zip(rows["made"], rows["sketches"], strict=True):
        own = np.frombuffer(made, MADE)
        ends = np.cumsum([sketch_bits(n) // 8 for n in own["n"].tolist()], dtype=np.int64).tolist()
        out.append(_rows(2, len(own), set=own["set"], check=own["check"], n=own["n"], sketch=[sketches[a:b] for a, b in zip([0, *ends[:-1]], ends)]))
    some = rows[rows["sigs"].str.len() > 0]
    if not len(some):
        return pd.concat(out)
    sig = np.concatenate([np.frombuffer(x, np.uint64) for x in some["sigs"]])
    sets = np.concatenate([np.frombuffer(s, np.int64)[np.frombuffer(a, "<u2" if 4 * len(a) == len(x) else "<u4")] for s, a, x in zip(some["sets"], some["at"], some["sigs"], strict=True)])
    order = np.lexsort((sets, sig))
    sig, sets = sig[order], sets[order]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    leader = np.repeat(sets[first], np.diff(np.r_[first, len(sig)]))
    pairs = np.stack([sets, leader], axis=1)[sets != leader]
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    return pd.concat([*out, _rows(1, len(pairs), set=pairs[:, 0], leader=pairs[:, 1])])


def linked(sets: list[np.ndarray], percent: int, ahead: int | None = None) -> np.ndarray:
    """Whether each pair of sets is similar; with ahead, only pairs of the first `ahead` sets with the others matter."""
    n = len(sets)
    out = np.zeros((n, n), bool)
    if n <= 6:
        for i in range(n):
            for j in range(i):
                if ahead is None or (j < ahead) != (i < ahead):
                    out[i, j] = out[j, i] = similar(sets[i], sets[j], percent)
        return out
    size = np.array([len(s) for s in sets], np.int64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    both = np.zeros((n, n), np.int32)
    # Shingles of many sets are counted by matrix products, a few at a time, those of few sets pair by pair.
    rank = np.cumsum(count >= DENSE) - 1
    own = count[column] >= DENSE
    wide, at = rank[column[own]], row[own]
    order = np.argsort(wide, kind="stable")
    wide, at = wide[order], at[order]
    step = max(64, CELLS // n)
    for begin in range(0, int(wide[-1]) + 1 if len(wide) else 0, step):
        x, y = np.searchsorted(wide, [begin, begin + step])
        held = np.zeros((n, step), np.float32)
        held[at[x:y], wide[x:y] - begin] = 1
        both += (held @ held.T).astype(np.int32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    flat = both.reshape(-1)
    for c in np.unique(count[(count > 1) & (count < DENSE)]).tolist():
        members = row[count[column] == c].reshape(-1, c)
        i, j = np.triu_indices(c, 1)
        for k in range(0, len(members), max(1, CELLS // len(i))):
            part = members[k : k + max(1, CELLS // len(i))]
            np.add.at(flat, (part[:, i] * n + part[:, j]).reshape(-1), 1)
            np.add.at(flat, (part[:, j] * n + part[:, i]).reshape(-1), 1)
    for i in range(n):
        out[i] = ((100 + percent) * both[i].astype(np.int64) >= percent * (size[i] + size)) & (both[i] > 0)
    if ahead is not None:
        out[:ahead, :ahead] = out[ahead:, ahead:] = False
    np.fill_diagonal(out, False)
    return out


def forest(ids: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) of all nodes that aren't roots, by breadth-first search."""
    out, todo = [], np.ones(len(ids), bool)
    for i in np.argsort(ids):
        if todo[i]:
            todo[i] = False
            edge = np.array([i])
            while len(edge):
                edge = np.flatnonzero(links[edge].any(axis=0) & todo)
                todo[edge] = False
                out += [(int(ids[j]), int(ids[i])) for j in edge]
    return out


UNIT_KEY = ["leader", "leader_check", "unit", "block"]


def _sifting(percent: int, second: bool):
    """For each unit of a bundle its sets that may be similar to another (in the second round, of the other side), with part: what may hang together."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*UNIT_KEY, "outside"], kind="stable").drop_duplicates([*UNIT_KEY, "set", "check"])
        sizes, sketches, outside = rows["n"].to_numpy(np.int64), rows["sketch"].tolist(), rows["outside"].to_numpy(bool)
        part = np.full(len(rows), -1)
        for a, b in _stretches(rows, UNIT_KEY):
            if b - a == 2:
                if (not second or outside[a] != outside[a + 1]) and pair_may_be_similar((int(sizes[a]), int(sizes[a + 1])), (sketches[a], sketches[a + 1]), percent):
                    part[a:b] = 0
            elif b - a > 2:
                near = may_be_similar(sizes[a:b], sketches[a:b], percent)
                if second:
                    ahead = int((~outside[a:b]).sum())
                    near[:ahead, :ahead] = near[ahead:, ahead:] = False
                for node, root in forest(np.arange(b - a), near):
                    part[[a + node, a + root]] = root
        return rows.assign(part=part)[part >= 0][[*UNIT_KEY, "part", "set", "check", "outside"]]

    return run


def _stretches(rows: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """(begin, end) of the runs of rows with equal keys, which must be sorted by them."""
    if not len(rows):
        return []
    held = rows[keys].to_numpy(np.int64)
    edges = np.flatnonzero(np.r_[True, (held[1:] != held[:-1]).any(axis=1), True]).tolist()
    return list(zip(edges[:-1], edges[1:]))


def _comparing(percent: int, width: int, second: bool):
    """For each part of the units of a bundle the links (a, b) that span its components; in the second round only between its own sets and outsiders."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(number=rows.groupby(["set", "check"], sort=False).ngroup())  # of each set here
        texts = rows.drop_duplicates("number").sort_values("number")
        sets: list[np.ndarray] = []
        for a, b in slices(pa.array(texts["text"], pa.large_string()), CHUNK_BYTES):
            sets += shingle_sets(pa.array(texts["text"].iloc[a:b], pa.string()), width)
        spans = []
        rows = rows.sort_values([*UNIT_KEY, "part", "outside"], kind="stable")
        number, outside = rows["number"].to_numpy(), rows["outside"].to_numpy(bool)
        for a, b in _stretches(rows, [*UNIT_KEY, "part"]):
            spans += forest(number[a:b], linked([sets[s] for s in number[a:b].tolist()], percent, int((~outside[a:b]).sum()) if second else None))
        a, b = np.array(spans, np.int64).reshape(-1, 2).T
        id, check = texts["set"].to_numpy(), texts["check"].to_numpy()
        return pd.DataFrame({"a": id[a], "a_check": check[a], "b": id[b], "b_check": check[b]})

    return run


def _bundled(units: DataFrame, *keys: str) -> DataFrame:
    """units with bundle: about a thousand rows with whole keys go to a task together. units should be a table, as it is counted."""
    return units.withColumn("bundle", F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-units.count() // 1000)))))


def _links(units: DataFrame, sketches: DataFrame, known: DataFrame, keyed: DataFrame, percent: int, width: int, second: bool) -> DataFrame:
    """The links of units (leader, unit, block, set, outside): sketches sift them first, and only what is left gets its texts."""
    flat = [F.col("leader.set").alias("leader"), F.col("leader.check").alias("leader_check"), "unit", "block", "set.*", "outside"]
    held = _bundled(units, "leader", "unit", "block").join(sketches, "set").select("bundle", *flat, "n", "sketch")
    kinds = "leader long, leader_check long, unit int, block int, part long, set long, check long, outside boolean"
    sifted = written(held.groupBy("bundle").applyInPandas(memory.groups(_sifting(percent, second)), kinds), "jaccard-sifted")
    whole = F.struct("set", "check")
    needed = sifted.select(whole.alias("set")).distinct().join(known, "set").select("set", F.col("first.at").alias("at"), F.col("first.hash").alias("hash"))
    needed = written(needed, "jaccard-needed")
    near = F.broadcast if needed.count() <= BROADCAST_ROWS else (lambda df: df)
    texts = keyed.select(F.coalesce("id", F.lit(NO_ID)).alias("at"), "hash", "text").join(near(needed), ["at", "hash"]).select("set", "text").dropDuplicates(["set"])
    texts = written(texts.select(F.col("set.set").alias("set"), F.col("set.check").alias("check"), "text"), "jaccard-texts")
    held = _bundled(sifted, *UNIT_KEY, "part").join(texts, ["set", "check"])
    links = held.groupBy("bundle").applyInPandas(memory.groups(_comparing(percent, width, second)), "a long, a_check long, b long, b_check long")
    end = lambda x: F.struct(F.col(x).alias("set"), F.col(f"{x}_check").alias("check")).alias(x)
    return written(links.select(end("a"), end("b")), "jaccard-links")


def _second_round(units: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """Units of the second round. Where a leader has several units, its sets that are in another component than the
    leader so far go, in blocks, to all its other units."""
    several = units.where("several AND set <> leader").join(roots, units["set"] == roots["node"], "left").select("leader", "unit", "set", F.coalesce("root", "set").alias("home"))
    leaders = several.select("leader").distinct().join(roots, F.col("leader") == roots["node"], "left").select("leader", F.coalesce("root", "leader").alias("leader_home"))
    apart = written(several.join(leaders, "leader").where("home <> leader_home").select("leader", "unit", "set"), "jaccard-apart")
    blocks = apart.groupBy("leader").agg(F.ceil(F.count("*") / OUTSIDERS).cast("int").alias("blocks"))
    spread = apart.join(blocks, "leader").withColumn("block", F.pmod(F.xxhash64("set", F.lit(1)), F.col("blocks")).cast("int"))
    outside = spread.join(sizes, "leader").select("leader", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("other"), "block", "set", "unit").where("other <> unit")
    inside = several.join(blocks, "leader").select("leader", "unit", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "set", F.lit(False).alias("outside"))
    return written(inside.union(outside.select("leader", F.col("other").alias("unit"), "block", "set", F.lit(True).alias("outside"))), "jaccard-units")


def similar_documents(docs: DataFrame, percent: int = 85, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, set_id, text_hash.

    Documents link when 100 * |A & B| >= percent * |A | B| for their sets of shingles. component_id is the smallest id
    that links reach. A document without words (or with a null text) links with nothing and is its own component; rows without an
    id take part, but never name a component unless no other row could. Equal sets always have the same component. Sets are told apart by a
    127-bit, shingles by a 64-bit hash. Texts are read whole, however long; an empty table gives no rows. Other columns are not kept.
    """
    if not 1 <= percent <= 100 or width < 1:
        raise ValueError("percent must be from 1 to 100 and width at least 1")
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-n_bytes // BUCKET_BYTES))
    signed = keyed.mapInArrow(memory.batches(_signing(buckets, percent, width)), "bucket int, " + ", ".join(f"{c} binary" for c in PACKED))
    signed = signed.repartitionById(buckets, F.col("bucket"))  # a task for each bucket, however many there are
    met = written(signed.groupBy("bucket").applyInPandas(memory.groups(_meeting), "kind int, id long, null boolean, hash long, n int, set long, check long, leader long, sketch binary"), "jaccard-met")
    sketches = met.where("kind = 2").groupBy(F.struct("set", "check").alias("set")).agg(F.max("n").alias("n"), F.any_value("sketch").alias("sketch"))
    sketches = written(sketches, "jaccard-sketches")
    rows = met.where("kind = 0").select(F.when(~F.col("null"), F.col("id")).alias("doc_id"), "hash", "n", F.struct("set", "check").alias("set"))
    met = met.where("kind = 1").select("set", "leader").distinct()

    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("hash"))
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("at"), "hash")
    known = written(rows.where("n > 0").groupBy("set").agg(F.max("n").alias("n"), F.min_by(place, order).alias("first"), F.min("doc_id").alias("least")), "jaccard-sets")
    # Sets met by a part of their ids; where several have it, all of them go on, to be told apart by their shingles.
    ids = known.select(F.col("set.set").alias("of"), F.col("set").alias("id"))
    stars = met.join(ids, F.col("set") == F.col("of")).select("leader", F.col("id").alias("member")).join(ids, F.col("leader") == F.col("of"))
    stars = written(stars.select(F.col("member").alias("set"), F.col("id").alias("leader")), "jaccard-stars")

    parts = F.greatest(F.ceil(F.count("*") / UNIT), F.ceil(F.sum("n") / UNIT_SHINGLES)).cast("int")
    sizes = written(stars.join(known.select("set", "n"), "set").groupBy("leader").agg(parts.alias("units")), "jaccard-leaders")
    units = stars.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("set"), F.col("units")).cast("int").alias("unit"), "set", (F.col("units") > 1).alias("several"))
    units = units.union(units.select("leader", "unit", F.col("leader").alias("set"), "several").distinct())
    units = written(units.select("leader", "unit", F.lit(0).alias("block"), "set", F.lit(False).alias("outside"), "several"), "jaccard-units")

    links = _links(units, sketches, known, keyed, percent, width, False)
    roots = components(links)
    if not sizes.where("units > 1").isEmpty():
        more = _links(_second_round(units, roots, sizes), sketches, known, keyed, percent, width, True)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    named = known.join(roots, known["set"] == roots["node"], "left").select("set", F.coalesce("root", "set").alias("root"), "least")
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "jaccard-least")  # a table, so that a large component's join can be split
    named = named.join(least, "root").select("set", "component_id")
    out = rows.join(named, "set", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.concat_ws("-", "set.set", "set.check").alias("set_id"), F.col("hash").alias("text_hash"))
