"""Exact top-k search over all vectors of a table, shard by shard.

1. Cuts fitted to a bounded sample part the space in cells; every row goes to its cell, and a cell to shards of about shard_rows rows,
   so that a cell with a third of all rows is many shards. Each shard gets a ball tree, and measures how far its
   rows are from the centre of the cell.
2. Queries are packed in blocks, cell by cell. Every block first searches one shard of its own cell; the k-th
   scores found there are floors.
3. A query goes on to those cells only whose ball (centre and reach, a few numbers a cell) can hold a score that
   reaches its floor. The queries that are left are shipped to the shards of those cells in portions, searched there by branch and
   bound below the floor, and the k best of all are ranked.

Vectors that are null, or hold null or non-finite components, and rows without an id take no part. Only vectors of equal
dimension meet. A query never finds its own row; other rows of its id, and repeated rows, are found as often as they stand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.balltree import BallTree, TopK, cell_of, spread
from lodestack.llm.store import require, written

#: Components (8 bytes each) of the sample to which cells are fitted in the driver, its most rows, and the most cells of a dimension.
SAMPLE_CELLS, SAMPLE_ROWS, CELLS = 2_000_000, 20_000, 1024
#: Bytes of queries that a shard searches together.
PORTION = 4_000_000
#: Other names for the keys of the trees, so that they can be told from those of the queries.
APART = ["of_dim", "of_cell", "of_part", "of_portion"]
FOUND = "row long, query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as doubles."""
    return F.transform(vector, lambda x: _floor(x.cast("double") * F.lit(float(scale))))


def _floor(x: Column) -> Column:
    """floor() that stays a double, so that large values keep theirs: values of 2^52 and more are whole."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.empty((0, 0))


def _cells(held: DataFrame, shards: int) -> dict[int, dict]:
    """Cuts for each dimension of the sample; rows of other dimensions are one cell each."""
    widest = held.agg(F.max("dim")).first()[0] or 1
    rows = held.where("dim > 0").orderBy(F.xxhash64("row")).select("dim", "vector").limit(max(1, min(SAMPLE_ROWS, SAMPLE_CELLS // max(1, widest)))).toPandas()
    return {int(dim): spread(_matrix(own["vector"]), min(CELLS, shards)) for dim, own in rows.groupby("dim")}


def _placed(cuts):
    def run(batches):
        for rows in batches:
            cell = np.zeros(len(rows), np.int64)
            for dim, at in rows.groupby("dim").indices.items():
                if dim in cuts.value:
                    cell[at] = cell_of(cuts.value[dim], _matrix(rows["vector"].iloc[at]))
            yield rows.assign(cell=cell)

    return run


def _building(cuts):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, cell, part = key
        points = _matrix(rows["vector"])
        tree = BallTree(rows["id"].to_numpy(np.int64), points, rows=rows["row"].to_numpy(np.int64))
        reach = float(np.sqrt(((points - cuts.value[dim]["centres"][cell]) ** 2).sum(axis=1)).max()) if dim in cuts.value else float("inf")
        return pd.DataFrame({"dim": [dim], "cell": [cell], "part": [part], "tree": [tree.to_bytes()], "reach": [reach]})

    return run


def _pack(rows: np.ndarray, ids: np.ndarray, floors: np.ndarray, vectors: np.ndarray) -> bytes:
    return np.column_stack([rows, ids, floors, np.ascontiguousarray(vectors).view(np.int64).reshape(len(rows), -1)]).astype(np.int64).tobytes()


def _unpack(content: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    held = np.frombuffer(content, np.int64).reshape(-1, dim + 3)
    return held[:, 0], held[:, 1], held[:, 2], np.ascontiguousarray(held[:, 3:]).view(np.float64)


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("row")
    lowest = np.full(len(rows), np.iinfo(np.int64).min)
    return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "block": [key[2]], "q": [_pack(rows["row"].to_numpy(), rows["id"].to_numpy(), lowest, _matrix(rows["vector"]))]})


def _seeding(k: int):
    """The blocks of a portion with their floors, by a search of one shard."""

    def run(key: tuple, queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        tree = BallTree.from_bytes(trees["tree"].iloc[0]) if len(trees) else None
        for q in queries.itertuples():
            rows, ids, floors, vectors = _unpack(q.q, q.dim)
            if tree is not None:
                best = TopK(len(rows), k)
                tree.search(rows, vectors, best)
                floors = np.where(best.count >= k, best.scores[:, -1], floors)
            out.append((q.dim, q.block, _pack(rows, ids, floors, vectors)))
        return pd.DataFrame(out, columns=["dim", "block", "q"])

    return run


def _shipping(cuts, balls):
    """For each block and each cell that can hold one of a query's k best: the queries that go there."""

    def run(batches):
        for blocks in batches:
            for b in blocks.itertuples():
                rows, ids, floors, vectors = _unpack(b.q, b.dim)
                known = balls.value.get(b.dim)
                if known is None:  # a dimension out of the sample: one cell, without a ball
                    yield pd.DataFrame({"dim": [b.dim], "cell": [0], "block": [b.block], "q": [b.q], "bytes": [len(b.q)]})
                    continue
                cells, reach = known
                norms = np.linalg.norm(vectors, axis=1)
                most = vectors @ cuts.value[b.dim]["centres"][cells].T + norms[:, None] * reach
                most += 1e-9 * np.abs(most) + 1e-6 * (1 + norms)[:, None]
                goes = np.floor(most) >= floors[:, None].astype(float)
                for c in np.flatnonzero(goes.any(axis=0)):
                    own = goes[:, c]
                    q = _pack(rows[own], ids[own], floors[own], vectors[own])
                    yield pd.DataFrame({"dim": [b.dim], "cell": [int(cells[c])], "block": [b.block], "q": [q], "bytes": [len(q)]})

    return run


def _searching(k: int):
    def run(key: tuple, queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        tree = BallTree.from_bytes(trees["tree"].iloc[0]) if len(trees) and len(queries) else None
        for q in queries.itertuples() if tree is not None else ():
            rows, ids, floors, vectors = _unpack(q.q, q.dim)
            best = TopK(len(rows), k, floors)
            tree.search(rows, vectors, best)
            has = np.arange(k)[None, :] < best.count[:, None]
            out.append(pd.DataFrame({"row": np.repeat(rows, best.count), "query_id": np.repeat(ids, best.count), "vec_id": best.ids[has], "score": best.scores[has]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("row", "query_id", "vec_id", "score")})

    return run


def shipped(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, block_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(portions, trees): which queries go to which shards (dim, cell, part, portion, q), and the shards' trees."""
    spark = vectors.sparkSession
    own = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    own = own.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    held = written(own.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("vector")}), "topk-vectors")
    cuts = spark.sparkContext.broadcast(_cells(held, -(-held.count() // shard_rows)))  # bounded by the sample
    placed = written(held.mapInPandas(_placed(cuts), "id long, vector array<double>, asks boolean, row long, dim int, cell long"), "topk-placed")

    counts = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).alias("parts"), F.ceil(F.count_if("asks") / block_rows).alias("blocks"))
    counts = written(counts, "topk-cells")
    deal = lambda n: F.pmod(F.xxhash64("row"), F.greatest(n, F.lit(1))).cast("long")
    dealt = placed.join(counts, ["dim", "cell"])
    trees = dealt.withColumn("part", deal(F.col("parts"))).groupBy("dim", "cell", "part").applyInPandas(_building(cuts), "dim int, cell long, part long, tree binary, reach double")
    trees = written(trees, "topk-trees")
    blocks = dealt.where("asks").withColumn("block", deal(F.col("blocks"))).groupBy("dim", "cell", "block").applyInPandas(_block, "dim int, cell long, block long, q binary")
    # A block's number tells it apart from those of other cells; its own cell's shards take its blocks in turn.
    blocks = blocks.join(counts.select("dim", "cell", "parts"), ["dim", "cell"]).withColumn("part", F.pmod("block", "parts"))
    seeds = written(blocks.select("dim", "cell", "part", F.concat_ws(":", "cell", "block").alias("block"), "q"), "topk-queries")

    near = ["dim", "cell", "part"]
    floors = seeds.withColumn("portion", F.col("block")).groupBy(*near, "portion")
    first = seeds.select(*near, F.col("block").alias("portion")).join(trees.select(*near, "tree"), near)
    blocks = written(floors.cogroup(first.toDF(*APART, "tree").groupBy(*APART)).applyInPandas(_seeding(k), "dim int, block string, q binary"), "topk-floors")

    # A row for each cell of the sampled dimensions, of which there are at most as many as the sample has parts.
    reach = trees.where(F.col("dim").isin(list(cuts.value))).groupBy("dim", "cell").agg(F.max("reach").alias("reach")).toPandas() if cuts.value else None
    balls = {} if reach is None else {int(d): (own["cell"].to_numpy(), own["reach"].to_numpy()) for d, own in reach.groupby("dim")}
    goes = written(blocks.mapInPandas(_shipping(cuts, spark.sparkContext.broadcast(balls)), "dim int, cell long, block string, q binary, bytes long"), "topk-goes")
    portions = goes.groupBy("dim", "cell").agg(F.ceil(F.sum("bytes") / PORTION).alias("portions"))
    ready = goes.join(portions, ["dim", "cell"]).withColumn("portion", F.pmod(F.xxhash64("block"), "portions")).join(counts.select("dim", "cell", "parts"), ["dim", "cell"])
    return ready.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(*near, "portion", "block", "q"), trees.select(*near, "tree")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best integer inner products of each row for which queries holds.

    vectors must hold whole numbers as doubles (see quantised()). Ties go to the smaller id. Other columns are not kept.
    An empty table, or one without queries, gives no rows. Vectors may have any length that a task's memory holds shard_rows times.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    require(vectors, id_col, vector_col)
    portions, trees = shipped(vectors, queries, k, id_col, vector_col, shard_rows, block_rows)
    near = ["dim", "cell", "part"]
    wanted = portions.select(*near, "portion").distinct().join(trees, near)
    found = portions.groupBy(*near, "portion").cogroup(wanted.toDF(*APART, "tree").groupBy(*APART)).applyInPandas(_searching(k), FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
