"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The words of a source, its documents in shuffled order, form a stream that may be gone through twice, cut in blocks of
block_words. A source is due ceil(target / block_words) blocks. Its weight is an interval of that many steps
on a line of 2^m steps, and slot i of the schedule stands at the van der Corput point of i (its bits reversed):
the source whose interval holds the point owns the slot. Since the first 2^m points meet every step once, each
source gets exactly its blocks, spread evenly over the schedule at every scale; the k-th slot of a source gives
its k-th block. The last block of a source is cut at its target. The mix is the table of the blocks' pieces of documents in
the order of their slots; what a document contributes, and where, is read from that table alone.

Built-in operations only. A hot source is spread over (range partition, source) groups for its order, over pieces of
its interval for its slots and over (source, block) for the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.store import OWN, numbered, require, written

WORD = r"[^\x20\x09-\x0D]+"
#: Slots ranked by one task, and steps of an interval made by one row.
CHUNK = 65536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sources (row, size) with weight and target; what is above cap times the size is reshared by weight.

    Each round fixes the sources that are above their cap and shares the rest anew; only two sums come to
    the driver. Without any words all targets are 0.
    """
    ring = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumns({"weight": F.element_at(ring, (F.col("row") % len(weights) + 1).cast("int")), "most": F.col("size") * F.lit(float(cap))})
    size, weight = sources.agg(F.sum("size"), F.sum("weight")).first()
    due = share * float(size or 0)
    level, capped = (due / weight if size else 0.0), -1
    while size:
        above = F.col("most") < F.col("weight") * F.lit(level)
        n, fixed, free = sources.agg(F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = (due - (fixed or 0.0)) / free, n
    return sources.withColumn("target", F.least("most", F.col("weight") * F.lit(level))).drop("most")


def schedule(sources: DataFrame) -> DataFrame:
    """(key, slot, block) for sources with key, blocks and before_blocks: which block each slot takes."""
    total = sources.agg(F.sum("blocks")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    pieces = sources.where("blocks > 0").select("key", "before_blocks", "blocks", F.explode(F.expr(f"sequence(0L, blocks - 1, {CHUNK}L)")).alias("piece")).repartition("key", "piece")
    steps = pieces.select("key", F.explode(F.expr(f"sequence(before_blocks + piece, before_blocks + least(piece + {CHUNK}, blocks) - 1)")).alias("step"))
    slots = steps.select("key", F.conv(F.reverse(F.lpad(F.bin("step"), bits, "0")), 2, 10).cast("long").alias("slot")).withColumn("chunk", F.shiftright("slot", 16))
    ahead = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = slots.groupBy("key", "chunk").agg(F.count("*").alias("n")).select("key", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot"))
    return slots.withColumn("rank", rank).join(chunks, ["key", "chunk"]).select("key", "slot", (F.col("first") + F.col("rank") - 1).alias("block"))


def ordered_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    block_words: int = 1024,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(pieces, stream): the mix itself, and the rows of docs in the order in which their sources are gone through.

    pieces: slot, at (word of its source's stream, by which pieces of a slot are ordered), words, place (the row of stream),
    pass (from 0), first (word of the document at which the piece begins). A document is cut where a block ends. A document
    without words has a piece of no words in each pass that comes to it.
    stream: place, doc_id, source, size, text_crc32, source_size, target for each row of docs, in any order of the table.
    """
    if cap < 1 or share > cap or block_words < 1:
        raise ValueError("cap and block_words must be at least 1, and share at most cap")
    require(docs, id_col, text_col, source_col)
    text, source = F.col(text_col), F.col(source_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), word_count(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    slim = slim.withColumns({"key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "shuffled": F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))})
    slim = written(slim, "mixing-sizes")

    sources = slim.groupBy("key").agg(F.sum("size").alias("size"))
    sources = written(targets(numbered(sources, (F.col("key") == "").cast("int"), F.col("key"), what="mixing-sources"), weights, share, cap), "mixing-targets")
    due = F.floor("target")
    sources = sources.select("key", F.col("size").alias("source_size"), "target", due.alias("due"), F.ceil(due / block_words).alias("blocks"))
    sources = written(numbered(sources, F.col("key"), sums=("blocks",), what="mixing-blocks").drop("row"), "mixing-due")

    # The stream: words before each document in its source, from all words before it less those before the source.
    placed = numbered(slim, F.col("key"), F.col("shuffled"), F.col("doc_id"), F.col("size"), sums=("size",), row="place", what="mixing-order")
    begins = numbered(sources.select("key", "source_size"), F.col("key"), sums=("source_size",), what="mixing-begins").select("key", F.col("before_source_size").alias("begin"))
    stream = placed.join(sources.join(begins, "key"), "key").withColumn("from", F.col("before_size") - F.col("begin"))

    slots = written(schedule(sources), "mixing-schedule")  # a table, so that its true size decides how it is joined
    passes = stream.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).withColumn("from", F.col("from") + F.col("pass") * F.col("source_size"))
    passes = passes.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("due"))).where(F.col("from") < F.col("due"))
    begin = F.greatest("from", F.col("block") * block_words)
    pieces = passes.withColumn("block", F.explode(F.expr(f"sequence(from div {block_words}, greatest(to - 1, from) div {block_words})")))
    pieces = pieces.select("key", "block", "place", "pass", begin.alias("at"), (F.least("to", (F.col("block") + 1) * block_words) - begin).alias("words"), (begin - F.col("from")).alias("first"))
    pieces = pieces.join(slots, ["key", "block"]).select("slot", "at", "words", "place", "pass", "first")
    return written(pieces, "mixing-pieces"), stream.select("place", "doc_id", "source", "size", "text_crc32", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, **how) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, text_crc32, source_size, target, taken, n_pieces, first_slot, copies, spots.

    size: words of the text (null: 0). Sources in the order of code points, null last, have the weights in turn
    and share `share` times all words; a target stops at cap times its source. taken: words of the document in
    the mix (see ordered_mix()), at most cap times its size, in n_pieces pieces, the first in first_slot (null where nothing is taken).
    copies: whole times it is taken, the nearest, so whole copies meet a source's target up to a document; for a document
    without words, the passes that come to its place. spots: for each copy the (slot, at) of its pass's first piece, the order of copies in the
    mix. The order in a source is that of md5(seed|id), then id, size and input order; a rerun on the same input agrees.
    text_crc32 tells rows apart for callers that join on it. Other columns are not kept. An empty table gives no rows; a very long
    text is a row of many pieces.
    """
    pieces, stream = ordered_mix(docs, weights, share, cap, **how)
    real = F.col("words") > 0
    spot = F.struct("slot", "at")
    per_pass = [F.min(F.when(F.col("pass") == p, spot)).alias(f"spot{p}") for p in range(cap)]
    found = pieces.groupBy("place").agg(F.sum("words").alias("taken"), F.count_if(real).alias("n_pieces"), F.min(F.when(real, F.col("slot"))).alias("first_slot"), F.countDistinct("pass").alias("reached"), *per_pass)
    own = stream.join(found, "place", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("taken", "n_pieces", "reached")})
    copies = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(F.col("reached")).cast("int")
    spots = F.slice(F.array(*[F.col(f"spot{p}") for p in range(cap)]), 1, F.col("copies"))
    return own.withColumn("copies", copies).select("doc_id", "source", "size", "text_crc32", "source_size", "target", "taken", "n_pieces", "first_slot", "copies", spots.alias("spots"), F.col("place").alias(f"{OWN}place"))
