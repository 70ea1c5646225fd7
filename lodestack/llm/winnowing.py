"""Passages of a benchmark in documents, found by winnowing.

Every item is cut in windows of `window` consecutive words (a shorter item is one window). Of each run of
window - k + 1 k-grams, winnowing keeps the smallest hash, so any two equal windows, whose k-grams are equal, keep the
same one: a shared window is never missed. Documents and items meet on these fingerprints; a hit is then extended
to the windows of the document that it stands for, and these are compared word by word. Shorter windows
have one k-gram, of their own length, as fingerprint.

Built-in operations only. Documents are known by id and hash of the text, so repeated rows are judged once and all get
the result. Words are the runs of `WORD`, with A-Z in lower case; a null text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.store import OWN, require, without, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: the complement of the contract's [^\x00-\x2F\x3A-\x60\x7B-\x7F].
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a k-gram.
K = 5
#: Fingerprints and windows of items up to this many rows are broadcast; the count is checked each time.
BROADCAST_ROWS = 300_000
KEY = [f"{OWN}id", f"{OWN}hash"]


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BREAK), "")


def _over(array: Column, width: int, f) -> Column:
    """f at every start of a run of width elements; an empty array where there are fewer."""
    last = F.size(array) - F.lit(width)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), f)).otherwise(F.array().cast("array<bigint>"))


def _grams(hashes: Column, k: int) -> Column:
    return _over(hashes, k, lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))


def _smallest(grams: Column, run: int) -> Column:
    return _over(grams, run, lambda i: F.least(*[F.get(grams, i + j) for j in range(run)])) if run > 1 else grams


def held_still(array: Column) -> Column:
    """array as an expression of its own. Spark filters before it explodes a plain column by its size, and pushes that filter below the
    projections that make the column, where nested lambdas are worked out again for every element."""
    return F.concat(array, F.array().cast("array<bigint>"))


def _fingerprinted(df: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """df (with words) plus, for each length, f<length>: the fingerprint of the window at each start."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    for n in lengths:
        k = min(K, n) if n == window else n
        df = df.withColumn(f"g{n}", _grams(F.col("hashes"), k)).withColumn(f"f{n}", _smallest(F.col(f"g{n}"), n - k + 1)).drop(f"g{n}")
    return df.drop("hashes")


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each distinct window: n (its words), win (joined by blanks), fp, items (sorted ids as strings).

    Items without an id or without words have no windows.
    """
    require(items, id_col, text_col)
    cut = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    cut = written(cut.withColumn("n", F.least(F.size("words"), F.lit(window))), "winnow-items")
    parts = []
    for n in sorted(r.n for r in cut.select("n").distinct().collect()):  # at most `window` lengths
        own = _fingerprinted(cut.where(F.col("n") == n), [n], window)
        at = own.select("item", "n", "words", F.posexplode(held_still(F.col(f"f{n}"))).alias("at", "fp"))
        parts.append(at.select("n", F.concat_ws(" ", F.slice("words", F.col("at") + 1, n)).alias("win"), "fp", "item"))
    if not parts:
        return items.sparkSession.createDataFrame([], "n int, win string, fp bigint, items array<string>")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return written(every.groupBy("n", "win", "fp").agg(F.array_sort(F.collect_set("item")).alias("items")), "winnow-windows")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash of the text, words; nulls keep apart from other values by the id's text form."""
    own_id = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    return docs.select(own_id.alias(KEY[0]), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(KEY[1]), words(F.col(text_col)).alias("words"))


def occurrences(docs: DataFrame, windows: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(key, at, n, items): every place of every document where a window of the items stands."""
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())
    prints = windows.select("fp", F.col("n").alias("fn")).distinct()
    small = windows.count() <= BROADCAST_ROWS
    near = F.broadcast if small else (lambda df: df)
    own = _fingerprinted(_keyed(docs, id_col, text_col), lengths, window)
    every = F.array_distinct(F.concat(*[F.col(f"f{n}") for n in lengths])) if lengths else F.array().cast("array<bigint>")
    if small:
        met = own.withColumn("fp", F.explode(every)).join(near(prints), "fp")
    else:
        # First which fingerprints each document meets, without its words; then the words of those documents only.
        hits = own.select(*KEY, F.explode(every).alias("fp")).join(prints, "fp").distinct()
        met = own.join(written(hits, "winnow-hits"), KEY)
    # Extend: the starts of the document at which this fingerprint was kept are those of the windows it stands for.
    starts = F.array().cast("array<int>")
    for n in reversed(lengths):
        starts = F.when((F.col("fn") == n) & (F.size(f"f{n}") > 0), _where(F.col(f"f{n}"), F.col("fp"))).otherwise(starts)
    shown = met.select(*KEY, "fn", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.concat_ws(" ", F.slice("words", i + 1, F.col("fn"))).alias("win")))).alias("w"))
    shown = shown.select(*KEY, F.col("fn").alias("n"), "w.at", "w.win")
    return shown.join(near(windows.select("n", "win", "items")), ["n", "win"]).select(*KEY, "at", "n", "items").distinct()


def _where(array: Column, value: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(array) - 1), lambda i: F.get(array, i) == value)


def _merged(places: Column) -> Column:
    """Sorted (begin, end) intervals without overlaps or touching ends."""
    start = F.struct(F.lit(None).cast("struct<begin:int,end:int>").alias("last"), F.array().cast("array<struct<begin:int,end:int>>").alias("done"))

    def step(acc, p):
        joins = acc["last"].isNotNull() & (p["begin"] <= acc["last"]["end"])
        last = F.when(joins, F.struct(acc["last"]["begin"].alias("begin"), F.greatest(acc["last"]["end"], p["end"]).alias("end"))).otherwise(p)
        done = F.when(joins | acc["last"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["last"]))
        return F.struct(last.alias("last"), done.alias("done"))

    return F.aggregate(places, start, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["last"])))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a window), spans (of hit words, end exclusive), item_ids (sorted).

    Columns of docs with these names are replaced. An empty table of documents gives no rows, one of items no hits.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    require(docs, id_col, text_col)
    windows = item_windows(items, window, item_id_col, item_text_col)
    found = occurrences(docs, windows, window, id_col, text_col)
    place = F.struct(F.col("at").alias("begin"), (F.col("at") + F.col("n")).alias("end"))
    per_doc = found.groupBy(*KEY).agg(F.array_sort(F.collect_set(place)).alias("places"), F.collect_set("items").alias("sets"))
    per_doc = per_doc.select(*KEY, _merged(F.col("places")).alias("spans"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("item_ids"))
    per_doc = written(per_doc, "winnow-documents")
    own_id = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    kept = without(docs, "n_words", "n_hit", "spans", "item_ids")
    base = kept.withColumns({KEY[0]: own_id, KEY[1]: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), "n_words": F.size(words(F.col(text_col))).cast("long")})
    out = base.join(per_doc, KEY, "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select(*kept.columns, "n_words", hit.alias("n_hit"), spans.alias("spans"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
