"""Documents drawn so that they resemble a target: importance resampling by hashed word n-grams.

Every run of one to `longest` consecutive words is a feature, and falls into one of a fixed number of buckets by the CRC-32 of its UTF-8 bytes.
A bucket's gain is how much likelier it is in the target than in the documents (both smoothed by one for each bucket), as
a whole number of thousandths. A document's weight is the sum of the gains of its features; with Gumbel noise from a hash of seed and id added,
the highest scores are a draw without replacement.

Higher-order functions make each document's array of buckets, once, in a table of the shared folder (of 10,000 buckets, two bytes a feature). Its weight is an aggregate over element_at of the gains, an array that stands
in the plan as a literal: no feature is a row of its own where documents are scored. Only the counts before that take bucket numbers as rows, summed in their tasks, so that
totals alone (a row for each bucket and task at most) are shuffled; the driver gets two totals for each bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.store import OWN, numbered, require, without, written
from lodestack.llm.winnowing import held_still, words

BUCKETS = 10_000
LONGEST = 3
ADDED = ("n_words", "n_features", "weight", "score", "rank")


def bucket_arrays(held: Column, n_buckets: int = BUCKETS, longest: int = LONGEST) -> Column:
    """The buckets of all runs of 1 to longest words of an array of words, repeats kept; in no particular order."""

    def runs(length: int) -> Column:
        last = F.size(held) - length
        joined = lambda i: F.concat_ws(" ", *[F.get(held, i + j) for j in range(length)])
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _bucket(joined(i), n_buckets))).otherwise(F.array().cast("array<int>"))

    return F.concat(F.transform(held, lambda w: _bucket(w, n_buckets)), *[runs(n) for n in range(2, longest + 1)])


def _bucket(feature: Column, n_buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % n_buckets).cast("int")


def bucket_totals(buckets: DataFrame, n_buckets: int) -> list[int]:
    """How often each bucket occurs in the column buckets of all rows."""
    counted = buckets.select(F.explode(held_still(F.col("buckets"))).alias("bucket")).groupBy("bucket").count()
    totals = [0] * n_buckets
    for bucket, n in counted.collect():  # a row for each bucket
        totals[bucket] = n
    return totals


def gains(documents: list[int], target: list[int]) -> list[int]:
    """Whole thousandths of the logarithm of each bucket's share in the target over that in the documents, smoothed by one."""
    held, wanted = float(sum(documents) + len(documents)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((t + 1.0) * held / ((s + 1.0) * wanted))) for s, t in zip(documents, target, strict=True)]


def _literal(numbers: list[int]) -> Column:
    """numbers as one array; the optimiser folds it into a literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, n_buckets: int = BUCKETS, longest: int = LONGEST, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """docs less the text, with n_words, n_features, weight, score and rank (from 1 among the drawn; null for the others).

    Of the documents with at least least_words words, floor(percent / 100 of them) are drawn by descending score, ties by id (nulls last).
    Whole texts count; a null or empty one has no features and weight 0, and still a score. Repeated rows each count and each have a rank.
    A null id has noise of its own, as of an empty id. Columns of docs with the added names are replaced. Without documents
    there are no rows; without target texts, gains follow from smoothing alone.
    """
    if not 0 <= percent <= 100 or longest < 1 or n_buckets < 1:
        raise ValueError("percent must be from 0 to 100, longest and n_buckets at least 1")
    require(docs, id_col, text_col)
    require(target, target_col)
    held, buckets = f"{OWN}words", "buckets"
    kept = without(docs, *ADDED, text_col)
    at = f"{OWN}buckets"
    split = without(docs, *(a for a in ADDED if a not in (id_col, text_col))).withColumn(held, words(F.col(text_col)))
    weighed = split.withColumns({"n_words": F.size(held).cast("long"), at: bucket_arrays(F.col(held), n_buckets, longest)})
    own = kept.columns if id_col.lower() in {c.lower() for c in kept.columns} else [*kept.columns, id_col]
    weighed = written(weighed.select(*[F.col(f"`{c}`") for c in own], "n_words", at), "importance-buckets")
    wanted = target.select(words(F.col(target_col)).alias(held)).select(bucket_arrays(F.col(held), n_buckets, longest).alias(buckets))
    gain = _literal(gains(bucket_totals(weighed.select(F.col(at).alias(buckets)), n_buckets), bucket_totals(wanted, n_buckets)))

    weight = F.aggregate(F.col(at), F.lit(0).cast("long"), lambda total, b: total + F.element_at(gain, b + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    weighed = weighed.withColumns({"n_features": F.size(at).cast("long"), "weight": weight})
    scored = written(weighed.withColumn("score", F.col("weight") + noise).select(*kept.columns, *ADDED[:-1]), "importance-scores")

    eligible = scored.where(F.col("n_words") >= least_words)
    n_drawn = eligible.count() * percent // 100
    placed = numbered(eligible, F.col("score").desc(), F.col(id_col).asc_nulls_last(), row=f"{OWN}row", what="importance-order")
    rank = F.when(F.col(f"{OWN}row") < n_drawn, F.col(f"{OWN}row") + 1).cast("long")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).drop(f"{OWN}row").unionByName(rest)
