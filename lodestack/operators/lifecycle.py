"""Documents through their life: retries, removal, imports, changes to views that depend on them, tables in chunks, and what can be plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.fixed import RETRYABLE
from lodestack.shared import small, written


def retried(documents: DataFrame, requests: DataFrame, key: str = "doc_id", status: str = "status") -> tuple[DataFrame, DataFrame]:
    """(documents, events): documents that were asked for (key) and may be retried wait for it; each request gives an event: scheduled,
    not_eligible, or not_found."""
    asked = requests.select(key).distinct().withColumn("_asked", F.lit(True))
    may = F.col(status).isin(*RETRYABLE)
    changed = documents.join(asked, key, "left").withColumn(status, F.when(F.col("_asked") & may, "retry_pending").otherwise(F.col(status))).drop("_asked")
    known = documents.select(key, F.col(status).alias("_was"))
    found = asked.join(known, key, "left").select(key, F.when(F.col("_was").isNull(), "not_found").when(F.col("_was").isin(*RETRYABLE), "scheduled").otherwise("not_eligible").alias("event"))
    return changed, found


def removed(documents: DataFrame, gone: DataFrame, key: str = "doc_id", status: str = "status") -> DataFrame:
    """documents with those of gone marked as deleted; their rows stay."""
    marks = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return documents.join(marks, key, "left").withColumn(status, F.when(F.col("_gone"), "deleted").otherwise(F.col(status))).drop("_gone")


def imported(turns: DataFrame, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(turns, refused): conversations whose turns all have a known role and a text, and the keys of the others; one bad turn refuses the whole."""
    bad = ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)) | (F.coalesce(F.trim("text"), F.lit("")) == "")
    refused = written(turns.groupBy(key).agg(F.max(bad).alias("bad")).where("bad").select(key), "refused")
    return turns.join(small(refused, 100_000), key, "left_anti"), refused


def refreshed(view: DataFrame, source: DataFrame, changed: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """view, one row group for each key, with the groups of changed keys made anew from source and those that are gone left out."""
    keys = changed.select(key).distinct()
    return view.join(keys, key, "left_anti").unionByName(make(source.join(keys, key, "left_semi")))


def batches(rows: DataFrame, keys: list[str], order: Column, size: Column, header: int, most: int) -> DataFrame:
    """(keys, batch, n, size): rows of a table in its order, dealt greedily: a batch is closed before the row that would take it beyond most;
    every batch starts with the header's size. The sizes of a table are folded in one array, a number a row."""
    sizes = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), size.cast("long").alias("s")))), lambda x: x["s"]).alias("s"))
    start = F.struct(F.array().cast("array<struct<n:bigint,size:bigint>>").alias("done"), F.lit(0).cast("long").alias("n"), F.lit(header).cast("long").alias("size"))

    def step(acc, s):
        full = (acc["n"] > 0) & (acc["size"] + s > most)
        done = F.when(full, F.concat(acc["done"], F.array(F.struct(acc["n"].alias("n"), acc["size"].alias("size"))))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, 1).otherwise(acc["n"] + 1).cast("long").alias("n"), (F.when(full, header).otherwise(acc["size"]) + s).cast("long").alias("size"))

    folded = F.aggregate("s", start, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["n"].alias("n"), acc["size"].alias("size")))))
    return sizes.select(*keys, F.posexplode(folded).alias("batch", "b")).select(*keys, "batch", "b.n", "b.size")


def through(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """df through named stages, each from DataFrame to DataFrame; an error says in which stage it arose."""

    def run(now: DataFrame, stage: tuple[str, Callable]) -> DataFrame:
        try:
            return stage[1](now)
        except Exception as error:
            raise RuntimeError(f"stage {stage[0]}: {error}") from error

    return reduce(run, stages, df)


def scored_by(pairs: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list[float]]], left: str, right: str, out: str = "score") -> DataFrame:
    """pairs with the score of a model for two texts. load runs once in a task and gives a function of two lists of texts: the place for a
    reranker, an embedding's similarity, or a judge."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in parts:
            yield pd.Series(model(a.tolist(), b.tolist()), dtype=float)

    return pairs.withColumn(out, score(left, right))
