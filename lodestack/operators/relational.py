"""Joins, set operations and rankings that the engine needs beyond plain SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.window import Window

from lodestack.functions.fixed import FILE_CATEGORIES, MASTHEAD
from lodestack.shared import written


def visible(is_admin: Column, user: Column, owner: Column, visibility: Column, roles: Column, allowed: Column) -> Column:
    """Row-level access: admins and owners always; public; restricted where a role matches; all else, and nulls, never."""
    return F.coalesce(
        F.when(F.coalesce(is_admin, F.lit(False)), True).when(user == owner, True).when(visibility == "public", True).when(visibility == "restricted", F.arrays_overlap(roles, allowed)).otherwise(False),
        F.lit(False),
    )


def access_reason(is_admin: Column, user: Column, owner: Column, visibility: Column, roles: Column, allowed: Column) -> Column:
    """Why a row is granted or denied."""
    return (
        F.when(F.coalesce(is_admin, F.lit(False)), "granted_admin")
        .when(user == owner, "granted_owner")
        .when(visibility == "public", "granted_public")
        .when((visibility == "restricted") & F.arrays_overlap(roles, allowed), "granted_role")
        .when(visibility == "restricted", "denied_role")
        .when(visibility == "private", "denied_private")
        .otherwise("denied_unknown")
    )


def granted_sources(named: DataFrame, documents: DataFrame, source: str, name: str, seen: Column) -> DataFrame:
    """The distinct named sources that are documents which the caller sees; sources that are no document are denied."""
    return named.select(source).distinct().join(documents.where(seen).select(F.col(name).alias(source)).distinct(), source, "left_semi")


def in_allowed(source: Column, allowed: tuple[str, ...] | None) -> Column:
    """Whether a source is in the allowed set. An empty set allows nothing; None is no restriction."""
    if allowed is None:
        return F.lit(True)
    return source.isin(*allowed) if allowed else F.lit(False)


def file_category(name: Column) -> Column:
    """The category of a file by its name without extension; general for other names."""
    table = F.create_map(*[F.lit(x) for pair in FILE_CATEGORIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.regexp_replace(name, r"\.[^.]+$", "")), F.lit("general"))


def masthead(passage: Column) -> Column:
    """Whether a passage of up to 45 words only names a document."""
    x = F.trim(F.regexp_replace(F.coalesce(passage, F.lit("")), r"\s+", " "))
    return (x != "") & (F.size(F.split(x, " ")) <= 45) & x.rlike(f"(?i){MASTHEAD}")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def min_max(df: DataFrame, columns: dict[str, str], keys: list[str]) -> DataFrame:
    """df with each column x of {x: name} scaled to 0..1 in its group as name, rounded to 4 places; 1 where all are equal.

    Groups may be of any size: their ends are aggregated and joined.
    """
    ends = df.groupBy(*keys).agg(*[f(x).alias(f"_{n}_{x}") for x in columns for n, f in (("low", F.min), ("high", F.max))])
    out = df.join(ends, keys)
    for x, name in columns.items():
        low, high = F.col(f"_low_{x}"), F.col(f"_high_{x}")
        out = out.withColumn(name, F.when(high == low, 1.0).otherwise(F.round((F.col(x) - low) / (high - low), 4)))
    return out.drop(*[c for c in ends.columns if c not in keys])


def diversified(df: DataFrame, keys: list[str], source: str, order: list[Column], limit: int) -> DataFrame:
    """The first row of every source, then the others, in order; at most limit per group of keys; adds position."""
    turn = F.row_number().over(Window.partitionBy(*keys, source).orderBy(*order))
    spot = F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("_turn") > 1).cast("int"), *order))
    few = df.withColumn("_turn", turn).where(F.col("_turn") <= limit)  # more of a source can't be shown
    return few.withColumn("position", spot).where(F.col("position") <= limit).drop("_turn")


def shared_elements(df: DataFrame, key: str, elements: str, least: int = 1) -> DataFrame:
    """(a, b, n): pairs of rows with a < b that share at least n >= least elements, by the elements they share."""
    long = df.select(F.col(key).alias("k"), F.explode(F.array_distinct(elements)).alias("e"))
    pairs = long.alias("x").join(long.alias("y"), (F.col("x.e") == F.col("y.e")) & (F.col("x.k") < F.col("y.k")))
    return pairs.groupBy(F.col("x.k").alias("a"), F.col("y.k").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with its rows replaced by those of changes with the same key, and new ones added."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


#: Names of at most so many rows and bytes are sent to all tasks; both are counted.
NAMES, NAME_BYTES = 100_000, 8_000_000


def first_contained(texts: DataFrame, names: DataFrame, key: list[str], text: str, name: str, most: int = NAMES) -> DataFrame:
    """(key, name): each name of a table that a text contains anywhere, without regard to case.

    Few names go to all tasks, which read each text once with an automaton of all names. More of them than most meet texts by the first letters of names, as many as the
    shortest has; only those letters are shuffled, and the whole name is looked for in the texts of keys that met some. Null texts, and null and empty names, count for nothing.
    """
    known = written(names.where(F.length(name) > 0).select(F.lower(name).alias("_low"), name).distinct(), "names")
    n, size, short = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_low") + F.octet_length(name)), F.lit(0)), F.min(F.length("_low"))).first()
    held = texts.where(F.col(text).isNotNull()).select(*key, F.lower(text).alias("_text"))
    if n <= most and size <= NAME_BYTES:
        return _read_for_names(held, known, key, name).distinct()
    letters = F.array_distinct(F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{short}}}))"), 1))
    met = held.select(*key, F.explode(letters).alias("_lead")).join(known.withColumn("_lead", F.substring("_low", 1, short)), "_lead").drop("_lead")
    met = written(met, "names-met")
    return held.join(met, key).where(F.contains("_text", F.col("_low"))).select(*key, name).distinct()


def _read_for_names(held: DataFrame, known: DataFrame, key: list[str], name: str) -> DataFrame:
    """(key, name) of the names that stand in texts (key, _text), a row for each text and name."""
    spelt: dict[str, list[str]] = {}
    for row in known.collect():  # of a checked size
        spelt.setdefault(row["_low"], []).append(row[name])
    sent = held.sparkSession.sparkContext.broadcast(spelt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for low, own in sent.value.items():
            automaton.add_word(low, own)
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            if len(automaton):
                for i, x in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    own = {n for _, spellings in automaton.iter(x) for n in spellings}
                    at += [i] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]), pa.array(found, pa.string())], names=[*key, name])

    schema = StructType([*held.select(*key).schema.fields]).add(name, StringType())
    return held.mapInArrow(run, schema)
