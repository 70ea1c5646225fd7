"""Chunks that keep headings with what follows and tables and lists whole, and checks of spans and of what chunks hold."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.operators import ingestion as I
from lodestack.operators import passages as A


class Limits(NamedTuple):
    """Characters that a chunk should have, from which it may close early, may have if it would be short otherwise, may have at most; and paragraphs to merge."""

    preferred: int = 1200
    least: int = 80
    soft: int = 1500
    most: int = 1800
    paragraphs: int = 2


#: Share of a text's words that may be missing from its blocks, and from its chunks.
BLOCK_LOSS, CHUNK_LOSS = 0.35, 0.20


def units(rows: DataFrame, tables: DataFrame, lists: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, unit, kind, start, end, page, last_page, heading_level, text, head): what chunks are made of, a row for each heading, paragraph, list item and row of a table.

    rows: lines with heading_level; tables: (key, start, end, columns, stacked); lists: (key, start, end). A table's row is each heading with its cell; its heading
    lines belong to the first row, and head is how long they are in one line. Items keep their marks and indents.
    """
    lined = A.placed(rows, tables, lists, key, ("line", "page")).where("NOT blank")
    n = F.row_number().over(Window.partitionBy(key, "block").orderBy("at")) - 1
    row = F.when(F.col("kind") == "list", n).when(F.col("stacked"), F.floor(n / F.col("columns"))).when(F.col("kind") == "table", n).otherwise(0)
    cells = F.when((F.col("kind") == "table") & ~F.col("stacked"), F.split(F.trim("line"), r"\s{2,}")).otherwise(F.array(F.when(F.col("kind") == "list", F.rtrim("line")).otherwise(F.trim("line"))))
    per = lined.withColumns({"unit": row.cast("int"), "cells": cells}).groupBy(key, "block", "unit").agg(
        F.first("kind").alias("kind"), F.min("at").alias("start"), F.max("at").alias("end"), F.min("page").alias("page"), F.max("page").alias("last_page"),
        F.first("heading_level").alias("heading_level"), F.flatten(F.array_sort(F.collect_list(F.struct("at", "cells")))["cells"]).alias("cells"),
    )
    heads = F.first("cells").over(Window.partitionBy(key, "block").orderBy("unit"))
    first = F.min("start").over(Window.partitionBy(key, "block"))
    is_table = F.col("kind") == "table"
    per = per.withColumns({"heads": F.when(is_table, heads), "_first": first}).where(~is_table | (F.col("unit") > 0))
    fields = F.array_join(F.zip_with("heads", "cells", lambda h, c: F.concat(h, F.lit(":\n"), c)), "\n\n")
    text = F.when(is_table, fields).otherwise(F.array_join("cells", "\n"))
    start = F.when(is_table & (F.col("unit") == 1), F.col("_first")).otherwise(F.col("start"))
    return per.select(key, "block", "unit", "kind", start.alias("start"), "end", "page", "last_page", F.when(F.col("kind") == "heading", F.col("heading_level")).alias("heading_level"), text.alias("text"), F.when(is_table, F.length(F.array_join("heads", " | "))).otherwise(0).alias("head"))


def packed(sizes: Sequence[int], most: int, own: int = 0) -> list[int]:
    """The part of each size, where parts are filled up to most one after the other; each part starts with own."""
    out, part, held = [], 0, None
    for size in sizes:
        if held is not None and held + size > most:
            part, held = part + 1, None
        held = (own if held is None else held) + size
        out.append(part)
    return out


def grouped(kinds: Sequence[str], sizes: Sequence[int], limits: Limits = Limits()) -> list[int]:
    """The group of each block of a document: a heading opens one and takes the block after it (a table only up to the preferred size); a table is otherwise on its own start,
    a list too where paragraphs are before it; more than a few paragraphs, or more than the preferred size, close a group unless it would stay short."""
    out, group, size, paragraphs, waits = [], -1, None, 0, False
    for kind, n in zip(kinds, sizes, strict=True):
        total = 0 if size is None else size + n + 2
        full = total > limits.most or (total > limits.preferred and (kind == "list" or (size or 0) >= limits.least))
        many = kind == "paragraph" and paragraphs >= limits.paragraphs and total <= limits.soft
        if waits:
            opens = kind == "heading" or (kind == "table" and size + n > limits.preferred)
        else:
            opens = size is None or kind in ("heading", "table") or (kind == "list" and paragraphs > 0) or full or many
        alone = opens and (n > limits.most or (waits and kind == "table")) and kind != "heading"
        if opens:
            group, size, paragraphs = group + 1, 0, 0
        out.append(group)
        size, paragraphs, waits = (None if alone else size + n), paragraphs + (kind == "paragraph"), kind == "heading"
    return out


def chunk_numbers(blocks: Sequence[int], kinds: Sequence[str], sizes: Sequence[int], heads: Sequence[int], limits: Limits = Limits()) -> list[int]:
    """The chunk of each unit of a document. Groups of blocks are chunks, unless they are too long: then tables and lists that are too long go by rows and items, and the rest by blocks."""
    firsts = [i for i in range(len(blocks)) if i == 0 or blocks[i] != blocks[i - 1]]
    bounds = list(pairwise([*firsts, len(blocks)]))
    apart = {"table": 2, "list": 1}
    whole = [sum(sizes[a:b]) + apart.get(kinds[a], 0) * (b - a - 1) for a, b in bounds]
    groups = grouped([kinds[a] for a, _ in bounds], whole, limits)
    out, chunk, i = [0] * len(blocks), -1, 0
    while i < len(bounds):
        end = i
        while end < len(bounds) and groups[end] == groups[i]:
            end += 1
        fits, held = sum(whole[i:end]) + 2 * (end - i - 1) <= limits.most, None
        for (a, b), n in zip(bounds[i:end], whole[i:end], strict=True):
            if not fits and kinds[a] in apart and n > limits.most:
                parts = packed([s + 2 for s in sizes[a:b]], limits.preferred, heads[a])
                out[a:b] = [chunk + 1 + p for p in parts]
                chunk, held = chunk + 1 + parts[-1], None
                continue
            if held is None or (not fits and held + n + 2 > limits.preferred):
                chunk, held = chunk + 1, 0
            held += n
            out[a:b] = [chunk] * (b - a)
        i = end
    return out


def semantic_chunks(pieces: DataFrame, key: str = "doc_id", limits: Limits = Limits()) -> DataFrame:
    """(key, chunk, chunk_id, kind, title, path, page, last_page, start, end, paragraphs, tables, lists, words, content): the chunks of documents from their units().

    A fold over the sizes of a document's units says which chunk each is in; texts stay in Arrow. Chunks of a section after its first begin with the headings above.
    chunk_id names a chunk by its blocks, so others may change; title is the first heading of level 1, else the first one. Documents without lines have no chunks.
    """
    sectioned = I.sections(pieces.withColumns({"line": F.col("text"), "at": F.col("start")}), key).drop("line", "at")
    held = sectioned.withColumn("size", F.length("text")).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("start", "unit", "block", "kind", "size", "head", "end", "page", "last_page", "path", "text"))).alias("u"),
        F.coalesce(F.min_by("text", F.when(F.col("heading_level") == 1, F.col("start"))), F.min_by("text", F.when(F.col("heading_level").isNotNull(), F.col("start")))).alias("title"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("u"))
            flat = lists.flatten()
            columns = [pc.struct_field(flat, f).to_pylist() for f in ("block", "kind", "size", "head")]
            numbers, at = [], 0
            for n in pc.list_value_length(lists).to_pylist():
                numbers.append(chunk_numbers(*(c[at : at + n] for c in columns), limits))
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.list_(pa.int32()))], names=[*batch.schema.names, "c"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + ", c array<int>"
    long = held.mapInArrow(run, schema).select(key, "title", F.explode(F.arrays_zip("u", "c")).alias("x")).select(key, "title", F.col("x.c").alias("chunk"), "x.u.*")
    # The names of blocks: their kind's letter and first line, and of parts of one the unit that they begin with.
    name = F.concat(F.substring("kind", 1, 1), F.min("start").over(Window.partitionBy(key, "block")))
    part = F.min("unit").over(Window.partitionBy(key, "block", "chunk"))
    least = F.min("unit").over(Window.partitionBy(key, "block"))
    sep = F.when((F.col("kind") == "list") & (F.col("unit") > part), "\n").otherwise("\n\n")
    long = long.withColumns({"_name": F.when(part > least, F.concat(name, F.lit(":"), part)).otherwise(name), "_text": F.concat(sep, "text")})
    kinds = lambda k: F.countDistinct(F.when(F.col("kind") == k, F.col("block")))
    per = long.groupBy(key, "chunk").agg(
        F.first("title").alias("title"), F.min_by("path", F.struct("start", "unit")).alias("path"), F.min("page").alias("page"), F.max("last_page").alias("last_page"), F.min("start").alias("start"), F.max("end").alias("end"),
        kinds("paragraph").alias("paragraphs"), kinds("table").alias("tables"), kinds("list").alias("lists"), kinds("heading").alias("headings"),
        F.array_sort(F.collect_list(F.struct("start", "unit", "_text", "_name"))).alias("u"),
    )
    body = F.regexp_replace(F.array_join(F.col("u._text"), ""), r"^\n+", "")
    section = F.get("path", F.size("path") - 1)
    again = (F.size("path") > 0) & (F.row_number().over(Window.partitionBy(key, section).orderBy("chunk")) > 1)
    above = F.array_join("path", " > ")
    repeats = (F.col("headings") == 0) & (F.size("path") > 1) & ~F.contains("body", section)
    prefix = F.when(repeats, F.concat(above, F.lit("\n"), section)).otherwise(above)
    content = F.when(again & ~F.col("body").startswith(prefix), F.concat(prefix, F.lit("\n\n"), "body")).otherwise(F.col("body"))
    only = lambda *others: sum((F.col(o) for o in others), F.lit(0)) == 0
    kind = F.when(only("paragraphs", "tables", "lists"), "section_header").when(only("headings", "tables", "lists"), "paragraph").when(only("headings", "paragraphs", "lists"), "table").when(only("headings", "paragraphs", "tables"), "list")
    kind = kind.when((F.col("headings") > 0) & (F.size("path") > 1), "subsection").otherwise("mixed")
    names = F.array_join(F.array_distinct(F.col("u._name")), "-")
    short = F.when(F.length(names) <= 120, names).otherwise(F.concat(F.get(F.col("u._name"), F.lit(0)), F.lit("-"), F.substring(F.sha1(names), 1, 12)))
    out = per.withColumn("body", body).withColumns({"kind": kind, "_content": content, "chunk_id": F.concat(F.col(key).cast("string"), F.lit("::"), short)})
    words = F.size(F.regexp_extract_all("_content", F.lit(r"\S+"), 0))
    return out.select(key, "chunk", "chunk_id", "kind", "title", above.alias("path"), "page", "last_page", "start", "end", "paragraphs", "tables", "lists", words.alias("words"), F.col("_content").alias("content"))


def span_faults(spans: DataFrame, key: str = "doc_id", order: str = "order", name: str = "name") -> DataFrame:
    """(key, spans, overlaps, disorders, repeats, empty): how many spans (key, start, end, order, name) begin at or before the end of one that starts earlier, come in the given
    order after one with a later start, share their name or place in the order with one before, and end before they start. A key's spans are read in two orders, never held."""
    before = lambda *by: Window.partitionBy(key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    flags = spans.withColumns({
        "_overlaps": F.col("start") <= F.max("end").over(before("start", "end", order)), "_disorders": F.col("start") < F.max("start").over(before(order, "start")),
        "_repeats": (F.row_number().over(Window.partitionBy(key, name).orderBy(order, "start")) > 1) | (F.row_number().over(Window.partitionBy(key, order).orderBy("start", "end")) > 1), "_empty": F.col("end") < F.col("start"),
    })
    return flags.groupBy(key).agg(F.count("*").alias("spans"), *[F.count_if(f"_{x}").alias(x) for x in ("overlaps", "disorders", "repeats", "empty")])


def missing_words(whole: DataFrame, parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, missing): the share of the distinct words of a key's whole text (stretches without blanks and colons), without regard to case, that none of its parts has; 0 without words."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[^\s:]+"), 0))
    held = parts.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(words(F.col(text))))).alias("_held"))
    both = whole.select(key, words(F.coalesce(text, F.lit(""))).alias("_all")).join(held, key, "left")
    left = F.size(F.array_except("_all", F.coalesce("_held", F.array().cast("array<string>"))))
    return both.select(key, F.round(left / F.greatest(F.size("_all"), F.lit(1)), 6).alias("missing"))
