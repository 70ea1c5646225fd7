"""Document preparation: Unicode and OCR clean-up, pages, boilerplate, headings, tables and chunks.

Line-level rules that only look around themselves are windows over lines; chunkers that carry state from sentence to
sentence run a document at a time in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.fixed import CLASSIFICATION, COPYRIGHT, NUMBER_LINES, PAGE_NUMBER, SIGNS, UNSEEN, VERSION_NOTE

TOP_LINES, BOTTOM_LINES = 4, 3


def _normal_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain = [t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(plain, pa.string())], names=batch.schema.names)


def normalised(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text (made the last column) in normal form NFKC, with plain signs, no signs without width and no control characters
    but line feeds, tabs and carriage returns; nulls stay. Only the normal form, which Spark has no built-in for, leaves the JVM, in Arrow batches."""
    rest = [c for c in docs.columns if c != text]
    held = docs.select(*rest, text)
    done = held.mapInArrow(_normal_form, held.schema)
    return done.withColumn(text, F.translate(F.translate(text, "".join(SIGNS), "".join(SIGNS.values())), UNSEEN, ""))


def ocr_cleaned(text: Column) -> Column:
    """Words joined over line-end hyphens, three or more of a mark cut to one, lines of one or two signs dropped."""
    text = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    text = F.regexp_replace(text, r"([!?.,;:])\1{2,}", "$1")
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.trim(line).rlike(r"(?U)^[^\w\s]{1,2}$"))
    return F.array_join(kept, "\n")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, line, page, blank, indent): all lines; page marks set the page and are no lines themselves."""
    long = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line"))
    mark = F.regexp_extract("line", r"^<<<PAGE:([0-9]+)>>>$", 1)
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    paged = long.withColumn("mark", F.when(mark != "", mark.cast("int"))).withColumn("page", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit(1)))
    indent = F.length("line") - F.length(F.ltrim("line"))
    return paged.where("mark IS NULL").select(key, "at", "line", "page", (F.trim("line") == "").alias("blank"), indent.alias("indent"))


def boilerplate_key(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\s+", " "), "[0-9]+", "{page}")


def structural(line: Column) -> Column:
    """Whether a line is furniture by its form: a page number, a classification, a copyright note, or a short note of a version."""
    x = F.trim(line)
    return x.rlike(f"(?i){PAGE_NUMBER}") | x.rlike(f"(?i){CLASSIFICATION}") | x.rlike(f"(?i){COPYRIGHT}") | (x.rlike(f"(?i){VERSION_NOTE}") & (F.length(x) < 120))


def structural_sql(x: str) -> str:
    return f"(regexp_matches(trim({x}), '(?i){PAGE_NUMBER}') OR regexp_matches(trim({x}), '(?i){CLASSIFICATION}') OR regexp_matches(trim({x}), '(?i){COPYRIGHT}') OR (regexp_matches(trim({x}), '(?i){VERSION_NOTE}') AND length(trim({x})) < 120))"


def number_line(line: Column) -> Column:
    """Whether a line is nothing but a page number."""
    return F.trim(line).rlike("(?i)" + "|".join(f"(?:{p})" for p in NUMBER_LINES))


def without_boilerplate(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines less headers and footers: those that recur at the top or bottom of at least max(2, 40 %) of a document's pages,
    and lines anywhere that look like page numbers, classifications or copyright notes. Documents of one page keep all."""
    edge = Window.partitionBy(key, "page")
    placed = rows.withColumns({"from_top": F.row_number().over(edge.orderBy("at")), "from_bottom": F.row_number().over(edge.orderBy(F.desc("at"))), "key": boilerplate_key(F.col("line"))})
    pages = rows.groupBy(key).agg(F.countDistinct("page").alias("pages"))
    at_edge = (F.col("from_top") <= TOP_LINES) | (F.col("from_bottom") <= BOTTOM_LINES)
    common = placed.where(at_edge & ~F.col("blank")).groupBy(key, "key").agg(F.countDistinct("page").alias("on"))
    common = common.join(pages, key).where((F.col("pages") >= 2) & (F.col("on") >= F.greatest(F.lit(2), F.floor(F.col("pages") * 0.4)))).select(key, "key", F.lit(True).alias("recurs"))
    judged = placed.join(pages, key).join(common, [key, "key"], "left")
    drop = (F.col("pages") >= 2) & ((at_edge & F.coalesce("recurs", F.lit(False))) | structural(F.col("line")))
    return judged.where(~drop).select(*rows.columns)


def capitals(line: Column) -> Column:
    """Whether a line is in capitals: 85 % of at least three letters, up to twelve words."""
    letters = F.regexp_replace(line, r"[^\p{L}]", "")
    return (F.length(letters) >= 3) & (F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) >= F.length(letters) * 0.85) & (F.size(F.split(F.trim(line), r"\s+")) <= 12)


def headings(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows with heading_level: 1 for sections, roman numbers and capitals, the depth of the number for numbered ones, 2 for short lines
    that stand alone; null for others."""
    w = Window.partitionBy(key).orderBy("at")
    before, after = F.coalesce(F.lag("blank").over(w), F.lit(True)), F.coalesce(F.lead("blank").over(w), F.lit(True))
    line = F.trim("line")
    n_words = F.size(F.split(line, r"\s+"))
    number = F.regexp_extract(line, r"^([0-9]+(?:\.[0-9]+)*)[.)]?\s+\p{Lu}", 1)
    level = (
        F.when(F.col("blank"), None)
        .when(line.rlike(r"(?i)^(section|chapter|article|appendix)\s+[0-9IVXLC]+"), 1)
        .when(line.rlike(r"^[IVXLC]+\.\s+\p{L}"), 1)
        .when((number != "") & (n_words <= 12), F.size(F.split(number, r"\.")))
        .when(capitals(line), 1)
        .when(before & after & (n_words <= 8) & ~line.rlike(r"[.!?,;:|]$") & line.rlike(r"^\p{Lu}"), 2)
    )
    return rows.withColumn("heading_level", level)


def sections(rows: DataFrame, key: str = "doc_id", depth: int = 6) -> DataFrame:
    """rows with path: the headings above each line, outer first; a heading ends all of its level and below."""
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("heading_level").isNotNull(), F.least("heading_level", F.lit(depth)))
    out = rows
    for d in range(1, depth + 1):
        out = out.withColumn(f"_h{d}", F.last(F.when(level == d, F.struct("at", F.trim("line").alias("t"))), ignorenulls=True).over(w))
    path, newest = [], F.lit(-1)
    for d in range(1, depth + 1):
        h = F.col(f"_h{d}")
        path.append(F.when(h["at"] > newest, h["t"]))
        newest = F.greatest(newest, F.coalesce(h["at"], F.lit(-1)))
    return out.withColumn("path", F.array_compact(F.array(*path))).drop(*[f"_h{d}" for d in range(1, depth + 1)])


def paragraphs(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, paragraph, page, text): runs of lines between blank ones."""
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    grouped = rows.withColumn("paragraph", F.sum(F.col("blank").cast("int")).over(w)).where(~F.col("blank"))
    found = grouped.groupBy(key, "paragraph").agg(F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    return found.select(key, "paragraph", "page", F.array_join(F.col("l.line"), "\n").alias("text"))


def cut_sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if s.strip()]


def greedy_chunks(text: str, size: int = 800, overlap: int = 150) -> list[str]:
    """Sentences joined up to size characters; each chunk starts again with the last sentences of the one before, up to
    overlap characters of them, and always goes on by one sentence at least. A longer sentence is a chunk of its own."""
    parts, out, at = cut_sentences(text), [], 0
    while at < len(parts):
        end, n = at, 0
        while end < len(parts) and (end == at or n + 1 + len(parts[end]) <= size):
            n += len(parts[end]) + (end > at)
            end += 1
        out.append(" ".join(parts[at:end]))
        if end == len(parts):
            break
        back, kept = end, 0
        while back - 1 > at and kept + len(parts[back - 1]) <= overlap:
            back -= 1
            kept += len(parts[back])
        at = back
    return out


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 800, overlap: int = 150) -> DataFrame:
    """(key, chunk_id, chunk, content): the chunks of every document; chunk_id is key::number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(k, f"{k}::{i}", i, c) for k, t in zip(rows[key], rows[text], strict=True) for i, c in enumerate(greedy_chunks(t, size, overlap))]
            yield pd.DataFrame(found, columns=[key, "chunk_id", "chunk", "content"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_id string, chunk int, content string")


def section_chunks(rows: DataFrame, key: str = "doc_id", size: int = 1500) -> DataFrame:
    """(key, chunk, path, content): lines of one section together, up to size characters; later chunks of a section start with its path.

    rows need path (see sections()). The running length in a section says which chunk a line is in.
    """
    title = F.array_join("path", " > ")
    w = Window.partitionBy(key).orderBy("at")
    starts = F.coalesce((F.lag(title).over(w) != title).cast("int"), F.lit(1))
    numbered = rows.where(~F.col("blank")).withColumn("title", title).withColumn("starts", starts)
    numbered = numbered.withColumn("section", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    used = F.sum(F.length("line") + 1).over(Window.partitionBy(key, "section").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    numbered = numbered.withColumn("part", F.floor((used - 1) / size))
    found = numbered.groupBy(key, "section", "part").agg(F.min("at").alias("first"), F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    body = F.array_join(F.col("l.line"), "\n")
    turn = F.row_number().over(Window.partitionBy(key, "section").orderBy("first"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1
    content = F.when((turn > 1) & (F.col("title") != ""), F.concat("title", F.lit("\n"), body)).otherwise(body)
    return found.select(key, order.alias("chunk"), F.col("title").alias("path"), content.alias("content"))


def chunk_statistics(parts: DataFrame, content: str = "content") -> DataFrame:
    n = F.length(content)
    return parts.agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"))
