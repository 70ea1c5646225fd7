"""File sources: every reader gives (path, name, text), one row a file; binary formats need their own library."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed limits of an upload.
MAX_BYTES = 50 * 1024 * 1024
EXTENSIONS = ("txt", "csv", "json", "pdf", "docx", "xlsx")
SCHEMA = "path string, name string, text string"
PAGE_MARK = "<<<PAGE:{}>>>"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def listed(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """All files under a folder, but for empty ones, which Spark leaves out: path, name, ext, size, content (read only where it is used)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), extension(F.col("path")).alias("ext"), F.col("length").alias("size"), "content")


def accepted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): known extension, some content, not over the limit."""
    reason = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name").when(~F.col("ext").isin(*EXTENSIONS), "unsupported type").when(F.col("size") == 0, "empty").when(F.col("size") > MAX_BYTES, "too large")
    marked = files.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").select("path", "name", "reason")


def texts(files: DataFrame) -> DataFrame:
    """Plain text: the content as UTF-8, what isn't becomes the replacement sign."""
    return files.where("ext = 'txt'").select("path", "name", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header: each row as `column: value` parts joined by commas, each file as its rows' lines in order."""
    raw = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in raw.columns]
    held = raw.select(F.col("_metadata.file_path").alias("path"), F.concat_ws(", ", *parts).alias("line"), F.monotonically_increasing_id().alias("at"))
    lines = held.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"))
    return lines.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.array_join(F.col("rows.line"), "\n").alias("text"))


def flat_json(text: str) -> str:
    """Nested JSON as `key: value` lines; lists give their elements' lines; what isn't JSON stays as it is."""
    try:
        value = json.loads(text)
    except ValueError:
        return text

    def lines(x, key: str = "") -> Iterator[str]:
        if isinstance(x, dict):
            for k, v in x.items():
                yield from lines(v, str(k))
        elif isinstance(x, list):
            for v in x:
                yield from lines(v, key)
        else:
            shown = {True: "true", False: "false", None: ""}.get(x, x) if isinstance(x, bool | None) else x
            yield f"{key}: {shown}" if key else str(shown)

    return "\n".join(lines(value))


def _by_file(files: DataFrame, ext: str, read: Callable[[bytes], str]) -> DataFrame:
    def run(batches):
        for rows in batches:
            yield pd.DataFrame({"path": rows["path"], "name": rows["name"], "text": [read(bytes(c)) for c in rows["content"]]})

    return files.where(F.col("ext") == ext).select("path", "name", "content").mapInPandas(run, SCHEMA)


def jsons(files: DataFrame) -> DataFrame:
    return _by_file(files, "json", lambda c: flat_json(c.decode("utf-8", "replace")))


def pdfs(files: DataFrame) -> DataFrame:
    """PDF pages with marks before them; blank pages are dropped. Needs pypdf on the workers."""

    def read(content: bytes) -> str:
        import io

        from pypdf import PdfReader

        pages = ((i, p.extract_text() or "") for i, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1))
        return "\n".join(f"{PAGE_MARK.format(i)}\n{t}" for i, t in pages if t.strip())

    return _by_file(files, "pdf", read)


def docx(files: DataFrame) -> DataFrame:
    """Paragraphs that aren't blank, a line each. Needs python-docx on the workers."""

    def read(content: bytes) -> str:
        import io

        from docx import Document

        return "\n".join(p.text for p in Document(io.BytesIO(content)).paragraphs if p.text.strip())

    return _by_file(files, "docx", read)


def xlsx(files: DataFrame) -> DataFrame:
    """Rows of all sheets, cells joined by commas. Needs openpyxl on the workers."""

    def read(content: bytes) -> str:
        import io

        from openpyxl import load_workbook

        book = load_workbook(io.BytesIO(content), read_only=True, data_only=True)
        rows = (", ".join(str(c) for c in row if c is not None) for sheet in book for row in sheet.iter_rows(values_only=True))
        return "\n".join(r for r in rows if r)

    return _by_file(files, "xlsx", read)


def checksums(files: DataFrame) -> DataFrame:
    return files.select("path", "name", F.sha2("content", 256).alias("checksum"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: a digest of the number and all checksums, to tell whether a corpus has changed; sums of parts of the checksums need no order."""
    parts = [F.sum(F.conv(F.substring("checksum", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return checksums(files).agg(F.sha2(F.concat_ws("-", F.count("*").cast("string"), *parts), 256).alias("fingerprint"))


def write_report(metrics: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    metrics.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON file; fails on malformed rows, missing required fields or repeated ids."""
    schema = "id string, question string, expected_answer string, expected_document string, expected_page int, expected_chunks array<int>, category string, difficulty string, tags array<string>"
    cases = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    lost = cases.where("id IS NULL OR question IS NULL OR expected_document IS NULL").count()
    twice = cases.groupBy("id").count().where("count > 1").count()
    if lost or twice:
        raise ValueError(f"{lost} cases lack a required field, {twice} ids repeat")
    return cases
