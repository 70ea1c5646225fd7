"""Web archives: a WARC record for each page, and a reader that trusts only boundary chains.

Writing: pages with equal payloads of at least min_revisit bytes share one response record, the one with the
smallest page_id; the others are revisit records that name it. Spark's text writer, with the blank lines
that end a record as its separator, commits the files.

Reading: every occurrence of the version line is a candidate, also those inside payloads. Candidates get their
byte offsets from a prefix sum of lengths over the splits of a file, and each names its successor, the offset where
its content length ends it. Pointer jumping from the start of every file then keeps the candidates that are
reachable; the pieces of a payload that false candidates cut are put together again. Files may be larger than a
task's memory, as splits are read by lines; a record must fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.store import OWN, require, written

VERSION = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Fixed date, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
#: Tables of at most so many short rows are broadcast; the count is checked each time.
BROADCAST_ROWS = 500_000
#: Beyond that, payloads are joined with their response in so many parts.
SALTS = 16


def _uri(url: Column) -> Column:
    """A header value stays on its line."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x1f\x7f]", "")


def decide(pages: DataFrame, min_revisit: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to for each row of pages.

    A null html is an empty payload. Among equal payloads the response is the row with the smallest page_id, nulls
    last; where rows repeat both id and payload, one of them. Other columns are not kept. Only ids and digests
    are grouped; pages meet their group by digest and part.
    """
    require(pages, id_col, url_col, html_col)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    held = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    held = held.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    ids = held.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.col("n")))
    groups = ids.groupBy("payload_digest").agg(first.alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    groups = written(groups.select("payload_digest", F.struct("first.page_id", "first.n").alias("to")), "warc-groups")
    n, repeats = groups.agg(F.count("*"), F.count_if(F.col("to.n") > 1)).first()
    if n <= BROADCAST_ROWS:
        joined = held.join(F.broadcast(groups), "payload_digest", "left")
    else:
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        joined = held.withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(SALTS))).join(groups.withColumn("salt", parts), ["payload_digest", "salt"], "left")
    same = F.col("page_id").eqNullSafe(F.col("to.page_id"))
    kinds = {"record_type": F.when(F.col("to").isNotNull() & ~same, "revisit").otherwise("response"), "refers_to": F.when(~same, F.col("to.page_id"))}
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    repeated = F.col("to").isNotNull() & same & (F.col("to.n") > 1)
    plain = joined.where(~repeated).withColumns(kinds).select(columns)
    if not repeats:
        return plain
    # Repeated rows: one response and, for the others, revisits of it.
    urls = F.col("urls")
    several = joined.where(repeated).groupBy("page_id", "payload_digest", "payload_bytes", "url").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    several = several.groupBy("page_id", "payload_digest", "payload_bytes").agg(F.first("payload").alias("payload"), F.array_sort(F.collect_list(F.struct("url", "n"))).alias("urls"))
    several = several.select("page_id", "payload", "payload_bytes", "payload_digest", F.posexplode(F.flatten(F.transform(urls, lambda u: F.array_repeat(u["url"], u["n"].cast("int"))))).alias("k", "url"))
    several = several.withColumns({"record_type": F.when(F.col("k") > 0, "revisit").otherwise("response"), "refers_to": F.when(F.col("k") > 0, F.col("page_id"))})
    return plain.unionByName(several.select(columns))


def write_archives(decided: DataFrame, path: str, file_records: int = 50_000, min_revisit: int = 100) -> None:
    """Write the rows of decide() as WARC files of at most file_records records. An empty table writes no record.

    Every record has an id of its own: page, digest, and 0 for a response that others may revisit (there is one of a payload), else a number of
    this run. min_revisit must be that of decide().
    """

    def line(name: str, value) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    is_response = F.col("record_type") == "response"
    named = lambda page, tag: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.col("payload_digest"), F.lit(":"), tag, F.lit(">"))
    own = F.when(is_response & (F.col("payload_bytes") >= min_revisit), "0").otherwise(F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string")))
    decided = decided.withColumn(f"{OWN}tag", own)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block_bytes = F.octet_length(http) + F.when(is_response, F.col("payload_bytes")).otherwise(0)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", named(F.col("page_id"), F.col(f"{OWN}tag"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", _uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(is_response, "").otherwise(F.concat(line("WARC-Profile", F.lit(profile)), line("WARC-Refers-To", named(F.col("refers_to"), F.lit("0"))))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block_bytes.cast("string")),
        F.lit("\r\n"),
        http,
    )
    record = F.concat(head.cast("binary"), F.when(is_response, F.col("payload")).otherwise(F.lit("").cast("binary"))).cast("string")
    decided.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at every version line: file, split, piece, start (of the version line before the piece), in any order.

    The first piece of a file starts at -len(VERSION): it stands before any version line.
    """
    return spark.read.option("lineSep", VERSION).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"), F.monotonically_increasing_id().alias("at")
    )


def _offsets(lines: DataFrame) -> DataFrame:
    """Adds start to rows with file, split, at, bytes: sums in a split, and of the splits before it."""
    here = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "split").agg(F.sum("bytes").alias("all")).select("file", "split", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("ahead"))
    placed = lines.withColumn("before", F.coalesce(F.sum("bytes").over(here), F.lit(0))).join(splits, ["file", "split"])
    return placed.withColumn("start", F.col("ahead") + F.col("before") - len(VERSION)).drop("ahead", "before")


def _header(name: str, head: Column) -> Column:
    return F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)


def _content(block: Column, head: Column) -> dict[str, Column]:
    """Fields of a record from its block and its header."""
    kind = _header("WARC-Type", head)
    http = F.substring_index(block.cast("string"), END, 1)
    payload = block.substr(F.octet_length(http) + len(END) + 1, F.octet_length(block))
    said = F.regexp_replace(_header("WARC-Payload-Digest", head), "^sha256:", "")
    got = F.sha2(payload, 256)
    revisit = kind == "revisit"
    return {
        "record_type": kind,
        "record_id": _header("WARC-Record-ID", head),
        "refers_to": F.nullif(_header("WARC-Refers-To", head), F.lit("")),
        "payload_bytes": F.when(revisit, _header("Content-Length", http).try_cast("long")).otherwise(F.octet_length(payload).cast("long")),
        "payload_digest": F.when(revisit, said).otherwise(got),
        "intact": F.when(revisit, F.lit(None).cast("boolean")).otherwise(said == got),
    }


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each version line: file, split, start, next (the successor's offset; null where no length can be
    read), bytes up to the next version line, clean (the record ends there), head and, if clean, the record's fields."""
    lines = _lines(spark, path)
    head = F.substring_index(F.col("piece").cast("string"), END, 1)
    parsed = lines.withColumns({"head": head, "bytes": (F.octet_length("piece") + len(VERSION)).cast("long")})
    ended = F.octet_length("piece") >= F.octet_length("head") + len(END)
    length = F.when(ended, _header("Content-Length", F.col("head")).try_cast("long"))
    parsed = parsed.withColumn("length", length).withColumn("whole", F.octet_length("head") + F.lit(len(VERSION) + 2 * len(END)) + F.col("length"))
    parsed = parsed.withColumn("clean", F.coalesce(F.col("whole") == F.col("bytes"), F.lit(False)))
    block = F.when(F.col("clean"), F.col("piece").substr(F.octet_length("head") + len(END) + 1, F.col("length").cast("int")))
    slim = parsed.withColumns(_content(block, F.col("head"))).drop("piece")
    placed = _offsets(slim.withColumn("head", F.when(~F.col("clean"), F.col("head"))))
    return placed.where("start >= 0").withColumn("next", F.col("start") + F.col("whole")).drop("whole", "at")


def reachable(found: DataFrame) -> DataFrame:
    """The candidates (file, split, start, next) that a chain from offset 0 of their file meets.

    In a split, neighbours that name each other form runs, which break wherever any other candidate points; then
    pointer jumping doubles the reach over the runs of each file, of which there are few, each round.
    """
    here = Window.partitionBy("file", "split").orderBy("start")
    linked = found.withColumns({"is_next": F.coalesce(F.lag("next").over(here) == F.col("start"), F.lit(False)), "to_next": F.coalesce(F.lead("start").over(here) == F.col("next"), F.lit(False))})
    targets = linked.where("NOT to_next AND next IS NOT NULL").select("file", F.col("next").alias("start"), F.lit(True).alias("pointed")).distinct()
    linked = linked.join(targets, ["file", "start"], "left").withColumn("head_at", F.when(~F.col("is_next") | F.col("pointed"), F.col("start")))
    linked = linked.withColumn("run", F.last("head_at", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))).drop("is_next", "to_next", "pointed", "head_at")
    linked = written(linked, "warc-runs")
    jumps = written(linked.groupBy("file", F.col("run").alias("at")).agg(F.max_by("next", "start").alias("to")), "warc-jumps")
    most = jumps.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    reach, span = jumps.where("at = 0").select("file", "at"), 1
    while span < most:
        onward = reach.join(jumps, ["file", "at"]).where("to IS NOT NULL").select("file", F.col("to").alias("at"))
        reach = written(reach.unionByName(onward).distinct(), "warc-reach")
        span *= 2
        if span < most:
            ahead = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
            jumps = written(jumps.join(ahead, ["file", "to"], "left").select("file", "at", F.col("beyond").alias("to")), "warc-jumps")
    return linked.join(reach.withColumnRenamed("at", "run"), ["file", "run"], "left_semi").drop("run")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files under path: file, start, record_type, record_id, refers_to, payload_bytes,
    payload_digest, intact (the payload's SHA-256 is the one in the header; null for revisits).

    The payload is what follows the HTTP header of the block. Files that don't begin with a version line, and what
    stands behind a record whose end is no record's start, give no rows. A record cut off by the end of its file is
    not intact.
    """
    kept = written(reachable(candidates(spark, path)), "warc-kept")
    fields = ["file", "start", "record_type", "record_id", "refers_to", "payload_bytes", "payload_digest", "intact"]
    cut = written(kept.where("NOT clean").select("file", F.col("start").alias("of"), "next", "length", "head"), "warc-cut")
    whole = kept.where("clean").select(fields)
    if not (n := cut.count()):
        return whole
    # Records that false candidates cut: read their files again and join the pieces within their bounds.
    near = F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)
    again = _lines(spark, path).join(near(cut.select("file").distinct()), "file", "left_semi").withColumn("bytes", (F.octet_length("piece") + len(VERSION)).cast("long"))
    parts = _offsets(again).where("start >= 0").join(near(cut), "file").where("start >= of AND start < coalesce(next, of + 1)")
    version = F.lit(VERSION).cast("binary")
    joined = parts.groupBy("file", "of", "length", "head").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("parts"))
    parts = joined.withColumn("whole", F.aggregate("parts", F.lit("").cast("binary"), lambda all_, p: F.concat(all_, version, p["piece"])))
    block = F.col("whole").substr(F.lit(len(VERSION) + len(END) + 1) + F.octet_length("head"), F.coalesce(F.col("length").cast("int"), F.lit(0)))
    mended = parts.withColumns(_content(block, F.col("head"))).withColumn("start", F.col("of"))
    return whole.unionByName(mended.select(fields))
