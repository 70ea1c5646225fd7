"""Lines and passages: page furniture, lists, tables between gaps, headings as titles and questions, claims and their support."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.fixed import BOUNDARY, BULLET, LIST_DEPTH, ORDERED
from lodestack.operators.retrieval import WORDS, by_words
from lodestack.shared import written


def runs(rows: DataFrame, key: str, member: Column, breaks: Column) -> DataFrame:
    """The rows that are members, with run: a number for each stretch of neighbouring lines that are members and do not break."""
    w = Window.partitionBy(key).orderBy("at")
    marked = rows.withColumns({"_in": F.coalesce(member, F.lit(False)), "_cut": F.coalesce(breaks, F.lit(True))})
    starts = F.col("_in") & (~F.coalesce(F.lag("_in").over(w), F.lit(False)) | F.col("_cut"))
    numbered = marked.withColumn("_starts", starts.cast("int"))
    return numbered.withColumn("run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_in").drop("_in", "_cut", "_starts")


def lists(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, ordered, items, depth): lists of lines with marks; a list ends at other lines and where marks change kind.

    Two blanks of indent are a level; items deeper than six levels are none.
    """
    text = F.trim("line")
    bullet, ordered = text.rlike(BULLET), text.rlike(ORDERED)
    level = F.floor(F.col("indent") / 2).cast("int")
    kind = F.when(bullet, False).when(ordered, True)
    w = Window.partitionBy(key).orderBy("at")
    marked = rows.withColumns({"ordered": kind, "level": level})
    items = runs(marked, key, F.col("ordered").isNotNull() & (F.col("level") <= LIST_DEPTH), F.lag("ordered").over(w) != F.col("ordered"))
    return items.groupBy(key, "run").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.first("ordered").alias("ordered"), F.count("*").alias("items"), F.max("level").alias("depth")).drop("run")


def gap_rows(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, run, at, page, cells): lines whose cells stand apart by two blanks or more, in runs with the same number of cells. A new section
    starts another run."""
    cells = F.filter(F.transform(F.split(F.trim("line"), r"\s{2,}"), lambda c: F.trim(c)), lambda c: c != "")
    w = Window.partitionBy(key).orderBy("at")
    cut = rows.withColumn("cells", F.when(~F.col("blank"), cells)).withColumn("n", F.size("cells"))
    breaks = (F.lag("n").over(w) != F.col("n")) | F.trim("line").rlike(f"(?i){BOUNDARY}")
    return runs(cut, key, F.col("n") >= 2, breaks).select(key, "run", "at", "page", "cells")


def header_cell(x: Column) -> Column:
    """Whether a cell may head a column."""
    words = F.size(F.split(x, r"\s+"))
    return (F.length(x) <= 50) & ~(F.contains(x, F.lit(";")) & (F.length(x) > 30)) & ~(x.endswith(".") & (words > 6))


def sentence_like(x: Column) -> Column:
    return (F.length(x) > 100) | (F.regexp_count(x, F.lit(r"\. ")) >= 2) | (x.rlike("[.!?]") & (F.size(F.split(x, r"\s+")) > 12))


def tables(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, columns, data_rows, confidence): runs of gap rows that are a table with a heading line and two rows at least.

    confidence is weighed from the cells in long form: likeness of headings, length of cells, evenness of columns and rows and numbers speak
    for a table; prose, narrative, marks and uneven widths against it. A run counts as a whole or not at all.
    """
    own = written(gap_rows(rows, key), "gap-rows")
    whole = own.groupBy(key, "run").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.min("page").alias("page"), F.min_by("cells", "at").alias("headers"), (F.count("*") - 1).alias("data_rows"))
    whole = whole.where((F.col("data_rows") >= 2) & F.forall("headers", header_cell))
    # A row or more for each document, which look small in a file: never sent through the driver.
    apart = lambda df: df.hint("merge")
    long = own.join(apart(whole.select(key, "run", "start")), [key, "run"]).select(key, "run", "at", (F.col("at") == F.col("start")).alias("head"), F.posexplode("cells").alias("col", "cell"))
    n, words = F.length("cell"), F.size(F.split("cell", r"\s+"))
    marks = F.regexp_count("cell", F.lit("[,.;:!?]")) / n
    long = long.withColumns({"n": n, "words": words, "marks": marks, "prose": sentence_like(F.col("cell")), "digit": F.col("cell").rlike(r"\d")})
    like = F.greatest(F.lit(0.0), 1.0 - F.when(n > 50, 0.4).otherwise(0.0) - F.when(F.col("prose"), 0.5).otherwise(0.0) - F.when(F.col("marks") > 0.08, 0.3).otherwise(0.0) - F.when(words > 8, 0.2).otherwise(0.0))
    low = F.lower("cell")
    narrative = (F.contains(low, F.lit(";")) & (n > 35)) | (F.contains(low, F.lit(" while ")) & (n > 60)) | F.contains(low, F.lit(" reflects "))
    share = lambda c, of=F.lit(True): F.avg(F.when(of, c.cast("int")))
    cells = long.groupBy(key, "run").agg(
        F.avg(F.when(F.col("head"), like)).alias("likeness"), F.avg("n").alias("mean"), share(F.col("digit"), ~F.col("head")).alias("numbers"), share(F.col("n") > 80).alias("long"),
        share(F.col("prose")).alias("prose"), share(narrative).alias("narrative"), share(F.col("marks") > 0.06).alias("marked"), F.max(F.col("col") + 1).alias("columns"),
    )
    step = lambda x, a, b: F.when(x <= a, 1.0).when(x <= b, 0.6).otherwise(0.2)
    spread = lambda x: F.stddev_pop(x) / F.avg(x)
    body = long.where("NOT head")
    aligned = body.groupBy(key, "run", "col").agg(step(spread("n"), 0.35, 0.7).alias("a")).groupBy(key, "run").agg(F.avg("a").alias("aligned"))
    lines = body.groupBy(key, "run", "at").agg(F.sum("words").alias("words"), F.sum("n").alias("width"))
    lines = lines.groupBy(key, "run").agg(step(spread("words"), 0.45, 0.9).alias("even"), spread("width").alias("uneven"), share(F.col("width") > 220).alias("oversized"))
    every = whole.join(apart(cells), [key, "run"]).join(apart(aligned), [key, "run"]).join(apart(lines), [key, "run"])
    return every.select(key, "start", "end", "columns", "data_rows", table_confidence().alias("confidence"), "headers", "run")


def table_confidence() -> Column:
    """From columns likeness, mean, aligned, even, numbers, long, prose, narrative, marked, uneven and oversized."""
    up = lambda x, *steps: _steps(x, steps)
    short = F.when(F.col("mean") <= 28, 0.20).when(F.col("mean") <= 45, 0.15).when(F.col("mean") <= 70, 0.08).otherwise(-0.10)
    numbers = F.when(F.col("numbers") >= 0.35, 1.0).when(F.col("numbers") >= 0.15, 0.6).otherwise(0.0)
    reward = 0.22 * F.col("likeness") + short + 0.18 * F.col("aligned") + 0.15 * F.col("even") + 0.10 * numbers + 0.10
    prose = up("long", (0.25, 0.25)) + up("prose", (0.20, 0.30)) + up("prose", (0.40, 0.20))
    penalty = prose + up("narrative", (0.20, 0.35), (0.10, 0.18)) + up("marked", (0.35, 0.25), (0.20, 0.12)) + up("uneven", (1.0, 0.20), (0.7, 0.10)) + up("oversized", (0.30, 0.20))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), reward - penalty)), 6)


def _steps(name: str, steps) -> Column:
    """What the first step that a value reaches takes off."""
    out = F.lit(0.0)
    for at, cost in reversed(steps):
        out = F.when(F.col(name) >= at, cost).otherwise(out)
    return out


#: Columns that a stacked table may have, rows at most, and rows and letters of a line at least and at most.
STACKED_COLUMNS, STACKED_ROWS, STACKED_LEAST, STACKED_LINE = (2, 6), 25, 2, 120


#: What is summed over the lines of a stretch, of which like over the headings only and digit over the data only.
STACKED_SUMS = ("n", "digit", "long", "prose", "narrative", "marked", "like")
#: What stacked_stretches() finds: lines at start and end, columns, lines of data, and what confidence needs.
STACKED_FOUND = "start int, end int, columns int, data int, likeness double, mean double, numbers double, long double, prose double, narrative double, marked double, aligned double, even double, uneven double, oversized double"


def _stretches(ends: np.ndarray, head: np.ndarray, stop: np.ndarray, x: dict[str, np.ndarray]) -> Iterator[list[np.ndarray]]:
    """For all stretches of runs of lines (ends: where each run ends) that begin with c headings and have whole rows of c lines up to their end, for each c: the place of
    their first line, and the columns of STACKED_FOUND with places in lines' stead.

    Every sum over a stretch, over one of its columns or over its rows is the difference of two running sums, those over columns and rows by steps of c lines; so all
    runs are worked on at once. Sums are of whole numbers, like in tenths, and do not depend on the lines before.
    """
    lines = len(head)
    place = np.arange(lines + 1)
    first = lambda flag: np.minimum.accumulate(np.append(np.where(flag, place[:-1], lines), lines)[::-1])[::-1]
    stop_at, no_head_at, over = first(stop), first(~head), np.repeat(ends, np.diff(ends, prepend=0))
    whole = {name: np.rint(10 * x[name]).astype(np.int64) if name == "like" else x[name].astype(np.int64) for name in STACKED_SUMS}
    upto = {name: np.concatenate([[0], np.cumsum(y)]) for name, y in whole.items()}
    words = np.concatenate([[0], np.cumsum(x["words"])])

    def by_steps(y: np.ndarray, c: int) -> np.ndarray:
        """At each place, the sum of y there and c, 2c... places before, after c zeros."""
        full = np.zeros((-(-len(y) // c) + 1) * c, y.dtype)
        full[c : c + len(y)] = y
        return np.cumsum(full.reshape(-1, c), axis=0).reshape(-1)[: c + len(y)]

    step = lambda v, a, b: np.where(v <= a, 1.0, np.where(v <= b, 0.6, 0.2))
    for c in range(STACKED_COLUMNS[0], min(STACKED_COLUMNS[1], int(np.diff(ends, prepend=0).max(initial=0)) // (1 + STACKED_LEAST)) + 1):
        p = place[: lines - c]
        p = p[(p + c < over[p]) & (np.minimum(no_head_at[p], over[p]) - p >= c)]
        data = np.minimum(np.minimum(stop_at[p + c], over[p]) - p - c, c * STACKED_ROWS)
        p = p[fit := (data >= c * STACKED_LEAST) & (data % c == 0)]
        if not len(p):
            continue
        data = data[fit]
        q, end, k = p + c, p + c + data, data // c
        spread = lambda y, yy, k=k: np.sqrt(np.maximum((k * yy - y * y).astype(float), 0.0)) / y
        of = lambda sums, a, b, c=c: sums[b] - sums[a]
        between = lambda y, a, b, c=c: (s := by_steps(y, c))[b] - s[a]
        n, nn = by_steps(whole["n"], c), by_steps(whole["n"] * whole["n"], c)
        column = lambda sums, j, q=q, end=end: sums[end + j] - sums[q + j]
        aligned = sum((step(spread(column(n, j), column(nn, j)), 0.35, 0.7) for j in range(c)), 0.0) / c
        row_words, row_width = words[c:] - words[:-c], upto["n"][c:] - upto["n"][:-c]
        every = lambda name, a=p, end=end, data=data, c=c: of(upto[name], a, end) / (data + c)
        yield [
            p, p, end - 1, np.full(len(p), c), data,
            of(upto["like"], p, q) / 10 / c, every("n"), of(upto["digit"], q, end) / data, *[every(name) for name in ("long", "prose", "narrative", "marked")],
            aligned, step(spread(between(row_words, q, end), between(row_words * row_words, q, end)), 0.45, 0.9), spread(between(row_width, q, end), between(row_width * row_width, q, end)), between((row_width > 220).astype(np.int64), q, end) / k,
        ]


def stacked_stretches(runs: DataFrame, key: str) -> DataFrame:
    """(key, _run, and STACKED_FOUND): what may be a table in runs of lines (key, _run, u: an array of the lines' at, head, stop, words and STACKED_SUMS, in order)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.select(key, "_run").schema) + ", " + STACKED_FOUND
    kinds = [pa.int32()] * 4 + [pa.float64()] * 11
    names = [key, "_run", *[c.split()[0] for c in STACKED_FOUND.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_words(batches, WORDS, 2):
            lists = batch.column(2)
            flat = lists.flatten()
            x = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            for p, start, end, *found in _stretches(ends, x["head"], x["stop"], x):
                which = pa.array(np.searchsorted(ends, p, side="right"))
                columns = [x["at"][start], x["at"][end], *found]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), *[pa.array(v, kind) for v, kind in zip(columns, kinds, strict=True)]], names=names)

    return runs.select(key, "_run", "u").mapInArrow(run, schema)


def stacked_tables(rows: DataFrame, taken: DataFrame, least: float, key: str = "doc_id") -> DataFrame:
    """(key, start, end, columns, data_rows, confidence): tables whose cells stand one below the other, a line each: the headings, then row after row up to a
    blank line, a new section, a long line, or a line that is taken (key, start, end).

    Of a start's numbers of columns the most confident counts, the smaller one of equals; tables below least are none. From the top, a table that is found takes its lines.
    A document's lines are in one task; what is known of a run of lines that may hold tables is in one row.
    """
    x = F.trim("line")
    n, words, low = F.length(x), F.size(F.split(x, r"\s+")), F.lower(x)
    marks = F.regexp_count(x, F.lit("[,.;:!?]")) / F.greatest(n, F.lit(1))
    prose = sentence_like(x)
    like = F.greatest(F.lit(0.0), 1.0 - F.when(n > 50, 0.4).otherwise(0.0) - F.when(prose, 0.5).otherwise(0.0) - F.when(marks > 0.08, 0.3).otherwise(0.0) - F.when(words > 8, 0.2).otherwise(0.0))
    narrative = (F.contains(low, F.lit(";")) & (n > 35)) | (F.contains(low, F.lit(" while ")) & (n > 60)) | F.contains(low, F.lit(" reflects "))
    flags = {"digit": x.rlike(r"\d"), "long": n > 80, "prose": prose, "narrative": narrative, "marked": marks > 0.06}
    slim = rows.select(
        key, "at", "blank", n.cast("long").alias("n"), words.cast("long").alias("words"), header_cell(x).alias("head"), F.when(n > 0, like).otherwise(0.0).alias("like"),
        (x.rlike(f"(?i){BOUNDARY}") | (n > STACKED_LINE) | ((F.regexp_count(x, F.lit(r"\. ")) >= 2) & (words > 18))).alias("stop"), *[F.coalesce(f, F.lit(False)).cast("long").alias(name) for name, f in flags.items()],
    )
    # A taken stretch comes as a row before its first line and hands its end down.
    begins = taken.select(key, F.col("start").alias("at"), F.col("end").alias("_end"))
    marked = slim.withColumn("_end", F.lit(None).cast("int")).unionByName(begins, allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("at", F.col("_end").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_taken", F.coalesce(F.max("_end").over(upto) >= F.col("at"), F.lit(False))).where("_end IS NULL")
    free = ~F.col("blank") & ~F.col("_taken")
    marked = marked.withColumns({"stop": ~free | F.col("stop"), "head": free & F.col("head")})
    # A table lies in a run of lines that are headings or data; the others, and runs too short for one, are left out.
    fit = F.col("head") | ~F.col("stop")
    runs = marked.withColumns({"_fit": fit, "_run": F.sum((~fit).cast("int")).over(upto)}).where("_fit")
    held = runs.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct("at", "head", "stop", "words", *STACKED_SUMS))).alias("u")).where(F.size("u") >= STACKED_COLUMNS[0] * (1 + STACKED_LEAST))
    scored = stacked_stretches(held, key).withColumn("confidence", table_confidence()).where(F.col("confidence") >= least)
    kind = "struct<start:int,worse:double,columns:int,end:int,data:int,confidence:double>"
    one = F.struct("start", -F.col("confidence"), "columns", "end", "data", "confidence").cast(kind)
    spans = scored.groupBy(key, "_run").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    start = F.struct(F.lit(-1).alias("last"), F.array().cast(f"array<{kind}>").alias("kept"))
    fold = lambda a, x: F.when(x["start"] > a["last"], F.struct(x["end"].alias("last"), F.array_append(a["kept"], x).alias("kept"))).otherwise(a)
    kept = spans.select(key, F.explode(F.aggregate("spans", start, fold, lambda a: a["kept"])).alias("t")).select(key, "t.*")
    return kept.select(key, "start", "end", "columns", (F.col("data") / F.col("columns")).cast("long").alias("data_rows"), "confidence")


def _handed_down(spans: DataFrame, key: str, name: str, at: str) -> DataFrame:
    """(key, at, name, name_one): each span (key, start, end and what else it has) at the first line that no span with an earlier start covers, and the place of spans of one line."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    first = F.greatest("start", F.max("end").over(before) + 1)
    span = F.struct(*[c for c in spans.columns if c != key])
    one = F.struct(first.cast(at).alias("at"), span.alias(name), F.lit(None).cast(at).alias(f"{name}_one"))
    own = F.struct(F.col("start").cast(at).alias("at"), F.lit(None).alias(name), F.col("start").cast(at).alias(f"{name}_one"))
    found = F.array_compact(F.array(F.when(first <= F.col("end"), one), F.when(F.col("start") == F.col("end"), own)))
    return spans.select(key, found.alias("_x")).select(key, F.explode("_x").alias("_x")).select(key, "_x.*")


def placed(rows: DataFrame, tables: DataFrame, lists: DataFrame, key: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """Lines that are not blank, or in a table, with block (its number in the document), kind, _table (the start of the line's table), what else tables has, and the carried columns.

    rows: lines with heading_level. tables and lists: (key, start, end). A line in a table is the table's; else, in a list, the list's, unless it is a heading and the
    only item; else a heading is a block of its own; what is left between these and blank lines are paragraphs.
    Tables and lists come as rows before their first line and hand themselves down, so nothing is joined: to the planner they look small, and the driver would get all of them.
    """
    at = rows.schema["at"].dataType.simpleString()
    marked = rows.select(key, "at", "blank", "heading_level", *carried, F.lit(True).alias("_line"))
    for spans, name in ((tables, "_t"), (lists.select(key, "start", "end"), "_l")):
        marked = marked.unionByName(_handed_down(spans, key, name, at), allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("at", F.col("_line").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = marked.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("_t", "_l", "_l_one")}).where("_line")
    own = own.withColumns({"_t": F.when(F.col("_t.end") >= F.col("at"), F.col("_t")), "_l": F.when(F.col("_l.end") >= F.col("at"), F.col("_l"))})
    alone = F.col("_l_one").eqNullSafe(F.col("at")) & F.col("heading_level").isNotNull()
    own = own.withColumns({"_table": F.col("_t.start"), "_list": F.when(~alone, F.col("_l.start")), **{c: F.col("_t")[c] for c in tables.columns if c not in (key, "start", "end")}})
    own = own.drop("_line", "_t", "_t_one", "_l", "_l_one")
    kind = F.when(F.col("_table").isNotNull(), "table").when(F.col("_list").isNotNull(), "list").when(F.col("heading_level").isNotNull(), "heading").otherwise("paragraph")
    span = F.coalesce("_table", "_list", F.when(F.col("heading_level").isNotNull(), F.col("at")), F.lit(-1))
    w = Window.partitionBy(key).orderBy("at")
    own = own.withColumns({"kind": F.when(~F.col("blank") | (F.col("_table").isNotNull()), kind), "_span": span})
    same = F.lag("kind").over(w).eqNullSafe(F.col("kind")) & F.lag("_span").over(w).eqNullSafe(F.col("_span"))
    return own.withColumn("_new", (~same).cast("int")).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind IS NOT NULL")


def blocks(rows: DataFrame, tables: DataFrame, lists: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, kind, heading_level, lines): each line that is not blank in exactly one block, in reading order; see placed()."""
    level = F.when(F.first("kind") == "heading", F.first("heading_level"))
    per = placed(rows, tables, lists, key).groupBy(key, "block")
    return per.agg(F.min("at").alias("start"), F.max("at").alias("end"), F.first("kind").alias("kind"), level.alias("heading_level"), F.count("*").alias("lines")).drop("block")


def links(pieces: DataFrame, key: str = "doc_id", depth: int = 6) -> DataFrame:
    """pieces with parent, the start of the last heading above a piece (of a heading: the last one of a smaller level), and next, the start of the piece after
    it; null where there is none. pieces: key, start, kind, heading_level; levels beyond depth count as depth. A source's pieces are linked in one task."""
    w = Window.partitionBy(key).orderBy("start")
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    level = F.least("heading_level", F.lit(depth))
    last = [F.last(F.when((F.col("kind") == "heading") & (level == d), F.col("start")), ignorenulls=True).over(above) for d in range(1, depth + 1)]
    none = F.lit(None).cast("int")
    upto = [F.greatest(*last[:d]) if d > 1 else last[0] if d else none for d in range(depth + 1)]
    parent = upto[depth]
    for d in range(1, depth + 1):
        parent = F.when((F.col("kind") == "heading") & (level == d), upto[d - 1]).otherwise(parent)
    return pieces.withColumns({"parent": parent, "next": F.lead("start").over(w)})


def title_word(w: Column) -> Column:
    """A word with a capital, unless it has digits or inner capitals."""
    return F.when(w.rlike(r"\d|^.+\p{Lu}"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))


def sentence_word(w: Column) -> Column:
    """A word that begins small, unless it has digits or inner capitals."""
    return F.when(w.rlike(r"\d|^.+\p{Lu}"), w).otherwise(F.concat(F.lower(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))


def question_of(heading: Column, title: Column) -> Column:
    """A question that a heading answers."""
    plain = F.regexp_replace(F.trim(heading), "[.:]+$", "")
    words = F.split(plain, r"\s+")
    low = F.array_join(F.transform(words, sentence_word), " ")
    article = F.when(low.rlike("^(the|a|an) "), "").otherwise("the ")
    short = F.concat(F.lit("Explain "), article, low, F.lit("."))
    long = F.concat(F.lit("What does the "), title, F.lit(" document say about "), low, F.lit("?"))
    return F.when(plain == "", F.concat(F.lit("What does "), title, F.lit(" cover?"))).when(plain.endswith("?"), plain).when(F.size(words) <= 5, short).otherwise(long)


def prose_of(line: Column) -> Column:
    """`Label: value` as a sentence; null for other lines, labels over 60 and values under 3 characters."""
    label, value = F.trim(F.regexp_extract(F.trim(line), r"^(.+?):\s*(.+)$", 1)), F.regexp_replace(F.trim(F.regexp_extract(F.trim(line), r"^(.+?):\s*(.+)$", 2)), r"\.+$", "")
    return F.when((label != "") & (F.length(label) <= 60) & (F.length(value) >= 3), F.concat(label, F.lit(" is "), value, F.lit(".")))


def claims(answers: DataFrame, key: list[str], answer: str, evidence: str, most: int = 12) -> DataFrame:
    """(key, place, ratio, support): the longest sentences of an answer with four words at least, and how many of their words the evidence has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), 0))
    parts = answers.select(*key, words(F.col(evidence)).alias("_known"), F.posexplode(F.split(answer, r"(?<=[.!?])\s+|\n+")).alias("place", "_s")).withColumn("_s", F.trim("_s")).where(F.length("_s") >= 25)
    longest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.length("_s")), "place"))
    kept = parts.withColumn("_r", longest).where(F.col("_r") <= most).withColumn("_w", words(F.col("_s"))).where(F.size("_w") >= 4)
    ratio = F.size(F.array_intersect("_w", "_known")) / F.size("_w")
    return kept.select(*key, "place", F.round(ratio, 6).alias("ratio"), F.when(ratio >= 0.28, "supported").when(ratio >= 0.12, "partially_supported").otherwise("unsupported").alias("support"))


def contents_penalty(text: Column) -> Column:
    """How much a passage looks like a table of contents, from 0 to 1; long lines of prose take most of it off."""
    lines = F.filter(F.transform(F.split(F.trim(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(lines)
    packed = F.regexp_count(F.trim(text), F.lit(r"\b\d+\.\d*\s+[A-Z]"))
    numbered = F.size(F.filter(lines, lambda x: x.rlike(r"^\d+(?:\.\d+)*\b")))
    ratio = F.when(n > 0, numbered / n).otherwise(0.0)
    prose = F.aggregate(F.filter(lines, lambda x: F.size(F.split(x, r"\s+")) >= 12), F.lit(0), lambda a, x: a + F.length(x))
    raw = F.when(packed >= 4, 0.30).when(packed >= 2, 0.15).otherwise(0.0) + F.when(ratio >= 0.55, 0.30).when(ratio >= 0.35, 0.12).otherwise(0.0)
    raw = raw + F.when((F.length(F.trim(text)) < 280) & (packed + ratio * F.greatest(n, F.lit(1)) >= 3), 0.15).otherwise(0.0)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0.0).otherwise(F.round(F.least(F.lit(1.0), F.when(prose >= 180, raw * 0.35).otherwise(raw)), 6))
