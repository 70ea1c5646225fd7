"""Chunks of documents, against plain loops over blocks, and faults that are planted."""

import random

from pyspark.sql import functions as F

from lodestack.operators import chunks as C
from lodestack.operators import ingestion as I
from lodestack.operators import passages as A
from lodestack.plans import passages as P


def plain_groups(blocks, lim):
    """blocks: (kind, size); lists of block numbers, by the rules one after the other."""
    groups, now, waits = [], [], False
    close = lambda: (groups.append(now), [])[1] if now else now
    for i, (kind, n) in enumerate(blocks):
        held = sum(blocks[j][1] for j in now)
        paragraphs = sum(blocks[j][0] == "paragraph" for j in now)
        if kind == "heading":
            now, waits = [*close(), i], True
        elif waits and kind == "table" and held + n > lim.preferred:
            close()
            groups.append([i])
            now, waits = [], False
        elif waits:
            now, waits = [*now, i], False
        else:
            shut = False
            if now:
                both = held + n + 2
                if kind == "table" or (kind == "list" and paragraphs):
                    shut = True
                elif both <= lim.preferred:
                    shut = kind == "paragraph" and paragraphs >= lim.paragraphs
                elif both <= lim.soft:
                    shut = kind == "list" or (kind == "paragraph" and paragraphs >= lim.paragraphs) or held >= lim.least
                elif both <= lim.most:
                    shut = kind == "list" or held >= lim.least
                else:
                    shut = True
            if shut:
                now = close()
            if not now and n > lim.most:
                groups.append([i])
            else:
                now = [*now, i]
    close()
    return groups


def plain_chunks(blocks, lim):
    """blocks: (kind, sizes of units, head); lists of (block, unit) a chunk."""
    gap = {"table": 2, "list": 1}
    sizes = [sum(s) + gap.get(k, 0) * (len(s) - 1) for k, s, _ in blocks]
    out = []

    def cut(b):
        kind, units, head = blocks[b]
        part, held = [], head
        for u, n in enumerate(units):
            if part and held + n + 2 > lim.preferred:
                out.append(part)
                part, held = [], head
            part.append((b, u))
            held += n + 2
        out.append(part)

    every = lambda b: [(b, u) for u in range(len(blocks[b][1]))]
    for group in plain_groups([(k, n) for (k, _, _), n in zip(blocks, sizes, strict=True)], lim):
        if sum(sizes[b] for b in group) + 2 * (len(group) - 1) <= lim.most:
            out.append([x for b in group for x in every(b)])
            continue
        part, held = [], 0
        for b in group:
            if blocks[b][0] in gap and sizes[b] > lim.most:
                if part:
                    out.append(part)
                part, held = [], 0
                cut(b)
                continue
            if part and held + sizes[b] + 2 > lim.preferred:
                out.append(part)
                part, held = [], 0
            part += every(b)
            held += sizes[b]
        if part:
            out.append(part)
    return out


def test_fold_is_the_plain_one():
    rng, lim = random.Random(3), C.Limits(120, 20, 150, 180, 2)
    for _ in range(3000):
        blocks = []
        for _ in range(rng.randrange(0, 14)):
            kind = rng.choice(["paragraph", "paragraph", "heading", "table", "list"])
            n = rng.randrange(1, 9) if kind in ("table", "list") else 1
            blocks.append((kind, [rng.choice([1, 5, 15, 19, 20, 40, 60, 118, 119, 120, 150, 190]) for _ in range(n)], 7 if kind == "table" else 0))
        flat = [(b, k, s, h) for b, (k, sizes, h) in enumerate(blocks) for s in sizes]
        got = C.chunk_numbers(*([x[i] for x in flat] for i in range(4)), lim)
        want = [i for i, part in enumerate(plain_chunks(blocks, lim)) for _ in part]
        assert got == want, blocks


TEXT = "\n".join([
    "1. Scope", "All rules hold here.", "", "They hold for all.", "", "More of it.", "", "2. Prices", "Item  Price", *[f"Thing {i}  {i}" for i in range(60)], "",
    "2.1 Steps", *[f"- step number {i}, {'which is longer than lines of tables are, ' * 3}" for i in range(40)], "", "closing words", "<<<PAGE:2>>>", "3. Empty", "", "4. End", "last words",
])


def chunks_of(spark, texts, limits):
    rows = I.lines(spark.createDataFrame(texts, "doc_id long, text string"))
    return C.semantic_chunks(P.document_units(rows), "doc_id", limits)


def test_rendered_chunks(spark):
    lim = C.Limits(300, 20, 350, 400, 2)
    out = chunks_of(spark, [(1, TEXT), (2, ""), (3, None)], lim).orderBy("doc_id", "chunk").collect()
    assert {r.doc_id for r in out} == {1}, "texts without lines have no chunks"
    assert [r.chunk for r in out] == list(range(len(out))) and len({r.chunk_id for r in out}) == len(out)
    assert out[0].content == "1. Scope\n\nAll rules hold here.\n\nThey hold for all." and out[0].path == "1. Scope" and out[0].title == "1. Scope"
    assert out[1].content == "1. Scope\n\nMore of it." and out[1].kind == "paragraph", "the second chunk of a section names it"
    tables, lists = [r for r in out if r.tables], [r for r in out if r.lists]
    assert len(tables) > 3 and len(lists) > 2
    assert sum(r.content.count("Item:\n") for r in tables) == 60 and all("Price:\n" in r.content for r in tables), "each row is under its headings"
    assert sum(r.content.count("- step") for r in lists) == 40
    assert all(r.content.startswith("2. Prices > 2.1 Steps\n2.1 Steps\n\n") for r in lists[1:]), "later chunks of a list repeat the path"
    assert [r.kind for r in out if r.path == "3. Empty"] == ["section_header"]
    assert out[-1].content == "4. End\n\nlast words" and (out[-1].page, out[-1].last_page) == (2, 2)
    assert all(len(r.content) <= lim.most + 60 for r in out)


def test_all_documents(spark, sf_dir):
    rows = P.stacked(spark, sf_dir)
    out = C.semantic_chunks(P.document_units(rows)).cache()
    spans = out.select("doc_id", "start", "end", F.col("chunk").alias("order"), F.col("chunk_id").alias("name"))
    faults = C.span_faults(spans).where("overlaps + disorders + repeats + empty > 0").count()
    assert faults == 0
    filled = rows.where("NOT blank")
    held = filled.join(spans.select("doc_id", "start", "end"), "doc_id").where("at BETWEEN start AND end").groupBy("doc_id", "at").count()
    assert held.count() == filled.count() and held.where("count > 1").count() == 0
    texts = rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "line")))["line"], "\n").alias("text"))
    assert C.missing_words(texts, out.withColumnRenamed("content", "text")).agg(F.max("missing")).first()[0] == 0


def test_planted_faults(spark):
    spans = [(1, 0, 4, 0, "a"), (1, 5, 9, 1, "b"), (1, 9, 12, 2, "c"), (1, 20, 22, 4, "d"), (1, 14, 15, 5, "e"), (1, 30, 31, 6, "a"), (1, 33, 32, 7, "f"), (1, 40, 41, 7, "g"), (2, 0, 1, 0, "a"), (2, 2, 2, 1, "b")]
    got = {r.doc_id: (r.spans, r.overlaps, r.disorders, r.repeats, r.empty) for r in C.span_faults(spark.createDataFrame(spans, "doc_id long, start int, end int, order int, name string")).collect()}
    assert got == {1: (8, 1, 1, 2, 1), 2: (2, 0, 0, 0, 0)}
    whole = spark.createDataFrame([(1, "One two: three four"), (2, ""), (3, None), (4, "a b")], "doc_id long, text string")
    parts = spark.createDataFrame([(1, "ONE"), (1, "four one"), (2, "x"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.missing for r in C.missing_words(whole, parts).collect()} == {1: 0.5, 2: 0, 3: 0, 4: 1}


def test_empty_tables(spark):
    assert chunks_of(spark, [], C.Limits()).count() == 0
    assert A.blocks(I.headings(I.lines(spark.createDataFrame([], "doc_id long, text string"))), spark.createDataFrame([], "doc_id long, start int, end int"), spark.createDataFrame([], "doc_id long, start int, end int")).count() == 0


def test_stacked_tables_have_a_short_plan(spark):
    """The driver's memory goes with the plan; a set of windows for each number of columns had it at over 500,000 signs."""
    text = "Name\nCity\nAnn\nRome\nBo\nOslo\n\nText that goes on. " + "And on. " * 20 + "\n<<<PAGE:2>>>\nKey\nTall\nWide\n1\n2\n3\n4\n5\n6"
    rows = I.lines(spark.createDataFrame([(1, text), (2, text.replace("Bo\n", "")), (3, "\n".join(f"c{i}" for i in range(80)))], "doc_id long, text string"))
    taken = spark.createDataFrame([(1, 15, 17)], "doc_id long, start int, end int")
    found = A.stacked_tables(rows, taken, 0.55)
    got = sorted((r.doc_id, r.start, r.end, r.columns, r.data_rows) for r in found.collect())
    assert got == [(1, 0, 5, 2, 2), (1, 9, 14, 2, 2), (2, 8, 16, 3, 2), (3, 0, 51, 2, 25), (3, 52, 79, 2, 13)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 6 and len(plan) < 100_000


def test_stacked_tables_end_at_blank_lines(spark):
    """Headings just before a blank line begin no table of what comes behind it; they had 25 rows, whatever stood there."""
    lines = [*[f"Section {i}" for i in range(1, 6)], "Item", "Code", "", "Cost", *[f"v{i}" for i in range(60)]]
    rows = I.lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"))
    found = A.stacked_tables(rows, spark.createDataFrame([], "doc_id long, start int, end int"), 0.55).collect()
    assert found and all("" not in lines[r.start : r.end + 1] for r in found)


def test_blocks_are_placed_without_broadcasts(spark):
    """Spans and runs look small in a file and are a row or more for each document: joined, all of them went through the driver."""
    rows = I.headings(I.lines(spark.createDataFrame([(1, "Alone\n\nName  Count\nAlpha  1\nBeta  2\n\n- a\n- b\n\nend of all"), (2, "x\ny")], "doc_id long, text string")))
    spans = spark.createDataFrame([(1, 2, 4, 2, False), (1, 3, 7, 9, True)], "doc_id long, start int, end int, columns int, stacked boolean")
    lists = spark.createDataFrame([(1, 0, 0), (1, 6, 7), (1, 7, 9)], "doc_id long, start int, end int")
    placed = A.placed(rows, spans, lists, carried=("line",))
    got = sorted((r.doc_id, r["at"], r.block, r.kind, r["_table"], r.columns) for r in placed.collect())
    assert got == [
        (1, 0, 1, "heading", None, None), (1, 2, 3, "table", 2, 2), (1, 3, 3, "table", 2, 2), (1, 4, 3, "table", 2, 2), (1, 5, 4, "table", 3, 9), (1, 6, 4, "table", 3, 9),
        (1, 7, 4, "table", 3, 9), (1, 9, 6, "list", None, None), (2, 0, 1, "paragraph", None, None), (2, 1, 1, "paragraph", None, None),
    ]
    for df in (C.units(rows, spans, lists), A.blocks(rows, spans.select("doc_id", "start", "end"), lists), A.tables(rows)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
