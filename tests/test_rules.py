"""Rules and small operators against plain Python."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestack.functions import fixed as V
from lodestack.functions import text as X
from lodestack.operators import activity as A
from lodestack.operators import graph as G
from lodestack.operators import ingestion as I
from lodestack.operators import knowledge as K
from lodestack.operators import passages as P
from lodestack.operators import planning as Q
from lodestack.operators import relational as R
from lodestack.plans import passages, preparation, registry
from lodestack.shared import numbered, shared_dir, with_neighbours


def one(spark, *columns, **values):
    """The values of columns over one row."""
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return tuple(frame.select(*columns).first())


def test_order_of_categories_and_safety(spark):
    asked = {
        "compare the security budgets": "security", "what is the password policy": "security", "which document lists aml rules": "cross_document", "list the table of totals": "table", "what is compliance": "compliance",
        "what are the steps of revenue approval": "financial", "how many people": "numeric", "who is the ceo": "entity_lookup", "what is love": "definition", "": "general", "hello": "general", "  list all": "list",
    }
    rows = spark.createDataFrame(list(asked.items()), "q string, want string").select("q", "want", Q.category(F.col("q")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert [n for n, _ in V.CATEGORIES] == ["cross_document", "compliance", "security", "financial", "table", "comparison", "list", "numeric", "procedure", "policy", "entity_lookup", "definition"]
    safe = {"how do i make a bomb": "unsafe", "what does our policy say on how do i make a bomb": "safe", "how do i hack someone's email": "unsafe", "steal ideas": "safe"}
    rows = spark.createDataFrame(list(safe.items()), "q string, want string").select("want", Q.safety(F.col("q")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_versions_words_and_folding(spark):
    names = {"x_v2_final": 90, "x_draft_v3": 10, "x_v12": 12, "report-rev4": 4, "plan version 7": 7, "q_09": 9, "plain": 1}
    rows = spark.createDataFrame(list(names.items()), "n string, want int").select("want", K.version_of(F.col("n")).alias("got"), K.version_group(F.col("n")).alias("g")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and rows[0].g == "x" and rows[5].g == "q"
    texts = ["Straße ﬁne ﬅop", "ĸ ſet", "ẞ GROẞ", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.tokens(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [re.findall("[a-z0-9]+", t.casefold()) for t in texts]
    words = ["running", "cats", "boxes", "happiness", "ed", "allowed", "nations", "as"]

    def stem(w):
        return next((w[: -len(s)] for s in V.SUFFIXES if len(w) > len(s) + 3 and w.endswith(s)), w)

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.stemmed(F.col("w")).alias("s")).collect()
    assert [r.s for r in rows] == [stem(w) for w in words]


def test_normal_form_of_all_documents(spark, sf_dir):
    gone = set(V.UNSEEN)

    def plain(t):
        t = "".join(V.SIGNS.get(c, c) for c in unicodedata.normalize("NFKC", t) if c not in gone or c in V.SIGNS)
        t = re.sub(r"([!?.,;:])\1{2,}", r"\1", re.sub(r"(\w)-\n(\w)", r"\1\2", t))
        return "\n".join(x for x in t.split("\n") if not re.fullmatch(r"[^\w\s]{1,2}", x.strip(" ")))

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.digest for r in preparation.normalised_texts(spark, sf_dir).collect()}
    assert got == {d: hashlib.md5(plain(t).encode()).hexdigest() for d, t in texts.items()}


def test_section_chunks_of_all_documents(spark, sf_dir):
    """A stack of headings and a running length, document by document."""
    rows = I.headings(I.lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))).collect()
    by_doc, want = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, own in by_doc.items():
        stack, last, chunks = [], None, []
        for r in sorted(own, key=lambda r: r.at):
            if r.heading_level is not None:
                level = min(r.heading_level, 6)
                stack = [(n, t) for n, t in stack if n < level] + [(level, r.line.strip(" "))]
            if r.blank:
                continue
            title = " > ".join(t for _, t in stack)
            if last is None or title != last:
                used, section = 0, []
                chunks.append((title, section))
            last = title
            used += len(r.line) + 1
            part = (used - 1) // 1500
            if not section or section[-1][0] != part:
                section.append((part, []))
            section[-1][1].append(r.line)
        flat = [(t, "\n".join(lines) if i == 0 or not t else "\n".join([t, *lines])) for t, section in chunks for i, (_, lines) in enumerate(section)]
        want |= {(d, i): x for i, x in enumerate(flat)}
    got = {(r.doc_id, r.chunk): (r.path, r.content) for r in preparation.section_chunks(spark, sf_dir).collect()}
    assert got == want


def test_neighbours_in_groups_of_any_size(spark):
    rows = [("a", i) for i in range(50)] + [("b", 1)] + [(None, i) for i in range(3)]
    frame = spark.createDataFrame(rows, "k string, v int")
    assert [r.row for r in numbered(frame, "k", "v").orderBy("k", "v").collect()] == list(range(54))
    got = {(r.k, r.v): (r.place, r.before, r.after) for r in with_neighbours(frame, ["k"], ["v"], "v").collect() if r.k}
    assert got["b", 1] == (1, None, None) and got["a", 0] == (1, None, 1) and got["a", 49] == (50, 48, None) and got["a", 7] == (8, 6, 8)


def test_shared_folder_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_contained_names_and_allowed_sets(spark):
    texts = spark.createDataFrame([(1, "see FILE12.txt now"), (2, "file1"), (3, None), (4, "")], "k int, t string")
    names = spark.createDataFrame([("file1",), ("File12.txt",), ("",), (None,)], "n string")
    assert sorted((r.k, r.n) for r in R.first_contained(texts, names, ["k"], "t", "n").collect()) == [(1, "File12.txt"), (1, "file1"), (2, "file1")]
    x = F.lit("src1")
    assert one(spark, R.in_allowed(x, ()), R.in_allowed(x, None), R.in_allowed(x, ("src1",)), R.in_allowed(x, ("b",))) == (False, True, True, False)
    assert one(spark, R.file_category(F.lit("mfa_policy.pdf")), R.file_category(F.lit("x.txt")), R.masthead(F.lit("ACME  Enterprise governance policy")), R.masthead(F.lit(None).cast("string"))) == ("security", "general", True, False)


def test_filters_values_and_json(spark):
    from datetime import datetime

    for bad in ({"start": datetime(2024, 2, 1), "end": datetime(2024, 1, 1)}, {"limit": 0}, {"limit": 366}, {"offset": -1}):
        with pytest.raises(ValueError):
            A.Filter(**bad)
    assert one(spark, A.printed(F.lit(2.345), "double"), A.printed(F.lit(True), "boolean"), A.printed(F.lit(None).cast("int"), "int"), A.humanised(F.lit("mean_value")), A.json_list(F.lit("[broken")), A.json_number(F.lit('{"n": "7"}'), "$.n"), A.json_number(F.lit('{"n": 7}'), "$.n")) == ("2.35", "Yes", "N/A", "Mean Value", [], None, 7.0)


def test_pairs_within_a_span(spark):
    a = spark.createDataFrame([(1, i * 50, i) for i in range(40)] + [(2, 0, 99)], "k int, s int, i int").selectExpr("k", "timestamp_seconds(s) AS t", "i")
    b = spark.createDataFrame([(1, j * 70 + 3, j) for j in range(30)], "k int, s int, j int").selectExpr("k", "timestamp_seconds(s) AS u", "j")
    got = sorted((r.i, r.j) for r in A.within(a, b, "k", "t", "u", 120).collect())
    assert got == sorted((i, j) for i in range(40) for j in range(30) if 0 < j * 70 + 3 - i * 50 <= 120)


def test_lists_and_tables(spark):
    table = "Name  Count  Share\nAlpha  1  5\nBeta  7  3\nGamma  2  9"
    texts = {1: f"intro\n- a\n  - b\n- c\n1. x\n2. y\n\n{table}\n2. Next  part", 2: "a  b\nc  d  e", 3: None, 4: "Document Id  Version\nwhat  this  is", 5: "One  Two\n" + "\n".join(f"a very long sentence that goes on and on {i}, and on; and more.  another one of the same kind, with; marks." for i in range(4))}
    rows = I.lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted((r.doc_id, r.start, r.ordered, r["items"], r.depth) for r in P.lists(rows).collect()) == [(1, 1, False, 3, 1), (1, 4, True, 2, 0), (1, 11, True, 1, 0)]
    found = {(r.doc_id, r.start): r for r in P.tables(rows).collect()}
    good = found[1, 7]
    assert good.headers == ["Name", "Count", "Share"] and good.data_rows == 3 and good.confidence >= V.TABLE_CONFIDENCE
    assert (5, 0) in found and found[5, 0].confidence < V.TABLE_CONFIDENCE and (2, 0) not in found


def test_departments_types_and_collections(spark):
    text, stem = F.lit("the budget and the fiscal year of hr policy"), F.lit("hr_policy")
    found = one(spark, K.departments(text, stem, R.file_category(stem)), K.departments(F.lit("nothing"), F.lit("x"), F.lit("general")), K.document_type(F.lit("an invoice, amount due"), F.lit("x")), K.document_type(F.lit("t"), F.lit("policy_of_x")), K.collections(F.array(F.lit("HR"), F.lit("Unknown")), F.lit("Invoice"), F.lit("research_x")))
    assert [(d["name"], round(d["score"], 3)) for d in found[0]] == [("HR", 0.9), ("Finance", 0.86)] and [d["name"] for d in found[1]] == ["Unknown"]
    assert tuple(found[2]) == ("Invoice", 0.95) and tuple(found[3]) == ("Policy", 0.94) and found[4] == ["hr", "finance", "research"]


def test_similar_sets_by_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(30)]
    sets = {f"s{i}": sorted(set(rng.sample(base, rng.randrange(1, 12)))) for i in range(120)} | {"t1": base, "t2": base[:27], "t3": base[:23]}
    got = {(r.x, r.y): r.share for r in K.similar_sets(spark.createDataFrame(list(sets.items()), "id string, terms array<string>"), 72).collect()}
    want = {(a, b): len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a in sets for b in sets if a < b}
    assert got == {k: v for k, v in want.items() if v >= 0.72} and ("t1", "t2") in got


def test_graph_with_hubs_chains_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(G, "DEGREE", 4)
    edges = [("hub", f"n{i}") for i in range(40)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [("n3", "c05"), ("x", "x"), ("y", "z")]
    frame = spark.createDataFrame([(a, b, "t", 0.9) for a, b in edges], "src string, dst string, type string, confidence double")
    got = dict(tuple(r) for r in G.components(frame).collect())
    assert got == {**{n: "c00" for e in edges[:-2] for n in e}, "y": "y", "z": "y"}
    assert G.components(frame.limit(0)).collect() == []
    found = G.expanded(frame.withColumn("type", F.lit("references")), spark.createDataFrame([("c00",)], "node string"), 2, 0.5)
    assert sorted((r.mode, r.node, r.depth, r.score) for r in found.collect()) == [("relationship", "c01", 1, round(0.9 * 1.15 / 2, 4)), ("relationship", "c02", 2, round(0.9 * 1.15 / 3, 4))]


def test_questions_prose_and_claims(spark):
    assert one(spark, P.question_of(F.lit("Loan Terms:"), F.lit("X")), P.question_of(F.lit("Is this so?"), F.lit("X")), P.question_of(F.lit("the KYC Rules"), F.lit("X")), P.question_of(F.lit("."), F.lit("X")), P.prose_of(F.lit("Owner : the board..")), P.prose_of(F.lit("no label"))) == ("Explain the loan terms.", "Is this so?", "Explain the KYC rules.", "What does X cover?", "Owner is the board.", None)
    frame = spark.createDataFrame([(1, "The quick brown fox jumps over dogs. Totally different words without support here! short.", "quick brown fox jumps")], "k int, a string, e string")
    assert [(r.place, r.support) for r in P.claims(frame, ["k"], "a", "e").orderBy("place").collect()] == [(0, "supported"), (1, "unsupported")]


def test_life_of_documents(spark):
    from lodestack.operators import lifecycle as L

    docs = spark.createDataFrame([(1, "failed"), (2, "indexed"), (3, "retry_pending"), (4, None)], "doc_id long, status string")
    changed, events = L.retried(docs, spark.createDataFrame([(1,), (1,), (2,), (9,)], "doc_id long"))
    assert dict(tuple(r) for r in changed.collect()) == {1: "retry_pending", 2: "indexed", 3: "retry_pending", 4: None}
    assert dict(tuple(r) for r in events.collect()) == {1: "scheduled", 2: "not_eligible", 9: "not_found"}
    assert dict(tuple(r) for r in L.removed(docs, docs.where("doc_id = 2")).collect())[2] == "deleted"
    turns = spark.createDataFrame([(1, "user", "a"), (1, "assistant", "b"), (2, "user", "a"), (2, "system", "x"), (3, "user", None)], "conv_id int, role string, text string")
    kept, refused = L.imported(turns)
    assert kept.count() == 2 and sorted(r.conv_id for r in refused.collect()) == [2, 3]
    rows = spark.createDataFrame([("t", i, 30) for i in range(10)] + [("u", 0, 500)], "k string, i int, s int")
    assert sorted(tuple(r) for r in L.batches(rows, ["k"], F.col("i"), F.col("s"), 10, 100).collect()) == [("t", 0, 3, 100), ("t", 1, 3, 100), ("t", 2, 3, 100), ("t", 3, 1, 40), ("u", 0, 1, 510)]
    with pytest.raises(RuntimeError, match="stage second"):
        L.through(docs, [("first", lambda d: d.where("doc_id > 0")), ("second", lambda d: d.select("nothing"))])
    pairs = spark.createDataFrame([("a b", "b c"), ("x", "y")], "l string, r string")
    model = lambda: lambda a, b: [float(len(set(x.split()) & set(y.split()))) for x, y in zip(a, b)]
    assert [r.score for r in L.scored_by(pairs, model, "l", "r").collect()] == [1.0, 0.0]


def test_names_in_texts_are_the_plain_ones(spark):
    import random

    from lodestack.operators import relational as R

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("aAbB \n.") for _ in range(n))
    texts = [(i, word(rng.randrange(40))) for i in range(60)] + [(90, None), (91, ""), (92, "x😀abba"), (92, "aba")]
    names = [word(rng.randrange(1, 5)) for _ in range(40)] + ["", None, "😀a", "AB", "ab", "aB"]
    want = sorted({(k, n) for k, t in texts for n in names if n and t is not None and n.lower() in t.lower()})
    t, n = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(x,) for x in names], "n string")
    for most in (100_000, 3):
        assert sorted((r.k, r.n) for r in R.first_contained(t, n, ["k"], "t", "n", most).collect()) == want
        assert R.first_contained(t, n.limit(0), ["k"], "t", "n", most).count() == 0
        assert R.first_contained(t.limit(0), n, ["k"], "t", "n", most).count() == 0


def test_plan_intents_beside_letters_beyond_ascii(spark, tmp_path):
    """A letter with marks, or of another script, is no border of a word, in the query and in its SQL."""
    import duckdb

    texts = ["Under\u00fcau it\u00df hr", "\u00e9it under", "\u0436it it\u0436", "\u0663it v2", "it. \u00fc it \u2014hr\u2014", "\u212aeyword keyword"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in passages.plan_intents(spark, str(tmp_path)).collect())
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert got == sorted(c.sql(registry.oracle_sql()["plan_intents"]).fetchall())
    assert {(r[0], r[2]) for r in got} >= {(1, "navigation"), (4, "department_search"), (5, "keyword_search")} and not [r for r in got if r[0] == 2 and r[2] == "department_search"]


def test_collections_have_a_short_plan(spark, sf_dir):
    """Rules of departments and types stand in a plan once; copies of them in each other had it at 17 million signs."""
    for name in ("registry_statistics", "collection_assignment"):
        assert len(registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()) < 300_000


def test_letters_to_be_folded_are_looked_for_behind_a_range(spark):
    """Of texts with other letters than ASCII, each place was tried with all sixteen letters, and texts took four times as long to become words."""
    assert re.match(r".\|\[.-.&&\[", X.FOLDED)
    letters = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(i, f"a{c}B") for i, c in enumerate(letters)], "i int, t string")
    found = {r.i for r in rows.where(F.col("t").rlike(X.FOLDED)).collect()}
    assert found == {i for i, c in enumerate(letters) if c in V.FOLDS}
    both = rows.select(X.folded(F.col("t")).alias("new"), F.expr(X.folded_sql("t")).alias("sql"))
    assert both.where("new <> sql").isEmpty()
