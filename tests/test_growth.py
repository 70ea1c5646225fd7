"""Queries whose shuffles or memory grew faster than their input."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestack.functions.fixed import CONCEPTS
from lodestack.operators import knowledge as K
from lodestack.plans import knowledge, lifecycle, reporting


def test_repeated_ngrams_counts_only_what_may_repeat(spark, tmp_path):
    rows = [(1, "a b c d e " * 4 + "x y z"), (2, "one two three four five six"), (3, None), (4, ""), (5, "k l m n o p k l m n o q"), (5, "k l m n o"), (5, None), (None, "r s t u v " * 3), (None, "r s t u v")]
    rows += [(6, "s " * 9), (7, "f g h i j f g h i j")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = knowledge.repeated_ngrams(spark, str(tmp_path))
    want = Counter()
    for key, text in rows:
        w = re.findall("[a-z0-9]+", text or "")
        want.update((key, " ".join(w[i : i + 5])) for i in range(len(w) - 4))
    assert {(r.doc_id, r.gram): r.n for r in df.collect()} == {k: n for k, n in want.items() if n >= 3} and want[5, "k l m n o"] == 3
    assert "array_sort" in df._jdf.queryExecution().optimizedPlan().toString(), "runs are not handed on one by one"


def test_approximate_users_keeps_a_sketch_for_each_type(spark, sf_dir):
    df = reporting.approximate_users(spark, sf_dir)
    steps = re.findall(r"Aggregate\(keys=\[(.*?)\], functions=\[(.*?)\]", df._jdf.queryExecution().executedPlan().toString())
    assert steps and not [keys for keys, functions in steps if "user_id" in keys and "approx_count_distinct" in functions]
    assert df.count() > 1 and df.where("NOT near").isEmpty()


def test_taxonomy_paths_search_each_text_once(spark, sf_dir):
    plan = lifecycle.taxonomy_prefix_pairs(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and len(plan) < 50_000


def test_concepts_are_those_of_the_patterns(spark):
    texts = ["budgets", "xbudget", "budgetx of budgeting.", "multi-factor authentication, 2fa", "the leaves", "sleave", "paid leave2", "expenses; wfh", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", K.concepts(F.col("t")).alias("c"))
    want = {i: [n for n, a in CONCEPTS if re.search("(?<![a-z0-9])(?:" + "|".join(a) + ")(?![a-z0-9])", t or "")] for i, t in enumerate(texts)}
    assert {r.i: r.c for r in rows.collect()} == want


def test_sets_that_share_rare_words_only_do_not_meet(spark):
    """All pairs that share a rare word went on to a comparison of whole sets."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    sets = [set(rng.sample(words, rng.randrange(1, 60))) for _ in range(150)]
    for s in list(sets[:60]):
        sets.append((s - set(rng.sample(sorted(s), len(s) // 8))) | set(rng.sample(words, len(s) // 8)))
    table = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, terms array<string>")
    close = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 72 * len(sets[i] | sets[j])}
    met = {(r.x, r.y) for r in K.meetings(table, 72).collect()}
    assert len(close) > 40 and close <= met and len(met) < len(close) + 60
    assert {(r.x, r.y) for r in K.similar_sets(table, 72).collect()} == close
