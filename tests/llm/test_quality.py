import zlib

import numpy as np
import pyarrow as pa

from lodestack.llm import op7_quality
from lodestack.llm.quality import held_out, train, training_rows, with_scores
from lodestack.llm import subword
from lodestack.llm.subword import SubwordClassifier, repeats, split

ODD = ["", None, " \t\n", "a", "word " * 3000, "x" * 50_000, "é ß 字 😀", "a a b a a"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op7_quality.run(spark, sf).toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.7)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    mine = rows[rows.held_out].merge(labels, on="doc_id")
    assert len(mine) > 50 and (mine.predicted == mine.quality).mean() > 0.95


def plain_features(word, buckets, low=2, high=4):
    """The word and all its n-grams between marks, one by one."""
    marked = [ord(c) for c in f"<{word}>"]
    out = [zlib.crc32(word.encode()) % buckets]
    for n in range(low, high + 1):
        for i in range(len(marked) - n + 1):
            h = 0
            for c in marked[i : i + n]:
                h = (h * 0x100000001B3 + c + 1) % 2**64
            out.append(((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 32) % buckets)
    return out


def test_every_ngram_of_every_word_counts(monkeypatch):
    words = ["", "a", "word", "é字😀", "x" * 130, "ab" * 500, "".join(chr(97 + i * i % 26) for i in range(5003))]
    for piece in (500_000, 1000, 64):
        monkeypatch.setattr(subword, "PIECE", piece)
        got = [[] for _ in words]
        for rows, owners in subword.features(words, 4096, 2, 4):
            for r, o in zip(rows.tolist(), owners.tolist(), strict=True):
                got[o].append(r)
        assert [sorted(g) for g in got] == [sorted(plain_features(w, 4096)) for w in words]
        assert subword.n_features(words, 2, 4).tolist() == [len(g) for g in got]


def test_learning_agrees_with_plain_loops():
    """One document a step, on plain lists: the same sums as the batched ones."""
    texts, labels = ["good fine words here", "bad bad ### bad", "fine good sea", "### bad tree"], [1, 0, 1, 0]
    model = SubwordClassifier(buckets=64, dim=3, examples=12, batch=1, rate=0.5).fit(pa.array(texts), np.array(labels))
    rng = np.random.default_rng(11)
    vectors = (rng.random((64, 3)) - 0.5) / 3
    out, offset, done = np.zeros((3, 2)), np.zeros(2), 0
    for _ in range(3):
        for i in rng.permutation(np.arange(4)):
            ws = texts[i].split()
            f = [x for w in ws for x in plain_features(w, 64)] + [zlib.crc32(b"a word with itself") % 64] * sum(a == b for a, b in zip(ws, ws[1:]))
            mean = sum(vectors[x] for x in f) / len(f)
            logit = mean @ out + offset
            p = np.exp(logit) / np.exp(logit).sum()
            p[labels[i]] -= 1
            step = 0.5 * (1 - done / 12)
            back = out @ p
            out = out - step * np.outer(mean, p)
            offset = offset - step * p / 4
            for x in f:
                vectors[x] = vectors[x] - step * back / len(f)
            done += 1
    # The step for the document's vectors uses the output layer as it was before this step.
    assert np.allclose(model.weights, vectors @ (out[:, 1] - out[:, 0]), atol=1e-4) and abs(model.bias - (offset[1] - offset[0])) < 1e-4


def test_scores_are_the_sum_over_features():
    texts = pa.array(["good fine words", "bad bad bad ###", "fine good", "### bad", *ODD])
    model = SubwordClassifier(buckets=512, examples=300).fit(texts, np.array([1, 0, 1, 0, 1, 1, 0, 1, 0, 0, 1, 0]))
    got = model.scores(texts)
    for t, s in zip(texts.to_pylist(), got, strict=True):
        words = (t or "").split()
        f = [x for w in words for x in plain_features(w, 512)]
        f += [zlib.crc32(b"a word with itself") % 512] * sum(a == b for a, b in zip(words, words[1:]))
        want = 1 / (1 + np.exp(-(model.weights[f].astype(float).sum() / len(f) + model.bias))) if f else model.empty
        assert abs(s - want) < 1e-6
    assert got[0] > 0.5 > got[1] and got[4] == got[5] == got[6] == model.empty
    again = SubwordClassifier(buckets=512, examples=300).fit(texts, np.array([1, 0, 1, 0, 1, 1, 0, 1, 0, 0, 1, 0]))
    assert (again.scores(texts) == got).all()
    assert np.allclose(np.concatenate([model.scores(texts.slice(i, 1)) for i in range(len(texts))]), got)


def test_words_and_repeats():
    words, place, ends = split(pa.array([" a  b", "", "b b", None, "b"]))
    assert [words[i].as_py() for i in place] == ["a", "b", "b", "b", "b"] and ends.tolist() == [2, 2, 4, 4, 5]
    assert repeats(place, ends).tolist() == [False, False, False, True, False]


def test_sample_is_bounded_and_never_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(7, "again"), (None, "n"), (8, "x" * 500_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(200)] + [(1, None), (None, 1), (4, 0), (4, 1)], "doc_id long, quality int")
    rows = training_rows(docs, labels, "quality", rows=40).collect()
    assert len({r.id for r in rows}) == 40 and {r.label for r in rows} <= {0, 1}
    ids = {int(r.text.split()[1]) for r in rows if r.text.startswith("text")}
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 and i % 3 < 2 for i in ids)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(ODD)] + [(None, "a", 1.0), (3, "a", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    got = with_scores(docs, train(docs, labels))
    rows = got.select("*", held_out(got.doc_id).alias("h")).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows) and got.columns == ["doc_id", "text", "score"]
    assert [r.h for r in rows if r.doc_id is None] == [False]
    none = train(docs, labels.limit(0))
    assert {r.score for r in with_scores(docs, none).collect()} == {0.5}
    assert with_scores(docs.limit(0), none).collect() == []
