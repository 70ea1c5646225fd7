import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import op4_personal, personal
from lodestack.llm.personal import KINDS, findings, near_words, personal_data, sanitise

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = (
                True,
                k == 1 and all(int(x[-4:]) <= 255 and not x[:-3].strip("0") for x in m.group().split(".")),
                14 <= len(digits) <= 19 and sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits))) % 10 == 0,
                10 <= len(digits) <= 15,
            )[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


ODD = [
    "", "a@b", "a@b.c", "x.a@b.c-%d@e.f.", "a@@b.c", "@b.c", "a@b.c.d@e.f", "a@b.c@d.e", "é@b.cé", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "0001.02.3.255", "1.2.3", "12.3.4.5x",
    "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111111111111111", "41111111111111112", "4 1 1", "+1 (415) 555-0100", "+1415555", "+4915112345678 +4915112345679", "+1 2 3 4 5 6 7 8 9 0 -", "++1 23456789012", "+1234567890123456",
    "😀 a@b.c 1.2.3.4 +14155550100", "a" * 300 + "@" + "b" * 300 + ".c", "1" * 5000, "1." * 300, "+" + "1(" * 300, "@" * 300, ("a@b.c," * 50), "9" * 5000 + ".1.1.1",
]


def test_patterns_agree_with_plain_ones():
    for text in ODD:
        assert findings(text) == brute(text), text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.2@-+ (5é%_", max_size=60))
def test_patterns_agree_on_any_text(text):
    assert findings(text) == brute(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 200_000, "1." * 200_000, "+1 " * 100_000, "a." * 100_000 + "@", "1 " * 200_000, "+1" + "(" * 400_000):
        findings(text)


def test_words_near_findings():
    text = "one two a@b.c three four 1.2.3.4 five"
    got = near_words(text, findings(text))
    assert {(t, k) for t, k, _, _ in got} == {(t, k) for t in ("one", "two", "three", "four", "five") for k in (0, 1)}
    assert all(text[a:b].lower() == t for t, _, a, b in got)
    far = "born" + " " * 250 + "a@b.c " + "y" * 300 + " - " * 500 + "end"
    assert [t for t, _, _, _ in near_words(far, findings(far))] == ["born", "y" * 300, "end"]


def test_query_agrees_with_brute_force(spark, sf_dir):
    rows = op4_personal.run(spark, sf_dir).collect()
    docs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert sum(r.n_email + r.n_phone for r in rows) > 0
    for r in rows:
        want = brute(docs[r.doc_id])
        line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in want) for k in range(4)]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term:")] == [s for s in line.split(",") if s]


def corpus():
    docs = [(i, f"mail lena at lena{i}@home.example.org today") for i in range(30)]
    docs += [(10_000 + i, f"today at the market {i} people met and mail came") for i in range(3000)]
    docs += [(500, "mail lena"), (501, None), (502, ""), (None, "lena wrote lena@home.org"), (503, "call +4915112345678 now"), (504, "lena lena@x.org"), (504, "lena lena@x.org")]
    return docs


def test_disclosing_terms_by_brute_force(spark):
    docs = corpus()
    near, count, places = Counter(), Counter(), Counter()
    for _, t in docs:
        words = [m.group().lower() for m in re.finditer(r"[^\W\d_]+", t or "")]
        count.update(words)
        for w, k, _, _ in near_words(t or "", findings(t or "")):
            near[w, k] += 1
            places[k] += 1
    total = sum(count.values())
    share = {x: 1 + math.log2(n / count[x[0]]) / -math.log2(places[x[1]] / total) for x, n in near.items() if n >= 5}
    want = {w for (w, _), s in share.items() if s >= 0.8}
    assert "lena" in want and "today" not in want and "at" not in want
    frame = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, terms string")
    rows = personal_data(frame, support=5).collect()
    assert len(rows) == len(docs)
    texts = {}
    for d, t in docs:
        texts.setdefault(d, t or "")
    for r in rows:
        t = texts[r.doc_id]
        assert {t[s.start : s.end].lower() for s in r.terms} == {w for w, k, _, _ in near_words(t, findings(t)) if share.get((w, k), 0) >= 0.8}
    assert not [r for r in rows if r.doc_id == 500][0].terms


def test_sanitised_texts(spark, monkeypatch):
    monkeypatch.setattr(personal, "BROADCAST_TERMS", 0)
    frame = spark.createDataFrame(corpus(), "doc_id long, text string")
    out = {r.doc_id: r.sanitised for r in sanitise(frame, support=5, remove=2.0).collect()}
    assert out[501] is None and out[502] == "" and out[500] == "mail lena" and out[503] == "call <PHONE> now"
    assert out[504] == "<TERM> <EMAIL>" and "lena" not in out[3] and "<EMAIL>" in out[3] and "today" in out[3]
    gone = {r.doc_id: r.sanitised for r in sanitise(frame, support=5, remove=0.8).collect()}
    assert gone[504] == " <EMAIL>"
    assert sanitise(frame.limit(0)).collect() == [] and personal_data(frame.limit(0)).collect() == []


def people():
    docs = [(i, f"{'filler ' * 20}{'uvwxyz'[i] * 4} lena {'uvwxyz'[i] * 3} {'filler ' * 20} asked {'uvwxyz'[i] * 5} of lena.k@home.example.org number {i}") for i in range(6)]
    docs += [(100 + i, f"note from user{i}@mail.example.org on daily matters {'abcdefgh'[i % 8] * 3}") for i in range(40)]
    docs += [(1000 + i, f"daily matters and note filler on text {i} went on from {'abcdefgh'[i % 8] * 3}") for i in range(800)]
    docs += [(4000, "a call by Orbanek, +4915112345678, came\nsecond line"), (4001, "Orbanek left"), (4002, "met Silvan silvan.t@x.example.org"), (4003, "met hapax once@y.example.org"), (4004, "line of Farword\n4111 1111 1111 1111")]
    docs += [(6000 + i, f"{'abcdefgh'[i] * 9} in the end a copy came with words and more by Kestrel kestrel@z.example.org and all of it went on from there {'xyz'[i % 3] * 7}") for i in range(8)]  # near copies
    return [*docs, (5000, "we met Lena there, LENA left"), (5001, None), (5002, "only once@x.example.org hapax"), (5002, "only once@x.example.org hapax")]


def told_by_brute_force(docs, least=0.8):
    """{term: share}, by plain counting of blocks."""
    n_blocks, with_term, of, strong, far = sum((t or "").count("\n") + 1 for _, t in docs), Counter(), Counter(), {}, {}
    for t in {t or "" for _, t in docs}:
        found = brute(t)
        for begin, line in zip([0, *(m.end() for m in re.finditer("\n", t))], t.split("\n"), strict=True):
            own = [(a - begin, k, b - begin) for a, k, b in found if begin <= a < begin + len(line)]
            words = [m for m in re.finditer(r"[^\W\d_]+", line) if not any(m.start() < b and a < m.end() for a, _, b in own)]
            low = [m.group().lower() for m in words]
            seen = [(tuple(low[max(0, i - 3) : i + 4]), min(i, 3)) for i in range(len(low))]
            blocks = {}
            for at in range(0, max(1, len(low)), 64):
                with_term.update(set(low[at : at + 64]))
            for a, k, b in own:
                i = sum(m.end() <= a for m in words)
                value = line[a:b].lower() if k == 0 else re.sub(r"\D", "", line[a:b]) if k > 1 else line[a:b]
                n = max(0, min(i, len(low) - 1)) // 64
                blocks.setdefault(n, set()).add((k, value))
                local = {w for w in re.findall(r"[^\W\d_]+", line[a:b].lower().split("@")[0]) if len(w) > 2} if k == 0 else set()
                for j in range(max(0, i - 3), min(len(low), i + 3)):
                    if words[j].group()[0].isupper() or low[j] in local:
                        for c in ((k, value), (k, None)):
                            strong.setdefault((low[j], c), (set(), set()))[0].add((t, begin, n))
                            strong[low[j], c][1].add(seen[j])
            for n, held in blocks.items():
                of.update(held)
                of.update((k, None) for k, _ in held)
                for w in set(low[n * 64 : n * 64 + 64]):
                    first = low.index(w, n * 64)
                    for c in held | {(k, None) for k, _ in held}:
                        far.setdefault((w, c), (set(), set()))[0].add((t, begin, n))
                        far[w, c][1].add(seen[first])
    out = {}
    for pairs, prior in ((strong, 0.5), (far, 3.0)):
        for (w, c), (both, sightings) in pairs.items():
            information = math.log2(n_blocks / of[c])
            p = len(both) / with_term[w] * len(sightings) / (len(sightings) + prior)
            if information > 0 and p >= 0.5 and 1 + math.log2(p) / information >= least and (prior < 1 or of[c] >= 3):
                out[w] = max(out.get(w, 0), 1 + math.log2(p) / information)
    return out


def test_defaults_find_a_name_by_its_address_and_everywhere(spark, monkeypatch):
    docs = people()
    want = told_by_brute_force(docs)
    assert {"lena", "asked", "silvan", "kestrel"} <= set(want) and not set(want) & {"daily", "matters", "note", "filler", "hapax", "only", "farword", "orbanek", "words", "more", "met"}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    texts = {d: t or "" for d, t in docs}
    for terms, rows in ((200_000, 1_000_000), (0, 0)):
        monkeypatch.setattr(personal, "BROADCAST_TERMS", terms)
        monkeypatch.setattr(personal, "BROADCAST_ROWS", rows)
        found = personal_data(frame).collect()
        assert len(found) == len(docs)
        for r in found:
            t = texts[r.doc_id]
            inside = [(s.start, s.end) for s in r.base]
            spots = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if m.group().lower() in want and not any(m.start() < b and a < m.end() for a, b in inside)]
            assert [(s.start, s.end) for s in r.terms] == spots
            assert all(abs(s.share - want[t[s.start : s.end].lower()]) < 1e-9 for s in r.terms)
    out = {r.doc_id: r.sanitised for r in sanitise(frame, remove=2.0).collect()}
    assert out[5000] == "we met <TERM> there, <TERM> left" and "lena" not in out[0] and out[5001] is None


def test_defaults_on_the_given_tables_find_planted_names(spark):
    """Names put beside an address or number in a copy of the documents: which of them are found, and what else is."""
    rng = random.Random(11)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    before = {w for w in told_by_brute_force(docs)}
    assert before  # the defaults disclose terms of the given documents, too
    syllables = ["zor", "vik", "pel", "lan", "tok", "mir", "quu", "bex", "dal", "fyn", "gro", "hux"]
    names = {(i, j): "".join(rng.sample(syllables, 3)).capitalize() + "abcdefghij"[i % 10] + "klmnop"[i // 10] for i in range(60) for j in (0, 1)}
    spots = rng.sample(range(len(docs)), 150)

    def put(at, words):
        d, t = docs[at]
        lines = (t or "").split("\n")
        n = rng.randrange(len(lines))
        lines[n] = f"{lines[n]} {words}"
        docs[at] = d, "\n".join(lines)

    for i in range(60):
        value = rng.choice([f"{names[i, 0].lower()}.{i}@post.example.org", f"user{i}@post.example.org", f"+49151123456{i:02d}"])
        put(spots.pop(), f"the {names[i, 0]} {names[i, 1]} {value} and of")
        if i % 3 == 0:  # a second document with both, and one with the name alone
            put(spots.pop(), f"is {value} {names[i, 0]} {names[i, 1]} it")
            put(spots.pop(), f"with {names[i, 0]} {names[i, 1]} by")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    texts = {}
    for d, t in docs:
        texts[d] = t or ""
    told = {texts[r.doc_id][s.start : s.end].lower() for r in personal_data(frame).where(F.size("terms") > 0).collect() for s in r.terms}
    planted = {n.lower() for n in names.values()}
    precision, recall = len(told & planted) / len(told), len(told & planted) / len(planted)
    print(f"precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.9 and recall > 0.9


def test_a_directory_makes_no_words_times_values():
    text = "\n".join(f"{'abcdefghijklmnopqrstuvwxyz'[i % 26] * (1 + i // 26)} user{i}@mail.example.org" for i in range(2000))
    found = personal.sighted(text, findings(text))
    assert sum(len(b["held"]) * len(b["words"]) for b in found) <= 2000
    text = text.replace("\n", " ")
    found = personal.sighted(text, findings(text))
    assert sum(len(b["held"]) * len(b["words"]) for b in found) <= 64 * 2000


def test_terms_in_other_scripts_are_counted_as_they_are_told(spark):
    """Lower case of a word depends on its end (sigma), and may have another length (dotted I)."""
    docs = [(i, f"{w} user{i}@x{i}.gr") for i in range(40) for w in ["ΚΩΔΙΚΟΣ" if i % 2 else "İSTANBUL"]]
    docs += [(1000 + i, f"plain text number {'abcdefgh'[i % 8] * (1 + i // 8)}") for i in range(2000)] + [(5000, "a ΚΩΔΙΚΟΣ stands here, an İSTANBUL too")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    texts = dict(docs)
    for how in ({}, {"support": 5}):
        told = {texts[r.doc_id][s.start : s.end] for r in personal_data(frame, **how).where("doc_id < 1000").collect() for s in r.terms}
        assert told == {"ΚΩΔΙΚΟΣ", "İSTANBUL"}, how
