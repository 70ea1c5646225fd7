"""Personal data in texts, and the terms around it that give it away.

Base findings are e-mail addresses, IP addresses, card and phone numbers by fixed patterns. Other terms may disclose what
was protected. How strongly is estimated from the whole corpus, by blocks: the lines of texts, in stretches of at most BLOCK words, equal texts once.
With p(c) the share of blocks that hold c, which is a protected value or a whole kind, the information of c is -log p(c), and
a term t discloses PMI(t; c) = log p(c | t) / p(c) of it. For p(c | t) stands q s / (s + a): q is the share of the term's
blocks that are the value's too; s are its different sightings there, known by the words on either side, so that near copies
are one sighting; and a is the prior's weight in sightings. A sighting CLOSE words or less from the value, by a word that is written as a name
or stands in the address itself, is strong, and one of them is enough (a = PRIOR_STRONG); elsewhere in the block it takes three
that never fail (a = PRIOR). A term that discloses a set share of the information and leaves no more than LEFT bits of it is
generalised wherever it stands, and removed from a higher share on.

With a given support, the former narrower way is taken instead: words near findings of a kind, over word places, from
so many on, and spans only there.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import memory
from lodestack.llm.store import OWN, require, without, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Fixed patterns of the contract, written so that each is linear in the text.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Words on either side of a finding that count as near it, where a support is given.
NEAR_WORDS = 8
#: Runs of letters.
WORD = re.compile(r"[^\W\d_]+")
#: Bytes to small letters, and all that are no letters to blanks: the words of texts of ASCII alone.
PLAIN_LETTERS = bytes(c | 32 if chr(c).isalpha() else 32 for c in range(128)) + b" " * 128
#: So few wanted terms are looked for as parts of a text before its words are. Letters whose lower case depends on others.
FEW, BOUND_LETTERS = 64, re.compile("[Σİ]")
#: One in so many texts is counted first. Terms that a counting task holds before it hands counts on.
FIRST, HELD_TERMS = 16, 500_000
#: Words in a block, at most; words on either side by which a sighting is known; words between a value and a strong sighting, itself included.
BLOCK, AROUND, CLOSE = 64, 3, 3
#: Weight of the prior, in sightings, against strong sightings and against others; bits of a value that a term may leave unknown.
PRIOR_STRONG, PRIOR, LEFT = 0.5, 3.0, 1.0
#: Shares of a kind's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.8, 0.95
#: More wanted terms than this are not sent to the counting tasks (then all terms are counted), nor more disclosing ones to the
#: locating tasks (then they are joined).
BROADCAST_TERMS = 200_000
#: Hashes of repeated texts, and repeated values, up to this many are broadcast; the count is checked.
BROADCAST_ROWS = 1_000_000

BASE = "array<struct<start:int,kind:int,end:int>>"
NEAR = "array<struct<term:string,kind:int,start:int,end:int>>"
TERMS = "array<struct<start:int,kind:int,end:int,share:double>>"
KEY = [f"{OWN}id", f"{OWN}hash"]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From every @: back over the local part, not into the last match, and on over the domain."""
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at) if begin < at else None
        if found:
            done = found.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base findings, sorted; offsets are code points."""
    if not any(c in text for c in "@0123456789"):
        return []
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def near_words(text: str, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int]]:
    """(term, kind, start, end) of the NEAR_WORDS words on either side of each finding, however far, that are in none; a word counts once for a kind."""
    words = [m.span() for m in WORD.finditer(text)]
    begins, stops = [a for a, _ in words], [b for _, b in words]
    spots: dict[tuple[int, int, int], None] = {}
    for start, kind, end in found:
        before, after = bisect_right(stops, start), bisect_left(begins, end)
        spots.update(((a, kind, b), None) for a, b in words[max(0, before - NEAR_WORDS) : before] + words[after : after + NEAR_WORDS])
    outside = set(outside_words(text, found))
    return [(text[a:b].lower(), kind, a, b) for a, kind, b in spots if (a, b) in outside]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    near_type = pa.list_(pa.struct([("term", pa.string()), ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        base, near = [], []
        for text in batch.column(batch.num_columns - 1):
            text = text.as_py()
            found = findings(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            near.append([{"term": t, "kind": k, "start": a, "end": b} for t, k, a, b in near_words(text, found)] if found else [])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base, base_type), pa.array(near, near_type)], names=[*batch.schema.names[:-1], "base", "near"])


def _counting(wanted):
    """Counts of the wanted words of letters (all, if None) in lower case, and of all under the empty word."""

    def run(batches):
        keep = None if wanted is None else frozenset(wanted.value)
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                seen.update(WORD.findall(text.as_py()))
            own: Counter = Counter()
            for word, n in seen.items():  # lower case as of the terms near findings, word by word
                own[word.lower()] += n
            rows = [(t, n) for t, n in own.items() if keep is None or t in keep]
            yield pa.RecordBatch.from_arrays([pa.array([*[t for t, _ in rows], ""], pa.string()), pa.array([*[n for _, n in rows], sum(own.values())], pa.int64())], names=["term", "n"])

    return run


def disclosing(docs: DataFrame, scanned: DataFrame, text_col: str, support: int, generalise: float = GENERALISE) -> DataFrame:
    """(term, kind, share): the terms that stand near a kind at least support times and disclose at least the share generalise of it."""
    spark = docs.sparkSession
    near = scanned.select(F.explode("near").alias("w")).groupBy("w.term", "w.kind").agg(F.count("*").alias("n_near"))
    near = written(near, "personal-near")
    places = dict(near.groupBy("kind").agg(F.sum("n_near")).collect())  # four kinds at most
    wanted = near.where(F.col("n_near") >= support)
    terms = [r.term for r in wanted.select("term").distinct().limit(BROADCAST_TERMS + 1).collect()]
    held = spark.sparkContext.broadcast(terms) if len(terms) <= BROADCAST_TERMS else None
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = written(texts.mapInArrow(_counting(held), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "personal-counts")
    total = counts.where("term = ''").agg(F.max("n")).first()[0] or 0
    p_kind = F.element_at(F.create_map(*[x for k in range(len(KINDS)) for x in (F.lit(k), F.lit(max(places.get(k, 1), 1) / max(total, 1)))]), F.col("kind"))
    information = -F.log2(p_kind)
    share = 1 + F.log2(F.least(F.col("n_near") / F.col("n"), F.lit(1.0))) / information
    told = wanted.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.raise_error(F.concat(F.lit("no count of the term "), F.col("term"))).cast("long")))
    return told.where(information > 0).select("term", "kind", share.alias("share")).where(F.col("share") >= generalise)


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias(KEY[0]), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(KEY[1])]


def value_of(text: str, kind: int) -> str:
    """A finding as the value that it stands for, however it is written."""
    if kind == 0:
        return text.lower()
    if kind == 1:
        return ".".join(x.lstrip("0") or "0" for x in text.split("."))
    return "".join(c for c in text if c in "0123456789")


def outside_words(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the words that no finding touches."""
    out, i, reach = [], 0, 0
    for m in WORD.finditer(text):
        while i < len(found) and found[i][0] < m.end():
            reach = max(reach, found[i][2])
            i += 1
        if reach <= m.start():
            out.append(m.span())
    return out


def terms_of(text: str, found: list[tuple[int, int, int]]) -> set[str]:
    """The different words that stand somewhere out of findings, in lower case, word by word."""
    if found:
        return {text[a:b].lower() for a, b in outside_words(text, found)}
    return set(text.encode().translate(PLAIN_LETTERS).decode().split()) if text.isascii() else {w.lower() for w in set(WORD.findall(text))}


def block_terms(text: str, found: list[tuple[int, int, int]]) -> Iterator[set[str]]:
    """The different terms of each block of a text, out of findings."""
    if found:
        yield from ({t for t, _, _ in words[at : at + BLOCK]} for words, _ in _lines(text, found) for at in range(0, len(words), BLOCK))
        return
    for line in text.split("\n"):
        words = [w.lower() for w in WORD.findall(line)]
        yield from (set(words[at : at + BLOCK]) for at in range(0, len(words), BLOCK))


def _lines(text: str, found: list[tuple[int, int, int]]) -> Iterator[tuple[list[tuple[str, int, int]], list[tuple[int, int, int]]]]:
    """Each line's (term, start, end) out of findings, and its findings."""
    words, at, f, begin = outside_words(text, found), 0, 0, 0
    while begin <= len(text):
        end = text.find("\n", begin)
        end = len(text) if end < 0 else end
        first, first_found = at, f
        while at < len(words) and words[at][0] < end:
            at += 1
        while f < len(found) and found[f][0] < end:
            f += 1
        yield [(text[a:b].lower(), a, b) for a, b in words[first:at]], found[first_found:f]
        begin = end + 1


def _sighting(words: list[tuple[str, int, int]], i: int) -> int:
    """A sighting as the word and those around it in its line."""
    seen = " ".join(t for t, _, _ in words[max(0, i - AROUND) : i + AROUND + 1]) + f" {min(i, AROUND)}"
    return int.from_bytes(hashlib.blake2b(seen.encode(), digest_size=8).digest(), "little", signed=True)


def sighted(text: str, found: list[tuple[int, int, int]]) -> list[dict]:
    """For each block with findings: held, its different (kind, value); words, each term with its first sighting; strong, (term, kind, value, sighting)."""
    out = []
    for words, own in _lines(text, found):
        blocks: dict[int, dict] = {}
        stops = [b for _, _, b in words]
        for start, kind, end in own:
            i = bisect_right(stops, start)  # words before the finding
            value, block = value_of(text[start:end], kind), blocks.setdefault(max(0, min(i, len(words) - 1)) // BLOCK, {"held": set(), "strong": set()})
            block["held"].add((kind, value))
            local = {w.lower() for w in WORD.findall(text[start:end].partition("@")[0]) if len(w) > 2} if kind == 0 else ()
            for j in range(max(0, i - CLOSE), min(len(words), i + CLOSE)):
                term, a, _ = words[j]
                if text[a].isupper() or term in local:
                    block["strong"].add((term, kind, value, _sighting(words, j)))
        for n, block in sorted(blocks.items()):
            first: dict[str, int] = {}
            for j in range(n * BLOCK, min(len(words), (n + 1) * BLOCK)):
                first.setdefault(words[j][0], j)
            out.append(
                {
                    "held": [{"kind": k, "value": v} for k, v in sorted(block["held"])],
                    "words": [{"term": t, "seen": _sighting(words, j)} for t, j in first.items()],
                    "strong": [{"term": t, "kind": k, "value": v, "seen": x} for t, k, v, x in sorted(block["strong"])],
                }
            )
    return out


BLOCKS = "array<struct<held:array<struct<kind:int,value:string>>,words:array<struct<term:string,seen:long>>,strong:array<struct<term:string,kind:int,value:string,seen:long>>>>"


def _scan_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    mark, word = [("kind", pa.int32()), ("value", pa.string())], [("term", pa.string()), ("seen", pa.int64())]
    block_type = pa.list_(pa.struct([("held", pa.list_(pa.struct(mark))), ("words", pa.list_(pa.struct(word))), ("strong", pa.list_(pa.struct([word[0], *mark, word[1]])))]))
    for batch in batches:
        base, blocks, n_blocks = [], [], []
        for text in batch.column(batch.num_columns - 1):
            text = text.as_py()
            found = findings(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            blocks.append(sighted(text, found) if found else [])
            n_blocks.append(text.count("\n") + 1)
        own = [pa.array(base, base_type), pa.array(blocks, block_type), pa.array(n_blocks, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*batch.schema.names[:-1], "base", "blocks", "n_lines"])


def _counted(text: str, keep: frozenset | None, by_block: bool) -> Iterator[set[str]]:
    """The wanted terms (all, if None) of a text, or of each of its blocks."""
    found = findings(text)
    for terms in block_terms(text, found) if by_block else (terms_of(text, found),):
        yield terms if keep is None else terms & keep


def _texts_with(wanted, by_block: bool):
    """(term, copies, n): texts of so many copies (or their blocks) that hold each wanted term; a row for each such term and number of copies of a task."""

    def run(batches):
        keep = None if wanted is None else frozenset(wanted.value)
        seen: dict[int, Counter] = {}
        for batch in batches:
            for copies, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = seen.setdefault(copies, Counter())
                for terms in _counted(text.as_py(), keep, by_block):
                    counts.update(terms)
            if sum(map(len, seen.values())) >= HELD_TERMS:
                yield from _counts_out(seen)
        yield from _counts_out(seen)

    return run


def _counts_out(seen: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
    rows = [(t, c, n) for c, found in seen.items() for t, n in found.items()]
    seen.clear()
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["term", "copies", "n"])


def _terms_with_texts(wanted, by_block: bool):
    """(term, hash, n): each text's wanted terms (all, if None), with 1 or how many of its blocks hold them."""

    def run(batches):
        keep = None if wanted is None else frozenset(wanted.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts: Counter = Counter()
                for terms in _counted(text.as_py(), keep, by_block):
                    counts.update(terms)
                rows += [(t, key, n) for t, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["term", KEY[1], "n"])

    return run


def _counts(keyed: DataFrame, repeated: DataFrame, pairs: DataFrame, by_block: bool) -> DataFrame:
    """(term, n): in how many of these texts (or blocks) each term of the pairs stands, equal texts once. Few repeated texts are sent to all tasks; with many,
    what each text counts is shuffled, not the text."""
    spark = keyed.sparkSession
    terms = [r.term for r in pairs.select("term").distinct().limit(BROADCAST_TERMS + 1).collect()]
    wanted = spark.sparkContext.broadcast(terms) if len(terms) <= BROADCAST_TERMS else None
    if repeated.count() <= BROADCAST_ROWS:
        texts = keyed.join(F.broadcast(repeated), KEY[1], "left").select(F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "text")
        counts = texts.mapInArrow(memory.batches(_texts_with(wanted, by_block)), "term string, copies long, n long")
        return counts.groupBy("term").agg(F.round(F.sum(F.col("n") / F.col("copies"))).alias("n"))
    each = keyed.select(KEY[1], "text").mapInArrow(memory.batches(_terms_with_texts(wanted, by_block)), f"term string, {KEY[1]} long, n long")
    return each.distinct().groupBy("term").agg(F.sum("n").cast("double").alias("n"))


def _pairs(blocks: DataFrame, generalise: float, n_blocks: int) -> DataFrame:
    """(term, kind, information, n_both, seen, prior): what terms could disclose of values and kinds if they stood nowhere else."""
    marks = blocks.select(F.explode("held").alias("v")).groupBy("v.kind", "v.value").agg(F.count("*").alias("n_of"))
    marks = written(marks, "personal-values")
    kinds = dict(marks.groupBy("kind").agg(F.sum("n_of")).collect())  # four at most
    of_kind = F.element_at(F.create_map(*[x for k in range(len(KINDS)) for x in (F.lit(k), F.lit(kinds.get(k, 1)))]), F.col("kind"))
    near = F.broadcast if marks.count() <= BROADCAST_ROWS else (lambda df: df)

    def counted(rows: DataFrame, prior: float, *by: str) -> DataFrame:
        return rows.groupBy("term", *by).agg(F.countDistinct("block").alias("n_both"), F.countDistinct("seen").alias("seen")).withColumn("prior", F.lit(prior))

    strong = blocks.select("block", F.explode("strong").alias("w")).select("block", "w.*")
    # A term must be seen three times with a value for the rest to count, so the value must stand in three blocks.
    often = marks.where(F.col("n_of") >= PRIOR)
    with_value = blocks.select("block", "words", F.explode("held").alias("v")).select("block", "words", "v.*").join(near(often.select("kind", "value")), ["kind", "value"])
    with_value = with_value.select("block", "kind", "value", F.explode("words").alias("w")).select("block", "kind", "value", "w.*")
    with_kind = blocks.select("block", F.explode("words").alias("w"), F.array_distinct("held.kind").alias("kinds")).select("block", "w.*", F.explode("kinds").alias("kind"))
    values = counted(strong, PRIOR_STRONG, "kind", "value").unionByName(counted(with_value, PRIOR, "kind", "value")).join(near(marks), ["kind", "value"]).drop("value")
    whole = counted(strong, PRIOR_STRONG, "kind").unionByName(counted(with_kind, PRIOR, "kind")).withColumn("n_of", of_kind.cast("long"))
    pairs = values.unionByName(whole).withColumn("information", F.log2(F.lit(max(n_blocks, 1)) / F.col("n_of"))).where("information > 0")
    return pairs.where(_told(F.col("n_both"), generalise))


def _p(n: Column) -> Column:
    """p(c | t) of a term that stands in n blocks."""
    return F.col("n_both") / F.greatest(n, F.col("n_both")) * F.col("seen") / (F.col("seen") + F.col("prior"))


def _share(n: Column) -> Column:
    return 1 + F.log2(_p(n)) / F.col("information")


def _told(n: Column, generalise: float) -> Column:
    return (_share(n) >= generalise) & (F.log2(_p(n)) >= -LEFT)


def _still_telling(pairs: DataFrame, counts: DataFrame, generalise: float) -> DataFrame:
    """The pairs that may tell enough if their terms stand in n blocks at least."""
    return pairs.join(counts, "term", "left").where(_told(F.coalesce("n", F.lit(0.0)), generalise)).drop("n")


def disclosing_anywhere(keyed: DataFrame, scanned: DataFrame, generalise: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """(term, kind, share): the terms that disclose at least the share generalise of a protected value or kind, and all but LEFT bits, with the largest share;
    and the places (key, places, n_blocks by term) of all terms that were looked up for it.

    A term can't tell enough once it is known to stand in too many blocks, so fewer than all will do to leave it out: those of a share of the texts, by
    hash, leave out the common words; then the number of texts that hold a term, which are no more than its blocks, leaves few terms, whose blocks are counted where they are found.
    """
    once = scanned.where(F.size("base") > 0).select(KEY[1], "blocks").dropDuplicates([KEY[1]])
    blocks = once.select(KEY[1], F.posexplode("blocks").alias("at", "b")).select(F.struct(KEY[1], "at").alias("block"), "b.*")
    blocks = written(blocks, "personal-blocks")
    n_blocks = scanned.agg(F.sum("n_lines")).first()[0] or 0
    pairs = written(_pairs(blocks, generalise, n_blocks), "personal-pairs")
    repeated = written(scanned.groupBy(KEY[1]).agg(F.count("*").alias("copies")).where("copies > 1"), "personal-repeated")
    some = keyed.where(F.pmod(KEY[1], F.lit(FIRST)) == 0)
    left = written(_still_telling(pairs, _counts(some, repeated, pairs, True), generalise), "personal-first")
    left = written(_still_telling(left, _counts(keyed, repeated, left, False), generalise), "personal-left")
    places = written(_located(keyed, left.select("term").distinct()), "personal-places")
    in_blocks = places.dropDuplicates([KEY[1]]).select(F.explode("blocks").alias("b")).groupBy("b.term").agg(F.sum("b.n").cast("double").alias("n"))
    told = left.join(in_blocks, "term").where(_told(F.col("n"), generalise)).withColumn("share", _share(F.col("n")))
    best = F.max(F.struct("share", (-F.col("kind")).alias("kind"))).alias("best")
    return told.groupBy("term").agg(best).select("term", (-F.col("best.kind")).cast("int").alias("kind"), "best.share"), places


def _locating(held):
    """The key, every place of the wanted terms (those held, or else those of the row), and how many blocks hold each."""
    place = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    count = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())]))

    def run(batches):
        for batch in batches:
            keep, places, blocks = [], [], []
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                wanted = held.value if held is not None else frozenset(batch.column(3)[i].as_py())
                if len(wanted) <= FEW and not BOUND_LETTERS.search(text):
                    lowered = text.lower()
                    if not any(t in lowered for t in wanted):
                        continue
                found = findings(text)
                if not (own := terms_of(text, found) & wanted):
                    continue
                counts: Counter = Counter()
                for terms in block_terms(text, found):
                    counts.update(terms & own)
                keep.append(i)
                places.append([{"term": w, "start": a, "end": b} for a, b in outside_words(text, found) if (w := text[a:b].lower()) in own])
                blocks.append([{"term": t, "n": n} for t, n in counts.items()])
            own = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(places, place), pa.array(blocks, count)], names=[*KEY, "places", "blocks"])

    return run


def _listing(batches):
    """The key, and each different word of the text."""
    for batch in batches:
        words = [sorted(terms_of(t.as_py(), [])) for t in batch.column(2)]
        at = np.repeat(np.arange(len(words)), [len(w) for w in words])
        own = batch.select([0, 1]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array([t for w in words for t in w], pa.string())], names=[*KEY, "term"])


def _located(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Key, places and blocks of the rows that hold wanted terms; rows of one key once."""
    spark, key = keyed.sparkSession, f"{KEY[0]} string, {KEY[1]} long"
    schema = f"{key}, places array<struct<term:string,start:int,end:int>>, blocks array<struct<term:string,n:long>>"
    texts = keyed.select(*KEY, "text")
    rows = [r.term for r in wanted.limit(BROADCAST_TERMS + 1).collect()]
    if len(rows) <= BROADCAST_TERMS:
        held = spark.sparkContext.broadcast(frozenset(rows))
        return texts.mapInArrow(memory.batches(_locating(held)), schema).dropDuplicates(KEY)
    listed = texts.mapInArrow(memory.batches(_listing), f"{key}, term string").join(wanted, "term").distinct()
    some = listed.groupBy(*KEY).agg(F.collect_list("term").alias("told"))
    return texts.join(some, KEY).select(*KEY, "text", "told").mapInArrow(memory.batches(_locating(None)), schema).dropDuplicates(KEY)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int | None = None, generalise: float = GENERALISE) -> DataFrame:
    """A row for each row of docs: doc_id, base and terms, sorted arrays of (start, kind, end[, share]), and a key of id and text.

    kind counts from 0 in KINDS. A null text is empty; texts of any length are read whole; an empty table gives no rows. Where a term discloses several kinds or values its largest share counts.
    terms has every place of a disclosing term, in documents without findings too. With a support, only words near findings
    of a kind count (NEAR_WORDS on either side, at any distance), from so many on, and only there; then repeated rows count as often as they stand, else equal texts once.
    Other columns are not kept. Repeated rows each get a row.
    """
    require(docs, id_col, text_col)
    keyed = docs.select(*_key(docs, id_col, text_col), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"{KEY[0]} string, {KEY[1]} long, doc_id {docs.schema[id_col].dataType.simpleString()}, base {BASE}"
    none = F.array().cast(TERMS)
    if support is None:
        scanned = written(keyed.mapInArrow(memory.batches(_scan_whole), f"{schema}, blocks {BLOCKS}, n_lines long"), "personal-findings")
        told, places = disclosing_anywhere(keyed, scanned, generalise)
        told = written(told, "personal-terms")
        near = F.broadcast if told.count() <= BROADCAST_TERMS else (lambda df: df)
        spots = places.select(*KEY, F.explode("places").alias("p")).select(*KEY, "p.*").join(near(told), "term")
        terms = spots.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "share"))).alias("terms"))
        return scanned.join(terms, KEY, "left").select("doc_id", *KEY, "base", F.coalesce("terms", none).alias("terms"))
    scanned = written(keyed.mapInArrow(_scan, f"{schema}, near {NEAR}"), "personal-findings")
    told = written(disclosing(docs, scanned, text_col, support, generalise), "personal-terms")
    near = scanned.where(F.size("near") > 0).dropDuplicates(KEY).select(*KEY, F.explode("near").alias("w")).select(*KEY, "w.*")
    spots = near.join(told, ["term", "kind"]).groupBy(*KEY, "start", "end").agg(F.max("share").alias("share"), F.min("kind").alias("kind"))
    terms = spots.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "share"))).alias("terms"))
    return scanned.join(terms, KEY, "left").select("doc_id", *KEY, "base", F.coalesce("terms", none).alias("terms"))


def _rewritten(remove: float):
    def run(batches):
        for batch in batches:
            texts = []
            n = batch.num_columns
            for text, base, terms in zip(*(batch.column(i).to_pylist() for i in (n - 3, n - 2, n - 1)), strict=True):
                if base or terms:
                    cuts = [(s["start"], s["end"], f"<{KINDS[s['kind']].upper()}>") for s in base or []]
                    cuts += [(s["start"], s["end"], "" if s["share"] >= remove else "<TERM>") for s in terms or []]
                    out, at = [], 0
                    for a, b, put in sorted(cuts):
                        if a >= at:
                            out += [text[at:a], put]
                        at = max(at, b)
                    text = "".join([*out, text[at:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 3], pa.array(texts, pa.string())], names=[*batch.schema.names[: n - 3], "sanitised"])

    return run


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **how) -> DataFrame:
    """docs with sanitised: the text with findings and disclosing terms generalised or removed (null stays null)."""
    found = personal_data(docs, id_col, text_col, **how).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(KEY).drop("doc_id")
    base = without(docs, "sanitised")
    joined = base.select(*base.columns, *_key(docs, id_col, text_col), F.col(text_col).alias(f"{OWN}text")).join(found, KEY, "left").select(*base.columns, f"{OWN}text", "base", "terms")
    from pyspark.sql import types as T

    return joined.mapInArrow(_rewritten(remove), T.StructType([*base.schema.fields, T.StructField("sanitised", T.StringType())]))
