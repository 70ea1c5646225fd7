"""Fill-in-the-middle training texts: each text is cut at two unit boundaries, and its three parts are put in another order behind marks.

A unit grammar is a regular expression of alternatives of character classes, such as ``[A-Za-z]+|[^A-Za-z]``. Where the units of a grammar
are decided by neighbouring characters alone, it says which neighbours stay in one unit, and the grammar is translated to a
zero-width regular expression of lookarounds that matches at every other place inside a text. Splitting there keeps all
pieces, so the pieces joined are the text again. An empty text has no units, but splitting it would give one empty piece; it is counted apart.

Where a text is cut and which form it takes comes from a hash of seed and id, so reruns agree. Built-in operations only, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.store import OWN, require, without

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Unit grammars: runs of letters and other characters one by one; single characters; runs of word characters, of blanks, and others one by one; lines with their ends.
GRAMMARS = {
    "letters": r"[A-Za-z]+|[^A-Za-z]",
    "characters": r"[\s\S]",
    "words": r"[\w]+|[\s]+|[^\w\s]",
    "lines": r"[^\n]*[\n]|[^\n]+",
}
_CLASS = r"\[(?:\\.|[^\]\\])+\]"
_ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def neighbours(grammar: str) -> list[tuple[str, str]]:
    """The pairs of classes whose characters stay in one unit where they stand side by side: a repeated class with itself, and a class with the next one of
    its alternative (or the one after that, where the next may be absent)."""
    pairs = []
    rest = grammar
    while rest:
        found = re.match(rf"((?:{_CLASS}[+*]?)+)(?:\||$)", rest)
        if not found:
            raise ValueError(f"not an alternative of classes: {rest!r}")
        items = re.findall(rf"({_CLASS})([+*]?)", found[1])
        for i, (one, times) in enumerate(items):
            if times:
                pairs.append((one, one))
            for other, may_be_absent in items[i + 1 :]:
                pairs.append((one, other))
                if may_be_absent != "*":
                    break
        rest = rest[found.end() :]
    return list(dict.fromkeys(pairs))


def boundary(grammar: str) -> str:
    """A zero-width regular expression that matches between any two characters of a text that are in different units. A character of two UTF-16
    units is one: no match before the second of them."""
    inside = "".join(f"(?!(?<={left})(?={right}))" for left, right in neighbours(grammar))
    return rf"(?!\A)(?!\z)(?![\x{{DC00}}-\x{{DFFF}}]){inside}"


def units(text: Column, grammar: str = GRAMMARS["letters"]) -> Column:
    """The units of a text in their order; null and empty texts have none."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(seed: int, id_col: str) -> list[Column]:
    """Four whole numbers below 2^32 from the hash of ``seed:id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, grammar: str = GRAMMARS["letters"], plain_percent: int = 10, suffix_first_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars and middle_chars (null where plain), and output.

    psm is prefix, suffix, middle behind their marks; spm is suffix, prefix, middle; plain is the text as it is, for plain_percent of
    the documents, empty texts, and texts that hold a mark (else they couldn't be rebuilt). Null texts count as empty, whatever their length
    texts are taken whole, repeated rows get equal results, and columns of docs with the added names are replaced. An empty table gives no rows.
    """
    if not (0 <= plain_percent <= 100 and 0 <= suffix_first_percent <= 100):
        raise ValueError("percentages must be from 0 to 100")
    require(docs, id_col, text_col)
    kept = without(docs, *(a for a in _ADDED if a not in (id_col, text_col)))
    own = [f"{OWN}{x}" for x in ("text", "units", "h1", "h2", "h3", "h4")]
    text, pieces, *h = own
    with_text = kept.withColumns({text: F.coalesce(F.col(text_col), F.lit("")), **dict(zip(h, draws(seed, id_col), strict=True))})
    cut = with_text.withColumn(pieces, units(F.col(text), grammar)).withColumn("n", F.size(pieces).cast("long"))
    a, b = (F.col(x) % (F.col("n") + 1) for x in h[:2])
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains(F.col(text), F.lit(mark))
    form = F.when((F.col("n") == 0) | marked | (F.col(h[2]) % 100 >= 100 - plain_percent), "plain").when(F.col(h[3]) % 100 < suffix_first_percent, "spm").otherwise("psm")
    parts = [f"{OWN}{x}" for x in ("prefix", "middle", "suffix")]
    join = lambda start, length: F.array_join(F.slice(pieces, start.cast("int"), length.cast("int")), "")
    low, high = F.least(a, b), F.greatest(a, b)
    cut = cut.withColumns({"form": form, parts[0]: join(F.lit(1), low), parts[1]: join(low + 1, high - low), parts[2]: join(high + 1, F.col("n") - high)})
    p, m, s = map(F.col, parts)
    output = F.when(F.col("form") == "plain", F.col(text)).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)).otherwise(F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    shown = lambda part: F.when(F.col("form") != "plain", F.char_length(part).cast("long"))
    return cut.withColumns({"prefix_chars": shown(p), "middle_chars": shown(m), "output": output}).select(*kept.columns, *_ADDED)


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle made output of. The first mark of each kind is the one that was put in, as marked texts stay plain."""

    def halves(rest: Column, mark: str) -> tuple[Column, Column]:
        return F.split_part(rest, F.lit(mark), F.lit(1)), F.split_part(rest, F.lit(mark), F.lit(2))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one, rest = halves(F.substr(output, F.lit(len(first) + 1)), second)
        return one, *halves(rest, MIDDLE)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_first, prefix_second, middle_last = parts(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_second, middle_last, suffix_first))
