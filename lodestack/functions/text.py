"""Text functions as column expressions: tokens, sentences, shapes of names, language, patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.fixed import ENGLISH, FOLDS, PERIOD, STOPWORDS, SUFFIXES


def _any_of(letters) -> str:
    """A pattern for any of some letters. A long class is tried letter by letter at each place of a text; behind a range most places are done with at once."""
    first, *others = sorted(letters)
    return f"{first}|[{others[0]}-{others[-1]}&&[{''.join(others)}]]"


FOLDED = _any_of(FOLDS)


def folded(x: Column) -> Column:
    """Case folding as far as it touches ASCII: lower case, with ligatures, the sharp s and the like as their letters."""
    low = F.lower(x)
    out = low
    for letter, plain in FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    plain_text = F.octet_length(x) == F.char_length(x)  # ASCII alone has none of these letters
    return F.when(plain_text | ~low.rlike(FOLDED), low).otherwise(out)


def folded_sql(x: str) -> str:
    """The same in SQL."""
    out = f"lower({x})"
    for letter, plain in FOLDS.items():
        out = f"replace({out}, '{letter}', '{plain}')"
    return out


def tokens(x: Column) -> Column:
    """Runs of ASCII letters and digits of the folded text."""
    return F.array_remove(F.split(folded(x), "[^a-z0-9]+"), "")  # faster than taking the runs out one by one


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({folded_sql(x)}, '[a-z0-9]+')"


#: Words that begin with a letter, for keywords and the language.
NAMED = "[A-Za-z][A-Za-z0-9'_-]{1,}"


def named_words(x: Column) -> Column:
    """Words that begin with an ASCII letter and go on, in lower case."""
    return F.transform(F.regexp_extract_all(x, F.lit(NAMED), 0), F.lower)


def named_words_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{NAMED.replace(chr(39), chr(39) * 2)}'), lambda w: lower(w))"


def significant(words: Column, least: int = 3) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*ENGLISH))


def without_stopwords(words: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Words that are in no stop list; repeated words stay."""
    return F.filter(words, lambda w: ~w.isin(*stop))


def collapsed(x: Column) -> Column:
    """Blanks and tabs as one blank, no blanks at line ends, at most one empty line."""
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def sentences(x: Column) -> Column:
    """Parts that end in a full stop, an exclamation or question mark, or at a line break."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def clean_sentence(x: Column) -> Column:
    """Whether a sentence is usable prose: 15 to 600 characters, no rules, a word of three letters."""
    return F.length(x).between(15, 600) & ~x.rlike("=+|-{4,}|_{4,}") & x.rlike("[a-zA-Z]{3,}")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by blanks; none where there are fewer words."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 for two empty sets."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def excerpt(x: Column, n: int = 160) -> Column:
    """The first n characters, with dots if more follow."""
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n)), F.lit("..."))).otherwise(x)


def slug(x: Column, n: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, n)


def readable(filename: Column) -> Column:
    """A file name as words: no extension, no leading number, separators as blanks."""
    x = F.regexp_replace(filename, r"\.[^.]+$", "")
    x = F.regexp_replace(x, r"^[0-9]+[ _.-]+", "")
    return F.trim(F.regexp_replace(x, "[_-]+", " "))


def suffix_number(x: Column) -> Column:
    """The whole number behind the last double colon, if there is one and it is a number."""
    return F.when(F.contains(x, F.lit("::")), F.substring_index(x, "::", -1).try_cast("int"))


def language(words: Column) -> Column:
    """en from a share of 0.12 of common English words (see named_words()); unknown below that, or below 20 words."""
    hits = F.size(F.filter(words, lambda w: w.isin(*ENGLISH)))
    return F.when((F.size(words) >= 20) & (hits / F.size(words) >= 0.12), "en").otherwise("unknown")


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def calibrated(x: Column) -> Column:
    """A raw similarity on a scale of 0 to 1."""
    return F.round(unit((x - 0.15) / 0.75), 4)


def soft_ceiling(x: Column, cap: float) -> Column:
    return F.lit(cap) * F.tanh(x / cap)


def stemmed(word: Column) -> Column:
    """The word without the first of the suffixes that leaves more than three letters."""
    out = word
    for s in reversed(SUFFIXES):
        out = F.when(word.endswith(s) & (F.length(word) > len(s) + 3), word.substr(F.lit(1), F.length(word) - len(s))).otherwise(out)
    return out


def stemmed_sql(x: str) -> str:
    cases = " ".join(f"WHEN ends_with({x}, '{s}') AND length({x}) > {len(s) + 3} THEN {x}[1:length({x}) - {len(s)}]" for s in SUFFIXES)
    return f"CASE {cases} ELSE {x} END"


def heading_weighted(heading: Column, body: Column, times: int = 2) -> Column:
    """A text with its heading repeated before it."""
    return F.when(F.coalesce(heading, F.lit("")) == "", body).otherwise(F.concat(F.repeat(F.concat(heading, F.lit("\n")), times), F.lit("\n"), body))


def periods(x: Column) -> Column:
    """The different periods of time that a text names, in one spelling."""
    return F.array_distinct(F.regexp_extract_all(F.upper(F.regexp_replace(x, r"\s+", " ")), F.lit(f"(?i){PERIOD}"), 0))
