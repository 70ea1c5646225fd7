"""License notices in documents: MinHash bands over overlapping windows find templates, exact containment verifies them.

Templates are grouped by length. For lengths up to c words, windows of 3c/2 words start every c/2 words, so a notice lies
whole in one of them. A band is one MinHash value. A window that holds the share `least` of a template's n shingles has a Jaccard similarity of at least
J = ceil(least * n) / (window's shingles + n - ceil(least * n)) with it, and so many bands are used that such a window meets its template with probability
1 - MISS at least. A match is a window whose shingles contain that share of the template's, compared as texts.

A window can meet a template in a band only if it holds the shingle that is the template's minimum there. So MinHash values are computed only for windows with
such a shingle, found by a join with these few; the windows left out could not have met any template.

Built-in operations only. Words are those of winnowing.py; documents are known by id and hash of the text, and repeated rows get the same result.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.store import require, without, written
from lodestack.llm.winnowing import KEY, LOWER, UPPER, _grams, _keyed, held_still, words

SHINGLE = 5
LEAST = 0.8
#: The chance that all bands miss a window that is just similar enough.
MISS = 1e-4
#: Shingles of templates that are sent to all tasks; the count is checked.
BROADCAST_ROWS = 300_000

#: Fixed texts of notices, headers and titles, with the usual wordings of the short ones.
NOTICES = {
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-distributed": "Distributed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "fsf-verbatim-copies": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "agpl-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "artistic-2.0-title": "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation.",
    "gpl-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
    "gpl-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "lgpl-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.",
    "lgpl-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-distributed": "Distributed under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-project": "This project is licensed under the MIT License.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


#: Whole license texts, a file each.
TEXTS = {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
TEMPLATES = NOTICES | TEXTS

#: Words before a license that is named, and so many words after them are looked at.
SAID = "licensed|licenced|released|distributed|available|published|provided|covered"
SAID_WORDS = 9
#: Names of licenses in words of small letters and digits, joined by blanks, by SPDX identifier: regular expressions.
NAMES = {
    "AGPL-3.0": "(gnu )?affero general public license( version| v)? ?3|(gnu )?agpl ?v? ?3",
    "Apache-2.0": "apache( software)?( license)?( version| v)? ?2|asl 2",
    "Artistic-2.0": "artistic license( version)? 2",
    "BSD-2-Clause": "bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd license",
    "BSD-3-Clause": "bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd",
    "BSL-1.0": "boost software license",
    "CC-BY-4.0": "creative commons attribution( 4 0)? international|creative commons attribution 4|cc by 4",
    "CC-BY-NC-4.0": "creative commons attribution non ?commercial 4|cc by nc 4",
    "CC-BY-NC-SA-4.0": "creative commons attribution non ?commercial share ?alike 4|cc by nc sa 4",
    "CC-BY-ND-4.0": "creative commons attribution no ?deriv(ative)?s 4|cc by nd 4",
    "CC-BY-SA-4.0": "creative commons attribution share ?alike 4|cc by sa 4",
    "CC0-1.0": "cc0( 1 0)?|creative commons zero",
    "EPL-2.0": "eclipse public license( version| v)? ?2|epl ?v? ?2",
    "GPL-2.0": "gnu general public license( version| v)? ?2|(gnu )?gpl ?v? ?2",
    "GPL-3.0": "gnu general public license( version| v)? ?3|(gnu )?gpl ?v? ?3",
    "ISC": "isc( license)?",
    "LGPL-2.1": "gnu (lesser|library) general public license( version| v)? ?2 1|(gnu )?lgpl ?v? ?2 1",
    "LGPL-3.0": "gnu lesser general public license( version| v)? ?3|(gnu )?lgpl ?v? ?3",
    "MIT": "mit( license)?|expat license",
    "MPL-2.0": "mozilla public license( version| v)? ?2|mpl ?v? ?2",
    "Unlicense": "unlicense",
    "WTFPL": "wtfpl",
    "Zlib": "zlib( license)?",
}
#: Further identifiers that are known behind SPDX-License-Identifier.
SPDX = ("0BSD", "Artistic-1.0", "BSD-4-Clause", "CC-BY-3.0", "CC-BY-SA-3.0", "CDDL-1.0", "EPL-1.0", "EUPL-1.2", "GPL-1.0", "LGPL-2.0", "MIT-0", "MPL-1.1", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0", "Ruby", "X11")
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PART = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What follows a word of SAID and under (or by); what stands behind SPDX-License-Identifier; an identifier in it, and what may end one.
SAID_PATTERN = rf"(?:{SAID}){_BREAK}(?:under|by){_BREAK}((?:{_PART}{_BREAK}){{0,{SAID_WORDS - 1}}}{_PART})"
SPDX_PATTERN = r"SPDX-License-Identifier:[ \t]*([^\r\n]*)"
SPDX_NAME, SPDX_END = "[A-Za-z0-9][A-Za-z0-9.+-]*", r"(-only|-or-later|\+)$"


def mentions(text: Column) -> Column:
    """The licenses that a text names, as sorted SPDX identifiers: by an SPDX line, or by name within SAID_WORDS words of a phrase such as "licensed under".

    An exact rule beside the templates, as such a name is too short for shingles. A name must stand in whole words, a version may go on (2.0, 2 or later).
    Null and empty texts name none.
    """
    known = F.coalesce(text, F.lit(""))
    said = F.regexp_extract_all(F.translate(known, UPPER, LOWER), F.lit(SAID_PATTERN), 1)
    said = F.transform(said, lambda s: F.concat(F.lit(" "), F.regexp_replace(s, _BREAK, " "), F.lit(" ")))
    named = F.array(*[F.when(F.exists(said, lambda s: F.rlike(s, F.lit(f" ({pattern}) "))), F.lit(name)) for name, pattern in sorted(NAMES.items())])  # noqa: B023
    ids = F.create_map(*[F.lit(x) for name in (*NAMES, *SPDX) for x in (name.lower(), name)])
    lines = F.array_join(F.regexp_extract_all(known, F.lit(SPDX_PATTERN), 1), " ")
    tagged = F.transform(F.regexp_extract_all(lines, F.lit(SPDX_NAME), 0), lambda x: F.element_at(ids, F.regexp_replace(F.lower(x), SPDX_END, "")))
    found = F.array_union(F.when(F.size(said) > 0, F.array_compact(named)).otherwise(F.array().cast("array<string>")), F.array_compact(tagged))
    return F.array_sort(found)


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((templates or TEMPLATES).items()), "template string, notice string")


def length_class(n_words: int) -> int:
    """The smallest power of two from 8 that is not below n_words."""
    return max(8, 1 << (n_words - 1).bit_length())


def bands_needed(size: int, least_shingles: int, least: float = LEAST) -> int:
    """Bands for the class of size words whose smallest template has least_shingles shingles."""
    shared = math.ceil(least * least_shingles - 1e-9)
    window = size + size // 2 - SHINGLE + 1
    similarity = shared / (window + least_shingles - shared)
    return math.ceil(math.log(MISS) / math.log(1 - similarity)) if similarity < 1 else 1


def _shingles(array: Column) -> Column:
    """The runs of SHINGLE words as texts."""
    last = F.size(array) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(array, i + 1, SHINGLE), " "))).otherwise(F.array().cast("array<string>"))


def _with_grams(df: DataFrame) -> DataFrame:
    """df (with words) plus grams, the hash of the shingle at each word. The hashes of the words are a column first, made once."""
    hashed = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("grams", _grams(F.col("hashes"), SHINGLE)).drop("hashes")


def _prepared(templates: DataFrame, least: float) -> tuple[DataFrame, dict[int, int]]:
    """template, size (its class), shingles, n, grams; and the bands of each class."""
    cut = written(templates.select("template", words(F.col("notice")).alias("words")), "license-words")
    if (few := cut.where(F.size("words") < SHINGLE).count()) > 0:
        raise ValueError(f"{few} templates have fewer than {SHINGLE} words")
    size = F.greatest(F.lit(8), F.pow(F.lit(2), F.ceil(F.log2(F.size("words").cast("double")))).cast("int"))
    shingled = _with_grams(cut).select("template", size.alias("size"), F.array_distinct(_shingles(F.col("words"))).alias("shingles"), F.array_distinct("grams").alias("grams"))
    held = written(shingled.withColumn("n", F.size("shingles")), "license-templates")
    classes = {r.size: bands_needed(r.size, r.n, least) for r in held.groupBy("size").agg(F.min("n").alias("n")).collect()}  # a class doubles, so there are few
    return held, classes


def license_matches(docs: DataFrame, templates: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, template, containment, windows, at): per document and template the best share of its shingles in one window, the windows
    that hold at least `least` of them, and the first word of the first such window."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    require(docs, id_col, text_col)
    held, classes = _prepared(templates, least)
    numbers = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair]) if classes else F.create_map().cast("map<int,int>")
    band = F.explode(F.sequence(F.lit(0), F.element_at(numbers, F.col("size")) - 1))
    signed = held.select("template", "size", "grams", band.alias("band"))
    least_of = F.array_min(F.transform("grams", lambda g: F.struct(F.xxhash64(g, F.col("band")).alias("low"), g.alias("gram"))))
    signed = written(signed.select("template", "size", "band", least_of.alias("m")).select("template", "size", "band", "m.low", "m.gram"), "license-bands")
    leads = written(signed.select("gram", "size").distinct(), "license-leads")
    small = leads.count() <= BROADCAST_ROWS
    near = F.broadcast if small else (lambda df: df)

    own = _with_grams(_keyed(docs, id_col, text_col))
    texts = ["words", "grams"] if small else []  # shuffled leads meet places first, and each text once then
    hits = own.select(*KEY, *texts, F.posexplode(held_still(F.col("grams"))).alias("at", "gram")).join(near(leads), "gram")
    step, width = F.col("size") / 2, F.col("size") + F.col("size") / 2
    low = F.greatest(F.lit(0), F.ceil((F.col("at") + SHINGLE - width) / step)).cast("int")
    place = F.explode(F.sequence(low, F.floor(F.col("at") / step).cast("int"))).alias("k")
    windows = hits.select(*KEY, "size", place, *texts)
    if not small:
        spots = written(windows.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("size", "k")).alias("spots")), "license-spots")  # no more than the words of a text
        windows = own.dropDuplicates(KEY).join(spots, KEY).select(*KEY, "words", "grams", F.explode("spots").alias("s")).select(*KEY, "s.size", "s.k", "words", "grams")
    begin = (F.col("k") * F.col("size") / 2).cast("int")
    windows = windows.select(*KEY, "size", begin.alias("at"), F.slice("words", begin + 1, width.cast("int")).alias("w"), F.slice("grams", begin + 1, (width - SHINGLE + 1).cast("int")).alias("g"))
    windows = written(windows.distinct(), "license-windows")

    lows = windows.select(*KEY, "size", "at", "w", F.explode(F.transform(F.sequence(F.lit(0), F.element_at(numbers, F.col("size")) - 1), lambda b: F.struct(b.alias("band"), _low_of("g", b).alias("low")))).alias("m"))
    met = lows.select(*KEY, "size", "at", "w", "m.band", "m.low").join(near(signed.select("template", "size", "band", "low")), ["size", "band", "low"])
    met = met.select(*KEY, "at", "w", "template").distinct().join(near(held.select("template", "shingles", "n")), "template")
    share = F.size(F.array_intersect(F.array_distinct(_shingles(F.col("w"))), F.col("shingles"))) / F.col("n")
    found = met.select(*KEY, "template", "at", share.alias("share")).where(F.col("share") >= least)
    return found.groupBy(*KEY, "template").agg(F.max("share").alias("containment"), F.count("*").alias("windows"), F.min("at").alias("at"))


def _low_of(grams: str, band: Column) -> Column:
    return F.array_min(F.transform(grams, lambda h: F.xxhash64(h, band)))


def scan_licenses(docs: DataFrame, templates: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with licenses: a sorted array of (template, containment, windows, at), and mentions: a sorted array of SPDX identifiers; both empty where there is none.

    A null text has no words; texts are read whole, however long. Columns of docs by these names are replaced. An empty table gives no rows; without templates nothing matches.
    """
    found = license_matches(docs, templates, least, id_col, text_col)
    entry = F.struct("template", "containment", "windows", "at")
    per_doc = written(found.groupBy(*KEY).agg(F.array_sort(F.collect_list(entry)).alias("licenses")), "license-documents")
    base = without(docs, "licenses", "mentions")
    own_id = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    keyed = base.withColumns({KEY[0]: own_id, KEY[1]: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    none = F.array().cast("array<struct<template:string,containment:double,windows:bigint,at:int>>")
    return keyed.join(per_doc, KEY, "left").select(*base.columns, F.coalesce("licenses", none).alias("licenses"), mentions(F.col(text_col)).alias("mentions"))
