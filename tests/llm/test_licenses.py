import random
import re

import duckdb
import pytest

from lodestack.llm import licenses, op3_licenses
from lodestack.llm.licenses import MISS, TEMPLATES, TEXTS, bands_needed, length_class, scan_licenses, template_table


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, templates, least=0.8):
    out = []
    for d, t in docs:
        w, found = words(t), {}
        for name, notice in templates.items():
            tw = words(notice)
            s, c = shingles(tw), length_class(len(tw))
            shares = [(at, len(shingles(w[at : at + c + c // 2]) & s) / len(s)) for at in range(0, max(1, len(w)), c // 2)]
            good = [(at, x) for at, x in shares if x >= least]
            if good:
                found[name] = (round(max(x for _, x in good), 9), len(good), good[0][0])
        out.append((d, sorted((n, *v) for n, v in found.items())))
    return sorted(out, key=repr)


def got(frame, templates, **how):
    return sorted(((r.doc_id, [(x.template, round(x.containment, 9), x.windows, x.at) for x in r.licenses]) for r in scan_licenses(frame, templates, **how).collect()), key=repr)


def test_query_agrees_with_sql(spark, sf_dir):
    rows = sorted(map(tuple, op3_licenses.run(spark, sf_dir).collect()))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert rows == sorted(c.sql(op3_licenses.SQL).fetchall())


def test_bands_are_enough():
    for size in (8, 16, 32, 64, 128):
        for n in range(max(1, size // 2 - 4), size - 3):
            b = bands_needed(size, n)
            shared = -(-8 * n // 10)
            assert (1 - shared / (size * 3 // 2 - 4 + n - shared)) ** b <= MISS * 1.0001


@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_odd_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", broadcast)
    rng = random.Random(4)
    noise = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    docs = [(i, f"{noise(rng.randrange(60))}\n{rng.choice(list(TEMPLATES.values()))} {noise(rng.randrange(60))}") for i in range(60)]
    long = TEMPLATES["mit-text"].split()
    docs += [(100 + i, " ".join(x for x in long if rng.random() > 0.02 * i)) for i in range(8)]
    docs += [(200, None), (201, ""), (202, "mit"), (None, TEMPLATES["mit"]), (203, TEMPLATES["mit"].upper()), (204, (TEMPLATES["mit"] + " ") * 50), (204, (TEMPLATES["mit"] + " ") * 50), (205, noise(3000) + TEMPLATES["gpl-3.0"]), (206, "released under the mit"), (207, "Released, under... the MIT\nLicense")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, licenses string")
    assert got(frame, template_table(spark)) == brute(docs, TEMPLATES)


def test_empty_tables_and_bad_templates(spark):
    frame = spark.createDataFrame([(1, TEMPLATES["mit"])], "doc_id long, text string")
    assert got(frame.limit(0), template_table(spark)) == []
    assert got(frame, template_table(spark).limit(0)) == [(1, [])]
    with pytest.raises(ValueError):
        scan_licenses(frame, template_table(spark, {"short": "too few words"}))
    with pytest.raises(ValueError):
        scan_licenses(frame, template_table(spark), least=0.0)


def test_usual_wordings_are_known(spark):
    wordings = ["Distributed under the MIT License", "this project is licensed under the MIT license", "Licensed under CC BY 4.0", "x " * 200 + TEMPLATES["isc-text"], "1. " + TEMPLATES["unlicense-text"].lower(), TEMPLATES["lgpl-2.1-header"], "clean text without any notice at all"]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(wordings)), "doc_id long, text string"), template_table(spark)).orderBy("doc_id").collect()
    assert all(r.licenses for r in rows[:-1]) and not rows[-1].licenses


def test_everyday_notices_whole_texts_and_altered_ones(spark):
    notices = {
        "gpl2": "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.\n59 Temple Place, Boston\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.",
        "spdx": "// SPDX-License-Identifier: MIT",
        "bsd": "Licensed under the BSD 3-Clause License.",
        "apache": "Released under the Apache 2.0 license",
        "gpl3": "This project is licensed under the GNU GPLv3",
        "dual": "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR apache-2.0 */\nDual licensed under MIT or Apache-2.0, provided by us",
        "none": "The GPL is a license; MIT is a school. This was provided by the isccc office.",
    }
    docs = list(notices.items()) + [(f"whole {k}", f"x y z\n{v}\nend") for k, v in TEXTS.items()]
    for k in ("mit-text", "apache-2.0-text", "gpl-3.0-text"):  # every thirtieth word changed: above 0.8 of the shingles left
        docs.append((f"altered {k}", " ".join("other" if i % 30 == 29 else w for i, w in enumerate(TEXTS[k].split()))))
    rows = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(docs, "doc_id string, text string"), template_table(spark)).collect()}
    names = {k: {x.template for x in r.licenses} for k, r in rows.items()}
    assert names["gpl2"] >= {"gpl-2.0-title", "fsf-verbatim-copies"}
    assert {k: rows[k].mentions for k in ("spdx", "bsd", "apache", "gpl3", "dual", "none")} == {"spdx": ["MIT"], "bsd": ["BSD-3-Clause"], "apache": ["Apache-2.0"], "gpl3": ["GPL-3.0"], "dual": ["Apache-2.0", "GPL-2.0", "MIT"], "none": []}
    assert not names["none"]
    assert len(TEXTS) >= 20
    for k in TEXTS:
        assert k in names[f"whole {k}"], k
    for k in ("mit-text", "apache-2.0-text", "gpl-3.0-text"):
        assert k in names[f"altered {k}"], k
