import re
import textwrap

from conftest import SF001, SF01
from oracle import compare
from tsfolds.llm import licence_texts, licences
from tsfolds.llm import queries as Q
from tsfolds.llm.licences import scan


def test_query_against_sql(spark):
    for sf in (SF001, SF01):
        ok, msg = compare(spark, "op4_licence_digest", sf, Q.QUERIES, Q.SQL)
        assert ok, msg
    assert Q.op4_licence_digest(spark, SF01).where("n_notices > 0").count() > 10


def test_canonical_equality(spark):
    mit = licence_texts.MIT
    rows = [
        (1, "Copyright (c) 2019 Someone\n" + mit),
        (2, "/*\n * " + mit.upper().replace("\n", "\n * ").replace('"', "“") + "\n */\n© 2020 X. All rights reserved."),
        (3, mit.replace("sublicense", "sub-license").replace("MIT License", "MIT Licence")),
        (4, mit + "\nand more"),
        (5, licence_texts.BSD_3.replace("COPYRIGHT HOLDER", "COPYRIGHT OWNER")),
        (6, "Some text.\n  # Released under the MIT LICENCE!\nLicensed under CC BY-NC 4.0\nreleased under the mit license"),
        (7, None),
        (8, ""),
        (9, "...!\n--"),
        (10, "x " * 50000),
        (6, "Some text.\n  # Released under the MIT LICENCE!\nLicensed under CC BY-NC 4.0\nreleased under the mit license"),
        (None, "Released under the MIT License."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as d", "3 as lines", "4 as licence")
    got = sorted(((r.doc_id or 0), r.licence, r.n_notices, r.notices) for r in scan(df).collect())
    assert got == [
        (0, "MIT", 1, "MIT"), (1, "MIT", 0, ""), (2, "MIT", 0, ""), (3, "MIT", 0, ""), (4, None, 0, ""), (5, "BSD-3-Clause", 0, ""),
        (6, None, 3, "CC-BY-NC-4.0,MIT"), (6, None, 3, "CC-BY-NC-4.0,MIT"), (7, None, 0, ""), (8, None, 0, ""), (9, None, 0, ""), (10, None, 0, ""),
    ]
    assert scan(df.limit(0)).collect() == []


def test_entire_texts_notices_and_spdx_lines(spark):
    text = {f.stem: f.read_text() for f in licence_texts._FILES}
    assert {"Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0"} <= text.keys()
    whole = {i: (name, t) for i, (name, t) in enumerate(sorted(text.items()))}
    lines = [
        ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("LGPL-2.1-or-later", "# SPDX-License-Identifier: LGPL-2.1-or-later"), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
        ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-3.0-or-later", "Licensed under the GPLv3 or later."),
        ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."), ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, v2.0"),
    ]
    rows = [(i, t) for i, (_, t) in whole.items()] + [(100 + i, "Some words.\n" + t) for i, (_, t) in enumerate(lines)]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].licence for i in whole} == {i: name for i, (name, _) in whole.items()}
    assert [got[100 + i].notices for i in range(len(lines))] == [x for x, _ in lines]
    digests = licences.known(spark).groupBy("digest").count()
    assert digests.where("count > 1").count() == 0
    rows = spark.createDataFrame(licence_texts.KNOWN, "licence string, text string")
    twice = licences.canonical(rows).selectExpr("licence", "units[0] as t").groupBy("t").agg({"licence": "collect_set"})
    assert twice.where("size(`collect_set(licence)`) > 1").collect() == []


def test_wrapping_does_not_matter(spark):
    """Every known text, its paragraphs wrapped anew at several widths, in a comment or not."""
    rows, want = [], {}
    for licence, text in licence_texts.KNOWN:
        if "\n" in text:
            for width in (40, 51, 66, 72, 78, 80, 100):
                paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
                wrapped = "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in paragraphs)
                for form in (wrapped, "/*\n" + textwrap.indent(wrapped, " * ", lambda line: True) + "\n */", wrapped.replace("\n", "\r\n")):
                    want[len(rows)] = licence, width
                    rows.append((len(rows), form))
    got = {r.doc_id: r.licence for r in scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert len(want) > 300
    assert [(want[i], got[i]) for i in want if got[i] != want[i][0]] == []


def test_statements_end_with_their_own_words(spark):
    mit = licence_texts.MIT
    grant = mit[mit.index("Permission is") :]
    heads = [
        "Copyright (c) 2019 Someone\n", "Copyright (c) 2019 John A. Smith, Foo Inc. and\ncontributors. ", "Copyright 2001, 2002 A\nCopyright (C) 2003 B\n\n",
        "Copyright\n(c) 2020 A very long name of a holder\nthat goes on. All rights\nreserved. ", "(c) 2020 X\n\n", "Copyright [yyyy] [name]\n\n",
    ]
    rows = [(i, "MIT License\n\n" + h + grant) for i, h in enumerate(heads)]
    rows += [(50, "MIT License\n\nCopyright (c) 2019 X\n\nPay first.\n\n" + grant), (51, "Copyright 2020 X. Licensed under the MIT License."), (52, "\ue000 \u2029")]
    got = {r.doc_id: (r.licence, r.notices) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(len(heads))] == ["MIT"] * len(heads)
    assert got[50] == (None, "") and got[51] == ("MIT", "MIT")
    assert got[52] == (None, "")
