"""Licence texts and notices under variations that do not matter."""

import re

from statloom.llm.licence_texts import FILES, NOTICES, TEXTS, known_notices
from statloom.llm.licences import MENTIONS, known, scan


def test_variants(spark):
    mit = TEXTS["MIT"]
    rows = [(1, mit), (2, mit.upper()), (3, "Copyright (c) 2020 Someone\n" + mit), (4, mit.replace("MIT License\n", "MIT License\n\nCopyright 1999 A, B\nAll rights reserved.\n")), (5, mit.replace("sublicense", "sub-licence").replace("License", "Licence")),
            (6, mit.replace(" ", "  ").replace("\n", "\r\n")), (7, mit + " extra"), (8, None), (9, ""), (10, "text\nReleased under the MIT Licence.\nmore\nreleased under the  mit license"), (10, TEXTS["Zlib"]), (None, TEXTS["0BSD"]), (11, mit.replace('"', "“"))]
    got = sorted(((r["doc_id"], r["licence"], r["n_notices"], r["notices"]) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(i, "MIT", 0, "") for i in (1, 2, 3, 4, 5, 6, 11)] + [(7, None, 0, ""), (8, None, 0, ""), (9, None, 0, ""), (10, None, 2, "MIT"), (10, "Zlib", 0, ""), (None, "0BSD", 0, "")]
    assert got == sorted(want, key=str)


def test_each_text_is_itself(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS.values())]
    got = {r["doc_id"]: r["licence"] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(TEXTS)
    got = {r["doc_id"]: r["n_notices"] for r in scan(spark.createDataFrame(list(enumerate(NOTICES.values())), "doc_id long, text string")).collect()}
    assert set(got.values()) == {1}


def test_oddities(odd, none):
    assert scan(odd).count() == odd.count() and scan(none).collect() == []


def test_long_texts_titles_and_wrapped_lines(spark):
    mit, bsd = TEXTS["MIT"].replace("MIT License\n\n", ""), TEXTS["BSD-3-Clause"]
    apache = (FILES / "Apache-2.0.txt").read_text()
    want = {f.stem: f.read_text() for f in FILES.glob("*.txt")}
    rows = [(k, v) for k, v in want.items()] + [
        ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 Some One\n\n" + mit), ("MIT", "# MIT Licence\n" + mit), ("MIT", mit), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright Some One\nAll rights reserved.\n\n" + bsd),
        ("BSD-3-Clause", bsd.replace("above copyright", "above\ncopyright")), ("MIT", mit.replace(" COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS")), ("Apache-2.0", apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2019 Some One")),
        ("Apache-2.0", apache.split("   APPENDIX")[0]), (None, apache.replace("(c) You must retain", "(c) You need not retain")), (None, "MIT License"), (None, bsd.replace("copyright notice, this list", "\ncopyright notice, no list"))]
    got = {r["doc_id"]: r["licence"] for r in scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [k for k, _ in rows]


def test_notices(spark):
    assert all(re.search(MENTIONS, line) for _, line in known_notices())
    d = spark.createDataFrame([(1, "x\nDas ist frei.\ny"), (2, "This project is licensed under the Mozilla Public Licence 2.0"), (3, "// SPDX-License-Identifier: BSD-3-Clause")], "doc_id long, text string")
    given = known(spark, {"frei": "das ist FREI"})
    assert {r["doc_id"]: r["notices"] for r in scan(d, notices=given).collect()} == {1: "frei", 2: "", 3: ""}
    assert {r["doc_id"]: r["notices"] for r in scan(d).collect()} == {1: "", 2: "MPL-2.0", 3: "BSD-3-Clause"}
