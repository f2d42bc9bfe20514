import duckdb
import pandas as pd

from tests.llm.conftest import DATA
from tracemill.llm import license_scan as ls

APACHE = "Licensed under the Apache License, Version 2.0."


def scanned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, licence string")
    return {(r.doc_id, r.path): r for r in ls.scan(df).collect()}


def test_headers_files_and_inheritance(spark):
    code = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau\n" * 4
    rows = [
        (1, "a/LICENSE", code + "All rights reserved.", "x"), (2, "a/b/one.py", code, "x"), (3, "a/b/c/two.py", code + APACHE, "x"), (4, "a/b/c/LICENSE.txt", "\n" + APACHE + "\n" + code, "x"),
        (5, "a/b/c/d/three.py", code, "x"), (6, "other/four.py", code, "x"), (7, "top.py", code, "x"), (8, "ab/five.py", code, "x"), (9, "a/b/six.py", "license of words that match nothing much at all here", "x"),
    ]
    got = scanned(spark, rows)
    brief = {k[0]: (r.own_licence, r.is_file, r.inherited_licence, r.inherited_from, r.licence) for k, r in got.items()}
    assert brief == {
        1: ("Proprietary", True, None, None, "Proprietary"), 2: (None, False, "Proprietary", "a", "Proprietary"), 3: ("Apache-2.0", False, None, None, "Apache-2.0"), 4: ("Apache-2.0", True, None, None, "Apache-2.0"),
        5: (None, False, "Apache-2.0", "a/b/c", "Apache-2.0"), 6: (None, False, None, None, None), 7: (None, False, None, None, None), 8: (None, False, None, None, None), 9: (None, False, "Proprietary", "a", "Proprietary"),
    }


def test_odd_rows(spark):
    rows = [(1, "d/COPYING", APACHE, "x"), (2, "d/x", None, "x"), (3, "d/y", "", "x"), (4, None, APACHE, "x"), (None, "d/z", "words", "x"), (5, "d/w", ("word " * 50 + "\n") * 4000 + APACHE, "x")]
    got = scanned(spark, rows + rows[:1])
    assert {k[0]: r.licence for k, r in got.items()} == dict.fromkeys([1, 2, 3, 4, None, 5], "Apache-2.0")
    assert got[4, None].inherited_from is None and got[5, "d/w"].own_licence == "Apache-2.0"
    assert scanned(spark, []) == {}


def test_root_directory_inherits(spark):
    got = scanned(spark, [(1, "/LICENSE", APACHE, "x"), (2, "/src/a", "text", "x")])
    assert got[2, "/src/a"].licence == "Apache-2.0"


def test_every_template_finds_itself(spark):
    rows = [(i, f"p{i}/x", "lead\n" + text, "x") for i, (_, text) in enumerate(ls.TEMPLATES)]
    got = scanned(spark, rows)
    assert [(i, got[i, f"p{i}/x"].own_licence) for i in range(len(rows))] == [(i, name) for i, (name, _) in enumerate(ls.TEMPLATES)]


def test_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.01/documents.parquet'")
    want = c.sql(ls.sql()).df().sort_values("doc_id").reset_index(drop=True)
    got = ls.op2_license_scan(spark, f"{DATA}/sf0.01").toPandas().sort_values("doc_id").reset_index(drop=True)[want.columns]
    pd.testing.assert_frame_equal(got.astype(object).where(got.notna(), None), want.astype(object).where(want.notna(), None), check_dtype=False)


def brute(texts):
    """The greatest cosine of each one-line text, by the definition."""
    import math
    import re
    from collections import Counter

    cut = lambda text: re.findall(ls.TERM, text.lower())
    df = Counter(t for text in texts for t in set(cut(text)))

    def unit(text):
        w = {t: k * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, k in Counter(cut(text)).items()}
        return {t: x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}

    known = [(name, unit(text)) for name, text in ls.TEMPLATES]
    out = []
    for text in texts:
        u = unit(text)
        out.append(max(((round(sum(u[t] * v.get(t, 0) for t in u), 6), -i, name) for i, (name, v) in enumerate(known)), default=None))
    return out


def test_cosines_do_not_depend_on_the_size_of_the_corpus(spark):
    block = ["This file is licensed under the MIT License.", "See the LICENSE file for this", "Licensed under the Apache License, Version 2.0, see file"] + ["this file is for words of prose and see the rest"] * 17 + ["plain words only"] * 30
    cosines = []
    for times in (4, 20, 400):
        texts = block * times
        got = scanned(spark, [(i, f"p{i}/x", t, "x") for i, t in enumerate(texts)])
        want = brute(texts)
        for i in range(3):
            r = got[i, f"p{i}/x"]
            assert (r.own_licence, r.cosine) == ((want[i][2], want[i][0]) if want[i][0] >= ls.MIN_COSINE else (None, None))
        assert got[0, "p0/x"].own_licence == "MIT" and got[2, "p2/x"].own_licence == "Apache-2.0"
        cosines.append(got[0, "p0/x"].cosine)
    assert max(cosines) - min(cosines) < 0.05


def comment(text, mark):
    import textwrap

    return "\n".join(f"{mark} {line}".rstrip() for p in text.split("\n") for line in (textwrap.wrap(p, 68) or [""]))


def test_file_heads_and_full_texts_of_each_licence(spark):
    """Full wordings in comments of several styles, with a copyright line and code behind; SPDX tags."""
    longest = {}
    for name, text in ls.TEMPLATES:
        if len(text) > len(longest.get(name, "")):
            longest[name] = text
    code = "\n\n" + "\n".join(f"def f{i}(alpha, beta): return gamma{i}" for i in range(30)) + "\n"
    rows, want = [], {}

    def add(text, licence):
        want[len(rows)] = licence
        rows.append((len(rows), f"p{len(rows)}/x.py", text, "x"))

    long = [n for n in longest if len(longest[n].split()) > 20]
    assert {"AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib"} <= set(long)
    for mark in ("#", " *", "//"):
        for name in long:
            add(comment(f"Copyright (c) 2021 Jane Doe\n\n{longest[name]}", mark) + code, name)
    add("ISC License\n\nCopyright (c) 2004-2010 by Some Body, Inc.\n\n" + longest["ISC"], "ISC")
    add("BSD 2-Clause License\n\nCopyright (c) 2019, Jane Doe\nAll rights reserved.\n\n" + longest["BSD-2-Clause"], "BSD-2-Clause")
    for tag, licence in (("MIT", "MIT"), ("GPL-3.0-or-later", "GPL-3.0"), ("Foo-1.0", "Foo-1.0"), ("(MIT OR Apache-2.0)", "MIT OR Apache-2.0"), ("LGPL-2.1+", "LGPL-2.1")):
        add(f"// SPDX-License-Identifier: {tag}" + code, licence)
    for line, licence in (("Released under the MIT License.", "MIT"), ("Distributed under the GNU General Public License, version 3", "GPL-3.0"), ("Released under the Wobble License.", None)):
        add("alpha beta\n" + line + code, licence)
    rows += [(1000 + i, f"q{i}/x", "the license of words under terms of use for the work, version one, is not here\n" * (i % 3) + code, "x") for i in range(200)]
    got = scanned(spark, rows)
    wrong = {i: (got[i, rows[i][1]].own_licence, w, got[i, rows[i][1]].cosine) for i, w in want.items() if got[i, rows[i][1]].own_licence != w}
    assert wrong == {}
    assert all(r.own_licence is None for (i, _), r in got.items() if i >= 1000)


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "d/LICENSE", APACHE), ("a", "d/COPYING", "Licensed under the MIT License"), (None, "d/x", "text")], "doc_id string, path string, text string")
    assert {r.doc_id: r.licence for r in ls.scan(df).collect()} == {"b": "Apache-2.0", "a": "MIT", None: "MIT"}
