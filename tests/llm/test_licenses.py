import os

import duckdb
import pytest

from shelfcast.llm import licenses

from .edge import ROWS, frame

MIT = """The MIT Licence (MIT)

Copyright (c) 2019-2024 Some One <some@one.example>
All rights reserved.

""" + licenses.MIT.replace("Software", "SOFTWARE").replace('"', "“").replace(", ", " ,\n  ")
TEXTS = [
    MIT,
    licenses.MIT,
    licenses.MIT + " and more",
    "// " + licenses.ZLIB.replace("\n", "\r\n// "),
    "© 2020 A. Person\n" + licenses.BSD_GRANT + licenses.BSD_NAMES.replace("holder", "owner") + licenses.BSD_WARRANTY.replace("HOLDER", "OWNER"),
    "Some prose.\nReleased under the MIT License.\nMore prose.\n * licensed  under CC-BY-NC 4.0\nreleased under the mit licence",
    "This work is licensed under the GNU General Public License, version 3.",
    "Copyright law says much, and all of this line is prose.\nThis is not released under the MIT License.",
    "copyright: nobody", "", None, "SPDX-License-Identifier: Apache-2.0",
]


def test_variants_of_known_texts(spark):
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)])
    got = {r.doc_id: r for r in licenses.scan(docs, licenses.known()).collect()}
    assert [got[i].license for i in range(12)] == ["MIT", "MIT", None, "Zlib", "BSD-3-Clause", None, "GPL-3.0", None, None, None, None, "Apache-2.0"]
    assert [got[i].notices for i in range(5, 12)] == ["CC-BY-NC-4.0,MIT", "GPL-3.0", "", "", "", "", "Apache-2.0"]
    assert [got[i].n_notices for i in range(5, 9)] == [3, 1, 0, 0]
    assert got[0].text_digest != got[1].text_digest and got[8].text_digest == got[9].text_digest == got[10].text_digest


def test_same_as_sql(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(100 + i, *r[1:]) for i, r in enumerate(ROWS)]
    docs = frame(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = con.execute(licenses.SQL).fetchall()
    cols = [d[0] for d in con.description]
    got = licenses.scan(docs, licenses.known()).select(cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_edges(spark):
    got = licenses.scan(frame(spark), licenses.known()).toPandas()
    assert len(got) == len(ROWS) and (got.n_notices == 0).all()
    twice = frame(spark, [(1, "Released under the MIT License.", "en", "s", 0)] * 2 + [(None, "Released under the MIT License.", "en", "s", 0)] * 2)
    assert [(r.notices, r.n_notices) for r in licenses.scan(twice, licenses.known()).collect()] == [("MIT", 1)] * 4
    assert licenses.scan(frame(spark, []), licenses.known()).count() == 0


@pytest.mark.parametrize("line", ["Copyright (C) 2020", "  # copyright © me", "(c) 1999 x", "© x", "All rights reserved."])
def test_copyright_lines_go(spark, line):
    df = spark.createDataFrame([(f"a b\n{line}\nc",)], "t string")
    assert df.select(licenses.canonical_lines(df.t)).first()[0] == ["a b", "c"]


def test_bodies_from_a_folder(spark, tmp_path):
    """Whole texts as a table; case, copyright lines, spelling and layout may differ."""
    bodies = {f"Licence {k}": "\n".join(f"{i}. The licensor of work {k} grants the organization, \"as is\", clause {i * k}." for i in range(1, 400)) for k in (1, 2, 3)}
    for name, body in bodies.items():
        (tmp_path / f"{name}.txt").write_text(body)
    texts = licenses.from_folder(spark, f"file://{tmp_path}")
    assert {r.license for r in texts.collect()} == set(bodies)
    one, two = bodies["Licence 1"], bodies["Licence 2"]
    docs = [one, "Copyright 2020 Some One\n" + two.upper().replace("LICENSOR", "Licensor"), two.replace("organization", "organisation").replace("\n", "\r\n\n"), one + " more", one[:-4], None]
    rows = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(docs)])
    for most in (10_000, 1):
        got = {r.doc_id: r.license for r in licenses.scan(rows, texts, most=most).collect()}
        assert got == {0: "Licence 1", 1: "Licence 2", 2: "Licence 2", 3: None, 4: None, 5: None}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_public_licence_texts(spark, tmp_path):
    for name in ("Apache-2.0", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0"):
        path = f"/usr/share/common-licenses/{name}"
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                (tmp_path / f"{name}.txt").write_text(f.read())
    texts = licenses.from_folder(spark, f"file://{tmp_path}").cache()
    changed = [(i, "(c) 2021 A. Person\n\n" + r.text.title().replace("\n", "\n\n"), r.license, "s", 0) for i, r in enumerate(texts.collect())]
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, changed), texts).collect()}
    assert got == {i: name for i, _, name, _, _ in changed} and len(got) >= 1
