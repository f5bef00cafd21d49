"""Splitting: the latest row of an id decides, one boundary array serves cutter and report, other languages cut at sections."""

import datetime as dt

from quarry.llm import splitting
from quarry.llm.splitting import Boundaries, pieces

T = [dt.datetime(2024, 1, k) for k in (1, 2)]
SCHEMA = "id string, content string, filepath string, language string, startline int, indexed_at timestamp, extra string"


def test_latest_row_decides(spark):
    long = "x = 1\n" * 300 + "def f():\n    pass\n" * 20
    rows = [
        ("shrunk", long, "r/a.py", "python", 1000, T[0], None), ("shrunk", "x = 1", "r/a.py", "python", 1000, T[1], None),
        ("grown", "x = 1", "r/b.py", "python", 1, T[0], None), ("grown", long, "r/b.py", "python", 1, T[1], None),
        ("tie", "x = 1", "r/c.py", "python", 1, T[0], None), ("tie", long, "r/c.py", "python", 1, T[0], None),
        ("null", long, "r/d.py", "python", 1, None, None), ("null", long, "r/d.py", "python", 1, None, None),
    ]
    chunks = spark.createDataFrame(rows, SCHEMA)
    options = spark.createDataFrame([("*", 1000, 200)], "language string, chunksize int, chunkoverlap int")
    assert sorted(r["id"] for r in splitting.oversized(chunks, options).collect()) == ["grown", "null", "tie"]
    cuts = splitting.natural_cuts(chunks, options)
    assert cuts.where("id = 'grown'").count() == 20
    pieces_ = splitting.split(chunks, options).where("id = 'grown' AND cut = 'natural'").selectExpr("id", "endline + 1 AS line")
    assert pieces_.join(cuts, ["id", "line"], "left_anti").count() == 0


def test_sections_of_other_languages():
    toml = "".join(f"[section{k}]\nname = \"{'v' * 30}\"\nother = {k}\n" for k in range(30))
    cuts = [(e, kind) for _, e, kind in pieces(toml, "toml", 300, 0)][:-1]
    assert {kind for _, kind in cuts} == {"section"} and all(toml[e:].startswith("[section") for e, _ in cuts)
    c = "".join(f"int f{k}(int a) {{\n  return a + {k};\n}}\n\n" for k in range(30))
    assert all(c[e:].startswith("int f") for _, e, _ in pieces(c, "c", 300, 0)[:-1])


def test_boundaries_are_sorted_offsets():
    text = "import os\n\n\n# about f\ndef f():\n    pass\n\n\nclass A:\n    def g(self):\n        pass\n"
    b = Boundaries(text, "python")
    assert [b.line(x) for x in b.natural] == [4, 9, 10]
    assert b.natural == sorted(b.natural) and b.tokens[-1] == len(text)
