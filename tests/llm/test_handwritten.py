"""Files nobody wrote: clusters that decide without marks, look-alikes that don't, folder names and headers as weak signs."""

import datetime as dt
import random

import pytest
import xxhash

from quarry.llm import handwritten
from quarry.llm.handwritten import marks
from quarry.llm.lexer import simple_tokens, tokens

WORDS = "anchor beacon cargo depot engine ferry gauge harbor index jetty kernel ledger mantle needle orchard parcel quota relay sieve ticket".split()


def _module(seed, names=None):
    """A module with a structure of its own; ``names`` gives the identifiers."""
    shape, pick = random.Random(seed), random.Random(names if names is not None else seed)
    out = []
    for _ in range(14):
        a, b, c = (f"{pick.choice(WORDS)}_{pick.randrange(99)}" for _ in range(3))
        out.append(f"def {a}({b}, {c}):\n")
        for _ in range(shape.randrange(2, 7)):
            out.append(shape.choice([f"    {b} = {c} + {shape.randrange(9)}\n", f"    if {b} > {c}:\n        return {b}\n", f"    for x in {c}:\n        {b}.append(x)\n", f"    while {b}[{c}]:\n        {c} += 1\n", f"    print({b}, {c})\n"]))
        out.append(f"    return {c}\n")
    return "".join(out)


def _table(spark, files):
    rows = [(p.split("/")[0], p, "tree-sitter", None, text, None, dt.datetime(2024, 1, 1), 1) for p, text in files.items()]
    return spark.createDataFrame(rows, "repo string, filepath string, method string, language string, content string, linecount int, parsed_at timestamp, shape int")


@pytest.fixture(scope="module")
def planted(spark):
    """Copies with edits over repositories, families of one repository, tables of literals; and code of people, some of it alike in shape."""
    files, want = {}, {}
    rng = random.Random(3)
    for k in range(12):  # vendored: the same text in four repositories, an identifier changed in some places
        base = _module(1000 + k).split("\n")
        for r in range(4):
            lines = list(base)
            for _ in range(2):
                at = rng.randrange(len(lines))
                lines[at] = lines[at].replace("x", "item")
            files[f"repo{r}/src/lib{k}_{r}.py"] = "\n".join(lines)
            want[f"repo{r}/src/lib{k}_{r}.py"] = "vendored"
    for k in range(12):  # generated: one shape with other names
        for r in range(4):
            files[f"repo{k}/app/family{k}_{r}.py"] = _module(2000 + k, names=k * 10 + r)
            want[f"repo{k}/app/family{k}_{r}.py"] = "generated"
    for r in range(4):
        files[f"repo{r}/src/table{r}.py"] = "ROWS = [\n" + "".join(f"    [{rng.randrange(9999)}, {rng.randrange(9999)}],\n" for _ in range(60)) + "]\n"
        want[f"repo{r}/src/table{r}.py"] = "data"
    for k in range(120):
        files[f"repo{k % 12}/src/own{k}.py"] = _module(5000 + k)
    for r in range(5):  # alike in shape, in repositories of their own, and named otherwise
        files[f"repo{r}/src/alike{r}.py"] = _module(9000, names=90 + r)
    return _table(spark, files), want


@pytest.mark.parametrize("use_marks", [False, True])
def test_clusters_decide(planted, use_marks):
    table, want = planted
    got = {r["filepath"]: r["verdict"] for r in handwritten.classified(table, use_marks).collect()}
    found = {k: v for k, v in got.items() if v != "hand-written"}
    both = sum(found.get(k) == v for k, v in want.items())
    assert both / len(want) >= 0.95 and both / len(found) >= 0.95


def test_weak_signs_are_not_enough():
    code = "def f(a):\n    return a + 1\n"
    assert marks("r/deps/own.py", "python", code)[0] is None
    assert marks("r/deps/lib-1.2/own.py", "python", code)[0] == "vendored"
    assert marks("r/src/a.py", "python", "# Config reader, generated class wrapper\n" + code)[0] is None
    assert marks("r/src/a.py", "python", "# Generated by protoc 3.1. Do not edit.\n" + code)[0] == "generated"


def test_empty(spark):
    assert handwritten.classified(_table(spark, {"r/a.py": "x"}).limit(0)).count() == 0


@pytest.mark.parametrize(
    ("lang", "text", "alone"),
    [
        ("python", "#!/usr/bin/python\nx = f'{a}' + r\"b\" \\\n  + 0x1F  # c\n", True), ("python", 'x = r"open\n', False), ("javascript", "let a = `x ${y} \\` z` ?? #b; // c\n", True), ("javascript", "a = b / c\n", False),
        ("javascript", "a = f(1) / 2; b = c.match(/[/(]x/g, /y/)[0] /= 3;\n", True), ("typescript", "return /x/.test(a)\n", False), ("php", "<?php\n$a = 'b'; # c\n#\n", True), ("php", "<?php $a ?>\n<b>\n", False), ("php", "<?php $a = <<<X\nb\nX;\n", False),
        ("typescript", "let a = `x ${`y`}`\n", False), ("go", "a := `x\ny` /* c */ + 'r'\n", True), ("csharp", '#region A\nvar a = $"{b}" + @"c""d";\n', True), ("rust", "let a = r##\"b\"##; fn f<'a>(x: &'a str) { 'x' }\n", True),
        ("rust", "/* a /* b */ c */ let d = 1;\n", False), ("java", '/** d */ char c = \'"\'; String s = """\n a "b" """;\n', True), ("php", "<?php # c\n#[A]\n", False), ("ruby", "a = <<~X\n b\nX\n", False),
    ],
)
def test_scan_without_context(lang, text, alone):
    want, seen = tokens(text, lang), handwritten.scan(text, lang)
    assert (simple_tokens(text, lang) is not None) is alone
    assert seen.texts == [t[1] for t in want] and bytes(seen.kinds).decode() == "".join(t[0] for t in want)
    assert seen.sizes.tolist() == [len(t[1]) for t in want]
    codes = [xxhash.xxh64_intdigest(t[1]) - (1 << 63) for t in want if t[0] not in "cl"]
    assert seen.plain.tolist() == codes
    handwritten._WORDS.get(lang, handwritten._WORDS["go"]).reset()
    assert handwritten.scan(text, lang).plain.tolist() == codes


def test_texts_hashed_together_as_alone():
    texts = ["a", "x = 1\n", "\n".join(f"def f{k}(a, b):\n    return a + {k} * b\n" for k in range(30)), "a b c d e", "g(" + ", ".join(map(str, range(40))) + ")\n"]
    scans = [(k, x.plain, x.masked()) for k, x in enumerate(handwritten.scan(t, "python") for t in texts)]
    rows = [("f", "r", "python", None, 0.0, *[None] * 5) for _ in texts]
    together = list(rows)
    handwritten._shape(together, scans)
    for scan in scans:
        handwritten._shape(rows, [scan])
    assert rows == together and all(r[6] == len(set(_runs(s[2], 16))) for r, s in zip(rows, scans, strict=True))


def _runs(codes, size):
    return [tuple(codes[k : k + size]) for k in range(max(1, len(codes) - size + 1))]
