"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import base64
import datetime
import random

import pytest

pytest.importorskip("quarry.llm")
import numpy as np
from pyspark.sql import functions as F

from quarry.llm import credentials, documented, handwritten, leaks, mixture, sentences, similar, splitting, validity

NOW, LATER = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
# names that operators use inside
EXTRA = ["r", "row", "cid", "rank", "pos", "gram", "tokens", "cell", "band", "shape", "block", "start", "list", "e", "k", "text2", "item", "df", "cluster", "bucket", "h", "path", "line", "words"]
CHUNK = "id string, content string, filepath string, language string, startline int, endline int, symbolname string, symboltype string, vector array<float>, repo string, indexed_at timestamp"
PARSE = "repo string, filepath string, method string, language string, content string, linecount int, parsed_at timestamp"
DOC = "doc_id long, text string, lang string, source string, n_chars long, repo string, title string, updated_at timestamp"
LONG = "word " * 60_000


def wide(df):
    return df.select("*", *[F.lit("x").alias(c) for c in EXTRA if c not in df.columns])


def vec(*head):
    return [float(x) for x in head] + [0.0] * (64 - len(head))


@pytest.fixture(scope="module")
def chunks(spark):
    def row(i, content="x", path="r/a.py", lang="python", start=1, vector=None, at=NOW):
        return (i, content, path, lang, start, None, None, "", vector, "r", at)

    rows = [
        row("a", vector=vec(1, 0.1)), row("a", vector=vec(1, 0.1), at=LATER), row("b", vector=vec(1, 0.12)), row("c", vector=vec(1, 0.1)), row("d", vector=vec(0, 1)),
        row("e", vector=vec()), row("f", vector=[float("nan")] * 64), row("g", vector=[1.0] * 32), row("h", vector=None), row(None, vector=vec(1, 0.1)), row("i", vector=[None] * 64), row("j", vector=[float("inf")] + [0.0] * 63),
        row("k", content=None), row("l", content=""), row("m", content='api_key = "Zq8vT4kLw2Rx9Bn6"\r\npassword = ""\n', path="./r\\cfg.py", lang=None, start=None),
        row("n", content='password = "Zq8vT4kLw2Rx9Bn6"', lang="PYTHON", start=7), row("n", content='password = "Zq8vT4kLw2Rx9Bn6"', lang="PYTHON", start=7, at=LATER),
        row("o", content="x" * 5000, path=None, lang=None), row("p", content=LONG, path="r/t.unknown", lang=None), row("q", content="def a():\n    pass\n" * 200 + "\nclass B:\n    pass\n", path="r/z.py"),
    ]
    return wide(spark.createDataFrame(rows, CHUNK))


@pytest.fixture(scope="module")
def options(spark):
    return spark.createDataFrame([("python", 1200, 200), ("*", 1000, 200), (None, 1, 1), ("go", None, None)], "language string, chunksize int, chunkoverlap int")


@pytest.fixture(scope="module")
def parses(spark):
    good = "# Adds the two numbers that the caller hands over.\ndef add(a, b):\n    return a + b\n"
    rows = [
        ("r", "r/a.py", "tree-sitter", "python", "def (:", 1, NOW), ("r", "./r\\a.py", None, None, good, None, LATER), ("r", "r/a.py", None, "PYTHON", good, None, LATER), ("r", "r/b.py", None, "python", "def f(:\n", None, NOW),
        ("r", "r/c.py", None, "python", "", None, None), ("r", "r/d.py", None, "python", None, None, NOW), ("r", None, None, "python", good, None, NOW), (None, "r/e.py", None, "python", good, None, None),
        ("r", "r/long.py", None, None, "x = 1\n" * 30_000, None, NOW), ("r", "r/x.weird", None, None, "?", None, NOW), ("r", "r/empty.json", None, "json", " ", None, NOW),
    ]
    return wide(spark.createDataFrame(rows, PARSE))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "One. Two! Three?", "en", " Wiki ", 3, "r", None, NOW), (1, "One. Two! Three?", "en", " Wiki ", 3, "r", None, NOW), (2, None, None, "wiki", None, None, None, None), (3, "", "xx", "wiki", 0, None, None, NOW), (4, LONG, None, "forum", None, None, None, NOW),
        (None, "No id.", "en", "wiki", 1, None, None, NOW), (5, "a b c d e f g h i j k l m n", "en", None, None, None, None, NOW), (6, "zero A, b; C d e f g h i j k l end", "en", "readme", None, None, None, NOW), (7, "   \n\n", "en", "readme", None, None, None, NOW),
    ]
    return wide(spark.createDataFrame(rows, DOC))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "A b c d e f g h i j k l", "en", "s"), (1, "A b c d e f g h i j k l", "en", "s"), (2, None, None, None), (3, "", None, None), (4, "too short", None, None), (None, "a b c d e f g h i j k l", None, None)], "item_id long, text string, lang string, suite string")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("wiki", 1.0, None), ("forum", 1.0, 2), ("glossary", 0.5, 9), (None, 1.0, 1), ("readme", 0.0, 1)], "source string, weight double, max_repeats int")


def test_similar(chunks):
    got = {tuple(r) for r in similar.pairs(chunks).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    assert {r["id"] for r in similar.neighbours(chunks, min_cosine=0.9).collect()} == {"a", "b", "c"}
    assert similar.pairs(chunks.limit(0)).count() == 0


def test_similar_copies(spark):
    """A group of copies costs each member at most k partners, the smallest ids."""
    rows = [(f"c{i:03d}", "x", "p", "python", 1, 1, None, None, vec(1, 2), "r", NOW) for i in range(300)]
    got = similar.pairs(spark.createDataFrame(rows, CHUNK)).collect()
    assert len(got) == 300 * 5 - 15 and {r["id_a"] for r in got} == {f"c{i:03d}" for i in range(5)}


@pytest.mark.parametrize(("n", "cap", "least"), [(400, 20, 1.0), (1_900_000, 20_000, 0.9)])
def test_similar_recall(spark, n, cap, least):
    """A hot cell of many blocks is compared in full, and the projections of a large collection keep recall at cosine 0.9."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((400, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    if cap < 400:  # one group whose members are close to one centre, in cells of at least 160 = 8 blocks of 20
        x = x[0] + 0.04 * z
    else:
        x = np.concatenate([x, 0.902 * x + np.sqrt(1 - 0.902**2) * z])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(c, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-c[i])[:1] if c[i, j] >= 0.9}
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cid long, vector array<float>")
    got = {(r["ca"], r["cb"]) for r in similar.class_neighbours(classes, n, cell_cap=cap).select("ca", "cb").collect()}
    assert len(want) >= 390 and len(want & got) >= least * len(want)


def test_credentials(chunks):
    assert {(r["id"], r["line"]) for r in credentials.locate(chunks).collect()} == {("m", 1), ("n", 7)}
    out = {r["id"]: r for r in credentials.redacted(chunks).collect()}
    assert out["k"]["content"] is None and out["l"]["content"] == "" and len(out) == 17
    assert out["m"]["content"] == 'api_key = "Xx0xX0xXx0Xx0Xx0"\r\npassword = ""\n' and out["m"]["n_credentials"] == 1
    assert credentials.locate(chunks.limit(0)).count() == 0


@pytest.mark.parametrize(
    "line",
    ["mysqldump -uroot -pZq8vT4kLw2 shop", "redis-cli -a Zq8vT4kLw2", "redis-cli --pass Zq8vT4kLw2", *(f'{k} = "Zq8vT4kLw2Rx9Bn6"' for k in ("deploy_key", "deployKey", "storageKey", "storage-key", "master-key", "account-key", "auth", "key", "pass", "pw"))],
)
def test_credential_keywords(line):
    """Each line that a rule matches reaches the rules."""
    assert len(credentials.find(line, "shell")) == 1


def test_credential_long():
    """A token has no upper length."""
    head = base64.urlsafe_b64encode(b'{"alg":"RS256","x5c":"' + b"Zq8vT4kL" * 400 + b'"}').decode().rstrip("=")
    token = f"{head}.eyJ{'aB3dE5' * 1000}.{'xY7zW9' * 40}"
    assert [(a, b, k) for _, a, b, k in credentials.find(f"x {token} y", None)] == [(2, 2 + len(token), "jwt")]


def test_splitting(chunks, options):
    assert {(r["id"], r["line"]) for r in splitting.natural_cuts(chunks, options).where("line > 400").collect()} == {("q", 402)}
    rows = splitting.split(chunks, options).collect()
    assert {r["id"] for r in rows} == {"o", "p", "q"}
    for r in rows:
        assert len(r["content"]) <= (1200 if r["id"] == "q" else 1000) and r["end_char"] - r["start_char"] == len(r["content"])
    text = {r["id"]: r["content"] for r in chunks.where("id in ('o', 'p', 'q')").collect()}
    for i in text:  # an exact round trip
        mine = sorted((r for r in rows if r["id"] == i), key=lambda r: r["piece"])
        assert mine[0]["start_char"] == 0 and mine[-1]["end_char"] == len(text[i])
        assert all(b["start_char"] == a["end_char"] - 200 for a, b in zip(mine, mine[1:]))
        assert all(text[i][r["start_char"] : r["end_char"]] == r["content"] for r in mine)
    assert splitting.split(chunks, options.limit(0)).where("id = 'o'").count() > 0
    assert splitting.split(chunks.limit(0), options).count() == 0


def test_documented(parses):
    assert {tuple(r) for r in documented.found(parses).collect()} == {("r/a.py", 2), ("r/e.py", 2)}
    assert {r["origin"] for r in documented.pairs(parses).collect()} == {"own"}
    assert documented.pairs(parses.limit(0)).count() == 0


def test_documented_elsewhere(spark):
    """A definition takes the documentation of the bodyless declaration with its signature, not of another overload."""
    api = "interface Store {\n  /** Puts the given value under its key and returns the old one. */\n  public int put(String k, int v);\n}\n"
    impl = "class Disk implements Store {\n  public int put(final String k, int v) {\n    return 1;\n  }\n  public int put(String k) {\n    return 2;\n  }\n}\n"
    df = spark.createDataFrame([("r", "r/A.java", None, "java", api, None, NOW), ("r", "r/B.java", None, "java", impl, None, NOW)], PARSE)
    got = {(r["filepath"], r["line"], r["origin"]) for r in documented.pairs(df).collect()}
    assert got == {("r/A.java", 3, "own"), ("r/B.java", 2, "declaration")}


def test_handwritten(spark, parses):
    assert {r["verdict"] for r in handwritten.classified(parses).collect()} == {"hand-written"}
    assert handwritten.classified(parses.limit(0)).count() == 0
    gen = "// Code generated by x. DO NOT EDIT.\npackage a\n"
    body = "package a\n" + "".join(f"func (x *T{i}) Get{i}() int {{\n\tif x != nil {{\n\t\treturn x.v\n\t}}\n\treturn 0\n}}\n" for i in range(12))
    rows = [("r", "r/one.go", None, "go", gen, None, NOW)] + [("r", f"r/f{k}.go", None, "go", body.replace("T", "ABC"[k]), None, NOW) for k in range(3)]
    got = {r["filepath"]: r["verdict"] for r in handwritten.classified(spark.createDataFrame(rows, PARSE)).collect()}
    assert set(got.values()) == {"generated"}


def test_handwritten_chain(spark):
    """Files of which only neighbours are similar form one cluster, whichever comes first in a bucket."""
    rng = random.Random(1)
    signs = "if for return func switch case range go defer select + - * / % & | ^ < > ! = ( ) [ ] { } , ; :".split()
    toks, rows = [rng.choice(signs) for _ in range(600)], []
    for k in range(6):
        toks[k * 80 : k * 80 + 30] = [rng.choice(signs) for _ in range(30)]
        rows.append((f"r{k}", f"r{k}/a.go", None, "go", "\n".join(" ".join(toks[i : i + 20]) for i in range(0, 600, 20)), None, NOW))
    got = {r["filepath"]: r["verdict"] for r in handwritten.classified(spark.createDataFrame(rows, PARSE)).collect()}
    assert len(got) == 6 and set(got.values()) == {"vendored"}


def test_handwritten_buckets(spark):
    """A pair that fails against the smallest shape of its bucket is compared too, in buckets of several blocks as well."""
    rows = [(k, 100, 7, k) for k in range(1, 8)] + [(8, 10, 7, 8)]
    banded = spark.createDataFrame(rows, "shape long, size int, band long, cluster long")
    want = {(a, b) for a in range(1, 8) for b in range(a + 1, 8)}
    for block in (2000, 3):
        old, handwritten.BLOCK = handwritten.BLOCK, block
        try:
            assert {tuple(r) for r in handwritten._in_buckets(banded).collect()} == want
        finally:
            handwritten.BLOCK = old
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 20)] + [(40, 30)], "shape long, other long")
    assert {tuple(r) for r in handwritten.components(links).collect()} == {(k, 1) for k in range(1, 21)} | {(40, 30), (30, 30)}


@pytest.mark.parametrize(("language", "text"), [
    ("yaml", "# Licensed to all.\n" * 40 + "---\n# Code generated by x. DO NOT EDIT.\na: 1\n"), ("toml", "\n# Licence\n" * 9 + "# This file was generated by x.\na = 1\n"),
    ("html", "<!--\n" + "licence\n" * 20 + "Code generated by x.\n-->\n<p>\n"), ("json", '{\n"dependencies": {' + '"a": 1,\n' * 2000 + '"b": 2},\n"lockfileVersion": 3}'),
])
def test_handwritten_late_notice(language, text):
    assert handwritten.marks(f"r/deps.{language}", language, text)[0] == "generated"
    assert handwritten.marks(f"r/a.{language}", language, "a: 1\n" * 9 + "# Code generated by x.\n")[0] is None


def test_handwritten_short_and_edited(spark):
    """Copies of a short file, and copies with scattered edits, are vendored."""
    rng = random.Random(2)
    signs = "if for return func switch case range go defer select + - * / % & | ^ < > ! = ( ) [ ] { } , ; :".split()
    base, rows = [rng.choice(signs) for _ in range(500)], []
    for k in range(3):
        toks = list(base)
        for at in range(0, 500 * (k > 0), 100):
            toks[at + 30 * k] = "fallthrough"
        rows.append((f"r{k}", f"r{k}/edited.go", None, "go", "\n".join(" ".join(toks[i : i + 20]) for i in range(0, 500, 20)), None, NOW))
        rows.append((f"r{k}", f"r{k}/short.go", None, "go", "package a\nfunc Get(x *T) int {\n\tif x != nil {\n\t\treturn x.v\n\t}\n\treturn 0\n}\n", None, NOW))
    got = {r["filepath"]: r["verdict"] for r in handwritten.classified(spark.createDataFrame(rows, PARSE)).collect()}
    assert len(got) == 6 and set(got.values()) == {"vendored"}


def test_validity(parses):
    got = {r["filepath"]: r["valid"] for r in validity.judged(parses).collect()}
    assert got == {"r/a.py": True, "r/b.py": False, "r/c.py": True, "r/e.py": True, "r/long.py": True, "r/empty.json": False}
    assert sum(r["files"] for r in validity.rates(parses).collect()) == 6
    assert validity.judged(parses.limit(0)).count() == 0


def test_leaks(docs, items):
    assert {tuple(r) for r in leaks.found(docs, items).collect()} == {(1, 5), (1, 6)}
    assert leaks.found(docs.limit(0), items).count() == 0 and leaks.found(docs, items.limit(0)).count() == 0
    assert {r["doc_id"] for r in leaks.leaked_documents(docs, items).collect()} == {5, 6}


def test_leaks_edited(spark):
    """A copy with one word in seven changed is found, and also beside an unedited copy."""
    text = [f"w{i}" for i in range(70)]
    edited = [f"x{i}" if i % 7 == 3 else w for i, w in enumerate(text)]
    items = spark.createDataFrame([(1, " ".join(text), "en", "s")], "item_id long, text string, lang string, suite string")
    rows = [(1, " ".join(edited)), (2, " ".join(text)), (3, "nothing of the kind is said in this text at all")]
    for some in (rows, [r for r in rows if r[0] != 2]):
        got = leaks.leaked_documents(spark.createDataFrame(some, "doc_id long, text string"), items).collect()
        assert {r["doc_id"] for r in got} == {r[0] for r in some if r[0] != 3}


def test_mixture(docs, targets):
    got = {r["source"]: r for r in mixture.shares(docs, targets).collect()}
    assert set(got) == {"wiki", "forum", "glossary"} and not got["glossary"]["feasible"] and got["forum"]["feasible"]
    assert {r["source"] for r in mixture.unreachable(docs, targets).collect()} == {"wiki", "glossary"}
    rows = mixture.mix(docs, targets, slot_tokens=1000).collect()
    assert max(r["pass"] for r in rows) <= 1 and {r["doc_id"] for r in rows} <= {1, 4}
    assert mixture.report(docs, targets).count() == 3
    assert mixture.mix(docs.limit(0), targets).count() == 0 and mixture.shares(docs, targets.limit(0)).count() == 0


def test_sentences(docs):
    got = sentences.sentences(docs)
    assert [r["sentence"] for r in got.where("doc_id = 1").orderBy("position").collect()] == ["One.", "Two!", "Three?"]
    assert got.where("doc_id IN (2, 3, 7)").count() == 0 and got.where("doc_id = 4").count() == 1
    assert sentences.sentences(docs.limit(0)).count() == 0
