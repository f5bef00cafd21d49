"""Expected values of single operators."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import extract as X
from quarry.operators import graph as G
from quarry.operators import relational as R
from quarry.operators import retrieval as V
from quarry.sinks import versioned as K
from quarry.sources import files as L
from quarry.streaming import changes as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fnv(spark):
    assert one(spark, S.fnv1a(F.lit("abc"))) == 440920331


@pytest.mark.parametrize(("text", "limit", "want"), [("abc", 2, "ab"), ("aé", 2, "a"), ("aé", 3, "aé"), ("日本", 4, "日"), ("日本", 5, "日"), ("😀x", 3, ""), ("", 5, "")])
def test_truncate(spark, text, limit, want):
    assert one(spark, S.truncate_utf8(F.lit(text), limit)) == want


def test_lexical_score(spark):
    rows = [("1", "needle", "a", "", ""), ("2", "needle needle", "a", "", ""), ("3", "x", "a", "needle", "function"), ("4", "x", "path-needle", "", "")]
    df = spark.createDataFrame(rows, "id string, content string, filepath string, symbolname string, symboltype string")
    assert {r["id"]: r["score"] for r in V.lexical_scores(df, "needle").collect()} == {"1": 3.0, "2": 4.0, "3": 3.0, "4": 0.5}
    assert V.lexical_scores(df, "!!!").count() == 0
    assert V.top_k(df, 0, "id").count() == 0


def test_metrics(spark):
    results = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("r", "a", 1), ("r", "a", 2), ("s", "z", 1), ("s", "y", 2), ("s", "a", 3)], "query string, id string, rank int")
    relevant = spark.createDataFrame([("q", "a"), ("r", "a"), ("r", "b"), ("s", "a")], "query string, id string")
    got = {r["query"]: tuple(r)[1:] for r in V.ranked_metrics(results, relevant, 2).collect()}
    assert got["q"] == (0.5, 1.0, 0.5, 0.6309)
    assert got["r"][:3] == (0.5, 0.5, 1.0)
    assert V.ranked_metrics(results, relevant, 3).where("query = 's'").first()["ndcg"] == 0.5


def test_cursor():
    c = R.cursor({"q": 1}, 20)
    assert R.read_cursor(c, {"q": 1}) == 20
    for bad, scope in ((c, {"q": 2}), ("x", {}), ("pc1.%%", {}), ("pc1." + "a" * 2000, {})):
        with pytest.raises(ValueError):
            R.read_cursor(bad, scope)


def test_fair_budget():
    got = R.fair_budget([("a", 1, 10), ("b", 1, 1000), ("c", 2, 1000)], 600)
    assert got["a"] == 10 and sum(got.values()) == 600
    assert R.fair_budget([], 5) == {}


def test_neighbours(spark):
    df = spark.createDataFrame([("before", "f", 1, 3), ("middle", "f", 5, 8), ("after", "f", 10, 12)], "id string, filepath string, startline int, endline int")
    got = R.adjacent(df, df.where("id = 'middle'"), 1).collect()
    assert {(r["id"], r["distance"]) for r in got} == {("before", 1), ("after", 1)}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert G.shortest_path(e, 1, 4, 5).first()["path"] == [1, 2, 3, 4]
    assert G.shortest_path(e, 4, 1, 5).count() == 0
    assert [r["cycle"] for r in G.cycles(e, 3).collect()] == [[1, 2, 3]]
    start = spark.createDataFrame([(4,)], "node long")
    assert {r["node"] for r in G.impact(e, start).collect()} == {1, 2, 3}
    empty = e.limit(0)
    assert G.closure(empty, start, 3).count() == 1 and G.cycles(empty, 2).count() == 0


def test_extract():
    assert X.symbols("export class A {}\n  async function b() {}\ndef c():") == [("class", "A", 1), ("function", "b", 2), ("function", "c", 3)]
    assert X.hierarchy("class A extends B implements C, D {\n}\nclass E(F, metaclass=M):\n") == [("class", "A", ["B", "C", "D"], 1), ("class", "E", ["F"], 3)]
    assert X.hunks("--- a/x\n+++ b/x\n@@ -1,2 +3 @@\n") == [("x", 1, 2, 3, 1)]
    assert [v for _, v, _ in X.signals("app.get('/a')\n@route\nx.on('e')")] == ["/a", "route", "e"]
    assert X.imports("import { a } from './b';\nfrom c import d\n") == [("./b", 1), ("c", 2)]
    pieces = X.split_lines("aa\nbb\ncc\n" + "d" * 50, 6, 2)
    assert [p[2] for p in pieces] == ["aa\nbb", "bb\ncc", "cc\n", "\n" + "d" * 50] or pieces[-1][2].endswith("d" * 50)
    assert all(len(p) <= 20 for p in X.split_recursive("word " * 40, 20, 5))


def test_versioned(spark, tmp_path):
    t = K.VersionedTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([("1", "a.py", "x"), ("2", "b.py", "y")], "id string, filepath string, content string")
    assert t.append(rows) == 1
    new = spark.createDataFrame([("3", "a.py", "z")], "id string, filepath string, content string")
    t.replace_files(new, new.select("filepath"))
    assert {r["id"] for r in t.read().collect()} == {"2", "3"} and t.read(1).count() == 2
    with pytest.raises(ValueError):
        t.replace_files(new, rows.where("id = '2'").select("filepath"))
    assert t.compact(1, 1) == 3 and t.status()["fragments"] == 2 and t.status()["versions"] == 1


def test_versions_survive_a_crash(spark, tmp_path):
    """A manifest that was not written to its end doesn't count, whatever data lies beside it; of two writers at once one fails."""
    t = K.VersionedTable(spark, str(tmp_path / "t"), 4)
    rows = spark.createDataFrame([(str(k), f"f{k}.py", "x") for k in range(20)], "id string, filepath string, content string")
    t.append(rows)
    (tmp_path / "t" / "_manifests" / "000002.json").write_text('{"parts": {"0"')
    assert t.version() == 1 and t.read().count() == 20
    before = set((tmp_path / "t" / "data").iterdir())
    assert t.replace_files(rows.where("id = '3'").selectExpr("id", "filepath", "'y' AS content"), rows.where("id = '3'").select("filepath")) == 3
    new = set((tmp_path / "t" / "data").iterdir()) - before
    assert len(new) == 1 and len([p for p in next(iter(new)).iterdir() if p.name.startswith("bucket=")]) == 1  # one bucket was rewritten
    assert {r["content"] for r in t.read().where("id = '3'").collect()} == {"y"} and t.read().count() == 20
    t.delete_files(rows.where("id IN ('3', '4')").select("filepath"))
    assert t.read().count() == 18 and t.restore(1) == 5 and t.read().count() == 20
    with pytest.raises(Exception):
        t._fs.create(t._path(f"{t.folder}/_manifests/000005.json"), False)


def test_snapshot_is_verified(spark, tmp_path):
    t = K.VersionedTable(spark, str(tmp_path / "t"), 2)
    t.append(spark.createDataFrame([("1", "a.py", "x"), ("2", "b.py", "y")], "id string, filepath string, content string"))
    t.snapshot(str(tmp_path / "s"))
    t.delete_files(t.read().select("filepath"))
    assert t.read().count() == 0 and t.restore_snapshot(str(tmp_path / "s")) == 3 and t.read().count() == 2
    part = next((tmp_path / "s").rglob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        t.restore_snapshot(str(tmp_path / "s"))


def test_fair_budget():
    assert R.fair_budget([("a", 1.0, 100), ("b", 3.0, 100)], 40) == {"a": 13, "b": 27}
    assert R.fair_budget([("a", 1.0, 5), ("b", 3.0, 100), ("c", 1.0, 100)], 100) == {"a": 5, "b": 67, "c": 28}
    assert R.fair_budget([("a", 1.0, 5)], 100) == {"a": 5} and R.fair_budget([], 5) == {}


def test_ignore_rules(spark):
    rules = L.scan_rules("*.log\n!keep.log\n/top\nsub/\n# c\na/**/z\n", ["*.tmp"])
    paths = ["x.log", "d/keep.log", "top/a", "d/top/a", "d/sub/keep.log", "sub", "a/b/c/z", "a/z", "n.tmp", "node_modules/x/keep.log", "src/a.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r["p"] for r in df.where(~L.ignored(F.col("p"), rules)).collect()] == ["d/keep.log", "d/top/a", "sub", "src/a.py"]


def test_watch_and_reconcile(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.PY").write_text("x")
    (tmp_path / "in" / "b.py.deleted").write_text("gone")
    C.watched(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    got = {r["path"].rsplit("/", 1)[-1]: (r["change_type"], r["content"]) for r in spark.table("watched").collect()}
    assert got == {"A.PY": ("add", "x"), "b.py": ("unlink", None)}
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    had = spark.createDataFrame([("b",), ("c",)], "path string")
    assert {tuple(r) for r in C.reconciled(spark, now, had, spark.createDataFrame([("b", "9")], "path string, hash string")).collect()} == {("a", "add"), ("b", "change"), ("c", "unlink")}
    with C.Progress(spark, "a job") as p:
        spark.range(10).count()
        assert p.state()["jobs"] >= 1


def test_snapshots():
    assert K.keep_snapshots([("a", 5), ("b", 100), ("c", 3)], 3, 10) == ["a", "c"]
    assert K.keep_snapshots([("a", 50)], 1, 10) == ["a"]


def test_sources(spark, tmp_path):
    (tmp_path / "s" / ".git").mkdir(parents=True)
    (tmp_path / "s" / "a.py").write_text("x = 1")
    (tmp_path / "s" / "server.pem").write_text("x")
    (tmp_path / "s" / ".git" / "b.py").write_text("x")
    assert [r["language"] for r in L.scan(spark, str(tmp_path / "s")).collect()] == ["python"]
    with pytest.raises(ValueError):
        L.scan(spark, str(tmp_path / "s"), max_files=0)
    raw = spark.createDataFrame([("ast-grep", '[{"ruleId":"r","file":"f","message":"m","range":{"start":{"line":0}}}]'), ("semgrep", '{"results":[{"check_id":"c","path":"p","start":{"line":3},"extra":{"message":"m"}}]}'), ("sarif", '{"runs":[{"tool":{"driver":{"name":"cq"}},"results":[{"ruleId":"q","message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"u"},"region":{"startLine":7}}}]}]}]}')], "tool string, payload string")
    assert {(r["tool"], r["line"]) for r in L.findings(raw).collect()} == {("ast-grep", 1), ("semgrep", 3), ("cq", 7)}
    log = spark.createDataFrame([("l", "c1\0d1\0\n3\t1\ta.py\n-\t-\tb.png\nc2\0d2\0\n1\t0\ta.py")], "log string, text string")
    assert {tuple(r)[1:] for r in L.numstat(log).collect()} == {("c1", "d1", 3, 1, "a.py"), ("c1", "d1", None, None, "b.png"), ("c2", "d2", 1, 0, "a.py")}


def test_stream(spark, tmp_path):
    t = K.VersionedTable(spark, str(tmp_path / "t"))
    schema = "id string, filepath string, content string"
    t.append(spark.createDataFrame([("1", "a.py", "x")], schema))
    src = str(tmp_path / "in")
    spark.createDataFrame([("9", "a.py", "new")], schema).write.parquet(src)
    C.apply_changes(spark.readStream.schema(schema).parquet(src), t, str(tmp_path / "cp")).awaitTermination(60)
    assert [r["content"] for r in t.read().collect()] == ["new"]


def test_redaction(spark):
    got = one(spark, S.redact(F.lit('api_key = "abc"; Authorization: Bearer abcdefgh12345')))
    assert got == 'api_key = "[REDACTED]"; Authorization: [REDACTED] [REDACTED TOKEN]' or "abc\"" not in got


@pytest.mark.parametrize("n", [0, 1, 150_000])
def test_fingerprint_of_any_size(spark, n):
    hashed = spark.range(n).select(F.col("id").cast("string").alias("path"), F.md5(F.col("id").cast("string")).alias("hash"))
    odd = spark.createDataFrame([(None, "x")] + [("a", "y"), ("a", "x"), ("é", "z"), ("b", None)] * (n > 1), "path string, hash string")
    rows = [(str(k), hashlib.md5(str(k).encode()).hexdigest()) for k in range(n)] + [("a", "y"), ("a", "x"), ("é", "z"), ("b", None)] * (n > 1)
    text = "\n".join("\0".join(x for x in r if x is not None) for r in sorted(rows, key=lambda r: (r[0], r[1] or "")))
    assert tuple(K.fingerprint(hashed.unionByName(odd)).first()) == (hashlib.sha256(text.encode()).hexdigest()[:16], len(rows))
