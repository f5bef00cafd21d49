"""Project metadata, memory and task operators on small tables with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import memory as M
from quarry.operators import relational as R
from quarry.sources import files as L
from quarry.sources import project as J

FILES = [
    ("web", "package.json", '{"name": " shop ", "workspaces": {"packages": ["a/*"]}, "dependencies": {"React": "1"}, "devDependencies": {"vite": "2", "react": "1"}}'),
    ("web", "yarn.lock", ""), ("web", "src/index.ts", "x"), ("web", "src/a.test.ts", "x"), ("web", "tests/unit/b.ts", "x"), ("web", "CODEOWNERS", "* @a\n# c"), ("web", "docs/CODEOWNERS", "no"),
    ("py", "pyproject.toml", '[tool.x]\nname = "no"\n[project]\nname = "calc"\ndependencies = ["fastapi"]\n'), ("py", "calc/__init__.py", ""), ("py", "node_modules/x/package.json", "{}"), ("py", ".github/ci.yml", ""), ("py", ".idea/x.yml", ""),
    ("go", "go.mod", "module example.org/tool\n"), ("go", "lib/a.go", "x"), ("bare", "src/a.rs", "x"), ("bad", "package.json", "{"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "repo string, path string, content string").cache()


def test_manifests(files):
    got = {(r["repo"], r["path"]): r for r in J.manifest_facts(files).collect()}
    web = got["web", "package.json"]
    assert (web["name"], web["dependencies"], web["workspaces"], web["package_manager"]) == ("shop", ["react", "vite"], ["a/*"], "yarn")
    assert got["py", "pyproject.toml"]["name"] == "calc" and got["go", "go.mod"]["name"] == "example.org/tool" and got["bad", "package.json"]["name"] is None and got["bad", "package.json"]["package_manager"] == "npm"
    assert {(r["repo"], r["framework"], r["category"]) for r in J.frameworks(files).collect()} == {("web", "React", "ui"), ("web", "Vite", "build"), ("py", "FastAPI", "web")}


def test_profiles(files):
    got = {r["repo"]: r for r in J.project_profile(files).collect()}
    assert {k: v["project_kind"] for k, v in got.items()} == {"web": "workspace", "py": "application", "go": "library", "bare": "unknown", "bad": "library"}
    assert {k: v["project_name"] for k, v in got.items()} == {"web": "shop", "py": "calc", "go": "example.org/tool", "bare": "bare", "bad": "bad"}
    assert (got["web"]["entrypoints"], got["web"]["test_files"], got["web"]["test_roots"]) == (1, 2, 2)
    assert {r["path"] for r in J.discover(files.where("repo = 'py'")).collect()} == {"pyproject.toml", ".github/ci.yml"}


def test_owners_and_aliases(files):
    assert [(r["line"], r["text"]) for r in J.owners(files).orderBy("line").collect()] == [(1, "* @a"), (2, "# c")]
    text = '{ // c\n "compilerOptions": { /* "x" */ "baseUrl": "./src", "paths": { "@core/*": ["core/*", "no/*"], "@app": ["app.ts"], "@e": [] }, } }'
    assert J.path_aliases(text) == {"@core/": "src/core/", "@app": "src/app.ts"} and J.path_aliases("{") == {}


def test_paths_stay_inside(spark):
    paths = ["a", "../b", "x/../../b", "/srv/a/b", "/srv/ab", "C:/x", "a\\..\\b", "."]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", J.within_root(F.col("p"), "/srv/a").alias("ok"))
    assert {r["p"]: r["ok"] for r in df.collect()} == {"a": True, "../b": False, "x/../../b": False, "/srv/a/b": True, "/srv/ab": False, "C:/x": False, "a\\..\\b": True, ".": True}


def test_state_files(spark, tmp_path):
    path = str(tmp_path / "state.json")
    J.write_state(path, [{"id": "1", "n": 2}])
    assert [tuple(r) for r in J.read_state(spark, path, "id string, n int").collect()] == [("1", 2)]
    assert J.read_state(spark, path, "id string", version=2).count() == 0 and J.read_state(spark, str(tmp_path / "none"), "id string").count() == 0
    (tmp_path / "state.json").write_text("{")
    assert J.read_state(spark, path, "id string").count() == 0
    good = spark.createDataFrame([("./a", "f" * 64)], "path string, hash string")
    assert J.hash_cache(good)[1] and [r["path"] for r in J.hash_cache(good)[0].collect()] == ["a"]
    rows, valid = J.hash_cache(good.unionByName(spark.createDataFrame([("b", "zz")], good.schema)))
    assert not valid and rows.count() == 0
    roots = J.project_roots(spark.createDataFrame([("C:\\x\\",), ("/p/q/",)], "root string"), spark.createDataFrame([("/p/q", 3)], "root string, chunks long"))
    assert {tuple(r) for r in roots.collect()} == {("C:/x", "x", False, 0), ("/p/q", "q", True, 3)}
    with pytest.raises(ValueError):
        J.content_or_file(spark)
    assert J.content_or_file(spark, path=path).first()["content"] == "{"


def test_captured_replies(spark):
    r = '{"start":{"line":1,"character":2},"end":{"line":1,"character":5}}'
    rows = spark.createDataFrame([("one", f'{{"uri":"u","range":{r}}}'), ("list", f'[{{"uri":"u","range":{r}}},{{"targetUri":"v","targetSelectionRange":{r},"targetRange":{r}}}]'), ("none", "null"), ("bad", "[")], "key string, json string")
    assert {(x["key"], x["uri"], x["character"]) for x in J.locations(rows).collect()} == {("one", "u", 2), ("list", "u", 2), ("list", "v", 2)}
    d = spark.createDataFrame([("k", f'{{"uri":"u","diagnostics":[{{"range":{r},"severity":2,"message":"m"}},{{"range":{r},"message":"n"}}]}}')], "key string, json string")
    assert {(x["severity"], x["message"]) for x in J.diagnostics(d).collect()} == {("warning", "m"), ("error", "n")}
    h = spark.createDataFrame([("a", '{"contents":"x"}'), ("b", '{"contents":{"kind":"markdown","value":"y"}}'), ("c", '{"contents":["x",{"value":"z"}]}'), ("d", "{}")], "key string, json string")
    assert {tuple(x) for x in J.hovers(h).collect()} == {("a", "x"), ("b", "y"), ("c", "x\n\nz")}


def test_tasks_and_gates(spark):
    t = lambda k: dt.datetime(2024, 1, 1, 0, 0, k)
    tasks = spark.createDataFrame([("a", "running", t(0), False), ("b", "completed", t(0), False), ("c", "running", t(0), True), ("d", "running", dt.datetime(2020, 1, 1), False)], "id string, status string, updated_at timestamp, orphan boolean")
    events = spark.createDataFrame([("a", "failed", t(1)), ("a", "running", t(2)), ("b", "failed", t(1))], "id string, status string, at timestamp")
    got = {r["id"]: r["status"] for r in M.task_states(tasks, events, F.lit("2024-01-01 00:01:00").cast("timestamp"), 3600).collect()}
    assert got == {"a": "failed", "b": "completed", "c": "failed"}
    gate = {r["metric"]: r["passed"] for r in M.quality_gate(spark.createDataFrame([(1.0, 0.9), (1.0, 0.8)], "recall double, mrr double"), {"recall": 1.0, "mrr": 0.95}).collect()}
    assert gate == {"recall": True, "mrr": False}
    empty = M.quality_gate(spark.createDataFrame([], "recall double"), {"recall": 0.5}).collect()
    assert [r["passed"] for r in empty] == [False]
    now = spark.createDataFrame([("0123456789abcdef", 3)], "fingerprint string, files long")
    states = [M.freshness(x, now, ok).first()["state"] for x, ok in (("0123456789abcdef", True), ("f" * 16, True), ("f" * 16, False), (None, True), ("xyz", True))]
    assert states == ["fresh", "stale", "unknown", "unknown", "unknown"]


def test_signals_and_locations(spark):
    rows = spark.createDataFrame([("q", "b", 1, "x"), ("q", "a", 9, "y"), ("q", "a", 2, "x")], "key string, source string, start int, kind string")
    r = M.merged_signals(rows, "key", 2).first()
    assert (r["count"], r["kinds"], r["sources"], r["first"]) == (2, ["x", "y"], 1, "x")
    places = spark.createDataFrame([("/r/a", 1, 2, 5), ("/r/a", 1, 2, 1), ("/x/a", 1, 2, 0), ("/r/b", 0, 1, 3)], "path string, start int, stop int, place int")
    kept, total = M.distinct_locations(places, "/r", 1)
    assert [r["path"] for r in kept.collect()] == ["/r/a"] and tuple(total.first()) == (1, 3)
    cut = M.truncated(places, 2, "place").collect()
    assert [r["place"] for r in cut] == [0, 1] and all(r["truncated"] for r in cut)
    assert spark.range(1).select(M.provenance(F.array(F.lit("index"), F.lit("lsp"))).alias("p")).first()["p"] == "lsp"


def test_spans(spark):
    spans = spark.createDataFrame([("f", 1, 100, "outer"), ("f", 5, 20, "inner"), ("f", 15, 90, "late")], "k string, start int, stop int, name string")
    points = spark.createDataFrame([("f", 16), ("f", 7), ("f", 200), ("g", 1)], "k string, line int")
    small = {(r["k"], r["line"]): r["name"] for r in R.smallest_span(spans, points, "k").collect()}
    last = {(r["k"], r["line"]): r["name"] for r in R.last_span(spans, points, "k").collect()}
    assert small == {("f", 16): "inner", ("f", 7): "inner", ("f", 200): None, ("g", 1): None}
    assert last == {("f", 16): "late", ("f", 7): "inner", ("f", 200): "__global__", ("g", 1): "__global__"}


def test_paths_and_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 2), (4, 1), (5, 4)], "src long, dst long")
    assert G.shortest_path(e, 1, 3, 5).first()["path"] == [1, 2, 3] and G.shortest_path(e, 1, 5, 5).count() == 0
    assert G.shortest_path(e, 1, 5, 5, "reverse").first()["path"] == [1, 4, 5] and G.shortest_path(e, 2, 4, 5, "both").first()["length"] == 2
    assert [r["cycle"] for r in G.all_cycles(e).collect()] == [[2, 3], [1, 2, 3]] and G.all_cycles(e.limit(0)).count() == 0


def test_version_control_output(spark):
    status = spark.createDataFrame([("M  a.py\0?? b.py\0 D c/d.py\0",)], "text string")
    assert {tuple(r) for r in L.porcelain(status).collect()} == {("M", " ", "a.py"), ("?", "?", "b.py"), (" ", "D", "c/d.py")}
