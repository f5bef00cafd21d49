"""Source tables and the property graph on small repositories with known results."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import code, extract
from quarry.operators import property_graph as P

GRAPH = {
    "p/src/base.ts": "export class Base {\n  run() { return 1; }\n}\n",
    "p/src/service.ts": "import { Base } from './base';\nexport class Service extends Base {\n  go() { return helper(); }\n}\nfunction helper() { return 2; }\nfunction unusedThing() { return 3; }\n",
    "p/src/app.ts": "import { Service } from './service';\nconst app = make();\napp.get('/users', handler);\nbus.emit('ready');\ncontainer.resolve(Service);\nexport function start() { return new Service(); }\n",
    "p/tests/service.test.ts": "import { Service } from '../src/service';\nfunction checks() { return new Service(); }\n",
    "p/src/lost.ts": "class Lost extends Missing {\n}\n",
}


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame([("p", k, v) for k, v in GRAPH.items()], "repo string, filepath string, content string").cache()
    return P.Tables(files)


def _edges(tables, kind):
    n = {r["id"]: (r["kind"], r["name"]) for r in P.nodes(tables).collect()}
    return {(n[r["src"]][1], n[r["dst"]][1], round(r["confidence"], 2)) for r in P.of_kinds(P.edges(tables), [kind]).collect()}


def test_graph(tables):
    assert _edges(tables, "inherits") == {("Service", "Base", 0.68)}
    imports = _edges(tables, "imports")
    assert ("p/src/app.ts", "p/src/service.ts", 0.96) in imports and ("p/src/app.ts", "Service", 0.9) in imports and ("p/src/service.ts", "Base", 0.9) in imports
    assert ("Service", "helper", 0.78) in _edges(tables, "calls")
    assert ("checks", "Service", 0.62) in _edges(tables, "tests")
    assert _edges(tables, "routes") == {("p/src/app.ts", "get /users", 0.64)}
    assert _edges(tables, "emits") == {("p/src/app.ts", "emit ready", 0.64)}
    assert _edges(tables, "injects") == {("p/src/app.ts", "Service", 0.64)}
    assert ("p/src/base.ts", "Base", 1.0) in _edges(tables, "contains")
    assert {r["kind"]: r["n"] for r in P.signal_totals(tables).collect()} == {"route": 1, "event": 1, "dependency": 1}


def test_graph_queries(tables):
    service = P.nodes(tables).where("kind = 'symbol' AND name = 'Service'")
    row = P.tests_of(P.edges(tables), service).collect()[0]
    assert row["files"] == ["p/tests/service.test.ts"] and not row["truncated"]
    picked = [r["name"] for r in P.select_nodes(P.nodes(tables), service, 2).collect()]
    assert "Service" in picked and len(picked) == 2
    good, lost = P.type_graph(tables)
    assert good.count() == 1 and [r["parent"] for r in lost.collect()] == ["Missing"]
    assert [(r["name"], r["confidence"]) for r in P.dead_symbols(tables).collect()] == [("Lost", 0.82), ("unusedThing", 0.82)]


def test_imports_resolve_by_alias_and_extension(spark):
    files = spark.createDataFrame([("p", p, "") for p in ("p/src/a.ts", "p/src/core/x.tsx", "p/src/lib/index.js", "p/src/b.py")], "repo string, filepath string, content string")
    imports = spark.createDataFrame([("p/src/a.ts", s) for s in ("./core/x", "./lib", "@core/x", "../src/b", "react", "./none")], "filepath string, source string")
    got = {r["source"]: r["target"] for r in P.resolved_imports(imports, files, {"@core/": "src/core/"}).collect()}
    assert got == {"./core/x": "p/src/core/x.tsx", "./lib": "p/src/lib/index.js", "@core/x": "p/src/core/x.tsx", "../src/b": "p/src/b.py", "react": None, "./none": None}


def test_semantic_chunks():
    text = "import x\n\n\nclass A {\n  m() {}\n}\n\nfunction f() {\n" + "  call();\n" * 50 + "}\ntail\n"
    got = code.semantic_chunks(text, 200, 40)
    assert got[0] == ("import x", 1, 1, None, None) and got[1] == ("class A {\n  m() {}\n}", 4, 6, "A", "class")
    parts = [c for c in got if c[3] == "f"]
    assert len(parts) > 1 and all(len(c[0]) <= 210 for c in parts) and parts[1][1] <= parts[0][2]
    assert got[-1][0] == "tail" and got[-1][3] is None
    assert code.semantic_chunks("a\nb\n", 1000, 0) == [("a\nb\n", 1, 3, None, None)] and code.semantic_chunks("", 10, 0) == []


def test_chunk_files(spark):
    files = spark.createDataFrame([("r/a.ts", "class A {}\n"), ("r/a.md", "# T\n\ntext"), ("r/a.png", "x"), ("r/b.py", None), (None, "x")], "filepath string, content string")
    rows = code.chunk_files(files).collect()
    assert {(r["filepath"], r["language"], r["symbolname"]) for r in rows} == {("r/a.ts", "typescript", "A"), ("r/a.md", "markdown", None)}
    one = next(r for r in rows if r["symbolname"] == "A")
    assert one["id"] == code.chunk_id("r/a.ts", 1, "class A {}")


def test_positions():
    assert code.utf16_to_byte("a😀b\nc", 0, 3) == 5 and code.utf16_to_byte("a😀b", 0, 2) == 1 and code.utf16_to_byte("ab\nc", 1, 9) == 4 and code.utf16_to_byte("a", 3, 0) is None
    assert code.position_to_byte("é\nbc", 2, 1) == 4 and code.position_to_byte("x", 0, 0) is None
    assert code.byte_snippet("aéb", 1, 3) == "é" and code.byte_snippet("aéb", 2, 3) is None and code.byte_snippet("aéb", 0, 2) == "a"
    assert code.identifier_at("let größe = 1", 1, 6) == "größe" and code.identifier_at("a", 2, 0) is None
    assert code.word_references("Cache cache_x cache\nCACHE", "cache") == [(1, 0, 0), (1, 14, 14), (2, 0, 20)]


def test_signatures_and_modifiers():
    assert code.signature("async function f<T>(a: T): X {") == "async function f<T>(a: T): X" and code.signature("def f(a) -> int:") == "def f(a) -> int" and code.signature("func (s *S) F(a int) error {") == "func (s *S) F(a int)" and code.signature("(a) => a") == "(a) =>"
    assert code.modifiers("export default async function f() {}") == ["export", "default", "async"]
    assert code.declaration_end('f() { "}" }x', 0) == 11 and code.declaration_end("abc\nd", 0) == 3
    assert code.clean_parent("public Base<T>(x)") == "Base" and code.hierarchy("class A(B, metaclass=M):\n    pass\n") == [("class", "A", ["B"], 1)]


def test_syntax_trees(spark):
    files = spark.createDataFrame([("a.py", "def f(x):\n    return g(x)\n"), ("b.py", "def f(:\n")], "filepath string, content string")
    nodes = code.extract(files, "syntax").cache()
    assert nodes.select("filepath").distinct().count() == 1
    stats = {r["type"]: (r["n"], r["nodes"]) for r in code.tree_statistics(nodes).collect()}
    assert stats["FunctionDef"][0] == 1 and stats["Name"][0] == 2
    assert code.filter_nodes(nodes, exclude=["Return"]).where("type IN ('Call', 'Return')").count() == 0
    assert code.filter_nodes(nodes, include=["Name"], max_depth=3).count() == 0
    at = code.node_at(nodes, spark.createDataFrame([("a.py", 2, 13)], "filepath string, line int, column int")).head()
    assert at["type"] == "Name" and len(at["ancestors"]) == 4
    assert code.s_expression(nodes).head()["tree"].startswith('(Module (FunctionDef (arguments (arg "x"))')
    assert code.first_of_line_start(nodes).where("line = 2").count() < nodes.where("line = 2").count()


def test_presets(spark):
    text = "// note\nimport a from 'm';\nexport const K = 'v';\ninterface I {}\nfunction f() {}\n"
    files = spark.createDataFrame([("a.ts", text)], "filepath string, content string")
    want = {"functions": ["f"], "types": ["I"], "imports": ["m"], "exports": ["K"], "comments": ["// note"], "strings": ["'m'", "'v'"], "variables": ["K"], "classes": []}
    assert {k: [r["name"] for r in code.preset(files, k).orderBy("line").collect()] for k in want} == want
    assert extract.split_types("A<B, C>, D") == ["A", "D"]


def test_lookups(spark):
    s = spark.createDataFrame([("f", "a", "class", 1, 1, 0, 9, 1), ("f", "b", "function", 3, 3, 2, 5, 4), ("g", "b", "method", 1, 1, 0, 2, 0)], "filepath string, name string, type string, start int, line int, column int, endline int, endcolumn int")
    assert P.symbols_of(s, include=["class", "function"], exclude=["class"]).count() == 1 and P.symbols_of(s, name="b").count() == 2
    assert P.first_named(s, "b").first()["filepath"] == "f" and P.first_named(s, "none").count() == 0
    points = spark.createDataFrame([("f", 3, 3), ("f", 3, 1), ("f", 20, 0)], "filepath string, line int, column int")
    assert {(r["line"], r["column"]): r["name"] for r in P.symbol_at(s, points).collect()} == {(3, 3): "a", (3, 1): "a"}
    c = spark.createDataFrame([("1", "src\\A.py"), ("2", "src/b.py")], "id string, filepath string")
    assert [r["id"] for r in P.chunks_of_file(c, "SRC/a.py").collect()] == ["1"]
    assert [r["id"] for r in P.chunks_of_ids(c, spark.createDataFrame([("2",), ("2",), ("9",)], "id string")).collect()] == ["2"]
    calls = spark.createDataFrame([("/r/a.py:f", "C:\\r\\b.py:g")], "caller string, callee string")
    assert tuple(P.public_names(calls, "/r/").first()) == ("a.py:f", "C:/r/b.py:g")
    saved = spark.createDataFrame([("a", "0123456789abcdefXX")], "path string, hash string")
    assert P.graph_is_current(saved, spark.createDataFrame([("a", "0123456789abcdefYY")], saved.schema)) and not P.graph_is_current(saved, saved.limit(0))


def test_call_graph(spark):
    files = spark.createDataFrame([("p", "p/a.py", "def f():\n    g()\n    g()\n\ng()\n"), ("p", "p/b.py", "def g():\n    return f()\n"), ("p", "p/c.rs", "fn h() { g() }\n"), ("q", "q/a.py", "g()\n")], "repo string, filepath string, content string")
    graph = P.call_graph(P.Tables(files)).cache()
    assert sorted((r["caller"], r["callee"]) for r in graph.collect()) == [("p/a.py:__global__", "p/b.py:g"), ("p/a.py:f", "p/b.py:g"), ("p/a.py:f", "p/b.py:g"), ("p/b.py:g", "p/a.py:f")]
    assert tuple(P.call_totals(graph).first()) == (4, 3)
    assert [tuple(r) for r in P.top_names(graph, "caller").collect()] == [("f", 2), ("g", 1)]
    assert P.busiest_nodes(graph, 1).first()["node"] == "p/b.py:g"


def test_embedding_client(spark):
    from quarry.operators.retrieval import embed_with

    def client_of(dim):
        return lambda: lambda texts: [[float(len(t))] * dim for t in texts]

    df = spark.createDataFrame([("1", "abc"), ("2", None)], "id string, content string")
    assert {r["id"]: r["vector"] for r in embed_with(df, client_of(2), 2).collect()} == {"1": [3.0, 3.0], "2": [0.0, 0.0]}
    with pytest.raises(Exception, match="missing or malformed"):
        embed_with(df, client_of(3), 2).collect()


def test_indented_bodies():
    text = "class A(B):\n    x = {1: 2}\n\n    def f(\n        self,\n    ):\n        g()\n\ndef g():\n    f()\ny = 1\n"
    assert [(s.name, s.line, s.endline) for s in code.symbols(text)] == [("A", 1, 7), ("f", 4, 7), ("g", 9, 10)]
    assert [(s.name, s.line, s.endline, s.signature) for s in code.symbols("  def f(x)\n    g\n  end\nend\n")] == [("f", 1, 3, "def f(x)")]
