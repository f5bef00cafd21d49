"""Documentation pairs: owners and their supertypes in the join, JSX, deep nesting."""

import datetime as dt

import pytest

from quarry.llm import documented, jsx
from quarry.llm.declare import declarations
from quarry.llm.documented import supertypes
from quarry.llm.grammar import valid
from quarry.llm.validity import verdict

DOC = "    /** Returns the cached value that belongs to the given key{}. */\n"


def _files(spark, files):
    rows = [("r", f"r/{name}", "tree-sitter", None, text, None, dt.datetime(2024, 1, 1), "x") for name, text in files.items()]
    return spark.createDataFrame(rows, "repo string, filepath string, method string, language string, content string, linecount int, parsed_at timestamp, owner string")


def test_owner_decides_the_join(spark):
    files = {
        "A.java": "interface A {\n" + DOC.format(" of A") + "    String get(String key);\n}\n",
        "B.java": "interface B {\n" + DOC.format(" of B") + "    String get(String key);\n}\n",
        "Mid.java": "interface Mid extends B {\n}\n",
        "AImpl.java": "class AImpl implements A {\n    public String get(final String key) { return key; }\n}\n",
        "BImpl.java": "class BImpl extends Base implements Mid {\n    public String get(String key) { return key; }\n    public String get(int key) { return null; }\n}\n",
        "Other.java": "class Other {\n    public String get(String key) { return key; }\n}\n",
    }
    rows = {(r["filepath"], r["line"]): (r["origin"], r["documentation"]) for r in documented.pairs(_files(spark, files)).collect()}
    text = "Returns the cached value that belongs to the given key of {}."
    assert rows == {
        ("r/A.java", 3): ("own", text.format("A")),
        ("r/B.java", 3): ("own", text.format("B")),
        ("r/AImpl.java", 2): ("declaration", text.format("A")),
        ("r/BImpl.java", 2): ("declaration", text.format("B")),
    }
    own = {(r["filepath"], r["line"]) for r in documented.found(_files(spark, files)).collect()}
    assert own == {k for k, v in rows.items() if v[0] == "own"}


def test_cyclic_supertypes_end(spark):
    files = {"A.py": "class A(B):\n    def f(self):\n        pass\n", "B.py": "class B(A):\n    def f(self):\n        pass\n"}
    assert documented.pairs(_files(spark, files)).count() == 0
    assert documented.pairs(_files(spark, files).limit(0)).count() == 0


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("java", "class A<T extends X> extends p.B<T> implements C, D<E> {\n}\n", ["B", "C", "D"]),
        ("csharp", "public class A : B, IC<D> where T : X\n{\n}\n", ["B", "IC"]),
        ("python", "class A(m.B, C, metaclass=M):\n    pass\n", ["B", "C"]),
        ("rust", "impl<T> Tr<T> for A<T> {\n}\n", ["Tr"]),
        ("ruby", "class A < M::B\nend\n", ["B"]),
        ("typescript", "export class A extends B<C> implements D {\n}\n", ["B", "D"]),
    ],
)
def test_supertypes(lang, text, want):
    d = next(x for x in declarations(text, lang) if x.kind == "type")
    assert supertypes(text, d, lang) == want


JSX = """/** Shows one row of the table with its label and value. */
export function Row({ label, value }) {
  return (
    <>
      <td className="a" {...rest}>don't {label && <b>{value}</b>}</td>
    </>
  );
}
"""


def test_jsx_is_valid_and_declares():
    assert valid(JSX, "javascript") and valid(JSX, "typescript")
    assert [(d.name, d.line) for d, _, _ in documented.functions(JSX, "javascript", True)] == [("Row", 2)]
    out = jsx.plain(JSX)
    assert len(out) == len(JSX) and out.count("\n") == JSX.count("\n")
    assert not valid(JSX.replace("</b>", ""), "javascript")
    assert jsx.plain("const a = b < c; x = d > e; /</.test(s)\n") is None


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("json", "[" * 100_000, False), ("json", "[" * 100_000 + "]" * 100_000, True), ("json", '{"a":' * 9000 + "1" + "}" * 9000, True), ("json", "[" * 9000 + "1," + "]" * 9000, False),
        ("javascript", "x = " + "[" * 50_000, False), ("javascript", "x = " + "[" * 5000 + "]" * 5000 + ";", True), ("javascript", "x = " + "[" * 5000 + "1 2" + "]" * 5000 + ";", False),
        ("java", "class A { int x = " + "(" * 5000 + "1" + ")" * 5000 + "; }", True), ("python", "x = " + "+".join(["1"] * 200_000), True), ("python", "x = " + "(" * 5000, False),
    ],
)
def test_depth_is_no_verdict(lang, text, want):
    assert valid(text, lang) is want


def test_foreign_parse_has_no_rank_limit():
    assert verdict('{"a": [1, 2, {"b": null}]}', "python")[0] is True  # a display of literals: names are no matter of syntax
    assert verdict('{"a": tru, }', "json") == (False, "python")
    assert verdict("<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "python") == (False, None)


def test_found_are_rows_of_pairs(spark, monkeypatch):
    hint = "export const Hint = () => <p>press the ` key</p>;\n\n/** Returns the cached value that belongs to the given key. */\nexport function get(key) {\n  return key;\n}\n"
    files = _files(spark, {"hint.js": hint, "A.java": "interface A {\n" + DOC.format(" of A") + "    String get(String key);\n}\n", "B.java": "class B implements A {\n    public String get(String key) { return key; }\n}\n"})
    rows = documented.pairs(files)
    assert {(r["filepath"], r["line"]) for r in documented.found(files).collect()} == {("r/hint.js", 4), ("r/A.java", 3)}
    assert rows.where("origin = 'declaration'").count() == 1
    monkeypatch.setattr(documented, "pairs", lambda _: rows.where("filepath = 'r/hint.js'"))
    assert [tuple(r) for r in documented.found(files).collect()] == [("r/hint.js", 4)]
