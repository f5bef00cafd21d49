"""Functions and methods paired with their documentation.

Declarations of all files form a table of qualified names and normalised signatures, types with
their declared supertypes. Documented declarations without a body (of interfaces, abstract types,
overloads, stubs) are joined with the separate definitions of the same signature in the same type or a
subtype, within a repository; then trivial texts are dropped.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import ensure_checkpoint_dir
from . import jsx
from .common import current_files, spread
from .declare import Declaration, declarations
from .docs import description, word_count
from .grammar import valid_plain
from .lexer import CODE_LANGUAGES, COMMENT, Code

MIN_WORDS = 6
_SCHEMA = "filepath string, repo string, language string, kind string, name string, owner string, line int, signature string, normal string, bodied boolean, documentation string, words int, supers array<string>"
_COLUMNS = ["filepath", "repo", "language", "name", "owner", "line", "signature", "documentation", "words"]


_SPACE = re.compile(r"\s+")
_UNTOLD = re.compile(r"/\*.*?\*/|=[^,()]*(?=,|$)|\b(?:final|const|readonly|mut|ref|out|in|self|this|cls)\b|@\w+(?:\([^)]*\))?|[&\s]")


def signature_of(text: str, start: int, end: int) -> str:
    return _SPACE.sub(" ", text[start:end]).rstrip(" {:;").strip()


def normal_signature(signature: str, name: str) -> str:
    """Name and parameter list without defaults, modifiers, comments and spaces: what tells overloads apart."""
    at = signature.find("(", max(signature.find(name), 0))
    if at < 0:
        return name
    depth, end = 0, len(signature)
    for k in range(at, len(signature)):
        depth += (signature[k] == "(") - (signature[k] == ")")
        if not depth:
            end = k
            break
    inside = _UNTOLD.sub("", signature[at + 1 : end])
    return f"{name}({inside.strip(',')})"


def best_description(comments, docstring: str | None) -> tuple[str, int]:
    """The documentation with its number of words; of a docstring and a comment block the first that isn't trivial."""
    inner = description((), docstring) if docstring else ""
    n = word_count(inner)
    if n >= MIN_WORDS or not comments:
        return inner, n
    above = description(comments, None)
    m = word_count(above)
    return (above, m) if m >= n else (inner, n)


_GENERIC = re.compile(r"<[^<>]*>|\[[^\[\]]*\]")
_EXTENDS = {
    "java": re.compile(r"\b(?:extends|implements)\b"),
    "csharp": re.compile(r":"),
    "rust": re.compile(r":"),
}


def supertypes(text: str, d: Declaration, lang: str) -> list[str]:
    """Last names of the types that a type declaration names as its supertypes."""
    if lang in ("python", "ruby"):
        m = re.compile(r"\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)" if lang == "python" else r"\s*<\s*([\w:]+)").match(text, d.end)
        rest = m[1] if m else ""
    else:
        head = text[d.start : d.end].rstrip(" {;")
        while (short := _GENERIC.sub("", head)) != head:
            head = short
        if lang == "rust":
            m = re.match(r"(?:unsafe\s+)?impl\s+(.+?)\s+for\s", head, re.S)
            rest = m[1] if m else head.partition(":")[2] if re.match(r"(?:pub(?:\([^)]*\))?\s+)?trait\b", head) else ""
        else:
            m = _EXTENDS.get(lang, _EXTENDS["java"]).search(head)
            rest = head[m.end() :] if m else ""
    rest = re.split(r"\bwhere\b|\bpermits\b", rest)[0]
    names = re.split(r",|\+|\bextends\b|\bimplements\b", re.sub(r"/\*.*?\*/", "", rest, flags=re.S))
    last = [re.split(r"\.|::|\\", re.sub(r"\(.*", "", x, flags=re.S).strip())[-1] for x in names if "=" not in x]
    return [x for x in dict.fromkeys(last) if re.fullmatch(r"[A-Za-z_$][\w$]*", x)]


def functions(text: str, lang: str, documented_only: bool = False) -> list[tuple[Declaration, str, int]]:
    """(declaration, documentation, its words) of the named functions and types of a valid text; none of an invalid one.

    With ``documented_only``, the functions with non-trivial documentation; a text without any isn't parsed.
    """
    got = _declared(text, lang, Code(text, lang), documented_only)
    if got is None and lang in ("javascript", "typescript"):
        other = jsx.plain(text)
        got = _declared(other, lang, Code(other, lang), documented_only) if other is not None else None
    return got or []


def _declared(text: str, lang: str, code: Code, documented_only: bool) -> list[tuple[Declaration, str, int]] | None:
    """The rows of ``functions``, or None if the text isn't valid; with ``documented_only`` a text without rows isn't parsed."""
    elements = lang in ("javascript", "typescript") and jsx.looks(text)  # such a text may hold more than its plain reading shows
    if documented_only and lang != "python" and not elements and COMMENT not in code.kinds:
        return []
    out = []
    for d in declarations(text, lang, code):
        if not d.name or documented_only and (d.kind == "type" or not d.comments and not d.docstring):
            continue
        doc, words = best_description(d.comments, d.docstring) if d.kind != "type" else ("", 0)
        if words >= MIN_WORDS or not documented_only:
            out.append((d, doc, words))
    if not out and not elements:
        return []
    return out if valid_plain(text, lang, code) else None


def _source(parse_results: DataFrame) -> DataFrame:
    files = current_files(parse_results).where(F.col("language").isin(*CODE_LANGUAGES) & (F.col("content") != ""))
    return spread(files.select("filepath", "repo", "language", "content"), "filepath")


def symbols(parse_results: DataFrame) -> DataFrame:
    """One row per function, method or type of every valid file of a programming language, documented or not.

    ``line`` is that of the name. Anonymous functions have no row; files that do not parse are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            gc.disable()  # scanning makes no cycles, and the collector looks through every token
            try:
                for path, repo, lang, text in zip(pdf["filepath"], pdf["repo"], pdf["language"], pdf["content"], strict=True):
                    for d, doc, words in functions(text, lang):
                        if d.kind == "type":
                            rows.append((path, repo, lang, d.kind, d.name, d.owner, d.line, None, None, d.bodied, None, 0, supertypes(text, d, lang)))
                            continue
                        sig = signature_of(text, d.start, d.end)
                        rows.append((path, repo, lang, d.kind, d.name, d.owner, d.line, sig, normal_signature(sig, d.name), d.bodied, doc or None, words, None))
            finally:
                gc.enable()
            yield pd.DataFrame(rows, columns=[re.split(" ", x)[0] for x in _SCHEMA.split(", ")])

    return _source(parse_results).mapInPandas(run, _SCHEMA)


def _own(table: DataFrame) -> DataFrame:
    """The functions whose own documentation isn't trivial."""
    return table.where((F.col("kind") != "type") & (F.col("words") >= MIN_WORDS)).select(*_COLUMNS, F.lit("own").alias("origin"))


def ancestors(table: DataFrame) -> DataFrame:
    """(repo, language, type, ancestor, distance): every type with itself (0) and the types above it in its repository, nearest first.

    Types count by name; the closure goes up one step a round until no pair is new, so cycles end.
    """
    types = table.where("kind = 'type'")
    up = types.select("repo", "language", F.col("name").alias("type"), F.explode("supers").alias("ancestor")).where("type <> ancestor").distinct().checkpoint()
    known = up.withColumn("distance", F.lit(1))
    frontier, distance = known, 1
    while not frontier.isEmpty():
        distance += 1
        step = frontier.select("repo", "language", "type", F.col("ancestor").alias("via")).join(up.withColumnRenamed("type", "via"), ["repo", "language", "via"])
        new = step.where("type <> ancestor").select("repo", "language", "type", "ancestor").distinct().join(known, ["repo", "language", "type", "ancestor"], "left_anti")
        frontier = new.withColumn("distance", F.lit(distance)).checkpoint()
        known = known.unionByName(frontier)
    return known


def pairs(parse_results: DataFrame) -> DataFrame:
    """(filepath, repo, language, name, owner, line, signature, documentation, words, origin) of every documented function.

    ``origin`` is ``own`` for the text at the function, ``declaration`` for that of a documented
    declaration without body of the same name and normalised signature, in the function's own type or,
    where that has none, in the nearest type above it, in the same repository and language. Of equally
    near declarations with different texts each gives a row. Fewer than six words are trivial.
    """
    ensure_checkpoint_dir(parse_results.sparkSession)
    table = symbols(parse_results).checkpoint()  # several uses of one pass over the texts
    last = F.element_at(F.split("owner", r"\."), -1)  # "" for functions outside types
    callables = table.where("kind <> 'type'").withColumn("type", last)
    bare = callables.where((F.col("words") < MIN_WORDS) & F.col("bodied")).drop("documentation", "words", "supers", "kind")
    declared = callables.where((F.col("words") >= MIN_WORDS) & ~F.col("bodied")).select("repo", "language", "normal", F.col("type").alias("ancestor"), "documentation", "words").distinct()
    key = ["repo", "language", "normal", "ancestor"]
    same = bare.withColumn("ancestor", F.col("type")).withColumn("distance", F.lit(0)).join(declared, key)
    # only bodies whose name is declared somewhere go up the hierarchy
    above = bare.join(declared.select("repo", "language", "normal").distinct(), ["repo", "language", "normal"], "left_semi").join(ancestors(table), ["repo", "language", "type"]).join(declared, key)
    met = same.unionByName(above)
    nearest = met.groupBy("filepath", "line", "name").agg(F.min("distance").alias("distance"))
    joined = met.join(nearest, ["filepath", "line", "name", "distance"]).select(*_COLUMNS, F.lit("declaration").alias("origin")).distinct().checkpoint()  # else a filter on origin takes the join out of the plan
    return _own(table).unionByName(joined)


def found(parse_results: DataFrame) -> DataFrame:
    """(filepath, line) of the functions and methods with non-trivial documentation of their own: the rows of ``pairs`` of origin ``own``."""
    return pairs(parse_results).where("origin = 'own'").select("filepath", "line").distinct()
