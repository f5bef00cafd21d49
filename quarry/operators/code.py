"""Table functions over source files: symbols, imports, exports, identifiers, references, hierarchy, signals, chunks, positions.

Pattern-based and portable over languages; pure functions over one text, run in Arrow batches by ``extract.table_function``.
Offsets count characters from 0, lines from 1.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extract as X

_NAME = r"([A-Za-z_$][\w$]*)"
# What declares a symbol, by kind.
DECLARATIONS = [
    ("class", r"\b(?:export\s+)?(?:abstract\s+)?class\s+" + _NAME),
    ("interface", r"\b(?:export\s+)?interface\s+" + _NAME),
    ("type", r"\b(?:export\s+)?type\s+" + _NAME + r"\s*="),
    ("enum", r"\b(?:export\s+)?enum\s+" + _NAME),
    ("function", r"\b(?:export\s+)?(?:async\s+)?function\s+" + _NAME),
    ("function", r"\bdef\s+" + _NAME + r"\s*\("),
    ("function", r"\bfunc\s+(?:\([^)]*\)\s*)?" + _NAME + r"\s*\("),
    ("function", r"\b(?:pub\s+)?fn\s+" + _NAME + r"\s*\("),
]
# Words that modify a declaration, in the order in which they are reported.
MODIFIERS = "export default async static public private protected readonly abstract const let var final override pub mut".split()
# What signals a route, an event or an injected dependency; the groups of operation and name.
SIGNALS = [
    ("route", re.compile(r"""\b(?:app|router|server|api)\.(get|post|put|patch|delete|options|head|use|route)\s*\(\s*["'`]([^"'`]+)["'`]""", re.I | re.A), 2),
    ("route", re.compile(r"""@(?:Get|Post|Put|Patch|Delete|Options|Head|All)\s*\(\s*["'`]([^"'`]+)["'`]""", re.A), 1),
    ("event", re.compile(r"""\.(on|once|emit|dispatch|addEventListener|removeEventListener)\s*\(\s*["'`]([^"'`]+)["'`]""", re.A), 2),
    ("dependency", re.compile(r"""(?:\b(?:container\.(?:register|bind|resolve)|inject|provide)|@Inject)\s*\(\s*["'`]?([A-Za-z_$][\w$./:@-]*)""", re.A), 1),
]
MAX_SYMBOLS = 2000
_PATTERNS = [(kind, re.compile(p, re.A)) for kind, p in DECLARATIONS]
_WORD = re.compile(r"\b[A-Za-z_$][\w$]*\b", re.A)
_CALL = re.compile(r"(?<![\w$.])(?P<n>[A-Za-z_$][\w$]*)\s*\(", re.A)
_IMPORT = re.compile(r"""\bimport\s+([^;\n]*?)(?:\s+from\s+)?["']([^"']+)["']""", re.A)
_EXPORT = re.compile(r"\bexport\s+(default\s+)?(?:abstract\s+|async\s+|declare\s+)*(?:function\*?|class|const|let|var|interface|type|enum)\s+(\w+)|\bexport\s+(default)\b|\bexport\s*\{([^}]*)\}", re.A)


class Symbol(NamedTuple):
    type: str
    name: str
    start: int
    stop: int
    line: int
    endline: int
    signature: str | None
    modifiers: list[str]


class Lines:
    """Line of an offset by binary search over the line starts."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, offset: int) -> int:
        return max(1, bisect_right(self.starts, offset))


def declaration_end(text: str, start: int) -> int:
    """End of a declaration: behind the brace that closes its first one, quoted text passed over; without a brace the end of the line."""
    at = text.find("{", start)
    if at < 0:
        end = text.find("\n", start)
        return len(text) if end < 0 else end
    depth = 0
    for m in re.compile(r"""\\.|"(?:[^"\\]|\\[\s\S])*(?:"|$)|'(?:[^'\\]|\\[\s\S])*(?:'|$)|`(?:[^`\\]|\\[\s\S])*(?:`|$)|[{}]""").finditer(text, at):
        sign = m.group()
        if sign == "{":
            depth += 1
        elif sign == "}":
            depth -= 1
            if not depth:
                return m.end()
    return len(text)


_BY_INDENT = re.compile(r"def\b|class\s+\w+\s*(?:\([^)]*\))?\s*:", re.A)


def indented_end(text: str, start: int) -> int:
    """End of a declaration whose body is indented: the last line deeper than its own, with a closing ``end`` of its own depth."""
    begin = text.rfind("\n", 0, start) + 1
    own = len(re.match(r"[ \t]*", text[begin:]).group())
    stop = text.find("\n", start)
    if stop < 0:
        return len(text)
    at = stop + 1
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        depth = len(line) - len(line.lstrip())
        if line.strip():
            if depth <= own and line.lstrip()[:1] not in ")]":
                return end if re.match(r"[ \t]*end\b", line) and depth == own else stop
            stop = end
        at = end + 1
    return stop


def modifiers(text: str) -> list[str]:
    """The modifiers among the first hundred characters of a declaration."""
    head = text[:100]
    return [m for m in MODIFIERS if re.search(rf"\b{m}\b", head, re.A)]


def signature(text: str) -> str | None:
    """Signature of a function's text: of a ``function``, an arrow, a ``def`` or a ``func``; else what stands before the first brace or colon."""
    for pattern in (r"(async\s+)?function\s*\*?\s*(\w*)\s*(<[^>]*>)?\s*\([^)]*\)(\s*:\s*[^{]+)?", r"\([^)]*\)\s*(:\s*[^=]+)?\s*=>", r"def\s+(\w+)\s*\([^)]*\)(\s*->\s*[^:]+)?(?=:)", r"func\s*(\([^)]*\)\s*)?(\w+)\s*\([^)]*\)"):
        m = re.match(pattern, text, re.A)
        if m:
            return m.group().strip()
    return re.split(r"[{:]", text)[0].strip() or None


def _head(body: str, indented: bool) -> str:
    """A function's declaration without its body; of a ``def`` without a colon the first line."""
    if not indented:
        return body.split("{")[0].strip()
    return (signature(body) or "") if re.match(r"def\s+\w+\s*\([^)]*\)[^:\n]*:", body) else body.split("\n")[0].strip()


def symbols(text: str) -> list[Symbol]:
    """Declared symbols in order of offset and name, each (type, name, offset) once, at most MAX_SYMBOLS."""
    lines, found = Lines(text), {}
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text):
            key = (kind, m[1], m.start())
            if key not in found:
                indented = _BY_INDENT.match(text, m.start()) is not None
                stop = indented_end(text, m.start()) if indented else declaration_end(text, m.start())
                body = text[m.start() : stop]
                found[key] = Symbol(kind, m[1], m.start(), stop, lines.of(m.start()), lines.of(stop), _head(body, indented) if kind == "function" else None, modifiers(body))
    return sorted(found.values(), key=lambda s: (s.start, s.name))[:MAX_SYMBOLS]


def imports(text: str) -> list[tuple[str, list[str], bool, int]]:
    """(source, names, whether only a default is named, line) of import statements with a quoted source."""
    lines, out = Lines(text), []
    for m in _IMPORT.finditer(text):
        clause = re.sub(r"[{}]", "", re.sub(r"^type\s+", "", m[1]))
        names = [n for n in (re.split(r"\s+as\s+", x.strip())[0] for x in clause.split(",")) if n]
        out.append((m[2], names, len(names) == 1 and "{" not in m[1] and "*" not in m[1], lines.of(m.start())))
    return out


def exports(text: str) -> list[tuple[str, bool, int]]:
    """(name, is the default, line) of export statements; an unnamed default is called ``default``."""
    lines, out = Lines(text), []
    for m in _EXPORT.finditer(text):
        line = lines.of(m.start())
        if m[4] is not None:
            out += [(re.split(r"\s+as\s+", x.strip())[-1], False, line) for x in m[4].split(",") if x.strip()]
        else:
            out.append((m[2] or "default", bool(m[1] or m[3]), line))
    return out


def identifiers(text: str, limit: int = 250) -> list[str]:
    """The first ``limit`` distinct identifiers in order of first use."""
    seen: dict[str, None] = {}
    for m in _WORD.finditer(text):
        seen.setdefault(m.group())
        if len(seen) >= limit:
            break
    return list(seen)


def uses(text: str, limit: int = 250) -> list[tuple[str, int, int, str, bool]]:
    """(symbol, its offset, its line, identifier, is called) of the identifiers in the body of every symbol."""
    out = []
    for s in symbols(text):
        body = text[s.start : s.stop]
        called = {m[1] for m in re.finditer(r"\b([A-Za-z_$][\w$]*)\s*\(", body, re.A)}
        out += [(s.name, s.start, s.line, name, name in called) for name in identifiers(body, limit)]
    return out


def word_references(text: str, word: str) -> list[tuple[int, int, int]]:
    """(line, column from 0, offset) of every whole-word occurrence, without regard to case."""
    lines = Lines(text)
    return [(lines.of(m.start()), m.start() - lines.starts[lines.of(m.start()) - 1], m.start()) for m in re.finditer(rf"(?<![A-Za-z0-9_$]){re.escape(word)}(?![A-Za-z0-9_$])", text, re.I)] if word else []


def clean_parent(text: str) -> str:
    """Name of a parent type without its arguments, calls, modifiers and defaults."""
    out = re.sub(r"<[\s\S]*>|\([\s\S]*\)|\[[\s\S]*\]", "", text)
    out = re.sub(r"\b(?:public|private|protected|virtual|dyn|async|readonly)\b", "", out)
    return re.sub(r"\s+", " ", out.split("=")[0]).strip(" {:;,&")


def hierarchy(text: str) -> list[tuple[str, str, list[str], int]]:
    """(kind, name, parents, line) of declared types, cleaned; of repeated declarations of a line the one with most parents."""
    best: dict[tuple[str, str, int], list[str]] = {}
    for kind, name, parents, line in X.hierarchy(text):
        clean = [p for p in map(clean_parent, parents) if p]
        if len(clean) >= len(best.get((kind, name, line), [])):
            best[kind, name, line] = clean
    return [(k, n, p, line) for (k, n, line), p in best.items()]


def signals(text: str) -> list[tuple[str, str, str | None, int, int, str]]:
    """(kind, name, operation, offset, line, evidence) in order of offset, kind and name; the evidence is the text around, 90 characters before and 180 behind."""
    lines, out = Lines(text), []
    for kind, pattern, group in SIGNALS:
        for m in pattern.finditer(text):
            out.append((kind, m[group], m[1], m.start(), lines.of(m.start()), text[max(0, m.start() - 90) : m.start() + 180].strip()))
    return sorted(out, key=lambda s: (s[3], s[0], s[1]))


def call_sites(text: str) -> list[tuple[str, str, int, int]]:
    """(caller, callee, offset, line): calls with the last symbol, by start, whose declaration holds them; ``__global__`` outside of all."""
    owners, lines = [s for s in symbols(text) if s.type == "function"], Lines(text)
    declared = {s.start + (re.search(rf"\b{re.escape(s.name)}\b", text[s.start : s.stop]) or re.match("", "")).start() for s in owners}
    out = []
    for m in _CALL.finditer(text):
        if m["n"] in X._NO_CALL or m.start("n") in declared:
            continue
        inside = [s for s in owners if s.start <= m.start() <= s.stop]
        out.append((inside[-1].name if inside else "__global__", m["n"], m.start(), lines.of(m.start())))
    return out


# ------------------------------------------------------------------ chunks
def _trimmed(text: str, start: int, stop: int) -> tuple[int, str]:
    body = text[start:stop]
    lead = len(body) - len(body.lstrip())
    return start + lead, body.strip()


def semantic_chunks(text: str, size: int = 1000, overlap: int = 200) -> list[tuple[str, int, int, str | None, str | None]]:
    """(content, first line, last line, symbol, type): every symbol, the text between symbols and the tail, each trimmed; longer ones cut at lines with ``overlap``.

    Symbols may lie in each other, so regions may overlap. A text without symbols is cut at lines as a whole.
    """
    found = symbols(text)
    if not found:
        normal = re.sub(r"\r\n?", "\n", text)
        return [(p, a, b, None, None) for a, b, p in _line_pieces(normal, size, overlap, 1) if p.strip()]
    regions: list[tuple[int, int, str | None, str | None]] = []
    last = 0
    for s in found:
        if s.start > last and text[last : s.start].strip():
            regions.append((last, s.start, None, None))
        regions.append((s.start, s.stop, s.name, s.type))
        last = max(last, s.stop)
    if text[last:].strip():
        regions.append((last, len(text), None, None))
    lines, out = Lines(text), []
    for start, stop, name, kind in regions:
        at, body = _trimmed(text, start, stop)
        if not body:
            continue
        first = lines.of(at)
        if len(body) <= size:
            out.append((body, first, first + body.count("\n"), name, kind))
        else:
            out += [(p, a, b, name, kind) for a, b, p in _line_pieces(re.sub(r"\r\n?", "\n", body), size, overlap, first)]
    return out


def _line_pieces(text: str, size: int, overlap: int, first: int) -> list[tuple[int, int, str]]:
    """Lines taken greedily while they and their ends fit; each next piece begins with the last lines that reach ``overlap`` characters."""
    if len(text) <= size:
        return [(first, first + text.count("\n"), text)]
    out, current, used = [], [], 0
    for number, line in enumerate(text.split("\n"), first):
        if used + len(line) + 1 > size and current:
            out.append((current[0][0], current[-1][0], "\n".join(x for _, x in current)))
            tail, length = [], 0
            for n, x in reversed(current):
                if length >= overlap:
                    break
                tail.insert(0, (n, x))
                length += len(x) + 1
            current, used = tail, length
        current.append((number, line))
        used += len(line) + 1
    if current:
        out.append((current[0][0], current[-1][0], "\n".join(x for _, x in current)))
    return out


def chunk_id(path: str, line: int, content: str) -> str:
    return "chunk_" + hashlib.md5(f"{path}:{line}:{content}".encode()).hexdigest()[:12]


def chunk_files(files: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, content, filepath, language, startline, endline, symbolname, symboltype) of files (filepath, content): the way they are cut follows their kind.

    Files of a language with a grammar, or of none that has a splitter, are cut at symbols and lines; those of
    a language with a splitter by its separators; binary files give nothing.
    """
    from ..sources.languages import SPLITTERS, chunk_language, parse_method

    rows = files.where("filepath IS NOT NULL AND content IS NOT NULL").select("filepath", "content", chunk_language(F.col("filepath")).alias("language"), parse_method(F.col("filepath")).alias("method")).where("method IS NOT NULL")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, text, language, method in zip(pdf["filepath"], pdf["content"], pdf["language"], pdf["method"], strict=True):
                if method == "langchain":
                    cut, at = [], 0
                    for p in X.split_recursive(text, size, overlap, X.SEPARATORS.get(SPLITTERS.get(language, ""), X.SEPARATORS[""])):
                        found = text.find(p, at)
                        at = found + 1 if found >= 0 else at
                        first = text.count("\n", 0, max(found, 0)) + 1
                        cut.append((p, first, first + p.count("\n"), None, None))
                else:
                    cut = semantic_chunks(text, size, overlap)
                out += [(chunk_id(path, a, c), c, path, language, a, b, name, kind) for c, a, b, name, kind in cut]
            yield pd.DataFrame(out, columns=["id", "content", "filepath", "language", "startline", "endline", "symbolname", "symboltype"])

    return rows.mapInPandas(run, "id string, content string, filepath string, language string, startline int, endline int, symbolname string, symboltype string")


# ------------------------------------------------------------------ presets and positions
_STRING = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"""
PRESETS = {
    "functions": lambda t: [(s.name, s.line) for s in symbols(t) if s.type == "function"],
    "classes": lambda t: [(s.name, s.line) for s in symbols(t) if s.type == "class"],
    "types": lambda t: [(s.name, s.line) for s in symbols(t) if s.type in ("interface", "type", "enum")],
    "imports": lambda t: [(source, line) for source, _, _, line in imports(t)] or [(source, line) for source, line in X.imports(t)],
    "exports": lambda t: [(name, line) for name, _, line in exports(t)],
    "comments": lambda t: _spans(t, rf"(?:{_STRING})|(?P<x>//[^\n]*|(?m:^\s*#[^\n]*)|/\*[\s\S]*?\*/)"),
    "strings": lambda t: _spans(t, rf"//[^\n]*|/\*[\s\S]*?\*/|(?P<x>{_STRING})"),
    "variables": lambda t: _spans(t, r"\b(?:const|let|var|val|static)\s+(?:mut\s+)?(?P<x>[A-Za-z_$][\w$]*)|^(?P<y>[A-Za-z_]\w*)\s*(?::[^=\n]+)?=(?!=)"),
}


def _spans(text: str, pattern: str) -> list[tuple[str, int]]:
    lines = Lines(text)
    return [(next(v for v in m.groupdict().values() if v is not None).strip(), lines.of(m.start(m.lastgroup))) for m in re.finditer(pattern, text, re.M) if m.lastgroup]


def tags(text: str, limit: int = 10_000) -> list[tuple[str, str, str, int]]:
    """(role, kind, name, line): definitions with their kind, and calls as references, in order of line, at most ``limit``."""
    out = [("definition", s.type, s.name, s.line) for s in symbols(text)] + [("reference", "call", callee, line) for _, callee, _, line in call_sites(text)]
    return sorted(out, key=lambda x: (x[3], x[0], x[2]))[:limit]


def identifier_at(text: str, line: int, column: int) -> str | None:
    """The identifier, of any script, at or just before a position (line from 1, column from 0 in characters)."""
    rows = text.split("\n")
    if not 1 <= line <= len(rows):
        return None
    for m in re.finditer(r"[^\W\d][\w$]*|\$[\w$]*", rows[line - 1]):
        if m.start() <= column <= m.end():
            return m.group()
    return None


def utf16_to_byte(text: str, line: int, character: int) -> int | None:
    """Byte offset of a position whose column counts UTF-16 units (line from 0); columns beyond the line count as its end, in a surrogate pair as its start."""
    rows = text.split("\n")
    if not 0 <= line < len(rows):
        return None
    row, units, k = rows[line].rstrip("\r"), 0, 0
    while k < len(row):
        step = 2 if ord(row[k]) > 0xFFFF else 1
        if units + step > character:
            break
        units, k = units + step, k + 1
    return len("\n".join(rows[:line]).encode()) + (1 if line else 0) + len(row[:k].encode())


def position_to_byte(text: str, line: int, column: int) -> int | None:
    """Byte offset of (line from 1, column from 0 in code points); columns beyond the line count as its end."""
    rows = text.split("\n")
    if not 1 <= line <= len(rows) or column < 0:
        return None
    return len("\n".join(rows[: line - 1]).encode()) + (1 if line > 1 else 0) + len(rows[line - 1][:column].encode())


def byte_snippet(text: str, start: int, end: int) -> str | None:
    """The text between two byte offsets: the start must lie between characters, the end is rounded down to one."""
    raw = text.encode()
    if not 0 <= start <= end or start > len(raw) or start < len(raw) and raw[start] & 0xC0 == 0x80:
        return None
    return raw[start:end].decode("utf-8", "ignore")


def imported_summary(imported: DataFrame, per_file: int = 10) -> DataFrame:
    """(importer, summary) of imported symbols (importer, target, name, signature): one line a symbol under its file."""
    from pyspark.sql import Window as W

    rows = imported.withColumn("rn", F.row_number().over(W.partitionBy("importer", "target").orderBy("name"))).where(F.col("rn") <= per_file)
    line = F.concat(F.lit("  "), F.col("name"), F.when(F.col("signature").isNotNull(), F.concat(F.lit(": "), F.col("signature"))).otherwise(""))
    files = rows.groupBy("importer", "target").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("t"))
    return files.groupBy("importer").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "t"))), lambda x: F.concat(F.lit("From "), x["target"], F.lit(":\n"), x["t"])), "\n").alias("summary"))


# ------------------------------------------------------------------ syntax trees
def syntax_nodes(text: str, limit: int = 10_000, max_depth: int = 200) -> list[tuple[int, int, str, int, int, int, int, int, str, list[int]]]:
    """(id, parent, type, depth, line, column, endline, endcolumn, text, ancestors) of a Python text's tree in pre-order, within a budget of nodes; an invalid text gives none.

    The root has the id 0 and the parent -1; texts are cut to 200 characters.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines, out = text.split("\n"), []
    stack: list[tuple[ast.AST, int, int, list[int]]] = [(tree, -1, 0, [])]
    while stack and len(out) < limit:
        node, parent, depth, above = stack.pop()
        key = len(out)
        line, column = getattr(node, "lineno", 1), getattr(node, "col_offset", 0)
        endline, endcolumn = getattr(node, "end_lineno", len(lines)) or line, getattr(node, "end_col_offset", 0) or 0
        own = getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "attr", None) or getattr(node, "arg", None) or (repr(node.value) if isinstance(node, ast.Constant) else "")
        out.append((key, parent, type(node).__name__, depth, line, column, endline, endcolumn, str(own)[:200], above))
        if depth < max_depth:
            stack += [(c, key, depth + 1, [*above, key]) for c in reversed([c for c in ast.iter_child_nodes(node) if not isinstance(c, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop))])]
    return out


SYNTAX = "id int, parent int, type string, depth int, line int, column int, endline int, endcolumn int, text string, ancestors array<int>"
FUNCTIONS = {
    "symbols": (lambda t: [tuple(s) for s in symbols(t)], "type string, name string, start int, stop int, line int, endline int, signature string, modifiers array<string>"),
    "imports": (imports, "source string, names array<string>, is_default boolean, line int"),
    "exports": (exports, "name string, is_default boolean, line int"),
    "uses": (uses, "symbol string, start int, line int, name string, called boolean"),
    "hierarchy": (hierarchy, "kind string, name string, parents array<string>, line int"),
    "signals": (signals, "kind string, name string, operation string, start int, line int, evidence string"),
    "calls": (call_sites, "caller string, callee string, start int, line int"),
    "tags": (tags, "role string, kind string, name string, line int"),
    "syntax": (syntax_nodes, SYNTAX),
}


def extract(files: DataFrame, what: str, key: str = "filepath", text: str = "content") -> DataFrame:
    """Rows (key, columns of the table function ``what``) of every text; null texts give none."""
    return X.table_function(files, key, text, *FUNCTIONS[what])


def preset(files: DataFrame, name: str, key: str = "filepath", text: str = "content") -> DataFrame:
    """(key, name, line) of a named preset."""
    return X.table_function(files, key, text, PRESETS[name], "name string, line int")


def references(files: DataFrame, word: str, key: str = "filepath", text: str = "content") -> DataFrame:
    """(key, line, column, start) of every whole-word occurrence; only texts that hold the word reach Python."""
    some = files.where(F.lower(text).contains(word.lower()))
    return X.table_function(some, key, text, lambda t: word_references(t, word), "line int, column int, start int")


def tree_statistics(nodes: DataFrame) -> DataFrame:
    """(filepath, type, n, nodes, depth) of syntax nodes: how many of each type, of all, and the greatest depth."""
    total = nodes.groupBy("filepath").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"))
    return nodes.groupBy("filepath", "type").agg(F.count(F.lit(1)).alias("n")).join(total, "filepath")


def filter_nodes(nodes: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """Nodes of the included types within a depth; an excluded node takes everything below it along."""
    out = nodes
    if exclude:
        cut = nodes.where(F.col("type").isin(exclude)).groupBy("filepath").agg(F.collect_set("id").alias("cut"))  # bounded by a file's budget of nodes
        out = nodes.join(cut, "filepath", "left").where(F.col("cut").isNull() | ~(F.array_contains("cut", F.col("id")) | F.arrays_overlap("cut", "ancestors"))).drop("cut")
    if include:
        out = out.where(F.col("type").isin(include))
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def node_at(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(filepath, line, column, id, type, ancestors): the deepest node that holds each point (filepath, line, column), the last in pre-order."""
    n = nodes.select("filepath", "id", "type", "ancestors", F.struct("line", "column").alias("a"), F.struct(F.col("endline").alias("line"), F.col("endcolumn").alias("column")).alias("b"))
    p = points.withColumn("at", F.struct("line", "column"))
    hit = p.join(n, "filepath").where((F.col("a") <= F.col("at")) & (F.col("at") <= F.col("b")))
    best = hit.groupBy("filepath", "line", "column").agg(F.max(F.struct("id", "type", "ancestors")).alias("n"))
    return best.select("filepath", "line", "column", "n.id", "n.type", "n.ancestors")


def first_of_line_start(nodes: DataFrame) -> DataFrame:
    """Nodes once for each place at which one begins, the outermost."""
    return nodes.groupBy("filepath", "line", "column").agg(F.min_by(F.struct("id", "type"), "id").alias("n")).select("filepath", "line", "column", "n.id", "n.type")


def s_expression(nodes: DataFrame, leaf: int = 30) -> DataFrame:
    """(filepath, tree) as a bracketed text in pre-order, the texts of leaves cut to ``leaf`` characters. A file's nodes are bounded by the budget."""
    listed = nodes.groupBy("filepath").agg(F.sort_array(F.collect_list(F.struct("id", "depth", "type", F.substring("text", 1, leaf).alias("text")))).alias("l"))
    size = F.size("l")
    nxt = lambda k: F.when(k < size, F.element_at("l", k + 1)["depth"]).otherwise(F.lit(0))

    def one(k):
        node = F.element_at("l", k)
        depth = node["depth"]
        inner = F.when((nxt(k) <= depth) & (node["text"] != ""), F.concat(F.lit(' "'), node["text"], F.lit('"'))).otherwise("")
        closing = F.repeat(F.lit(")"), F.greatest(depth - nxt(k) + 1, F.lit(0)) + F.when(k == size, F.when(nxt(k) == 0, 0).otherwise(0)).otherwise(0))
        return F.concat(F.when(k > 1, " ").otherwise(""), F.lit("("), node["type"], inner, closing)

    return listed.select("filepath", F.array_join(F.transform(F.sequence(F.lit(1), size), one), "").alias("tree"))
