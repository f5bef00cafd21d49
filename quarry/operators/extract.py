"""Table functions from texts to rows: portable pattern-based extraction of symbols, imports, hierarchies, signals, calls, hunks and pieces."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Declaration patterns (name in group n).
_SYMBOLS = re.compile(
    r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:(?:public|private|protected|internal|static|final|abstract|async|pub(?:\([a-z]+\))?|open|sealed|override)\s+)*"
    r"(?P<k>class|interface|struct|trait|enum|type|function\*?|def|func|fn)\s+(?:\([^)]*\)\s*)?(?P<n>[A-Za-z_$][\w$]*)"
)
_KIND = {"class": "class", "interface": "interface", "struct": "class", "trait": "interface", "enum": "enum", "type": "type"}
_IMPORTS = re.compile(r"""(?m)^\s*(?:import\s+(?:type\s+)?(?:[\w*{}\s,$]+\s+from\s+)?["'](?P<a>[^"']+)["']|(?:const|let|var)\s+[\w{}\s,$:]+=\s*require\(\s*["'](?P<b>[^"']+)["']\s*\)|from\s+(?P<c>[\w.]+)\s+import\b|import\s+(?P<d>[\w.]+)\s*;?\s*$|use\s+(?P<e>[\w:\\]+)|require(?:_relative|_once)?\s*\(?\s*["'](?P<f>[^"']+)["']|using\s+(?P<g>[\w.]+)\s*;)""")
_HIERARCHY = re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:(?:public|abstract|final|sealed|default|static)\s+)*(?P<k>class|interface|struct|trait)\s+(?P<n>\w+)(?:<[^>{]*>)?(?P<rest>[^{\n:]*(?::[^{\n]*)?)")
_RUST_IMPL = re.compile(r"(?m)^\s*impl(?:<[^>]*>)?\s+(?P<p>[\w:]+)(?:<[^>]*>)?\s+for\s+(?P<n>\w+)")
_PY_CLASS = re.compile(r"(?m)^\s*class\s+(?P<n>\w+)\s*\((?P<p>[^)]*)\)\s*:")
_SIGNALS = {
    "route": re.compile(r"\b(?:app|router|server)\.(?:get|post|put|patch|delete|use)\(\s*[\"'](?P<v>[^\"']+)"),
    "decorator": re.compile(r"(?m)^\s*@(?P<v>[A-Za-z_][\w.]*)"),
    "event": re.compile(r"\.(?:on|once|emit|addListener|addEventListener)\(\s*[\"'](?P<v>[^\"']+)"),
    "dependency": re.compile(r"@(?:Inject|Autowired)\b|\b(?:inject|resolve)\(\s*(?P<v>\w+)"),
}
_CALL = re.compile(r"(?<![\w$.])(?P<n>[A-Za-z_$][\w$]*)\s*\(")
# Words before a bracket that are no calls.
_NO_CALL = frozenset("if for while switch catch return function def func fn class new typeof await match foreach print and or not in elif with lambda sizeof using lock except assert yield do else case".split())
_HUNK = re.compile(r"^@@ -(?P<a>\d+)(?:,(?P<b>\d+))? \+(?P<c>\d+)(?:,(?P<d>\d+))? @@")


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def symbols(text: str) -> list[tuple[str, str, int]]:
    """(type, name, line)."""
    starts = _line_starts(text)
    return [(_KIND.get(m["k"], "function"), m["n"], bisect_right(starts, m.start("n"))) for m in _SYMBOLS.finditer(text)]


def imports(text: str) -> list[tuple[str, int]]:
    starts = _line_starts(text)
    return [(next(g for g in m.groups() if g), bisect_right(starts, m.start(m.lastgroup))) for m in _IMPORTS.finditer(text)]


def split_types(text: str) -> list[str]:
    """A type list cut at its outer commas."""
    out, depth, last = [], 0, 0
    for k, ch in enumerate(text):
        depth += (ch in "<([{") - (ch in ">)]}")
        if ch == "," and depth == 0:
            out.append(text[last:k])
            last = k + 1
    out.append(text[last:])
    return [re.sub(r"<.*$|\(.*$|\b(?:public|private|virtual)\b", "", x).strip() for x in out if x.strip()]


def hierarchy(text: str) -> list[tuple[str, str, list[str], int]]:
    """(kind, name, parents, line) of types; of repeats the one with most parents."""
    starts, found = _line_starts(text), {}
    for m in _HIERARCHY.finditer(text):
        rest = m["rest"]
        parents = []
        for word in ("extends", "implements", ":"):
            part = re.search(rf"{word}\s*(.*?)(?=\bimplements\b|\bextends\b|\bwhere\b|$)", rest) if word != ":" else re.search(r"^\s*:\s*(.*)$", rest)
            if part:
                parents += split_types(part[1])
        key = (m["k"], m["n"], bisect_right(starts, m.start("n")))
        if len(parents) >= len(found.get(key, [])):
            found[key] = parents
    for m in _PY_CLASS.finditer(text):
        found[("class", m["n"], bisect_right(starts, m.start("n")))] = [x for x in split_types(m["p"]) if "=" not in x]
    for m in _RUST_IMPL.finditer(text):
        found[("impl", m["n"], bisect_right(starts, m.start("n")))] = [m["p"]]
    return [(k, n, p, line) for (k, n, line), p in sorted(found.items(), key=lambda x: (x[0][2], x[0][1]))]


def signals(text: str) -> list[tuple[str, str, int]]:
    starts = _line_starts(text)
    out = [(kind, m["v"] or m.group(), bisect_right(starts, m.start())) for kind, p in _SIGNALS.items() for m in p.finditer(text)]
    return sorted(out, key=lambda x: (x[2], x[0], x[1]))


def calls(text: str) -> list[tuple[str, int]]:
    starts = _line_starts(text)
    return [(m["n"], bisect_right(starts, m.start())) for m in _CALL.finditer(text) if m["n"] not in _NO_CALL]


def hunks(diff: str) -> list[tuple[str, int, int, int, int]]:
    """(path, old start, old lines, new start, new lines) of a unified diff; a missing count is 1."""
    out, path = [], ""
    for line in diff.splitlines():
        if line.startswith("+++ "):
            path = re.sub(r"^[ab]/", "", line[4:].split("\t")[0].strip())
        m = _HUNK.match(line)
        if m:
            out.append((path, int(m["a"]), int(m["b"] or 1), int(m["c"]), int(m["d"] or 1)))
    return out


def split_lines(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first line, last line, piece): lines taken greedily up to ``size`` characters, the tail of at least ``overlap`` characters repeated; a longer line stays whole."""
    lines, out, current, start, used = text.split("\n"), [], [], 1, 0
    for number, line in enumerate(lines, 1):
        if current and used + len(line) + 1 > size:
            out.append((start, number - 1, "\n".join(current)))
            tail, length = [], 0
            while current and length < overlap and len(tail) < len(current) - 1:
                tail.insert(0, current[-1 - len(tail)])
                length += len(tail[0]) + 1
            current, used = tail, length
            start = number - len(tail)
        current.append(line)
        used += len(line) + 1
    if current:
        out.append((start, len(lines), "\n".join(current)))
    return out


# Separators of a language's splitter from the coarsest to the finest; what all have comes last.
_LAST = ["\n\n", "\n", " ", ""]
_FLOW = ["\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase "]
SEPARATORS = {
    "": _LAST,
    "python": ["\nclass ", "\ndef ", "\n\tdef ", *_LAST],
    "js": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", *_FLOW, "\ndefault ", *_LAST],
    "go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\ncase ", *_LAST],
    "java": ["\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", *_FLOW, *_LAST],
    "cpp": ["\nclass ", "\nvoid ", "\nint ", "\nfloat ", "\ndouble ", *_FLOW, *_LAST],
    "rust": ["\nfn ", "\nconst ", "\nlet ", "\nif ", "\nwhile ", "\nfor ", "\nloop ", "\nmatch ", *_LAST],
    "php": ["\nfunction ", "\nclass ", "\nif ", "\nforeach ", "\nwhile ", "\ndo ", "\nswitch ", "\ncase ", *_LAST],
    "ruby": ["\ndef ", "\nclass ", "\nif ", "\nunless ", "\nwhile ", "\nfor ", "\ndo ", "\nbegin ", "\nrescue ", *_LAST],
    "scala": ["\nclass ", "\nobject ", "\ndef ", "\nval ", "\nvar ", "\nif ", "\nfor ", "\nwhile ", "\nmatch ", "\ncase ", *_LAST],
    "swift": ["\nfunc ", "\nclass ", "\nstruct ", "\nenum ", "\nif ", "\nfor ", "\nwhile ", "\ndo ", "\nswitch ", "\ncase ", *_LAST],
    "markdown": ["\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "```\n\n", "\n\n***\n\n", "\n\n---\n\n", "\n\n___\n\n", *_LAST],
    "html": ["<body>", "<div>", "<p>", "<br>", "<li>", "<h1>", "<h2>", "<h3>", "<h4>", "<h5>", "<h6>", "<span>", "<table>", "<tr>", "<td>", "<th>", "<ul>", "<ol>", "<header>", "<footer>", "<nav>", "<head>", "<style>", "<script>", "<meta>", "<title>", " ", ""],
    "latex": ["\n\\chapter{", "\n\\section{", "\n\\subsection{", "\n\\subsubsection{", "\n\\begin{enumerate}", "\n\\begin{itemize}", "\n\\begin{description}", "\n\\begin{list}", "\n\\begin{quote}", "\n\\begin{quotation}", "\n\\begin{verse}", "\n\\begin{verbatim}", "\n\\begin{align}", "$$", "$", *_LAST],
    "proto": ["\nmessage ", "\nservice ", "\nenum ", "\noption ", "\nimport ", "\nsyntax ", *_LAST],
    "rst": ["\n===\n", "\n---\n", "\n***\n", "\n.. ", *_LAST],
    "sol": ["\npragma ", "\nusing ", "\ncontract ", "\ninterface ", "\nlibrary ", "\nconstructor ", "\ntype ", "\nfunction ", "\nevent ", "\nmodifier ", "\nerror ", "\nstruct ", "\nenum ", "\nif ", "\nfor ", "\nwhile ", "\ndo while ", "\nassembly ", *_LAST],
}


def split_recursive(text: str, size: int, overlap: int, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most ``size`` characters, split by the coarsest separator that helps and merged with ``overlap``."""
    seps = separators or SEPARATORS[""]
    sep = next((s for s in seps if s == "" or s in text), "")
    rest = seps[seps.index(sep) + 1 :]
    parts = list(text) if sep == "" else [(sep if k else "") + p for k, p in enumerate(text.split(sep))]
    small: list[str] = []
    for p in parts:
        small += [p] if len(p) <= size or not rest else split_recursive(p, size, overlap, rest)
    out, current = [], ""
    for p in small:
        if current and len(current) + len(p) > size:
            out.append(current)
            current = current[-overlap:] if overlap and len(current[-overlap:]) + len(p) <= size else ""
        current += p
    return [x.strip() for x in [*out, current] if x.strip()]


_FUNCTIONS = {
    "symbols": (symbols, "type string, name string, line int"),
    "imports": (imports, "target string, line int"),
    "hierarchy": (hierarchy, "kind string, name string, parents array<string>, line int"),
    "signals": (signals, "kind string, value string, line int"),
    "calls": (calls, "name string, line int"),
    "hunks": (hunks, "path string, old_start int, old_lines int, new_start int, new_lines int"),
}


def extract(df: DataFrame, what: str, key: str, text: str) -> DataFrame:
    """Rows (key, columns of the table function ``what``) of every text; null texts give none."""
    return table_function(df, key, text, *_FUNCTIONS[what])


def table_function(df: DataFrame, key: str, text: str, function, fields: str) -> DataFrame:
    """A function from a text to tuples as a row generator, in Arrow batches."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, *(f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", fields))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *r) for k, t in zip(pdf[key], pdf[text], strict=True) for r in function(t)]
            yield pd.DataFrame(rows, columns=names)

    return df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, {fields}")
