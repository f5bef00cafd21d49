"""Token scanners for the programming languages the source-code operators read.

One master expression per language splits a text into tokens; literals that nest
(templates, interpolation, here documents, nested comments) are closed by small
hand-written scanners. Pure functions over one text, used inside Arrow batches.
"""

from __future__ import annotations

import operator
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate, compress

# File extension -> language.
EXTENSIONS = {
    "py": "python", "pyi": "python", "pyw": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "java": "java", "go": "go", "cs": "csharp", "rs": "rust", "php": "php", "rb": "ruby",
    "json": "json", "md": "markdown", "markdown": "markdown", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "ini": "ini", "cfg": "ini", "env": "env",
}
CODE_LANGUAGES = ("python", "javascript", "typescript", "java", "go", "csharp", "rust", "php", "ruby")

# Token kinds.
COMMENT, STRING, NUMBER, IDENT, OP, REGEX, NEWLINE, BAD = "c", "s", "n", "i", "o", "r", "l", "x"

_NUM = r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)\w*"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_OPS = r">>>=|<<=|>>=|\*\*=|===|!==|\.\.\.|\.\.=|<=>|\?\?=|&&=|\|\|=|=>|->|<-|::|:=|\+\+|--|&&|\|\||\?\?|\?\.|\?->|==|!=|<=|[+\-*/%&|^]=|>=|\*\*|=~|!~|\.\.|<<|[{}()\[\];,<>=+\-*/%&|^!~?:.@#\\$]"


def _master(*parts: tuple[str, str]) -> re.Pattern:
    """White space is taken along with the token behind it, so that it costs no match of its own."""
    space = r"[ \t\f\v\xa0\ufeff]"
    return re.compile(space + "*(?:(?P<l>\n)|" + "|".join(f"(?P<{k}>{p})" for k, p in parts) + r"|(?P<w>\\\n)|(?P<x>[^ \t\f\v\xa0\ufeff]))")


_C_COMMENT = ("c", r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/")
_QUICK = ("k", r"[(){}\[\],;]")  # signs that begin nothing else
# Names come first because they are the most frequent.
_PARTS: dict[str, tuple[tuple[str, str], ...]] = {
    "python": (
        ("i", r"(?!(?:[rbufRBUF]|[rR][bBfF]|[bBfF][rR])[\"'])[^\W\d]\w*"), _QUICK, ("c", r"#[^\n]*"),
        ("s", r"(?i:[rbuf]|rb|br|rf|fr)?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|(?!\"\"\"|''')(?:" + _DQ + "|" + _SQ + "))"),
        ("n", _NUM), ("o", _OPS)),
    "javascript": (("i", r"[#]?[^\W\d][\w$]*|\$[\w$]*"), _QUICK, _C_COMMENT, ("t", r"`"), ("s", _DQ + "|" + _SQ), ("n", _NUM), ("d", r"/"), ("o", _OPS)),
    "java": (("i", r"[^\W\d][\w$]*"), _QUICK, _C_COMMENT, ("s", r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|(?!""")' + _DQ + r"|'(?:[^'\\\n]|\\[^\n]{1,6}?)'"), ("n", _NUM), ("o", _OPS)),
    "go": (("i", r"[^\W\d]\w*"), _QUICK, _C_COMMENT, ("s", _DQ + r"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{1,10}?)'"), ("n", _NUM), ("o", _OPS)),
    "csharp": (
        ("i", r"@?[^\W\d]\w*"), _QUICK, _C_COMMENT,
        ("s", r'\$*"""[\s\S]*?"""(?!")|(?:@\$?|\$@)"(?:[^"]|"")*"|\$"(?:[^"\\\n{]|\\.|\{\{|\{(?:[^{}"\n]|"(?:[^"\\\n]|\\.)*"|\{[^{}\n]*\})*\})*"|' + _DQ + r"|'(?:[^'\\\n]|\\[^\n]{1,8}?)'"),
        ("p", r"#(?:region|endregion|pragma|if|elif|else|endif|define|undef|nullable|error|warning|line|r|load)\b[^\n]*"), ("n", _NUM), ("o", _OPS)),
    "rust": (
        ("i", r"(?!b?r#*\"|[bc]\"|b')(?:r#)?[^\W\d]\w*|'[^\W\d]\w*+(?!')"), _QUICK, ("c", r"//[^\n]*"), ("b", r"/\*"),
        ("s", r'b?r(?P<h>#*)"[\s\S]*?"(?P=h)|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?\'(?:[^\'\\\n]|\\(?:u\{[^}]*\}|x..|.))\''),
        ("n", r"(?:0[xbo][\da-fA-F_]+|\d[\d_]*(?:\.(?!\.)(?![A-Za-z_])[\d_]*)?(?:[eE][+-]?\d+)?)\w*"), ("o", _OPS)),
    "php": (
        ("i", r"\$+[^\W\d]\w*|\\?[^\W\d]\w*(?:\\[^\W\d]\w*)*"), _QUICK,
        ("c", r"//(?:(?!\?>)[^\n])*|#(?!\[)(?:(?!\?>)[^\n])*|/\*(?:[^*]|\*(?!/))*\*/"), ("q", r"\?>"), ("h", r"<<<[ \t]*(?P<hq>['\"]?)(?P<hn>[A-Za-z_]\w*)(?P=hq)"),
        ("s", r'"(?:[^"\\]|\\[\s\S])*"|\'(?:[^\'\\]|\\[\s\S])*\'|`[^`]*`'), ("n", _NUM), ("o", _OPS)),
    "ruby": (
        ("c", r"(?:(?<=\n)|\A)=begin\b[\s\S]*?\n=end[^\n]*|#[^\n]*"), ("z", r"(?:(?<=\n)|\A)__END__\n[\s\S]*"),
        ("i", r":[^\W\d]\w*[?!=]?(?![\w:])|:\"(?:[^\"\\\n]|\\.)*\"|@{0,2}[^\W\d]\w*(?:[?!](?!=))?|\$[\w~!@&+`'=/\\,;.<>*?:\"]\w*"), _QUICK,
        ("h", r"<<[~-]?(?P<hq>['\"`]?)(?P<hn>[A-Za-z_]\w*)(?P=hq)"), ("t", r"\""), ("s", r"'(?:[^'\\]|\\[\s\S])*'|`[^`\n]*`"), ("pct", r"%[wWiIqQr]?[\[({<|!]"), ("n", _NUM), ("d", r"/"), ("o", _OPS)),
}
_MASTERS = {k: _master(*v) for k, v in _PARTS.items()}
_MASTERS["typescript"] = _MASTERS["javascript"]

_REGEX = re.compile(r"/(?![*\s])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
# Languages whose tokens mostly need no context: then a text alone tells a token's kind.
SIMPLE_LANGUAGES = ("python", "javascript", "typescript", "java", "go", "csharp", "rust", "php")
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}\"'`]*\})*`"
# A slash close behind a bracket or a number divides, one behind a sign that awaits an operand begins a regular expression.
_SLASH = r"(?:(?<=[)\]\d])|(?<=[)\]\d] ))/=?|(?:(?<=[(,=:!&|?{;\[+])|(?<=[(,=:!&|?{;\[+] ))" + _REGEX.pattern
_RAW = "b?r(?:" + "|".join(rf'{h}"[\s\S]*?"{h}' for h in ("#" * k for k in range(7))) + ")"


def _simple(lang: str) -> re.Pattern:
    """The master with a single group, which stays empty for a token that needs context and for a bad one."""
    own = {"t": _TEMPLATE, "d": _SLASH, "b": None, "q": None, "h": None}
    parts = [own.get(k, p) for k, p in _PARTS[lang][:-1]]
    parts = [p.replace(r'b?r(?P<h>#*)"[\s\S]*?"(?P=h)', _RAW) for p in parts if p]
    left = {"javascript": "(?!/)", "rust": r"(?!/\*)", "php": r"(?!#|\?>|<<<)"}.get(lang, "")
    space = r"[ \t\f\v\xa0\ufeff]"
    return re.compile(space + "*(?:(\n|" + "|".join(parts) + f"|{left}(?:{_OPS}))|[^ \t\f\v\xa0\ufeff])")


_SIMPLE = {x: _simple(x) for x in SIMPLE_LANGUAGES if x != "typescript"}
_SIMPLE["typescript"] = _SIMPLE["javascript"]

# After these words a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "and", "or", "not", "if", "elsif", "unless", "while", "until", "when", "then", "puts", "match"}
_REGEX_RUBY = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_CLOSERS = {"[": "]", "(": ")", "{": "}", "<": ">", "|": "|", "!": "!"}


def _skip_braces(src: str, pos: int) -> int:
    """End of the interpolation whose ``{`` lies just before ``pos``, or -1."""
    depth, n = 1, len(src)
    while pos < n:
        ch = src[pos]
        if ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if not depth:
                return pos + 1
        elif ch in "\"'":
            end = pos + 1
            while end < n and src[end] != ch and src[end] != "\n":
                end += 2 if src[end] == "\\" else 1
            pos = end
        elif ch == "`":
            pos = _template(src, pos + 1) - 1
            if pos < 0:
                return -1
        pos += 1
    return -1


def _template(src: str, pos: int, close: str = "`", mark: str = "$") -> int:
    """End of a literal with ``${}``/``#{}`` interpolation opened before ``pos``, or -1."""
    n = len(src)
    while pos < n:
        ch = src[pos]
        if ch == "\\":
            pos += 2
        elif ch == close:
            return pos + 1
        elif ch == mark and src.startswith("{", pos + 1):
            pos = _skip_braces(src, pos + 2)
            if pos < 0:
                return -1
        else:
            pos += 1
    return -1


def _nested_comment(src: str, pos: int) -> int:
    depth = 1
    for m in re.compile(r"/\*|\*/").finditer(src, pos):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


def tokens(src: str, lang: str) -> list[tuple[str, str, int]]:
    """(kind, text, offset) of every token of ``src``; an unknown language gives one BAD token."""
    master = _MASTERS.get(lang)
    if master is None:
        return [(BAD, src, 0)] if src else []
    out: list[tuple[str, str, int]] = []
    n, pos = len(src), 0
    heredocs: list[tuple[str, bool]] = []
    if lang == "php":
        at = src.find("<?")
        if at >= 0:
            if src[:at].strip():
                out.append((STRING, src[:at], 0))
            pos = at + (5 if src.startswith("<?php", at) else 3 if src.startswith("<?=", at) else 2)
    elif lang in ("javascript", "typescript", "ruby", "python", "rust") and src.startswith("#!") and not src.startswith("#!["):
        pos = n if (at := src.find("\n")) < 0 else at
    add, plain = out.append, _PLAIN
    while pos < n:
        for m in master.finditer(src, pos):
            kind = m.lastgroup
            if kind in plain:
                text = m[kind]
                add((kind, text, m.end() - len(text)))
                continue
            if kind == "k":
                add(("o", m["k"], m.end() - 1))
                continue
            if kind == "l":
                add(("l", "\n", m.end() - 1))
                if heredocs:
                    pos = m.end()
                    break
                continue
            if kind == "w":
                continue
            pos = _special(src, lang, kind, m, out, heredocs)
            if pos != m.end():
                break
        else:
            break
        if heredocs and out and out[-1][0] == NEWLINE:
            for name, loose in heredocs:
                close = re.compile(rf"^[ \t]*{name}\b" if loose else rf"^{name}\b", re.M).search(src, pos)
                if close is None:
                    add((BAD, src[pos:], pos))
                    pos = n
                    break
                add((STRING, src[pos : close.start()], pos))
                pos = close.end()
            heredocs.clear()
    if heredocs:
        add((BAD, "", n))
    return out


def simple_tokens(src: str, lang: str) -> list[str] | None:
    """The texts of ``tokens``; None for a text with a token that needs its context or is a bad one."""
    pattern, pos = _SIMPLE.get(lang), _simple_begin(src, lang)
    if pattern is None or pos < 0:
        return None
    out = pattern.findall(src, pos)
    return None if "" in out else out


def _simple_begin(src: str, lang: str) -> int:
    """Where the tokens of ``simple_tokens`` begin, or -1."""
    if lang in ("javascript", "typescript", "python", "rust") and src.startswith("#!") and not src.startswith("#!["):
        return len(src) if (at := src.find("\n")) < 0 else at
    if lang == "php" and (at := src.find("<?")) >= 0:
        return -1 if src[:at].strip() else at + (5 if src.startswith("<?php", at) else 3 if src.startswith("<?=", at) else 2)
    return 0


def simple_kind(token: str, lang: str) -> str:
    """The kind of a token of ``simple_tokens``."""
    kind = _MASTERS[lang].match(token).lastgroup
    if kind == "d":
        return OP if token in ("/", "/=") else REGEX
    return {"k": OP, "p": COMMENT, "t": STRING}.get(kind, kind)


class _Kinds(dict):
    """Kinds of short tokens of a language by their text, a bounded number of them."""

    def __init__(self, lang: str):
        self.lang = lang

    def __missing__(self, token: str) -> str:
        if token.isidentifier():
            kind = IDENT
        elif token[0] == '"':
            kind = STRING
        elif token.startswith(("//", "/*")):
            kind = COMMENT
        else:
            kind = simple_kind(token, self.lang)
        if len(token) <= 40:
            if len(self) >= 1 << 15:
                self.clear()
            self[token] = kind
        return kind


_KINDS = {x: _Kinds(x) for x in _SIMPLE}


def _heads(lang: str) -> dict[int, str]:
    """First characters that alone tell the kind of a token of ``simple_tokens``; all others become a question mark."""
    table = dict.fromkeys(range(128), "?") | {ord("\n"): NEWLINE, ord('"'): STRING}
    letters = "abcdefghijklmnopqrstuvwxyz"
    prefixes = {"python": "rbuf", "rust": "rbc"}.get(lang, "")
    table |= {ord(y): IDENT for x in letters if x not in prefixes for y in (x, x.upper())} | {ord("_"): IDENT}
    table |= {ord(x): NUMBER for x in "0123456789"} | {ord(x): OP for x in "(){}[],;=+*%&|^!~:>"}
    return table


_HEAD_KINDS = {x: _heads(x) for x in _SIMPLE}
_UNTOLD = re.compile(r"[^lsino]")


def _simple_kinds(texts: list[str], lang: str) -> str:
    """The kinds of ``simple_tokens``."""
    kinds = "".join([x[0] for x in texts]).translate(_HEAD_KINDS[lang])
    untold = [m.start() for m in _UNTOLD.finditer(kinds)]
    if not untold:
        return kinds
    out, known = list(kinds), _KINDS[lang]
    for i in untold:
        out[i] = known[texts[i]]
    return "".join(out)


_RUNS = re.compile(r"[cSX]|[^lcSX]+l*|l+")  # of the kinds of a text's tokens; S and X are those over several lines
_ANY = re.compile(".")
_IS_CODE = bytes(chr(x) not in "lc" for x in range(256))
_NO_CODE = str.maketrans("", "", "lc")


class Code:
    """The tokens of a text in parallel sequences, with their lines; offsets are worked out when asked for.

    ``kinds`` and ``texts`` are of all tokens; ``k``, ``t`` and ``line_of`` leave comments and line ends out,
    ``place`` is the index of such a token among all. ``first`` marks those that begin a line's code, ``broken``
    those behind a line end or a comment over several lines.
    """

    def __init__(self, src: str, lang: str):
        self.src, self.lang = src, lang
        self.lines = Lines(src)
        texts = simple_tokens(src, lang)
        if texts is None:
            toks = tokens(src, lang)
            self.kinds, texts, self.offsets, self.begin = "".join([t[0] for t in toks]), [t[1] for t in toks], [t[2] for t in toks], 0
        else:
            self.kinds, self.offsets, self.begin = _simple_kinds(texts, lang), None, _simple_begin(src, lang)
        self.texts = texts
        code = self.kinds.encode().translate(_IS_CODE)
        self.k, self.t, self.place = self.kinds.translate(_NO_CODE), list(compress(texts, code)), list(compress(range(len(texts)), code))
        self._pass()

    def _pass(self):
        kinds, texts, starts = self.kinds, self.texts, self.lines.starts
        self.coded = bytearray(len(starts) + 2)  # the line holds code
        self.commented = bytearray(len(starts) + 2)
        self.remark: dict[int, list[tuple[int, str]]] = {}  # comments by line, with their index
        self.first = bytearray(len(self.t))
        self.broken = bytearray(len(self.t))
        self.line_of: list[int] = []
        self.ends: list[int] = []  # indices of line ends, of several in a row the last
        self.end_lines: list[int] = []
        if wide := [i for i in (m.start() for m in _LITERAL.finditer(kinds)) if "\n" in texts[i]]:
            marked = list(kinds)
            for i in wide:
                marked[i] = marked[i].upper()
            kinds = "".join(marked)
        coded, first, breaks, line_of, ends, end_lines = self.coded, self.first, self.broken, self.line_of, self.ends, self.end_lines
        gaps = self.lang == "php" and self.offsets is not None  # text between code, which holds line ends that are no tokens
        line, fresh, broken, n = 1 + self.src.count("\n", 0, self.begin), True, False, 0
        for m in (_ANY if gaps else _RUNS).finditer(kinds):
            at, end = m.span()
            kind = kinds[at]
            if gaps:
                line = self.lines.of(self.offsets[at])
            if kind == "c":
                self.remark.setdefault(line, []).append((at, texts[at]))
                self.commented[line] = 1
                for _ in range(texts[at].count("\n")):
                    line += 1
                    self.commented[line] = 1
                    broken = True
                continue
            size = kinds.find("l", at, end) - at
            if size < 0:
                size = end - at
            if size:
                if fresh:
                    coded[line] = first[n] = 1
                    fresh = False
                if broken:
                    breaks[n] = 1
                    broken = False
                line_of += [line] * size
                n += size
                if kind in "SX":
                    for _ in range(texts[at].count("\n")):
                        line += 1
                        coded[line] = 1
            if at + size < end:
                line += end - at - size
                ends.append(end - 1)
                end_lines.append(line - 1)
                fresh = broken = True

    def offset(self, i: int) -> int:
        """Offset of the ``i``-th token that is code."""
        at = self.place[i]
        if self.offsets is not None:
            return self.offsets[at]
        src, texts = self.src, self.texts
        b = bisect_left(self.ends, at) - 1
        k, pos = (self.ends[b] + 1, self.lines.starts[self.end_lines[b]]) if b >= 0 else (0, self.begin)
        for text in texts[k:at]:
            pos = src.index(text, pos) + len(text)  # only white space lies between
        return src.index(texts[at], pos)

    def tuples(self) -> list[tuple[str, str, int]]:
        """The rows of ``tokens``."""
        if self.offsets is None:
            find, pos, out = self.src.index, self.begin, []
            for text in self.texts:
                pos = find(text, pos)
                out.append(pos)
                pos += len(text)
            self.offsets = out
        return list(zip(self.kinds, self.texts, self.offsets, strict=True))


_LITERAL = re.compile("[sx]")
_PLAIN = frozenset("csniox")


def _previous(out: list[tuple[str, str, int]]) -> tuple[str, str]:
    """Kind and text of the last token that isn't a comment or line end."""
    for kind, text, _ in reversed(out):
        if kind not in (COMMENT, NEWLINE):
            return kind, text
    return "", ""


def _special(src: str, lang: str, kind: str, m: re.Match, out: list[tuple[str, str, int]], heredocs: list[tuple[str, bool]]) -> int:
    """A token that needs its context; appends it and gives the offset behind it."""
    pos, end, n = m.start(kind), m.end(), len(src)
    last_kind, last = _previous(out)
    if kind == "t":
        end = _template(src, pos + 1, "`", "$") if lang != "ruby" else _template(src, pos + 1, '"', "#")
        kind = STRING
        if end < 0:
            kind, end = BAD, n
    elif kind == "d":
        free = not last_kind or (last_kind == OP and last not in (")", "]", "}")) or (last_kind == IDENT and last in _BEFORE_REGEX)
        if lang == "ruby" and last_kind == IDENT and not free:
            free = src[pos - 1] in " \t" and src[pos + 1 : pos + 2] not in (" ", "=", "")
        r = (_REGEX if lang != "ruby" else _REGEX_RUBY).match(src, pos) if free else None
        if r:
            kind, end = REGEX, r.end()
        else:
            kind, end = OP, pos + (2 if src.startswith("/=", pos) else 1)
    elif kind == "b":
        end = _nested_comment(src, end)
        kind = COMMENT
        if end < 0:
            kind, end = BAD, n
    elif kind == "p":
        kind = COMMENT
    elif kind == "q":
        at = src.find("<?", end)
        out.append((OP, ";", pos))
        return n if at < 0 else at + (5 if src.startswith("<?php", at) else 3 if src.startswith("<?=", at) else 2)
    elif kind == "z":
        return n
    elif kind == "h":
        shift = last_kind in (NUMBER, STRING) or last in (")", "]") or last_kind == IDENT and src[pos - 1] not in " \t("
        if lang == "ruby" and (shift or src[pos + 2 : pos + 3] not in ("~", "-") and not re.match(r"<<['\"]?[A-Z]", src[pos : pos + 4])):
            kind, end = OP, pos + 2
        else:
            heredocs.append((m["hn"], lang == "php" or src[pos + 2] in "~-"))
            kind = STRING
    elif kind == "pct":
        if last_kind in (NUMBER, IDENT) and src[pos - 1 : pos] != " " or last in (")", "]") or last_kind == NUMBER:
            kind, end = OP, pos + 1
        else:
            opener = src[end - 1]
            closer, depth, at = _CLOSERS[opener], 1, end
            while at < n and depth:
                ch = src[at]
                if ch == "\\":
                    at += 1
                elif ch == closer:
                    depth -= 1
                elif ch == opener:
                    depth += 1
                at += 1
            kind, end = (STRING, at) if not depth else (BAD, n)
    out.append((kind, src[pos:end], pos))
    return end


class Lines:
    """Offset to 1-based line number."""

    def __init__(self, src: str):
        parts = src.split("\n")
        self.starts = [0, *map(operator.add, accumulate(map(len, parts)), range(1, len(parts)))]

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)


def clean(text: str | None) -> str:
    """CRLF and lone CR count as one line feed; null as the empty text."""
    return (text or "").replace("\r\n", "\n").replace("\r", "\n")


@lru_cache(maxsize=65536)
def language_of(filepath: str | None, language: str | None) -> str | None:
    """The ``language`` value in lower case, or that of the extension if it is null or blank."""
    if language and language.strip():
        return language.strip().lower()
    name = (filepath or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    if name.startswith("dockerfile") or name.endswith(".dockerfile"):
        return "dockerfile"
    if name == ".env" or name.startswith(".env."):
        return "env"
    return EXTENSIONS.get(name.rsplit(".", 1)[-1]) if "." in name else None
