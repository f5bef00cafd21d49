"""Declarations of functions, methods and types in a source text, with their leading comments."""

from __future__ import annotations

import re
from typing import NamedTuple

from .lexer import IDENT, STRING, Code


class Declaration(NamedTuple):
    kind: str  # function, method or type
    name: str
    owner: str  # names of the enclosing types, joined by dots
    line: int  # of the name
    first_line: int  # of the first comment or annotation directly above
    start: int  # offset of the first modifier or keyword
    end: int  # offset behind the header
    bodied: bool
    comments: tuple[str, ...]  # comment texts directly above
    docstring: str | None


# Words that may stand before a declaration.
_MODS = {
    "javascript": "export default async static get set",
    "typescript": "export default declare abstract async public private protected static readonly override get set",
    "java": "public protected private static final abstract native synchronized transient volatile strictfp default sealed",
    "csharp": "public protected private internal static readonly sealed abstract virtual override async extern unsafe volatile partial new required file",
    "rust": "pub const async unsafe extern default crate",
    "php": "public private protected static abstract final readonly",
    "ruby": "private public protected module_function private_class_method public_class_method",
    "python": "async",
    "go": "",
}
_MODS = {k: frozenset(v.split()) for k, v in _MODS.items()}
_TYPES = {
    "javascript": "class", "typescript": "class interface enum", "java": "class interface enum record", "csharp": "class interface enum struct record",
    "rust": "struct enum trait impl union", "php": "class interface trait enum", "ruby": "class module", "python": "class", "go": "",
}
_TYPES = {k: frozenset(v.split()) for k, v in _TYPES.items()}
# Words that look like a callee or a type but head a statement.
_NO_NAME = frozenset("if for while switch catch return throw new else do try finally await yield function typeof delete void in of case using lock foreach fixed match super this with assert synchronized instanceof is as base when where select from goto default checked unchecked elseif unless until and or not import export require super".split())


_BRACKETS = frozenset("()[]{}")


# Words one of which begins every declaration, by language; and words that begin none where a type can.
_HEADS = {k: _MODS[k] | _TYPES[k] | frozenset(v.split()) for k, v in {"python": "def", "ruby": "def", "go": "func type", "rust": "fn", "php": "function"}.items()}
_STATEMENTS = frozenset("if for while switch return try throw else do case catch finally this super await yield foreach break continue assert lock import package".split())


class _Scan:
    def __init__(self, src: str, lang: str, code: Code | None = None):
        self.src, self.lang = src, lang
        self.code = code = Code(src, lang) if code is None else code
        self.t, self.k, self.line_of, self.offset = code.t, code.k, code.line_of, code.offset
        self.annotated = bytearray(len(code.coded))
        self.n = len(self.t)
        self.contract = False  # the place is directly in an interface, where methods need no body and no modifier

    def marks(self) -> list[int]:
        """The tokens that begin a line's code or are brackets."""
        k = self.k
        return [i for i, (first, text) in enumerate(zip(self.code.first, self.t, strict=True)) if first or text in _BRACKETS and k[i] == "o"]

    def text(self, i: int) -> str:
        return self.t[i] if i < self.n else ""

    def kind(self, i: int) -> str:
        return self.k[i] if i < self.n else ""

    def group(self, i: int) -> int:
        """Index behind the bracket group opening at ``i``; the end of the text when it never closes."""
        depth = 0
        while i < self.n:
            if self.k[i] == "o":
                text = self.t[i]
                if text in ("(", "[", "{"):
                    depth += 1
                elif text in (")", "]", "}"):
                    depth -= 1
                    if depth <= 0:
                        return i + 1
            i += 1
        return self.n

    def angles(self, i: int) -> int:
        """Index behind the type arguments opening at ``i``, or -1."""
        depth, start = 0, i
        while i < self.n and i - start < 60:
            if self.k[i] == "o":
                text = self.t[i]
                if text == "<":
                    depth += 1
                elif text in (">", ">>", ">>>"):
                    depth -= len(text)
                    if depth <= 0:
                        return i + 1
                elif text in (";", "{", "}", ")"):
                    return -1
                elif text == "(":
                    i = self.group(i) - 1
            i += 1
        return -1

    # -- annotations, from a first token of a line
    def annotation(self, i: int) -> int:
        """Index behind an annotation at ``i``, or ``i``."""
        text, lang = self.text(i), self.lang
        if self.kind(i) != "o":
            return i
        if text == "@" and lang in ("python", "java", "javascript", "typescript") and self.kind(i + 1) == IDENT and self.text(i + 1) != "interface":
            j = i + 2
            while self.text(j) == "." and self.kind(j + 1) == IDENT:
                j += 2
            while self.text(j) == "(" or lang == "python" and self.text(j) in ("[",) and self.line_of[j] == self.line_of[j - 1]:
                j = self.group(j)
            return j
        if text == "[" and lang == "csharp" and self.kind(i + 1) == IDENT:
            return self.group(i)
        if text == "#" and lang in ("rust", "php"):
            j = i + 1 + (self.text(i + 1) == "!")
            if self.text(j) == "[":
                return self.group(j)
        return i

    def type_ref(self, i: int) -> int:
        """Index behind a type at ``i``, or -1 (Java, C#)."""
        if self.text(i) == "(" and self.lang == "csharp":
            i = self.group(i)
        else:
            if self.kind(i) != IDENT or self.text(i) in _NO_NAME and self.text(i) != "void":
                return -1
            i += 1
            while True:
                if self.text(i) == "<":
                    i = self.angles(i)
                    if i < 0:
                        return -1
                if self.text(i) in (".", "::") and self.kind(i + 1) == IDENT:
                    i += 2
                    continue
                break
        while True:
            if self.text(i) == "[" and self.text(i + 1) in ("]", ","):
                i = self.group(i)
            elif self.text(i) in ("?", "*") and self.lang == "csharp":
                i += 1
            else:
                return i

    def header(self, i: int):
        """(kind, name index or -1, index behind the header, bodied) of a declaration whose modifiers begin at ``i``, or None."""
        lang, mods = self.lang, set()
        words = _MODS[lang]
        j = i
        while self.kind(j) == IDENT and self.text(j) in words:
            if lang in ("javascript", "typescript") and self.text(j + 1) in ("(", "=", ":", ";", ",", ".", "?", "}", ")"):
                break
            mods.add(self.text(j))
            j += 1
            if lang == "rust" and self.text(j) == "(" and self.text(j - 1) == "pub":
                j = self.group(j)
            if lang == "rust" and self.kind(j) == STRING:
                j += 1
            k = self.annotation(j)
            if lang in ("java", "typescript") and k > j:
                j = k
        text = self.text(j)
        if self.kind(j) != IDENT and not (lang in ("java", "csharp") and text in ("<", "(")) and not (lang == "java" and text == "@"):
            return None
        if lang == "java" and text == "@" and self.text(j + 1) == "interface":
            return "type", j + 2, j + 3, True
        if text in _TYPES[lang] and (self.kind(j + 1) == IDENT or text == "impl" and self.text(j + 1) == "<" or lang == "ruby" and text == "class"):
            if text in ("record", "union") and self.kind(j + 1) != IDENT:
                return None
            name = j + 1
            if text == "impl":
                if self.text(name) == "<":
                    name = self.angles(name)
                k = name
                while 0 <= k < self.n and self.text(k) not in ("{", "for", "where", ";"):
                    k += 1
                if self.text(k) == "for":
                    name = k + 1
            if lang == "csharp" and text == "record" and self.text(name) in ("class", "struct"):
                name += 1
            k = name
            if k < 0:
                return None
            if lang not in ("python", "ruby"):
                while k < self.n and self.text(k) not in ("{", ";"):
                    k += 1
            elif self.kind(k) == IDENT:
                while self.text(k + 1) == "::":
                    k += 2
            return "type", name, min(k + 1, self.n), self.text(k) != ";"
        rule = getattr(self, f"f_{lang}")
        return rule(j, mods)

    def f_python(self, j, mods):
        if self.text(j) != "def" or self.kind(j + 1) != IDENT:
            return None
        k = j + 2
        if self.text(k) == "[":
            k = self.group(k)
        if self.text(k) == "(":
            k = self.group(k)
        while k < self.n and self.text(k) != ":" and self.line_of[k] == self.line_of[k - 1]:
            k = self.group(k) if self.text(k) in ("[", "(") else k + 1
        return "function", j + 1, min(k + 1, self.n), True

    def f_ruby(self, j, mods):
        if self.text(j) != "def":
            return None
        k = j + 1
        if self.text(k + 1) == "." and self.kind(k + 2) in (IDENT, "o"):
            k += 2
        if self.kind(k) not in (IDENT, "o"):
            return None
        end = k + 1
        if self.text(end) == "(":
            end = self.group(end)
        else:
            while end < self.n and self.line_of[end] == self.line_of[k]:
                end += 1
        return "function", k, end, True

    def f_go(self, j, mods):
        if self.contract:
            k = self.group(j + 1) if self.kind(j) == IDENT and self.text(j + 1) == "(" else -1
            while 0 < k < self.n and self.line_of[k] == self.line_of[k - 1]:
                k = self.group(k) if self.text(k) in ("(", "[") else k + 1
            return ("method", j, k, False) if k > 0 else None
        if self.text(j) == "type" and self.kind(j + 1) == IDENT:
            k = j + 2
            if self.text(k) == "[":
                k = self.group(k)
            if self.text(k) in ("struct", "interface"):
                return "type", j + 1, k + 2, True
            return None
        if self.text(j) != "func":
            return None
        k, kind = j + 1, "function"
        if self.text(k) == "(":
            k, kind = self.group(k), "method"
        if self.kind(k) != IDENT:
            return None
        name, k = k, k + 1
        if self.text(k) == "[":
            k = self.group(k)
        if self.text(k) != "(":
            return None
        k = self.group(k)
        line = self.line_of[k - 1]
        while k < self.n and self.text(k) != "{" and self.line_of[k] == line:
            k = self.group(k) if self.text(k) in ("(", "[") else k + 1
        return kind, name, min(k + 1, self.n), self.text(k) == "{"

    def f_rust(self, j, mods):
        if self.text(j) != "fn" or self.kind(j + 1) != IDENT:
            return None
        k = j + 2
        while k < self.n and self.text(k) not in ("{", ";"):
            k = self.group(k) if self.text(k) in ("(", "[") else k + 1
        return "function", j + 1, min(k + 1, self.n), self.text(k) == "{"

    def f_php(self, j, mods):
        if self.text(j) != "function":
            return None
        k = j + 1 + (self.text(j + 1) == "&")
        if self.kind(k) != IDENT or self.text(k)[:1] == "$":
            return None
        name = k
        if self.text(k + 1) == "(":
            k = self.group(k + 1)
        while k < self.n and self.text(k) not in ("{", ";"):
            k += 1
        return "function", name, min(k + 1, self.n), self.text(k) == "{"

    def f_javascript(self, j, mods):
        text = self.text(j)
        if text == "function":
            k = j + 1 + (self.text(j + 1) == "*")
            name = k if self.kind(k) == IDENT else -1
            k += name >= 0
            if self.text(k) == "<":
                k = self.angles(k)
            if k < 0 or self.text(k) != "(":
                return None
            return self.rest(name, self.group(k), "function")
        if text in ("const", "let", "var"):
            name = j + 1
            if self.kind(name) != IDENT:
                return None
            k = name + 1
            if self.text(k) == ":":
                while k < self.n and self.text(k) not in ("=", ";"):
                    k = self.group(k) if self.text(k) in ("(", "[", "{") else k + 1
            if self.text(k) != "=":
                return None
            k += 1
            if self.text(k) == "async":
                k += 1
            if self.text(k) == "function":
                while k < self.n and self.text(k) != "(":
                    k += 1
                return self.rest(name, self.group(k), "function")
            if self.text(k) == "<":
                k = self.angles(k)
                if k < 0:
                    return None
            if self.text(k) == "(":
                k = self.group(k)
                if self.text(k) == ":":
                    at = k
                    while at < self.n and self.text(at) not in ("=>", ";", "="):
                        at = self.group(at) if self.text(at) in ("(", "[", "{") else at + 1
                    k = at
            elif self.kind(k) == IDENT:
                k += 1
            return ("function", name, k + 1, True) if self.text(k) == "=>" else None
        if text in _NO_NAME or self.kind(j) != IDENT:
            return None
        k = j + 1
        if self.contract and self.text(k) == "?":
            k += 1
        if self.text(k) == "<":
            k = self.angles(k)
        if k < 0 or self.text(k) != "(":
            return None
        got = self.rest(j, self.group(k), "method")
        return got if got and (got[3] or "abstract" in mods or self.contract) else None

    f_typescript = f_javascript

    def rest(self, name, k, kind):
        """Behind the parameters: an optional return type and the body."""
        if self.text(k) == ":":
            k += 1
            while k < self.n and self.text(k) not in ("{", ";"):
                if self.text(k) in ("(", "["):
                    k = self.group(k)
                elif self.text(k) == "<":
                    at = self.angles(k)
                    k = at if at > 0 else k + 1
                else:
                    k += 1
            if self.text(k) == "{" and self.text(k - 1) in (":", "|", "&"):
                k = self.group(k)
        if self.text(k) == "{":
            return kind, name, k + 1, True
        return (kind, name, k, False) if kind == "function" and name >= 0 or kind == "method" else None

    def f_java(self, j, mods):
        k = j
        if self.text(k) == "<":
            k = self.angles(k)
            if k < 0:
                return None
        first = k
        k = self.type_ref(k)
        if k < 0:
            return None
        if self.text(k) == "(" and k == first + 1:
            name, ctor = first, True
        elif self.kind(k) == IDENT and self.text(k) not in _NO_NAME:
            name, ctor = k, False
            k += 1
            while self.lang == "csharp" and self.text(k) == "." and self.kind(k + 1) == IDENT:
                name, k = k + 1, k + 2
            if self.text(k) == "<":
                k = self.angles(k)
            if k < 0 or self.text(k) != "(":
                return None
        else:
            return None
        k = self.group(k)
        while k < self.n and self.text(k) not in ("{", ";", "=>", "=", "}"):
            text = self.text(k)
            if text not in ("throws", "where", ":", ",", ".", "<", ">", "[", "]", "default", "?", "@") and self.kind(k) not in (IDENT, "s", "n") and text != "(":
                return None
            if k and self.kind(k) == IDENT and text in _NO_NAME - {"default", "new", "base", "this", "where"}:
                return None
            k = self.group(k) if text == "(" else k + 1
        text = self.text(k)
        if text == "{" or text == "=>" and self.lang == "csharp":
            return "method", name, k + 1, True
        if text == ";" and not ctor and (self.contract or mods - {"new", "async"}):
            return "method", name, k + 1, False
        return None

    f_csharp = f_java


_STRING_PREFIX = re.compile(r"^[rbufRBUF]{0,2}(\"\"\"|'''|\"|')")


def declarations(src: str, lang: str, code: Code | None = None) -> list[Declaration]:
    """Every declaration of ``src`` that begins at the start of a line, in order. ``code`` are its tokens, if they are known."""
    if lang not in _MODS or not src:
        return []
    s = _Scan(src, lang, code)
    starts, coded, commented, remark, place = s.code.lines.starts, s.code.coded, s.code.commented, s.code.remark, s.code.place
    out: list[Declaration] = []
    depth = 0  # of round and square brackets
    stack: list[tuple[str, int, bool]] = []  # owners: (name, brace depth or indentation, is an interface)
    braces = 0
    outer: list[int] = []  # bracket depth around each open brace
    pending: tuple[str, bool] | None = None
    opens = -1
    i = 0
    done, heads = -1, _HEADS.get(lang)
    indented = lang in ("python", "ruby")
    skip = 0
    t, k_of, first = s.t, s.k, s.code.first
    for i in s.marks():
        if i < skip:
            continue
        text = t[i]
        if depth == 0 and i > done and first[i]:
            line = s.line_of[i]
            j = i
            while text in "@[#" and (k := s.annotation(j)) > j and k < s.n:
                for x in range(s.line_of[j], s.line_of[k - 1] + 1):
                    s.annotated[x] = 1
                j = k
            word = s.text(j)
            s.contract = bool(stack) and stack[-1][2] and stack[-1][1] == braces
            got = s.header(j) if (s.contract or word in heads if heads else word not in _STATEMENTS) else None
            if got:
                done = j  # behind annotations the header stands on a line of its own
                what, name, end, bodied = got
                begin = s.line_of[j]
                for x in range(line, begin):
                    s.annotated[x] = s.annotated[x] or commented[x]
                if indented:
                    column = s.offset(i) - starts[line - 1]
                    while stack and stack[-1][1] >= column:
                        stack.pop()
                else:
                    while stack and stack[-1][1] >= braces + 1:
                        stack.pop()
                owner = ".".join(x[0] for x in stack)
                top, texts = line, []
                while top > 1 and not coded[top - 1] and commented[top - 1] or top > 1 and s.annotated[top - 1] and coded[top - 1]:
                    top -= 1
                for x in range(top, s.line_of[j] + 1):
                    texts += [t for a, t in remark.get(x, ()) if a < place[j]]
                label = s.text(name) if name >= 0 else ""
                doc = None
                if lang == "python" and end < s.n and s.kind(end) == STRING and s.line_of[end] > s.line_of[end - 1]:
                    m = _STRING_PREFIX.match(s.text(end))
                    if m and "b" not in s.text(end)[: m.start(1)].lower() and "f" not in s.text(end)[: m.start(1)].lower():
                        doc = s.text(end)[m.end() : -len(m[1])]
                what2 = "method" if what == "function" and stack and lang in ("python", "ruby", "rust", "php") else what
                stop = s.offset(end - 1) + len(s.t[end - 1]) if end else s.offset(i)
                out.append(Declaration(what2, label, owner, s.line_of[name] if name >= 0 else begin, top, s.offset(j), stop, bodied, tuple(texts), doc))
                if what == "type" and bodied:
                    if indented:
                        stack.append((label, column, False))
                    else:
                        pending, opens = (label, "interface" in (s.text(name - 1), s.text(end - 1), s.text(end - 2)) or lang == "rust" and s.text(name - 1) == "trait"), end - 1
            if j > i and not got:
                skip = j
                continue
        if text in _BRACKETS and k_of[i] == "o":
            if text in ("(", "["):
                depth += 1
            elif text in (")", "]"):
                depth = max(0, depth - 1)
            elif text == "{":
                braces += 1
                if pending is not None and i >= opens:
                    stack.append((pending[0], braces, pending[1]))
                    pending = None
                outer.append(depth)
                depth = 0
            elif text == "}":
                while stack and not indented and stack[-1][1] >= braces:
                    stack.pop()
                braces = max(0, braces - 1)
                depth = outer.pop() if outer else 0
    return out


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)$")
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")


def markdown_headings(src: str) -> list[int]:
    """1-based lines on which a Markdown heading begins, code fences left out."""
    out, fence = [], ""
    lines = src.split("\n")
    paragraph = 0  # first line of the open paragraph
    front = bool(lines) and lines[0].strip() == "---" and any(x.strip() in ("---", "...") for x in lines[1:])
    comment = False
    for number, line in enumerate(lines, 1):
        if front:
            front = not (number > 1 and line.strip() in ("---", "..."))
            continue
        if comment:
            comment = "-->" not in line
            paragraph = 0
            continue
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            continue
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence, paragraph = m[1], 0
            continue
        if line.lstrip().startswith("<!--") and "-->" not in line:
            comment, paragraph = True, 0
            continue
        if not line.strip():
            paragraph = 0
        elif _ATX.match(line):
            out.append(number)
            paragraph = 0
        elif paragraph and _SETEXT.match(line):
            out.append(paragraph)
            paragraph = 0
        elif not paragraph and (line.startswith("    ") or line.startswith("\t")):
            continue
        elif not paragraph:
            if re.match(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?:\s|$)|\s{0,3}>|\s{0,3}\|", line):
                paragraph = -1
            else:
                paragraph = number
        if paragraph == -1 and not line.strip():
            paragraph = 0
    return sorted(x for x in out if x > 0)
