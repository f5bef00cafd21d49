"""Recursive-descent recognisers: does a text belong to a language's grammar?

Each class accepts the statement and declaration forms of its language; operator
precedence is left out because it doesn't decide membership. ``valid(text, lang)`` is the
entry. Python and JSON use the interpreter's own parsers, where these are deep enough.
"""

from __future__ import annotations

import ast
import io
import json
import re
import symtable
import sys
import tokenize
import warnings
from functools import lru_cache

from . import jsx
from .lexer import BAD, COMMENT, IDENT, NEWLINE, NUMBER, REGEX, STRING, Code, tokens


class Reject(Exception):
    """The text isn't in the language."""


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_CLOSING = frozenset((")", ";", ",", "]", "}"))
_BRACKETS = frozenset("()[]{}")


class Parser:
    lang = ""
    lines_matter = False  # a line end can end a statement
    reserved: frozenset[str] = frozenset()
    binary: frozenset[str] = frozenset()
    prefix: frozenset[str] = frozenset()

    def __init__(self, toks: list[tuple[str, str, int]] | Code):
        self.k: list[str] = []
        self.t: list[str] = []
        self.nl: list[bool] = []
        ready = self.prepare_code(toks) if isinstance(toks, Code) else None
        if ready is None:
            toks = self.prepare(toks.tuples() if isinstance(toks, Code) else toks)
        if ready is not None:
            self.k, self.t = ready
            self.nl = list(map(bool, toks.broken)) if self.lines_matter else [False] * len(self.t)
        elif self.lines_matter:
            line = False
            kinds, texts, breaks = self.k.append, self.t.append, self.nl.append
            for kind, text, _ in toks:
                if kind == NEWLINE:
                    line = True
                elif kind == COMMENT:
                    line = line or "\n" in text
                else:
                    kinds(kind)
                    texts(text)
                    breaks(line)
                    line = False
        else:
            code = [t for t in toks if t[0] != NEWLINE and t[0] != COMMENT]
            self.k = [t[0] for t in code]
            self.t = [t[1] for t in code]
            self.nl = [False] * len(code)
        if BAD in self.k:
            raise Reject
        self.k += ["e"] * 4
        self.t += [""] * 4
        self.nl += [True] * 4
        self.i = 0
        self.undo: list[tuple[int, str]] = []
        self.groups: dict[int, int] | None = None

    def prepare(self, toks):
        return toks

    def prepare_code(self, code: Code) -> tuple[list[str], list[str]] | None:
        """Kinds and texts without line ends and comments, as ``prepare`` has them; None where that needs the rows of ``tokens``."""
        return (list(code.k), list(code.t)) if type(self).prepare is Parser.prepare else None

    # -- token access
    @property
    def tok(self) -> str:
        return self.t[self.i]

    def fail(self):
        raise Reject  # often caught at once, so no message is made

    def isop(self, text: str) -> bool:
        return self.t[self.i] == text and self.k[self.i] == "o"

    def accept(self, *texts: str) -> bool:
        if self.t[self.i] in texts and self.k[self.i] in "oi":
            self.i += 1
            return True
        return False

    def expect(self, text: str):
        if self.t[self.i] != text or self.k[self.i] not in "oi":
            self.fail()
        self.i += 1

    def name(self):
        if self.k[self.i] != IDENT or self.t[self.i] in self.reserved:
            self.fail()
        self.i += 1

    def isname(self, at: int | None = None) -> bool:
        at = self.i if at is None else at
        return self.k[at] == IDENT and self.t[at] not in self.reserved

    def close_angle(self):
        text = self.t[self.i]
        if self.k[self.i] != "o" or text[:1] != ">":
            self.fail()
        if text == ">":
            self.i += 1
        else:
            self.undo.append((self.i, text))
            self.t[self.i] = text[1:]

    def mark(self) -> tuple[int, int]:
        return self.i, len(self.undo)

    def back(self, mark: tuple[int, int]):
        self.i = mark[0]
        while len(self.undo) > mark[1]:
            at, text = self.undo.pop()
            self.t[at] = text

    def behind(self) -> dict[int, int]:
        """Index behind the bracket group that opens at an index, of every group that closes; one pass over the text."""
        if self.groups is None:
            self.groups, open_at = {}, []
            for i in [i for i, text in enumerate(self.t) if text in _BRACKETS]:
                text = self.t[i]
                if self.k[i] == "o":
                    if text in ("(", "[", "{"):
                        open_at.append(i)
                    elif open_at and self.t[open_at[-1]] + text in ("()", "[]", "{}"):
                        self.groups[open_at.pop()] = i + 1
                    else:
                        open_at.clear()  # none of them closes in order
        return self.groups

    def skip_group(self):
        """Over a bracket group, whatever it holds, or over one token."""
        at = self.behind().get(self.i)
        if at is None:
            if self.k[self.i] == "e" or self.k[self.i] == "o" and self.t[self.i] in ("(", "[", "{", ")", "]", "}"):
                self.fail()
            at = self.i + 1
        self.i = at

    def after_group(self) -> int:
        """Index behind the bracket group at the current token."""
        at = self.i
        try:
            self.skip_group()
            return self.i
        finally:
            self.i = at

    def attempt(self, rule) -> bool:
        mark = self.mark()
        try:
            rule()
            return True
        except Reject:
            self.back(mark)
            return False

    def listed(self, close: str, item, empty: bool = True):
        """Comma-separated items up to ``close``, a trailing comma allowed."""
        t, k = self.t, self.k
        while not (t[self.i] == close and k[self.i] in "oi"):
            item()
            if t[self.i] != ",":
                self.expect(close)
                return
            self.i += 1
        self.i += 1

    # -- whole text
    def file(self):
        while self.k[self.i] != "e":
            self.stmt()

    def block(self):
        self.expect("{")
        while not self.accept("}"):
            if self.k[self.i] == "e":
                self.fail()
            self.stmt()

    def paren(self):
        self.expect("(")
        self.expr()
        self.expect(")")

    # -- expressions: operands and operators alternate
    def expr(self):
        self.assign()
        while self.t[self.i] == ",":
            self.i += 1
            self.assign()

    def assign(self):
        self.operand()
        while True:
            text = self.t[self.i]
            if text in _CLOSING:
                return
            kind = self.k[self.i]
            if kind in "oi" and text in self.binary and self.infix_ok():
                self.i += 1
                self.right(text)
            elif kind == "o" and text == "?" and self.ternary():
                self.i += 1
                self.assign()
                self.expect(":")
                self.assign()
            else:
                return

    def infix_ok(self) -> bool:
        return True

    def ternary(self) -> bool:
        return True

    def right(self, op: str):
        self.operand()

    def operand(self):
        t, i = self.t, self.i
        while t[i] in self.prefix and self.k[i] in "oi":
            i += 1
        self.i = i
        self.primary()
        while t[self.i] not in _CLOSING and self.postfix():
            pass

    def args(self):
        self.expect("(")
        self.listed(")", self.arg)

    def arg(self):
        self.assign()


# ------------------------------------------------------------------ JavaScript, TypeScript
_JS_RESERVED = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum"


class Js(Parser):
    lang, types, lines_matter = "javascript", False, True
    reserved = _words(_JS_RESERVED)
    binary = _words("+ - * / % ** == != === !== < > <= >= << >> >>> && || ?? & | ^ = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= in instanceof")
    prefix = _words("! ~ + - ++ -- typeof void delete await yield")
    no_in = False

    def infix_ok(self):
        return not (self.no_in and self.tok == "in")

    def end(self):
        if not self.accept(";") and not (self.nl[self.i] or self.isop("}") or self.k[self.i] == "e"):
            self.fail()

    def stmt(self):
        text, kind = self.tok, self.k[self.i]
        if kind == IDENT:
            rule = getattr(self, f"s_{text}", None)
            if rule and rule() is not False:
                return
            if self.isname() and self.t[self.i + 1] == ":" and text not in self.reserved:
                self.i += 2
                return self.stmt()
        elif kind == "o":
            if text == "{":
                return self.block()
            if text == ";":
                self.i += 1
                return None
            if text == "@":
                self.decorators()
                return self.stmt()
        self.expr()
        self.end()

    def decorators(self):
        while self.accept("@"):
            self.primary()
            while self.postfix():
                pass

    def s_if(self):
        self.i += 1
        self.paren()
        self.stmt()
        if self.accept("else"):
            self.stmt()

    def s_while(self):
        self.i += 1
        self.paren()
        self.stmt()

    s_with = s_while

    def s_do(self):
        self.i += 1
        self.stmt()
        self.expect("while")
        self.paren()
        self.accept(";")

    def s_for(self):
        self.i += 1
        self.accept("await")
        self.expect("(")
        if not self.isop(";"):
            if self.accept("var", "let", "const"):
                self.declarators(True)
            else:
                self.no_in = True
                try:
                    self.expr()
                finally:
                    self.no_in = False
            if self.accept("of", "in"):
                self.expr()
                self.expect(")")
                return self.stmt()
        self.expect(";")
        if not self.isop(";"):
            self.expr()
        self.expect(";")
        if not self.isop(")"):
            self.expr()
        self.expect(")")
        self.stmt()

    def s_return(self):
        self.i += 1
        if not (self.isop(";") or self.isop("}") or self.nl[self.i]):
            self.expr()
        self.end()

    def s_throw(self):
        self.i += 1
        self.expr()
        self.end()

    def s_break(self):
        self.i += 1
        if self.isname() and not self.nl[self.i]:
            self.i += 1
        self.end()

    s_continue = s_break

    def s_debugger(self):
        self.i += 1
        self.end()

    def s_try(self):
        self.i += 1
        self.block()
        caught = False
        if self.accept("catch"):
            caught = True
            if self.accept("("):
                self.binding()
                self.expect(")")
            self.block()
        if self.accept("finally"):
            caught = True
            self.block()
        if not caught:
            self.fail()

    def s_switch(self):
        self.i += 1
        self.paren()
        self.expect("{")
        while not self.accept("}"):
            if self.accept("case"):
                self.expr()
                self.expect(":")
            elif self.accept("default"):
                self.expect(":")
            else:
                self.stmt()

    def s_var(self):
        self.i += 1
        self.declarators(False)
        self.end()

    def s_const(self):
        if self.types and self.t[self.i + 1] == "enum":
            self.i += 1
            return self.s_enum()
        return self.s_var()

    def s_let(self):
        if self.k[self.i + 1] == IDENT or self.t[self.i + 1] in ("[", "{"):
            return self.s_var()
        return False

    def declarators(self, loop: bool):
        while True:
            self.binding()
            if self.accept("="):
                old, self.no_in = self.no_in, loop
                self.assign()
                self.no_in = old
            if not self.accept(","):
                return

    def binding(self):
        if self.isop("[") or self.isop("{"):
            self.skip_group()
        else:
            self.name()
            if self.types:
                self.accept("!", "?")
        self.annotation()

    def annotation(self):
        if self.types and self.accept(":"):
            self.type()

    def s_function(self):
        self.i += 1
        self.accept("*")
        if self.isname():
            self.i += 1
        self.signature()
        if self.types and not self.isop("{"):
            return self.end()
        self.block()

    def s_async(self):
        if self.t[self.i + 1] == "function" and not self.nl[self.i + 1]:
            self.i += 1
            return self.s_function()
        return False

    def signature(self):
        self.generics()
        self.expect("(")
        self.listed(")", self.param)
        if self.types and self.accept(":"):
            self.type()

    def generics(self):
        if self.types and self.isop("<"):
            self.type_args()

    def param(self):
        self.decorators()
        if self.types:
            while self.tok in ("public", "private", "protected", "readonly", "override") and (self.isname(self.i + 1) or self.t[self.i + 1] == "this"):
                self.i += 1
        self.accept("...")
        if self.types and self.tok == "this":
            self.i += 1
            return self.annotation()
        self.binding()
        if self.accept("="):
            self.assign()

    def s_class(self):
        self.i += 1
        if self.isname() and self.tok not in ("extends", "implements"):
            self.i += 1
        self.generics()
        if self.accept("extends"):
            self.operand()
            self.generics()
        if self.types and self.accept("implements"):
            self.type()
            while self.accept(","):
                self.type()
        self.expect("{")
        while not self.accept("}"):
            self.member()

    _MODIFIERS = _words("static async get set public private protected readonly abstract override declare accessor")
    _JS_MODIFIERS = _words("static async get set accessor")

    def member(self):
        if self.accept(";"):
            return
        self.decorators()
        mods = self._MODIFIERS if self.types else self._JS_MODIFIERS
        while self.tok in mods and self.k[self.i] == IDENT and self.t[self.i + 1] not in ("(", "=", ";", "}", ":", "?", "!", "<", ","):
            if self.tok == "static" and self.t[self.i + 1] == "{":
                self.i += 1
                return self.block()
            self.i += 1
        self.accept("*")
        if self.types and self.isop("[") and self.k[self.i + 1] == IDENT and self.t[self.i + 2] == ":":
            self.skip_group()
            self.annotation()
            return self.end()
        self.key()
        if self.types:
            self.accept("?", "!")
        if self.isop("(") or self.isop("<"):
            self.signature()
            if self.isop("{"):
                return self.block()
            if not self.types:
                self.fail()
            return self.end()
        self.annotation()
        if self.accept("="):
            self.assign()
        self.end()

    def key(self):
        if self.k[self.i] in (IDENT, STRING, NUMBER):
            self.i += 1
        elif self.accept("["):
            self.assign()
            self.expect("]")
        else:
            self.fail()

    def s_import(self):
        after = self.t[self.i + 1]
        if after in ("(", "."):
            return False
        self.i += 1
        if self.k[self.i] == STRING:
            self.i += 1
        else:
            if self.types and self.tok == "type" and self.t[self.i + 1] not in ("from", ",", "="):
                self.i += 1
            if self.isname():
                self.i += 1
                if self.types and self.accept("="):
                    self.expr()
                    return self.end()
                self.accept(",")
            if self.accept("*"):
                self.expect("as")
                self.name()
            elif self.isop("{"):
                self.specifiers()
            self.expect("from")
            if self.k[self.i] != STRING:
                self.fail()
            self.i += 1
        if self.tok in ("with", "assert") and self.t[self.i + 1] == "{":
            self.i += 1
            self.skip_group()
        self.end()
        return None

    def specifiers(self):
        self.expect("{")

        def item():
            if self.types and self.tok == "type" and self.t[self.i + 1] not in (",", "}", "as"):
                self.i += 1
            self.key()
            if self.accept("as"):
                self.key()

        self.listed("}", item)

    def s_export(self):
        self.i += 1
        if self.accept("default"):
            if self.tok in ("function", "class", "async", "abstract", "interface"):
                return self.stmt()
            self.assign()
            return self.end()
        if self.accept("*"):
            if self.accept("as"):
                self.key()
            self.expect("from")
            self.i += 1
            return self.end()
        if self.types and self.accept("="):
            self.expr()
            return self.end()
        if self.types and self.tok == "type" and self.t[self.i + 1] in ("{", "*"):
            self.i += 1
        if self.isop("{"):
            self.specifiers()
            if self.accept("from"):
                self.i += 1
            return self.end()
        if self.isop("@"):
            self.decorators()
        if self.tok not in ("var", "let", "const", "function", "class", "async") and not (self.types and self.tok in ("interface", "type", "enum", "namespace", "module", "declare", "abstract", "import")):
            self.fail()
        self.stmt()

    # -- expressions
    def arrow_body(self):
        if self.isop("{"):
            self.block()
        else:
            self.assign()

    def primary(self):
        kind, text = self.k[self.i], self.tok
        if kind in (NUMBER, STRING, REGEX):
            self.i += 1
        elif kind == IDENT:
            if text == "function":
                self.s_function()
            elif text == "class":
                self.s_class()
            elif text == "async" and not self.nl[self.i + 1] and (self.t[self.i + 1] == "function" or self.isname(self.i + 1) and self.t[self.i + 2] == "=>" or self.t[self.i + 1] == "("):
                self.i += 1
                self.primary()
            elif text == "new":
                self.i += 1
                if self.accept("."):
                    return self.name()
                self.primary()
                while self.isop(".") or self.isop("["):
                    self.postfix()
                if self.types and self.isop("<"):
                    self.attempt(self.type_args)
                if self.isop("("):
                    self.args()
            elif text in ("this", "null", "true", "false", "super") or text == "import" and self.t[self.i + 1] in ("(", "."):
                self.i += 1
            else:
                self.name()
                if self.isop("=>"):
                    self.i += 1
                    self.arrow_body()
        elif text == "(":
            at = self.after_group()
            if self.t[at] == "=>" or self.types and self.t[at] == ":" and self.attempt(self.typed_arrow):
                if self.t[at] == "=>":
                    self.signature()
                    self.expect("=>")
                    self.arrow_body()
                return
            self.i += 1
            self.expr()
            self.expect(")")
        elif text == "[":
            self.i += 1
            while not self.accept("]"):
                if self.accept(","):
                    continue
                self.accept("...")
                self.assign()
                if not self.isop("]"):
                    self.expect(",")
        elif text == "{":
            self.i += 1
            self.listed("}", self.property)
        elif text == "<" and self.types:
            if self.attempt(self.generic_arrow):
                return
            self.type_args()
            self.operand()
        else:
            self.fail()

    def typed_arrow(self):
        self.signature()
        self.expect("=>")
        self.arrow_body()

    generic_arrow = typed_arrow

    def property(self):
        if self.accept("..."):
            return self.assign()
        while self.tok in ("async", "get", "set") and self.t[self.i + 1] not in ("(", ":", ",", "}", "="):
            self.i += 1
        self.accept("*")
        short = self.isname()
        self.key()
        if self.isop("(") or self.isop("<"):
            self.signature()
            return self.block()
        if self.accept(":"):
            return self.assign()
        if not short:
            self.fail()
        if self.accept("="):
            self.assign()

    def arg(self):
        self.accept("...")
        self.assign()

    def postfix(self):
        text, kind = self.tok, self.k[self.i]
        if kind == "o":
            if text == "." or text == "?.":
                self.i += 1
                if text == "?." and (self.isop("(") or self.isop("[")):
                    return True
                if self.k[self.i] != IDENT:
                    self.fail()
                self.i += 1
                return True
            if text == "(":
                self.args()
                return True
            if text == "[":
                self.i += 1
                self.expr()
                self.expect("]")
                return True
            if text in ("++", "--") and not self.nl[self.i]:
                self.i += 1
                return True
            if self.types and text == "!" and not self.nl[self.i]:
                self.i += 1
                return True
            if self.types and text == "<":
                mark = self.mark()
                if self.attempt(self.type_args):
                    if self.isop("(") or self.k[self.i] == STRING:
                        return True
                    self.back(mark)
                return False
        elif kind == STRING and self.t[self.i][:1] == "`":
            self.i += 1
            return True
        elif self.types and kind == IDENT and text in ("as", "satisfies") and not self.nl[self.i]:
            self.i += 1
            if not self.accept("const"):
                self.type()
            return True
        return False

    # -- types
    def type_args(self):
        self.expect("<")
        while True:
            self.accept("const")
            self.type()
            if self.accept("="):
                self.type()
            if not self.accept(","):
                break
            if self.isop(">"):
                break
        self.close_angle()

    def type(self):
        if not self.accept("|"):
            self.accept("&")
        while True:
            self.type_one()
            if not self.accept("|", "&"):
                break
        if self.tok == "extends" and not self.nl[self.i]:
            self.i += 1
            self.type()
            if self.accept("?"):
                self.type()
                self.expect(":")
                self.type()

    def type_one(self):
        kind, text = self.k[self.i], self.tok
        while kind == IDENT and text in ("keyof", "readonly", "unique", "infer", "asserts", "abstract") and (self.k[self.i + 1] == IDENT or self.t[self.i + 1] in ("[", "(", "{")):
            self.i += 1
            kind, text = self.k[self.i], self.tok
        if text == "new":
            self.i += 1
            text = self.tok
        if kind in (STRING, NUMBER):
            self.i += 1
        elif text == "-":
            self.i += 2
        elif text in ("(", "<"):
            if text == "<":
                self.type_args()
            at = self.after_group()
            self.skip_group()
            if self.t[at] == "=>":
                self.i += 1
                self.type()
        elif text in ("{", "["):
            self.skip_group()
        elif text == "typeof":
            self.i += 1
            self.type_one()
        elif kind == IDENT and (text in ("void", "null", "this", "true", "false", "import") or text not in self.reserved):
            self.i += 1
            if text == "import":
                self.skip_group()
            while self.accept("."):
                self.i += 1
            if self.isop("<"):
                self.type_args()
            if self.tok == "is" and not self.nl[self.i]:
                self.i += 1
                self.type()
        else:
            self.fail()
        while self.isop("[") and not self.nl[self.i]:
            self.skip_group()


class Ts(Js):
    lang, types = "typescript", True

    def _named(self) -> bool:
        return self.k[self.i + 1] == IDENT and not self.nl[self.i + 1]

    def s_interface(self):
        if not self._named():
            return False
        self.i += 2
        self.generics()
        if self.accept("extends"):
            self.type()
            while self.accept(","):
                self.type()
        if not self.isop("{"):
            self.fail()
        self.skip_group()
        return None

    def s_type(self):
        if not self._named():
            return False
        self.i += 2
        self.generics()
        self.expect("=")
        self.type()
        self.end()
        return None

    def s_enum(self):
        self.i += 1
        self.name()
        if not self.isop("{"):
            self.fail()
        self.skip_group()

    def s_namespace(self):
        if self.k[self.i + 1] not in (IDENT, STRING) or self.nl[self.i + 1]:
            return False
        self.i += 2
        while self.accept("."):
            self.name()
        self.block()
        return None

    s_module = s_namespace

    def s_declare(self):
        if not self._named():
            return False
        self.i += 1
        if self.tok == "global":
            self.i += 1
            return self.block()
        return self.stmt()

    def s_abstract(self):
        if self.t[self.i + 1] != "class":
            return False
        self.i += 1
        return self.s_class()


# ------------------------------------------------------------------ Java, C#
class Managed(Parser):
    """What the Java and C# recognisers share."""

    modifiers: frozenset[str] = frozenset()
    primitive: frozenset[str] = frozenset()
    binary = _words("+ - * / % == != < > <= >= << >> >>> && || & | ^ = += -= *= /= %= <<= >>= >>>= &= |= ^= ?? ??=")
    prefix = _words("! ~ + - ++ --")

    def end(self):
        self.expect(";")

    def annotations(self):
        pass

    def type_args(self):
        self.expect("<")
        if self.accept(">"):
            return
        while True:
            if self.isop(",") or self.isop(">"):
                pass
            else:
                self.annotations()
                if not self.accept("in", "out") or True:
                    self.type()
            if not self.accept(","):
                break
        self.close_angle()

    def type_name(self):
        if self.tok in self.primitive and self.k[self.i] == IDENT:
            self.i += 1
            return
        self.name()
        if self.isop("<"):
            self.type_args()
        while self.tok in (".", "::") and self.k[self.i + 1] == IDENT:
            self.i += 1
            self.name()
            if self.isop("<"):
                self.type_args()

    def brackets(self):
        while self.isop("["):
            at = self.i + 1
            while self.t[at] == ",":
                at += 1
            if self.t[at] != "]":
                return
            self.i = at + 1

    def stmt(self):
        text, kind = self.tok, self.k[self.i]
        if kind == IDENT:
            rule = getattr(self, f"s_{text}", None)
            if rule and rule() is not False:
                return
            if self.isname() and self.t[self.i + 1] == ":" and self.t[self.i + 2] != ":":
                self.i += 2
                return self.stmt()
        elif text == "{" and kind == "o":
            return self.block()
        elif self.accept(";"):
            return None
        if self.local():
            return None
        self.expr_stmt()
        self.end()

    def expr_stmt(self):
        at = self.i
        self.assign()
        inner = self.t[at : self.i]
        if not ("(" in inner or any(x in inner for x in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "++", "--", "??=", "new", "await"))):
            self.fail()

    def local(self) -> bool:
        """A local declaration, if one begins here."""
        mark = self.mark()
        try:
            self.annotations()
            while self.tok in ("final", "const", "ref", "readonly", "scoped"):
                self.i += 1
            self.type()
            self.name()
            ok = self.tok in ("=", ";", ",", "[") and self.k[self.i] == "o"
        except Reject:
            ok = False
        if not ok:
            self.back(mark)
            return False
        self.declarators()
        self.end()
        return True

    def declarators(self):
        """Behind the first declared name."""
        while True:
            self.brackets()
            if self.accept("="):
                self.init()
            if not self.accept(","):
                return
            self.name()

    def init(self):
        if self.isop("{"):
            self.i += 1
            self.listed("}", self.init)
        else:
            self.accept("ref")
            self.assign()

    def s_if(self):
        self.i += 1
        self.paren()
        self.stmt()
        if self.accept("else"):
            self.stmt()

    def s_while(self):
        self.i += 1
        self.paren()
        self.stmt()

    def s_do(self):
        self.i += 1
        self.stmt()
        self.expect("while")
        self.paren()
        self.end()

    def s_return(self):
        self.i += 1
        if not self.isop(";"):
            self.accept("ref")
            self.assign()
        self.end()

    def s_throw(self):
        self.i += 1
        if not self.isop(";"):
            self.assign()
        self.end()

    def s_break(self):
        self.i += 1
        if self.isname():
            self.i += 1
        self.end()

    s_continue = s_break

    def for_rest(self):
        if not self.isop(";") and not self.local():
            self.expr()
            self.expect(";")
        elif self.t[self.i - 1] != ";":
            self.expect(";")
        if not self.isop(";"):
            self.expr()
        self.expect(";")
        if not self.isop(")"):
            self.expr()
        self.expect(")")
        self.stmt()

    def lambda_body(self):
        if self.isop("{"):
            self.block()
        else:
            self.assign()

    arrow = "->"

    def primary(self):
        kind, text = self.k[self.i], self.tok
        if kind in (NUMBER, STRING):
            self.i += 1
        elif kind == IDENT:
            if text in self.literals:
                self.i += 1
            elif text == "new":
                self.new()
            elif text in self.primitive:
                self.i += 1
                self.brackets()
            elif self.word():
                pass
            else:
                self.name()
                if self.isop(self.arrow):
                    self.i += 1
                    self.lambda_body()
                elif self.isop("<"):
                    mark = self.mark()
                    if not (self.attempt(self.type_args) and self.tok in ("(", ".", "::", "[")):
                        self.back(mark)
        elif text == "(":
            at = self.after_group()
            if self.t[at] == self.arrow:
                self.skip_group()
                self.i += 1
                return self.lambda_body()
            self.i += 1
            mark = self.mark()
            if self.attempt(self.cast) and self.operand_follows():
                return self.operand()
            self.back(mark)
            self.arg()
            while self.accept(","):
                self.arg()
            self.expect(")")
        else:
            self.other()
        return None

    def cast(self):
        self.type()
        while self.accept("&"):
            self.type()
        self.expect(")")

    def operand_follows(self) -> bool:
        kind, text = self.k[self.i], self.tok
        return kind in (NUMBER, STRING) or kind == "o" and text in ("(", "!", "~") or kind == IDENT and text not in ("instanceof", "is", "as", "in", "switch", "with")

    def other(self):
        self.fail()

    def word(self) -> bool:
        return False


class Java(Managed):
    lang = "java"
    reserved = _words("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null")
    primitive = _words("boolean byte short int long char float double void")
    literals = _words("true false null this super")
    modifiers = _words("public protected private static final abstract native synchronized transient volatile strictfp default sealed")
    prefix = _words("! ~ + - ++ --")

    def file(self):
        self.annotations()
        if self.accept("package"):
            self.dotted()
            self.end()
        while self.accept(";"):
            pass
        while self.accept("import"):
            self.accept("static")
            self.dotted()
            self.end()
        while self.k[self.i] != "e":
            if not self.accept(";"):
                self.type_decl()

    def dotted(self):
        self.name()
        while self.accept("."):
            if not self.accept("*"):
                self.name()

    def annotations(self):
        while self.isop("@") and self.t[self.i + 1] != "interface":
            self.i += 1
            self.dotted()
            if self.isop("("):
                self.skip_group()

    def mods(self):
        while True:
            self.annotations()
            if self.tok == "non" and self.t[self.i + 1] == "-":
                self.i += 3
            elif self.k[self.i] == IDENT and self.tok in self.modifiers and not (self.tok == "default" and self.t[self.i + 1] in (":", "->")):
                self.i += 1
            else:
                return

    def type(self):
        self.annotations()
        if self.accept("?"):
            if self.accept("extends", "super"):
                self.type()
            return
        self.type_name()
        self.brackets()
        if self.tok == "extends" and self.k[self.i] == IDENT and self.in_params:
            self.i += 1
            self.type()
            while self.accept("&"):
                self.type()

    in_params = False

    def type_params(self):
        if self.isop("<"):
            self.in_params = True
            self.type_args()
            self.in_params = False

    def types(self):
        self.type()
        while self.accept(","):
            self.type()

    def is_type_decl(self) -> bool:
        return self.tok in ("class", "interface", "enum") or self.isop("@") or self.tok == "record" and self.isname(self.i + 1) and self.t[self.i + 2] in ("(", "<")

    def type_decl(self):
        self.mods()
        if not self.is_type_decl():
            self.fail()
        self.accept("@")
        kind = self.tok
        self.i += 1
        self.name()
        self.type_params()
        if kind == "record":
            self.params()
        while self.accept("extends", "implements", "permits"):
            self.types()
        self.expect("{")
        if kind == "enum":
            while self.isname() or self.isop("@"):
                self.annotations()
                self.name()
                if self.isop("("):
                    self.args()
                if self.isop("{"):
                    self.body()
                if not self.accept(","):
                    break
            if not self.isop("}"):
                self.expect(";")
        while not self.accept("}"):
            self.member()

    def body(self):
        self.expect("{")
        while not self.accept("}"):
            self.member()

    def member(self):
        if self.accept(";"):
            return
        at = self.i
        self.mods()
        if self.isop("{"):
            return self.block()
        if self.is_type_decl():
            self.i = at
            return self.type_decl()
        self.type_params()
        if self.isname() and self.t[self.i + 1] in ("(", "{"):
            self.i += 1
        else:
            self.type()
            self.name()
        if self.isop("{"):
            return self.block()
        if self.isop("("):
            self.params()
            self.brackets()
            if self.accept("throws"):
                self.types()
            if self.accept("default"):
                self.init()
            if self.isop("{"):
                return self.block()
            return self.end()
        self.declarators()
        self.end()

    def params(self):
        self.expect("(")

        def item():
            self.mods()
            self.type()
            self.accept("...")
            if not self.accept("this"):
                self.name()
            self.brackets()

        if not self.accept(")"):
            item()
            while self.accept(","):
                item()
            self.expect(")")

    def stmt(self):
        at = self.i
        if self.tok in ("final", "abstract", "static", "class", "interface", "enum", "record") or self.isop("@"):
            self.mods()
            if self.is_type_decl():
                self.i = at
                return self.type_decl()
            self.i = at
        return super().stmt()

    def s_for(self):
        self.i += 1
        self.expect("(")

        def each():
            self.mods()
            self.type()
            self.name()
            self.expect(":")

        if self.attempt(each):
            self.assign()
            self.expect(")")
            return self.stmt()
        return self.for_rest()

    def s_try(self):
        self.i += 1
        ok = False
        if self.isop("("):
            ok = True
            self.skip_group()
        self.block()
        while self.accept("catch"):
            ok = True
            self.expect("(")
            self.mods()
            self.type()
            while self.accept("|"):
                self.type()
            self.name()
            self.expect(")")
            self.block()
        if self.accept("finally"):
            ok = True
            self.block()
        if not ok:
            self.fail()

    def s_switch(self):
        self.switch()

    def switch(self):
        self.i += 1
        self.paren()
        self.expect("{")
        while not self.accept("}"):
            if self.accept("case"):
                while True:
                    if not self.accept("default"):
                        if self.isname() and self.t[self.i + 1] in ("->", ":", ","):
                            self.i += 1
                        elif not self.attempt(self.pattern):
                            self.operand()
                            while self.tok in self.binary:
                                self.i += 1
                                self.operand()
                    if not self.accept(","):
                        break
                if self.tok == "when":
                    self.i += 1
                    self.assign()
                self.case_body()
            elif self.accept("default"):
                self.case_body()
            else:
                self.stmt()

    def case_body(self):
        if self.accept(":"):
            return
        self.expect("->")
        if self.isop("{"):
            self.block()
        elif self.tok == "throw":
            self.stmt()
        else:
            self.assign()
            self.end()

    def pattern(self):
        self.mods()
        self.type()
        if self.isop("("):
            self.skip_group()
        else:
            self.name()
        if self.tok not in (":", "->", "when", ","):
            self.fail()

    def s_synchronized(self):
        self.i += 1
        self.paren()
        self.block()

    def s_assert(self):
        self.i += 1
        self.assign()
        if self.accept(":"):
            self.assign()
        self.end()

    def s_yield(self):
        if self.t[self.i + 1] in ("=", ".", "("):
            return False
        self.i += 1
        self.assign()
        return self.end()

    def word(self):
        if self.tok == "switch":
            self.switch()
            return True
        return False

    def new(self):
        self.i += 1
        self.annotations()
        self.type_name()
        if self.isop("["):
            while self.accept("["):
                if not self.accept("]"):
                    self.assign()
                    self.expect("]")
            if self.isop("{"):
                self.init()
        else:
            self.args()
            if self.isop("{"):
                self.body()

    def postfix(self):
        text, kind = self.tok, self.k[self.i]
        if kind == IDENT and text == "instanceof":
            self.i += 1
            self.mods()
            self.type()
            if self.isname():
                self.i += 1
            elif self.isop("("):
                self.skip_group()
            return True
        if kind != "o":
            return False
        if text == ".":
            self.i += 1
            if self.isop("<"):
                self.type_args()
            if self.tok == "new":
                self.new()
            elif self.tok in ("class", "this", "super"):
                self.i += 1
            else:
                self.name()
            return True
        if text == "(":
            self.args()
            return True
        if text == "[":
            self.i += 1
            if not self.accept("]"):
                self.assign()
                self.expect("]")
            return True
        if text in ("++", "--"):
            self.i += 1
            return True
        if text == "::":
            self.i += 1
            if not self.accept("new"):
                self.name()
            return True
        return False


class CSharp(Managed):
    lang = "csharp"
    arrow = "=>"
    reserved = _words("abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while")
    primitive = _words("bool byte sbyte char decimal double float int uint long ulong short ushort object string void")
    literals = _words("true false null this base")
    modifiers = _words("public protected private internal static readonly sealed abstract virtual override async extern unsafe volatile partial new const required file ref")
    prefix = _words("! ~ + - ++ -- & * await ref ^ throw")

    def file(self):
        while self.k[self.i] != "e":
            self.top()

    def attributes(self):
        while self.isop("[") and (self.k[self.i + 1] == IDENT):
            self.skip_group()

    annotations = attributes

    def dotted(self):
        self.type_name()

    def top(self):
        if self.accept(";"):
            return
        if self.tok == "extern" and self.t[self.i + 1] == "alias":
            self.i += 3
            return self.end()
        if self.tok in ("using", "global") and self.t[self.i + 1] != "(" and not (self.tok == "using" and self.t[self.i + 1] == "var"):
            self.accept("global")
            self.expect("using")
            self.accept("static")
            if self.isname() and self.t[self.i + 1] == "=":
                self.i += 2
                self.type()
            else:
                self.dotted()
            return self.end()
        if self.accept("namespace"):
            self.dotted()
            if self.accept(";"):
                return None
            self.expect("{")
            while not self.accept("}"):
                if self.k[self.i] == "e":
                    self.fail()
                self.top()
            return None
        at = self.i
        self.attributes()
        self.mods()
        if self.is_type_decl():
            self.i = at
            return self.type_decl()
        self.i = at
        return self.stmt()

    def mods(self):
        while self.k[self.i] == IDENT and self.tok in self.modifiers and not (self.tok in ("partial", "required", "file", "async") and self.t[self.i + 1] in ("(", "=", ";", ".", ",", ")")):
            self.i += 1

    def is_type_decl(self):
        return self.tok in ("class", "interface", "enum", "struct", "delegate") or self.tok == "record" and self.k[self.i + 1] == IDENT

    def type_decl(self):
        self.attributes()
        self.mods()
        kind = self.tok
        self.i += 1
        if kind == "delegate":
            self.type()
            self.name()
            if self.isop("<"):
                self.type_args()
            self.params()
            self.constraints()
            return self.end()
        if kind == "record":
            self.accept("class", "struct")
        self.name()
        if self.isop("<"):
            self.type_args()
        if self.isop("("):
            self.params()
        if self.accept(":"):
            self.type()
            if self.isop("("):
                self.args()
            while self.accept(","):
                self.type()
        self.constraints()
        if self.accept(";"):
            return None
        if kind == "enum":
            if not self.isop("{"):
                self.fail()
            self.skip_group()
        else:
            self.expect("{")
            while not self.accept("}"):
                self.member()
        self.accept(";")

    def constraints(self):
        while self.tok == "where":
            self.i += 1
            self.name()
            self.expect(":")
            while True:
                if self.accept("new"):
                    self.skip_group()
                elif not self.accept("class", "struct"):
                    self.type()
                self.accept("?")
                if not self.accept(","):
                    break

    def type(self):
        self.accept("ref")
        if self.isop("("):
            self.i += 1
            while True:
                self.type()
                if self.isname():
                    self.i += 1
                if not self.accept(","):
                    break
            self.expect(")")
        else:
            self.type_name()
        while True:
            if self.isop("["):
                at = self.i
                self.brackets()
                if self.i == at:
                    return
            elif not self.accept("?", "*"):
                return

    def params(self, close: str = ")"):
        self.i += 1

        def item():
            self.attributes()
            while self.accept("ref", "out", "in", "params", "this", "scoped", "readonly"):
                pass
            self.type()
            self.name()
            if self.accept("="):
                self.assign()

        if not self.accept(close):
            item()
            while self.accept(","):
                item()
            self.expect(close)

    def member(self):
        if self.k[self.i] == "e":
            self.fail()
        if self.accept(";"):
            return None
        at = self.i
        self.attributes()
        self.mods()
        if self.is_type_decl():
            self.i = at
            return self.type_decl()
        if self.accept("~"):
            self.name()
            self.skip_group()
            return self.block()
        self.accept("event")
        if self.tok in ("implicit", "explicit"):
            self.i += 1
            self.expect("operator")
            self.type()
            return self.method()
        if self.isname() and self.t[self.i + 1] == "(":
            self.i += 1
            self.params()
            if self.accept(":"):
                if not self.accept("base", "this"):
                    self.fail()
                self.args()
            return self.method_body()
        self.type()
        if self.accept("operator"):
            self.i += 1
            return self.method()
        if self.accept("this"):
            self.params("]")
            return self.accessors()
        self.type_name()
        if self.accept("this"):
            self.params("]")
            return self.accessors()
        if self.isop("("):
            return self.method()
        if self.isop("{") or self.isop("=>"):
            return self.accessors()
        self.declarators()
        return self.end()

    def method(self):
        if not self.isop("("):
            self.fail()
        self.params()
        self.constraints()
        self.method_body()

    def method_body(self):
        if self.isop("{"):
            self.block()
        else:
            if self.accept("=>"):
                self.assign()
            self.end()

    def accessors(self):
        if self.accept("=>"):
            self.assign()
            return self.end()
        self.expect("{")
        while not self.accept("}"):
            self.attributes()
            self.mods()
            if not self.accept("get", "set", "init", "add", "remove"):
                self.fail()
            self.method_body()
        if self.accept("="):
            self.init()
            self.end()
        return None

    def stmt(self):
        at = self.i
        self.attributes()
        if self.tok in ("static", "async", "unsafe", "extern", "const") or self.i != at:
            pass
        if self.attempt(self.local_function):
            return None
        if self.tok == "using":
            self.i += 1
            if self.isop("("):
                self.skip_group()
                return self.stmt()
            return self.stmt()
        if self.tok == "await" and self.t[self.i + 1] in ("foreach", "using"):
            self.i += 1
        return super().stmt()

    def local_function(self):
        while self.tok in ("static", "async", "unsafe", "extern"):
            self.i += 1
        if self.tok in ("return", "new", "await", "throw", "else"):
            self.fail()
        self.type()
        self.name()
        if self.isop("<"):
            self.type_args()
        if not self.isop("("):
            self.fail()
        self.params()
        self.constraints()
        if not (self.isop("{") or self.isop("=>")):
            self.fail()
        self.method_body()

    def s_for(self):
        self.i += 1
        self.expect("(")
        return self.for_rest()

    def s_foreach(self):
        self.i += 1
        self.expect("(")
        if self.tok == "var" and self.t[self.i + 1] == "(":
            self.i += 1
            self.skip_group()
        else:
            self.type()
            self.name()
        self.expect("in")
        self.assign()
        self.expect(")")
        self.stmt()

    def s_try(self):
        self.i += 1
        self.block()
        ok = False
        while self.accept("catch"):
            ok = True
            if self.accept("("):
                self.type()
                if self.isname():
                    self.i += 1
                self.expect(")")
            if self.tok == "when":
                self.i += 1
                self.paren()
            self.block()
        if self.accept("finally"):
            ok = True
            self.block()
        if not ok:
            self.fail()

    def s_switch(self):
        self.i += 1
        self.paren()
        self.expect("{")
        while not self.accept("}"):
            if self.accept("case"):
                self.pattern()
                self.expect(":")
            elif self.tok == "default" and self.t[self.i + 1] == ":":
                self.i += 2
            else:
                self.stmt()

    def pattern(self):
        depth = 0
        while True:
            text = self.tok if self.k[self.i] == "o" else ""
            if self.k[self.i] == "e":
                self.fail()
            if not depth and text in (":", "=>", ",", "}", ";"):
                return
            if text in ("(", "[", "{"):
                self.skip_group()
                continue
            self.i += 1

    def s_lock(self):
        self.i += 1
        self.paren()
        self.stmt()

    s_fixed = s_lock

    def s_checked(self):
        if self.t[self.i + 1] != "{":
            return False
        self.i += 1
        return self.block()

    s_unchecked = s_unsafe = s_checked

    def s_yield(self):
        if self.t[self.i + 1] not in ("return", "break"):
            return False
        self.i += 1
        if self.accept("break"):
            return self.end()
        self.i += 1
        self.assign()
        return self.end()

    def s_goto(self):
        self.i += 1
        while not self.accept(";"):
            if self.k[self.i] == "e":
                self.fail()
            self.i += 1

    def word(self):
        text = self.tok
        if text in ("typeof", "sizeof", "default", "checked", "unchecked", "nameof") and self.t[self.i + 1] == "(":
            self.i += 1
            self.skip_group()
        elif text == "default":
            self.i += 1
        elif text == "stackalloc":
            self.i += 1
            self.type_name()
            self.skip_group()
        elif text == "delegate":
            self.i += 1
            if self.isop("("):
                self.skip_group()
            self.block()
        elif text in ("async", "static") and (self.isname(self.i + 1) and self.t[self.i + 2] == "=>" or self.t[self.i + 1] == "(") and text not in self.primitive:
            self.i += 1
            self.primary()
        elif text == "from" and self.isname(self.i + 1) and self.t[self.i + 2] == "in":
            while not (self.k[self.i] == "e" or self.k[self.i] == "o" and self.tok in (";", ")", ",", "]", "}")):
                if self.k[self.i] == "o" and self.tok in ("(", "[", "{"):
                    self.skip_group()
                else:
                    self.i += 1
        else:
            return False
        return True

    def new(self):
        self.i += 1
        if self.isop("{"):
            return self.skip_group()
        if not self.isop("(") and not self.isop("["):
            self.type_name()
            self.accept("?")
        if self.isop("["):
            while self.isop("["):
                self.skip_group()
            if self.isop("{"):
                self.skip_group()
            return None
        if self.isop("("):
            self.args()
            if self.isop("{"):
                self.skip_group()
        elif self.isop("{"):
            self.skip_group()
        else:
            self.fail()
        return None

    def other(self):
        if self.isop("["):
            self.i += 1
            self.listed("]", self.arg)
        elif self.isop(".."):
            self.i += 1
            if not self.isop("]"):
                self.operand()
        else:
            self.fail()

    def arg(self):
        if self.isname() and self.t[self.i + 1] == ":":
            self.i += 2
        if self.accept("ref", "out", "in"):
            if self.tok == "var" or self.isname(self.i + 1):
                self.type()
                return self.name()
        self.accept("..")
        self.assign()

    def postfix(self):
        text, kind = self.tok, self.k[self.i]
        if kind == IDENT:
            if text in ("is", "as"):
                self.i += 1
                if text == "as":
                    self.type()
                    return True
                self.accept("not")
                if self.isop("{") or self.isop("("):
                    self.skip_group()
                elif self.k[self.i] in (NUMBER, STRING) or self.tok in ("null", "true", "false") or self.k[self.i] == "o":
                    if self.k[self.i] == "o":
                        self.i += 1
                    self.i += 1
                else:
                    self.type_name()
                    if self.isop("{"):
                        self.skip_group()
                while self.accept("or", "and"):
                    self.accept("not")
                    self.operand()
                if self.isname() and self.tok not in ("when", "and", "or"):
                    self.i += 1
                return True
            if text == "switch" and self.t[self.i + 1] == "{":
                self.i += 2
                while not self.accept("}"):
                    self.pattern()
                    self.expect("=>")
                    self.assign()
                    if not self.accept(","):
                        self.expect("}")
                        break
                return True
            if text == "with" and self.t[self.i + 1] == "{":
                self.i += 1
                self.skip_group()
                return True
            return False
        if kind != "o":
            return False
        if text in (".", "?.", "->", "::"):
            self.i += 1
            self.name()
            if self.isop("<"):
                mark = self.mark()
                if not (self.attempt(self.type_args) and self.tok in ("(", ".", ";", ")", ",")):
                    self.back(mark)
            return True
        if text == "(":
            self.args()
            return True
        if text == "[" or text == "?" and self.t[self.i + 1] == "[":
            self.accept("?")
            self.i += 1
            self.listed("]", self.arg)
            return True
        if text in ("++", "--"):
            self.i += 1
            return True
        if text == "!" and self.t[self.i + 1] in (".", ";", ")", ",", "[", "}"):
            self.i += 1
            return True
        if text == "..":
            self.i += 1
            if not (self.isop("]") or self.isop(")") or self.isop(",")):
                self.operand()
            return True
        return False


# ------------------------------------------------------------------ entry
def _python(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            symtable.symtable(text, "", "exec")  # the interpreter's own parser, without a tree of objects
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass  # errors of scopes are no errors of syntax
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError):
            return False
        except (RecursionError, MemoryError):
            return _python_tokens(text)


def _python_tokens(text: str) -> bool:
    """For what is nested too deep for the interpreter's parser: tokens, indentation and brackets."""
    toks = tokens(text, "python")
    if any(t[0] == BAD for t in toks) or not balanced(toks):
        return False
    try:
        for _ in tokenize.generate_tokens(io.StringIO(text).readline):
            pass
    except (tokenize.TokenError, SyntaxError):
        return False
    return True


def balanced(toks: list[tuple[str, str, int]]) -> bool:
    """Whether the brackets of a text close in order; a stack of its own, so of any depth."""
    stack = []
    for kind, text, _ in toks:
        if kind == "o":
            if text in "([{":
                stack.append(text)
            elif text in ")]}" and (not stack or stack.pop() + text not in ("()", "[]", "{}")):
                return False
    return not stack


def _no_constant(name: str):
    raise ValueError(name)


_JSON = re.compile(r'[ \t\n\r]*(?:(?P<s>"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(?P<v>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)|(?P<o>[{}\[\],:])|(?P<e>\Z))')


def _json(text: str) -> bool:
    try:
        json.loads(text.removeprefix("\ufeff"), parse_constant=_no_constant)
        return True
    except ValueError:
        return False
    except RecursionError:
        return _json_deep(text.removeprefix("\ufeff"))


def _json_deep(text: str) -> bool:
    """JSON of any depth: a stack of open brackets and what may come next."""
    stack: list[str] = []
    want, at = "value", 0  # value, first (value or ]), key, firstkey (key or }), colon, next
    while True:
        m = _JSON.match(text, at)
        if not m:
            return False
        at, kind, sign = m.end(), m.lastgroup, m["o"]
        if kind == "e":
            return want == "next" and not stack
        if want in ("value", "first"):
            if kind in ("s", "v"):
                want = "next"
            elif sign == "[":
                stack.append("]")
                want = "first"
            elif sign == "{":
                stack.append("}")
                want = "firstkey"
            elif sign == "]" and want == "first":
                stack.pop()
                want = "next"
            else:
                return False
        elif want in ("key", "firstkey"):
            if kind == "s":
                want = "colon"
            elif sign == "}" and want == "firstkey":
                stack.pop()
                want = "next"
            else:
                return False
        elif want == "colon":
            if sign != ":":
                return False
            want = "value"
        elif sign == "," and stack:
            want = "value" if stack[-1] == "]" else "key"
        elif stack and sign == stack[-1]:
            stack.pop()
        else:
            return False


@lru_cache(maxsize=1)
def _parsers() -> dict[str, type[Parser]]:
    from .grammar_more import Go, Php, Ruby, Rust

    return {"javascript": Js, "typescript": Ts, "java": Java, "csharp": CSharp, "go": Go, "rust": Rust, "php": Php, "ruby": Ruby}


def valid(text: str, lang: str, toks: list[tuple[str, str, int]] | None = None) -> bool:
    """Whether ``text`` is syntactically valid in ``lang`` (one of lexer.CODE_LANGUAGES or json). ``toks`` are its tokens, if they are known.

    An empty text is valid in every language but JSON and Go. Depth is no limit: a text nested deeper
    than the usual stack is checked for balanced brackets first and then parsed with a stack as deep as it needs.
    JavaScript and TypeScript may hold JSX.
    """
    if valid_plain(text, lang, toks):
        return True
    if lang in ("javascript", "typescript"):
        other = jsx.plain(text)
        return other is not None and _accepts(tokens(other, lang), lang)
    return False


def valid_plain(text: str, lang: str, toks: list[tuple[str, str, int]] | Code | None = None) -> bool:
    """As ``valid``, without JSX."""
    if lang == "python":
        return _python(text)
    if lang == "json":
        return _json(text)
    if lang == "php" and text.strip() and "<?" not in text:
        return False
    return _accepts(tokens(text, lang) if toks is None else toks, lang)


def _accepts(toks: list[tuple[str, str, int]] | Code, lang: str) -> bool:
    usual = max(6000, sys.getrecursionlimit())
    sys.setrecursionlimit(usual)
    try:
        return _parses(toks, lang)
    except RecursionError:
        toks = toks.tuples() if isinstance(toks, Code) else toks
        if not balanced(toks):
            return False
        # calls between Python functions take no space of the native stack
        sys.setrecursionlimit(usual + 40 * len(toks))
        try:
            return _parses(toks, lang)
        finally:
            sys.setrecursionlimit(usual)


def _parses(toks: list[tuple[str, str, int]] | Code, lang: str) -> bool:
    try:
        parser = _parsers()[lang](toks)
        parser.file()
        return parser.k[parser.i] == "e"
    except Reject:
        return False
