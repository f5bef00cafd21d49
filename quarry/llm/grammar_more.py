"""Recognisers for Go, Rust, PHP and Ruby; see grammar.py."""

from __future__ import annotations

from itertools import pairwise

from .grammar import Js, Parser, Reject, _words
from .lexer import IDENT, NEWLINE, NUMBER, OP, REGEX, STRING


class Go(Parser):
    lang = "go"
    reserved = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
    binary = _words("+ - * / % & | ^ << >> && || == != < <= > >=")
    prefix = _words("+ - ! ^ * & <-")
    assigns = _words("= := += -= *= /= %= &= |= ^= <<= >>=")
    literal_ok = True

    def prepare(self, toks):
        """Newlines end a statement behind an operand, as the language says."""
        out, last = [], ("", "", 0)
        merged = []
        for tok in toks:
            if merged and tok[0] == OP and merged[-1][0] == OP and merged[-1][1] == "&" and tok[1] == "^" and merged[-1][2] + 1 == tok[2]:
                merged[-1] = (OP, "&", tok[2])
                continue
            merged.append(tok)
        for tok in [*merged, (NEWLINE, "\n", 0)]:
            if tok[0] == NEWLINE or tok[0] == "c" and "\n" in tok[1]:
                kind, text = last[0], last[1]
                if kind in (NUMBER, STRING) or kind == IDENT and text not in self.reserved | {""} or text in ("break", "continue", "fallthrough", "return") or kind == OP and text in ("++", "--", ")", "]", "}"):
                    out.append((OP, ";", tok[2]))
                    last = ("", "", 0)
                out.append(tok)
                continue
            if tok[0] != "c":
                last = tok
            out.append(tok)
        return out

    def prepare_code(self, code):
        k, t = code.k, code.t
        if "^" in t and any(a == "&" and b == "^" for a, b in pairwise(t)):
            return None
        kinds, texts, at, n = [], [], 0, len(t)
        for i in [i for i in range(1, n) if code.broken[i]] + [n] * bool(n):
            kind, text = k[i - 1], t[i - 1]
            if kind in (NUMBER, STRING) or kind == IDENT and text not in self.reserved or text in ("break", "continue", "fallthrough", "return") or kind == OP and text in ("++", "--", ")", "]", "}"):
                kinds += [*k[at:i], OP]
                texts += [*t[at:i], ";"]
                at = i
        return kinds + list(k[at:]), texts + t[at:]

    def end(self):
        if not self.accept(";") and not self.isop("}") and not self.isop(")") and self.k[self.i] != "e":
            self.fail()

    def file(self):
        self.expect("package")
        self.name()
        self.end()
        while self.accept("import"):
            self.grouped(self.import_spec)
        while self.k[self.i] != "e":
            if self.accept(";"):
                continue
            if self.tok == "func":
                self.i += 1
                if self.isop("("):
                    self.params()
                self.name()
                if self.isop("["):
                    self.skip_group()
                self.signature()
                if self.isop("{"):
                    self.block()
                self.end()
            elif not self.declaration():
                self.fail()

    def import_spec(self):
        if self.isname() or self.isop("."):
            self.i += 1
        if self.k[self.i] != STRING:
            self.fail()
        self.i += 1

    def grouped(self, item):
        if self.accept("("):
            while not self.accept(")"):
                item()
                if not self.isop(")"):
                    self.expect(";")
        else:
            item()
        self.end()

    def declaration(self) -> bool:
        if self.accept("var", "const"):
            self.grouped(self.var_spec)
        elif self.accept("type"):
            self.grouped(self.type_spec)
        else:
            return False
        return True

    def var_spec(self):
        self.name()
        while self.accept(","):
            self.name()
        if not (self.isop("=") or self.isop(";") or self.isop(")")):
            self.type()
        if self.accept("="):
            self.exprs()

    def type_spec(self):
        self.name()
        if self.isop("[") and self.k[self.i + 1] == IDENT and self.t[self.i + 2] != "]":
            self.skip_group()
        self.accept("=")
        self.type()

    def type(self):
        if self.accept("*", "...", "<-", "~"):
            return self.type()
        if self.isop("["):
            self.skip_group()
            return self.type()
        if self.accept("("):
            self.type()
            return self.expect(")")
        if self.accept("map"):
            self.expect("[")
            self.type()
            self.expect("]")
            return self.type()
        if self.accept("chan"):
            self.accept("<-")
            return self.type()
        if self.accept("func"):
            return self.signature()
        if self.accept("struct"):
            self.expect("{")
            while not self.accept("}"):
                self.field()
            return None
        if self.accept("interface"):
            if not self.isop("{"):
                self.fail()
            return self.skip_group()
        self.name()
        if self.accept("."):
            self.name()
        if self.isop("[") and self.t[self.i + 1] != "]":
            self.skip_group()
        return None

    def field(self):
        if self.accept("*"):
            self.type()
        else:
            self.name()
            if self.accept("."):
                self.name()
            else:
                while self.accept(","):
                    self.name()
                if not (self.isop(";") or self.isop("}") or self.k[self.i] == STRING):
                    self.type()
        if self.k[self.i] == STRING:
            self.i += 1
        if not self.isop("}"):
            self.expect(";")

    def params(self):
        self.expect("(")

        def item():
            self.type()
            if not (self.isop(",") or self.isop(")")):
                self.type()

        self.listed(")", item)

    def signature(self):
        self.params()
        if self.isop("("):
            self.params()
        elif not (self.k[self.i] == "e" or self.k[self.i] == "o" and self.tok in ("{", ";", ")", ",", "}", "]", ":", "=", ":=") or self.k[self.i] == STRING):
            self.type()

    def exprs(self):
        self.assign()
        while self.accept(","):
            self.assign()

    def simple(self):
        if self.accept("range"):
            return self.assign()
        self.exprs()
        if self.tok in self.assigns and self.k[self.i] == "o":
            self.i += 1
            if self.accept("range"):
                return self.assign()
            return self.exprs()
        if self.accept("<-"):
            return self.assign()
        self.accept("++", "--")
        return None

    def header(self):
        """Clauses before a block, in which a brace opens the block."""
        old, self.literal_ok = self.literal_ok, False
        while not self.isop("{"):
            if self.accept(";"):
                continue
            self.simple()
            if not self.isop("{"):
                self.expect(";")
        self.literal_ok = old

    def block(self):
        old, self.literal_ok = self.literal_ok, True
        self.expect("{")
        while not self.accept("}"):
            if self.k[self.i] == "e":
                self.fail()
            self.stmt()
        self.literal_ok = old

    def stmt(self):
        text, kind = self.tok, self.k[self.i]
        if self.accept(";"):
            return None
        if kind == IDENT:
            if text in ("var", "const", "type"):
                self.declaration()
                return None
            if self.accept("if"):
                if self.isop("{"):
                    self.fail()
                self.header()
                self.block()
                if self.accept("else"):
                    if self.tok == "if":
                        return self.stmt()
                    self.block()
                return self.end()
            if self.accept("for"):
                self.header()
                self.block()
                return self.end()
            if self.accept("switch", "select"):
                old, self.literal_ok = self.literal_ok, False
                while not self.isop("{"):
                    if self.accept(";"):
                        continue
                    self.simple()
                    if not self.isop("{"):
                        self.expect(";")
                self.literal_ok = True
                self.expect("{")
                while not self.accept("}"):
                    if self.accept("case"):
                        if text == "select":
                            self.simple()
                        else:
                            self.case_items()
                        self.expect(":")
                    elif self.accept("default"):
                        self.expect(":")
                    elif self.k[self.i] == "e":
                        self.fail()
                    else:
                        self.stmt()
                self.literal_ok = old
                return self.end()
            if self.accept("return"):
                if not (self.isop(";") or self.isop("}")):
                    self.exprs()
                return self.end()
            if self.accept("defer", "go"):
                self.assign()
                return self.end()
            if self.accept("break", "continue", "goto", "fallthrough"):
                if self.isname():
                    self.i += 1
                return self.end()
            if self.isname() and self.t[self.i + 1] == ":":
                self.i += 2
                return self.stmt()
        elif text == "{":
            self.block()
            return self.end()
        self.simple()
        return self.end()

    def case_items(self):
        while True:
            if not self.attempt(self.case_expr):
                self.type()
            if not self.accept(","):
                return

    def case_expr(self):
        self.assign()
        if self.tok not in (",", ":"):
            self.fail()

    def primary(self):
        kind, text = self.k[self.i], self.tok
        if kind in (NUMBER, STRING):
            self.i += 1
        elif text == "func" and kind == IDENT:
            self.i += 1
            self.signature()
            self.block()
        elif kind == "o" and text == "(":
            self.i += 1
            old, self.literal_ok = self.literal_ok, True
            if not self.attempt(lambda: (self.assign(), self.expect(")"))):
                self.type()
                self.expect(")")
            self.literal_ok = old
        elif kind == "o" and text == "[" or text in ("map", "struct", "chan", "interface"):
            self.type()
            if self.isop("{"):
                self.literal()
            elif not self.isop("(") and self.t[self.i] not in (",", ")"):
                self.fail()
        elif kind == IDENT:
            self.name()
            if self.isop(".") and self.k[self.i + 1] == IDENT and self.t[self.i + 2] == "{" and self.literal_ok:
                self.i += 2
            if self.isop("{") and self.literal_ok:
                self.literal()
        else:
            self.fail()

    def literal(self):
        self.expect("{")

        def item():
            if self.isop("{"):
                self.literal()
            else:
                self.assign()
            if self.accept(":"):
                if self.isop("{"):
                    self.literal()
                else:
                    self.assign()

        old, self.literal_ok = self.literal_ok, True
        self.listed("}", item)
        self.literal_ok = old

    def ternary(self):
        return False

    def arg(self):
        if not self.attempt(self.arg_expr):
            self.type()
        self.accept("...")

    def arg_expr(self):
        self.assign()
        if self.tok not in (",", ")", "...", ";"):
            self.fail()

    def args(self):
        old, self.literal_ok = self.literal_ok, True
        super().args()
        self.literal_ok = old

    def postfix(self):
        if self.k[self.i] != "o":
            return False
        text = self.tok
        if text == ".":
            self.i += 1
            if self.accept("("):
                if not self.accept("type"):
                    self.type()
                self.expect(")")
            else:
                self.name()
            return True
        if text == "(":
            self.args()
            return True
        if text == "[":
            old, self.literal_ok = self.literal_ok, True
            self.i += 1
            while not self.isop("]"):
                if not self.accept(":", ","):
                    if not self.attempt(self.index):
                        self.type()
            self.expect("]")
            self.literal_ok = old
            if self.isop("{") and self.literal_ok:
                self.attempt(self.literal)
            return True
        return False

    def index(self):
        self.assign()
        if self.tok not in ("]", ":", ","):
            self.fail()


class Rust(Parser):
    lang = "rust"
    reserved = _words("as break const continue else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while true false")
    binary = _words("+ - * / % & | ^ << >> && || == != < <= > >= = += -= *= /= %= &= |= ^= <<= >>=")
    prefix = _words("- ! * & && mut")
    no_struct = False

    def file(self):
        while self.k[self.i] != "e":
            self.item_or_fail()

    def attributes(self):
        while self.isop("#") and (self.t[self.i + 1] == "[" or self.t[self.i + 1] == "!" and self.t[self.i + 2] == "["):
            self.i += 1
            self.accept("!")
            self.skip_group()

    def item_or_fail(self):
        if self.accept(";"):
            return
        if not self.item():
            if self.k[self.i] == IDENT and self.macro_ahead():
                self.macro()
                self.accept(";")
                return
            self.fail()

    def macro_ahead(self) -> bool:
        at = self.i
        while self.k[at] == IDENT and self.t[at + 1] == "::":
            at += 2
        return self.k[at] == IDENT and self.t[at] not in self.reserved and self.t[at + 1] == "!" and (self.t[at + 2] in ("(", "[", "{") or self.k[at + 2] == IDENT and self.t[at + 3] == "{")

    def macro(self):
        while not self.accept("!"):
            self.i += 1
        if self.k[self.i] == IDENT:
            self.i += 1
        self.skip_group()

    def visibility(self):
        if self.accept("pub") and self.isop("(") and self.t[self.i + 1] in ("crate", "super", "self", "in"):
            self.skip_group()

    def item(self) -> bool:
        start = self.i
        self.attributes()
        if self.isop("}") or self.k[self.i] == "e":
            return self.i > start and self.t[start + 1] == "!"
        self.visibility()
        at = self.i
        while self.tok in ("const", "async", "unsafe", "extern", "default") and (self.t[self.i + 1] in ("fn", "unsafe", "async", "extern", "impl", "trait") or self.k[self.i + 1] == STRING):
            self.i += 1
            if self.k[self.i] == STRING:
                self.i += 1
        text = self.tok
        if self.k[self.i] != IDENT:
            if self.isop("{") and self.t[at] in ("extern", "unsafe") and self.t[at] == "extern":
                self.block_of_items()
                return True
            self.i = start
            return False
        if text == "fn":
            self.i += 1
            self.function()
        elif text in ("struct", "union") and self.isname(self.i + 1):
            self.i += 2
            self.generics()
            self.where()
            if self.isop("("):
                self.skip_group()
                self.where()
                self.expect(";")
            elif not self.accept(";"):
                self.expect("{")
                self.listed("}", self.field)
        elif text == "enum":
            self.i += 1
            self.name()
            self.generics()
            self.where()
            self.expect("{")
            self.listed("}", self.variant)
        elif text == "trait" or text == "auto":
            self.i += 1
            self.accept("trait")
            self.name()
            self.generics()
            if self.accept(":"):
                self.bounds()
            self.where()
            self.block_of_items()
        elif text == "impl":
            self.i += 1
            self.generics()
            self.accept("!")
            self.type()
            if self.accept("for"):
                self.type()
            self.where()
            self.block_of_items()
        elif text == "use":
            self.i += 1
            self.use_tree()
            self.expect(";")
        elif text == "mod":
            self.i += 1
            self.name()
            if not self.accept(";"):
                self.block_of_items()
        elif text == "type":
            self.i += 1
            self.name()
            self.generics()
            if self.accept(":"):
                self.bounds()
            self.where()
            if self.accept("="):
                self.type()
            self.where()
            self.expect(";")
        elif text in ("const", "static") and (self.k[self.i + 1] == IDENT and (self.t[self.i + 2] == ":" or self.t[self.i + 1] in ("mut", "_"))):
            self.i += 1
            self.accept("mut")
            self.name()
            self.expect(":")
            self.type()
            if self.accept("="):
                self.assign()
            self.expect(";")
        elif text == "extern" and self.t[self.i + 1] == "crate":
            self.i += 3
            if self.accept("as"):
                self.name()
            self.expect(";")
        elif text == "macro_rules" and self.t[self.i + 1] == "!":
            self.macro()
            self.accept(";")
        else:
            self.i = start
            return False
        return True

    def block_of_items(self):
        self.expect("{")
        while not self.accept("}"):
            self.item_or_fail()

    def use_tree(self):
        self.accept("::")
        while True:
            if self.accept("{"):
                self.listed("}", self.use_tree)
                return
            if self.accept("*"):
                return
            self.i += self.k[self.i] == IDENT or self.fail()
            if self.accept("as"):
                self.name()
                return
            if not self.accept("::"):
                return

    def field(self):
        self.attributes()
        self.visibility()
        self.name()
        self.expect(":")
        self.type()

    def variant(self):
        self.attributes()
        self.name()
        if self.isop("(") or self.isop("{"):
            self.skip_group()
        if self.accept("="):
            self.assign()

    def generics(self):
        if not self.accept("<"):
            return
        while not self.isop(">"):
            self.attributes()
            self.accept("const")
            self.i += self.k[self.i] == IDENT or self.fail()
            if self.accept(":"):
                self.bounds()
            if self.accept("="):
                self.type()
            if not self.accept(","):
                break
        self.close_angle()

    def bounds(self):
        while self.k[self.i] == IDENT or self.tok in ("?", "(", "~"):
            self.accept("?", "~")
            self.type_single()
            if not self.accept("+"):
                return

    def where(self):
        if self.accept("where"):
            while not (self.tok in ("{", ";", "=") and self.k[self.i] == "o"):
                self.type()
                self.expect(":")
                self.bounds()
                if not self.accept(","):
                    return

    def function(self):
        self.name()
        self.generics()
        self.expect("(")

        def param():
            self.attributes()
            mark = self.mark()
            self.accept("&")
            if self.k[self.i] == IDENT and self.tok[:1] == "'":
                self.i += 1
            self.accept("mut")
            if self.accept("self"):
                if self.accept(":"):
                    self.type()
                return
            self.back(mark)
            if self.accept("..."):
                return
            self.pattern()
            self.expect(":")
            self.type()

        self.listed(")", param)
        if self.accept("->"):
            self.type()
        self.where()
        if not self.accept(";"):
            self.block()

    def type(self):
        self.type_single()
        while self.accept("+"):
            self.type_single()

    def type_single(self):
        if self.accept("&", "&&"):
            if self.k[self.i] == IDENT and self.tok[:1] == "'":
                self.i += 1
            self.accept("mut")
            return self.type_single()
        if self.accept("*"):
            if not self.accept("const", "mut"):
                self.fail()
            return self.type_single()
        if self.accept("!", "_"):
            return None
        if self.isop("("):
            self.i += 1
            return self.listed(")", self.type)
        if self.accept("["):
            self.type()
            if self.accept(";"):
                self.assign()
            return self.expect("]")
        if self.accept("dyn", "impl"):
            return self.bounds()
        if self.accept("for"):
            self.generics()
            return self.type_single()
        if self.tok in ("unsafe", "extern", "fn") and self.k[self.i] == IDENT:
            while self.tok != "fn":
                self.i += 1
            self.i += 1
            self.skip_group()
            if self.accept("->"):
                self.type_single()
            return None
        if self.k[self.i] == IDENT and self.tok[:1] == "'":
            self.i += 1
            return None
        if self.accept("<"):
            self.type()
            if self.accept("as"):
                self.type()
            self.close_angle()
            self.expect("::")
        return self.path(True)

    def path(self, types: bool):
        self.accept("::")
        while True:
            self.name()
            if types and self.isop("<") or self.isop("::") and self.t[self.i + 1] == "<":
                self.accept("::")
                self.type_list()
            if types and self.isop("(") and self.t[self.i - 1] in ("Fn", "FnMut", "FnOnce"):
                self.skip_group()
                if self.accept("->"):
                    self.type_single()
            if self.isop("::") and self.k[self.i + 1] == IDENT:
                self.i += 1
                continue
            if self.isop("::") and self.t[self.i + 1] == "<":
                continue
            return

    def type_list(self):
        self.expect("<")
        while not (self.k[self.i] == "o" and self.tok[:1] == ">"):
            if self.k[self.i] == NUMBER or self.isop("{"):
                self.skip_group() if self.isop("{") else setattr(self, "i", self.i + 1)
            elif self.isname() and self.t[self.i + 1] == "=":
                self.i += 2
                self.type()
            else:
                self.type()
                if self.accept(":"):
                    self.bounds()
            if not self.accept(","):
                break
        self.close_angle()

    def pattern(self):
        self.accept("|")
        while True:
            self.pattern_one()
            if not self.accept("|"):
                return

    def pattern_one(self):
        while self.accept("&", "&&", "ref", "mut", "box"):
            pass
        self.accept("-")
        if self.k[self.i] in (NUMBER, STRING) or self.tok in ("true", "false"):
            self.i += 1
        elif self.isop("(") or self.isop("["):
            self.skip_group()
        elif self.accept("..", "_"):
            return
        else:
            self.path(False)
            if self.isop("!"):
                self.i += 1
                self.skip_group()
            if self.isop("(") or self.isop("{") and not self.no_struct:
                self.skip_group()
            elif self.accept("@"):
                self.pattern_one()
        if self.accept("..=", "..", "..."):
            self.accept("-")
            if self.k[self.i] in (NUMBER, STRING) or self.isname():
                self.i += 1

    def block(self):
        old, self.no_struct = self.no_struct, False
        self.expect("{")
        while not self.accept("}"):
            if self.k[self.i] == "e":
                self.fail()
            self.stmt()
        self.no_struct = old

    def stmt(self):
        if self.accept(";"):
            return
        if self.tok != "unsafe" or self.t[self.i + 1] != "{":
            if self.item():
                return
        self.attributes()
        if self.accept("let"):
            self.pattern()
            if self.accept(":"):
                self.type()
            if self.accept("="):
                self.assign()
                if self.accept("else"):
                    self.block()
            self.expect(";")
            return
        if self.tok in ("if", "match", "while", "for", "loop", "unsafe", "async") and self.k[self.i] == IDENT or self.isop("{") or self.tok[:1] == "'" and self.k[self.i] == IDENT:
            mark = self.mark()
            self.primary()
            if not (self.isop(".") or self.isop("?") or self.k[self.i] == "o" and self.tok in self.binary and self.tok not in ("*", "&", "-", "|", "||", "&&")):
                self.accept(";")
                return
            self.back(mark)
        if self.macro_ahead():
            mark = self.mark()
            self.macro()
            brace = self.t[self.i - 1] == "}"
            if brace or self.isop(";") or self.isop("}"):
                self.accept(";")
                return
            self.back(mark)
        self.assign()
        if not self.isop("}"):
            self.expect(";")

    def ternary(self):
        return False

    def infix_ok(self):
        return True

    def header(self):
        old, self.no_struct = self.no_struct, True
        while True:
            if self.accept("let"):
                self.pattern()
                self.expect("=")
            self.assign()
            if not self.accept("&&", "||"):
                break
        self.no_struct = old

    def right(self, op):
        if op in ("&&", "||") and self.tok == "let":
            self.i += 1
            self.pattern()
            self.expect("=")
        self.operand()

    def operand(self):
        while self.k[self.i] in "oi" and self.tok in self.prefix:
            self.i += 1
        self.primary()
        while self.postfix():
            pass

    def primary(self):
        kind, text = self.k[self.i], self.tok
        if kind in (NUMBER, STRING) or text in ("true", "false"):
            self.i += 1
            return None
        if kind == IDENT and text[:1] == "'" and self.t[self.i + 1] == ":":
            self.i += 2
            kind, text = self.k[self.i], self.tok
        if text == "{":
            return self.block()
        if self.accept("unsafe"):
            return self.block()
        if text == "async" and self.t[self.i + 1] in ("{", "move", "|", "||"):
            self.i += 1
            self.accept("move")
            return self.block() if self.isop("{") else self.primary()
        if self.accept("if"):
            self.header()
            self.block()
            if self.accept("else"):
                if self.tok == "if":
                    return self.primary()
                self.block()
            return None
        if self.accept("match"):
            self.header()
            self.expect("{")
            old, self.no_struct = self.no_struct, False
            while not self.accept("}"):
                self.attributes()
                self.pattern()
                if self.accept("if"):
                    self.assign()
                self.expect("=>")
                braced = self.isop("{")
                self.assign()
                if not self.accept(",") and not self.isop("}") and not (braced and self.t[self.i - 1] == "}"):
                    self.fail()
            self.no_struct = old
            return None
        if self.accept("while"):
            self.header()
            return self.block()
        if self.accept("loop"):
            return self.block()
        if self.accept("for"):
            self.pattern()
            self.expect("in")
            self.header()
            return self.block()
        if self.accept("return", "break"):
            if self.k[self.i] == IDENT and self.tok[:1] == "'":
                self.i += 1
            if not (self.k[self.i] == "o" and self.tok in (";", "}", ")", ",", "]")):
                self.assign()
            return None
        if self.accept("continue"):
            if self.k[self.i] == IDENT and self.tok[:1] == "'":
                self.i += 1
            return None
        if text == "move" or kind == "o" and text in ("|", "||"):
            self.accept("move")
            if not self.accept("||"):
                self.expect("|")
                while not self.accept("|"):
                    self.pattern_one()
                    if self.accept(":"):
                        self.type()
                    self.accept(",")
            if self.accept("->"):
                self.type()
                return self.block()
            return self.assign()
        if text == "(" or text == "[":
            old, self.no_struct = self.no_struct, False
            self.i += 1
            close = ")" if text == "(" else "]"
            while not self.accept(close):
                self.assign()
                if not self.accept(",", ";") and not self.isop(close):
                    self.fail()
            self.no_struct = old
            return None
        if text in ("..", "..="):
            self.i += 1
            if not (self.k[self.i] == "o" and self.tok in ("]", ")", ",", ";", "}")):
                self.assign()
            return None
        if self.macro_ahead():
            return self.macro()
        if text == "<":
            self.type_single()
        else:
            self.path(False)
        if self.isop("{") and not self.no_struct:
            self.i += 1

            def init():
                self.attributes()
                if self.accept(".."):
                    if not self.isop("}"):
                        self.assign()
                    return
                self.i += self.k[self.i] in (IDENT, NUMBER) or self.fail()
                if self.accept(":"):
                    self.assign()

            self.listed("}", init)
        return None

    def postfix(self):
        kind, text = self.k[self.i], self.tok
        if kind == IDENT and text == "as":
            self.i += 1
            self.type_single()
            return True
        if kind != "o":
            return False
        if text == ".":
            self.i += 1
            if self.k[self.i] not in (IDENT, NUMBER):
                self.fail()
            self.i += 1
            if self.isop("::"):
                self.i += 1
                self.type_list()
            return True
        if text == "(":
            old, self.no_struct = self.no_struct, False
            self.args()
            self.no_struct = old
            return True
        if text == "[":
            old, self.no_struct = self.no_struct, False
            self.i += 1
            self.assign()
            self.expect("]")
            self.no_struct = old
            return True
        if text == "?":
            self.i += 1
            return True
        if text in ("..", "..="):
            self.i += 1
            if not (self.k[self.i] == "o" and self.tok in ("]", ")", ",", ";", "}", "{")):
                self.operand()
                while self.k[self.i] == "o" and self.tok in ("+", "-", "*", "/"):
                    self.i += 1
                    self.operand()
            return True
        return False


class Php(Js):
    lang, types, lines_matter = "php", False, False
    reserved = _words("abstract and as break case catch class clone const continue declare default do echo else elseif enddeclare endfor endforeach endif endswitch endwhile extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list namespace new or private protected public require require_once return static switch throw trait try unset use var while xor yield")
    binary = _words("+ - * / % ** . << >> && || ?? == != === !== < > <= >= <=> & | ^ = += -= *= /= .= %= **= ??= &= |= ^= <<= >>= and or xor instanceof <>")
    prefix = _words("! ~ + - ++ -- & @ new clone print include include_once require require_once throw yield")

    def prepare(self, toks):
        out = []
        for tok in toks:
            if out and tok[0] == OP and out[-1][0] == OP and (out[-1][1] + tok[1]) in (".=", "<>", "**=") and out[-1][2] + len(out[-1][1]) == tok[2]:
                out[-1] = (OP, out[-1][1] + tok[1], out[-1][2])
            else:
                out.append(tok)
        if out and out[0][0] == STRING and out[0][2] == 0:
            out = out[1:]
        return out

    def prepare_code(self, code):
        kinds, texts, t = list(code.k), list(code.t), code.t
        for i in reversed([i for i in range(1, len(t)) if t[i] in ("=", ">") and t[i - 1] + t[i] in (".=", "<>", "**=")]):
            if kinds[i] == OP and kinds[i - 1] == OP and code.offset(i) == code.offset(i - 1) + len(t[i - 1]):
                texts[i - 1 : i + 1] = [t[i - 1] + t[i]]
                del kinds[i]
        if kinds[:1] == [STRING] and code.place[0] == 0 and code.offset(0) == 0:
            return kinds[1:], texts[1:]
        return kinds, texts

    def end(self):
        self.expect(";")

    def file(self):
        while self.k[self.i] != "e":
            self.stmt()

    def stmt(self):
        text, kind = self.tok, self.k[self.i]
        if kind == STRING and False:
            return None
        if kind == IDENT and text[:1] != "$":
            rule = getattr(self, f"p_{text.lower()}", None)
            if rule and rule() is not False:
                return None
            if self.isname() and self.t[self.i + 1] == ":":
                self.i += 2
                return None
        elif kind == "o":
            if text == "{":
                return self.block()
            if self.accept(";"):
                return None
            if text == "#":
                self.attributes()
                return self.stmt()
        self.expr()
        return self.end()

    def attributes(self):
        while self.isop("#") and self.t[self.i + 1] == "[":
            self.i += 1
            self.skip_group()

    def body(self, *ends: str):
        """A statement, or the colon form up to one of ``ends``."""
        if self.accept(":"):
            while self.tok not in ends:
                if self.k[self.i] == "e":
                    self.fail()
                self.stmt()
            return True
        self.stmt()
        return False

    def p_if(self):
        self.i += 1
        self.paren()
        colon = self.body("elseif", "else", "endif")
        while self.accept("elseif"):
            self.paren()
            self.body("elseif", "else", "endif")
        if self.tok == "else" and self.t[self.i + 1] == "if" and not colon:
            self.i += 1
            return self.p_if()
        if self.accept("else"):
            self.body("endif")
        if colon:
            self.expect("endif")
            self.end()

    def p_while(self):
        word = f"end{self.tok}"
        self.i += 1
        self.paren()
        if self.body(word):
            self.i += 1
            self.end()

    p_switch_body = None

    def p_for(self):
        self.i += 1
        self.expect("(")
        for close in (";", ";", ")"):
            if not self.isop(close):
                self.expr()
            self.expect(close)
        if self.body("endfor"):
            self.i += 1
            self.end()

    def p_foreach(self):
        self.i += 1
        self.expect("(")
        self.assign()
        self.expect("as")
        self.assign()
        if self.accept("=>"):
            self.assign()
        self.expect(")")
        if self.body("endforeach"):
            self.i += 1
            self.end()

    def p_do(self):
        self.i += 1
        self.stmt()
        self.expect("while")
        self.paren()
        self.end()

    def p_switch(self):
        self.i += 1
        self.paren()
        self.expect("{")
        while not self.accept("}"):
            if self.accept("case"):
                self.expr()
                if not self.accept(":", ";"):
                    self.fail()
            elif self.accept("default"):
                if not self.accept(":", ";"):
                    self.fail()
            else:
                self.stmt()

    def p_try(self):
        self.i += 1
        self.block()
        ok = False
        while self.accept("catch"):
            ok = True
            self.expect("(")
            self.type()
            if self.k[self.i] == IDENT and self.tok[:1] == "$":
                self.i += 1
            self.expect(")")
            self.block()
        if self.accept("finally"):
            ok = True
            self.block()
        if not ok:
            self.fail()

    def p_return(self):
        self.i += 1
        if not self.isop(";"):
            self.expr()
        self.end()

    p_break = p_continue = p_return

    def p_echo(self):
        self.i += 1
        self.expr()
        self.end()

    p_global = p_unset = p_echo

    def p_static(self):
        if self.k[self.i + 1] == IDENT and self.t[self.i + 1][:1] == "$":
            self.i += 1
            self.expr()
            return self.end()
        return False

    def p_goto(self):
        self.i += 2
        self.end()

    def p_namespace(self):
        self.i += 1
        if self.k[self.i] == IDENT:
            self.i += 1
        if not self.accept(";"):
            self.block()

    def p_use(self):
        self.i += 1
        self.accept("function", "const")
        while True:
            self.i += self.k[self.i] == IDENT or self.fail()
            if self.isop("\\"):
                self.i += 1
                self.skip_group()
            if self.accept("as"):
                self.name()
            if not self.accept(","):
                break
        self.end()

    def p_const(self):
        self.i += 1
        while True:
            if self.k[self.i + 1] == IDENT:
                self.type()
            self.i += self.k[self.i] == IDENT or self.fail()
            self.expect("=")
            self.assign()
            if not self.accept(","):
                break
        self.end()

    def p_declare(self):
        self.i += 1
        self.skip_group()
        if not self.accept(";"):
            self.stmt()

    def p_function(self):
        at = self.i + 1
        if self.t[at] == "&":
            at += 1
        if self.k[at] != IDENT:
            return False
        self.i = at
        self.name()
        self.signature()
        return self.block()

    def signature(self):
        self.expect("(")
        self.listed(")", self.param)
        if self.accept(":"):
            self.type()

    def param(self):
        self.attributes()
        while self.accept("public", "private", "protected", "readonly"):
            pass
        if not (self.k[self.i] == IDENT and self.tok[:1] == "$" or self.tok in ("&", "...")):
            self.type()
        self.accept("&")
        self.accept("...")
        if not (self.k[self.i] == IDENT and self.tok[:1] == "$"):
            self.fail()
        self.i += 1
        if self.accept("="):
            self.assign()

    def type(self):
        self.accept("?")
        while True:
            if self.accept("("):
                self.type()
                self.expect(")")
            else:
                if self.k[self.i] != IDENT or self.tok[:1] == "$":
                    self.fail()
                self.i += 1
            if self.isop("&") and (self.t[self.i + 1][:1] == "$" or self.t[self.i + 1] in ("...", "&")):
                return
            if not self.accept("|", "&"):
                return

    def _class(self):
        while self.accept("abstract", "final", "readonly"):
            pass
        kind = self.tok
        if not self.accept("class", "interface", "trait", "enum"):
            return False
        self.name()
        if kind == "enum" and self.accept(":"):
            self.type()
        return self.class_rest()

    def class_rest(self):
        while self.accept("extends", "implements"):
            while True:
                self.i += self.k[self.i] == IDENT or self.fail()
                if not self.accept(","):
                    break
        self.expect("{")
        while not self.accept("}"):
            self.member()

    p_class = p_abstract = p_final = p_interface = p_trait = _class

    def p_enum(self):
        if self.k[self.i + 1] != IDENT:
            return False
        return self._class()

    def p_readonly(self):
        if self.t[self.i + 1] not in ("class", "final", "abstract"):
            return False
        return self._class()

    def member(self):
        self.attributes()
        if self.accept("use"):
            while self.isname() or self.isop(","):
                self.i += 1
            if self.isop("{"):
                return self.skip_group()
            return self.end()
        if self.accept("case"):
            self.name()
            if self.accept("="):
                self.assign()
            return self.end()
        mods = 0
        while self.accept("public", "private", "protected", "static", "abstract", "final", "readonly", "var"):
            mods += 1
        if self.tok == "const":
            return self.p_const()
        if self.accept("function"):
            self.accept("&")
            self.i += self.k[self.i] == IDENT and self.tok[:1] != "$" or self.fail()
            self.signature()
            if self.accept(";"):
                return None
            return self.block()
        if not mods:
            self.fail()
        if self.tok[:1] != "$":
            self.type()
        while True:
            if self.tok[:1] != "$":
                self.fail()
            self.i += 1
            if self.accept("="):
                self.assign()
            if not self.accept(","):
                break
        return self.end()

    def ternary(self):
        if self.t[self.i + 1] == ":" and self.k[self.i + 1] == "o":
            self.i += 2
            self.assign()
            return False
        return True

    def primary(self):
        kind, text = self.k[self.i], self.tok
        if kind in (NUMBER, STRING):
            self.i += 1
            if kind == STRING and text.startswith("<<<") and self.k[self.i] == STRING:
                self.i += 1
        elif kind == "o":
            if text == "(":
                self.i += 1
                if self.k[self.i] == IDENT and self.t[self.i + 1] == ")" and self.tok.lower() in ("int", "integer", "bool", "boolean", "float", "double", "string", "array", "object", "unset"):
                    self.i += 2
                    return self.operand()
                self.expr()
                self.expect(")")
            elif text == "[":
                self.i += 1
                self.items("]")
            elif text == "$":
                self.i += 1
                if self.isop("{"):
                    self.skip_group()
                else:
                    self.primary()
            elif text == "#":
                self.attributes()
                self.primary()
            elif text == "\\":
                self.i += 1
                self.primary()
            else:
                self.fail()
        elif kind == IDENT:
            low = text.lower()
            if text[:1] == "$":
                self.i += 1
            elif low == "static" and self.t[self.i + 1] in ("function", "fn"):
                self.i += 1
                self.primary()
            elif low == "function":
                self.i += 1
                self.accept("&")
                self.expect("(")
                self.listed(")", self.param)
                if self.accept("use"):
                    self.skip_group()
                if self.accept(":"):
                    self.type()
                self.block()
            elif low == "fn":
                self.i += 1
                self.accept("&")
                self.signature()
                self.expect("=>")
                self.assign()
            elif low == "class" and self.t[self.i - 1] == "new":
                self.i += 1
                if self.isop("("):
                    self.args()
                self.class_rest()
            elif low == "match" and self.t[self.i + 1] == "(":
                self.i += 1
                self.paren()
                self.expect("{")

                def arm():
                    if not (self.tok == "default" and self.accept("default")):
                        self.assign()
                        while self.accept(","):
                            if self.isop("=>"):
                                break
                            self.assign()
                    self.expect("=>")
                    self.assign()

                self.listed("}", arm)
            elif low in ("isset", "list", "array", "empty", "exit", "die", "unset") and self.t[self.i + 1] == "(":
                self.i += 2
                self.items(")")
            elif low in ("static", "exit", "die"):
                self.i += 1
            else:
                self.name()
        else:
            self.fail()
        return None

    def items(self, close: str):
        while not self.accept(close):
            if self.accept(","):
                continue
            self.accept("...")
            self.assign()
            if self.accept("=>"):
                self.assign()
            if not self.isop(close):
                self.expect(",")

    def arg(self):
        if self.k[self.i] == IDENT and self.t[self.i + 1] == ":" and self.tok[:1] != "$":
            self.i += 2
        if self.accept("..."):
            if self.isop(")"):
                return
        self.assign()

    def postfix(self):
        if self.k[self.i] != "o":
            return False
        text = self.tok
        if text in ("->", "?->", "::"):
            self.i += 1
            if self.isop("{"):
                self.skip_group()
            elif self.isop("$"):
                self.primary()
            elif self.k[self.i] == IDENT:
                self.i += 1
            else:
                self.fail()
            return True
        if text == "(":
            self.args()
            return True
        if text == "[":
            self.i += 1
            if not self.accept("]"):
                self.expr()
                self.expect("]")
            return True
        if text in ("++", "--"):
            self.i += 1
            return True
        return False


class Ruby(Parser):
    lang, lines_matter = "ruby", True
    reserved = _words("BEGIN END alias and begin break case class def defined? do else elsif end ensure for if in module next not or redo rescue retry return then undef unless until when while yield")
    binary = _words("+ - * / % ** . << >> && || == != === < > <= >= <=> =~ !~ & | ^ = += -= *= /= %= **= ||= &&= <<= >>= &= |= ^= .. ... and or => ? :")
    prefix = _words("! ~ + - & * ** not defined? .. ...")
    no_do = False

    def prepare(self, toks):
        out = []
        for tok in toks:
            if out and tok[0] == OP and out[-1][0] == OP and (out[-1][1] + tok[1]) in ("&.", "**=") and out[-1][2] + len(out[-1][1]) == tok[2]:
                out[-1] = (OP, out[-1][1] + tok[1], out[-1][2])
            else:
                out.append(tok)
        return out

    def end(self):
        if not self.accept(";") and not (self.nl[self.i] or self.k[self.i] == "e" or self.isop("}") or self.isop(")") or self.tok in ("end", "else", "elsif", "when", "in", "rescue", "ensure", "then", "do") and self.k[self.i] == IDENT):
            self.fail()

    def file(self):
        self.body(())
        if self.k[self.i] != "e":
            self.fail()

    def body(self, stops):
        while self.k[self.i] != "e" and not (self.k[self.i] == IDENT and self.tok in stops):
            if self.accept(";"):
                continue
            if self.isop("}") or self.isop(")"):
                return
            self.stmt()
            self.end()

    def until_end(self, *middles: str):
        self.body(("end", *middles))

    def stmt(self):
        self.expr_stmt()
        while self.k[self.i] == IDENT and not self.nl[self.i]:
            if self.accept("if", "unless", "while", "until", "rescue"):
                self.expr_stmt()
            else:
                return

    def expr_stmt(self):
        self.accept("*")
        self.assign()
        while True:
            if self.accept("and", "or"):
                self.assign()
            elif self.isop(",") and self.multiple:
                self.i += 1
                self.accept("*")
                if self.isop("="):
                    continue
                self.assign()
            else:
                return

    multiple = True

    def expr(self):
        self.expr_stmt()

    def assign(self):
        self.operand()
        while True:
            text, kind = self.tok, self.k[self.i]
            if kind == "o" and text == "?" and not self.nl[self.i]:
                self.i += 1
                self.assign()
                if self.k[self.i] == IDENT and self.tok[:1] == ":":
                    self.t[self.i] = self.tok[1:]
                else:
                    self.expect(":")
                self.assign()
            elif kind == "o" and text in self.binary and text not in ("?", ":", ".") and (not self.nl[self.i] or text in ("&&", "||")):
                self.i += 1
                if text in ("..", "...") and (self.isop(")") or self.isop("]") or self.nl[self.i]):
                    continue
                self.operand()
                if text.endswith("=") and text not in ("==", "!=", "<=", ">=", "===") and self.tok == "rescue" and not self.nl[self.i]:
                    self.i += 1
                    self.assign()
            else:
                return

    def operand(self):
        while self.k[self.i] in "oi" and self.tok in self.prefix:
            self.i += 1
        self.primary()
        while self.postfix():
            pass

    def block_params(self):
        if self.accept("||"):
            return
        if self.accept("|"):
            while not self.accept("|"):
                if self.k[self.i] == "e" or self.nl[self.i]:
                    self.fail()
                self.i += 1

    def rescue_rest(self):
        while self.tok in ("rescue", "else", "ensure") and self.k[self.i] == IDENT:
            self.i += 1
            if self.t[self.i - 1] == "rescue" and not self.nl[self.i]:
                while not self.nl[self.i] and not self.isop(";") and self.tok != "then":
                    self.i += 1
                self.accept("then")
            self.until_end("rescue", "else", "ensure")
        self.expect("end")

    def primary(self):
        kind, text = self.k[self.i], self.tok
        if kind in (NUMBER, REGEX):
            self.i += 1
            return None
        if kind == STRING:
            self.i += 1
            while self.k[self.i] == STRING:
                self.i += 1
            return None
        if kind == "o":
            if text in ("(", "["):
                self.i += 1
                close = ")" if text == "(" else "]"
                old, self.no_do = self.no_do, False
                if text == "(":
                    self.body(())
                    self.expect(")")
                else:
                    self.listed("]", self.arg)
                self.no_do = old
                return None
            if text == "{":
                self.i += 1
                return self.listed("}", self.arg)
            if text == "->":
                self.i += 1
                if self.isop("("):
                    self.skip_group()
                elif self.isname():
                    while not (self.isop("{") or self.tok == "do"):
                        if self.k[self.i] == "e":
                            self.fail()
                        self.i += 1
                return self.code_block()
            if text == "::":
                self.i += 1
                return self.primary()
            self.fail()
        if kind != IDENT:
            self.fail()
        if self.accept("def"):
            if self.k[self.i] not in (IDENT, OP):
                self.fail()
            self.i += 1
            while self.accept(".", "=", "]", "@"):
                if self.k[self.i] == IDENT and self.t[self.i - 1] == ".":
                    self.i += 1
            if self.isop("("):
                self.skip_group()
                if self.accept("="):
                    return self.stmt()
            else:
                if self.accept("="):
                    return self.stmt()
                while not self.nl[self.i] and not self.isop(";"):
                    if self.k[self.i] not in (IDENT, NUMBER, STRING) and self.tok not in (",", "*", "**", "&", "=", ":", "[", "]", "{", "}", "."):
                        self.fail()
                    self.i += 1
            self.until_end("rescue", "else", "ensure")
            return self.rescue_rest()
        if self.accept("class"):
            if self.accept("<<"):
                self.operand()
            else:
                self.constant()
                if self.accept("<"):
                    self.operand()
            self.until_end("rescue", "ensure")
            return self.rescue_rest()
        if self.accept("module"):
            self.constant()
            self.until_end()
            return self.expect("end")
        if self.accept("if", "unless"):
            self.expr_stmt()
            self.accept("then")
            self.until_end("elsif", "else")
            while self.accept("elsif"):
                self.expr_stmt()
                self.accept("then")
                self.until_end("elsif", "else")
            if self.accept("else"):
                self.until_end()
            return self.expect("end")
        if self.accept("while", "until"):
            old, self.no_do = self.no_do, True
            self.expr_stmt()
            self.no_do = old
            self.accept("do")
            self.until_end()
            return self.expect("end")
        if self.accept("for"):
            while not self.accept("in"):
                if self.k[self.i] not in (IDENT, OP) or self.nl[self.i]:
                    self.fail()
                self.i += 1
            old, self.no_do = self.no_do, True
            self.expr_stmt()
            self.no_do = old
            self.accept("do")
            self.until_end()
            return self.expect("end")
        if self.accept("case"):
            if not self.nl[self.i]:
                self.expr_stmt()
            while self.accept(";"):
                pass
            while self.tok in ("when", "in") and self.k[self.i] == IDENT:
                self.i += 1
                while not (self.nl[self.i] and self.t[self.i - 1] != ",") and not self.accept("then", ";"):
                    if self.k[self.i] == "e":
                        self.fail()
                    self.i += 1
                self.until_end("when", "in", "else")
            if self.accept("else"):
                self.until_end()
            return self.expect("end")
        if self.accept("begin"):
            self.until_end("rescue", "else", "ensure")
            return self.rescue_rest()
        if self.accept("return", "break", "next", "redo", "retry", "yield"):
            if self.t[self.i - 1] == "yield" and self.isop("(") and not self.nl[self.i]:
                return self.call_args()
            if self.starts_operand():
                self.arg()
                while self.accept(","):
                    self.arg()
            return None
        if self.accept("alias"):
            self.i += 2
            return None
        if self.accept("undef"):
            self.i += 1
            return None
        if text in ("BEGIN", "END") and self.t[self.i + 1] == "{":
            self.i += 1
            return self.code_block()
        self.name()
        if text[:1] == ":" or text in ("self", "true", "false", "nil", "__FILE__", "__LINE__", "__method__") or text[:1] in "@$":
            return None
        self.command()
        return None

    def constant(self):
        self.accept("::")
        if not (self.isname() and self.tok[:1].isupper()):
            self.fail()
        self.i += 1
        while self.accept("::"):
            self.name()

    def starts_operand(self) -> bool:
        """An operand on the same line, so that a name before it is a command with arguments."""
        kind, text = self.k[self.i], self.tok
        if self.nl[self.i]:
            return False
        if kind in (NUMBER, STRING, REGEX):
            return True
        if kind == IDENT:
            return text not in self.reserved or text in ("not", "defined?", "case", "begin", "def", "class", "yield")
        return kind == "o" and text in ("[", "->", "::", "!", "(")

    def command(self):
        """Arguments without parentheses."""
        if self.isop("(") or self.isop("["):
            return
        splat = self.k[self.i] == "o" and self.tok in ("*", "&", "**", "-") and not self.nl[self.i] and self.glued()
        if self.starts_operand() or splat:
            self.arg()
            while self.isop(","):
                self.i += 1
                self.arg()
            self.do_block()

    def glued(self) -> bool:
        return False

    def arg(self):
        if self.accept("*", "**", "&"):
            if self.isop(",") or self.isop(")"):
                return
        if self.k[self.i] in (IDENT, STRING) and self.t[self.i + 1] == ":" and self.k[self.i + 1] == "o":
            self.i += 2
            if self.isop(",") or self.isop(")") or self.isop("}") or self.nl[self.i]:
                return
        elif self.k[self.i] == IDENT and self.t[self.i + 1][:1] == ":" and self.k[self.i + 1] == IDENT and self.t[self.i + 1][:2] != "::" and False:
            self.i += 2
        old, self.multiple = self.multiple, False
        self.assign()
        self.multiple = old

    def call_args(self):
        self.expect("(")
        old, self.no_do = self.no_do, False
        self.listed(")", self.arg)
        self.no_do = old

    def code_block(self):
        if self.accept("{"):
            self.block_params()
            old, self.no_do, self.multiple, m = self.no_do, False, True, self.multiple
            self.body(())
            self.no_do, self.multiple = old, m
            self.expect("}")
        elif self.accept("do"):
            self.block_params()
            old, self.no_do, self.multiple, m = self.no_do, False, True, self.multiple
            self.until_end("rescue", "else", "ensure")
            self.no_do, self.multiple = old, m
            self.rescue_rest()
        else:
            self.fail()

    def do_block(self):
        if self.tok == "do" and self.k[self.i] == IDENT and not self.no_do and not self.nl[self.i]:
            self.code_block()

    def postfix(self):
        kind, text = self.k[self.i], self.tok
        if kind == IDENT and text == "do" and not self.no_do and not self.nl[self.i]:
            self.code_block()
            return True
        if kind != "o":
            return False
        if text in (".", "&.", "::"):
            if text == "::" and self.nl[self.i]:
                return False
            self.i += 1
            if self.isop("("):
                self.call_args()
                return True
            if self.k[self.i] not in (IDENT, OP):
                self.fail()
            self.i += 1
            self.command()
            return True
        if self.nl[self.i]:
            return False
        if text == "(":
            self.call_args()
            return True
        if text == "[":
            self.i += 1
            self.listed("]", self.arg)
            return True
        if text == "{" and self.k[self.i - 1] in (IDENT, OP) and self.t[self.i - 1] not in ("[",) and (self.t[self.i - 1] == ")" or self.k[self.i - 1] == IDENT):
            self.code_block()
            return True
        return False


__all__ = ["Go", "Php", "Reject", "Ruby", "Rust"]
