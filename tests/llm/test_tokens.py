"""Tokens in parallel sequences (the pass of p4_found) against the rows of the scanner with context."""

import pytest

from quarry.llm.declare import declarations
from quarry.llm.documented import functions
from quarry.llm.grammar import valid_plain
from quarry.llm.lexer import CODE_LANGUAGES, Code, Lines, tokens

TEXTS = {
    "python": '#!/usr/bin/env python\n"""Head\nlines."""\n\ndef f(a,\n      b):  # x\n    """Adds two numbers that the caller has at hand."""\n    return a + b\n',
    "javascript": "/* a\n b */ const x = a / b, y = `p\nq ${x}`;\n/** Gives back the one number that is asked. */\nfunction f() { return /re[/]x/g; }\n",
    "typescript": "interface A { f(x: number): void }\n/* a\n b */\nfunction g<T>(x: T): T { return x! }\n",
    "java": "class A {\n  /** Adds two numbers that the caller has. */\n  @X(1)\n  int f(int a) { return a; }\n}\n",
    "go": "package a\n\n// F adds two numbers the caller has at hand.\nfunc F(a int) int {\n\tx := a &^ 1; y := a & 2\n\treturn x /* c\n*/\n}\n",
    "csharp": '#region A\nclass A { void F() { var s = @"a\nb"; } }\n#endregion\n',
    "rust": "/* a /* nested */ b */\ntrait T { fn f<'a>(x: &'a str) -> char { '\\n' } }\n",
    "php": "\n\n<?php\nfunction f($a) { $a .= 'x'; if ($a <> 1) { $b = $a . $a; } ?>\n<b>\n<?php }\nfunction g() { return 1; }\n",
    "ruby": "=begin\nx\n=end\ndef f(a)\n  b = <<~E\n    text\n  E\n  a **= 2\nend\n",
}


@pytest.mark.parametrize("lang", CODE_LANGUAGES)
@pytest.mark.parametrize("change", ["", "\n\n", "#!x\n", "<", '"', "/*"])
def test_sequences_are_the_rows(lang, change):
    for text in (change + TEXTS[lang], TEXTS[lang] + change, TEXTS[lang].replace("\n", " \t\n" + change, 2)):
        want, code, lines = tokens(text, lang), Code(text, lang), Lines(text)
        rows = [t for t in want if t[0] not in "lc"]
        assert [code.offset(i) for i in range(len(code.t))] == [t[2] for t in rows]
        assert list(zip(code.k, code.t, strict=True)) == [t[:2] for t in rows]
        assert code.line_of == [lines.of(t[2]) for t in rows]
        assert code.tuples() == want
        assert valid_plain(text, lang, code) == valid_plain(text, lang, want) == valid_plain(text, lang)


@pytest.mark.parametrize("lang", CODE_LANGUAGES)
def test_declarations_of_known_tokens(lang):
    text = TEXTS[lang]
    assert valid_plain(text, lang)
    found = declarations(text, lang, Code(text, lang))
    assert found and found == declarations(text, lang)
    assert [d for d, _, _ in functions(text, lang)] == [d for d in found if d.name]
