"""JSX in JavaScript and TypeScript: the same text with its elements written as plain expressions.

An element becomes a name at its ``<`` that is called with each of its ``{}`` containers; tags and text
are blanked. Offsets and lines stay, so scanners and grammars read the result like any other text.
"""

from __future__ import annotations

import re

_LOOK = re.compile(r"</[A-Za-z>]|/>")
_OPEN = re.compile(r"<(?:>|[A-Za-z_$][\w$]*(?:[.:\-][\w$]+)*(?=[\s/>]))")
_GENERIC = re.compile(r"<[A-Za-z_$][\w$]*\s*(?:,|extends\b|=)")
_CLOSE = re.compile(r"</[^<>{}]*>")
_STRING = re.compile(r"\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|//[^\n]*|/\*[\s\S]*?\*/|/(?![*/\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE = re.compile(r"(?:[(,=?:;{}\[&|!]|=>|\b(?:return|default|case|else|yield|await)|^)\s*$")
_LEAD = 40  # characters looked back over for the sign before an element; white space beyond them is skipped first


class _Broken(Exception):
    """No JSX after all."""


def looks(text: str) -> bool:
    """Whether a text may hold elements."""
    return _LOOK.search(text) is not None


class _Writer:
    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.out = list(text)

    def blank(self, a: int, b: int) -> None:
        for k in range(a, b):
            if self.out[k] != "\n":
                self.out[k] = " "

    def begins(self, at: int) -> bool:
        """An element can begin at the ``<`` at ``at``: nothing that could be compared stands before it."""
        if not _OPEN.match(self.text, at) or _GENERIC.match(self.text, at):
            return False
        k = at
        while k and self.text[k - 1].isspace():
            k -= 1
        return k == 0 or _BEFORE.search(self.text[max(0, k - _LEAD) : k]) is not None

    def scan(self) -> str:
        """The whole text. A stack of states, not recursion, follows the nesting: code in braces, templates, tags, children."""
        stack: list[list] = [["code", ""]]  # kind, what closes it
        at = 0
        while at < self.n:
            kind = stack[-1][0]
            ch = self.text[at]
            if kind == "code":
                if ch in "\"'/":
                    regex_free = ch != "/" or self.text[at : at + 2] in ("//", "/*") or _BEFORE.search(self.text[max(0, at - _LEAD) : at])
                    m = _STRING.match(self.text, at) if regex_free else None
                    at = m.end() if m else at + 1
                elif ch == "`":
                    stack.append(["template", "`"])
                    at += 1
                elif ch == "{":
                    stack.append(["code", "}"])
                    at += 1
                elif ch == "}":
                    if len(stack) > 1:
                        if stack[-1][1] == ")":
                            self.out[at] = ")"
                        stack.pop()
                    at += 1
                elif ch == "<" and self.begins(at):
                    self.out[at] = "f"
                    at = self.tag(at, stack, True)
                else:
                    at += 1
            elif kind == "template":
                if ch == "\\":
                    at += 2
                elif ch == "`":
                    stack.pop()
                    at += 1
                elif ch == "$" and self.text[at + 1 : at + 2] == "{":
                    stack.append(["code", "}"])
                    at += 2
                else:
                    at += 1
            elif kind == "tag":  # attributes
                if ch in "\"'":
                    end = self.text.find(ch, at + 1)
                    if end < 0:
                        raise _Broken
                    self.blank(at, end + 1)
                    at = end + 1
                elif ch == "{":
                    self.out[at] = "("
                    stack.append(["code", ")"])
                    at += 1
                elif ch == ">" or self.text.startswith("/>", at):
                    stack.pop()
                    size = 1 if ch == ">" else 2
                    if size == 1:
                        stack.append(["children", ""])
                    self.blank(at, at + size)
                    at += size
                elif ch == "<" and self.begins(at):  # an element as an attribute's value
                    at = self.tag(at, stack, False)
                else:
                    self.blank(at, at + 1)
                    at += 1
            elif ch == "{":
                self.out[at] = "("
                stack.append(["code", ")"])
                at += 1
            elif ch == "<":
                m = _CLOSE.match(self.text, at)
                if m:
                    self.blank(at, m.end())
                    stack.pop()
                    at = m.end()
                elif _OPEN.match(self.text, at):
                    at = self.tag(at, stack, False)
                else:
                    raise _Broken
            else:
                self.blank(at, at + 1)
                at += 1
        if len(stack) > 1:
            raise _Broken
        return "".join(self.out)

    def tag(self, at: int, stack: list[list], keep: bool) -> int:
        m = _OPEN.match(self.text, at)
        whole = m.group() == "<>"
        self.blank(at + keep, m.end())
        stack.append(["children", ""] if whole else ["tag", ""])
        return m.end()


def plain(text: str) -> str | None:
    """``text`` without elements, as long as before; None if it has none or they don't close."""
    if not looks(text):
        return None
    try:
        out = _Writer(text).scan()
    except _Broken:
        return None
    return out if out != text else None
