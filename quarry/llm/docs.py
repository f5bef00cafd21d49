"""Documentation text of a declaration: marks stripped, parameter sections, directives and dead code left out."""

from __future__ import annotations

import re

# Openings of comments that steer a tool.
_DIRECTIVE = re.compile(
    r"""^\W{0,3}(?:eslint|prettier|tslint|jshint|jslint|jscs|istanbul|c8\s|v8\s|webpack|babel|stylelint|biome|deno-|@ts-|ts-ignore|ts-expect|@jsx|@flow|flow\b|sourceMappingURL|globals?\s+\w+\s*(?::|,|\*/|$)
    |noqa|type:\s*ignore|pylint|mypy|pyright|pytype|fmt:|isort|yapf|black:|ruff|flake8|nosec|pragma\b|coverage:|-\*-|vim?:|ex:\s
    |rubocop|reek|steep:|typed:|frozen_string_literal|encoding:|sorbet|:nocov:|:nodoc:|standard:|brakeman
    |phpcs|@phpcs|phpstan|@phpstan|psalm|@psalm|@codingStandards|@codeCoverage|phpmd|php-cs-fixer|@noinspection|noinspection
    |go:|\+build|nolint|lint:|golint|gosec|staticcheck|export\s+\w+$|line\s.*:\d+$|cgo\b
    |clippy|rustfmt|tarpaulin|cbindgen|allow\(|deny\(|\#!?\[
    |resharper|nolint|nosonar|checkstyle|spotbugs|@formatter|spotless|findbugs|@suppress|suppresswarnings|sonar|stylecop|codeql|semgrep|cspell|spell-?checker|snyk|\#(?:region|endregion|pragma|nullable|if|endif)|(?:end)?region\b
    |<auto-?generated|SPDX-|\$Id|\$Rev|editorconfig|markdownlint|keep-sorted|swagger:|\+k8s|\+kubebuilder|@todo:skip)""",
    re.I | re.X,
)
# Tags whose text describes; every other tag opens a section on parameters and results.
_DESCRIBING = re.compile(r"^\s*[@\\](?:desc(?:ription)?|summary|brief|details|remarks?|overview|note|classdesc|abstract)\b:?", re.I)
_TAG = re.compile(r"^\s*(?:[@\\][A-Za-z][\w-]*|:(?:param|parameter|arg|argument|type|returns?|rtype|raises?|except|exception|var|ivar|cvar|yields?|ytype|keyword|key|meta)\b[^:\n]*:)")
_SECTION = re.compile(
    r"^\s*(?:\#{1,6}\s*|\*\*)?(?:args?|arguments?|parameters?|params?|other parameters|keyword args?|keyword arguments?|returns?|return value|yields?|raises?|throws|errors?|exceptions?|attributes|panics|safety|options|inputs?|outputs?|type parameters)\s*(?:\*\*)?\s*:?\s*(?:\*\*)?$",
    re.I,
)
_XML_SECTION = re.compile(r"<(param|typeparam|returns|exception|value|paramref|seealso|permission)\b[^>]*?(?:/>|>[\s\S]*?</\1\s*>|>[^\n]*)", re.I)
_XML_TAG = re.compile(r"</?[A-Za-z][\w.:-]*(?:\s[^<>]*)?/?>")
_WORD = re.compile(r"[^\W_][\w'’\-./]*")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯฀-๿]")
_CODE_END = re.compile(r"[;{}]\s*$|\)\s*(?:=>|->)\s*\S|^\s*(?:\}|\{|\)|end)\s*;?\s*$")
_CODE_ASSIGN = re.compile(r"^\s*(?:(?:const|let|var|val|final|auto|int|string|bool|mut|local|my|static|public|private)\s+)*[$@]?[A-Za-z_][\w.$\[\]>'\"-]*(?:\s*:\s*[\w<>\[\], .|&?]+)?\s*(?:=|\+=|-=|\*=|/=|\|\|=|:=|\?\?=|<<)\s*\S")
_CODE_CALL = re.compile(r"^\s*(?:await\s+|return\s+|print\s+|raise\s+|throw\s+|yield\s+|assert\s+|del\s+|defer\s+|go\s+|echo\s+|puts\s+|new\s+)?[$@&*]?[A-Za-z_][\w.$:>\-\[\]]*!?\s*\(.*\)\s*[;{:,]?\s*(?:do(?:\s*\|[^|]*\|)?)?$")
_CODE_HEAD = re.compile(r"^\s*(?:(?:if|elif|while|for|switch|catch|foreach|match|with|unless|until|when|case)\b.*[:{)]\s*$|(?:async\s+)?(?:def|fn|func|function|class|struct|impl|interface|enum)\s+[\w$.]+.*[:{(]\s*$|(?:import|from|use|using|require|include|package)\s+[\w.:/'\"{*]+(?:\s+(?:import|from|as)\b.*)?;?\s*$|(?:return|break|continue|pass|throw|raise|yield|else|try|end|do|finally|ensure|rescue)\s*[\w$.]*\s*[;:{]?\s*$|@[\w.]+\(.*\)$)")


_OPENING, _CLOSING, _STAR, _LINE_MARK = (re.compile(x) for x in (r"^/\*+!?<?", r"\**\*/\s*$", r"^\s*\*+(?:\s|$)|^\s*\*(?=\S)", r"^\s*(?://[/!]*<?|\#+[!:']?)\s?"))


def looks_like_code(line: str) -> bool:
    """A line of source that was commented out rather than prose."""
    return bool(line.strip()) and bool(_CODE_END.search(line) or _CODE_ASSIGN.match(line) or _CODE_CALL.match(line) or _CODE_HEAD.match(line))


def strip_marks(comment: str) -> list[str]:
    """Lines of one comment without its marks."""
    text = comment.strip()
    if text.startswith("/*"):
        text = _OPENING.sub("", text)
        text = _CLOSING.sub("", text)
        return [_STAR.sub("", x, count=1) for x in text.split("\n")]
    if text.startswith("=begin"):
        return text.split("\n")[1:-1]
    return [_LINE_MARK.sub("", x, count=1) for x in text.split("\n")]


def prose(lines: list[str]) -> str:
    """The describing part of documentation lines."""
    text = _XML_SECTION.sub("\n", "\n".join(lines))
    out: list[str] = []
    section, depth = "", 0
    fence = False
    for raw in text.split("\n"):
        line = raw.rstrip()
        body = line.strip()
        if body.startswith("```") or body.startswith("~~~"):
            fence = not fence
            continue
        if fence:
            continue
        if not body:
            if section == "tag" or section == "head" and depth:
                section = ""
            out.append("")
            continue
        if _DESCRIBING.match(line):
            section = ""
            out.append(_DESCRIBING.sub("", line).strip())
            continue
        if _TAG.match(line):
            section = "tag"
            continue
        if _SECTION.match(line) and (body[-1] in ":*" or body[0] in "#*" or len(body.split()) == 1):
            section, depth = "head", 0
            indent = len(line) - len(line.lstrip())
            continue
        if section == "head":
            if depth == 0 or re.match(r"^\s*(?:-{3,}|={3,})\s*$", line):
                depth += 1
                continue
            if len(line) - len(line.lstrip()) > indent or re.match(r"^\s*[-*`]|^\s*\w+\s*(?:\([^)]*\))?\s*:", line):
                continue
            section = ""
        if section == "tag":
            continue
        if _DIRECTIVE.match(body) or looks_like_code(_XML_TAG.sub(" ", line)):
            continue
        out.append(_XML_TAG.sub(" ", line).strip())
    return re.sub(r"[ \t]+", " ", "\n".join(out)).strip()


def word_count(text: str) -> int:
    """Words of a description; in scripts without spaces two characters count as a word."""
    return len(_WORD.findall(_CJK.sub(" ", text))) + len(_CJK.findall(text)) // 2


def description(comments, docstring: str | None) -> str:
    """Describing text of the comment block above a declaration and its docstring."""
    lines: list[str] = []
    for comment in comments or ():
        lines += strip_marks(comment)
    above = prose(lines) if lines else ""
    if docstring:
        return prose(docstring.split("\n")) or above
    return above
