"""Credentials in source code and configuration: where their values begin, and the text with the values blanked.

A keyword automaton picks the lines that can hold a credential, and the literals that can begin a
split one; issuer formats and key names find the value there; check digits, structure and
placeholder tests decide; a value's placeholder keeps its length, its alphabet and its issuer's prefix.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import clean_path
from .common import language_expr
from .lexer import CODE_LANGUAGES, clean

# issuers' token formats. Each begins with a literal that the automaton knows.
ISSUERS = {
    "aws_key_id": r"(?:AKIA|ASIA|AROA|AIDA)[A-Z2-7]{16}",
    "github": r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,}",
    "gitlab": r"(?:glpat|gldt|glrt|glsa|glft|glcbt)-[A-Za-z0-9_-]{20,}",
    "slack": r"xox[abeoprs]-[A-Za-z0-9-]{10,}|xapp-\d-[A-Za-z0-9-]{20,}",
    "stripe": r"(?:sk|rk|pk)_(?:live|test|prod)_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9+/=]{24,}",
    "openai_style": r"sk-(?:proj-|ant-[a-z0-9]+-)?[A-Za-z0-9_-]{20,}",
    "google": r"AIza[A-Za-z0-9_-]{35}|ya29\.[A-Za-z0-9_-]{20,}|GOCSPX-[A-Za-z0-9_-]{28}",
    "sendgrid": r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{32,}",
    "npm": r"npm_[A-Za-z0-9]{36}",
    "pypi": r"pypi-[A-Za-z0-9_-]{50,}",
    "huggingface": r"hf_[A-Za-z0-9]{30,}",
    "digitalocean": r"do[opr]_v1_[a-f0-9]{64}",
    "shopify": r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}",
    "square": r"sq0(?:atp|csp)-[A-Za-z0-9_-]{22,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{10,}",
}
# Words of the rules below. Every alternative of _STRONG holds one of the key words.
_WEAK_WORDS = ["token", "secret", "auth", "key", "pass", "pw"]
_COMMANDS = ["mysql", "mysqldump", "psql", "sshpass", "redis-cli", "wget", "docker login"]
# Substrings, in lower case, without which a line holds no credential.
KEYWORDS = [
    "akia", "asia", "aroa", "aida", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "gldt-", "glrt-", "glsa-", "glft-", "glcbt-",
    "xox", "xapp-", "sk_", "rk_", "pk_", "whsec_", "sk-", "aiza", "ya29.", "gocspx-", "sg.", "npm_", "pypi-", "hf_", "doo_v1_", "dop_v1_", "dor_v1_",
    "shpat_", "shpca_", "shppa_", "shpss_", "sq0", "eyj", "://", "bearer", "basic", "credential", "curl", *_WEAK_WORDS, *_COMMANDS,
]
# Quoted beginnings of tokens that stand in two literals: "glpat-" + "...".
_SPLIT = ["akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat", "xox", "sk", "rk", "sg", "npm", "hf", "aiza", "eyj"]
_ISSUER = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in ISSUERS.items()) + r")(?![A-Za-z0-9_])")
_WHOLE_ISSUER = re.compile("|".join(f"(?:{v})" for v in ISSUERS.values()))

# A key name ends in one of these words; what follows them (label, policy, limit ...) makes another thing of it.
_STRONG = (
    r"(?:auth|access|refresh|bearer|api|bot|deploy|deployment|personal|oauth|user|service|admin|vault|github|gitlab|slack|npm|push|webhook)[_-]?token"
    r"|(?:client|signing|webhook|app|application|consumer|shared|api|auth|oauth|jwt|session|cookie|db|hmac|storage|admin|user)[_-]?secret(?:[_-]?key)?"
    r"|secret[_-]?(?:access[_-]?)?key|access[_-]?key(?:[_-]?id)?|api[_-]?key|private[_-]?key|encryption[_-]?key|signing[_-]?key|master[_-]?key|account[_-]?key|storage[_-]?key|deploy[_-]?key"
    r"|passw(?:or)?d|passwd|pwd|passphrase|passcode|credentials?|secret[_-]?token"
)
_WEAK = "|".join(_WEAK_WORDS)
_NAME = rf"[A-Za-z0-9_.\-]{{0,80}}?(?:(?P<strong>{_STRONG})|(?<![A-Za-z0-9])(?P<weak>{_WEAK}))"
_LITERAL = r"""(?P<q>"{3}|'{3}|["'`])(?P<v>(?:(?!(?P=q))(?:[^\\\n]|\\.))*)(?P=q)"""
_ASSIGN = r"(?:\s*\)?\s*(?:=>|:=|\|\|=|\?\?=|==?|:|,)\s*(?:[A-Za-z_<>\[\]]{0,30}\s*=\s*)?|\s+)"
_SIGIL = r"(?:[&*]|(?:[rbufRBUF]{1,2}|@\$?|\$)(?=[\"'])|String::from\(|new\s+String\(|\(\s*)*"
_QUOTED = re.compile(rf"(?<![A-Za-z0-9])(?P<o>[\"'`]?){_NAME}(?P=o)[\"'`]?\s*\]?(?:\s*:\s*(?:&?(?:'static\s+)?[A-Za-z_][\w<>\[\]. |?]{{0,30}}))?{_ASSIGN}{_SIGIL}{_LITERAL}", re.I)
_NEXT_LINE = re.compile(rf"(?<![A-Za-z0-9]){_NAME}[\"'`]?\s*\]?\s*(?:=>|:=|=|:|\()\s*(?:\(|\\)?\s*$", re.I)
_LEADING = re.compile(rf"^\s*{_SIGIL}{_LITERAL}")
_BARE = re.compile(rf"(?<![A-Za-z0-9]){_NAME}[\"']?\s*[=:]\s*(?P<v>[^\s\"'`,;#][^\s,;]*)", re.I)
_BARE_LINE = re.compile(rf"^\s*(?:export\s+|ENV\s+|ARG\s+|set\s+|-\s+)?[\"']?{_NAME}[\"']?(?:\s*[=:]\s*|\s+)(?P<v>[^\s\"'].*?)\s*$", re.I)
_BLOCK_SCALAR = re.compile(rf"^\s*(?:-\s+)?[\"']?{_NAME}[\"']?\s*:\s*[|>][-+]?\s*$", re.I)
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://(?P<u>[^\s/:@\"'`<>]*):(?P<v>[^\s/@\"'`<>]+)@")
_HEADER = re.compile(r"(?:\bBearer|\bBasic|\bToken)\s+(?P<v>[A-Za-z0-9\-._~+/]{8,}=*)", re.I)
_HEADER_KEY = re.compile(r"(?:authorization|x-[a-z-]*(?:key|token|auth))[\"']?\s*[:=,]\s*[\"']?(?:(?:Bearer|Basic|Token)\s+)?(?P<v>[A-Za-z0-9\-._~+/]{16,}=*)", re.I)
_COMMAND = re.compile(r"(?:\bcurl\b[^\n]*?\s(?:-u|--user)[ =]?[\"']?[^\s:\"']*:(?P<a>[^\s\"']+)|\b(?:" + "|".join(_COMMANDS) + r")\b[^\n]*?\s(?:-p(?!\s|assword|ort)|--password[= ]|--pass[= ]|-a )[\"']?(?P<b>[^\s\"']{4,})|\s--?(?:password|passwd|token|api-key|secret)[= ][\"']?(?P<c>[^\s\"']{4,}))")
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_COMMENT_LINE = re.compile(r"(?:^|\s)(?://|#|/\*|\*|--|;|<!--|rem\b)", re.I)
_PAIR = re.compile(r"(?P<q>[\"'`])(?P<a>(?:(?!(?P=q))[^\\\n]|\\.)+)(?P=q)\s*(?:\+|\.|,|\\|&|<<|\|\||~|\n)?\s*\n?\s*(?:\+|\.|&|<<)?\s*(?P<q2>[\"'`])(?P<b>(?:(?!(?P=q2))[^\\\n]|\\.)+)(?P=q2)")

# Words that stand for a value rather than being one.
_PLACEHOLDER = re.compile(
    r"""^(?:|null|nil|none|undefined|true|false|todo|tbd|n/?a|empty|unset|default|string|str|text|value|password|passwd|secret|token|key|api[_-]?key|dummy|example|sample|test|testing|foo|bar|baz|foobar|fake|mock|redacted|masked|hidden|censored|removed|placeholder|required|optional|
      change[_-]?(?:me|it|this).*|replace[_-]?(?:me|this|with).*|fill[_-]?(?:me|in).*|insert[_-]?.*(?:here)?|your[_-].*|my[_-]?(?:password|secret|token|api[_-]?key)|(?:some|a|the)[_-]?(?:password|secret|token|key)|.*[_-]here|put[_-].*|enter[_-].*|to[_-]?be[_-].*|xxx+.*|
      .*EXAMPLE(?:KEY)?|.*(?:placeholder|redacted|changeme).*|[x*.#_\-=?•0]+|\.{2,}|(?P<c>.)(?P=c)*)$""",
    re.I | re.X,
)
_REFERENCE = re.compile(
    r"""^(?:\$\{.*|\$\(.*|\$[A-Za-z_]\w*$|%[A-Za-z_]\w*%$|%\(.*|%[sdv]$|\{\{.*|\{[^{}]*\}$|<[^<>]*>$|\[[^\[\]]*\]$|@[A-Za-z]+\(.*|\#\{.*|(?:process\.env|os\.environ|env|ENV|System\.getenv|getenv|os\.Getenv|Environment|std::env|config|settings|secrets|vault|vars|var|local|data|module|params|process|self|this|request|options|opts|args|ctx|app)[.:\[(].*|
      (?:vault|arn|secret|secretsmanager|ssm|gcp|azure|kms|op|aws|keyvault|keychain|file|env|ref|sops)(?:://|:|\#).*|!\w+.*|ENC\[.*|\|[-+]?$|>[-+]?$|&\w+$|\*\w+$)""",
    re.I | re.X,
)
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
_IDENT = re.compile(r"[A-Za-z_]+(?:[._-][A-Za-z_]+)*$")


def _masked(v: str) -> bool:
    """A value that ``blank`` has written: no other letters and digits than those of one of its alphabets."""
    m = _PREFIX.match(v)
    body = re.sub(r"(?<![A-Za-z0-9])eyJ|[^A-Za-z0-9]", "", v[m.end() if m else 0 :])
    return bool(re.fullmatch(r"[xX0]+|[aA0]{16,}|[A2]{12,}", body))


def _blankable(value: str) -> bool:
    """A value is present: no placeholder, mask, reference or text."""
    v = value.strip()
    if len(v) < 4 or _PLACEHOLDER.match(v) or _REFERENCE.match(v) or " " in v or "\t" in v:
        return False
    if _masked(v):
        return False
    core = re.sub(r"^[A-Za-z]{2,6}[_-]|^(?:AKIA|ASIA)", "", v)
    return not re.fullmatch(r"[xX*.0_\-]+", core or "x") and len(set(v)) > 2


def _secretish(v: str) -> bool:
    """For weak key names: long, mixed and no plain identifier."""
    return len(v) >= 16 and bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v)) and not _UUID.match(v) and not re.search(r"[/\\](?:var|usr|etc|home|opt)[/\\]|\.(?:ya?ml|json|txt|pem|key|crt|internal|example|com|org|test|invalid)\b", v) and not re.match(r"sha(?:1|256|384|512)[-:]", v, re.I) and not re.fullmatch(r"[0-9a-f]{32,128}", v)


def checksum(token: str) -> bool | None:
    """Whether a token's own check digits hold; None where its format has none."""
    m = re.match(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})$", token)
    if not m:
        return None
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    crc, digits = zlib.crc32(m[1].encode()), ""
    while crc:
        crc, r = divmod(crc, 62)
        digits = alphabet[r] + digits
    return digits.rjust(6, "0") == m[2]


def structure(kind: str, token: str) -> bool:
    """Structure of an issuer's token beyond its characters.

    Check digits that hold prove a token. Those that fail do not refute it, since a token of an older
    or self-hosted issue has none; it must then mix cases and digits as a random one does.
    """
    if _masked(token):
        return False
    proven = checksum(token)
    if proven is not None:
        body = token.split("_", 1)[1]
        return proven or len(set(body)) >= 10 and all(re.search(c, body) for c in ("[a-z]", "[A-Z]", "[0-9]")) and not re.search(r"EXAMPLE|(.)\1{7}", token)
    if kind == "jwt":
        head = token.split(".", 1)[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (ValueError, binascii.Error, TypeError):
            return False
    if kind == "stripe" and token.startswith("pk_"):
        return False
    body = re.sub(r"^[A-Za-z0-9]{2,10}[_-]", "", token)
    if kind == "aws_key_id":
        body = token[4:]
    elif kind in ("openai_style", "gitlab", "huggingface") and not re.search(r"\d", body):
        return False
    return len(set(body)) >= 5 and not re.search(r"EXAMPLE|(.)\1{7}", token)


# What issuers write before the random part of a token.
_PREFIX = re.compile(r"AKIA|ASIA|AROA|AIDA|gh[pousr]_|github_pat_|gl[a-z]{2,5}-|xox[abeoprs]-|xapp-\d-|(?:sk|rk|pk)_(?:live|test|prod)_|whsec_|sk-(?:proj-|ant-[a-z0-9]+-)?|AIza|ya29\.|GOCSPX-|SG\.|npm_|pypi-|hf_|do[opr]_v1_|shp(?:at|ca|pa|ss)_|sq0(?:atp|csp)-")
# The letters and the digit that stand for a value's, by its alphabet; the first alphabet that holds all its signs counts.
_ALPHABETS = (
    (re.compile(r"[0-9]+$"), "xX0"),
    (re.compile(r"[0-9a-f]+$"), "aA0"),
    (re.compile(r"[0-9A-F]+$"), "aA0"),
    (re.compile(r"[A-Z2-7]+=*$"), "xA2"),
)
_KEPT = re.compile(r"(\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)|%[0-9a-fA-F]{2}|(?<![A-Za-z0-9])eyJ)|[a-z]|[A-Z]|[0-9]")


def blank(value: str) -> str:
    """Same length, same alphabet: an issuer's prefix, escapes and signs stay, letters and digits become one letter and digit of the value's own alphabet (hexadecimal, base32, else any)."""
    prefix = _PREFIX.match(value)
    at = prefix.end() if prefix else 0
    body = value[at:]
    low, up, digit = next((signs for p, signs in _ALPHABETS if p.match(body)), "xX0")
    return value[:at] + _KEPT.sub(lambda m: m[1] or (digit if m[0].isdigit() else low if m[0].islower() else up), body)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in KEYWORDS:
        a.add_word(word, 0)
    for word in _SPLIT:
        for quote in "\"'`":
            a.add_word(quote + word, len(word) + 1)
    a.make_automaton()
    return a


def _pem(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _BEGIN.finditer(text):
        end = _END.search(text, m.end())
        stop = end.start() if end else len(text)
        nxt = _BEGIN.search(text, m.end())
        if nxt and nxt.start() < stop:
            stop = nxt.start()
        body = text[m.end() : stop]
        if end is None:
            run = re.match(r"(?:[\s\"'`+\\.,;()>|*#/-]|\\n|[A-Za-z0-9+/=]{4,})*", body)
            body = run.group()
        letters = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", body)
        if len(letters) >= 24 and len(set(letters)) >= 10 and not _PLACEHOLDER.match(letters):
            out.append((m.start(), m.end() + len(body), "private_key"))
    return out


def find(text: str, language: str | None) -> list[tuple[int, int, int, str]]:
    """(begin, value start, value end, kind) of each credential, in order and without overlaps.

    ``begin`` is the offset that counts as the place. Empty texts give nothing.
    """
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    lines: set[int] = set()
    starts = [0]
    at = text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    pairs = []
    for end, size in _automaton().iter(low):
        if size:
            m = _PAIR.match(text, end - size + 1)
            if m:
                pairs.append(m)
        else:
            lines.add(bisect_right(starts, end) - 1)
    if not lines and not pairs:
        return []
    code = language in CODE_LANGUAGES
    found: list[tuple[int, int, int, str]] = []
    blocks = _pem(text) if "PRIVATE KEY" in text else []
    found += [(a, a, b, k) for a, b, k in blocks]
    for m in pairs:
        whole = m["a"] + m["b"]
        w = _WHOLE_ISSUER.fullmatch(whole)
        if w and not _WHOLE_ISSUER.fullmatch(m["a"]):
            kind = next(k for k, v in ISSUERS.items() if re.fullmatch(v, whole))
            if structure(kind, whole):
                found.append((m.start("a"), m.start("a"), m.end("a"), kind))
                found.append((-1, m.start("b"), m.end("b"), kind))
    for number in sorted(lines):
        begin = starts[number]
        stop = starts[number + 1] - 1 if number + 1 < len(starts) else len(text)
        line = text[begin:stop]
        if any(a <= begin and stop <= b for a, b, _ in blocks):
            continue
        hits: list[tuple[int, int, str]] = []
        joined: list[tuple[int, int, int, str]] = []  # further literals of a value
        for m in _ISSUER.finditer(line):
            if structure(m.lastgroup, m.group()) and not _PLACEHOLDER.match(m.group()):
                hits.append((m.start(), m.end(), m.lastgroup))
        for m in _URL.finditer(line):
            if _blankable(m["v"]):
                hits.append((*m.span("v"), "url_password"))
        for m in _HEADER.finditer(line):
            if _blankable(m["v"]) and (re.search(r"\d", m["v"]) or len(m["v"]) >= 24) and not _IDENT.match(m["v"]):
                hits.append((*m.span("v"), "header"))
        for m in _HEADER_KEY.finditer(line):
            if _blankable(m["v"]) and _secretish(m["v"]):
                hits.append((*m.span("v"), "header"))
        for m in _COMMAND.finditer(line):
            g = next(k for k in "abc" if m[k] is not None)
            if _blankable(m[g]):
                hits.append((*m.span(g), "command"))
        for m in _QUOTED.finditer(line):
            v = m["v"]
            if "-----BEGIN" in v or not _blankable(v) or "://" in v:
                continue
            if m["strong"] or _secretish(v):
                joined += _continued(text, begin + m.end())
                if m["strong"] and code and _IDENT.match(v) and v.islower() and re.search(r"[_.-]", v) and len(v) < 40:
                    continue  # the name of a setting
                hits.append((*m.span("v"), "assignment"))
        comment = _COMMENT_LINE.search(line) if code else None
        if not code and language not in ("markdown", None) or language is None:
            m = _BARE_LINE.match(line)
            if m and not line.lstrip().startswith(("#", ";", "//")):
                v = re.sub(r"\s+[#;].*$", "", m["v"]).rstrip(",;")
                if _blankable(v) and "://" not in v and (m["strong"] or _secretish(v)):
                    hits.append((m.start("v"), m.start("v") + len(v), "assignment"))
            elif line.lstrip().startswith(("#", ";", "//")):
                comment = _COMMENT_LINE.search(line)
        if comment:
            for m in _BARE.finditer(line, comment.start()):
                v = m["v"].rstrip(").,")
                if m["strong"] and len(v) >= 6 and _blankable(v) and "(" not in v and "://" not in v and not _IDENT.fullmatch(v) or m["strong"] and _mixed(v) and _blankable(v):
                    hits.append((m.start("v"), m.start("v") + len(v), "comment"))
        m = _BLOCK_SCALAR.match(line) if not code else None
        if m and number + 1 < len(starts):
            nxt = starts[number + 1]
            after = text[nxt : starts[number + 2] - 1 if number + 2 < len(starts) else len(text)]
            v = after.strip()
            if "-----BEGIN" not in v and _blankable(v) and (m["strong"] or _secretish(v)):
                place = nxt + after.index(v)
                found.append((place, place, place + len(v), "assignment"))
        m = _NEXT_LINE.search(line)
        if m and number + 1 < len(starts):
            nxt = starts[number + 1]
            after = text[nxt : starts[number + 2] - 1 if number + 2 < len(starts) else len(text)]
            lit = _LEADING.match(after)
            if lit and _blankable(lit["v"]) and "-----BEGIN" not in lit["v"] and (m["strong"] or _secretish(lit["v"])) and not re.match(r"\s*[:=]", after[lit.end() :]):
                found.append((nxt + lit.start("v"), nxt + lit.start("v"), nxt + lit.end("v"), "assignment"))
        found += [(begin + a, begin + a, begin + b, k) for a, b, k in hits] + joined
    if blocks == [] and "PRIVATE KEY" in text:
        end = _END.search(text)  # a block that began before this text
        if end and not _BEGIN.search(text[: end.start()]):
            run = re.search(r"(?:(?:^|\n)[ \t\"']*[A-Za-z0-9+/=]{20,}(?:\\n)?[\"'+, \t\\]*)+\s*$", text[: end.start()])
            if run:
                found.append((-1, run.start(), end.start(), "private_key"))
    found.sort(key=lambda x: (x[1], -x[2]))
    out: list[tuple[int, int, int, str]] = []
    for item in found:
        if out and item[1] < out[-1][2]:
            continue
        out.append(item)
    return out


_MORE = re.compile(r"""\s*(?:\+|\.(?!\w)|&|\\\n|\n)\s*(?:\\\n)?\s*(?:\+|\.|&)?\s*(?P<q>["'])(?P<v>(?:(?!(?P=q))[^\\\n]|\\.)+)(?P=q)(?!\s*[:=])""")


def _continued(text: str, at: int) -> list[tuple[int, int, int, str]]:
    """Spans of the literals that are joined to the one that ends at ``at``; they begin no value of their own."""
    out = []
    while m := _MORE.match(text, at):
        out.append((-1, *m.span("v"), "assignment"))
        at = m.end()
    return out


def _mixed(v: str) -> bool:
    return len(v) >= 8 and bool(re.search(r"[a-z][A-Z]", v)) and bool(re.search(r"[A-Z]{2}|\d", v))


def redact(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """``text`` with the values blanked; nothing else changes, so lines and columns stay."""
    out, last = [], 0
    for _, a, b, kind in spans:
        value = text[a:b]
        if kind == "private_key":
            value = re.sub(r"(-----(?:BEGIN|END)[^-\n]*-----)|((?:(?!-----).)+|\n)", lambda m: m[1] or blank(m[2]), value, flags=re.S)
        else:
            value = blank(value)
        out += [text[last:a], value]
        last = b
    out.append(text[last:])
    return "".join(out)


# Documents in Markdown are no code or configuration.
_OUT_OF_SCOPE = ("markdown",)


def _chunks(code_chunks: DataFrame) -> DataFrame:
    path = clean_path(F.col("filepath"))
    return code_chunks.where("id IS NOT NULL AND content IS NOT NULL AND content <> ''").select("id", "content", F.coalesce(F.col("startline"), F.lit(1)).alias("startline"), path.alias("filepath"), language_expr(F.col("language"), path).alias("language"))


def locate(code_chunks: DataFrame) -> DataFrame:
    """(id, line, kind): chunk and file line on which each credential's value begins; one row per chunk, line and kind.

    A null ``startline`` counts as 1; null ids, null contents and Markdown give nothing.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, lines, kinds = [], [], []
            for i, content, start, lang in zip(pdf["id"], pdf["content"], pdf["startline"], pdf["language"], strict=True):
                text = clean(content)
                for begin, _, _, kind in find(text, lang):
                    if begin >= 0:
                        ids.append(i)
                        lines.append(int(start) + text.count("\n", 0, begin))
                        kinds.append(kind)
            if ids:
                yield pd.DataFrame({"id": ids, "line": pd.Series(lines, dtype="int32"), "kind": kinds})

    rows = _chunks(code_chunks).where(~F.coalesce(F.col("language"), F.lit("")).isin(*_OUT_OF_SCOPE))
    return rows.select("id", "content", "startline", "language").mapInPandas(scan, "id string, line int, kind string").distinct()


def redacted(code_chunks: DataFrame) -> DataFrame:
    """(id, content, n_credentials): every chunk id once, its content with credential values blanked.

    Of repeated ids the row with the latest ``indexed_at`` counts. Null contents stay null.
    """
    latest = code_chunks.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("indexed_at", "content", "filepath", "language")).alias("r"))
    path = clean_path(F.col("r.filepath"))
    rows = latest.select("id", F.col("r.content").alias("content"), language_expr(F.col("r.language"), path).alias("language"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, counts = [], []
            for content, lang in zip(pdf["content"], pdf["language"], strict=True):
                if not isinstance(content, str):
                    texts.append(None)
                    counts.append(0)
                    continue
                spans = [] if lang in _OUT_OF_SCOPE else find(content, lang)
                texts.append(redact(content, spans) if spans else content)
                counts.append(sum(s[0] >= 0 for s in spans))
            yield pd.DataFrame({"id": pdf["id"].to_list(), "content": texts, "n_credentials": pd.Series(counts, dtype="int32")})

    return rows.mapInPandas(scan, "id string, content string, n_credentials int")
