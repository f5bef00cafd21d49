"""Column functions. All of them stay inside code generation except where a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII word boundary: Java's \b knows Unicode letters, the wanted one doesn't.
BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Token alphabets by use.
ALPHABETS = {"embedding": "[a-z0-9_]+", "search": "[a-z0-9_$]+", "memory": "[a-z0-9_$.-]+", "artifact": "[a-z0-9_$-]+", "focus": r"[\p{L}_$][\p{L}\p{N}_$-]{2,}"}


def split_camel(x: Column) -> Column:
    """A space between a lower-case letter or digit and the capital behind it."""
    return F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")


def tokens(x: Column, alphabet: str = "search") -> Column:
    """All tokens of the lower-cased text, repeats kept; null gives null."""
    return F.regexp_extract_all(F.lower(x), F.lit(f"({ALPHABETS[alphabet]})"), F.lit(1))


def distinct_tokens(x: Column, alphabet: str = "search") -> Column:
    """Each token once, in the order of first use."""
    return F.array_distinct(tokens(x, alphabet))


def quote_regex(x: Column) -> Column:
    """The text with every sign that means something in a regular expression escaped."""
    return F.regexp_replace(x, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def normal_path(x: Column) -> Column:
    """``\\`` as ``/`` and no leading ``./``."""
    return F.regexp_replace(F.translate(x, "\\", "/"), r"^\./", "")


def normal_newlines(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n?", "\n")


def line_count(x: Column) -> Column:
    """Lines of a text: one more than its line feeds."""
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1


def chunk_id(path: Column, line: Column, content: Column) -> Column:
    """``chunk_`` and 12 hexadecimal digits over ``path:line:content``."""
    return F.concat(F.lit("chunk_"), F.substring(F.md5(F.concat_ws(":", path, line.cast("string"), content)), 1, 12))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def project_id(path: Column) -> Column:
    return F.concat(F.lit("project-"), F.substring(F.sha2(path, 256), 1, 24))


def base64url(x: Column) -> Column:
    """Base64 in the URL alphabet without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(x, "UTF-8")), "+/", "-_"), F.lit("="))


def token_estimate(x: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(x) / 4).cast("long")


def truncate_utf8(x: Column, limit: int) -> Column:
    """The longest prefix of whole code points within ``limit`` bytes.

    The byte prefix is cut back over the continuation bytes of a broken last code point.
    """
    head = F.substring(F.encode(x, "UTF-8"), 1, limit)
    nxt = F.conv(F.hex(F.substring(F.encode(x, "UTF-8"), limit + 1, 1)), 16, 10).cast("int")
    # a continuation byte behind the limit means that the last code point is broken
    fits = F.octet_length(x) <= limit
    broken = F.coalesce((nxt >= 128) & (nxt < 192), F.lit(False))

    def back(n: int) -> Column:
        return F.substring(F.encode(x, "UTF-8"), 1, limit - n)

    def lead(n: int) -> Column:
        return F.conv(F.hex(F.substring(F.encode(x, "UTF-8"), limit - n + 1, 1)), 16, 10).cast("int") >= 192

    cut = F.when(~broken, head).when(lead(1), back(1)).when(lead(2), back(2)).otherwise(back(3))
    return F.when(fits, x).otherwise(F.decode(cut, "UTF-8"))


def byte_to_index(x: Column, offset: Column) -> Column:
    """Code points that fit wholly into the first ``offset`` bytes."""
    return F.length(F.regexp_replace(F.decode(F.substring(F.encode(x, "UTF-8"), F.lit(1), offset), "UTF-8"), "�+$", ""))


def line_column(x: Column, index: Column) -> tuple[Column, Column]:
    """1-based line and 0-based column of a 0-based character index."""
    head = F.substring(x, F.lit(1), index)
    return line_count(head), F.length(F.substring_index(head, "\n", -1))


# White space as scripts count it: that of Java's class, and the Unicode spaces.
SPACE = r"[\s\u000b\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def content_parts(content: Column) -> tuple[Column, Column, Column]:
    """(documentation, signature, body) of a chunk.

    Documentation are the comment lines before the first line of code; the signature is the code up to the
    first ``{`` or ``=>``, or without either its first line; the body the rest, or all of the code. A part
    that is empty is null, the body never.
    """
    lines = F.split(content, "\n", -1)
    remark = F.transform(lines, lambda x: x.rlike(rf"^{SPACE}*(?://|#|/\*|\*)") | (strip(x) == ""))
    first = F.coalesce(F.nullif(F.array_position(remark, F.lit(False)), F.lit(0)), F.size(lines) + 1).cast("int")
    doc = F.array_join(F.filter(F.slice(lines, F.lit(1), first - 1), lambda x: strip(x) != ""), "\n")
    code = F.array_join(F.slice(lines, first, F.size(lines)), "\n")
    brace, arrow = F.instr(code, "{"), F.instr(code, "=>")
    opening = F.when((brace > 0) & (arrow > 0), F.least(brace, arrow)).otherwise(F.greatest(brace, arrow))
    head = F.when(opening > 0, F.substring(code, F.lit(1), opening - 1)).otherwise(F.substring_index(code, "\n", 1))
    body = F.when(opening > 0, F.substring(code, opening, F.length(code))).otherwise(code)
    return F.nullif(doc, F.lit("")), F.nullif(strip(head), F.lit("")), strip(body)


def round6(x: Column) -> Column:
    return F.round(x, 6)


# Names whose value is a secret, marks of token formats, words that are types rather than values.
SECRET_KEY = "(?:api[_-]?key|access[_-]?token|auth(?:entication)?[_-]?token|authorization|client[_-]?secret|password|passwd|private[_-]?key|secret|token)"
PEM = r"-----BEGIN [^-]+-----[\s\S]*?-----END [^-]+-----"
BEARER = r"(?i)\bBearer[ \t]+[A-Za-z0-9._~+/-]{8,}={0,2}"
TOKEN = r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{20,})\b"
TYPE_WORD = r"(?:any|bigint|boolean|never|null|number|object|string|symbol|undefined|unknown|void)(?:\[\])?[?]?"


def redact(x: Column) -> Column:
    """Secrets masked in five passes: key blocks, bearer tokens, quoted values of secret names, unquoted ones that are no type, token formats."""
    left = rf"""((?:["']?(?<![A-Za-z0-9_]){SECRET_KEY}(?![A-Za-z0-9_])["']?)[ \t]*[:=][ \t]*)"""
    out = F.regexp_replace(x, PEM, "[REDACTED PEM BLOCK]")
    out = F.regexp_replace(out, BEARER, "Bearer [REDACTED TOKEN]")
    out = F.regexp_replace(out, rf"""(?i){left}(["'`])(?:\\.|[^\\\r\n])*?\2""", "$1$2[REDACTED]$2")
    value = r"""[^\s"'`,;}\r\n)]"""
    out = F.regexp_replace(out, rf"(?i){left}(?!{TYPE_WORD}(?!{value})){value}+", "$1[REDACTED]")
    return F.regexp_replace(out, TOKEN, "[REDACTED TOKEN]")


def redact_values(values: Column) -> Column:
    """A map of texts with the values of secret names masked whole, the others as texts are. A value that is masked already stays."""
    secret = lambda k: F.lower(k).rlike(f"^{SECRET_KEY}$")
    return F.transform_values(values, lambda k, v: F.when(secret(k) & v.isNotNull() & ~v.contains("[REDACTED"), "[REDACTED]").otherwise(redact(v)))


# Fixed value: what an absolute path looks like in a message.
ABSOLUTE_PATH = r"""(?:[A-Za-z]:[\\/]|(?:^|[\s("'`])/[^\s"'`)]*)"""


def scrub_error(x: Column, fallback: str) -> Column:
    """An error text, at most 500 characters; the fallback for one that holds an absolute path."""
    return F.when(x.rlike(ABSOLUTE_PATH), F.lit(fallback)).when(F.length(x) > 500, F.concat(F.substring(x, 1, 497), F.lit("..."))).otherwise(x)


# Phrases by which a text tries to steer its reader, with the confidence of each; in this order they are looked for.
INSTRUCTION_SIGNALS = {
    "instruction_override": (0.99, r"(?i)\b(?:ignore|disregard|forget|override|bypass|follow only)\b[\s\S]{0,140}\b(?:previous|prior|above|system|developer|assistant|safety|instruction|rule)s?\b"),
    "authority_spoofing": (0.96, r"(?im)(?:^|[\r\n])\s*(?:system|developer|assistant)\s*(?:message|prompt|instruction)\s*[:>]"),
    "tool_execution_request": (0.82, r"(?i)\b(?:call|invoke|use|run|execute)\b[\s\S]{0,100}\b(?:tool|function|command|shell|powershell|bash|terminal|script)\b"),
    "secret_exfiltration_request": (0.94, r"(?i)\b(?:send|upload|exfiltrate|reveal|print|dump|share|post|collect)\b[\s\S]{0,120}\b(?:secret|token|api[_ -]?key|password|credential|private\s+key|environment|\.env)\b"),
    "delimiter_spoofing": (0.91, r"(?i)<\s*/?\s*(?:system|tool_call|function_call|assistant|developer)\s*>|\[\s*(?:system|assistant|developer)\s*\]|```\s*(?:system|tool_call|function_call)\b"),
    "hidden_unicode": (0.90, r"[\u202A-\u202E\u2066-\u2069]"),
    "encoded_instruction": (0.78, r"(?i)\b(?:base64|atob|frombase64|decode|decode64)\b[\s\S]{0,100}\b(?:instruction|prompt|command|secret|token)\b"),
}


def signal_count(x: Column, name: str) -> Column:
    """Hits of one instruction signal."""
    return F.regexp_count(x, F.lit(INSTRUCTION_SIGNALS[name][1]))


# Kinds of project documents by name, the first that applies; ``adr`` looks at the whole path.
ARTIFACTS = [
    ("adr", r"(?:^|[-_])adr(?:[-_]|$)|(?:^|/)adr(?:/|$)"),
    ("specification", r"(?:spec|rfc|requirements?)"),
    ("plan", r"(?:plan|roadmap|proposal)"),
    ("runbook", r"(?:runbook|playbook|operations?|incident)"),
    ("security", r"(?:security|threat|vulnerability)"),
    ("changelog", r"(?:change|history|release|version)"),
    ("contributing", r"(?:contribut|development|getting-started)"),
]


def stem(path: Column) -> Column:
    """Last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def artifact_kind(path: Column) -> Column:
    """Kind of a project document by its path."""
    p = F.lower(normal_path(path))
    name = stem(p)
    out = F.when(name == "readme", "readme").when(name.contains("architecture") | (name == "design"), "architecture")
    for kind, pattern in ARTIFACTS:
        out = out.when((p if kind == "adr" else name).rlike(pattern), kind)
    return out.otherwise("documentation")


def markdown_title(x: Column) -> Column:
    """Text of the first level-1 heading without closing signs, or null."""
    return F.nullif(strip(F.regexp_extract(x, r"(?m)^\s*#\s+(.+?)\s*#?\s*$", 1)), F.lit(""))


def markdown_links(x: Column, limit: int = 50) -> Column:
    """Distinct link targets in order, at most ``limit``."""
    return F.slice(F.array_distinct(F.regexp_extract_all(x, F.lit(r"\[[^\]]+\]\(([^)\s]+)(?:\s+[^)]*)?\)"), F.lit(1))), 1, limit)


def change_kind(code: Column) -> Column:
    """Name of a change code of a version-control status; a null or unknown code is ``unknown``."""
    c = F.lower(F.trim(code))
    return F.when(c.isin("a", "add", "added"), "added").when(c.isin("m", "change", "modified"), "modified").when(c.isin("d", "unlink", "deleted"), "deleted").when(c.startswith("r"), "renamed").otherwise("unknown")


def snippet(x: Column, at: Column, before: int = 100, behind: int = 180) -> Column:
    """The surroundings of a 1-based position."""
    start = F.greatest(at - before, F.lit(1))
    return F.substring(x, start, at + behind - start)


def unsigned32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(4294967295))


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a of a text's code units (ASCII), as a long."""
    chars = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.ascii(F.substring(x, i, F.lit(1))))
    step = lambda h, c: unsigned32(unsigned32(h.bitwiseXOR(c.cast("long"))) * F.lit(16777619))
    return F.when(F.length(x) == 0, F.lit(2166136261)).otherwise(F.aggregate(chars, F.lit(2166136261), step))
