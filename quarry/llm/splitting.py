"""Oversized items cut into overlapping pieces at natural boundaries.

Offsets of lines and tokens are prefix sums; the boundaries of each rank (declaration or
heading, section, blank line, line, token) form a sorted array, in which binary search finds the last
one under the limit; the next piece begins ``overlap`` characters before the cut. ``natural_cuts``
reports the first rank of the same arrays.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import clean_path, clean_text
from .common import language_expr
from .declare import declarations, markdown_headings
from .lexer import CODE_LANGUAGES

_TOKEN = re.compile(r"\w+|[^\w\s]|\s+")
# Lines that begin a section in languages without a declaration scanner; a second choice behind declarations and headings.
_SECTIONS = {
    "yaml": re.compile(r"---|[^\s#\-][^\n]*:(?:\s|$)"),
    "toml": re.compile(r"\[{1,2}[^\]]+\]"),
    "ini": re.compile(r"\[[^\]]+\]"),
    "dockerfile": re.compile(r"FROM\s", re.I),
    "json": re.compile(r"(?:\t|  ?(?:  )?)?[\"{\[]"),
    "html": re.compile(r"\s*<(?:h[1-6]|section|article|div|table|body|head)\b", re.I),
    "css": re.compile(r"[^\s}@/*][^\n]*\{|@\w"),
    "sql": re.compile(r"(?:create|alter|drop|insert|update|delete|select|with)\s", re.I),
    "bash": re.compile(r"(?:function\s+)?[A-Za-z_]\w*\s*\(\)|function\s"),
}
# Declarations at the start of a line in languages of the C family, Kotlin, Scala, Swift and others without a scanner.
_DECLARES = re.compile(r"(?:(?:public|private|protected|internal|open|final|abstract|sealed|data|static|inline|override|export|extern|virtual|case|implicit|@\w+)\s+)*(?:fun|func|def|class|struct|interface|trait|object|enum|extension|protocol|namespace|module|type|union|template|impl|sub|proc)\b")


def cut_lines(text: str, language: str | None) -> list[int]:
    """1-based lines, beyond the first, on which a declaration with its comments and annotations or a heading begins."""
    if language == "markdown":
        found = markdown_headings(text)
    elif language in CODE_LANGUAGES:
        found = [d.first_line for d in declarations(text, language)]
    else:
        found = []
    return sorted({x for x in found if x > 1})


def section_lines(text: str, language: str | None) -> list[int]:
    """1-based lines, beyond the first, on which a section of a language without declarations begins."""
    if language == "markdown" or language in CODE_LANGUAGES:
        return []
    pattern = _SECTIONS.get(language or "")
    begins = pattern.match if pattern else _declares
    return [k for k, line in enumerate(text.split("\n"), 1) if k > 1 and begins(line)]


def _declares(line: str) -> bool:
    """A declaring word, or a function header of the C family, at the start of a line."""
    return bool(_DECLARES.match(line)) or (line[:1].isalpha() or line[:1] == "_") and line.rstrip().endswith("{") and "(" in line and ";" not in line


class Boundaries:
    """Sorted offsets of a text's boundaries, one array a rank; token offsets are summed only when they are asked for."""

    def __init__(self, text: str, language: str | None):
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.natural = self._offsets(cut_lines(text, language))
        self.sections = self._offsets(section_lines(text, language))
        self._blank: list[int] | None = None
        self._tokens: list[int] | None = None

    def _offsets(self, numbers: list[int]) -> list[int]:
        return [self.lines[k - 1] for k in numbers if k <= len(self.lines)]

    def line(self, offset: int) -> int:
        """1-based line of an offset."""
        return bisect_right(self.lines, offset)

    @property
    def blank(self) -> list[int]:
        if self._blank is None:
            self._blank = [b for a, b in zip(self.lines, self.lines[1:], strict=False) if not self.text[a:b].strip()]
        return self._blank

    @property
    def tokens(self) -> list[int]:
        if self._tokens is None:
            self._tokens = [m.end() for m in _TOKEN.finditer(self.text)]
        return self._tokens

    def last(self, limit: int, least: int, half: int) -> tuple[str, int]:
        """The last boundary of the best rank in (least, limit], or a hard cut.

        A section or blank line that wastes more than half of the piece is no better than a later line.
        """
        for kind, bounds, low in (("natural", self.natural, least), ("section", self.sections, max(least, half)), ("blank line", None, max(least, half)), ("line", self.lines, least), ("token", None, least)):
            bounds = (self.blank if kind == "blank line" else self.tokens) if bounds is None else bounds
            k = bisect_right(bounds, limit) - 1
            if k >= 0 and bounds[k] > low:
                return kind, bounds[k]
        return "hard", _safe(self.text, limit, least)


def _safe(text: str, at: int, low: int) -> int:
    """No cut inside a base character and its marks."""
    while at > low + 1 and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "\u200d\ufe0f"):
        at -= 1
    return at


def pieces(text: str, language: str | None, size: int, overlap: int, known: Boundaries | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of each piece: no longer than ``size``, overlapping by ``overlap``.

    The text itself if it fits. ``size`` is at least 1; an overlap that leaves no progress is cut to ``size - 1``.
    """
    n, size = len(text), max(1, size)
    overlap = max(0, min(overlap, size - 1))
    if n <= size:
        return [(0, n, "end")] if n else []
    known = known or Boundaries(text, language)
    out, start = [], 0
    while n - start > size:
        kind, cut = known.last(start + size, start + overlap, start + size // 2)
        out.append((start, cut, kind))
        start = cut - overlap
    out.append((start, n, "end"))
    return out


def oversized(code_chunks: DataFrame, parse_options: DataFrame) -> DataFrame:
    """(id, filepath, language, content, startline, chunksize, chunkoverlap): each chunk over its language's limit, once.

    Of repeated ids the latest row counts, of equally late ones the longest and of these that of the
    greatest hash; a chunk whose latest row fits gives nothing, however long older ones were.
    Languages that aren't listed take the row ``*``, without one 1000 and 200. The options are a fixed
    table of a few rows. Which row is the latest is found on keys; only oversized contents are shuffled.
    """
    options = parse_options.where("language IS NOT NULL").groupBy(F.lower(F.trim("language")).alias("option")).agg(F.max("chunksize").alias("size"), F.max("chunkoverlap").alias("overlap")).collect()
    path = clean_path(F.col("filepath"))
    rows = code_chunks.where("id IS NOT NULL AND content IS NOT NULL").select("id", "indexed_at", path.alias("filepath"), language_expr(F.col("language"), path).alias("language"), clean_text(F.col("content")).alias("content"), F.coalesce("startline", F.lit(1)).alias("startline"))

    def option(field: str, default: int) -> Column:
        known = {r["option"]: r[field] for r in options if r[field] is not None}
        value = F.lit(known.pop("*", default))
        for name, number in known.items():
            value = F.when(F.col("language") == name, number).otherwise(value)
        return value.cast("int")

    every = rows.withColumn("h", F.xxhash64("indexed_at", "filepath", "language", "content", "startline")).withColumn("chunksize", option("size", 1000))
    over = every.where(F.length("content") > F.col("chunksize")).withColumn("chunkoverlap", option("overlap", 200))
    latest = every.groupBy("id").agg(F.max(F.struct("indexed_at", F.length("content").alias("n"), "h")).alias("r")).select("id", F.col("r.h").alias("h"))
    return over.join(latest, ["id", "h"], "left_semi").dropDuplicates(["id"]).select("id", "filepath", "language", "content", "startline", "chunksize", "chunkoverlap")


def split(code_chunks: DataFrame, parse_options: DataFrame) -> DataFrame:
    """(id, piece, startline, endline, start_char, end_char, cut, content) of every oversized chunk.

    ``startline`` and ``endline`` are lines of the file; a piece's last line is the one its last character is on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, lang, first, size, overlap in zip(pdf["id"], pdf["content"], pdf["language"], pdf["startline"], pdf["chunksize"], pdf["chunkoverlap"], strict=True):
                known = Boundaries(text, lang)
                for k, (a, b, kind) in enumerate(pieces(text, lang, int(size), int(overlap), known)):
                    rows.append((i, k, int(first) + known.line(a) - 1, int(first) + max(bisect_left(known.lines, b) - 1, 0), a, b, kind, text[a:b]))
            yield pd.DataFrame(rows, columns=["id", "piece", "startline", "endline", "start_char", "end_char", "cut", "content"])

    return oversized(code_chunks, parse_options).mapInPandas(run, "id string, piece int, startline int, endline int, start_char int, end_char int, cut string, content string")


def natural_cuts(code_chunks: DataFrame, parse_options: DataFrame) -> DataFrame:
    """(id, line): the natural boundaries, as lines of the file, among which ``split`` chooses its cuts of oversized chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, lines = [], []
            for i, text, lang, first in zip(pdf["id"], pdf["content"], pdf["language"], pdf["startline"], strict=True):
                known = Boundaries(text, lang)
                ids += [i] * len(known.natural)
                lines += [int(first) + known.line(x) - 1 for x in known.natural]
            if ids:
                yield pd.DataFrame({"id": ids, "line": pd.Series(lines, dtype="int32")})

    return oversized(code_chunks, parse_options).select("id", "content", "language", "startline").mapInPandas(run, "id string, line int")
