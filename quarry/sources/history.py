"""Captured version-control output as tables: status, history, changes of a revision, blame. Every captured text is one row (key, text)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_path
from ..operators.extract import table_function

_BLAME = re.compile(r"([a-f0-9]{7,40}) \d+ (\d+)", re.I)


def status_kind(index: Column, worktree: Column) -> Column:
    """Kind of a change by the two letters of a status line; the first that applies counts."""
    code = F.concat(index, worktree)
    return F.when(code.contains("?") | code.contains("A"), "added").when(code.contains("D"), "deleted").when(code.contains("R"), "renamed").when(code.contains("M"), "modified").otherwise("unknown")


def revision_kind(code: Column) -> Column:
    """Kind of a change by the first letter of a name-status code."""
    first = F.substring(code, 1, 1)
    return F.when(first.isin("A", "C"), "added").when(first == "D", "deleted").when(first == "R", "renamed").when(first.isin("M", "T"), "modified").otherwise("unknown")


def safe_path(path: Column) -> Column:
    """A relative path without a step up, a drive or a control character."""
    return (F.length(path) > 0) & ~path.rlike(r"^/|^[A-Za-z]:|(?:^|/)\.\.(?:/|$)|[\x00-\x1f]")


def status(texts: DataFrame) -> DataFrame:
    """(key, path, index, worktree, kind, staged, untracked) of NUL-separated status output; entries of fewer than three characters go."""
    e = texts.select("key", F.explode(F.split("text", "\0")).alias("e")).where(F.length("e") >= 3)
    i, w = F.substring("e", 1, 1), F.substring("e", 2, 1)
    return e.select("key", normal_path(F.substring("e", 4, 1 << 16)).alias("path"), i.alias("index"), w.alias("worktree"), status_kind(i, w).alias("kind"), ((i != " ") & (i != "?")).alias("staged"), ((i == "?") & (w == "?")).alias("untracked"))


def history(texts: DataFrame) -> DataFrame:
    """(key, place, commit, author, date, subject) of NUL-separated logs, four fields an entry; empty fields are no fields, a last entry that is not whole goes."""
    fields = texts.select("key", F.filter(F.split("text", "\0"), lambda x: x != "").alias("f"))
    whole = F.floor(F.size("f") / 4).cast("int")
    rows = fields.where(whole > 0).select("key", "f", F.explode(F.sequence(F.lit(0), whole - 1)).alias("place"))
    part = lambda k: F.element_at("f", F.col("place") * 4 + k + 1)
    return rows.select("key", "place", part(0).alias("commit"), part(1).alias("author"), part(2).alias("date"), part(3).alias("subject"))


def _changes(text: str) -> list[tuple[str, str | None, str]]:
    fields, out, k = [f for f in text.split("\0") if f], [], 0
    while k + 1 < len(fields):
        code, two = fields[k], fields[k][:1] in "RC"
        if two and k + 2 >= len(fields):
            break
        out.append((fields[k + 2], fields[k + 1], code) if two else (fields[k + 1], None, code))
        k += 3 if two else 2
    return out


def revision_changes(texts: DataFrame) -> DataFrame:
    """(key, path, old_path, kind) of NUL-separated name-status output; renames and copies have two paths, entries with an unsafe path go."""
    rows = table_function(texts, "key", "text", _changes, "path string, old_path string, code string")
    rows = rows.withColumn("path", normal_path(F.col("path"))).withColumn("old_path", normal_path(F.col("old_path")))
    return rows.where(safe_path(F.col("path")) & (F.col("old_path").isNull() | safe_path(F.col("old_path")))).select("key", "path", "old_path", revision_kind(F.col("code")).alias("kind"))


def _blame(text: str) -> list[tuple[int, str, str | None, str | None, str | None]]:
    out: list[list] = []
    for line in text.split("\n"):
        m = _BLAME.match(line)
        if m:
            out.append([int(m[2]), m[1], None, None, None])
        elif out:
            for k, word in enumerate(("author ", "author-time ", "summary "), 2):
                if line.startswith(word):
                    out[-1][k] = line[len(word) :]
    return [tuple(x) for x in out]


def blame(texts: DataFrame, most: int = 10_000) -> DataFrame:
    """(key, line, commit, author, date, summary) of line-porcelain output, at most ``most`` lines a text."""
    return table_function(texts, "key", "text", _First(most), "line int, commit string, author string, date string, summary string")


class _First:
    """The first entries of a blame; a class, so that workers get it with its limit."""

    def __init__(self, most: int):
        self.most = most

    def __call__(self, text: str) -> list[tuple]:
        return _blame(text)[: self.most]
