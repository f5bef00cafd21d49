"""File sources: scans of source trees, language detection, captured tool output as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .languages import base_name, indexable, language_of

# Names that are never read, folders that are never entered, budgets of a scan.
SENSITIVE = [r"^\.env(?:\..*)?$", r"^(?:credentials?|secrets?)(?:\.(?:json|ya?ml|toml|ini|txt|env|config))?$", r"(?:^|[._-])(?:id_rsa|id_ed25519)(?:[._-]|$)", r"\.(?:pem|key|p12|pfx|kdbx)$"]
EXCLUSIONS = ["node_modules", ".git", "dist", "build", ".src-index"]
MAX_FILES, MAX_BYTES, MAX_DEPTH = 100_000, 512 * 1024 * 1024, 128


def is_sensitive(path: Column) -> Column:
    """Names under which secrets are kept."""
    name = F.lower(base_name(path))
    out = F.lit(False)
    for pattern in SENSITIVE:
        out = out | name.rlike(pattern)
    return out


def is_hidden(path: Column) -> Column:
    """Some folder of the path begins with a dot; a file that does is read only if its language is known."""
    return path.rlike(r"(^|/)\.[^/]+/") | base_name(path).startswith(".") & ~indexable(path)


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regular expression over a path whose folders end in ``/``, whether it takes in again) of the lines of an ignore file, in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[1:] if back else line.removeprefix("\\")
        folder = line.endswith("/")
        line = line.rstrip("/")
        rooted = "/" in line
        line = line.lstrip("/")
        body, k = "", 0
        while k < len(line):
            if line.startswith("**/", k):
                body, k = body + "(?:.*/)?", k + 3
            elif line.startswith("/**", k) and k + 3 == len(line):
                body, k = body + "/.+", k + 3
            elif line[k] == "*":
                body, k = body + "[^/]*", k + 1
            elif line[k] == "?":
                body, k = body + "[^/]", k + 1
            elif line[k] == "[" and (end := line.find("]", k + 2)) > 0:
                body, k = body + "[" + line[k + 1 : end].replace("!", "^", 1) + "]", end + 1
            elif line[k] == "\\" and k + 1 < len(line):
                body, k = body + re.escape(line[k + 1]), k + 2
            else:
                body, k = body + re.escape(line[k]), k + 1
        if body:
            out.append(("^" + ("" if rooted else "(?:.*/)?") + body + ("/" if folder else "/?") + "$", back))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether rules leave a relative path out: the last rule that matches it or, first, a folder above it decides.

    What lies in a folder that is left out cannot be taken in again.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.when(k < F.size(parts), "/").otherwise("")))

    def left_out(p: Column) -> Column:
        out = F.lit(False)
        for pattern, back in rules:  # a later rule stands further out
            out = F.when(p.rlike(pattern), F.lit(not back)).otherwise(out)
        return out

    return F.exists(above, left_out) if rules else F.lit(False)


def scan_rules(gitignore: str = "", patterns: list[str] | None = None) -> list[tuple[str, bool]]:
    """The fixed exclusions, then the root's ignore file, then the caller's patterns."""
    return ignore_rules("\n".join([*EXCLUSIONS, gitignore, *(patterns or [])]))


def scan(spark: SparkSession, folder: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH, max_file: int = 1 << 20, patterns: list[str] | None = None) -> DataFrame:
    """(path, length, content, language) of the readable files below a folder.

    Left out are what the fixed exclusions, the folder's ``.gitignore`` and ``patterns`` name, hidden
    folders, sensitive names, unknown languages and too large files; a scan beyond a budget fails
    instead of being cut. The budget is taken from the listing, before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    relative = F.substring(path, len(folder.rstrip("/")) + 2, 1 << 16)
    own = files.where(relative == ".gitignore").select(F.decode("content", "UTF-8").alias("c")).first()
    kept = ~ignored(relative, scan_rules(own["c"] if own else "", patterns)) & ~is_sensitive(relative) & ~is_hidden(relative) & indexable(relative) & (F.col("length") <= max_file)
    listed = files.select(path.alias("path"), "length", "content", (F.size(F.split(relative, "/")) - 1).alias("depth"), kept.alias("kept")).where("kept")
    used = listed.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"), F.max("depth").alias("d")).first()
    if used["n"] > max_files or (used["b"] or 0) > max_bytes or (used["d"] or 0) > max_depth:
        raise ValueError(f"scan exceeds its budget: {used['n']} files, {used['b']} bytes, {used['d']} levels")
    return listed.select("path", "length", F.decode("content", "UTF-8").alias("content"), language_of(F.col("path")).alias("language"))


_SARIF = "array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"


def findings(raw: DataFrame) -> DataFrame:
    """(tool, rule, path, line, message) of captured analyser output (tool, payload); ast-grep counts lines from 0, the others from 1."""
    ast = raw.where("tool = 'ast-grep'").select("tool", F.explode(F.from_json("payload", "array<struct<ruleId:string,file:string,message:string,range:struct<start:struct<line:int>>>>")).alias("r")).select("tool", F.col("r.ruleId").alias("rule"), F.col("r.file").alias("path"), (F.col("r.range.start.line") + 1).alias("line"), F.col("r.message").alias("message"))
    sem = raw.where("tool = 'semgrep'").select("tool", F.explode(F.from_json("payload", "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<message:string>>>>")["results"]).alias("r")).select("tool", F.col("r.check_id").alias("rule"), F.col("r.path").alias("path"), F.col("r.start.line").alias("line"), F.col("r.extra.message").alias("message"))
    runs = raw.where("tool = 'sarif'").select(F.explode(F.from_json("payload", f"struct<runs:{_SARIF}>")["runs"]).alias("run")).select(F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("r"))
    sarif = runs.select("tool", F.col("r.ruleId").alias("rule"), F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("path"), F.col("r.locations")[0]["physicalLocation"]["region"]["startLine"].alias("line"), F.col("r.message.text").alias("message"))
    return ast.unionByName(sem).unionByName(sarif)


def scip_occurrences(raw: DataFrame) -> DataFrame:
    """(path, symbol, line, start, end_line, end, definition) of index documents (path, occurrences); ranges of three numbers end on their line."""
    o = raw.select("path", F.explode("occurrences").alias("o"))
    r, three = F.col("o.range"), F.size("o.range") == 3
    return o.select("path", F.col("o.symbol").alias("symbol"), r[0].alias("line"), r[1].alias("start"), F.when(three, r[0]).otherwise(F.try_element_at(r, F.lit(3))).alias("end_line"), F.when(three, r[2]).otherwise(F.try_element_at(r, F.lit(4))).alias("end"), (F.col("o.symbol_roles").bitwiseAND(F.lit(1)) != 0).alias("definition"))


def numstat(log: DataFrame) -> DataFrame:
    """(commit, date, additions, deletions, path) of captured ``--numstat`` logs (text): headers ``commit NUL date NUL``, binary counts null.

    A log is one row; logs of different repositories are parsed side by side.
    """
    lines = log.select(F.posexplode(F.split("text", "\n")).alias("pos", "line"), F.col("log"))
    head = F.when(F.col("line").contains("\0"), F.struct("pos", F.split("line", "\0")[0].alias("commit"), F.split("line", "\0")[1].alias("date")))
    from pyspark.sql import Window as W

    marked = lines.withColumn("h", F.last(head, ignorenulls=True).over(W.partitionBy("log").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    parts = F.split("line", "\t")
    rows = marked.where(F.size(parts) == 3)
    number = lambda c: F.when(c != "-", c.cast("int"))
    return rows.select("log", F.col("h.commit").alias("commit"), F.col("h.date").alias("date"), number(parts[0]).alias("additions"), number(parts[1]).alias("deletions"), parts[2].alias("path"))


def porcelain(status: DataFrame) -> DataFrame:
    """(index, worktree, path) of captured NUL-separated status output (text)."""
    entry = status.select(F.explode(F.split("text", "\0")).alias("e")).where(F.length("e") > 3)
    return entry.select(F.substring("e", 1, 1).alias("index"), F.substring("e", 2, 1).alias("worktree"), F.substring("e", 4, 1 << 16).alias("path"))


CHUNK_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("content", T.StringType()), ("filepath", T.StringType()), ("language", T.StringType()), ("startline", T.IntegerType()), ("endline", T.IntegerType()), ("symbolname", T.StringType()), ("symboltype", T.StringType()), ("vector", T.ArrayType(T.FloatType())))])
