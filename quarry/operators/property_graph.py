"""The property graph of source files: modules, symbols and signals as nodes, typed edges between them.

Every kind of edge is one join over the tables that ``code.extract`` makes of the files; repositories are
projects, so names resolve within one. Identifiers of nodes hold the path and the offset in characters.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import ensure_checkpoint_dir
from . import code
from .relational import is_test_path

# Extensions tried for an import, in this order.
EXTENSIONS = "ts tsx js jsx mjs cjs py go rs java kt cs rb php".split()
EDGE_KINDS = ["contains", "imports", "calls", "references", "inherits", "implements", "tests", "routes", "emits", "injects"]
MAX_NODES, MAX_EDGES = 50_000, 100_000
TEST_WORDS = 200  # identifiers of a test that are looked up


def module_id(path: Column) -> Column:
    return F.concat(F.lit("module:"), path)


def symbol_id(path: Column, start: Column, name: Column) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit(":"), start.cast("string"), F.lit(":"), name)


def joined_path(folder: Column, relative: Column) -> Column:
    """A relative path from a folder, its ``.`` and ``..`` resolved."""
    step = lambda done, x: F.when((x == "") | (x == "."), done).when((x == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(F.concat_ws("/", folder, relative), "/"), F.array().cast("array<string>"), step), "/")


def import_base(filepath: Column, source: Column, aliases: dict[str, str] | None = None) -> Column:
    """Where an import points before extensions: an alias's folder, or from the importing file for a relative source; null for others."""
    out = F.when(source.startswith("."), joined_path(F.regexp_extract(filepath, r"^(.*)/[^/]*$", 1), source))
    for alias, folder in reversed((aliases or {}).items()):
        plain = alias.rstrip("/")
        rest = F.regexp_replace(F.substring(source, len(plain) + 1, 1 << 16), r"^[/\\]", "")
        root = F.regexp_extract(filepath, r"^([^/]+)/", 1)
        out = F.when((source == plain) | source.startswith(plain + "/"), joined_path(F.concat_ws("/", root, F.lit(folder)), rest)).otherwise(out)
    return out


def resolved_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """The imports (filepath, source, ...) with ``target``: the first existing of the exact path, with an extension, as an index file; null if none."""
    keyed = imports.select("filepath", "source").distinct().withColumn("base", import_base(F.col("filepath"), F.col("source"), aliases))
    suffixes = ["", *(f".{e}" for e in EXTENSIONS), *(f"/index.{e}" for e in EXTENSIONS)]
    options = keyed.where("base IS NOT NULL").select("filepath", "source", F.posexplode(F.array(*(F.concat("base", F.lit(s)) for s in suffixes))).alias("pos", "path"))
    hits = options.join(files.select(F.col("filepath").alias("path")).distinct(), "path").groupBy("filepath", "source").agg(F.min_by("path", "pos").alias("target"))
    return imports.join(hits, ["filepath", "source"], "left")


class Tables:
    """The tables of one set of files (repo, filepath, content), each extracted when it is first asked for; those with many uses are written once."""

    def __init__(self, files: DataFrame, aliases: dict[str, str] | None = None):
        self.files, self._aliases = files, aliases

    @cached_property
    def modules(self) -> DataFrame:
        return self.files.select("repo", "filepath", is_test_path(F.col("filepath")).alias("is_test"))

    @cached_property
    def symbols(self) -> DataFrame:
        ensure_checkpoint_dir(self.files.sparkSession)
        return code.extract(self.files, "symbols").join(self.modules, "filepath").withColumn("id", symbol_id(F.col("filepath"), F.col("start"), F.col("name"))).checkpoint()

    @cached_property
    def imports(self) -> DataFrame:
        ensure_checkpoint_dir(self.files.sparkSession)
        return resolved_imports(code.extract(self.files, "imports"), self.files, self._aliases).checkpoint()

    @cached_property
    def uses(self) -> DataFrame:
        return code.extract(self.files, "uses").join(self.modules, "filepath")

    @cached_property
    def hierarchy(self) -> DataFrame:
        return code.extract(self.files, "hierarchy").join(self.modules, "filepath")

    @cached_property
    def signals(self) -> DataFrame:
        return code.extract(self.files, "signals")

    def nearest(self, wanted: DataFrame, file: str, name: str, offset: Column) -> DataFrame:
        """The rows of ``wanted`` with ``near``: the id of the symbol of a name in a file that begins nearest to an offset, null if there is none."""
        s = self.symbols.select(F.col("filepath").alias(file), F.col("name").alias(name), F.col("start").alias("s_start"), F.col("id").alias("s_id"))
        keys = [c for c in wanted.columns]
        met = wanted.join(s, [file, name], "left").withColumn("_d", F.struct(F.abs(F.col("s_start") - offset), F.col("s_start")))
        return met.groupBy(*keys).agg(F.min_by("s_id", "_d").alias("near"))

    def unique(self, tests: bool = True) -> DataFrame:
        """(repo, name, only): the symbols whose name a repository declares once, tests included or not."""
        s = self.symbols if tests else self.symbols.where(~F.col("is_test"))
        return s.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only")).where("n = 1").select("repo", "name", "only")


def _edge(kind: Column | str, confidence: Column | float, source: Column, target: Column, path: Column) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return [source.alias("src"), target.alias("dst"), kind.alias("kind"), confidence.alias("confidence"), path.alias("path")]


def contains(t: Tables) -> DataFrame:
    return t.symbols.select(*_edge("contains", 1.0, module_id(F.col("filepath")), F.col("id"), F.col("filepath")))


def import_edges(t: Tables) -> DataFrame:
    """Module edges (0.96), and for every imported name its symbol in the target (0.9)."""
    hit = t.imports.where("target IS NOT NULL")
    modules = hit.select(*_edge("imports", 0.96, module_id(F.col("filepath")), module_id(F.col("target")), F.col("filepath")))
    named = t.nearest(hit.select("filepath", "target", F.explode("names").alias("name")).distinct(), "target", "name", F.lit(0)).where("near IS NOT NULL")
    return modules.unionByName(named.select(*_edge("imports", 0.9, module_id(F.col("filepath")), F.col("near"), F.col("filepath"))))


def reference_edges(t: Tables) -> DataFrame:
    """Identifiers of a symbol's body: bound by an import, else the nearest symbol of the file, else the only one of the repository. Calls where a bracket follows; 0.78 if bound or unique, else 0.58."""
    bound = t.imports.where("target IS NOT NULL").select("filepath", F.explode("names").alias("name"), "target").groupBy("filepath", "name").agg(F.max("target").alias("bound"))
    known = t.symbols.select("repo", "name").distinct()
    rows = t.uses.join(known, ["repo", "name"], "left_semi").join(bound, ["filepath", "name"], "left").withColumn("where", F.coalesce("bound", "filepath"))
    keyed = rows.select("repo", "filepath", "symbol", "start", "name", "called", "bound", "where")
    near = t.nearest(keyed, "where", "name", F.when(F.col("bound").isNull(), F.col("start")).otherwise(F.lit(0)))
    out = near.join(t.unique(), ["repo", "name"], "left").withColumn("dst", F.coalesce("near", "only"))
    source = symbol_id(F.col("filepath"), F.col("start"), F.col("symbol"))
    confidence = F.when(F.col("bound").isNotNull() | F.col("only").isNotNull(), 0.78).otherwise(0.58)
    return out.where(F.col("dst").isNotNull() & (source != F.col("dst"))).select(*_edge(F.when(F.col("called"), "calls").otherwise("references"), confidence, source, F.col("dst"), F.col("filepath")))


def hierarchy_relations(t: Tables) -> DataFrame:
    """(src, dst, kind, path, parent, line) of every parent of a declared type, in its file first, else the only one of the repository; ``dst`` null where neither is there."""
    rows = t.nearest(t.hierarchy.select("repo", "filepath", "kind", "name", "line", F.explode("parents").alias("parent")).distinct(), "filepath", "name", F.lit(0)).where("near IS NOT NULL").withColumnRenamed("near", "src")
    local = t.nearest(rows, "filepath", "parent", F.lit(0))
    out = local.join(t.unique().withColumnRenamed("name", "parent"), ["repo", "parent"], "left")
    return out.select("src", F.coalesce("near", "only").alias("dst"), F.when(F.col("kind") == "impl", "implements").otherwise("inherits").alias("kind"), F.col("filepath").alias("path"), "parent", "line")


def hierarchy_edges(t: Tables) -> DataFrame:
    return hierarchy_relations(t).where("dst IS NOT NULL").select("src", "dst", "kind", F.lit(0.68).alias("confidence"), "path")


def test_edges(t: Tables) -> DataFrame:
    """Identifiers in the symbols of tests, or in a test without symbols as a whole, that only one symbol outside of tests has (0.62)."""
    rank = F.row_number().over(W.partitionBy("filepath", "symbol", "start").orderBy("place"))
    words = code.X.table_function(t.files, "filepath", "content", _test_words, "symbol string, start int, name string, place int").join(t.modules.where("is_test"), "filepath")
    hit = words.withColumn("rn", rank).where(F.col("rn") <= TEST_WORDS).join(t.unique(tests=False), ["repo", "name"])
    return hit.select(*_edge("tests", 0.62, symbol_id(F.col("filepath"), F.col("start"), F.coalesce("symbol", "filepath")), F.col("only"), F.col("filepath")))


def _test_words(text: str) -> list[tuple[str | None, int, str, int]]:
    found = [(s.name, s.start, text[s.start : s.stop]) for s in code.symbols(text)] or [(None, 0, text)]
    return [(name, start, word, k) for name, start, body in found for k, word in enumerate(code.identifiers(body, TEST_WORDS))]


def signal_rows(t: Tables) -> DataFrame:
    """Signals with their node id and owner: the smallest symbol that holds the place, else the module."""
    s = t.symbols.select("filepath", F.col("start").alias("a"), F.col("stop").alias("b"), F.col("id").alias("owner_id"))
    inside = t.signals.select("filepath", F.col("start").alias("at")).distinct().join(s, "filepath").where("a <= at AND at <= b").groupBy("filepath", "at").agg(F.min_by("owner_id", F.struct(F.col("b") - F.col("a"), "a")).alias("owner"))
    id_ = F.concat(F.lit("signal:"), F.col("kind"), F.lit(":"), F.col("filepath"), F.lit(":"), F.col("start").cast("string"), F.lit(":"), F.col("name"))
    return t.signals.join(inside.withColumnRenamed("at", "start"), ["filepath", "start"], "left").withColumn("id", id_).withColumn("owner", F.coalesce("owner", module_id(F.col("filepath"))))


def signal_edges(t: Tables) -> DataFrame:
    kind = F.when(F.col("kind") == "route", "routes").when(F.col("kind") == "event", "emits").otherwise("injects")
    return signal_rows(t).select(*_edge(kind, 0.64, F.col("owner"), F.col("id"), F.col("filepath")))


def signal_totals(t: Tables) -> DataFrame:
    """(kind, n) of the signals."""
    return t.signals.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def nodes(t: Tables) -> DataFrame:
    """(id, kind, name, path, line, endline, symbol_type, is_test), each id once."""
    module = t.modules.select(module_id(F.col("filepath")).alias("id"), F.lit("module").alias("kind"), F.col("filepath").alias("name"), F.col("filepath").alias("path"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("endline"), F.lit(None).cast("string").alias("symbol_type"), "is_test")
    symbol = t.symbols.select("id", F.lit("symbol").alias("kind"), "name", F.col("filepath").alias("path"), "line", "endline", F.col("type").alias("symbol_type"), "is_test")
    signal = signal_rows(t).select("id", "kind", F.concat_ws(" ", F.when(F.col("operation") != F.col("name"), F.col("operation")), "name").alias("name"), F.col("filepath").alias("path"), "line", F.lit(None).cast("int").alias("endline"), F.lit(None).cast("string").alias("symbol_type"), is_test_path(F.col("filepath")).alias("is_test"))
    bare = t.modules.where("is_test").join(t.symbols.select("filepath").distinct(), "filepath", "left_anti")
    test = bare.select(symbol_id(F.col("filepath"), F.lit(0), F.col("filepath")).alias("id"), F.lit("symbol").alias("kind"), F.col("filepath").alias("name"), F.col("filepath").alias("path"), F.lit(1).alias("line"), F.lit(1).alias("endline"), F.lit("test-file").alias("symbol_type"), "is_test")
    return module.unionByName(symbol).unionByName(signal).unionByName(test).dropDuplicates(["id"])


def edges(t: Tables, tests: bool = True, signals: bool = True) -> DataFrame:
    """(src, dst, kind, confidence, path), each (kind, src, dst) once with its greatest confidence."""
    out = contains(t).unionByName(import_edges(t)).unionByName(reference_edges(t)).unionByName(hierarchy_edges(t))
    if tests:
        out = out.unionByName(test_edges(t))
    if signals:
        out = out.unionByName(signal_edges(t))
    return out.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.min("path").alias("path"))


def of_kinds(edges_: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges of the given kinds."""
    return edges_.where(F.col("kind").isin(kinds))


def select_nodes(nodes_: DataFrame, focus: DataFrame, most: int) -> DataFrame:
    """The first ``most`` nodes, those of ``focus`` (id) first, then by path, line and id; in order of path."""
    marked = nodes_.join(focus.select("id").distinct().withColumn("f", F.lit(True)), "id", "left")
    order = [F.col("path"), F.coalesce("line", F.lit(0)), F.col("id")]
    return marked.orderBy(F.coalesce("f", F.lit(False)).desc(), *order).limit(most).drop("f").orderBy(*order)


def tests_of(edges_: DataFrame, targets: DataFrame, most: int = 100) -> DataFrame:
    """(target, tests, files, truncated): the tests that reach each target, and their files, at most ``most`` of each."""
    hit = edges_.where(F.col("kind") == "tests").join(targets.select(F.col("id").alias("dst")).distinct(), "dst").select(F.col("dst").alias("target"), F.col("src").alias("test"), "path").distinct()
    ranked = hit.withColumn("rn", F.dense_rank().over(W.partitionBy("target").orderBy("test")))
    n = hit.groupBy("target").agg(F.count_distinct("test").alias("n"))
    got = ranked.where(F.col("rn") <= most).groupBy("target").agg(F.sort_array(F.collect_set("test")).alias("tests"), F.slice(F.sort_array(F.collect_set("path")), 1, most).alias("files"))
    return got.join(n, "target").select("target", "tests", "files", (F.col("n") > most).alias("truncated"))


def type_graph(t: Tables, most_edges: int = 500, most_unresolved: int = 200) -> tuple[DataFrame, DataFrame]:
    """The first resolved (src, dst, kind) and unresolved (src, parent, path, line) relations of types."""
    rows = hierarchy_relations(t)
    good = rows.where("dst IS NOT NULL").select("src", "dst", "kind").distinct().orderBy("src", "dst").limit(most_edges)
    return good, rows.where("dst IS NULL").select("src", "parent", "path", "line").distinct().orderBy("path", "line", "parent").limit(most_unresolved)


def dead_symbols(t: Tables, limit: int | None = None) -> DataFrame:
    """(filepath, name, type, line, confidence) of symbols declared once in their repository, not exported, no entry point, and mentioned nowhere else.

    Mentions are whole words of all texts outside of tests, counted once a text before they meet the symbols. Most confident first.
    """
    live = t.files.where(~is_test_path(F.col("filepath")))
    s = t.symbols.where(~F.col("is_test"))
    exported = code.extract(live, "exports").select("filepath", "name").distinct().withColumn("exported", F.lit(True))
    marked = s.join(exported, ["filepath", "name"], "left").withColumn("exported", F.coalesce("exported", F.lit(False)) | F.array_contains("modifiers", "export") | F.array_contains("modifiers", "pub"))
    defined = marked.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("definitions"))
    word = F.regexp_extract_all("content", F.lit(r"(?<![A-Za-z0-9_$])([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))
    said = live.select("repo", F.explode(word).alias("name")).groupBy("repo", "name").agg(F.count(F.lit(1)).alias("mentions"))
    one = marked.join(defined.where("definitions = 1"), ["repo", "name"]).join(said, ["repo", "name"], "left").where("NOT exported").where(~F.col("name").isin("main", "constructor", "__init__"))
    kinds = ["function", "method", "class", "interface", "type", "enum"]
    dead = one.where((F.coalesce("mentions", F.lit(0)) <= F.col("definitions")) & F.col("type").isin(kinds)).select("filepath", "name", "type", "line", F.when(F.col("type") == "method", 0.70).otherwise(0.82).alias("confidence"))
    order = [F.desc("confidence"), "filepath", "line", "name"]
    return dead.orderBy(*order) if limit is None else dead.orderBy(*order).limit(limit)


def public_names(calls: DataFrame, root: str) -> DataFrame:
    """Call rows (caller, callee, ...) whose qualified names ``path:name`` are given from the root."""
    cut = lambda c: F.regexp_replace(F.translate(F.col(c), "\\", "/"), f"^\\Q{root.rstrip('/')}/\\E", "").alias(c)
    return calls.select(*[cut(c) if c in ("caller", "callee") else F.col(c) for c in calls.columns])


def graph_is_current(saved: DataFrame, now: DataFrame) -> bool:
    """Whether a saved graph belongs to the files as they are: as many, each with the same first 16 digits of its hash."""
    a = saved.select("path", F.substring("hash", 1, 16).alias("h"))
    b = now.select("path", F.substring("hash", 1, 16).alias("h"))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# ------------------------------------------------------------------ call graph
CALL_LANGUAGES = ["typescript", "javascript", "python", "go"]


def calls(t: Tables) -> DataFrame:
    """(filepath, caller, callee, start, line): the call sites of the languages that have a call graph, with the function that begins last among those around."""
    from ..sources.languages import chunk_language

    return code.extract(t.files.where(chunk_language(F.col("filepath")).isin(CALL_LANGUAGES)), "calls")


def call_graph(t: Tables) -> DataFrame:
    """(caller, callee, name): one edge for every call site and every function of the called name in its repository; names are ``path:name``, repeats are kept.

    Functions of one name in one file are one node.
    """
    targets = t.symbols.where("type = 'function'").select("repo", "name", F.concat_ws(":", "filepath", "name").alias("callee")).distinct()
    sites = calls(t).join(t.modules.select("filepath", "repo"), "filepath").select("repo", F.concat_ws(":", "filepath", "caller").alias("caller"), F.col("callee").alias("name"))
    return sites.join(targets, ["repo", "name"]).select("caller", "callee", "name")


def call_totals(graph: DataFrame) -> DataFrame:
    """(edge_count, total_calls): all edges, and those from within functions."""
    return graph.agg(F.count(F.lit(1)).alias("edge_count"), F.count_if(~F.col("caller").endswith(":__global__")).alias("total_calls"))


def top_names(graph: DataFrame, side: str, most: int = 10) -> DataFrame:
    """(name, n) of the busiest callers or callees by short name; of qualified names with one short name the last in order counts."""
    n = graph.where(~F.col(side).endswith(":__global__")).groupBy(side).agg(F.count(F.lit(1)).alias("n"))
    short = n.groupBy(F.element_at(F.split(side, ":"), -1).alias("name")).agg(F.max_by("n", side).alias("n"))
    return short.orderBy(F.desc("n"), "name").limit(most)


def busiest_nodes(graph: DataFrame, most: int) -> DataFrame:
    """(node, degree): the nodes of a call graph by how many edges they have, then by name."""
    ends = graph.select(F.explode(F.array("caller", "callee")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(most)


# ------------------------------------------------------------------ lookups
def symbols_of(symbols: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Symbols of the included types without the excluded ones, and of a name."""
    out = symbols if include is None else symbols.where(F.col("type").isin(include))
    out = out if not exclude else out.where(~F.col("type").isin(exclude))
    return out if name is None else out.where(F.col("name") == name)


def first_named(symbols: DataFrame, name: str) -> DataFrame:
    """The first symbol of a name by file and place."""
    return symbols.where(F.col("name") == name).orderBy("filepath", "start").limit(1)


def symbol_at(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """(filepath, line, column, name): the first symbol (filepath, name, line, column, endline, endcolumn) that holds each point (filepath, line, column)."""
    s = symbols.select("filepath", "name", F.struct("line", "column").alias("a"), F.struct(F.col("endline").alias("line"), F.col("endcolumn").alias("column")).alias("b"))
    p = points.withColumn("at", F.struct("line", "column"))
    hit = p.join(s, "filepath").where((F.col("a") <= F.col("at")) & (F.col("at") <= F.col("b")))
    return hit.groupBy("filepath", "line", "column").agg(F.min_by("name", F.struct("a", "name")).alias("name"))


def chunks_of_file(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks of a file, its path without regard to case and kind of slash."""
    return chunks.where(F.lower(F.translate("filepath", "\\", "/")) == path.replace("\\", "/").lower())


def chunks_of_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks of the given ids (id)."""
    return chunks.join(ids.select("id").distinct(), "id", "left_semi")
