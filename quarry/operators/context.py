"""Operators over symbol navigation data, project manifests, retrieval context and captured tool results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that carry no focus.
STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from", "into", "are", "was", "has", "have", "not", "les", "des", "une", "est", "dans", "pour", "sur", "par", "que", "qui"]


def focus_terms(text: Column, limit: int = 12) -> Column:
    """The first distinct words of three or more letters that are no stop words, in lower case."""
    camel = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.transform(F.regexp_extract_all(camel, F.lit(r"([\p{L}_$][\p{L}\p{N}_$-]{2,})"), F.lit(1)), F.lower)
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS))), 1, limit)


def short_symbol(symbol: Column) -> Column:
    """Last word of an index symbol."""
    parts = F.filter(F.split(symbol, "[#/.:`()]+"), lambda x: x != "")
    return F.try_element_at(parts, F.lit(-1))


def chunk_symbols(chunks: DataFrame, symbols: DataFrame, limit: int = 20) -> DataFrame:
    """(id, names): the distinct symbols (filepath, name, line, endline) whose lines overlap a chunk's, in order of line, at most ``limit``.

    The overlap is tested within a file; files meet by hash, so AQE can split a hot one.
    """
    s = symbols.select("filepath", "name", F.col("line").alias("s1"), F.coalesce("endline", "line").alias("s2"))
    met = chunks.join(s, "filepath").where((F.col("startline") <= F.col("s2")) & (F.col("s1") <= F.col("endline"))).groupBy("id", "name").agg(F.min("s1").alias("at"))
    ranked = met.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy("at", "name"))).where(F.col("rn") <= limit)
    return ranked.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]).alias("names"))


def exported_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(importer, target, name, confidence): an imported name joined with the symbol of that name in the target file, 0.9; the module edge itself 0.96."""
    named = imports.join(symbols.select(F.col("filepath").alias("target"), "name").distinct(), ["target", "name"]).select("importer", "target", "name", F.lit(0.9).alias("confidence"))
    module = imports.select("importer", "target").distinct().select("importer", "target", F.lit(None).cast("string").alias("name"), F.lit(0.96).alias("confidence"))
    return named.unionByName(module)


def imported_symbols(imports: DataFrame, symbols: DataFrame, per_file: int = 10, per_import: int = 5) -> DataFrame:
    """(importer, target, name): for the first imports of a file the first symbols of each target."""
    i = imports.select("importer", "target").distinct().withColumn("ri", F.row_number().over(W.partitionBy("importer").orderBy("target"))).where(F.col("ri") <= per_file)
    s = symbols.select(F.col("filepath").alias("target"), "name", "line").distinct().withColumn("rs", F.row_number().over(W.partitionBy("target").orderBy("line", "name"))).where(F.col("rs") <= per_import)
    return i.join(s, "target").select("importer", "target", "name")


def occurrences_at(occurrences: DataFrame, positions: DataFrame, definitions_only: bool = False) -> DataFrame:
    """All occurrences of the symbols that stand at the given positions (path, line, column)."""
    at = positions.join(occurrences, ["path", "line"]).where((F.col("start") <= F.col("column")) & (F.col("column") <= F.col("end"))).select("symbol").distinct()
    out = occurrences.join(at, "symbol", "left_semi")
    return out.where("definition") if definitions_only else out


def dependency_edges(resolved: DataFrame, include_external: bool = False, limit: int | None = None) -> DataFrame:
    """Edges (importer, target, resolved) without unresolved external imports; relative ones that don't resolve stay."""
    out = resolved if include_external else resolved.where(F.col("resolved").isNotNull() | F.col("target").startswith("."))
    if limit is None:
        return out
    return out.orderBy("importer", "target").limit(limit)


def reference_counts(definitions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(name, definitions, mentions) of each defined name."""
    d = definitions.groupBy("name").agg(F.count(F.lit(1)).alias("definitions"))
    m = mentions.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"))
    return d.join(m, "name", "left").select("name", "definitions", F.coalesce("mentions", F.lit(0)).alias("mentions"))


def split_budget(callers: int, callees: int, total: int) -> tuple[int, int]:
    """Nodes for callers and callees: half each, what one side leaves goes to the other."""
    a = min(callers, total // 2)
    b = min(callees, total - a)
    return min(callers, total - b), b


def ordered_union_page(parts: list[tuple[DataFrame, int]], file: str, position: str, offset: int, limit: int) -> DataFrame:
    """One page of several result kinds (frame, order of the kind) in file order, by kind and position within a file."""
    out = None
    for frame, mode in parts:
        tagged = frame.withColumn("mode", F.lit(mode))
        out = tagged if out is None else out.unionByName(tagged)
    return out.orderBy(file, "mode", position, "name").offset(offset).limit(limit)


def manifest_facts(files: DataFrame) -> DataFrame:
    """(filepath, name, dependencies) of package manifests (filepath, content): JSON names and dependency keys, TOML names."""
    base = F.element_at(F.split("filepath", "/"), -1)
    name = F.when(base.endswith(".json"), F.get_json_object("content", "$.name")).otherwise(F.nullif(F.regexp_extract("content", r'(?m)^\s*name\s*=\s*"([^"]+)"', 1), F.lit("")))
    deps = F.map_keys(F.from_json(F.get_json_object("content", "$.dependencies"), "map<string,string>"))
    return files.select("filepath", name.alias("name"), F.sort_array(F.coalesce(deps, F.array().cast("array<string>"))).alias("dependencies"))


def enrichment_header(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(id, header): File, Language and Symbols lines of a chunk; absent parts are left out."""
    joined = chunks.join(names, "id", "left")
    return joined.select("id", F.concat_ws("\n", F.concat(F.lit("File: "), F.col("filepath")), F.concat(F.lit("Language: "), F.col("language")), F.when(F.size("names") > 0, F.concat(F.lit("Symbols: "), F.array_join("names", ", ")))).alias("header"))


def change_summary(changes: DataFrame, first: int = 10) -> DataFrame:
    """(kind, summary): the first paths of each kind of change, and how many more there are."""
    ranked = changes.withColumn("rn", F.row_number().over(W.partitionBy("kind").orderBy("path")))
    n = changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    head = ranked.where(F.col("rn") <= first).groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list("path")), ", ").alias("paths"))
    more = F.when(F.col("n") > first, F.concat(F.lit(" ... and "), (F.col("n") - first).cast("string"), F.lit(" more"))).otherwise("")
    return n.join(head, "kind").select("kind", F.concat("paths", more).alias("summary"))


def prometheus(metrics: DataFrame, name: str) -> DataFrame:
    """(line) text exposition of a metric table (event_type, calls)."""
    return metrics.select(F.format_string(name + '{tool="%s"} %d', "event_type", "calls").alias("line"))


def hunk_rows(diffs: DataFrame) -> DataFrame:
    """(key, start, stop): new line ranges of captured diffs (key, text), in SQL functions alone."""
    hits = F.regexp_extract_all("text", F.lit(r"@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"), F.lit(1))
    h = diffs.select("key", F.explode(hits).alias("h"))
    start = F.split("h", ",")[0].cast("int")
    count = F.coalesce(F.try_element_at(F.split("h", ","), F.lit(2)).cast("int"), F.lit(1))
    return h.select("key", start.alias("start"), (start + F.greatest(count, F.lit(1)) - 1).alias("stop"))
