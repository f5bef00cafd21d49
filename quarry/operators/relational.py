"""Filters, joins, aggregates, ranking and set operators of the chunk, symbol and change tables."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import normal_path
from ..tables import ensure_checkpoint_dir

# Fixed value: folders and file names of tests.
TEST_PATH = r"(^|/)(tests?|__tests__|specs?)/|(\.test|\.spec|_test|_spec)\.[^./]+$"


# ------------------------------------------------------------------ filters
def is_test_path(path: Column) -> Column:
    return F.coalesce(F.lower(normal_path(path)).rlike(TEST_PATH), F.lit(False))


def search_filter(df: DataFrame, language: str | None = None, symbol_type: str | None = None, prefix: str | None = None, include_tests: bool = True) -> DataFrame:
    """Post-filter of a candidate pool: equality without case, path prefix on whole segments, tests in or out."""
    if language:
        df = df.where(F.lower("language") == language.lower())
    if symbol_type:
        df = df.where(F.lower("symboltype") == symbol_type.lower())
    if prefix:
        path, p = normal_path(F.col("filepath")), prefix.rstrip("/")
        df = df.where((path == p) | path.startswith(p + "/"))
    return df if include_tests else df.where(~is_test_path(F.col("filepath")))


def match_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose id, name or path ends with the query; where none does, the first 20 that contain it."""
    q = query.lower().replace("\\", "/")
    fields = [F.lower(normal_path(F.coalesce(F.col(c), F.lit("")))) for c in ("id", "name", "path")]
    ends = fields[0].endswith(q) | fields[1].endswith(q) | fields[2].endswith(q)
    holds = fields[0].contains(q) | fields[1].contains(q) | fields[2].contains(q)
    first = nodes.where(ends).withColumn("tier", F.lit(1))
    second = nodes.where(holds & ~ends).orderBy("id").limit(20).withColumn("tier", F.lit(2))
    both = first.unionByName(second)
    return both.where(F.col("tier") == both.agg(F.min("tier")).scalar()).drop("tier")


def _inside(spans: DataFrame, points: DataFrame, key: str, point: str, width: int) -> DataFrame:
    """(key, point, start, stop, name) of the spans that contain each point, met in windows of ``width`` so that a hot key is spread."""
    a = spans.select(key, "start", "stop", "name", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))).alias("_w")).where("start <= stop")
    b = points.select(key, point).distinct().withColumn("_w", F.floor(F.col(point) / width))
    return b.join(a, [key, "_w"]).where((F.col("start") <= F.col(point)) & (F.col("stop") >= F.col(point))).drop("_w")


def smallest_span(spans: DataFrame, points: DataFrame, key: str, point: str = "line", width: int = 64) -> DataFrame:
    """Each point with the smallest span (start, stop, name) of its key that contains it; points in no span keep null."""
    hit = _inside(spans, points, key, point, width).groupBy(key, point).agg(F.min(F.struct((F.col("stop") - F.col("start")).alias("w"), "start", "name")).alias("s"))
    return points.select(key, point).distinct().join(hit, [key, point], "left").select(key, point, F.col("s.name").alias("name"))


def last_span(spans: DataFrame, points: DataFrame, key: str, point: str = "line", default: str = "__global__", width: int = 64) -> DataFrame:
    """Each point with the span of its key that begins last among those that contain it, or ``default``."""
    hit = _inside(spans, points, key, point, width).groupBy(key, point).agg(F.max(F.struct("start", "name")).alias("s"))
    return points.select(key, point).distinct().join(hit, [key, point], "left").select(key, point, F.coalesce("s.name", F.lit(default)).alias("name"))


# ------------------------------------------------------------------ joins
def keyed_range_join(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of equal key whose intervals (a1, a2) and (b1, b2) overlap.

    Intervals are cut into windows of ``width``; the pair meets in the window where the later one
    begins, so each pair comes once and a hot key is spread over its windows.
    """
    a = left.withColumn("w", F.explode(F.sequence(F.floor(F.col("a1") / width), F.floor(F.col("a2") / width))))
    b = right.withColumn("w", F.explode(F.sequence(F.floor(F.col("b1") / width), F.floor(F.col("b2") / width))))
    met = a.join(b, [key, "w"]).where((F.col("a1") <= F.col("b2")) & (F.col("b1") <= F.col("a2")))
    return met.where(F.col("w") == F.floor(F.greatest("a1", "b1") / width)).drop("w")


def resolve_by_precedence(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each reference (ref_id, filepath, name, line) with its target: the nearest symbol of the same file, else the only one of that name anywhere, else null.

    ``confidence`` is 0.78 for a unique name, 0.58 otherwise.
    """
    everywhere = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("filepath", "line")).alias("only"))
    local = refs.join(symbols.select("filepath", "name", F.col("line").alias("at")), ["filepath", "name"]).groupBy("ref_id").agg(F.min(F.struct(F.abs(F.col("at") - F.col("line")).alias("d"), "at")).alias("near"))
    out = refs.join(local, "ref_id", "left").join(everywhere, "name", "left")
    unique = F.coalesce(F.col("n") == 1, F.lit(False))
    return out.select(
        "ref_id",
        F.when(F.col("near").isNotNull(), F.col("filepath")).when(unique, F.col("only.filepath")).alias("target_path"),
        F.when(F.col("near").isNotNull(), F.col("near.at")).when(unique, F.col("only.line")).alias("target_line"),
        F.when(F.col("near").isNotNull() | unique, F.when(unique, 0.78).otherwise(0.58)).alias("confidence"),
    )


def unique_name_join(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References joined with the symbols whose name occurs once only."""
    single = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("filepath").alias("target")).where("n = 1").drop("n")
    return refs.join(single, "name")


def resolve_imports(imports: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """Each import (importer, target) with the first existing candidate: exact, with an extension, as an index file; null if none exists."""
    suffixes = ["", *(f".{e}" for e in extensions), *(f"/index.{e}" for e in extensions)]
    options = imports.select("importer", "target", F.posexplode(F.array(*(F.concat("target", F.lit(s)) for s in suffixes))).alias("pos", "path"))
    hits = options.join(files.select("path").distinct(), "path").groupBy("importer", "target").agg(F.min(F.struct("pos", "path")).alias("m"))
    return imports.distinct().join(hits, ["importer", "target"], "left").select("importer", "target", F.col("m.path").alias("resolved"))


def incremental_diff(current: DataFrame, indexed: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, state): added by the table, modified by the hash cache, unchanged, removed."""
    a = current.select("path", F.col("hash").alias("now"))
    b = indexed.select("path").distinct().withColumn("known", F.lit(True))
    c = cache.select("path", F.col("hash").alias("old"))
    joined = a.join(b, "path", "full_outer").join(c, "path", "left")
    state = F.when(F.col("now").isNull(), "removed").when(F.col("known").isNull(), "added").when(F.col("old").eqNullSafe(F.col("now")), "unchanged").otherwise("modified")
    return joined.where(F.col("now").isNotNull() | F.col("known").isNotNull()).select("path", state.alias("state"))


def adjacent(chunks: DataFrame, seeds: DataFrame, window: int = 1) -> DataFrame:
    """(seed, id, distance, side): the chunks up to ``window`` places before and behind each seed within its file."""
    placed = chunks.withColumn("rn", F.row_number().over(W.partitionBy("filepath").orderBy("startline", "endline", "id"))).select("filepath", "id", "rn")
    anchors = placed.join(seeds.select("id"), "id", "left_semi").select("filepath", F.col("id").alias("seed"), F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("d"), (F.col("rn") + F.col("d")).alias("rn")).where("d <> 0")
    return anchors.join(placed, ["filepath", "rn"]).select("seed", "id", F.abs("d").alias("distance"), F.when(F.col("d") < 0, "before").otherwise("after").alias("side"))


# ------------------------------------------------------------------ aggregates
def index_status(chunks: DataFrame) -> DataFrame:
    """(language, chunks, files) of every language, a null one as unknown."""
    return chunks.groupBy(F.coalesce(F.lower("language"), F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct(normal_path(F.col("filepath"))).alias("files"))


def change_hotspots(changes: DataFrame) -> DataFrame:
    """Per file: commits, additions, deletions, binary changes, churn, last commit. A change that is binary counts once in the churn; repeated rows count once."""
    rows = changes.dropDuplicates(["change_id"]).withColumn("path", normal_path(F.col("filepath")))
    binary = F.col("additions").isNull()
    return (
        rows.groupBy("path")
        .agg(
            F.countDistinct("commit_id").alias("commits"),
            F.coalesce(F.sum("additions"), F.lit(0)).alias("additions"),
            F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"),
            F.count_if(binary).alias("binary_changes"),
            F.max(F.struct("ts", "change_id", "commit_id")).alias("last"),
        )
        .select("path", "commits", "additions", "deletions", "binary_changes", (F.col("additions") + F.col("deletions") + F.col("binary_changes")).alias("churn"), F.col("last.commit_id").alias("last_commit"))
    )


def degree(edges: DataFrame) -> DataFrame:
    """(node, inbound, outbound, score) with score = 2 x inbound + outbound."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound")).withColumn("score", F.col("inbound") * 2 + F.col("outbound"))


def call_metrics(events: DataFrame, key: str = "event_type", value: str = "value", last: int = 200, failed: Column | None = None) -> DataFrame:
    """Per key: calls, successes, failures (of the rows where ``failed`` is true), total and last value, nearest-rank p50 and p95 of the ``last`` values.

    The window keeps ``last`` rows a key before anything else, so a hot key is cut on the map side.
    """
    bad = F.coalesce(F.lit(False) if failed is None else failed, F.lit(False))
    totals = events.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.count_if(~bad).alias("successes"), F.count_if(bad).alias("failures"), F.sum(value).alias("total"), F.max_by(value, F.struct("ts", "event_id")).alias("last"))
    recent = events.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("rn") <= last)
    marks = recent.groupBy(key).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))
    return totals.join(marks, key)


def symbol_summary(symbols: DataFrame, kinds: list[str]) -> DataFrame:
    """(repo, total, one column a kind)."""
    return symbols.groupBy("repo").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds])


# ------------------------------------------------------------------ ranking
def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, key: str, n: int, *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def byte_budget_prefix(df: DataFrame, tokens: int, order: str, text: str) -> DataFrame:
    """Rows in order until the next would exceed ``tokens`` x 4 bytes.

    Sums of ranges of the order come first, so that no task holds all rows: the range in which
    the budget ends is the only one whose rows are added up one by one.
    """
    budget = tokens * 4
    spark = df.sparkSession
    sized = df.withColumn("bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ensure_checkpoint_dir(spark)
    # written once: both uses of the partition numbers see the same ranges
    parts = sized.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()).checkpoint()
    sums = parts.groupBy("part").agg(F.sum("bytes").alias("b"), F.min(order).alias("low")).withColumn("before", F.coalesce(F.sum("b").over(W.orderBy("low").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = sums.where(F.col("before") <= budget).select("part", "before")  # one row a partition
    rows = parts.join(F.broadcast(inside), "part")
    run = F.sum("bytes").over(W.partitionBy("part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", F.col("before") + run).where(F.col("used") <= budget).drop("part", "before")


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def cursor(scope: dict, offset: int) -> str:
    """Opaque cursor of an offset, bound to a query by the hash of its canonical form."""
    body = canonical_json({"offset": offset, "scope": hashlib.sha256(canonical_json(scope).encode()).hexdigest(), "version": 1})
    return "pc1." + base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def read_cursor(text: str, scope: dict) -> int:
    """Offset of a cursor; ValueError for one of another query, a malformed or too long one."""
    if len(text) > 1024 or not text.startswith("pc1."):
        raise ValueError("malformed cursor")
    raw = text[4:]
    try:
        body = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)))
    except ValueError as error:
        raise ValueError("malformed cursor") from error
    if body.get("scope") != hashlib.sha256(canonical_json(scope).encode()).hexdigest():
        raise ValueError("cursor of another query")
    offset = body.get("offset")
    if not isinstance(offset, int) or not 0 <= offset <= 10_000_000:
        raise ValueError("offset out of range")
    return offset


def page(df: DataFrame, offset: int, limit: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def fair_budget(layers: list[tuple[str, float, int]], total: int) -> dict[str, int]:
    """Bytes of a budget for each layer (name, weight, wanted); a handful of layers, so plain arithmetic.

    Three tenths go in equal parts and the rest by weight, each part rounded down, what rounding leaves to the
    last layer; no layer gets more than it wants. What is over is poured by weight on those that want more,
    at least a byte each, in rounds until nothing is left or wanted.
    """
    if not layers:
        return {}
    even, weights = total * 3 // 10, sum(w for _, w, _ in layers)
    parts = [even // len(layers) + int((total - even) * w / weights) for _, w, _ in layers[:-1]]
    parts.append(total - sum(parts))
    given = {name: min(part, wanted) for (name, _, wanted), part in zip(layers, parts, strict=True)}
    over = total - sum(given.values())
    while over > 0:
        hungry = [x for x in layers if given[x[0]] < x[2]]
        pool, weights = over, sum(w for _, w, _ in hungry)
        for name, weight, wanted in hungry:
            more = min(wanted - given[name], max(1, int(pool * weight / weights)), over)
            given[name] += more
            over -= more
        if over == pool:
            break
    return given


# ------------------------------------------------------------------ sets
def union_keep_first(first: DataFrame, second: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Union in which a key's row from ``first`` wins."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    return keep_first(both, keys, "_o", *order).drop("_o")


def last_change(changes: DataFrame) -> DataFrame:
    """(path, change_type): the last change of each path, by time and id."""
    path = normal_path(F.col("filepath")).alias("path")
    return changes.groupBy(path).agg(F.max_by("change_type", F.struct("ts", "change_id")).alias("change_type"))


def removed(indexed: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return indexed.select(key).distinct().join(current.select(key), key, "left_anti")


def between_selected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are selected."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def most_parents(relations: DataFrame) -> DataFrame:
    """Of repeated relations (kind, name, line) the one with the most parents, then the greatest list."""
    return relations.groupBy("kind", "name", "line").agg(F.max(F.struct(F.size("parents").alias("n"), "parents")).alias("r")).select("kind", "name", "line", "r.parents")
