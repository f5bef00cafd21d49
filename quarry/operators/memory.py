"""Project memory, document catalog, findings and tasks: filters, scores, normal forms and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .retrieval import presence_score, query_terms

# Kinds of typed links, what a task's state can be, states that nothing follows.
LINK_KINDS = "references|implements|supersedes|blocks|related"
TERMINAL = ["completed", "failed", "cancelled"]
MAX_CATALOG, MAX_RECORDS = 1000, 500


def normal_tags(tags: Column, most: int = 16) -> Column:
    """Trimmed lower-case tags, each once in order, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda x: F.lower(S.strip(x))), lambda x: x != "")), 1, most)


def normal_links(links: Column, most: int = 20) -> Column:
    """Links (kind, target) with trimmed targets, each once in order, at most ``most``; empty targets go."""
    trimmed = F.transform(links, lambda x: F.struct(x["kind"].alias("kind"), S.strip(x["target"]).alias("target")))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda x: x["target"] != "")), 1, most)


def typed_link(link: Column) -> Column:
    """``kind:target`` as (kind, target); a link without a known kind is a reference."""
    text, pattern = S.strip(link), rf"(?i)^({LINK_KINDS}):(.+)$"
    typed = text.rlike(pattern)
    return F.struct(F.when(typed, F.lower(F.regexp_extract(text, pattern, 1))).otherwise("references").alias("kind"), F.when(typed, S.strip(F.regexp_extract(text, pattern, 2))).otherwise(text).alias("target"))


def not_expired(expires: Column, now: Column) -> Column:
    """Whether an ISO time has not passed; texts that are no time never expire."""
    at = F.try_to_timestamp(expires)
    return at.isNull() | (at > now)


def age_days(at: Column, now: Column) -> Column:
    """Whole days since a time."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400)


def time_id(at: Column) -> Column:
    """A time's milliseconds in base 36, lower case."""
    return F.lower(F.conv(F.unix_millis(at.cast("timestamp")).cast("string"), 10, 36))


def memory_filter(records: DataFrame, scope: str, kind: str | None = None, tags: list[str] | None = None, now: Column | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Records of a scope and kind that have all requested tags, have not expired by ``now`` (None: whatever their time) and are sure enough."""
    out = records.where((F.col("scope") == scope) & (F.col("confidence") >= min_confidence))
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    wanted = list(dict.fromkeys(t.strip().lower() for t in tags or [] if t.strip()))[:16]
    for tag in wanted:
        out = out.where(F.array_contains("tags", tag))
    return out if now is None else out.where(not_expired(F.col("expires_at"), now))


def memory_search(records: DataFrame, query: str, mode: str = "hybrid", limit: int = 20, offset: int = 0) -> DataFrame:
    """The records by score, confidence, time and id: 5 a term in the title, 3 in the tags, 2 in the links, 1 in the body, and 8 for the whole query in hybrid mode."""
    terms = query_terms(query, S.ALPHABETS["memory"])[:30]
    parts = {"title": F.lower("title"), "tags": F.lower(F.array_join("tags", " ")), "links": F.lower(F.array_join(F.transform("links", lambda x: x["target"]), " ")), "body": F.lower("body")}
    text = {k: F.coalesce(v, F.lit("")) for k, v in parts.items()}
    score = F.lit(0)
    for t in terms:
        for field, weight in (("title", 5), ("tags", 3), ("links", 2), ("body", 1)):
            score = score + F.when(text[field].contains(t), weight).otherwise(0)
    q = query.strip().lower()
    if terms and mode == "hybrid" and q:
        score = score + F.when(F.concat_ws("\n", text["title"], text["body"], text["tags"], text["links"]).contains(q), 8).otherwise(0)
    scored = records.withColumn("score", score)
    return scored.orderBy(F.desc("score"), F.desc("confidence"), F.desc("updated_at"), "id").offset(offset).limit(limit)


def catalog_search(artifacts: DataFrame, query: str, mode: str = "hybrid", limit: int = 20, offset: int = 0) -> DataFrame:
    """Catalog entries (file_path, title, links) by score and path: 4 a term in the path, 5 in the title, 2 in the links, 8 for the whole query; with terms only those that score."""
    terms = query_terms(query, S.ALPHABETS["memory"])[:30]
    text = {"path": F.lower("file_path"), "title": F.lower(F.coalesce("title", F.lit(""))), "links": F.lower(F.array_join(F.transform("links", lambda x: x["target"]), " "))}
    score = F.lit(0)
    for t in terms:
        for field, weight in (("path", 4), ("title", 5), ("links", 2)):
            score = score + F.when(text[field].contains(t), weight).otherwise(0)
    q = query.strip().lower()
    if terms and mode == "hybrid" and q:
        score = score + F.when(F.concat_ws("\n", *text.values()).contains(q), 8).otherwise(0)
    scored = artifacts.withColumn("score", score)
    return (scored.where("score > 0") if terms else scored).orderBy(F.desc("score"), "file_path").offset(offset).limit(limit)


def artifacts(files: DataFrame, query: str = "") -> DataFrame:
    """(file_path, kind, title, links, size_bytes, relevance) of the documents among files (filepath, content): 4 a term in the path, 5 in the title, 1 in the body; with terms only those that score."""
    path = S.normal_path(F.col("filepath"))
    rows = files.where(F.lower("filepath").rlike(r"\.(?:md|markdown|txt|rst)$")).select(path.alias("file_path"), S.artifact_kind(path).alias("kind"), F.coalesce(S.markdown_title(F.col("content")), S.stem(path)).alias("title"), S.markdown_links(F.col("content")).alias("links"), F.octet_length("content").alias("size_bytes"), "content")
    terms = query_terms(query, S.ALPHABETS["artifact"])[:20]
    score = F.lit(0)
    for t in terms:
        for field, weight in (("file_path", 4), ("title", 5), ("content", 1)):
            score = score + F.when(F.lower(field).contains(t), weight).otherwise(0)
    out = rows.withColumn("relevance", score)
    return (out.where("relevance > 0") if terms else out).drop("content")


def catalog(documents: DataFrame, at: Column, most: int = MAX_CATALOG) -> DataFrame:
    """Metadata of the first ``most`` documents (of ``artifacts``) in order of path, with typed links and the time of indexing."""
    links = F.slice(F.filter(F.transform("links", typed_link), lambda x: x["target"] != ""), 1, 50)
    return documents.orderBy("file_path").limit(most).select("file_path", "kind", "title", "size_bytes", links.alias("links"), at.alias("indexed_at"))


def focus_score(path: Column, names: Column, focus: list[str]) -> Column:
    """Per focus word 3 if the path or a symbol equals it and 1 if one contains it."""
    lowered = F.concat(F.array(F.lower(F.regexp_replace(S.normal_path(path), "/$", ""))), F.transform(names, F.lower))
    score = F.lit(0)
    for word in focus:
        w = word.replace("\\", "/").removeprefix("./").removesuffix("/").lower()
        score = score + F.when(F.exists(lowered, lambda x: x == w), 3).otherwise(0) + F.when(F.exists(lowered, lambda x: x.contains(w)), 1).otherwise(0)
    return score


def ranked_files(files: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` files (path, focus, rank) by focus, rank and path, with score rank + focus / 10."""
    return files.orderBy(F.desc("focus"), F.desc("rank"), "path").limit(most).select("path", "focus", "rank", F.round(F.col("rank") + F.col("focus") / 10, 6).alias("score"))


# ------------------------------------------------------------------ findings, locations, tasks, gates
def merged_signals(signals: DataFrame, key: str, most: int = 50) -> DataFrame:
    """(key, count, kinds, sources, first) of instruction signals (key, source, start, kind): the first ``most`` by source, place and kind, and their distinct kinds."""
    ranked = signals.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy("source", "start", "kind"))).where(F.col("rn") <= most)
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.count_distinct("source").alias("sources"), F.min_by("kind", "rn").alias("first"))


def distinct_locations(locations: DataFrame, root: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` different places (path, start, stop) within the root, in order; and (external, total): how many lay outside, how many places there were."""
    inside = F.col("path").startswith(root.rstrip("/") + "/")
    once = locations.groupBy("path", "start", "stop").agg(F.min("place").alias("place"))
    kept = once.where(inside).orderBy("place").limit(most)
    return kept, once.agg(F.count_if(~inside).alias("external"), F.count(F.lit(1)).alias("total"))


def truncated(df: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first ``most`` rows of a total order with ``truncated``: whether there were more. One row more is read, not all counted."""
    some = df.orderBy(*order).limit(most + 1)
    n = some.agg(F.count(F.lit(1)).alias("n")).scalar()
    return some.orderBy(*order).limit(most).withColumn("truncated", n > most)


def task_states(tasks: DataFrame, events: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """(id, status, updated_at) after transitions (id, status, at): those after a terminal one are ignored, and tasks past their time are purged.

    A running task whose owner is gone (``orphan``) has failed.
    """
    first_end = events.where(F.col("status").isin(TERMINAL)).groupBy("id").agg(F.min(F.struct("at", "status")).alias("end"))
    last = events.groupBy("id").agg(F.max(F.struct("at", "status")).alias("last"))
    joined = tasks.join(last, "id", "left").join(first_end, "id", "left")
    fresh = ~F.col("status").isin(TERMINAL)
    final = F.when(fresh & F.col("end").isNotNull(), F.col("end")).when(fresh & F.col("last").isNotNull(), F.col("last")).otherwise(F.struct(F.col("updated_at").alias("at"), "status"))
    out = joined.withColumn("f", final)
    status = F.when(F.col("orphan") & ~F.col("f.status").isin(TERMINAL), "failed").otherwise(F.col("f.status"))
    return out.select("id", status.alias("status"), F.col("f.at").alias("updated_at")).where(F.unix_timestamp(now) - F.unix_timestamp("updated_at") < ttl_seconds)


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def quality_gate(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(metric, value, threshold, passed): the mean of each metric over the queries against its threshold; no query at all passes nothing."""
    means = metrics.agg(*[F.round(F.avg(k), 4).alias(k) for k in thresholds])
    rows = means.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("threshold")) for k, v in thresholds.items()))).alias("m")).select("m.*")
    return rows.withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))


def freshness(recorded: str | None, current: DataFrame, cache_valid: bool = True, most: int = 20_000) -> DataFrame:
    """(state): fresh or stale by the fingerprint of the files as they are (fingerprint, files); unknown without a well-formed record or cache, or above ``most`` files."""
    known = recorded is not None and cache_valid and len(recorded) in range(16, 65) and all(c in "0123456789abcdef" for c in recorded)
    if not known:
        return current.select(F.lit("unknown").alias("state"))
    same = F.substring("fingerprint", 1, 16) == F.lit(recorded[:16])
    return current.select(F.when(F.col("files") > most, "unknown").when(same, "fresh").otherwise("stale").alias("state"))


def provenance(sources: Column) -> Column:
    """Where a result comes from, the strongest of its sources: language server, index, file system, analysis."""
    order = ["lsp", "index", "filesystem", "analysis"]
    out = F.lit("analysis")
    for s in reversed(order[:-1]):
        out = F.when(F.array_contains(sources, s), s).otherwise(out)
    return out


def prometheus(metrics: DataFrame, prefix: str) -> DataFrame:
    """(line) text exposition of tool metrics (tool, calls, failures, p50, p95): a counter of calls by outcome and two quantiles each."""
    tool = F.regexp_replace("tool", r'([\\"])', r"\\$1")
    row = lambda name, label, value: F.concat(F.lit(f"{prefix}_{name}{{tool=\""), tool, F.lit(f"\"{label}}} "), value.cast("string"))
    lines = F.array(row("calls_total", ',outcome="success"', F.col("calls") - F.col("failures")), row("calls_total", ',outcome="failure"', F.col("failures")), row("duration_ms", ',quantile="0.5"', F.col("p50")), row("duration_ms", ',quantile="0.95"', F.col("p95")))
    return metrics.select(F.explode(lines).alias("line"))
