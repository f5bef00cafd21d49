"""Composite requests: search, repository map, changed symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, retrieval
from ..operators.relational import adjacent, byte_budget_prefix, keep_first, keyed_range_join, search_filter


def search(chunks: DataFrame, query: str, vector: list[float] | None = None, mode: str = "fts", rerank: str = "lexical", limit: int = 10, offset: int = 0, floor: float = 0.0, threshold: float | None = None, weight: float = 0.5, neighbours: int = 0, **filters) -> DataFrame:
    """(id, filepath, startline, score, confidence, rank, neighbour_of) of one search.

    The first 500 candidates of the mode are ordered, then filtered, each (file, line, symbol) once, widened by
    up to 3 neighbours of the first 20 hits, reranked, rated, and cut to those of enough confidence and the
    page. The filters follow the pool, as they narrow a result and don't widen it; ``threshold`` is a distance
    and counts in vector mode only.
    """
    found = retrieval.candidates(chunks, query, vector or [], mode, retrieval.POOL + 1, weight)
    better = F.col("score").asc() if mode == "vector" else F.col("score").desc()
    order = [better, "filepath", "startline", "id"]
    pool = retrieval.top_k(found, retrieval.POOL, better, "id").join(chunks, "id")
    if threshold is not None and mode == "vector":
        pool = pool.where(F.col("score") <= threshold)
    kept = keep_first(search_filter(pool, **filters), ["filepath", "startline", "symbolname"], *order)
    hits = retrieval.with_rank(kept, *order).withColumn("neighbour_of", F.lit(None).cast("string")).withColumn("distance", F.lit(None).cast("int"))
    if neighbours:
        seeds = hits.where("rank < 20").select("id", F.col("score").alias("seed_score"), F.col("rank").alias("seed_rank"))
        near = adjacent(chunks, seeds, min(3, neighbours)).join(seeds.withColumnRenamed("id", "seed"), "seed").join(search_filter(chunks, **filters), "id")
        score = retrieval.neighbour_score(F.col("seed_score"), F.col("distance"), mode == "vector" and rerank == "none")
        placed = near.withColumn("score", score).withColumn("side_order", F.when(F.col("side") == "before", 0).otherwise(1))
        first = retrieval.with_rank(placed, "seed_rank", "distance", "side_order", "id").where("rank < 120").withColumn("rank", F.col("rank") + 1000)
        wide = hits.unionByName(first.withColumn("neighbour_of", F.col("seed").cast("string")).select(*hits.columns))
        hits = retrieval.with_rank(keep_first(wide, ["filepath", "startline", "symbolname"], "rank", "id").withColumnRenamed("rank", "_r"), "_r").drop("_r")
    scored = retrieval.rerank(hits, query, rerank)
    again = scored.withColumnRenamed("rank", "_old").withColumn("score", F.col("rerank_score")).drop("rerank_score")
    placed = retrieval.with_rank(again, *([F.desc("score"), "_old"] if rerank != "none" else ["_old"]))
    rated = retrieval.confidence(placed, query).where(F.col("confidence") >= floor)
    return rated.orderBy("rank").offset(offset).limit(limit).select("id", "filepath", "startline", F.round("score", 6).alias("score"), "confidence", "rank", "neighbour_of")


def repository_map(edges: DataFrame, files: DataFrame, tokens: int) -> DataFrame:
    """Files (node, focus, text) by personalised rank within a token budget."""
    rank = graph.pagerank(edges, files.select("node", "focus"))
    ordered = files.join(rank, "node").withColumn("key", F.concat(F.lpad(F.format_number(1e6 - F.col("rank") * 1e6, 6), 20, "0"), F.lit(" "), F.col("node").cast("string")))
    return byte_budget_prefix(ordered, tokens, "key", "text").select("node", "rank", "used")


def changed_symbols(symbols: DataFrame, hunks: DataFrame, whole: DataFrame) -> DataFrame:
    """Symbols (filepath, name, line, endline) that a hunk (filepath, start, stop) touches, or whose file changed as a whole."""
    a = symbols.select("filepath", "name", "line", "endline").distinct().withColumn("a1", F.col("line")).withColumn("a2", F.coalesce("endline", "line"))
    b = hunks.select("filepath", F.col("start").alias("b1"), F.col("stop").alias("b2")).distinct()
    touched = keyed_range_join(a, b, "filepath", 64).select("filepath", "name", "line", "endline")
    return touched.unionByName(symbols.select("filepath", "name", "line", "endline").join(whole, "filepath", "left_semi")).distinct()
