"""Retrieval and scoring over a chunk table (id, content, filepath, language, startline, symbolname, symboltype)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import BOUNDARY, content_parts, split_camel, tokens

RRF_K = 60
POOL = 500


def query_terms(query: str, alphabet: str = r"[a-z0-9_$]+") -> list[str]:
    """Distinct terms of a query, in order."""
    return list(dict.fromkeys(re.findall(alphabet, query.lower())))


def _occurrences(text: Column, term: str) -> Column:
    return F.regexp_count(text, F.lit(f"{BOUNDARY}{re.escape(term)}{BOUNDARY}"))


def _pieces(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def lexical_scores(chunks: DataFrame, query: str) -> DataFrame:
    """The chunks with a positive ``score``: whole-word hits in the content, three times those in the symbol, half of those in the path, 2 for the whole query.

    A query without terms gives no row; nulls count as empty texts.
    """
    terms = query_terms(query)
    if not terms:
        return chunks.limit(0).withColumn("score", F.lit(0.0))
    content, path = F.lower(F.coalesce("content", F.lit(""))), F.lower(F.coalesce("filepath", F.lit("")))
    symbol = F.lower(F.concat_ws(" ", F.coalesce("symbolname", F.lit("")), F.coalesce("symboltype", F.lit(""))))
    score = F.when(content.contains(query.lower().strip()), 2.0).otherwise(0.0)
    for t in terms:
        score = score + _occurrences(content, t) + 3 * _occurrences(symbol, t) + 0.5 * _pieces(path, t)
    return chunks.withColumn("score", score.cast("double")).where("score > 0")


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of a total order; a limit below 1 gives none."""
    return df.limit(0) if k < 1 else df.orderBy(*order).limit(k)


def squared_distance(vector: Column, query: list[float]) -> Column:
    """Squared Euclidean distance in double precision."""
    target = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, target, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def vector_top_k(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id", threshold: float | None = None) -> DataFrame:
    """(key, score) of the ``k`` nearest vectors, score being the squared distance; optionally only those within ``threshold``."""
    scored = vectors.where(valid_embedding(F.col(vector), len(query))).select(key, squared_distance(F.col(vector), query).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") <= threshold)
    return top_k(scored, k, "score", key)


def valid_embedding(vector: Column, dim: int) -> Column:
    """Exact dimension and only finite values."""
    return F.coalesce((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))), F.lit(False))


def lexical_embedding(df: DataFrame, dim: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, slot, value): deterministic embedding, each token adding 1 to one slot and taking 0.25 from another, then unit length.

    The distinct tokens are hashed once each; rows of all-zero vectors stay zero.
    """
    from ..functions.scalars import fnv1a

    words = df.select(key, F.explode(tokens(split_camel(F.col(text)), "embedding")).alias("token")).groupBy(key, "token").count()
    table = words.select("token").distinct().withColumn("h", fnv1a(F.col("token")))
    hashed = words.join(table, "token")
    plus = hashed.select(key, (F.col("h") % dim).alias("slot"), F.col("count").cast("double").alias("x"))
    minus = hashed.select(key, (F.col("h").bitwiseXOR(F.lit(0x9E3779B9)) % dim).alias("slot"), (F.col("count") * -0.25).alias("x"))
    slots = plus.unionByName(minus).groupBy(key, "slot").agg(F.sum("x").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key)))
    return slots.select(key, "slot", F.when(norm > 0, F.col("x") / norm).otherwise(F.col("x")).alias("value"))


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, limit: int, weight: float = 0.5, key: str = "id") -> DataFrame:
    """(key, score) of two ranked lists (key, rank from 0) merged by weighted reciprocal ranks.

    A weight that isn't finite is 0.5, others are clamped to 0..1. Ties keep the first list's order.
    """
    w = min(1.0, max(0.0, weight)) if math.isfinite(weight) else 0.5
    a = first.where(F.col("rank") < 2 * limit).select(key, (w / (RRF_K + F.col("rank") + 1)).alias("s"), F.col("rank").alias("o"))
    b = second.where(F.col("rank") < 2 * limit).select(key, ((1 - w) / (RRF_K + F.col("rank") + 1)).alias("s"), (F.col("rank") + 2 * limit).alias("o"))
    merged = a.unionByName(b).groupBy(key).agg(F.sum("s").alias("score"), F.min("o").alias("o"))
    return top_k(merged, limit, F.desc("score"), "o", key).drop("o")


def with_rank(df: DataFrame, *order: Column | str) -> DataFrame:
    """0-based ``rank`` in a total order, for a result that a limit has already bounded."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order)) - 1)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf): the full-text index of a table."""
    return docs.select(key, F.explode(tokens(F.col(text), "search")).alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: str, k: int, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the ``k`` best documents by BM25 with k1 = 1.2 and b = 0.75.

    Only the query's terms leave the tokeniser; the lengths are counted without exploding them.
    """
    terms = query_terms(query)
    sized = docs.where(F.col(text).isNotNull()).select(key, tokens(F.col(text), "search").alias("words"))

    def uses(term: str) -> Column:
        return F.size(F.filter("words", lambda x: x == F.lit(term)))

    lengths = sized.select(key, F.size("words").alias("len"), *[uses(t).alias(f"t{i}") for i, t in enumerate(terms)])
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    hit = lengths.where(" or ".join(f"t{i} > 0" for i in range(len(terms))) or "false")
    if not terms:
        return docs.limit(0).select(key, F.lit(0.0).alias("score"))
    one = stats.select(F.struct("*").alias("s")).scalar()  # statistics of the whole table, as one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"t{i}"), one[f"d{i}"]
        idf = F.log(1 + (one["n"] - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / one["avg"]))
    joined = hit
    return top_k(joined.select(key, score.alias("score")), k, F.desc("score"), key)


def full_text(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """(id, score) of the ``k`` best chunks by BM25, the score being one over the place."""
    best = bm25(chunks, query, k, "id", "content")
    return with_rank(best, F.desc("score"), "id").select("id", (1.0 / (F.col("rank") + 1)).alias("score"))


def candidates(chunks: DataFrame, query: str, vector: list[float], mode: str = "hybrid", limit: int = POOL + 1, weight: float = 0.5) -> DataFrame:
    """(id, score) of the first ``limit`` chunks in the mode: ``vector`` (distance, less is nearer), ``fts`` (one over the place) or ``hybrid`` (fused ranks of twice as many of both)."""
    if mode == "vector":
        return vector_top_k(chunks, vector, limit, "vector", "id")
    if mode == "fts":
        return full_text(chunks, query, limit)
    if mode != "hybrid":
        raise ValueError(f"mode {mode}")
    near = with_rank(vector_top_k(chunks, vector, 2 * limit, "vector", "id"), "score", "id").select("id", "rank")
    text = with_rank(full_text(chunks, query, 2 * limit), F.desc("score"), "id").select("id", "rank")
    return reciprocal_rank_fusion(near, text, limit, weight)


_IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)?$"


def split_terms(query: str) -> list[str]:
    """Distinct terms of a query whose camel case is split first, as reranking and classification read it."""
    return query_terms(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query))


def query_kind(query: str) -> str:
    """identifier, concept or mixed: one name is an identifier, a name of two terms is mixed, everything else a concept."""
    text = query.strip()
    terms = split_terms(text)
    named = re.match(_IDENTIFIER, text) is not None or any("_" in t or "$" in t for t in terms)
    if named and len(terms) <= 2:
        return "identifier" if len(terms) == 1 else "mixed"
    return "concept"


def classify_query(query: Column) -> Column:
    """``query_kind`` of a column."""
    text = F.trim(query)
    terms = F.array_distinct(tokens(split_camel(text), "search"))
    named = text.rlike(_IDENTIFIER) | F.exists(terms, lambda t: t.contains("_") | t.contains("$"))
    return F.when(named & (F.size(terms) == 1), "identifier").when(named & (F.size(terms) <= 2), "mixed").otherwise("concept")


def _symbol_text() -> Column:
    return F.lower(F.concat(F.coalesce("symbolname", F.lit("")), F.lit(" "), F.coalesce("symboltype", F.lit(""))))


def rerank(pool: DataFrame, query: str, mode: str = "lexical") -> DataFrame:
    """A ranked pool (rank from 0, bounded) with ``rerank_score`` mixing the old position and a term signal.

    Without terms, with mode ``none`` or with fewer than two rows the old ``score`` stays.
    """
    terms, q = split_terms(query), query.strip().lower()
    if mode == "none" or not terms:
        return pool.withColumn("rerank_score", F.col("score"))
    content, path, symbol = F.lower(F.coalesce("content", F.lit(""))), F.lower(F.coalesce("filepath", F.lit(""))), _symbol_text()
    weight = 1.5 if query_kind(query) == "concept" else 3.0
    signal = F.lit(0.0)
    for t in terms:
        signal = signal + F.when(symbol.contains(t), weight).otherwise(0.0) + F.when(content.contains(t), 1.0).otherwise(0.0) + F.when(path.contains(t), 0.5).otherwise(0.0)
    most, old, new = 4.5, 0.65, 0.35
    if mode == "code":
        name = F.lower(F.coalesce("symbolname", F.lit("")))
        words = tokens(name, "search")
        signal = signal + F.when(name == q, 8.0).otherwise(0.0)
        for t in terms:
            signal = signal + F.when(F.array_contains(words, t), 3.0).otherwise(0.0)
        signature = F.lower(F.coalesce(content_parts(F.coalesce("content", F.lit("")))[1], F.lit("")))
        signal = signal + F.when(signature.contains(q) & (signature != ""), 2.0).otherwise(0.0)
        most, old, new = 8.0, 0.4, 0.6
    share = F.least(F.lit(1.0), signal / max(most * len(terms), 1.0))
    several = F.count(F.lit(1)).over(W.partitionBy(F.lit(1))) > 1  # of a bounded pool
    return pool.withColumn("rerank_score", F.when(several, old / (F.col("rank") + 1) + new * share).otherwise(F.col("score")))


def confidence(ranked: DataFrame, query: str) -> DataFrame:
    """A ranked result (rank, score; ``distance`` for neighbours) with ``confidence`` between 0 and 1."""
    terms, q = split_terms(query), query.lower()
    symbol, content = _symbol_text(), F.lower(F.coalesce("content", F.lit("")))
    matched = sum((F.when(content.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    following = F.lead("score").over(W.orderBy("rank"))  # a bounded result
    margin = F.when(F.col("score") > following, F.least(F.lit(0.12), (F.col("score") - following) / F.greatest(F.abs("score"), F.lit(1.0)))).otherwise(0.0)
    named = 0.16 if query_kind(query) == "concept" else 0.35
    value = 0.25 + F.least(F.lit(0.25), 0.2 / (F.col("rank") + 1)) + F.when(symbol.contains(q), named).otherwise(0.0) + F.when(content.contains(q), 0.16).otherwise(0.0) + 0.18 * matched / max(len(terms), 1) + margin
    if "distance" in ranked.columns:
        value = value * F.when(F.col("distance").isNull(), 1.0).otherwise(F.pow(F.lit(0.82), F.col("distance")))
    return ranked.withColumn("confidence", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 4))


def abstention(scored: DataFrame, floor: float) -> DataFrame:
    """One row (candidates, kept, abstained): whether a positive floor leaves nothing of a result that had rows."""
    return scored.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("confidence") >= floor).alias("kept")).withColumn("abstained", (F.col("candidates") > 0) & (F.col("kept") == 0) & F.lit(floor > 0))


def neighbour_score(score: Column, distance: Column, vector_mode: bool = False) -> Column:
    """Score of a chunk that stands ``distance`` rows from a hit."""
    return score + 0.05 * distance if vector_mode else score * F.pow(F.lit(0.82), distance)


def presence_score(query: str, weights: dict[str, float], phrase: float = 0.0, alphabet: str = r"[a-z0-9_$.-]+", limit: int = 30) -> Column:
    """Per term the weight of each field that contains it, and ``phrase`` if the fields together hold the whole query."""
    score = F.lit(0.0)
    for t in query_terms(query, alphabet)[:limit]:
        for field, w in weights.items():
            score = score + F.when(F.lower(F.coalesce(F.col(field), F.lit(""))).contains(t), w).otherwise(0.0)
    if phrase:
        score = score + F.when(F.lower(F.concat_ws(" ", *weights)).contains(query.lower().strip()), phrase).otherwise(0.0)
    return score


def baseline_scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): 5 for the whole query and the literal occurrences of its terms; documents without any keep 0."""
    body, name = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(F.col(key).cast("string"))
    score = F.when(body.contains(query.lower().strip()), 5.0).otherwise(0.0)
    for t in query_terms(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query)):
        score = score + _pieces(body, t) + 3 * _pieces(name, t)
    return docs.select(key, score.alias("score"))


def ranked_metrics(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, precision, recall, mrr, ndcg) at ``k`` of ranked results (query, id, rank from 1) against (query, id).

    Only the first occurrence of a relevant id counts; repeats keep their ranks.
    """
    top = results.where(F.col("rank") <= k)
    first = top.groupBy("query", "id").agg(F.min("rank").alias("rank"))
    hits = first.join(relevant.distinct(), ["query", "id"])
    gained = hits.groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("best"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = relevant.distinct().groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return wanted.join(gained, "query", "left").select(
        "query",
        F.round(F.coalesce("hits", F.lit(0)) / k, 4).alias("precision"),
        F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 4).alias("recall"),
        F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 4).alias("mrr"),
        F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 4).alias("ndcg"),
    )


def dead_code_confidence(kind: Column) -> Column:
    return F.when(kind == "method", 0.70).otherwise(0.82)


def revision_state(recorded: Column, current: Column) -> Column:
    """current, stale, or unknown where either is missing."""
    return F.when(recorded.isNull() | current.isNull(), "unknown").when(recorded == current, "current").otherwise("stale")


def embed_with(df: DataFrame, client, dim: int, text: str = "content", batch: int = 10) -> DataFrame:
    """``df`` with ``vector`` from an embedding client: a picklable object that, called in a worker, gives a function from a list of texts to a list of vectors.

    Batches go to the client in the size it takes; a missing vector, one of another length or with a value
    that is not finite fails the job, so that no index is written from part of them.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches):
        embed = client()
        for pdf in batches:
            texts, vectors = pdf[text].fillna("").to_list(), []
            for k in range(0, len(texts), batch):
                got = embed(texts[k : k + batch])
                if len(got) != len(texts[k : k + batch]) or any(len(v) != dim or not all(math.isfinite(x) for x in v) for v in got):
                    raise ValueError("an embedding is missing or malformed")
                vectors += got
            yield pdf.assign(vector=vectors)

    return df.mapInPandas(run, schema)
