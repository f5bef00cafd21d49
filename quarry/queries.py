"""Core queries with their SQL equivalents: name -> (function of (session, folder), SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import extract as X
from .operators import graph as G
from .operators import relational as R
from .operators import retrieval as V
from .plans import search as P
from .sinks import versioned as K
from .sources import files as L
from .streaming import changes as C
from .tables import read

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ------------------------------------------------------------------ views
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents seen as chunks."""
    return read(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.concat_ws("/", F.coalesce("repo", F.lit("")), F.lower(F.trim(F.coalesce("source", F.lit(""))))).alias("filepath"), F.lower("lang").alias("language"), F.col("doc_id").cast("int").alias("startline"), F.col("doc_id").cast("int").alias("endline"), F.coalesce("title", F.lit("")).alias("symbolname"), F.lit("section").alias("symboltype"))


CHUNKS = "chunks AS (SELECT doc_id AS id, text AS content, coalesce(repo, '') || '/' || lower(trim(coalesce(source, ''))) AS filepath, lower(lang) AS language, doc_id::INT AS startline, doc_id::INT AS endline, coalesce(title, '') AS symbolname, 'section' AS symboltype FROM documents)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers and the suppliers they bought from, in one space of keys: some suppliers are hot."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    pairs = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return pairs.where("src <> dst").distinct()


EDGES = "edges AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey)"


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols once each, with normalised paths."""
    return read(spark, d, "unified_symbols").select("repo", S.normal_path(F.col("filepath")).alias("filepath"), "name", "type", "line", "endline", "signature").where("name IS NOT NULL AND filepath IS NOT NULL AND line IS NOT NULL").distinct()


SYMBOLS = "symbols AS (SELECT DISTINCT repo, regexp_replace(replace(filepath, '\\', '/'), '^\\./', '') AS filepath, name, type, line, endline, signature FROM unified_symbols WHERE name IS NOT NULL AND filepath IS NOT NULL AND line IS NOT NULL)"
PATH = "regexp_replace(replace(filepath, '\\', '/'), '^\\./', '')"
QUERY = "frozen cache"
_SCORE = """(CASE WHEN contains(lower(coalesce(content,'')), 'frozen cache') THEN 2.0 ELSE 0 END
 + {0})""".format(" + ".join(f"len(regexp_extract_all(lower(coalesce(content,'')), '\\b{t}\\b')) + 3 * len(regexp_extract_all(lower(symbolname || ' ' || symboltype), '\\b{t}\\b')) + 0.5 * ((length(lower(filepath)) - length(replace(lower(filepath), '{t}', ''))) / {len(t)})" for t in ("frozen", "cache")))  # fmt: skip
SCORED = f"scored AS (SELECT *, ({_SCORE})::DOUBLE AS score FROM chunks WHERE {_SCORE} > 0)"


# ------------------------------------------------------------------ retrieval
@query(f"WITH {CHUNKS}, {SCORED} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 10")
def lexical_topk(s, d):
    return V.top_k(V.lexical_scores(chunks(s, d), QUERY), 10, F.desc("score"), "id").select("id", "score")


@query(f"WITH {CHUNKS}, {SCORED} SELECT id, score, filepath FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 500) WHERE lower(language) = 'en' AND NOT regexp_matches(lower(filepath), '(^|/)(tests?|__tests__|specs?)/')")
def lexical_filtered(s, d):
    pool = V.top_k(V.lexical_scores(chunks(s, d), QUERY), 500, F.desc("score"), "id")
    return R.search_filter(pool, language="EN", include_tests=False).select("id", "score", "filepath")


_TARGET = [((i * 37) % 64 - 32) / 200 for i in range(64)]
_DIST = "list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - [{}][i]) * (embedding[i]::DOUBLE - [{}][i])))".format(*[", ".join(f"{x}::DOUBLE" for x in _TARGET)] * 2)


@query(f"SELECT vec_id, round(dist, 6) AS score FROM (SELECT vec_id, {_DIST} AS dist FROM embeddings) ORDER BY dist, vec_id LIMIT 10")
def vector_topk(s, d):
    return V.vector_top_k(read(s, d, "embeddings"), _TARGET, 10).withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id, round(dist, 6) AS score FROM (SELECT vec_id, {_DIST} AS dist FROM embeddings) WHERE dist <= 1.5 ORDER BY dist, vec_id LIMIT 50")
def vector_threshold(s, d):
    return V.vector_top_k(read(s, d, "embeddings"), _TARGET, 50, threshold=1.5).withColumn("score", F.round("score", 6))


@query("SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64) AS valid FROM embeddings GROUP BY label")
def valid_embeddings(s, d):
    return read(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(V.valid_embedding(F.col("embedding"), 64)).alias("valid"))


@query("""
WITH w AS (SELECT s_suppkey AS key, unnest(regexp_extract_all(lower(regexp_replace(s_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9_]+')) AS token FROM supplier),
t AS (SELECT key, token, count(*) AS n FROM w GROUP BY 1, 2),
h AS (SELECT key, n, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length(token) + 1), lambda i: unicode(substr(token, i, 1))::UBIGINT)), lambda a, c: (xor(a, c) * 16777619::UBIGINT) & 4294967295::UBIGINT) AS h FROM t),
p AS (SELECT key, (h % 16)::BIGINT AS slot, n::DOUBLE AS x FROM h UNION ALL SELECT key, (xor(h, 2654435769::UBIGINT) % 16)::BIGINT, -0.25 * n FROM h),
q AS (SELECT key, slot, sum(x) AS x FROM p GROUP BY 1, 2)
SELECT key AS s_suppkey, slot, round(CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY key)) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY key)) ELSE x END, 6) AS value FROM q""")
def lexical_embedding(s, d):
    return V.lexical_embedding(read(s, d, "supplier"), 16, "s_suppkey", "s_name").withColumn("value", F.round("value", 6))


def _two_lists(s, d):
    text = V.with_rank(V.top_k(V.lexical_scores(chunks(s, d), QUERY), 40, F.desc("score"), "id"), F.desc("score"), "id").select("id", "rank")
    near = V.with_rank(V.vector_top_k(read(s, d, "embeddings"), _TARGET, 40), "score", "vec_id").select(F.col("vec_id").alias("id"), "rank")
    return near, text


_RRF = f"""WITH {CHUNKS}, {SCORED},
a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY dist, vec_id) - 1 AS rank FROM (SELECT vec_id, {_DIST} AS dist FROM embeddings) QUALIFY rank < 40),
b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM scored QUALIFY rank < 40),
m AS (SELECT id, {{0}} / (61.0 + rank) AS s, rank AS o FROM a UNION ALL SELECT id, {{1}} / (61.0 + rank), rank + 40 FROM b)
SELECT id, round(sum(s), 8) AS score FROM m GROUP BY id ORDER BY sum(s) DESC, min(o), id LIMIT 20"""


@query(_RRF.format("0.5", "0.5"))
def rrf_hybrid(s, d):
    return V.reciprocal_rank_fusion(*_two_lists(s, d), 20).withColumn("score", F.round("score", 8))


@query(_RRF.format("0.8", "(1 - 0.8)"))
def rrf_weighted(s, d):
    return V.reciprocal_rank_fusion(*_two_lists(s, d), 20, 0.8).withColumn("score", F.round("score", 8))


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_$]+') AS w FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: x = 'frozen')) AS a, len(list_filter(w, lambda x: x = 'cache')) AS b FROM t),
g AS (SELECT count(*) AS n, avg(len) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM l)
SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / m)) AS score FROM l, g WHERE a > 0 OR b > 0) ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_topk(s, d):
    return V.bm25(read(s, d, "documents"), QUERY, 20).withColumn("score", F.round("score", 6))


@query("SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_$]+')) AS term FROM documents) GROUP BY 1, 2")
def fts_postings(s, d):
    return V.postings(read(s, d, "documents"))


_POOL = f"WITH {CHUNKS}, {SCORED}, pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM scored QUALIFY rank < 50)"
_SIG = "+".join(f"(CASE WHEN contains(lower(symbolname || ' ' || symboltype), '{t}') THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(coalesce(content,'')), '{t}') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(filepath), '{t}') THEN 0.5 ELSE 0 END)" for t in ("frozen", "cache"))


def _pool(s, d):
    return V.with_rank(V.top_k(V.lexical_scores(chunks(s, d), QUERY), 50, F.desc("score"), "id"), F.desc("score"), "id")


@query(f"{_POOL} SELECT id, rank, round(0.65 / (rank + 1) + 0.35 * least(1.0, ({_SIG}) / 9.0), 6) AS rerank_score FROM pool")
def rerank_lexical(s, d):
    return V.rerank(_pool(s, d), QUERY).select("id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


_NAME = "lower(symbolname)"


# lines, the first that is neither blank nor a comment, and the code from there
_SPLIT = r"""string_split(coalesce(content, ''), chr(10)) AS ls, list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: regexp_matches(x, '^\s*(//|#|/\*|\*)') OR regexp_replace(x, '\s', '', 'g') = '') AS remark"""
_CODE_SQL = rf"""lined AS (SELECT *, coalesce(nullif(list_position(remark, FALSE), 0), len(ls) + 1) AS first FROM (SELECT *, {_SPLIT} FROM {{0}})),
coded AS (SELECT *, array_to_string(list_filter(ls[1:first - 1], lambda x: regexp_replace(x, '\s', '', 'g') <> ''), chr(10)) AS doc, array_to_string(ls[first:], chr(10)) AS code FROM lined),
opened AS (SELECT *, least(coalesce(nullif(instr(code, '{{{{'), 0), 1000000000), coalesce(nullif(instr(code, '=>'), 0), 1000000000)) AS opening FROM coded),
parted AS (SELECT *, regexp_replace(CASE WHEN opening < 1000000000 THEN left(code, opening - 1) ELSE split_part(code, chr(10), 1) END, '^\s+|\s+$', '', 'g') AS head, regexp_replace(CASE WHEN opening < 1000000000 THEN substr(code, opening) ELSE code END, '^\s+|\s+$', '', 'g') AS body FROM opened)"""


@query(f"""{_POOL}, {_CODE_SQL.format("pool")} SELECT id, rank, round(0.4 / (rank + 1) + 0.6 * least(1.0, ({_SIG} + CASE WHEN {_NAME} = 'frozen cache' THEN 8.0 ELSE 0 END
 + CASE WHEN list_contains(regexp_extract_all({_NAME}, '[a-z0-9_$]+'), 'frozen') THEN 3.0 ELSE 0 END + CASE WHEN list_contains(regexp_extract_all({_NAME}, '[a-z0-9_$]+'), 'cache') THEN 3.0 ELSE 0 END
 + CASE WHEN contains(lower(head), 'frozen cache') THEN 2.0 ELSE 0 END) / 16.0), 6) AS rerank_score FROM parted""")
def rerank_code(s, d):
    return V.rerank(_pool(s, d), QUERY, "code").select("id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


_CONF = """least(1.0, greatest(0.0, 0.25 + least(0.25, 0.2 / (rank + 1)) + CASE WHEN contains(lower(symbolname || ' ' || symboltype), 'frozen cache') THEN 0.16 ELSE 0 END + CASE WHEN contains(lower(coalesce(content,'')), 'frozen cache') THEN 0.16 ELSE 0 END
 + 0.18 * ((CASE WHEN contains(lower(coalesce(content,'')), 'frozen') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(coalesce(content,'')), 'cache') THEN 1 ELSE 0 END)) / 2
 + CASE WHEN score > lead(score) OVER (ORDER BY rank) THEN least(0.12, (score - lead(score) OVER (ORDER BY rank)) / greatest(abs(score), 1.0)) ELSE 0 END))"""


@query(f"{_POOL} SELECT id, rank, floor(round({_CONF}, 4) * 1000 + 0.25)::BIGINT AS permille FROM pool")
def confidence(s, d):
    return V.confidence(_pool(s, d), QUERY).select("id", "rank", F.floor(F.col("confidence") * 1000 + 0.25).alias("permille"))  # the engines round half-way cases differently


@query(f"{_POOL} SELECT count(*) AS candidates, count(*) FILTER (c >= 0.99) AS kept, count(*) > 0 AND count(*) FILTER (c >= 0.99) = 0 AS abstained FROM (SELECT round({_CONF}, 4) AS c FROM pool)")
def abstain(s, d):
    return V.abstention(V.confidence(_pool(s, d), QUERY), 0.99)


@query("""WITH c AS (SELECT DISTINCT id, regexp_replace(replace(filepath, '\\', '/'), '^\\./', '') AS filepath, startline, endline FROM code_chunks),
p AS (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY startline, endline, id) AS rn FROM c), x AS (SELECT id AS seed, filepath, rn FROM p)
SELECT seed, p.id, abs(p.rn - x.rn) AS distance, CASE WHEN p.rn < x.rn THEN 'before' ELSE 'after' END AS side, round(pow(0.82, abs(p.rn - x.rn)), 6) AS factor FROM x JOIN p USING (filepath) WHERE p.rn <> x.rn AND abs(p.rn - x.rn) <= 3""")
def neighbor_expand(s, d):
    c = read(s, d, "code_chunks").select("id", S.normal_path(F.col("filepath")).alias("filepath"), "startline", "endline").distinct()
    return R.adjacent(c, c, 3).withColumn("factor", F.round(V.neighbour_score(F.lit(1.0), F.col("distance")), 6))


@query("SELECT doc_id, 0.0 + CASE WHEN contains(lower(text), 'frozen cache') THEN 5 ELSE 0 END + (length(lower(text)) - length(replace(lower(text), 'frozen', ''))) / 6 + (length(lower(text)) - length(replace(lower(text), 'cache', ''))) / 5 AS score FROM documents")
def baseline_rank(s, d):
    return V.baseline_scores(read(s, d, "documents"), QUERY)


@query(r"""SELECT name, CASE WHEN named AND n = 1 THEN 'identifier' WHEN named AND n <= 2 THEN 'mixed' ELSE 'concept' END AS kind FROM (
SELECT name, regexp_matches(trim(name), '^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)?$') OR len(list_filter(terms, lambda t: contains(t, '_') OR contains(t, '$'))) > 0 AS named, len(terms) AS n
FROM (SELECT name, list_distinct(regexp_extract_all(lower(regexp_replace(trim(name), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9_$]+')) AS terms FROM (SELECT name FROM unified_symbols WHERE name IS NOT NULL UNION SELECT title FROM documents WHERE title IS NOT NULL)))""")
def query_class(s, d):
    names = read(s, d, "unified_symbols").select("name").unionByName(read(s, d, "documents").select(F.col("title").alias("name")))
    return names.where("name IS NOT NULL").distinct().withColumn("kind", V.classify_query(F.col("name")))


_JUDGED = """rel AS (SELECT DISTINCT lower(trim(source)) AS query, doc_id AS id FROM documents WHERE source IS NOT NULL AND lower(lang) = 'en'),
res AS (SELECT lower(trim(source)) AS query, doc_id AS id, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE source IS NOT NULL)"""


@query(f"""WITH {_JUDGED}, w AS (SELECT query, count(*) AS n FROM rel GROUP BY 1), g AS (SELECT query, count(*) AS h, min(rank) AS b, sum(1 / log2(rank + 1)) AS dcg FROM res JOIN rel USING (query, id) WHERE rank <= 10 GROUP BY 1)
SELECT query, round(coalesce(h, 0) / 10.0, 4) AS precision, round(coalesce(h, 0)::DOUBLE / n, 4) AS recall, round(coalesce(1.0 / b, 0), 4) AS mrr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))), 4) AS ndcg FROM w LEFT JOIN g USING (query)""")
def eval_at_k(s, d):
    docs = read(s, d, "documents").where("source IS NOT NULL").withColumn("query", F.lower(F.trim("source")))
    relevant = docs.where("lower(lang) = 'en'").select("query", F.col("doc_id").alias("id"))
    ranked = R.top_per_key(docs, "query", 10, F.desc("n_chars"), "doc_id").select("query", F.col("doc_id").alias("id"), "rank")
    return V.ranked_metrics(ranked, relevant, 10)


@query(f"WITH {CHUNKS}, {SCORED} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 10 OFFSET 10")
def page_2(s, d):
    scope = {"query": QUERY}
    return R.page(V.lexical_scores(chunks(s, d), QUERY).select("id", "score"), R.read_cursor(R.cursor(scope, 10), scope), 10, F.desc("score"), "id")


# ------------------------------------------------------------------ scalars
@query("SELECT doc_id, ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(s, d):
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, 'chunk_' || substr(md5(coalesce(source, '') || ':' || doc_id || ':' || text), 1, 12) AS id FROM documents WHERE text IS NOT NULL")
def chunk_ids(s, d):
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", S.chunk_id(F.coalesce("source", F.lit("")), F.col("doc_id"), F.col("text")).alias("id"))


@query("SELECT doc_id, sha256(text) AS hash, 'project-' || substr(sha256(repo), 1, 24) AS project FROM documents")
def content_hashes(s, d):
    return read(s, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("hash"), S.project_id(F.col("repo")).alias("project"))


@query("""WITH b AS (SELECT substr(sha256(doc_id::VARCHAR), 1, 4) || ':' || sha256(string_agg(doc_id || chr(0) || sha256(text), chr(10) ORDER BY doc_id || chr(0) || sha256(text))) AS part FROM documents GROUP BY substr(sha256(doc_id::VARCHAR), 1, 4))
SELECT substr(sha256(string_agg(part, chr(10) ORDER BY part)), 1, 16) AS fingerprint FROM b""")
def wide_fingerprint(s, d):
    return K.wide_fingerprint(read(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), S.content_hash(F.col("text")).alias("hash")))


@query("SELECT doc_id, rtrim(translate(to_base64(encode(title)), '+/', '-_'), '=') AS code FROM documents WHERE title IS NOT NULL")
def base64url_titles(s, d):
    return read(s, d, "documents").where("title IS NOT NULL").select("doc_id", S.base64url(F.col("title")).alias("code"))


@query("SELECT doc_id, length(regexp_replace(text, '\\r\\n?', chr(10), 'g')) - length(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10), '')) + 1 AS lines FROM documents WHERE text IS NOT NULL")
def line_counts(s, d):
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", S.line_count(S.normal_newlines(F.col("text"))).alias("lines"))


@query()
def utf8_prefix(s, d):
    return read(s, d, "documents").select("doc_id", S.truncate_utf8(F.col("text"), 100).alias("head"))


@query("SELECT regexp_replace(replace(filepath, '\\', '/'), '^\\./', '') AS path, count(*) AS n FROM code_chunks GROUP BY 1")
def normal_paths(s, d):
    return read(s, d, "code_chunks").groupBy(S.normal_path(F.col("filepath")).alias("path")).agg(F.count(F.lit(1)).alias("n"))


_STEM = f"regexp_replace(regexp_extract(lower({PATH}), '[^/]*$'), '(.)\\.[^.]*$', '\\1')"


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN {_STEM} = 'readme' THEN 'readme' WHEN contains({_STEM}, 'architecture') OR {_STEM} = 'design' THEN 'architecture'
 {' '.join(f"WHEN regexp_matches({f'lower({PATH})' if k == 'adr' else _STEM}, '{p}') THEN '{k}'" for k, p in S.ARTIFACTS)} ELSE 'documentation' END AS kind FROM parse_results WHERE filepath IS NOT NULL) GROUP BY 1""")
def artifact_kinds(s, d):
    return read(s, d, "parse_results").where("filepath IS NOT NULL").groupBy(S.artifact_kind(S.normal_path(F.col("filepath"))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, nullif(trim(regexp_extract(text, '(?m)^\s*#\s+(.+?)\s*#?\s*$', 1)), '') AS heading FROM documents")
def title_of(s, d):
    return read(s, d, "documents").select("doc_id", S.markdown_title(F.col("text")).alias("heading"))


@query("SELECT CASE WHEN lower(trim(change_type)) IN ('a', 'add', 'added') THEN 'added' WHEN lower(trim(change_type)) IN ('m', 'change', 'modified') THEN 'modified' WHEN lower(trim(change_type)) IN ('d', 'unlink', 'deleted') THEN 'deleted' WHEN lower(trim(change_type)) LIKE 'r%' THEN 'renamed' ELSE 'unknown' END AS kind, count(*) AS n FROM file_changes GROUP BY 1")
def change_kinds(s, d):
    return read(s, d, "file_changes").groupBy(S.change_kind(F.col("change_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, json_extract_string(props, '$.k') IS NULL AS missing, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(s, d):
    return read(s, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").isNull().alias("missing")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ filters and aggregates
@query("SELECT coalesce(lower(language), 'unknown') AS language, count(*) AS chunks, count(DISTINCT regexp_replace(replace(filepath, '\\', '/'), '^\\./', '')) AS files FROM code_chunks GROUP BY 1")
def index_status(s, d):
    return R.index_status(read(s, d, "code_chunks"))


@query("""WITH r AS (SELECT *, regexp_replace(replace(filepath, '\\', '/'), '^\\./', '') AS path FROM (SELECT DISTINCT ON (change_id) * FROM file_changes))
SELECT path, count(DISTINCT commit_id) AS commits, coalesce(sum(additions), 0)::BIGINT AS additions, coalesce(sum(deletions), 0)::BIGINT AS deletions, count(*) FILTER (additions IS NULL) AS binary_changes,
 (coalesce(sum(additions), 0) + coalesce(sum(deletions), 0) + count(*) FILTER (additions IS NULL))::BIGINT AS churn, (max({'ts': ts, 'change_id': change_id, 'commit_id': commit_id})).commit_id AS last_commit FROM r GROUP BY path""")
def hotspots(s, d):
    return R.change_hotspots(read(s, d, "file_changes"))


@query(f"WITH {EDGES} SELECT node, sum(i)::BIGINT AS inbound, sum(o)::BIGINT AS outbound, (2 * sum(i) + sum(o))::BIGINT AS score FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY 1")
def degree_hotspots(s, d):
    return R.degree(edges(s, d))


@query(f"WITH {EDGES} SELECT node, sum(i)::BIGINT AS inbound, sum(o)::BIGINT AS outbound, (2 * sum(i) + sum(o))::BIGINT AS score FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY 1 ORDER BY score DESC, node LIMIT 20")
def degree_top(s, d):
    return V.top_k(R.degree(edges(s, d)), 20, F.desc("score"), "node")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
t AS (SELECT event_type, count(*) AS calls, count(*) FILTER (value < 0) AS failures, round(sum(value), 4) AS total, arg_max(value, {'ts': ts, 'e': event_id}) AS last FROM events GROUP BY 1), p AS (SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM r WHERE rn <= 200 GROUP BY 1)
SELECT event_type, calls, calls - failures AS successes, failures, total, last, p50, p95 FROM t JOIN p USING (event_type)""")
def tool_metrics(s, d):
    return R.call_metrics(read(s, d, "events"), failed=F.col("value") < 0).withColumn("total", F.round("total", 4))


@query(f"WITH {SYMBOLS} SELECT repo, count(*) AS total, count(*) FILTER (type = 'function') AS n_function, count(*) FILTER (type = 'method') AS n_method, count(*) FILTER (type = 'class') AS n_class FROM symbols GROUP BY repo")
def symbol_summary(s, d):
    return R.symbol_summary(symbols(s, d), ["function", "method", "class"])


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topn_per_key(s, d):
    return R.top_per_key(read(s, d, "orders"), "o_custkey", 3, F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query(f"WITH {SYMBOLS} SELECT filepath, name, line FROM symbols WHERE type IN ('function', 'method') AND contains(lower(name), 'cache') AND NOT regexp_matches(lower(filepath), '(^|/)(tests?|__tests__|specs?)/|(\\.test|\\.spec|_test|_spec)\\.[^./]+$')")
def find_symbols(s, d):
    x = symbols(s, d)
    return x.where(F.col("type").isin("function", "method") & F.lower("name").contains("cache") & ~R.is_test_path(F.col("filepath"))).select("filepath", "name", "line")


@query(f"""WITH n AS (SELECT DISTINCT name AS id, name, filepath AS path FROM (SELECT name, min({PATH}) AS filepath FROM unified_symbols WHERE name IS NOT NULL AND filepath IS NOT NULL GROUP BY name)) SELECT id, path FROM n WHERE lower(id) LIKE '%cache' OR lower(path) LIKE '%cache'""")
def match_nodes(s, d):
    n = read(s, d, "unified_symbols").where("name IS NOT NULL AND filepath IS NOT NULL").groupBy("name").agg(F.min(S.normal_path(F.col("filepath"))).alias("path")).select(F.col("name").alias("id"), "name", "path")
    return R.match_nodes(n, "cache").select("id", "path")


_LANGS = {"py": "python", "ts": "typescript", "js": "javascript", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "rb": "ruby", "php": "php", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini"}


# ------------------------------------------------------------------ joins
@query(f"""WITH {SYMBOLS}, s AS (SELECT DISTINCT filepath, line AS start, endline AS stop, name FROM symbols WHERE endline IS NOT NULL AND type <> 'class'), p AS (SELECT DISTINCT filepath, line + 2 AS line FROM symbols)
SELECT p.filepath, p.line, (min(CASE WHEN start <= p.line AND stop >= p.line THEN {{'w': stop - start, 's': start, 'n': name}} END)).n AS name FROM p LEFT JOIN s ON p.filepath = s.filepath GROUP BY 1, 2""")
def range_owner(s, d):
    x = symbols(s, d)
    spans = x.where("endline IS NOT NULL AND type <> 'class'").select("filepath", F.col("line").alias("start"), F.col("endline").alias("stop"), "name").distinct()
    return R.smallest_span(spans, x.select("filepath", (F.col("line") + 2).alias("line")).distinct(), "filepath")


@query("""WITH e AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS t FROM events) SELECT a.user_id, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.t <= b.t + 1800 AND b.t <= a.t + 1800 GROUP BY 1""")
def interval_overlap(s, d):
    e = read(s, d, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("t"))
    a = e.select("user_id", F.col("event_id").alias("ea"), F.col("t").alias("a1"), (F.col("t") + 1800).alias("a2"))
    b = e.select("user_id", F.col("event_id").alias("eb"), F.col("t").alias("b1"), (F.col("t") + 1800).alias("b2"))
    return R.keyed_range_join(a, b, "user_id", 3600).where("ea < eb").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SYMBOLS}, y AS (SELECT DISTINCT filepath, name, line FROM symbols), r AS (SELECT md5(filepath || ':' || name || ':' || line) AS ref_id, filepath, name, line + 5 AS line FROM y),
g AS (SELECT name, count(*) AS n, min({{'f': filepath, 'l': line}}) AS o FROM y GROUP BY name), l AS (SELECT ref_id, min({{'d': abs(y.line - r.line), 'a': y.line}}) AS near FROM r JOIN y USING (filepath, name) GROUP BY 1)
SELECT ref_id, CASE WHEN near IS NOT NULL THEN filepath WHEN n = 1 THEN o.f END AS target_path, CASE WHEN near IS NOT NULL THEN near.a WHEN n = 1 THEN o.l END AS target_line, (CASE WHEN n = 1 THEN 0.78 WHEN near IS NOT NULL THEN 0.58 END)::DOUBLE AS confidence FROM r LEFT JOIN l USING (ref_id) LEFT JOIN g USING (name)""")
def precedence_join(s, d):
    y = symbols(s, d).select("filepath", "name", "line").distinct()
    refs = y.withColumn("ref_id", F.md5(F.concat_ws(":", "filepath", "name", F.col("line").cast("string")))).select("ref_id", "filepath", "name", (F.col("line") + 5).alias("line"))
    return R.resolve_by_precedence(refs, y)


@query(f"WITH {SYMBOLS}, y AS (SELECT DISTINCT filepath, name, line FROM symbols), u AS (SELECT name, min(filepath) AS target FROM y GROUP BY name HAVING count(*) = 1) SELECT name, target FROM u")
def unique_only_join(s, d):
    y = symbols(s, d).select("filepath", "name", "line").distinct()
    return R.unique_name_join(y.select("name").distinct(), y).select("name", "target")


@query("""WITH i AS (SELECT DISTINCT repo AS importer, regexp_replace(regexp_replace(replace(filepath, '\\', '/'), '^\\./', ''), '\\.[^./]*$', '') AS target FROM parse_results), f AS (SELECT DISTINCT regexp_replace(replace(filepath, '\\', '/'), '^\\./', '') AS path FROM parse_results),
c AS (SELECT importer, target, pos, target || sfx AS path FROM i, (VALUES (0, ''), (1, '.ts'), (2, '.js'), (3, '.py'), (4, '/index.ts'), (5, '/index.js'), (6, '/index.py')) v(pos, sfx))
SELECT importer, target, (min(CASE WHEN f.path IS NOT NULL THEN {'p': pos, 'x': c.path} END)).x AS resolved FROM c LEFT JOIN f USING (path) GROUP BY 1, 2""")
def import_resolution(s, d):
    p = S.normal_path(F.col("filepath"))
    r = read(s, d, "parse_results")
    return R.resolve_imports(r.select(F.col("repo").alias("importer"), F.regexp_replace(p, r"\.[^./]*$", "").alias("target")), r.select(p.alias("path")), ["ts", "js", "py"])


def _versions(s, d):
    """(path, hash) of every file by its latest and by its first parse."""
    r = read(s, d, "parse_results").where("filepath IS NOT NULL AND content IS NOT NULL").select(S.normal_path(F.col("filepath")).alias("path"), S.content_hash(F.col("content")).alias("hash"), "parsed_at")
    g = r.groupBy("path").agg(F.max(F.struct("parsed_at", "hash")).alias("l"), F.min(F.struct("parsed_at", "hash")).alias("f"))
    return g.select("path", F.col("l.hash").alias("hash")), g.select("path", F.col("f.hash").alias("hash"))


def _indexed(s, d):
    return read(s, d, "code_chunks").where("filepath IS NOT NULL").select(S.normal_path(F.col("filepath")).alias("path")).distinct()


VERSIONS = f"""v AS (SELECT {PATH} AS path, sha256(content) AS hash, parsed_at AS t FROM parse_results WHERE filepath IS NOT NULL AND content IS NOT NULL),
now AS (SELECT path, (max({{'t': t, 'h': hash}})).h AS hash FROM v GROUP BY 1), cache AS (SELECT path, (min({{'t': t, 'h': hash}})).h AS hash FROM v GROUP BY 1), idx AS (SELECT DISTINCT {PATH} AS path FROM code_chunks WHERE filepath IS NOT NULL)"""


@query(f"""WITH {VERSIONS} SELECT coalesce(now.path, idx.path) AS path, CASE WHEN now.path IS NULL THEN 'removed' WHEN idx.path IS NULL THEN 'added' WHEN cache.hash = now.hash THEN 'unchanged' ELSE 'modified' END AS state FROM now FULL JOIN idx ON now.path = idx.path LEFT JOIN cache ON cache.path = coalesce(now.path, idx.path)""")
def incremental_diff(s, d):
    now, cache = _versions(s, d)
    return R.incremental_diff(now, _indexed(s, d), cache)


@query("SELECT lower(trim(source)) AS filepath, count(*) AS n, sum(CASE WHEN lower(trim(source)) IN ('wiki', 'forum') THEN 1 ELSE 0 END)::BIGINT AS fresh FROM documents WHERE source IS NOT NULL AND (lower(trim(source)) NOT IN ('wiki', 'forum') OR n_chars > 300) GROUP BY 1")
def replace_by_file(s, d):
    docs = read(s, d, "documents").where("source IS NOT NULL").select("doc_id", F.lower(F.trim("source")).alias("filepath"), "n_chars")
    paths = docs.where("filepath IN ('wiki', 'forum')").select("filepath").distinct()
    old = docs.withColumn("fresh", F.lit(0))
    new = docs.join(F.broadcast(paths), "filepath", "left_semi").where("n_chars > 300").withColumn("fresh", F.lit(1)).select(*old.columns)
    return K.replaced(old, new, paths).groupBy("filepath").agg(F.count(F.lit(1)).alias("n"), F.sum("fresh").alias("fresh"))


@query(f"WITH {EDGES}, n AS (SELECT src AS node FROM edges INTERSECT SELECT dst FROM edges) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def semi_endpoints(s, d):
    e = edges(s, d)
    return R.between_selected(e, e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node")))).select("src", "dst")


@query(f"WITH {VERSIONS} SELECT DISTINCT path FROM (SELECT {PATH} AS path FROM file_changes WHERE filepath IS NOT NULL) WHERE path NOT IN (SELECT path FROM idx)")
def anti_removed(s, d):
    changed = read(s, d, "file_changes").where("filepath IS NOT NULL").select(S.normal_path(F.col("filepath")).alias("path"))
    return R.removed(changed, _indexed(s, d), "path")


# ------------------------------------------------------------------ ranking and sets
@query("SELECT source, lang, doc_id FROM (SELECT lower(trim(source)) AS source, lang, doc_id, row_number() OVER (PARTITION BY lower(trim(source)), lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_keep_first(s, d):
    docs = read(s, d, "documents").select(F.lower(F.trim("source")).alias("source"), "lang", "doc_id", "n_chars")
    return R.keep_first(docs, ["source", "lang"], F.desc("n_chars"), "doc_id").drop("n_chars")


@query("SELECT doc_id, used::BIGINT AS used FROM (SELECT doc_id, sum(strlen(coalesce(text, ''))) OVER (ORDER BY doc_id) AS used FROM documents) WHERE used <= 400000")
def byte_budget_prefix(s, d):
    return R.byte_budget_prefix(read(s, d, "documents").select("doc_id", "text"), 100_000, "doc_id", "text").select("doc_id", "used")


@query("SELECT k, v, o FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, v) AS rn FROM (SELECT p_brand AS k, p_partkey AS v, 0 AS o FROM part WHERE p_size > 25 UNION ALL SELECT p_brand, p_partkey, 1 FROM part)) WHERE rn = 1")
def union_keep_first(s, d):
    p = read(s, d, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("v"), "p_size")
    return R.union_keep_first(p.where("p_size > 25").drop("p_size").withColumn("o", F.lit(0)), p.drop("p_size").withColumn("o", F.lit(1)), ["k"], "v")


@query("SELECT regexp_replace(replace(filepath, '\\', '/'), '^\\./', '') AS path, arg_max(change_type, {'t': ts, 'c': change_id}) AS change_type FROM file_changes WHERE change_type IS NOT NULL GROUP BY 1")
def last_changes(s, d):
    return R.last_change(read(s, d, "file_changes").where("change_type IS NOT NULL"))


@query("SELECT lang AS name, (max({'n': len(p), 'p': p})).p[1] AS first_parent, max(len(p)) AS n FROM (SELECT lang, [source, coalesce(repo, '')] AS p FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) GROUP BY lang")
def max_parents(s, d):
    x = read(s, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select(F.lit("class").alias("kind"), F.col("lang").alias("name"), F.lit(1).alias("line"), F.array("source", F.coalesce("repo", F.lit(""))).alias("parents"))
    return R.most_parents(x).select("name", F.col("parents")[0].alias("first_parent"), F.size("parents").alias("n"))


# ------------------------------------------------------------------ graph
_RANK0 = f"WITH {EDGES}, nodes AS (SELECT DISTINCT node FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges)), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), o AS (SELECT src, count(*)::DOUBLE AS d FROM edges GROUP BY src), r0 AS (SELECT node, 1 / n AS rank FROM nodes, n)"
_STEPS = ", ".join(f"r{i} AS (SELECT t.node, 0.15 * (1 / (2 * n)) + 0.85 * coalesce(s, 0) AS rank FROM nodes t LEFT JOIN (SELECT dst, sum(rank / d) AS s FROM edges JOIN o USING (src) JOIN r{i - 1} ON src = node GROUP BY dst) x ON t.node = x.dst, n)" for i in range(1, 31))


def _nodes(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


@query(f"{_RANK0}, {_STEPS} SELECT node, round(rank, 6) AS rank FROM r30")
def pagerank(s, d):
    e = edges(s, d)
    return G.pagerank(e, _nodes(e).withColumn("focus", F.lit(0.0))).withColumn("rank", F.round("rank", 6))


_CLOSURE = f"""WITH RECURSIVE {EDGES}, walk AS (SELECT 5::BIGINT AS node, 0 AS distance UNION SELECT e.src, w.distance + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.distance < {{depth}}), best AS (SELECT node, min(distance) AS distance FROM walk GROUP BY node)"""


@query(_CLOSURE.format(depth=20) + " SELECT node, distance = 1 AS direct FROM best WHERE node <> 5")
def impact_closure(s, d):
    return G.impact(edges(s, d), s.createDataFrame([(5,)], "node long"), 20)


@query(_CLOSURE.format(depth=4) + " SELECT node, distance, CASE WHEN distance = 1 THEN 'direct' ELSE 'transitive' END AS kind FROM best WHERE distance > 0")
def blast_radius(s, d):
    return G.blast_radius(edges(s, d), s.createDataFrame([(5,)], "node long"), 3)


@query(f"WITH RECURSIVE {EDGES}, walk AS (SELECT 1::BIGINT AS node, 0 AS l UNION SELECT e.dst, w.l + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.l < 6) SELECT min(l)::INT AS length FROM walk WHERE node = 77 HAVING min(l) IS NOT NULL")
def shortest_path(s, d):
    return G.shortest_path(edges(s, d), 1, 77, 6).select("length")


@query(f"WITH {EDGES} SELECT a.src AS a, a.dst AS b FROM edges a JOIN edges b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst")
def cycles_len_2(s, d):
    return G.cycles(edges(s, d), 2).select(F.col("cycle")[0].alias("a"), F.col("cycle")[1].alias("b"))


@query(f"WITH {EDGES} SELECT a.src AS a, a.dst AS b, b.dst AS c FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst")
def cycles_len_3(s, d):
    return G.cycles(edges(s, d), 3).select(F.col("cycle")[0].alias("a"), F.col("cycle")[1].alias("b"), F.col("cycle")[2].alias("c"))


@query()
def repository_map(s, d):
    e = edges(s, d)
    files = _nodes(e).select("node", F.when(F.col("node") == 5, 3.0).otherwise(0.0).alias("focus"), F.concat(F.lit("file "), F.col("node").cast("string")).alias("text"))
    return P.repository_map(e, files, 200)


# ------------------------------------------------------------------ streams, extraction, sinks
@query("""WITH c AS (SELECT user_id, event_id, ts, event_type, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM c)
SELECT user_id::VARCHAR AS key, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n, arg_max(event_type, {'t': ts, 'e': event_id}) AS change_type FROM g GROUP BY user_id, grp""")
def debounce_session(s, d):
    e = read(s, d, "events").select(F.col("user_id").cast("string").alias("filepath"), "ts", F.col("event_id").alias("change_id"), F.col("event_type").alias("change_type"))
    return C.debounced(e, "30 minutes")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(s, d):
    return C.tumbling(read(s, d, "events")).withColumn("total", F.round("total", 4))


@query(f"WITH {VERSIONS} SELECT now.path, now.hash FROM now JOIN cache USING (path) WHERE now.hash <> cache.hash")
def hash_suppressed(s, d):
    now, cache = _versions(s, d)
    return C.real_changes(now, cache)


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def audit_tail(s, d):
    return K.last_events(read(s, d, "events"), 2000).select("event_id", "ts", "event_type")


@query("""WITH o AS (SELECT doc_id, n_chars, 1 AS updated_at FROM documents WHERE title IS NOT NULL), c AS (SELECT doc_id, n_chars + 1 AS n_chars, CASE WHEN n_chars > 300 THEN 1 ELSE 9 END AS expected, 2 AS updated_at FROM documents WHERE lower(lang) = 'en')
SELECT doc_id AS id, n_chars, updated_at FROM (SELECT c.doc_id, c.n_chars, c.updated_at FROM c LEFT JOIN o USING (doc_id) WHERE o.doc_id IS NULL OR c.expected = o.updated_at UNION ALL SELECT o.doc_id, o.n_chars, o.updated_at FROM o WHERE o.doc_id NOT IN (SELECT c.doc_id FROM c JOIN o USING (doc_id) WHERE c.expected = o.updated_at)) ORDER BY updated_at DESC, doc_id LIMIT 500""")
def memory_upsert(s, d):
    docs = read(s, d, "documents")
    old = docs.where("title IS NOT NULL").select(F.col("doc_id").alias("id"), "n_chars", F.lit(1).alias("updated_at"))
    change = docs.where("lower(lang) = 'en'").select(F.col("doc_id").alias("id"), (F.col("n_chars") + 1).alias("n_chars"), F.lit(2).alias("updated_at"), F.when(F.col("n_chars") > 300, 1).otherwise(9).alias("expected"))
    return K.optimistic_upsert(old, change)


@query()
def line_split(s, d):
    return X.table_function(read(s, d, "documents"), "doc_id", "text", _pieces, "first int, last int, piece string")


def _pieces(text: str) -> list[tuple[int, int, str]]:
    return X.split_lines(text, 400, 80)


@query()
def recursive_split(s, d):
    return X.table_function(read(s, d, "documents"), "doc_id", "text", _recursive, "piece string")


def _recursive(text: str) -> list[tuple[str]]:
    return [(p,) for p in X.split_recursive(text, 500, 100, X.SEPARATORS["markdown"])]
