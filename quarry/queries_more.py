"""More core queries; see queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import context as N
from .operators import graph as G
from .operators import relational as R
from .operators import retrieval as V
from .queries import EDGES, PATH, SYMBOLS, edges, query, symbols
from .tables import read


@query(f"""WITH {SYMBOLS}, c AS (SELECT DISTINCT id, {PATH} AS filepath, startline, endline FROM code_chunks), m AS (SELECT id, s.name, min(s.line) AS pos FROM c JOIN symbols s USING (filepath) WHERE c.startline <= coalesce(s.endline, s.line) AND s.line <= c.endline GROUP BY 1, 2)
SELECT id, least(count(*), 20) AS n, arg_min(name, {{'a': pos, 'n': name}}) AS first_name FROM m GROUP BY id""")
def chunk_symbols(s, d):
    c = read(s, d, "code_chunks").select("id", S.normal_path(F.col("filepath")).alias("filepath"), "startline", "endline").distinct()
    x = N.chunk_symbols(c, symbols(s, d))
    return x.select("id", F.size("names").alias("n"), F.col("names")[0].alias("first_name"))


@query(f"WITH {SYMBOLS} SELECT filepath, name, line FROM (SELECT filepath, name, line, 0 AS mode FROM (SELECT DISTINCT filepath, name, line FROM symbols WHERE type = 'class') UNION ALL SELECT filepath, name, line, 1 FROM (SELECT DISTINCT filepath, name, line FROM symbols WHERE type = 'function')) ORDER BY filepath, mode, line, name LIMIT 100 OFFSET 50")
def symbol_page(s, d):
    x = symbols(s, d).select("filepath", "name", "line", "type").distinct()
    parts = [(x.where("type = 'class'").drop("type").distinct(), 0), (x.where("type = 'function'").drop("type").distinct(), 1)]
    return N.ordered_union_page(parts, "filepath", "line", 50, 100).select("filepath", "name", "line")


@query("""WITH k AS (SELECT DISTINCT regexp_replace(replace(filepath, '\\', '/'), '^\\./', '') AS path, CASE WHEN lower(trim(change_type)) IN ('a', 'add', 'added') THEN 'added' WHEN lower(trim(change_type)) IN ('m', 'change', 'modified') THEN 'modified' WHEN lower(trim(change_type)) IN ('d', 'unlink', 'deleted') THEN 'deleted' WHEN lower(trim(change_type)) LIKE 'r%' THEN 'renamed' ELSE 'unknown' END AS kind FROM file_changes WHERE filepath IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path) AS rn, count(*) OVER (PARTITION BY kind) AS n FROM k)
SELECT kind, string_agg(path, ', ' ORDER BY path) || CASE WHEN max(n) > 10 THEN ' ... and ' || (max(n) - 10) || ' more' ELSE '' END AS summary FROM r WHERE rn <= 10 GROUP BY kind""")
def change_summaries(s, d):
    c = read(s, d, "file_changes").where("filepath IS NOT NULL").select(S.normal_path(F.col("filepath")).alias("path"), S.change_kind(F.col("change_type")).alias("kind")).distinct()
    return N.change_summary(c)


@query(f"WITH {SYMBOLS} SELECT DISTINCT signature, list_last(list_filter(regexp_split_to_array(signature, '[#/.:`()]+'), lambda x: x <> '')) AS short FROM symbols WHERE signature IS NOT NULL")
def short_symbols(s, d):
    return symbols(s, d).where("signature IS NOT NULL").select("signature").distinct().select("signature", N.short_symbol(F.col("signature")).alias("short"))


@query(f"SELECT DISTINCT {PATH} AS node FROM file_changes WHERE filepath IS NOT NULL AND {PATH} NOT IN (SELECT {PATH} FROM parse_results WHERE filepath IS NOT NULL)")
def unknown_nodes(s, d):
    node = S.normal_path(F.col("filepath")).alias("node")
    return R.removed(read(s, d, "file_changes").where("filepath IS NOT NULL").select(node), read(s, d, "parse_results").where("filepath IS NOT NULL").select(node), "node")


@query("SELECT lang, count(*) FILTER (state = 'current') AS current, count(*) FILTER (state = 'stale') AS stale, count(*) FILTER (state = 'unknown') AS unknown FROM (SELECT lang, CASE WHEN repo IS NULL OR title IS NULL THEN 'unknown' WHEN n_chars % 2 = 0 THEN 'current' ELSE 'stale' END AS state FROM documents) GROUP BY lang")
def revision_states(s, d):
    x = read(s, d, "documents")
    state = V.revision_state(F.when(F.col("repo").isNotNull() & F.col("title").isNotNull(), F.lit("a")), F.when(F.col("n_chars") % 2 == 0, "a").otherwise("b"))
    return x.select("lang", state.alias("state")).groupBy("lang").agg(*[F.count_if(F.col("state") == k).alias(k) for k in ("current", "stale", "unknown")])


@query(f"WITH p AS (SELECT DISTINCT {PATH} AS path FROM parse_results) SELECT path, regexp_matches(lower(path), '(^|/)(tests?|__tests__|specs?)/|(\\.test|\\.spec|_test|_spec)\\.[^./]+$') AS is_test FROM p")
def test_paths(s, d):
    p = read(s, d, "parse_results").select(S.normal_path(F.col("filepath")).alias("path")).distinct()
    return p.select("path", R.is_test_path(F.col("path")).alias("is_test"))


@query("SELECT sum(strlen(content))::BIGINT AS bytes, count(*) AS n, max(strlen(content)) AS largest FROM parse_results")
def stored_bytes(s, d):
    return read(s, d, "parse_results").agg(F.sum(F.octet_length("content")).alias("bytes"), F.count(F.lit(1)).alias("n"), F.max(F.octet_length("content")).alias("largest"))


@query(f"WITH RECURSIVE {EDGES}, walk AS (SELECT 5::BIGINT AS node, 0 AS distance UNION SELECT e.dst, w.distance + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.distance < 10) SELECT node, min(distance) AS distance FROM walk GROUP BY node")
def reachable(s, d):
    return G.closure(edges(s, d), s.createDataFrame([(5,)], "node long"), 10)


@query("SELECT l.repo, count(*) AS files FROM (SELECT DISTINCT repo, regexp_replace(replace(filepath, '\\', '/'), '^\\./', '') AS path FROM parse_results) l JOIN (SELECT DISTINCT regexp_replace(replace(filepath, '\\', '/'), '^\\./', '') AS path FROM file_changes) c USING (path) GROUP BY 1")
def changed_files_by_repo(s, d):
    a = read(s, d, "parse_results").select("repo", S.normal_path(F.col("filepath")).alias("path")).distinct()
    b = read(s, d, "file_changes").select(S.normal_path(F.col("filepath")).alias("path")).distinct()
    return a.join(b, "path", "left_semi").groupBy("repo").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {SYMBOLS} SELECT name, list_sort(list(DISTINCT type)) AS types FROM symbols GROUP BY name HAVING count(DISTINCT type) > 1")
def sorted_unique_kinds(s, d):
    x = symbols(s, d).groupBy("name").agg(F.sort_array(F.collect_set("type")).alias("types"))
    return x.where(F.size("types") > 1)
