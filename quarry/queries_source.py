"""Queries over source files: extraction, property graph, languages, projects, governance; see queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import code as C
from .operators import extract as X
from .operators import memory as M
from .operators import property_graph as P
from .operators import relational as R
from .operators import retrieval as V
from .plans import search as A
from .queries import _DIST, _TARGET, PATH, SYMBOLS, query, symbols
from .sinks import versioned as K
from .sources import files as L
from .sources import history as H
from .sources import languages as G
from .sources import project as J
from .tables import read


def files(spark: SparkSession, d: str) -> DataFrame:
    """(filepath, repo, content) of every file's latest parse, its path normalised."""
    rows = read(spark, d, "parse_results").where("filepath IS NOT NULL AND content IS NOT NULL").select(S.normal_path(F.col("filepath")).alias("filepath"), F.struct("parsed_at", "content", F.coalesce("repo", F.lit("")).alias("repo")).alias("r"))
    return rows.groupBy("filepath").agg(F.max("r").alias("r")).select("filepath", "r.repo", "r.content")


FILES = f"files AS (SELECT filepath, r.repo AS repo, r.content AS content FROM (SELECT {PATH} AS filepath, max({{'t': coalesce(parsed_at, TIMESTAMP '0001-01-01'), 'content': content, 'repo': coalesce(repo, '')}}) AS r FROM parse_results WHERE filepath IS NOT NULL AND content IS NOT NULL GROUP BY 1))"


def relative(spark: SparkSession, d: str) -> DataFrame:
    """(repo, path, content): the files with their paths within the repository."""
    return files(spark, d).select("repo", F.expr("substring(filepath, length(repo) + 2)").alias("path"), "content")


RELATIVE = "rel AS (SELECT repo, substr(filepath, length(repo) + 2) AS path, content FROM files)"
_Q = "'"


def _sql(pattern: str) -> str:
    """A regular expression as a SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


# ------------------------------------------------------------------ extraction
_DECLARED = " UNION ALL ".join(f"SELECT filepath, '{k}' AS type, unnest(regexp_extract_all(content, {_sql(p)}, 1)) AS name FROM files" for k, p in C.DECLARATIONS)


@query(f"WITH {FILES} SELECT filepath, type, name, count(*) AS n FROM ({_DECLARED}) GROUP BY ALL")
def regex_symbols(s, d):
    return C.extract(files(s, d), "symbols").groupBy("filepath", "type", "name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES} SELECT filepath, source, count(*) AS n FROM (SELECT filepath, unnest(regexp_extract_all(content, {_sql(C._IMPORT.pattern)}, 2)) AS source FROM files) GROUP BY ALL")
def regex_imports(s, d):
    return C.extract(files(s, d), "imports").groupBy("filepath", "source").agg(F.count(F.lit(1)).alias("n"))


_SIGNALS = " UNION ALL ".join(f"SELECT filepath, '{k}' AS kind, unnest(regexp_extract_all(content, {_sql(('(?i)' if n == 0 else '') + p.pattern)}, {g})) AS name FROM files" for n, (k, p, g) in enumerate(C.SIGNALS))


@query(f"WITH {FILES} SELECT filepath, kind, name, count(*) AS n FROM ({_SIGNALS}) GROUP BY ALL")
def code_signals(s, d):
    return C.extract(files(s, d), "signals").groupBy("filepath", "kind", "name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES} SELECT kind, count(*) AS n FROM ({_SIGNALS}) GROUP BY kind")
def signal_totals(s, d):
    return P.signal_totals(P.Tables(files(s, d)))


@query(f"WITH {FILES} SELECT filepath, n FROM (SELECT filepath, len(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9_$]+'), lambda x: x = 'cache')) AS n FROM files) WHERE n > 0")
def word_references(s, d):
    return C.references(files(s, d), "cache").groupBy("filepath").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES} SELECT filepath, array_to_string(list_distinct_order[1:250], ' ') AS names FROM (SELECT filepath, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_order FROM (SELECT filepath, regexp_extract_all(content, '\\b[A-Za-z_$][\\w$]*\\b') AS w FROM files))")
def file_identifiers(s, d):
    return X.table_function(files(s, d), "filepath", "content", _names, "names string")


def _names(text: str) -> list[tuple[str]]:
    return [(" ".join(C.identifiers(text)),)]


@query(f"""WITH {FILES} SELECT filepath, name, count(*) AS n FROM (
 SELECT filepath, unnest(regexp_extract_all(content, '\\bexport\\s+(?:default\\s+)?(?:abstract\\s+|async\\s+|declare\\s+)*(?:function\\*?|class|const|let|var|interface|type|enum)\\s+(\\w+)', 1)) AS name FROM files
 UNION ALL SELECT filepath, list_last(regexp_split_to_array(trim(x), '\\s+as\\s+')) FROM (SELECT filepath, unnest(string_split(g, ',')) AS x FROM (SELECT filepath, unnest(regexp_extract_all(content, '\\bexport\\s*\\{{([^}}]*)\\}}', 1)) AS g FROM files)) WHERE trim(x) <> ''
 UNION ALL SELECT filepath, 'default' FROM (SELECT filepath, unnest(regexp_extract_all(content, '\\bexport\\s+default\\b')) AS x FROM files)) GROUP BY ALL HAVING name <> 'default'""")
def regex_exports(s, d):
    return C.extract(files(s, d), "exports").where("name <> 'default'").groupBy("filepath", "name").agg(F.count(F.lit(1)).alias("n"))


@query()
def type_hierarchy(s, d):
    return C.extract(files(s, d), "hierarchy")


@query()
def call_sites(s, d):
    return C.extract(files(s, d), "calls")


@query()
def code_tags(s, d):
    return C.extract(files(s, d), "tags")


@query()
def semantic_chunks(s, d):
    return C.chunk_files(files(s, d).select("filepath", "content"))


@query()
def syntax_statistics(s, d):
    return C.tree_statistics(C.extract(files(s, d).where(G.chunk_language(F.col("filepath")) == "python"), "syntax"))


@query(f"WITH {FILES} SELECT filepath, unnest(regexp_extract_all(content, '\\b(?:const|let|var|val|static)\\s+(?:mut\\s+)?([A-Za-z_$][\\w$]*)', 1)) AS name FROM files WHERE regexp_matches(filepath, '\\.[jt]s$')")
def preset_variables(s, d):
    ts = files(s, d).where(F.col("filepath").rlike(r"\.[jt]s$"))
    return X.table_function(ts, "filepath", "content", _declared, "name string")


def _declared(text: str) -> list[tuple[str]]:
    return [(n,) for n, _ in C._spans(text, r"\b(?:const|let|var|val|static)\s+(?:mut\s+)?(?P<x>[A-Za-z_$][\w$]*)")]


_HUNK = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def _diffs(s, d):
    """Every document as the diff that adds its lines at the place its id gives."""
    t = read(s, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    n = F.length(F.regexp_replace("text", "[^\n]", "")) + 1
    return t.select("doc_id", F.concat(F.lit("--- a/x\n+++ b/"), F.col("doc_id").cast("string"), F.lit(".md\n@@ -0,0 +"), (F.col("doc_id") + 1).cast("string"), F.lit(","), n.cast("string"), F.lit(" @@\n")).alias("diff"))


@query("SELECT doc_id, doc_id::VARCHAR || '.md' AS path, 0 AS old_start, 0 AS old_lines, (doc_id + 1)::INT AS new_start, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS new_lines FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def hunk_parse(s, d):
    return X.extract(_diffs(s, d), "hunks", "doc_id", "diff")


@query(f"""WITH {SYMBOLS}, y AS (SELECT DISTINCT filepath, name, line, endline FROM symbols), h AS (SELECT DISTINCT {PATH} AS filepath, 1 + (additions % 40) AS start, 1 + (additions % 40) + (deletions % 20) AS stop FROM file_changes WHERE filepath IS NOT NULL AND additions IS NOT NULL AND deletions IS NOT NULL),
w AS (SELECT DISTINCT {PATH} AS filepath FROM file_changes WHERE lower(trim(change_type)) = 'add' AND filepath IS NOT NULL)
SELECT DISTINCT filepath, name, line, endline FROM (SELECT y.* FROM y JOIN h USING (filepath) WHERE h.start <= coalesce(y.endline, y.line) AND h.stop >= y.line UNION ALL SELECT y.* FROM y JOIN w USING (filepath))""")
def changed_symbols(s, d):
    c = read(s, d, "file_changes").where("filepath IS NOT NULL").withColumn("filepath", S.normal_path(F.col("filepath")))
    start = 1 + F.col("additions") % 40
    hunks = c.where("additions IS NOT NULL AND deletions IS NOT NULL").select("filepath", start.alias("start"), (start + F.col("deletions") % 20).alias("stop"))
    return A.changed_symbols(symbols(s, d), hunks, c.where(F.lower(F.trim("change_type")) == "add").select("filepath").distinct())


# ------------------------------------------------------------------ property graph
@query(f"WITH {FILES} SELECT filepath AS path, count(*) AS n FROM ({_DECLARED}) GROUP BY 1")
def graph_contains(s, d):
    return P.of_kinds(P.contains(P.Tables(files(s, d))), ["contains"]).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query()
def graph_edges(s, d):
    return P.edges(P.Tables(files(s, d))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query()
def graph_imports(s, d):
    return P.import_edges(P.Tables(files(s, d)))


@query()
def graph_references(s, d):
    return P.reference_edges(P.Tables(files(s, d)))


@query()
def graph_tests(s, d):
    return P.test_edges(P.Tables(files(s, d)))


@query()
def graph_types(s, d):
    return P.hierarchy_relations(P.Tables(files(s, d)))


@query()
def dead_code(s, d):
    return P.dead_symbols(P.Tables(files(s, d)))


_TEST = "regexp_matches(lower(filepath), '(^|/)(tests?|__tests__|specs?)/|(\\.test|\\.spec|_test|_spec)\\.[^./]+$')"


@query(f"WITH {FILES}, y AS ({_DECLARED}) SELECT repo, name, count(*) AS definitions FROM y JOIN files USING (filepath) GROUP BY 1, 2 HAVING count(*) = 1")
def graph_unique_names(s, d):
    return P.Tables(files(s, d)).unique().select("repo", "name", F.lit(1).cast("long").alias("definitions"))


@query(f"""WITH {FILES}, {SYMBOLS}, w AS (SELECT name, count(*) AS mentions FROM (SELECT unnest(regexp_extract_all(content, '\\b[A-Za-z_$][\\w$]*\\b')) AS name FROM files) GROUP BY 1), y AS (SELECT name, count(*) AS definitions FROM (SELECT DISTINCT name, filepath, line FROM symbols) GROUP BY 1)
SELECT name, definitions, coalesce(mentions, 0) AS mentions FROM y LEFT JOIN w USING (name)""")
def definition_counts(s, d):
    from .operators import context as N

    word = F.regexp_extract_all("content", F.lit(r"(?<![A-Za-z0-9_])([A-Za-z_$][A-Za-z0-9_$]*)(?![A-Za-z0-9_])"), F.lit(1))
    mentions = files(s, d).select(F.explode(word).alias("name"))
    return N.reference_counts(symbols(s, d).select("name", "filepath", "line").distinct(), mentions)


# ------------------------------------------------------------------ languages and projects
def _case(table: dict[str, str], key: str) -> str:
    return f"map_extract(MAP {{{', '.join(f'{_Q}{k}{_Q}: {_Q}{v}{_Q}' for k, v in table.items())}}}, {key})[1]"


_NAME = f"lower(regexp_extract({PATH}, '[^/]*$'))"
_EXT = f"nullif(regexp_extract({_NAME}, '^.+\\.([^.]*)$', 1), '')"
_PREFIXED = f"CASE WHEN starts_with({_NAME}, 'dockerfile.') THEN 'dockerfile' WHEN starts_with({_NAME}, '.env.') THEN 'env' END"
_LANGUAGE = f"coalesce({_case(G.SPECIAL, _NAME)}, {_PREFIXED}, {_case(G._BY_FALLBACK | G._BY_GRAMMAR, _EXT)})"
_UNIFIED = f"coalesce({_case(G._BY_GRAMMAR, _EXT)}, {_case(G._BY_FALLBACK, _EXT)}, {_case(G.SPECIAL, _NAME)}, {_PREFIXED}, 'text')"


@query(f"SELECT DISTINCT {PATH} AS path, {_LANGUAGE} AS language, {_UNIFIED} AS unified, CASE WHEN {_LANGUAGE} = 'tsx' THEN 'typescript' WHEN {_LANGUAGE} = 'c_sharp' THEN 'csharp' ELSE coalesce({_LANGUAGE}, 'unknown') END AS chunked FROM (SELECT filepath FROM parse_results UNION ALL SELECT filepath FROM file_changes) WHERE filepath IS NOT NULL")
def detected_languages(s, d):
    every = read(s, d, "parse_results").select("filepath").unionByName(read(s, d, "file_changes").select("filepath")).where("filepath IS NOT NULL").select(S.normal_path(F.col("filepath")).alias("path")).distinct()
    p = F.col("path")
    return every.select("path", G.language_of(p).alias("language"), G.unified_language(p).alias("unified"), G.chunk_language(p).alias("chunked"))


@query(f"WITH {FILES} SELECT coalesce({_LANGUAGE}, 'unknown') AS language, count(*) AS files, sum(strlen(content))::BIGINT AS bytes FROM files GROUP BY 1")
def lang_bytes(s, d):
    return J.language_totals(files(s, d).select(F.col("filepath").alias("path"), F.octet_length("content").alias("bytes")))


@query("SELECT language, method, len(extensions) AS n, extensions[1] AS first FROM (VALUES " + ", ".join(f"('{k}', 'tree-sitter', {['.' + e for e in v]})" for k, v in G.GRAMMARS.items()) + ", " + ", ".join(f"('{k}', 'langchain', {['.' + e for e in v]})" for k, v in G.FALLBACK.items()) + ") t(language, method, extensions)")
def language_capabilities(s, d):
    return G.capabilities(s).select("language", "method", F.size("extensions").alias("n"), F.col("extensions")[0].alias("first"))


@query(f"WITH {FILES} SELECT filepath, CASE WHEN {_UNIFIED} IN ({', '.join(_Q + k + _Q for k in G.GRAMMARS)}) THEN 'tree-sitter' WHEN {_UNIFIED} IN ({', '.join(_Q + k + _Q for k in G.SPLITTERS)}) THEN 'langchain' ELSE 'generic' END AS method FROM files")
def parse_methods(s, d):
    return files(s, d).select("filepath", G.parse_method(F.col("filepath")).alias("method"))


_SENSITIVE = " OR ".join(f"regexp_matches({_NAME}, {_sql(p)})" for p in L.SENSITIVE)


@query(f"SELECT DISTINCT {PATH} AS path, {_SENSITIVE} AS sensitive FROM (SELECT filepath FROM parse_results UNION ALL SELECT filepath || suffix FROM parse_results, (VALUES ('.pem'), ('.env'), ('/.env.local'), ('/secrets.yaml'), ('/id_rsa')) t(suffix)) WHERE filepath IS NOT NULL")
def sensitive_files(s, d):
    p = read(s, d, "parse_results").where("filepath IS NOT NULL").select(F.explode(F.array(*(F.concat("filepath", F.lit(x)) for x in ("", ".pem", ".env", "/.env.local", "/secrets.yaml", "/id_rsa")))).alias("f"))
    return p.select(S.normal_path(F.col("f")).alias("path")).distinct().select("path", L.is_sensitive(F.col("path")).alias("sensitive"))


@query(f"WITH {FILES}, {RELATIVE} SELECT repo, path FROM rel WHERE NOT regexp_matches(path, '(^|/)(node_modules|\\.git|dist|build|\\.src-index)(/|$)') AND NOT regexp_matches(path, '(^|/)docs/adr(/|$)') AND NOT regexp_matches(path, '\\.toml$')")
def scannable_files(s, d):
    return relative(s, d).where(~L.ignored(F.col("path"), L.scan_rules("docs/adr/\n*.toml"))).select("repo", "path")


_TEST_PROFILE = "regexp_matches(lower(path), " + _sql(J.PROFILE_TEST.replace("(?i)", "")) + ")"


@query(f"""WITH {FILES}, {RELATIVE}, p AS (SELECT repo, path, lower(regexp_extract(path, '[^/]*$')) IN ({', '.join(_Q + x + _Q for x in J.ENTRYPOINTS)}) AS entry, {_TEST_PROFILE} AS test, list_position(list_transform(string_split(path, '/'), lambda x: lower(x) IN ('test', 'tests', '__tests__', 'spec')), TRUE) AS seg FROM rel)
SELECT repo, path, entry, test, CASE WHEN test THEN CASE WHEN seg > 0 THEN array_to_string(string_split(path, '/')[1:seg], '/') ELSE coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') END END AS root FROM p""")
def profile_paths(s, d):
    p = F.col("path")
    return relative(s, d).select("repo", "path", J.is_entrypoint(p).alias("entry"), J.is_profile_test(p).alias("test"), J.test_root(p).alias("root"))


_MANIFEST = _case(J.MANIFESTS, "lower(regexp_extract(path, '[^/]*$'))")


@query(f"WITH {FILES}, {RELATIVE} SELECT repo, path, {_MANIFEST} AS kind FROM rel WHERE {_MANIFEST} IS NOT NULL OR regexp_matches(regexp_extract(path, '[^/]*$'), {_sql(J.CONFIG_FILE)}) OR regexp_matches(lower(path), '\\.(md|markdown|rst|txt)$')")
def discovered_metadata(s, d):
    return J.discover(relative(s, d)).select("repo", "path", J.manifest_kind(F.col("path")).alias("kind"))


@query()
def project_profiles(s, d):
    return J.project_profile(relative(s, d))


@query()
def project_frameworks(s, d):
    return J.frameworks(relative(s, d))


@query("WITH h AS (SELECT string_agg(doc_id::VARCHAR || chr(0) || sha256(text), chr(10) ORDER BY doc_id::VARCHAR) AS t, count(*) AS files FROM documents WHERE text IS NOT NULL) SELECT substr(sha256(t), 1, 16) AS fingerprint, files FROM h")
def source_fingerprint(s, d):
    return K.fingerprint(read(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), S.content_hash(F.col("text")).alias("hash")))


@query("WITH h AS (SELECT substr(sha256(string_agg(doc_id::VARCHAR || chr(0) || sha256(text), chr(10) ORDER BY doc_id::VARCHAR)), 1, 16) AS f, count(*) AS n FROM documents WHERE text IS NOT NULL) SELECT CASE WHEN n > 20000 THEN 'unknown' WHEN f = '0123456789abcdef' THEN 'fresh' ELSE 'stale' END AS state FROM h")
def index_freshness(s, d):
    return M.freshness("0123456789abcdef", source_fingerprint(s, d))


@query(f"WITH {FILES}, {RELATIVE} SELECT sha256('root' || string_agg(filepath || chr(0) || strlen(content) || chr(0) || '0' || chr(10), '' ORDER BY filepath)) AS fingerprint FROM files")
def profile_fingerprint(s, d):
    return J.profile_fingerprint(files(s, d).select(F.col("filepath").alias("path"), F.octet_length("content").alias("size"), F.lit(0).alias("mtime")), "root")


@query("SELECT path, CASE WHEN starts_with(path, '/') THEN starts_with(path, '/srv/a/') ELSE NOT starts_with(path, '../') END AS inside FROM (SELECT DISTINCT " + PATH + " AS p0 FROM file_changes WHERE filepath IS NOT NULL), LATERAL (SELECT unnest([p0, '../' || p0, '/srv/a/' || p0, '/srv/ab/' || p0]) AS path)")
def contained_paths(s, d):
    p = read(s, d, "file_changes").where("filepath IS NOT NULL").select(S.normal_path(F.col("filepath")).alias("p")).distinct()
    every = p.select(F.explode(F.array(*(F.concat(F.lit(x), F.col("p")) for x in ("", "../", "/srv/a/", "/srv/ab/")))).alias("path"))
    return every.select("path", J.within_root(F.col("path"), "/srv/a").alias("inside"))


# ------------------------------------------------------------------ secrets and signals
_KEY = S.SECRET_KEY
_LEFT = rf"((?:[\"'']?\b{_KEY}\b[\"'']?)[ \t]*[:=][ \t]*)"
_REDACTED = "text"
for _p, _r in ((S.PEM, "[REDACTED PEM BLOCK]"), (S.BEARER, "Bearer [REDACTED TOKEN]"), *((rf"(?i){_LEFT}{q}(?:\\.|[^\\\r\n])*?{q}", rf"\1{q}[REDACTED]{q}") for q in ('"', "''", "`"))):
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p}', '{_r}', 'g')"


@query(f"SELECT doc_id, regexp_replace({_REDACTED}, '{S.TOKEN}', '[REDACTED TOKEN]', 'g') AS text FROM documents")
def redact_quoted(s, d):
    """The passes that RE2 can express too; the unquoted one is in ``redact_texts``."""
    t = read(s, d, "documents").select("doc_id", F.col("text"))
    left = rf"""((?:["']?(?<![A-Za-z0-9_]){S.SECRET_KEY}(?![A-Za-z0-9_])["']?)[ \t]*[:=][ \t]*)"""
    x = F.regexp_replace(F.regexp_replace("text", S.PEM, "[REDACTED PEM BLOCK]"), S.BEARER, "Bearer [REDACTED TOKEN]")
    for q in ('"', "'", "`"):
        x = F.regexp_replace(x, rf"(?i){left}{q}(?:\\.|[^\\\r\n])*?{q}", f"$1{q}[REDACTED]{q}")
    return t.select("doc_id", F.regexp_replace(x, S.TOKEN, "[REDACTED TOKEN]").alias("text"))


@query()
def redact_texts(s, d):
    return read(s, d, "documents").select("doc_id", S.redact(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN title IS NULL THEN NULL ELSE '[REDACTED]' END AS secret, lang FROM documents")
def redact_maps(s, d):
    m = F.create_map(F.lit("API-Key"), F.col("title"), F.lit("lang"), F.col("lang"))
    out = S.redact_values(m)
    return read(s, d, "documents").select("doc_id", out["API-Key"].alias("secret"), out["lang"].alias("lang"))


_SCAN = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(text, {_sql(p.replace('(?im)', '(?i)(?m)')) if k != 'hidden_unicode' else _sql('[‪-‮⁦-⁩]')})) AS n FROM documents" for k, (_, p) in S.INSTRUCTION_SIGNALS.items())


@query(f"SELECT doc_id, kind, n FROM ({_SCAN}) WHERE n > 0")
def signal_scan(s, d):
    counts = F.array(*(F.struct(F.lit(k).alias("kind"), S.signal_count(F.col("text"), k).alias("n")) for k in S.INSTRUCTION_SIGNALS))
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(counts).alias("x")).select("doc_id", "x.kind", "x.n").where("n > 0")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]:[\\\\/]|(^|[\\s(\"''`])/[^\\s\"''`)]*') THEN 'failed' WHEN length(text) > 500 THEN left(text, 497) || '...' ELSE text END AS message FROM documents")
def scrubbed_errors(s, d):
    return read(s, d, "documents").select("doc_id", S.scrub_error(F.col("text"), "failed").alias("message"))


# ------------------------------------------------------------------ memory, catalog, gates
def records(s, d):
    """Documents as memory records."""
    t = read(s, d, "documents").where("doc_id IS NOT NULL")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    tags = M.normal_tags(F.array(blank("source"), blank("lang"), blank("source")))
    links = M.normal_links(F.array(F.struct(F.lit("references").alias("kind"), blank("repo").alias("target")), F.struct(F.lit("references").alias("kind"), F.concat(blank("repo"), F.lit(" ")).alias("target"))))
    return t.select(F.col("doc_id").alias("id"), F.lit("project").alias("scope"), F.lower(F.trim("source")).alias("kind"), blank("title").alias("title"), blank("text").alias("body"), tags.alias("tags"), links.alias("links"), (F.col("doc_id") % 10 / 10).alias("confidence"), F.col("updated_at"), F.when(F.col("doc_id") % 2 == 0, F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("expires_at"))


_TAG = lambda c: f"lower(trim(coalesce({c}, '')))"
RECORDS = f"""records AS (SELECT doc_id AS id, lower(trim(source)) AS kind, coalesce(title, '') AS title, coalesce(text, '') AS body, list_filter(CASE WHEN {_TAG('source')} = {_TAG('lang')} THEN [{_TAG('source')}] ELSE [{_TAG('source')}, {_TAG('lang')}] END, lambda x: x <> '') AS tags, trim(coalesce(repo, '')) AS link, (doc_id % 10) / 10.0 AS confidence, updated_at, CASE WHEN doc_id % 2 = 0 THEN date_trunc('second', updated_at) END AS expires_at FROM documents WHERE doc_id IS NOT NULL)"""


@query(f"WITH {RECORDS} SELECT id, array_to_string(tags, ',') AS tags, link FROM records")
def normal_tags(s, d):
    return records(s, d).select("id", F.array_join("tags", ",").alias("tags"), F.coalesce(F.try_element_at("links", F.lit(1))["target"], F.lit("")).alias("link"))


@query(f"WITH {RECORDS} SELECT id FROM records WHERE list_contains(tags, 'wiki') AND confidence >= 0.3 AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-06-01')")
def memory_filter(s, d):
    return M.memory_filter(records(s, d), "project", None, [" Wiki "], F.lit("2024-06-01").cast("timestamp"), 0.3).select("id")


_MEMORY = " + ".join(f"CASE WHEN contains(lower({f}), '{t}') THEN {w} ELSE 0 END" for t in ("cache", "memory") for f, w in (("title", 5), ("array_to_string(tags, ' ')", 3), ("link", 2), ("body", 1)))


@query(f"WITH {RECORDS} SELECT id, score FROM (SELECT id, confidence, updated_at, ({_MEMORY} + CASE WHEN contains(lower(concat_ws(chr(10), title, body, array_to_string(tags, ' '), link)), 'cache memory') THEN 8 ELSE 0 END)::INT AS score FROM records) ORDER BY score DESC, confidence DESC, updated_at DESC NULLS LAST, id LIMIT 50")
def memory_rank(s, d):
    return M.memory_search(records(s, d), "Cache memory", "hybrid", 50).select("id", "score")


_LINK = r"\[[^\]]+\]\(([^)\s]+)(?:\s+[^)]*)?\)"
_TITLE = r"(?m)^\s*#\s+(.+?)\s*#?\s*$"
DOCS = f"docs AS (SELECT filepath AS file_path, coalesce(nullif(trim(regexp_extract(content, {_sql(_TITLE)}, 1)), ''), regexp_replace(regexp_extract(filepath, '[^/]*$'), '(.)\\.[^.]*$', '\\1')) AS title, content FROM files WHERE regexp_matches(lower(filepath), '\\.(md|markdown|txt|rst)$'))"


@query(f"WITH {FILES}, {DOCS} SELECT file_path, title, relevance FROM (SELECT file_path, title, (CASE WHEN contains(lower(file_path), 'cache') THEN 4 ELSE 0 END + CASE WHEN contains(lower(title), 'cache') THEN 5 ELSE 0 END + CASE WHEN contains(lower(content), 'cache') THEN 1 ELSE 0 END)::INT AS relevance FROM docs) WHERE relevance > 0")
def artifact_relevance(s, d):
    return M.artifacts(files(s, d), "Cache").select("file_path", "title", "relevance")


@query(f"WITH {FILES}, {DOCS}, c AS (SELECT * FROM docs ORDER BY file_path LIMIT 1000), k AS (SELECT file_path, title, array_to_string(regexp_extract_all(content, {_sql(_LINK)}, 1), ' ') AS links FROM c) SELECT file_path, score FROM (SELECT file_path, (CASE WHEN contains(lower(file_path), 'docs') THEN 4 ELSE 0 END + CASE WHEN contains(lower(title), 'docs') THEN 5 ELSE 0 END + CASE WHEN contains(lower(links), 'docs') THEN 2 ELSE 0 END + CASE WHEN contains(lower(concat_ws(chr(10), file_path, title, links)), 'docs') THEN 8 ELSE 0 END)::INT AS score FROM k) WHERE score > 0 ORDER BY score DESC, file_path LIMIT 100")
def catalog_rank(s, d):
    made = M.catalog(M.artifacts(files(s, d)), F.lit("2024-01-01").cast("timestamp"))
    return M.catalog_search(made, "docs", "hybrid", 100).select("file_path", "score")


@query("SELECT link, CASE WHEN regexp_matches(trim(link), '(?i)^(references|implements|supersedes|blocks|related):.+') THEN lower(split_part(trim(link), ':', 1)) ELSE 'references' END AS kind FROM (SELECT DISTINCT unnest([title, 'Blocks: ' || title, 'other:' || title]) AS link FROM documents WHERE title IS NOT NULL)")
def typed_links(s, d):
    t = read(s, d, "documents").where("title IS NOT NULL").select(F.explode(F.array("title", F.concat(F.lit("Blocks: "), "title"), F.concat(F.lit("other:"), "title"))).alias("link")).distinct()
    return t.select("link", M.typed_link(F.col("link"))["kind"].alias("kind"))


@query(f"WITH {SYMBOLS}, f AS (SELECT filepath, list(DISTINCT lower(name)) AS names FROM symbols GROUP BY filepath) SELECT filepath, (CASE WHEN list_contains(names, 'cache') OR lower(filepath) = 'cache' THEN 3 ELSE 0 END + CASE WHEN contains(lower(filepath), 'cache') OR len(list_filter(names, lambda x: contains(x, 'cache'))) > 0 THEN 1 ELSE 0 END)::INT AS focus FROM f")
def focus_scores(s, d):
    f = symbols(s, d).groupBy("filepath").agg(F.collect_set("name").alias("names"))
    return f.select("filepath", M.focus_score(F.col("filepath"), F.col("names"), ["Cache"]).alias("focus"))


@query("SELECT doc_id, (epoch_us(updated_at) // 1000) AS ms, floor((epoch(TIMESTAMP '2025-01-01') - floor(epoch(updated_at))) / 86400)::BIGINT AS days FROM documents WHERE updated_at IS NOT NULL")
def record_ages(s, d):
    t = read(s, d, "documents").where("updated_at IS NOT NULL")
    # the id in base 36 read back as a number
    return t.select("doc_id", F.conv(F.upper(M.time_id(F.col("updated_at"))), 36, 10).cast("long").alias("ms"), M.age_days(F.col("updated_at"), F.lit("2025-01-01").cast("timestamp")).alias("days"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def task_counts(s, d):
    return M.status_counts(read(s, d, "events").select(F.col("event_type").alias("status")))


@query("""SELECT line FROM (SELECT event_type, count(*) AS n, count(*) FILTER (value < 0) AS bad, quantile_disc(value, 0.5) FILTER (rn <= 200) AS p50, quantile_disc(value, 0.95) FILTER (rn <= 200) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY 1),
LATERAL (SELECT unnest(['tool_calls_total{tool="' || event_type || '",outcome="success"} ' || (n - bad), 'tool_calls_total{tool="' || event_type || '",outcome="failure"} ' || bad, 'tool_duration_ms{tool="' || event_type || '",quantile="0.5"} ' || round(p50 * 100)::BIGINT, 'tool_duration_ms{tool="' || event_type || '",quantile="0.95"} ' || round(p95 * 100)::BIGINT]) AS line)""")
def prometheus_lines(s, d):
    m = R.call_metrics(read(s, d, "events"), failed=F.col("value") < 0)
    hundred = lambda c: F.round(F.col(c) * 100).cast("long").alias(c)
    return M.prometheus(m.select(F.col("event_type").alias("tool"), "calls", "failures", hundred("p50"), hundred("p95")), "tool")


@query("""WITH r AS (SELECT lower(trim(source)) AS query, doc_id AS id, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE source IS NOT NULL),
g AS (SELECT query, count(*) FILTER (rank <= 10) / 10.0 AS p, count(*) AS n FROM r GROUP BY 1) SELECT 'recall' AS metric, round(avg(least(10, n) / n), 4) AS value, 0.95::DOUBLE AS threshold, avg(least(10, n) / n) >= 0.95 AS passed FROM g UNION ALL SELECT 'mrr', 1.0, 0.95, TRUE FROM g HAVING count(*) > 0""")
def quality_gate(s, d):
    docs = read(s, d, "documents").where("source IS NOT NULL").withColumn("query", F.lower(F.trim("source")))
    ranked = R.top_per_key(docs, "query", 10, F.desc("n_chars"), "doc_id").select("query", F.col("doc_id").alias("id"), "rank")
    return M.quality_gate(V.ranked_metrics(ranked, docs.select("query", F.col("doc_id").alias("id")), 10), {"recall": 0.95, "mrr": 0.95})


# ------------------------------------------------------------------ retrieval in three modes
def code_chunks(s, d):
    """Each chunk once, by its latest row."""
    rows = read(s, d, "code_chunks").where("id IS NOT NULL").select("id", F.struct("indexed_at", "content", S.normal_path(F.col("filepath")).alias("filepath"), "language", "startline", "endline", F.coalesce("symbolname", F.lit("")).alias("symbolname"), F.coalesce("symboltype", F.lit("")).alias("symboltype"), "vector").alias("r"))
    one = rows.groupBy("id").agg(F.max_by("r", F.struct("r.indexed_at", "r.content", "r.filepath")).alias("r"))
    return one.select("id", *[F.col(f"r.{c}").alias(c) for c in ("content", "filepath", "language", "startline", "endline", "symbolname", "symboltype", "vector")])


_CC = f"""cc AS (SELECT id, r.content AS content, r.filepath AS filepath, r.language AS language, r.startline AS startline, r.endline AS endline, r.symbolname AS symbolname, r.symboltype AS symboltype, r.vector AS vector FROM (
 SELECT id, arg_max({{'content': content, 'filepath': {PATH}, 'language': language, 'startline': startline, 'endline': endline, 'symbolname': coalesce(symbolname, ''), 'symboltype': coalesce(symboltype, ''), 'vector': vector}}, {{'t': coalesce(indexed_at, TIMESTAMP '0001-01-01'), 'c': content, 'f': {PATH}}}) AS r FROM code_chunks WHERE id IS NOT NULL GROUP BY id))"""
_VEC = f"vec AS (SELECT id, {_DIST.replace('embedding[', 'vector[')} AS score FROM cc WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)"
_TOK = "regexp_extract_all(lower(content), '[a-z0-9_$]+')"
_FTS = f"""tok AS (SELECT id, {_TOK} AS w FROM cc WHERE content IS NOT NULL), len AS (SELECT id, len(w) AS len, len(list_filter(w, lambda x: x = 'frozen')) AS a, len(list_filter(w, lambda x: x = 'cache')) AS b FROM tok),
st AS (SELECT count(*) AS n, avg(len) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM len),
fts AS (SELECT id, 1.0 / row_number() OVER (ORDER BY s DESC, id) AS score FROM (SELECT id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / m)) AS s FROM len, st WHERE a > 0 OR b > 0))"""
_HYBRID = """hybrid AS (SELECT id, sum(s) AS score FROM (SELECT id, 0.5 / (60 + r) AS s FROM (SELECT id, row_number() OVER (ORDER BY score, id) AS r FROM vec) WHERE r <= 1002 UNION ALL SELECT id, 0.5 / (60 + r) FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM fts) WHERE r <= 1002) GROUP BY id)"""


def _search_sql(mode: str, order: str) -> str:
    sig = "+".join(f"(CASE WHEN contains(lower(symbolname || ' ' || symboltype), '{t}') THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(coalesce(content, '')), '{t}') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(filepath), '{t}') THEN 0.5 ELSE 0 END)" for t in ("frozen", "cache"))
    views = {"vector": _VEC, "fts": _FTS, "hybrid": f"{_VEC}, {_FTS}, {_HYBRID}"}[mode]
    name = {"vector": "vec"}.get(mode, mode)
    return f"""WITH {_CC}, {views}, pool AS (SELECT cc.*, p.score FROM (SELECT id, score FROM {name} ORDER BY score {order}, id LIMIT 500) p JOIN cc USING (id) WHERE lower(language) = 'python'),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filepath, startline, symbolname ORDER BY score {order}, filepath, startline, id) AS k FROM pool) WHERE k = 1), ranked AS (SELECT *, row_number() OVER (ORDER BY score {order}, filepath, startline, id) - 1 AS old, count(*) OVER () AS many FROM one),
again AS (SELECT *, CASE WHEN many > 1 THEN 0.65 / (old + 1) + 0.35 * least(1.0, ({sig}) / 9.0) ELSE score END AS s2 FROM ranked), placed AS (SELECT *, row_number() OVER (ORDER BY s2 DESC, old) - 1 AS rank FROM again)
SELECT id, round(s2, 6) AS score, rank FROM placed ORDER BY rank LIMIT 30"""


@query(_search_sql("vector", "ASC"))
def search_vector(s, d):
    return A.search(code_chunks(s, d), "frozen cache", _TARGET, "vector", limit=30, language="Python").select("id", "score", "rank")


@query(_search_sql("fts", "DESC"))
def search_fts(s, d):
    return A.search(code_chunks(s, d), "frozen cache", _TARGET, "fts", limit=30, language="Python").select("id", "score", "rank")


@query(_search_sql("hybrid", "DESC"))
def search_hybrid(s, d):
    return A.search(code_chunks(s, d), "frozen cache", _TARGET, "hybrid", limit=30, language="Python").select("id", "score", "rank")


@query()
def search_composite(s, d):
    return A.search(code_chunks(s, d), "frozen cache", _TARGET, "hybrid", "code", limit=20, floor=0.3, neighbours=2, include_tests=False)


_SPLIT = r"string_split(content, chr(10)) AS ls, list_transform(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\s*(//|#|/\*|\*)') OR regexp_replace(x, '\s', '', 'g') = '') AS remark"


@query(rf"""WITH {_CC}, l AS (SELECT id, ls, coalesce(nullif(list_position(remark, FALSE), 0), len(ls) + 1) AS first FROM (SELECT id, {_SPLIT} FROM cc WHERE content IS NOT NULL)),
c AS (SELECT id, nullif(array_to_string(list_filter(ls[1:first - 1], lambda x: regexp_replace(x, '\s', '', 'g') <> ''), chr(10)), '') AS documentation, array_to_string(ls[first:], chr(10)) AS code FROM l),
o AS (SELECT *, least(coalesce(nullif(instr(code, '{{'), 0), 1000000000), coalesce(nullif(instr(code, '=>'), 0), 1000000000)) AS opening FROM c)
SELECT id, documentation, nullif(regexp_replace(CASE WHEN opening < 1000000000 THEN left(code, opening - 1) ELSE split_part(code, chr(10), 1) END, '^\s+|\s+$', '', 'g'), '') AS signature, regexp_replace(CASE WHEN opening < 1000000000 THEN substr(code, opening) ELSE code END, '^\s+|\s+$', '', 'g') AS body FROM o""")
def content_parts(s, d):
    doc, head, body = S.content_parts(F.col("content"))
    return code_chunks(s, d).where("content IS NOT NULL").select("id", doc.alias("documentation"), head.alias("signature"), body.alias("body"))


@query(f"""WITH {_CC}, {SYMBOLS}, m AS (SELECT id, s.name, min(s.line) AS pos FROM cc JOIN symbols s USING (filepath) WHERE cc.startline <= coalesce(s.endline, s.line) AND s.line <= cc.endline GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, name) AS rn FROM m),
n AS (SELECT id, string_agg(name, ', ' ORDER BY rn) AS names FROM r WHERE rn <= 20 GROUP BY id)
SELECT id, concat_ws(chr(10), 'File: ' || filepath, 'Language: ' || language, 'Symbols: ' || names) AS header FROM cc LEFT JOIN n USING (id)""")
def enrichment_headers(s, d):
    from .operators import context as N

    c = code_chunks(s, d)
    return N.enrichment_header(c.select("id", "filepath", "language"), N.chunk_symbols(c.select("id", "filepath", "startline", "endline"), symbols(s, d)))


@query("SELECT doc_id, strpos(lower(text), 'cache') > 0 AS hit, substr(text, greatest(strpos(lower(text), 'cache') - 100, 1)::INT, (strpos(lower(text), 'cache') + 180 - greatest(strpos(lower(text), 'cache') - 100, 1))::INT) AS head FROM documents WHERE text IS NOT NULL")
def snippets(s, d):
    at = F.instr(F.lower("text"), "cache")
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", (at > 0).alias("hit"), S.snippet(F.col("text"), at).alias("head"))


@query("SELECT repo, count(*) AS total, " + ", ".join(f"count(*) FILTER (type = '{k}') AS n_{k}" for k in ("function", "method", "class", "interface", "type", "enum", "variable", "constant", "property")) + f" FROM (WITH {SYMBOLS} SELECT * FROM symbols) GROUP BY repo")
def symbol_kinds(s, d):
    return R.symbol_summary(symbols(s, d), ["function", "method", "class", "interface", "type", "enum", "variable", "constant", "property"])


@query(f"WITH {FILES}, y AS ({_DECLARED}) SELECT filepath, length(content) - length(replace(content, chr(10), '')) + 1 AS lines, (SELECT count(*) FROM y WHERE y.filepath = f.filepath AND type = 'function') AS functions, (SELECT count(*) FROM y WHERE y.filepath = f.filepath AND type = 'class') AS classes, len(regexp_extract_all(content, {_sql(C._IMPORT.pattern)})) AS imports FROM files f")
def file_metrics(s, d):
    f = files(s, d)
    y = C.extract(f, "symbols").groupBy("filepath").agg(F.count_if(F.col("type") == "function").alias("functions"), F.count_if(F.col("type") == "class").alias("classes"))
    i = C.extract(f, "imports").groupBy("filepath").agg(F.count(F.lit(1)).alias("imports"))
    return f.select("filepath", S.line_count(F.col("content")).alias("lines")).join(y, "filepath", "left").join(i, "filepath", "left").na.fill(0, ["functions", "classes", "imports"])


@query(f"""WITH {SYMBOLS}, t AS (SELECT DISTINCT filepath, name, line FROM symbols WHERE name IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY filepath, line, name) AS rn FROM t) SELECT filepath, name, line, (SELECT count(*) FROM t) > 200 AS truncated FROM r WHERE rn <= 200""")
def truncated_symbols(s, d):
    return M.truncated(symbols(s, d).select("filepath", "name", "line").distinct(), 200, "filepath", "line", "name")


# ------------------------------------------------------------------ call graph
_NO_CALL = ", ".join(f"'{w}'" for w in sorted(X._NO_CALL))
_WITH_BRACKET = " UNION ALL ".join(f"SELECT filepath, unnest(regexp_extract_all(content, {_sql(p if p.endswith('(') else p + chr(92) + 's*' + chr(92) + '(')}, 1)) AS name FROM src" for k, p in C.DECLARATIONS if k == "function")
CALLS = rf"""src AS (SELECT * FROM files WHERE CASE WHEN {_LANGUAGE} = 'tsx' THEN 'typescript' ELSE {_LANGUAGE} END IN ('typescript', 'javascript', 'python', 'go')),
said AS (SELECT filepath, name, count(*) AS n FROM (SELECT filepath, unnest(regexp_extract_all(replace(content, '(', '(('), '(?:^|[^\w$.])([A-Za-z_$][\w$]*)\s*\(', 1)) AS name FROM src) WHERE name NOT IN ({_NO_CALL}) GROUP BY 1, 2),
made AS (SELECT filepath, name, count(*) AS n FROM ({_WITH_BRACKET}) GROUP BY 1, 2), site AS (SELECT repo, said.name, sum(said.n - coalesce(made.n, 0))::BIGINT AS n FROM said JOIN files USING (filepath) LEFT JOIN made ON made.filepath = said.filepath AND made.name = said.name GROUP BY 1, 2),
goal AS (SELECT repo, name, count(DISTINCT filepath) AS n FROM (SELECT * FROM ({_DECLARED}) WHERE type = 'function') JOIN files USING (filepath) GROUP BY 1, 2)"""


@query(f"WITH {FILES}, {CALLS} SELECT name, sum(site.n * goal.n)::BIGINT AS n FROM site JOIN goal USING (repo, name) WHERE site.n > 0 GROUP BY 1")
def call_edges(s, d):
    return P.call_graph(P.Tables(files(s, d))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query()
def call_context(s, d):
    g = P.call_graph(P.Tables(files(s, d)))
    from .operators import graph

    e = g.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return graph.call_context(e, e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), 10)


@query(f"WITH {FILES}, {CALLS} SELECT coalesce(sum(site.n * goal.n), 0)::BIGINT AS edge_count FROM site JOIN goal USING (repo, name) WHERE site.n > 0")
def total_calls(s, d):
    return P.call_totals(P.call_graph(P.Tables(files(s, d)))).select("edge_count")


@query()
def top_callers(s, d):
    g = P.call_graph(P.Tables(files(s, d)))
    return P.top_names(g, "caller").withColumn("side", F.lit("caller")).unionByName(P.top_names(g, "callee").withColumn("side", F.lit("callee")))


@query()
def busiest_functions(s, d):
    return P.busiest_nodes(P.call_graph(P.Tables(files(s, d))), 100)


# ------------------------------------------------------------------ version control
CHANGED = f"ch AS (SELECT DISTINCT commit_id AS key, {PATH} AS path, CASE WHEN lower(trim(change_type)) = 'add' THEN 'added' WHEN lower(trim(change_type)) = 'unlink' THEN 'deleted' ELSE 'modified' END AS kind FROM file_changes WHERE commit_id IS NOT NULL AND filepath IS NOT NULL)"


def _changed(s, d):
    kind = F.lower(F.trim("change_type"))
    return read(s, d, "file_changes").where("commit_id IS NOT NULL AND filepath IS NOT NULL").select(F.col("commit_id").alias("key"), S.normal_path(F.col("filepath")).alias("path"), F.when(kind == "add", "A").when(kind == "unlink", "D").otherwise("M").alias("code")).distinct()


@query(f"WITH {CHANGED} SELECT key, path, kind FROM ch")
def revision_changes(s, d):
    """Each commit's changes written as captured output and read back."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "code"))), lambda x: F.concat(x["code"], F.lit("\0"), x["path"])), "\0")
    return H.revision_changes(_changed(s, d).groupBy("key").agg(text.alias("text"))).select("key", "path", "kind")


@query(f"WITH {CHANGED} SELECT key, path, kind, kind = 'added' AS untracked FROM ch")
def status_entries(s, d):
    code = F.when(F.col("code") == "A", "??").when(F.col("code") == "D", " D").otherwise("M ")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", code.alias("c")))), lambda x: F.concat(x["c"], F.lit(" "), x["path"])), "\0")
    return H.status(_changed(s, d).groupBy("key").agg(text.alias("text"))).select("key", "path", "kind", "untracked")


@query("SELECT coalesce(nullif(repo, ''), 'none') AS key, doc_id::VARCHAR AS commit, title AS subject FROM documents WHERE doc_id IS NOT NULL AND title IS NOT NULL AND title <> ''")
def commit_history(s, d):
    t = read(s, d, "documents").where("doc_id IS NOT NULL AND title IS NOT NULL AND title <> ''").select(F.coalesce(F.nullif("repo", F.lit("")), F.lit("none")).alias("key"), F.col("doc_id").cast("string").alias("c"), "title")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "title"))), lambda x: F.concat_ws("\0", x["c"], F.lit("author"), F.lit("2024-01-01"), x["title"])), "\0")
    return H.history(t.groupBy("key").agg(text.alias("text"))).select("key", "commit", "subject")


@query(f"WITH {CHANGED} SELECT key, row_number() OVER (PARTITION BY key ORDER BY path, kind) AS line, path AS summary FROM ch")
def blamed_lines(s, d):
    row = lambda x, k: F.concat(F.lit("abcdef0 1 "), (k + 1).cast("string"), F.lit("\nauthor a\nauthor-time 1\nsummary "), x["path"], F.lit("\n\tcode"))
    order = F.sort_array(F.collect_list(F.struct("path", F.when(F.col("code") == "A", "added").when(F.col("code") == "D", "deleted").otherwise("modified").alias("k"))))
    return H.blame(_changed(s, d).groupBy("key").agg(F.array_join(F.transform(order, row), "\n").alias("text"))).select("key", "line", "summary")
