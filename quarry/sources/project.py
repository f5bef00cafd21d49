"""Project metadata: manifests, frameworks, entry points, aliases, owners, saved state and captured navigation replies, all as tables."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normal_path
from .languages import base_name, extension, language_of

# Manifest names and their kinds.
MANIFESTS = {
    "package.json": "javascript-package", "pnpm-workspace.yaml": "pnpm-workspace", "lerna.json": "lerna-workspace", "nx.json": "nx-workspace", "turbo.json": "turborepo-workspace",
    "tsconfig.json": "typescript-config", "jsconfig.json": "javascript-config", "pyproject.toml": "python-package", "requirements.txt": "python-dependencies", "requirements-dev.txt": "python-dependencies",
    "setup.py": "python-package", "setup.cfg": "python-config", "poetry.lock": "python-lockfile", "uv.lock": "python-lockfile", "cargo.toml": "rust-package", "cargo.lock": "rust-lockfile",
    "go.mod": "go-module", "go.work": "go-workspace", "go.sum": "go-lockfile", "pom.xml": "maven-project", "build.gradle": "gradle-project", "build.gradle.kts": "gradle-project",
    "settings.gradle": "gradle-config", "settings.gradle.kts": "gradle-config", "composer.json": "php-package", "composer.lock": "php-lockfile", "gemfile": "ruby-package", "gemfile.lock": "ruby-lockfile",
    "mix.exs": "elixir-package", "mix.lock": "elixir-lockfile", "pubspec.yaml": "dart-package", "pubspec.lock": "dart-lockfile", "makefile": "make-project", "dockerfile": "container-config",
    "docker-compose.yml": "container-config", "docker-compose.yaml": "container-config", "compose.yml": "container-config", "compose.yaml": "container-config", "angular.json": "angular-config",
    "vite.config.js": "vite-config", "vite.config.ts": "vite-config", "next.config.js": "next-config", "next.config.mjs": "next-config", "next.config.ts": "next-config", "nuxt.config.ts": "nuxt-config",
}
CONFIG_FILE = r"(?i)^(?:\.?[^/]+\.(?:config|conf|ini|toml|yaml|yml|json|xml)|Dockerfile(?:\..*)?|Makefile)$"
DOCUMENTATION = ["md", "markdown", "rst", "txt"]
SKIPPED_FOLDERS = ["node_modules", ".git", ".src-index", "dist", "build", "coverage", ".next", ".nuxt", ".turbo", ".cache", "target", "vendor", "out", "obj"]
VISIBLE_FOLDERS = [".devcontainer", ".github", ".vscode", ".husky"]
ENTRYPOINTS = (
    "main.ts main.tsx main.js main.jsx main.py main.go main.rs index.ts index.tsx index.js index.jsx index.py index.go index.rs server.ts server.js server.py app.ts app.js app.py manage.py __main__.py"
).split()
PROFILE_TEST = r"(?i)(?:^|/)(?:test|tests|__tests__|spec)(?:/|$)|(?:\.test|\.spec)\.[^/]+$|(?:^|/)(?:test_[^/]+|[^/]+_test)\.(?:py|go|rs)$"
TEST_SEGMENT = r"(?i)^(?:test|tests|__tests__|spec)$"
# Dependency -> framework and its category.
FRAMEWORKS = {
    "react": "React ui", "react-native": "React Native mobile", "next": "Next.js web", "vue": "Vue ui", "nuxt": "Nuxt web", "svelte": "Svelte ui", "@sveltejs/kit": "SvelteKit web", "@angular/core": "Angular web",
    "express": "Express server", "fastify": "Fastify server", "@nestjs/core": "NestJS server", "hono": "Hono server", "astro": "Astro web", "vite": "Vite build", "webpack": "Webpack build",
    "vitest": "Vitest testing", "jest": "Jest testing", "playwright": "Playwright testing", "cypress": "Cypress testing", "prisma": "Prisma data", "drizzle": "Drizzle data", "django": "Django web",
    "fastapi": "FastAPI web", "flask": "Flask web", "pytest": "pytest testing", "sqlalchemy": "SQLAlchemy data", "pydantic": "Pydantic data", "tokio": "Tokio runtime", "axum": "Axum server",
    "actix": "Actix server", "serde": "Serde serialization", "tauri": "Tauri desktop", "gin": "Gin server", "echo": "Echo server", "fiber": "Fiber server",
}
FRAMEWORKS = {k: tuple(v.rsplit(" ", 1)) for k, v in FRAMEWORKS.items()}
APPLICATION_FRAMEWORKS = ["Next.js", "React Native", "Django", "FastAPI"]
LOCKS = [("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lock", "bun"), ("package-lock.json", "npm")]
CODEOWNERS = ["CODEOWNERS", ".github/CODEOWNERS", ".gitlab/CODEOWNERS", "docs/CODEOWNERS"]
MAX_ENTRIES, MAX_LEVEL = 20_000, 8


# ------------------------------------------------------------------ predicates of paths
def manifest_kind(path: Column) -> Column:
    from .languages import lookup

    return lookup(MANIFESTS, F.lower(base_name(path)))


def is_config(path: Column) -> Column:
    return base_name(path).rlike(CONFIG_FILE) | manifest_kind(path).isNotNull()


def is_documentation(path: Column) -> Column:
    return extension(base_name(path)).isin(DOCUMENTATION)


def is_entrypoint(path: Column) -> Column:
    return F.lower(base_name(path)).isin(ENTRYPOINTS)


def is_profile_test(path: Column) -> Column:
    return F.lower(path).rlike(PROFILE_TEST)


def test_root(path: Column) -> Column:
    """Folder down to the first one named after tests, else the file's own folder (``.`` at the root); null for files that are no tests."""
    parts = F.split(path, "/")
    at = F.array_position(F.transform(parts, lambda x: x.rlike(TEST_SEGMENT)), F.lit(True)).cast("int")
    own = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).otherwise(".")
    return F.when(is_profile_test(path), F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), at), "/")).otherwise(own))


def within_root(path: Column, root: str) -> Column:
    """Whether a path, its ``.`` and ``..`` resolved, stays in ``root``; absolute paths must begin with it."""
    p = F.translate(path, "\\", "/")
    full = F.when(p.startswith("/") | p.rlike("^[A-Za-z]:/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))
    step = lambda done, x: F.when((x == "") | (x == "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    clean = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step), "/"))
    base = root.rstrip("/")
    return F.coalesce(((clean == base) | clean.startswith(base + "/")) & ~p.contains("\0"), F.lit(False))


def discover(files: DataFrame, max_entries: int = MAX_ENTRIES, max_depth: int = MAX_LEVEL) -> DataFrame:
    """The manifests, configuration and documentation files of a listing (repo, path), the first ``max_entries`` of a repository in order of path."""
    from pyspark.sql import Window as W

    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    hidden = F.exists(folders, lambda x: x.startswith(".") & ~x.isin(VISIBLE_FOLDERS))
    kept = files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))) & ~hidden & (F.size(folders) <= max_depth))
    kept = kept.where(is_config(F.col("path")) | is_documentation(F.col("path")))
    return kept.withColumn("rn", F.row_number().over(W.partitionBy("repo").orderBy("path"))).where(F.col("rn") <= max_entries).drop("rn")


# ------------------------------------------------------------------ manifests
def toml_name(content: Column, section: str) -> Column:
    """``name`` of a section of a TOML text; without that section of the whole text."""
    part = F.regexp_extract(content, rf"(?i)(?:^|\n)\s*\[{section}\]([\s\S]*?)(?=\n\s*\[|$(?![\s\S]))", 1)
    found = content.rlike(rf"(?i)(?:^|\n)\s*\[{section}\]")
    return F.nullif(F.regexp_extract(F.when(found, part).otherwise(content), r"(?i)(?:^|\n)\s*name\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))


def go_module(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, r"(?m)^\s*module\s+(\S+)", 1), F.lit(""))


def dependency_names(content: Column) -> Column:
    """Distinct lower-case names of the four dependency fields of a JSON manifest, sorted."""
    fields = [F.map_keys(F.from_json(F.get_json_object(content, f"$.{f}"), "map<string,string>")) for f in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in fields))), F.lower)))


def workspace_patterns(content: Column) -> Column:
    """The first hundred workspace patterns of a JSON manifest: a list, or the ``packages`` of an object."""
    plain = F.from_json(F.get_json_object(content, "$.workspaces"), "array<string>")
    packed = F.from_json(F.get_json_object(content, "$.workspaces.packages"), "array<string>")
    return F.slice(F.coalesce(packed, plain, F.array().cast("array<string>")), 1, 100)


def manifest_facts(files: DataFrame) -> DataFrame:
    """(repo, path, kind, name, dependencies, workspaces, package_manager) of the manifests among files (repo, path, content).

    The package manager is the configured one, else that of a lock file beside the manifest, else npm.
    """
    rows = files.withColumn("kind", manifest_kind(F.col("path"))).where("kind IS NOT NULL")
    name = F.lower(base_name(F.col("path")))
    json_like, content = name.isin("package.json", "composer.json"), F.col("content")
    title = F.when(json_like, F.nullif(F.trim(F.get_json_object(content, "$.name")), F.lit(""))).when(name == "pyproject.toml", toml_name(content, "project")).when(name == "cargo.toml", toml_name(content, "package")).when(name == "go.mod", go_module(content))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    locks = files.select("repo", "path").withColumn("lock", base_name(F.col("path"))).where(F.col("lock").isin([x for x, _ in LOCKS]))
    order = F.create_map(*(F.lit(y) for k, (x, _) in enumerate(LOCKS) for y in (x, k)))
    beside = locks.groupBy("repo", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("folder")).agg(F.min_by("lock", order[F.col("lock")]).alias("lock"))
    managers = F.create_map(*(F.lit(y) for x, m in LOCKS for y in (x, m)))
    configured = F.nullif(F.split(F.trim(F.get_json_object(content, "$.packageManager")), "@")[0], F.lit(""))
    facts = rows.withColumn("folder", folder).join(beside, ["repo", "folder"], "left")
    return facts.select("repo", "path", "kind", title.alias("name"), F.when(json_like, dependency_names(content)).otherwise(F.array().cast("array<string>")).alias("dependencies"), F.when(json_like, workspace_patterns(content)).otherwise(F.array().cast("array<string>")).alias("workspaces"), F.when(name == "package.json", F.coalesce(configured, managers[F.col("lock")], F.lit("npm"))).alias("package_manager"))


def frameworks(files: DataFrame, most: int = 5) -> DataFrame:
    """(repo, framework, category, evidence): the frameworks that a repository's manifests (repo, path, content) name, with at most ``most`` manifests as evidence.

    JSON packages name them as dependencies, other manifests anywhere between blanks, quotes, slashes and colons.
    """
    from pyspark.sql import Window as W

    rows = files.withColumn("kind", manifest_kind(F.col("path"))).where("kind IS NOT NULL")
    text = F.lower("content")
    mentioned = F.filter(F.array(*map(F.lit, FRAMEWORKS)), lambda x: F.lit(True))
    found = F.when(F.col("kind") == "javascript-package", F.filter(dependency_names(F.col("content")), lambda x: x.isin(list(FRAMEWORKS))))
    words = F.regexp_extract_all(F.concat(F.lit(" "), F.regexp_replace(text, r"[\s\"'/:]", "  "), F.lit(" ")), F.lit(r" ([^ ]+) "), F.lit(1))
    # names with a slash or colon of their own are looked for as they stand
    long = [k for k in FRAMEWORKS if "/" in k]
    whole = F.filter(F.array(*map(F.lit, long)), lambda x: F.rlike(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(r"[\s\"'/:]\Q"), x, F.lit(r"\E[\s\"'/:]"))))
    other = F.concat(F.array_intersect(mentioned, words), whole)
    signals = rows.select("repo", "path", F.explode(F.array_distinct(F.coalesce(found, other))).alias("dependency"))
    table = F.create_map(*(F.lit(y) for k, (n, _) in FRAMEWORKS.items() for y in (k, n)))
    category = F.create_map(*(F.lit(y) for n, c in dict(FRAMEWORKS.values()).items() for y in (n, c)))
    named = signals.select("repo", table[F.col("dependency")].alias("framework"), "path").distinct()
    ranked = named.withColumn("rn", F.row_number().over(W.partitionBy("repo", "framework").orderBy("path"))).where(F.col("rn") <= most)
    return ranked.groupBy("repo", "framework").agg(F.sort_array(F.collect_list("path")).alias("evidence")).select("repo", "framework", category[F.col("framework")].alias("category"), "evidence")


def project_profile(files: DataFrame) -> DataFrame:
    """(repo, project_name, project_kind, manifests, entrypoints, test_files, test_roots) of every repository of files (repo, path, content), paths relative to it.

    The name is that of a manifest at the root, then the Go module's, then the repository's; the kind is
    workspace before application before library before unknown.
    """
    facts, kit = manifest_facts(files), frameworks(files)
    apps = kit.where(F.col("framework").isin(APPLICATION_FRAMEWORKS)).select("repo").distinct().withColumn("app", F.lit(True))
    by_repo = facts.groupBy("repo").agg(
        F.count(F.lit(1)).alias("manifests"),
        F.min(F.when(~F.col("path").contains("/") & F.col("name").isNotNull(), F.struct("path", "name"))).alias("root"),
        F.max((F.size("workspaces") > 0) | F.col("kind").contains("workspace")).alias("workspace"),
    )
    paths = files.groupBy("repo").agg(F.count_if(is_entrypoint(F.col("path"))).alias("entrypoints"), F.count_if(is_profile_test(F.col("path"))).alias("test_files"), F.count_distinct(test_root(F.col("path"))).alias("test_roots"))
    kind = F.when(F.col("workspace"), "workspace").when((F.col("entrypoints") > 0) | F.col("app"), "application").when(F.col("manifests") > 0, "library").otherwise("unknown")
    return paths.join(by_repo, "repo", "left").join(apps, "repo", "left").select("repo", F.coalesce("root.name", "repo").alias("project_name"), kind.alias("project_kind"), F.coalesce("manifests", F.lit(0)).alias("manifests"), "entrypoints", "test_files", "test_roots")


def language_totals(files: DataFrame) -> DataFrame:
    """(language, files, bytes) of files (path, bytes), each path once, most files first."""
    once = files.groupBy("path").agg(F.max("bytes").alias("bytes"))
    return once.groupBy(F.coalesce(language_of(F.col("path")), F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).orderBy(F.desc("files"), "language")


def profile_fingerprint(files: DataFrame, root: str) -> DataFrame:
    """(fingerprint): SHA-256 over the root and every file's (path, size, mtime in milliseconds) in order of path.

    One hash over a whole listing is sequential by its definition; a listing is bounded by the scan's budget of files.
    """
    line = F.concat(F.col("path"), F.lit("\0"), F.col("size").cast("string"), F.lit("\0"), F.col("mtime").cast("string"), F.lit("\n"))
    return files.agg(F.sort_array(F.collect_list(F.struct("path", line.alias("line")))).alias("l")).select(F.sha2(F.concat(F.lit(root), F.array_join(F.transform("l", lambda x: x["line"]), "")), 256).alias("fingerprint"))


# ------------------------------------------------------------------ aliases, owners, state, roots
def path_aliases(text: str) -> dict[str, str]:
    """Prefix -> folder of a compiler configuration with comments: the first target of each pattern, from the base folder."""
    out: list[str] = []
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*[\s\S]*?\*/|[^"/]+|/', text):
        if not m.group().startswith(("//", "/*")):
            out.append(m.group())
    try:
        options = json.loads(re.sub(r",(\s*[}\]])", r"\1", "".join(out))).get("compilerOptions") or {}
    except (ValueError, AttributeError):
        return {}
    base, aliases = options.get("baseUrl") or ".", {}
    for pattern, targets in (options.get("paths") or {}).items():
        if not targets:
            continue
        star = pattern.endswith("/*") and targets[0].endswith("/*")
        target = targets[0][:-2] if star else targets[0]
        folder = posixpath.normpath(posixpath.join(base, target)).replace("\\", "/")
        aliases[pattern[:-1] if star else pattern] = folder + "/" if star else folder
    return aliases


def owners(files: DataFrame, most: int = 1000) -> DataFrame:
    """(repo, path, line, text) of the first existing owners file of each repository of files (repo, path, content)."""
    order = F.create_map(*(F.lit(y) for k, x in enumerate(CODEOWNERS) for y in (x, k)))
    first = files.where(F.col("path").isin(CODEOWNERS)).groupBy("repo").agg(F.min_by(F.struct("path", "content"), order[F.col("path")]).alias("f"))
    return first.select("repo", "f.path", F.posexplode(F.slice(F.split("f.content", r"\r?\n"), 1, most)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def read_state(spark: SparkSession, path: str, schema: str, version: int = 1, max_bytes: int = 4 << 20) -> DataFrame:
    """Records of a saved state file {version, records}; none of a missing, too large, malformed or other version's file."""
    from pathlib import Path

    body = {"records": []}
    file = Path(path)
    if file.is_file() and file.stat().st_size <= max_bytes:
        try:
            got = json.loads(file.read_text("utf-8"))
            body = got if isinstance(got, dict) and got.get("version") == version and isinstance(got.get("records"), list) else body
        except ValueError:
            pass
    lines = spark.createDataFrame([(json.dumps(r),) for r in body["records"]], "value string")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_state(path: str, records: list[dict], version: int = 1) -> None:
    """Replace a saved state file at once: written beside it, then renamed over it."""
    import os
    import tempfile

    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".state-")
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        json.dump({"version": version, "records": records}, out, sort_keys=True)
        out.flush()
        os.fsync(out.fileno())
    os.replace(temporary, path)


def hash_cache(entries: DataFrame) -> tuple[DataFrame, bool]:
    """(path, hash) of saved entries and whether the cache is valid: one entry without a path or a SHA-256 makes all of it invalid, so it counts as empty."""
    ok = F.coalesce((F.length("path") > 0) & F.col("hash").rlike("^[a-f0-9]{64}$"), F.lit(False))
    valid = entries.where(~ok).isEmpty()
    rows = entries.select(normal_path(F.col("path")).alias("path"), "hash")
    return (rows, True) if valid else (rows.limit(0), False)


def project_roots(roots: DataFrame, status: DataFrame) -> DataFrame:
    """(root, name, indexed, chunks) of the allowed roots beside the state of their index (root, chunks)."""
    joined = roots.select(F.regexp_replace(F.translate("root", "\\", "/"), r"(?<=.)/+$", "").alias("root")).distinct().join(status, "root", "left")
    return joined.select("root", base_name(F.col("root")).alias("name"), F.col("chunks").isNotNull().alias("indexed"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def content_or_file(spark: SparkSession, content: str | None = None, path: str | None = None, max_bytes: int = 1 << 20) -> DataFrame:
    """(path, content) of one given text or one file; exactly one of both is wanted, and the file must not be too large."""
    if (content is None) == (path is None):
        raise ValueError("either a content or a path")
    if content is not None:
        return spark.createDataFrame([(None, content)], "path string, content string")
    one = spark.read.format("binaryFile").load(path).select("path", "length", F.decode("content", "UTF-8").alias("content"))
    return one.select("path", F.when(F.col("length") <= max_bytes, F.col("content")).otherwise(F.raise_error(F.lit("file too large"))).alias("content"))


# ------------------------------------------------------------------ captured replies of language servers
_RANGE = "struct<start:struct<line:int,character:int>,end:struct<line:int,character:int>>"


def locations(replies: DataFrame) -> DataFrame:
    """(key, uri, line, character, end_line, end_character) of captured replies (key, json): one location or link, or a list; lines from 0."""
    kind = f"array<struct<uri:string,range:{_RANGE},targetUri:string,targetSelectionRange:{_RANGE},targetRange:{_RANGE}>>"
    listed = F.when(F.ltrim("json").startswith("["), F.col("json")).otherwise(F.concat(F.lit("["), F.col("json"), F.lit("]")))
    rows = replies.select("key", F.explode(F.from_json(listed, kind)).alias("l"))
    place = F.coalesce("l.range", "l.targetSelectionRange", "l.targetRange")
    out = rows.select("key", F.coalesce("l.uri", "l.targetUri").alias("uri"), place.alias("r")).where("uri IS NOT NULL AND r.start IS NOT NULL")
    return out.select("key", "uri", F.col("r.start.line").alias("line"), F.col("r.start.character").alias("character"), F.col("r.end.line").alias("end_line"), F.col("r.end.character").alias("end_character"))


def diagnostics(replies: DataFrame) -> DataFrame:
    """(key, uri, line, severity, source, message) of captured diagnostics (key, json {uri, diagnostics}); a missing severity is 1, an error."""
    rows = replies.select("key", F.from_json("json", f"uri string, diagnostics array<struct<range:{_RANGE},severity:int,source:string,message:string>>").alias("d")).select("key", "d.uri", F.explode("d.diagnostics").alias("d"))
    names = F.create_map(*(F.lit(y) for k, n in enumerate(("error", "warning", "information", "hint"), 1) for y in (k, n)))
    return rows.select("key", "uri", F.col("d.range.start.line").alias("line"), F.coalesce(names[F.coalesce("d.severity", F.lit(1))], F.lit("error")).alias("severity"), "d.source", "d.message")


def hovers(replies: DataFrame) -> DataFrame:
    """(key, text) of captured hovers (key, json): contents as a text, a marked text, or a list of them."""
    body = F.get_json_object("json", "$.contents")
    parts = F.transform(F.from_json(body, "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.value"), x))
    text = F.when(F.ltrim(body).startswith("["), F.array_join(parts, "\n\n")).otherwise(F.coalesce(F.get_json_object(body, "$.value"), body))
    return replies.select("key", text.alias("text")).where("text IS NOT NULL AND text <> ''")
