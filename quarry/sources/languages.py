"""Languages of files by name: tables of fixed values, and the orders in which they are asked."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages with a grammar and their extensions.
GRAMMARS = {
    "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "mts", "cts"], "tsx": ["tsx"], "html": ["html", "htm", "xhtml"], "svelte": ["svelte"],
    "c": ["c", "h"], "cpp": ["cpp", "hpp", "cc", "hh", "cxx", "hxx", "c++", "h++"], "rust": ["rs"], "go": ["go"], "java": ["java"], "kotlin": ["kt", "kts"],
    "scala": ["scala", "sc"], "python": ["py", "pyi", "pyw"], "ruby": ["rb", "rake", "gemspec"], "php": ["php", "phtml", "php3", "php4", "php5", "phps"],
    "ocaml": ["ml", "mli"], "swift": ["swift"], "c_sharp": ["cs", "csx"],
}
# Further languages and their extensions.
FALLBACK = {
    "json": ["json"], "yaml": ["yaml", "yml"], "toml": ["toml"], "ini": ["ini", "cfg", "conf"], "env": ["env"], "markdown": ["md", "markdown"], "rst": ["rst"], "latex": ["tex", "ltx"],
    "xml": ["xml"], "csv": ["csv"], "bash": ["sh", "bash", "zsh"], "fish": ["fish"], "powershell": ["ps1"], "batch": ["bat", "cmd"], "css": ["css"], "scss": ["scss"], "sass": ["sass"],
    "less": ["less"], "sql": ["sql"], "graphql": ["graphql", "gql"], "proto": ["proto"], "solidity": ["sol"], "zig": ["zig"], "nim": ["nim"], "lua": ["lua"], "r": ["r"], "dart": ["dart"],
    "elixir": ["ex", "exs"], "erlang": ["erl", "hrl"], "haskell": ["hs", "lhs"], "clojure": ["clj", "cljs", "cljc"], "lisp": ["lisp", "el"], "vim": ["vim"], "terraform": ["tf"],
    "hcl": ["hcl"], "vue": ["vue"], "text": ["txt", "log"],
}
# Names that decide alone.
SPECIAL = {
    "dockerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile", "cmakelists.txt": "cmake", ".gitignore": "gitignore", ".dockerignore": "gitignore", ".env": "env",
    ".editorconfig": "ini", ".prettierrc": "json", ".eslintrc": "json", "tsconfig.json": "json", "package.json": "json", "composer.json": "json", "cargo.toml": "toml",
    "pyproject.toml": "toml", "gemfile": "ruby", "rakefile": "ruby", "podfile": "ruby",
}
# Extensions of files that hold no text.
BINARY = (
    "png jpg jpeg gif bmp ico webp svg tiff mp3 mp4 wav avi mov mkv flac ogg zip tar gz rar 7z bz2 exe dll so dylib bin wasm pdf doc docx xls xlsx ppt pptx ttf otf woff woff2 eot class pyc o a lib node"
).split()
# Languages whose texts a splitter of their own cuts, by the name of the splitter.
SPLITTERS = {
    "javascript": "js", "typescript": "js", "tsx": "js", "jsx": "js", "python": "python", "go": "go", "rust": "rust", "java": "java", "cpp": "cpp", "c": "cpp", "html": "html", "markdown": "markdown",
    "md": "markdown", "ruby": "ruby", "php": "php", "scala": "scala", "swift": "swift", "solidity": "sol", "proto": "proto", "protobuf": "proto", "rst": "rst", "latex": "latex", "tex": "latex",
}

_BY_GRAMMAR = {e: lang for lang, exts in GRAMMARS.items() for e in exts}
_BY_FALLBACK = {e: lang for lang, exts in FALLBACK.items() for e in exts}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension of a name without its point; none for a name that begins with its only point."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null if it has none."""
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), key)


def is_binary(path: Column) -> Column:
    return extension(base_name(path)).isin(BINARY)


def language_of(path: Column) -> Column:
    """Language by special name, ``dockerfile.*``, ``.env.*``, then extension; null if none is known."""
    name = F.lower(base_name(path))
    prefixed = F.when(name.startswith("dockerfile."), "dockerfile").when(name.startswith(".env."), "env")
    return F.coalesce(lookup(SPECIAL, name), prefixed, lookup(_BY_FALLBACK | _BY_GRAMMAR, extension(name)))


def indexable(path: Column) -> Column:
    """Text of a known language."""
    return ~is_binary(path) & language_of(path).isNotNull()


def unified_language(path: Column) -> Column:
    """Language by grammar extension, further extension, special name, then ``text``: another order than ``language_of``."""
    name = F.lower(base_name(path))
    ext = extension(name)
    prefixed = F.when(name.startswith(".env.") | (name == ".env"), "env").when(name.startswith("dockerfile.") | (name == "dockerfile"), "dockerfile")
    return F.coalesce(lookup(_BY_GRAMMAR, ext), lookup(_BY_FALLBACK, ext), lookup(SPECIAL, name), prefixed, F.lit("text"))


def chunk_language(path: Column) -> Column:
    """Language as chunks carry it: dialects under their main name, ``unknown`` where none is known."""
    found = language_of(path)
    return F.when(found == "tsx", "typescript").when(found == "c_sharp", "csharp").otherwise(F.coalesce(found, F.lit("unknown")))


def parse_method(path: Column) -> Column:
    """How a file is cut: by a grammar, by its language's splitter, generically, or not at all (null for binary files)."""
    language = unified_language(path)
    return F.when(is_binary(path), F.lit(None).cast("string")).when(language.isin(list(GRAMMARS)), "tree-sitter").when(language.isin(list(SPLITTERS)), "langchain").otherwise("generic")


def capabilities(spark: SparkSession) -> DataFrame:
    """(language, method, extensions) of every language, those with a grammar first."""
    rows = [(k, v, "tree-sitter", [f".{e}" for e in exts]) for k, (v, exts) in enumerate(GRAMMARS.items())]
    rows += [(len(rows) + k, v, "langchain", [f".{e}" for e in exts]) for k, (v, exts) in enumerate((v, e) for v, e in FALLBACK.items() if v not in GRAMMARS)]
    return spark.createDataFrame(rows, "place int, language string, method string, extensions array<string>").orderBy("place").drop("place")
