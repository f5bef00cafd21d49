"""Source files that do not parse.

Each file is parsed by its own language's grammar; one that fails is parsed by all the others, in
the order of a token-based ranking. A foreign grammar that accepts it shows a wrong extension;
none, that the text is corrupt.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import current_files, spread
from .grammar import valid
from .lexer import CODE_LANGUAGES

SCOPE = (*CODE_LANGUAGES, "json")
# Words and signs that speak for a language.
MARKS = {
    "python": "def elif self None True False import from lambda except raise with pass",
    "javascript": "const let var function => require module exports === undefined typeof async await",
    "typescript": "const let interface type readonly string number boolean void unknown private public implements => import",
    "java": "public private final class package import static void new throws extends String @Override",
    "go": "func package := chan defer go range nil err struct map import type",
    "csharp": "using namespace public private internal static void string var foreach class get set",
    "rust": "fn let mut impl pub struct match use crate :: -> &self Some None",
    "php": "<?php function echo => -> $this foreach array namespace use public",
    "ruby": "def end do elsif unless require module attr_accessor nil puts each",
    "json": "{ } [ ] : , true false null",
}
_WORD = re.compile(r"<\?php|\$this|@\w+|&self|=>|->|:=|::|===|[A-Za-z_]\w*|[{}\[\]:,]")


def ranking(text: str) -> list[str]:
    """Languages by how much of the text's words and signs they share, best first."""
    seen = Counter(_WORD.findall(text))
    score = {lang: sum(min(seen[w], 20) for w in words.split()) / len(words.split()) for lang, words in MARKS.items()}
    return sorted(score, key=lambda x: (-score[x], x))


# Grammars that accept much that is neither: a foreign parse by one of these counts only if the text looks more like it than like its own language.
_LENIENT = ("ruby", "json")


def verdict(text: str, language: str) -> tuple[bool, str | None]:
    """(valid in its language, language whose grammar accepts it instead or None).

    A text that its own grammar accepts is settled; one that fails meets every other grammar, best rank first.
    """
    if valid(text, language):
        return True, None
    if not text.strip():
        return False, None
    own = False
    for other in ranking(text):
        if other == language:
            own = True
        elif not (own and other in _LENIENT) and valid(text, other):
            return False, other
    return False, None


def judged(parse_results: DataFrame) -> DataFrame:
    """(filepath, repo, language, valid, parses_as, cause) of the current content of each file in scope.

    ``cause`` is null, ``wrong extension`` or ``corrupt``. Files without path, content or known
    language, and languages out of scope, give no row.
    """
    files = current_files(parse_results).where(F.col("language").isin(*SCOPE))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [verdict(text, lang) for text, lang in zip(pdf["content"], pdf["language"], strict=True)]
            own = {c: pdf[c].to_list() for c in ("filepath", "repo", "language")}
            cause = [None if ok else "wrong extension" if other else "corrupt" for ok, other in got]
            yield pd.DataFrame({**own, "valid": [g[0] for g in got], "parses_as": [g[1] for g in got], "cause": cause})

    return spread(files.select("filepath", "repo", "language", "content"), "filepath").mapInPandas(run, "filepath string, repo string, language string, valid boolean, parses_as string, cause string")


def invalid(parse_results: DataFrame) -> DataFrame:
    """(filepath) of the files that are not valid in their language."""
    return judged(parse_results).where(~F.col("valid")).select("filepath")


def rates(parse_results: DataFrame) -> DataFrame:
    """(repo, language, files, invalid_files, wrong_extension, corrupt, rate) of every repository and language."""
    return (
        judged(parse_results)
        .groupBy("repo", "language")
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("invalid_files"), F.count_if(F.col("cause") == "wrong extension").alias("wrong_extension"), F.count_if(F.col("cause") == "corrupt").alias("corrupt"))
        .withColumn("rate", F.col("invalid_files") / F.col("files"))
    )
