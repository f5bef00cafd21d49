"""What the operators of this subpackage share."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import clean_path, clean_text
from .lexer import EXTENSIONS


def language_expr(language: Column, filepath: Column) -> Column:
    """The language in lower case, that of the extension where it is null or blank."""
    name = F.lower(F.regexp_extract(F.translate(filepath, "\\", "/"), r"([^/]*)$", 1))
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in EXTENSIONS.items()))
    by_name = F.when(name.rlike(r"^dockerfile|\.dockerfile$"), "dockerfile").when(name.rlike(r"^\.env(\.|$)"), "env").otherwise(F.try_element_at(known, F.regexp_extract(name, r"\.([^.]+)$", 1)))
    return F.coalesce(F.nullif(F.lower(F.trim(language)), F.lit("")), by_name)


def current_files(parse_results: DataFrame) -> DataFrame:
    """One row per file: (filepath, repo, language, content, parsed_at) of its latest parse.

    Paths are normalised and line ends are line feeds. Rows without a path or content are left
    out; of rows with the same ``parsed_at`` the greater content counts. ``max`` over a struct
    pre-aggregates before the shuffle, so a file with very many rows loads no single task.
    """
    repo = F.col("repo")
    rows = parse_results.where("filepath IS NOT NULL AND content IS NOT NULL").select(
        clean_path(F.col("filepath")).alias("filepath"),
        F.struct("parsed_at", "content", "language", repo.alias("repo")).alias("row"),
    )
    latest = rows.groupBy("filepath").agg(F.max("row").alias("row"))
    return latest.select(
        "filepath",
        F.coalesce("row.repo", F.regexp_extract("filepath", r"^([^/]+)/", 1)).alias("repo"),
        language_expr(F.col("row.language"), F.col("filepath")).alias("language"),
        clean_text(F.col("row.content")).alias("content"),
        F.col("row.parsed_at").alias("parsed_at"),
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even partitions before costly Python work; by ``keys``, or round robin over all cores."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys) if keys else df.repartition(n)
