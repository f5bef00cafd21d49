"""Queries of this subpackage: name -> function of (session, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import read
from . import credentials, documented, handwritten, leaks, mixture, sentences, similar, splitting, validity

Query = Callable[[SparkSession, str], DataFrame]


def _on(operator, *names: str) -> Query:
    return lambda spark, sf_dir: operator(*(read(spark, sf_dir, n) for n in names))


def _sentence_counts(documents: DataFrame) -> DataFrame:
    rows = sentences.sentences(documents, with_text=False)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.col("end_char") - F.col("start_char")).alias("longest"))


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"  # of the driver; its file server ships it


def _in_tokens(operator) -> Query:
    return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"), mixture.tokenizer_size(spark, TOKENIZER))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on(similar.pairs, "code_chunks"),
        "p1_neighbours": _on(similar.query_neighbours, "code_chunks"),
        "p1_every": _on(similar.neighbours, "code_chunks"),
        "p2_found": _on(lambda df: credentials.locate(df).select("id", "line").distinct(), "code_chunks"),
        "p2_redacted": _on(credentials.redacted, "code_chunks"),
        "p3_found": _on(splitting.natural_cuts, "code_chunks", "parse_options"),
        "p3_pieces": _on(splitting.split, "code_chunks", "parse_options"),
        "p4_found": _on(documented.found, "parse_results"),
        "p4_pairs": _on(documented.pairs, "parse_results"),
        "p5_found": _on(handwritten.not_handwritten, "parse_results"),
        "p5_files": _on(handwritten.classified, "parse_results"),
        "p6_found": _on(validity.invalid, "parse_results"),
        "p6_rates": _on(validity.rates, "parse_results"),
        "p7_found": _on(leaks.found, "documents", "eval_items"),
        "p7_documents": _on(leaks.leaked_documents, "documents", "eval_items"),
        "p8_found": _on(mixture.unreachable, "documents", "mix_targets"),
        "p8_shares": _on(mixture.shares, "documents", "mix_targets"),
        "p8_report": _on(mixture.report, "documents", "mix_targets"),
        "p8_mix": _on(mixture.mix, "documents", "mix_targets"),
        "p8_token_report": _in_tokens(mixture.report),
        "p9_found": _on(lambda df: sentences.sentences(df, with_text=False).select("doc_id", "end_char").distinct(), "documents"),
        "p9_counts": _on(_sentence_counts, "documents"),
    }


_SHARES = """
WITH d AS (
  SELECT doc_id, max(lower(trim(regexp_replace(source, '\\s+', ' ', 'g')))) AS source, max(CAST(ceil(strlen(text) / 4.0) AS BIGINT)) AS tokens
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL GROUP BY doc_id),
t AS (
  SELECT lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS source, max(weight) AS weight, max(greatest(coalesce(max_repeats, 1), 0)) AS cap
  FROM mix_targets WHERE source IS NOT NULL AND weight > 0 GROUP BY 1),
h AS (SELECT source, sum(tokens)::BIGINT AS available FROM d GROUP BY source),
j AS (SELECT t.source, weight, cap, coalesce(available, 0) AS available FROM t LEFT JOIN h USING (source)),
k AS (SELECT *, (sum(available) OVER ())::BIGINT AS total, weight / sum(weight) OVER () AS share FROM j)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": _SHARES + "SELECT source FROM k WHERE available * cap < share * total",
        "p8_shares": _SHARES + "SELECT source, weight, cap, share, available, share * total AS target_tokens, total, available * cap >= share * total AS feasible FROM k",
    }
