"""Passages of held-out items inside a corpus.

Seeds are the rarest word 5-grams of the items by their count in the whole corpus: every window
of ``min_run`` words of an item keeps its rarest one, so no run of that length can be missed.
For edited copies every gram is a seed. Seeds join corpus and items; a Smith-Waterman alignment of the two word lists scores each pair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import ensure_checkpoint_dir

GRAM = 5
MIN_RUN = 12
BROADCAST_GRAMS = 2_000_000  # item grams up to which the items are broadcast (about 50 MB)
BROADCAST_DOCS = 2_000_000  # candidate documents up to which their ids are broadcast (about 50 MB), so that other texts do not move
CELLS = 1 << 17  # cells of one row of a batch of alignments
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC and lower-casing."""
    return _WORD.findall(unicodedata.normalize("NFKC", text or "").lower())


_CODES: dict[str, int] = {}  # hashes of words seen by this worker


def gram_hashes(text: str | None, n: int = GRAM) -> np.ndarray:
    """64-bit hashes of the word n-grams of a text, in order; none for a shorter text."""
    import xxhash

    if len(_CODES) > 1_000_000:
        _CODES.clear()
    found = words(text)
    if len(found) < n:
        return np.zeros(0, np.int64)
    code = np.array([_CODES.get(w) or _CODES.setdefault(w, xxhash.xxh64_intdigest(w)) for w in found], np.uint64)
    h = np.zeros(len(code) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ code[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def grams(texts: pd.Series) -> pd.Series:
    return texts.map(gram_hashes, na_action="ignore")


def align(a: list[str], b: list[str], match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int, int]:
    """Smith-Waterman over words: (score, end in a, end in b, longest common run)."""
    codes: dict[str, int] = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in a], np.int64)
    y = np.array([codes.setdefault(w, len(codes)) for w in b], np.int64)
    if not len(x) or not len(y):
        return 0, 0, 0, 0
    slope = np.arange(1, len(y) + 1) * -gap
    row, run = np.zeros(len(y) + 1, np.int64), np.zeros(len(y) + 1, np.int64)
    best, at_a, at_b, longest = 0, 0, 0, 0
    for i, w in enumerate(x):
        same = y == w
        run[1:] = np.where(same, run[:-1] + 1, 0)
        longest = max(longest, int(run.max()))
        cell = np.maximum(np.maximum(row[:-1] + np.where(same, match, mismatch), row[1:] + gap), 0)
        cell = np.maximum.accumulate(cell + slope) - slope  # gaps along the row
        row = np.concatenate([[0], cell])
        top = int(cell.argmax())
        if cell[top] > best:
            best, at_a, at_b = int(cell[top]), i + 1, top + 1
    return best, at_a, at_b, longest


def align_many(x: np.ndarray, others: list[np.ndarray], match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """(score, longest common run) of the Smith-Waterman alignment of one word list with each of many.

    The lists are padded to the longest of a batch and filled row by row, all of a batch at once.
    """
    score, longest = np.zeros(len(others), np.int64), np.zeros(len(others), np.int64)
    order = sorted(range(len(others)), key=lambda k: len(others[k]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(others[order[stop]]) <= CELLS:
            stop += 1
        part = order[at:stop]
        at, n = stop, len(others[order[stop - 1]])
        if not n or not len(x):
            continue
        kind = np.int16 if max(2 * match * len(x), n * -gap + match * len(x)) < 32_000 else np.int32
        y = np.full((len(part), n), -1, x.dtype)
        for r, k in enumerate(part):
            y[r, : len(others[k])] = others[k]
        slope = (np.arange(1, n + 1) * -gap).astype(kind)
        row, run = np.zeros((len(part), n + 1), kind), np.zeros((len(part), n + 1), kind)
        best, most = np.zeros(len(part), kind), np.zeros(len(part), kind)
        for w in x:
            same = y == w
            run[:, 1:] = (run[:, :-1] + kind(1)) * same
            np.maximum(most, run.max(axis=1), out=most)
            cell = np.maximum(row[:, :-1] + np.where(same, kind(match), kind(mismatch)), row[:, 1:] + kind(gap))
            np.maximum(cell, kind(0), out=cell)
            cell += slope
            np.maximum.accumulate(cell, axis=1, out=cell)  # gaps along the row
            row[:, 1:] = cell - slope
            np.maximum(best, row.max(axis=1), out=best)
        score[part], longest[part] = best, most
    return score, longest


def leaks(documents: DataFrame, items: DataFrame, min_run: int = MIN_RUN, every: bool = False, min_share: float = 0.0) -> DataFrame:
    """(item_id, doc_id, score, share, longest_run) of every document that shares a rare seed with an item.

    Every pair with a common run of ``min_run`` or more words is among the rows. ``score`` is the
    alignment's score, ``share`` what it is of the item's perfect score. Null ids or texts and
    items below ``min_run`` words give nothing; repeated rows count once. With ``every``, each
    5-gram of an item that the corpus has is a seed, so that edited passages without a common run of
    ``min_run`` words are aligned as well. Pairs whose common words, in whatever order, can make up neither
    ``min_share`` nor a run of ``min_run`` are not aligned and give no row.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    span = min_run - GRAM + 1
    if span < 1:
        raise ValueError(f"min_run is at least {GRAM}")
    its = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.col("text").alias("item")).distinct()
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    item_grams = its.select("item_id", F.posexplode(grams("item")).alias("pos", "gram")).checkpoint()
    small = item_grams.count() <= BROADCAST_GRAMS
    hint = F.broadcast if small else (lambda x: x)
    known = item_grams.select("gram").distinct()
    doc_grams = docs.select("doc_id", F.explode(grams("text")).alias("gram"))
    # only grams that an item has leave the scan; copies of a text are counted like others
    hits = doc_grams.join(hint(known), "gram", "left_semi").groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    if every:
        long = item_grams.groupBy("item_id").agg(F.max("pos").alias("last")).where(F.col("last") + 1 >= span).select("item_id")
        seeds = item_grams.join(long, "item_id", "left_semi").select("item_id", "gram").distinct()
    else:
        frequency = hits.groupBy("gram").agg(F.sum("n").alias("df"))
        window = W.partitionBy("item_id").orderBy("pos")
        ranked = item_grams.join(frequency, "gram", "left").select("item_id", "pos", "gram", F.coalesce("df", F.lit(0)).alias("df"))
        # the rarest gram of each window of min_run words; a window with a gram that the corpus lacks occurs nowhere
        rare = ranked.select("item_id", F.min(F.struct("df", "pos", "gram")).over(window.rowsBetween(0, span - 1)).alias("r"), "pos", F.max("pos").over(W.partitionBy("item_id")).alias("last"))
        seeds = rare.where((F.col("pos") + span - 1 <= F.col("last")) & (F.col("r.df") > 0)).select("item_id", F.col("r.gram").alias("gram")).distinct()
    candidates = hits.join(hint(seeds), "gram").select("doc_id", "item_id").distinct().checkpoint()
    ids = candidates.select("doc_id").distinct().checkpoint()
    # texts of other documents stay where they are as long as the candidates' ids are few
    near = F.broadcast if ids.count() <= BROADCAST_DOCS else (lambda x: x)
    texts = docs.join(near(ids), "doc_id", "left_semi").join(candidates, "doc_id").join(hint(its), "item_id").select("item_id", "doc_id", "item", "text")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes: dict[str, int] = {}
            encoded: dict[str, np.ndarray] = {}

            def encode(text: str) -> np.ndarray:
                if text not in encoded:
                    encoded[text] = np.array([codes.setdefault(w, len(codes)) for w in words(text)], np.int32)
                return encoded[text]

            rows = []
            for (item, text), part in pdf.groupby(["item_id", "item"], sort=False):
                x = encode(text)
                uses = np.bincount(x)
                others, ids = [], []
                for doc, other in zip(part["doc_id"], part["text"], strict=True):
                    y = encode(other)
                    common = int(np.minimum(uses, np.bincount(y[y < len(uses)], minlength=len(uses))).sum())
                    if common >= min_run or common >= min_share * len(x):
                        others.append(y)
                        ids.append(doc)
                s, run = align_many(x, others)
                rows.append(pd.DataFrame({"item_id": np.full(len(ids), item, np.int64), "doc_id": np.array(ids, np.int64), "score": s.astype(np.int32), "share": s / (2 * max(1, len(x))), "longest_run": run.astype(np.int32)}))
            yield pd.concat(rows)

    return texts.mapInPandas(score, "item_id long, doc_id long, score int, share double, longest_run int").dropDuplicates(["item_id", "doc_id"])


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents with at least 12 consecutive words of the item."""
    return leaks(documents, items).where(F.col("longest_run") >= MIN_RUN).select("item_id", "doc_id")


def leaked_documents(documents: DataFrame, items: DataFrame, min_run: int = 8, min_share: float = 0.3) -> DataFrame:
    """(doc_id, n_items, items, best_share, longest_run): each document with leaked or edited passages and the items."""
    rows = leaks(documents, items, min_run, every=True, min_share=min_share).where((F.col("longest_run") >= MIN_RUN) | (F.col("share") >= min_share))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"), F.max("share").alias("best_share"), F.max("longest_run").alias("longest_run"))
