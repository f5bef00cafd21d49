"""A mix of sources at target weights, each document used no more often than its source's cap.

A low-discrepancy schedule fills slots of equal token size: the golden-ratio points frac(i * phi)
go through the cumulative weights to sources, the slots of a source are ranked, and slot r of a
source takes its r-th block of shuffled documents, beginning again after the last block. A source
whose slots outnumber those that its allowed passes can fill cannot reach its share.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import ensure_checkpoint_dir

PHI = 0.6180339887498949
SLOT = 128  # tokens of a slot, about a short document: shares are met to about a slot's share of the mix
BUCKET_TOKENS = 1 << 22  # tokens that a shuffle bucket of a source should hold, so that no task holds a source, however large


def source_key(source: Column) -> Column:
    """Sources compare trimmed and in lower case."""
    return F.lower(F.trim(F.regexp_replace(source, r"[\s ]+", " ")))


def bytes4(text: Column) -> Column:
    """Size estimate in tokens: a quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("long")


def tokenizer_size(spark: SparkSession, path: str):
    """A size function that counts the tokens of the public byte-level tokenizer file (.json) at ``path``.

    The file goes to the executors once, by the driver's own file server.
    """
    name = os.path.basename(path)
    spark.sparkContext.addFile(path)

    @F.pandas_udf(T.LongType())
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(SparkFiles.get(name))
        t.encode_special_tokens = True
        for texts in batches:
            yield pd.Series([len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)], dtype="int64")

    return size


def targets(mix_targets: DataFrame) -> DataFrame:
    """(source, weight, cap): usable rows; a null cap means once, a repeated source the greatest weight and cap."""
    rows = mix_targets.where("source IS NOT NULL AND weight > 0").select(source_key(F.col("source")).alias("source"), "weight", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap"))
    return rows.groupBy("source").agg(F.max("weight").alias("weight"), F.max("cap").alias("cap"))


def sized(documents: DataFrame, size=bytes4) -> DataFrame:
    """(doc_id, source, tokens): each document once; rows with a null in any of its three columns have no size and no part.

    Of repeated ids the row of the greatest (source, tokens) counts, here and so in every result.
    """
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL").select("doc_id", source_key(F.col("source")).alias("source"), size(F.col("text")).alias("tokens"))
    return docs.groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("r")).select("doc_id", "r.source", "r.tokens")


def _shares(docs: DataFrame, mix_targets: DataFrame) -> DataFrame:
    have = docs.groupBy("source").agg(F.sum("tokens").alias("available"))
    every = W.partitionBy(F.lit(1))  # one row a target source
    return (
        targets(mix_targets)
        .join(have, "source", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("total", F.sum("available").over(every))
        .withColumn("share", F.col("weight") / F.sum("weight").over(every))
        .withColumn("target_tokens", F.col("share") * F.col("total"))
        .withColumn("feasible", F.col("available") * F.col("cap") >= F.col("target_tokens"))
        .select("source", "weight", "cap", "share", "available", "target_tokens", "total", "feasible")
    )


def shares(documents: DataFrame, mix_targets: DataFrame, size=bytes4) -> DataFrame:
    """(source, weight, cap, share, available, target_tokens, total, feasible) of every target source; a source without documents has 0 available.

    ``total`` is the size of all documents of target sources, each counted once; a source is
    feasible when available x cap reaches its share of it.
    """
    return _shares(sized(documents, size), mix_targets)


class Plan(NamedTuple):
    """What a schedule needs to know of each source: one row a target source, however many documents."""

    rows: list
    slots: int  # of the whole mix
    slot_tokens: int

    def point_source(self, point: Column) -> Column:
        """The source in whose interval of the cumulative weights a point lies."""
        high, edges = 0.0, []
        for r in self.rows:
            high += r["share"]
            edges.append((r["source"], high))
        pick = F.lit(edges[-1][0] if edges else None).cast("string")
        for name, edge in reversed(edges[:-1]):
            pick = F.when(point < edge, name).otherwise(pick)
        return pick


def planned(docs: DataFrame, mix_targets: DataFrame, slot_tokens: int = SLOT) -> Plan:
    rows = _shares(docs, mix_targets).orderBy("source").collect()  # one row a target source
    total = rows[0]["total"] if rows else 0
    return Plan(rows, math.ceil(total / slot_tokens) if total else 0, slot_tokens)


def schedule(spark: SparkSession, plan: Plan) -> DataFrame:
    """(slot, source): point frac(slot x golden ratio) of every slot through the cumulative weights."""
    n = plan.slots
    slots = spark.range(n, numPartitions=max(1, min(4096, n // 1_000_000 + 1))).withColumnRenamed("id", "slot")
    point = F.col("slot") * F.lit(PHI) - F.floor(F.col("slot") * F.lit(PHI))
    return slots.select("slot", plan.point_source(point).alias("source"))


def unreachable(documents: DataFrame, mix_targets: DataFrame, slot_tokens: int = SLOT) -> DataFrame:
    """(source) of the targets whose documents, used as often as allowed, stay below their share.

    The schedule asks each source for slots; one that is asked for about as many as its passes fill, or
    for more, or for none, is a candidate, and its tokens decide.
    """
    spark = documents.sparkSession
    plan = planned(sized(documents), mix_targets, slot_tokens)
    facts = spark.createDataFrame([(r["source"], r["available"] * r["cap"], r["target_tokens"], r["available"] * r["cap"] / plan.slot_tokens) for r in plan.rows], "source string, supply long, target_tokens double, fills double")
    asked = schedule(spark, plan).groupBy("source").agg(F.count(F.lit(1)).alias("asked"))
    slack = 2 + math.ceil(2 * math.log2(plan.slots + 2))  # by which golden-ratio points can miss a share, in slots
    near = facts.join(asked, "source", "left").where(F.col("asked").isNull() | (F.col("asked") + slack >= F.col("fills")))
    return near.where(F.col("supply") < F.col("target_tokens")).select("source")


def mix(documents: DataFrame, mix_targets: DataFrame, size=bytes4, slot_tokens: int = SLOT, seed: int = 17) -> DataFrame:
    """(slot, source, doc_id, pass, position, tokens): the mix in reading order (slot, position).

    A source gets its share of the slots to within the discrepancy of golden-ratio points (a few slots,
    growing with the logarithm of their number); one that runs out of allowed passes fills only those
    it can. A document belongs to the block in which it begins, so a run of blocks is as long as its slots
    to within a document. The order depends on ``seed`` and the ids only. Empty documents have no size and
    no place.
    """
    return _mixed(_written(documents, size), mix_targets, slot_tokens, seed)


def _written(documents: DataFrame, size) -> DataFrame:
    """Ids, sources and sizes, written once: several uses of one pass over the texts."""
    ensure_checkpoint_dir(documents.sparkSession)
    return sized(documents, size).checkpoint()


def _mixed(every: DataFrame, mix_targets: DataFrame, slot_tokens: int, seed: int = 17) -> DataFrame:
    """``mix`` of documents whose sizes are known."""
    spark, caps = every.sparkSession, targets(mix_targets)
    plan = planned(every, mix_targets, slot_tokens)
    slots = schedule(spark, plan).withColumn("part", F.floor(F.col("slot") / F.lit(65536)))
    # the rank of a slot within its source in two steps, so that no task holds all slots
    before = slots.groupBy("source", "part").count().withColumn("before", F.sum("count").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    ranked = slots.join(before.drop("count"), ["source", "part"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.row_number().over(W.partitionBy("source", "part").orderBy("slot")) - 1).select("slot", "source", "rank")
    # blocks: token prefix sums over the shuffled documents, again in two steps; the buckets grow in number with the source
    sizes = {r["source"]: max(1, math.ceil(r["available"] / BUCKET_TOKENS)) for r in plan.rows}
    buckets = F.lit(1)
    for name, n in sizes.items():
        buckets = F.when(F.col("source") == name, n).otherwise(buckets)
    docs = every.where("tokens > 0").join(F.broadcast(caps), "source").withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1))
    # equal ranges of the hash, so that the order of the buckets is the order of the hash
    docs = docs.withColumn("bucket", F.floor(F.shiftrightunsigned("h", 31) * buckets.cast("long") / F.lit(2**32)).cast("long"))
    sums = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).withColumn("offset", F.coalesce(F.sum("t").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    order = W.partitionBy("source", "bucket").orderBy("h", "doc_id")
    placed = (
        docs.join(sums.drop("t"), ["source", "bucket"])
        .withColumn("start", F.col("offset") + F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("source", "doc_id", "tokens", "cap", "start", F.floor(F.col("start") / slot_tokens).alias("block"))
    )
    counts = sums.groupBy("source").agg(F.sum("t").alias("all")).select("source", F.ceil(F.col("all") / slot_tokens).alias("blocks"))
    used = ranked.join(F.broadcast(counts), "source").withColumn("pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks")).select("slot", "source", "pass", "block")
    out = used.join(placed, ["source", "block"]).where(F.col("pass") < F.col("cap"))
    # the place within a slot is the token offset within the block; it orders the documents of a slot
    return out.select("slot", "source", "doc_id", F.col("pass").cast("int").alias("pass"), (F.col("start") - F.col("block") * slot_tokens).cast("int").alias("position"), "tokens")


def report(documents: DataFrame, mix_targets: DataFrame, size=bytes4, slot_tokens: int = SLOT) -> DataFrame:
    """(source, target_share, actual_share, reached, tokens, documents, most_uses, feasible): the shares that the mix reaches.

    ``actual_share`` is of the mix, which falls short of the total by what the unfeasible sources
    lack; ``reached`` is the part of its own target that a source fills.
    """
    docs = _written(documents, size)
    used = _mixed(docs, mix_targets, slot_tokens)
    per_doc = used.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"))
    got = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    every = W.partitionBy(F.lit(1))  # one row a target source
    return (
        _shares(docs, mix_targets)
        .join(got, "source", "left")
        .na.fill(0, ["tokens", "documents", "most_uses"])
        .select("source", F.col("share").alias("target_share"), (F.col("tokens") / F.sum("tokens").over(every)).alias("actual_share"), (F.col("tokens") / F.col("target_tokens")).alias("reached"), "tokens", "documents", "most_uses", "feasible")
    )
