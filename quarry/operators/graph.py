"""Graph operators over an edge table (src, dst). Loops run on the driver, one distributed step a round; lineage is cut with checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..tables import ensure_checkpoint_dir


def closure(edges: DataFrame, start: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(node, distance): everything within ``depth`` edges of the start nodes, the start at 0. Cycles end by themselves."""
    ensure_checkpoint_dir(edges.sparkSession)
    if reverse:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = edges.select("src", "dst").distinct()
    seen = start.select("node").distinct().withColumn("distance", F.lit(0))
    frontier = seen
    for step in range(1, depth + 1):
        reached = Observation()
        step_ = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(step))
        nxt = step_.observe(reached, F.count(F.lit(1)).alias("n")).checkpoint()
        if not reached.get["n"]:
            break
        seen = seen.unionByName(nxt)
        if step % 8 == 0:
            seen = seen.checkpoint()
        frontier = nxt
    return seen


def impact(edges: DataFrame, changed: DataFrame, depth: int = 50) -> DataFrame:
    """(node, direct): what depends on the changed nodes; the transitive set includes the direct one and leaves out the changed."""
    near = closure(edges, changed, depth, reverse=True)
    return near.join(changed.select("node"), "node", "left_anti").select("node", (F.col("distance") == 1).alias("direct"))


def blast_radius(edges: DataFrame, focus: DataFrame, max_path: int) -> DataFrame:
    """(node, distance, kind): reverse neighbourhood of the focus nodes to depth max_path + 1, depth 1 as direct."""
    near = closure(edges, focus, max_path + 1, reverse=True).where("distance > 0")
    return near.withColumn("kind", F.when(F.col("distance") == 1, "direct").otherwise("transitive"))


def shortest_path(edges: DataFrame, source, target, max_length: int, direction: str = "forward") -> DataFrame:
    """(path, length) of a shortest path of at most ``max_length`` edges, the least by node order among the shortest; no row if there is none.

    ``direction`` follows the edges forward, in reverse, or both ways. Each round keeps one least path a node,
    so a round's size is bounded by the number of nodes.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = {"forward": edges.select("src", "dst"), "reverse": back, "both": edges.select("src", "dst").unionByName(back)}
    edges = ways[direction].distinct()
    seen = spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.array(F.lit(source).cast(kind)).alias("path"))
    frontier = seen
    for k in range(max_length):
        goal = frontier.where(F.col("node") == target)
        if not goal.isEmpty():
            return goal.select("path", (F.size("path") - 1).alias("length"))
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        frontier = step.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.select("node").unionByName(frontier.select("node"))
        if k % 8 == 7:
            seen = seen.checkpoint()
    return frontier.where(F.col("node") == target).select("path", (F.size("path") - 1).alias("length"))


ROUNDS = 5  # rounds of a ranking between two writes


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int = 30, tolerance: float = 1e-6, damping: float = 0.85) -> DataFrame:
    """(node, rank): personalised by ``focus`` >= 0 of the nodes, without redistribution of dangling mass.

    Stops once the L1 change of a round falls below ``tolerance``. ROUNDS rounds are one job, whose last change
    is observed as it is written; the rounds run beyond the first small change move the ranks by less than that.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    stats = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("focus") > 0, F.col("focus")).otherwise(1.0)).alias("f")).first()
    n = stats["n"]
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    total = max((stats["f"] or 0.0) + n, 1.0)
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    # both are joined by their key in every round: written once, in partitions by it
    weighted = edges.join(out, "src").select("src", "dst", (F.lit(1.0) / F.col("out")).alias("w")).checkpoint()
    rank = nodes.select("node", ((F.col("focus") + 1) / total).alias("p"), F.lit(1.0 / n).alias("rank")).checkpoint()
    for i in range(1, iterations + 1):
        inflow = weighted.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("w")).alias("s"))
        new = ((1 - damping) * F.col("p") + damping * F.coalesce("s", F.lit(0.0))).alias("rank")
        step = rank.join(inflow, "node", "left")
        if i % ROUNDS and i < iterations:
            rank = step.select("node", "p", new)
            continue
        seen = Observation()
        rank = step.select("node", "p", new, F.abs(new - F.col("rank")).alias("moved")).observe(seen, F.sum("moved").alias("change")).select("node", "p", "rank").checkpoint()
        change = seen.get["change"]
        if change is not None and change < tolerance:
            break
    return rank.select("node", "rank")


def cycles(edges: DataFrame, length: int) -> DataFrame:
    """(cycle): each simple cycle of exactly ``length`` nodes once, beginning with its least node.

    Paths grow from their least node only, through nodes that lie on some cycle candidate (in and out degree).
    """
    edges = edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    core = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    paths = core.where(F.col("dst") > F.col("src")).select(F.array("src", "dst").alias("cycle"), F.col("dst").alias("end"), F.col("src").alias("first"))
    for _ in range(length - 2):
        step = core.withColumnRenamed("src", "end").withColumnRenamed("dst", "nxt")
        paths = paths.join(step, "end").where((F.col("nxt") > F.col("first")) & ~F.array_contains("cycle", F.col("nxt"))).select(F.concat("cycle", F.array("nxt")).alias("cycle"), F.col("nxt").alias("end"), "first")
    back = core.select(F.col("src").alias("end"), F.col("dst").alias("first"))
    return paths.join(back, ["end", "first"]).select("cycle")


def all_cycles(edges: DataFrame, most: int = 50, longest: int = 50) -> DataFrame:
    """(cycle): the first ``most`` simple cycles of at most ``longest`` nodes by length and nodes, each set of nodes once.

    Nodes that lie on no cycle are stripped first; lengths are tried until enough are found.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    core = edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct().checkpoint()
    n = core.count()
    while n:
        core = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").checkpoint()
        n, last = core.count(), n
        if n == last:
            break
    found, have = None, 0
    for length in range(2, longest + 1):
        if not n or have >= most or not length <= n:
            break
        some = cycles(core, length).groupBy(F.array_sort("cycle").alias("nodes")).agg(F.min("cycle").alias("cycle")).orderBy("cycle").limit(most - have).checkpoint()
        have += some.count()
        found = some if found is None else found.unionByName(some)
        if length >= core.select("src").distinct().count():
            break
    empty = edges.limit(0).select(F.array("src").alias("cycle"))
    return empty if found is None else found.select("cycle")


def call_edges(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(caller, callee): one row per call site and function of the called name; repeats are kept."""
    return calls.join(nodes.select("name", F.col("node").alias("callee")), "name").select("caller", "callee")


def call_context(edges: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """(node, callers, callees): sorted distinct neighbours, at most ``limit`` of each."""

    def side(key: str, other: str, name: str) -> DataFrame:
        from pyspark.sql import Window as W

        ranked = edges.select(F.col(key).alias("node"), F.col(other).alias("x")).distinct().withColumn("rn", F.row_number().over(W.partitionBy("node").orderBy("x"))).where(F.col("rn") <= limit)
        return ranked.groupBy("node").agg(F.sort_array(F.collect_list("x")).alias(name))

    return nodes.select("node").join(side("dst", "src", "callers"), "node", "left").join(side("src", "dst", "callees"), "node", "left")
