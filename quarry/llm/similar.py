"""The k most similar vectors of every vector, by multiprobe p-stable hashing with exact reranking.

Each table hashes a unit vector x to the cell floor((a_i.x + b_i) / w) of m Gaussian projections.
A vector is indexed in its own cell and asks, besides that cell, the neighbouring cells in the
order of the estimated chance that they hold a close vector (squared distances to the cell walls).
Candidates of a cell are ranked by their exact cosine at once, so only the best leave a cell.

Scale: vectors of one direction are one class before hashing, so a group of copies, scaled or not,
costs one row; m grows with the logarithm of the collection up to MOST, so cells keep their size, and
the tables and probes with m, so recall keeps too. Cells are counted with those that ask them: an ask
of an empty cell goes nowhere, and a cell whose vectors or askers exceed ``cell_cap``, by whatever
factor, is cut into a grid of blocks that compares all of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import ensure_checkpoint_dir

DIM = 64
TABLES, PROBES, WIDTH = 3, 2, 1.5
MOST = 12  # projections of a table; beyond it cells grow
# Tables and probes at more than five projections: a pair of cosine 0.9 shares a cell with 0.93 or more.
EFFORT = {6: (4, 2), 7: (5, 2), 8: (8, 2), 9: (10, 2), 10: (12, 2), 11: (10, 6), 12: (10, 6)}
FAR = 0.6  # cosine below which neighbours are asked for whatever their distance: their cells differ more often


def far_effort(m: int) -> tuple[int, int]:
    """Tables and probes for neighbours at any distance: recall 0.97 at m = 2 (15 000 vectors), 0.92 at m = 5 (142 000), not measured beyond."""
    return max(TABLES, m + 1), max(PROBES, 2 * m - 4)


CELL_TARGET = 2000  # vectors that a cell should hold
CELL_CAP = 20_000  # vectors above which a cell is cut
BUNDLE = 5_000  # rows that one call of the ranking function takes, about
TASK_ROWS = 50_000  # rows that one ranking task reads, about (12 MB), however large the collection
BROADCAST_CELLS = 1_000_000  # cells up to which their sizes are broadcast (about 40 MB)
_SCALE = float(2**23 - 1)


def usable(vector: Column, dim: int = DIM) -> Column:
    """Exactly ``dim`` finite values that aren't all zero; null gives false."""
    ok = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def pack(x: np.ndarray) -> np.ndarray:
    """Unit vectors as rows of 24-bit numbers (error below 1e-7), a quarter less to move than floats."""
    q = np.rint(x * _SCALE).astype("<i4")
    return np.ascontiguousarray(q.view(np.uint8).reshape(len(x), -1, 4)[:, :, :3]).reshape(len(x), -1)


def unpack(rows: list[bytes] | pd.Series) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1, 3)
    q = np.zeros((*raw.shape[:2], 4), np.uint8)
    q[:, :, 1:] = raw  # the sign sits in the highest byte
    return (q.view("<i4")[:, :, 0] / (256 * _SCALE)).astype(np.float32)


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(batch.num_rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _binary(rows: np.ndarray) -> pa.Array:
    n, size = rows.shape
    offsets = np.arange(0, (n + 1) * size, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _mix(cells: np.ndarray, table: int) -> np.ndarray:
    """64-bit key of integer cell coordinates."""
    h = np.full(len(cells), 0x9E3779B97F4A7C15 * (table + 1) % 2**64, np.uint64)
    for column in cells.T:
        h ^= column.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) + (h << np.uint64(6)) + (h >> np.uint64(2))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def probe_cells(x: np.ndarray, table: int, m: int, width: float, probes: int, seed: int = 11) -> tuple[np.ndarray, list[np.ndarray]]:
    """Key of each vector's own cell, and the keys of its ``probes`` likeliest neighbour cells."""
    rng = np.random.default_rng([seed, table, m, int(width * 1e6)])
    a, b = rng.standard_normal((x.shape[1], m)), rng.uniform(0, width, m)
    f = (x @ a + b) / width
    cell = np.floor(f).astype(np.int64)
    part = f - cell
    cost = np.concatenate([part**2, (1 - part) ** 2], axis=1)  # a step down, a step up
    near = np.argsort(cost, axis=1)[:, : min(2 * m, 2 * probes + 2)]
    low = np.take_along_axis(cost, near, axis=1)
    sets = [(i,) for i in range(near.shape[1])] + [(i, j) for i in range(near.shape[1]) for j in range(i + 1, near.shape[1])]
    score = np.stack([low[:, list(s)].sum(axis=1) for s in sets], axis=1)
    for k, s in enumerate(sets):  # both steps of one projection contradict each other
        if len(s) == 2:
            score[near[:, s[0]] % m == near[:, s[1]] % m, k] = np.inf
    best = np.argsort(score, axis=1)[:, :probes]
    rows = np.arange(len(x))
    out = []
    for p in range(best.shape[1]):
        moved = cell.copy()
        for k, s in enumerate(sets):
            mask = best[:, p] == k
            if mask.any():
                for i in s:
                    step = near[mask, i]
                    moved[rows[mask], step % m] += np.where(step < m, -1, 1)
        out.append(_mix(moved, table))
    return _mix(cell, table), out


def projections(n: int) -> int:
    """Projections per table, MOST at most, at which a cell holds about CELL_TARGET of ``n`` vectors."""
    return int(np.clip(round(math.log(max(n, 1) / CELL_TARGET) / math.log(2.35)), 1, MOST))


def _hashed(classes: DataFrame, m: int, width: float, tables: int, probes: int, vectors: bool) -> DataFrame:
    """(tbl, cell, own, ask, cid[, v]): each class in its own cell, and those that ask in the cells they ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch)
            ask = batch.column("ask").to_numpy(zero_copy_only=False)
            cid = batch.column("cid")
            packed = _binary(pack(x)) if vectors else None
            asking = pa.array(np.nonzero(ask)[0])
            for t in range(tables):
                own, asked = probe_cells(x, t, m, width, probes)
                for k, key in enumerate([own, *asked]):
                    pick = (lambda a: a) if k == 0 or ask.all() else (lambda a: a.take(asking))
                    columns = [pick(pa.array(np.full(len(x), t, np.int32))), pick(pa.array(key)), pick(pa.array(np.full(len(x), k == 0))), pick(pa.array(ask)), pick(cid)]
                    names = ["tbl", "cell", "own", "ask", "cid"]
                    if vectors:
                        columns.append(pick(packed))
                        names.append("v")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return classes.select("cid", "vector", "ask").mapInArrow(run, "tbl int, cell long, own boolean, ask boolean, cid long" + (", v binary" if vectors else ""))


def _rank(min_cosine: float, keep: int):
    """The ``keep`` nearest indexed classes of each asking class of one block."""

    def block(own: np.ndarray, cid: np.ndarray, side: np.ndarray, x: np.ndarray, out: list) -> None:
        target, query = np.nonzero(own & (side != 2))[0], np.nonzero(side != 1)[0]
        if not len(target) or not len(query):
            return
        y = x[target]
        place = np.full(len(x), -1)
        place[target] = np.arange(len(target))
        for s in range(0, len(query), 512):
            part = query[s : s + 512]
            c = x[part] @ y.T
            home = np.nonzero(place[part] >= 0)[0]
            c[home, place[part[home]]] = -2  # itself
            close = c >= min_cosine - 1e-6
            rows = np.nonzero(close.any(axis=1))[0]
            if not len(rows):
                continue
            close = close[rows]
            much = np.nonzero(np.count_nonzero(close, axis=1) > keep)[0]
            if len(much):  # rows with more than enough keep their best
                top = np.argpartition(-c[rows[much]], keep - 1, axis=1)[:, :keep]
                close[much] = False
                close[much[:, None], top] = True
            r, k = np.nonzero(close)
            a, b = part[rows[r]], target[k]
            exact = np.einsum("ij,ij->i", x[a].astype(np.float64), x[b].astype(np.float64))
            ok = (exact >= min_cosine) & (cid[a] != cid[b])
            if ok.any():
                out.append((cid[a[ok]], cid[b[ok]], exact[ok]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A bundle of whole cells."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        keys = [pdf[c].to_numpy() for c in ("tbl", "cell", "bi", "bq")]
        order = np.lexsort(keys)
        change = np.zeros(len(order), bool)
        for key in keys:
            change[1:] |= key[order[1:]] != key[order[:-1]]
        own, cid, side = (pdf[c].to_numpy()[order] for c in ("own", "cid", "side"))
        bounds = np.concatenate([[0], np.nonzero(change)[0], [len(order)]])
        packed = pdf["v"].to_numpy()[order]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if high - low > 1 and own[low:high].any():
                block(own[low:high], cid[low:high], side[low:high], unpack(list(packed[low:high])), out)
        if not out:
            return pd.DataFrame({"ca": np.zeros(0, np.int64), "cb": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        a, b, s = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"ca": a, "cb": b, "cosine": s})

    return run


def direction(packed: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of ``pack``, so of a vector's direction: its length doesn't count."""
    words = packed.view(np.uint64)
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for column in words.T:
            h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _directed(code_chunks: DataFrame, *columns: str) -> DataFrame:
    """(cid, columns) of the usable rows: the hash of the vector's direction beside columns of the row."""
    rows = code_chunks.where(F.col("id").isNotNull() & usable(F.col("vector"))).select("vector", *(c for c in columns if c != "vector"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cid = pa.array(direction(pack(_unit(batch))))
                yield pa.RecordBatch.from_arrays([cid, *(batch.column(n) for n in batch.schema.names if n in columns)], ["cid", *(n for n in batch.schema.names if n in columns)])

    return rows.mapInArrow(run, f"cid long, {fields}")


def members(code_chunks: DataFrame) -> DataFrame:
    """(id, cid): each usable chunk id once with the class of its vector; of repeated ids the latest row counts."""
    rows = _directed(code_chunks, "id", "indexed_at")
    return rows.groupBy("id").agg(F.max(F.struct("indexed_at", "cid")).alias("r")).select("id", F.col("r.cid").alias("cid"))


def vector_classes(code_chunks: DataFrame) -> DataFrame:
    """(cid, vector): each different direction of the usable vectors once."""
    return _directed(code_chunks, "vector").groupBy("cid").agg(F.first("vector").alias("vector"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with the blocks they take part in: an indexed row meets each block of askers, an asking row each block of the index.

    ``bis`` blocks of the index and ``bqs`` of the askers make the grid of a cell; most cells are one block.
    ``side``: 0 both, 1 indexed only, 2 asking only.
    """
    salt = lambda n: F.pmod(F.xxhash64("cid"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda bi, bq, side: F.struct(bi.alias("bi"), bq.alias("bq"), side.cast("int").alias("side"))
    whole = F.array(place(F.lit(0), F.lit(0), F.when(~F.col("own"), 2).when(F.col("ask"), 0).otherwise(1)))
    asking = F.transform(every("bis"), lambda i: place(i, salt("bqs"), F.lit(2)))
    indexed = F.transform(every("bqs"), lambda i: place(salt("bis"), i, F.lit(1)))
    grid = F.when(F.col("own") & F.col("ask"), F.concat(indexed, asking)).when(F.col("own"), indexed).otherwise(asking)
    places = F.when((F.col("bis") == 1) & (F.col("bqs") == 1), whole).otherwise(grid)
    return rows.select("tbl", "cell", "own", "cid", "v", F.explode(places).alias("p")).select("tbl", "cell", "own", "cid", "v", "p.bi", "p.bq", "p.side")


def cell_sizes(classes: DataFrame, m: int, tables: int, probes: int, cell_cap: int) -> DataFrame:
    """(tbl, cell, bis, bqs): the blocks of every cell that holds a vector and is asked by another, counted before any vector moves."""
    keys = _hashed(classes, m, WIDTH, tables, probes, False)
    sizes = keys.groupBy("tbl", "cell").agg(F.count_if("own").alias("owners"), F.count_if("ask").alias("askers"), F.count(F.lit(1)).alias("n"))
    blocks = lambda x: F.greatest(F.lit(1), F.ceil(F.col(x) / cell_cap)).cast("int")
    return sizes.where("owners > 0 AND askers > 0 AND n > 1").select("tbl", "cell", blocks("owners").alias("bis"), blocks("askers").alias("bqs"))


def class_neighbours(classes: DataFrame, n: int, k: int = 5, min_cosine: float = 0.9, cell_cap: int = CELL_CAP, effort: tuple[int, int] | None = None) -> DataFrame:
    """(ca, cb, cosine): for each class its ``k`` nearest other classes of at least ``min_cosine``; with a column ``ask``, for those where it is true.

    ``n`` is about the number of classes; ``effort`` (tables, probes) replaces that of EFFORT, or of
    ``far_effort`` where the threshold lets far ones in. Of
    classes at exactly the same distance those of the smaller hash count.
    """
    ensure_checkpoint_dir(classes.sparkSession)
    everyone = "ask" not in classes.columns
    if everyone:
        classes = classes.withColumn("ask", F.lit(True))
    m = projections(n)
    tables, probes = effort or (far_effort(m) if min_cosine < FAR else EFFORT.get(m, (TABLES, PROBES)))
    cells = cell_sizes(classes, m, tables, probes, cell_cap).checkpoint()
    hint = F.broadcast if cells.count() <= BROADCAST_CELLS else (lambda x: x)
    cut = _in_blocks(_hashed(classes, m, WIDTH, tables, probes, True).join(hint(cells), ["tbl", "cell"]))
    # whole cells in bundles, since a call for each of very many small cells would cost more than their work
    rows = n * tables * (probes + 1)
    bundles = max(1, rows // BUNDLE)
    tasks = max(classes.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))
    cut = cut.withColumn("bundle", F.pmod(F.xxhash64("tbl", "cell", "bi", "bq"), F.lit(bundles))).repartition(tasks, "bundle")
    found = cut.groupBy("bundle").applyInPandas(_rank(min_cosine, k), "ca long, cb long, cosine double")
    if everyone:  # what one of two classes finds, the other has found too
        found = found.select(F.explode(F.array(F.struct("ca", "cb", "cosine"), F.struct(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "cosine"))).alias("p")).select("p.*")
    merged = found.groupBy("ca", "cb").agg(F.max("cosine").alias("cosine"))
    rank = W.partitionBy("ca").orderBy(F.desc("cosine"), "cb")
    return merged.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).drop("rank")


def neighbours(code_chunks: DataFrame, k: int = 5, min_cosine: float = -1.0, effort: tuple[int, int] | None = None) -> DataFrame:
    """(id, neighbour, cosine, rank): for each usable chunk the ``k`` most similar chunks of at least ``min_cosine``, by default however far.

    Vectors of one direction come first (cosine 1), ties among them go to the smaller id; between
    different directions at exactly the same distance the smaller class hash decides. Ids count once;
    unusable vectors take no part; an empty table gives no row. What the hashing finds of near vectors
    and of far ones differs: the README has the measured recalls, and ``effort`` (tables, probes) raises them.
    """
    return _by_id(members(code_chunks), class_neighbours(vector_classes(code_chunks), code_chunks.count(), k, min_cosine, effort=effort), k)


def _by_id(own: DataFrame, near: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """Neighbours of classes spelt out for chunks (id, cid), or for the ``asked`` ones."""
    by_id = W.partitionBy("cid").orderBy("id")
    heads = own.withColumn("rn", F.row_number().over(by_id)).where(F.col("rn") <= k + 1).groupBy("cid").agg(F.sort_array(F.collect_list("id")).alias("heads"))
    mine = heads.where(F.size("heads") > 1).select("cid", F.transform("heads", lambda x: F.struct(F.lit(-1.0).alias("c"), x.alias("id"))).alias("list"))
    others = near.join(heads.withColumnRenamed("cid", "cb"), "cb").select(F.col("ca").alias("cid"), F.transform("heads", lambda x: F.struct((-F.col("cosine")).alias("c"), x.alias("id"))).alias("list"))
    # at most (k + 1) * (k + 1) entries a class
    lists = mine.unionByName(others).groupBy("cid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("list"))), 1, k + 1).alias("list"))
    whom = own if asked is None else asked
    pairs = whom.join(lists, "cid").select("id", F.posexplode(F.slice(F.filter("list", lambda e: e["id"] != F.col("id")), 1, k)).alias("rank", "e"))
    return pairs.select("id", F.col("e.id").alias("neighbour"), (-F.col("e.c")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def pairs(code_chunks: DataFrame, k: int = 5, min_cosine: float = 0.9) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of at least ``min_cosine`` of which one is among the ``k`` nearest of the other."""
    near = neighbours(code_chunks, k, min_cosine)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


# ------------------------------------------------------------------ a stated query set, answered in full
QUERY_BLOCK = 50_000  # query vectors sent to the executors at once: 12.8 MB


def query_neighbours(code_chunks: DataFrame, k: int = 5, min_cosine: float = 0.9) -> DataFrame:
    """(id, neighbour, cosine, rank): the ``k`` most similar chunks, however far, of every chunk whose id hashes to a multiple of 100.

    Multiprobe hashing answers queries with ``k`` neighbours of at least ``min_cosine``; the rest is
    compared with all vectors, in blocks of at most QUERY_BLOCK queries.
    """
    spark = code_chunks.sparkSession
    ensure_checkpoint_dir(spark)
    own, n = members(code_chunks), code_chunks.count()
    asked = own.where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0).checkpoint()
    classes = vector_classes(code_chunks)
    # only the query set asks; every class is indexed
    ask = asked.select("cid").distinct().withColumn("ask", F.lit(True))
    hint = F.broadcast if n / 100 <= BROADCAST_CELLS else (lambda x: x)
    marked = classes.join(hint(ask), "cid", "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
    near = _by_id(own, class_neighbours(marked, n, k, min_cosine), k, asked).checkpoint()
    full = near.groupBy("id").count().where(F.col("count") >= k).select("id")
    rest = asked.join(full, "id", "left_anti").join(classes, "cid").select("id", "cid", "vector").withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(1 << 20)))
    out = near.join(full, "id", "left_semi")
    parts = max(1, math.ceil(n / 100 / (QUERY_BLOCK * 0.8)))
    rest = rest.checkpoint()
    for p in range(parts):
        block = rest.where(F.col("block") % parts == p).select("id", "vector").toPandas()
        if block.empty:
            continue
        x = np.stack(block["vector"].to_numpy()).astype(np.float64)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        shared = spark.sparkContext.broadcast((block["id"].to_numpy(), x))
        out = out.unionByName(_scan(code_chunks, shared, k))
    return out


def _scan(code_chunks: DataFrame, shared, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        best = np.full((len(ids), k), -2.0)
        name = np.full((len(ids), k), None, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, other = _unit(batch).astype(np.float32), np.array(batch.column("id").to_pylist(), object)
            for s in range(0, len(ids), 2048):
                c = (x[s : s + 2048] @ y.T).astype(np.float64)
                c[ids[s : s + 2048][:, None] == other[None, :]] = -2
                all_c = np.concatenate([best[s : s + 2048], c], axis=1)
                top = np.argsort(-all_c, axis=1, kind="stable")[:, :k]
                names = np.concatenate([name[s : s + 2048], np.broadcast_to(other, (len(c), len(other)))], axis=1)
                best[s : s + 2048] = np.take_along_axis(all_c, top, axis=1)
                name[s : s + 2048] = np.take_along_axis(names, top, axis=1)
        r, j = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(list(ids[r]), pa.string()), pa.array(list(name[r, j]), pa.string()), pa.array(best[r, j])], ["id", "neighbour", "cosine"])

    latest = members(code_chunks)
    rows = latest.join(vector_classes(code_chunks), "cid").select("id", "vector")
    found = rows.mapInArrow(run, "id string, neighbour string, cosine double")
    rank = W.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
