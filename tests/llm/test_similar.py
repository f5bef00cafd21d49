"""Nearest vectors: k for every vector, cells beside a hot one, copies of other lengths, the stated query set in full."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import similar

CHUNKS = "id string, vector array<float>, indexed_at timestamp, cid string"


def _chunks(spark, x):
    return spark.createDataFrame([(f"v{i:05d}", [float(v) for v in r], None, "clash") for i, r in enumerate(x)], CHUNKS)


def _nearest(x, k):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = y @ y.T
    np.fill_diagonal(c, -2)
    return np.argsort(-c, axis=1)[:, :k]


def test_k_for_every_vector(spark):
    """Without a threshold every vector has k neighbours, nearly all the right ones, however far."""
    x = np.random.default_rng(1).standard_normal((3000, 64)).astype(np.float32)
    rows = similar.neighbours(_chunks(spark, x)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["id"], set()).add(r["neighbour"])
    assert len(got) == 3000 and all(len(v) == 5 for v in got.values())
    want = _nearest(x, 5)
    hit = sum(f"v{j:05d}" in got[f"v{i:05d}"] for i in range(3000) for j in want[i])
    assert hit >= 0.9 * 15_000


def test_no_block_over_twice_the_cap(spark):
    """A tight group of a fifth of the rows: neither its cells nor those beside them give one call more than twice the cap."""
    rng = np.random.default_rng(2)
    group = rng.standard_normal(64) + rng.standard_normal((4000, 64)) * 0.12
    x = np.concatenate([group, rng.standard_normal((16_000, 64))]).astype(np.float32)
    classes = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cid long, vector array<float>").withColumn("ask", F.lit(True)).cache()
    m, cap = 5, 500
    cells = similar.cell_sizes(classes, m, 3, 2, cap).cache()
    rows = similar._in_blocks(similar._hashed(classes, m, similar.WIDTH, 3, 2, True).join(cells, ["tbl", "cell"]))
    top = rows.groupBy("tbl", "cell", "bi", "bq").count().agg(F.max("count")).head()[0]
    assert top <= 2 * cap * 1.25  # blocks are filled by hash
    assert cells.where("bqs > 1 AND bis = 1").count() > 0  # cells beside the hot ones, with many askers
    asked = similar._hashed(classes, m, similar.WIDTH, 3, 2, False).groupBy("tbl", "cell").agg(F.count_if("own").alias("own"))
    assert asked.where("own = 0").join(cells, ["tbl", "cell"]).count() == 0


def test_scaled_copies_are_one_class(spark):
    v = np.random.default_rng(3).standard_normal(64)
    x = np.stack([v * s for s in (1, 2, 3, 0.37, 1e-3, 1e6)] + [-v]).astype(np.float32)
    assert similar.vector_classes(_chunks(spark, x.astype(np.float64))).count() <= 7
    exact = np.stack([v.astype(np.float32) * np.float32(2.0**s) for s in range(-60, 60)])
    got = similar.pairs(_chunks(spark, exact)).collect()
    assert similar.vector_classes(_chunks(spark, exact)).count() == 1
    assert len(got) == 120 * 5 - 15  # k partners each, the smallest ids


def test_query_set_in_full(spark):
    x = np.random.default_rng(4).standard_normal((4000, 64)).astype(np.float32)
    x[2000:2400] = x[:400] + 0.05
    df = _chunks(spark, x)
    asked = {r["id"] for r in df.where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0).select("id").collect()}
    got = {}
    for r in similar.query_neighbours(df).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    want = _nearest(x, 5)
    assert set(got) == asked and len(asked) > 20
    hit = sum(f"v{j:05d}" in got[i].values() for i in asked for j in want[int(i[1:])])
    assert hit >= 0.98 * 5 * len(asked)
