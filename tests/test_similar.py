"""All pairs above a cosine against all pairs, and how many of them are multiplied in full."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.operators import search, similar


def brute(x, least):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    g = np.round(u @ u.T, 6)
    return {(i, j) for i, j in zip(*np.nonzero(g >= least), strict=True) if i < j}


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("kind, least", [("plain", 0.4), ("plain", 0.0), ("groups", 0.85), ("groups", 0.99), ("equal", 0.85)])
def test_pairs_are_all_pairs(spark, kind, least):
    r = np.random.default_rng(7)
    x = r.normal(size=(260, 20))
    if kind == "groups":
        x = r.normal(size=(6, 20))[r.integers(0, 6, 260)] * 3 + x
    if kind == "equal":
        x[:200] = x[0]
    got = similar.similar_pairs(frame(spark, x), least, group=70, tile=16).collect()
    assert len(got) == len({(p["a"], p["b"]) for p in got}) and {(p["a"], p["b"]) for p in got} == brute(x, least)


def test_few_pairs_are_multiplied_in_full(spark, sf_dir):
    """On the table of embeddings, at the cosine of the query, under a tenth."""
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    turned = u @ np.linalg.eigh(u.T @ u)[1][:, ::-1]
    i, j, full = similar.above(turned, turned, 0.4)
    assert full < 0.1 * len(u) ** 2 and brute(x, 0.4) <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_what_travels_grows_with_the_rows(spark):
    """Groups hold more rows, not more groups as many rows; vectors travel as they were given, and floats give the pairs of their doubles."""
    assert [similar.group_count(n) for n in (0, 5_000, 102_564, 615_384)] == [1, 2, similar.GROUPS, similar.GROUPS]
    assert similar.group_count(10_000_000) * similar.MOST >= 10_000_000
    x = np.random.default_rng(5).normal(size=(150, 20)).astype(np.float32)
    floats = frame(spark, x).withColumn("embedding", F.col("embedding").cast("array<float>"))
    got = {(p["a"], p["b"]) for p in similar.similar_pairs(floats, 0.4, group=40, tile=16).collect()}
    assert got == brute(x.astype(float), 0.4) and got
    assert similar.usable_vectors(floats).schema["x"].dataType.simpleString() == "array<float>"


def test_far_groups_do_not_meet():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(100, 8)) * 0.05 + c for c in np.eye(8)[:4]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    pivots = similar.spread_pivots(x, 4)
    d = similar._distances(x, pivots).reshape(4, 100, 4)
    apart = similar._apart(d.min(1)[0], d.max(1)[0], d.min(1), d.max(1))
    assert apart[0] < 0 and (apart[1:] > np.sqrt(2 - 2 * 0.9)).all()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0, 0.0]), (8, [3.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (9, [])]
    got = sorted(tuple(r) for r in similar.similar_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect())
    assert got == [(1, 2, 1.0), (1, 2, 1.0), (7, 8, 1.0)]
    assert similar.similar_pairs(spark.createDataFrame([], "vec_id long, embedding array<double>"), 0.9).count() == 0


@pytest.mark.parametrize("k, least, positive", [(3, None, False), (40, 0.1, False), (200, None, False), (4, None, True)])
def test_nearest_in_blocks_as_by_hand(spark, monkeypatch, k, least, positive):
    monkeypatch.setattr(search, "BLOCK", 30)
    monkeypatch.setattr(search, "CHUNK", 9)
    rng = random.Random(8)
    rows = []
    for i in range(120):
        v = [1.0, 2.0, 0.0, 1.0] if i % 4 == 0 else [float(rng.randint(-2, 3)) for _ in range(4)]
        rows.append((i, None if i == 7 else v[:3] if i == 8 else [*v[:3], None] if i == 9 else [0.0] * 4 if i == 11 else v))
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = e.where("vec_id % 5 = 2 or vec_id in (8, 9, 20)").withColumnsRenamed({"vec_id": "query_id", "embedding": "q"})
    found = search.vector_top_k(e, asked, k, least, positive=positive)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())
    # Pair by pair, as built-in functions have it.
    pairs = e.crossJoin(asked).where("vec_id <> query_id").withColumn("product", C.dot("embedding", "q")).withColumn("score", F.round(C.cosine("embedding", "q"), 6))
    pairs = pairs.where("product > 0") if positive else pairs
    pairs = pairs if least is None else pairs.where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    want = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pairs.withColumn("rank", rank).where(F.col("rank") <= k).collect())
    assert got == want and got


def test_nearest_scores_leave_a_block_few_to_a_query():
    n, k = 2000, 5
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(n, 8))
    vectors[::2] = vectors[0]  # one vector many times
    store = pa.table({"vec_id": np.arange(n), "embedding": vectors.tolist()})
    asked = pa.table({"query_id": np.arange(0, n, 20), "q": vectors[::20].tolist()})
    i, j, _, _ = search._best_of_block(store, asked, k, None, 1e-10, False)
    assert len(i) == k * asked.num_rows and np.bincount(j).max() == k
