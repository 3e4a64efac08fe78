"""Groups of the forest stay bounded at any reach, and equal keys lie in another order in each tree."""

import numpy as np
from pyspark.sql import functions as F

from callbrook.llm import annforest
from callbrook.llm.queries import op5_prefix_forest
from test_sets import exact


def made(spark, n=600, d=16, noise=1.0):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in np.float32(1 + noise * rng.normal(size=d))]) for k in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_equal_keys_are_ordered_anew_in_each_tree(spark):
    _, df = made(spark, 64)
    pts = annforest.points(df, F.lit(True), 5, "vec_id", "embedding")
    far = pts.unionByName(pts.select((F.col("rep") + 1000).alias("rep"), F.expr("transform(v, (x, i) -> cast(if(i = 0, 1, 0) as float))").alias("v"), "ids", "asks"))
    orders: dict = {}
    for r in annforest.arrays(annforest.written(far, "points"), 4, 11).filter("rep >= 1000").orderBy("rank").collect():
        orders.setdefault(r.tree, []).append(r.rep)
    assert len(orders) == 4 and len({tuple(o) for o in orders.values()}) == 4


def test_groups_stay_bounded_and_a_full_reach_is_exact(spark):
    rows, df = made(spark)
    ask = F.col("vec_id") % 50 == 0
    pts = annforest.written(annforest.points(df, ask, 5, "vec_id", "embedding"), "points")
    arrays = annforest.arrays(pts, 3, 11)
    for cell in (8, 64):
        sizes = annforest.groups(arrays, annforest.asked(arrays, cell), 600, 600, cell).groupBy("cell", "block").agg(
            F.count_if("asks").alias("q"), F.count_if(~F.col("asks")).alias("p")).collect()
        assert max(r.q for r in sizes) <= cell and max(r.p for r in sizes) <= cell
    got: dict = {}
    for r in annforest.neighbours(df, ask, reach=600, cell=64, trees=2).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert got == {q: {k + 1: c for k, (c, _) in enumerate(best)} for q, best in exact(rows).items()}


def check_recall(rows, answers, least=0.9):
    """Ranks, scores and ties as defined, and nearly all of the exact neighbours."""
    want, got = exact(rows), {}
    for r in answers:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    unit = {k: np.array(v, float) / np.linalg.norm(np.array(v, float)) for k, v in rows}
    hits = 0
    for q, best in want.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        listed = [got[q][k] for k in range(1, 6)]
        assert listed == sorted(listed, key=lambda x: (-x[1], x[0])) and all(abs(s - unit[q] @ unit[c]) < 1e-9 for c, s in listed)
        hits += len({c for c, _ in listed} & {c for c, _ in best})
    assert hits >= least * 5 * len(want)


def test_recall_of_the_query_against_brute_force(spark, monkeypatch):
    """The registered query on the given table, where its first reach is an eighth of the rows."""
    reaches, search = [], annforest.search
    monkeypatch.setattr(annforest, "search", lambda a, q, n, reach, *more: reaches.append((n, reach)) or search(a, q, n, reach, *more))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    check_recall(rows, op5_prefix_forest(spark, "/root/testdata/sf0.1").collect())
    assert max(reach for _, reach in reaches) <= reaches[0][0] / 10


def test_recall_on_a_larger_table(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 32))
    rows = [(k, [float(x) for x in np.float32(centres[k % 60] + 0.7 * rng.normal(size=32))]) for k in range(20000)]
    few = [(k if k % 50 or k < 2000 else k + 1000001, v) for k, v in rows]  # forty queries
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    check_recall(few, annforest.neighbours(df, F.col("vec_id") % 50 == 0).collect())
