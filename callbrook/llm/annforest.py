"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives every vector a string of 64 hash bits (signs of orthogonal projections) and keeps the vectors sorted by it.  In a
sorted array the neighbours of a query are its longest prefix matches; going outward from its place ascends to shorter and shorter
prefixes.  All trees ascend together by the same number of places, ``reach``.  The arrays are cut into cells of a fixed number
of consecutive places; blocks of queries travel to the cells they reach, and only the best candidates of each cell leave it, so a
group's size does not grow with the reach.
The first reach is short, so that a search looks at a small part of each tree.  After a search the recall of a bounded number of queries is measured against brute force over all rows; while it is below
``recall`` all trees ascend further.

Equal vectors are one point with its ``k + 1`` smallest ids, enough for exact results, so a group of copies is never gathered.

Defined results: rows whose id is null or whose vector is null, zero or holds a null or non-finite component take no part, nor do
vectors whose length is not the most frequent one (of several the smallest); repeated ids are separate candidates, but rows with a
query's own id are not its candidates; ties go to the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callbrook.operators.ranking import ranked
from callbrook.session import written

TREES, REACH, CELL, RECALL, MEASURED, BITS = 16, 64, 4096, 0.95, 64, 64
FOUND = "q long, c long, score double"


def points(vectors: DataFrame, queries, k: int, id_col: str, vec_col: str) -> DataFrame:
    """``rep, v, ids, asks``: distinct usable vectors, named by their smallest id, with the ids that can matter."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(~bad & F.exists(v, lambda x: x != 0)) \
        .select(F.col(id_col).cast("long").alias("id"), v.alias("v"), queries.alias("ask"))
    dims = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    same = usable.filter(F.size("v") == (dims.d if dims else 0))
    kept = same.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("nth") <= k + 1)
    few = kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most k + 1
    asked = same.groupBy("v").agg(F.max("ask").alias("asks")).withColumnRenamed("v", "w")
    return few.join(asked, F.col("v") == F.col("w")).select(F.col("ids")[0].alias("rep"), "v", "ids", "asks")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _mean(pts: DataFrame) -> np.ndarray:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0))
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.shape[1])), pa.array(m.sum(0)), pa.array(np.full(m.shape[1], len(m)))], ["i", "s", "n"])
    rows = pts.select("v").mapInArrow(sums, "i long, s double, n long").groupBy("i").agg(F.sum("s") / F.sum("n")).collect()  # one row per dimension
    return np.array([r[1] for r in sorted(rows)])


def arrays(pts: DataFrame, trees: int, seed: int) -> DataFrame:
    """The sorted arrays: ``tree, key, rep, v, asks, rank`` with the rank counted through all trees."""
    mean = _mean(pts)
    rng, d = np.random.default_rng(seed), len(mean)
    planes = []
    for _ in range(trees):
        blocks = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-BITS // max(1, d)))]
        planes.append(np.concatenate(blocks, 1)[:, :BITS])
    shared = pts.sparkSession.sparkContext.broadcast((mean, planes))  # trees x 64 x dimension numbers

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, sides = shared.value
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                m = m / np.linalg.norm(m, axis=1, keepdims=True) - centre
                for t, h in enumerate(sides):
                    bits = np.packbits(m @ h > 0, axis=1).view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)  # signed order
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array(bits.view(np.int64)), *b.columns], ["tree", "key", *b.schema.names])

    types = dict(pts.dtypes)
    made = pts.select("rep", "v", "asks").mapInArrow(hashes, f"tree int, key long, rep long, v {types['v']}, asks {types['asks']}")
    return ranked(made, "arrays", "tree", "key", F.xxhash64("rep", "tree"), "rep")  # equal keys lie in another order in each tree


def _best(score: np.ndarray, reps: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest finite scores, ties to the smaller id."""
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
    else:
        near = np.arange(len(score))
    near = near[np.isfinite(score[near])]
    return near[np.lexsort((reps[near], -score[near]))][:k]


def asked(sorted_arrays: DataFrame, cell: int) -> DataFrame:
    """The asking points of all trees, in blocks of ``cell`` in the order of the arrays."""
    asking = sorted_arrays.filter("asks").select("tree", "rep", "v", F.col("rank").alias("place"))
    return ranked(asking, "asked", "place").select("tree", "rep", "v", "place", F.floor(F.col("rank") / cell).alias("block"))


def groups(sorted_arrays: DataFrame, asking: DataFrame, n: int, reach: int, cell: int) -> DataFrame:
    """``cell, block, tree, rank, rep, v, asks``: each block of queries with each cell of points that one of its queries reaches.
    A group holds at most ``cell`` queries and ``cell`` points, however far queries reach."""
    first, last = F.col("tree") * F.lit(n).cast("long"), (F.col("tree") + 1) * F.lit(n).cast("long") - 1  # of the tree's places
    met = F.sequence(F.floor(F.greatest(F.col("place") - reach, first) / cell), F.floor(F.least(F.col("place") + reach, last) / cell))
    visits = asking.withColumn("cell", F.explode(met))
    pairs = visits.select("cell", "block").distinct()
    held = sorted_arrays.withColumn("cell", F.floor(F.col("rank") / cell)).join(pairs, "cell")
    return held.select("cell", "block", "tree", "rank", "rep", "v", F.lit(False).alias("asks")) \
        .union(visits.select("cell", "block", "tree", "place", "rep", "v", F.lit(True)))


def search(sorted_arrays: DataFrame, asking: DataFrame, n: int, reach: int, cell: int, k: int) -> DataFrame:
    """``q, c, score``: for each asking point the best candidates of each cell within ``reach`` places of its tree."""
    def in_cell(key: tuple, table: pa.Table) -> pa.Table:
        tree, rank, rep, asks = (table[c].to_numpy() for c in ("tree", "rank", "rep", "asks"))
        m = _matrix(table["v"])
        norm = np.linalg.norm(m, axis=1)
        out: list[tuple] = []
        for t in np.unique(tree[asks]):
            mine = np.flatnonzero(~asks & (tree == t))
            ask = np.flatnonzero(asks & (tree == t))
            for at in range(0, len(ask), 128):
                part = ask[at:at + 128]
                score = (m[part] @ m[mine].T) / (norm[part][:, None] * norm[mine][None, :])
                score[(np.abs(rank[part][:, None] - rank[mine][None, :]) > reach) | (rep[part][:, None] == rep[mine][None, :])] = -np.inf
                for q, row in zip(part, score, strict=True):
                    out += [(rep[q], rep[mine[j]], row[j]) for j in _best(row, rep[mine], k)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"q": pa.array(cols[0], pa.int64()), "c": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return groups(sorted_arrays, asking, n, reach, cell).groupBy("cell", "block").applyInArrow(in_cell, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return found.dropDuplicates(["q", "c"]).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).drop("nth")


def brute(pts: DataFrame, some: DataFrame, k: int) -> DataFrame:
    """``q, c, score``: exact answers for a bounded number of points."""
    rows = some.select("rep", "v").collect()
    shared = pts.sparkSession.sparkContext.broadcast((np.array([r.rep for r in rows], np.int64), np.array([r.v for r in rows], float)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, q = shared.value
        for b in batches:
            if b.num_rows and len(q):
                m, own = _matrix(b.column(1)), b.column(0).to_numpy()
                score = (q @ m.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :])
                score[reps[:, None] == own[None, :]] = -np.inf
                best = [(i, j) for i in range(len(q)) for j in _best(score[i], own, k)]
                if best:
                    i, j = map(list, zip(*best, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(reps[i]), pa.array(own[j]), pa.array(score[i, j])], ["q", "c", "score"])

    return _top(pts.select("rep", "v").mapInArrow(scan, FOUND), k)


def neighbours(vectors: DataFrame, queries, k: int = 5, trees: int = TREES, reach: int = REACH, cell: int = CELL, recall: float = RECALL,
               measured: int = MEASURED, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``queries`` is a condition on the rows."""
    pts = written(points(vectors, queries, k, id_col, vec_col), "points")
    n = pts.count()
    sorted_arrays = arrays(pts, trees, seed)
    asking = asked(sorted_arrays, cell)
    some = pts.filter("asks").orderBy(F.xxhash64("rep")).limit(measured)
    truth = written(brute(pts, some, k), "truth")
    wanted = truth.count()
    while True:
        found = written(_top(search(sorted_arrays, asking, n, reach, cell, k), k), "found")
        hits = truth.join(found, ["q", "c"], "left_semi").count()
        if hits >= recall * wanted or reach >= n:
            break
        reach *= 2
    named = pts.select(F.col("rep").alias("c"), "ids")
    # a point's own copies are its nearest candidates; the cosine of a vector with itself is taken like any other
    v = F.col("v")
    dot = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    own = pts.filter("asks").select(F.col("rep").alias("q"), F.col("rep").alias("c"), (dot / (F.sqrt(dot) * F.sqrt(dot))).alias("score"), "ids")
    lists = found.join(named, "c").select("q", "c", "score", "ids").union(own) \
        .groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("best"))  # at most k + 1 points
    v = F.col(vec_col)
    asking = vectors.filter(queries & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), v.alias("w")).distinct()
    answered = asking.join(pts.filter("asks").select("v", F.col("rep").alias("q")), F.col("w") == F.col("v")).join(lists, "q")
    each = answered.select("query_id", F.explode(F.expr(
        "flatten(transform(best, b -> transform(filter(b.ids, i -> i <> query_id), i -> struct(-b.score as s, i as i))))")).alias("x"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("x.s", "x.i"))
    return each.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
