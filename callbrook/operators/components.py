"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbrook.session import discard, written


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _star(edges: DataFrame) -> DataFrame:
    """One round.  Larger neighbours move to the smallest neighbour, then the smaller ones do; each step is an aggregation
    with map-side minimum and a join back, so a hub is never gathered."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_least_neighbour(both), "u").filter(F.col("v") > F.col("u")) \
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    joined = large.join(_least_neighbour(large), "u")
    return joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
        .select("e.u", "e.v").filter("u > v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``, any orderable type): the smallest node it reaches.

    Self-links and repeats are allowed, nulls are not links.  Rounds are written to the shared folder, so a lost executor costs
    one round at most, and go when the next is written; their number is logarithmic in the length of the longest chain in practice.
    """
    nodes = edges.filter("a is not null and b is not null").select("a", "b")
    e = written(nodes.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, old, e = mark, e, written(_star(e), "edges")
        discard(old)
    else:
        raise RuntimeError("components did not settle")
    seen = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return seen.join(e, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))
