"""SimHash near-duplicates over a vantage-point tree.

Fingerprints are collapsed to distinct values first, so groups of equal texts cost nothing more.  A tree of vantage points, made
from a bounded sample, cuts the fingerprints into shards by Hamming distance.  A fingerprint lives in one shard; by the triangle
bound it visits every other shard that may hold a partner within the radius.  Of two fingerprints parted at a node only the one
nearer to the vantage point visits the other's side.  Inside a shard the search goes on by rings of equal distance to further
vantage points.  A shard returns a spanning forest of its links, never its pairs, and forests are joined to components.

Defined results: a null or blank text has the fingerprint zero and is linked like any other; fewer words than a shingle form one
shingle; repeated rows share a component; a component is named by its smallest id that is not null; an empty table gives an empty
table.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbrook.operators.components import connected_components
from callbrook.session import written

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Shards are planned for so many fingerprints; vantage points are picked from at most SAMPLE of them.
SHARD, SAMPLE, LEAST = 16384, 32768, 24
LEAF, BLOCK = 512, 1 << 22


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    import xxhash
    w = text.lower().split()  # on bytes both touch ASCII only
    if not w:
        return 0
    digest, total = xxhash.xxh64_intdigest, max(1, len(w) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        part = w[at:at + (1 << 16) + shingle - 1]
        joined = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        last = min(shingle, len(part)) - 1
        spans = zip(starts[: len(part) - last].tolist(), ends[last:].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.arrow_udf("long")
    def marks(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([fingerprint_of(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in batch], pa.int64())
    return marks(text.cast("string"))


class Tree:
    """Nodes are ``(vantage point, threshold, left, right)``; a leaf is its shard's number."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int):
        self.radius, self.shards = radius, 0
        self.root = self._grow(sample.view(np.uint64), depth)

    def _grow(self, sample, depth):
        if depth and len(sample) >= LEAST:
            best = None
            for vp in sample[:: max(1, len(sample) // 24)]:
                d = np.bitwise_count(sample ^ vp)
                seen = np.cumsum(np.bincount(d, minlength=65)) / len(sample)
                for t in range(64):
                    if 0.35 <= seen[t] <= 0.65:
                        crossing = seen[min(64, t + self.radius)] - (seen[t - self.radius] if t >= self.radius else 0.0)
                        if best is None or crossing < best[0]:
                            best = crossing, vp, t, d
            if best:
                _, vp, t, d = best
                return vp, t, self._grow(sample[d <= t], depth - 1), self._grow(sample[d > t], depth - 1)
        self.shards += 1
        return self.shards - 1

    def route(self, f: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(shard, fingerprints, whether they live there)."""
        work = [(self.root, f.view(np.uint64), f.view(np.uint64)[:0])]
        while work:
            node, home, guests = work.pop()
            if not len(home) + len(guests):
                continue
            if isinstance(node, int):
                yield node, home, True
                yield node, guests, False
                continue
            vp, t, left, right = node
            h, g = (np.bitwise_count(x ^ vp).astype(np.int16) for x in (home, guests))
            near = h <= t
            work.append((left, home[near], guests[g <= t + self.radius]))
            crossing = home[near & (h > t - self.radius)]
            work.append((right, home[~near], np.concatenate([guests[g > t - self.radius], crossing])))


class Forest:
    """Labels of a shard's fingerprints, merged link by link."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            up = np.arange(len(self.label))
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while (up[up] != up).any():
                up = up[up]
            self.label = up[self.label]


def shard_forest(fps: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the position of a fingerprint of its component, searching links that end at one living here."""
    f, forest = fps.view(np.uint64), Forest(len(fps))
    work = [(np.flatnonzero(home), np.arange(len(fps)), 0)]
    while work:
        h, q, depth = work.pop()
        if len(h) > LEAF and depth < 8:
            vp = f[h[len(h) // 2]]
            dh, dq = (np.bitwise_count(f[x] ^ vp).astype(np.int16) for x in (h, q))
            for ring in np.unique(dh):
                work.append((h[dh == ring], q[np.abs(dq - ring) <= radius], depth + 1))
            continue
        step = max(1, BLOCK // max(1, len(h)))
        for at in range(0, len(q), step):
            part = q[at:at + step]
            i, j = np.nonzero(np.bitwise_count(f[part][:, None] ^ f[h][None, :]) <= radius)
            forest.merge(part[i], h[j])
    return forest.label


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints of column ``fp`` as all pairs within ``radius`` would."""
    n = fps.count()
    depth = min(12, max(0, int(np.ceil(np.log2(max(1, n) / shard)))))
    size = min(sample, 256 << depth)
    some = fps if n <= size else fps.filter(F.shiftrightunsigned(F.xxhash64("fp"), 11) < F.lit(int(size / n * 2 ** 53)))
    taken = np.sort(np.array([r.fp for r in some.limit(2 * size).collect()], np.int64))  # a bounded sample
    tree = fps.sparkSession.sparkContext.broadcast(Tree(taken, depth, radius))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, f, lives in tree.value.route(batch.column(0).to_numpy(zero_copy_only=False)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), number, np.int32)), pa.array(f.view(np.int64)), pa.array(np.full(len(f), lives))],
                                                 ["shard", "fp", "home"])

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        f = rows["fp"].to_numpy()
        label = shard_forest(f, rows["home"].to_numpy(bool), radius)
        linked = label != np.arange(len(f))
        return pd.DataFrame({"a": f[linked], "b": f[label[linked]]})

    placed = fps.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    return placed.groupBy("shard").applyInPandas(search, "a long, b long")


def classes(tagged: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, component_fp, component_id`` per distinct fingerprint of ``tagged`` (``doc_id, fp``)."""
    distinct = written(tagged.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    joined = connected_components(written(links(distinct.select("fp"), radius), "links"))
    named = distinct.join(joined, distinct["fp"] == joined["node"], "left") \
        .select("fp", "least", F.coalesce("component", "fp").alias("component_fp"))
    first = named.groupBy("component_fp").agg(F.min("least").alias("component_id"))
    return named.join(first, "component_fp").select("fp", "component_fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document."""
    tagged = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")), "tagged")
    return tagged.join(classes(tagged, radius), "fp") \
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each component: the smallest id, null last, then the first row."""
    tagged = written(docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp"))
                     .withColumn("row", F.monotonically_increasing_id()), "tagged")
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    per = tagged.groupBy("fp").agg(F.min(key).alias("least"))
    best = per.join(classes(tagged.select("doc_id", "fp"), radius), "fp").groupBy("component_fp").agg(F.min("least").alias("k"))
    return tagged.join(best.select("k.row"), "row", "left_semi").select("doc.*")
