"""Product-quantization codes by cover-tree Lloyd.

Vectors become integers and are cut into parts; each part position has a codebook.  A block of rows holds one cover tree a part: every
node has a centre, the radius of what lies below it and a slice of the block's points, whose sums are differences of cumulative sums.
Trees are built once and written; each Lloyd round reads them, and a node goes to an entry as a whole when the triangle inequality
leaves no other entry nearer to any of its points.  Other nodes hand the question to their children, and the points of an ambiguous
leaf are compared exactly.  A block returns one sum and count an entry, and these are added up per part and entry.

All distances are sums of squared integers below 2^53, so they are exact in double precision and ties go to the lower index.  Bounds
have a margin beyond rounding errors, so a whole subtree is only assigned where every point's exact comparison gives the same entry.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped.  Shorter vectors count as padded
with zeros to the longest, rounded up to a multiple of the parts.  Scaled components beyond 2^23 (that is 8192 before scaling) are
held at it.  Fewer rows than entries make a smaller codebook; of equal ids the smaller vector comes first, a null id comes last.
Repeated rows count each; null labels are one group.  An empty table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbrook.session import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
MOST, LEAF, BLOCK = 1 << 23, 12, 8192
_TREE = "vec_id array<long>, label array<string>, points array<binary>, order array<binary>, nodes array<binary>, radii array<binary>"


def whole_numbers(v: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component, held at ``MOST``."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))


def usable(v: Column) -> Column:
    d = v.cast("array<double>")
    return v.isNotNull() & ~F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


# --- cover trees ----------------------------------------------------------------


class CoverTree:
    """``nodes``: centre's row, first and last row of the slice, first and last child; children of a node lie side by side.

    A node's centre is a point of its slice and also that of its first child; children halve the node's radius, and their centres are
    further apart than that.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        nodes, radii = [], []
        far = self._distances(points, self.order, 0)
        nodes.append([0, 0, len(points), 0, 0])
        radii.append(far.max())
        work = [(0, far)]  # a node and the distances of its slice from its centre
        while work:
            k, far = work.pop()
            centre, first, last, _, _ = nodes[k]
            if last - first <= leaf or radii[k] == 0:
                continue
            scale, rest, rows, made = radii[k] / 2, far > radii[k] / 2, self.order[first:last], []
            made.append((rows[~rest], far[~rest]))
            left = rows[rest]
            while len(left):
                d = self._distances(points, left, left[0])
                made.append((left[d <= scale], d[d <= scale]))
                left = left[d > scale]
            nodes[k][3:] = len(nodes), len(nodes) + len(made)
            for part, d in made:
                self.order[first:first + len(part)] = part
                nodes.append([part[np.argmin(d)], first, first + len(part), 0, 0])
                radii.append(d.max())
                work.append((len(nodes) - 1, d))
                first += len(part)
        self.nodes, self.radii = np.array(nodes, np.int64), np.array(radii)

    @staticmethod
    def _distances(points, rows, centre) -> np.ndarray:
        d = points[rows] - points[centre]
        return np.sqrt(np.einsum("ij,ij->i", d, d))


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries."""
    return (x * x).sum(1)[:, None] - 2.0 * (x @ entries.T) + (entries * entries).sum(1)[None, :]


def assigned(points: np.ndarray, nodes: np.ndarray, radii: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, last, entry) of slices of the ordered ``points``; every point lies in one."""
    frontier = np.zeros(1, np.int64)
    while len(frontier):
        d = squares(points[nodes[frontier, 0]], entries)
        best = d.argmin(1)
        near = np.sqrt(d[np.arange(len(d)), best])
        d[np.arange(len(d)), best] = np.inf
        clear = near + 2 * radii[frontier] < np.sqrt(d.min(1)) * (1 - 1e-9) - 1e-6
        clear |= (radii[frontier] == 0)  # copies of the centre
        for k, e in zip(frontier[clear].tolist(), best[clear].tolist(), strict=True):
            yield nodes[k, 1], nodes[k, 2], e
        open_, leaves = frontier[~clear], nodes[frontier[~clear], 3] == 0
        rows = _spread(nodes[open_[leaves], 1], nodes[open_[leaves], 2])
        for at in range(0, len(rows), 4096):
            part = rows[at:at + 4096]
            for row, e in zip(part.tolist(), squares(points[part], entries).argmin(1).tolist(), strict=True):
                yield row, row + 1, e
        frontier = _spread(nodes[open_[~leaves], 3], nodes[open_[~leaves], 4])


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    n = last - first
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


# --- blocks ---------------------------------------------------------------------


def _built(ids: list, labels: list, x: np.ndarray, parts: int) -> list:
    """A row of ``_TREE``."""
    points, order, nodes, radii = [], [], [], []
    for part in np.split(x, parts, axis=1):
        tree = CoverTree(part.astype(np.float64))
        where = np.empty(len(part), np.int64)  # nodes name rows of the ordered points
        where[tree.order] = np.arange(len(part))
        tree.nodes[:, 0] = where[tree.nodes[:, 0]]
        points.append(part[tree.order].astype("<i4").tobytes())
        order.append(tree.order.astype("<i4").tobytes())
        nodes.append(tree.nodes.astype("<i4").tobytes())
        radii.append(tree.radii.astype("<f8").tobytes())
    return [ids, labels, points, order, nodes, radii]


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """Of each row of ``_TREE`` its columns, with arrays for the binary ones."""
    for row in batch.to_pylist():
        yield (row["vec_id"], row["label"],
               [np.frombuffer(b, "<i4").reshape(-1, width).astype(np.float64) for b in row["points"]], [np.frombuffer(b, "<i4") for b in row["order"]],
               [np.frombuffer(b, "<i4").reshape(-1, 5).astype(np.int64) for b in row["nodes"]], [np.frombuffer(b, "<f8") for b in row["radii"]])


def blocks(rows: DataFrame, parts: int, length: int, block: int = BLOCK) -> DataFrame:
    """One row a block of at most ``block`` rows ``vec_id, label, x``: its cover trees."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made():
            t = pa.Table.from_batches(held)
            flat = t["x"].combine_chunks()
            size = np.diff(flat.offsets.to_numpy())
            x = np.zeros((len(size), length), np.int64)
            x[np.repeat(np.arange(len(size)), size), _spread(np.zeros(len(size), np.int64), size)] = flat.flatten().to_numpy()
            for at in range(0, len(x), block):
                ids, labels = (t[c].slice(at, block).to_pylist() for c in ("vec_id", "label"))
                row = _built(ids, labels, x[at:at + block], parts)
                kinds = (pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.list_(pa.binary())] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _TREE.split(", ")])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block:
                yield from made()
                held, n = [], 0
        if n:
            yield from made()

    return rows.mapInArrow(build, _TREE)


def entry_sums(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``part, entry, n, sums``: of the points nearest to each entry, over all blocks."""
    width = books[0].shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(books), *books[0].shape), np.int64), np.zeros((len(books), len(books[0])), np.int64)
        for batch in batches:
            for _, _, points, _, nodes, radii in _trees(batch, width):
                for p, entries in enumerate(books):
                    upto = np.zeros((len(points[p]) + 1, width), np.int64)
                    np.cumsum(points[p].astype(np.int64), axis=0, out=upto[1:])
                    a, b, e = np.array([*assigned(points[p], nodes[p], radii[p], entries)], np.int64).T
                    np.add.at(sums[p], e, upto[b] - upto[a])
                    np.add.at(counts[p], e, b - a)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
                                         ["part", "entry", "n", "sums"])

    each = trees.mapInArrow(add, "part long, entry long, n long, sums array<long>")
    total = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).select("part", "entry", "n", F.array(*[f"s{k}" for k in range(width)]).alias("sums"))


def final_codes(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error`` for every row."""
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, points, order, nodes, radii in _trees(batch, books[0].shape[1]):
                codes, error = np.zeros((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
                for p, entries in enumerate(books):
                    code = np.zeros(len(ids), np.int64)
                    for a, b, e in assigned(points[p], nodes[p], radii[p], entries):
                        code[a:b] = e
                    d = (points[p] - entries[code]).astype(np.int64)
                    codes[order[p], p] = code
                    error[order[p]] += (d * d).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)],
                                                 ["vec_id", "label", "code", "error"])
    return trees.mapInArrow(tell, "vec_id long, label string, code string, error long")


def first_entries(rows: DataFrame, parts: int, length: int, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the rows with the smallest ids: a fixed number of rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    x = np.zeros((len(first), length))
    for k, r in enumerate(first):
        x[k, :len(r.x)] = r.x
    return np.split(x, parts, axis=1)


def quantized(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK,
              id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits a part")
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    rows = vectors.filter(usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), whole_numbers(F.col(vector_col), scale).alias("x"))
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return vectors.sparkSession.createDataFrame([], schema)
    length = max(1, -(-longest // parts)) * parts
    books = first_entries(rows, parts, length, entries)
    trees = written(blocks(rows, parts, length, block), "cover_trees")
    for _ in range(rounds):
        for r in entry_sums(trees, books).collect():  # at most a row an entry and part
            books[r.part][r.entry] = [s // r.n for s in r.sums]
    digest = hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()
    coded = written(final_codes(trees, books), "codes").withColumns({"unlabelled": F.col("label").isNull(), "group": F.coalesce("label", F.lit(""))})
    totals = written(coded.groupBy("unlabelled", "group").agg(F.sum("error").alias("label_error")), "label_errors")
    return coded.join(totals, ["unlabelled", "group"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
