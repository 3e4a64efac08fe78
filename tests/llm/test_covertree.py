"""Cover-tree Lloyd against the plain rounds in integers."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from callbrook.llm import covertree

SCHEMA = "vec_id long, embedding array<float>, label int, x array<int>, code string, error string, part long, points string, unlabelled string, group string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, [1], *["x"] * 2, 1, *["x"] * 3) for i, v, k in rows], SCHEMA)


def plain(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, k) for i, v, k in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    length = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    x = [[int(np.clip(np.floor(1024 * float(np.float32(c))), -covertree.MOST, covertree.MOST)) for c in v] + [0] * (length - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, x[r]))[:entries]
    width = length // parts
    books = [[x[r][p * width:(p + 1) * width] for r in first] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for turn in range(rounds + 1):
        found = [[nearest(r[p * width:(p + 1) * width], books[p]) for p in range(parts)] for r in x]
        for p in range(parts) if turn < rounds else ():
            groups = defaultdict(list)
            for r, f in zip(x, found):
                groups[f[p][1]].append(r[p * width:(p + 1) * width])
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g)]
    error = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for (_, _, k), e in zip(kept, error):
        by_label[k] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join("%02x" % k for _, k in f), e, by_label[k2], digest) for (i, _, k2), f, e in zip(kept, found, error)), key=str)


def got(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def fixture(n, length=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, length))
    rows = [(k, (centres[k % 9] + r.normal(size=length) * r.choice([0, 0.01, 0.3])).astype(np.float32).tolist(), None if k % 4 == 3 else k % 4) for k in range(n)]
    return rows


@pytest.mark.parametrize("block", [8192, 37])
def test_rounds_are_exact(spark, block):
    rows = fixture(700)
    assert got(covertree.quantized(frame(spark, rows), block=block)) == plain(rows)


def test_awkward_rows(spark):
    one = [0.25, -0.5, 1.0, 2.0, 0.1, 0.2, 0.3, 0.4]
    rows = [(5, None, 1), (6, [1.0, None] * 4, 1), (7, [float("nan")] * 8, 2), (8, [float("inf")] * 8, 2), (9, one, None), (9, one, None), (9, one[::-1], 3),
            (None, [0.0] * 8, 3), (None, one, 4), (10, [], 4), (11, [1e30] * 8, 5), (12, [-1e30] + [0.0] * 7, 6), (13, one[:5], 7), (14, one + [0.7], None)]
    assert got(covertree.quantized(frame(spark, rows))) == plain(rows)
    copies = [(k, one, k % 2) for k in range(300)] + fixture(300, 8)
    random.Random(1).shuffle(copies)
    assert got(covertree.quantized(frame(spark, copies), block=100)) == plain(copies)


def test_empty_tables(spark):
    assert got(covertree.quantized(frame(spark, []))) == []
    assert got(covertree.quantized(frame(spark, [(1, None, 1)]))) == []


def test_tree_shape_and_pruning():
    x = np.array([v for _, v, _ in fixture(3000, 4)]) * 1024 // 1
    tree = covertree.CoverTree(x)
    ordered = x[tree.order]
    assert sorted(tree.order) == list(range(3000))
    where = np.empty(3000, int)
    where[tree.order] = np.arange(3000)
    nodes = tree.nodes.copy()
    nodes[:, 0] = where[nodes[:, 0]]
    for (centre, first, last, a, b), radius in zip(nodes, tree.radii):
        far = np.sqrt(((ordered[first:last] - ordered[centre]) ** 2).sum(1))
        assert far.max() <= radius + 1e-9 and first <= centre < last
        if b:
            assert nodes[a, 1] == first and nodes[b - 1, 2] == last and (nodes[a + 1:b, 1] == nodes[a:b - 1, 2]).all()
            assert (tree.radii[a:b] <= radius / 2 + 1e-9).all()
    entries = np.random.default_rng(2).permutation(x)[:16].astype(float)
    slices = [*covertree.assigned(ordered, nodes, tree.radii, entries)]
    label = np.full(3000, -1)
    for a, b, e in slices:
        assert (label[a:b] == -1).all()
        label[a:b] = e
    assert (label == covertree.squares(ordered, entries).argmin(1)).all()
    assert len(slices) < 1500  # whole subtrees were assigned
