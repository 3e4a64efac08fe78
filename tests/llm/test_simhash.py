"""Fingerprints, the exactness of the tree search and whole classes against brute force."""

import random

import numpy as np
import pytest
import xxhash

from callbrook.llm import simhash


def plain_fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(values, radius):
    seen = sorted(set(values))
    label = {x: x for x in seen}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, a in enumerate(seen):
        for b in seen[:i]:
            if (a ^ b).bit_count() <= radius:
                label[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in seen}


def test_fingerprints():
    r = random.Random(1)
    texts = ["", "  \n\t", "One", "one\x0btwo", "Ärger mit Ölen Im Ü", "a b c " * 40000] + [
        " ".join(r.choice("abcdeFGHÉ") * r.randint(1, 3) for _ in range(r.randint(1, 60))) for _ in range(40)]
    for t in texts:
        assert simhash.fingerprint_of(t.encode()) & (1 << 64) - 1 == plain_fingerprint(t)


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, n // 6, dtype=np.uint64) * np.uint64(2)
    out = set()
    for c in centres:
        for _ in range(6):
            x = int(c)
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(k)
            out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_shards_find_every_link(seed, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    values = clustered(1500, seed)
    f = np.array(values, np.int64)
    tree = simhash.Tree(f, 4, 2)
    assert tree.shards > 4
    shards: dict = {}
    for number, part, lives in tree.route(f):
        shards.setdefault(number, []).append((part.view(np.int64), np.full(len(part), lives)))
    edges, homes = [], 0
    for parts in shards.values():
        g, home = (np.concatenate(x) for x in zip(*parts))
        homes += home.sum()
        label = simhash.shard_forest(g, home, 2)
        edges += zip(g.tolist(), g[label].tolist())
    assert homes == len(f)
    mask = (1 << 64) - 1
    want = plain_components([x & mask for x in values], 2)
    got = {x: x for x in want}

    def root(x):
        while got[x] != x:
            x = got[x]
        return x
    for a, b in edges:
        a, b = root(a & mask), root(b & mask)
        got[max(a, b)] = min(a, b)
    assert {x: root(x) for x in got} == want


SCHEMA = "doc_id long, text string, fp string, row string, shard int"


def fixture_rows():
    r = random.Random(7)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(300)) for _ in range(12)]
    rows = [(None, base[0]), (5, None), (6, ""), (7, " \n"), (8, "Word"), (9, "word"), (9, "word"), (10, base[0]), (11, base[0].upper())]
    for k, b in enumerate(base):
        w = b.split()
        w[150] = "other"
        rows += [(100 + k, b), (200 + k, " ".join(w))]
    return [(i, t, "x", "y", 1) for i, t in rows]


def test_classes_against_brute_force(spark):
    rows = fixture_rows()
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    comp = plain_components(fps, 2)
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[comp[f]] = min(r[0], least.get(comp[f], r[0]))
    want = sorted((str(r[0]), f"{f:016x}", least.get(comp[f])) for r, f in zip(rows, fps))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_one_document_of_each_class_stays(spark):
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    comp = plain_components([plain_fingerprint(r[1]) for r in rows], 2)
    assert kept.count() == len(set(comp.values()))
    ids = [r.doc_id for r in kept.collect()]
    assert 10 in ids and 11 not in ids and None not in ids and ids.count(9) <= 1


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []
