"""Near-duplicates by five-word shingles against brute force over all pairs."""

import random

import awkward
import numpy as np
import pytest

import corpus_pipeline
from callbrook.llm import shingles


def plain_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def plain_keep(rows, least=0.8):
    """Positions that stay: the smallest id, null last, of each component of the graph of all pairs."""
    sets, label = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) / len(x | y) >= least:
                label[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append((d is None, d or 0, i))
    return sorted(min(g)[:2] for g in groups.values())


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


def edited(r, text, edits):
    w = text.split()
    for _ in range(edits):
        k = r.randrange(len(w))
        w[k:k + r.randint(0, 1)] = ["new%d" % r.randint(0, 99)] * r.randint(0, 2)
    return " ".join(w)


def fixture():
    r = random.Random(3)
    vocabulary = ["w%d" % k for k in range(400)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.choice((3, 5, 9, 30, 120, 400)))) for _ in range(40)]
    texts = [*base, *(edited(r, b, r.randint(0, 1 + len(b.split()) // 30)) for b in base for _ in range(6)), None, "", " \n"]
    chain = [r.choice(vocabulary) for _ in range(200)]
    for k in range(12):  # each near the next, the ends far apart
        texts.append(" ".join(chain))
        chain[k * 15:k * 15 + 3] = ["c%d" % k] * 3
    texts.append(base[5].upper())
    r.shuffle(texts)
    return [(None if k % 40 == 7 else 1000 - k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("centres, sent, radius", [(0, 1 << 21, 2), (1, 0, 2), (2, 1 << 21, 0)])
def test_stage_against_brute_force(spark, centres, sent, radius, monkeypatch):
    monkeypatch.setattr(shingles.set_links, "__defaults__", (centres,))
    monkeypatch.setattr(shingles, "SENT", sent)
    monkeypatch.setattr(shingles, "RADIUS", radius)
    monkeypatch.setattr(shingles, "FREQUENT", 300)
    rows = fixture()
    rows += rows[:30]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_keep(rows)
    assert ids(corpus_pipeline.near_duplicates(spark, docs, "")) == want and len(want) < 0.6 * len(rows)


def test_given_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    assert ids(corpus_pipeline.near_duplicates(spark, docs, "")) == plain_keep(rows)


def test_first_hashes_always_meet():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n, cut, more = int(rng.integers(1, 60)), int(rng.integers(0, 8)), int(rng.integers(0, 8))
        universe = rng.permutation(200)
        x, y = np.sort(universe[:n]), np.sort(universe[min(cut, n - 1):n + more])
        common = np.intersect1d(x, y)
        if len(common) / (len(x) + len(y) - len(common)) >= 0.8:
            i, j = np.searchsorted(x, common[0]), np.searchsorted(y, common[0])
            assert i < shingles.first_hashes(len(x), 0.8) and j < shingles.first_hashes(len(y), 0.8)
            assert shingles.may_reach(len(x), i, len(y), j, 0.8)


def test_awkward_and_empty_tables(spark):
    docs = awkward.frame(spark)
    kept = shingles.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(plain_keep([r[:2] for r in awkward.rows()]))
    assert shingles.keep_one(awkward.empty(spark)).collect() == []


def test_sets_far_apart_are_told_before_their_texts_move(spark, monkeypatch):
    r, asked, confirmed = random.Random(7), [], shingles.confirmed
    monkeypatch.setattr(shingles, "confirmed", lambda pairs, *a: (asked.append(pairs.count()), confirmed(pairs, *a))[1])
    monkeypatch.setattr(shingles, "PLACE", 4)
    own = [["u%d" % r.randrange(10**6) for _ in range(300)] for _ in range(12)]
    texts = [" ".join(["c1 c2 c3 c4 c5 c6", *w]) for w in own]  # one passage in common, else apart
    texts += [edited(r, texts[0], 1) for _ in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ids(shingles.keep_one(docs)) == plain_keep(list(enumerate(texts)))
    apart = len(own) * (len(own) - 1) // 2
    assert 0 < sum(asked) < apart


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(9)
    for n, more in ((1, 0), (40, 5), (900, 80), (5000, 3000)):
        h = np.unique(rng.integers(-2**63, 2**63 - 1, n + more, dtype=np.int64))
        x, y = h[:n], h[more:]
        differ = np.bitwise_count((shingles.parities(x) ^ shingles.parities(y)).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(x, y))
