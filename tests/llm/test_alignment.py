"""Token alignment against a plain walk over both token sequences."""

import hashlib
import random
from collections import Counter, defaultdict

import awkward
import pytest

from callbrook.llm import alignment
from callbrook.llm.queries import op12_align_spans

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PARTS = ["a", "b", " ", "  ", "\n", " word", "ß", "é", "́", "😀", "一", "\U0001f9ff", "ﬁ", " ", "\x85", "<|endoftext|>", "<s>", "<0x41>", "'s",
         "12", " 3", "▁", "\t", "　", "e", "‍", "Å", " fish", "\x1c", ".", "xylophonic"]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(alignment.public_path("byte_bpe_50k.json"), alignment.public_path("piece_bpe_32k.model"))


def plain(pair, rows):
    held, found = Counter(), []
    for d, t in rows:
        a = pair.a.encode(" " + (t or ""), add_special_tokens=False).ids
        b = pair.b.encode(t or "")
        x, y = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            found.append((d, None))
            continue
        i = j = i0 = j0 = at_a = at_b = 0
        links, groups = [], []
        while i < len(a):
            links.append((a[i], b[j]))
            end_a, end_b = at_a + len(x[i]), at_b + len(y[j])
            if end_a <= end_b:
                at_a, i = end_a, i + 1
            if end_b <= end_a:
                at_b, j = end_b, j + 1
            if end_a == end_b:
                groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
                i0, j0 = i, j
        held.update(set(links))
        found.append((d, (len(a), len(b), groups, links)))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return Counter((d, *(none if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(held[p] == best[p[0]] for p in f[3]), sum(held[p] for p in f[3]),
                                                 hashlib.sha256(";".join(f[2]).encode()).hexdigest()))) for d, f in found)


def got(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [1 << 24, 1500])
def test_random_strings(spark, pair, block):
    r = random.Random(4)
    rows = [(k, "".join(r.choice(PARTS) for _ in range(r.randint(0, 30)))) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(pair, rows)
    assert got(alignment.alignments(docs, block=block)) == want
    assert 200 < sum(x[1] > 0 for x in want) < 1400  # both kinds


def test_given_documents(spark, sf, pair):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_align_spans(spark, sf)) == plain(pair, rows)


def test_bytes_of_ids(pair):
    text = "naïve 😀 日本 \x00\x7f\xa0\xad ÿ"
    assert b"".join(pair.a_bytes[i] for i in pair.a.encode(text, add_special_tokens=False).ids) == text.encode()
    assert not pair.joins and len({x for x in alignment.byte_table().values()}) == 256


def test_awkward_and_empty_tables(spark, pair):
    rows = awkward.rows([(20, "long" * 40000), (21, "no break " * 3), (22, " lead"), (23, "trail ")])
    assert got(alignment.alignments(awkward.frame(spark, [(20, "long" * 40000), (21, "no break " * 3), (22, " lead"), (23, "trail ")]))) == \
        plain(pair, [r[:2] for r in rows])
    assert alignment.alignments(awkward.empty(spark)).collect() == []
