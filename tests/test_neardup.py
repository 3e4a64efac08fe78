"""Near duplicates against brute force over every pair."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from callbrook.operators import neardup as nd


def fixture_texts():
    rng = random.Random(7)
    words = ["loan", "rate", "bank", "monthly", "revenue", "policy", "tenor", "quote", "zebra", "xylem", "cicilan", "jury"]
    base = [" ".join(rng.choice(words) for _ in range(k)) for k in (1, 2, 3, 5, 8, 20, 40, 41, 90, 200, 320)]
    texts = list(base)
    for b in base:
        for edits in (1, 2, max(1, len(b) // 30), max(1, len(b) // 12)):
            chars = list(b)
            for _ in range(edits):
                i = rng.randrange(len(chars))
                action = rng.choice("rdi")
                if action == "r":
                    chars[i] = rng.choice("abcdefghijklmnopqrstuvwxyz ")
                elif action == "d" and len(chars) > 1:
                    del chars[i]
                else:
                    chars.insert(i, rng.choice("aeiou"))
            texts.append("".join(chars))
    texts += ["a" * 250, "a" * 240 + "b" * 20, "ab" * 150, "ab" * 149 + "ba", "", "x", "xy", "same", "SAME ", base[6].upper()]
    texts += ["common start " * 30 + "q", "common start " * 30 + "z end"]
    rng.shuffle(texts)
    return texts


def brute_force(texts, t):
    norm = [" ".join(x.lower().split()) for x in texts]
    first = {}
    for i, x in enumerate(norm):
        first.setdefault(x, i)
    edges, counts = {}, {}
    for i, x in enumerate(norm):
        for j in range(i):
            if norm[j] == x:
                continue
            r = SequenceMatcher(None, x, norm[j]).ratio()
            if r >= t:
                edges[(first[x], first[norm[j]])] = round(r, 4)
                counts[i] = counts.get(i, 0) + 1
    return edges, counts


def test_complete_against_brute_force(spark):
    texts = fixture_texts()
    df = spark.createDataFrame([(f"r{i}", i, x) for i, x in enumerate(texts)], "record_id string, seq long, content string")
    for t in (0.90, 0.75):
        want, counts = brute_force(texts, t)
        edges = nd.near_contents(df, t)
        got = {(r["new_cid"], r["earlier_cid"]): r["similarity"] for r in edges.collect()}
        assert got == want
        assert len(want) > 20
        found = {int(r["record_id"][1:]): r["near_matches"] for r in nd.near_counts(df, edges).collect()}
        assert found == counts


def test_complete_on_documents(spark, sf):
    """Every document of the smallest table with its own edited copies."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    edited = d.select((F.col("doc_id") + 1000).alias("doc_id"), F.regexp_replace("text", "tion", "sion").alias("text"))
    both = d.unionAll(edited).filter(F.length("text") < 600)
    rows = sorted((r["doc_id"], r["text"]) for r in both.collect())
    want, _ = brute_force([x for _, x in rows], 0.9)
    df = spark.createDataFrame([(f"r{i}", i, x) for i, (_, x) in enumerate(rows)], "record_id string, seq long, content string")
    got = {(r["new_cid"], r["earlier_cid"]): r["similarity"] for r in nd.near_contents(df).collect()}
    assert got == want and want


def test_direction_and_kind(spark):
    pairs = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("Same  text", "same text"), ("", "x")], "a string, b string")
    got = [(r["similarity"], r["duplicate_type"]) for r in nd.compare_pairs(pairs).collect()]
    assert got == [(0.25, None), (0.5, None), (1.0, "exact"), (0.0, None)]


def test_duplicate_of(spark):
    texts = ["The quick brown fox jumps over", "the quick  brown fox jumps over", "The quick brown fox jumped over", "unrelated text here"]
    df = spark.createDataFrame([(f"r{i}", i, x) for i, x in enumerate(texts)], "record_id string, seq long, content string")
    out = {r["record_id"]: r["duplicate_of"] for r in nd.duplicate_of(df, nd.near_contents(df)).collect()}
    assert out == {"r1": "r0", "r2": "r0"}


def test_targets_of_long_texts(spark, monkeypatch):
    """The earliest near match of long texts, without a visit to every character for each block."""
    class Unused(SequenceMatcher):
        def find_longest_match(self, *ranges):
            raise AssertionError("every character is visited")
    texts = [x for x in long_texts()[:15] if len(x) > 200]
    want = {}
    for i, x in enumerate(texts):
        near = [j for j in range(i) if x == texts[j] or SequenceMatcher(None, x, texts[j]).ratio() >= 0.9]
        same = [j for j in near if texts[j] == x]
        if near:
            want[f"r{i}"] = f"r{same[-1] if same else near[0]}"
    assert len(want) >= 5
    df = spark.createDataFrame([(f"r{i}", i, x) for i, x in enumerate(texts)], "record_id string, seq long, content string")
    out = nd.duplicate_of(df, nd.near_contents(df))
    assert {r["record_id"]: r["duplicate_of"] for r in out.collect()} == want
    monkeypatch.setattr(nd, "SequenceMatcher", Unused)
    assert all(nd.ratio_if_near(x, y, 0.9) is None or x == y or SequenceMatcher(None, x, y).ratio() >= 0.9 for x in texts for y in texts)


def test_small_tiles_lose_no_pair(spark, monkeypatch):
    texts = fixture_texts()
    df = spark.createDataFrame([(f"r{i}", i, x) for i, x in enumerate(texts)], "record_id string, seq long, content string")
    monkeypatch.setattr(nd, "TILE_ROWS", 3)
    for t in (0.90, 0.75):
        got = {(r["new_cid"], r["earlier_cid"]): r["similarity"] for r in nd.near_contents(df, t).collect()}
        assert got == brute_force(texts, t)[0]


def test_few_texts_are_compared(spark, monkeypatch):
    """Candidates grow with the near pairs, not with all pairs of a length."""
    rows, write = {}, nd.written

    def counted(df, name, *more):
        out = write(df, name, *more)
        rows[name] = out.count()
        return out
    monkeypatch.setattr(nd, "written", counted)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    df = d.select(F.col("doc_id").cast("string").alias("record_id"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))
    assert nd.near_contents(df).count() > 0
    assert rows["candidates"] < d.count() / 10


def test_ratio_equals_the_library():
    texts = [x for x in (" ".join(t.lower().split()) for t in fixture_texts()) if x]
    for a in texts[::2]:
        for b in texts:
            for t in (0.9, 0.75):
                r = SequenceMatcher(None, a, b).ratio()
                assert nd.ratio_if_near(a, b, t) == (r if r >= t else None)


def long_texts():
    """Texts above 200 characters: with few rare ones, in rows of them, with none, all of them rare, and very frequent in one only."""
    rng = random.Random(11)
    words = ["thand", "onere", "atthe", "hest", "inge", "kyq", "zqx", "vjk.", "erenan", "tion", "w", "bq,"]
    base = [" ".join(rng.choices(words, [9, 9, 9, 9, 9, 1, 1, 1, 9, 9, 2, 1], k=k)) for k in (60, 80, 300)]
    base += ["whnt " * 60, "".join(chr(0x4E00 + rng.randrange(400)) for _ in range(240)), "kyqzqx" * 40 + " onere" * 10]
    texts = []
    for b in base:
        for share in (0, 0.01, 0.03, 0.1):
            parts = b.split(" ") if " " in b else list(b)
            for _ in range(int(share * len(parts)) + (share > 0)):
                i = rng.randrange(len(parts))
                parts[i:i + rng.randrange(3)] = rng.choices([*words, "]", "^-", "\\"], k=rng.randrange(3))
            texts.append((" " if " " in b else "").join(parts))
        texts.append(b[len(b) // 20:] + b[:len(b) // 20])
    return texts


def test_long_texts_equal_the_library():
    texts, near = long_texts(), 0
    texts += [x[:n] for x in (texts[0], texts[2]) for n in (196, 199, 200, 203)]  # characters are frequent from 200 on
    for a in texts:
        for b in texts:
            r = SequenceMatcher(None, a, b).ratio()
            near += r >= 0.75
            for t in (0.9, 0.75, 0.3):
                assert nd.ratio_if_near(a, b, t) == (r if r >= t else None)
    assert near > 2 * len(texts)


def test_long_texts_are_not_read_through_for_each_block(monkeypatch):
    """Blocks of long texts are sought at their rare characters, with equal ratios."""
    texts = [x for x in long_texts()[:15] if len(x) > 200]
    want = {(a, b): r for a in texts for b in texts if (r := SequenceMatcher(None, a, b).ratio()) >= 0.9}
    assert len(want) > len(texts)

    class Unused(SequenceMatcher):
        def find_longest_match(self, *ranges):
            raise AssertionError("every character is visited")
    monkeypatch.setattr(nd, "SequenceMatcher", Unused)
    assert {(a, b): r for a in texts for b in texts if (r := nd.ratio_if_near(a, b, 0.9)) is not None} == want


def test_a_text_moves_once_to_a_bin(spark, monkeypatch):
    """Pairs of a group of similar texts meet in few bins, whatever the number of pairs, and none is lost."""
    monkeypatch.setattr(nd, "SIDE", 8)
    n = 60
    docs = spark.createDataFrame([(k, 100) for k in range(n)], "cid long, n long")
    pairs = spark.createDataFrame([(b, a) for a in range(n) for b in range(a + 1, n)], "new_cid long, earlier_cid long")
    out = nd.binned(pairs, docs)
    rows = out.collect()
    assert sorted((r["new_cid"], r["earlier_cid"]) for r in rows) == sorted((b, a) for a in range(n) for b in range(a + 1, n))
    assert len({(r["bin"], c) for r in rows for c in (r["new_cid"], r["earlier_cid"])}) < len(rows) / 2
