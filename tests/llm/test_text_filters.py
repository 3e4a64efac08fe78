"""Language, quality, license and line operators on awkward rows and against brute force."""

import random
import re
from collections import Counter

import awkward
import numpy as np
import pytest
from pyspark.sql import functions as F

from callbrook.llm import langid, licenses, linededup, quality


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(spark):
    got = langid.identify(awkward.frame(spark)).collect()
    assert len(got) == len(awkward.rows())
    for r in got:
        if r.doc_id in (1, 2, 3, 11):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.identify(awkward.empty(spark)).collect() == []
    kept = langid.keep_identified(awkward.frame(spark))
    assert kept.columns == awkward.frame(spark).columns


def test_language_gradient():
    rng = np.random.default_rng(0)
    x = np.zeros((60, langid.WINDOW), np.uint8)
    y = np.arange(60) % 2
    for k in range(60):
        letters = (b"abc", b"xyz")[y[k]]
        x[k] = rng.choice(np.frombuffer(letters, np.uint8), langid.WINDOW)
    net = langid.Network(["p", "q"]).train(x, y, steps=100)
    assert (net.probabilities(x).argmax(1) == y).all()
    one = net.of_texts(np.frombuffer(b"abcabc" * 200, np.uint8), np.array([0, 6, 6, 1200]))
    assert one[0].argmax() == 0 and one[2].argmax() == 0


def plain_repeats(text):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    return len({p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 8)})


def test_base_counts(spark):
    r = random.Random(2)
    more = [(100 + k, " ".join(r.choice("abc") for _ in range(r.randint(0, 400))).replace(" a ", r.choice((" \n", " a\t", "\n\n")))) for k in range(30)]
    docs = awkward.frame(spark, more)
    got = {(x.doc_id, x.h): x for x in quality.measure(docs.withColumn("h", F.xxhash64("text"))).collect()}
    for i, t, *_ in awkward.rows(more):
        if i is None:
            continue
        x = next(v for (d, _), v in got.items() if d == i)
        w = re.findall("[^\x20\x09-\x0D]+", t or "")
        lines = [y for y in (t or "").split("\n") if re.search("[^\x20\x09-\x0D]", y)]
        assert (x.n_words if isinstance(x.n_words, int) else int(x.n_words)) == len(w)
        assert x.word_chars == sum(map(len, w))
        assert x.n_dup_lines == len(lines) - len(set(lines))
        assert x.n_repeat_words == plain_repeats(t)


def test_fences_follow_the_source(spark):
    """Symbols that are common in one source are out of place in the other; the same text changes verdict with the source."""
    r = random.Random(8)

    def text(low, high):
        return " ".join("w%d" % r.randint(0, 999) for _ in range(99)) + " " + "#" * r.randint(low, high)

    def plain():
        return text(1, 3)

    def many():
        return text(40, 60)

    rows = [(k, plain(), "en", "calm") for k in range(300)] + [(1000 + k, many(), "en", "loud") for k in range(300)]
    odd = many()
    for source, want in (("calm", {5000: False}), ("loud", {5000: True})):
        docs = spark.createDataFrame([*rows, (5000, odd, "en", source)], "doc_id long, text string, lang string, source string")
        assert {x.doc_id: x.kept for x in quality.judge(docs).filter("doc_id >= 5000").collect()} == want, source


def test_quality_verdicts(spark):
    got = quality.judge(awkward.frame(spark)).collect()
    assert len(got) == len(awkward.rows())
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.judge(awkward.empty(spark)).collect() == []
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(500)]
    clean = [(1000 + k, " ".join(r.choice(words) for _ in range(80))) for k in range(400)]
    junk = [(5000 + k, " ".join(r.choice(words) + "###" for _ in range(80))) for k in range(8)]
    verdict = {x.doc_id: x.kept for x in quality.judge(awkward.frame(spark, clean + junk)).collect()}
    assert np.mean([verdict[i] for i, _ in clean]) > 0.99 and not any(verdict[i] for i, _ in junk)


@pytest.mark.parametrize("v", [0, 1, 31, 32, 63, 64, 1000, 123456, 10 ** 9])
def test_sketch_buckets_keep_five_bits(spark, v):
    b = spark.range(1).select(quality.bucket(F.lit(v)).alias("b")).first().b
    assert b.top << b.cut <= v < (b.top + 1) << b.cut and (b.cut == 0 or b.top >= 32)


def test_license_spans(spark):
    texts = ["Released under the MIT License. Released, under the (mit) license!", "MIT\nlicense; mit license apache license", None, "",
             "Permission is hereby kindly granted, free of charge, to any person obtaining a copy of this software and associated files",
             "cc by-nc", "mit K license CC BY", "All rights reserved.", "all the rights reserved"]
    docs = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in enumerate(texts)], "doc_id long, text string, label string, place int, h string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[k].n_base for k in range(9)] == [2, 3, 0, 0, 0, 1, 1, 0, 0]
    assert (got[0].first_word, got[0].last_word, got[0].base_labels, got[0].labels) == (3, 8, "mit", "mit")
    assert got[1].base_labels == "apache,mit" and got[1].score == 1.0
    assert (got[4].base_labels, got[4].labels) == ("", "mit") and 0.7 <= got[4].score < 1
    assert got[6].n_words == 5 and got[6].first_word == 3
    assert got[7].labels == "proprietary" and got[8].labels == "" and got[3].n_words == 0 and got[2].first_word is None
    same = licenses.scan(awkward.frame(spark))
    assert same.count() == len(awkward.rows()) and licenses.scan(awkward.empty(spark)).collect() == []


def plain_dedup(docs, sentences=True):
    seen, out = {}, {}
    blanks = " \t\n\x0b\x0c\r"
    for i, t in sorted(docs.items(), key=lambda x: (x[0] is not None, x[0] or 0)):
        if t is None:
            out[i] = (None, 0)
            continue
        parts = re.split("(?<=\n)|(?<=[.!?] )" if sentences else "(?<=\n)", t)
        parts = parts[:-1] if parts and parts[-1] == "" and len(parts) > 1 else parts
        lines = [(k, p.strip(blanks)) for k, p in enumerate(parts) if p.strip(blanks)]
        gone = set()
        for j in range(len(lines) - 2):
            key = tuple(x for _, x in lines[j:j + 3])
            if seen.setdefault(key, (i, j)) != (i, j):
                gone |= set(range(lines[j][0], lines[j + 2][0] + 1))
        out[i] = ("".join(p for k, p in enumerate(parts) if k not in gone), len(gone))
    return out


@pytest.mark.parametrize("sentences", [True, False])
def test_lines_against_brute_force(spark, sentences):
    r = random.Random(5)
    sentences = [" ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.randint(2, 8))) + r.choice(".!?") for _ in range(25)]
    more = [(100 + k, "".join(r.choice(sentences) + r.choice((" ", "\n", "\n \n")) for _ in range(r.randint(0, 60)))) for k in range(40)]
    docs = awkward.frame(spark, more)
    got = linededup.dedup_lines(docs, sentences=sentences)
    assert got.columns == [c for c in docs.columns if c != "n_removed"] + ["n_removed"]
    want = plain_dedup({i: t for i, t, *_ in awkward.rows(more) if i is not None}, sentences)
    rows = got.collect()
    assert len(rows) == docs.count()
    for x in rows:
        if x.doc_id is not None:
            text, n = want[x.doc_id]
            assert (x.text, x.n_removed > 0) == (text, n > 0), x.doc_id
    assert linededup.dedup_lines(docs, added=False).columns == docs.columns
    assert linededup.dedup_lines(awkward.empty(spark)).collect() == []
