"""Repeated passages of short lines go, in the pipeline stage, against brute force without a floor."""

import corpus_pipeline
from test_text_filters import plain_dedup


def test_stage_removes_repeated_short_lines(spark):
    menu = "".join(f"No. {k}\n" for k in range(60))
    texts = {1: "Own words come first here.\n" + menu, 2: menu + "Other words come last here.\n", 3: "a\nb\n", 4: None}
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in texts.items()], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_lines(spark, docs, "").collect()}
    want = plain_dedup(texts)
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in want.items()}
    assert got[2] == ("Other words come last here.\n", 28)


def test_stage_on_given_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_lines(spark, docs, "").select("doc_id", "text").collect()}
    assert got == {i: t for i, (t, _) in plain_dedup(texts).items()}
