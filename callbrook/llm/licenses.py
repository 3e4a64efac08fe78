"""License scan by diagonal voting.

Every rolling k-word gram of a text is joined by its hash to the positions at which the templates hold it.  Matches of one document
and template vote for the offset between both positions, their diagonal; diagonals at most ``gap`` apart, as a word put in or left
out makes them, are merged; a merged group is accepted if it covers enough of the template.  Grams are compared as text after the
hash join, so a shared hash alone never counts.

Defined results: a null text is the empty text; texts shorter than a gram vote for nothing; a template that occurs twice gives two
spans; repeated rows (same id and text) get the same result each; null ids are allowed; an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbrook.llm.common import let

#: The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices by which authors put a work under a licence.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved"),
)
GRAM, GAP, COVER = 3, 2, 0.7


def license_words(text: Column) -> Column:
    """Lower-cased words.  Two letters whose lower case is ASCII although they are not are put aside first."""
    t = F.lower(F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ſ")), F.lit("İ"), F.lit("ı")))
    return F.array_remove(F.split(t, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _grams(w: Column, k: int) -> Column:
    """(place, text) of every k words in a row."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(
        i.cast("long").alias("place"), F.concat_ws(" ", *(F.get(w, i + j) for j in range(k))).alias("gram")))
    return F.when(F.size(w) >= k, each)


def template_grams(spark, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    rows = [(n, label, text, len(text.split()) - k + 1) for n, (label, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "template int, label string, text string, grams int")
    return t.withColumn("g", F.explode(_grams(F.split("text", " "), k))) \
        .select("template", "label", "grams", F.col("g.place").alias("t_place"), F.col("g.gram").alias("t_gram"), F.xxhash64("g.gram").alias("h"))


def spans(docs: DataFrame, templates=TEMPLATES, k: int = GRAM, gap: int = GAP, cover: float = COVER, text: str = "text",
          id_col: str = "doc_id") -> DataFrame:
    """``id, content, label, first, last, covered``: the accepted spans, in words; ``content`` is the text's hash."""
    grams = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), F.explode_outer(let(license_words(F.col(text)), lambda w: _grams(w, k))).alias("g")) \
        .select("id", "content", F.col("g.place").alias("place"), F.col("g.gram").alias("gram"), F.xxhash64("g.gram").alias("h"))
    # the templates are a fixed list of some hundred positions
    votes = grams.join(F.broadcast(template_grams(docs.sparkSession, templates, k)), "h").filter(F.col("gram") == F.col("t_gram"))
    diagonals = votes.groupBy("id", "content", "template", "label", "grams", (F.col("place") - F.col("t_place")).alias("diagonal")) \
        .agg(F.collect_set("t_place").alias("seen"), F.min("place").alias("first"), F.max("place").alias("last"))
    by = "partition by id, content, template order by diagonal"
    group = diagonals.withColumn("new", F.expr(f"coalesce(diagonal - lag(diagonal) over ({by}) > {gap}, true)")) \
        .withColumn("run", F.expr(f"count_if(new) over ({by})"))
    merged = group.groupBy("id", "content", "template", "label", "grams", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"), F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.withColumn("covered", F.col("seen") / F.col("grams")).filter(F.col("covered") >= cover) \
        .select("id", "content", "label", "first", (F.col("last") + k - 1).alias("last"), "covered")


def _phrase_places(w: Column, phrase: str, label: str) -> Column:
    p = phrase.split()

    def starts(i: Column) -> Column:
        same = [F.coalesce(F.get(w, i + j) == x, F.lit(False)) for j, x in enumerate(p)]
        return reduce(and_, same)

    where = F.filter(F.sequence(F.lit(0), F.size(w) - len(p)), starts)
    found = F.transform(where, lambda i: F.struct(i.cast("long").alias("place"), F.lit(label).alias("label")))
    held = reduce(and_, (F.array_contains(w, x) for x in p))  # most texts hold none of the words
    return F.when((F.size(w) >= len(p)) & held, found).otherwise(F.array().cast("array<struct<place:bigint,label:string>>"))


def _places(w: Column, phrases) -> Column:
    """(place, label) of every base phrase."""
    return F.concat(*(_phrase_places(w, phrase, label) for phrase, label in phrases))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = GRAM, gap: int = GAP, cover: float = COVER,
         text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document."""
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), let(license_words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _places(w, phrases).alias("places"))).alias("b"))
    found = spans(docs, templates, k, gap, cover, text, id_col).groupBy("id", "content") \
        .agg(F.collect_set("label").alias("found"), F.max("covered").alias("covered")) \
        .select(F.col("id").alias("f_id"), F.col("content").alias("f_content"), "found", "covered")
    places, labels = F.col("b.places.place"), F.array_distinct("b.places.label")
    none = F.array().cast("array<string>")
    return base.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("content") == F.col("f_content")), "left").select(
        F.col("id").alias("doc_id"), F.col("b.n_words").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce("covered", F.lit(0.0))).alias("score"))
