"""From raw documents to packed training sequences: language, repeated lines, near-duplicates, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callbrook.llm import langid, linededup, mixing, packing, shingles
from callbrook.plans import tables
from callbrook.session import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is quite uncertain, go."""
    return langid.keep_identified(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line passages, however short their lines, are cut out of the texts."""
    out = linededup.dedup_lines(docs, sentences=True, added=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by five-word shingles at a similarity of 0.8 stays."""
    return shingles.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that sources reach their target weights."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths."""
    return packing.pieces(docs)


STAGES = [("language", language), ("repeated_lines", repeated_lines), ("near_duplicates", near_duplicates),
          ("mixture", mixture), ("packed", packed)]

#: Neither the network nor the tokens can be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = written(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
