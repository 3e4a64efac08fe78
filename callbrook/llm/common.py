"""Column expressions and small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callbrook.plans import tables

BLANKS = "\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents")


def let(value: Column, body) -> Column:
    """Bind a costly expression once: inside a lambda it would be evaluated per element."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, chars: str) -> Column:
    """Remove single characters; plain replacements stay on bytes and need no regex."""
    for ch in chars:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def spaced(text: Column) -> Column:
    """ASCII white space as single spaces; null as the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for ch in BLANKS:
        text = F.replace(text, F.lit(ch), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """The runs of `[^\\x20\\x09-\\x0D]+` as an array."""
    return F.array_remove(F.split(spaced(text), " "), "")
