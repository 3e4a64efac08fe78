"""Feature-hashed text vectors and dense dot products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions.text import col, strip, tokens


def slot(token: Column, dim: int = v.EMBED_DIM) -> Column:
    """MD5 of the token modulo ``dim``, from four 32-bit words of the digest.

    ``2**32 % dim`` carries the higher words, so no 128-bit integer is needed.
    """
    digest = F.md5(token.cast("binary"))
    shift = (1 << 32) % dim
    rest = F.lit(0).cast("long")
    for start in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
        rest = (rest * shift + word) % dim
    return rest.cast("int")


def feature_rows(df: DataFrame, key: str, c: Column | str, dim: int = v.EMBED_DIM) -> DataFrame:
    """(key, slot, weight) of a text's unigrams, bigrams and numbers.

    Tokens are exploded before they are hashed, so the digest runs in generated
    code and once per token.
    """
    prepared = df.select(key, strip(F.lower(col(c))).alias("text")).withColumn("toks", tokens("text"))
    n = F.size("toks")
    pairs = F.zip_with(F.slice("toks", 1, n - 1), F.slice("toks", 2, n - 1), lambda a, b: F.concat_ws("_", a, b))
    numbers = F.transform(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)), lambda x: F.concat(F.lit("num_"), x))
    some = prepared.filter(n > 0)
    parts = [
        some.select(key, F.explode_outer("toks").alias("f"), F.lit(v.EMBED_UNIGRAM).alias("w")),
        some.filter(n > 1).select(key, F.explode_outer(pairs).alias("f"), F.lit(v.EMBED_BIGRAM).alias("w")),
        some.select(key, F.explode_outer(numbers).alias("f"), F.lit(v.EMBED_NUMBER).alias("w")),
    ]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return every.filter("f IS NOT NULL").select(key, slot(F.col("f"), dim).alias("slot"), "w") \
        .groupBy(key, "slot").agg(F.sum("w").alias("weight"))


NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"


def dot(a: Column | str, b: Column | str) -> Column:
    """Clipped dot product of two arrays; 0 when the lengths differ."""
    x, y = col(a), col(b)
    total = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                        F.lit(0.0), lambda acc, t: acc + t)
    return F.when((F.size(x) != F.size(y)) | (F.size(x) < 1), 0.0) \
        .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total)))
