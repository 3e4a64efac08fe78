"""Views of the given tables in the shapes the operators expect.

Nothing here is sampled or cut: every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callbrook.functions.text import record_hash


# text tables whose rows cost much more to process than to read
_HEAVY = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, _HEAVY[name]) if name in _HEAVY else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table stored in few splits.  A table that already has
    a split per core, as any large one does, is left alone: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def sql_list(values) -> str:
    return "[" + ", ".join(sql_str(x) for x in values) + "]"


def sql_str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# white space as Python's str.strip sees it, for DuckDB's regex dialect
SQL_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({sql_strip(expr)}, '{SQL_SPACE}+'), lambda w: w <> '')"


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one searchable chunk, titled by its first sentence."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        F.substring_index("text", ".", 1).alias("title"),
        F.col("lang").alias("section"),
        F.col("text").alias("content"),
        F.col("source").alias("source_id"),
        F.col("source").alias("source_name"),
        F.lit(None).cast("int").alias("source_page"),
        F.col("lang").alias("category"),
        F.col("source").alias("product"),
        F.col("lang").alias("language"),
        F.concat(F.lit("1."), (F.col("doc_id") % 3).cast("string")).alias("version"),
        record_hash("text").alias("content_hash"),
        F.create_map(F.lit("market"), F.when(F.col("lang") == "es", "PH").otherwise("ID")).alias("metadata"),
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as finished records, ready to be chunked."""
    c = document_chunks(spark, sf_dir)
    return c.withColumn("record_id", F.concat(F.lit("doc_"), F.col("chunk_id").cast("string"))) \
        .withColumn("subcategory", F.when(F.col("category") == "es", "PH").otherwise("ID")).drop("chunk_id", "metadata")


SQL_CHUNKS = f"""
chunks AS (
  SELECT doc_id AS chunk_id, split_part(text, '.', 1) AS title, lang AS section, text AS content,
         source AS source_id, source AS source_name, lang AS category, source AS product, lang AS language,
         '1.' || CAST(doc_id % 3 AS VARCHAR) AS version,
         sha256(lower({sql_strip('text')})) AS content_hash,
         CASE WHEN lang = 'es' THEN 'PH' ELSE 'ID' END AS market
  FROM documents)"""


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callbrook.operators.search import query_batch
    return query_batch(read(spark, sf_dir, "benchmark"), "item_id", "text")


SQL_QUERIES = f"queries AS (SELECT item_id AS query_id, {sql_strip('text')} AS query FROM benchmark)"
