"""Directory scans, text, CSV and JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callbrook import fixed_values as v
from callbrook.functions.text import col, stable_id

KB_RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()), T.StructField("product", T.StringType()),
    T.StructField("source_id", T.StringType()), T.StructField("source_name", T.StringType()),
    T.StructField("source_type", T.StringType()), T.StructField("source_page", T.IntegerType()),
    T.StructField("version", T.StringType()), T.StructField("effective_from", T.StringType()),
    T.StructField("effective_to", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("pii", T.BooleanType()), T.StructField("section", T.StringType()),
    T.StructField("content_hash", T.StringType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()), T.StructField("parent_document_id", T.StringType()),
    T.StructField("element_ids", T.ArrayType(T.StringType())),
    T.StructField("table_ids", T.ArrayType(T.StringType())),
    T.StructField("duplicate_of", T.StringType()),
    T.StructField("validation_flags", T.ArrayType(T.StringType())),
])


def source_type(path: Column | str) -> Column:
    """Type from the lower-cased extension, ``unknown`` when not listed."""
    ext = F.lower(F.regexp_extract(col(path), r"(\.[^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in v.SOURCE_TYPE_BY_EXTENSION.items() for x in kv])
    return F.coalesce(F.try_element_at(known, ext), F.lit("unknown"))


def scan_directory(spark: SparkSession, directory: str, extensions=tuple(v.SOURCE_TYPE_BY_EXTENSION)) -> DataFrame:
    """All files of the listed types as rows of bytes, in no particular order."""
    globs = ",".join(f"*{e},*{e.upper()}" for e in extensions)
    files = (spark.read.format("binaryFile")
             .option("pathGlobFilter", "{" + globs + "}").load(directory))
    return files.withColumn("filename", F.element_at(F.split("path", "/"), -1))


def register_sources(files: DataFrame) -> DataFrame:
    """Identity, type and extraction method of each file; the bytes stay lazy."""
    kind = source_type("filename")
    return files.select(
        stable_id("src", "path").alias("source_id"),
        "filename",
        kind.alias("source_type"),
        F.col("path").alias("uri"),
        F.sha2(F.col("content"), 256).alias("content_hash"),
        F.concat(F.lit("native_"), kind).alias("extraction_method"),
        F.decode("content", "UTF-8").alias("text"),
    )


def csv_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row; give a schema to keep types and skip inference."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def table_text(columns: Column, rows: Column, caption: Column | None = None) -> Column:
    """Readable rendering of a table: header, rule, one line per row."""
    header = F.array_join(columns, " | ")
    lines = F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Table: "), F.nullif(caption, F.lit(""))) if caption is not None else F.lit(None),
        header,
        F.repeat(F.lit("-"), F.length(header)),
        F.when(F.size(rows) > 0, lines),
    )


def csv_table_text(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One table element per key from rows in ``order`` (a CSV file is one key)."""
    row = F.struct(F.col(order).alias("o"),
                   F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda s: s["r"])
    grouped = df.groupBy(*keys).agg(rows.alias("rows"))
    names = F.array(*[F.lit(c) for c in columns])
    return grouped.select(*keys, table_text(names, F.col("rows")).alias("text"),
                          F.size("rows").cast("long").alias("n_rows"))


def read_records(spark: SparkSession, path: str, schema: T.StructType = KB_RECORD, lines: bool = False) -> DataFrame:
    """Files of one JSON array each, or of one record per line, which Spark can split; a missing path gives no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_records(records: DataFrame, path: str, partition_by: tuple[str, ...] = ("language",)) -> None:
    records.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def union_records(*frames: DataFrame) -> DataFrame:
    """Base and localized records together; missing columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
