"""Disagreeing records of one topic, without listing every pair.

Two records conflict when they share product, category and subcategory, come
from different sources, and name different amounts (medium) or carry different
versions (low).  A topic can hold a third of all records, so the number of
partners is counted from group sizes instead of joining the topic with itself:
partners = topic - own source - same value + own source and same value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbrook.functions.quality import amounts

TOPIC = ["product", "category", "subcategory"]


def with_amounts(records: DataFrame, require_digit: bool = False) -> DataFrame:
    found = amounts("content", require_digit)
    return records.withColumn("amounts", F.array_join(found, ";")).withColumn("has_amounts", F.size(found) > 0)


def _partners(records: DataFrame, value: str) -> DataFrame:
    """Records of the same topic, another source and another ``value``.

    Sizes are pre-aggregated to (topic, source, value) before any join; the
    coarser sizes are sums of those few rows.
    """
    fine = records.groupBy(*TOPIC, "source_id", value).agg(F.count("*").alias("n_fine"))
    topic = fine.groupBy(*TOPIC).agg(F.sum("n_fine").alias("n_topic"))
    source = fine.groupBy(*TOPIC, "source_id").agg(F.sum("n_fine").alias("n_source"))
    same = fine.groupBy(*TOPIC, value).agg(F.sum("n_fine").alias("n_value"))
    return fine.join(topic, TOPIC).join(source, [*TOPIC, "source_id"]).join(same, [*TOPIC, value]) \
        .select(*TOPIC, "source_id", value,
                (F.col("n_topic") - F.col("n_source") - F.col("n_value") + F.col("n_fine")).alias("partners"))


def conflict_counts(records: DataFrame, require_digit: bool = False) -> DataFrame:
    """(record_id, amount_conflicts, version_conflicts) of conflicting records."""
    r = with_amounts(records, require_digit).select("record_id", *TOPIC, "source_id", "version", "amounts", "has_amounts")
    by_amount = _partners(r.filter("has_amounts"), "amounts").withColumnRenamed("partners", "amount_conflicts") \
        .withColumn("has_amounts", F.lit(True))
    by_version = _partners(r.filter("version <> ''"), "version").withColumnRenamed("partners", "version_conflicts")
    joined = r.join(by_amount, [*TOPIC, "source_id", "amounts", "has_amounts"], "left") \
        .join(by_version, [*TOPIC, "source_id", "version"], "left")
    out = joined.select("record_id", F.coalesce("amount_conflicts", F.lit(0)).alias("amount_conflicts"),
                        F.coalesce("version_conflicts", F.lit(0)).alias("version_conflicts"))
    return out.filter(F.col("amount_conflicts") + F.col("version_conflicts") > 0)


def conflict_rows(records: DataFrame, require_digit: bool = False) -> DataFrame:
    """One row per record and kind of conflict: what the record says, how many records of its topic say otherwise, and how
    grave that is.  Partners are counted, not listed."""
    counts = conflict_counts(records, require_digit)
    said = with_amounts(records, require_digit).select("record_id", "category", "version", "amounts").join(counts, "record_id")
    kinds = F.array(
        F.struct(F.concat("category", F.lit(".amounts")).alias("field"), F.col("amounts").cast("string").alias("value"), F.lit("medium").alias("severity"),
                 F.col("amount_conflicts").alias("partners")),
        F.struct(F.lit("version").alias("field"), F.col("version").alias("value"), F.lit("low").alias("severity"), F.col("version_conflicts").alias("partners")))
    return said.select("record_id", F.explode(kinds).alias("k")).filter("k.partners > 0").select("record_id", "k.*", F.lit("unresolved").alias("status"))


def conflict_values(records: DataFrame, require_digit: bool = False) -> DataFrame:
    """The disagreeing statements of each topic: any two rows of a topic that
    come from different sources are one conflict, unresolved."""
    r = with_amounts(records, require_digit).filter("has_amounts")
    fine = r.groupBy(*TOPIC, "amounts", "source_id").agg(F.count("*").alias("n"))
    values = fine.groupBy(*TOPIC, "amounts").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_sources"),
                                                 F.min("source_id").alias("first_source"))
    topics = fine.groupBy(*TOPIC).agg(F.count_distinct("amounts").alias("n_values"), F.count_distinct("source_id").alias("all_sources")) \
        .filter("n_values > 1 AND all_sources > 1")
    return values.join(topics.select(*TOPIC), TOPIC)


def conflicts_of(records: DataFrame, wanted: DataFrame, require_digit: bool = False) -> DataFrame:
    """Conflict rows of the given record ids against all others: the two kinds
    with their values and severity.  Grows with ``wanted`` only."""
    r = with_amounts(records, require_digit).select("record_id", *TOPIC, "source_id", "version", "amounts", "has_amounts")
    a = r.join(wanted.select("record_id").distinct(), "record_id", "left_semi").alias("a")
    b = r.alias("b")
    on = (F.col("a.source_id") != F.col("b.source_id"))
    for k in TOPIC:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    pairs = a.join(b, on)
    kinds = F.filter(F.array(
        F.when(F.col("a.has_amounts") & F.col("b.has_amounts") & (F.col("a.amounts") != F.col("b.amounts")), F.struct(
            F.concat(F.col("a.category"), F.lit(".amounts")).alias("field"), F.col("a.amounts").alias("value"),
            F.col("b.amounts").alias("other_value"), F.lit("medium").alias("severity"))),
        F.when((F.col("a.version") != "") & (F.col("b.version") != "") & (F.col("a.version") != F.col("b.version")), F.struct(
            F.lit("version").alias("field"), F.col("a.version").alias("value"),
            F.col("b.version").alias("other_value"), F.lit("low").alias("severity"))),
    ), lambda k: k.isNotNull())
    return pairs.select(F.col("a.record_id").alias("record_id"), F.col("b.record_id").alias("other_id"), F.explode_outer(kinds).alias("k")).filter("k IS NOT NULL") \
        .select("record_id", "other_id", "k.*", F.lit("unresolved").alias("status"))
