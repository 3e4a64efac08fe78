"""Elements to records: splitting, cleaning, sections, diagnostics, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions.text import (
    content_hash, dashed_dates, is_blank, matches_any, stable_id, strip, tidy_whitespace,
)
from callbrook.operators.carry import Running, previous, running, runs
from callbrook.operators.ranking import ranked

SEGMENT = 4096  # consecutive rows of one source handled by one window task


def text_elements(texts: DataFrame, source_id: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Non-empty stripped paragraphs; one starting with ``#`` is a heading."""
    parts = F.filter(F.transform(F.split(F.col(text), _literal(separator)), strip), lambda p: p != "")
    return texts.select(
        F.col(source_id).alias("source_id"), F.posexplode_outer(parts).alias("ord", "text"),
    ).filter("ord IS NOT NULL").select(
        "source_id", F.col("ord").cast("long").alias("ord"), "text",
        F.when(F.col("text").startswith("#"), "heading").otherwise("paragraph").alias("element_type"),
    )


def _literal(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def is_navigation(text: Column | str) -> Column:
    return matches_any(strip(text), v.NAVIGATION_PATTERNS)


def is_footer(text: Column | str) -> Column:
    bare = strip(text)
    return (F.length(bare) < 3) | matches_any(bare, v.FOOTER_PATTERNS)


def removal_reason(text: Column, element_type: Column) -> Column:
    """Why an element is dropped; null keeps it.  Rule order matters."""
    return (
        F.when(element_type == "navigation", "navigation_element")
        .when(element_type.isin("footer", "header") & is_footer(text), "header_footer")
        .when(is_navigation(text), "navigation_content")
        .when((F.length(strip(text)) < 3) & (element_type == "paragraph"), "short_fragment")
    )


def clean_elements(elements: DataFrame, unicode_form: bool = True) -> DataFrame:
    """Flag removals and normalise what stays; rows are kept for the report."""
    reason = removal_reason(F.col("text"), F.col("element_type"))
    tidy = dashed_dates(tidy_whitespace(F.col("text"), unicode_form))
    flagged = elements.withColumn("removal_reason", reason)
    return flagged.withColumn("clean_text", F.when(F.col("removal_reason").isNull(), tidy))


def section_groups(kept: DataFrame) -> DataFrame:
    """Mark runs of equal section names.  A missing name continues the current
    run; text before the first name belongs to an untitled run."""
    out = runs(kept, ["source_id"], ["ord"], F.floor(F.col("ord") / SEGMENT),
               F.nullif(F.col("section"), F.lit("")), lambda before, name: before != name)
    return out.withColumn("section_title", F.coalesce("run_value", F.lit(""))).drop("run_value")


def section_records(kept: DataFrame, text: str = "clean_text") -> DataFrame:
    """One record per section run: texts joined by a blank line, in order."""
    piece = F.struct("ord", F.col(text).alias("t"))
    grouped = section_groups(kept).groupBy("source_id", "run_start").agg(
        F.min("ord").alias("section_start"),
        F.max("section_title").alias("section_title"),
        F.array_sort(F.collect_list(piece)).alias("pieces"),
    )
    records = grouped.select(
        "source_id", "section_start",
        stable_id("kb", "source_id", "section_start").alias("record_id"),
        F.coalesce(F.nullif("section_title", F.lit("")), F.col("source_id").cast("string")).alias("title"),
        F.array_join(F.transform("pieces", lambda p: p["t"]), "\n\n").alias("content"),
        F.transform("pieces", lambda p: p["ord"]).alias("element_ords"),
    )
    return records.filter(~is_blank("content"))


def garbage_chars(text: Column | str) -> Column:
    """Characters neither printable nor white space."""
    c = F.col(text) if isinstance(text, str) else text
    return F.length(c) - F.length(F.regexp_replace(
        c, r"[\p{C}&&[^\u0009-\u000D\u001C-\u001F\u0085]]", ""))


def extraction_diagnostics(elements: DataFrame) -> DataFrame:
    """Per-source quality figures and status.

    Two levels, pages before sources, so no source is gathered in one place;
    elements without a page count only towards the totals.
    """
    seg = F.coalesce(F.col("page_number"), -1 - F.floor(F.col("ord") / SEGMENT))
    page = elements.groupBy("source_id", F.col("page_number"), seg.alias("seg")).agg(
        F.sum(F.length("text")).alias("chars"),
        F.sum(garbage_chars("text")).alias("garbage"),
        F.count("*").alias("elements"),
        F.sum((F.col("element_type") == "table").cast("long")).alias("tables"),
        F.when(F.col("page_number").isNotNull(), F.lower(strip(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("page_number").isNotNull(), F.struct("ord", "text")))),
            lambda p: p["text"]), " ")))).alias("body"),
    )
    body_id = F.when(F.length("body") > 20, F.sha2("body", 256))
    per_source = page.withColumn("body_id", body_id).groupBy("source_id").agg(
        (F.sum("chars") + F.sum("elements") - 1).alias("total_characters"),
        F.sum("garbage").alias("garbage"),
        F.sum("elements").alias("total_elements"),
        F.sum("tables").alias("tables_detected"),
        F.count_distinct("page_number").alias("pages_detected"),
        (F.count("body_id") - F.count_distinct("body_id")).alias("repeated_pages"),
    )
    ratio = F.when(F.col("total_characters") > 0, F.col("garbage") / F.col("total_characters")).otherwise(0.0)
    low = F.col("total_characters") < 50
    status = (
        F.when(F.col("total_characters") == 0, "failed")
        .when(low | (ratio > 0.3) | (F.col("repeated_pages") > 0), "partial")
        .otherwise("success")
    )
    return per_source.withColumn("garbage_ratio", ratio).withColumn("status", status).drop("garbage")


def placed_in_key(df: DataFrame, name: str, key: str, order: Sequence[str]) -> DataFrame:
    """Add ``place``: the segment of full length in which a row lies when all rows are sorted by key and order.  Whatever numbers
    the order has, a key with a third of all rows is cut into as many segments as its rows fill."""
    return ranked(df, name, key, *order).withColumn("place", F.floor(F.col("rank") / SEGMENT)).drop("rank")


def duplicate_sources(sources: DataFrame, order: str = "seq") -> DataFrame:
    """Previous registration of the same bytes (each copy points one back).

    Copies are chained through the segmented scan, so a hash shared by a third
    of all sources is still spread over tasks.
    """
    placed = placed_in_key(sources, "sources", "content_hash", [order])
    return previous(placed, ["content_hash"], [order], F.col("place"), "previous_source_id", F.col("source_id")).drop("place")


def latest_by_hash(sources: DataFrame, order: str = "seq") -> DataFrame:
    return sources.groupBy("content_hash").agg(F.max_by("source_id", order).alias("source_id"))


def processing_report(elements: DataFrame, records: DataFrame) -> DataFrame:
    """Counts per source from flagged elements and finished records."""
    e = elements.groupBy("source_id").agg(
        F.count("*").alias("elements_extracted"),
        F.count_if(F.col("removal_reason").isNull()).alias("elements_cleaned"),
        F.count_if(F.col("removal_reason").isNotNull()).alias("elements_removed"),
        F.count_if(F.col("element_type") == "table").alias("tables_found"),
    )
    r = records.groupBy("source_id").agg(
        F.count("*").alias("records_created"),
        F.sum("pii_count").alias("pii_entities_found"),
        F.count_if(F.col("exact_of").isNotNull()).alias("duplicates_found"),
        F.sum(F.size("flags")).alias("validation_flags"),
    )
    counts = [c for c in r.columns if c != "source_id"]
    return e.join(r, "source_id", "left").select(
        *e.columns, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts])


def ingest_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("total_sources"),
        F.coalesce(F.sum("records_created"), F.lit(0)).alias("total_records"),
        F.count_if(F.col("records_created") == 0).alias("total_errors"),
    )


def exact_duplicate_chain(records: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Previous copy (chain) and first copy (canonical) of equal content; ``order`` is total."""
    placed = placed_in_key(records.withColumn("dup_hash", content_hash("content")), "chain", "dup_hash", order)
    chained = running(placed, ["dup_hash"], list(order), F.col("place"), [
        Running("exact_of", "last", F.col("record_id")),
        Running("__first", "min", F.struct(*order, "record_id")),
    ])
    return chained.withColumn("canonical_id", F.col("__first.record_id")).drop("__first", "place")
