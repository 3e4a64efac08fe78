"""Rule and topic signals of call transcripts, in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions.text import contains_any, first_match, strip, words

SEGMENT_SECONDS = 3600.0
ORDER = ["timestamp", "is_final", "chunk_sequence"]


def partial_events(turns: DataFrame) -> DataFrame:
    """The early half-length guess of each utterance (at least one word)."""
    w = words("text")
    n = F.greatest(F.lit(1), F.floor(F.size(w) / 2).cast("int"))
    return turns.withColumn("text", F.array_join(F.slice(w, 1, n), " ")) \
        .withColumn("confidence", F.round(F.col("confidence") * 0.9, 2)) \
        .withColumn("is_final", F.lit(False))


def transcript_events(turns: DataFrame, chunk_ms: float = 500.0) -> DataFrame:
    """Planned utterances as a partial event followed by its final one."""
    finals = turns.withColumn("timestamp", F.col("timestamp") + chunk_ms / 1000.0 * 0.5) \
        .withColumn("is_final", F.lit(True))
    return partial_events(turns).unionByName(finals)


def usable_events(events: DataFrame, min_words: int = v.PARTIAL_MIN_WORDS) -> DataFrame:
    """Drop blank events, and partial ones too short to mean anything."""
    e = events.withColumn("text", strip("text")).filter("text <> ''")
    return e.filter(F.col("is_final") | (F.size(words("text")) >= min_words))


def topic_of(text: Column | str, topics=v.TOPIC_KEYWORDS) -> Column:
    """First topic whose keyword list occurs as a substring, else null."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.when(contains_any(low, topics[0][1]), topics[0][0])
    for name, keywords in topics[1:]:
        out = out.when(contains_any(low, keywords), name)
    return out


def rule_hits(text: Column, speaker: Column, disclosed: Column, rules: Sequence = v.SIGNAL_RULES) -> Column:
    """Array of matched rules as structs, in rule order."""
    found = []
    for i, (name, kind, confidence, severity, who, needs_disclosure, patterns) in enumerate(rules):
        allowed = F.lit(True)
        if who:
            allowed = allowed & (speaker == who)
        if needs_disclosure:
            allowed = allowed & ~disclosed
        evidence = F.when(allowed, first_match(text, patterns))
        found.append(F.when(evidence.isNotNull(), F.struct(
            F.lit(i).alias("rule_order"), F.lit(kind).alias("signal_type"), F.lit(name).alias("rule_name"),
            F.lit(confidence).alias("confidence"), F.lit(severity).alias("severity"),
            evidence.alias("evidence"), F.lit("rule").alias("source"),
            F.lit(None).cast("string").alias("new_topic"))))
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def event_context(events: DataFrame, context_turns: int = v.CONTEXT_TURNS) -> DataFrame:
    """Add ``disclosed`` (within the last final turns) and ``last_topic``.

    One segmented pass (see ``carry``): counts, topic and the final-turn number
    of the last disclosure run inside (session, segment); segment summaries
    bring what happened before.
    """
    inside = Window.partitionBy("session_id", "__seg").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    final = F.col("is_final")
    local = events.withColumn("topic", F.when(final, topic_of("text"))) \
        .withColumn("__seg", F.floor(F.col("timestamp") / SEGMENT_SECONDS)) \
        .withColumn("__n", F.coalesce(F.sum(final.cast("long")).over(inside), F.lit(0))) \
        .withColumn("__told", F.when(final & F.col("text").rlike("(?iuU)" + v.DISCLOSURE_PATTERN), F.col("__n") + 1))
    rows = local.withColumn("__topic", F.last("topic", ignorenulls=True).over(inside)) \
        .withColumn("__told_before", F.max("__told").over(inside))

    summary = local.groupBy("session_id", "__seg").agg(
        F.sum(final.cast("long")).alias("__s_n"), F.max("__told").alias("__s_told"),
        F.max_by("topic", F.when(F.col("topic").isNotNull(), F.struct(*ORDER))).alias("__s_topic"))
    earlier = Window.partitionBy("session_id").orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    handed = summary.withColumn("__c_n", F.coalesce(F.sum("__s_n").over(earlier), F.lit(0))) \
        .withColumn("__c_topic", F.last("__s_topic", ignorenulls=True).over(earlier)) \
        .withColumn("__c_told", F.max(F.col("__c_n") + F.col("__s_told")).over(earlier)) \
        .select("session_id", "__seg", "__c_n", "__c_topic", "__c_told")
    told_at = F.greatest(F.col("__c_told"), F.col("__c_n") + F.col("__told_before"))
    return rows.join(handed, ["session_id", "__seg"]).select(
        *[F.col(c) for c in events.columns], "topic",
        F.coalesce(told_at > F.col("__c_n") + F.col("__n") - context_turns, F.lit(False)).alias("disclosed"),
        F.coalesce("__topic", "__c_topic", F.lit(v.FIRST_TOPIC)).alias("last_topic"))


def detect_signals(events: DataFrame, rules: Sequence = v.SIGNAL_RULES, context_turns: int = v.CONTEXT_TURNS) -> DataFrame:
    """One row per signal.  Rules see partial and final events, topics only finals."""
    e = event_context(usable_events(events), context_turns)
    hits = rule_hits(F.col("text"), F.col("speaker"), F.col("disclosed"), rules)
    shifted = F.col("topic").isNotNull() & (F.col("topic") != F.col("last_topic"))
    shift = F.when(shifted, F.array(F.struct(
        F.lit(len(rules)).alias("rule_order"), F.lit("topic_shift").alias("signal_type"),
        F.lit(None).cast("string").alias("rule_name"), F.lit(v.TOPIC_CONFIDENCE).alias("confidence"),
        F.lit("low").alias("severity"),
        F.concat(F.lit("Shifted from "), F.col("last_topic"), F.lit(" to "), F.col("topic")).alias("evidence"),
        F.lit("semantic").alias("source"), F.col("topic").alias("new_topic")))).otherwise(F.array())
    out = e.select("session_id", "chunk_sequence", "timestamp", "is_final", "speaker",
                   F.explode_outer(F.concat(hits, shift)).alias("s")).filter("s IS NOT NULL")
    return out.select("session_id", "chunk_sequence", "timestamp", "is_final", "speaker", "s.*") \
        .withColumn("signal_id", F.concat_ws("_", F.lit("sig"), F.coalesce("rule_name", F.lit("topic")),
                                             F.floor(F.col("timestamp") * 1000).cast("string")))
