"""Which signals become nudges.

The decision is a fold: whether a signal is shown depends on the last one that
was.  Two facts keep it parallel.  State never crosses signal types, and a
signal arriving a full window after the one before it always finds clean state,
so each (session, type) falls into islands that are folded independently.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.operators.carry import runs


@dataclass(frozen=True)
class NudgePolicy:
    min_confidence: float = v.NUDGE_MIN_CONFIDENCE
    high_confidence: float = v.NUDGE_HIGH_CONFIDENCE
    cooldown: float = v.NUDGE_COOLDOWN
    compliance_cooldown: float = v.NUDGE_COMPLIANCE_COOLDOWN
    expiry: float = v.NUDGE_EXPIRY

    def cooldown_of(self, signal_type: str) -> float:
        return self.compliance_cooldown if signal_type == "compliance_gap" else self.cooldown

    @property
    def reach(self) -> float:
        """No decision looks further back than this."""
        return max(self.expiry, self.cooldown, self.compliance_cooldown)


def decide(policy: NudgePolicy, state: dict, signal_type: str, rule: str, confidence: float, now: float) -> str:
    """One step of the fold.  ``state`` holds ``until`` and the last emission
    per rule; it is updated when the answer is ``emitted``."""
    if confidence < policy.min_confidence:
        return "low_confidence"
    if state.get("until", float("-inf")) > now:
        return "active_duplicate"
    last = state.get(rule)
    if last is not None and now - last < policy.cooldown_of(signal_type):
        return "cooldown"
    state["until"] = now + policy.expiry
    state[rule] = now
    return "emitted"


def signal_islands(signals: DataFrame, reach: float, segment_seconds: float = 3600.0) -> DataFrame:
    """Add ``island``: the key of the signal that follows a gap of ``reach``."""
    order = ["timestamp", "is_final", "chunk_sequence", "rule_order"]
    return runs(signals, ["session_id", "signal_type"], order, F.floor(F.col("timestamp") / segment_seconds),
                F.col("timestamp"), lambda before, now: now - before >= reach) \
        .withColumnRenamed("run_start", "island").drop("run_value")


def nudge_decisions(signals: DataFrame, policy: NudgePolicy = NudgePolicy(), segment_seconds: float = 3600.0) -> DataFrame:
    """Every signal with its decision.

    Islands are spread over tasks and read as sorted batches; a task keeps the
    state of one island at a time, however many signals it has.
    """
    keyed = signal_islands(signals, policy.reach, segment_seconds) \
        .withColumn("__rule", F.coalesce("rule_name", "signal_type")) \
        .withColumn("island", F.xxhash64("session_id", "signal_type", "island"))
    spread = keyed.repartition("island") \
        .sortWithinPartitions("island", "session_id", "signal_type", "timestamp", "is_final", "chunk_sequence", "rule_order")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, {}
        for pdf in batches:
            decisions = []
            for session, kind, island, rule, confidence, now in zip(
                    pdf["session_id"], pdf["signal_type"], pdf["island"], pdf["__rule"], pdf["confidence"], pdf["timestamp"]):
                if (session, kind, island) != current:
                    current, state = (session, kind, island), {}
                decisions.append(decide(policy, state, kind, rule, confidence, now))
            yield pdf.assign(decision=decisions)

    decided = spread.mapInPandas(fold, spread.schema.simpleString()[7:-1] + ",decision:string")
    priority, message = nudge_content(policy)
    emitted = F.col("decision") == "emitted"
    return decided.drop("__rule", "island").select(
        "*", F.when(emitted, priority).when(F.col("decision") == "low_confidence", F.lit("LOW")).alias("priority"),
        F.when(emitted, message).alias("message"),
        F.when(emitted, F.col("timestamp") + policy.expiry).alias("expires_at"))


def nudge_content(policy: NudgePolicy = NudgePolicy()) -> tuple[Column, Column]:
    """(priority, message) of a signal from its type, rule and confidence."""
    kind, rule = F.col("signal_type"), F.coalesce("rule_name", F.lit(""))
    text = v.NUDGE_MESSAGES
    missed = kind == "missed_opportunity"
    vehicle, family = missed & rule.contains("vehicle"), missed & rule.contains("family")
    priority = (
        F.when(kind.isin("compliance_gap", "frustration", "risk"), "HIGH")
        .when(vehicle, F.when(F.col("confidence") < policy.high_confidence, "LOW").otherwise("MEDIUM"))
        .when(kind.isin("callback_need", "buying_signal"), "MEDIUM").otherwise("LOW")
    )
    message = (
        F.when(vehicle, text["vehicle"]).when(family, text["family"]).when(missed, text["missed_opportunity"])
        .when(kind == "compliance_gap", text["compliance_gap"]).when(kind == "callback_need", text["callback_need"])
        .when(kind == "frustration", text["frustration"]).when(kind == "risk", text["risk"])
        .when(kind == "buying_signal", text["buying_signal"])
        .when(kind == "topic_shift", F.concat(F.lit(v.TOPIC_SHIFT_MESSAGE[0]), F.coalesce("new_topic", F.lit("")), F.lit(v.TOPIC_SHIFT_MESSAGE[1])))
        .otherwise(F.concat(F.lit(v.OTHER_MESSAGE), F.col("evidence")))
    )
    return priority, message


def expired_at(decisions: DataFrame, now: float) -> DataFrame:
    """Nudges whose validity has run out by ``now``."""
    return decisions.filter((F.col("decision") == "emitted") & (F.col("expires_at") <= now))
