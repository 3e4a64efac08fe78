"""Running values over ordered groups, cut into segments.

A plain ``Window.partitionBy(key)`` puts a whole group into one task.  When one
call, provider or content hash holds a third of all rows that task is the job.
Here each group is cut into segments of consecutive rows: the window runs
inside (key, segment), every segment is reduced to one summary row before the
shuffle, the summaries (rows / segment length of them) are scanned per key, and
what earlier segments hand over is joined back.  The result equals the plain
window's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, max, min or last (last non-null)."""

    name: str
    kind: str
    value: Column
    inclusive: bool = False


def _local(spec: Running, window) -> Column:
    end = 0 if spec.inclusive else -1
    frame = window.rowsBetween(Window.unboundedPreceding, end)
    if spec.kind == "last":
        return F.last(spec.value, ignorenulls=True).over(frame)
    return {"sum": F.sum, "max": F.max, "min": F.min}[spec.kind](spec.value).over(frame)


def _summary(spec: Running, order: Sequence[str]) -> Column:
    if spec.kind == "last":
        key = F.when(spec.value.isNotNull(), F.struct(*order))
        return F.max_by(spec.value, key)
    return {"sum": F.sum, "max": F.max, "min": F.min}[spec.kind](spec.value)


def _merge(spec: Running, carried: Column, local: Column) -> Column:
    if spec.kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if spec.kind == "last":
        return F.coalesce(local, carried)
    return (F.greatest if spec.kind == "max" else F.least)(carried, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    specs: Sequence[Running],
) -> DataFrame:
    """Add one column per spec.

    ``order`` must be a total order inside a group, and ``segment`` must not
    decrease along it.
    """
    cut = df.withColumn("__seg", segment)
    inside = Window.partitionBy(*keys, "__seg").orderBy(*order)
    rows = cut.select("*", *[_local(s, inside).alias(f"__l_{s.name}") for s in specs])

    summary = cut.groupBy(*keys, "__seg").agg(
        *[_summary(s, order).alias(f"__s_{s.name}") for s in specs])
    before = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    over_segments = {"sum": F.sum, "max": F.max, "min": F.min}
    handed = summary.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__seg").alias("__k_seg"),
        *[
            (F.last(f"__s_{s.name}", ignorenulls=True) if s.kind == "last"
             else over_segments[s.kind](f"__s_{s.name}")).over(before).alias(f"__c_{s.name}")
            for s in specs
        ],
    )
    on = F.col("__seg") == F.col("__k_seg")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = rows.join(handed, on, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_merge(s, F.col(f"__c_{s.name}"), F.col(f"__l_{s.name}")).alias(s.name) for s in specs],
    )


def previous(df, keys, order, segment, name: str, value: Column) -> DataFrame:
    """The value of the row before (its value must not be null)."""
    return running(df, keys, order, segment, [Running(name, "last", value)])


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, value: Column,
         breaks: Callable[[Column, Column], Column]) -> DataFrame:
    """Gaps and islands in one segmented pass.

    Adds ``run_value`` (last non-null value up to the row) and ``run_start``
    (the order key of the row that opened the row's run; null before the first
    break).  ``breaks(previous, value)`` says whether a value opens a run; a null
    value never does.  Only the first value of a segment needs anything from
    earlier segments, and that is settled on the summaries.
    """
    at = F.struct(*order)
    inside = Window.partitionBy(*keys, "__seg").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    cut = df.withColumn("__seg", segment).withColumn("__v", value).withColumn("__at", at)
    local = cut.withColumn("__p", F.last("__v", ignorenulls=True).over(before)) \
        .withColumn("__b", F.when(F.col("__v").isNotNull() & F.col("__p").isNotNull()
                                  & breaks(F.col("__p"), F.col("__v")), F.col("__at")))
    rows = local.withColumn("__lv", F.last("__v", ignorenulls=True).over(upto)) \
        .withColumn("__lb", F.last("__b", ignorenulls=True).over(upto))

    known = F.when(F.col("__v").isNotNull(), F.col("__at"))
    summary = local.groupBy(*keys, "__seg").agg(
        F.min(known).alias("__first_at"), F.min_by("__v", known).alias("__first"),
        F.max_by("__v", known).alias("__last"), F.max("__b").alias("__last_b"))
    earlier = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    opened = summary.withColumn("__carry_v", F.last("__last", ignorenulls=True).over(earlier)) \
        .withColumn("__opens", F.when(F.col("__first").isNotNull() & (
            F.col("__carry_v").isNull() | breaks(F.col("__carry_v"), F.col("__first"))), F.col("__first_at"))) \
        .withColumn("__carry_b", F.last(F.coalesce("__last_b", "__opens"), ignorenulls=True).over(earlier))
    handed = opened.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__seg").alias("__k_seg"),
                           "__carry_v", "__opens", "__carry_b")
    on = F.col("__seg") == F.col("__k_seg")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return rows.join(handed, on, "left").select(
        *[F.col(c) for c in df.columns],
        F.coalesce("__lv", "__carry_v").alias("run_value"),
        F.coalesce(F.col("__lb"), F.when(F.col("__at") >= F.col("__opens"), F.col("__opens")), F.col("__carry_b")).alias("run_start"),
    )


def is_small(df: DataFrame, limit: int) -> bool:
    """Does the frame have at most ``limit`` rows?  Reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast only after counting; beyond ``limit`` the planner decides."""
    return F.broadcast(df) if is_small(df, limit) else df
