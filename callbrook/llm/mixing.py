"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source may be copied ``target / source size`` times.  The whole part is taken at once; the fractional parts are
settled in pairs: words move from one document to the other until one of the two probabilities is 0 or 1, with odds that keep
every document's expectation, and the other document meets the next.  Words are conserved at each step.  A bucket of a source
leaves one unsettled document and, kept aside as small change, a few others; these meet the leftovers of other buckets in a tree of
bounded fan-in.  The root does the same: small change is set aside until it can take the largest document twice
over, all others meet in pairs, and what the pairs leave is settled against the change as a whole, so that the last
rounding error is that of a small document.  A source of any size goes this way.  Units are ordered by one hash and drawn by another, fresh at each level, so that
neighbours in a bucket do not share their draws, nor do repeated rows.

Defined results: a null or blank text has size 0 and is copied by its own draw; a null source is a source of its own, ordered last;
null and repeated ids and repeated rows are separate documents; an empty table gives an empty table.  Reruns over the same
files agree.  No document is taken more than ``most`` times.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbrook.llm.common import words
from callbrook.operators.ranking import ranked
from callbrook.session import written

BUCKET, FAN, CHANGE, RESERVE = 4096, 64, 64, 2.0
UNIT = "__row long, __h long, __place long, __bucket long, __size double, __p double, __order long, __spare boolean"


def sizes_of(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.size(words(F.col(text))).cast("long"))


def targets(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
            source: str = "source") -> DataFrame:
    """``source, source_size, n_docs, place, target``: one row per source, in code point order with null last.

    The weights repeat over the ordered sources.  The level at which uncapped sources stand is found by one small aggregation per
    round; only sums come to the driver.
    """
    per = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    placed = written(ranked(per, "sources", F.col("source").isNull(), F.col("source")).withColumnRenamed("rank", "place")
                     .withColumn("__w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))), "placed")
    cap = F.col("source_size") * most
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, known = 0.0, -1
    while total:
        over = cap < F.col("__w") * level
        n, held, weight = placed.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.sum(F.when(~over, F.col("__w")))).first()
        if n == known:
            break
        known = n
        if not weight:
            break
        level = (share * total - held) / weight
    return placed.withColumn("target", F.least(cap, F.col("__w") * level)).drop("__w")


def _pair(size, p, u):
    """Settle a run of documents pair by pair; returns the probabilities, at most one of them fractional, and its index."""
    a = -1
    for b in range(len(p)):
        if not 0.0 < p[b] < 1.0:
            continue
        if a < 0:
            a = b
            continue
        up = min((1.0 - p[a]) * size[a], p[b] * size[b])  # words that can move from b to a
        down = min(p[a] * size[a], (1.0 - p[b]) * size[b])
        move = up if u[b] * (up + down) < down else -down
        for k, by in ((a, move), (b, -move)):
            q = p[k] + by / size[k]
            p[k] = 0.0 if q < 1e-12 else 1.0 if q > 1.0 - 1e-12 else q
        if not 0.0 < p[a] < 1.0:
            a = b if 0.0 < p[b] < 1.0 else -1
    return p, a


def _root(size, p, rng):
    """Settle everything, the largest first, each against all smaller ones together while these can take the difference.

    The others move along one fixed direction, ``p * (1 - p)`` each, so that every expectation is kept.
    """
    order = np.argsort(-size, kind="stable")
    size, p = size[order], p[order]
    i, n = 0, len(p)
    while i < n:
        if not 0.0 < p[i] < 1.0:
            i += 1
            continue
        rest = slice(i + 1, n)
        q, way = p[rest], p[rest] * (1.0 - p[rest])
        room = float((size[rest] * way).sum())
        if size[i] * max(p[i], 1.0 - p[i]) < room:
            up = rng.random() < p[i]
            p[rest] = q - way * (1.0 - p[i]) * size[i] / room if up else q + way * p[i] * size[i] / room
            p[i] = float(up)
            i += 1
        elif way.any():
            j = i + 1 + int(np.argmax(way > 0.0))
            p[[i, j]], _ = _pair(size[[i, j]], p[[i, j]], rng.random(2))
        else:
            p[i] = float(rng.random() < p[i])
    back = np.empty(n)
    back[order] = p
    return back


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(h: np.ndarray, nth: np.ndarray, seed: int, level: int) -> np.ndarray:
    """Draws in [0, 1) by hash, occurrence of the hash, seed and level."""
    x = h.astype(np.int64).view(np.uint64)
    for salt in (np.full(1, seed), np.full(1, level), nth):
        x = _mixed(x + (salt.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(11)) * 2.0 ** -53


def _kept_aside(size, p, change: int) -> int:
    """How many of the units, in order, make up change that can take the largest one ``RESERVE`` times over."""
    enough = np.cumsum(size * p * (1.0 - p)) >= RESERVE * size.max(initial=0.0)
    return max(change, int(np.argmax(enough)) + 1 if enough.any() else len(p))


def _settle(root: bool, change: int, seed: int, level: int):
    def settle(units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["__order", "__row"], kind="stable").reset_index(drop=True)
        size, p = (units[c].to_numpy(float).copy() for c in ("__size", "__p"))
        h, nth = units["__h"].to_numpy(np.int64), units.groupby("__h").cumcount().to_numpy()
        u = _draws(h, nth, seed, level)
        spare = np.zeros(len(units), bool)
        loose = np.flatnonzero((p > 0) & (p < 1))
        loose = loose[np.argsort(~units["__spare"].to_numpy(bool)[loose], kind="stable")]
        spare[loose[:_kept_aside(size[loose], p[loose], change) if root else change]] = True
        main = np.flatnonzero(~spare)
        p[main], _ = _pair(size[main], p[main], u[main])
        if root:
            left = np.flatnonzero((p > 0) & (p < 1))
            p[left] = _root(size[left], p[left], np.random.default_rng((seed, level, int(h.view(np.uint64).sum()))))
        return units.assign(__p=p, __spare=spare)
    return settle


def copies(units: DataFrame, bucket: int = BUCKET, fan: int = FAN, change: int = CHANGE, seed: int = 17) -> DataFrame:
    """``__row, __copies`` for rows ``__row, __h, __place, __size, __rate, __n``: ``__h`` is a hash of the row's id and content, on
    which its draw depends however rows are numbered, and ``__n`` the documents of its source."""
    whole = F.floor("__rate")
    top = units.agg(F.max("__n")).first()[0] or 0
    # rows alike in id and content that would overfill a bucket are told apart by their numbers; of others the numbers do not matter
    many = written(units.groupBy("__h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("__h", F.lit(True).alias("__many")), "many")
    units = units.join(many, "__h", "left").withColumn("__h", F.when(F.col("__many"), F.xxhash64("__h", "__row")).otherwise(F.col("__h")))
    draw = F.shiftrightunsigned(F.xxhash64("__h", F.lit(seed + 2)), 11) * F.lit(2.0 ** -53)
    units = units.withColumns({"__u": draw, "__order": F.xxhash64("__h", F.lit(seed)), "__whole": whole, "__f": F.col("__rate") - whole})
    blank = F.col("__size") == 0
    units = units.withColumns({
        "__p": F.when(blank, (F.col("__u") < F.col("__f")).cast("double")).otherwise(F.col("__f")),
        "__bucket": F.pmod(F.xxhash64("__h", F.lit(seed + 1)), F.ceil(F.col("__n") / bucket)), "__spare": F.lit(False)})
    names = [c.split()[0] for c in UNIT.split(", ")]
    fixed = [units.filter(F.col("__p").isin(0.0, 1.0)).select("__row", "__p")]
    loose, buckets, level = units.filter(~F.col("__p").isin(0.0, 1.0)).select(*names), -(-top // bucket), 0
    while top:
        root = buckets <= 1
        done = loose.groupBy("__place", "__bucket").applyInPandas(_settle(root, change, seed, level), UNIT)
        if root:
            fixed.append(done.select("__row", "__p"))
            break
        done = written(done, "mix")
        fixed.append(done.filter(F.col("__p").isin(0.0, 1.0)).select("__row", "__p"))
        level += 1
        loose = done.filter(~F.col("__p").isin(0.0, 1.0)).withColumn("__bucket", F.floor(F.col("__bucket") / fan))
        buckets = -(-buckets // fan)
    settled = fixed[0]
    for more in fixed[1:]:
        settled = settled.unionByName(more)
    return units.select("__row", "__whole").join(settled, "__row") \
        .select("__row", (F.col("__whole") + F.col("__p")).cast("long").alias("__copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, text: str = "text",
        source: str = "source", columns: Sequence[str] = (), seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """Each document with ``size, source_size, target, copies``; ``columns`` of the input are kept beside them."""
    keep = [c for c in columns if c.lower() not in ("size", "source_size", "target", "copies")]
    base = docs.select(*(F.col(c).alias(f"in_{k}") for k, c in enumerate(keep)), F.col(source).alias("__source"),
                       F.size(words(F.col(text))).cast("long").alias("size"), F.xxhash64(id_col, text).alias("__h"))
    base = written(base.withColumn("__row", F.monotonically_increasing_id()), "sized")
    goal = targets(base, weights, share, most, "__source")
    rated = base.select("__row", "__h", "__source", F.col("size").cast("double").alias("__size")) \
        .join(goal.withColumnRenamed("source", "__of"), F.col("__source").eqNullSafe(F.col("__of")))
    rated = written(rated.select("__row", "__h", F.col("place").cast("long").alias("__place"), "__size", F.col("n_docs").alias("__n"),
                                 F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__rate"),
                                 "source_size", "target"), "rated")
    drawn = copies(rated.drop("source_size", "target"), seed=seed)
    return base.join(drawn, "__row").join(rated.select("__row", "source_size", "target"), "__row").select(
        *(F.col(f"in_{k}").alias(c) for k, c in enumerate(keep)), "size", "source_size", "target",
        F.col("__copies").alias("copies"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: every document as many times as it was drawn, with the input's own columns."""
    drawn = mix(docs, columns=docs.columns, **how)
    return drawn.filter(F.col("copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))) \
        .select(*docs.columns)
