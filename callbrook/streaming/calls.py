"""Live transcripts: signals, nudges, counters, states, leads and event log.

One clock everywhere: event time is the transcript time stamp.  Ordered states
wait until the watermark has passed a row before they fold it, so results do not
depend on how, or in which order within the watermark's delay, rows arrived.
"""

from __future__ import annotations

import json
import math
import threading

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from callbrook import fixed_values as v
from callbrook.functions.quality import sanitize_map
from callbrook.operators.calls import latency_segments, lead_state, leads_of, merge_leads
from callbrook.operators.nudges import NudgePolicy, decide, nudge_content
from callbrook.operators.signals import rule_hits, topic_of, usable_events
from callbrook.session import ROCKSDB
from callbrook.streaming.ordered import IDLE_MS, OrderedProcessor

WATERMARK = "60 seconds"  # longer than a nudge lives
ORIGIN_SECONDS = 86400.0
LEAD_BUCKETS = 64
EVENT = T.StructType([
    T.StructField("session_id", T.LongType()), T.StructField("chunk_sequence", T.LongType()),
    T.StructField("timestamp", T.DoubleType()), T.StructField("speaker", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("is_final", T.BooleanType()),
])

_SIGNAL_FIELDS = ("rule_order int, signal_type string, rule_name string, confidence double, severity string, "
                  "evidence string, source string, new_topic string")
SIGNAL = f"session_id long, chunk_sequence long, timestamp double, is_final boolean, speaker string, {_SIGNAL_FIELDS}"
DECISION = SIGNAL + ", decision string, expires_at double"
_ORDER = ["timestamp", "is_final", "chunk_sequence"]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_transcripts(spark: SparkSession, path: str, max_files: int | None = None, schema: T.StructType = EVENT) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def event_time(timestamp: Column | str) -> Column:
    """Call-relative seconds as a time stamp.  A watermark starts at the epoch
    and rows on it count as late, so second zero is put one day after it."""
    return F.timestamp_seconds((F.col(timestamp) if isinstance(timestamp, str) else timestamp) + ORIGIN_SECONDS)


def once_per_event(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Drop repeats of a (session, sequence, partial/final) within the watermark."""
    return events.withColumn("event_time", event_time("timestamp")).withWatermark("event_time", delay) \
        .dropDuplicatesWithinWatermark(["session_id", "chunk_sequence", "is_final"])


def write_slices(events: DataFrame, path: str, by: str, slices: int = 3, dealt: bool = False) -> int:
    """Replay a table as a stream of ``slices`` writes: its rows in ``by`` order or, ``dealt``, by a hash of it and so in no order of
    time.  Returns the files of a write, the rate limit that makes a batch of each."""
    files = events.sparkSession.sparkContext.defaultParallelism
    if dealt:
        parts = [F.pmod(F.xxhash64("session_id", by), F.lit(slices)) == k for k in range(slices)]
    else:
        cuts = events.approxQuantile(by, [k / slices for k in range(1, slices)], 0.01)
        parts = [(F.lit(True) if low is None else F.col(by) > low) & (F.lit(True) if high is None else F.col(by) <= high)
                 for low, high in zip([None, *cuts], [*cuts, None])]
    for part in parts:
        events.filter(part).repartition(files, "session_id").write.mode("append").parquet(path)
    return files


def write_end(events: DataFrame, path: str, session: int = -1, **values) -> None:
    """A last row of a session of its own, long after the others: it drives the watermark past all of them."""
    beat = events.agg(F.max("timestamp").alias("timestamp")).select(
        F.lit(session).cast("long").alias("session_id"), (F.col("timestamp") + 1e6).alias("timestamp"), *[F.lit(x).alias(c) for c, x in values.items()])
    events.limit(0).unionByName(beat, allowMissingColumns=True).select(events.columns).coalesce(1).write.mode("append").parquet(path)


def counted_source(events: DataFrame, name: str = "source") -> DataFrame:
    """Expose per-batch row counts to listeners.  A bounded queue would drop
    rows when full; here the source is rate-limited and nothing is dropped."""
    return events.observe(name, F.count("*").alias("received"), F.count_if("is_final").alias("final"))


# --- signals -----------------------------------------------------------------


class _SignalState(OrderedProcessor):
    """Per session: final turns so far, the last one disclosing, the last topic."""

    ROW = "session_id long, chunk_sequence long, timestamp double, is_final boolean, speaker string, hits string, topic string, says boolean, event_ms long"

    def __init__(self, context_turns: int, gated: list[str], shift_order: int, idle_ms: int):
        super().__init__(self.ROW, _ORDER, [f.split()[0] for f in SIGNAL.split(", ")], idle_ms)
        self.context_turns, self.gated, self.shift_order = context_turns, frozenset(gated), shift_order

    def open(self, handle):
        self.state = handle.getValueState("context", "finals long, told long, topic string")

    def fold(self, rows):
        finals, told, topic = self.state.get() or (0, -1, v.FIRST_TOPIC)
        for e in rows:
            disclosed = told >= 0 and told > finals - self.context_turns
            base = {k: e[k] for k in ("session_id", "chunk_sequence", "timestamp", "is_final", "speaker")}
            for hit in json.loads(e["hits"]):
                if not (disclosed and hit["rule_name"] in self.gated):
                    yield {**base, **hit}
            if e["is_final"]:
                if e["topic"] and e["topic"] != topic:
                    yield {**base, "rule_order": self.shift_order, "signal_type": "topic_shift", "rule_name": None,
                           "confidence": v.TOPIC_CONFIDENCE, "severity": "low",
                           "evidence": f"Shifted from {topic} to {e['topic']}", "source": "semantic", "new_topic": e["topic"]}
                    topic = e["topic"]
                finals += 1
                if e["says"]:
                    told = finals
        self.state.update((finals, told, topic))

    def forget(self):
        self.state.clear()


def in_time(df: DataFrame, timestamp: str = "timestamp", delay: str = WATERMARK) -> DataFrame:
    return df.withColumn("event_time", event_time(timestamp)).withWatermark("event_time", delay) \
        .withColumn("event_ms", F.unix_millis("event_time"))


def signals_stream(events: DataFrame, context_turns: int = v.CONTEXT_TURNS, rules=v.SIGNAL_RULES, delay: str = WATERMARK, idle_ms: int = IDLE_MS) -> DataFrame:
    """Matching is stateless and stays on the JVM; the state only decides which
    matches stand."""
    hits = rule_hits(F.col("text"), F.col("speaker"), F.lit(False), rules)
    prepared = in_time(usable_events(events), delay=delay).select(
        "session_id", "chunk_sequence", "timestamp", "is_final", "speaker", F.to_json(hits).alias("hits"),
        F.when(F.col("is_final"), topic_of("text")).alias("topic"), F.col("text").rlike("(?iuU)" + v.DISCLOSURE_PATTERN).alias("says"), "event_ms", "event_time")
    gated = [r[0] for r in rules if r[5]]
    return prepared.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_SignalState(context_turns, gated, len(rules), idle_ms), outputStructType=SIGNAL, outputMode="Append", timeMode="EventTime")


# --- nudges ------------------------------------------------------------------


class _NudgeState(OrderedProcessor):
    """Per session: when each type's nudge runs out and each rule last fired."""

    def __init__(self, policy: NudgePolicy, idle_ms: int):
        super().__init__(SIGNAL + ", event_ms long", [*_ORDER, "rule_order"], [f.split()[0] for f in DECISION.split(", ")], idle_ms)
        self.policy = policy

    def open(self, handle):
        self.until = handle.getMapState("until", "signal_type string", "at double")
        self.fired = handle.getMapState("fired", "signal_type string, rule string", "at double")

    def read(self):
        """Both memories at once: a session has few types and rules."""
        self.live = {k[0]: at[0] for k, at in self.until.iterator()}
        self.recent = {tuple(k): at[0] for k, at in self.fired.iterator()}
        self.stored = dict(self.live), dict(self.recent)

    def fold(self, rows):
        self.read()
        for s in rows:
            kind, rule = s["signal_type"], s["rule_name"] or s["signal_type"]
            state = {}
            if kind in self.live:
                state["until"] = self.live[kind]
            if (kind, rule) in self.recent:
                state[rule] = self.recent[kind, rule]
            decision = decide(self.policy, state, kind, rule, s["confidence"], s["timestamp"])
            expires = None
            if decision == "emitted":
                expires = state["until"]
                if kind in self.live:  # it ran out before this one
                    yield self._expired(s["session_id"], kind, self.live[kind])
                self.live[kind], self.recent[kind, rule] = expires, s["timestamp"]
            yield {**s, "decision": decision, "expires_at": expires}

    @staticmethod
    def _expired(session, kind, at):
        return {"session_id": session, "timestamp": at, "signal_type": kind, "decision": "expired", "expires_at": at}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.session, self.live = key[0], None
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def passed(self, mark):
        """Event time has passed a nudge's validity: report it and forget it."""
        now = mark / 1000.0 - ORIGIN_SECONDS
        if self.live is None:
            self.read()
        until, fired = self.stored
        for kind, at in self.live.items():
            if at <= now:
                yield self._expired(self.session, kind, at)
                if kind in until:
                    self.until.removeKey((kind,))
            elif until.get(kind) != at:
                self.until.updateValue((kind,), (at,))
                self.handle.registerTimer(int((at + ORIGIN_SECONDS) * 1000))
        for k, at in self.recent.items():
            end = at + self.policy.cooldown_of(k[0])
            if end <= now:
                if k in fired:
                    self.fired.removeKey(k)
            elif fired.get(k) != at:  # kept until then
                self.fired.updateValue(k, (at,))
                self.handle.registerTimer(int((end + ORIGIN_SECONDS) * 1000))

    def forget(self):
        self.until.clear()
        self.fired.clear()


def nudges_stream(signals: DataFrame, policy: NudgePolicy = NudgePolicy(), delay: str = WATERMARK, idle_ms: int = IDLE_MS) -> DataFrame:
    """Every signal with its decision, and an ``expired`` row per nudge once the
    watermark passes its validity."""
    decided = in_time(signals, delay=delay).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_NudgeState(policy, idle_ms), outputStructType=DECISION, outputMode="Append", timeMode="EventTime")
    priority, message = nudge_content(policy)
    emitted = F.col("decision") == "emitted"
    return decided.withColumn("priority", F.when(emitted, priority)).withColumn("message", F.when(emitted, message))


# --- counters, slices, states ------------------------------------------------


def session_counters(events: DataFrame) -> DataFrame:
    """Running counters per session (use update or complete mode)."""
    return events.groupBy("session_id").agg(
        F.count("*").alias("transcripts_count"), F.count_if("is_final").alias("final_count"), F.max("timestamp").alias("last_seen"))


def slices(chunks: DataFrame, width: str = "500 milliseconds") -> DataFrame:
    """Audio metadata per fixed slice, closed by the watermark."""
    return chunks.withColumn("event_time", event_time("timestamp")).withWatermark("event_time", WATERMARK) \
        .groupBy("session_id", F.window("event_time", width)).agg(F.count("*").alias("chunks"), F.sum("duration_ms").alias("duration_ms"))


SKETCH_BASE = 1.02  # a percentile lies within one hundredth of the exact one
LATENCY = ("session_id long, segment string, sample_size long, p50_bucket long, p95_bucket long, low_us long, high_us long, total_us long")


class _LatencySketch(StatefulProcessor):
    """Per session and segment: counts of logarithmic buckets beside exact count, sum and extremes.  All of it adds up, so the order
    of rows and batches does not matter; a session silent for ``idle_ms`` is complete, gives its summary and goes."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle):
        self.handle = handle
        self.sketch = handle.getValueState("sketch", "seen long, figures string")  # at most some thousand buckets

    def handleInputRows(self, key, rows, timerValues):
        seen, figures = self.sketch.get() or (None, "{}")
        first, seen, figures = seen is None, seen or 0, json.loads(figures)
        for part in rows:
            seen = max(int(part["event_ms"].max()), seen)
            for segment, bucket, us in zip(part["segment"], part["bucket"].tolist(), part["us"].tolist()):
                f = figures.setdefault(segment, {"n": 0, "total": 0, "low": us, "high": us, "buckets": {}})
                f["n"], f["total"], f["low"], f["high"] = f["n"] + 1, f["total"] + us, min(f["low"], us), max(f["high"], us)
                f["buckets"][str(bucket)] = f["buckets"].get(str(bucket), 0) + 1
        self.sketch.update((seen, json.dumps(figures)))
        if first:  # one timer a session is pending
            self.handle.registerTimer(seen + self.idle_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        names = [c.split()[0] for c in LATENCY.split(", ")]
        seen, figures = self.sketch.get()
        if seen + self.idle_ms > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(seen + self.idle_ms)
            return
        out = []
        for segment, f in json.loads(figures).items():
            counts = sorted((int(k), n) for k, n in f["buckets"].items())
            out.append((key[0], segment, f["n"], *[_bucket_at(counts, int(q * (f["n"] - 1))) for q in (0.5, 0.95)], f["low"], f["high"], f["total"]))
        self.sketch.clear()
        yield pd.DataFrame(out, columns=names)

    def close(self):
        pass


def _bucket_at(counts: list[tuple[int, int]], rank: int) -> int:
    for bucket, n in counts:
        rank -= n
        if rank < 0:
            break
    return bucket


def latency_summaries(measured: DataFrame, delay: str = WATERMARK, idle_ms: int = IDLE_MS) -> DataFrame:
    """The latency summary of each session at its completion, from rows with ``session_id, timestamp, t0 .. t4``.

    Counts, means and extremes are exact to the microsecond, percentiles to the sketch's width.
    """
    keyed = measured.select(F.struct("session_id", "timestamp").alias("event_id"), *[f"t{k}" for k in range(5)])
    us = F.round(F.col("ms") * 1000).cast("long")
    rows = latency_segments(keyed).select("event_id.session_id", event_time("event_id.timestamp").alias("event_time"), "segment", us.alias("us")) \
        .withColumn("bucket", F.floor(F.log(F.greatest("us", F.lit(1))) / math.log(SKETCH_BASE))) \
        .withColumn("event_ms", F.unix_millis("event_time")).withWatermark("event_time", delay)
    done = rows.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_LatencySketch(idle_ms), outputStructType=LATENCY, outputMode="Append", timeMode="EventTime")

    def value(bucket: str) -> Column:
        middle = F.exp((F.col(bucket) + 0.5) * math.log(SKETCH_BASE))
        return F.round(F.least(F.greatest(middle, "low_us"), "high_us") / 1000, 2)

    return done.select("session_id", "segment", "sample_size", value("p50_bucket").alias("p50_ms"), value("p95_bucket").alias("p95_ms"),
                       F.col("low_us").alias("min_us"), F.col("high_us").alias("max_us"), F.floor(F.col("total_us") / F.col("sample_size")).alias("mean_us"))


class _Conversation(OrderedProcessor):
    def __init__(self, idle_ms: int):
        super().__init__("session_id long, seq long, to_state string, event_ms long", ["seq"],
                         ["session_id", "seq", "from_state", "to_state", "state_after", "valid"], idle_ms)
        self.moves = {a: frozenset(b) for a, b in v.STATE_MOVES.items()}

    def open(self, handle):
        self.state = handle.getValueState("state", "state string")

    def fold(self, rows):
        current = (self.state.get() or ("GREETING",))[0]
        for r in rows:
            asked, before = r["to_state"], current
            valid = asked in self.moves[current]
            if valid or asked in v.ALWAYS_REACHABLE:
                current = asked
            yield {"session_id": r["session_id"], "seq": r["seq"], "from_state": before, "to_state": asked, "state_after": current, "valid": valid}
        self.state.update((current,))

    def forget(self):
        self.state.clear()


def conversation_states(requests: DataFrame, delay: str = WATERMARK, idle_ms: int = IDLE_MS) -> DataFrame:
    """Transition log of each live session; an invalid request changes nothing."""
    return in_time(requests, delay=delay).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Conversation(idle_ms), outputMode="Append", timeMode="EventTime",
        outputStructType="session_id long, seq long, from_state string, to_state string, state_after string, valid boolean")


# --- sinks -------------------------------------------------------------------


def _batch_writer(path: str, change=lambda df: df):
    """Each batch owns one folder and overwrites it, so a retried batch leaves
    the same rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def write_event_log(events: DataFrame, path: str, checkpoint: str):
    """Append call events with masked payloads."""
    clean = lambda df: df.withColumn("payload", sanitize_map("payload"))
    return events.writeStream.foreachBatch(_batch_writer(path, clean)).option("checkpointLocation", checkpoint)


def write_leads(updates: DataFrame, path: str, checkpoint: str, order=("seq",), buckets: int = LEAD_BUCKETS):
    """Keep one merged state per call, in buckets of calls.

    A batch reads and rewrites only the buckets it touches, as a version named
    by its id, from the versions of earlier batches.  A batch that is run again
    starts from the same versions and writes the same rows, so it changes
    nothing; a bucket's older versions are never read again.
    """
    return updates.writeStream.foreachBatch(lead_batch(path, order, buckets)).option("checkpointLocation", checkpoint)


def lead_batch(path: str, order=("seq",), buckets: int = LEAD_BUCKETS):
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = lead_state(batch, list(order)).withColumn("bucket", F.pmod(F.xxhash64("call_id"), F.lit(buckets)).cast("int"))
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most the number of buckets
        known = {b: n for b, n in _lead_versions(spark, path, batch_id).items() if b in touched}
        old = _lead_buckets(spark, path, known)
        out = merge_leads((new if old is None else new.unionByName(old)).drop("bucket"))
        out.withColumn("bucket", F.pmod(F.xxhash64("call_id"), F.lit(buckets)).cast("int")).repartition("bucket") \
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={batch_id}")
        spark.createDataFrame([(b, batch_id) for b in touched], "bucket int, version long").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/versions/batch={batch_id}")  # last: a batch counts once it is here
    return merge


def _lead_versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The newest version of each bucket, of batches before ``before``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return {}
    v_ = spark.read.schema("bucket int, version long, batch long").parquet(f"{path}/versions")
    kept = v_ if before is None else v_.filter(F.col("batch") < before)
    return {r.bucket: r.version for r in kept.groupBy("bucket").agg(F.max("version").alias("version")).collect()}


def _lead_buckets(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame | None:
    if not versions:
        return None
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/version={n}/bucket={b}" for b, n in sorted(versions.items())]).drop("version")


def current_leads(spark: SparkSession, path: str) -> DataFrame:
    """One row a call: the newest version of each bucket, nothing else is read."""
    return leads_of(_lead_buckets(spark, path, _lead_versions(spark, path)).drop("bucket"))


class Intake(StreamingQueryListener):
    """What ``counted_source`` observed, batch by batch, as a table."""

    def __init__(self, name: str = "source"):
        self.name, self.seen, self.ended = name, {}, threading.Event()

    def onQueryStarted(self, event):
        self.ended.clear()

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.seen[(str(event.progress.runId), event.progress.batchId)] = (row["received"], row["final"])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.set()

    def table(self, spark: SparkSession, wait: float = 60.0) -> DataFrame:
        """``batch_id, received, final``; events arrive in order, so the end of the query comes after its batches."""
        self.ended.wait(wait)
        return spark.createDataFrame([(k[1], *x) for k, x in sorted(self.seen.items())], "batch_id long, received long, final long")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, then return the sink as a table."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
