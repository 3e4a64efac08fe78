"""Registered streaming queries: the whole table replayed as a stream.

The stream must give what the batch operators give, so the SQL is the same.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions.clock import epoch_seconds
from callbrook.operators.signals import transcript_events
from callbrook.plans import call_queries as cq
from callbrook.plans.tables import read
from callbrook.session import shared_dir
from callbrook.streaming import calls as st


def _work(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


DELAY = "1 hour"  # longer than a call: rows of any batch are in time
_OWN = "session_id >= 0"  # without the row that ends the replay


def _events(spark, sf):
    """The given turns, each as a partial event and its final one."""
    return transcript_events(cq.turns(spark, sf).drop("role")).select(*st.EVENT.fieldNames())


def _event_stream(spark, sf):
    path = _work(spark, "transcripts")
    events = _events(spark, sf)
    files = st.write_slices(events, path, "chunk_sequence", dealt=True)
    st.write_end(events, path, chunk_sequence=0, text="the end", is_final=True)
    st.use_rocksdb(spark)
    return st.read_transcripts(spark, path, files)


def _signals(spark, sf):
    return st.run_available(st.signals_stream(_event_stream(spark, sf), delay=DELAY), _work(spark, "signals"), _work(spark, "ckpt"))


def _nudges(spark, sf):
    path = _work(spark, "dealt")
    signals = _signals(spark, sf)
    files = st.write_slices(signals, path, "chunk_sequence", dealt=True)
    st.write_end(signals, path, confidence=0.0, signal_type="heartbeat")
    stream = spark.readStream.schema(signals.schema).option("maxFilesPerTrigger", files).parquet(path)
    return st.run_available(st.nudges_stream(stream, delay=DELAY), _work(spark, "out"), _work(spark, "ckpt")).filter(_OWN)


def signals_stream(spark, sf):
    """Three batches that each hold turns of all times."""
    return _signals(spark, sf).filter(_OWN).select("session_id", "chunk_sequence", "is_final", "signal_type", "rule_name", "evidence", "new_topic")


def nudges_stream(spark, sf):
    return _nudges(spark, sf).filter("decision <> 'expired'").select("session_id", "chunk_sequence", "is_final", "signal_type", "decision", "expires_at")


def expired_nudges_stream(spark, sf):
    """Nudges whose validity the watermark has passed."""
    return _nudges(spark, sf).filter("decision = 'expired'").select("session_id", "signal_type", "expires_at")


def slices_stream(spark, sf):
    """Half-minute slices of the stored events, closed by the watermark; the last ones stay open and are left out."""
    path = _work(spark, "events")
    e = read(spark, sf, "events").select(F.col("user_id").alias("session_id"), epoch_seconds("ts").alias("timestamp"), F.col("value").alias("duration_ms"))
    files = st.write_slices(e, path, "timestamp")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path)
    out = st.run_available(st.slices(stream, "1 hour"), _work(spark, "out"), _work(spark, "ckpt"))
    return out.select("session_id", (F.unix_timestamp("window.start") - int(st.ORIGIN_SECONDS)).alias("slice_start"), "chunks", F.round("duration_ms", 4).alias("duration_ms"))


def session_counters_stream(spark, sf):
    """Counters kept by a complete-mode aggregation, as of the last batch.  Every third event comes twice."""
    events = _event_stream(spark, sf)
    again = F.array_repeat(F.lit(1), F.when(F.col("chunk_sequence") % 3 == 0, 2).otherwise(1))
    repeated = events.withColumn("again", F.explode(again)).drop("again")
    counted = st.session_counters(st.counted_source(st.once_per_event(repeated, DELAY)))
    path = _work(spark, "counters")

    def keep(batch, _batch_id):
        batch.write.mode("overwrite").parquet(path)

    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", _work(spark, "ckpt")) \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).filter(_OWN).select("session_id", "transcripts_count", "final_count")


def latency_stream(spark, sf):
    """Latency summaries given when a session (a user's week) is over; three batches in the order of time."""
    path = _work(spark, "stamps")
    week = F.floor(epoch_seconds("ts") / 604_800)
    e = read(spark, sf, "events").select("event_id", (F.col("user_id") * 100_000 + week).alias("session_id"), epoch_seconds("ts").alias("timestamp"))
    m = cq._latency_stamps(spark, sf).join(e, "event_id").drop("event_id")
    files = st.write_slices(m, path, "timestamp")
    st.write_end(m, path, t0=1.0, t1=2.0)
    st.use_rocksdb(spark)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", files).parquet(path)
    return st.run_available(st.latency_summaries(stream, DELAY, idle_ms=604_800_000), _work(spark, "out"), _work(spark, "ckpt")).filter(_OWN)


def conversation_stream(spark, sf):
    path = _work(spark, "requests")
    asked = cq._asked(spark, sf).withColumn("timestamp", F.col("seq") * 5.0)
    files = st.write_slices(asked, path, "seq", dealt=True)
    st.write_end(asked, path, seq=0, to_state="GREETING")
    st.use_rocksdb(spark)
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", files).parquet(path)
    return st.run_available(st.conversation_states(stream, delay=DELAY), _work(spark, "out"), _work(spark, "ckpt")).filter(_OWN) \
        .select("session_id", "seq", "from_state", "to_state", "state_after")


def leads_stream(spark, sf):
    """Three batches in no order, merged into the snapshot."""
    path, out = _work(spark, "updates"), _work(spark, "leads")
    updates = cq._lead_updates(spark, sf)
    files = spark.sparkContext.defaultParallelism
    for k in range(3):
        updates.filter(F.pmod(F.xxhash64("call_id", "seq"), F.lit(3)) == k).repartition(files).write.mode("append").parquet(path)
    stream = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", files).parquet(path)
    st.write_leads(stream, out, _work(spark, "ckpt")).trigger(availableNow=True).start().awaitTermination()
    return st.current_leads(spark, out)


def intake_counts(spark, sf):
    """Events read from the source as the listener saw them, batch by batch; a purchase ends a visit."""
    path = _work(spark, "events")
    e = read(spark, sf, "events").select("event_id", (F.col("event_type") == "purchase").alias("is_final"))
    e.repartition(6, "event_id").write.parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(path)
    intake = st.Intake()
    spark.streams.addListener(intake)
    try:
        st.run_available(st.counted_source(stream), _work(spark, "out"), _work(spark, "ckpt"))
        seen = intake.table(spark)
    finally:
        spark.streams.removeListener(intake)
    return seen.agg(F.sum("received").alias("received"), F.sum("final").alias("final"))


def event_log_stream(spark, sf):
    path, out = _work(spark, "events"), _work(spark, "log")
    events = cq.turns(spark, sf).select("session_id", "chunk_sequence", F.create_map(F.lit("text"), F.col("text")).alias("payload"))
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    st.write_event_log(stream, out, _work(spark, "ckpt")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("session_id", "chunk_sequence", F.element_at("payload", "text").alias("payload_text"))


QUERIES = {f.__name__: f for f in (
    signals_stream, nudges_stream, expired_nudges_stream, slices_stream, session_counters_stream, latency_stream, conversation_stream, leads_stream, intake_counts, event_log_stream)}

_STEP = cq._STEP
ORACLE = {
    "signals_stream": cq._with(*cq._SIG) + " SELECT session_id, chunk_sequence, is_final, signal_type, rule_name, evidence, new_topic FROM signals",
    "nudges_stream": cq._with(*cq._NUDGED, recursive=True) + f""" SELECT session_id, chunk_sequence, is_final, signal_type, decision,
      CASE WHEN decision = 'emitted' THEN ts + {v.NUDGE_EXPIRY} END AS expires_at FROM decided""",
    "expired_nudges_stream": cq._with(*cq._NUDGED, recursive=True) + f" SELECT session_id, signal_type, ts + {v.NUDGE_EXPIRY} AS expires_at FROM decided WHERE decision = 'emitted'",
    "slices_stream": """WITH e AS (SELECT user_id, floor(epoch_us(ts) / 3600000000)::BIGINT * 3600 AS slice_start, value, max(epoch_us(ts)) OVER () / 1000000.0 - 60 AS mark FROM events)
      SELECT user_id AS session_id, slice_start, count(*) AS chunks, round(sum(value), 4) AS duration_ms FROM e WHERE slice_start + 3600 <= mark GROUP BY ALL""",
    "session_counters_stream": cq._with(cq.SQL_TURNS, cq.SQL_EVENTS) + " SELECT session_id, count(*) AS transcripts_count, count(*) FILTER (is_final) AS final_count FROM raw_events GROUP BY 1",
    "latency_stream": cq.ORACLE["latency_summary"].split("long AS")[0] + f"""
      weeks AS (SELECT event_id, user_id * 100000 + epoch_us(ts) // 604800000000 AS session_id FROM events),
      long AS (SELECT event_id, 'asr' AS segment, (t1 - t0) * 1000.0 AS ms FROM s4 UNION ALL SELECT event_id, 'signal', (t2 - t1) * 1000.0 FROM s4
        UNION ALL SELECT event_id, 'nudge', (t3 - t2) * 1000.0 FROM s4 UNION ALL SELECT event_id, 'delivery', (t4 - t3) * 1000.0 FROM s4
        UNION ALL SELECT event_id, 'end_to_end', (coalesce(t4, t3, t2, t1) - t0) * 1000.0 FROM s4),
      u AS (SELECT session_id, segment, CAST(round(greatest(0.0, ms) * 1000) AS BIGINT) AS us FROM long JOIN weeks USING (event_id) WHERE ms IS NOT NULL),
      b AS (SELECT session_id, segment, count(*) AS n, min(us) AS low, max(us) AS high, sum(us) AS total, list_sort(list(floor(ln(greatest(us, 1)) / ln({st.SKETCH_BASE})))) AS bs FROM u GROUP BY ALL)
      SELECT session_id, segment, n AS sample_size, {', '.join(f"round(least(greatest(exp((bs[CAST(floor({q} * (n - 1)) AS BIGINT) + 1] + 0.5) * ln({st.SKETCH_BASE})), low), high) / 1000, 2) AS {name}" for q, name in ((0.5, 'p50_ms'), (0.95, 'p95_ms')))},
        low AS min_us, high AS max_us, CAST(total // n AS BIGINT) AS mean_us FROM b""",
    "conversation_stream": cq._with(
        cq.SQL_ASKED, "a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM asked)",
        f"s AS (SELECT session_id, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::VARCHAR AS from_state, NULL::VARCHAR AS to_state, 'GREETING' AS state FROM a GROUP BY 1 UNION ALL "
        f"SELECT a.session_id, a.rn, a.seq, s.state, a.to_state, {_STEP} FROM s JOIN a ON a.session_id = s.session_id AND a.rn = s.rn + 1)",
        recursive=True) + " SELECT session_id, seq, from_state, to_state, state AS state_after FROM s WHERE rn > 0",
    "intake_counts": "SELECT count(*) AS received, count(*) FILTER (event_type = 'purchase') AS final FROM events",
    "leads_stream": cq.ORACLE["lead_upsert"],
    "event_log_stream": cq.ORACLE["event_log_sanitize"],
}
