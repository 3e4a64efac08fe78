"""Registered call-intelligence queries with their SQL.

The given conversations hold invented words, so every turn gets a business
phrase appended, chosen by its own conversation and turn number.  Work still
grows with the table and every rule meets data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions.clock import epoch_seconds
from callbrook.functions.quality import sanitize, sanitize_json
from callbrook.functions.text import stable_id
from callbrook.operators import calls as c
from callbrook.operators import nudges as nd
from callbrook.operators import signals as sg
from callbrook.session import written
from callbrook.plans.tables import read, sql_list, sql_str, sql_strip, sql_words

PHRASES = (
    "Hello, this call is recorded for quality and training.",
    "I also have another vehicle that I might want to insure.",
    "Please tell me your income and bank account.",
    "Could I get extra coverage for my wife as well?",
    "We opened a second branch of the store last spring.",
    "We promise guaranteed approval for everyone.",
    "I am driving right now, please call me back.",
    "I lost my job and cannot afford the cicilan.",
    "This is taking so long, what a waste of my time!",
    "I am ready to sign, where do I sign today?",
    "What is the interest rate and the down payment?",
    "That is too expensive, I am not interested.",
    "How do I transfer it to the bank?",
    "Thank you, talk later.",
    "",
    "Mail me at jane.doe@example.org or call 415-555-2671 please.",
    "Tidak bisa bayar, saya ragu karena mahal.",
    "Good morning, we sell retail goods for 3 years now.",
    "Magandang araw po, magkano ang monthly premium ng policy?",
    "Kirim kontraknya, saya setuju.",
    "Our monthly revenue is about 1.2 million and we need 500 thousand for stock.",
    "My annual revenue is around fifty and I run a logistics app.",
    "I want to speak with a human specialist now.",
    "Gimana cicilannya kak, tenor berapa bulan kalau DP 20 juta?",
    "Yes, you have my permission to contact me.",
    "Why do I need so many documents for a loan of 2 crore?",
    "Turnover of 40 lakh, we have been trading for 18 months.",
    "Mohon informasi pembiayaan dan angsuran dengan jatuh tempo.",
    "Ano po ang grace period bago mag-lapse ang policy?",
)
N = len(PHRASES)


def turns(spark, sf):
    """Conversation turns as planned utterances (five seconds apart)."""
    conv = read(spark, sf, "conversations")
    pick = ((F.col("conv_id") * 5 + F.col("turn") * 7) % N + 1).cast("int")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), pick)
    return conv.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("chunk_sequence"),
        (F.col("turn") * 5.0).alias("timestamp"),
        F.when(F.col("role") == "user", "CUSTOMER").when(F.col("role") == "assistant", "AGENT").otherwise("UNKNOWN").alias("speaker"),
        F.concat_ws(" ", phrase, "text").alias("text"),
        (F.lit(1.0) - F.col("turn") * 0.05).alias("confidence"),
        "role",
    )


SQL_TURNS = f"""
turns AS (
  SELECT conv_id AS session_id, turn AS chunk_sequence, turn * 5.0::DOUBLE AS ts, role,
    CASE WHEN role = 'user' THEN 'CUSTOMER' WHEN role = 'assistant' THEN 'AGENT' ELSE 'UNKNOWN' END AS speaker,
    {sql_list(PHRASES)}[(conv_id * 5 + turn * 7) % {N} + 1] || ' ' || text AS text, 1.0::DOUBLE - turn * 0.05::DOUBLE AS confidence
  FROM conversations)"""

SQL_EVENTS = f"""
raw_events AS (
  SELECT session_id, chunk_sequence, ts + 0.25 AS ts, speaker, text, confidence, true AS is_final FROM turns
  UNION ALL
  SELECT session_id, chunk_sequence, ts, speaker, array_to_string(w[1:greatest(1, len(w) // 2)], ' '), round(confidence * 0.9, 2), false
  FROM (SELECT *, {sql_words('text')} AS w FROM turns)),
events AS (
  SELECT * FROM (SELECT * REPLACE ({sql_strip('text')} AS text) FROM raw_events)
  WHERE text <> '' AND (is_final OR len({sql_words('text')}) >= {v.PARTIAL_MIN_WORDS}))"""

_TOPIC = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), {sql_str(k)})" for k in ks) + f" THEN '{name}'" for name, ks in v.TOPIC_KEYWORDS) + " END"

SQL_CONTEXT = f"""
topical AS (SELECT *, CASE WHEN is_final THEN {_TOPIC} END AS topic,
    is_final AND regexp_matches(text, '(?i){v.DISCLOSURE_PATTERN}') AS says FROM events),
counted AS (
  SELECT *, coalesce(sum(CASE WHEN is_final THEN 1 ELSE 0 END) OVER w, 0) AS finals_before,
    coalesce(last_value(topic IGNORE NULLS) OVER w, '{v.FIRST_TOPIC}') AS last_topic
  FROM topical WINDOW w AS (PARTITION BY session_id ORDER BY ts, is_final, chunk_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
context AS (
  SELECT *, coalesce(max(CASE WHEN says THEN finals_before + 1 END) OVER (PARTITION BY session_id ORDER BY ts, is_final, chunk_sequence
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > finals_before - {v.CONTEXT_TURNS}, false) AS disclosed FROM counted)"""


def _evidence(patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {sql_str('(?i)' + p)}), '')" for p in patterns) + ")"


def _rule_sql(i, rule) -> str:
    name, kind, confidence, severity, who, disclosure, patterns = rule
    test = "TRUE" + (f" AND speaker = '{who}'" if who else "") + (" AND NOT disclosed" if disclosure else "")
    return (f"SELECT session_id, chunk_sequence, ts, is_final, speaker, {i} AS rule_order, '{kind}' AS signal_type, '{name}' AS rule_name, "
            f"{confidence}::DOUBLE AS confidence, '{severity}' AS severity, {_evidence(patterns)} AS evidence, 'rule' AS source, CAST(NULL AS VARCHAR) AS new_topic "
            f"FROM context WHERE {test}")


SQL_SIGNALS = "signals AS (SELECT * FROM (" + " UNION ALL ".join(
    _rule_sql(i, r) for i, r in enumerate(v.SIGNAL_RULES)) + f""") WHERE evidence IS NOT NULL
  UNION ALL SELECT session_id, chunk_sequence, ts, is_final, speaker, {len(v.SIGNAL_RULES)}, 'topic_shift', NULL, {v.TOPIC_CONFIDENCE}::DOUBLE, 'low',
    'Shifted from ' || last_topic || ' to ' || topic, 'semantic', topic FROM context WHERE topic IS NOT NULL AND topic <> last_topic)"""


def sql_fold(source: str, expiry: float, cooldown: str, gate: float = v.NUDGE_MIN_CONFIDENCE) -> str:
    """The greedy fold as recursion per (session, type); one rule per type or
    expiry beyond every cooldown, so the last emission is all the state."""
    return f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY session_id, signal_type ORDER BY ts, is_final, chunk_sequence, rule_order) AS rn FROM {source}),
fold AS (
  SELECT session_id, signal_type, 0::BIGINT AS rn, NULL::DOUBLE AS last, ''::VARCHAR AS decision FROM ordered GROUP BY ALL
  UNION ALL
  SELECT o.session_id, o.signal_type, o.rn,
    CASE WHEN o.confidence >= {gate} AND (f.last IS NULL OR (f.last + {expiry} <= o.ts AND o.ts - f.last >= {cooldown})) THEN o.ts ELSE f.last END,
    CASE WHEN o.confidence < {gate} THEN 'low_confidence' WHEN f.last + {expiry} > o.ts THEN 'active_duplicate'
      WHEN o.ts - f.last < {cooldown} THEN 'cooldown' ELSE 'emitted' END
  FROM fold f JOIN ordered o ON o.session_id = f.session_id AND o.signal_type = f.signal_type AND o.rn = f.rn + 1),
decided AS (SELECT o.*, f.decision FROM ordered o JOIN fold f USING (session_id, signal_type, rn))"""


_M = {k: sql_str(m) for k, m in v.NUDGE_MESSAGES.items()}
SQL_CONTENT = f"""
  CASE WHEN decision = 'low_confidence' THEN 'LOW' WHEN decision <> 'emitted' THEN NULL
    WHEN signal_type IN ('compliance_gap', 'frustration', 'risk') THEN 'HIGH'
    WHEN signal_type = 'missed_opportunity' AND contains(rule_name, 'vehicle') THEN CASE WHEN confidence < {v.NUDGE_HIGH_CONFIDENCE} THEN 'LOW' ELSE 'MEDIUM' END
    WHEN signal_type IN ('callback_need', 'buying_signal') THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE WHEN decision <> 'emitted' THEN NULL
    WHEN signal_type = 'missed_opportunity' AND contains(rule_name, 'vehicle') THEN {_M['vehicle']}
    WHEN signal_type = 'missed_opportunity' AND contains(rule_name, 'family') THEN {_M['family']}
    WHEN signal_type = 'missed_opportunity' THEN {_M['missed_opportunity']}
    WHEN signal_type = 'compliance_gap' THEN {_M['compliance_gap']} WHEN signal_type = 'callback_need' THEN {_M['callback_need']}
    WHEN signal_type = 'frustration' THEN {_M['frustration']} WHEN signal_type = 'risk' THEN {_M['risk']}
    WHEN signal_type = 'buying_signal' THEN {_M['buying_signal']}
    ELSE {sql_str(v.TOPIC_SHIFT_MESSAGE[0])} || new_topic || {sql_str(v.TOPIC_SHIFT_MESSAGE[1])} END AS message"""


def _with(*parts, recursive=False):
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts)


# --- queries -----------------------------------------------------------------


def _events(spark, sf):
    return sg.transcript_events(turns(spark, sf).drop("role"))


def transcript_events(spark, sf):
    return _events(spark, sf).select("session_id", "chunk_sequence", "timestamp", "is_final", "text",
                                     F.round("confidence", 4).alias("confidence"))


def topic_shift(spark, sf):
    s = sg.detect_signals(_events(spark, sf)).filter("signal_type = 'topic_shift'")
    return s.select("session_id", "chunk_sequence", "evidence", "new_topic")


def disclosure_gap(spark, sf):
    e = sg.event_context(sg.usable_events(_events(spark, sf)))
    return e.select("session_id", "chunk_sequence", "is_final", "disclosed")


def rule_signals(spark, sf):
    s = sg.detect_signals(_events(spark, sf)).filter("source = 'rule'")
    return s.select("session_id", "chunk_sequence", "is_final", "speaker", "signal_type", "rule_name", "confidence",
                    "severity", "evidence", "signal_id")


def _decisions(spark, sf):
    return nd.nudge_decisions(written(sg.detect_signals(_events(spark, sf)), "signals"))


def nudges_greedy(spark, sf):
    return _decisions(spark, sf).select("session_id", "chunk_sequence", "is_final", "signal_type", "signal_id",
                                        "decision", "priority", "message", "expires_at")


HOURS = nd.NudgePolicy(min_confidence=0.5, cooldown=43200.0, compliance_cooldown=43200.0, expiry=21600.0)


def _event_signals(spark, sf):
    """The event stream as signals of its users: six-hour validity, twelve-hour
    cooldown, so both suppression rules decide."""
    e = read(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk_sequence"),
        epoch_seconds("ts").alias("timestamp"), F.lit(True).alias("is_final"), F.lit(0).alias("rule_order"),
        F.col("event_type").alias("signal_type"), F.lit(None).cast("string").alias("rule_name"),
        F.least(F.lit(1.0), F.col("value") / 20.0).alias("confidence"), F.lit(None).cast("string").alias("new_topic"),
        F.col("event_type").alias("evidence"))


def nudges_of_events(spark, sf):
    d = nd.nudge_decisions(_event_signals(spark, sf), HOURS, segment_seconds=86400.0)
    return d.select("session_id", "chunk_sequence", "signal_type", "decision")


def expired_nudges(spark, sf):
    d = nd.nudge_decisions(_event_signals(spark, sf), HOURS, segment_seconds=86400.0)
    cutoff = 1705000000.0
    return nd.expired_at(d, cutoff).groupBy("session_id").agg(F.count("*").alias("n_expired"))


def _latency_stamps(spark, sf):
    e = read(spark, sf, "events")
    t0 = epoch_seconds("ts")
    t1 = t0 + F.col("value") / 1000.0
    t2 = F.when(F.col("event_id") % 3 != 0, t1 + F.col("user_id") / 100000.0)
    t3 = F.when(F.col("event_id") % 5 != 0, t2 + 0.004)
    t4 = F.when(F.col("event_id") % 7 != 0, t3 - 0.001 + F.col("event_id") % 11 / 1000.0)
    return e.select("event_id", t0.alias("t0"), t1.alias("t1"), t2.alias("t2"), t3.alias("t3"), t4.alias("t4"))


def latency_summary(spark, sf):
    return c.latency_summary(_latency_stamps(spark, sf))


def session_stats(spark, sf):
    e = sg.usable_events(_events(spark, sf))
    s = written(sg.detect_signals(_events(spark, sf)), "signals")
    return c.session_stats(e, s, nd.nudge_decisions(s))


def tumbling_slices(spark, sf):
    s = c.tumbling_slices(read(spark, sf, "events"), "ts", "500 milliseconds", ["event_type"])
    return s.select("event_type", "slice_start", "n", F.round("total", 4).alias("total"))


def audio_slices(spark, sf):
    """Half-second slices with activity per user of the stored events, and the time they cover."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.floor(epoch_seconds("ts") * 2).alias("slice")).distinct()
    return e.groupBy("session_id").agg(F.count("*").alias("chunk_count"), F.sum(F.lit(500.0)).alias("duration_ms"))


def call_transcript(spark, sf):
    return c.call_transcript(_call_turns(spark, sf)).select("call_id", "turn", "role", "text")


def _asked(spark, sf):
    """Requested state per turn: what the turn's intent asks for."""
    states = list(v.STATE_MOVES)
    t = turns(spark, sf)
    pick = ((F.col("session_id") * 3 + F.col("chunk_sequence") * 5) % len(states) + 1).cast("int")
    return t.select("session_id", F.col("chunk_sequence").alias("seq"),
                    F.element_at(F.array(*[F.lit(s) for s in states]), pick).alias("to_state"))


_STATES = list(v.STATE_MOVES)
SQL_ASKED = f"""asked AS (SELECT conv_id AS session_id, turn AS seq, {sql_list(_STATES)}[(conv_id * 3 + turn * 5) % {len(_STATES)} + 1] AS to_state FROM conversations)"""


def transition_audit(spark, sf):
    return c.invalid_moves(c.state_log(_asked(spark, sf))).select("session_id", "seq", "from_state", "to_state")


def final_states(spark, sf):
    return c.final_states(_asked(spark, sf))


def event_log_sanitize(spark, sf):
    return turns(spark, sf).select("session_id", "chunk_sequence", sanitize("text").alias("payload_text"))


def event_log_map(spark, sf):
    e = turns(spark, sf).withColumn("payload", F.create_map(F.lit("turn"), F.col("chunk_sequence").cast("string"), F.lit("text"), F.col("text")))
    return c.call_event_log(e).select("session_id", "chunk_sequence", F.element_at("payload", "turn").alias("turn"), F.element_at("payload", "text").alias("text"))


def event_payload_nested(spark, sf):
    """Given properties two levels deep beside texts that name addresses and numbers; every seventh payload is no JSON."""
    e = read(spark, sf, "events")
    number = F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")
    nested = F.concat(F.lit('{"call":{"notes":["write \\\\ \\"u'), F.col("user_id"), F.lit('@mail.example.com\\" now",{"props":'), F.col("props"),
                      F.lit(',"u@x.co":"call\\n415-555-'), number, F.lit('"}],"n":'), F.col("event_id"), F.lit("}}"))
    raw = F.when(F.col("event_id") % 7 == 3, F.concat(F.lit("{a@b.com 415-555-"), number)).otherwise(nested)
    return e.select("event_id", sanitize_json(raw).alias("payload"))


def last_user_query(spark, sf):
    return c.last_user_message(read(spark, sf, "conversations"))


def rolling_context(spark, sf):
    return c.rolling_context(read(spark, sf, "conversations")).select("conv_id", "turn", "context")


def _call_turns(spark, sf):
    t = turns(spark, sf)
    asked = _asked(spark, sf).withColumnRenamed("seq", "chunk_sequence")
    low = F.lower("text")
    return t.join(asked, ["session_id", "chunk_sequence"]).select(
        F.col("session_id").alias("call_id"), F.col("chunk_sequence").alias("turn"), "role", "text",
        F.col("to_state").alias("state"),
        F.when(low.contains("po"), "taglish").otherwise("en").alias("language"),
        low.contains("human").alias("escalated"),
        F.filter(F.array(*[F.when(low.contains(k), k) for k in ("premium", "policy", "tenor", "cicilan")]), lambda x: x.isNotNull()).alias("terms"),
        (F.col("chunk_sequence") % 3 != 1).alias("grounded"), F.col("text").alias("answer"))


def call_summary(spark, sf):
    s = c.call_summary(_call_turns(spark, sf))
    return s.select("call_id", "turns", "final_state", "final_language", "escalated", F.array_join("detected_terms", ",").alias("detected_terms"))


def escalation_extract(spark, sf):
    return c.escalated_calls(_call_turns(spark, sf))


def fallback_extract(spark, sf):
    return c.fallback_turns(_call_turns(spark, sf)).select("call_id", "turn", "grounded", "state")


def _lead_updates(spark, sf):
    o = read(spark, sf, "orders")
    n = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("call_id"), F.col("o_orderkey").alias("seq"),
        F.when(n % 3 == 0, F.col("o_orderpriority")).alias("business_type"),
        F.when(n % 4 == 0, (n % 9).cast("double")).alias("years_in_business"),
        F.when(n % 2 == 0, F.col("o_totalprice")).alias("monthly_revenue"),
        F.when(n % 5 != 0, F.col("o_totalprice") * 2).alias("requested_amount"),
        F.col("o_orderstatus").alias("qualification_status"),
        F.when(n % 6 == 0, F.concat(F.lit("P"), (n % 4).cast("string"))).when(n % 6 == 1, "").alias("recommended_product"),
        (n % 7 != 0).alias("contact_permission"),
        F.when(n % 8 == 0, F.concat(F.lit("note "), n.cast("string"))).alias("notes"),
        F.floor(epoch_seconds("o_orderdate")).alias("updated_at"))


def lead_upsert(spark, sf):
    return c.upsert_leads(_lead_updates(spark, sf), ["seq"])


_LEAD_COLUMNS = ("lead_id", "call_id", "business_type", "monthly_revenue", "qualification_status", "created_at")


def lead_list(spark, sf):
    return c.lead_list(lead_upsert(spark, sf)).select("position", *_LEAD_COLUMNS)


def lead_by_call(spark, sf):
    asked = read(spark, sf, "events").select(F.col("user_id").alias("call_id"))
    return c.leads_of_calls(lead_upsert(spark, sf), asked).select(*_LEAD_COLUMNS)


def lead_by_id(spark, sf):
    asked = read(spark, sf, "customer").select(stable_id("lead", "c_custkey").alias("lead_id"))
    return c.leads_by_id(lead_upsert(spark, sf), asked).select(*_LEAD_COLUMNS)


def call_events(spark, sf):
    """Events of the calls that have a lead, in order."""
    events = read(spark, sf, "events").withColumnRenamed("user_id", "call_id")
    return c.events_of_calls(events, lead_upsert(spark, sf), "event_id").select("call_id", "event_no", "event_id", "event_type")


def lead_notes(spark, sf):
    return c.lead_notes(_lead_updates(spark, sf), "seq")


def _attempts(spark, sf):
    e = read(spark, sf, "events")
    failed = F.col("event_type").isin("error", "view", "click") & (F.col("event_id") % 4 != 0)
    errors = F.element_at(F.array(*[F.lit(x) for x in ERRORS]), (F.col("event_id") % len(ERRORS) + 1).cast("int"))
    return e.select(
        F.concat(F.lit("Provider"), (F.col("user_id") % 9).cast("string")).alias("provider"), F.col("event_id").alias("seq"),
        (~failed).alias("success"), F.when(failed, errors).alias("error"),
        F.when(failed & (F.col("event_id") % 10 == 0), "timeout").otherwise("error").alias("error_type"),
        F.when(F.col("event_id") % 6 == 5, 401).when(F.col("event_id") % 6 == 4, 404).alias("status_code"),
        F.floor(F.col("event_id") / 3).alias("request_id"), (F.col("event_id") % 3).alias("idx"))


ERRORS = ("Request timed out", "HTTP 429", "Rate limit reached", "Bad schema", "Connection refused", "Simulated failure", "HTTP 503 Service Unavailable")
SQL_ATTEMPTS = f"""
attempts AS (
  SELECT *, CASE WHEN success THEN NULL ELSE {sql_list(ERRORS)}[event_id % {len(ERRORS)} + 1] END AS error,
    CASE WHEN NOT success AND event_id % 10 = 0 THEN 'timeout' ELSE 'error' END AS error_type,
    CASE WHEN event_id % 6 = 5 THEN 401 WHEN event_id % 6 = 4 THEN 404 END AS status_code, event_id // 3 AS request_id, event_id % 3 AS idx
  FROM (SELECT *, 'provider' || (user_id % 9) AS provider, NOT (event_type IN ('error', 'view', 'click') AND event_id % 4 <> 0) AS success FROM events))"""


def provider_health(spark, sf):
    return c.provider_health(_attempts(spark, sf), ["seq"])


def fallback_outcome(spark, sf):
    return c.fallback_outcome(_attempts(spark, sf))


def retryable_errors(spark, sf):
    return _attempts(spark, sf).select("seq", c.retryable("status_code", "error").alias("retryable"))


QUERIES = {f.__name__: f for f in (
    transcript_events, topic_shift, disclosure_gap, rule_signals, nudges_greedy, nudges_of_events, expired_nudges,
    latency_summary, session_stats, tumbling_slices, audio_slices, transition_audit, final_states, event_log_sanitize,
    event_log_map, event_payload_nested, last_user_query, rolling_context, call_summary, escalation_extract, fallback_extract, call_transcript, lead_upsert, lead_list, lead_by_call, lead_by_id, call_events, lead_notes,
    provider_health, fallback_outcome, retryable_errors,
)}

_SIG = (SQL_TURNS, SQL_EVENTS, SQL_CONTEXT, SQL_SIGNALS)
_NUDGED = (*_SIG, sql_fold("signals", v.NUDGE_EXPIRY, str(v.NUDGE_COOLDOWN)))
_EVENT_SIG = """esig AS (SELECT user_id AS session_id, event_id AS chunk_sequence, epoch_us(ts) / 1e6 AS ts, true AS is_final, 0 AS rule_order,
  event_type AS signal_type, least(1.0, value / 20.0) AS confidence FROM events)"""
_EVENT_FOLD = (_EVENT_SIG, sql_fold("esig", HOURS.expiry, str(HOURS.cooldown), HOURS.min_confidence))
_SANITIZED = (f"regexp_replace(regexp_replace(text, '[\\p{{L}}\\p{{N}}_.-]+@[\\p{{L}}\\p{{N}}_.-]+\\.[\\p{{L}}\\p{{N}}_]+', '{v.EVENT_EMAIL_MASK}', 'g'), "
              f"'{v.EVENT_PHONE}', '{v.EVENT_PHONE_MASK}', 'g')")
_CALLS = (SQL_TURNS, SQL_ASKED, """calls AS (
  SELECT t.session_id AS call_id, chunk_sequence AS turn, role, text, to_state AS state, CASE WHEN contains(lower(text), 'po') THEN 'taglish' ELSE 'en' END AS language,
    contains(lower(text), 'human') AS escalated, list_filter(['premium', 'policy', 'tenor', 'cicilan'], lambda k: contains(lower(text), k)) AS terms,
    chunk_sequence % 3 <> 1 AS grounded FROM turns t JOIN asked a ON t.session_id = a.session_id AND chunk_sequence = seq)""")
_MOVES = ", ".join(f"('{a}', '{b}')" for a, b in c.moves())
_STEP = f"CASE WHEN a.to_state IN {v.ALWAYS_REACHABLE} OR (s.state || '>' || a.to_state) IN ({', '.join(sql_str(a + '>' + b) for a, b in c.moves())}) THEN a.to_state ELSE s.state END"

_LEADS = """leads AS (SELECT 'lead_' || substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 16) AS lead_id, o_custkey AS call_id,
    coalesce(arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 = 0), '') AS business_type, arg_max(o_totalprice, o_orderkey) FILTER (o_orderkey % 2 = 0) AS monthly_revenue,
    arg_max(o_orderstatus, o_orderkey) AS qualification_status, CAST(epoch(min(o_orderdate)) AS BIGINT) AS created_at FROM orders GROUP BY o_custkey)"""

ORACLE = {
    "lead_list": _with(_LEADS) + " SELECT row_number() OVER (ORDER BY created_at, call_id) AS position, * FROM leads",
    "lead_by_call": _with(_LEADS) + """ SELECT lead_id, a.call_id, business_type, monthly_revenue, qualification_status, created_at
      FROM (SELECT DISTINCT user_id AS call_id FROM events) a LEFT JOIN leads USING (call_id)""",
    "lead_by_id": _with(_LEADS) + """ SELECT a.lead_id, call_id, business_type, monthly_revenue, qualification_status, created_at
      FROM (SELECT 'lead_' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) AS lead_id FROM customer) a LEFT JOIN leads USING (lead_id)""",
    "call_events": """SELECT user_id AS call_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS event_no, event_id, event_type
      FROM events WHERE user_id IN (SELECT o_custkey FROM orders)""",
    "transcript_events": _with(SQL_TURNS, SQL_EVENTS) + " SELECT session_id, chunk_sequence, ts AS timestamp, is_final, text, round(confidence, 4) AS confidence FROM raw_events",
    "topic_shift": _with(*_SIG) + " SELECT session_id, chunk_sequence, evidence, new_topic FROM signals WHERE signal_type = 'topic_shift'",
    "disclosure_gap": _with(SQL_TURNS, SQL_EVENTS, SQL_CONTEXT) + " SELECT session_id, chunk_sequence, is_final, disclosed FROM context",
    "rule_signals": _with(*_SIG) + """ SELECT session_id, chunk_sequence, is_final, speaker, signal_type, rule_name, confidence, severity, evidence,
      'sig_' || rule_name || '_' || CAST(floor(ts * 1000) AS BIGINT) AS signal_id FROM signals WHERE source = 'rule'""",
    "nudges_greedy": _with(*_NUDGED, recursive=True) + f""" SELECT session_id, chunk_sequence, is_final, signal_type,
      'sig_' || coalesce(rule_name, 'topic') || '_' || CAST(floor(ts * 1000) AS BIGINT) AS signal_id, decision, {SQL_CONTENT},
      CASE WHEN decision = 'emitted' THEN ts + {v.NUDGE_EXPIRY} END AS expires_at FROM decided""",
    "nudges_of_events": _with(*_EVENT_FOLD, recursive=True) + " SELECT session_id, chunk_sequence, signal_type, decision FROM decided",
    "expired_nudges": _with(*_EVENT_FOLD, recursive=True) + f" SELECT session_id, count(*) AS n_expired FROM decided WHERE decision = 'emitted' AND ts + {HOURS.expiry} <= 1705000000.0 GROUP BY 1",
    "latency_summary": """
      WITH s0 AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t0, value FROM events), s1 AS (SELECT *, t0 + value / 1000.0 AS t1 FROM s0),
      s2 AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN t1 + user_id / 100000.0 END AS t2 FROM s1),
      s3 AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN t2 + 0.004 END AS t3 FROM s2),
      s4 AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN t3 - 0.001 + event_id % 11 / 1000.0 END AS t4 FROM s3),
      long AS (SELECT 'asr' AS segment, (t1 - t0) * 1000.0 AS ms FROM s4 UNION ALL SELECT 'signal', (t2 - t1) * 1000.0 FROM s4 UNION ALL
        SELECT 'nudge', (t3 - t2) * 1000.0 FROM s4 UNION ALL SELECT 'delivery', (t4 - t3) * 1000.0 FROM s4 UNION ALL
        SELECT 'end_to_end', (coalesce(t4, t3, t2, t1) - t0) * 1000.0 FROM s4),
      x AS (SELECT segment, greatest(0.0, ms) AS ms FROM long WHERE ms IS NOT NULL)
      SELECT segment, count(*) AS sample_size, round(quantile_cont(ms, 0.5), 2) AS p50_ms, round(quantile_cont(ms, 0.95), 2) AS p95_ms,
        round(min(ms), 2) AS min_ms, round(max(ms), 2) AS max_ms, round(avg(ms), 2) AS mean_ms FROM x GROUP BY 1""",
    "session_stats": _with(*_NUDGED, recursive=True) + """ SELECT e.session_id, e.n AS transcripts_count, f AS final_count, coalesce(s.n, 0) AS signals_count,
      coalesce(emitted, 0) AS nudges_count, coalesce(s.n - emitted, 0) AS suppressed_count
      FROM (SELECT session_id, count(*) AS n, count(*) FILTER (is_final) AS f FROM events GROUP BY 1) e
      LEFT JOIN (SELECT session_id, count(*) AS n, count(*) FILTER (decision = 'emitted') AS emitted FROM decided GROUP BY 1) s USING (session_id)""",
    "tumbling_slices": "SELECT event_type, epoch_us(ts) // 500000 * 500000 AS slice_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "audio_slices": "SELECT user_id AS session_id, count(DISTINCT floor(epoch_us(ts) / 500000.0)) AS chunk_count, CAST(count(DISTINCT floor(epoch_us(ts) / 500000.0)) * 500.0 AS DOUBLE) AS duration_ms FROM events GROUP BY 1",
    "call_transcript": _with(SQL_TURNS) + " SELECT session_id AS call_id, chunk_sequence AS turn, role, text FROM turns",
    "transition_audit": _with(SQL_ASKED, "a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM asked)",
                              f"s AS (SELECT session_id, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::VARCHAR AS from_state, NULL::VARCHAR AS to_state, 'GREETING' AS state FROM a GROUP BY 1 "
                              f"UNION ALL SELECT a.session_id, a.rn, a.seq, s.state, a.to_state, {_STEP} FROM s JOIN a ON a.session_id = s.session_id AND a.rn = s.rn + 1)",
                              recursive=True) + f""" SELECT session_id, seq, from_state, to_state FROM s WHERE rn > 0
      AND (from_state, to_state) NOT IN (VALUES {_MOVES}) AND to_state NOT IN {v.ALWAYS_REACHABLE}""",
    "final_states": _with(SQL_ASKED, "a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM asked)",
                          f"s AS (SELECT session_id, 0::BIGINT AS rn, 'GREETING' AS state FROM a GROUP BY 1 UNION ALL SELECT a.session_id, a.rn, {_STEP} FROM s JOIN a ON a.session_id = s.session_id AND a.rn = s.rn + 1)",
                          recursive=True) + " SELECT session_id, arg_max(state, rn) AS final_state FROM s GROUP BY 1",
    "event_log_sanitize": _with(SQL_TURNS) + f" SELECT session_id, chunk_sequence, {_SANITIZED} AS payload_text FROM turns",
    "event_log_map": _with(SQL_TURNS) + f" SELECT session_id, chunk_sequence, CAST(chunk_sequence AS VARCHAR) AS turn, {_SANITIZED} AS text FROM turns",
    "event_payload_nested": f"""SELECT event_id, CASE WHEN event_id % 7 = 3 THEN '{{{v.EVENT_EMAIL_MASK} {v.EVENT_PHONE_MASK}' ELSE
      '{{"call":{{"n":' || event_id || ',"notes":["write \\\\ \\"{v.EVENT_EMAIL_MASK}\\" now",{{"props":' || replace(props, ' ', '') || ',"u@x.co":"call\\n{v.EVENT_PHONE_MASK}"}}]}}}}' END AS payload FROM events""",
    "last_user_query": "SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role IN ('user', 'human')), arg_max(text, turn)) AS query FROM conversations GROUP BY 1",
    "rolling_context": """SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations""",
    "call_summary": _with(*_CALLS) + """ SELECT call_id, count(*) AS turns, arg_max(state, turn) AS final_state,
      arg_max(language, turn) AS final_language, bool_or(escalated) AS escalated, array_to_string(list_sort(list_distinct(flatten(list(terms)))), ',') AS detected_terms FROM calls GROUP BY 1""",
    "escalation_extract": _with(*_CALLS) + " SELECT call_id, arg_min(text, turn) FILTER (role = 'user') AS first_utterance FROM calls GROUP BY 1 HAVING bool_or(escalated)",
    "fallback_extract": _with(*_CALLS) + """ SELECT call_id, turn, grounded, state FROM calls WHERE NOT grounded OR contains(lower(text), 'clarify') OR contains(lower(text), 'don''t have verified')""",
    "lead_upsert": """
      WITH u AS (SELECT o_custkey AS call_id, o_orderkey AS n, *, CASE WHEN o_orderkey % 6 = 0 THEN 'P' || (o_orderkey % 4) WHEN o_orderkey % 6 = 1 THEN '' END AS prod FROM orders)
      SELECT call_id, coalesce(arg_max(o_orderpriority, n) FILTER (n % 3 = 0), '') AS business_type,
        arg_max((n % 9)::DOUBLE, n) FILTER (n % 4 = 0) AS years_in_business, arg_max(o_totalprice, n) FILTER (n % 2 = 0) AS monthly_revenue,
        arg_max(o_totalprice * 2, n) FILTER (n % 5 <> 0) AS requested_amount, arg_max(o_orderstatus, n) AS qualification_status,
        arg_max(prod, n) FILTER (prod <> '') AS recommended_product, arg_max(n % 7 <> 0, n) AS contact_permission,
        count(*) FILTER (n % 8 = 0) AS n_notes,
        CAST(epoch(min(o_orderdate)) AS BIGINT) AS created_at, CAST(epoch(max(o_orderdate)) AS BIGINT) AS updated_at FROM u GROUP BY 1""",
    "lead_notes": """SELECT o_custkey AS call_id, o_orderkey AS seq, 'note ' || o_orderkey AS notes,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS note_no FROM orders WHERE o_orderkey % 8 = 0""",
    "provider_health": _with(SQL_ATTEMPTS, """
      f AS (SELECT *, NOT success AND (contains(lower(error), 'timed out') OR contains(lower(error), 'timeout') OR error_type = 'timeout') AS to_, event_id AS seq FROM attempts),
      last AS (SELECT provider, max(seq) FILTER (success) AS ls FROM f GROUP BY 1),
      t AS (SELECT f.provider, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failure_count, count(*) FILTER (to_) AS timeout_count,
        count(*) FILTER (NOT success AND NOT to_ AND (contains(error, '429') OR contains(lower(error), 'rate limit'))) AS rate_limit_count,
        arg_max(error, seq) FILTER (NOT success) AS last_error, count(*) FILTER (NOT success AND (ls IS NULL OR seq > ls)) AS consecutive_failures
        FROM f JOIN last USING (provider) GROUP BY 1)""") + f""" SELECT *, CASE WHEN consecutive_failures >= {v.UNHEALTHY_AFTER} THEN 'unhealthy'
        WHEN consecutive_failures >= {v.DEGRADED_AFTER} THEN 'degraded' WHEN success_count > 0 THEN 'healthy' ELSE 'standby' END AS status FROM t""",
    "fallback_outcome": _with(SQL_ATTEMPTS) + """ SELECT request_id, 'P' || substr(arg_min(provider, idx), 2) || '' AS primary_provider, 'P' || substr(arg_min(provider, idx) FILTER (success), 2) AS final_provider,
      bool_or(success) AS success, coalesce(min(idx) FILTER (success) > 0, false) AS fallback_used, coalesce(min(idx) FILTER (success), 0) AS fallback_count, count(*) AS attempts FROM attempts GROUP BY 1""",
    "retryable_errors": _with(SQL_ATTEMPTS) + f""" SELECT event_id AS seq, coalesce(status_code IN {v.RETRYABLE_CODES}, false) OR {' OR '.join(f"contains(lower(coalesce(error, '')), {sql_str(p)})" for p in v.RETRYABLE_PHRASES)} AS retryable FROM attempts""",
}
