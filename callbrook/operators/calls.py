"""Call-level figures: latency, session counters, states, leads, providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions.clock import epoch_micros
from callbrook.functions.quality import sanitize_map
from callbrook.functions.text import contains_any, stable_id
from callbrook.operators.carry import Running, running
from callbrook.operators.ranking import ranked
from callbrook.session import written

# --- percentiles and latency -------------------------------------------------


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                      accuracy: int = 10_000, exclusive: bool = False) -> DataFrame:
    """Exact linearly interpolated percentiles of groups of any size
    (``exclusive`` treats the data as a sample: ranks run over n + 1).

    A sketch brackets each wanted rank, values below the bracket are only
    counted, and just the bracket (equal values collapsed) is ranked.  The
    bracket must lie beyond the needed ranks by the sketch's own error and some
    whole rows; of a ladder of widths each group takes the first that does, so
    a small group is ranked whole and a large one to a few parts in
    ``accuracy``.  No task holds a large group's values.
    """
    widths = [4.0 ** j / accuracy for j in range(1, 30) if 4.0 ** (j - 1) < accuracy]
    ends = [(p, e) for p in probs.values() for e in widths]
    n = df.groupBy(*keys).agg(F.count(value).alias("__n"), F.percentile_approx(
        value, [x for p, e in ends for x in (max(0.0, p - e), min(1.0, p + e))], accuracy).alias("__b"))

    def end(i: int, p: float, side: int) -> Column:
        out = F.lit(side * float("inf"))
        for j in reversed(range(len(widths))):
            e = widths[j]
            open_ = p - e <= 0 if side < 0 else p + e >= 1
            found = F.lit(side * float("inf")) if open_ else F.get("__b", F.lit(2 * (i * len(widths) + j) + (side > 0)))
            out = F.when(F.col("__n") * e >= F.col("__n") / accuracy + 4, found).otherwise(out)
        return out

    wanted = F.explode(F.array(*[F.struct(
        F.lit(name).alias("__name"), F.lit(p).alias("__p"), end(i, p, -1).alias("__lo"), end(i, p, 1).alias("__hi"))
        for i, (name, p) in enumerate(probs.items())]))
    brackets = n.select(*keys, "__n", wanted.alias("w")).select(*keys, "__n", "w.*")
    values = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    near = values.join(brackets, list(keys)).filter(F.col(value) <= F.col("__hi"))
    below = near.groupBy(*keys, "__name").agg(
        F.coalesce(F.sum(F.when(F.col(value) < F.col("__lo"), F.col("__c"))), F.lit(0)).alias("__below"))
    inside = near.filter(F.col(value) >= F.col("__lo")).join(below, [*keys, "__name"])
    w = Window.partitionBy(*keys, "__name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("__below") + F.sum("__c").over(w) - 1  # zero-based rank of the value's last copy
    last_rank = F.col("__n") - 1
    k = F.greatest(F.lit(0.0), F.least(last_rank, (F.col("__n") + 1) * F.col("__p") - 1)) if exclusive else last_rank * F.col("__p")
    ranked = inside.withColumn("__last", last).withColumn("__first", F.col("__last") - F.col("__c") + 1) \
        .withColumn("__f", F.floor(k)).withColumn("__g", F.ceil(k)).withColumn("__k", k)

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("__first") <= F.col(rank)) & (F.col(rank) <= F.col("__last")), F.col(value)))

    picked = ranked.groupBy(*keys, "__name").agg(
        at("__f").alias("__a"), at("__g").alias("__z"), F.max(F.col("__k") - F.col("__f")).alias("__t"))
    exact = picked.withColumn("__x", F.col("__a") * (1 - F.col("__t")) + F.col("__z") * F.col("__t"))
    return exact.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, F.col("__x"))).alias(name) for name in probs])


def latency_segments(m: DataFrame) -> DataFrame:
    """(event_id, segment, ms) in long form, null segments left out."""
    t0, t1, t2, t3, t4 = (F.col(f"t{i}") for i in range(5))

    def ms(end: Column, start: Column) -> Column:
        gap = (end - start) * 1000.0
        return F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap))

    def present(t: Column) -> Column:  # a zero stamp counts as absent here
        return F.nullif(t, F.lit(0.0))

    end = F.coalesce(present(t4), present(t3), present(t2), t1)
    wide = {"asr": ms(t1, t0), "signal": ms(t2, t1), "nudge": ms(t3, t2), "delivery": ms(t4, t3), "end_to_end": ms(end, t0)}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), x.alias("ms")) for k, x in wide.items()]))
    return m.select("event_id", rows.alias("r")).select("event_id", "r.*").filter("ms IS NOT NULL")


def latency_summary(m: DataFrame) -> DataFrame:
    long = latency_segments(m)
    p = exact_percentiles(long, ["segment"], "ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    s = long.groupBy("segment").agg(F.count("*").alias("sample_size"), F.min("ms").alias("min_ms"),
                                    F.max("ms").alias("max_ms"), F.avg("ms").alias("mean_ms"))
    return s.join(p, "segment").select("segment", "sample_size", *[
        F.round(c, 2).alias(c) for c in ("p50_ms", "p95_ms", "min_ms", "max_ms", "mean_ms")])


# --- sessions ----------------------------------------------------------------


def session_stats(events: DataFrame, signals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Counters per session; each input is reduced before the join."""
    e = events.groupBy("session_id").agg(F.count("*").alias("transcripts_count"),
                                         F.count_if("is_final").alias("final_count"))
    s = signals.groupBy("session_id").agg(F.count("*").alias("signals_count"))
    d = decisions.groupBy("session_id").agg(
        F.count_if(F.col("decision") == "emitted").alias("nudges_count"),
        F.count_if(F.col("decision") != "emitted").alias("suppressed_count"))
    out = e.join(s, "session_id", "left").join(d, "session_id", "left")
    return out.select("session_id", "transcripts_count", "final_count", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in ("signals_count", "nudges_count", "suppressed_count")])


def tumbling_slices(events: DataFrame, ts: str, width: str, keys: Sequence[str] = ()) -> DataFrame:
    return events.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")) \
        .withColumn("slice_start", epoch_micros(F.col("window.start"))).drop("window")


# --- conversation states -----------------------------------------------------


def moves() -> list[tuple[str, str]]:
    return [(a, b) for a, bs in v.STATE_MOVES.items() for b in bs]


def invalid_moves(log: DataFrame) -> DataFrame:
    """Requested (from_state, to_state) pairs the table does not allow; ending
    and escalating are always possible."""
    allowed = log.sparkSession.createDataFrame(moves(), "from_state string, to_state string")
    return log.join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti") \
        .filter(~F.col("to_state").isin(*v.ALWAYS_REACHABLE))


def next_state(state: Column, asked: Column) -> Column:
    table = F.create_map(*[x for s, bs in v.STATE_MOVES.items() for x in (
        F.lit(s), F.array(*[F.lit(b) for b in bs]).cast("array<string>"))])
    ok = F.array_contains(F.element_at(table, state), asked) | asked.isin(*v.ALWAYS_REACHABLE)
    return F.when(ok, asked).otherwise(state)


def _state_functions(log: DataFrame, block: int):
    """Requests of consecutive blocks, and the functions from states to states that blocks and blocks of blocks are.

    A run of requests is such a function, and functions compose, so no session is walked row by row in one task.
    """
    states = list(v.STATE_MOVES)
    counted = running(log, ["session_id"], ["seq"], F.floor(F.col("seq") / block), [Running("__i", "sum", F.lit(1))])
    runs = counted.withColumn("b1", F.floor(F.col("__i") / block)).groupBy("session_id", "b1") \
        .agg(F.array_sort(F.collect_list(F.struct("seq", "to_state"))).alias("asked"))
    asked = F.transform("asked", lambda r: r["to_state"])
    runs = written(runs.withColumn("fn", F.array(*[F.aggregate(asked, F.lit(s), next_state) for s in states]))
                   .withColumn("b2", F.floor(F.col("b1") / block)), "blocks")
    listed = runs.groupBy("session_id", "b2").agg(F.array_sort(F.collect_list(F.struct("b1", "fn"))).alias("fns"))
    return runs, listed.withColumn("fn", F.array(*[_through("fns", F.lit(s)) for s in states]))


def _apply(fn: Column, state: Column) -> Column:
    return F.get(fn, F.array_position(F.array(*map(F.lit, v.STATE_MOVES)), state).cast("int") - 1)


def _through(fns: str, start: Column) -> Column:
    return F.aggregate(fns, start, lambda state, f: _apply(f["fn"], state))


def _starts(fns: str, start: Column, order: str) -> Column:
    """(order, state before it) of a list of functions."""
    first = F.struct(F.array().cast(f"array<struct<{order}:bigint,state:string>>").alias("out"), start.alias("state"))
    return F.aggregate(fns, first, lambda acc, f: F.struct(
        F.array_append(acc["out"], F.struct(f[order].cast("long").alias(order), acc["state"].alias("state"))).alias("out"),
        _apply(f["fn"], acc["state"]).alias("state")), lambda acc: acc["out"])


def state_log(log: DataFrame, start: str = "GREETING", block: int = 1024) -> DataFrame:
    """Each request with ``from_state``, the state it meets: invalid requests leave the state as it was."""
    runs, second = _state_functions(log, block)
    whole = second.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("b2", "fn"))).alias("fns2"))
    at2 = whole.select("session_id", F.explode(_starts("fns2", F.lit(start), "b2")).alias("x")).select("session_id", "x.b2", F.col("x.state").alias("s2"))
    at1 = second.join(at2, ["session_id", "b2"]).select("session_id", F.explode(_starts("fns", F.col("s2"), "b1")).alias("x")) \
        .select("session_id", "x.b1", F.col("x.state").alias("s1"))
    rows = runs.join(at1, ["session_id", "b1"])
    first = F.struct(F.array().cast("array<struct<seq:bigint,from_state:string,to_state:string>>").alias("out"), F.col("s1").alias("state"))
    walked = F.aggregate("asked", first, lambda acc, r: F.struct(
        F.array_append(acc["out"], F.struct(r["seq"].cast("long").alias("seq"), acc["state"].alias("from_state"), r["to_state"].alias("to_state"))).alias("out"),
        next_state(acc["state"], r["to_state"]).alias("state")), lambda acc: acc["out"])
    return rows.select("session_id", F.explode(walked).alias("x")).select("session_id", "x.*")


def final_states(log: DataFrame, start: str = "GREETING", block: int = 1024) -> DataFrame:
    """State each session ends in when invalid requests leave it unchanged."""
    _, second = _state_functions(log, block)
    whole = second.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("b2", "fn"))).alias("fns"))
    return whole.select("session_id", _through("fns", F.lit(start)).alias("final_state"))


# --- call events and leads ---------------------------------------------------


def call_event_log(events: DataFrame) -> DataFrame:
    """Audit rows with masked payload values (a string map)."""
    return events.withColumn("payload", sanitize_map("payload"))


def upsert_leads(updates: DataFrame, order: Sequence[str], notes_text: bool = False) -> DataFrame:
    """One lead per call from its updates in order: last given value per field,
    last status.  Every figure combines map-side.  Notes are counted here and
    listed by ``lead_notes``; ``notes_text`` joins them into the lead instead,
    for data where no call collects an unbounded number."""
    at = F.struct(*order)

    def last(c: str, given: Column | None = None) -> Column:
        known = F.col(c).isNotNull() if given is None else given
        return F.max_by(F.col(c), F.when(known, at))

    noted = F.coalesce("notes", F.lit("")) != ""
    listed = F.array_sort(F.collect_list(F.when(noted, F.struct(*order, "notes"))))
    text = [F.array_join(F.transform(listed, lambda s: s["notes"]), "\n").alias("notes")] if notes_text else []
    fields = [c for c in ("years_in_business", "monthly_revenue", "requested_amount") if c in updates.columns]
    return updates.groupBy("call_id").agg(
        F.coalesce(last("business_type"), F.lit("")).alias("business_type"),
        *[last(c).alias(c) for c in fields],
        F.max_by("qualification_status", at).alias("qualification_status"),
        last("recommended_product", F.coalesce("recommended_product", F.lit("")) != "").alias("recommended_product"),
        F.max_by("contact_permission", at).alias("contact_permission"),
        F.count_if(noted).alias("n_notes"),
        *text,
        F.min("updated_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    )


_LEAD_NUMBERS = ("years_in_business", "monthly_revenue", "requested_amount")


def lead_state(updates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Leads that can be merged: each field with the place of the update that gave it."""
    at = F.struct(*order)

    def last(c: str, known: Column) -> Column:
        return F.max(F.when(known, F.struct(at.alias("at"), F.col(c).alias("value")))).alias(c)

    always = F.lit(True)
    return updates.groupBy("call_id").agg(
        *[last(c, F.col(c).isNotNull()) for c in ("business_type", *[c for c in _LEAD_NUMBERS if c in updates.columns])],
        last("qualification_status", always), last("recommended_product", F.coalesce("recommended_product", F.lit("")) != ""),
        last("contact_permission", always), F.count_if(F.coalesce("notes", F.lit("")) != "").alias("n_notes"),
        F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def merge_leads(states: DataFrame) -> DataFrame:
    """Several states of a call as one; the order of merging does not matter."""
    fixed = {"n_notes": F.sum("n_notes"), "created_at": F.min("created_at")}
    return states.groupBy("call_id").agg(*[fixed.get(c, F.max(c)).alias(c) for c in states.columns if c != "call_id"])


def leads_of(state: DataFrame) -> DataFrame:
    """The leads that ``upsert_leads`` would give."""
    plain = ("n_notes", "created_at", "updated_at")
    value = lambda c: F.coalesce(F.col(c)["value"], F.lit("")) if c == "business_type" else F.col(c)["value"]
    return state.select("call_id", *[F.col(c) if c in plain else value(c).alias(c) for c in state.columns if c != "call_id"])


def lead_notes(updates: DataFrame, order: str, segment: int = 4096) -> DataFrame:
    """Notes of every lead, numbered in order."""
    noted = updates.filter("notes <> ''").select("call_id", order, "notes")
    return running(noted, ["call_id"], [order], F.floor(F.col(order) / segment),
                   [Running("note_no", "sum", F.lit(1), inclusive=True)])


def call_summary(turns: DataFrame) -> DataFrame:
    """One row per call: turns, last state and language, flags and distinct
    terms.  The transcript itself stays a table (``call_transcript``)."""
    terms = turns.select("call_id", F.explode_outer("terms").alias("term")).filter("term IS NOT NULL").distinct() \
        .groupBy("call_id").agg(F.array_sort(F.collect_list("term")).alias("detected_terms"))
    calls = turns.groupBy("call_id").agg(
        F.count("*").alias("turns"),
        F.max_by("state", "turn").alias("final_state"),
        F.max_by("language", "turn").alias("final_language"),
        F.bool_or("escalated").alias("escalated"),
    )
    return calls.join(terms, "call_id", "left") \
        .withColumn("detected_terms", F.coalesce("detected_terms", F.array().cast("array<string>")))


def localized_call_summary(turns: DataFrame, qualified: DataFrame, leads: DataFrame) -> DataFrame:
    """``call_summary`` with the last register, the confirmed ``qualification`` of ``qualified`` and whether the call has a lead."""
    registers = turns.groupBy("call_id").agg(F.max_by("register", "turn").alias("final_register"))
    with_lead = leads.select("call_id").distinct().withColumn("lead_created", F.lit(True))
    return call_summary(turns).join(registers, "call_id").join(qualified.select("call_id", "qualification"), "call_id", "left") \
        .join(with_lead, "call_id", "left").withColumn("lead_created", F.coalesce("lead_created", F.lit(False)))


def with_lead_ids(leads: DataFrame) -> DataFrame:
    """The id of a lead follows from its call, so an update or a replay keeps it."""
    return leads.withColumn("lead_id", stable_id("lead", "call_id"))


def lead_list(leads: DataFrame) -> DataFrame:
    """All leads with their place in the order of creation, from 1; ties go to the smaller call."""
    return ranked(with_lead_ids(leads), "leads", "created_at", "call_id").withColumn("position", F.col("rank") + 1).drop("rank")


def leads_of_calls(leads: DataFrame, calls: DataFrame) -> DataFrame:
    """The lead of each asked call; a call without one gives a row of nulls."""
    return calls.select("call_id").distinct().join(with_lead_ids(leads), "call_id", "left")


def leads_by_id(leads: DataFrame, ids: DataFrame) -> DataFrame:
    """The lead of each asked id; an unknown id gives a row of nulls."""
    return ids.select("lead_id").distinct().join(with_lead_ids(leads), "lead_id", "left")


def events_of_calls(events: DataFrame, calls: DataFrame, order: str, segment: int = 4096) -> DataFrame:
    """The events of the asked calls, numbered from 1 within each call by ``order``, a whole number."""
    asked = events.join(calls.select("call_id").distinct(), "call_id", "left_semi")
    return running(asked, ["call_id"], [order], F.floor(F.col(order) / segment), [Running("event_no", "sum", F.lit(1), inclusive=True)])


def call_transcript(turns: DataFrame) -> DataFrame:
    """Turns in reading order, range-partitioned so that a long call spreads."""
    return turns.repartitionByRange("call_id", "turn").sortWithinPartitions("call_id", "turn")


def fallback_turns(turns: DataFrame) -> DataFrame:
    """Turns not grounded, or answered by asking back or abstaining."""
    return turns.filter(~F.col("grounded") | contains_any(F.lower("answer"), v.FALLBACK_MARKERS))


def escalated_calls(turns: DataFrame) -> DataFrame:
    """Escalated calls with the caller's first utterance."""
    return turns.groupBy("call_id").agg(
        F.bool_or("escalated").alias("escalated"),
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first_utterance"),
    ).filter("escalated").drop("escalated")


def last_user_message(messages: DataFrame) -> DataFrame:
    """Query text of a chat: the last user message, else the last message."""
    return messages.groupBy("conv_id").agg(F.coalesce(
        F.max_by("text", F.when(F.col("role").isin("user", "human"), F.col("turn"))), F.max_by("text", "turn")).alias("query"))


def rolling_context(turns: DataFrame, n: int = 4, block: int = 1024) -> DataFrame:
    """Previous ``n`` turns in one text per turn.

    Turns are counted first, whatever numbers they bear, and blocks are made
    of consecutive counts.  Each block also receives copies of the ``n`` turns
    before it, so the window never has to cross a block.
    """
    if block < n:
        raise ValueError("a block must hold the context")
    counted = written(running(turns, ["conv_id"], ["turn"], F.floor(F.col("turn") / block), [Running("__i", "sum", F.lit(1))]), "turns")
    own = counted.withColumn("__b", F.floor(F.col("__i") / block)).withColumn("__copy", F.lit(False))
    ahead = counted.filter(F.col("__i") % block >= block - n) \
        .withColumn("__b", F.floor(F.col("__i") / block) + 1).withColumn("__copy", F.lit(True))
    w = Window.partitionBy("conv_id", "__b").orderBy("__i").rowsBetween(-n, -1)
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    return own.unionByName(ahead).withColumn("context", F.array_join(F.collect_list(line).over(w), "\n")) \
        .filter(~F.col("__copy")).drop("__b", "__copy", "__i")


# --- providers ---------------------------------------------------------------


def retryable(status: Column | str, message: Column | str) -> Column:
    code = F.col(status) if isinstance(status, str) else status
    text = F.lower(F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")))
    return F.coalesce(code.isin(*v.RETRYABLE_CODES), F.lit(False)) | contains_any(text, v.RETRYABLE_PHRASES)


def provider_health(attempts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Counters and status per provider from its attempts log.

    Failures since the last success are found by comparing with that success,
    not by walking the log, so a busy provider needs no ordered pass.
    """
    at = F.struct(*order)
    failed = ~F.col("success")
    err = F.lower(F.coalesce("error", F.lit("")))
    timeout = failed & (err.contains("timeout") | err.contains("timed out") | (F.col("error_type") == "timeout"))
    limited = failed & ~timeout & (err.contains("429") | err.contains("rate limit") | (F.col("error_type") == "rate_limit"))
    a = attempts.select(F.lower("provider").alias("provider"), at.alias("at"), "success", "error",
                        F.coalesce(timeout, F.lit(False)).alias("timeout"), F.coalesce(limited, F.lit(False)).alias("limited"))
    totals = a.groupBy("provider").agg(
        F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"),
        F.count_if("timeout").alias("timeout_count"), F.count_if("limited").alias("rate_limit_count"),
        F.max(F.when(F.col("success"), F.col("at"))).alias("last_success"),
        F.max_by("error", F.when(~F.col("success"), F.col("at"))).alias("last_error"))
    since = a.filter(~F.col("success")).join(totals.select("provider", "last_success"), "provider") \
        .filter(F.col("last_success").isNull() | (F.col("at") > F.col("last_success"))) \
        .groupBy("provider").agg(F.count("*").alias("consecutive_failures"))
    out = totals.join(since, "provider", "left").withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))
    status = (
        F.when(F.col("consecutive_failures") >= v.UNHEALTHY_AFTER, "unhealthy")
        .when(F.col("consecutive_failures") >= v.DEGRADED_AFTER, "degraded")
        .when(F.col("success_count") > 0, "healthy").otherwise("standby")
    )
    return out.withColumn("status", status).drop("last_success")


def fallback_outcome(attempts: DataFrame) -> DataFrame:
    """First successful provider of each request in attempt order."""
    ok = F.when(F.col("success"), F.col("idx"))
    return attempts.groupBy("request_id").agg(
        F.min_by("provider", F.when(F.col("success"), F.col("idx"))).alias("final_provider"),
        F.min_by("provider", "idx").alias("primary_provider"),
        F.min(ok).alias("first_ok"), F.count("*").alias("attempts"),
    ).select("request_id", "primary_provider", "final_provider",
             F.col("first_ok").isNotNull().alias("success"),
             F.coalesce(F.col("first_ok") > 0, F.lit(False)).alias("fallback_used"),
             F.coalesce("first_ok", F.lit(0)).cast("long").alias("fallback_count"), "attempts")
