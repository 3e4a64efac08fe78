"""Signals, nudges, latency, qualification, language and evaluation on literals."""

import random

import pytest
from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.operators import calls, evaluation as ev, localization as lo, nudges as nd, qualification as ql, search, signals as sg
from callbrook.plans import call_queries as cq
from callbrook.streaming import calls as st

EVENT = "session_id long, chunk_sequence long, timestamp double, speaker string, text string, confidence double, is_final boolean"


def events(spark, rows):
    return spark.createDataFrame([(1, i, t, who, text, 1.0, True) for i, (t, who, text) in enumerate(rows)], EVENT)


def test_scripted_calls(spark):
    scripts = {
        "cross-sell": ([(1.0, "AGENT", "Good morning, thank you for calling. This call is recorded."), (7.5, "CUSTOMER", "Also, I have another vehicle for this policy.")], ["missed_opportunity"]),
        "gap": ([(1.0, "AGENT", "We can start."), (5.0, "AGENT", "Please give your social security number and revenue.")], ["compliance_gap"]),
        "told": ([(1.0, "AGENT", "This call is recorded for quality."), (3.0, "AGENT", "Please give your social security number.")], []),
        "frustration": ([(1.0, "CUSTOMER", "I've explained this three times already, why is this taking so long?")], ["frustration"]),
        "noise": ([(1.0, "CUSTOMER", "mumble... maybe another... car... crackle")], []),
    }
    for name, (rows, want) in scripts.items():
        got = [r["signal_type"] for r in sg.detect_signals(events(spark, rows)).filter("source = 'rule'").orderBy("timestamp").collect()]
        assert got == want, name


def test_disclosure_is_forgotten_after_25_turns(spark):
    for gap, expected in ((24, 0), (25, 1)):
        rows = [(0.0, "AGENT", "recorded line")] + [(float(i + 1), "AGENT", "nothing") for i in range(gap)] + [(99.0, "AGENT", "your income")]
        assert sg.detect_signals(events(spark, rows)).filter("signal_type = 'compliance_gap'").count() == expected


SIGNAL = "session_id long, chunk_sequence long, timestamp double, is_final boolean, rule_order int, signal_type string, rule_name string, confidence double, evidence string, new_topic string"


def signal_rows(spark, rows):
    return spark.createDataFrame([(1, i, t, True, 0, kind, rule, conf, "e", None) for i, (t, kind, rule, conf) in enumerate(rows)], SIGNAL)


def decisions(df):
    return [r["decision"] for r in df.orderBy("chunk_sequence").collect()]


def test_nudge_rules(spark):
    v = "cross_sell_second_vehicle"
    rows = [(1.0, "missed_opportunity", v, 0.45), (1.0, "missed_opportunity", v, 0.88), (2.0, "missed_opportunity", v, 0.89), (2.0, "risk", "r", 0.9), (46.0, "missed_opportunity", v, 0.88)]
    assert decisions(nd.nudge_decisions(signal_rows(spark, rows))) == ["low_confidence", "emitted", "active_duplicate", "emitted", "emitted"]
    short = nd.NudgePolicy(expiry=10.0)
    rows = [(1.0, "missed_opportunity", v, 0.88), (15.0, "missed_opportunity", v, 0.88), (35.0, "missed_opportunity", v, 0.88)]
    out = nd.nudge_decisions(signal_rows(spark, rows), short)
    assert decisions(out) == ["emitted", "cooldown", "emitted"]
    first = out.orderBy("chunk_sequence").first()
    assert (first["priority"], first["expires_at"]) == ("MEDIUM", 11.0)
    assert nd.expired_at(out, 12.0).count() == 1


def test_islands_do_not_change_the_fold(spark):
    rng = random.Random(5)
    rows, t = [], 0.0
    for _ in range(400):
        t += rng.choice([0.5, 3.0, 20.0, 60.0])
        rows.append((t, rng.choice(["risk", "compliance_gap"]), rng.choice(["a", "b"]), rng.choice([0.5, 0.9])))
    policy = nd.NudgePolicy(expiry=12.0)
    state, want = {}, []
    for t, kind, rule, conf in rows:
        want.append(nd.decide(policy, state.setdefault(kind, {}), kind, rule, conf, t))
    for width in (5.0, 100.0, 1e6):
        assert decisions(nd.nudge_decisions(signal_rows(spark, rows), policy, width)) == want


def test_exact_percentiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(10, 201, 10)] + [("b", 5.0)], "k string, v double")
    got = {r["k"]: (r["p50"], r["p95"]) for r in calls.exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (105.0, 190.5), "b": (5.0, 5.0)}
    skewed = spark.range(200_000).select(F.lit("h").alias("k"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") % 1013 * 1.0).alias("v"))
    exact = skewed.agg(F.percentile("v", 0.95)).first()[0]
    assert calls.exact_percentiles(skewed, ["k"], "v", {"p": 0.95}, accuracy=500).first()["p"] == exact


def test_exact_percentiles_of_any_size(spark):
    rows = [(n, float((k * 7919) % (n + 3)), float(k % 3)) for n in range(1, 401) for k in range(n)]
    df = spark.createDataFrame(rows, "k long, v double, tied double").repartition(8).cache()
    probs = {"low": 0.05, "mid": 0.5, "high": 0.95}
    for c in ("v", "tied"):
        got = {r.k: (r.low, r.mid, r.high) for r in calls.exact_percentiles(df, ["k"], c, probs).collect()}
        want = df.groupBy("k").agg(F.percentile(c, F.array(*map(F.lit, probs.values()))).alias("p")).collect()
        assert len(got) == 400
        for r in want:
            assert all(abs(a - b) < 1e-9 for a, b in zip(got[r.k], r.p)), r.k
    sample = {r.k: r.p for r in calls.exact_percentiles(df, ["k"], "v", {"p": 0.95}, exclusive=True).collect()}
    for n in range(1, 401):
        v = sorted(x for k, x, _ in rows if k == n)
        at = min(max((n + 1) * 0.95 - 1, 0.0), n - 1)
        low = int(at)
        assert abs(sample[n] - (v[low] + (v[min(low + 1, n - 1)] - v[low]) * (at - low))) < 1e-9, n


def test_context_over_sparse_turn_numbers(spark):
    numbers = [0, 3, 7, 1000, 1010, 1030, 1040, 1041, 5000, 9000, 9001, 40000]
    df = spark.createDataFrame([(1, n, "r", str(n)) for n in numbers] + [(2, 5, "r", "5")], "conv_id long, turn long, role string, text string")
    for block in (4, 5, 1024):
        got = {(r.conv_id, r.turn): r.context for r in calls.rolling_context(df, block=block).collect()}
        assert got == {(1, n): "\n".join(f"r: {x}" for x in numbers[max(0, k - 4):k]) for k, n in enumerate(numbers)} | {(2, 5): ""}


def test_states_met_by_requests(spark):
    rng = random.Random(3)
    states = list(v.STATE_MOVES)
    rows = [(s, 10 * k, rng.choice(states)) for s in range(3) for k in range(60)]
    df = spark.createDataFrame(rows, "session_id long, seq long, to_state string")
    want, at = {}, {}
    for s, k, asked in rows:
        now = at.get(s, "GREETING")
        want[(s, k)] = now
        at[s] = asked if asked in v.ALWAYS_REACHABLE or asked in v.STATE_MOVES[now] else now
    for block in (3, 16, 1024):
        assert {(r.session_id, r.seq): r.from_state for r in calls.state_log(df, block=block).collect()} == want
        assert {r.session_id: r.final_state for r in calls.final_states(df, block=block).collect()} == at


def test_final_states_in_blocks(spark):
    rows = [(1, 0, "QUALIFICATION"), (1, 1, "LEAD_CONFIRMATION"), (1, 2, "REVIEW"), (1, 3, "LEAD_CONFIRMATION"), (2, 0, "REVIEW"), (2, 1, "ESCALATION"), (2, 2, "QUALIFICATION")]
    df = spark.createDataFrame(rows, "session_id long, seq long, to_state string")
    for block in (1, 2, 1024):
        got = {r["session_id"]: r["final_state"] for r in calls.final_states(df, block=block).collect()}
        assert got == {1: "LEAD_CONFIRMATION", 2: "ESCALATION"}


def test_stream_equals_batch_over_several_batches(spark, sf, tmp_path):
    """Partial and final events in no order of time over three batches, with a restart before each."""
    ev_df = sg.transcript_events(cq.turns(spark, sf).drop("role")).select(*st.EVENT.fieldNames()).filter("session_id < 8").toPandas().sample(frac=1, random_state=3)
    src, out_dir = str(tmp_path / "src"), str(tmp_path / "out")
    st.use_rocksdb(spark)

    def signals():
        return st.run_available(st.signals_stream(st.read_transcripts(spark, src, 1), delay="1 hour"), out_dir, str(tmp_path / "ckpt"))

    for k in range(3):
        spark.createDataFrame(ev_df[k::3], st.EVENT).coalesce(1).write.mode("append").parquet(src)
        assert signals().count() == 0  # within the delay nothing is decided
    st.write_end(spark.createDataFrame(ev_df, st.EVENT), src, chunk_sequence=0, text="the end", is_final=True)
    out = signals()
    cols = ["session_id", "chunk_sequence", "is_final", "signal_type", "rule_name", "evidence"]
    batch = sg.detect_signals(spark.createDataFrame(ev_df, st.EVENT))
    assert sorted(map(tuple, out.select(*cols).collect()), key=str) == sorted(map(tuple, batch.select(*cols).collect()), key=str)
    sig_dir = str(tmp_path / "signals")
    files = st.write_slices(out, sig_dir, "chunk_sequence", dealt=True)
    st.write_end(out, sig_dir, confidence=0.0, signal_type="heartbeat")
    stream = spark.readStream.schema(out.schema).option("maxFilesPerTrigger", files).parquet(sig_dir)
    nudged = st.run_available(st.nudges_stream(stream, delay="1 hour"), str(tmp_path / "n"), str(tmp_path / "nc")).filter("session_id >= 0")
    key = ["session_id", "chunk_sequence", "is_final", "signal_type", "rule_name", "decision"]
    want = sorted(map(tuple, nd.nudge_decisions(batch).select(*key).collect()), key=str)
    assert sorted(map(tuple, nudged.filter("decision <> 'expired'").select(*key).collect()), key=str) == want
    assert nudged.filter("decision = 'expired'").count() == sum(w[-1] == "emitted" for w in want)


def test_silent_session_is_forgotten(spark, tmp_path):
    """A session that goes on after its idle time starts anew; before it, it goes on."""
    src, schema = str(tmp_path / "src"), "session_id long, seq long, to_state string, timestamp double"
    st.use_rocksdb(spark)
    last = list(v.STATE_MOVES)[0]
    first = next(iter(v.STATE_MOVES["GREETING"]))
    for batch in ([(1, 0, first, 0.0), (2, 0, first, 0.0)], [(9, 0, last, 50000.0)], [(9, 1, last, 200000.0), (2, 1, last, 140000.0)], [(1, 1, last, 210000.0), (9, 2, last, 9e6)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        out = st.run_available(st.conversation_states(stream, delay="1 day", idle_ms=100000 * 1000), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {(r.session_id, r.seq): r.from_state for r in out.collect()}
    assert got[(1, 0)] == got[(2, 0)] == "GREETING" and got[(1, 1)] == "GREETING"


def test_replayed_lead_batch_changes_nothing(spark, sf, tmp_path):
    updates = cq._lead_updates(spark, sf)
    path, merge = str(tmp_path / "leads"), st.lead_batch(str(tmp_path / "leads"), buckets=4)
    parts = [updates.filter(F.pmod(F.xxhash64("call_id", "seq"), F.lit(3)) == k) for k in range(3)]
    want = sorted(map(tuple, calls.upsert_leads(updates, ["seq"]).drop("n_notes").collect()), key=str)
    for k in (0, 1, 1, 2, 2):  # batches come again
        merge(parts[k], k)
    leads = st.current_leads(spark, path)
    assert sorted(map(tuple, leads.select(calls.upsert_leads(updates, ["seq"]).drop("n_notes").columns).collect()), key=str) == want
    assert leads.agg(F.sum("n_notes")).first()[0] == updates.filter("notes <> ''").count()


@pytest.mark.parametrize("raw,value,ambiguous", [
    ("$600k", 600000.0, False), ("1.5 million", 1500000.0, False), ("our revenue is around fifty", 50.0, True), ("50", 50.0, True),
    ("$1,200,000", 1200000.0, False), ("", None, False), ("nothing", None, True), ("fifty thousand", None, True), ("-5m", -5000000.0, False)])
def test_amounts(spark, raw, value, ambiguous):
    p = spark.createDataFrame([(raw,)], "r string").select(ql.parse_amount("r").alias("p")).first()["p"]
    assert (p["value"], p["is_ambiguous"]) == (value, ambiguous)


def test_eligibility(spark):
    rows = [("Retail", 3.0, 600000.0, 1500000.0), ("Mfg", 6.0, 7e6, 25e6), ("Food", 1.0, 800000.0, 1e6), ("C", 4.0, 300000.0, 5e5), ("L", None, 1e6, None), ("R", 2.5, 6e5, 4e6), ("N", -1.0, 6e5, 1e6), ("Z", 3.0, 0.0, 5.0)]
    df = spark.createDataFrame([(i, *r, []) for i, r in enumerate(rows)], "i long, business_type string, years_in_business double, monthly_revenue double, requested_amount double, ambiguous array<string>")
    got = [(r["status"], r["recommended_product"]) for r in ql.evaluate(df).orderBy("i").collect()]
    assert got == [("ELIGIBLE", "Starter"), ("ELIGIBLE", "Enterprise"), ("INELIGIBLE", None), ("INELIGIBLE", None), ("NEEDS_MORE_INFORMATION", None), ("MANUAL_REVIEW", "Starter"), ("INELIGIBLE", None), ("MANUAL_REVIEW", None)]
    reasons = [r["reasons"] for r in ql.evaluate(df).orderBy("i").collect()]
    assert "below policy minimum requirement of 2 years" in reasons[2][0] and "below policy minimum requirement of $500,000" in reasons[3][0]


@pytest.mark.parametrize("text,market,language,register", [
    ("Hello, I would like to inquire about business loan interest rates.", "PH", "en", "professional"),
    ("Magandang araw po sa inyo, nais ko po sanang magtanong ukol sa proteksyon.", "PH", "fil", "formal"),
    ("Hello po, magkano po ang monthly premium kung mag-a-apply ako ng life insurance policy plan?", "PH", "taglish", "formal"),
    ("Selamat pagi Bapak/Ibu, saya ingin mengajukan fasilitas pembiayaan multiguna untuk modal usaha.", "ID", "id_formal", "formal"),
    ("Halo Kak! Mau nanya dong, ada promo DP ringan nggak buat kredit motor?", "ID", "id_colloquial", "colloquial"), ("", "PH", "taglish", "colloquial")])
def test_language(spark, text, market, language, register):
    d = spark.createDataFrame([(text,)], "t string").select(lo.detect_language("t", market).alias("d")).first()["d"]
    assert (d["language"], d["register"]) == (language, register)


def test_market_terms(spark):
    t = "Berapa cicilan per bulan kalau uang muka saya 20 juta sebelum jatuh tempo?"
    r = spark.createDataFrame([(t,)], "t string").select(lo.find_terms("t", "ID").alias("c"), lo.normalize_market_terms("t", "ID").alias("n"), lo.lookup_term(F.lit(" Hulog "), "PH").alias("l")).first()
    assert r["c"] == ["installment", "due_date", "tenor", "down_payment"] and "DP saya" in r["n"] and r["l"] == "premium"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_word_error_rate_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    pairs = [(" ".join(rng.choices(vocab, k=rng.randrange(0, 300))), " ".join(rng.choices(vocab, k=rng.randrange(0, 300)))) for _ in range(12)] + [("", ""), ("", "x"), ("A b", "a B")]
    got = [r["w"] for r in spark.createDataFrame(pairs, "r string, h string").coalesce(1).select(ev.word_error_rate("r", "h").alias("w")).collect()]
    for (r, h), w in zip(pairs, got):
        rw, hw = r.lower().split(), h.lower().split()
        assert w == (round(edit_distance(rw, hw) / len(rw), 4) if rw else float(bool(hw)))


def test_index_roundtrip_gives_same_answers(spark, sf, tmp_path):
    from callbrook.plans.tables import benchmark_queries, document_chunks
    chunks, queries = document_chunks(spark, sf), benchmark_queries(spark, sf).limit(5)
    search.write_index(chunks, str(tmp_path / "ix"), 4)
    direct = search.hybrid_search(chunks, queries)[1].drop("query")
    stored = search.search_index(search.read_index(spark, str(tmp_path / "ix")), queries)[1].drop("query")
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, stored.collect()))


def test_blank_query_abstains(spark, sf):
    from callbrook.plans.tables import document_chunks
    q = search.query_batch(spark.createDataFrame([(1, "  ")], "i long, t string"), "i", "t")
    row = search.hybrid_search(document_chunks(spark, sf), q)[1].first()
    assert (row["grounded"], row["abstain_reason"], row["confidence"]) == (False, "empty_query", 0.0)


def test_latency_sketch_is_near_the_exact_percentile():
    import math
    import random
    from callbrook.streaming import calls as st
    r = random.Random(2)
    for n in (1, 2, 7, 400):
        us = sorted(int(r.lognormvariate(9, 2)) + 1 for _ in range(n))
        counts = {}
        for x in us:
            k = math.floor(math.log(x) / math.log(st.SKETCH_BASE))
            counts[k] = counts.get(k, 0) + 1
        for q in (0.0, 0.5, 0.95, 1.0):
            rank = int(q * (n - 1))
            got = math.exp((st._bucket_at(sorted(counts.items()), rank) + 0.5) * math.log(st.SKETCH_BASE))
            assert abs(got - us[rank]) <= 0.011 * us[rank]
