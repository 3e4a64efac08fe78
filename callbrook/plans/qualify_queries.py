"""Registered qualification, localization and evaluation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions.text import words
from callbrook.operators import calls
from callbrook.operators import evaluation as ev
from callbrook.operators import localization as lo
from callbrook.operators import qualification as ql
from callbrook.operators import search as s
from callbrook.operators.ranking import ranked
from callbrook.plans import call_queries as cq
from callbrook.plans.call_queries import SQL_TURNS, turns
from callbrook.plans.search_queries import _RANKED, SQL_GATE, _ranked
from callbrook.plans.tables import benchmark_queries, document_chunks, read, sql_list, sql_str, sql_strip, sql_words


def _with(*parts):
    return "WITH " + ",".join(parts)


# --- stated values -----------------------------------------------------------

AMOUNT_FORMS = ("${}k", "{} million", "about fifty", "{}", "$1,{}", "{} thousand dollars", "none given", "", "-{}.5m", "twenty lakh", "  {} ")
YEAR_FORMS = ("{} years", "{} months", "{}", "{}.5 yrs", "a while", "", "over {}0 in total", "-{} years")
CONSENT_FORMS = ("Yes, please", "no, don't call me", "never", "I refuse", "perhaps", "", "OK fine", "stop it", "nothing")


def _formed(n, forms):
    """The form chosen by the key, with a number from the key put in."""
    chosen = F.element_at(F.array(*[F.lit(f) for f in forms]), (n % len(forms) + 1).cast("int"))
    return F.replace(chosen, F.lit("{}"), (n % 97 + 1).cast("string"))


def _sql_formed(n, forms):
    return f"replace({sql_list(forms)}[{n} % {len(forms)} + 1], '{{}}', CAST({n} % 97 + 1 AS VARCHAR))"


def amount_parse(spark, sf):
    o = read(spark, sf, "orders").withColumn("raw", _formed(F.col("o_orderkey"), AMOUNT_FORMS))
    p = o.withColumn("p", ql.parse_amount("raw"))
    return p.select("o_orderkey", "raw", "p.value", "p.is_ambiguous", "p.clarification")


def years_parse(spark, sf):
    o = read(spark, sf, "orders").withColumn("raw", _formed(F.col("o_orderkey"), YEAR_FORMS))
    return o.withColumn("p", ql.parse_years("raw")).select("o_orderkey", F.col("p.value").alias("years"), "p.is_ambiguous")


def consent_parse(spark, sf):
    o = read(spark, sf, "orders").withColumn("raw", _formed(F.col("o_orderkey"), CONSENT_FORMS))
    return o.select("o_orderkey", ql.parse_consent("raw").alias("consent"))


# RE2 and the JVM read these the same way on the ASCII forms above
_L = "lower(trim(raw))"
_CLEAN = f"trim(regexp_replace({_L}, '[$,]', '', 'g'))"


def _num(p, src):
    return f"TRY_CAST(nullif(regexp_extract({src}, {sql_str(p)}, 1), '') AS DOUBLE)"


_M1, _K1, _N1 = r"(-?[\d\.]+)\s*(?:million|m)\b", r"(-?[\d\.]+)\s*(?:thousand|k)\b", r"(-?\d+(?:\.\d+)?)"
_WORD_CASES = " ".join(
    f"WHEN regexp_matches({_L}, '\\b{w}\\b') AND NOT regexp_matches({_L}, '{v.MONEY_UNITS}') THEN {{{i}}}" for i, (w, _) in enumerate(v.NUMBER_WORDS))
_BARE = rf"^[\$]?(\d{{1,3}})$"


def _amount_case(words_, bare, million, thousand, number, other, empty):
    return (f"CASE WHEN {_L} = '' THEN {empty} {_WORD_CASES.format(*words_)} WHEN regexp_matches({_L}, '{_BARE}') THEN {bare} "
            f"WHEN {_num(_M1, _CLEAN)} IS NOT NULL THEN {million} WHEN {_num(_K1, _CLEAN)} IS NOT NULL THEN {thousand} "
            f"WHEN {_num(_N1, _CLEAN)} IS NOT NULL THEN {number} ELSE {other} END")


SQL_AMOUNT = {
    "value": _amount_case([f"{n}.0::DOUBLE" for _, n in v.NUMBER_WORDS], _num(_BARE, _L), _num(_M1, _CLEAN) + " * 1000000",
                          _num(_K1, _CLEAN) + " * 1000", _num(_N1, _CLEAN), "NULL", "NULL"),
    "is_ambiguous": _amount_case(["true"] * len(v.NUMBER_WORDS), "true", "false", "false", "false", "true", "false"),
    "clarification": _amount_case(
        [f"'Could you clarify if you mean {w} thousand, {w} million, or another amount?'" for w, _ in v.NUMBER_WORDS],
        f"'Could you clarify if you mean $' || regexp_extract({_L}, '{_BARE}', 1) || ',000 or $' || regexp_extract({_L}, '{_BARE}', 1) || ',000,000?'",
        "NULL", "NULL", "NULL", "'Could you specify the exact monetary amount in dollars?'", "NULL"),
}
_MO, _YR = r"(-?[\d\.]+)\s*months?", r"(-?[\d\.]+)\s*(?:years?|yrs?)\b"

# --- eligibility -------------------------------------------------------------


def _applicants(spark, sf):
    c = read(spark, sf, "customer")
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(
        F.floor(F.sum("o_totalprice")).alias("total"), F.floor(F.max("o_totalprice")).alias("top"))
    k = F.col("c_custkey")
    a = c.join(o, c.c_custkey == o.o_custkey, "left")
    return a.select(
        "c_custkey", F.when(k % 17 != 0, F.col("c_mktsegment")).alias("business_type"),
        F.when(k % 11 != 0, (k % 15) / 2.0 - 0.5).alias("years_in_business"),
        F.coalesce(F.col("total"), F.lit(0)).cast("double").alias("monthly_revenue"),
        (F.coalesce(F.col("top"), F.lit(1)) * (k % 40)).cast("double").alias("requested_amount"),
        F.when(k % 13 == 0, F.array(F.lit("monthly_revenue"))).otherwise(F.array().cast("array<string>")).alias("ambiguous"))


def qualification(spark, sf):
    e = ql.evaluate(_applicants(spark, sf))
    return e.select("c_custkey", "status", "recommended_product", "max_eligible_amount", "interest_rate",
                    F.col("term_months").cast("long").alias("term_months"), F.array_join("missing_fields", ",").alias("missing_fields"),
                    F.col("rules_checked").cast("long").alias("rules_checked"), F.array_join("reasons", " ; ").alias("reasons"))


SQL_APPLICANTS = """
applicants AS (
  SELECT c_custkey, CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END AS business_type,
    CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 15) / 2.0::DOUBLE - 0.5 END AS years,
    CAST(coalesce(total, 0) AS DOUBLE) AS revenue, CAST(coalesce(top, 1) * (c_custkey % 40) AS DOUBLE) AS asked, c_custkey % 13 = 0 AS vague
  FROM customer LEFT JOIN (SELECT o_custkey, floor(sum(o_totalprice)) AS total, floor(max(o_totalprice)) AS top FROM orders GROUP BY 1) ON c_custkey = o_custkey),
missed AS (SELECT *, list_filter([CASE WHEN business_type IS NULL THEN 'business_type' END, CASE WHEN years IS NULL THEN 'years_in_business' END,
    CASE WHEN vague THEN 'monthly_revenue' END], lambda x: x IS NOT NULL) AS missing FROM applicants)"""
_TIERS = ", ".join(f"('{n}', {r}::DOUBLE, {y}::DOUBLE, {m}::DOUBLE, {t}, {i}::DOUBLE)" for n, r, y, m, t, i in v.TIERS)
SQL_TIERED = f"""
tiers(name, min_rev, min_years, max_loan, term, rate) AS (VALUES {_TIERS}),
best AS (SELECT c_custkey, arg_max(name, min_rev) AS name, arg_max(max_loan, min_rev) AS max_loan, arg_max(term, min_rev) AS term, arg_max(rate, min_rev) AS rate,
    arg_max(min_years, min_rev) AS t_years, max(min_rev) AS t_rev FROM missed JOIN tiers ON revenue >= min_rev AND missed.years >= min_years GROUP BY 1),
judged AS (SELECT m.*, b.* EXCLUDE (c_custkey), CASE WHEN len(missing) > 0 THEN 1 WHEN years < 0 OR revenue < 0 OR asked < 0 THEN 2 WHEN revenue = 0 AND asked > 0 THEN 3
    WHEN years < {v.MIN_YEARS} OR revenue < {v.MIN_REVENUE} THEN 4 WHEN name IS NULL THEN 5 WHEN asked > max_loan THEN 6 ELSE 7 END AS step
  FROM missed m LEFT JOIN best b USING (c_custkey))"""


def _usd(x):
    return f"'$' || format('{{:,}}', CAST({x} AS BIGINT))"


# --- intents and fields ------------------------------------------------------


def _sql_any(low, phrases):
    return "(" + " OR ".join(f"contains({low}, {sql_str(p)})" for p in phrases) + ")"


def _sql_starts(low, phrases):
    return "(" + " OR ".join(f"starts_with({low}, {sql_str(p)})" for p in phrases) + ")"


def _market_case(build):
    """PH for even calls, ID for odd ones."""
    return F.when(F.col("session_id") % 2 == 0, build("PH")).otherwise(build("ID"))


def intents(spark, sf):
    return turns(spark, sf).select(
        "session_id", "chunk_sequence", ql.intent("text").alias("intent"), ql.base_intent("text").alias("base_intent"),
        _market_case(lambda m: ql.market_intent("text", m)).alias("market_intent"))


def kb_query_clause(spark, sf):
    return turns(spark, sf).select("session_id", "chunk_sequence", _market_case(lambda m: ql.kb_clause("text", m)).alias("clause"))


def field_extract(spark, sf):
    return turns(spark, sf).select("session_id", "chunk_sequence", *[c.alias(k) for k, c in ql.extract_fields("text").items()])


def base_field_extract(spark, sf):
    return turns(spark, sf).select("session_id", "chunk_sequence", *[c.alias(k) for k, c in ql.base_fields("text").items()])


def market_field_extract(spark, sf):
    return turns(spark, sf).select("session_id", "chunk_sequence", *[c.alias(k) for k, c in ql.market_fields("text").items()])


def qualification_state(spark, sf):
    f = ql.extract_fields("text")
    t = turns(spark, sf).select("session_id", "chunk_sequence", *[f[k].alias(k) for k in v.MANDATORY_FIELDS])
    r = ql.running_fields(t, "session_id", "chunk_sequence", v.MANDATORY_FIELDS)
    return r.select("session_id", "chunk_sequence", *[f"{k}_now" for k in v.MANDATORY_FIELDS])


def _stated(spark, sf):
    return turns(spark, sf).select("session_id", "chunk_sequence", *[x.alias(k) for k, x in ql.stated_fields("text", "chunk_sequence").items()])


def qualification_snapshot(spark, sf):
    """After each turn: the latest statement of every field, unclear ones marked, and what of it is confirmed."""
    r = ql.running_fields(_stated(spark, sf), "session_id", "chunk_sequence", v.MANDATORY_FIELDS)
    part = [F.col(f"{k}_now.{p}").alias(f"{k}_{p}") for k in v.MANDATORY_FIELDS for p in ("is_ambiguous", "source_turn")]
    return r.select("session_id", "chunk_sequence", *part, *[ql.validated(F.col(f"{k}_now")).alias(f"{k}_valid") for k in v.MANDATORY_FIELDS])


def localized_call_summary(spark, sf):
    detected = turns(spark, sf).select("session_id", "chunk_sequence", _market_case(lambda m: lo.detect_language("text", m)).alias("d"))
    t = cq._call_turns(spark, sf).drop("language").join(
        detected.select(F.col("session_id").alias("call_id"), F.col("chunk_sequence").alias("turn"), "d.language", "d.register"), ["call_id", "turn"])
    final = ql.final_fields(_stated(spark, sf), "session_id", "chunk_sequence", v.MANDATORY_FIELDS)
    qualified = final.select(F.col("session_id").alias("call_id"), ql.snapshot(v.MANDATORY_FIELDS).alias("qualification"))
    s = calls.localized_call_summary(t, qualified, cq.lead_upsert(spark, sf))
    return s.select("call_id", "turns", "final_state", "final_language", "final_register", "escalated", "lead_created",
                    F.array_join("detected_terms", ",").alias("detected_terms"), *[F.col(f"qualification.{k}").alias(k) for k in v.MANDATORY_FIELDS])


def model_json_parse(spark, sf):
    e = read(spark, sf, "events")
    body = F.concat(F.lit('{"intent": "other", "entities": '), F.replace("props", F.lit('"k"'), F.lit('"years_in_business"')), F.lit("}"))
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))) \
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure, here it is: "), body, F.lit(" Done."))) \
        .when(F.col("event_id") % 4 == 2, body).otherwise(F.concat(F.lit("no answer "), F.col("props"), F.lit(" {")))
    p = e.select("event_id", ql.parse_model_json(raw).alias("p"))
    fields = ql.entity_fields(F.col("p"))
    return p.select("event_id", F.try_variant_get("p", "$.intent", "string").alias("intent"), fields["years_in_business"].alias("years_in_business"))


_LOW = "lower(text)"
_T = f"lower({sql_strip('text')})"


def _sql_market_intent(m):
    return (f"CASE WHEN {_sql_any(_T, v.ESCALATE_COMMON + v.ESCALATE_MARKET[m])} THEN 'human_escalation' WHEN {_sql_any(_T, v.OBJECT_COMMON + v.OBJECT_MARKET[m])} THEN 'objection' "
            f"WHEN {_sql_starts(_T, v.QUESTION_COMMON + v.QUESTION_MARKET[m])} OR contains({_T}, '?') THEN 'knowledge_question' ELSE 'qualification_info' END")


def _sql_clause(m):
    cl = f"list_filter(list_transform(regexp_split_to_array({sql_strip('text')}, '[\\.\\?\\!]'), lambda c: {sql_strip('c')}), lambda c: length(c) >= 10)"
    return (f"coalesce(list_filter({cl}, lambda c: {_sql_starts('lower(c)', v.QUESTION_COMMON + v.QUESTION_MARKET[m])} OR contains(c, '?'))[1], "
            f"list_filter({cl}, lambda c: {_sql_any('lower(c)', v.KB_CLAUSE_KEYWORDS)})[1], {sql_strip('text')})")


def _x(p, src=_LOW, g=1):
    return f"nullif(regexp_extract({src}, {sql_str(p)}, {g}), '')"


SQL_FIELDS = f"""
ctx AS (SELECT *, lower(text) AS low, trim(regexp_extract(lower(text), {sql_str(v.REVENUE_CONTEXT)}, 1)) AS rev, trim(regexp_extract(lower(text), {sql_str(v.LOAN_CONTEXT)}, 1)) AS loan FROM turns),
fields AS (
  SELECT session_id, chunk_sequence,
    CASE {' '.join(f"WHEN {_sql_any('low', ws)} THEN '{n}'" for n, ws in v.BUSINESS_TYPES)} END AS business_type,
    coalesce(CAST({_x(v.YEARS_PATTERN, 'low')} AS DOUBLE), round(CAST({_x(v.MONTHS_PATTERN, 'low')} AS DOUBLE) / 12.0, 2)) AS years_in_business,
    CASE {' '.join(f"WHEN {_x(p, 'rev')} IS NOT NULL THEN CAST({_x(p, 'rev')} AS DOUBLE) * {m}" for p, m in v.AMOUNT_UNITS)}
      {' '.join(f"WHEN regexp_matches(rev, '\\b{w}\\b') THEN {n}::DOUBLE" for w, n in v.NUMBER_WORDS)}
      ELSE CAST({_x(r'(\d+(?:\.\d+)?)', 'rev')} AS DOUBLE) END AS monthly_revenue,
    NOT ({' OR '.join(f"{_x(p, 'rev')} IS NOT NULL" for p, _ in v.AMOUNT_UNITS)}) AND (regexp_matches(rev, '\\b(?:{'|'.join(w for w, _ in v.NUMBER_WORDS)})\\b')
      OR coalesce(CAST({_x(r'(\d+(?:\.\d+)?)', 'rev')} AS DOUBLE) < 1000, false)) AS revenue_ambiguous,
    CASE {' '.join(f"WHEN {_x(p, 'loan')} IS NOT NULL THEN CAST({_x(p, 'loan')} AS DOUBLE) * {m}" for p, m in v.AMOUNT_UNITS)}
      ELSE CAST({_x(r'(\d+(?:\.\d+)?)', 'loan')} AS DOUBLE) END AS requested_amount,
    CASE WHEN {_sql_any('low', v.PERMISSION_PHRASES)} THEN true END AS contact_permission
  FROM ctx)"""

# --- language ----------------------------------------------------------------


def language_detect(spark, sf):
    d = _market_case(lambda m: lo.detect_language("text", m))
    return turns(spark, sf).select("session_id", "chunk_sequence", d.alias("d")).select(
        "session_id", "chunk_sequence", "d.language", F.round("d.confidence", 6).alias("confidence"), "d.register", "d.code_switch")


def term_find(spark, sf):
    return turns(spark, sf).select("session_id", "chunk_sequence", F.array_join(_market_case(lambda m: lo.find_terms("text", m)), ",").alias("concepts"))


def term_normalize(spark, sf):
    return turns(spark, sf).select("session_id", "chunk_sequence", _market_case(lambda m: lo.normalize_market_terms("text", m)).alias("normalized"))


REASONS = ("unsupported_kb", "unclear_audio", "tool_failure", "human_escalation")


def localized_message(spark, sf):
    d = _market_case(lambda m: lo.detect_language("text", m))
    t = turns(spark, sf).withColumn("d", d).withColumn("market", F.when(F.col("session_id") % 2 == 0, "PH").otherwise("ID")) \
        .withColumn("reason", F.element_at(F.array(*[F.lit(r) for r in REASONS]), (F.col("chunk_sequence") % 4 + 1).cast("int"))) \
        .withColumn("language", F.when(F.col("chunk_sequence") % 5 == 4, "tagalog_other").otherwise(F.col("d.language")))
    return t.select("session_id", "chunk_sequence", lo.fallback_message("market", "language", "reason", F.col("d.register")).alias("message"))


def _sql_count(words_):
    return f"len(list_filter(tk, lambda t: list_contains({sql_list(words_)}, t)))"


SQL_LANGUAGE = f"""
tk AS (SELECT *, list_transform(regexp_extract_all({sql_strip('text')}, '[\\p{{L}}\\p{{N}}_]+(?:-+[\\p{{L}}\\p{{N}}_]+)*'), lambda t: lower(t)) AS tk,
    CASE WHEN session_id % 2 = 0 THEN 'PH' ELSE 'ID' END AS market FROM turns),
lc AS (SELECT *, greatest(1, len(tk)) AS n, {_sql_count(v.FILIPINO_MARKERS)} AS fil, {_sql_count(v.PH_ENGLISH_WORDS)} AS en, {_sql_count(v.PH_POLITE_WORDS)} AS polite,
    len(list_filter(tk, lambda t: regexp_matches(t, '{v.PH_SWITCH_PREFIX}'))) AS sw, {_sql_count(v.INDONESIAN_FORMAL)} AS formal, {_sql_count(v.INDONESIAN_COLLOQUIAL)} AS casual,
    {_sql_count(v.ID_LOANWORDS)} AS loans FROM tk),
lang AS (
  SELECT session_id, chunk_sequence, market,
    CASE WHEN market = 'PH' THEN CASE WHEN fil = 0 AND NOT list_has_any(tk, ['po', 'opo']) THEN 'en' WHEN fil / n > 0.65 AND en = 0 AND sw = 0 THEN 'fil' ELSE 'taglish' END
      ELSE CASE WHEN formal > casual AND formal > 0 THEN 'id_formal' WHEN casual > 0 THEN 'id_colloquial' ELSE 'id_mixed' END END AS language,
    CASE WHEN market = 'PH' THEN CASE WHEN fil = 0 AND NOT list_has_any(tk, ['po', 'opo']) THEN 0.90 WHEN fil / n > 0.65 AND en = 0 AND sw = 0 THEN 0.85 ELSE 0.88 END
      ELSE CASE WHEN formal > casual AND formal > 0 THEN least(0.95, 0.70 + formal / n * 0.5) WHEN casual > 0 THEN least(0.95, 0.70 + casual / n * 0.5) ELSE 0.75 END END::DOUBLE AS confidence,
    CASE WHEN market = 'PH' THEN CASE WHEN fil = 0 AND NOT list_has_any(tk, ['po', 'opo']) THEN 'professional' WHEN polite > 0 THEN 'formal' ELSE 'mixed' END
      ELSE CASE WHEN formal > casual AND formal > 0 THEN 'formal' WHEN casual > 0 THEN 'colloquial' ELSE 'mixed' END END AS register,
    CASE WHEN market = 'PH' THEN NOT (fil = 0 AND NOT list_has_any(tk, ['po', 'opo'])) AND NOT (fil / n > 0.65 AND en = 0 AND sw = 0) ELSE loans > 0 END AS code_switch
  FROM lc)"""


def _sql_terms(m):
    hits = ", ".join(f"CASE WHEN regexp_matches({_LOW}, {sql_str(chr(92) + 'b' + ql.literal(k) + chr(92) + 'b')}) THEN '{c}' END" for k, c, _ in lo.term_owners(m))
    # first occurrence order, repeats dropped
    return f"list_reduce(list_concat([''], list_filter([{hits}], lambda x: x IS NOT NULL)), lambda acc, x: CASE WHEN list_contains(string_split(acc, ','), x) THEN acc WHEN acc = '' THEN x ELSE acc || ',' || x END)"


def _sql_norm(m):
    out = "text"
    for k, _, term in lo.term_owners(m):
        if k != term.lower():
            out = f"regexp_replace({out}, {sql_str('(?i)' + chr(92) + 'b' + ql.literal(k) + chr(92) + 'b')}, '{term}', 'g')"
    return out


_MSG = "CASE " + " ".join(f"WHEN k = '{lang}|{why}' THEN {sql_str(t)}" for lang, why, t in v.FALLBACK_MESSAGES) + " END"

# --- evaluation --------------------------------------------------------------


def wer(spark, sf):
    """Each clause of each turn against a misheard copy of itself."""
    return _misheard(spark, sf).select("session_id", "chunk_sequence", "sentence", "market",
                                       ev.word_error_rate("reference", "hypothesis").alias("wer"))


def _misheard(spark, sf):
    t = turns(spark, sf).select("session_id", "chunk_sequence", F.posexplode(F.split("text", r"[.,\n]")).alias("sentence", "reference"))
    h = F.regexp_replace(F.regexp_replace("reference", " (the|de|la|le) ", " "), "tion", "shun")
    return t.withColumn("hypothesis", F.when(F.col("session_id") % 10 != 9, h)).withColumn("sentence", F.col("sentence").cast("long")) \
        .withColumn("market", F.when(F.col("session_id") % 2 == 0, "PH").otherwise("ID"))


def wer_summary(spark, sf):
    return ev.wer_summary(_misheard(spark, sf))


SQL_MISHEARD = f"""
sent AS (SELECT session_id, chunk_sequence, unnest(range(0, len(p))) AS sentence, unnest(p) AS reference FROM (SELECT *, regexp_split_to_array(text, '[.,\n]') AS p FROM turns)),
pairs AS (SELECT *, CASE WHEN session_id % 10 <> 9 THEN regexp_replace(regexp_replace(reference, ' (the|de|la|le) ', ' ', 'g'), 'tion', 'shun', 'g') END AS hypothesis,
    CASE WHEN session_id % 2 = 0 THEN 'PH' ELSE 'ID' END AS market FROM sent),
wd AS (SELECT *, {sql_words('lower(reference)')} AS r, {sql_words('lower(hypothesis)')} AS h FROM pairs),
cd AS (SELECT *, array_to_string(list_transform(r, lambda w: chr(CAST(list_position(list_distinct(list_concat(r, h)), w) AS INTEGER))), '') AS rc,
    array_to_string(list_transform(h, lambda w: chr(CAST(list_position(list_distinct(list_concat(r, h)), w) AS INTEGER))), '') AS hc FROM wd),
scored AS (SELECT *, CASE WHEN hypothesis IS NULL THEN NULL WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END ELSE round(levenshtein(rc, hc) / len(r), 4) END::DOUBLE AS wer FROM cd)"""


def confusion_metrics(spark, sf):
    """Does 'names an e-mail, an amount or a dash' predict low quality?"""
    return ev.confusion_metrics(_cases(spark, sf), "expected", "predicted")


def _cases(spark, sf):
    d, lab = read(spark, sf, "documents"), read(spark, sf, "labels")
    return lab.join(d, "doc_id").select("doc_id", (F.col("quality") == 0).alias("expected"), F.col("text").rlike(r"@|\d|\||-").alias("predicted"))


def confusion_failures(spark, sf):
    return ev.failures(_cases(spark, sf), "expected", "predicted")


SQL_CASES = "cases AS (SELECT doc_id, quality = 0 AS expected, regexp_matches(text, '@|\\d|\\||-') AS predicted FROM labels JOIN documents USING (doc_id))"


def _verdicts(spark, sf):
    ranked, q = _ranked(spark, sf)
    out = s.answers(s.confidence_gate(ranked, q)).drop("query")
    n = F.col("query_id")
    cases = q.select(
        "query_id", (n % 4 != 3).alias("should_answer"), F.when(n % 3 == 0, F.concat(F.lit("src"), (n % 20).cast("string"))).alias("expected_source"),
        F.filter(words("query"), lambda w: F.length(w) > 5).alias("keywords"))
    return ev.retrieval_verdicts(cases, out).withColumn("latency_ms", (F.pmod(n * 7, F.lit(53)) + F.col("confidence")).cast("double"))


def retrieval_eval(spark, sf):
    return _verdicts(spark, sf).select("query_id", "should_answer", "grounded", "correct")


def retrieval_eval_summary(spark, sf):
    return ev.retrieval_summary(_verdicts(spark, sf), "latency_ms")


SQL_VERDICTS = f"""
vcases AS (SELECT query_id, query_id % 4 <> 3 AS should_answer, CASE WHEN query_id % 3 = 0 THEN 'src' || (query_id % 20) END AS expected_source,
    list_filter({sql_words('query')}, lambda w: length(w) > 5) AS keywords FROM queries),
verdicts AS (
  SELECT query_id, should_answer, abstain_reason IS NULL AS grounded, query_id * 7 % 53 + confidence AS latency_ms,
    CASE WHEN NOT should_answer THEN abstain_reason IS NOT NULL
      ELSE abstain_reason IS NULL AND (expected_source IS NULL OR contains(source_name, expected_source) OR contains(title, expected_source)
        OR len(keywords) = 0 OR len(list_filter(keywords, lambda k: contains(lower(content), lower(k)))) > 0) END AS correct
  FROM vcases JOIN gate USING (query_id) LEFT JOIN (SELECT query_id, source_name, title, content FROM ranked WHERE rank = 1) USING (query_id))"""


def _paired(spark, sf):
    """Every document with one benchmark passage, the passages taking turns."""
    q = ranked(benchmark_queries(spark, sf), "queries", "query_id").drop("query_id").withColumnRenamed("rank", "turn")
    d = document_chunks(spark, sf).select("chunk_id", "content", F.pmod("chunk_id", F.lit(max(1, q.count()))).alias("turn"))
    return d.join(q, "turn").drop("turn")


def keyword_similarity(spark, sf):
    return _paired(spark, sf).select("chunk_id", ev.keyword_similarity(F.concat(F.lit("loan "), F.col("query")), F.concat(
        F.when(F.col("chunk_id") % 2 == 0, "revenue ").otherwise(""), F.col("content"))).alias("score"))


def model_comparison(spark, sf):
    p = _paired(spark, sf).select("chunk_id", ev.keyword_similarity("query", "content").alias("score"),
                                  F.lower("content").contains(F.lower("query")).alias("baseline"))
    return ev.compare_models(p, "score", "baseline", 0.30)


def terms_preserved(spark, sf):
    t = _misheard(spark, sf).filter("hypothesis IS NOT NULL")
    return t.select("session_id", "chunk_sequence", "sentence", ev.terms_preserved(words("reference"), "hypothesis").alias("preserved"))


_Q = (SQL_TURNS,)
_PAIRED = ("queries AS (SELECT item_id AS query_id, " + sql_strip("text") + " AS query FROM benchmark)",
           "turns_of AS (SELECT query, row_number() OVER (ORDER BY query_id) - 1 AS turn, count(*) OVER () AS n FROM queries)",
           "paired AS (SELECT doc_id AS chunk_id, text AS content, query FROM documents JOIN turns_of ON turn = doc_id % n)")


def _sql_similarity(q, d):
    qw, dw = f"list_distinct({sql_words(f'lower({q})')})", f"list_distinct({sql_words(f'lower({d})')})"
    return (f"round(least(0.98, greatest(0.12, CAST(len(list_intersect({qw}, {dw})) AS DOUBLE) / greatest(len({qw}), 1) * 0.5 + "
            f"CASE WHEN {_sql_any(f'lower({q})', v.FINANCE_TERMS)} AND {_sql_any(f'lower({d})', v.FINANCE_TERMS)} THEN 0.45 ELSE 0.0 END)), 4)::DOUBLE")


QUERIES = {f.__name__: f for f in (
    amount_parse, years_parse, consent_parse, qualification, intents, kb_query_clause, field_extract, base_field_extract,
    market_field_extract, qualification_state, qualification_snapshot, localized_call_summary, model_json_parse, language_detect, term_find, term_normalize, localized_message,
    wer, wer_summary, confusion_metrics, confusion_failures, retrieval_eval, retrieval_eval_summary, keyword_similarity,
    model_comparison, terms_preserved,
)}

_B = {
    "business_type": "CASE " + " ".join(f"WHEN contains(low, '{t}') THEN '{t}'" for t in reversed(v.BASE_TYPES)) + " END",
    "years_in_business": _x(v.YEARS_PATTERN, "low"),
    "monthly_revenue": f"CASE WHEN regexp_matches(low, {sql_str(v.BASE_REVENUE)}) THEN CASE WHEN trim(regexp_extract(low, {sql_str(v.BASE_REVENUE)}, 1)) NOT IN {v.BASE_REVENUE_SKIP} THEN trim(regexp_extract(low, {sql_str(v.BASE_REVENUE)}, 1)) END "
                       + " ".join(f"WHEN contains(low, '{w}') THEN '{w}'" for w in v.BASE_REVENUE_WORDS) + " END",
    "requested_amount": f"CASE WHEN regexp_matches(low, {sql_str(v.BASE_LOAN)}) AND trim(regexp_extract(low, {sql_str(v.BASE_LOAN)}, 1)) NOT IN {v.BASE_LOAN_SKIP} THEN trim(regexp_extract(low, {sql_str(v.BASE_LOAN)}, 1)) END",
    "contact_permission": f"CASE WHEN {_sql_any('low', v.BASE_PERMISSION)} THEN 'yes' END",
    "loan_purpose": f"CASE WHEN length({sql_strip(f'regexp_extract(low, {sql_str(v.BASE_PURPOSE)}, 1)')}) > 3 AND {sql_strip(f'regexp_extract(low, {sql_str(v.BASE_PURPOSE)}, 1)')} NOT IN {v.BASE_PURPOSE_SKIP} THEN {sql_strip(f'regexp_extract(low, {sql_str(v.BASE_PURPOSE)}, 1)')} END",
}


def _sql_scaled(raw):
    inner = SQL_AMOUNT["value"].replace("lower(trim(raw))", f"lower(trim({raw}))")
    num = f"TRY_CAST(nullif(regexp_extract({raw}, '([\\d\\.]+)', 1), '') AS DOUBLE)"
    return f"CASE WHEN regexp_matches({raw}, 'juta|jt') THEN {num} * 1000000 WHEN regexp_matches({raw}, 'ribu|rb') THEN {num} * 1000 ELSE {inner} END"


_LOCAL_WORDS = " ".join(
    f"WHEN {_sql_any('low', (f'{w} juta', f'{w} jt', f'{w} million'))} THEN {n * 1e6}::DOUBLE WHEN {_sql_any('low', (f'{w} ribu', f'{w} rb', f'{w} thousand'))} THEN {n * 1e3}::DOUBLE"
    for w, n in v.LOCAL_NUMBER_WORDS)

ORACLE = {
    "amount_parse": f"SELECT o_orderkey, raw, {', '.join(f'{x} AS {k}' for k, x in SQL_AMOUNT.items())} FROM (SELECT o_orderkey, {_sql_formed('o_orderkey', AMOUNT_FORMS)} AS raw FROM orders)",
    "years_parse": f"""SELECT o_orderkey, CASE WHEN {_L} = '' THEN NULL WHEN {_num(_MO, _L)} IS NOT NULL THEN round({_num(_MO, _L)} / 12.0, 2) WHEN {_num(_YR, _L)} IS NOT NULL THEN {_num(_YR, _L)}
      WHEN {_num(_N1, _L)} > 60 THEN round({_num(_N1, _L)} / 12.0, 2) ELSE {_num(_N1, _L)} END AS years,
      {_L} <> '' AND {_num(_MO, _L)} IS NULL AND {_num(_YR, _L)} IS NULL AND {_num(_N1, _L)} IS NULL AS is_ambiguous
      FROM (SELECT o_orderkey, {_sql_formed('o_orderkey', YEAR_FORMS)} AS raw FROM orders)""",
    "consent_parse": f"""SELECT o_orderkey, CASE WHEN {_L} = '' THEN NULL WHEN {_sql_any(_L, v.CONSENT_YES)} THEN true WHEN {_sql_any(_L, v.CONSENT_NO)} THEN false ELSE true END AS consent
      FROM (SELECT o_orderkey, {_sql_formed('o_orderkey', CONSENT_FORMS)} AS raw FROM orders)""",
    "qualification": _with(SQL_APPLICANTS, SQL_TIERED) + f""" SELECT c_custkey,
      ['NEEDS_MORE_INFORMATION', 'INELIGIBLE', 'MANUAL_REVIEW', 'INELIGIBLE', 'INELIGIBLE', 'MANUAL_REVIEW', 'ELIGIBLE'][step] AS status,
      CASE WHEN step > 5 THEN name END AS recommended_product, CASE WHEN step > 5 THEN max_loan END AS max_eligible_amount, CASE WHEN step > 5 THEN rate END AS interest_rate,
      CASE WHEN step > 5 THEN CAST(term AS BIGINT) END AS term_months, array_to_string(missing, ',') AS missing_fields, CAST([1, 2, 2, 3, 4, 5, 5][step] AS BIGINT) AS rules_checked,
      CASE step WHEN 1 THEN 'Missing or unconfirmed required qualification fields: ' || array_to_string(missing, ', ')
        WHEN 2 THEN 'Financial values and operational years cannot be negative.' WHEN 3 THEN 'Zero monthly revenue with requested loan amount requires manual review.'
        WHEN 4 THEN concat_ws(' ; ', CASE WHEN years < 2 THEN 'Years in business (' || printf('%.1f', years) || ' yrs) is below policy minimum requirement of 2 years.' END,
          CASE WHEN revenue < 500000 THEN 'Monthly revenue (' || {_usd('revenue')} || ') is below policy minimum requirement of $500,000.' END)
        WHEN 5 THEN 'Applicant profile does not qualify for any standard loan product tier.'
        WHEN 6 THEN 'Requested amount (' || {_usd('asked')} || ') exceeds the maximum limit for ' || name || ' tier (' || {_usd('max_loan')} || '). Requires underwriter manual review or counter-offer.'
        ELSE 'Applicant meets all eligibility criteria for ' || name || ' loan tier. ; Monthly revenue (' || {_usd('revenue')} || ') >= ' || {_usd('t_rev')} || '. ; Years in business (' || printf('%.1f', years) || ') >= '
          || CAST(CAST(t_years AS INTEGER) AS VARCHAR) || ' years. ; Requested amount (' || {_usd('asked')} || ') is within limit (' || {_usd('max_loan')} || ').' END AS reasons FROM judged""",
    "intents": _with(*_Q) + f""" SELECT session_id, chunk_sequence,
      CASE WHEN {_sql_any(_T, v.HUMAN_PHRASES)} THEN 'human_escalation' WHEN {_sql_any(_T, v.OBJECTION_PHRASES)} THEN 'objection' WHEN {_sql_any(_T, v.QUESTION_PHRASES + ('?',))} THEN 'knowledge_question' ELSE 'qualification_info' END AS intent,
      CASE WHEN {_sql_any(_T, v.BASE_HUMAN_PHRASES)} THEN 'human_escalation' WHEN {_sql_any(_T, v.BASE_QUESTION_PHRASES + ('?',))} THEN 'knowledge_question' ELSE 'qualification_info' END AS base_intent,
      CASE WHEN session_id % 2 = 0 THEN {_sql_market_intent('PH')} ELSE {_sql_market_intent('ID')} END AS market_intent FROM turns""",
    "kb_query_clause": _with(*_Q) + f" SELECT session_id, chunk_sequence, CASE WHEN session_id % 2 = 0 THEN {_sql_clause('PH')} ELSE {_sql_clause('ID')} END AS clause FROM turns",
    "field_extract": _with(*_Q, SQL_FIELDS) + " SELECT * FROM fields",
    "base_field_extract": _with(*_Q, "lows AS (SELECT *, lower(text) AS low FROM turns)") + f" SELECT session_id, chunk_sequence, {', '.join(f'{x} AS {k}' for k, x in _B.items())} FROM lows",
    "market_field_extract": _with(*_Q, f"lows AS (SELECT *, lower(text) AS low, {_x(v.LOCAL_REVENUE)} AS rv, {_x(v.LOCAL_LOAN)} AS ln FROM turns)") + f""" SELECT session_id, chunk_sequence,
      CASE {' '.join(f"WHEN contains(low, '{t}') THEN '{t}'" for t in reversed(v.LOCAL_TYPES))} END AS business_type, CAST({_x(v.LOCAL_YEARS, 'low')} AS DOUBLE) AS years_in_business,
      CASE WHEN trim(rv) <> '' THEN {_sql_scaled('rv')} WHEN {_sql_any('low', v.LOCAL_REVENUE_WORDS)} THEN 50.0 END::DOUBLE AS monthly_revenue,
      CASE {_LOCAL_WORDS} WHEN trim(ln) <> '' THEN {_sql_scaled('ln')} END::DOUBLE AS requested_amount, CASE WHEN {_sql_any('low', v.LOCAL_PERMISSION)} THEN 'yes' END AS contact_permission FROM lows""",
    "qualification_state": _with(*_Q, SQL_FIELDS) + " SELECT session_id, chunk_sequence, " + ", ".join(
        f"last_value({f} IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY chunk_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {f}_now" for f in v.MANDATORY_FIELDS) + " FROM fields",
    "qualification_snapshot": _with(*_Q, SQL_FIELDS) + " SELECT session_id, chunk_sequence, " + ", ".join(
        f"last_value(CASE WHEN {f} IS NOT NULL THEN {'revenue_ambiguous' if f == 'monthly_revenue' else 'false'} END IGNORE NULLS) OVER w AS {f}_is_ambiguous, "
        f"last_value(CASE WHEN {f} IS NOT NULL THEN chunk_sequence END IGNORE NULLS) OVER w AS {f}_source_turn, "
        f"CASE WHEN NOT {f}_is_ambiguous THEN last_value({f} IGNORE NULLS) OVER w END AS {f}_valid" for f in v.MANDATORY_FIELDS)
    + " FROM fields WINDOW w AS (PARTITION BY session_id ORDER BY chunk_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "localized_call_summary": _with(*cq._CALLS, SQL_FIELDS, SQL_LANGUAGE, "confirmed AS (SELECT session_id, " + ", ".join(
        f"arg_max({f}, chunk_sequence) FILTER ({f} IS NOT NULL) AS {f}" + (", arg_max(revenue_ambiguous, chunk_sequence) FILTER (monthly_revenue IS NOT NULL) AS vague" if f == "monthly_revenue" else "")
        for f in v.MANDATORY_FIELDS) + " FROM fields GROUP BY 1)") + """
      SELECT call_id, count(*) AS turns, arg_max(state, turn) AS final_state, arg_max(l.language, turn) AS final_language, arg_max(l.register, turn) AS final_register,
        bool_or(escalated) AS escalated, call_id IN (SELECT o_custkey FROM orders) AS lead_created, array_to_string(list_sort(list_distinct(flatten(list(terms)))), ',') AS detected_terms, """
    + ", ".join(f"any_value(CASE WHEN NOT vague THEN q.{f} END) AS {f}" if f == "monthly_revenue" else f"any_value(q.{f}) AS {f}" for f in v.MANDATORY_FIELDS)
    + " FROM calls JOIN lang l ON call_id = l.session_id AND turn = l.chunk_sequence LEFT JOIN confirmed q ON q.session_id = call_id GROUP BY call_id",
    "model_json_parse": """SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN 'other' END AS intent,
      CASE WHEN event_id % 4 <> 3 THEN CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) END AS years_in_business FROM events""",
    "language_detect": _with(*_Q, SQL_LANGUAGE) + " SELECT session_id, chunk_sequence, language, round(confidence, 6) AS confidence, register, code_switch FROM lang",
    "term_find": _with(*_Q) + f" SELECT session_id, chunk_sequence, coalesce(CASE WHEN session_id % 2 = 0 THEN {_sql_terms('PH')} ELSE {_sql_terms('ID')} END, '') AS concepts FROM turns",
    "term_normalize": _with(*_Q) + f" SELECT session_id, chunk_sequence, CASE WHEN session_id % 2 = 0 THEN {_sql_norm('PH')} ELSE {_sql_norm('ID')} END AS normalized FROM turns",
    "localized_message": _with(*_Q, SQL_LANGUAGE, f"""
      keyed AS (SELECT session_id, chunk_sequence, CASE WHEN chunk_sequence % 5 = 4 THEN CASE WHEN market = 'PH' THEN 'taglish' WHEN register = 'colloquial' THEN 'id_colloquial'
        WHEN register = 'formal' THEN 'id_formal' ELSE 'id_mixed' END ELSE language END || '|' || {sql_list(REASONS)}[chunk_sequence % 4 + 1] AS k FROM lang)""")
    + f" SELECT session_id, chunk_sequence, {_MSG} AS message FROM keyed",
    "wer": _with(*_Q, SQL_MISHEARD) + " SELECT session_id, chunk_sequence, sentence, market, CASE WHEN hypothesis IS NOT NULL THEN wer END AS wer FROM scored",
    "wer_summary": _with(*_Q, SQL_MISHEARD) + " SELECT market, count(*) AS total_test_cases, count(wer) AS executed_cases, round(avg(wer), 4) AS average_wer FROM scored GROUP BY 1",
    "confusion_metrics": _with(SQL_CASES, """
      n AS (SELECT count(*) AS total_cases, count(*) FILTER (expected AND predicted) AS tp, count(*) FILTER (NOT expected AND NOT predicted) AS tn,
        count(*) FILTER (NOT expected AND predicted) AS fp, count(*) FILTER (expected AND NOT predicted) AS fn FROM cases),
      pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END::DOUBLE AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END::DOUBLE AS r FROM n)""")
    + """ SELECT total_cases, tp, tn, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 4)::DOUBLE AS false_positive_rate,
      round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4)::DOUBLE AS f1_score FROM pr""",
    "confusion_failures": _with(SQL_CASES) + " SELECT doc_id, expected, predicted, CASE WHEN predicted THEN 'FP' ELSE 'FN' END AS verdict FROM cases WHERE expected <> predicted",
    "retrieval_eval": _with(*_RANKED, SQL_GATE, SQL_VERDICTS) + " SELECT query_id, should_answer, grounded, correct FROM verdicts",
    "retrieval_eval_summary": _with(*_RANKED, SQL_GATE, SQL_VERDICTS, "srt AS (SELECT list(latency_ms ORDER BY latency_ms) AS l, count(*) AS n, count(*) FILTER (correct) AS c FROM verdicts)") + """
      SELECT n AS total_queries, c AS correct, round(c / greatest(1, n), 4) AS accuracy, round((l[(n + 1) // 2] + l[(n + 2) // 2]) / 2.0, 2) AS latency_p50_ms,
        round(CASE WHEN n >= 20 THEN (l[19 * (n + 1) // 20] * (20 - 19 * (n + 1) % 20) + l[19 * (n + 1) // 20 + 1] * (19 * (n + 1) % 20)) / 20.0 ELSE l[n] END, 2) AS latency_p95_ms FROM srt""",
    "keyword_similarity": _with(*_PAIRED) + f" SELECT chunk_id, {_sql_similarity(chr(39) + 'loan ' + chr(39) + ' || query', 'CASE WHEN chunk_id % 2 = 0 THEN ' + chr(39) + 'revenue ' + chr(39) + ' ELSE ' + chr(39) * 2 + ' END || content')} AS score FROM paired",
    "model_comparison": _with(*_PAIRED, f"sc AS (SELECT chunk_id, {_sql_similarity('query', 'content')} AS score, contains(lower(content), lower(query)) AS baseline FROM paired)")
    + " SELECT chunk_id, score, baseline, score >= 0.3 AS candidate_grounded, CASE WHEN (score >= 0.3) = baseline THEN 'PASS' ELSE 'FAIL' END AS verdict FROM sc",
    "terms_preserved": _with(*_Q, SQL_MISHEARD.split("wd AS")[0].rstrip().rstrip(",")) + f""" SELECT session_id, chunk_sequence, sentence,
      len(list_filter({sql_words('reference')}, lambda t: NOT (contains(lower(hypothesis), lower(t)) OR contains(lower(hypothesis), lower(replace(t, ' ', '')))))) = 0 AS preserved FROM pairs WHERE hypothesis IS NOT NULL""",
}
