"""Parsing stated amounts, extracting fields, eligibility, running state."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions.text import col, contains_any, starts_with_any, strip
from callbrook.operators.carry import Running, running

U = "(?U)"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, U + pattern, group), F.lit(""))


def _number(c: Column) -> Column:
    return c.try_cast("double")


def first_of(pairs: Sequence[tuple[Column, Column]]) -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


# --- parsing stated values ---------------------------------------------------


def _amount(value: Column, ambiguous: bool, prompt: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), F.lit(ambiguous).alias("is_ambiguous"), prompt.cast("string").alias("clarification"))


def parse_amount(raw: Column | str) -> Column:
    """Struct (value, is_ambiguous, clarification).  Bare number words and bare
    one- to three-digit numbers need a unit before they count."""
    s = F.lower(strip(col(raw).cast("string")))
    none = F.lit(None)
    unit = s.rlike(U + v.MONEY_UNITS)
    steps = [(F.coalesce(s, F.lit("")) == "", _amount(none, False, none))]
    for word, number in v.NUMBER_WORDS:
        steps.append((s.rlike(rf"{U}\b{word}\b") & ~unit, _amount(F.lit(float(number)), True, F.lit(
            f"Could you clarify if you mean {word} thousand, {word} million, or another amount?"))))
    bare = _found(s, r"^[\$]?(\d{1,3})$").cast("int")
    steps.append((bare.isNotNull(), _amount(bare, True, F.concat(
        F.lit("Could you clarify if you mean $"), bare.cast("string"), F.lit(",000 or $"), bare.cast("string"), F.lit(",000,000?")))))
    plain = strip(F.regexp_replace(s, r"[$,]", ""))
    million = _found(plain, r"(-?[\d\.]+)\s*(?:million|m)\b")
    thousand = _found(plain, r"(-?[\d\.]+)\s*(?:thousand|k)\b")
    number = _found(plain, r"(-?\d+(?:\.\d+)?)")
    steps += [
        (million.isNotNull(), _amount(_number(million) * 1_000_000, False, none)),
        (thousand.isNotNull(), _amount(_number(thousand) * 1_000, False, none)),
        (number.isNotNull(), _amount(_number(number), False, none)),
    ]
    return first_of(steps).otherwise(_amount(none, True, F.lit("Could you specify the exact monetary amount in dollars?")))


def parse_years(raw: Column | str) -> Column:
    s = F.lower(strip(col(raw).cast("string")))
    none = F.lit(None)
    months = _found(s, r"(-?[\d\.]+)\s*months?")
    years = _found(s, r"(-?[\d\.]+)\s*(?:years?|yrs?)\b")
    number = _number(_found(s, r"(-?\d+(?:\.\d+)?)"))
    return first_of([
        (F.coalesce(s, F.lit("")) == "", _amount(none, False, none)),
        (months.isNotNull(), _amount(F.round(_number(months) / 12.0, 2), False, none)),
        (years.isNotNull(), _amount(_number(years), False, none)),
        (number > 60, _amount(F.round(number / 12.0, 2), False, none)),
        (number.isNotNull(), _amount(number, False, none)),
    ]).otherwise(_amount(none, True, F.lit("Could you tell me how many years your business has been operating?")))


def parse_consent(raw: Column | str) -> Column:
    """Yes-words are looked for first, inside words too; no answer means yes."""
    s = F.lower(strip(col(raw).cast("string")))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(None).cast("boolean")) \
        .when(contains_any(s, v.CONSENT_YES), F.lit(True)).when(contains_any(s, v.CONSENT_NO), F.lit(False)).otherwise(F.lit(True))


# --- eligibility -------------------------------------------------------------


def _money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def evaluate(applicants: DataFrame, tiers: Sequence[tuple] = v.TIERS, min_years: float = v.MIN_YEARS,
             min_revenue: float = v.MIN_REVENUE) -> DataFrame:
    """Eligibility of rows with business_type, years_in_business,
    monthly_revenue, requested_amount and ``ambiguous`` (array of field names).

    The tier list is a parameter, so the best-tier lookup is an expression:
    the first matching tier from the highest revenue down.
    """
    years, revenue, asked = F.col("years_in_business"), F.col("monthly_revenue"), F.col("requested_amount")
    missing = F.filter(F.array(*[
        F.when(F.col(f).isNull() | (F.col(f).cast("string") == "") | F.array_contains("ambiguous", f), f)
        for f in v.MANDATORY_FIELDS]), lambda x: x.isNotNull())
    tier = F.coalesce(*[
        F.when((revenue >= t[1]) & (years >= t[2]), F.struct(
            F.lit(t[0]).alias("name"), F.lit(t[1]).alias("min_revenue"), F.lit(t[2]).alias("min_years"),
            F.lit(t[3]).alias("max_loan"), F.lit(t[4]).alias("term"), F.lit(t[5]).alias("rate")))
        for t in sorted(tiers, key=lambda t: -t[1])])
    a = applicants.withColumn("missing_fields", missing).withColumn("__tier", tier)
    t = F.col("__tier")
    low = (years < min_years) | (revenue < min_revenue)
    checks = [
        (F.size("missing_fields") > 0, "NEEDS_MORE_INFORMATION", 1, F.array(F.concat(
            F.lit("Missing or unconfirmed required qualification fields: "), F.array_join("missing_fields", ", ")))),
        ((years < 0) | (revenue < 0) | (asked < 0), "INELIGIBLE", 2,
         F.array(F.lit("Financial values and operational years cannot be negative."))),
        ((revenue == 0) & (asked > 0), "MANUAL_REVIEW", 2,
         F.array(F.lit("Zero monthly revenue with requested loan amount requires manual review."))),
        (low, "INELIGIBLE", 3, F.filter(F.array(
            F.when(years < min_years, F.concat(F.lit("Years in business ("), F.format_string("%.1f", years),
                   F.lit(f" yrs) is below policy minimum requirement of {min_years:.0f} years."))),
            F.when(revenue < min_revenue, F.concat(F.lit("Monthly revenue ("), _money(revenue),
                   F.lit(f") is below policy minimum requirement of ${min_revenue:,.0f}.")))), lambda x: x.isNotNull())),
        (t.isNull(), "INELIGIBLE", 4, F.array(F.lit("Applicant profile does not qualify for any standard loan product tier."))),
        (asked > t["max_loan"], "MANUAL_REVIEW", 5, F.array(F.concat(
            F.lit("Requested amount ("), _money(asked), F.lit(") exceeds the maximum limit for "), t["name"], F.lit(" tier ("),
            _money(t["max_loan"]), F.lit("). Requires underwriter manual review or counter-offer.")))),
    ]
    eligible = F.array(
        F.concat(F.lit("Applicant meets all eligibility criteria for "), t["name"], F.lit(" loan tier.")),
        F.concat(F.lit("Monthly revenue ("), _money(revenue), F.lit(") >= "), _money(t["min_revenue"]), F.lit(".")),
        F.concat(F.lit("Years in business ("), F.format_string("%.1f", years), F.lit(") >= "),
                 t["min_years"].cast("int").cast("string"), F.lit(" years.")),
        F.concat(F.lit("Requested amount ("), _money(asked), F.lit(") is within limit ("), _money(t["max_loan"]), F.lit(").")))
    tests = [test for test, *_ in checks]
    status = first_of([(x, F.lit(s)) for x, s, _, _ in checks]).otherwise(F.lit("ELIGIBLE"))
    rules = first_of([(x, F.lit(n)) for x, _, n, _ in checks]).otherwise(F.lit(5))
    reasons = first_of([(x, r) for x, _, _, r in checks]).otherwise(eligible)
    priced = ~(tests[0] | F.coalesce(tests[1] | tests[2] | tests[3] | tests[4], F.lit(False)))
    return a.select(
        *[F.col(c) for c in applicants.columns], "missing_fields", status.alias("status"),
        F.when(priced, t["name"]).alias("recommended_product"), F.when(priced, t["max_loan"]).alias("max_eligible_amount"),
        F.when(priced, t["rate"]).alias("interest_rate"), F.when(priced, t["term"]).alias("term_months"),
        rules.alias("rules_checked"), reasons.alias("reasons"))


# --- intents -----------------------------------------------------------------


def intent(text: Column | str) -> Column:
    low = F.lower(strip(text))
    return F.when(contains_any(low, v.HUMAN_PHRASES), "human_escalation") \
        .when(contains_any(low, v.OBJECTION_PHRASES), "objection") \
        .when(contains_any(low, v.QUESTION_PHRASES) | low.contains("?"), "knowledge_question") \
        .otherwise("qualification_info")


def base_intent(text: Column | str) -> Column:
    low = F.lower(strip(text))
    return F.when(contains_any(low, v.BASE_HUMAN_PHRASES), "human_escalation") \
        .when(contains_any(low, v.BASE_QUESTION_PHRASES) | low.contains("?"), "knowledge_question") \
        .otherwise("qualification_info")


def is_market_question(low: Column, market: str) -> Column:
    return starts_with_any(low, v.QUESTION_COMMON + v.QUESTION_MARKET[market]) | low.contains("?")


def market_intent(text: Column | str, market: str) -> Column:
    low = F.lower(strip(text))
    return F.when(contains_any(low, v.ESCALATE_COMMON + v.ESCALATE_MARKET[market]), "human_escalation") \
        .when(contains_any(low, v.OBJECT_COMMON + v.OBJECT_MARKET[market]), "objection") \
        .when(is_market_question(low, market), "knowledge_question").otherwise("qualification_info")


def kb_clause(text: Column | str, market: str) -> Column:
    """First question clause, else first clause naming a product term, else all."""
    clauses = F.filter(F.transform(F.split(strip(text), r"[\.\?\!]"), strip), lambda c: F.length(c) >= 10)
    asked = F.filter(clauses, lambda c: is_market_question(F.lower(c), market))
    named = F.filter(clauses, lambda c: contains_any(F.lower(c), v.KB_CLAUSE_KEYWORDS))
    return F.coalesce(F.get(asked, F.lit(0)), F.get(named, F.lit(0)), strip(text))


# --- fields of an utterance --------------------------------------------------


def extract_fields(utterance: Column | str) -> dict[str, Column]:
    """Typed fields with lakh/crore/million/thousand units."""
    low = F.lower(col(utterance))
    kind = first_of([(contains_any(low, words), F.lit(name)) for name, words in v.BUSINESS_TYPES])
    years, months = _number(_found(low, v.YEARS_PATTERN)), _number(_found(low, v.MONTHS_PATTERN))
    revenue, loan = strip(F.regexp_extract(low, U + v.REVENUE_CONTEXT, 1)), strip(F.regexp_extract(low, U + v.LOAN_CONTEXT, 1))

    def united(raw: Column) -> list[tuple[Column, Column]]:
        return [(_found(raw, p).isNotNull(), _number(_found(raw, p)) * mult) for p, mult in v.AMOUNT_UNITS]

    def plain(raw: Column) -> Column:
        return _number(_found(raw, r"(\d+(?:\.\d+)?)"))

    worded = [(revenue.rlike(rf"{U}\b{w}\b"), F.lit(float(n))) for w, n in v.NUMBER_WORDS]
    any_unit = F.coalesce(*[_found(revenue, p) for p, _ in v.AMOUNT_UNITS]).isNotNull()
    any_word = revenue.rlike(U + r"\b(?:" + "|".join(w for w, _ in v.NUMBER_WORDS) + r")\b")
    return {
        "business_type": kind,
        "years_in_business": F.coalesce(years, F.round(months / 12.0, 2)),
        "monthly_revenue": first_of(united(revenue) + worded).otherwise(plain(revenue)),
        "revenue_ambiguous": ~any_unit & (any_word | F.coalesce(plain(revenue) < 1000, F.lit(False))),
        "requested_amount": first_of(united(loan)).otherwise(plain(loan)),
        "contact_permission": F.when(contains_any(low, v.PERMISSION_PHRASES), F.lit(True)),
    }


def base_fields(utterance: Column | str) -> dict[str, Column]:
    """The narrower extractor: raw strings, last matching business type wins."""
    low = F.lower(col(utterance))
    revenue, loan, purpose = (strip(F.regexp_extract(low, p, 1)) for p in (v.BASE_REVENUE, v.BASE_LOAN, v.BASE_PURPOSE))
    matched = low.rlike(v.BASE_REVENUE)
    word = first_of([(low.contains(w), F.lit(w)) for w in v.BASE_REVENUE_WORDS])
    return {
        "business_type": first_of([(low.contains(t), F.lit(t)) for t in reversed(v.BASE_TYPES)]),
        "years_in_business": _found(low, v.YEARS_PATTERN),
        "monthly_revenue": F.when(matched, F.when(~revenue.isin(*v.BASE_REVENUE_SKIP), revenue)).otherwise(word),
        "requested_amount": F.when(low.rlike(v.BASE_LOAN) & ~loan.isin(*v.BASE_LOAN_SKIP), loan),
        "contact_permission": F.when(contains_any(low, v.BASE_PERMISSION), F.lit("yes")),
        "loan_purpose": F.when((F.length(purpose) > 3) & ~purpose.isin(*v.BASE_PURPOSE_SKIP), purpose),
    }


def market_fields(utterance: Column | str) -> dict[str, Column]:
    """English, Tagalog and Indonesian amounts (juta, ribu) as parsed values."""
    low = F.lower(col(utterance))

    def scaled(raw: Column) -> Column:
        number = _number(_found(raw, r"([\d\.]+)"))
        million, thousand = raw.rlike("juta|jt"), raw.rlike("ribu|rb")
        return F.when(million, number * 1_000_000).when(thousand, number * 1_000).otherwise(parse_amount(raw)["value"])

    revenue, loan = (F.nullif(strip(F.regexp_extract(low, U + p, 1)), F.lit("")) for p in (v.LOCAL_REVENUE, v.LOCAL_LOAN))
    worded = []
    for w, n in v.LOCAL_NUMBER_WORDS:
        worded.append((contains_any(low, (f"{w} juta", f"{w} jt", f"{w} million")), F.lit(n * 1_000_000)))
        worded.append((contains_any(low, (f"{w} ribu", f"{w} rb", f"{w} thousand")), F.lit(n * 1_000)))
    return {
        "business_type": first_of([(low.contains(t), F.lit(t)) for t in reversed(v.LOCAL_TYPES)]),
        "years_in_business": _number(_found(low, v.LOCAL_YEARS)),
        "monthly_revenue": F.when(revenue.isNotNull(), scaled(revenue))
        .when(contains_any(low, v.LOCAL_REVENUE_WORDS), F.lit(50.0)),
        "requested_amount": first_of(worded).otherwise(F.when(loan.isNotNull(), scaled(loan))),
        "contact_permission": F.when(contains_any(low, v.LOCAL_PERMISSION), F.lit("yes")),
    }


def parse_model_json(raw: Column | str) -> Column:
    """VARIANT of a model's JSON answer: fences stripped, else the outermost
    braces; null when neither parses."""
    bare = strip(F.regexp_replace(F.regexp_replace(col(raw), r"```(?:json)?\s*", ""), r"`+\s*$", ""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))


def entity_fields(parsed: Column, root: str = "$.entities") -> dict[str, Column]:
    out = {f: F.try_variant_get(parsed, f"{root}.{f}", "double")
           for f in ("years_in_business", "monthly_revenue", "requested_amount")}
    out |= {f: F.nullif(F.try_variant_get(parsed, f"{root}.{f}", "string"), F.lit("")) for f in ("business_type", "loan_purpose")}
    return out | {"contact_permission": F.try_variant_get(parsed, f"{root}.contact_permission", "boolean")}


# --- state over turns --------------------------------------------------------


def running_fields(turns: DataFrame, call: str, turn: str, fields: Sequence[str], block: int = 1024) -> DataFrame:
    """Latest extracted value of every field after each turn (a later value,
    ambiguous or not, replaces an earlier one)."""
    return running(turns, [call], [turn], F.floor(F.col(turn) / block),
                   [Running(f"{f}_now", "last", F.col(f), inclusive=True) for f in fields])


def stated(value: Column, ambiguous: Column, turn: Column) -> Column:
    """A field as one turn states it, null where the turn says nothing about it."""
    return F.when(value.isNotNull(), F.struct(value.alias("value"), ambiguous.alias("is_ambiguous"), turn.alias("source_turn")))


def stated_fields(utterance: Column | str, turn: Column | str) -> dict[str, Column]:
    """Every mandatory field of an utterance with its ambiguity and its turn."""
    f, clear = extract_fields(utterance), F.lit(False)
    return {k: stated(f[k], F.coalesce(f["revenue_ambiguous"], clear) if k == "monthly_revenue" else clear, col(turn)) for k in v.MANDATORY_FIELDS}


def final_fields(turns: DataFrame, call: str, turn: str, fields: Sequence[str]) -> DataFrame:
    """One row per call: the last statement of each field.  Combines map-side, however long a call is."""
    return turns.groupBy(call).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(turn))).alias(f) for f in fields])


def snapshot(fields: Sequence[str]) -> Column:
    """The fields that count as confirmed, in one struct: unclear ones are null."""
    return F.struct(*[validated(F.col(f)).alias(f) for f in fields])


def validated(field: Column) -> Column:
    return F.when(~field["is_ambiguous"] & field["value"].isNotNull(), field["value"])


def literal(pattern: str) -> str:
    return re.escape(pattern)
