"""Terminology, personal data and validation expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions.text import col, contains_any, is_blank, let, strip

# --- terminology -------------------------------------------------------------


def alias_pairs(terminology=v.KB_TERMINOLOGY) -> list[tuple[str, str]]:
    """(alias, canonical), longest alias first; equal lengths keep list order."""
    last = {a.lower(): form for form, aliases in terminology for a in aliases}
    return sorted(last.items(), key=lambda kv: -len(kv[0]))


_FOLDS_TO_ASCII = "[\u017F\u212A\u0130\u0131]"


def names_alias(c: Column | str, terminology=v.KB_TERMINOLOGY) -> Column:
    """Cheap test whether any alias may occur: substring search on the lowered
    text, and anything holding a letter that only case-folds to ASCII."""
    low = F.lower(col(c))
    return contains_any(low, [alias for alias, _ in alias_pairs(terminology)]) | col(c).rlike(_FOLDS_TO_ASCII)


def replaced_terms(c: Column | str, terminology=v.KB_TERMINOLOGY) -> Column:
    """Struct (text, replaced): aliases replaced as substrings, each pass over the result of the last, and what was replaced as
    (original, normalized) in order of the passes.

    The passes are one fold, so none is computed twice; a pass whose alias does not occur in the lowered text does nothing.
    Texts naming no alias skip all passes.
    """
    kind = "array<struct<original:string,normalized:string>>"
    passes = F.array(*[F.struct(F.lit(alias).alias("alias"), F.lit("(?iu)" + re.escape(alias)).alias("pattern"), F.lit(form).alias("form"))
                       for alias, form in alias_pairs(terminology)])

    def state(text: Column, low: Column, odd: Column, found: Column) -> Column:
        return F.struct(text.alias("text"), low.alias("low"), odd.alias("odd"), found.alias("replaced"))

    def replace(s: Column, p: Column) -> Column:
        def done(hits: Column) -> Column:
            made = F.transform(hits, lambda hit: F.struct(hit.alias("original"), p["form"].alias("normalized")))
            return F.when(F.size(hits) == 0, s).otherwise(let(
                F.regexp_replace(s["text"], p["pattern"], p["form"]), lambda t: state(t, F.lower(t), s["odd"], F.concat(s["replaced"], made))))
        return F.when(s["odd"] | s["low"].contains(p["alias"]), let(F.regexp_extract_all(s["text"], p["pattern"], F.lit(0)), done)).otherwise(s)

    text, none = col(c), F.array().cast(kind)
    folded = F.aggregate(passes, state(text, F.lower(text), text.rlike(_FOLDS_TO_ASCII), none), replace,
                         lambda s: F.struct(s["text"].alias("text"), s["replaced"].alias("replaced")))
    return F.when(names_alias(c, terminology), folded).otherwise(F.struct(text.alias("text"), none.alias("replaced")))


def normalize_terms(c: Column | str, terminology=v.KB_TERMINOLOGY) -> Column:
    return replaced_terms(c, terminology)["text"]


def term_replacements(c: Column | str, terminology=v.KB_TERMINOLOGY) -> Column:
    return replaced_terms(c, terminology)["replaced"]


# --- personal data -----------------------------------------------------------

def _jvm(pattern: str, flags: str) -> str:
    """White space as wide as in Python, Unicode classes for the rest."""
    wide = r"\s\x1c-\x1f"
    return f"(?{flags}U)" + pattern.replace(r"[\s", "[" + wide).replace(r":\s-", f":{wide}-").replace(r"\s+", f"[{wide}]+")


#: (type, pattern, fewest signs without separators, sign of a text that may hold it)
_DETECTORS = [
    ("email", _jvm(v.PII_EMAIL, ""), 0, "@"),
    *(("phone", _jvm(p, ""), 7, r"(?U)\d") for p in v.PII_PHONES),
    *(("account_id", _jvm(p, "iu"), 0, r"(?U)\d") for p in v.PII_ACCOUNTS),
    ("person_name", _jvm(v.PII_TITLED_NAME, ""), 0, "Mr|Ms|Dr|Prof"),
]
_HIT = "array<struct<start:int,minus:double,rank:int,end:int,text:string>>"
_ENTITY = "array<struct<entity_type:string,start:int,end:int,text:string,confidence:double>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hits(text: Column, rank: int) -> Column:
    """Where one detector matches: the pieces between the matches tell the places."""
    kind, pattern, least, sign = _DETECTORS[rank]
    none = F.array().cast(_HIT)
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("text")))

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["text"])
        hit = F.struct(start.alias("start"), F.lit(-v.PII_CONFIDENCE[kind]).alias("minus"), F.lit(rank).alias("rank"),
                       end.alias("end"), x["text"].alias("text"))
        return F.struct(F.array_append(acc["out"], hit).cast(_HIT).alias("out"), end.alias("at"))

    placed = F.aggregate(F.filter(pairs, lambda x: x["text"].isNotNull()),
                         F.struct(none.alias("out"), F.lit(0).alias("at")), place, lambda acc: acc["out"])
    if least:
        placed = F.filter(placed, lambda x: F.length(F.regexp_replace(x["text"], "[ .-]", "")) >= least)
    return F.when(text.rlike(sign), placed).otherwise(none)


def personal_entities(c: Column | str) -> Column:
    """Non-overlapping entities of a text: the earliest start wins, confidence and the order of the detectors decide only
    between equal starts.  A fold over the sorted matches, all on the JVM."""
    text = F.coalesce(col(c), F.lit(""))
    hits = F.array_sort(F.concat(*[_hits(text, k) for k in range(len(_DETECTORS))]))
    kinds = F.array(*[F.lit(d[0]) for d in _DETECTORS])

    def take(acc: Column, x: Column) -> Column:
        return F.when(x["start"] >= acc["at"], F.struct(F.array_append(acc["out"], x).cast(_HIT).alias("out"), x["end"].alias("at"))).otherwise(acc)

    kept = F.aggregate(hits, F.struct(F.array().cast(_HIT).alias("out"), F.lit(0).alias("at")), take, lambda acc: acc["out"])
    return F.transform(kept, lambda x: F.struct(
        F.get(kinds, x["rank"]).alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"),
        (-x["minus"]).alias("confidence"))).cast(_ENTITY)


def masked_text(text: Column, entities: Column) -> Column:
    """The text with each entity replaced by its type."""
    def end_before(i: Column) -> Column:
        return F.coalesce(F.get(entities, i - 1)["end"], F.lit(0))

    parts = F.transform(entities, lambda x, i: F.concat(
        F.substring(text, end_before(i) + 1, x["start"] - end_before(i)), F.lit("["), F.upper(x["entity_type"]), F.lit("]")))
    return F.concat(F.array_join(parts, ""), F.substring(text, end_before(F.size(entities)) + 1, F.length(text)))


_MAY_HOLD_PII = r"(?U)@|\d|(?:Mr|Mrs|Ms|Dr|Prof)"


def personal_data(c: Column | str) -> Column:
    """Struct (masked, entities).  Texts without ``@``, a digit or a title are passed on as they are."""
    text = col(c)
    found = _bound(personal_entities(text), lambda e: F.struct(masked_text(text, e).alias("masked"), e.alias("entities")))
    return F.when(text.rlike(_MAY_HOLD_PII), found).otherwise(F.struct(text.alias("masked"), F.array().cast(_ENTITY).alias("entities")))


def mask_emails(c: Column | str, mask: str = "[EMAIL]") -> Column:
    return F.regexp_replace(col(c), v.PII_EMAIL, mask)


def pii_type_counts(c: Column | str) -> dict[str, Column]:
    """Raw matches per type, before overlaps are resolved, all on the JVM."""
    text = col(c)

    def hits(pattern: str, flags: str = "") -> Column:
        return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(0))

    phones = F.lit(0)
    for p in v.PII_PHONES:
        phones = phones + F.size(F.filter(
            hits(p), lambda m: F.length(F.regexp_replace(m, "[ .-]", "")) >= 7))
    accounts = F.lit(0)
    for p in v.PII_ACCOUNTS:
        accounts = accounts + F.size(hits(p, "(?i)"))
    return {
        "email": F.size(hits(v.PII_EMAIL)),
        "phone": phones,
        "account_id": accounts,
        "person_name": F.size(hits(v.PII_TITLED_NAME)),
    }


def sanitize(c: Column | str) -> Column:
    """Event-log masking of e-mail addresses and phone numbers in one string."""
    text = F.regexp_replace(col(c), "(?U)" + v.EVENT_EMAIL, v.EVENT_EMAIL_MASK)
    return F.regexp_replace(text, v.EVENT_PHONE, v.EVENT_PHONE_MASK)


def sanitize_map(m: Column | str) -> Column:
    """Values are masked, keys are not."""
    return F.transform_values(col(m), lambda _k, val: sanitize(val))


_JSON_PART = r'"[^"]*+":?|[^"]++'


def sanitize_json(payload: Column | str) -> Column:
    """A JSON payload of any depth with every string value masked and its keys untouched.

    The payload is brought into its plain form, cut into strings and what stands between them, and a string before a colon is a
    key.  What is no JSON is masked as one string; key order and spacing are those of the plain form.
    """
    raw = col(payload)
    pair, quote = "\x01", "\x02"  # never bare in plain JSON
    plain = F.replace(F.replace(F.to_json(F.try_parse_json(raw)), F.lit("\\\\"), F.lit(pair)), F.lit('\\"'), F.lit(quote))

    def mask(part: Column) -> Column:
        escaped = F.replace(F.replace(part, F.lit(quote), F.lit('\\"')), F.lit(pair), F.lit("\\\\"))
        value = F.get(F.from_json(F.concat(F.lit("["), escaped, F.lit("]")), "array<string>"), F.lit(0))
        listed = F.to_json(F.array(sanitize(value)))
        return F.when(part.startswith('"') & ~part.endswith(":"), F.substring(listed, F.lit(2), F.length(listed) - 2)).otherwise(escaped)

    parts = F.transform(F.regexp_extract_all(plain, F.lit(_JSON_PART), F.lit(0)), mask)
    return F.coalesce(F.array_join(parts, ""), sanitize(raw))


# --- validation --------------------------------------------------------------


def effective_date_flag(start: Column | str, end: Column | str) -> Column:
    """``impossible_date`` when both are given and unreadable or reversed."""
    a, b = col(start), col(end)
    given = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    x, y = F.try_to_timestamp(a), F.try_to_timestamp(b)
    return F.when(given & (x.isNull() | y.isNull() | (y < x)), F.lit("impossible_date"))


def negative_money(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"-\$[\d,]+", 0), F.lit(""))


def wild_percentages(c: Column | str) -> Column:
    found = F.regexp_extract_all(col(c), F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1))
    return F.filter(found, lambda p: p.cast("double") > 1000)


def validation_flags(title, source_id, content, effective_from=None, effective_to=None) -> Column:
    """All flags of a record, repeats included, in check order."""
    missing, numeric = F.lit("missing_metadata"), F.lit("invalid_numeric")
    content_c = F.coalesce(col(content), F.lit(""))
    single = [
        F.when(is_blank(title), missing),
        F.when(F.coalesce(col(source_id).cast("string"), F.lit("")) == "", missing),
        F.when(F.length(strip(content_c)) < 10, missing),
    ]
    if effective_from is not None:
        single.append(effective_date_flag(effective_from, effective_to))
    single.append(F.when(negative_money(content_c).isNotNull(), numeric))
    head = F.filter(F.array(*single), lambda x: x.isNotNull())
    return F.concat(head, F.transform(wild_percentages(content_c), lambda _p: numeric))


def amounts(c: Column | str, require_digit: bool = False) -> Column:
    """Sorted set of the amounts named in a text.  A lone comma counts as an
    amount unless ``require_digit``."""
    found = F.regexp_extract_all(col(c), F.lit(v.AMOUNT_PATTERN), F.lit(1))
    if require_digit:
        found = F.filter(found, lambda a: a.rlike(r"\d"))
    return F.array_sort(F.array_distinct(found))
