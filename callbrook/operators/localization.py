"""Language, register, market terms and localized messages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions.text import col, strip

TOKEN = r"(?U)\b[\w\-]+\b"


def _count(tokens: Column, words: Sequence[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*words)))


def _result(language, confidence, register, switched, details) -> Column:
    return F.struct(
        F.lit(language).alias("language") if isinstance(language, str) else language.alias("language"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
        (F.lit(register) if isinstance(register, str) else register).alias("register"),
        (F.lit(switched) if isinstance(switched, bool) else switched).alias("code_switch"),
        (F.lit(details) if details is None or isinstance(details, str) else details).cast("string").alias("details"))


def spoken_tokens(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(strip(text), F.lit(TOKEN), F.lit(0)), F.lower)


def detect_ph(tokens: Column) -> Column:
    n = F.greatest(F.lit(1), F.size(tokens))
    local, english = _count(tokens, v.FILIPINO_MARKERS), _count(tokens, v.PH_ENGLISH_WORDS)
    switches = F.size(F.filter(tokens, lambda t: t.rlike(v.PH_SWITCH_PREFIX)))
    register = F.when(_count(tokens, v.PH_POLITE_WORDS) > 0, "formal").otherwise("mixed")
    ratio = local / n
    return F.when((local == 0) & (_count(tokens, ("po", "opo")) == 0), _result("en", 0.90, "professional", False, None)) \
        .when((ratio > 0.65) & (english == 0) & (switches == 0), _result("fil", 0.85, register, False, None)) \
        .otherwise(_result("taglish", 0.88, register, True, F.concat(
            F.lit("Filipino marker ratio: "), F.format_string("%.2f", F.bround(ratio, 2)),
            F.lit(", English keywords: "), english.cast("string"))))


def detect_id(tokens: Column) -> Column:
    n = F.greatest(F.lit(1), F.size(tokens))
    formal, casual = _count(tokens, v.INDONESIAN_FORMAL), _count(tokens, v.INDONESIAN_COLLOQUIAL)
    loans = _count(tokens, v.ID_LOANWORDS)
    details = F.when(loans > 0, F.concat(F.lit("English finance loanwords detected: "), loans.cast("string")))

    def sure(k: Column) -> Column:
        return F.least(F.lit(0.95), F.lit(0.70) + (k / n) * 0.5)

    return F.when((formal > casual) & (formal > 0), _result("id_formal", sure(formal), "formal", loans > 0, details)) \
        .when(casual > 0, _result("id_colloquial", sure(casual), "colloquial", loans > 0, details)) \
        .otherwise(_result("id_mixed", 0.75, "mixed", loans > 0, details))


def detect_language(text: Column | str, market: str) -> Column:
    """Struct (language, confidence, register, code_switch, details)."""
    tokens = spoken_tokens(text)
    blank = _result("taglish" if market == "PH" else "id_colloquial", 0.5, "colloquial", False, "Empty utterance default")
    return F.when(strip(text) == "", blank).otherwise(detect_ph(tokens) if market == "PH" else detect_id(tokens))


def term_owners(market: str) -> list[tuple[str, str, str]]:
    """(lower-cased term or variant, concept, term): terms first, then variants
    in list order; the first owner of a spelling keeps it."""
    entries = v.MARKET_TERMS[market]
    owned = {term.lower(): (concept, term) for concept, term, _ in entries}
    for concept, term, variants in entries:
        for variant in variants:
            owned.setdefault(variant.lower(), (concept, term))
    return [(k, c, t) for k, (c, t) in owned.items()]


def find_terms(text: Column | str, market: str) -> Column:
    """Distinct concepts named in a text, in dictionary order."""
    low = F.lower(col(text))
    hits = [F.when(low.rlike(rf"(?U)\b{re.escape(k)}\b"), concept) for k, concept, _ in term_owners(market)]
    return F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))


def normalize_market_terms(text: Column | str, market: str) -> Column:
    out = col(text)
    for k, _, term in term_owners(market):
        if k != term.lower():
            out = F.regexp_replace(out, rf"(?iuU)\b{re.escape(k)}\b", term)
    return out


def lookup_term(term: Column | str, market: str) -> Column:
    """Concept that owns a term or variant, else null."""
    table = F.create_map(*[F.lit(x) for k, concept, _ in term_owners(market) for x in (k, concept)])
    return F.try_element_at(table, F.lower(strip(term)))


def fallback_message(market: Column | str, language: Column | str, reason: Column | str, register: Column | str) -> Column:
    """Message in the caller's language; else by register (ID) or Taglish (PH)."""
    table = F.create_map(*[F.lit(x) for lang, why, text in v.FALLBACK_MESSAGES for x in (f"{lang}|{why}", text)])

    def of(lang: Column) -> Column:
        return F.try_element_at(table, F.concat_ws("|", lang, col(reason)))

    by_register = F.when(col(register) == "colloquial", "id_colloquial").when(col(register) == "formal", "id_formal").otherwise("id_mixed")
    return F.coalesce(
        of(col(language)),
        F.when(col(market) == "ID", F.coalesce(of(by_register), of(F.lit("id_formal"))))
        .otherwise(F.coalesce(of(F.lit("taglish")), of(F.lit("en")))))
