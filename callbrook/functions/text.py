"""Text expressions with Unicode semantics fixed in one place.

Spark's ``trim`` and Java's ``\\s`` are ASCII-only by default, so stripping and
whitespace folding go through the explicit class below, and patterns that need
Unicode word boundaries carry ``(?U)``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\u000B\u001C-\u001F\u0085\p{Z}]"
# the same characters one by one, for trimming without a regular expression
SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(SPACE_CHARS))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def words(c: Column | str) -> Column:
    """Whitespace-separated words of the stripped text; none for blank text."""
    parts = F.split(strip(c), f"{SPACE}+")
    return F.filter(parts, lambda w: w != "")


def fold_for_hash(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(c)), f"{SPACE}+", " ")


def record_hash(c: Column | str) -> Column:
    """Identity of a record's content: strip, lower, SHA-256."""
    return F.sha2(F.lower(strip(c)), 256)


def content_hash(c: Column | str) -> Column:
    """Identity used for duplicates: as above, with whitespace runs folded."""
    return F.sha2(fold_for_hash(c), 256)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column | str) -> Column:
    """Unicode compatibility form.  ASCII rows never leave the JVM's side of
    the Arrow batch: they travel as nulls and are taken from the input."""
    text = col(c)
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def tidy_whitespace(c: Column | str, unicode_form: bool = True) -> Column:
    """Blanks and tabs to one blank, three or more newlines to two, lines stripped."""
    text = nfkc(c) if unicode_form else col(c)
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    lines = F.transform(F.split(text, "\n"), strip)
    return strip(F.array_join(lines, "\n"))


def dashed_dates(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(\d{1,2})/(\d{1,2})/(\d{4})", "$1-$2-$3")


def matches_any(c: Column | str, patterns: Iterable[str], flags: str = "(?iu)") -> Column:
    """One alternation, so Spark compiles a single pattern per predicate."""
    return col(c).rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def contains_any(c: Column | str, phrases: Iterable[str]) -> Column:
    """Plain substring test against a constant list."""
    text = col(c)
    test = F.lit(False)
    for phrase in phrases:
        test = test | text.contains(phrase)
    return test


def contains_any_regex(c: Column | str, phrases: Iterable[str]) -> Column:
    """The same for long lists: one pass over the text instead of one per phrase."""
    return col(c).rlike("|".join(re.escape(p) for p in phrases))


def starts_with_any(c: Column | str, phrases: Iterable[str]) -> Column:
    return col(c).rlike("^(?:" + "|".join(re.escape(p) for p in phrases) + ")")


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def tokens(c: Column | str) -> Column:
    """Every ``[a-z0-9_]+`` run of the lower-cased text, stopwords included."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9_]+"), F.lit(0))


def without(c: Column, stopwords: Sequence[str]) -> Column:
    """Drop stopwords and keep repeats (``array_except`` would lose them).  The
    literal list becomes one hash set in the plan."""
    return F.filter(c, lambda w: ~w.isin(*stopwords))


def first_match(c: Column | str, patterns: Sequence[str], flags: str = "(?iuU)") -> Column:
    """Text matched by the first pattern that matches at all, else null."""
    return F.coalesce(*[
        F.nullif(F.regexp_extract(col(c), flags + p, 0), F.lit("")) for p in patterns
    ])


def replace_chain(c: Column | str, pairs: Sequence[tuple[str, str]], flags: str = "(?iu)") -> Column:
    """Successive literal-replacement passes; each sees the previous result."""
    text = col(c)
    for pattern, replacement in pairs:
        text = F.regexp_replace(text, flags + pattern, replacement)
    return text


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """Deterministic surrogate id: retries and reruns give the same value."""
    key = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(key, 256), 1, 16))
