"""Personal data: fixed patterns plus a semi-Markov conditional random field.

The field scores whole candidate spans of up to ``LONGEST`` chunks (runs without white space, outer punctuation trimmed) and a
dynamic program over the chunks chooses borders and types together.  It reads only the neighbourhood of digits, ``@``, ``=`` and quoted
words of twelve signs or more; elsewhere every chunk is plain text.  It is trained here by gradient ascent on the conditional likelihood of regions taken from a
bounded sample of texts.  The labels are the spans of the fixed patterns and of quoted assignments to secret names; half of the
labelled spans are rewritten (separators changed, prefix left out), so the field learns the spans and not the patterns.
A span is added if its posterior is at least ``sure`` and it touches no pattern span; pattern spans always stay.

Defined results: a null text is the empty text; repeated rows get equal results; an empty table gives an empty table; without
training regions only the patterns count.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TYPES = ("text", *KINDS, "secret")
LONGEST, AROUND, SURE, MOST_TEXTS, MOST_REGIONS = 5, 40, 0.9, 3000, 1500
RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a run of digits is never entered midway: it would fail alike
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"\b(?:token|secret|password|passwd|api_key|apikey|access_key|key)\s?[=:]\s?\"([^\"\s]{12,})\"", re.I)
_HOT = r"[0-9@=]|\"[^\s\"]{12,}\""
_TRIGGER, _CHUNK, _DIGIT = re.compile(_HOT), re.compile(r"\S*?[=:](?=\")|\S+"), re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    twice = [2 * int(x) for x in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, by kind as listed, then start."""
    out = [("email", *s) for s in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.sub("", m[0])) <= 15]
    return out


def regions(text: str, around: int = AROUND) -> Iterator[tuple[int, int]]:
    """Stretches around triggers, ending at white space."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        at, to = m.span()
        if to <= end:
            continue
        low, high = max(0, at - around), min(len(text), to + around)
        while low > 0 and not text[low - 1].isspace():
            low -= 1
        while high < len(text) and not text[high].isspace():
            high += 1
        if low <= end:
            end = high
        else:
            if end >= 0:
                yield start, end
            start, end = low, high
    if end >= 0:
        yield start, end


def _trim(text: str, s: int, e: int) -> tuple[int, int]:
    opened = text.find("(", s, e)
    while e > s and not (text[e - 1].isalnum() or (text[e - 1] == ")" and 0 <= opened < e)):
        e -= 1
    closed = text.rfind(")", s, e)
    while s < e and not (text[s].isalnum() or text[s] == "+" or (text[s] == "(" and closed >= s)):
        s += 1
    return s, e


def _bucket(n: int) -> int:
    return n if n < 8 else 8 + (n - 8) // 4 if n < 40 else 16


def features(text: str, s: int, e: int, chunks: int, before: str) -> list[str]:
    """Of a whole candidate span."""
    span = text[s:e]
    digits = _DIGIT.sub("", span)
    letters = sum(c.isalpha() for c in span)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", span[:64]))
    quoted = s > 0 and text[s - 1] == '"' and e < len(text) and text[e] == '"'
    out = ["bias", f"chunks {chunks}", f"shape {shape[:24]}", f"digits {_bucket(len(digits))}", f"length {_bucket(len(span))}",
           f"letters {min(letters, 3)}", f"quoted {quoted}", f"before {before}"]
    parts = re.split(r"[^0-9]+", digits and span.strip("+()"))
    if digits and not letters:
        out.append("groups " + " ".join(str(min(len(x), 9)) for x in parts[:6]))
        out.append(f"signs {''.join(sorted(set(_sign(span))))}")
        if len(digits) >= 13:
            out.append(f"luhn {luhn(digits)}")
        if len(parts) == 4 and all(x for x in parts):
            out.append(f"bytes {all(len(x) <= 3 and int(x) <= 255 for x in parts)}")
    if "@" in span:
        out.append(f"at {span.count('@')} {'.' in span.partition('@')[2]}")
    if re.fullmatch(r"[0-9A-Za-z_\-/+=]{12,}", span) and digits and letters:
        out.append(f"key {_bucket(len(span))} {quoted}")
    return out


def _sign(span: str) -> str:
    return re.sub(r"[0-9]", "", span)


class Field:
    """Weights of span features and of neighbouring types."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps

    @staticmethod
    def candidates(text: str, start: int, end: int):
        """Chunks of a region and, per chunk and length, the trimmed span or None where no entity can be."""
        chunks = [m.span() for m in _CHUNK.finditer(text, start, end)]
        hot = [bool(_TRIGGER.search(text, s, e)) for s, e in chunks]
        spans = []
        for i in range(len(chunks)):
            row = []
            for n in range(1, LONGEST + 1):
                ok = i + n <= len(chunks) and (n == 1 or (hot[i] and hot[i + n - 1]))
                s, e = _trim(text, chunks[i][0], chunks[i + n - 1][1]) if ok else (0, 0)
                row.append((s, e) if e > s else None)
            spans.append(row)
        return chunks, hot, spans

    @staticmethod
    def described(text: str, chunks, spans):
        """Feature lists [chunk][length - 1]; None where no candidate is."""
        rows = []
        for i, row in enumerate(spans):
            before = text[slice(*chunks[i - 1])].lower() if i else ""
            before = before if before in ("=", ":", "tel", "call", "mail", "card") else "other" if before else "none"
            rows.append([features(text, *x, n + 1, before) if x else (["bias", "blank"] if n == 0 else None) for n, x in enumerate(row)])
        return rows

    def scores(self, rows, hot) -> np.ndarray:
        out = np.full((len(rows), LONGEST, len(TYPES)), -np.inf)
        for i, row in enumerate(rows):
            for n, names in enumerate(row):
                if names is not None:
                    at = [k for k in map(self.names.get, names) if k is not None]
                    z = self.weights[at].sum(axis=0)
                    out[i, n] = z if n or hot[i] else -np.inf
                    out[i, n, 0] = z[0] if n == 0 else -np.inf
        return out

    def passes(self, s: np.ndarray):
        """Log sums of all segmentations before and after each border; rows are the type left behind."""
        n, k = len(s), len(TYPES)
        ahead, back = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        ahead[0, 0] = 0.0
        back[n] = 0.0
        with np.errstate(divide="ignore"):
            for j in range(1, n + 1):
                into = [_sum(ahead[j - m][:, None] + self.steps, 0) + s[j - m, m - 1] for m in range(1, min(LONGEST, j) + 1)]
                ahead[j] = _sum(np.array(into), 0)
            for j in range(n - 1, -1, -1):
                out = [s[j, m - 1] + back[j + m] for m in range(1, min(LONGEST, n - j) + 1)]
                back[j] = _sum(self.steps + _sum(np.array(out), 0)[None, :], 1)
        return ahead, back, float(_sum(ahead[n], 0))

    def posterior(self, s: np.ndarray):
        """[chunk, length - 1, type] and the expected neighbourhoods of types."""
        ahead, back, z = self.passes(s)
        p, steps = np.zeros_like(s), np.zeros_like(self.steps)
        with np.errstate(divide="ignore"):
            for i in range(len(s)):
                for m in range(1, min(LONGEST, len(s) - i) + 1):
                    both = ahead[i][:, None] + self.steps + s[i, m - 1][None, :] + back[i + m][None, :] - z
                    q = np.exp(both)
                    p[i, m - 1] = q.sum(axis=0)
                    steps += q
        return p, steps

    def spans(self, text: str, start: int, end: int, sure: float) -> list[tuple[str, int, int]]:
        """The best segmentation's entities whose posterior is at least ``sure``."""
        chunks, hot, spans = self.candidates(text, start, end)
        if not any(hot):
            return []
        s = self.scores(self.described(text, chunks, spans), hot)
        n, k = len(s), len(TYPES)
        best, come = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k, 2), int)
        best[0, 0] = 0.0
        for j in range(1, n + 1):
            for m in range(1, min(LONGEST, j) + 1):
                way = best[j - m][:, None] + self.steps
                z = way.max(axis=0) + s[j - m, m - 1]
                up = z > best[j]
                best[j][up], come[j][up, 0], come[j][up, 1] = z[up], m, way.argmax(axis=0)[up]
        out, j, y = [], n, int(best[n].argmax())
        p = None
        while j > 0:
            m, before = come[j, y]
            if y:
                p = self.posterior(s)[0] if p is None else p
                if p[j - m, m - 1, y] >= sure:
                    out.append((TYPES[y], *spans[j - m][m - 1]))
            j, y = j - m, int(before)
        return out


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    safe = np.where(np.isfinite(top), top, 0.0)
    return np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis=axis)) + safe


def _rewritten(kind: str, span: str, rng: random.Random) -> str:
    """Another common way to write the same datum."""
    digits = _DIGIT.sub("", span)
    if kind == "phone" and len(digits) > 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits[:-10]}-{a}-{b}-{c}"))
    if kind == "card":
        return rng.choice(("-", " ", ".")).join(digits[k:k + 4] for k in range(0, len(digits), 4))
    return span


def labelled(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    found = [x for x in base_spans(text[start:end])] + [("secret", *m.span(1)) for m in _SECRET.finditer(text, start, end)]
    return sorted((k, s + (start if k != "secret" else 0), e + (start if k != "secret" else 0)) for k, s, e in found)


def train(examples: list[str], epochs: int = 8, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> Field | None:
    """Ascend the conditional likelihood of the labelled regions by adaptive steps per weight."""
    rng, cases, names = random.Random(seed), [], {}
    for text in examples:
        for again in range(2):
            t, marks = text, sorted(labelled(text, 0, len(text)), key=lambda x: x[1])
            if again:
                moved, shift = [], 0
                for kind, s, e in marks:
                    new = _rewritten(kind, t[s + shift:e + shift], rng)
                    t = t[:s + shift] + new + t[e + shift:]
                    moved.append((kind, s + shift, s + shift + len(new)))
                    shift += len(new) - (e - s)
                if t == text:
                    continue
                marks = moved
            chunks, hot, spans = Field.candidates(t, 0, len(t))
            where = {x: (i, n) for i, row in enumerate(spans) for n, x in enumerate(row) if x}
            gold, used = {}, set()
            for kind, s, e in marks:
                i, n = where.get((s, e), (None, 0))
                if i is None or used & set(range(i, i + n + 1)):
                    break
                gold[i] = (n, TYPES.index(kind))
                used |= set(range(i, i + n + 1))
            else:  # every label is a candidate
                rows = Field.described(t, chunks, spans)
                for row in rows:
                    for f in row:
                        for name in f or ():
                            names.setdefault(name, len(names))
                cases.append((rows, hot, gold))
    if not cases:
        return None
    field = Field(names, np.zeros((len(names), len(TYPES))), np.zeros((len(TYPES), len(TYPES))))
    gw, gs = np.full(field.weights.shape, 1e-8), np.full(field.steps.shape, 1e-8)
    for _ in range(epochs):
        rng.shuffle(cases)
        for rows, hot, gold in cases:
            p, steps = field.posterior(field.scores(rows, hot))
            change, before, i = -steps, 0, 0
            while i < len(rows):
                n, y = gold.get(i, (0, 0))
                p[i, n, y] -= 1
                change[before, y] += 1
                before, i = y, i + n + 1
            grad: dict[int, np.ndarray] = {}
            for i, row in enumerate(rows):
                for n, f in enumerate(row):
                    if f is not None and np.abs(p[i, n]).max() > 1e-6:
                        for name in f:
                            k = names[name]
                            grad[k] = grad[k] - p[i, n] if k in grad else -p[i, n]
            at = np.fromiter(grad, int, len(grad))
            if len(at):
                g = np.array(list(grad.values())) - decay * field.weights[at]
                gw[at] += g * g
                field.weights[at] += rate * g / np.sqrt(gw[at])
            gs += change * change
            field.steps += rate * change / np.sqrt(gs)
    return field


def fit(docs: DataFrame, text: str = "text", id_col: str = "doc_id", most_texts: int = MOST_TEXTS, most_regions: int = MOST_REGIONS) -> Field | None:
    """Train on at most ``most_regions`` regions of about ``most_texts`` texts, picked by hash over the whole table."""
    triggered = docs.filter(F.rlike(text, F.lit(_HOT)))
    n = triggered.count()
    share = min(1.0, most_texts / max(1, n))
    picked = triggered.filter(F.shiftrightunsigned(F.xxhash64(text, F.lit("learn")), 11) * F.lit(2.0 ** -53) < share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [t[s:e] for t in b.column(0).to_pylist() for s, e in regions(t) if e - s <= 1000]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["region"])

    rows = picked.select(F.col(text).cast("string").alias("text")).mapInArrow(cut, "region string").distinct() \
        .orderBy(F.xxhash64("region")).limit(most_regions).collect()
    return train(sorted(r.region for r in rows))


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sure: float = SURE, field: Field | None = None) -> DataFrame:
    """``doc_id``, the pattern counts, ``base_sha256`` and ``spans`` of every document."""
    field = field or fit(docs, text, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # at most the features of MOST_REGIONS regions

    def found(t: str) -> tuple:
        base = base_spans(t)
        added = []
        if shared.value is not None:
            placed = sorted(x[1:] for x in base)
            starts, longest = [x[0] for x in placed], max((e - s for s, e in placed), default=0)
            for s, e in regions(t):
                near = placed[bisect_left(starts, s - longest):bisect_left(starts, e)]
                added += [x for x in shared.value.spans(t, s, e, sure) if all(x[2] <= b[0] or b[1] <= x[1] for b in near)]
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        both = sorted({*base, *added}, key=lambda x: (TYPES.index(x[0]), x[1], x[2]))
        count = [sum(b[0] == k for b in base) for k in KINDS]
        return (*count, hashlib.sha256(listed.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in both))

    plain = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")

    @F.arrow_udf(RESULT)
    def apply(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for part in parts:
            rows = []
            for at in range(0, len(part), 256):
                rows += [found(t) if t else plain for t in part.slice(at, 256).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(cols)], names)

    # texts without a trigger or plus sign cannot hold anything and stay in the JVM
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sent = F.when(F.rlike(t, F.lit(_HOT)), t).otherwise(F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), apply(sent).alias("x")).select("doc_id", "x.*")
