"""Near duplicates by matching-block ratio, complete.

Two texts are near duplicates when ``SequenceMatcher(new, earlier).ratio()``
reaches the threshold.  A lossless filter finds the candidates:

* The ratio ``2M / (la + lb)`` fixes how many characters M must match, and
  with it how far the lengths may differ: only neighbouring length classes meet.
* Matching blocks are few.  Between two blocks at least one character is
  unmatched; and in texts of 200 characters or more every block but a common
  beginning holds a character that is rare in the earlier text.  So the texts
  share at least ``M - blocks * (q - 1)`` of their q-grams, copies counted.
* A text becomes a row of bits, each the parity of the number of grams that fall on it.  Two rows differ in no more bits than the
  texts differ in grams.  Rows folded to half are compared first, block by block as matrix products; whole rows of what passes follow.
  Blocks of texts whose lengths or counts of characters are too far apart are skipped.

Texts of a length class are cut into tiles of bounded size, and each pair of
tiles is searched by a task of its own.  Every pair of tiles in reach is compared, so this
step grows with the square of a class, but no text is read in it.  Pairs that pass are dealt to bins so that those of a group of
similar texts meet, and a text moves once to a bin.  Equal texts are collapsed first, and edges between contents stand for
the edges of all their copies.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callbrook import fixed_values as v
from callbrook.functions.text import fold_for_hash
from callbrook.operators.carry import Running, running
from callbrook.session import written

CHECKED_GRAMS = (3, 5, 8, 12, 24)  # lengths counted for a candidate before its blocks are sought
CHARS = 32  # counts of characters, folded
TILE_ROWS, TILE_BYTES, TILES = 16384, 1 << 25, 32  # most rows and bytes of a tile; tiles wanted, so that all tasks have work
SETS, ODD = 5, 0.04  # sets of characters that part the texts of a tile, and the share by which a text is odd
BLOCK_ROWS, BLOCK_BITS, HELD_BITS, LISTED_BYTES = 128, 1 << 22, 1 << 24, 1 << 22  # most rows and bits of a block; bits of blocks and bytes of rows at a time
LONGEST_RUN = 24  # rare characters in a row up to which a text's runs are listed
SIDE, BIN_PAIRS, BIN_CHARS = 256, 8192, 1 << 24  # texts of a group that meet as many others; about so many pairs and characters of a bin
LEAST_TILE = 512


# --- bounds ------------------------------------------------------------------


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def rare_positions(codes: np.ndarray) -> int:
    """Positions holding a character that is not frequent in a long text; short texts have no frequent ones."""
    n = len(codes)
    if n < 200:
        return n
    counts = np.unique(codes, return_counts=True)[1]
    return int(counts[counts <= n // 100 + 1].sum())


def needed_grams(total, rare, q: int, t: float):
    """Least number of shared q-grams of texts with ``total`` characters together, when the earlier one has ``rare`` positions."""
    blocks = np.minimum(rare + 1, (1 - t) * total + 1)
    return t * total / 2 - blocks * (q - 1) - 1e-6


def length_class(n: int, t: float) -> int:
    """Texts whose lengths allow the ratio lie in the same class or in neighbouring ones."""
    return int(math.log(n) / math.log((2 - t) / t * 1.0001)) if n > 1 else 0


def class_grams(k: int, t: float) -> tuple[int, int]:
    """(gram length, bits of a folded row) for the texts of a class and those of the next one that meet them."""
    longest = ((2 - t) / t * 1.0001) ** (k + 1)
    q, share = (2, 1.5) if longest < 250 else (3, 1.5) if longest < 1500 else (4, 1.5) if longest < 8000 else (7, 2)
    return q, 64 * math.ceil(share * longest / 64)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q-grams; the k-th copy of a gram hashes differently
    from the others, so set overlap equals multiset overlap."""
    m = len(codes) - q + 1
    if m < 1:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(m, dtype=np.uint64)
    for j in range(q):
        h *= np.uint64(1099511628211)
        h += codes[j:j + m]
        h += np.uint64(1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h.sort()
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    copy = np.arange(m) - np.repeat(starts, np.diff(np.append(starts, m)))
    h = (h ^ (copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def gram_bits(h: np.ndarray, bits: int) -> bytes:
    """For each of twice ``bits`` places whether an odd number of grams falls there."""
    return np.packbits((np.bincount((h >> np.uint64(20)) % np.uint64(2 * bits), minlength=2 * bits) & 1).astype(bool)).tobytes()


def most_apart(total, rare, q: int, t: float):
    """Most q-grams that are in one only of two texts which share the needed ones."""
    return total - 2 * (q - 1) - 2 * needed_grams(total, rare, q, t)


def char_counts(codes: np.ndarray) -> bytes:
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(27), minlength=CHARS).astype(np.int32).tobytes()


def alike(a: str, b: str, i: int, j: int, most: int) -> int:
    """How many of ``most`` characters from ``a[i]`` and ``b[j]`` on are equal."""
    lo, hi = 0, 8
    while hi < most and a[i + lo:i + hi] == b[j + lo:j + hi]:
        lo, hi = hi, 4 * hi
    hi = min(hi, most) + 1  # not all of the first ``hi`` are equal
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[i + lo:i + mid] == b[j + lo:j + mid] else (lo, mid)
    return lo


def alike_before(a: str, b: str, i: int, j: int, most: int) -> int:
    """How many of ``most`` characters before ``a[i]`` and ``b[j]`` are equal."""
    lo, hi = 0, 8
    while hi < most and a[i - hi:i - lo] == b[j - hi:j - lo]:
        lo, hi = hi, 4 * hi
    hi = min(hi, most) + 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[i - mid:i - lo] == b[j - mid:j - lo] else (lo, mid)
    return lo


def counts_of(text: str) -> dict[str, int]:
    chars = set(text)
    return {c: text.count(c) for c in chars} if len(chars) < 256 else Counter(text)


def some_of(chars: set[str], least: int) -> re.Pattern:
    """One of these characters, or so many of them in a row at least."""
    return re.compile(f"[{re.escape(''.join(sorted(chars)))}]" + (f"{{{least},}}" if least > 1 else "") if chars else "(?!)")


def places_of_runs(text: str, more: re.Pattern, longest: int) -> list[dict[str, list[int]]] | None:
    """For each length from 2 up, after an empty one for 1, the places of each run, parts of longer ones included; None if one is
    longer than ``longest``."""
    runs: list[dict[str, list[int]]] = [{}]
    for found in more.finditer(text):
        at, run = found.start(), found.group()
        if len(run) > longest:
            return None
        for size in range(2, len(run) + 1):
            if len(runs) < size:
                runs.append({})
            for k in range(len(run) - size + 1):
                runs[size - 1].setdefault(run[k:k + size], []).append(at + k)
    return runs


class New:
    """A text with its runs of two and more characters that are not very frequent in it; None if some are very long."""

    def __init__(self, text: str):
        self.text, counts, most = text, counts_of(text), len(text) // 64 + 2
        self.frequent = {c for c, k in counts.items() if k > most}
        self.runs = places_of_runs(text, some_of(counts.keys() - self.frequent, 2), LONGEST_RUN) if len(text) >= 200 else None


class Earlier:
    """A text with the places of its runs of rare characters, from which alone blocks grow in a long text.

    ``runs`` is None for a text in which every character counts or runs are very long.
    """

    def __init__(self, text: str):
        self.text, self.runs = text, None
        n = len(text)
        if n >= 200:
            self.rare = {c for c, k in counts_of(text).items() if k <= n // 100 + 1}
            self.one, self.more = some_of(self.rare, 1), some_of(self.rare, 2)
            self.runs = places_of_runs(text, self.more, LONGEST_RUN)
            if self.runs is not None:
                for found in self.one.finditer(text):
                    self.runs[0].setdefault(found.group(), []).append(found.start())

    def runs_of(self, new: New) -> list[dict[str, list[int]]]:
        """Places in ``new`` of all runs of two and more characters that are rare here, and of others that occur in no run here."""
        if new.runs is not None and self.rare.isdisjoint(new.frequent):
            return new.runs
        return places_of_runs(new.text, self.more, len(new.text))


def ratio_if_near(new: str | New, earlier: str | Earlier, t: float) -> float | None:
    """The ratio when it reaches ``t``: the blocks of ``SequenceMatcher``, until those still possible no longer suffice."""
    a, b = new if isinstance(new, New) else New(new), earlier if isinstance(earlier, Earlier) else Earlier(earlier)
    longest_match = _by_rare_runs(a, b) if b.runs is not None else _by_library(a.text, b.text, t)
    if longest_match is None:
        return None
    na, nb = len(a.text), len(b.text)
    total, matched, possible, parts = na + nb, 0, min(na, nb), [(0, na, 0, nb)]
    while parts:
        alo, ahi, blo, bhi = parts.pop()
        i, j, k = longest_match(alo, ahi, blo, bhi)
        possible -= min(ahi - alo, bhi - blo)
        if k:
            matched += k
            for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                fits = min(part[1] - part[0], part[3] - part[2])
                if fits:
                    possible += fits
                    parts.append(part)
        if 2.0 * (matched + possible) / total < t:
            return None
    return 2.0 * matched / total


def _by_library(new: str, earlier: str, t: float):
    """Cheap upper bounds go first; None if they tell the texts apart."""
    a, b = codes_of(new), codes_of(earlier)
    total, rare = len(a) + len(b), rare_positions(b)
    for q in CHECKED_GRAMS:
        need = needed_grams(total, rare, q, t)
        if need > 0 and np.intersect1d(grams(a, q), grams(b, q), assume_unique=True).size < need:
            return None
    m = SequenceMatcher(None, new, earlier)
    return m.find_longest_match if m.quick_ratio() >= t else None


def _by_rare_runs(new: New, earlier: Earlier):
    """As the library finds it: the longest shared run of rare characters, the first in ``a`` and then in ``b``, grown to both sides."""
    a, b, runs = new.text, earlier.text, earlier.runs_of(new)
    shared = []  # runs of each size that both have, the largest first
    for size, (mine, its) in enumerate(zip(runs[1:], earlier.runs[1:]), 2):
        if not (both := mine.keys() & its.keys()):
            break
        shared.insert(0, (size, mine, its, both))
    listed: dict[int, tuple[list[int], list[list[int]]]] = {}

    def first_run(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        for size, mine, its, both in shared:
            if size not in listed:
                rows = sorted([(i, run) for run in both for i in mine[run]])
                listed[size] = [i for i, _ in rows], [its[run] for _, run in rows]
            starts, places = listed[size]
            for p in range(bisect_left(starts, alo), bisect_left(starts, ahi - size + 1)):
                q = bisect_left(places[p], blo)
                if q < len(places[p]) and places[p][q] <= bhi - size:
                    return starts[p], places[p][q], size
        for found in earlier.one.finditer(a, alo, ahi):
            if at := earlier.runs[0].get(found.group()):
                q = bisect_left(at, blo)
                if q < len(at) and at[q] < bhi:
                    return found.start(), at[q], 1
        return alo, blo, 0

    def longest_match(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        i, j, k = first_run(alo, ahi, blo, bhi)
        back, room = min(i - alo, j - blo), min(ahi - i, bhi - j) - k
        back = alike_before(a, b, i, j, back) if back else 0
        return i - back, j - back, back + k + (alike(a, b, i + k, j + k, room) if room else 0)

    return longest_match


class Tile:
    """Texts of one class in a task, in blocks of similar counts of characters and by ascending length within."""

    def __init__(self, rows: pa.Table, bits: int, sides: np.ndarray, t: float):
        self.cid, self.last, self.n, self.rare = (rows.column(c).to_numpy() for c in ("cid", "last_seq", "n", "rare"))
        self.chars = np.frombuffer(b"".join(rows.column("chars").to_pylist()), np.int32).reshape(-1, CHARS)
        self.bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(-1, 2 * bits // 64)
        count = self.chars @ sides.T  # how many characters a text has of each set
        # texts on the same side of the middle in each set, but odd ones apart, so that blocks have narrow bounds
        share = count[:, :SETS] / self.n[:, None]
        group = (share > (share.max(0) + share.min(0)) / 2) @ (1 << np.arange(SETS))
        for code in np.unique(group):
            own = np.flatnonzero(group == code)
            group[own[(np.abs(share[own] - np.median(share[own], axis=0)) > ODD).any(1)]] = 1 << SETS
        order = np.lexsort((self.n, group))
        for name in ("cid", "last", "n", "rare", "chars", "bits"):
            setattr(self, name, getattr(self, name)[order])
        count, step = count[order], max(1, min(BLOCK_ROWS, BLOCK_BITS // bits))
        edges = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
        self.starts = np.concatenate([np.arange(lo, hi, step) for lo, hi in zip(edges[:-1], edges[1:], strict=True)])
        self.stops = np.append(self.starts[1:], len(order))
        half = self.bits.shape[1] // 2
        self.ones = np.bitwise_count(self.bits[:, :half] ^ self.bits[:, half:]).sum(1, dtype=np.int64)  # of folded rows
        # of two near texts, one has at most the other's characters of a set and those it does not match
        self.least, self.most = (f.reduceat(x, self.starts) for f, x in ((np.minimum, self.n), (np.maximum, self.n)))
        self.over = np.minimum.reduceat(count - (1 - t / 2) * self.n[:, None], self.starts)
        self.has = np.maximum.reduceat(count - t / 2 * self.n[:, None], self.starts)

    def folded(self, k: int) -> np.ndarray:
        rows = self.bits[self.starts[k]:self.stops[k]]
        half = rows.shape[1] // 2
        return np.unpackbits((rows[:, :half] ^ rows[:, half:]).view(np.uint8), axis=1).astype(np.float32)


def char_sets(chars: np.ndarray) -> np.ndarray:
    """Sets of characters (a row each, of zeros and ones) by which the texts differ most."""
    share = chars / np.maximum(1, chars.sum(1, keepdims=True))
    vectors = np.linalg.eigh(np.cov(share, rowvar=False, bias=True))[1]
    return (vectors[:, -SETS:] > 0).T.astype(np.int64)


def tile_pairs(x: Tile, y: Tile, q: int, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``new, earlier`` ids of pairs of the tiles that pass the filter."""
    reach = (x.least[:, None] * t / (2 - t) <= y.most + 1e-6) & (y.least * t / (2 - t) <= x.most[:, None] + 1e-6)
    for one, other in zip(x.over.T, y.has.T, strict=True):
        reach &= one[:, None] <= other + 1e-6
    for one, other in zip(x.has.T, y.over.T, strict=True):
        reach &= other <= one[:, None] + 1e-6
    if x is y:
        reach = np.triu(reach)
    held = max(1, HELD_BITS // (x.bits.shape[1] * 32 * BLOCK_ROWS))
    for at in range(0, len(reach), held):
        left = {i: x.folded(i) for i in range(at, min(at + held, len(reach))) if reach[i].any()}
        for j in np.flatnonzero(reach[at:at + held].any(0)):
            right, others = y.folded(j), slice(y.starts[j], y.stops[j])
            other = (y.ones[others] - (1 - t) * y.n[others]).astype(np.float32)
            for i in [i for i in left if reach[i, j]]:
                # rows differ in at most (1 - t) * total + 2 * (q - 1) * rare bits; float32 is exact enough below 2 ** 23
                rows = slice(x.starts[i], x.stops[i])
                own = (x.ones[rows] - (1 - t) * x.n[rows]).astype(np.float32)
                common = left[i] @ right.T
                common += (q - 1) * np.maximum.outer(x.rare[rows].astype(np.float32), y.rare[others].astype(np.float32))
                a, b = np.nonzero(2 * common >= np.add.outer(own, other) - 2)
                a, b = a + x.starts[i], b + y.starts[j]
                if x is y and i == j:
                    a, b = a[a < b], b[a < b]
                step = max(1, LISTED_BYTES // (8 * x.bits.shape[1]))
                for k in range(0, len(a), step):
                    yield from _whole_rows(x, y, a[k:k + step], b[k:k + step], q, t)


def _whole_rows(x: Tile, y: Tile, a: np.ndarray, b: np.ndarray, q: int, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    apart = np.bitwise_count(x.bits[a] ^ y.bits[b]).sum(1, dtype=np.uint32)
    keep = apart <= most_apart(x.n[a] + y.n[b], np.maximum(x.rare[a], y.rare[b]), q, t)
    a, b, apart = a[keep], b[keep], apart[keep]
    keep = 2 * np.minimum(x.chars[a], y.chars[b]).sum(1) >= t * (x.n[a] + y.n[b]) - 1e-6
    a, b, apart = a[keep], b[keep], apart[keep]
    for new, earlier, p, r in ((x, y, a, b), (y, x, b, a)):
        at = np.flatnonzero((new.last[p] > earlier.cid[r]) & (apart <= most_apart(x.n[a] + y.n[b], earlier.rare[r], q, t)))
        if len(at):
            yield new.cid[p[at]], earlier.cid[r[at]]


# --- jobs --------------------------------------------------------------------


def contents(records: DataFrame, seq: str = "seq") -> DataFrame:
    """Distinct folded texts: ``cid`` is the first record's sequence number."""
    folded = records.select("record_id", F.col(seq).cast("long").alias("seq"), fold_for_hash("content").alias("text")) \
        .withColumn("h", F.sha2("text", 256))
    return folded.groupBy("h").agg(
        F.min("seq").alias("cid"), F.max("seq").alias("last_seq"), F.min_by("record_id", "seq").alias("first_id"),
        F.min_by("text", "seq").alias("text"), F.count("*").alias("copies"))


def near_contents(records: DataFrame, threshold: float = v.NEAR_DUPLICATE_THRESHOLD, seq: str = "seq") -> DataFrame:
    """Directed edges (new_cid, earlier_cid, new_id, earlier_id, similarity)
    between contents, where some record of the first comes after one of the
    second and the ratio (which depends on direction) reaches ``threshold``."""
    t = threshold
    docs = written(contents(records, seq).select("cid", "last_seq", "first_id", "text", F.length("text").alias("n")), "contents")
    pairs = written(binned(written(candidates(docs, t), "candidates"), docs), "pairs")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism * 3, docs.rdd.getNumPartitions(), pairs.count() // (2 * BIN_PAIRS))
    met = pairs.select(F.col("bin").alias("held"), F.explode(F.array("new_cid", "earlier_cid")).alias("cid")).distinct() \
        .join(docs.select("cid", "first_id", "text"), "cid").repartition(tasks, "held")

    def checked(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        at = {cid: k for k, cid in enumerate(texts["cid"].to_pylist())}
        text, first = texts["text"].to_pylist(), texts["first_id"]
        out, known, b, news = [], None, None, {}
        pairs = pairs.sort_by([("earlier_cid", "ascending"), ("new_cid", "ascending")])
        for new, earlier in zip(pairs["new_cid"].to_pylist(), pairs["earlier_cid"].to_pylist(), strict=True):
            if earlier != known:
                known, b = earlier, Earlier(text[at[earlier]])
            if new not in news:
                news[new] = New(text[at[new]])
            ratio = ratio_if_near(news[new], b, t)
            if ratio is not None:
                out.append((new, earlier, ratio))
        new, earlier, ratios = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [])
        ids = [first.take(pa.array([at[c] for c in cids], pa.int64())).combine_chunks().cast(pa.string()) for cids in (new, earlier)]
        return pa.table({"new_cid": pa.array(new, pa.int64()), "earlier_cid": pa.array(earlier, pa.int64()),
                         "new_id": ids[0], "earlier_id": ids[1], "similarity": pa.array(ratios, pa.float64())})

    kind = records.schema["record_id"].dataType
    scored = pairs.repartition(tasks, "bin").groupBy("bin").cogroup(met.groupBy("held")) \
        .applyInArrow(checked, "new_cid long, earlier_cid long, new_id string, earlier_id string, similarity double")
    return scored.select("new_cid", "earlier_cid", F.col("new_id").cast(kind).alias("new_id"), F.col("earlier_id").cast(kind).alias("earlier_id"),
                         F.round("similarity", 4).alias("similarity"))


def binned(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` with a ``bin``.  Texts go by the smallest id they are a candidate with, so those of a group of similar texts
    mostly go together; a large group is cut, and each two of its parts meet apart."""
    both = pairs.select(F.col("new_cid").alias("cid"), F.col("earlier_cid").alias("other")) \
        .union(pairs.select(F.col("earlier_cid").alias("cid"), F.col("new_cid").alias("other")))
    named = written(both.groupBy("cid").agg(F.least("cid", F.min("other")).alias("group")).join(docs.select("cid", "n"), "cid"), "named")
    sizes = named.groupBy("group").agg(F.ceil(F.count("*") / SIDE).alias("parts"))
    sided = written(named.join(sizes, "group").select("cid", "n", "group", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part")), "sides")
    x, y = (sided.select(F.col("cid").alias(c), F.struct("group", "part").alias(s)) for c, s in (("new_cid", "x"), ("earlier_cid", "y")))
    placed = pairs.join(x, "new_cid").join(y, "earlier_cid").withColumn("place", F.xxhash64(F.least("x", "y"), F.greatest("x", "y")))
    placed = written(placed.select("new_cid", "earlier_cid", "place"), "places")
    chars = placed.select("place", F.explode(F.array("new_cid", "earlier_cid")).alias("cid")).distinct() \
        .join(sided.select("cid", "n"), "cid").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(pairs.sparkSession.sparkContext.defaultParallelism * 8, placed.count() // BIN_PAIRS, chars // BIN_CHARS)
    return placed.select("new_cid", "earlier_cid", F.pmod(F.xxhash64("place"), F.lit(bins)).alias("bin"))


def candidates(docs: DataFrame, t: float) -> DataFrame:
    """``new_cid, earlier_cid`` of all pairs of ``docs`` (``cid, last_seq, n, text``) that may reach the threshold."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for cid, last, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    codes = codes_of(text)
                    k = length_class(len(codes), t)
                    shared, known = {"cid": cid, "last_seq": last, "n": len(codes), "rare": rare_positions(codes), "chars": char_counts(codes)}, {}
                    for level, guest in ((k, False), (k - 1, True)):
                        if level >= 0:
                            q, bits = class_grams(level, t)
                            if q not in known:
                                known[q] = grams(codes, q)
                            out.append(shared | {"level": level, "guest": guest, "bits": gram_bits(known[q], bits)})
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("cid", pa.int64()), ("last_seq", pa.int64()), ("n", pa.int64()), ("rare", pa.int64()), ("chars", pa.binary()),
                        ("level", pa.int32()), ("guest", pa.bool_()), ("bits", pa.binary())])
    marked = written(docs.filter("n > 0").select("cid", "last_seq", "text").mapInArrow(
        marks, "cid long, last_seq long, n long, rare long, chars binary, level int, guest boolean, bits binary"), "marks")

    # a row a class and side: how many tiles it has
    sizes = {(r["level"], r["guest"]): r["rows"] for r in marked.groupBy("level", "guest").agg(F.count("*").alias("rows")).collect()}
    wanted = max(LEAST_TILE, sum(c for (_, guest), c in sizes.items() if not guest) // TILES)

    def tiles(level: int, guest: bool) -> int:
        most = min(TILE_ROWS, wanted, max(1, TILE_BYTES // (class_grams(level, t)[1] // 4)))
        return math.ceil(sizes.get((level, guest), 0) / most)

    counts = F.create_map(*(F.lit(x) for level, _ in sizes for x in (level, tiles(level, False)))) if sizes else F.create_map()
    others = F.create_map(*(F.lit(x) for level, _ in sizes for x in (level, tiles(level, True)))) if sizes else F.create_map()
    home, away = F.coalesce(counts[F.col("level")], F.lit(0)), F.coalesce(others[F.col("level")], F.lit(0))
    tile = F.pmod(F.xxhash64("cid"), F.when(F.col("guest"), away).otherwise(home)).cast("int")

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    # a pair of tiles (i, j) has the rows of i as the first ones and those of j as the others, unless they are the same
    at = F.col("tile")
    meets = F.when(F.col("guest"), F.transform(upto(home), lambda i: F.struct(i.alias("i"), at.alias("j"), F.lit(True).alias("away"), F.lit(False).alias("first")))) \
        .otherwise(F.concat(
            F.transform(upto(home), lambda j: F.struct(F.least(at, j).alias("i"), F.greatest(at, j).alias("j"), F.lit(False).alias("away"), (at <= j).alias("first"))),
            F.transform(upto(away), lambda j: F.struct(at.alias("i"), j.alias("j"), F.lit(True).alias("away"), F.lit(True).alias("first")))))
    dealt = marked.withColumn("tile", tile).withColumn("meet", F.explode(meets)) \
        .select("level", "meet.*", "cid", "last_seq", "n", "rare", "chars", "bits")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))  # two tiles at most
        level, same = rows.column("level")[0].as_py(), not rows.column("away")[0].as_py() and rows.column("i")[0] == rows.column("j")[0]
        q, bits = class_grams(level, t)
        sets = char_sets(np.frombuffer(b"".join(rows.column("chars").to_pylist()), np.int32).reshape(-1, CHARS))
        first, others = rows.filter(rows.column("first")), rows.filter(pc.invert(rows.column("first")))
        if not len(first) or not (same or len(others)):
            return
        x = Tile(first, bits, sets, t)
        for new, earlier in tile_pairs(x, x if same else Tile(others, bits, sets, t), q, t):
            yield pa.RecordBatch.from_arrays([pa.array(new), pa.array(earlier)], ["new_cid", "earlier_cid"])

    tasks = max(docs.sparkSession.sparkContext.defaultParallelism * 3, 64)
    return dealt.repartition(tasks, "level", "away", "i", "j").groupBy("level", "away", "i", "j").applyInArrow(search, "new_cid long, earlier_cid long")


def near_counts(records: DataFrame, edges: DataFrame, seq: str = "seq", segment: int = 4096) -> DataFrame:
    """Near matches of every record: earlier records with a near content.

    Copies are counted with running sums along each edge, never paired.
    """
    folded = records.select("record_id", F.col(seq).cast("long").alias("seq"), F.sha2(fold_for_hash("content"), 256).alias("h"))
    ids = folded.groupBy("h").agg(F.min("seq").alias("cid"))
    r = folded.join(ids, "h").select("record_id", "seq", "cid")
    e = edges.select("new_cid", "earlier_cid")
    asks = e.join(r, e.new_cid == r.cid).select("new_cid", "earlier_cid", "record_id", "seq", F.lit(0).alias("one"))
    gives = e.join(r, e.earlier_cid == r.cid).select("new_cid", "earlier_cid", "record_id", "seq", F.lit(1).alias("one"))
    run = running(asks.unionAll(gives), ["new_cid", "earlier_cid"], ["seq"], F.floor(F.col("seq") / segment),
                  [Running("before", "sum", F.col("one"))])
    return run.filter("one = 0").groupBy("record_id").agg(F.sum("before").alias("near_matches")).filter("near_matches > 0")


def duplicate_of(records: DataFrame, edges: DataFrame, seq: str = "seq") -> DataFrame:
    """Record each duplicate points to: the previous equal copy, else the
    earliest near match.  Only a content's first record lacks an equal copy."""
    from callbrook.operators.ingest import exact_duplicate_chain
    earliest = edges.filter("earlier_cid < new_cid").groupBy("new_id").agg(F.min_by("earlier_id", "earlier_cid").alias("near_of"))
    chain = exact_duplicate_chain(records, [seq]).select("record_id", "exact_of")
    out = chain.join(earliest, chain.record_id == earliest.new_id, "left")
    return out.select("record_id", F.coalesce("exact_of", "near_of").alias("duplicate_of")).filter("duplicate_of IS NOT NULL")


def compare_pairs(pairs: DataFrame, threshold: float = v.NEAR_DUPLICATE_THRESHOLD) -> DataFrame:
    """Similarity and kind for given pairs of texts (columns ``a`` and ``b``);
    ``b`` is the candidate duplicate of ``a``."""

    @F.pandas_udf(T.DoubleType())
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float:
            return (1.0 if x == y else 0.0) if not x or not y else SequenceMatcher(None, x, y).ratio()
        return pd.Series([one(x, y) for x, y in zip(a, b)])

    s = pairs.withColumn("__s", similarity(fold_for_hash("a"), fold_for_hash("b")))
    kind = F.when(F.col("__s") >= 1.0, "exact").when(F.col("__s") >= threshold, "near")
    return s.withColumn("duplicate_type", kind).withColumn("similarity", F.round("__s", 4)).drop("__s")
