"""Near-duplicates by Jaccard similarity of five-word shingles: SimHash and vantage points first, then complete by prefixes.

A text is its set of distinct shingle hashes; equal sets are collapsed.  Every candidate link is confirmed by the exact similarity of
the whole sets before it counts; pairs whose parity sketches differ too much for the similarity go before that.  Candidates come in two steps:

* SimHash fingerprints of the sets, searched by the vantage-point tree of ``simhash``; this joins most near copies cheaply.
* SimHash alone misses pairs at a similarity of 0.8, so a complete search follows.  All shingles have one order, rare ones first.  Of
  two sets that reach ``similarity`` each must hold a common shingle among its first ``n - ceil(similarity * n) + 1`` ones, so sets meet
  only under these, by length and place there.  Under each shingle the sets first meet a chosen centre, which joins large groups with
  as many pairs as rows; then sets whose components still differ meet each other, so that the components are those of all pairs.

The order uses estimated counts of the most frequent shingles.  Any order gives the same components; a good one makes few pairs.

Defined results: words are parted by ASCII white space and ASCII case is ignored; fewer words than a shingle form one shingle; null
and blank texts have the empty set and are copies of one another; of repeated rows (same id and text) any one stays; an empty table
gives an empty table; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbrook.llm import simhash
from callbrook.operators.components import connected_components
from callbrook.session import temporary, written

SHINGLE, SIMILARITY, CENTRES, SEED, RADIUS = 5, 0.8, 1, 42, 2
#: A task counts so many shingles at a time and reports the most frequent ones; so many of all are put last in the order.
COUNTED, REPORTED, FREQUENT = 1 << 22, 1 << 16, 1 << 18
#: Tables of up to so many keys are sent to the tasks, larger ones are joined by a shuffle.
SENT = 1 << 21
#: So many texts meet another one at a place, and about so many pairs are a group of a task.
PLACE = 64
#: Size of the sketch that tells sets far apart before their texts move.
BITS = 1024


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, ascending."""
    import xxhash
    w = text.lower().split()  # on bytes both touch ASCII only
    if not w:
        return np.zeros(0, np.int64)
    joined = b" ".join(w)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    last = min(shingle, len(w)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip((ends - lengths)[: len(w) - last].tolist(), ends[last:].tolist(), strict=True)
    h = np.sort(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64).view(np.int64))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def first_hashes(n: int, similarity: float) -> int:
    """How many of ``n`` ordered hashes must hold one that any set of this similarity has among its own first ones."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def may_reach(n, i, m, j, similarity: float):
    """Whether sets of ``n`` and ``m`` hashes whose first common one is at ``i`` and ``j`` can reach the similarity."""
    need = similarity * (n + m) - 1e-6
    return ((1 + similarity) * (n - i) >= need) & ((1 + similarity) * (m - j) >= need)  # of columns and arrays alike


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set: a bit is set if it is in over half of the hashes."""
    bits = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(s), bitorder="little").view("<i8")[0])


def parities(s: np.ndarray) -> np.ndarray:
    """For each value of the hashes' last bits whether an odd number has it, 64 to a word.  Two sets' words differ in no more bits than
    the sets differ in hashes."""
    return np.packbits(np.bincount(s & (BITS - 1), minlength=BITS) & 1 == 1, bitorder="little").view("<i8")


def _sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    return [shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in column]


def frequent_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent hashes, ascending, with the binary order of magnitude of their estimated counts; a bounded list."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def report():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            top = np.flatnonzero(c >= 4)
            if len(top) > REPORTED:
                top = top[np.argpartition(c[top], -REPORTED)[-REPORTED:]]
            return pa.RecordBatch.from_arrays([pa.array(h[top]), pa.array(c[top])], ["h", "c"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held += _sets(batch.column(0).slice(at, 256), shingle)
                n = n + sum(map(len, held[-min(256, batch.num_rows - at):]))
                if n >= COUNTED:
                    yield report()
                    held, n = [], 0
        if held:
            yield report()

    top = texts.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")) \
        .orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()  # at most FREQUENT rows
    h, c = top["h"].to_numpy(), top["c"].to_numpy()
    order = np.argsort(h)
    return h[order], np.ceil(np.log2(np.maximum(c[order], 1))).astype(np.int8)


def marks(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``doc_id, key, digest, n, fp, bits, first`` of rows ``doc_id, key, text``: a digest of the whole set, its size, sketches and first hashes."""
    known = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs.select("text"), shingle))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        h, level = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets, first = _sets(part.column(2), shingle), []
                for s in sets:
                    place = np.minimum(np.searchsorted(h, s), max(0, len(h) - 1))
                    late = np.where(h[place] == s, level[place], 0) if len(h) else np.zeros(len(s), np.int8)
                    first.append(s[np.argsort(late, kind="stable")[: first_hashes(len(s), similarity)]])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int32()), pa.array([fingerprint(s) if len(s) else 0 for s in sets], pa.int64()),
                     pa.array([parities(s) for s in sets], pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))],
                    ["doc_id", "key", "digest", "n", "fp", "bits", "first"])

    return docs.mapInArrow(mark, "doc_id long, key string, digest binary, n int, fp long, bits array<long>, first array<long>")


def _join(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """A join with a written table, which is sent to the tasks when it is small."""
    return df.join(F.broadcast(keys) if keys.count() <= SENT else keys, on, how)


def _unrepeated(df: DataFrame, repeated: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """One row by these columns; only keys that are repeated in the table meet in a shuffle, after a partial aggregation."""
    if not repeated.count():
        return df
    return _join(df, repeated, "key", "left_anti").unionByName(_join(df, repeated, "key", "left_semi").dropDuplicates([*by]))


def not_far(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` without those whose sketches ``row, n, bits`` already differ more than sets of the similarity can."""
    a, b = (sketches.select(F.col("row").alias(c), F.col("n").alias("n" + c), F.col("bits").alias("bits" + c)) for c in "ab")
    differ = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, k: total + k)
    most = (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-6
    return pairs.distinct().join(a, "a").join(b, "b").filter(differ <= most).select("a", "b")


def confirmed(pairs: DataFrame, texts, similarity: float, shingle: int) -> DataFrame:
    """The distinct pairs ``a, b`` whose whole sets reach the similarity.  Rows come to ``a`` at places of about ``PLACE`` rows, and bins of
    places are tasks' groups: what moves is the text of each row of a place, and its set is made there.  ``texts`` gives
    ``a, part, row, text`` of places ``a, part, row``."""
    def confirm(rows: pa.Table) -> pa.Table:
        column = rows["text"].combine_chunks()
        sets = [s for at in range(0, len(column), 256) for s in _sets(column.slice(at, 256), shingle)]
        a, part, row = (rows[c].to_numpy() for c in ("a", "part", "row"))
        centre = {(x, p): s for x, p, r, s in zip(a.tolist(), part.tolist(), row.tolist(), sets, strict=True) if x == r}
        linked = np.zeros(len(row), bool)
        for k in np.flatnonzero(a != row):
            x, y = sets[k], centre[int(a[k]), int(part[k])]
            c = len(np.intersect1d(x, y, assume_unique=True))
            linked[k] = c / (len(x) + len(y) - c) >= similarity
        return pa.table({"a": a[linked], "b": row[linked]})

    with temporary():
        pairs = written(pairs, "candidates")
        degrees = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")), "degrees")
        part = F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / PLACE)).alias("part")
        met = written(_join(pairs, degrees, "a", "inner").select("a", part, F.col("b").alias("row")), "met")
        found = texts(written(met.unionByName(met.select("a", "part", F.col("a").alias("row")).distinct()), "places"))
        bins = F.pmod(F.xxhash64("a", "part"), F.lit(pairs.count() // PLACE + 1)).alias("bin")
        return written(found.groupBy(bins).applyInArrow(confirm, "a long, b long"), "links", keep=True)


def _with_components(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Rows under shingles whose rows are not yet all of one component."""
    joined = written(connected_components(links).filter("node <> component"), "components")
    placed = shared.join(joined, shared["row"] == joined["node"], "left").withColumn("component", F.coalesce("component", "row")).drop("node")
    several = written(placed.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("h"), "open")
    return written(_join(placed, several, "h", "left_semi"), "placed")


def set_links(sets: DataFrame, confirm, similarity: float, centres: int = CENTRES) -> DataFrame:
    """``a, b``: confirmed links that connect the sets ``row, n, fp, bits, first`` as all pairs that reach the similarity would.
    ``confirm`` gives those of distinct pairs ``a, b`` that reach it; many of the pairs of a group share their ``a``."""
    at = sets.select("row", "n", F.posexplode("first").alias("at", "h"))
    # size and place in one number: under a shingle of two sets the least and the largest are both of them, and tell if they may be a pair
    both = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    counts = at.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(both).alias("x"), F.max(both).alias("y"))
    n, i, m, j = (f(F.col(c)) for c in "xy" for f in (lambda p: F.shiftright(p, 32), lambda p: p.bitwiseAND(F.lit(0xFFFFFFFF))))
    twice = written(counts.filter((F.col("c") > 2) | (F.col("c") == 2) & may_reach(n, i, m, j, similarity)).select("h"), "twice")
    shared = written(_join(at, twice, "h", "left_semi"), "shared")
    rows = written(shared.groupBy("row").agg(F.first("n").alias("n")).select("row"), "rows")

    fps = written(_join(sets.select("row", "n", "fp", "bits"), rows, "row", "left_semi"), "fingerprints")

    def linked(pairs: DataFrame) -> DataFrame:
        return confirm(not_far(pairs, fps, similarity))

    named = written(fps.groupBy("fp").agg(F.min("row").alias("row")), "named")
    near = simhash.links(named.select("fp"), RADIUS)
    a, b = (named.select(F.col("fp").alias(x), F.col("row").alias(y)) for x, y in (("a", "x"), ("b", "y")))
    met = near.join(a, "a").join(b, "b").select(F.col("y").alias("a"), F.col("x").alias("b"))  # several meet the second
    same = fps.select("row", "fp").join(named.withColumnRenamed("row", "a"), "fp").filter("row <> a").select("a", F.col("row").alias("b"))
    links = linked(met.unionByName(same).select("a", "b"))

    for k in range(centres):
        with temporary():
            placed = _with_components(shared, links)
            centre = written(placed.groupBy("h").agg(F.min(F.struct(F.xxhash64("component", F.lit(k)).alias("order"), "row", "n", "at", "component")).alias("c")), "centres")
            met = placed.join(centre, "h").filter((F.col("component") != F.col("c.component"))
                                                  & may_reach(F.col("n"), F.col("at"), F.col("c.n"), F.col("c.at"), similarity))
            found = linked(met.select(F.col("c.row").alias("a"), F.col("row").alias("b")))
            links = written(links.unionByName(found), "links", keep=True)
    with temporary():
        placed = _with_components(shared, links)
        x, y = (placed.select("h", *[F.col(c).alias(c + side) for c in ("row", "n", "at", "component")]) for side in "xy")
        across = x.join(y, "h").filter((F.col("componentx") < F.col("componenty")) & may_reach(F.col("nx"), F.col("atx"), F.col("ny"), F.col("aty"), similarity))
        found = linked(across.select(F.col("rowx").alias("a"), F.col("rowy").alias("b")))
        return written(links.unionByName(found), "links", keep=True)


def row_key(doc_id: Column, text: Column) -> Column:
    """A digest of a row's id and text; nulls differ from every value."""
    return F.md5(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(F.md5(text.cast("string")), F.lit("-"))))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each component of near-duplicates: the smallest id, null last."""
    key = row_key(F.col(id_col), F.col(text))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text).cast("string").alias("text"))
    with temporary():
        tagged = written(marks(plain, shingle, similarity).withColumn("row", F.monotonically_increasing_id()), "marks")
        repeated = written(tagged.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "repeated", keep=True)
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
        least = written(tagged.groupBy("digest").agg(F.min(order).alias("least")).select("least", F.col("least.row").alias("row")), "distinct")
        firsts = _join(tagged, least.select("row"), "row", "left_semi")

        def texts(places: DataFrame) -> DataFrame:
            wanted = written(_join(tagged.select("row", "key"), places, "row", "inner"), "wanted")
            found = _join(plain.select("key", "text"), wanted, "key", "inner")
            return _unrepeated(found, repeated, ("key", "a", "part")).select("a", "part", "row", "text")

        links = set_links(firsts.select("row", "n", "fp", "bits", "first"), lambda pairs: confirmed(pairs, texts, similarity, shingle), similarity)
        best = least.join(connected_components(links), F.col("row") == F.col("node"), "left") \
            .groupBy(F.coalesce("component", "row").alias("component")).agg(F.min("least").alias("k")).select("k.row")
        stays = tagged.select("row", "key").join(best, "row", "left_semi").select("key").distinct()
        gone = written(tagged.select("key").distinct().join(stays, "key", "left_anti"), "gone", keep=True)
    name = "__key"
    kept = _join(docs.withColumn(name, key), gone.withColumnRenamed("key", name), name, "left_anti")
    if not repeated.count():
        return kept.drop(name)
    again = repeated.withColumnRenamed("key", name)
    return _join(kept, again, name, "left_anti").unionByName(_join(kept, again, name, "left_semi").dropDuplicates([name])).drop(name)
