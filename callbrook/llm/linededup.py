"""Line de-duplication by overlapping three-line windows.

A line ends at a line feed and, with ``sentences``, after ``. ``, ``! `` or ``? ``, as web texts often hold a paragraph in one physical
line.  Three consecutive lines that are not blank form a window, whatever their length; windows are the same if two independent
64-bit hashes of their lines without surrounding white space are.  A window that occurs more than once keeps its first occurrence, by
id and place; the lines of all later ones go, overlapping windows being merged to one stretch.  What stays is byte for byte as before.

Defined results: a null text stays null and has no lines; texts of fewer than three lines stay whole; rows alike in id and text count
as one document and share its result; null ids come first; an empty table stays empty; other columns are kept untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbrook.llm.common import let
from callbrook.session import written

LINE_END, SENTENCE_END = "(?<=\\n)", "(?<=\\n|[.!?] )"
BLANKS = " \t\n\x0b\x0c\r"


def pieces(text: Column, sentences: bool) -> Column:
    """The lines with what ends them; joined they give the text again."""
    return F.split(text, SENTENCE_END if sentences else LINE_END)


def _lines(text: Column, sentences: bool) -> Column:
    trimmed = F.transform(pieces(text, sentences), lambda x, i: F.struct(F.btrim(x, F.lit(BLANKS)).alias("t"), i.alias("i")))
    # a leading argument seeds the second hash differently
    return F.transform(F.filter(trimmed, lambda x: x["t"] != ""),
                       lambda x: F.struct(F.xxhash64(x["t"]).alias("h"), F.xxhash64(F.lit(1), x["t"]).alias("g"), x["i"].alias("i")))


def windows(docs: DataFrame, text: str, id_col: str, sentences: bool) -> DataFrame:
    """``id, content, w, v, a, b``: each window's two hashes with its first and last piece."""
    def each(lines: Column) -> Column:
        def window(j: Column) -> Column:
            one, two, three = (F.get(lines, j + k) for k in range(3))
            return F.struct(F.xxhash64(one["h"], two["h"], three["h"]).alias("w"), F.xxhash64(F.lit(1), one["g"], two["g"], three["g"]).alias("v"),
                            one["i"].alias("a"), three["i"].alias("b"))
        return F.when(F.size(lines) >= 3, F.transform(F.sequence(F.lit(0), F.size(lines) - 3), window))
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), F.explode_outer(let(_lines(F.col(text), sentences), each)).alias("x"))
    return found.filter(F.col("x").isNotNull()).select("id", "content", "x.w", "x.v", "x.a", "x.b")


def stretches(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sentences: bool = False) -> DataFrame:
    """``id, content, gone``: for each document that loses lines the sorted stretches ``(a, b)`` of pieces to remove."""
    all_windows = written(windows(docs, text, id_col, sentences), "windows")
    place = F.struct("id", "content", "a")
    # written, so that both joins read plain shuffles, whose hot hashes Spark can split
    twice = written(all_windows.groupBy("w", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w", "v"), "twice")
    repeated = written(all_windows.join(twice, ["w", "v"], "left_semi"), "repeated")
    first = written(repeated.groupBy("w", "v").agg(F.min(place).alias("first")), "first")
    later = repeated.join(first, ["w", "v"]).filter(place > F.col("first")).select("id", "content", "a", "b").distinct()
    by = "partition by id, content order by a, b"
    runs = later.withColumn("new", F.expr(f"coalesce(a > max(b) over ({by} rows between unbounded preceding and 1 preceding), true)")) \
        .withColumn("run", F.expr(f"count_if(new) over ({by} rows unbounded preceding)"))
    merged = runs.groupBy("id", "content", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("id", "content").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("gone"))


def _kept(text: Column, gone: Column, sentences: bool) -> Column:
    def rest(x: Column) -> Column:
        p, g = x["p"], x["g"]
        between = F.transform(F.sequence(F.lit(0), F.size(g)), lambda k: let(
            F.struct(F.coalesce(F.get(g, k - 1)["b"] + 1, F.lit(0)).alias("s"), F.coalesce(F.get(g, k)["a"], F.size(p)).alias("e")),
            lambda r: F.slice(p, r["s"] + 1, r["e"] - r["s"])))
        return F.array_join(F.flatten(between), "")
    return let(F.struct(pieces(text, sentences).alias("p"), gone.alias("g")), rest)


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sentences: bool = False, added: bool = True) -> DataFrame:
    """The documents with repeated stretches removed; ``added`` puts ``n_removed``, the pieces removed, last."""
    gone = stretches(docs, text, id_col, sentences).select(F.col("id").alias("__id"), F.col("content").alias("__content"), F.col("gone").alias("__gone"))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__content")), "left")
    kept = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(_kept(F.col(text), F.col("__gone"), sentences))
    out = [kept.alias(c) if c == text else F.col(c) for c in docs.columns if not added or c.lower() != "n_removed"]
    n = F.coalesce(F.aggregate("__gone", F.lit(0), lambda s, g: s + g["b"] - g["a"] + 1), F.lit(0)).cast("long")
    return joined.select(*out, *[n.alias("n_removed")] * added)
