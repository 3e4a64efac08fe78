"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Each document gets integer measures.  Documents that pass the base rules feed one sketch per language, source and measure: counts
per bucket, where buckets are exact up to 32 and keep five leading bits beyond (about 3 % relative error).  Sketches of one key
merge by adding counts, so partial sketches are combined before any shuffle, a source's sketches add up to its language's, and
these to the whole corpus's; a key with fewer than ``enough`` documents uses the next wider sketch.  Shares that are mostly zero are
judged among the documents where they are not.  A fence lies beyond an outer quantile of its key, as far from it as that is from the
median, and at least by the sketch's resolution there; a document is kept if every measure lies inside its key's fences.  No threshold
is a constant of its own: all follow the documents of the key.

Defined results: a null or blank text has no words and fails the base rules; null languages and sources are keys of their own;
repeated rows are measured alike; an empty table gives an empty table.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbrook.llm.common import let, without, words
from callbrook.session import written

SYMBOLS, WINDOW = "#*$%&|<>", 8
#: measure: (numerator, denominator, whether zeros are left out of its quantiles, whether it has a lower fence too)
MEASURES = {
    "symbols": ("1000 * n_symbols", "n_words", True, False),
    "dup_lines": ("1000 * n_dup_lines", "n_lines", True, False),
    "repeats": ("1000 * n_repeat_words", "n_words", True, False),
    "word_length": ("100 * word_chars", "n_words", False, True),
}
#: Thousandths of words, lines and words, and hundredths of code points.
#: Quantiles in hundredths, and the documents a key needs for its own fences.
LOW, MIDDLE, HIGH, ENOUGH = 5, 50, 95, 200


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur at least twice in the array, each counted once."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda o: F.filter(o, lambda s, i: F.coalesce(F.get(o, i - 1)["h"] == s["h"], F.lit(False))
                                                | F.coalesce(F.get(o, i + 1)["h"] == s["h"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda s: s["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")),
                           lambda a: a["n"])

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(w) >= window, counted).otherwise(0).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts of every whole text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blanks = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(blanks)) != "")
    parts = docs.withColumns({
        "__w": words(F.col(text)), "__t": t,
        "__lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))})
    out = parts.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(without(F.col("__t"), blanks)).cast("long"),
        "n_symbols": (F.length("__t") - F.length(without(F.col("__t"), SYMBOLS))).cast("long"),
        "n_lines": F.col("__lines.n").cast("long"), "n_dup_lines": F.col("__lines.dup").cast("long"),
        "n_repeat_words": repeated_words(F.col("__w"))}).drop("__w", "__t", "__lines")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def bucket(v: Column) -> Column:
    """Sketch bucket of a whole number: itself below 32, else its bit length and the five bits below the leading one."""
    cut = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.struct(cut.cast("int").alias("cut"), (F.floor(v / F.pow(F.lit(2.0), cut))).cast("long").alias("top"))


def _values() -> list[Column]:
    return [F.when(F.expr(f"{d} > 0"), F.expr(f"({n}) div ({d})")).otherwise(0).alias(m) for m, (n, d, *_) in MEASURES.items()]


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, measure, cut, top, n``: the additive sketches of the documents that pass the base rules."""
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", *_values())
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("b")) for m in MEASURES)))
    return rows.select("lang", "source", each.alias("x")) \
        .groupBy("lang", "source", F.col("x.measure").alias("measure"), F.col("x.b.cut").alias("cut"), F.col("x.b.top").alias("top")) \
        .agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, measure, n, low, middle, high`` from sketches added up by ``keys``; a key's sketch has a bounded number of buckets."""
    by = ", ".join([*keys, "measure"])
    merged = sketch.groupBy(*keys, "measure", "cut", "top").agg(F.sum("n").alias("n"))
    bottom = "top * cast(pow(2, cut) as bigint)"
    return merged.withColumns({"at": F.expr(f"sum(n) over (partition by {by} order by cut, top)"),
                               "total": F.expr(f"sum(n) over (partition by {by})")}) \
        .groupBy(*keys, "measure").agg(F.max("total").alias("n"), *[
            F.expr(f"min({bottom}) filter (where 100 * at >= {q} * total)").alias(name) for name, q in (("low", LOW), ("middle", MIDDLE), ("high", HIGH))])


def resolution(v: Column) -> Column:
    """Width of the bucket that begins at ``v``."""
    return F.pow(F.lit(2.0), F.greatest(F.length(F.bin(v)) - 6, F.lit(0))).cast("long")


def fences(sketch: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """``lang, source`` and, for each measure, the bounds that hold for that key; null where no document of the corpus tells."""
    zeros_out = [m for m, (_, _, positive, _) in MEASURES.items() if positive]
    counted = sketch.filter(~F.col("measure").isin(zeros_out) | (F.col("top") > 0))
    fine, by_lang, whole = (quantiles(counted, keys) for keys in (["lang", "source"], ["lang"], []))
    keys = sketch.select("lang", "source").distinct().select("lang", "source", F.explode(F.array(*map(F.lit, MEASURES))).alias("measure"))
    f, w, t = (q.select(*[F.col(c).alias(f"{side}_{c}") for c in q.columns]) for q, side in ((fine, "f"), (by_lang, "w"), (whole, "t")))
    j = keys.join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")) & (F.col("measure") == F.col("f_measure")), "left") \
        .join(w, F.col("lang").eqNullSafe(F.col("w_lang")) & (F.col("measure") == F.col("w_measure")), "left") \
        .join(F.broadcast(t), F.col("measure") == F.col("t_measure"), "left")  # one row per measure
    low, middle, high = (F.when(F.col("f_n") >= enough, F.col(f"f_{c}")).when(F.col("w_n") >= enough, F.col(f"w_{c}")).otherwise(F.col(f"t_{c}")) for c in ("low", "middle", "high"))
    bounds = []
    for m, (_, _, _, lower) in MEASURES.items():
        mine = F.col("measure") == m
        bounds.append(F.max(F.when(mine, high + F.greatest(high - middle, resolution(high)))).alias(f"{m}_most"))
        if lower:
            bounds.append(F.max(F.when(mine, low - F.greatest(middle - low, resolution(low)))).alias(f"{m}_least"))
    return j.groupBy("lang", "source").agg(*bounds)


def judge(docs: DataFrame, enough: int = ENOUGH, text: str = "text", lang: str = "lang", source: str = "source",
          columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts, ``base_failed`` and ``kept`` of every document, with the named input columns first."""
    base = docs.select(*(F.col(c).alias(f"in_{k}") for k, c in enumerate(columns)), F.col(lang).alias("lang"), F.col(source).alias("source"),
                       F.col(text).alias("__text"))
    measured = written(measure(base, "__text").drop("__text"), "measured")
    bounds = fences(written(sketches(measured), "sketches"), enough).select(F.col("lang").alias("__l"), F.col("source").alias("__s"), "*").drop("lang", "source")
    inside = F.lit(True)
    for m, v in zip(MEASURES, _values(), strict=True):
        inside = inside & (v <= F.coalesce(F.col(f"{m}_most"), v))
        if MEASURES[m][3]:
            inside = inside & (v >= F.coalesce(F.col(f"{m}_least"), v))
    joined = measured.join(bounds, F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")), "left")
    return joined.select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(columns)), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
