"""Offline scoring jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions.text import col, contains_any, let, words
from callbrook.operators.calls import exact_percentiles


def word_error_rate(reference: Column | str, hypothesis: Column | str) -> Column:
    """Word-level edit distance over reference words, rounded to four places.

    Every distinct word of the pair becomes one code point (surrogates skipped),
    so the built-in ``levenshtein`` works on words.  UTF-32 leaves room for a
    million distinct words in one pair.
    """
    def rate(p: Column) -> Column:
        def coded(w: Column) -> Column:
            def point(x: Column) -> Column:
                n = F.array_position(p["all"], x) + 255
                n = F.when(n >= 0xD800, n + 0x800).otherwise(n)
                return F.lpad(F.hex(n), 8, "0")
            return F.decode(F.unhex(F.array_join(F.transform(w, point), "")), "UTF-32")

        n = F.size(p["r"])
        return F.when(n == 0, F.when(F.size(p["h"]) == 0, 0.0).otherwise(1.0)).when(p["r"] == p["h"], 0.0) \
            .otherwise(F.round(F.levenshtein(coded(p["r"]), coded(p["h"])).cast("double") / n, 4))

    def with_vocabulary(p: Column) -> Column:
        return let(F.struct(p["r"].alias("r"), p["h"].alias("h"), F.array_distinct(F.concat(p["r"], p["h"])).alias("all")), rate)

    # words and vocabulary are bound: named inside the lambda they would be split again for every word
    split = F.struct(words(F.lower(col(reference))).alias("r"), words(F.lower(col(hypothesis))).alias("h"))
    missing = col(reference).isNull() | col(hypothesis).isNull()
    return F.when(missing, F.lit(None)).when(col(reference) == col(hypothesis), 0.0).otherwise(let(split, with_vocabulary))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def confusion_metrics(cases: DataFrame, expected: str, predicted: str) -> DataFrame:
    """One row: the four counts and precision, recall, false-positive rate, F1."""
    e, p = F.col(expected), F.col(predicted)
    n = cases.agg(F.count("*").alias("total_cases"), F.count_if(e & p).alias("tp"), F.count_if(~e & ~p).alias("tn"),
                  F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return n.select("*", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
                    F.round(_ratio(fp, fp + tn), 4).alias("false_positive_rate"),
                    F.round(F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0), 4).alias("f1_score"))


def failures(cases: DataFrame, expected: str, predicted: str) -> DataFrame:
    wrong = F.col(expected) != F.col(predicted)
    return cases.filter(wrong).withColumn("verdict", F.when(F.col(predicted), "FP").otherwise("FN"))


def retrieval_verdicts(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Cases (query_id, should_answer, expected_source, keywords) against the
    answers, which carry the best match of each query."""
    j = cases.join(answers, "query_id")
    body = F.lower(F.coalesce("top_content", F.lit("")))
    source = F.col("expected_source").isNull() | F.coalesce("top_source_name", F.lit("")).contains(F.col("expected_source")) \
        | F.coalesce("top_title", F.lit("")).contains(F.col("expected_source"))
    keyword = (F.size("keywords") == 0) | F.exists("keywords", lambda k: body.contains(F.lower(k)))
    abstained = ~F.col("grounded") & F.col("answer").contains("don't have verified information")
    good = F.when(~F.col("should_answer"), abstained).otherwise(F.col("grounded") & (source | keyword))
    return j.withColumn("correct", F.coalesce(good, F.lit(False)))


def retrieval_summary(verdicts: DataFrame, latency: str) -> DataFrame:
    """Accuracy, median and 95th percentile (exclusive method; the maximum
    below twenty cases)."""
    one = verdicts.withColumn("__all", F.lit(1))
    mid = exact_percentiles(one, ["__all"], latency, {"p50": 0.5})
    high = exact_percentiles(one, ["__all"], latency, {"p95": 0.95}, exclusive=True)
    n = one.groupBy("__all").agg(F.count("*").alias("total_queries"), F.count_if("correct").alias("correct"), F.max(latency).alias("worst"))
    return n.join(mid, "__all").join(high, "__all").select(
        "total_queries", "correct", F.round(F.col("correct") / F.greatest(F.lit(1), F.col("total_queries")), 4).alias("accuracy"),
        F.round("p50", 2).alias("latency_p50_ms"),
        F.round(F.when(F.col("total_queries") >= 20, F.col("p95")).otherwise(F.col("worst")), 2).alias("latency_p95_ms"))


def wer_summary(pairs: DataFrame) -> DataFrame:
    scored = pairs.withColumn("wer", F.when(F.col("hypothesis").isNotNull(), word_error_rate("reference", "hypothesis")))
    return scored.groupBy("market").agg(F.count("*").alias("total_test_cases"), F.count("wer").alias("executed_cases"),
                                        F.round(F.avg("wer"), 4).alias("average_wer"))


def terms_preserved(terms: Column | str, hypothesis: Column | str) -> Column:
    """Every term occurs in the hypothesis, with or without its spaces."""
    h = F.lower(col(hypothesis))
    return F.forall(col(terms), lambda t: h.contains(F.lower(t)) | h.contains(F.lower(F.replace(t, F.lit(" "), F.lit("")))))


def keyword_similarity(query: Column | str, document: Column | str) -> Column:
    q, d = F.lower(col(query)), F.lower(col(document))
    qw, dw = F.array_distinct(words(q)), F.array_distinct(words(d))
    overlap = F.size(F.array_intersect(qw, dw)).cast("double") / F.greatest(F.size(qw), F.lit(1))
    boost = F.when(contains_any(q, v.FINANCE_TERMS) & contains_any(d, v.FINANCE_TERMS), 0.45).otherwise(0.0)
    return F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.12), overlap * 0.5 + boost)), 4)


def compare_models(results: DataFrame, score: str, baseline: str, threshold: float = v.COMPARISON_THRESHOLD) -> DataFrame:
    grounded = F.col(score) >= threshold
    return results.withColumn("candidate_grounded", grounded) \
        .withColumn("verdict", F.when(grounded == F.col(baseline), "PASS").otherwise("FAIL"))
