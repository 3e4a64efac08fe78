"""Costly parts of an expression are named once, whatever the number of words or passes."""

from callbrook.functions import quality as q
from callbrook.operators import evaluation as ev


def _plan(spark, value):
    df = spark.createDataFrame([("a b", "a c")], "r string, h string").select(value)
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_pair_are_split_once(spark):
    assert _plan(spark, ev.word_error_rate("r", "h")).count("split(") <= 4  # it was 34


def test_a_text_is_replaced_once_a_pass(spark):
    assert _plan(spark, q.term_replacements("r")).count("regexp_replace(") <= 2  # it was 342


def test_special_letters_and_forms_that_hold_aliases(spark):
    texts = ["SME LOAN and ſme loan", "qualification criteria, requirements", "nothing", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(q.replaced_terms("t").alias("x")).collect()
    for text, r in zip(texts, rows):
        want, hits = text, []
        import re
        for alias, form in q.alias_pairs():
            hits += [(m, form) for m in re.findall(re.escape(alias), want or "", re.I)]
            want = want and re.sub(re.escape(alias), form, want, flags=re.I)
        assert (r.x.text, [tuple(h) for h in r.x.replaced]) == (want, hits)
