"""Rows that every operator must take: nulls, blanks, long texts, repeats, ties and columns with clashing names."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, copies long, n_removed string, n_words string, "
          "row string, fp string, id string, content string, rank string, doc string, w string, n string, kept string, label string")
LINE = "A line of seven quite common words. "


def rows(more=()):
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (None, "No id here, yet words."), (None, None),
             (6, "Same text twice."), (6, "Same text twice."), (7, "word " * 60000), (8, "\n".join([LINE.strip()] * 40)), (9, LINE * 12), (10, LINE * 12),
             (11, "123 456 !!!"), (12, "É" * 30 + " ß\x0bü\x0cö"), *more]
    langs, sources = ("en", None, "de"), ("s1", "s2", None)
    return [(i, t, langs[k % 3], sources[k % 3], None, 7, 7, *["x"] * 12) for k, (i, t) in enumerate(texts)]


def frame(spark, more=()):
    return spark.createDataFrame(rows(more), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
