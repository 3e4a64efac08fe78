"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callbrook.llm import alignment, annforest, covertree, langid, licenses, linededup, mixing, packing, pii, quality, simhash, urlfilter, warc
from callbrook.llm.common import LOWER, UPPER, documents
from callbrook.plans import tables
from callbrook.session import shared_dir

#: The rules of the URL query.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op1_language_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op2_quality_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(documents(spark, sf_dir), columns=("doc_id",))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return linededup.dedup_lines(docs, sentences=True)[["doc_id", "n_removed", "text"]]


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.neighbours(tables.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_pack_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(documents(spark, sf_dir), with_ids=False)


def op7_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_pii_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op10_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = tables.read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, rules)[["page_id", "host", "path", "rule", "verdict"]]


def op11_cover_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.quantized(tables.spread(tables.read(spark, sf_dir, "embeddings"), "vec_id"))


def op12_align_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(documents(spark, sf_dir))


def op13_warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(tables.read(spark, sf_dir, "pages"), path)
    return warc.pages_of(warc.read_archives(spark, path))


QUERIES = {f.__name__: f for f in (op1_language_bytes, op2_quality_fences, op3_mix_sources, op4_line_windows, op5_prefix_forest, op6_pack_powers,
                                   op7_simhash_vptree, op8_license_diagonals, op9_pii_segments, op10_url_trie, op11_cover_codes, op12_align_spans, op13_warc_ranges)}

_M = quality.MEASURES
_BUCKET = "greatest(length(bin({v})) - 6, 0)"


def _quantile_sql(name: str, keys: str) -> str:
    """Quantiles of the added sketches by ``keys``, as a common table expression."""
    by = f"{keys}, measure" if keys else "measure"
    points = ", ".join(f"min(low) FILTER (WHERE 100 * upto >= {q} * total) AS {c}" for c, q in (("lo", quality.LOW), ("mid", quality.MIDDLE), ("hi", quality.HIGH)))
    return f"""{name} AS (SELECT {by}, max(total) AS n, {points} FROM (
  SELECT {by}, low, sum(sum(c)) OVER (PARTITION BY {by} ORDER BY low) AS upto, sum(sum(c)) OVER (PARTITION BY {by}) AS total
  FROM sketch WHERE low > 0 OR measure NOT IN ({", ".join(f"'{m}'" for m, x in _M.items() if x[2])}) GROUP BY {by}, low) GROUP BY {by})"""


def _quality_sql(enough: int = quality.ENOUGH) -> str:
    width = "(1 << " + _BUCKET.format(v="{v}") + ")"
    most = f"max(hi + greatest(hi - mid, {width.format(v='hi')})) FILTER (WHERE f.measure = '{{m}}')"
    least = f"max(lo - greatest(mid - lo, {width.format(v='lo')})) FILTER (WHERE f.measure = '{{m}}')"
    values = ", ".join(f"CASE WHEN {d} > 0 THEN ({n}) // ({d}) ELSE 0 END AS {m}" for m, (n, d, *_) in _M.items())
    tests = " AND ".join(f"v.{m} <= coalesce({most.format(m=m)}, v.{m})" + (f" AND v.{m} >= coalesce({least.format(m=m)}, v.{m})" if x[3] else "") for m, x in _M.items())
    pick = ", ".join(f"CASE WHEN fine.n >= {enough} THEN fine.{c} WHEN wide.n >= {enough} THEN wide.{c} ELSE whole.{c} END AS {c}" for c in ("lo", "mid", "hi"))
    return f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
grams AS (SELECT doc_id, r.i AS i, r.g AS g FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 6), lambda i: struct_pack(i := i, g := words[i:i + 7]))) AS r FROM w)),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, len(words) AS n_words, length(t) - length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {values} FROM m),
long AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS x FROM v WHERE NOT base_failed" for m in _M)}),
sketch AS (SELECT lang, source, measure, (x >> {_BUCKET.format(v="x")}) << {_BUCKET.format(v="x")} AS low, count(*) AS c FROM long GROUP BY ALL),
{_quantile_sql("fine", "lang, source")}, {_quantile_sql("wide", "lang")}, {_quantile_sql("whole", "")},
f AS (
  SELECT k.lang, k.source, k.measure, {pick}
  FROM (SELECT DISTINCT lang, source, measure FROM long) k
  LEFT JOIN fine ON k.lang IS NOT DISTINCT FROM fine.lang AND k.source IS NOT DISTINCT FROM fine.source AND k.measure = fine.measure
  LEFT JOIN wide ON k.lang IS NOT DISTINCT FROM wide.lang AND k.measure = wide.measure LEFT JOIN whole ON k.measure = whole.measure)
SELECT v.doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed,
  NOT v.base_failed AND coalesce({tests}, false) AS kept
FROM v LEFT JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source
GROUP BY v.doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed, {", ".join("v." + m for m in _M)}"""


def _license_sql() -> str:
    phrases = ", ".join(f"('{p}', '{x}')" for p, x in licenses.PHRASES)
    templates = ", ".join(f"({n}, '{x}', '{t}')" for n, (x, t) in enumerate(licenses.TEMPLATES))
    k = licenses.GRAM
    gram = " || ' ' || ".join(f"words[i + {j}]" for j in range(k))
    return f"""
WITH phrases(phrase, label) AS (VALUES {phrases}), texts(template, label, body) AS (VALUES {templates}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
placed AS (SELECT doc_id, r.i AS i, r.g AS g FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(words) + 1), lambda i: struct_pack(i := i, g := words[i:i + 3]))) AS r FROM w)),
base AS (SELECT doc_id, i - 1 AS place, label FROM placed JOIN phrases ON g[1] = split_part(phrase, ' ', 1)
         WHERE array_to_string(g[1:len(string_split(phrase, ' '))], ' ') = phrase),
based AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS labels FROM base GROUP BY doc_id),
tw AS (SELECT template, label, string_split(body, ' ') AS words FROM texts),
tg AS (SELECT template, label, len(words) - {k - 1} AS grams, i - 1 AS t_place, {gram} AS gram
       FROM (SELECT *, unnest(range(1, len(words) - {k - 2})) AS i FROM tw)),
votes AS (SELECT doc_id, template, label, grams, t_place, i - 1 - t_place AS diagonal FROM placed JOIN tg ON array_to_string(g[1:{k}], ' ') = gram),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {licenses.GAP} THEN 0 ELSE 1 END AS new FROM votes),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM steps),
found AS (SELECT doc_id, label, count(DISTINCT t_place) / grams AS covered FROM runs GROUP BY doc_id, template, label, grams, run
          HAVING count(DISTINCT t_place) / grams >= {licenses.COVER}),
added AS (SELECT doc_id, list(DISTINCT label) AS labels, max(covered) AS covered FROM found GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(based.n, 0) AS n_base, lo AS first_word, hi AS last_word,
  array_to_string(list_sort(coalesce(based.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(based.labels, []) || coalesce(added.labels, []))), ',') AS labels,
  CASE WHEN based.n > 0 THEN 1.0 ELSE coalesce(covered, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN based USING (doc_id) LEFT JOIN added USING (doc_id)"""


def _codes_sql(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds as common table expressions; squared distances without the points' own squares, which change no order."""
    steps = [f"c0 AS (SELECT part, rn - 1 AS e, v FROM p WHERE rn <= {entries})"]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rn, part, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (
  SELECT p.rn, p.part, c.e, list_inner_product(c.v, c.v) - 2 * list_inner_product(p.v, c.v) AS d FROM p JOIN c{r} c USING (part)) GROUP BY rn, part)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
  SELECT part, e, list(x ORDER BY i) AS v FROM (
    SELECT part, e, i, floor(sum(v[i]) / count(*)) AS x FROM (SELECT a.part, a.e, p.v, unnest(range(1, {width + 1})) AS i FROM a{r} a JOIN p USING (rn, part)) GROUP BY part, e, i)
  GROUP BY part, e) m USING (part, e))""")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rn, part, x[part * {width} + 1:part * {width} + {width}] AS v FROM k, range({parts}) t(part)),
{", ".join(steps)},
coded AS (SELECT rn, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(a.d + list_inner_product(p.v, p.v)) AS BIGINT) AS error
          FROM a{rounds} a JOIN p USING (rn, part) GROUP BY rn),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY part, e)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM k JOIN coded USING (rn), digest"""


ORACLE = {
    "op11_cover_codes": _codes_sql(),
    "op2_quality_fences": _quality_sql(),
    "op4_line_windows": """
WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(\\n|[.!?] )', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM documents),
lines AS (SELECT doc_id, r.i AS i, r.t AS t FROM (SELECT doc_id, unnest(list_transform(range(0, len(ps)),
  lambda i: struct_pack(i := i, t := trim(ps[i + 1], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))) AS r FROM p) WHERE r.t <> ''),
wins AS (SELECT doc_id, i AS a, lead(i, 2) OVER d AS b, t AS x, lead(t) OVER d AS y, lead(t, 2) OVER d AS z FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, a) AS nth FROM wins WHERE z IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM ranked WHERE nth > 1),
whole AS (SELECT doc_id, r.i AS i, r.x AS x FROM (SELECT doc_id, unnest(list_transform(range(0, len(ps)), lambda i: struct_pack(i := i, x := ps[i + 1]))) AS r FROM p)),
kept AS (SELECT doc_id, count(gone.i) AS n, coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE gone.i IS NULL), '') AS text
         FROM whole LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE kept.text END AS text FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op8_license_diagonals": _license_sql(),
    "op10_url_trie": f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages)
SELECT p.page_id, p.host, p.path, arg_max(rule_host || rule_path, length(rule_host) + length(rule_path)) AS rule,
       coalesce(arg_max(rule_verdict, length(rule_host) + length(rule_path)), 'allow') AS verdict
FROM (SELECT row_number() OVER () AS n, * FROM parts) p
LEFT JOIN rules ON (p.host = rule_host OR p.host LIKE '%.' || rule_host) AND starts_with(p.path, rule_path)
GROUP BY p.n, p.page_id, p.host, p.path""",
    "op13_warc_ranges": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER w AS nth, first_value(page_id) OVER w AS first_page FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST))
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  list_reduce(list_transform(range(0, 8), lambda k: list_reduce(list_transform([15, 10, 5, 0], lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 5 * k + 1, 5))::INT >> b) % 32 + 1, 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first_page END AS refers_to
FROM r""",
}
