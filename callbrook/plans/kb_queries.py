"""Registered ingestion, quality and duplicate queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions import quality as q
from callbrook.functions.text import content_hash, record_hash, strip
from callbrook.operators import conflicts as cf
from callbrook.operators import ingest as g
from callbrook.operators.neardup import duplicate_of, near_contents
from callbrook.plans.tables import read, sql_list, sql_str, sql_strip
from callbrook.session import shared_dir, written
from callbrook.sources import files
from callbrook.sources.html import html_elements

# --- views -------------------------------------------------------------------


def line_elements(spark, sf):
    """Lines of every document as elements; page, section and type follow from
    the line's place so that all rules meet data."""
    e = g.text_elements(read(spark, sf, "documents"), "doc_id", "text", "\n")
    word = F.element_at(F.split("text", " "), 1)
    return e.select(
        "source_id", "ord", "text",
        F.when(F.col("ord") % 11 == 10, "footer").when(F.col("ord") % 13 == 12, "navigation")
        .otherwise(F.col("element_type")).alias("element_type"),
        F.when(F.col("ord") % 4 == 1, word).alias("section"),
        F.floor(F.col("ord") / 3).alias("page_number"),
    )


SQL_LINES = f"""
parts AS (
  SELECT doc_id AS source_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: {sql_strip('p')}),
    lambda p: p <> '') AS p FROM documents),
lines AS (
  SELECT source_id, ord - 1 AS ord, text FROM (SELECT source_id, unnest(range(1, len(p) + 1)) AS ord, unnest(p) AS text FROM parts)),
elements AS (
  SELECT source_id, ord, text,
    CASE WHEN ord % 11 = 10 THEN 'footer' WHEN ord % 13 = 12 THEN 'navigation'
      WHEN starts_with(text, '#') THEN 'heading' ELSE 'paragraph' END AS element_type,
    CASE WHEN ord % 4 = 1 THEN split_part(text, ' ', 1) END AS section, ord // 3 AS page_number
  FROM lines)"""

_NAV = "|".join(f"(?:{p})" for p in v.NAVIGATION_PATTERNS)
_FOOT = "|".join(f"(?:{p})" for p in v.FOOTER_PATTERNS)


def sql_tidy(t: str) -> str:
    lines = f"string_split(regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"
    joined = f"array_to_string(list_transform({lines}, lambda l: {sql_strip('l')}), chr(10))"
    return sql_strip(joined)


SQL_CLEAN = f"""
flagged AS (
  SELECT *, CASE WHEN element_type = 'navigation' THEN 'navigation_element'
      WHEN element_type IN ('footer', 'header') AND (length({sql_strip('text')}) < 3
        OR regexp_matches({sql_strip('text')}, '(?i){_FOOT}')) THEN 'header_footer'
      WHEN regexp_matches({sql_strip('text')}, '(?i){_NAV}') THEN 'navigation_content'
      WHEN length({sql_strip('text')}) < 3 AND element_type = 'paragraph' THEN 'short_fragment' END AS removal_reason
  FROM elements),
cleaned AS (
  SELECT *, CASE WHEN removal_reason IS NULL THEN
    regexp_replace({sql_tidy('text')}, '(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{4}})', '\\1-\\2-\\3', 'g') END AS clean_text FROM flagged),
kept AS (SELECT * FROM cleaned WHERE removal_reason IS NULL)"""

SQL_SECTIONS = """
ffill AS (SELECT *, last_value(nullif(section, '') IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS name FROM kept),
marked AS (SELECT *, CASE WHEN name IS NOT NULL AND name IS DISTINCT FROM lag(name) OVER (PARTITION BY source_id ORDER BY ord)
    THEN 1 ELSE 0 END AS is_new FROM ffill),
grouped AS (SELECT *, sum(is_new) OVER (PARTITION BY source_id ORDER BY ord) AS section_no FROM marked),
sections AS (
  SELECT source_id, min(ord) AS section_start, coalesce(max(name), CAST(source_id AS VARCHAR)) AS title,
    string_agg(clean_text, chr(10) || chr(10) ORDER BY ord) AS content, count(*) AS n_elements
  FROM grouped GROUP BY source_id, section_no)"""


def _with(*parts):
    return "WITH " + ",".join(parts)


# --- elements, cleaning, sections --------------------------------------------


def source_types(spark, sf):
    p = read(spark, sf, "pages").withColumn("path", F.concat(F.regexp_replace("url", r"\?.*$", ""), F.element_at(
        F.array(*[F.lit(x) for x in (".html", ".HTM", ".txt", ".md", ".csv", ".tar", "")]), (F.col("page_id") % 7 + 1).cast("int"))))
    return p.select("page_id", files.source_type("path").alias("source_type"))


def source_registration(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


def csv_scan(spark, sf):
    """Customers stored as CSV files with a header and read back by name and type."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    c.write.option("header", True).csv(path)
    return files.csv_rows(spark, path, c.schema)


def json_records(spark, sf):
    """Records stored as JSON and read back under the record schema, joined by records that lack most columns."""
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    d = read(spark, sf, "documents")
    d.select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("record_id"), F.col("text").alias("content"), F.col("source").alias("source_id"),
             F.col("lang").alias("language")).write.json(path)
    pages = read(spark, sf, "pages").select(F.concat(F.lit("page_"), F.col("page_id")).alias("record_id"), F.col("url").alias("source_name"))
    return files.union_records(files.read_records(spark, path, lines=True), pages).select("record_id", "content", "source_id", "source_name", "language")


def duplicate_sources(spark, sf):
    d = read(spark, sf, "documents").select(
        F.col("doc_id").alias("source_id"), F.col("doc_id").alias("seq"),
        F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return g.duplicate_sources(d).filter("previous_source_id IS NOT NULL").select("source_id", "previous_source_id")


def latest_source_by_hash(spark, sf):
    d = read(spark, sf, "documents").select(
        F.col("doc_id").alias("source_id"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return g.latest_by_hash(d, "source_id")


def text_elements(spark, sf):
    return g.text_elements(read(spark, sf, "documents"), "doc_id", "text", "\n")


def table_rendering(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return files.csv_table_text(o, ["o_custkey"], "o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"])


def clean_elements(spark, sf):
    return g.clean_elements(line_elements(spark, sf)).select(
        "source_id", "ord", "element_type", "removal_reason", "clean_text")


def section_records(spark, sf):
    kept = g.clean_elements(line_elements(spark, sf)).filter("removal_reason IS NULL")
    return g.section_records(kept).select(
        "source_id", "section_start", "title", "content",
        F.size("element_ords").cast("long").alias("n_elements"))


def extraction_diagnostics(spark, sf):
    return g.extraction_diagnostics(line_elements(spark, sf)).select(
        "source_id", "total_characters", "total_elements", "tables_detected", "pages_detected",
        "repeated_pages", F.round("garbage_ratio", 6).alias("garbage_ratio"), "status")


def _record_quality(kept):
    """Finished records: terms normalised, e-mail masked, hashed, chained, flagged."""
    r = g.section_records(kept).withColumn("content", q.normalize_terms("content"))
    r = r.withColumn("pii_count", q.pii_type_counts("content")["email"]) \
        .withColumn("content", q.mask_emails("content"))
    return r.withColumn("flags", q.validation_flags("title", "source_id", "content"))


def ingest_report(spark, sf):
    """The elements and records tables of an ingest are written, as later jobs
    need them anyway, and the report is read off them."""
    elements = written(g.clean_elements(line_elements(spark, sf)), "elements")
    records = written(_record_quality(elements.filter("removal_reason IS NULL")), "records")
    return g.processing_report(elements, g.exact_duplicate_chain(records, ["source_id", "section_start"]))


def ingest_totals(spark, sf):
    return g.ingest_totals(ingest_report(spark, sf))


# --- terms, personal data, validation ----------------------------------------


def _phrased(spark, sf):
    """Documents with a business phrase in front, chosen by the document's own
    id, so that dictionary and validation rules all meet data."""
    d = read(spark, sf, "documents")
    phrase = F.element_at(F.array(*[F.lit(x) for x in DOC_PHRASES]), (F.col("doc_id") % len(DOC_PHRASES) + 1).cast("int"))
    return d.withColumn("content", F.concat_ws(" ", phrase, "text"))


DOC_PHRASES = (
    "SME Loan and commercial loan.", "Monthly income or monthly turnover; revenue per month.",
    "Requested amount $1,500,000 at 12.5%.", "RATE OF INTEREST against lending rate, 2500 % up.",
    "Qualification criteria and requirements (eligibility criteria).", "Loss of -$4,000 on 12/31/2024.",
    "Call +1 415 555 2671 or 415-555-2671.", "Account #123456, policy: 9981, cust 4455.",
    "Mr. John Smith and Dr Jane Ann Doe wrote to jane.doe@example.org.", "Up 10%, 1001% and 99999%.",
    "Business credit for a qualification.",
)
SQL_PHRASED = f"phrased AS (SELECT *, {sql_list(DOC_PHRASES)}[doc_id % {len(DOC_PHRASES)} + 1] || ' ' || text AS content FROM documents)"


def _sql_terms(expr: str) -> str:
    for alias, form in q.alias_pairs():
        expr = f"regexp_replace({expr}, '(?i){alias}', '{form}', 'g')"
    return expr


def terminology_normalize(spark, sf):
    d = _phrased(spark, sf).withColumn("terms", q.replaced_terms("content"))
    return d.select("doc_id", F.col("terms.text").alias("normalized"), F.size("terms.replaced").cast("long").alias("n_replaced"))


def _sql_replaced() -> str:
    """Number of replacements, pass by pass on the already replaced text."""
    expr, total = "content", []
    for alias, form in q.alias_pairs():
        total.append(f"len(regexp_extract_all({expr}, '(?i){alias}'))")
        expr = f"regexp_replace({expr}, '(?i){alias}', '{form}', 'g')"
    return " + ".join(total)


def pii_email_mask(spark, sf):
    return read(spark, sf, "documents").select("doc_id", q.mask_emails("text").alias("masked"))


def pii_type_counts(spark, sf):
    counts = q.pii_type_counts("content")
    return _phrased(spark, sf).select("doc_id", *[c.cast("long").alias(k) for k, c in counts.items()])


def pii_spans(spark, sf):
    d = _phrased(spark, sf).withColumn("p", q.personal_data("content"))
    listed = F.transform("p.entities", lambda e: F.concat_ws(":", e["entity_type"], e["start"], e["end"]))
    return d.select("doc_id", F.col("p.masked").alias("masked"), F.size("p.entities").cast("long").alias("n_entities"), F.array_join(listed, ",").alias("entities"))


def validate_records(spark, sf):
    d = _phrased(spark, sf).withColumn("title", F.when(F.col("doc_id") % 5 != 0, F.col("lang"))) \
        .withColumn("effective_from", F.when(F.col("doc_id") % 2 == 0, F.lit("2024-05-01"))) \
        .withColumn("effective_to", F.concat(F.lit("20"), (F.col("doc_id") % 17 + 14).cast("string"), F.lit("-05-02")))
    flags = q.validation_flags("title", "source", "content", "effective_from", "effective_to")
    return d.select("doc_id", F.array_join(flags, ",").alias("flags"), (F.size(flags) == 0).alias("is_valid"))


def amount_sets(spark, sf):
    return _phrased(spark, sf).select("doc_id", F.array_join(q.amounts("content"), ";").alias("amounts"),
                                      F.array_join(q.amounts("content", require_digit=True), ";").alias("strict_amounts"))


def _conflict_records(spark, sf):
    d = read(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("record_id"), F.col("source").alias("source_id"), F.col("lang").alias("category"),
        F.lit("").alias("subcategory"), F.lit("").alias("product"),
        F.concat(F.lit("1."), (F.col("doc_id") % 3).cast("string")).alias("version"), F.col("text").alias("content"))


def conflicts(spark, sf):
    return cf.conflict_counts(_conflict_records(spark, sf))


def conflict_rows(spark, sf):
    return cf.conflict_rows(_conflict_records(spark, sf))


def conflict_values(spark, sf):
    return cf.conflict_values(_conflict_records(spark, sf)).select(
        "category", "amounts", "n_records", "n_sources")


_AMT = v.AMOUNT_PATTERN
SQL_CONFLICT = f"""
recs AS (
  SELECT doc_id AS record_id, source AS source_id, lang AS category, '1.' || CAST(doc_id % 3 AS VARCHAR) AS version,
    array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{_AMT}', 1))), ';') AS amounts,
    len(regexp_extract_all(text, '{_AMT}', 1)) > 0 AS has FROM documents)"""


# --- duplicates --------------------------------------------------------------


def content_hashes(spark, sf):
    return read(spark, sf, "documents").select("doc_id", record_hash("text").alias("record_hash"),
                                               content_hash("text").alias("dedup_hash"))


def exact_dups_chain(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("seq"),
                                            F.col("text").alias("content"))
    return g.exact_duplicate_chain(d).filter("exact_of IS NOT NULL").select("record_id", "exact_of", "canonical_id")


def _dedup_records(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.col("doc_id").alias("seq"),
                                               F.col("text").alias("content"))


def near_dups(spark, sf):
    return near_contents(_dedup_records(spark, sf)).select("new_id", "earlier_id", "similarity")


def duplicate_targets(spark, sf):
    r = _dedup_records(spark, sf)
    return duplicate_of(r, near_contents(r))


# --- pages -------------------------------------------------------------------


def html_page_elements(spark, sf):
    return html_elements(read(spark, sf, "pages")).select("source_id", "ord", "element_type", "text", "section")


def html_headings(spark, sf):
    """Headings of each page."""
    e = html_elements(read(spark, sf, "pages"))
    return e.groupBy("source_id").agg(
        F.count_if(F.col("element_type") == "heading").alias("headings"),
        F.max(F.when(F.col("element_type") == "heading", F.col("text"))).alias("heading"))


QUERIES = {f.__name__: f for f in (
    source_types, source_registration, csv_scan, json_records, duplicate_sources, latest_source_by_hash, text_elements, table_rendering,
    clean_elements, section_records, extraction_diagnostics, ingest_report, ingest_totals, terminology_normalize,
    pii_email_mask, pii_type_counts, pii_spans, validate_records, amount_sets, conflicts, conflict_rows, conflict_values,
    content_hashes, exact_dups_chain, near_dups, duplicate_targets, html_page_elements, html_headings,
)}

_KINDS = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{t}'" for e, t in v.SOURCE_TYPE_BY_EXTENSION.items()) + " ELSE 'unknown' END"
_CHAIN = """
hashed AS (SELECT doc_id, sha256({h}) AS h FROM documents),
chain AS (SELECT doc_id, lag(doc_id) OVER w AS prev, first_value(doc_id) OVER w AS first_id FROM hashed WINDOW w AS (PARTITION BY h ORDER BY doc_id))"""
_FOLD = f"regexp_replace(lower({sql_strip('text')}), '{r'[\s\x0b\x1c-\x1f\x85\p{Z}]'}+', ' ', 'g')"
_VALID = r"""
  SELECT doc_id, array_to_string(flags, ',') AS flags, len(flags) = 0 AS is_valid FROM (
    SELECT doc_id, list_concat(list_filter([
      CASE WHEN doc_id % 5 = 0 THEN 'missing_metadata' END,
      CASE WHEN length(content) < 10 THEN 'missing_metadata' END,
      CASE WHEN doc_id % 2 = 0 AND CAST('20' || (doc_id % 17 + 14) || '-05-02' AS DATE) < DATE '2024-05-01' THEN 'impossible_date' END,
      CASE WHEN regexp_matches(content, '-\$[\d,]+') THEN 'invalid_numeric' END], lambda x: x IS NOT NULL),
      list_transform(list_filter(regexp_extract_all(content, '(\d+(?:\.\d+)?)\s*%', 1), lambda p: CAST(p AS DOUBLE) > 1000), lambda p: 'invalid_numeric')) AS flags
    FROM phrased)"""

SQL_QUALITY = f"""
terms AS (SELECT *, {_sql_terms('content')} AS c1 FROM sections),
masked AS (SELECT *, len(regexp_extract_all(c1, '{v.PII_EMAIL}')) AS pii_count, regexp_replace(c1, '{v.PII_EMAIL}', '[EMAIL]', 'g') AS c2 FROM terms),
checked AS (SELECT *,
    (CASE WHEN length({sql_strip('c2')}) < 10 THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(c2, '-\\$[\\d,]+') THEN 1 ELSE 0 END)
    + len(list_filter(regexp_extract_all(c2, '(\\d+(?:\\.\\d+)?)\\s*%', 1), lambda p: CAST(p AS DOUBLE) > 1000)) AS n_flags,
    row_number() OVER (PARTITION BY sha256({_FOLD.replace('(text,', '(c2,')}) ORDER BY source_id, section_start) AS copy FROM masked),
report AS (
  SELECT e.*, CAST(coalesce(records_created, 0) AS BIGINT) AS records_created, CAST(coalesce(pii, 0) AS BIGINT) AS pii_entities_found,
    CAST(coalesce(dups, 0) AS BIGINT) AS duplicates_found, CAST(coalesce(flags, 0) AS BIGINT) AS validation_flags
  FROM (SELECT source_id, count(*) AS elements_extracted, count(*) FILTER (removal_reason IS NULL) AS elements_cleaned,
      count(*) FILTER (removal_reason IS NOT NULL) AS elements_removed, count(*) FILTER (element_type = 'table') AS tables_found
    FROM cleaned GROUP BY source_id) e
  LEFT JOIN (SELECT source_id, count(*) AS records_created, sum(pii_count) AS pii, count(*) FILTER (copy > 1) AS dups, sum(n_flags) AS flags
    FROM checked GROUP BY source_id) r USING (source_id))"""

_DETECTED = [("email", v.PII_EMAIL, 0), *(("phone", p, 7) for p in v.PII_PHONES), *(("account_id", "(?i)" + p, 0) for p in v.PII_ACCOUNTS), ("person_name", v.PII_TITLED_NAME, 0)]
_HITS = " UNION ALL ".join(
    f"""SELECT doc_id, {k} AS rank, '{kind}' AS kind, {v.PII_CONFIDENCE[kind]} AS conf, ms[j] AS m,
      CAST(list_sum(list_transform(ps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS s
      FROM (SELECT doc_id, ms, regexp_split_to_array(content, '{p}') AS ps, unnest(range(1, len(ms) + 1)) AS j
            FROM (SELECT doc_id, content, regexp_extract_all(content, '{p}') AS ms FROM phrased) WHERE len(ms) > 0) WHERE length(regexp_replace(ms[j], '[ .-]', '', 'g')) >= {least}"""
    for k, (kind, p, least) in enumerate(_DETECTED))
#: the next entity is the first that starts at or after the end of the last one
SQL_PII_SPANS = f"""WITH RECURSIVE {SQL_PHRASED}, hits AS MATERIALIZED ({_HITS}),
  placed AS MATERIALIZED (SELECT *, s + length(m) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY s, conf DESC, rank, s + length(m)) AS n FROM hits),
  walk AS (SELECT doc_id, 0::BIGINT AS n, 0::BIGINT AS e, 0::BIGINT AS k, ''::VARCHAR AS masked, ''::VARCHAR AS kinds FROM phrased
    UNION ALL SELECT * FROM (SELECT w.doc_id, p.n, p.e, w.k + 1 AS k, w.masked || substring(f.content, w.e + 1, p.s - w.e) || '[' || upper(p.kind) || ']' AS masked,
        w.kinds || CASE WHEN w.k > 0 THEN ',' ELSE '' END || p.kind || ':' || p.s || ':' || p.e AS kinds
      FROM walk w JOIN placed p ON p.doc_id = w.doc_id AND p.n > w.n AND p.s >= w.e JOIN phrased f ON f.doc_id = w.doc_id
      QUALIFY row_number() OVER (PARTITION BY w.doc_id ORDER BY p.n) = 1)),
  last AS (SELECT doc_id, max(k) AS k FROM walk GROUP BY 1)
  SELECT w.doc_id, w.masked || substring(f.content, w.e + 1) AS masked, w.k AS n_entities, w.kinds AS entities
  FROM walk w JOIN last USING (doc_id, k) JOIN phrased f ON f.doc_id = w.doc_id"""

ORACLE = {
    "source_types": f"""SELECT page_id, {_KINDS} AS source_type FROM (SELECT page_id, lower(regexp_extract(
      regexp_replace(url, '\\?.*$', '') || ['.html', '.HTM', '.txt', '.md', '.csv', '.tar', ''][page_id % 7 + 1], '(\\.[^./]+)$', 1)) AS ext FROM pages)""",
    "csv_scan": "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer",
    "json_records": """SELECT 'doc_' || doc_id AS record_id, text AS content, source AS source_id, NULL AS source_name, lang AS language FROM documents
      UNION ALL SELECT 'page_' || page_id, NULL, NULL, url, NULL FROM pages""",
    "source_registration": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "duplicate_sources": _with(_CHAIN.format(h="text")) + " SELECT doc_id AS source_id, prev AS previous_source_id FROM chain WHERE prev IS NOT NULL",
    "latest_source_by_hash": "SELECT sha256(text) AS content_hash, max(doc_id) AS source_id FROM documents GROUP BY 1",
    "text_elements": _with(SQL_LINES) + " SELECT source_id, ord, text, CASE WHEN starts_with(text, '#') THEN 'heading' ELSE 'paragraph' END AS element_type FROM lines",
    "table_rendering": """SELECT o_custkey, 'o_orderkey | o_orderstatus | o_orderpriority' || chr(10) || repeat('-', 44) || chr(10) ||
      string_agg(o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS text, count(*) AS n_rows FROM orders GROUP BY 1""",
    "clean_elements": _with(SQL_LINES, SQL_CLEAN) + " SELECT source_id, ord, element_type, removal_reason, clean_text FROM cleaned",
    "section_records": _with(SQL_LINES, SQL_CLEAN, SQL_SECTIONS) + f" SELECT source_id, section_start, title, content, n_elements FROM sections WHERE {sql_strip('content')} <> ''",
    "extraction_diagnostics": _with(SQL_LINES, f"""
      page AS (SELECT source_id, page_number, lower({sql_strip("string_agg(text, ' ' ORDER BY ord)")}) AS body FROM elements GROUP BY ALL),
      pages2 AS (SELECT source_id, count(*) AS pages_detected, count(*) FILTER (length(body) > 20) - count(DISTINCT CASE WHEN length(body) > 20 THEN body END) AS repeated_pages FROM page GROUP BY 1),
      tot AS (SELECT source_id, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS total_characters, count(*) AS total_elements,
        count(*) FILTER (element_type = 'table') AS tables_detected,
        sum(length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0e-\\x1b\\x7f-\\x84\\x86-\\x9f\\p{{Cf}}\\p{{Co}}]', '', 'g'))) AS garbage FROM elements GROUP BY 1)""")
    + """ SELECT source_id, total_characters, total_elements, tables_detected, pages_detected, repeated_pages, round(garbage / total_characters, 6) AS garbage_ratio,
      CASE WHEN total_characters = 0 THEN 'failed' WHEN total_characters < 50 OR garbage / total_characters > 0.3 OR repeated_pages > 0 THEN 'partial' ELSE 'success' END AS status
      FROM tot JOIN pages2 USING (source_id)""",
    "ingest_report": _with(SQL_LINES, SQL_CLEAN, SQL_SECTIONS, SQL_QUALITY) + " SELECT * FROM report",
    "ingest_totals": _with(SQL_LINES, SQL_CLEAN, SQL_SECTIONS, SQL_QUALITY) + """ SELECT count(*) AS total_sources, CAST(sum(records_created) AS BIGINT) AS total_records,
      count(*) FILTER (records_created = 0) AS total_errors FROM report""",
    "terminology_normalize": _with(SQL_PHRASED) + f" SELECT doc_id, {_sql_terms('content')} AS normalized, CAST({_sql_replaced()} AS BIGINT) AS n_replaced FROM phrased",
    "pii_email_mask": f"SELECT doc_id, regexp_replace(text, '{v.PII_EMAIL}', '[EMAIL]', 'g') AS masked FROM documents",
    "pii_type_counts": _with(SQL_PHRASED) + f""" SELECT doc_id, CAST(len(regexp_extract_all(content, '{v.PII_EMAIL}')) AS BIGINT) AS email,
      CAST({' + '.join(f"len(list_filter(regexp_extract_all(content, '{p}'), lambda m: length(regexp_replace(m, '[ .-]', '', 'g')) >= 7))" for p in v.PII_PHONES)} AS BIGINT) AS phone,
      CAST({' + '.join(f"len(regexp_extract_all(content, '(?i){p}'))" for p in v.PII_ACCOUNTS)} AS BIGINT) AS account_id,
      CAST(len(regexp_extract_all(content, '{v.PII_TITLED_NAME}')) AS BIGINT) AS person_name FROM phrased""",
    "pii_spans": SQL_PII_SPANS,
    "validate_records": _with(SQL_PHRASED) + _VALID,
    "amount_sets": _with(SQL_PHRASED) + f""" SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '{_AMT}', 1))), ';') AS amounts,
      array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(content, '{_AMT}', 1), lambda a: regexp_matches(a, '\\d')))), ';') AS strict_amounts FROM phrased""",
    "conflicts": _with(SQL_CONFLICT) + """
      SELECT a.record_id, count(*) FILTER (a.has AND b.has AND a.amounts <> b.amounts) AS amount_conflicts,
        count(*) FILTER (a.version <> b.version) AS version_conflicts
      FROM recs a JOIN recs b ON a.category = b.category AND a.source_id <> b.source_id GROUP BY a.record_id
      HAVING amount_conflicts + version_conflicts > 0""",
    "conflict_rows": _with(SQL_CONFLICT, """
      n AS (SELECT a.record_id, a.category, a.version, a.amounts, count(*) FILTER (a.has AND b.has AND a.amounts <> b.amounts) AS by_amount,
        count(*) FILTER (a.version <> b.version) AS by_version
        FROM recs a JOIN recs b ON a.category = b.category AND a.source_id <> b.source_id GROUP BY ALL)""") + """
      SELECT record_id, category || '.amounts' AS field, amounts AS value, 'medium' AS severity, by_amount AS partners, 'unresolved' AS status FROM n WHERE by_amount > 0
      UNION ALL SELECT record_id, 'version', version, 'low', by_version, 'unresolved' FROM n WHERE by_version > 0""",
    "conflict_values": _with(SQL_CONFLICT) + """
      SELECT category, amounts, count(*) AS n_records, count(DISTINCT source_id) AS n_sources FROM recs WHERE has
        AND category IN (SELECT category FROM recs WHERE has GROUP BY 1 HAVING count(DISTINCT amounts) > 1 AND count(DISTINCT source_id) > 1) GROUP BY ALL""",
    "content_hashes": f"SELECT doc_id, sha256(lower({sql_strip('text')})) AS record_hash, sha256({_FOLD}) AS dedup_hash FROM documents",
    "exact_dups_chain": _with(_CHAIN.format(h=_FOLD)) + " SELECT doc_id AS record_id, prev AS exact_of, first_id AS canonical_id FROM chain WHERE prev IS NOT NULL",
    "html_headings": r"""SELECT page_id AS source_id, count(*) AS headings, max(heading) AS heading FROM (
      SELECT page_id, trim(replace(unnest(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1)), '&amp;', '&')) AS heading FROM pages) WHERE heading <> '' GROUP BY 1""",
}
