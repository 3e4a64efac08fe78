"""Registered retrieval queries and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from callbrook import fixed_values as v
from callbrook.functions.text import strip, words
from callbrook.functions.vectors import dot, feature_rows
from callbrook.operators import search as s
from callbrook.operators.chunking import chunk_records
from callbrook.session import shared_dir, written
from callbrook.plans.tables import (
    SQL_CHUNKS, SQL_QUERIES, benchmark_queries, document_chunks, document_records, read, sql_list, sql_str, sql_strip, sql_words,
)

K = v.TOP_K
STOP = sql_list(v.STOPWORDS)

# --- shared SQL --------------------------------------------------------------

SQL_TOKENS = f"""
toks AS (
  SELECT chunk_id, list_filter(regexp_extract_all(lower(title || ' ' || section || ' ' || content), '[a-z0-9_]+'),
         lambda w: NOT list_contains({STOP}, w)) AS terms FROM chunks),
lens AS (SELECT chunk_id, len(terms) AS doc_len FROM toks),
stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM lens),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""

SQL_BM25 = f"""
qterms AS (
  SELECT query_id, term, count(*) AS occ FROM (
    SELECT query_id, unnest(list_filter(regexp_extract_all(lower(query), '[a-z0-9_]+'),
           lambda w: NOT list_contains({STOP}, w))) AS term FROM queries) GROUP BY ALL),
bm AS (
  SELECT q.query_id, p.chunk_id, sum(q.occ
     * (CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) <= 0 THEN {v.BM25_IDF_FLOOR}
             ELSE ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) END)
     * (tf * ({v.BM25_K1} + 1.0)) / greatest(1e-6, tf + {v.BM25_K1} * (1.0 - {v.BM25_B}
        + {v.BM25_B} * (doc_len / greatest(avg_len, 1e-6))))) AS raw_score
  FROM qterms q JOIN post p USING (term) JOIN dfs USING (term) JOIN lens USING (chunk_id), stats GROUP BY ALL),
cut AS (
  SELECT *, max(raw_score) OVER (PARTITION BY query_id) AS best,
    row_number() OVER (PARTITION BY query_id ORDER BY round(raw_score, 9) DESC, chunk_id) AS r FROM bm)"""


def sql_sparse(n: int, where: str = "TRUE") -> str:
    return f"""
sparse AS (SELECT query_id, chunk_id, sparse_score, sparse_rank FROM (
    SELECT c.query_id, c.chunk_id, CASE WHEN best > 0 THEN raw_score / best ELSE 0.0 END AS sparse_score,
      row_number() OVER (PARTITION BY c.query_id ORDER BY r) AS sparse_rank
    FROM cut c JOIN chunks USING (chunk_id) WHERE r <= {2 * n} AND {where}) WHERE sparse_rank <= {n})"""


def sql_slot(f: str) -> str:
    """MD5 modulo the dimension from four 32-bit words, first word highest."""
    words = [f"CAST('0x' || substr(md5({f}), {i}, 8) AS BIGINT)" for i in (1, 9, 17, 25)]
    out = f"({words[0]} % {v.EMBED_DIM})"
    for w in words[1:]:
        out = f"(({out} * {(1 << 32) % v.EMBED_DIM} + {w}) % {v.EMBED_DIM})"
    return out


def sql_slots(source: str, key: str, text: str, name: str) -> str:
    return f"""
{name}_t AS (SELECT {key} AS k, lower({text}) AS low FROM {source}),
{name}_u AS (SELECT k, {sql_strip('low')} AS low, regexp_extract_all({sql_strip('low')}, '[a-z0-9_]+') AS t FROM {name}_t),
{name}_f AS (
  SELECT k, unnest(t) AS f, {v.EMBED_UNIGRAM} AS w FROM {name}_u
  UNION ALL SELECT k, unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])), {v.EMBED_BIGRAM} FROM {name}_u
  UNION ALL SELECT k, 'num_' || unnest(regexp_extract_all(low, '\\b\\d+(?:\\.\\d+)?\\b')), {v.EMBED_NUMBER} FROM {name}_u WHERE len(t) > 0),
{name}_s AS (SELECT k, {sql_slot('f')} AS slot, CAST(sum(w) AS DOUBLE) AS w FROM {name}_f GROUP BY ALL),
{name}_v AS (SELECT k, slot, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM {name}_s)"""


SQL_VECTORS = sql_slots("chunks", "chunk_id", "title || chr(10) || content", "c") + "," \
    + sql_slots("queries", "query_id", "query", "q")


def sql_dense(n: int, where: str = "TRUE") -> str:
    return f"""
sims AS (
  SELECT q.k AS query_id, c.k AS chunk_id, greatest(-1.0, least(1.0, sum(q.w * c.w))) AS dense_score
  FROM q_v q JOIN c_v c USING (slot) GROUP BY ALL),
every AS (
  SELECT query_id, chunk_id, coalesce(dense_score, 0.0) AS dense_score
  FROM (SELECT query_id, chunk_id FROM queries, chunks WHERE query <> '' AND {where}) LEFT JOIN sims USING (query_id, chunk_id)),
dense AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dense_score, 9) DESC, chunk_id) AS dense_rank
  FROM every) WHERE dense_rank <= {n})"""


SQL_RRF = f"""
fused AS (
  SELECT query_id, chunk_id, round(coalesce(dense_score, 0.0), 4) AS dense_score,
    round(coalesce(sparse_score, 0.0), 4) AS sparse_score,
    round(least(1.0, (coalesce(1.0 / ({v.RRF_K} + dense_rank), 0.0) + coalesce(1.0 / ({v.RRF_K} + sparse_rank), 0.0))
      * {v.RRF_K / 2.0}), 4) AS combined_score
  FROM dense FULL JOIN sparse USING (query_id, chunk_id))"""

SQL_WEIGHTED = f"""
fused AS (
  SELECT query_id, chunk_id, round(greatest(0.0, coalesce(dense_score, 0.0)), 4) AS dense_score,
    round(greatest(0.0, coalesce(sparse_score, 0.0)), 4) AS sparse_score,
    round({v.FUSION_ALPHA} * greatest(0.0, coalesce(dense_score, 0.0))
      + {1 - v.FUSION_ALPHA} * greatest(0.0, coalesce(sparse_score, 0.0)), 4) AS combined_score
  FROM dense FULL JOIN sparse USING (query_id, chunk_id))"""

SQL_RERANK = f"""
qf0 AS (
  SELECT query_id, lower(query) AS q, regexp_extract_all(lower(query), '[a-z0-9_]+') AS aw,
    list_distinct(regexp_extract_all(lower(query), '\\b\\d+(?:,\\d+)*(?:\\.\\d+)?%?\\b')) AS nums,
    list_distinct(regexp_extract_all(lower(query), '[a-z0-9_]{{2,}}')) AS gw FROM queries),
qf AS (
  SELECT query_id, q, nums,
    list_distinct(CASE WHEN len(list_filter(aw, lambda w: NOT list_contains({STOP}, w) AND length(w) > 1)) > 0
      THEN list_filter(aw, lambda w: NOT list_contains({STOP}, w) AND length(w) > 1) ELSE aw END) AS mw,
    list_transform(list_filter(range(1, len(aw)), lambda i: NOT (list_contains({STOP}, aw[i]) AND list_contains({STOP}, aw[i + 1]))),
      lambda i: aw[i] || ' ' || aw[i + 1]) AS sp,
    CASE WHEN len(list_filter(gw, lambda w: NOT list_contains({sql_list(v.GATE_STOPWORDS)}, w))) > 0
      THEN list_filter(gw, lambda w: NOT list_contains({sql_list(v.GATE_STOPWORDS)}, w)) ELSE gw END AS gate_words
  FROM qf0),
feat AS (
  SELECT f.*, c.* EXCLUDE (chunk_id), q.* EXCLUDE (query_id), lower(content) AS body
  FROM fused f JOIN chunks c USING (chunk_id) JOIN qf q USING (query_id)),
boosted AS (
  SELECT *,
    CASE WHEN contains(body, q) THEN 1.0 WHEN len(sp) > 0
      THEN CAST(len(list_filter(sp, lambda x: contains(body, x))) AS DOUBLE) / len(sp) ELSE 0.0 END AS phrase_score,
    CAST(len(list_filter(mw, lambda w: NOT list_contains({STOP}, w) AND list_contains(
      regexp_extract_all(lower(title || ' ' || section), '[a-z0-9_]+'), w))) AS DOUBLE) / greatest(1, len(mw)) AS title_score,
    CASE WHEN len(nums) > 0 THEN CAST(len(list_filter(nums, lambda x: contains(replace(body, ',', ''),
      replace(replace(x, ',', ''), '%', '')))) AS DOUBLE) / len(nums) ELSE combined_score END AS numeric_score,
    CAST(len(list_filter(mw, lambda w: NOT list_contains({STOP}, w) AND list_contains(
      regexp_extract_all(body, '[a-z0-9_]+'), w))) AS DOUBLE) / greatest(1, len(mw)) AS coverage_score
  FROM feat),
ranked AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM (
    SELECT *, round(least(1.0, greatest(0.0, 0.50 * combined_score + 0.50 * (
      {v.RERANK_PHRASE} * phrase_score + {v.RERANK_TITLE} * title_score + {v.RERANK_NUMERIC} * numeric_score
      + {v.RERANK_COVERAGE} * coverage_score))), 4) AS rerank_score FROM boosted)) WHERE rank <= {K})"""

SQL_GATE = f"""
lead1 AS (
  SELECT *, coalesce(nullif(rerank_score, 0.0), combined_score) AS top_score,
    coalesce(lead(coalesce(nullif(rerank_score, 0.0), combined_score)) OVER (PARTITION BY query_id ORDER BY rank), 0.0) AS second_score
  FROM ranked),
gated AS (
  SELECT *, least(1.0, greatest(0.0, round({v.GATE_TOP} * top_score
    + {v.GATE_COVERAGE} * (CAST(len(list_filter(gate_words, lambda w: list_contains(
        regexp_extract_all(body || ' ' || lower(title) || ' ' || lower(section), '[a-z0-9_]{{2,}}'), w))) AS DOUBLE) / greatest(1, len(gate_words)))
    + {v.GATE_MARGIN} * least(1.0, greatest(0.0, top_score - second_score) * 2.0), 4))) AS value
  FROM lead1 WHERE rank = 1),
gate AS (
  SELECT q.query_id, q.query,
    CASE WHEN top_score IS NULL OR q.query = '' THEN 0.0 WHEN top_score < {v.GATE_WEAK} THEN round(top_score, 4) ELSE value END AS confidence,
    CASE WHEN q.query = '' THEN 'empty_query' WHEN top_score IS NULL THEN 'no_matching_records'
      WHEN top_score < {v.GATE_WEAK} THEN 'weak_candidate_score'
      WHEN value < {v.GATE_THRESHOLD} THEN 'confidence_below_threshold_{v.GATE_THRESHOLD}' END AS abstain_reason,
    g.chunk_id AS top_chunk_id
  FROM queries q LEFT JOIN gated g USING (query_id))"""

SQL_CITED = f"""
cited AS (
  SELECT *, CASE WHEN length(line) > 160 THEN substr(line, 1, 157) || '...' ELSE line END AS snippet,
    coalesce(nullif(source_name, ''), nullif(title, ''), 'Unknown Source') AS cite_name,
    '[' || concat_ws(' | ', 'Source: ' || coalesce(nullif(source_name, ''), nullif(title, ''), 'Unknown Source'),
      'Section: ' || nullif(section, ''), 'v' || version, 'hash:' || substr(content_hash, 1, 8)) || ']' AS tag
  FROM (SELECT *, split_part({sql_strip('content')}, chr(10), 1) AS line FROM ranked))"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_BASE = (SQL_CHUNKS, SQL_QUERIES)
_SPARSE = (*_BASE, SQL_TOKENS, SQL_BM25, sql_sparse(3 * K))
_BOTH = (*_SPARSE, SQL_VECTORS, sql_dense(3 * K))
_RANKED = (*_BOTH, SQL_RRF, SQL_RERANK)
_FILTER = {"category": "EN", "product": None, "source_name": ["src1", "src2", "src3", "src4"], "market": "id"}
_SQL_FILTER = "lower(category) = 'en' AND source_name IN ('src1', 'src2', 'src3', 'src4') AND lower(market) = 'id'"


# --- queries -----------------------------------------------------------------


def _inputs(spark, sf):
    return document_chunks(spark, sf), benchmark_queries(spark, sf)


def _round(df, **places):
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


def tokenize(spark, sf):
    toks = s.index_tokens(document_chunks(spark, sf))
    return toks.select("chunk_id", F.array_join("terms", " ").alias("terms"), F.col("doc_len").cast("long").alias("doc_len"))


def corpus_stats(spark, sf):
    return s.corpus_stats(document_chunks(spark, sf)).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def document_frequency(spark, sf):
    return s.document_frequency(s.postings(document_chunks(spark, sf)))


def bm25_topk(spark, sf):
    c, q = _inputs(spark, sf)
    return _round(s.sparse_topk(c, q, 3 * K), sparse_score=6)


def bm25_filtered(spark, sf):
    c, q = _inputs(spark, sf)
    return _round(s.sparse_topk(c, q, 3 * K, filters=_FILTER), sparse_score=6)


def bm25_after_removal(spark, sf):
    c, q = _inputs(spark, sf)
    removed = read(spark, sf, "labels").filter("toxic = 1 OR quality = 0").select(F.col("doc_id").alias("chunk_id"))
    return _round(s.sparse_topk(s.without_removed(c, removed), q, K), sparse_score=6)


def hash_embed_slots(spark, sf):
    return feature_rows(benchmark_queries(spark, sf), "query_id", "query").withColumn("slot", F.col("slot").cast("long"))


def hash_embed_topk(spark, sf):
    c, q = _inputs(spark, sf)
    return _round(s.dense_topk(c, q, 3 * K), dense_score=6)


def rrf_fusion(spark, sf):
    c, q = _inputs(spark, sf)
    return s.fuse_rrf(s.dense_topk(c, q, 3 * K), s.sparse_topk(c, q, 3 * K))


def weighted_fusion(spark, sf):
    c, q = _inputs(spark, sf)
    return s.fuse_weighted(s.dense_topk(c, q, 3 * K), s.sparse_topk(c, q, 3 * K))


def _ranked(spark, sf):
    c, q = _inputs(spark, sf)
    fused = s.fuse_rrf(s.dense_topk(c, q, 3 * K), s.sparse_topk(c, q, 3 * K))
    return s.rerank(fused, c, q, K), q


def rerank(spark, sf):
    return _ranked(spark, sf)[0].select("query_id", "rank", "chunk_id", "combined_score", "rerank_score")


def confidence_gate(spark, sf):
    ranked, q = _ranked(spark, sf)
    return s.confidence_gate(ranked, q).select("query_id", "confidence", "grounded", "abstain_reason", "top_chunk_id")


def citations(spark, sf):
    return s.cited(_ranked(spark, sf)[0]).select("query_id", "rank", "chunk_id", "cite_name", "snippet", "tag")


ANSWER = ("query_id", "query", "confidence", "grounded", "abstain_reason", "answer", "cited_sources")


def hybrid_answers(spark, sf):
    c, q = _inputs(spark, sf)
    return s.hybrid_search(c, q)[1].select(*ANSWER)


def index_search(spark, sf):
    """The index is written once; the search reads chunks, postings, vectors and figures from it."""
    c, q = _inputs(spark, sf)
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    s.write_index(c, path)
    return s.search_index(s.read_index(spark, path), q)[1].select(*ANSWER)


def hybrid_filtered(spark, sf):
    c, q = _inputs(spark, sf)
    return s.hybrid_search(c, q, filters=_FILTER)[1].select(*ANSWER).drop("query")


def vector_topk(spark, sf):
    """Nearest stored embeddings of every class's first vector."""
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    firsts = e.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.min_by("vector", "vec_id").alias("vector"))
    top = s.vector_topk(e, firsts, lambda part: part, 10, "vec_id")
    return top.select("query_id", "chunk_id", F.round("dense_score", 6).alias("dense_score"),
                      F.col("dense_rank").cast("long").alias("dense_rank"))


def vector_cosine(spark, sf):
    """Every stored embedding against its class's first one."""
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    firsts = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("first"))
    return e.join(firsts, "label").select("vec_id", "label", F.round(dot("v", "first"), 6).alias("cosine"))


def metadata_filter(spark, sf):
    return s.filter_chunks(document_chunks(spark, sf), _FILTER).select("chunk_id", "category", "source_name")


def kb_stats(spark, sf):
    c = document_chunks(spark, sf)
    return c.agg(
        F.count("*").alias("total_chunks"),
        F.count_distinct(F.nullif("source_id", F.lit(""))).alias("total_sources"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("category", F.lit("")))), ",").alias("categories"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("product", F.lit("")))), ",").alias("products"),
    )


def paginate(spark, sf):
    c = document_chunks(spark, sf)
    return c.orderBy("chunk_id").offset(40).limit(20).select("chunk_id", "title", "language")


def index_upsert(spark, sf):
    """Re-indexing the labelled documents: the newer row of a chunk wins."""
    c = document_chunks(spark, sf).select("chunk_id", "title", "version").withColumn("batch", F.lit(1))
    lab = read(spark, sf, "labels").select("doc_id", "quality")
    again = c.join(lab, c.chunk_id == lab.doc_id).select(
        "chunk_id", F.concat(F.lit("again: "), "title").alias("title"), F.concat(F.lit("2."), F.col("quality").cast("string")).alias("version"),
        F.lit(2).alias("batch"))
    return s.latest_chunks(c.unionByName(again), "batch").select("chunk_id", "title", "version", F.col("batch").cast("long").alias("batch"))


def chunks(spark, sf):
    """Section-aware chunks of every document."""
    return chunk_records(document_records(spark, sf)).select(
        "record_id", "chunk_index", "total_chunks", "section", "content", "char_count", "token_count")


def chunk_totals(spark, sf):
    """What chunking may not change: per document, the words in order.  (Table
    chunks repeat their header rows, so table documents only count chunks.)"""
    piped = F.size(F.filter(F.split("content", "\n"), lambda x: x.contains("|"))) >= 3
    r = document_records(spark, sf).withColumn("is_table", piped & (F.length(strip("content")) > v.CHUNK_SIZE))
    c = chunk_records(r)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), " ")
    per = c.groupBy("record_id", "is_table").agg(text.alias("text"), F.max("total_chunks").alias("n"), F.count("*").alias("rows"))
    return per.select("record_id", "is_table", F.when(~F.col("is_table"), F.md5(F.array_join(words("text"), " ").cast("binary"))).alias("words_md5"),
                      (F.col("n") == F.col("rows")).alias("complete"))


def chunk_search(spark, sf):
    """Documents cut into chunks, the chunk table written, and searched."""
    c = written(chunk_records(document_records(spark, sf)), "chunks")
    return s.hybrid_search(c, benchmark_queries(spark, sf))[1].select(*ANSWER)


QUERIES = {f.__name__: f for f in (
    tokenize, corpus_stats, document_frequency, bm25_topk, bm25_filtered, bm25_after_removal, hash_embed_slots,
    hash_embed_topk, rrf_fusion, weighted_fusion, rerank, confidence_gate, citations, hybrid_answers, index_search,
    hybrid_filtered, vector_topk, vector_cosine, metadata_filter, kb_stats, paginate, index_upsert,
    chunks, chunk_totals, chunk_search,
)}

ORACLE = {
    "chunk_totals": f"""SELECT record_id, is_table, CASE WHEN NOT is_table THEN md5(array_to_string({sql_words('text')}, ' ')) END AS words_md5, true AS complete
      FROM (SELECT 'doc_' || doc_id AS record_id, text, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|'))) >= 3
        AND length({sql_strip('text')}) > {v.CHUNK_SIZE} AS is_table FROM documents)""",
    "tokenize": _with(SQL_CHUNKS, SQL_TOKENS) + " SELECT chunk_id, array_to_string(terms, ' ') AS terms, CAST(len(terms) AS BIGINT) AS doc_len FROM toks",
    "corpus_stats": _with(SQL_CHUNKS, SQL_TOKENS) + " SELECT n_docs, round(avg_len, 6) AS avg_len FROM stats",
    "document_frequency": _with(SQL_CHUNKS, SQL_TOKENS) + " SELECT term, df FROM dfs",
    "bm25_topk": _with(*_SPARSE) + " SELECT query_id, chunk_id, round(sparse_score, 6) AS sparse_score, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM sparse",
    "bm25_filtered": _with(*_BASE, SQL_TOKENS, SQL_BM25, sql_sparse(3 * K, _SQL_FILTER))
    + " SELECT query_id, chunk_id, round(sparse_score, 6) AS sparse_score, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM sparse",
    "bm25_after_removal": _with(
        SQL_CHUNKS.replace("FROM documents", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)"),
        SQL_QUERIES, SQL_TOKENS, SQL_BM25, sql_sparse(K))
    + " SELECT query_id, chunk_id, round(sparse_score, 6) AS sparse_score, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM sparse",
    "hash_embed_slots": _with(SQL_QUERIES, sql_slots("queries", "query_id", "query", "q")) + " SELECT k AS query_id, slot, w AS weight FROM q_s",
    "hash_embed_topk": _with(*_BASE, SQL_VECTORS, sql_dense(3 * K))
    + " SELECT query_id, chunk_id, round(dense_score, 6) AS dense_score, CAST(dense_rank AS INTEGER) AS dense_rank FROM dense",
    "rrf_fusion": _with(*_BOTH, SQL_RRF) + " SELECT * FROM fused",
    "weighted_fusion": _with(*_BOTH, SQL_WEIGHTED) + " SELECT * FROM fused",
    "rerank": _with(*_RANKED) + " SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, combined_score, rerank_score FROM ranked",
    "confidence_gate": _with(*_RANKED, SQL_GATE) + " SELECT query_id, confidence, abstain_reason IS NULL AS grounded, abstain_reason, top_chunk_id FROM gate",
    "citations": _with(*_RANKED, SQL_CITED) + " SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, cite_name, snippet, tag FROM cited",
    "hybrid_answers": _with(*_RANKED, SQL_GATE, SQL_CITED) + f"""
      SELECT g.query_id, g.query, g.confidence, g.abstain_reason IS NULL AS grounded, g.abstain_reason,
        CASE WHEN g.abstain_reason IS NULL THEN body2 || chr(10) || chr(10) || 'Sources:' || chr(10) || tags
          ELSE {sql_str(v.ABSTENTION)} END AS answer,
        CASE WHEN g.abstain_reason IS NULL THEN n ELSE 0 END AS cited_sources
      FROM gate g LEFT JOIN (
        SELECT query_id, max(CASE WHEN rank = 1 THEN {sql_strip('content')} END) AS body2, count(*) AS n,
          string_agg('  [' || rank || '] ' || tag, chr(10) ORDER BY rank) AS tags FROM cited WHERE rank <= 2 GROUP BY query_id) t USING (query_id)""",
    "hybrid_filtered": _with(*_BASE, SQL_TOKENS, SQL_BM25, sql_sparse(3 * K, _SQL_FILTER), SQL_VECTORS,
                             sql_dense(3 * K, _SQL_FILTER), SQL_RRF, SQL_RERANK, SQL_GATE, SQL_CITED) + f"""
      SELECT g.query_id, g.confidence, g.abstain_reason IS NULL AS grounded, g.abstain_reason,
        CASE WHEN g.abstain_reason IS NULL THEN body2 || chr(10) || chr(10) || 'Sources:' || chr(10) || tags
          ELSE {sql_str(v.ABSTENTION)} END AS answer,
        CASE WHEN g.abstain_reason IS NULL THEN n ELSE 0 END AS cited_sources
      FROM gate g LEFT JOIN (
        SELECT query_id, max(CASE WHEN rank = 1 THEN {sql_strip('content')} END) AS body2, count(*) AS n,
          string_agg('  [' || rank || '] ' || tag, chr(10) ORDER BY rank) AS tags FROM cited WHERE rank <= 2 GROUP BY query_id) t USING (query_id)""",
    "vector_topk": """
      WITH firsts AS (SELECT label AS query_id, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS qv FROM embeddings GROUP BY label),
      sims AS (SELECT CAST(query_id AS BIGINT) AS query_id, vec_id AS chunk_id,
        greatest(-1.0, least(1.0, list_sum(list_transform(range(1, len(qv) + 1), lambda i: qv[i] * CAST(embedding[i] AS DOUBLE))))) AS s
        FROM firsts, embeddings)
      SELECT query_id, chunk_id, round(s, 6) AS dense_score, dense_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS dense_rank FROM sims)
      WHERE dense_rank <= 10""",
    "vector_cosine": """
      WITH firsts AS (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS f FROM embeddings GROUP BY label)
      SELECT vec_id, label, round(greatest(-1.0, least(1.0, list_sum(list_transform(range(1, len(f) + 1), lambda i: f[i] * CAST(embedding[i] AS DOUBLE))))), 6) AS cosine
      FROM embeddings JOIN firsts USING (label)""",
    "metadata_filter": _with(SQL_CHUNKS) + f" SELECT chunk_id, category, source_name FROM chunks WHERE {_SQL_FILTER}",
    "kb_stats": _with(SQL_CHUNKS) + """ SELECT count(*) AS total_chunks, count(DISTINCT nullif(source_id, '')) AS total_sources,
      string_agg(DISTINCT category, ',' ORDER BY category) AS categories, string_agg(DISTINCT product, ',' ORDER BY product) AS products FROM chunks""",
    "paginate": _with(SQL_CHUNKS) + " SELECT chunk_id, title, language FROM chunks ORDER BY chunk_id LIMIT 20 OFFSET 40",
    "index_upsert": _with(SQL_CHUNKS) + """ SELECT chunk_id, CASE WHEN quality IS NULL THEN title ELSE 'again: ' || title END AS title,
      CASE WHEN quality IS NULL THEN version ELSE '2.' || quality END AS version, CASE WHEN quality IS NULL THEN 1 ELSE 2 END::BIGINT AS batch
      FROM chunks LEFT JOIN labels ON chunk_id = doc_id""",
}
ORACLE["index_search"] = ORACLE["hybrid_answers"]
