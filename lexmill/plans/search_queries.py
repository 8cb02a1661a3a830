"""Search queries: benchmark passages as queries, documents as chunks (section: language; journal: source)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.functions import text as X
from lexmill.operators import chunking, evidence, increments, lines, retrieval, search, vector_index
from lexmill.plans import sql as S
from lexmill.plans.corpus_queries import IDF_SQL, POSTINGS_SQL, TITLES_SQL, documents, table
from lexmill.plans.registry import query
from lexmill.session import shared_path

K = 10


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", lines.title("text").alias("title"), F.col("lang").alias("section"), F.col("source").alias("journal_id"))


_indexes: dict[tuple[str, str], str] = {}


def index_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The index of documents as chunks: built at the first use in an application, and read by all queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = shared_path(spark, f"index-{uuid.uuid4().hex}")
        search.write_index(search_chunks(spark, sf_dir).withColumn("chunk_index", F.lit(0)).withColumn("char_len", F.length("text")), path)
        _indexes[key] = path
    return search.read_index(spark, _indexes[key])


def sparse(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    index = index_of(spark, sf_dir)
    posts = index["postings"] if docs is None else index["postings"].join(docs.select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")
    q, known = retrieval.on_driver(retrieval.postings(search_queries(spark, sf_dir), "query_id", "query"), retrieval.SMALL_ROWS)
    return retrieval.sparse_scores_of(q, search.touched(posts, q, known), index["idf"], few=known is not None).withColumnRenamed("chunk_id", "doc_id")


def candidates(spark: SparkSession, sf_dir: str, k: int = 3 * K) -> DataFrame:
    top, known = retrieval.on_driver(retrieval.top_k(sparse(spark, sf_dir), k, "doc_id"), search.RESULTS_MOST)
    rows = (F.broadcast(top) if known is not None else top).join(index_of(spark, sf_dir)["ranked"], "doc_id").join(retrieval.small(search_queries(spark, sf_dir)), "query_id")
    return rows.select("query_id", "query", "chunk_id", "doc_id", "title", "section", "journal_id", "text", F.col("score").alias("raw_score"), "rank", *retrieval.TERM_COLUMNS)


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank(candidates(spark, sf_dir))


_Q_POSTS = POSTINGS_SQL.replace("documents", "(SELECT item_id AS doc_id, text FROM benchmark)")


def _sparse_sql(where: str = "true") -> str:
    return f"""SELECT q.doc_id AS query_id, p.doc_id, round(sum(q.tf * p.tf * i.idf), 6) AS score FROM ({_Q_POSTS}) q JOIN ({POSTINGS_SQL}) p USING (bucket) JOIN ({IDF_SQL}) i USING (bucket)
    JOIN (SELECT doc_id AS k FROM documents WHERE {where}) f ON f.k = p.doc_id GROUP BY ALL"""


def _top_sql(scored: str, k: int, id_col: str = "doc_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {id_col}) AS rank FROM ({scored})) WHERE rank <= {k}"


SPARSE_SQL = _sparse_sql()


@query("sparse_topk", _top_sql(SPARSE_SQL, K))
def sparse_topk(spark, sf_dir):
    return retrieval.top_k(sparse(spark, sf_dir), K, "doc_id")


@query("filtered_search", _top_sql(_sparse_sql("lang = 'en' AND source = 'src1'"), K))
def filtered_search(spark, sf_dir):
    docs = retrieval.metadata_filter(documents(spark, sf_dir), lang="en", source="src1", section=None)
    return retrieval.top_k(sparse(spark, sf_dir, docs), K, "doc_id")


DENSE_SQL = """
SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))
  / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 6) AS score
FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0
"""


def dense_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every vector with an id divisible by 50 as a query, and all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return vectors.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), vectors


@query("dense_topk", _top_sql(DENSE_SQL, K, "chunk_id"))
def dense_topk(spark, sf_dir):
    return retrieval.dense_top_k(*dense_tables(spark, sf_dir), K)


def vectors_of(spark: SparkSession, sf_dir: str) -> str:
    """The index of all vectors: built at the first use in an application."""
    key = (spark.sparkContext.applicationId, f"vectors of {sf_dir}")
    if key not in _indexes:
        path = shared_path(spark, f"vectors-{uuid.uuid4().hex}")
        vector_index.write_vectors(dense_tables(spark, sf_dir)[1], path)
        _indexes[key] = path
    return _indexes[key]


@query("dense_topk_quantised", _top_sql(DENSE_SQL, K, "chunk_id"))
def dense_topk_quantised(spark, sf_dir):
    """From codes of a byte a component of all cells: what is left is scored exactly."""
    return vector_index.nearest(spark, vectors_of(spark, sf_dir), dense_tables(spark, sf_dir)[0], K, probes=0)


@query("ann_topk")
def ann_topk(spark, sf_dir):
    """From the nearest cells: approximate, with the recall that the index was built for."""
    return vector_index.nearest(spark, vectors_of(spark, sf_dir), dense_tables(spark, sf_dir)[0], K)


@query(
    "precision_at_k",
    f"""SELECT t.query_id, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS precision_at_k FROM ({_top_sql(DENSE_SQL, K, 'chunk_id')}) t
    JOIN embeddings a ON a.vec_id = t.query_id JOIN embeddings b ON b.vec_id = t.chunk_id GROUP BY t.query_id""",
)
def precision_at_k(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    top = retrieval.dense_top_k(*dense_tables(spark, sf_dir), K)
    rows = top.join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "a"}), "query_id").join(labels.withColumnsRenamed({"vec_id": "chunk_id", "label": "b"}), "chunk_id")
    return rows.groupBy("query_id").agg(F.round(F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)), 6).alias("precision_at_k"))


_DIM = f"SELECT doc_id, bucket % {retrieval.DIMENSIONS} AS d, sum((1 - 2 * ((bucket // {retrieval.DIMENSIONS}) % 2)) * tf) AS v FROM ({{}}) GROUP BY ALL"
_UNIT = "SELECT doc_id, d, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM ({})"
HASHED_SQL = f"""SELECT q.doc_id AS query_id, p.doc_id, round(sum(q.v * p.v), 6) AS score FROM ({_UNIT.format(_DIM.format(_Q_POSTS))}) q JOIN ({_UNIT.format(_DIM.format(POSTINGS_SQL))}) p USING (d) GROUP BY ALL"""
RRF_SQL = f"""SELECT query_id, doc_id, round(sum(1.0 / ({P.RRF_K} + rank)), 8) AS score FROM (
  SELECT query_id, doc_id, rank FROM ({_top_sql(SPARSE_SQL, 3 * K)}) UNION ALL SELECT query_id, doc_id, rank FROM ({_top_sql(HASHED_SQL, 3 * K)})) GROUP BY ALL"""


@query("hybrid_rrf", _top_sql(RRF_SQL, K))
def hybrid_rrf(spark, sf_dir):
    queries = retrieval.hashed_vectors(search_queries(spark, sf_dir), "query_id", "query")
    hashed = retrieval.dense_top_k(queries, index_of(spark, sf_dir)["vectors"].withColumnRenamed("chunk_id", "doc_id"), 3 * K, "doc_id")
    lists = {"sparse": retrieval.top_k(sparse(spark, sf_dir), 3 * K, "doc_id"), "dense": hashed}
    return retrieval.fuse(lists, K, "doc_id")


_CANDIDATES = f"""SELECT t.query_id, b.text AS query, t.doc_id AS chunk_id, t.doc_id, x.title, d.lang AS section, d.source AS journal_id, d.text, t.score AS raw_score, t.rank
FROM ({_top_sql(SPARSE_SQL, 3 * K)}) t JOIN documents d ON d.doc_id = t.doc_id JOIN ({TITLES_SQL}) x ON x.doc_id = t.doc_id JOIN benchmark b ON b.item_id = t.query_id"""
_BODY = "substr(text, 1, 1800)"
RERANK_SQL = f"""
WITH c AS ({_CANDIDATES}),
t AS (SELECT *, {S.search_tokens('query')} AS q, {S.search_tokens('title')} AS tt, {S.search_tokens('section')} AS st, {S.search_tokens(_BODY)} AS bt,
      {S.normalize_search('query')} AS qn, {S.normalize_search(f"title || ' ' || section || ' ' || {_BODY}")} AS xn, {S.normalize_search('title')} AS tn FROM c),
p AS (SELECT *, {S.bigrams('q')} AS qp, list_concat(tt[1:24], bt[1:48]) AS xl FROM t),
v AS (SELECT *, {S.coverage('q', 'tt')} AS ct, {S.coverage('q', 'bt')} AS cb, {S.coverage('q', 'st')} AS cs, {S.coverage('qp', S.bigrams('xl'))} AS cp FROM p),
l AS (SELECT *, least(1.0, 0.55::DOUBLE * ct + 0.25::DOUBLE * cb + 0.10::DOUBLE * cs + 0.10::DOUBLE * cp + CASE WHEN qn != '' AND contains(xn, qn) THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN qn != '' AND contains(tn, qn) THEN 0.08::DOUBLE ELSE 0 END) AS lexical,
  min(raw_score) OVER w AS lo, max(raw_score) OVER w AS hi, count(*) OVER w AS n FROM v WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT *, CASE WHEN lexical < 0.08 AND ct = 0 AND cb < 0.08 THEN 0.72::DOUBLE ELSE 1.0::DOUBLE END AS damp FROM l),
s AS (SELECT *, round(greatest(0.0, least(1.0, 0.45::DOUBLE * CASE WHEN hi <= lo THEN 1.0 ELSE (raw_score - lo) / (hi - lo) END * damp + 0.25::DOUBLE * CASE WHEN n > 1 THEN 1.0 - (rank - 1)::DOUBLE / greatest(n - 1, 1) ELSE 1.0 END * damp
  + 0.30::DOUBLE * lexical - CASE WHEN {S.matches('trim(title)', P.AUTHOR_TITLE)} THEN 0.14::DOUBLE ELSE 0 END)), 4) AS score FROM f)
SELECT query_id, chunk_id, doc_id, title, section, journal_id, rank, round(lexical, 4) AS lexical_score, round(ct, 4) AS title_score, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM s
"""
_SHOWN = ["query_id", "doc_id", "rank", "lexical_score", "title_score", "score", "new_rank"]


@query("rerank", f"SELECT {', '.join(_SHOWN)} FROM ({RERANK_SQL})")
def rerank(spark, sf_dir):
    return reranked(spark, sf_dir).select(*_SHOWN)


GATE_SQL = f"""SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ({RERANK_SQL})) WHERE new_rank = 1 OR score >= greatest(0.2, round(best * 0.42, 8)) OR greatest(lexical_score, title_score) >= 0.24"""


@query("confidence_gate", f"SELECT {', '.join(_SHOWN)} FROM ({GATE_SQL})")
def confidence_gate(spark, sf_dir):
    return retrieval.confidence_gate(reranked(spark, sf_dir)).select(*_SHOWN)


@query(
    "low_confidence",
    f"""SELECT b.item_id AS query_id, coalesce(g.top < 0.34 OR round(g.lexical, 6) < 0.14, true) AS low_confidence FROM benchmark b LEFT JOIN (
    SELECT query_id, max(score) AS top, avg(lexical_score) FILTER (new_rank <= 3) AS lexical FROM ({GATE_SQL}) GROUP BY query_id) g ON g.query_id = b.item_id""",
)
def low_confidence(spark, sf_dir):
    return retrieval.low_confidence(search_queries(spark, sf_dir), retrieval.confidence_gate(reranked(spark, sf_dir)))


_TITLE_WORDS = rf"regexp_extract_all(lower(title), '[\p{{L}}\p{{M}}\p{{N}}]+')"


@query("title_filter_search", _top_sql(_sparse_sql(f"doc_id IN (SELECT doc_id FROM ({TITLES_SQL}) WHERE list_has_all({_TITLE_WORDS}, ['the', 'and']))"), K))
def title_filter_search(spark, sf_dir):
    """Sparse search among the documents whose title has two words, by the index of titles."""
    return title_search(spark, sf_dir, "And THE", phrase=False)


@query("title_phrase_search", _top_sql(_sparse_sql(f"doc_id IN (SELECT doc_id FROM ({TITLES_SQL}) WHERE contains(' ' || array_to_string({_TITLE_WORDS}, ' ') || ' ', ' of the '))"), K))
def title_phrase_search(spark, sf_dir):
    return title_search(spark, sf_dir, "of the", phrase=True)


def title_search(spark: SparkSession, sf_dir: str, words: str, phrase: bool) -> DataFrame:
    within = search.held_to(index_of(spark, sf_dir), words, phrase).withColumnRenamed("chunk_id", "doc_id")
    return retrieval.top_k(sparse(spark, sf_dir, within), K, "doc_id")


@query("incremental_search", _top_sql(SPARSE_SQL, K))
def incremental_search(spark, sf_dir):
    """Search in an index of three writes, the later ones with what the earlier ones had wrong or too much: the same as in one built at once."""
    key = (spark.sparkContext.applicationId, f"increments of {sf_dir}")
    if key not in _indexes:
        path = shared_path(spark, f"increments-{uuid.uuid4().hex}")
        final = search_chunks(spark, sf_dir).withColumn("chunk_index", F.lit(0)).withColumn("char_len", F.length("text"))
        early = final.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("an earlier state "), "text")).otherwise(F.col("text")))
        extra = early.filter("doc_id % 10 = 0").withColumn("chunk_id", F.concat(F.lit("old "), F.col("chunk_id").cast("string")))
        increments.upsert(spark, path, early.filter("doc_id % 3 = 0").withColumn("chunk_id", F.col("chunk_id").cast("string")).unionByName(extra))
        increments.upsert(spark, path, early.filter("doc_id % 3 = 1"))
        increments.upsert(spark, path, final.filter("doc_id % 3 = 2 OR doc_id % 4 = 0"), removed=extra.select("chunk_id"))
        _indexes[key] = path
    index = increments.read_index(spark, _indexes[key])
    q = retrieval.postings(search_queries(spark, sf_dir), "query_id", "query")
    scored = retrieval.sparse_scores_of(q, search.touched(index["postings"], q), index["idf"])
    return retrieval.top_k(scored.select("query_id", F.col("chunk_id").cast("long").alias("doc_id"), "score"), K, "doc_id")


@query(
    "incremental_documents",
    "SELECT source AS journal_id, count(DISTINCT doc_id) AS documents, true AS estimate_is_close FROM documents GROUP BY source",
)
def incremental_documents(spark, sf_dir):
    """Documents of each journal, exactly from the chunks, and whether the estimate from the writes' sketches, which read no chunk, is within two per cent (or one) of it."""
    incremental_search(spark, sf_dir)
    path = _indexes[(spark.sparkContext.applicationId, f"increments of {sf_dir}")]
    exact = increments.read_index(spark, path)["chunks"].groupBy("journal_id").agg(F.count_distinct("doc_id").alias("documents"))
    about = increments.document_estimates(spark, path).withColumnRenamed("documents", "estimate")
    close = F.abs(F.col("estimate") - F.col("documents")) <= F.greatest(F.lit(1.0), F.col("documents") * 0.02)
    return exact.join(about, "journal_id", "left").select("journal_id", "documents", F.coalesce(close, F.lit(False)).alias("estimate_is_close"))


def chunk_index(spark: SparkSession, sf_dir: str) -> dict:
    """The index of the documents' chunks, with cells of vectors: what the ingest makes of them, built at the first use in an application."""
    key = (spark.sparkContext.applicationId, f"chunks of {sf_dir}")
    if key not in _indexes:
        path = shared_path(spark, f"chunks-{uuid.uuid4().hex}")
        docs = documents(spark, sf_dir)
        chunks = chunking.chunk_documents(docs).drop("embed_text").join(docs.select("doc_id", F.col("source").alias("journal_id")), "doc_id")
        search.write_index(chunks, path, ann=True)
        _indexes[key] = path
    return search.read_index(spark, _indexes[key], ann=True)


@query("chunk_search")
def chunk_search(spark, sf_dir):
    """Hybrid search of chunks, one result a document; whole documents are chunked, indexed and searched."""
    found, _ = search.search_articles(chunk_index(spark, sf_dir), search_queries(spark, sf_dir), 5, "hybrid")
    return found.select("query_id", "position", "doc_id", "chunk_id", "section", "chunk_index", "score")


@query("chunk_passages")
def chunk_passages(spark, sf_dir):
    """The best passages of the document with the most chunks."""
    index = chunk_index(spark, sf_dir)
    longest = index["chunks"].groupBy("doc_id").count().orderBy(F.desc("count"), "doc_id").first()
    found = search.passages(index, search_queries(spark, sf_dir), longest["doc_id"], 5, "sparse")
    return found.select("query_id", "position", "doc_id", "chunk_id", "score")


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks with a made-up score that ties often: many chunks per document."""
    rows = lines.split_lines(documents(spark, sf_dir), "source", "lang").filter("line != ''")
    score = F.round((F.length("line") % 97) / 97, 4)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"), F.asc("line_no"))
    rows = rows.withColumn("score", score).withColumn("query_id", F.floor(F.col("doc_id") / 100)).withColumn("chunk_id", X.chunk_id("doc_id", F.col("line_no")))
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("section", F.substring("line", 1, 40))


_HITS = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, line_no) AS rank FROM (
SELECT doc_id, line_no, source, lang, line, round((length(line) % 97) / 97.0::DOUBLE, 4) AS score, doc_id // 100 AS query_id, format('{{}}_chunk_{{:03d}}', doc_id, line_no) AS chunk_id, substr(line, 1, 40) AS section
FROM (SELECT doc_id, source, lang, line_no, {S.strip('line')} AS line FROM ({S.LINES})) WHERE line != '')"""


@query(
    "dedup_per_doc",
    f"""SELECT query_id, doc_id, chunk_id, rank, doc_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS doc_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS k FROM ({_HITS})) WHERE k = 1) WHERE doc_rank <= {K}""",
)
def dedup_per_doc(spark, sf_dir):
    return retrieval.dedup_per_document(line_hits(spark, sf_dir), K).select("query_id", "doc_id", "chunk_id", "rank", "doc_rank")


@query(
    "facets",
    f"""SELECT query_id, facet, value, n, row_number() OVER (PARTITION BY query_id, facet ORDER BY n DESC, first_rank, value) AS position FROM (SELECT query_id, facet, value, count(*) AS n, min(rank) AS first_rank FROM (
    SELECT query_id, 'section' AS facet, trim(section) AS value, rank FROM ({RERANK_SQL}) UNION ALL SELECT query_id, 'journal_id', trim(journal_id), rank FROM ({RERANK_SQL})) WHERE value != '' GROUP BY query_id, facet, value)""",
)
def facets(spark, sf_dir):
    return retrieval.facets(candidates(spark, sf_dir), ["section", "journal_id"])


@query(
    "suggestions",
    rf"""SELECT query_id, position, suggestion FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, lower(suggestion) ORDER BY rank) AS k FROM (SELECT query_id, rank, CASE WHEN length(t) <= 80 THEN t ELSE
      CASE WHEN strpos(h, ' ') > 0 AND length(h) - strpos(reverse(h), ' ') > 0 THEN substr(h, 1, length(h) - strpos(reverse(h), ' ')) ELSE h END || '…' END AS suggestion
      FROM (SELECT query_id, rank, trim(title) AS t, substr(trim(title), 1, 80) AS h FROM ({RERANK_SQL})) WHERE t != '')) WHERE k = 1) WHERE position <= 3""",
)
def suggestions(spark, sf_dir):
    return retrieval.suggestions(candidates(spark, sf_dir))


@query(
    "multi_query_merge",
    f"""SELECT parent_id, chunk_id, sub_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, chunk_id::VARCHAR) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY parent_id, chunk_id ORDER BY score DESC, sub_id) AS k FROM (SELECT query_id // 4 AS parent_id, query_id AS sub_id, doc_id AS chunk_id, score FROM ({_top_sql(SPARSE_SQL, K)}))) WHERE k = 1) WHERE rank <= 18""",
)
def multi_query_merge(spark, sf_dir):
    top = retrieval.top_k(sparse(spark, sf_dir), K, "doc_id")
    rows = top.select(F.floor(F.col("query_id") / 4).alias("parent_id"), F.col("query_id").alias("sub_id"), F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", F.lit("").alias("section"), "score")
    return evidence.merge_queries(rows, 18).select("parent_id", F.col("chunk_id").cast("long").alias("chunk_id"), "sub_id", "score", "rank")


@query(
    "best_sources",
    f"""SELECT query_id, doc_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS source_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, rank) AS k FROM ({_HITS})) WHERE k = 1""",
)
def best_sources(spark, sf_dir):
    return evidence.best_sources(line_hits(spark, sf_dir)).select("query_id", "doc_id", "chunk_id", "score", "source_rank")


DOC_RANK_SQL = f"""SELECT query_id, doc_id, best_chunk, aggregate, row_number() OVER (PARTITION BY query_id ORDER BY aggregate DESC, doc_id) AS doc_rank FROM (
SELECT query_id, doc_id, arg_min(chunk_id, k) AS best_chunk, round(0.55::DOUBLE * max(score) + 0.25::DOUBLE * avg(score) FILTER (k <= 3) + 0.15::DOUBLE * least(count(DISTINCT bucket), 4) / 4 + CASE WHEN doc_id % 5 = 0 THEN 0.05::DOUBLE ELSE 0 END, 6) AS aggregate
FROM (SELECT *, {S.section_bucket('section')} AS bucket, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS k FROM ({_HITS})) GROUP BY query_id, doc_id)"""


@query("document_ranking", f"SELECT * FROM ({DOC_RANK_SQL}) WHERE doc_rank <= 5")
def document_ranking(spark, sf_dir):
    hits = line_hits(spark, sf_dir)
    seeds = hits.filter("doc_id % 5 = 0").select("query_id", "doc_id")
    return evidence.rank_documents(hits, seeds, 5)


_KIND = f"(SELECT *, CASE line_no % 4 WHEN 0 THEN 'results ' ELSE '' END || CASE line_no % 3 WHEN 0 THEN 'methods' WHEN 1 THEN 'discussion' ELSE section END AS label FROM ({_HITS}))"
_ORDER = "[" + ", ".join(S.lit(b) for b in P.BUCKET_ORDER) + "]"


@query(
    "diverse_chunks",
    f"""WITH b AS (SELECT *, {S.section_bucket('label')} AS bucket, line_no = 1 AS preferred FROM {_KIND}),
    p AS (SELECT *, max(CASE WHEN preferred THEN bucket END) OVER (PARTITION BY query_id, doc_id) AS pb, row_number() OVER (PARTITION BY query_id, doc_id, bucket ORDER BY score DESC, chunk_id) AS ik FROM b),
    g AS (SELECT *, CASE WHEN preferred THEN 0 WHEN ik = 1 AND NOT coalesce(bucket = pb, false) THEN 1 ELSE 2 END AS grp FROM p)
    SELECT query_id, doc_id, chunk_id, bucket, pick FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY grp, CASE WHEN grp = 1 THEN list_position({_ORDER}, bucket) ELSE 0 END, score DESC, chunk_id) AS pick FROM g) WHERE pick <= 4""",
)
def diverse_chunks(spark, sf_dir):
    hits = line_hits(spark, sf_dir)
    label = F.concat(F.when(F.col("line_no") % 4 == 0, "results ").otherwise(""), F.when(F.col("line_no") % 3 == 0, "methods").when(F.col("line_no") % 3 == 1, "discussion").otherwise(F.col("section")))
    rows = hits.withColumn("section", label).withColumn("preferred", F.col("line_no") == 1)
    return evidence.diverse_chunks(rows, 4).select("query_id", "doc_id", "chunk_id", "bucket", "pick")


@query("point_lookup", "SELECT (doc_id * 7) % 1000 AS pos, doc_id, lang FROM documents WHERE doc_id % 37 = 0")
def point_lookup(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "doc_id", "lang")
    ids = docs.filter("doc_id % 37 = 0").select("chunk_id", (F.col("doc_id") * 7 % 1000).alias("pos")).unionByName(spark.createDataFrame([(-1, 0)], "chunk_id long, pos long"))
    return retrieval.lookup(ids, docs).select("pos", "doc_id", "lang")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search: sparse retrieval, re-ranking, confidence gate, one result a document."""
    gated = retrieval.confidence_gate(reranked(spark, sf_dir))
    return retrieval.dedup_per_document(gated, K, "new_rank").select("query_id", "doc_rank", "doc_id", "title", "score", "lexical_score")


query("search_results", f"""SELECT query_id, doc_rank, doc_id, title, score, lexical_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new_rank) AS doc_rank FROM ({GATE_SQL})) WHERE doc_rank <= {K}""")(flagship)
