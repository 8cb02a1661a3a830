"""Queries over the text of documents: lines, titles, tokens, ingest bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import display
from lexmill.functions import patterns as P
from lexmill.functions import text as X
from lexmill.operators import chunking, lines, retrieval
from lexmill.plans import sql as S
from lexmill.plans.registry import query
from lexmill.sources import articles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_STRIPPED = f"SELECT doc_id, line_no, {S.strip('line')} AS line, length(line) AS raw_chars FROM ({S.LINES})"
_CLASS = f"""CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, {S.lit(P.PAGE_NUMBER)}) THEN 'page_number' WHEN {S.matches('line', P.REFERENCE_HEADER)} THEN 'reference_header'
WHEN length(line) < 5 OR {S.matches('line', P.BOILERPLATE)} THEN 'boilerplate'
WHEN {S.matches('line', P.SECTION_HEADER)} OR (length(line) < 60 AND regexp_matches(line, {S.lit(P.HEADING_LIKE)})) THEN 'section_header' ELSE 'text' END"""
CLASSED_SQL = f"SELECT doc_id, line_no, line, raw_chars, {_CLASS} AS class FROM ({_STRIPPED})"
LINES_SQL = rf"""
SELECT doc_id, line_no, class, in_references,
  coalesce(last_value(CASE WHEN class = 'section_header' AND NOT in_references THEN regexp_replace(line, '[:\s]+$', '') END IGNORE NULLS) OVER w, '') AS section,
  coalesce(sum(raw_chars + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_offset
FROM (SELECT *, max(CASE WHEN class = 'reference_header' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) = 1 AS in_references FROM ({CLASSED_SQL}))
WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)
"""


@query("line_classes", f"SELECT class, count(*) AS n FROM ({CLASSED_SQL}) GROUP BY class")
def line_classes(spark, sf_dir):
    rows = lines.split_lines(documents(spark, sf_dir))
    return rows.groupBy(lines.line_class(F.col("line")).alias("class")).agg(F.count("*").alias("n"))


@query("line_sections", LINES_SQL)
def line_sections(spark, sf_dir):
    return lines.classify(documents(spark, sf_dir)).select("doc_id", "line_no", "class", "in_references", "section", "char_offset")


TITLES_SQL = rf"""
SELECT d.doc_id, coalesce(t.line, '') AS title FROM documents d LEFT JOIN (
  SELECT doc_id, line FROM (
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY round(
      CASE WHEN line_no < 5 THEN 1.2 ELSE 0 END + CASE WHEN length(line) BETWEEN 20 AND 140 THEN 1.4 WHEN length(line) BETWEEN 12 AND 180 THEN 0.8 ELSE 0 END
      + CASE WHEN len(regexp_split_to_array(line, {S.lit(f'[{P.SPACE}]+')})) BETWEEN 4 AND 18 THEN 0.6 ELSE 0 END - CASE WHEN regexp_matches(line, '[.:؛،]$') THEN 0.4 ELSE 0 END
      - CASE WHEN regexp_matches(line, {S.lit(f'[{P.DIGIT}]')}) THEN 0.25 ELSE 0 END, 4) DESC, line_no) AS k
    FROM ({CLASSED_SQL}) WHERE line_no < 20 AND length(line) >= 10 AND class IN ('text', 'reference_header') AND NOT {S.matches('line', P.AUTHOR_LINE)})
  WHERE k = 1) t ON t.doc_id = d.doc_id
"""


@query("doc_titles", TITLES_SQL)
def doc_titles(spark, sf_dir):
    return lines.titles(documents(spark, sf_dir))


@query("short_doc_rejects", rf"SELECT doc_id, length({S.strip('text')}) AS n FROM documents WHERE length({S.strip('text')}) < 100")
def short_doc_rejects(spark, sf_dir):
    return articles.rejected(documents(spark, sf_dir), "text").select("doc_id", F.length(X.strip("text")).alias("n"))


@query(
    "sentence_stats",
    rf"""SELECT doc_id, len(s) AS n_sentences, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (
    SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?؟。])[{P.SPACE}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x != '') AS s FROM documents)""",
)
def sentence_stats(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", X.sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_sentences"), F.array_max(F.transform("s", F.length)).alias("longest"))


@query("chunks")
def chunks(spark, sf_dir):
    return chunking.chunk_documents(documents(spark, sf_dir))


@query("chunk_size_report")
def chunk_size_report(spark, sf_dir):
    return chunking.size_report(chunking.chunk_documents(documents(spark, sf_dir)))


POSTINGS_SQL = f"""
SELECT doc_id, bucket, count(*) / any_value(n)::DOUBLE AS tf FROM (
  SELECT doc_id, {S.bucket('token')} AS bucket, n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS token FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)))
GROUP BY doc_id, bucket
"""


@query("token_tf", f"SELECT doc_id, bucket, round(tf, 8) AS tf FROM ({POSTINGS_SQL})")
def token_tf(spark, sf_dir):
    return retrieval.postings(documents(spark, sf_dir), "doc_id").select("doc_id", "bucket", F.round("tf", 8).alias("tf"))


IDF_SQL = f"SELECT bucket, n, ln(1 + (N_ALL - n + 0.5) / (n + 0.5)) AS idf FROM (SELECT bucket, count(*) AS n FROM ({POSTINGS_SQL}) GROUP BY bucket), (SELECT count(*) AS N_ALL FROM documents)"


@query("doc_freq_idf", f"SELECT bucket, n, round(idf, 8) AS idf FROM ({IDF_SQL})")
def doc_freq_idf(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = retrieval.document_frequency(retrieval.postings(docs, "doc_id"), docs.count())
    return found.select("bucket", "n", F.round("idf", 8).alias("idf"))


@query("paragraph_dedup", "SELECT min(doc_id) AS doc_id, md5(substr(text, 1, 1024)) AS phash FROM documents GROUP BY md5(substr(text, 1, 1024))")
def paragraph_dedup(spark, sf_dir):
    return articles.unseen_paragraphs(documents(spark, sf_dir), None, "doc_id").select("doc_id", "phash")


@query("resume_antijoin", "SELECT doc_id, sha1(text) AS sha1 FROM documents WHERE NOT (doc_id % 3 = 0 AND lang != 'fr')")
def resume_antijoin(spark, sf_dir):
    """A second run: every third document is in the state, but French ones with another content."""
    files = documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha1(F.col("text").cast("binary")).alias("sha1"), "lang")
    state = files.filter("doc_id % 3 = 0").select("path", F.when(F.col("lang") == "fr", F.md5("sha1")).otherwise(F.col("sha1")).alias("sha1"))
    return articles.unseen_files(files, state).select("doc_id", "sha1")


@query(
    "dry_run_stats",
    r"""WITH d AS (SELECT *, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100 AS ok, md5(substr(text, 1, 1024)) AS h FROM documents)
    SELECT count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS unchanged, count(*) FILTER (doc_id % 3 != 0 AND NOT ok) AS rejected, count(*) FILTER (doc_id % 3 != 0 AND ok) AS fresh,
    count(DISTINCT CASE WHEN doc_id % 3 != 0 AND ok THEN h END) AS unique_paragraphs FROM d""",
)
def dry_run_stats(spark, sf_dir):
    rows = documents(spark, sf_dir).select((F.col("doc_id") % 3 == 0).alias("old"), (F.length(X.strip("text")) >= articles.LEAST_CHARS).alias("ok"), F.md5(F.substring("text", 1, 1024).cast("binary")).alias("h"))
    new = ~F.col("old")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if("old").alias("unchanged"),
        F.count_if(new & ~F.col("ok")).alias("rejected"),
        F.count_if(new & F.col("ok")).alias("fresh"),
        F.count_distinct(F.when(new & F.col("ok"), F.col("h"))).alias("unique_paragraphs"),
    )


@query("corpus_stats", "SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS journals, sum(length(text))::BIGINT AS chars FROM documents")
def corpus_stats(spark, sf_dir):
    return documents(spark, sf_dir).agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("source").alias("journals"), F.sum(F.length("text")).alias("chars"))


@query(
    "article_page",
    """SELECT doc_id, length(text) AS total_chars, substr(text, 1001, 1500) AS content, 1000 + 1500 < length(text) AS truncated FROM documents""",
)
def article_page(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.length("text").alias("total_chars"), F.substring("text", 1001, 1500).alias("content"), (F.length("text") > 2500).alias("truncated"))


@query(
    "path_metadata",
    """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN format('{:04d}-{:03d}-{:03d}-{:03d}', doc_id % 7, doc_id % 11, doc_id % 13, doc_id % 1000) ELSE doc_id::VARCHAR || '-x' END AS id FROM documents)
    SELECT doc_id, id, CASE WHEN doc_id % 4 = 0 THEN string_split(id, '-')[1] END AS journal_id, CASE WHEN doc_id % 4 = 0 THEN string_split(id, '-')[4] END AS article_num, doc_id % 4 = 0 AS valid FROM x""",
)
def path_metadata(spark, sf_dir):
    made = F.when(F.col("doc_id") % 4 == 0, F.format_string("%04d-%03d-%03d-%03d", F.col("doc_id") % 7, F.col("doc_id") % 11, F.col("doc_id") % 13, F.col("doc_id") % 1000)).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit("-x")))
    rows = documents(spark, sf_dir).select("doc_id", made.alias("id")).withColumn("m", articles.path_metadata("id"))
    return rows.select("doc_id", "id", "m.journal_id", "m.article_num", articles.valid_doc_id("id").alias("valid"))


@query("point_ids", "SELECT doc_id, md5(format('{}_chunk_{:03d}', doc_id, doc_id % 1500)) AS point_id FROM documents")
def point_ids(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", articles.point_id(X.chunk_id("doc_id", F.col("doc_id") % 1500)).alias("point_id"))


@query(
    "snippets",
    r"""SELECT doc_id, CASE WHEN length(text) <= 700 THEN text ELSE CASE WHEN strpos(h, ' ') > 0 AND length(h) - strpos(reverse(h), ' ') > 350 THEN substr(h, 1, length(h) - strpos(reverse(h), ' ')) ELSE h END || '…' END AS snippet
    FROM (SELECT doc_id, text, substr(text, 1, 700) AS h FROM documents)""",
)
def snippets(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.cut_at_space("text", 700, 350).alias("snippet"))


@query("citation_norms", f"SELECT doc_id, md5({S.normalize_citation('text')}) AS spaced, md5({S.normalize_citation('text', '')}) AS joined, md5({S.normalize_search('text')}) AS search FROM documents")
def citation_norms(spark, sf_dir):
    as_md5 = lambda c: F.md5(c.cast("binary"))
    return documents(spark, sf_dir).select("doc_id", as_md5(X.normalize_citation("text")).alias("spaced"), as_md5(X.normalize_citation("text", "")).alias("joined"), as_md5(X.normalize_search("text")).alias("search"))


@query(
    "reading_stats",
    r"SELECT doc_id, len(w) AS n_words, greatest(1, floor(len(w) / 180.0::DOUBLE + 0.5::DOUBLE))::BIGINT AS minutes FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x != '') AS w FROM documents)",
)
def reading_stats(spark, sf_dir):
    n, minutes = display.reading_stats("text")
    return documents(spark, sf_dir).select("doc_id", n.alias("n_words"), minutes.alias("minutes"))


@query("section_buckets", f"SELECT bucket, count(*) AS n FROM (SELECT {S.section_bucket('line')} AS bucket FROM ({_STRIPPED})) GROUP BY bucket")
def section_buckets(spark, sf_dir):
    return lines.split_lines(documents(spark, sf_dir)).groupBy(X.section_bucket("line").alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "seeded_sample",
    r"""SELECT doc_id, md5('42' || doc_id) AS ticket FROM documents WHERE length(text) >= 500 AND len(regexp_split_to_array(trim(text), '\s+')) >= 30 ORDER BY ticket LIMIT 50""",
)
def seeded_sample(spark, sf_dir):
    """A sampling operator: the 50 first documents of a shuffle by seed."""
    rows = documents(spark, sf_dir).filter((F.length("text") >= 500) & (F.size(F.split(F.trim("text"), r"\s+")) >= 30))
    return rows.select("doc_id", F.md5(F.concat(F.lit("42"), F.col("doc_id").cast("string")).cast("binary")).alias("ticket")).orderBy("ticket").limit(50)
