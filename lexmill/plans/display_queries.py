"""Queries for what a user is shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import display
from lexmill.functions import patterns as P
from lexmill.functions import text as X
from lexmill.operators import conversations
from lexmill.plans import sql as S
from lexmill.plans.corpus_queries import documents, table
from lexmill.plans.registry import query
from lexmill.plans.search_queries import _HITS, line_hits


@query("text_direction", f"SELECT doc_id, CASE WHEN regexp_matches(regexp_extract(text, '[A-Za-z{P.RIGHT_TO_LEFT}]'), '^[A-Za-z]') THEN 'ltr' ELSE 'rtl' END AS direction FROM documents")
def text_direction(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.text_direction("text").alias("direction"))


@query("highlight_terms", r"SELECT doc_id, md5(regexp_replace(text, '(?i)(the|que|und)', '<mark>\1</mark>', 'g')) AS marked FROM documents")
def highlight_terms(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(display.highlight("text", "the que und a").cast("binary")).alias("marked"))


@query("title_slugs", rf"SELECT doc_id, line_no, 'syn-' || regexp_replace(regexp_replace({S.strip('line')}, '\s+', '-', 'g'), '[^\p{{L}}\p{{N}}-]', '', 'g') AS slug FROM ({_HITS})")
def title_slugs(spark, sf_dir):
    return line_hits(spark, sf_dir).select("doc_id", "line_no", display.slug("line").alias("slug"))


_HEADING = r"^[\p{L}\p{N}][^\r\n]{0,59}$"


@query(
    "outline",
    rf"""SELECT doc_id, list(slug ORDER BY line_no) AS ids, list(title ORDER BY line_no) AS titles FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY line_no) AS k FROM (
      SELECT doc_id, line_no, {S.strip('line')} AS title, 'syn-' || regexp_replace(regexp_replace({S.strip('line')}, '\s+', '-', 'g'), '[^\p{{L}}\p{{N}}-]', '', 'g') AS slug FROM ({S.LINES}) WHERE regexp_matches(line, '{_HEADING}')))
    WHERE k = 1 GROUP BY doc_id""",
)
def outline(spark, sf_dir):
    """Short lines as headings of a markdown text in a fence; headings with one id are one."""
    made = F.concat(F.lit("```markdown\n"), F.regexp_replace("text", f"(?m){_HEADING}", "### $0"), F.lit("\n```"))
    found = documents(spark, sf_dir).select("doc_id", display.outline(display.without_fence(made)).alias("o")).filter("size(o) > 0")
    return found.select("doc_id", F.col("o.id").alias("ids"), F.col("o.title").alias("titles"))


@query("score_bars", f"SELECT query_id, chunk_id, CASE WHEN max(score) OVER w > 0 THEN round(least(100.0, score / max(score) OVER w * 100), 4) ELSE 0 END AS bar FROM ({_HITS}) WINDOW w AS (PARTITION BY query_id)")
def score_bars(spark, sf_dir):
    return display.score_bar(line_hits(spark, sf_dir)).select("query_id", "chunk_id", "bar")


@query("cited_first", f"SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN line_no = 2 THEN 0 ELSE 1 END, rank) AS position FROM ({_HITS})")
def cited_first(spark, sf_dir):
    rows = line_hits(spark, sf_dir).withColumn("cited", F.col("line_no") == 2)
    return display.cited_first(rows, "query_id", "rank", "cited").select("query_id", "chunk_id", "position")


@query("stacked_cards", f"SELECT query_id, chunk_id, depth FROM (SELECT *, ((rank - 1 - 3) % n + n) % n AS depth FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ({_HITS}))) WHERE depth < 4")
def stacked_cards(spark, sf_dir):
    return display.stacked_cards(line_hits(spark, sf_dir), "query_id", "rank", 3).select("query_id", "chunk_id", "depth")


@query(
    "context_blocks",
    f"""SELECT doc_id, md5(string_agg('[' || k || '] ' || source || CASE WHEN section != '' THEN ' — ' || section ELSE '' END || chr(10) || substr(line, 1, 1800), chr(10) || chr(10) ORDER BY k)) AS context
    FROM (SELECT *, line_no + 1 AS k FROM ({_HITS})) GROUP BY doc_id""",
)
def context_blocks(spark, sf_dir):
    rows = line_hits(spark, sf_dir).select("doc_id", (F.col("line_no") + 1).alias("k"), F.col("source").alias("title"), "section", F.col("line").alias("text"))
    return display.context_blocks(rows, "doc_id", "k").select("doc_id", F.md5(F.col("context").cast("binary")).alias("context"))


@query("conversation_filter", "SELECT conv_id FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user' AND conv_id % 3 != 0) AS title FROM conversations GROUP BY conv_id) WHERE contains(lower(coalesce(title, 'New conversation')), 'on')")
def conversation_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    title = F.min_by(F.when((F.col("role") == "user") & (F.col("conv_id") % 3 != 0), F.col("text")), F.when((F.col("role") == "user") & (F.col("conv_id") % 3 != 0), F.col("turn"))).alias("title")
    return conversations.title_filter(rows.groupBy("conv_id").agg(title), " ON ").select("conv_id")
