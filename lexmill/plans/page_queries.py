"""Queries from words found in a document to boxes on its pages.

Documents are laid out as a layout service returns them: lines of LINE words, pages of PAGE words, boxes in inches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import citations
from lexmill.plans import sql as S
from lexmill.plans.corpus_queries import documents
from lexmill.plans.registry import query
from lexmill.sources import articles

LINE, PAGE = 12, 240
TERMS = ["th", "on"]
TERM = "que"


def laid_out(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, columns carried along, and pages, of the schema that article files have; a page's lines come from the last to the first."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    # generated, so that the optimizer doesn't put the split into the lambdas, once a word
    rows = docs.select("doc_id", *carry, F.explode(F.array(words)).alias("w")).filter("size(w) > 0")

    def polygon(left, top, width):
        right, bottom = left + width, top + 0.25
        return F.array(left, top, right, top, right, bottom, left, bottom)

    def word(content, i):
        left = 0.25 + (i % LINE) * 0.5
        return F.struct(content.alias("content"), polygon(left, 0.25 + F.floor(i / LINE) * 0.5, F.lit(0.375)).alias("polygon"), F.lit(1.0).alias("confidence"))

    def line(own, k):
        return F.struct(F.array_join(F.slice(own, k * LINE + 1, LINE), " ").alias("content"), polygon(F.lit(0.25), 0.25 + k * 0.5, F.lit(5.875)).alias("polygon"))

    def page(p):
        own = F.slice("w", p * PAGE + 1, PAGE)
        lines = F.transform(F.reverse(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / LINE).cast("int"))), lambda k: line(own, k))
        return F.struct((p + 1).alias("pageNumber"), F.lit(8.0).alias("width"), F.lit(11.0).alias("height"), F.lit("inch").alias("unit"), F.lit(0.0).alias("angle"), F.transform(own, word).alias("words"), lines.alias("lines"))

    return rows.select("doc_id", *carry, F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / PAGE).cast("int")), page).alias("pages"))


def found_words(docs: DataFrame) -> DataFrame:
    """doc_id, word_index of all words in a match of TERMS or of TERM."""

    def of(terms: list[str]) -> DataFrame:
        starts = citations.find_in_document(docs, terms).select("doc_id", F.explode("starts").alias("start"))
        return starts.select("doc_id", F.explode(F.sequence("start", F.col("start") + len(terms) - 1)).alias("word_index"))

    return articles.matched_words(of(TERMS), of([TERM]))


_FITS = f"list_filter(range(0, greatest(len(w) - 1, 0)), lambda i: contains(w[i + 1], '{TERMS[0]}') AND contains(w[i + 2], '{TERMS[1]}'))"
_STARTS = f"list_reduce(list_concat([[]::BIGINT[]], list_transform({_FITS}, lambda i: [i])), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] >= acc[-1] + 2 THEN list_concat(acc, x) ELSE acc END)"
_WORDS = f"SELECT doc_id, {S.words('text')} AS w FROM documents"
_FOUND = f"""SELECT DISTINCT doc_id, i FROM (
  SELECT doc_id, unnest(list_concat({_STARTS}, list_transform({_STARTS}, lambda s: s + 1), list_filter(range(0, len(w)), lambda i: contains(w[i + 1], '{TERM}')))) AS i FROM ({_WORDS}))"""


@query(
    "citation_boxes",
    f"""SELECT doc_id, page, region, (0.25 + min(i % {LINE}) * 0.5)::DOUBLE * 200 - 3 AS "left", (0.25 + min(i % {PAGE} // {LINE}) * 0.5)::DOUBLE * 200 - 3 AS top,
    (0.625 + max(i % {LINE}) * 0.5)::DOUBLE * 200 + 3 AS "right", (0.5 + min(i % {PAGE} // {LINE}) * 0.5)::DOUBLE * 200 + 3 AS bottom, count(*)::INT AS n_words
    FROM (SELECT *, (sum(first) OVER (PARTITION BY doc_id, page ORDER BY i) - 1)::INT AS region FROM (
      SELECT doc_id, i, (i // {PAGE} + 1)::INT AS page, CASE WHEN i % {LINE} = 0 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM i - 1 THEN 1 ELSE 0 END AS first FROM ({_FOUND})))
    GROUP BY doc_id, page, region""",
)
def citation_boxes(spark, sf_dir):
    """What is marked on the pages of a document that is searched for several phrases."""
    docs = documents(spark, sf_dir)
    # texts meet the places of matches before they are laid out; documents without one have no boxes
    hits = found_words(docs).groupBy("doc_id").agg(F.collect_list("word_index").alias("hits"))
    # a layout is far larger than its text, so texts aren't put together in fewer tasks for being small
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = articles.matched_pages(laid_out(docs.repartition(n, "doc_id").join(hits, "doc_id"), "hits"))
    return articles.regions_of(pages).select("doc_id", "page", "region", "left", "top", "right", "bottom", "n_words")


@query(
    "pages_shown",
    f"""WITH f AS ({_FOUND}), p AS (SELECT doc_id, unnest(range(0, (len(w) - 1) // {PAGE} + 1)) AS p FROM ({_WORDS}) WHERE len(w) > 0)
    SELECT doc_id, (p + 1)::INT AS page FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = p.doc_id) OR EXISTS (SELECT 1 FROM f WHERE f.doc_id = p.doc_id AND f.i // {PAGE} = p.p)""",
)
def pages_shown(spark, sf_dir):
    """The pages with a match, or all pages of documents without one."""
    docs = documents(spark, sf_dir)
    layout = laid_out(docs)
    pages = layout.select("doc_id", F.explode("pages.pageNumber").alias("page"))
    return articles.pages_to_show(pages, articles.page_words(layout), found_words(docs))


@query(
    "page_lines",
    rf"""SELECT doc_id, (k // {PAGE // LINE} + 1)::INT AS page, (k % {PAGE // LINE} + 1)::INT AS line_no, md5(array_to_string(w[k * {LINE} + 1:k * {LINE} + {LINE}], ' ')) AS content
    FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // {LINE} + 1)) AS k FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x != '') AS w FROM documents) WHERE len(w) > 0)""",
)
def page_lines(spark, sf_dir):
    """Lines from top to bottom, whatever their order in the file."""
    return articles.page_lines(laid_out(documents(spark, sf_dir))).select("doc_id", "page", "line_no", F.md5(F.col("content").cast("binary")).alias("content"))
