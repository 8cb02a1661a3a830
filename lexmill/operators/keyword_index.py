"""Indexes of a search index's fields: title words with their places, and whole values of keyword fields.

Both are sorted tables, by word and by field and value, so that a filter reads the row groups of its words and nothing else. A filter gives documents or chunks, which a
search is held to before it ranks.

A word of a title is a run of letters, marks and digits, lower-cased. A filter of several words asks for all of them, in any order, or as a phrase for one after the other;
one without words asks for nothing. Null and empty titles and values are in no index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that are compared as a whole.
KEYWORDS = ("doc_id", "journal_id", "section")
WORD = r"[\p{L}\p{M}\p{N}]+"


def title_words(c: Column | str) -> Column:
    """The words of a title, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def write_keyword_index(chunks: DataFrame, path: str) -> None:
    """Write ``titles`` (word, doc_id, place) and ``keywords`` (field, value, chunk_id) of chunks (chunk_id, doc_id, title and keyword fields)."""
    titles = chunks.filter("title != ''").select("doc_id", "title").distinct()  # a document's chunks have one title
    words = titles.select("doc_id", F.posexplode(title_words("title")).alias("place", "word")).select("word", "doc_id", "place")
    words.repartitionByRange("word", "doc_id").sortWithinPartitions("word", "doc_id").write.mode("overwrite").parquet(f"{path}/titles")
    fields = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in KEYWORDS]
    values = chunks.select("chunk_id", F.explode(F.array(*fields)).alias("x")).select("x.field", "x.value", "chunk_id").filter("value != ''")
    values.repartitionByRange("field", "value", "chunk_id").sortWithinPartitions("field", "value").write.mode("overwrite").parquet(f"{path}/keywords")


def documents_with_title(titles: DataFrame, text: str, phrase: bool = False) -> DataFrame:
    """doc_id of the documents whose title has all words of ``text``, or has them as a phrase."""
    asked = [r[0] for r in titles.sparkSession.range(1).select(F.explode(title_words(F.lit(text)))).collect()]
    if not asked:
        return titles.select("doc_id").distinct()
    hits = titles.filter(F.col("word").isin(sorted(set(asked))))
    if not phrase:
        return hits.groupBy("doc_id").agg(F.count_distinct("word").alias("n")).filter(F.col("n") == len(set(asked))).select("doc_id")
    # each word says where a phrase that has it would start; all of them have to say so of one place
    at = [F.when(F.col("word") == w, F.struct(F.lit(k).alias("k"), (F.col("place") - k).alias("start"))) for k, w in enumerate(asked)]
    starts = hits.select("doc_id", F.explode(F.array_compact(F.array(*at))).alias("x"))
    return starts.groupBy("doc_id", "x.start").agg(F.count_distinct("x.k").alias("n")).filter(F.col("n") == len(asked)).select("doc_id").distinct()


def chunks_with_values(keywords: DataFrame, **equal: str | None) -> DataFrame | None:
    """chunk_id of the chunks that have all the values; None without a condition."""
    found = None
    for field, value in equal.items():
        if value:
            hits = keywords.filter((F.col("field") == field) & (F.col("value") == str(value))).select("chunk_id")
            found = hits if found is None else found.join(hits, "chunk_id", "left_semi")
    return found
