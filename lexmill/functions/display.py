"""Column functions for showing results: marks, slugs, outlines, context blocks, score bars, order of cards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import strip


def highlight(text: Column | str, query: str, mark: str = "mark") -> Column:
    """The text with the query's terms of two characters and more marked, whatever their case."""
    terms = [re.sub(r"([^\w\s])", r"\\\1", t) for t in query.split() if len(t) >= 2]
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, f"(?iu)({'|'.join(terms)})", f"<{mark}>$1</{mark}>") if terms else c


def slug(title: Column | str) -> Column:
    """The id of a heading: words joined by hyphens after a prefix, without other marks."""
    return F.concat(F.lit("syn-"), F.regexp_replace(F.regexp_replace(strip(title), r"\s+", "-"), r"[^\p{L}\p{N}-]", ""))


def outline(text: Column | str) -> Column:
    """Third-level headings (id, title) of a markdown text, in order; the first of those with one id."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^###[ \t]+(.+?)[ \t]*$"), F.lit(1)), lambda t: F.struct(slug(t).alias("id"), strip(t).alias("title")))
    ids = F.transform(found, lambda x: x["id"])
    return F.filter(found, lambda x, i: F.array_position(ids, x["id"]) == i + 1)


def reading_stats(text: Column | str) -> tuple[Column, Column]:
    """Words, and minutes to read them at 180 a minute, one at least."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return n, F.greatest(F.lit(1), F.floor(n / 180 + 0.5)).cast("long")


def without_fence(text: Column | str) -> Column:
    """A markdown text without the code fence around it."""
    return F.trim(F.regexp_replace(text, r"^\s*```(?:\w+)?\s*|\s*```\s*$", ""))


def rewrite_dialect(tokens: Column, table: dict[str, str]) -> Column:
    """Tokens with those in the table replaced."""
    if not table:
        return tokens
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(pairs, t), t))


def context_blocks(sources: DataFrame, by: str, rank: str, most: int = 1800) -> DataFrame:
    """One prompt text for each key: numbered blocks of title (the document's id where there is none), section and the first characters of each source, in rank order."""
    name = F.coalesce(F.nullif("title", F.lit("")), F.col("doc_id").cast("string"))
    head = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), name, F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" — "), F.col("section"))).otherwise(""))
    block = F.concat(head, F.lit("\n"), F.substring("text", 1, most))
    rows = sources.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))).alias("x"))
    return rows.select(by, F.array_join(F.transform("x", lambda v: v["b"]), "\n\n").alias("context"))


def source_block(number: Column, title: Column, section: Column, doc_id: Column, chunk_id: Column, chunk_index: Column, text: Column, most: int = 1500) -> Column:
    """A source in a synthesis prompt: numbered head with ids, then its text, cut with a mark."""
    clean = lambda c, n=None: F.coalesce(strip(c.cast("string")), F.lit("")) if n is None else _cut(F.coalesce(strip(c.cast("string")), F.lit("")), n)
    head = F.concat(F.lit("### م "), number.cast("string"), F.lit(": "), F.coalesce(F.nullif(clean(title, 80), F.lit("")), F.lit("Unknown")))
    head = F.concat(head, F.when(clean(section) != "", F.concat(F.lit(" — "), clean(section))).otherwise(""))
    ids = F.concat(F.lit(" [doc_id="), clean(doc_id), F.lit("; chunk_id="), clean(chunk_id), F.lit("; chunk="), chunk_index.cast("string"), F.lit("]"))
    return F.concat(head, ids, F.lit("\n"), clean(text, most), F.lit("\n"))


def _cut(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def document_share(n_documents: Column | int, budget: int = 400_000) -> Column:
    """Characters that each of several documents gets of a prompt's budget."""
    n = F.lit(n_documents) if isinstance(n_documents, int) else n_documents
    return F.floor(F.lit(budget) / F.greatest(n, F.lit(1)))


def score_bar(results: DataFrame, by: str = "query_id") -> DataFrame:
    """Adds bar: the score as a percentage of the best of its query."""
    top = F.max("score").over(Window.partitionBy(by))
    return results.withColumn("bar", F.when(top > 0, F.round(F.least(F.lit(100.0), F.col("score") / top * 100), 4)).otherwise(0.0))


def cited_first(sources: DataFrame, by: str, rank: str, cited: str) -> DataFrame:
    """Adds position: cited sources first, otherwise in rank order."""
    return sources.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(F.when(F.col(cited), 0).otherwise(1), rank)))


def stacked_cards(items: DataFrame, by: str, rank: str, active: int, most: int = 4) -> DataFrame:
    """Up to ``most`` items from the active one on, going round; adds depth."""
    n = F.count("*").over(Window.partitionBy(by))
    return items.withColumn("depth", F.pmod(F.col(rank) - 1 - active, n)).filter(F.col("depth") < most)
