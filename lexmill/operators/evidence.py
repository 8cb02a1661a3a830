"""Merging of result lists, choice of documents and chunks, stance of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.functions.text import section_bucket, strip

_REFS = "chunk_refs: array<string>"
#: Fields of a piece of evidence as a model writes it.
EVIDENCE = (
    "doc_index int, doc_id string, title string, research_focus string, methodology string, sample string, "
    f"key_findings array<struct<claim: string, evidence: string, {_REFS}>>, statistics array<struct<value: string, context: string, {_REFS}>>, "
    "limitations array<string>, implications array<string>, evidence_quality string, stance string, notes string"
)
# Fixed value: what stands for a field that the model left out.
NOT_TOLD = "غير مذكور"
STANCES = ("support", "contrast", "mixed", "neutral")


def merge_queries(results: DataFrame, most: int) -> DataFrame:
    """Results of several sub-queries of a parent query: the best row of each chunk, then the ``most`` best chunks."""
    key = F.coalesce(F.nullif("chunk_id", F.lit("")), F.concat_ws(":", "doc_id", "section"))
    best = Window.partitionBy("parent_id", "merge_key").orderBy(F.desc("score"), F.asc("sub_id"))
    rows = results.withColumn("merge_key", key).withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")
    order = Window.partitionBy("parent_id").orderBy(F.desc("score"), F.asc("merge_key"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def best_sources(results: DataFrame) -> DataFrame:
    """The best row of each document, documents by score."""
    first = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), F.asc("rank"))
    rows = results.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    return rows.withColumn("source_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"))))


def rank_documents(results: DataFrame, seeds: DataFrame | None, most: int) -> DataFrame:
    """Documents by 0.55 best score, 0.25 mean of the three best, 0.15 spread over sections, 0.05 for seeds; with their best chunk."""
    in_doc = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    rows = results.withColumn("k", F.row_number().over(in_doc)).withColumn("bucket", section_bucket("section"))
    docs = rows.groupBy("query_id", "doc_id").agg(
        F.max("score").alias("top"),
        F.avg(F.when(F.col("k") <= 3, F.col("score"))).alias("mean3"),
        F.least(F.count_distinct("bucket"), F.lit(4)).alias("n_buckets"),
        F.min_by("chunk_id", "k").alias("best_chunk"),
    )
    if seeds is not None:
        docs = docs.join(seeds.select("query_id", "doc_id").distinct().withColumn("seed", F.lit(1.0)), ["query_id", "doc_id"], "left")
    else:
        docs = docs.withColumn("seed", F.lit(0.0))
    total = 0.55 * F.col("top") + 0.25 * F.col("mean3") + 0.15 * F.col("n_buckets") / 4 + 0.05 * F.coalesce("seed", F.lit(0.0))
    docs = docs.withColumn("aggregate", F.round(total, 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("aggregate"), F.asc("doc_id"))
    return docs.withColumn("doc_rank", F.row_number().over(order)).filter(F.col("doc_rank") <= most).select("query_id", "doc_id", "best_chunk", "aggregate", "doc_rank")


def diverse_chunks(results: DataFrame, limit: int) -> DataFrame:
    """Per query and document: the preferred chunk, the best of each section kind not yet there in a fixed order, then the best others."""
    kinds = F.array(*[F.lit(b) for b in P.BUCKET_ORDER])
    rows = results.withColumn("bucket", section_bucket("section")).withColumn("priority", F.array_position(kinds, F.col("bucket")))
    doc = Window.partitionBy("query_id", "doc_id")
    rows = rows.withColumn("preferred_bucket", F.max(F.when(F.col("preferred"), F.col("bucket"))).over(doc))
    per_kind = Window.partitionBy("query_id", "doc_id", "bucket").orderBy(F.desc("score"), F.asc("chunk_id"))
    rows = rows.withColumn("in_kind", F.row_number().over(per_kind))
    first = (F.col("in_kind") == 1) & ~F.coalesce(F.col("bucket") == F.col("preferred_bucket"), F.lit(False))
    group = F.when(F.col("preferred"), 0).when(first, 1).otherwise(2)
    rows = rows.withColumn("grp", group)
    order = doc.orderBy("grp", F.when(F.col("grp") == 1, F.col("priority")).otherwise(0), F.desc("score"), F.asc("chunk_id"))
    return rows.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= limit).drop("preferred_bucket", "in_kind", "grp", "priority")


def bare_json(text: Column | str) -> Column:
    """Model output without the code fence around it."""
    inner = F.regexp_replace(F.regexp_replace(strip(text), "^`+", ""), "`+$", "")
    return F.when(strip(text).startswith("```"), strip(F.regexp_replace(inner, "^(?i)json", ""))).otherwise(strip(text))


def parse_evidence(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """Model output (with doc_index, doc_id, title of the document it is about) as evidence rows: broken JSON and fields left out as defaults, unknown stances as neutral."""
    rows = raw.withColumn("e", F.from_json(bare_json(text_col), EVIDENCE))
    told = ["research_focus", "methodology", "sample"]
    lists = ["key_findings", "statistics", "limitations", "implications"]
    kinds = rows.schema["e"].dataType
    return rows.select(
        *[F.coalesce(f"e.{c}", F.col(c)).alias(c) for c in ("doc_index", "doc_id", "title")],
        *[F.coalesce(f"e.{c}", F.lit(NOT_TOLD)).alias(c) for c in told],
        *[F.coalesce(f"e.{c}", F.array().cast(kinds[c].dataType)).alias(c) for c in lists],
        F.coalesce("e.evidence_quality", F.lit("medium")).alias("evidence_quality"),
        F.when(F.col("e.stance").isin(*STANCES), F.col("e.stance")).otherwise("neutral").alias("stance"),
        F.coalesce("e.notes", F.lit("")).alias("notes"),
    )


def evidence_totals(evidence: DataFrame) -> DataFrame:
    """How many documents, findings and statistics the evidence has."""
    size = lambda c: F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0))), F.lit(0))
    return evidence.agg(F.count("*").alias("n_documents"), size("key_findings").alias("n_findings"), size("statistics").alias("n_statistics"))


def stance_meter(evidence: DataFrame, by: str) -> DataFrame:
    """Counts of stances and a verdict."""
    stance = F.when(F.col("stance").isin(*STANCES), F.col("stance")).otherwise("neutral")
    counts = evidence.withColumn("stance", stance).groupBy(by).agg(*[F.count_if(F.col("stance") == s).alias(f"n_{s}") for s in STANCES])
    pro, con = F.col("n_support"), F.col("n_contrast")
    verdict = F.when((pro == 0) & (con == 0) & (F.col("n_mixed") == 0), "descriptive").when((pro > 0) & (pro >= 2 * con), "support").when((con > 0) & (con >= 2 * pro), "oppose").otherwise("conflicting")
    total = F.greatest(sum((F.col(f"n_{x}") for x in STANCES[1:]), F.col(f"n_{STANCES[0]}")), F.lit(1))
    return counts.withColumn("verdict", verdict).withColumns({f"share_{x}": F.round(F.col(f"n_{x}") / total * 100, 4) for x in STANCES})
