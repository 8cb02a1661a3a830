"""A corpus pipeline of five stages: toxicity, line deduplication, near-duplicate documents, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of ``documents``. What a stage keeps in the shared folder goes when the next one starts, as
its result has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from lexmill.llm.common import collected, join_small, keep, new_path, remove_all, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_kept: list[tuple[SparkSession, str]] = []


def _stage(fn: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_all(_kept)
        with collected(_kept):
            return fn(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = fn.__name__, fn.__doc__
    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    # a row goes along as one column, so that none of its names can clash with the score's
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"))
    kept = toxicity.score_toxicity(rows, model, carry=["row"]).filter("predicted = 0")
    return kept.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, nearly or exactly, an earlier one go; so do documents of which no line is left."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0), *others).alias("row"))
    cleaned = line_dedup.fuzzy_line_dedup(rows, carry=["row"]).filter("n_dropped = 0 OR trim(text) != ''").withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.select(*[F.col(f"row.`{c}`") if c in others else F.col(c) for c in docs.columns])


@_stage
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays; a null id is never in another's way."""
    groups = keep(ngram_join.ngram_groups(docs), "groups")
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    left = join_small(docs, keep(gone, "gone"), "doc_id", "left_anti")
    # rows that repeat an id are one document where they are linked
    again = groups.filter("n_shingles > 0").groupBy("doc_id", "component_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    again = keep(again.distinct(), "again")
    if not again.limit(1).count():
        return left
    return join_small(left, again, "doc_id", "left_anti").unionByName(join_small(left, again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


@_stage
def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = table(spark, sf_dir, "benchmark")
    # rows without an id are judged as well, by what they say
    named = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256))))
    found = decontaminate.find_contaminated(named, benchmark, id_col="__key")
    return join_small(named, keep(found.select("__key").distinct(), "found"), "__key", "left_anti").drop("__key")


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed: a row per piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: The stages learn, hash and tokenise, which SQL can't express; tests/llm compares them with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
