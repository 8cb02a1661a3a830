"""Evidence for a synthesis: seeds, their canonical chunks, documents, diverse chunks of each, and the prompts made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.display import source_block
from lexmill.functions.text import strip
from lexmill.operators import evidence
from lexmill.operators.retrieval import small

FAST_SEEDS = 10
_FROM_CANON = ("text", "section", "title", "chunk_index", "char_len")
_TEXTS = ("chunk_id", "doc_id", "text", "title", "section", "journal_id")


def safe_text(c: Column | str, most: int | None = None) -> Column:
    """Text, stripped, empty for null; with a bound, cut there with a mark."""
    s = F.coalesce(strip(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")), F.lit(""))
    return s if most is None else F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def as_sources(rows: DataFrame) -> DataFrame:
    """Rows with the fields of a source: texts stripped, numbers 0 where they are null or none."""
    number = {"score": "double", "chunk_index": "int", "char_len": "int"}
    other = [c for c in rows.columns if c not in _TEXTS and c not in number]
    return rows.select(*other, *[safe_text(c).alias(c) for c in _TEXTS], *[F.coalesce(F.col(c).try_cast(t), F.lit(0).cast(t)).alias(c) for c, t in number.items()])


def rehydrated(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """Seeds (query_id, chunk_id, …) with text, section, title, place and length of the index's chunk where it is there, in their own order."""
    canon = chunks.select("chunk_id", *[F.col(c).alias(f"canon_{c}") for c in _FROM_CANON], F.lit(True).alias("found"))
    rows = seeds.join(canon, "chunk_id", "left")
    return rows.select(*[F.when(F.col("found"), F.col(f"canon_{c}")).otherwise(F.col(c)).alias(c) if c in _FROM_CANON else F.col(c) for c in seeds.columns])


def seed_documents(seeds: DataFrame, most: int) -> DataFrame:
    """The first seed of each document in rank order, ``most`` documents a query; blank ids are passed over."""
    rows = seeds.filter(safe_text("doc_id") != "")
    first = Window.partitionBy("query_id", safe_text("doc_id")).orderBy("rank")
    rows = rows.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    return rows.withColumn("seed_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("seed_rank") <= most)


def document_limits(max_documents: int, n_seeds: int) -> tuple[int, int]:
    """Candidates and prefetch of the search for documents."""
    n = max(8 * max_documents, 4 * n_seeds, 16)
    return n, 3 * n


def chunk_limits(per_document: int) -> tuple[int, int]:
    """Candidates and prefetch of the search within a document."""
    n = max(4 * per_document, per_document + 4)
    return n, 3 * n


def with_missing_seeds(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """Candidates, and seeds whose chunk isn't among their query's."""
    return candidates.unionByName(seeds.select(*candidates.columns).join(candidates.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select(*candidates.columns))


def unique_chunks(sources: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """The first row of each chunk in rank order; blank ids go."""
    first = Window.partitionBy(*by, "chunk_id").orderBy(rank)
    return sources.filter(safe_text("chunk_id") != "").withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")


def choose_documents(candidates: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """Documents for an advanced synthesis by evidence.rank_documents(); a query without any has its seed documents."""
    ranked = evidence.rank_documents(with_missing_seeds(candidates, seeds), seeds, most).select("query_id", "doc_id", F.col("best_chunk").alias("chunk_id"), F.col("doc_rank"))
    none = seed_documents(seeds.join(ranked.select("query_id").distinct(), "query_id", "left_anti"), most)
    return ranked.unionByName(none.select("query_id", "doc_id", "chunk_id", F.col("seed_rank").alias("doc_rank")))


def document_evidence(documents: DataFrame, found: DataFrame, chunks: DataFrame, per_document: int) -> DataFrame:
    """Diverse chunks of each chosen document (query_id, doc_id, chunk_id): of those ``found`` in it, with the document's own best chunk first if the search has missed it."""
    exact = documents.select("query_id", "doc_id", "chunk_id")
    fields = [c for c in found.columns if c not in ("query_id", "rank", "score")]
    missing = exact.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id")
    added = small(missing).join(chunks.select(*fields), "chunk_id").withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0))
    rows = unique_chunks(found.unionByName(added.select(*found.columns)), ["query_id", "doc_id"])
    preferred = exact.select("query_id", "doc_id", F.col("chunk_id").alias("exact"))
    rows = rows.join(small(preferred), ["query_id", "doc_id"]).withColumn("preferred", F.col("chunk_id") == F.col("exact")).drop("exact")
    return evidence.diverse_chunks(rows, per_document)


def source_blocks(sources: DataFrame, by: list[str], rank: str) -> DataFrame:
    """The blocks of each key's sources in rank order, as a prompt has them."""
    order = Window.partitionBy(*by).orderBy(rank)
    rows = sources.withColumn("number", F.row_number().over(order))
    block = source_block(F.col("number"), F.col("title"), F.col("section"), F.col("doc_id"), F.col("chunk_id"), F.coalesce("chunk_index", F.lit(0)), F.col("text"))
    got = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("number", block.alias("b")))).alias("x"))
    return got.select(*by, strip(F.array_join(F.transform("x", lambda v: v["b"]), "\n\n")).alias("chunks"))


def fast_prompts(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id and the source part of a fast synthesis: the first ten seeds, rehydrated."""
    first = seeds.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("k") <= FAST_SEEDS).drop("k")
    return source_blocks(rehydrated(first, chunks), ["query_id"], "rank")


def evidence_prompts(picked: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, doc_id, and the source part and head of the prompt about each chosen document (doc_index from its rank, its title, its id)."""
    blocks = source_blocks(picked, ["query_id", "doc_id"], "pick")
    title = F.coalesce(F.nullif(safe_text("title", 80), F.lit("")), F.lit("Unknown"))
    titles = picked.groupBy("query_id", "doc_id").agg(F.min_by("title", "pick").alias("title"))
    rows = blocks.join(titles, ["query_id", "doc_id"]).join(documents.select("query_id", "doc_id", "doc_rank"), ["query_id", "doc_id"])
    head = F.concat(F.lit("معلومات المستند: "), F.col("doc_rank").cast("string"), F.lit(" | "), title, F.lit(" | doc_id="), safe_text("doc_id"))
    return rows.select("query_id", "doc_id", F.col("doc_rank").alias("doc_index"), "chunks", head.alias("head"))
