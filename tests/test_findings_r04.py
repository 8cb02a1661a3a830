"""What the findings of round 4 were about."""

import sys

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.operators import chunking, lines, retrieval


def test_scores_are_rounded_as_sql_does(spark):
    """0.72615 and others are below their decimal text's half when scaled, or above it."""
    values = [k / 1e5 + d for k in range(5, 100_000, 370) for d in (0.0, 1e-16, -1e-16)] + [0.72615, 0.285, 1.005, -0.72615, 2.5e-5, 0.0]
    want = [duckdb.sql(f"SELECT round({v!r}::DOUBLE, 4)").fetchall()[0][0] for v in values]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r["r"] for r in rows.select("k", retrieval.rounded(F.col("v"), 4).alias("r")).orderBy("k").collect()]
    assert got == want
    assert retrieval.rounded_array(np.array(values), 4).tolist() == want
    assert [r["r"] for r in rows.select("k", F.round("v", 4).alias("r")).orderBy("k").collect()] != want


def test_texts_are_written_once_and_compressed(spark, tmp_path):
    """an index leaves no staged tables, and its shuffles go with its queries."""
    from lexmill.operators import search

    rows = spark.createDataFrame([(k, f"word{k % 7} other{k} text " * 50) for k in range(200)], "doc_id long, text string")
    chunks = chunking.chunk_documents(rows).drop("embed_text")
    path = str(tmp_path / "index")
    search.write_index(chunks, path, ann=True)
    names = {p.name for p in (tmp_path / "index").iterdir()}
    assert names == {"chunks", "postings", "idf", "titles", "keywords", "vectors", "ann"}
    assert all(".zstd." in p.name for n in ("chunks", "postings", "vectors") for p in (tmp_path / "index" / n).glob("*.parquet"))
    buckets = [set(r["b"]) for r in spark.read.parquet(f"{path}/postings").groupBy(F.input_file_name()).agg(F.collect_set("bucket").alias("b")).collect()]
    assert sum(map(len, buckets)) == len(set().union(*buckets))  # a bucket is in one file
    assert spark.read.parquet(f"{path}/chunks").count() == chunks.count()


def test_digits_of_all_scripts_are_found(spark):
    """F8: the class that titles are scored by has the same characters as P.DIGIT."""
    rows = spark.range(0x20000).filter("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    both = rows.select(F.col("c").rlike(lines.HAS_DIGIT).alias("a"), F.col("c").rlike(f"[{P.DIGIT}]").alias("b"))
    assert both.filter("a != b").count() == 0
    assert both.filter("a").count() > 500


def test_size_report_makes_chunks_once(spark):
    """F8."""
    docs = spark.createDataFrame([(k, "a sentence of some words. " * (k * 20 + 1)) for k in range(20)], "doc_id long, text string")
    report = chunking.size_report(chunking.chunk_documents(docs))
    assert report._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert report.agg(F.round(F.sum("share"), 2)).first()[0] == 1.0


def test_overview_builds_no_index(spark, monkeypatch):
    """F10."""
    from lexmill.plans import tool_queries

    monkeypatch.setattr(tool_queries, "index_of", None)
    got = tool_queries.corpus_overview(spark, "/root/testdata/sf0.001").collect()
    assert [tuple(r) for r in got] == [(200, 200, "ar")]


def test_ways_to_the_root_are_not_broadcast(spark):
    """files of ways are far smaller than the ways in memory, so Spark took them for small tables."""
    from lexmill.llm import merkle

    rows = spark.range(3000).select(F.col("id"), F.lit("g").alias("source"))
    got = merkle.manifest(rows, "id", "source", merkle.row_digest([F.col("id")]))
    joins = [line for line in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [g#" in line and ", p#" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
    assert got.filter(merkle.fold_up(F.col("leaf"), F.col("way")) == F.col("root")).count() == 3000


def test_boxes_are_made_within_rows(spark):
    """the boxes are those that words one by one come to, and no word goes through a shuffle."""
    from lexmill.plans import page_queries as Q
    from lexmill.sources import articles

    got = Q.citation_boxes(spark, "/root/testdata/sf0.001")
    assert "pageNumber" not in "".join(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line or "Aggregate" in line or "Window" in line)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = articles.page_words(Q.laid_out(docs)).join(Q.found_words(docs).withColumn("hit", F.lit(True)), ["doc_id", "word_index"], "left").withColumn("matched", F.col("hit").isNotNull())
    want = articles.highlight_regions(words).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_lines_are_ranked_once_for_evidence(spark):
    """F12."""
    from lexmill.plans import tool_queries

    got = tool_queries.advanced_evidence(spark, "/root/testdata/sf0.001")
    assert not any("documents" in f for f in got.inputFiles())
    assert got.count() > 0
